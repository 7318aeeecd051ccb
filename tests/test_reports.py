"""Report bundles: shapes, empty selections, the skip model."""

from encore.plans import reports as RP
from encore.sources import curated

from conftest import SF_SMALL


def test_reports_run(spark):
    p = curated.plays(spark, SF_SMALL)
    d = RP.dashboard(p)
    assert d["kpis"]["rows"] == p.count()
    assert d["hourly"].count() <= 24 and d["topArtists"].count() == 10
    o = RP.overview(p)
    assert 0 <= o["highlights"]["mostActiveHour"] <= 23
    t = RP.listening_trends(p)
    assert set(t["stats"]) == {"mean", "median", "variance", "std_dev", "p25", "p50", "p75", "p90"}
    assert RP.time_patterns(p)["heatmap"].count() == 7
    s = RP.statistical_insights(p, threshold=2.5)
    assert s["confidenceInterval"]["lower"] < s["confidenceInterval"]["upper"]
    assert s["hypothesis"]["status"] == "ok" and 0.0 <= s["hypothesis"]["p_value"] <= 1.0
    a = RP.artist_song_analytics(p, top_n=5)
    assert a["rankings"]["topArtists"].count() == 5 and 0.0 <= a["diversityScore"] <= 1.0
    assert RP.behavior_analysis(p)["platformUsage"].count() >= 1


def test_empty_selection(spark):
    p = curated.plays(spark, SF_SMALL)
    d = RP.dashboard(p, start="2100-01-01")
    assert d["kpis"] == {"totalHours": 0.0, "tracksPlayed": 0, "uniqueArtists": 0, "uniqueAlbums": 0,
                         "skipRate": 0.0, "shuffleRate": 0.0, "rows": 0}
    assert d["topArtists"].count() == 0
    assert RP.listening_trends(p, start="2100-01-01")["stats"] == {}
    s = RP.statistical_insights(p, start="2100-01-01")
    assert s["confidenceInterval"] is None and s["hypothesis"] == {"status": "insufficient_data"}
    assert RP.skip_model(p, start="2100-01-01") == {"status": "insufficient_data"}


def test_skip_model(spark):
    p = curated.plays(spark, SF_SMALL)
    r = RP.skip_model(p)
    assert r["status"] == "ok"
    assert 0.0 <= r["accuracy"] <= 1.0 and 0.0 <= r["roc_auc"] <= 1.0
    assert set(r["report"]) == {"0", "1", "accuracy", "macro avg", "weighted avg"}
    assert r["report"]["0"]["support"] + r["report"]["1"]["support"] == r["report"]["accuracy"]["support"]


def test_stratified_split_fractions(spark):
    from pyspark.sql import functions as F

    from encore.operators.skip_model import model_frame, stratified_split

    d = model_frame(curated.plays(spark, SF_SMALL))
    train, test = stratified_split(d)
    for lbl in (0.0, 1.0):
        n_all = d.where(F.col("label") == lbl).count()
        n_test = test.where(F.col("label") == lbl).count()
        assert abs(n_test / n_all - 0.25) < 0.02
    assert train.count() + test.count() == d.count()
    assert train.join(test, "_h", "left_semi").count() == 0  # disjoint


def test_coefficients_equal_a_newton_solve(spark):
    """The fit against numpy: weighted mean log-loss plus lambda / 2 |w|^2, intercept free."""
    import numpy as np
    from pyspark.ml.functions import vector_to_array
    from pyspark.sql import functions as F

    from encore.operators.skip_model import model_frame, stratified_split, train_skip_model

    p = curated.plays(spark, SF_SMALL)
    r = train_skip_model(p)
    train, _ = stratified_split(model_frame(p))
    rows = r.model.transform(train.withColumn("_w", F.lit(1.0))).select(vector_to_array("features").alias("x"), "label").collect()
    x = np.array([row["x"] for row in rows])
    y = np.array([row["label"] for row in rows])
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    x1 = np.hstack([x, np.ones((len(x), 1))])
    ridge = np.full(x1.shape[1], 1.0)
    ridge[-1] = 0.0
    w = np.zeros(x1.shape[1])
    for _ in range(50):
        q = 1 / (1 + np.exp(-x1 @ w))
        grad = x1.T @ (weight * (q - y)) + ridge * w
        hess = (x1 * (weight * q * (1 - q))[:, None]).T @ x1 + np.diag(ridge)
        w -= np.linalg.lstsq(hess, grad, rcond=None)[0]
    got = np.append(r.model.coefficients, r.model.intercept)
    assert np.abs(got - w).max() < 1e-8


def test_wide_features_go_to_the_same_minimum(spark, monkeypatch):
    """Beyond the Newton width MLlib's solver fits the same loss."""
    import numpy as np

    from encore.operators import skip_model as M

    p = curated.plays(spark, SF_SMALL)
    newton = M.train_skip_model(p).model
    monkeypatch.setattr(M, "NEWTON_WIDTH", 0)
    wide = M.train_skip_model(p).model
    assert np.abs(newton.coefficients - wide.coefficients).max() < 1e-4
    assert len(newton.feature_names()) == len(newton.coefficients)


def test_newton_on_separable_rows_and_unscaled_features(spark):
    """Steps that would overshoot are halved; the gradient vanishes at the end."""
    import numpy as np

    from encore.operators.skip_model import newton_fit

    x = [[float(i), 1000.0 * (i % 3)] for i in range(60)]
    rows = [(v, float(v[0] >= 30), 1.0) for v in x]
    coefficients, intercept = newton_fit(spark.createDataFrame(rows, "x array<double>, label double, _w double").repartition(5), 2, 1 / 60)
    a = np.hstack([np.array(x), np.ones((60, 1))])
    y = np.array([r[1] for r in rows])
    w = np.append(coefficients, intercept)
    grad = a.T @ (1 / (1 + np.exp(-a @ w)) - y) / 60 + np.append(coefficients, 0.0) / 60
    assert np.abs(grad).max() < 1e-8
