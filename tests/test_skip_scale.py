"""The skip model's tasks read bounded pieces of the log, whatever its size."""

import datetime as dt

from encore import session
from encore.operators import skip_model as M

from conftest import raw_rows


def test_training_reads_small_pieces(spark, tmp_path, monkeypatch):
    """Before, a task held and read again at every step the vectors of a whole 128 MB split."""
    from encore.operators.prepare import prepare_plays

    start = dt.datetime(2024, 1, 1)
    rows = [{"ts": start + dt.timedelta(seconds=61 * i), "ms_played": 1000.0 * (i % 97), "master_metadata_track_name": f"t{i * 7919 % 5003}",
             "platform": f"p{i % 3}", "skipped": i % 5 < 2} for i in range(4000)]
    path = str(tmp_path / "plays")
    prepare_plays(raw_rows(spark, rows), with_sessions=False).repartition(2).write.option("parquet.block.size", 16_000).parquet(path)
    seen, fit = [], M.newton_fit

    def look(vectors, width, ridge):
        seen.append(vectors.rdd.getNumPartitions())
        return fit(vectors, width, ridge)

    monkeypatch.setattr(M, "newton_fit", look)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    monkeypatch.setattr(session, "SPLIT_BYTES", 10_000)
    small = M.train_skip_model(spark.read.parquet(path))
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == old
    monkeypatch.setattr(session, "SPLIT_BYTES", 128 << 20)
    large = M.train_skip_model(spark.read.parquet(path))
    assert seen[0] > 4 * seen[1]
    assert abs(small.model.coefficients - large.model.coefficients).max() < 1e-9
    assert (small.n_train, small.n_test) == (large.n_train, large.n_test) and small.n_train + small.n_test == 4000
    assert small.scored.count() == small.n_test


def test_training_keeps_no_rows_in_memory(spark, make_plays, monkeypatch):
    """Before, the cached rows and vectors of the log took up the executors' heap, however large."""
    start = dt.datetime(2024, 1, 1)
    plays = make_plays([{"ts": start + dt.timedelta(seconds=61 * i), "ms_played": 1000.0 * (i % 97), "master_metadata_track_name": f"t{i}",
                         "platform": f"p{i % 3}", "skipped": i % 5 < 2} for i in range(600)], sessions=False)
    kept, fit = [], M.newton_fit

    def look(vectors, width, ridge):
        out = fit(vectors, width, ridge)
        kept.extend((r.memSize(), r.diskSize()) for r in spark.sparkContext._jsc.sc().getRDDStorageInfo())
        return out

    monkeypatch.setattr(M, "newton_fit", look)
    spark.catalog.clearCache()
    assert M.train_skip_model(plays).status == "ok"
    assert len(kept) >= 2 and all(m == 0 and d > 0 for m, d in kept)


def test_metrics_equal_the_evaluator(spark):
    """Over many ranges of scores with ties, and without rows of one class or both."""
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    ev = BinaryClassificationEvaluator(rawPredictionCol="probability", labelCol="label", metricName="areaUnderROC", numBins=0)
    rows = [(float(i * 7 % 5 < 2), float(i % 3 == 0), (i * 7919 % 211) / 211) for i in range(2000)]
    for some in (rows, rows[:1], [r for r in rows if r[0] == 1], [r for r in rows if r[0] == 0], []):
        df = spark.createDataFrame(some, "label double, prediction double, probability double").repartition(4)
        m = M.metrics(df).first()
        assert abs(m["roc_auc"] - ev.evaluate(df)) < 1e-12
        assert m["n_test"] == len(some)
        assert m["accuracy"] == (sum(a == b for a, b, _ in some) / len(some) if some else None)
    df = spark.createDataFrame(rows, "label double, prediction double, probability double")
    aqe = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # one range for each task
    try:
        assert abs(M.metrics(df).first()["roc_auc"] - ev.evaluate(df)) < 1e-12
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", aqe)


def test_report_keeps_no_scores_in_memory(spark, make_plays, monkeypatch):
    """Before, the cached scores of the report's test rows stayed in the executors' heap."""
    from encore.plans.registry import q_reports

    start = dt.datetime(2024, 1, 1)
    plays = make_plays([{"ts": start + dt.timedelta(seconds=61 * i), "ms_played": 1000.0 * (i % 97), "master_metadata_track_name": f"t{i}",
                         "skipped": i % 5 < 2} for i in range(600)], sessions=False)
    kept, report = [], M.classification_report

    def look(scored):
        kept.extend((r.memSize(), r.diskSize()) for r in spark.sparkContext._jsc.sc().getRDDStorageInfo())
        return report(scored)

    monkeypatch.setattr(M, "classification_report", look)
    spark.catalog.clearCache()
    r = q_reports.RP.skip_model(plays)
    assert r["status"] == "ok" and sum(r["report"][k]["support"] for k in "01") == r["report"]["accuracy"]["support"]
    assert kept and all(m == 0 and d > 0 for m, d in kept)
