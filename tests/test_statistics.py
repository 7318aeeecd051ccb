"""Statistics: golden values, one-day edge cases, closed-form Student t."""

import math

from pyspark.sql import functions as F

from encore.functions.student_t import t_cdf, t_ppf, t_sf_two_sided
from encore.operators import statistics as S

from conftest import ts


def _values(spark, xs):
    return spark.createDataFrame([(float(x),) for x in xs], "x double")


def test_quantiles_linear(spark):
    r = S.describe(_values(spark, [1, 2, 3, 10])).first()
    assert (r["p25"], r["p50"], r["p75"], round(r["p90"], 9)) == (1.75, 2.5, 4.75, 7.9)
    assert r["median"] == 2.5 and r["mean"] == 4.0


def test_one_value(spark, make_plays):
    r = S.describe(_values(spark, [3.0])).first()
    assert r["variance"] == 0.0 and r["std_dev"] == 0.0
    assert S.confidence_interval(_values(spark, [3.0])) is None
    assert S.describe(_values(spark, []).where(F.lit(False))).count() == 0
    p = make_plays([{"ts": ts("2024-01-01 10:00:00"), "ms_played": 60000.0}], sessions=False)
    z = S.zscores(S.daily_values(p)).first()
    assert z["zscore"] == 0.0
    assert S.weekend_test(p) == {"status": "insufficient_data"}


def test_student_t_closed_form():
    assert abs(t_ppf(0.975, 29) - 2.045230) < 1e-6
    assert abs(t_ppf(0.975, 1) - 12.706205) < 1e-5
    assert abs(t_ppf(0.975, 1e7) - 1.959964) < 1e-5  # large df -> normal
    assert abs(t_cdf(1.3, 7) + t_cdf(-1.3, 7) - 1.0) < 1e-12  # symmetric
    assert abs(t_sf_two_sided(2.045230, 29) - 0.05) < 1e-6
    assert t_ppf(0.5, 3) == 0.0


def test_confidence_interval(spark):
    xs = [1.0, 2.0, 3.0, 4.0, 10.0]
    lo, hi = S.confidence_interval(_values(spark, xs))
    n, m = len(xs), sum(xs) / len(xs)
    sd = math.sqrt(sum((x - m) ** 2 for x in xs) / (n - 1))
    q = t_ppf(0.975, n - 1)
    assert abs(lo - (m - q * sd / math.sqrt(n))) < 1e-9 and abs(hi - (m + q * sd / math.sqrt(n))) < 1e-9


def test_histogram(spark):
    h = S.histogram(_values(spark, [0, 1, 2, 10])).orderBy("bin").collect()
    assert len(h) == 20 and sum(r["count"] for r in h) == 4
    assert h[-1]["count"] == 1 and h[0]["count"] == 1  # max lands in the last, closed bin
    flat = S.histogram(_values(spark, [5, 5, 5])).collect()
    assert len(flat) == 1 and flat[0]["count"] == 3


def test_zscore_population_std(spark):
    z = {r["x"]: r["zscore"] for r in S.zscores(_values(spark, [1, 2, 3])).collect()}
    assert abs(z[3.0] - 1.224744871) < 1e-8


def test_diversity(spark, make_plays):
    rows = [{"ts": ts(f"2024-01-01 10:0{i}:00"), "master_metadata_album_artist_name": a}
            for i, a in enumerate(["A", "A", "B", "C"])]
    d = S.artist_diversity(make_plays(rows, sessions=False)).first()["diversity_score"]
    assert abs(d - (1 - (0.25 + 0.0625 + 0.0625))) < 1e-12
    empty = make_plays(rows, sessions=False).where(F.lit(False))
    assert S.artist_diversity(empty).first()["diversity_score"] == 0.0


def test_normal_overlay(spark):
    o = S.normal_overlay(_values(spark, [1, 2, 4])).orderBy("i").collect()
    assert len(o) == 300 and o[0]["x"] == 1.0 and o[-1]["x"] == 4.0
    assert S.normal_overlay(_values(spark, [2.0])).count() == 0


def test_per_key_statistics_equal_filtered_runs(spark):
    """``by`` keys: each key's row equals the operator run on that key's plays alone."""
    from encore.sources import curated

    from conftest import SF_SMALL

    p = curated.plays(spark, SF_SMALL)
    keys = [r[0] for r in p.select("platform").distinct().collect()]

    def rows(df, drop=()):
        return sorted(tuple(round(v, 9) if isinstance(v, float) else v for k, v in r.asDict().items()
                            if k not in drop) for r in df.collect())

    checks = [
        (lambda d, by=None: S.daily_stats(d, by=by)),
        (lambda d, by=None: S.ci_moments(S.daily_values(d, by), by=by)),
        (lambda d, by=None: S.anomaly_days(d, 2.0, by=by)),
        (lambda d, by=None: S.weekend_moments(d, by=by)),
        (lambda d, by=None: S.artist_diversity(d, by=by)),
        (lambda d, by=None: S.daily_histogram(d, by=by)),
        (lambda d, by=None: S.daily_normal_overlay(d, by=by)),
    ]
    for f in checks:
        keyed = f(p, ["platform"])
        for k in keys:
            one = keyed.where(F.col("platform") == k)
            assert rows(one, drop=("platform",)) == rows(f(p.where(F.col("platform") == k)))
