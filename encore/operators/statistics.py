"""Statistics over the daily series (A20-A24, W4, F11, P22) and the artist diversity score.

The heavy part (daily sums, moments, counts) runs on Spark; the daily series has one row
per calendar day, so exact percentiles and the 300-point overlay work on a bounded table.
Only a final scalar (Student-t quantile / tail) is evaluated on the driver.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from encore.functions.columns import count_rows
from encore.functions.student_t import t_interval, t_sf_two_sided
from encore.operators.trends import daily_ms
from encore.schema import ARTIST, HISTOGRAM_BINS, MS_PER_HOUR, MS_PER_MINUTE, OVERLAY_POINTS

_QS = [0.25, 0.5, 0.75, 0.9]


Keys = list[str] | None


def _k(by: Keys) -> list[str]:
    return list(by or [])


def _whole(by: Keys) -> Window:
    """The whole (bounded, per-day) series, or each key's series."""
    return Window.partitionBy(*_k(by))


def daily_values(plays: DataFrame, by: Keys = None) -> DataFrame:
    """``[by...], date, x`` where x is daily listening hours (per ``by`` key, e.g. a listener)."""
    return daily_ms(plays, by=_k(by)).select(*_k(by), "date", (F.col("day_ms") / F.lit(MS_PER_HOUR)).alias("x"))


def describe(values: DataFrame, col: str = "x", by: Keys = None) -> DataFrame:
    """mean, median, variance, std_dev (n-1; 0.0 for one value), p25/p50/p75/p90 (linear).

    No row for an empty input. With ``by`` keys, one row per key.
    """
    q = F.percentile(F.col(col), _QS)
    agg = values.where(F.col(col).isNotNull()).groupBy(*_k(by)).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(col).alias("mean"),
        q.alias("_q"),
        F.var_samp(col).alias("_var"),
        F.stddev_samp(col).alias("_std"),
    )
    one = F.col("n") == 1
    return agg.where(F.col("n") > 0).select(
        *_k(by),
        F.col("n").cast("long").alias("n"),
        "mean",
        F.col("_q")[1].alias("median"),
        F.when(one, F.lit(0.0)).otherwise(F.col("_var")).alias("variance"),
        F.when(one, F.lit(0.0)).otherwise(F.col("_std")).alias("std_dev"),
        F.col("_q")[0].alias("p25"),
        F.col("_q")[1].alias("p50"),
        F.col("_q")[2].alias("p75"),
        F.col("_q")[3].alias("p90"),
    )


def daily_stats(plays: DataFrame, by: Keys = None) -> DataFrame:
    return describe(daily_values(plays, by), by=by)


def ci_moments(values: DataFrame, col: str = "x", by: Keys = None) -> DataFrame:
    """n, mean and standard error of the mean (one row, or one per key)."""
    return values.where(F.col(col).isNotNull()).groupBy(*_k(by)).agg(
        F.count(F.lit(1)).cast("long").alias("n"),
        F.avg(col).alias("mean"),
        (F.stddev_samp(col) / F.sqrt(F.count(F.lit(1)))).alias("std_err"),
    )


def confidence_interval(values: DataFrame, col: str = "x", confidence: float = 0.95) -> tuple[float, float] | None:
    """t interval of the mean; fewer than two values -> None."""
    row = ci_moments(values, col).first()
    if row is None or row["n"] < 2:
        return None
    return t_interval(confidence, row["n"] - 1, row["mean"], row["std_err"] or 0.0)


def daily_ci(plays: DataFrame, confidence: float = 0.95, by: Keys = None) -> DataFrame:
    """``[by...], n, mean, lower, upper``: the t interval of mean daily hours (NULL bounds for fewer
    than two days). The quantile is computed on the aggregated rows, one per key."""
    m = ci_moments(daily_values(plays, by), by=by)

    @F.pandas_udf("double")
    def half_width(n: pd.Series, std_err: pd.Series) -> pd.Series:
        return pd.Series([None if k < 2 else t_interval(confidence, k - 1, 0.0, e or 0.0)[1] for k, e in zip(n, std_err)],
                         dtype="float64")

    half = half_width("n", F.coalesce("std_err", F.lit(0.0)))
    return m.where(F.col("n") > 0).withColumn("_h", half).select(
        *_k(by), "n", "mean", (F.col("mean") - F.col("_h")).alias("lower"), (F.col("mean") + F.col("_h")).alias("upper")
    )


def zscores(values: DataFrame, col: str = "x", by: Keys = None) -> DataFrame:
    """Adds ``zscore`` = (x - mean) / population std; zero spread -> 0.0.

    ``values`` is a per-day series (one row per calendar day, a bounded table): the moments
    are whole-series windows over it (per ``by`` key), so the series is computed once."""
    whole = _whole(by)
    z = (F.col(col) - F.avg(col).over(whole)) / F.nullif(F.stddev_pop(col).over(whole), F.lit(0.0))
    return values.withColumn("zscore", F.coalesce(z, F.lit(0.0)))


def anomaly_days(plays: DataFrame, threshold: float = 2.5, by: Keys = None) -> DataFrame:
    """Days whose |z| >= threshold (threshold must be in [1, 5]), highest z first."""
    if not 1.0 <= float(threshold) <= 5.0:
        raise ValueError("threshold must be between 1 and 5")
    z = zscores(daily_values(plays, by), by=by)
    return (
        z.where(F.abs(F.col("zscore")) >= F.lit(float(threshold)))
        .select(*_k(by), "date", F.col("x").alias("play_hours"), "zscore")
        .orderBy(F.col("zscore").desc(), F.col("date").asc())
    )


def weekend_moments(plays: DataFrame, by: Keys = None) -> DataFrame:
    """Welch t statistic and degrees of freedom, weekday vs weekend daily minutes (one row).

    ``status`` is ``insufficient_data`` when either side has fewer than two days; the t
    statistic is NULL when both variances are zero.
    """
    day = daily_ms(plays, by=_k(by)).select(
        *_k(by), (F.col("day_ms") / F.lit(MS_PER_MINUTE)).alias("m"), (F.weekday("date") >= 5).alias("we")
    )
    a = day.groupBy(*_k(by)).agg(
        F.count_if(~F.col("we")).cast("long").alias("n1"),
        F.count_if(F.col("we")).cast("long").alias("n2"),
        F.avg(F.when(~F.col("we"), F.col("m"))).alias("weekday_mean"),
        F.avg(F.when(F.col("we"), F.col("m"))).alias("weekend_mean"),
        F.var_samp(F.when(~F.col("we"), F.col("m"))).alias("v1"),
        F.var_samp(F.when(F.col("we"), F.col("m"))).alias("v2"),
    )
    se2 = F.col("v1") / F.col("n1") + F.col("v2") / F.col("n2")
    ok = (F.col("n1") >= 2) & (F.col("n2") >= 2)
    dof = F.pow(se2, 2) / (
        F.pow(F.col("v1") / F.col("n1"), 2) / (F.col("n1") - 1) + F.pow(F.col("v2") / F.col("n2"), 2) / (F.col("n2") - 1)
    )
    return a.select(
        *_k(by),
        F.when(ok, F.lit("ok")).otherwise(F.lit("insufficient_data")).alias("status"),
        F.col("n1").alias("weekday_days"),
        F.col("n2").alias("weekend_days"),
        F.when(ok, F.col("weekday_mean")).alias("weekday_mean"),
        F.when(ok, F.col("weekend_mean")).alias("weekend_mean"),
        F.when(ok & (se2 > 0), (F.col("weekday_mean") - F.col("weekend_mean")) / F.sqrt(se2)).alias("t_stat"),
        F.when(ok & (se2 > 0), dof).alias("dof"),
    )


def weekend_p(plays: DataFrame, by: Keys = None) -> DataFrame:
    """``weekend_moments`` with the two-sided ``p_value`` (NULL without a t statistic), computed on the
    aggregated rows, one per key."""

    @F.pandas_udf("double")
    def tail(t: pd.Series, dof: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(x) else t_sf_two_sided(x, d) for x, d in zip(t, dof)], dtype="float64")

    return weekend_moments(plays, by).withColumn("p_value", tail("t_stat", "dof"))


def weekend_test(plays: DataFrame) -> dict:
    """The hypothesis result as a dict, with the two-sided p-value."""
    r = weekend_moments(plays).first()
    if r is None or r["status"] != "ok":
        return {"status": "insufficient_data"}
    t, dof = r["t_stat"], r["dof"]
    p = None if t is None else t_sf_two_sided(t, dof)
    return {
        "status": "ok",
        "weekday_mean": r["weekday_mean"],
        "weekend_mean": r["weekend_mean"],
        "t_stat": t,
        "p_value": p,
    }


def artist_diversity(df: DataFrame, by: Keys = None) -> DataFrame:
    """Simpson index 1 - sum(p^2) over artist shares; 0.0 for an empty input (one row, or one
    per key)."""
    counts = df.groupBy(*_k(by), ARTIST).agg(count_rows(df).cast("double").alias("c"))
    a = counts.groupBy(*_k(by)).agg(F.sum(F.col("c") * F.col("c")).alias("s2"), F.sum("c").alias("s1"))
    return a.select(
        *_k(by),
        F.when(F.col("s1") > 0, F.lit(1.0) - F.col("s2") / (F.col("s1") * F.col("s1"))).otherwise(F.lit(0.0))
        .alias("diversity_score")
    )


def histogram(values: DataFrame, col: str = "x", bins: int = HISTOGRAM_BINS, by: Keys = None) -> DataFrame:
    """Equal-width bins over [min, max], last bin closed, all bins listed (zero counts too).

    All values equal -> one bin holding every value. ``density`` = count / (n * width).
    ``values`` is a bounded per-day series: min/max/count are whole-table windows over it,
    then one pass counts per bin and each bin emits the empty bins before the next one.
    """
    keys = _k(by)
    whole = _whole(by)
    v = values.where(F.col(col).isNotNull()).select(
        *keys, F.col(col).alias("x"), F.min(col).over(whole).alias("lo"), F.max(col).over(whole).alias("hi"),
        F.count(F.lit(1)).over(whole).alias("n"),
    )
    step = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    flat = F.col("hi") == F.col("lo")
    idx = F.when(flat, F.lit(0)).otherwise(F.least(F.floor((F.col("x") - F.col("lo")) / step), F.lit(bins - 1)))
    counts = v.groupBy(*keys, idx.cast("int").alias("bin")).agg(
        F.count(F.lit(1)).cast("long").alias("_c"), F.first("lo").alias("lo"), F.first("hi").alias("hi"),
        F.first("n").alias("n"),
    )
    by_bin = whole.orderBy("bin")
    nxt = counts.withColumn("_next", F.lead("bin").over(by_bin))
    last = F.when(F.col("hi") == F.col("lo"), F.lit(0)).otherwise(F.lit(bins - 1))
    # bins before the first present one, and between present ones, are empty
    first_pad = F.when(F.lag("bin").over(by_bin).isNull(), F.col("bin")).otherwise(F.lit(0))
    filled = nxt.withColumn("_pad", first_pad).select(
        *keys, "_c", "lo", "hi", "n", "bin",
        F.explode(F.sequence(
            F.col("bin") - F.col("_pad"),
            F.coalesce(F.col("_next") - 1, last),
        )).alias("b"),
    )
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    cnt = F.when(F.col("b") == F.col("bin"), F.col("_c")).otherwise(F.lit(0)).cast("long")
    return filled.select(
        *keys,
        F.col("b").alias("bin"),
        F.when(flat, F.col("lo")).otherwise(F.col("lo") + F.col("b") * width).alias("range_start"),
        F.when(flat, F.col("hi")).otherwise(F.col("lo") + F.col("b") * width + width).alias("range_end"),
        cnt.alias("count"),
        F.when(flat, F.lit(None).cast("double")).otherwise(cnt / (F.col("n") * width)).alias("density"),
    )


def daily_histogram(plays: DataFrame, by: Keys = None) -> DataFrame:
    return histogram(daily_values(plays, by), by=by)


def normal_overlay(values: DataFrame, col: str = "x", points: int = OVERLAY_POINTS, by: Keys = None) -> DataFrame:
    """Normal density (sample std) on ``points`` evenly spaced values over [min, max].

    Needs more than one value; none when the spread is zero.
    """
    m = values.where(F.col(col).isNotNull()).groupBy(*_k(by)).agg(
        F.min(col).alias("lo"), F.max(col).alias("hi"), F.avg(col).alias("mu"),
        F.stddev_samp(col).alias("sd"), F.count(F.lit(1)).alias("n"),
    )
    step = (F.col("hi") - F.col("lo")) / F.lit(float(points - 1))
    pts = m.where((F.col("n") > 1) & (F.col("sd") > 0)).select(
        *_k(by), F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"), "lo", "hi", "mu", "sd"
    )
    x = F.when(F.col("i") == points - 1, F.col("hi")).otherwise(F.col("lo") + F.col("i") * step)
    pts = pts.withColumn("x", x)
    pdf = F.exp(-F.pow(F.col("x") - F.col("mu"), 2) / (F.lit(2.0) * F.pow(F.col("sd"), 2))) / (
        F.col("sd") * F.lit(math.sqrt(2.0 * math.pi))
    )
    return pts.select(*_k(by), F.col("i").cast("int").alias("i"), "x", pdf.alias("density"))


def daily_normal_overlay(plays: DataFrame, by: Keys = None) -> DataFrame:
    return normal_overlay(daily_values(plays, by), by=by)
