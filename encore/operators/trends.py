"""Daily series, rolling/cumulative windows and gap-filled calendar bins.

Every window here runs over the *daily aggregate* (one row per date, bounded by the calendar
span), never over the raw log, so the un-partitioned ``orderBy(date)`` window sorts a few
thousand rows. Sums are kept in whole milliseconds until the final division, which makes
them independent of partitioning and addition order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from encore.functions.columns import month_end, week_end_sunday, year_end
from encore.schema import MS_PER_HOUR


def daily_ms(plays: DataFrame, value: str = "ms_played", by: list[str] | None = None) -> DataFrame:
    """One row per date present (per ``by`` key): ``[by...], date, day_ms``."""
    return plays.groupBy(*(by or []), "date").agg(F.coalesce(F.sum(value), F.lit(0.0)).alias("day_ms"))


def daily_hours(plays: DataFrame, by: list[str] | None = None) -> DataFrame:
    return daily_ms(plays, by=by).select(*(by or []), "date", (F.col("day_ms") / F.lit(MS_PER_HOUR)).alias("play_hours"))


def daily_trend(plays: DataFrame, window_days: int = 7, by: list[str] | None = None) -> DataFrame:
    """``[by...], date, play_hours, rolling_7d, cumulative_hours``.

    The rolling mean is over the last ``window_days`` *observed* days (missing days are not
    inserted), at least one row; the running total is over all earlier observed days. With
    ``by`` keys (e.g. a listener id) every series is separate and the windows partition by them.
    """
    keys = list(by or [])
    d = daily_ms(plays, by=keys)
    w = (Window.partitionBy(*keys) if keys else Window).orderBy("date")
    roll = w.rowsBetween(-(window_days - 1), Window.currentRow)
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return d.select(
        *keys,
        "date",
        (F.col("day_ms") / F.lit(MS_PER_HOUR)).alias("play_hours"),
        (F.sum("day_ms").over(roll) / F.count(F.lit(1)).over(roll) / F.lit(MS_PER_HOUR)).alias("rolling_7d"),
        (F.sum("day_ms").over(run) / F.lit(MS_PER_HOUR)).alias("cumulative_hours"),
    )


_LABELS = {"week": week_end_sunday, "month": month_end, "year": year_end}


def _bins_until(freq: str, b, nxt):
    """The bins from ``b`` up to, not including, the next present bin ``nxt`` (just ``b`` at
    the end of the series)."""
    if freq == "week":
        span = F.sequence(b, F.date_sub(nxt, 7), F.expr("INTERVAL 7 DAYS"))
    elif freq == "month":
        months = F.round(F.months_between(nxt, b)).cast("int")  # both are month ends: whole
        span = F.transform(F.sequence(F.lit(0), months - 1), lambda i: F.last_day(F.add_months(b, i)))
    else:
        span = F.transform(F.sequence(F.year(b), F.year(nxt) - 1), lambda y: F.make_date(y, F.lit(12), F.lit(31)))
    return F.when(nxt.isNull(), F.array(b)).otherwise(span)


def calendar_hours(plays: DataFrame, freq: str, by: list[str] | None = None) -> DataFrame:
    """Resampled sums with empty bins as 0: ``date`` (bin label), ``play_hours``.

    Labels: week -> the Sunday ending it, month -> last day, year -> 31 December. One pass:
    the per-bin sums (one row per non-empty bin, bounded by the calendar span) are ordered by
    a window, and every bin emits itself plus the empty bins before the next present one.
    """
    keys = list(by or [])
    label_fn = _LABELS[freq]
    sums = daily_ms(plays, by=keys).groupBy(*keys, label_fn(F.col("date")).alias("bin")).agg(
        F.sum("day_ms").alias("bin_ms")
    )
    w = (Window.partitionBy(*keys) if keys else Window).orderBy("bin")
    ordered = sums.withColumn("_next", F.lead("bin").over(w))
    filled = ordered.select(
        *keys, "bin_ms", F.posexplode(_bins_until(freq, F.col("bin"), F.col("_next"))).alias("pos", "date")
    )
    return filled.select(
        *keys,
        "date",
        (F.when(F.col("pos") == 0, F.col("bin_ms")).otherwise(F.lit(0.0)) / F.lit(MS_PER_HOUR)).alias("play_hours"),
    )


def weekly_hours(plays: DataFrame, by: list[str] | None = None) -> DataFrame:
    return calendar_hours(plays, "week", by)


def monthly_hours(plays: DataFrame, by: list[str] | None = None) -> DataFrame:
    return calendar_hours(plays, "month", by)


def yearly_hours(plays: DataFrame, by: list[str] | None = None) -> DataFrame:
    return calendar_hours(plays, "year", by)
