"""Column expressions shared by the operators (all JVM-side, no Python UDF)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from encore.schema import (
    DAY_END_HOUR,
    DAY_PERIOD_LABELS,
    DAY_START_HOUR,
    MS_PER_HOUR,
    MS_PER_MINUTE,
    URI_SCHEMES,
    WEEK_SEGMENT_LABELS,
    WEEKDAY_NAMES,
)


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hours_of(ms: str | Column = "ms_played") -> Column:
    """``sum(ms_played)/3.6e6``: whole-millisecond doubles add exactly in any order."""
    return F.coalesce(F.sum(col(ms)), F.lit(0.0)) / F.lit(MS_PER_HOUR)


def minutes_of(ms: str | Column = "ms_played") -> Column:
    return F.coalesce(F.sum(col(ms)), F.lit(0.0)) / F.lit(MS_PER_MINUTE)


ROWS = "_rows"  # in a rollup (operators/rollup.py): how many plays a row stands for


def count_rows(df: DataFrame | None = None) -> Column:
    """How many plays there are; a rollup's rows count as the plays they stand for."""
    if df is not None and ROWS in df.columns:
        return F.coalesce(F.sum(ROWS), F.lit(0))
    return F.count(F.lit(1))


def count_true(flag: str | Column, df: DataFrame | None = None) -> Column:
    """How many plays have the flag."""
    if df is not None and ROWS in df.columns:
        return F.coalesce(F.sum(F.when(col(flag), F.col(ROWS))), F.lit(0))
    return F.count_if(col(flag))


def mean_minutes(df: DataFrame | None = None) -> Column:
    return F.sum("ms_played") / count_rows(df) / F.lit(MS_PER_MINUTE)


def rate(flag: str | Column, df: DataFrame | None = None) -> Column:
    """Share of plays with the flag (0..1)."""
    return count_true(flag, df) / count_rows(df)


def clean_ms(c: Column) -> Column:
    """Numeric coercion, NULL/NaN -> 0, negatives -> 0."""
    d = c.try_cast("double")
    d = F.nanvl(d, F.lit(None).cast("double"))
    return F.greatest(F.coalesce(d, F.lit(0.0)), F.lit(0.0))


def weekday_num(ts: str | Column = "ts") -> Column:
    """Monday = 0 ... Sunday = 6."""
    return F.weekday(col(ts)).cast("int")


def weekday_name(ts: str | Column = "ts") -> Column:
    return F.date_format(col(ts), "EEEE")


def day_period(hour: str | Column = "listening_hour") -> Column:
    h = col(hour)
    day, night = DAY_PERIOD_LABELS
    return F.when((h >= DAY_START_HOUR) & (h < DAY_END_HOUR), F.lit(day)).otherwise(F.lit(night))


def week_segment(weekday: str | Column = "weekday_num") -> Column:
    weekend, weekday_ = WEEK_SEGMENT_LABELS
    return F.when(col(weekday) >= 5, F.lit(weekend)).otherwise(F.lit(weekday_))


def week_end_sunday(d: str | Column = "date") -> Column:
    """Label of the week holding ``d``: the Sunday that ends it."""
    return F.date_add(col(d), (F.lit(6) - F.weekday(col(d))).cast("int"))


def month_end(d: str | Column = "date") -> Column:
    return F.last_day(col(d))


def year_end(d: str | Column = "date") -> Column:
    return F.make_date(F.year(col(d)), F.lit(12), F.lit(31))


def _uri_part(uri: str | Column, n: int) -> Column:
    """Part ``n`` of ``<scheme>:<kind>:<id>``; another scheme or not exactly three parts -> NULL."""
    parts = F.split(col(uri), ":")
    return F.when((F.size(parts) == 3) & parts[0].isin(URI_SCHEMES), parts[n])


def uri_kind(uri: str | Column) -> Column:
    return _uri_part(uri, 1)


def uri_id(uri: str | Column) -> Column:
    return _uri_part(uri, 2)


def label(flag: str | Column, labels: tuple[str, str]) -> Column:
    """Boolean -> (label when true, label when false)."""
    return F.when(col(flag), F.lit(labels[0])).otherwise(F.lit(labels[1]))


def weekday_name_of(num: str | Column) -> Column:
    """Monday..Sunday from a Monday=0 weekday number."""
    return F.element_at(F.array(*[F.lit(n) for n in WEEKDAY_NAMES]), col(num) + 1)
