"""Rollups: plays added up once over the keys that several measures share.

A rollup has one row per combination of its keys, ``ms_played`` summed up and ``_rows`` plays behind it
(with ``span``, also ``ts``, the first play, and ``_last``, the last one). Sums, counts, rates and extremes
of plays are the same over a rollup, so the operators take one in place of plays; whole milliseconds add
exactly in any order. Rows with a NULL key form groups of their own; no plays give an empty rollup.

A rollup is one partial and one final aggregate, so a hot combination is one row per task before the
shuffle, and its size is bounded by the keys' combinations, not by the plays. It is written to the shared
folder until the driver's process ends: what reads it neither scans the log again nor depends on an
executor's memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from encore.functions.columns import ROWS
from encore.schema import LATE_NIGHT_HOURS
from encore.sources.fs import temporary

LAST = "_last"
LATE, WEEKEND = "_late_night", "_weekend"


def late_night(plays: DataFrame) -> Column:
    """Whether a play began late at night."""
    return F.col(LATE) if LATE in plays.columns else F.col("listening_hour").between(*LATE_NIGHT_HOURS)


def weekend(plays: DataFrame) -> Column:
    """Whether a play was on a Saturday or Sunday (F8)."""
    return F.col(WEEKEND) if WEEKEND in plays.columns else F.col("weekday_num") >= 5


def rollup(plays: DataFrame, *keys: str | Column, span: bool = False) -> DataFrame:
    """``plays`` added up over ``keys`` and stored."""
    sums = [F.sum("ms_played").alias("ms_played"), F.count(F.lit(1)).alias(ROWS)]
    if span:
        sums += [F.min("ts").alias("ts"), F.max("ts").alias(LAST)]
    table = plays.groupBy(*keys).agg(*sums)
    path = temporary(plays.sparkSession, "rollup")
    table.write.parquet(path)
    return plays.sparkSession.read.schema(table.schema).parquet(path)
