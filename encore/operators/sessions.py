"""Gap-based sessions over a whole log without a global sort of its rows.

Time is cut into slots as wide as the gap. Two plays of one slot lie closer together than the gap,
so a slot never holds a session border: all that matters of it is its first and last timestamp
(partial aggregation, so a timestamp holding a third of all rows costs one row per task). A session
starts with a slot whose first timestamp lies more than the gap after the last one of the slot
before it, and a slot's session number is the running count of such starts. The count runs inside
parts of ``SLOTS`` neighbouring slots; a part's offset comes from a table with one row per part
(3.7 years each for a gap of 30 minutes). Rows then get the number of their slot by an equi-join.

One plan for every size; building it starts no job. A gap equal to the limit stays inside the
session. Optional ``by`` keys (a listener id) number sessions per key. Rows with a NULL timestamp,
or a NULL key, get NULL; their join keys are spread so that they do not meet in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from encore.schema import SESSION_GAP_MINUTES

SLOTS = 65_536  # slots whose starts are counted in one window

_US = "_ts_us"
_S = "_slot"
_P = "_part"


def epoch_us(col: str, dtype=None):
    """Epoch microseconds. TIMESTAMP_NTZ (wall-clock) values are measured without any time
    zone, so gaps never depend on the session zone or daylight-saving shifts."""
    if isinstance(dtype, T.TimestampNTZType):
        c = F.col(col)
        return (
            F.unix_date(F.to_date(c)).cast("long") * F.lit(86_400_000_000)
            + F.hour(c).cast("long") * F.lit(3_600_000_000)
            + F.minute(c).cast("long") * F.lit(60_000_000)
            + (F.date_part(F.lit("SECOND"), c) * F.lit(1_000_000)).cast("long")
        )
    return F.unix_micros(F.col(col).cast("timestamp"))


def _floor_div(c, n: int):
    """Integer floor division (``pmod`` keeps it exact for times before the epoch)."""
    return ((c - F.pmod(c, F.lit(n))) / F.lit(n)).cast("long")


def _slot(df: DataFrame, ts_col: str, gap_us: int):
    return _floor_div(epoch_us(ts_col, df.schema[ts_col].dataType), max(1, gap_us))


def session_slots(
    df: DataFrame, ts_col: str = "ts", gap_minutes: float = SESSION_GAP_MINUTES,
    out_col: str = "session_id", by: list[str] | None = None,
) -> DataFrame:
    """Per (``by`` keys, slot of the width of the gap): the session number, ``[by...], _slot, out_col``."""
    keys = list(by or [])
    gap_us = int(round(gap_minutes * 60 * 1_000_000))
    us = epoch_us(ts_col, df.schema[ts_col].dataType)
    slots = (
        df.where(F.col(ts_col).isNotNull())
        .select(*keys, us.alias(_US), _slot(df, ts_col, gap_us).alias(_S))
        .groupBy(*keys, _S).agg(F.min(_US).alias("_first"), F.max(_US).alias("_last"))
        .withColumn(_P, _floor_div(F.col(_S), SLOTS))
    )
    inside = Window.partitionBy(*keys, _P).orderBy(_S)
    # the first slot of a part has no slot before it here; the part table settles it
    starts = (F.col("_first") - F.lag("_last").over(inside) > gap_us).cast("long")
    slots = slots.withColumn("_brk", F.coalesce(starts, F.lit(0).cast("long")))
    parts = slots.groupBy(*keys, _P).agg(
        F.min("_first").alias("_first"), F.max("_last").alias("_last"), F.sum("_brk").alias("_inner"))
    order = Window.partitionBy(*keys).orderBy(_P)
    before = F.lag("_last").over(order)
    parts = parts.withColumn("_new", (before.isNull() | (F.col("_first") - before > gap_us)).cast("long"))
    running = F.sum(F.col("_new") + F.col("_inner")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    parts = parts.select(*keys, _P, (running - F.col("_inner")).alias("_base"))
    local = F.sum("_brk").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    return (
        slots.withColumn("_local", local).join(parts, [*keys, _P])
        .select(*keys, _S, (F.col("_base") + F.col("_local")).cast("long").alias(out_col))
    )


def sessionize(
    df: DataFrame,
    ts_col: str = "ts",
    gap_minutes: float = SESSION_GAP_MINUTES,
    out_col: str = "session_id",
    by: list[str] | None = None,
    ids: DataFrame | None = None,
) -> DataFrame:
    """Add ``out_col`` to every row of ``df``; with ``by`` keys sessions are numbered per key from 1. ``ids`` may
    hold the ``session_slots`` of ``df``, e.g. as a stored table, whose size tells the planner how to join."""
    keys = list(by or [])
    ids = session_slots(df, ts_col, gap_minutes, out_col, keys) if ids is None else ids
    gap_us = int(round(gap_minutes * 60 * 1_000_000))
    # a row without a timestamp takes one of many slots that do not exist
    nowhere = F.lit(-(1 << 60)) - F.pmod(F.xxhash64(*df.columns), F.lit(1 << 20))
    rows = df.withColumn(_S, F.coalesce(_slot(df, ts_col, gap_us), nowhere))
    return rows.join(ids, [*keys, _S], "left").select(*df.columns, out_col)
