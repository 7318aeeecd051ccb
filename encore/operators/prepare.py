"""Cleaning of raw plays into the curated ``plays`` table.

Order of steps follows the dashboard's cleaning: parse ``ts`` (bad -> dropped), drop exact
duplicate rows (all columns, ``source_file`` included, before ``ms_played`` is cleaned),
then fill and derive columns. Sessions are numbered over the whole log before any filter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from encore.functions.columns import clean_ms, weekday_name, weekday_num
from encore.operators.sessions import sessionize
from encore.schema import (
    ALBUM,
    ARTIST,
    EXPORT_KEYS,
    FULL_PLAY_MINUTES,
    MS_PER_HOUR,
    MS_PER_MINUTE,
    RAW_COLUMNS,
    SESSION_GAP_MINUTES,
    TRACK,
    UNKNOWN_ALBUM,
    UNKNOWN_ARTIST,
    UNKNOWN_CATEGORY,
    UNKNOWN_TRACK,
    raw_type,
)


def parse_ts(c: Column, dtype: T.DataType) -> Column:
    """Timestamps pass through; text is parsed as an ISO instant (bad -> NULL)."""
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return c
    if isinstance(dtype, T.DateType):
        return c.cast("timestamp")
    return F.try_to_timestamp(c.cast("string"))


def to_bool(c: Column, dtype: T.DataType) -> Column:
    """NULL -> false. Text is parsed as a boolean (bad -> false); numbers != 0 are true."""
    if isinstance(dtype, T.BooleanType):
        b = c
    elif isinstance(dtype, T.StringType):
        b = c.try_cast("boolean")
    elif isinstance(dtype, T.NumericType):
        b = c != 0
    else:
        b = c.cast("string").try_cast("boolean")
    return F.coalesce(b, F.lit(False))


def complete_raw(df: DataFrame) -> DataFrame:
    """Columns under an export's own keys are renamed, missing expected columns become NULL, others
    are kept (U1/S4 on frames)."""
    for name, key in EXPORT_KEYS.items():
        if name not in df.columns:
            df = df.withColumnRenamed(key, name)
    for name in RAW_COLUMNS + ["source_file", "extra_json"]:
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(raw_type(name) if name in RAW_COLUMNS else "string"))
    return df


def valid_plays(raw: DataFrame) -> DataFrame:
    """complete rows with a readable timestamp."""
    raw = complete_raw(raw)
    return raw.withColumn("ts", parse_ts(F.col("ts"), raw.schema["ts"].dataType)).where(F.col("ts").isNotNull())


def prepare_plays(
    raw: DataFrame,
    session_gap_minutes: float = SESSION_GAP_MINUTES,
    with_sessions: bool = True,
) -> DataFrame:
    df = clean_plays(valid_plays(raw).dropDuplicates())
    return sessionize(df, "ts", session_gap_minutes) if with_sessions else df


def clean_plays(df: DataFrame) -> DataFrame:
    """Fills and derives the curated columns of valid, distinct rows (all but the session number)."""
    types = {f.name: f.dataType for f in df.schema.fields}

    derived: dict[str, Column] = {
        "ms_played": clean_ms(F.col("ms_played")),
        TRACK: F.coalesce(F.col(TRACK), F.lit(UNKNOWN_TRACK)),
        ARTIST: F.coalesce(F.col(ARTIST), F.lit(UNKNOWN_ARTIST)),
        ALBUM: F.coalesce(F.col(ALBUM), F.lit(UNKNOWN_ALBUM)),
        "shuffle": to_bool(F.col("shuffle"), types["shuffle"]),
        "offline": to_bool(F.col("offline"), types["offline"]),
        "incognito_mode": to_bool(F.col("incognito_mode"), types["incognito_mode"]),
        "platform": F.coalesce(F.col("platform"), F.lit(UNKNOWN_CATEGORY)),
        "reason_start": F.coalesce(F.col("reason_start"), F.lit(UNKNOWN_CATEGORY)),
        "reason_end": F.coalesce(F.col("reason_end"), F.lit(UNKNOWN_CATEGORY)),
    }
    df = df.withColumns(derived)

    is_podcast = (
        F.col("episode_name").isNotNull() | F.col("episode_show_name").isNotNull() | F.col("episode_uri").isNotNull()
    )
    is_audiobook = (
        F.col("audiobook_title").isNotNull() | F.col("audiobook_uri").isNotNull() | F.col("audiobook_chapter_uri").isNotNull()
    )
    is_skipped = to_bool(F.col("skipped"), types["skipped"])
    df = df.withColumns(
        {
            "play_minutes": F.col("ms_played") / F.lit(MS_PER_MINUTE),
            "play_hours": F.col("ms_played") / F.lit(MS_PER_HOUR),
            "date": F.to_date(F.col("ts")),
            "year": F.year("ts").cast("int"),
            "month": F.month("ts").cast("int"),
            "weekday_name": weekday_name("ts"),
            "weekday_num": weekday_num("ts"),
            "listening_hour": F.hour("ts").cast("int"),
            "is_podcast": is_podcast,
            "is_audiobook": is_audiobook,
            "is_song": ~(is_podcast | is_audiobook),
            "is_skipped": is_skipped,
        }
    )
    return df.withColumn("is_fully_played", ~F.col("is_skipped") & (F.col("play_minutes") >= FULL_PLAY_MINUTES))


def dedup_plays(raw: DataFrame) -> DataFrame:
    """F1 + F2 alone: valid timestamps, exact duplicates removed."""
    return valid_plays(raw).dropDuplicates()
