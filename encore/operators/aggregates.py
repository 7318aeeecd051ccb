"""Grouped measures over plays.

All are single hash aggregates (partial aggregation map-side, one shuffle on a key of a few
distinct values), so a key holding a third of the rows is combined before the shuffle.
Each also takes a rollup (operators/rollup.py) that holds its keys, in place of plays.
Optional ``by`` keys (e.g. a listener id) cost nothing extra and default to the reference's
single-listener behaviour.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from encore.functions.columns import (
    count_rows,
    count_true,
    day_period,
    hours_of,
    label,
    mean_minutes,
    minutes_of,
    rate,
    week_segment,
    weekday_name_of,
)
from encore.schema import ALBUM, ARTIST, CONTENT_TYPES, INCOGNITO_LABELS, OFFLINE_LABELS, SHUFFLE_LABELS

Keys = list[str] | None


def _k(by: Keys) -> list[str]:
    return list(by or [])


def kpis(plays: DataFrame, by: Keys = None) -> DataFrame:
    """Headline figures; an empty selection gives one row of zeros (no ``by``).

    The log is read into one group per (artist, album) by partial aggregation; the distinct
    counts then run over those groups, so no log row is expanded per distinct count."""
    groups = plays.groupBy(*_k(by), ARTIST, ALBUM).agg(
        F.sum("ms_played").alias("_ms"),
        count_true("is_song", plays).alias("_songs"),
        count_true("is_skipped", plays).alias("_skipped"),
        count_true("shuffle", plays).alias("_shuffled"),
        count_rows(plays).alias("_n"),
    )
    n = F.sum("_n")
    zero = F.lit(0).cast("long")
    return groups.groupBy(*_k(by)).agg(
        (F.coalesce(F.sum("_ms"), F.lit(0.0)) / F.lit(3600000.0)).alias("total_hours"),
        F.coalesce(F.sum("_songs"), zero).alias("tracks_played"),
        F.count_distinct(ARTIST).cast("long").alias("unique_artists"),
        F.count_distinct(ALBUM).cast("long").alias("unique_albums"),
        F.coalesce(F.sum("_skipped") / n * F.lit(100.0), F.lit(0.0)).alias("skip_rate"),
        F.coalesce(F.sum("_shuffled") / n * F.lit(100.0), F.lit(0.0)).alias("shuffle_rate"),
        F.coalesce(n, zero).alias("rows"),
    )


def hourly_hours(plays: DataFrame, by: Keys = None) -> DataFrame:
    return plays.groupBy(*_k(by), "listening_hour").agg(hours_of().alias("play_hours"))


def weekday_hours(plays: DataFrame, by: Keys = None) -> DataFrame:
    """Hours per weekday; order Monday..Sunday with ``orderBy('weekday_num')``."""
    return plays.groupBy(*_k(by), "weekday_num", "weekday_name").agg(hours_of().alias("play_hours"))


def content_mix(plays: DataFrame) -> DataFrame:
    """Rows per content type (a play that is podcast and audiobook counts twice)."""
    agg = plays.agg(
        count_true("is_song", plays).alias("songs"),
        count_true("is_podcast", plays).alias("podcasts"),
        count_true("is_audiobook", plays).alias("audiobooks"),
    )
    songs, podcasts, audiobooks = CONTENT_TYPES
    return agg.select(
        F.expr(f"stack(3, '{songs}', CAST(songs AS DOUBLE), '{podcasts}', CAST(podcasts AS DOUBLE), "
               f"'{audiobooks}', CAST(audiobooks AS DOUBLE)) AS (name, value)")
    )


def value_counts(plays: DataFrame, column: str) -> DataFrame:
    return plays.groupBy(column).agg(count_rows(plays).cast("long").alias("count"))


def skip_by_reason(plays: DataFrame) -> DataFrame:
    return plays.groupBy("reason_end").agg(
        rate("is_skipped", plays).alias("skip_rate"), count_rows(plays).cast("long").alias("count")
    )


def shuffle_compare(plays: DataFrame) -> DataFrame:
    g = plays.groupBy("shuffle").agg(
        rate("is_skipped", plays).alias("skip_rate"),
        mean_minutes(plays).alias("avg_minutes"),
        count_rows(plays).cast("long").alias("count"),
    )
    return g.select(
        label("shuffle", SHUFFLE_LABELS).alias("shuffle"),
        "skip_rate", "avg_minutes", "count",
    )


def offline_share(plays: DataFrame) -> DataFrame:
    g = plays.groupBy("offline").agg(hours_of().alias("hours"), rate("is_skipped", plays).alias("skip_rate"))
    return g.select(
        label("offline", OFFLINE_LABELS).alias("offline"), "hours", "skip_rate"
    )


def incognito_share(plays: DataFrame) -> DataFrame:
    g = plays.groupBy("incognito_mode").agg(hours_of().alias("hours"), count_rows(plays).cast("long").alias("plays"))
    return g.select(
        label("incognito_mode", INCOGNITO_LABELS).alias("incognito_mode"),
        "hours", "plays",
    )


def platform_usage(plays: DataFrame) -> DataFrame:
    return plays.groupBy("platform").agg(
        count_rows(plays).cast("long").alias("plays"), hours_of().alias("hours"), rate("is_skipped", plays).alias("skip_rate")
    )


def platform_share(plays: DataFrame, k: int = 8) -> DataFrame:
    g = plays.groupBy("platform").agg(hours_of().alias("value"))
    return g.orderBy(F.col("value").desc(), F.col("platform").asc()).limit(k).select(
        F.col("platform").alias("name"), "value"
    )


def monthly_seasonality(plays: DataFrame) -> DataFrame:
    """Hours by month number across all years."""
    return plays.groupBy("month").agg(hours_of().alias("play_hours"))


def day_night(plays: DataFrame) -> DataFrame:
    return plays.groupBy(day_period("listening_hour").alias("day_period")).agg(
        hours_of().alias("hours"), count_rows(plays).cast("long").alias("plays")
    )


def week_segment_hours(plays: DataFrame) -> DataFrame:
    return plays.groupBy(week_segment("weekday_num").alias("week_segment")).agg(
        hours_of().alias("hours"), mean_minutes(plays).alias("avg_minutes")
    )


def heatmap_long(plays: DataFrame) -> DataFrame:
    """Dense 7x24 grid of minutes (168 rows, zeros where nothing was played)."""
    cells = plays.groupBy("weekday_num", "listening_hour").agg(minutes_of().alias("play_minutes"))
    spark = plays.sparkSession
    # 168 generated rows: a fixed, proven size.
    grid = spark.range(7).select(F.col("id").cast("int").alias("weekday_num")).crossJoin(
        spark.range(24).select(F.col("id").cast("int").alias("listening_hour"))
    )
    names = weekday_name_of("weekday_num")
    return (
        F.broadcast(grid)
        .join(cells, ["weekday_num", "listening_hour"], "left")
        .select(
            "weekday_num",
            names.alias("weekday_name"),
            "listening_hour",
            F.coalesce(F.col("play_minutes"), F.lit(0.0)).alias("play_minutes"),
        )
    )


def heatmap_wide(plays: DataFrame) -> DataFrame:
    """7 rows (Monday..Sunday) x 24 hour columns ``h00``..``h23``."""
    long = heatmap_long(plays)
    wide = long.groupBy("weekday_num", "weekday_name").pivot("listening_hour", list(range(24))).agg(
        F.first("play_minutes")
    )
    return wide.select(
        "weekday_num", "weekday_name", *[F.coalesce(F.col(str(h)), F.lit(0.0)).alias(f"h{h:02d}") for h in range(24)]
    )


def peak_hour_day(plays: DataFrame) -> DataFrame:
    """Most active hour and weekday by hours (ties to the smallest key).

    One aggregation to the (at most 168) weekday x hour cells; both arg-maxes read that."""
    cells = plays.groupBy("weekday_num", "weekday_name", "listening_hour").agg(F.sum("ms_played").alias("_ms"))
    h = cells.groupBy("listening_hour").agg(F.sum("_ms").alias("play_hours"))
    d = cells.groupBy("weekday_num", "weekday_name").agg(F.sum("_ms").alias("play_hours"))
    h = h.orderBy(F.col("play_hours").desc(), F.col("listening_hour").asc()).limit(1)
    d = d.orderBy(F.col("play_hours").desc(), F.col("weekday_num").asc()).limit(1)
    return h.select(F.col("listening_hour").alias("most_active_hour")).crossJoin(
        d.select(F.col("weekday_name").alias("most_active_day"))
    )


def filter_options(plays: DataFrame) -> DataFrame:
    """Distinct artists (one row each) with the data's date range and file count."""
    span = plays.agg(
        F.min("date").alias("min_date"), F.max("date").alias("max_date"),
        F.count_distinct("source_file").cast("long").alias("files_loaded"),
    )
    artists = plays.select(F.col(ARTIST).alias("artist")).distinct()
    return artists.crossJoin(F.broadcast(span))  # one-row side


def heatmap_present(plays: DataFrame) -> DataFrame:
    """The legacy grid: weekdays present x hours present (zeros for empty cells), long form.

    One aggregation to the cells (at most 7 x 24), gathered into one bounded list; the grid and
    its values are array expressions over that list, so the data is read once.
    """
    cells = plays.groupBy("weekday_num", "weekday_name", "listening_hour").agg(minutes_of().alias("m"))
    one = cells.agg(F.collect_list(F.struct("weekday_num", "weekday_name", "listening_hour", "m")).alias("c"))
    days = F.array_distinct(F.transform("c", lambda x: F.struct(x["weekday_num"].alias("n"), x["weekday_name"].alias("w"))))
    hours = F.array_distinct(F.transform("c", lambda x: x["listening_hour"]))
    grid = one.select("c", F.explode(days).alias("d")).select("c", "d", F.explode(hours).alias("h"))
    value = F.aggregate(
        F.filter("c", lambda x: (x["weekday_num"] == F.col("d")["n"]) & (x["listening_hour"] == F.col("h"))),
        F.lit(0.0), lambda acc, x: acc + x["m"],
    )
    return grid.select(
        F.col("d")["n"].alias("weekday_num"), F.col("d")["w"].alias("weekday_name"),
        F.col("h").alias("listening_hour"), value.alias("play_minutes"),
    )
