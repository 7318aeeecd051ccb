"""Deterministic top-k rankings and year-in-review picks.

``top_k`` is ``groupBy -> orderBy(metrics desc, keys asc) -> limit(k)``, which Spark plans as
``TakeOrderedAndProject``: every task keeps its own k best rows and only those k-per-task
reach the final merge, so no full sort and no single-task collection of a group occurs.
A rollup (operators/rollup.py) that holds a ranking's keys may stand in for plays.
Ties are broken by the group keys ascending, in Spark and in the oracle alike.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from encore.functions.columns import count_rows, hours_of, minutes_of
from encore.operators.rollup import LAST, late_night, weekend
from encore.schema import ALBUM, ARTIST, REPEAT_MIN_PLAYS, TRACK, TRACK_URI
from encore.session import shared_dir


def top_k(agg: DataFrame, keys: list[str], metrics: list[str], k: int | None) -> DataFrame:
    order: list[Column] = [F.col(m).desc() for m in metrics] + [F.col(c).asc() for c in keys]
    out = agg.orderBy(*order)
    return out.limit(k) if k is not None else out


def songs(plays: DataFrame) -> DataFrame:
    return plays.where(F.col("is_song"))


def top_artists_hours(plays: DataFrame, k: int = 10) -> DataFrame:
    g = plays.groupBy(F.col(ARTIST).alias("artist")).agg(hours_of().alias("play_hours"))
    return top_k(g, ["artist"], ["play_hours"], k)


def top_tracks_hours(plays: DataFrame, k: int = 10) -> DataFrame:
    g = plays.groupBy(F.col(TRACK).alias("track")).agg(hours_of().alias("play_hours"))
    return top_k(g, ["track"], ["play_hours"], k)


def favorite_albums(plays: DataFrame, k: int = 10) -> DataFrame:
    g = plays.groupBy(F.col(ALBUM).alias("album"), F.col(ARTIST).alias("artist")).agg(hours_of().alias("play_hours"))
    return top_k(g, ["album", "artist"], ["play_hours"], k)


def once(top: DataFrame) -> DataFrame:
    """A ranked result of k rows, computed here and kept in the shared checkpoint folder: what uses it
    several times does not rank the log again."""
    shared_dir(top.sparkSession)
    return top.checkpoint()


def first_uri(plays: DataFrame, top: DataFrame, keys: list[str]) -> DataFrame:
    """``top`` (k rows, ``keys`` unique) with ``track_uri``: the URI of each row's earliest play
    that has one, the smallest of several at the same time. Only plays of the k keys are looked at, in a
    second scan of the log; the ranking itself is computed ``once``."""
    top = once(top)
    k = F.broadcast(top.select(*[F.col(c).alias(f"_k_{c}") for c in keys]))  # k rows
    match = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"_k_{c}") for c in keys])
    hits = plays.where(F.col(TRACK_URI).isNotNull()).select(*keys, "ts", TRACK_URI).join(k, match)
    found = hits.groupBy(*[f"_k_{c}" for c in keys]).agg(F.min(F.struct("ts", TRACK_URI))[TRACK_URI].alias("track_uri"))
    on = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"_k_{c}") for c in keys])
    return top.join(F.broadcast(found), on, "left").drop(*[f"_k_{c}" for c in keys])


def featured_track(plays: DataFrame) -> DataFrame:
    """Most streamed (track, artist, album) among songs, then most minutes; first/last play day.
    The ranking is a hash aggregate; the URI is looked up for the winner alone."""
    keys = [TRACK, ARTIST, ALBUM]
    g = songs(plays).groupBy(*keys).agg(
        count_rows(plays).cast("long").alias("streams"),
        minutes_of().alias("listening_minutes"),
        F.min("ts").alias("_first"),
        F.max(LAST if LAST in plays.columns else "ts").alias("_last"),
    )
    top = first_uri(songs(plays), top_k(g, keys, ["streams", "listening_minutes"], 1), keys)
    return top.select(
        F.col(TRACK).alias("track"), F.col(ARTIST).alias("artist"), F.col(ALBUM).alias("album"),
        "streams", "listening_minutes",
        F.date_format("_first", "yyyy-MM-dd").alias("first_play"),
        F.date_format("_last", "yyyy-MM-dd").alias("last_play"),
        "track_uri",
    )


def album_spotlight(plays: DataFrame, k: int = 8) -> DataFrame:
    g = songs(plays).groupBy(F.col(ALBUM).alias("album"), F.col(ARTIST).alias("artist")).agg(
        count_rows(plays).cast("long").alias("play_count"), minutes_of().alias("play_minutes")
    )
    return top_k(g, ["album", "artist"], ["play_count", "play_minutes"], k)


def artist_spotlight(plays: DataFrame, k: int = 5, digits: int | None = 2) -> DataFrame:
    """Top artists by plays then minutes, rank and share (%) of all song plays.

    ``digits`` rounds the share for display (``None`` keeps it exact)."""
    s = songs(plays)
    g = s.groupBy(F.col(ARTIST).alias("artist")).agg(
        count_rows(plays).cast("long").alias("total_plays"), minutes_of().alias("total_minutes")
    )
    top = top_k(g, ["artist"], ["total_plays", "total_minutes"], k)
    total = s.agg(F.greatest(count_rows(plays), F.lit(1)).alias("_all"))  # one row
    w = Window.orderBy(F.col("total_plays").desc(), F.col("total_minutes").desc(), F.col("artist").asc())
    share = F.lit(100.0) * F.col("total_plays") / F.col("_all")
    return top.crossJoin(F.broadcast(total)).select(
        F.row_number().over(w).cast("int").alias("rank"),
        "artist", "total_plays", "total_minutes",
        (share if digits is None else F.round(share, digits)).alias("share"),
    )


def _count_top1(df: DataFrame, key: str, out_key: str) -> DataFrame:
    g = df.groupBy(F.col(key).alias(out_key)).agg(count_rows(df).cast("long").alias("plays"))
    return top_k(g, [out_key], ["plays"], 1)


def wrapped_late_night(plays: DataFrame) -> DataFrame:
    return _count_top1(songs(plays).where(late_night(plays)), TRACK, TRACK)


def wrapped_top_artist(plays: DataFrame) -> DataFrame:
    return _count_top1(songs(plays), ARTIST, ARTIST)


def wrapped_weekend(plays: DataFrame) -> DataFrame:
    return _count_top1(songs(plays).where(weekend(plays)), TRACK, TRACK)


def wrapped_artist_year(plays: DataFrame) -> DataFrame:
    """Top artist of the latest year present.

    The latest year is an uncorrelated scalar subquery; on the curated table the filter on it
    is a partition filter, so only that year's files are read for the ranking."""
    s = songs(plays)
    latest = s.select(F.max("year")).scalar()
    top = _count_top1(s.where(F.col("year") == latest), ARTIST, ARTIST)
    return top.select(latest.alias("year"), ARTIST, "plays")


def _plays_hours(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(count_rows(df).cast("long").alias("plays"), hours_of().alias("hours"))


def ranking_artists(plays: DataFrame, top_n: int = 10) -> DataFrame:
    return top_k(_plays_hours(songs(plays), [ARTIST]), [ARTIST], ["plays"], _check_top_n(top_n))


def ranking_tracks(plays: DataFrame, top_n: int = 10) -> DataFrame:
    return top_k(_plays_hours(songs(plays), [TRACK, ARTIST]), [TRACK, ARTIST], ["plays"], _check_top_n(top_n))


def ranking_albums(plays: DataFrame, top_n: int = 10) -> DataFrame:
    return top_k(_plays_hours(songs(plays), [ALBUM]), [ALBUM], ["plays"], _check_top_n(top_n))


def repeated_tracks(plays: DataFrame, min_plays: int = REPEAT_MIN_PLAYS) -> DataFrame:
    """All (track, artist) pairs played at least ``min_plays`` times, most played first."""
    g = songs(plays).groupBy(TRACK, ARTIST).agg(count_rows(plays).cast("long").alias("play_count"))
    return top_k(g.where(F.col("play_count") >= min_plays), [TRACK, ARTIST], ["play_count"], None)


def _check_top_n(top_n: int) -> int:
    if not 5 <= int(top_n) <= 50:
        raise ValueError("top_n must be between 5 and 50")
    return int(top_n)


def with_track_label(df: DataFrame) -> DataFrame:
    """Adds ``label`` = ``"<track> - <artist>"`` (NULL if either part is NULL) for charts."""
    return df.withColumn("label", F.concat(F.col(TRACK), F.lit(" - "), F.col(ARTIST)))
