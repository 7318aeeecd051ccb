"""Report bundles (R1-R9): the dashboard's endpoints as plain functions.

Signature: ``report(plays, start=None, end=None, artists=None, content_types=None, ...)``
returning a dict of lazy DataFrames (ordered for display) plus the few scalars the
dashboard shows, which are read from one-row aggregates. An empty selection yields empty
frames and zero KPIs. Catalog tables for enrichment are optional arguments.

A report scans the log at most twice. When R2 to R8 are called they add their selection up into one
stored rollup, R2 and R3 into two (times and categories, names), and all their frames read those.

``persist=True`` also keeps the filtered selection (``_selection``) in executor memory/disk, for a
caller who goes on with it; call ``release(report)`` afterwards.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from encore.functions.columns import count_rows
from encore.operators import aggregates as A
from encore.operators import enrich as EN
from encore.operators import filters as FL
from encore.operators import rankings as R
from encore.operators import statistics as S
from encore.operators import trends as TR
from encore.operators.rollup import LATE, WEEKEND, late_night, rollup, weekend
from encore.schema import ALBUM, ARTIST, CONTENT_TYPES, TRACK, TRACK_URI


# What any report reads: a persisted selection holds these columns only.
_REPORT_COLUMNS = [
    "ts", "ms_played", "play_minutes", "play_hours", "date", "year", "month", "weekday_name", "weekday_num",
    "listening_hour", "is_podcast", "is_audiobook", "is_song", "is_skipped", "is_fully_played", "platform",
    "reason_start", "reason_end", "shuffle", "offline", "incognito_mode", TRACK, ARTIST, ALBUM, TRACK_URI,
]


_DAY = ["weekday_num", "weekday_name"]
_CONTENT = ["is_song", "is_podcast", "is_audiobook"]


def _select(plays, start, end, artists, content_types, persist) -> DataFrame:
    df = FL.apply_filters(plays, start, end, artists, content_types or list(CONTENT_TYPES))
    return df.select(*_REPORT_COLUMNS).persist(StorageLevel.MEMORY_AND_DISK) if persist else df


def release(report: dict) -> None:
    src = report.get("_selection")
    if src is not None:
        src.unpersist()


def _rows(cells: DataFrame) -> int:
    return int(cells.agg(count_rows(cells)).first()[0])


def _kpi_dict(sel: DataFrame) -> dict:
    # display rounding is Spark's (half up), as everywhere
    r = A.kpis(sel).withColumns({c: F.round(c, 2) for c in ("total_hours", "skip_rate", "shuffle_rate")}).first()
    return {
        "totalHours": float(r["total_hours"]),
        "tracksPlayed": int(r["tracks_played"]),
        "uniqueArtists": int(r["unique_artists"]),
        "uniqueAlbums": int(r["unique_albums"]),
        "skipRate": float(r["skip_rate"]),
        "shuffleRate": float(r["shuffle_rate"]),
        "rows": int(r["rows"]),
    }


def filter_options(plays: DataFrame, data_dir: str | None = None) -> dict:
    """Distinct artists, date range, number of export files, content types."""
    from encore.sources.exports import json_files

    span = plays.agg(F.min("date").alias("min"), F.max("date").alias("max")).first()
    files = json_files(plays.sparkSession, data_dir).count() if data_dir else None
    return {
        "artists": plays.select(F.col(ARTIST).alias("artist")).distinct().orderBy("artist"),
        "dateRange": None if span["min"] is None else {"min": str(span["min"]), "max": str(span["max"])},
        "filesLoaded": files,
        "contentTypes": list(CONTENT_TYPES),
    }


def dashboard(plays, start=None, end=None, artists=None, content_types=None, catalogs: dict | None = None,
              persist=False) -> dict:
    """R2: KPIs, hourly/weekday/daily hours, top artists/tracks/albums, content mix, platforms."""
    sel = _select(plays, start, end, artists, content_types, persist)
    cells = rollup(sel, "date", *_DAY, "listening_hour", "platform", *_CONTENT)
    names = rollup(sel, ARTIST, ALBUM, TRACK, "is_song", "is_skipped", "shuffle")
    top_artists = R.top_artists_hours(names)
    albums = R.favorite_albums(names)
    if catalogs:
        top_artists = EN.enrich_artists(top_artists, catalogs["artist_primary"], catalogs["artist_fallback"])
        albums = EN.enrich_albums(albums, catalogs["album_primary"], catalogs["album_fallback"])
    return {
        "_selection": sel,
        "kpis": _kpi_dict(names),
        "hourly": A.hourly_hours(cells).orderBy("listening_hour"),
        "weekday": A.weekday_hours(cells).orderBy("weekday_num"),
        "daily": TR.daily_hours(cells).orderBy("date"),
        "topArtists": top_artists.orderBy(F.col("play_hours").desc(), "artist"),
        "topTracks": R.top_tracks_hours(names),
        "favoriteAlbums": albums.orderBy(F.col("play_hours").desc(), "album", "artist"),
        "contentMix": A.content_mix(cells),
        "platformShare": A.platform_share(cells),
    }


def overview(plays, start=None, end=None, artists=None, content_types=None, persist=False) -> dict:
    """KPIs, most active hour/day, hourly and weekday hours."""
    sel = _select(plays, start, end, artists, content_types, persist)
    cells = rollup(sel, *_DAY, "listening_hour")
    names = rollup(sel, ARTIST, ALBUM, "is_song", "is_skipped", "shuffle")
    peak = A.peak_hour_day(cells).first()
    return {
        "_selection": sel,
        "kpis": _kpi_dict(names),
        "highlights": {
            "mostActiveHour": None if peak is None else int(peak["most_active_hour"]),
            "mostActiveDay": None if peak is None else peak["most_active_day"],
        },
        "hourly": A.hourly_hours(cells).orderBy("listening_hour"),
        "weekday": A.weekday_hours(cells).orderBy("weekday_num"),
    }


def listening_trends(plays, start=None, end=None, artists=None, content_types=None, persist=False) -> dict:
    """Daily series with 7-day mean and running total, weekly/monthly/yearly sums, stats."""
    sel = _select(plays, start, end, artists, content_types, persist)
    cells = rollup(sel, "date")
    stats = S.daily_stats(cells).first()
    return {
        "_selection": sel,
        "daily": TR.daily_trend(cells).orderBy("date"),
        "weekly": TR.weekly_hours(cells).orderBy("date"),
        "monthly": TR.monthly_hours(cells).orderBy("date"),
        "yearly": TR.yearly_hours(cells).orderBy("date"),
        "rows": _rows(cells),
        "stats": {} if stats is None else {k: stats[k] for k in
                                           ["mean", "median", "variance", "std_dev", "p25", "p50", "p75", "p90"]},
    }


def behavior_analysis(plays, start=None, end=None, artists=None, content_types=None, persist=False) -> dict:
    """start/end reasons, skip rate by end reason, shuffle/offline/incognito, platforms."""
    sel = _select(plays, start, end, artists, content_types, persist)
    cells = rollup(sel, "reason_start", "reason_end", "platform", "shuffle", "offline", "incognito_mode", "is_skipped")
    return {
        "_selection": sel,
        "startCounts": A.value_counts(cells, "reason_start").orderBy(F.col("count").desc(), "reason_start"),
        "endCounts": A.value_counts(cells, "reason_end").orderBy(F.col("count").desc(), "reason_end"),
        "skipByReason": A.skip_by_reason(cells).orderBy(F.col("skip_rate").desc(), "reason_end"),
        "shuffleCompare": A.shuffle_compare(cells),
        "offlineShare": A.offline_share(cells),
        "incognitoShare": A.incognito_share(cells),
        "platformUsage": A.platform_usage(cells).orderBy(F.col("plays").desc(), "platform"),
        "rows": _rows(cells),
    }


def time_patterns(plays, start=None, end=None, artists=None, content_types=None, persist=False) -> dict:
    """Dense weekday x hour heatmap, monthly seasonality, day/night, weekday/weekend."""
    sel = _select(plays, start, end, artists, content_types, persist)
    cells = rollup(sel, "month", *_DAY, "listening_hour")
    return {
        "_selection": sel,
        "heatmap": A.heatmap_wide(cells).orderBy("weekday_num"),
        "seasonal": A.monthly_seasonality(cells).orderBy("month"),
        "dayNight": A.day_night(cells),
        "weekSegment": A.week_segment_hours(cells),
        "rows": _rows(cells),
        "hourCurve": A.hourly_hours(cells).orderBy("listening_hour"),
    }


def statistical_insights(plays, start=None, end=None, artists=None, content_types=None, threshold: float = 2.5,
                         persist=False) -> dict:
    """Daily hours, 95% t interval of the mean, z-score outlier days, histogram, normal
    overlay and the Welch weekday/weekend test."""
    sel = _select(plays, start, end, artists, content_types, persist)
    cells = rollup(sel, "date")
    values = S.daily_values(cells)
    ci = S.confidence_interval(values, "x", 0.95)
    return {
        "_selection": sel,
        "daily": TR.daily_hours(cells).orderBy("date"),
        "confidenceInterval": None if ci is None else {"lower": ci[0], "upper": ci[1]},
        "anomalies": S.anomaly_days(cells, threshold),
        "histogram": S.histogram(values).orderBy("bin"),
        "overlay": S.normal_overlay(values).orderBy("i"),
        "hypothesis": S.weekend_test(cells),
        "distribution": values,
        "rows": _rows(cells),
    }


def artist_song_analytics(plays, start=None, end=None, artists=None, content_types=None, top_n: int = 10,
                          catalogs: dict | None = None, persist=False) -> dict:
    """Diversity, featured track, album and artist spotlights, year-in-review picks and
    rankings — all over songs; ``rows`` counts the whole filtered selection."""
    sel = _select(plays, start, end, artists, content_types, persist)
    cells = rollup(
        sel, TRACK, ARTIST, ALBUM, TRACK_URI, "year", "is_song", late_night(sel).alias(LATE), weekend(sel).alias(WEEKEND),
        span=True,
    )
    songs = R.songs(cells)
    featured = R.featured_track(cells)
    albums = R.album_spotlight(cells)
    spot = R.artist_spotlight(cells)
    if catalogs:
        featured = EN.enrich_albums(featured, catalogs["album_primary"], catalogs["album_fallback"])
        albums = EN.enrich_albums(albums, catalogs["album_primary"], catalogs["album_fallback"])
        spot = EN.enrich_artists(spot, catalogs["artist_primary"], catalogs["artist_fallback"])
        if "track_catalog" in catalogs:
            # the track's record wins; the album's image and link stay where the track has none
            album = {"image_url": "_album_image_url", "external_url": "_album_external_url"}
            featured = EN.enrich_tracks(featured.withColumnsRenamed(album), catalogs["track_catalog"])
            featured = featured.withColumns({
                "image_url": F.coalesce("album_image", "_album_image_url"),
                "external_url": F.coalesce("external_url", "_album_external_url"),
            }).drop(*album.values())
    year = R.wrapped_artist_year(cells).first()
    return {
        "_selection": sel,
        "diversityScore": float(S.artist_diversity(songs).first()["diversity_score"]),
        "featuredTrack": featured,
        "topAlbums": albums.orderBy(F.col("play_count").desc(), F.col("play_minutes").desc(), "album", "artist"),
        "topArtists": spot.orderBy("rank"),
        "wrapped": {
            "lateNightTrack": R.wrapped_late_night(cells),
            "mostReplayedArtist": R.wrapped_top_artist(cells),
            "weekendAnthem": R.wrapped_weekend(cells),
            "topArtistYear": {"year": None if year is None else int(year["year"]),
                              "items": R.wrapped_artist_year(cells).select(ARTIST, "plays")},
        },
        "rankings": {
            "topArtists": R.ranking_artists(cells, top_n),
            "topTracks": R.ranking_tracks(cells, top_n),
            "topAlbums": R.ranking_albums(cells, top_n),
            "repeatedTracks": R.repeated_tracks(cells),
        },
        "rows": _rows(cells),
    }


def skip_model(plays, start=None, end=None, artists=None, content_types=None) -> dict:
    """Train and evaluate the skip classifier on the selection's songs."""
    from encore.operators.skip_model import KEPT, classification_report, metrics, train_skip_model

    sel = _select(plays, start, end, artists, content_types, False)
    res = train_skip_model(sel)
    if res.status != "ok":
        return {"status": res.status}
    scored = res.scored.persist(KEPT)  # three numbers a test row, which several passes read
    try:
        m = metrics(scored).first()
        report = {r["label"]: {"precision": r["precision"], "recall": r["recall"], "f1-score": r["f1_score"],
                               "support": r["support"]} for r in classification_report(scored).collect()}  # 5 rows
    finally:
        scored.unpersist()
    return {"status": "ok", "accuracy": m["accuracy"], "roc_auc": m["roc_auc"], "report": report, "model": res.model}


__all__ = [
    "filter_options", "dashboard", "overview", "listening_trends", "behavior_analysis", "time_patterns",
    "statistical_insights", "artist_song_analytics", "skip_model", "release",
]
