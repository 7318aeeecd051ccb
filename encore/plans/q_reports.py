"""The reports (R1-R9) as queries: every section as rows ``section, position, field, text, num``.

A report function returns frames and a few scalars; here its frames are numbered in display order
and turned into one row per field, numbers rounded to six digits. The oracle builds the same rows
from the SQL of the operator that each section shows, so what a report wires together is checked too.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from encore.operators.numbering import numbered
from encore.plans import reports as RP
from encore.plans.oracle import with_plays
from encore.plans.registry import SQL, plays, register

_TEXT = {
    "date", "weekday_name", "artist", "track", "album", "name", "reason_start", "reason_end", "shuffle", "offline",
    "incognito_mode", "platform", "day_period", "week_segment", "first_play", "last_play", "track_uri", "status",
    "master_metadata_track_name", "master_metadata_album_artist_name", "master_metadata_album_album_name",
    "mostActiveDay", "min", "max",
}
_TRACK, _ARTIST, _ALBUM = (
    "master_metadata_track_name", "master_metadata_album_artist_name", "master_metadata_album_album_name")


def _at(report: dict, path: str):
    return reduce(lambda r, k: r[k], path.split("."), report)


# sections with a row per artist or track; the others have k rows, or one per day or category
_UNBOUNDED = {"artists", "rankings.repeatedTracks"}


def _frame_rows(section: str, df: DataFrame, order: str, cols: list[str]) -> DataFrame:
    by = [F.col(o.removesuffix(" desc")).desc() if o.endswith(" desc") else F.col(o).asc() for o in order.split(", ")]
    if section in _UNBOUNDED:
        df = numbered(df, by, "_p")
    else:
        df = df.withColumn("_p", F.row_number().over(Window.orderBy(*by)))

    def field(c: str):
        is_text = c in _TEXT
        return F.struct(
            F.lit(c).alias("field"),
            (F.col(c).cast("string") if is_text else F.lit(None).cast("string")).alias("text"),
            (F.lit(None).cast("double") if is_text else F.round(F.col(c).cast("double"), 6)).alias("num"),
        )

    rows = df.select("_p", F.explode(F.array(*[field(c) for c in cols])).alias("f"))
    return rows.select(F.lit(section).alias("section"), F.col("_p").cast("long").alias("position"), "f.field", "f.text", "f.num")


_ROW = T.StructType([
    T.StructField("section", T.StringType()), T.StructField("position", T.LongType()),
    T.StructField("field", T.StringType()), T.StructField("text", T.StringType()), T.StructField("num", T.DoubleType()),
])


def _scalar_rows(spark, section: str, values: dict, fields: list[str]) -> DataFrame:
    rows = []
    for f in fields:
        v = values.get(f)
        text = f in _TEXT
        rows.append((section, 1, f, v if text else None, None if text or v is None else round(float(v), 6)))
    return spark.createDataFrame(rows, _ROW)


def _sql_rows(section: str, sql: str, order: str | None, cols: list[str]) -> str:
    fields = ", ".join(
        f"{{'field': '{c}', 'text': {c if c in _TEXT else 'NULL'}::VARCHAR, "
        f"'num': {'NULL' if c in _TEXT else f'round(CAST({c} AS DOUBLE), 6)'}::DOUBLE}}" for c in cols)
    p = f"row_number() OVER (ORDER BY {order})" if order else "1"
    return (f"SELECT '{section}' AS section, CAST(p AS BIGINT) AS position, u.field AS field, u.text AS text, u.num AS num "
            f"FROM (SELECT p, unnest([{fields}]) AS u FROM (SELECT *, {p} AS p FROM ({sql}) q0) q1) q2")


def _report(name: str, build, frames: dict, scalars: dict) -> None:
    """``frames``: path in the report -> (operator key or SQL, order, columns); ``scalars``: path ->
    (SQL of one row, fields). Paths of scalars name a dict, or with a trailing ``.`` the report itself."""
    parts = [_sql_rows(s, SQL.get(k, k), o, c.split()) for s, (k, o, c) in frames.items()]
    parts += [_sql_rows(s, q, None, f.split()) for s, (q, f) in scalars.items()]

    @register(name, "\nUNION ALL\n".join(parts))
    def query(spark, sf):
        r = build(plays(spark, sf))
        out = [_frame_rows(s, _at(r, s), o, c.split()) for s, (_, o, c) in frames.items()]
        out += [_scalar_rows(spark, s, r if s == "report" else _at(r, s) or {}, f.split()) for s, (_, f) in scalars.items()]
        return reduce(DataFrame.unionByName, out)


def _count(where: str = "") -> str:
    return with_plays(f"SELECT count(*) AS rows FROM plays {where}")


_KPIS = (f"""SELECT round(total_hours, 2) AS totalHours, tracks_played AS tracksPlayed, unique_artists AS uniqueArtists,
  unique_albums AS uniqueAlbums, round(skip_rate, 2) AS skipRate, round(shuffle_rate, 2) AS shuffleRate, row_count AS rows
FROM ({SQL["kpis"]}) k""", "totalHours tracksPlayed uniqueArtists uniqueAlbums skipRate shuffleRate rows")
_HOURLY = ("hourly_hours", "listening_hour", "listening_hour play_hours")
_WEEKDAY = ("weekday_hours", "weekday_num", "weekday_num weekday_name play_hours")
_DAILY = ("daily_hours", "date", "date play_hours")

_report("report_options", RP.filter_options, {
    "artists": (f"SELECT artist FROM ({SQL['filter_options']}) o", "artist", "artist"),
}, {"dateRange": (f"SELECT min(min_date) AS min, max(max_date) AS max FROM ({SQL['filter_options']}) o", "min max")})

_report("report_dashboard", RP.dashboard, {
    "hourly": _HOURLY, "weekday": _WEEKDAY, "daily": _DAILY,
    "topArtists": ("top_artists_hours", "play_hours desc, artist", "artist play_hours"),
    "topTracks": ("top_tracks_hours", "play_hours desc, track", "track play_hours"),
    "favoriteAlbums": ("favorite_albums", "play_hours desc, album, artist", "album artist play_hours"),
    "contentMix": ("content_mix", "name", "name value"),
    "platformShare": ("platform_share", "name", "name value"),
}, {"kpis": _KPIS})

_report("report_overview", RP.overview, {"hourly": _HOURLY, "weekday": _WEEKDAY}, {
    "kpis": _KPIS,
    "highlights": (f"SELECT most_active_hour AS mostActiveHour, most_active_day AS mostActiveDay FROM ({SQL['peak_hour_day']}) k",
                   "mostActiveHour mostActiveDay"),
})

_report("report_trends", RP.listening_trends, {
    "daily": ("daily_trend", "date", "date play_hours rolling_7d cumulative_hours"),
    "weekly": ("weekly_hours", "date", "date play_hours"),
    "monthly": ("monthly_hours", "date", "date play_hours"),
    "yearly": ("yearly_hours", "date", "date play_hours"),
}, {"stats": (SQL["daily_stats"], "mean median variance std_dev p25 p50 p75 p90"), "report": (_count(), "rows")})

_report("report_behavior", RP.behavior_analysis, {
    "startCounts": ("start_reason_counts", "count desc, reason_start", "reason_start count"),
    "endCounts": ("end_reason_counts", "count desc, reason_end", "reason_end count"),
    "skipByReason": ("skip_by_reason", "reason_end", "reason_end skip_rate count"),
    "shuffleCompare": ("shuffle_compare", "shuffle", "shuffle skip_rate avg_minutes count"),
    "offlineShare": ("offline_share", "offline", "offline hours skip_rate"),
    "incognitoShare": ("incognito_share", "incognito_mode", "incognito_mode hours plays"),
    "platformUsage": ("platform_usage", "plays desc, platform", "platform plays hours skip_rate"),
}, {"report": (_count(), "rows")})

_report("report_time_patterns", RP.time_patterns, {
    "heatmap": ("heatmap_wide", "weekday_num", "weekday_num weekday_name " + " ".join(f"h{h:02d}" for h in range(24))),
    "seasonal": ("monthly_seasonality", "month", "month play_hours"),
    "dayNight": ("day_night", "day_period", "day_period hours plays"),
    "weekSegment": ("week_segment", "week_segment", "week_segment hours avg_minutes"),
    "hourCurve": _HOURLY,
}, {"report": (_count(), "rows")})

_report("report_statistics", RP.statistical_insights, {
    "daily": _DAILY,
    "distribution": (f"SELECT date, play_hours AS x FROM ({SQL['daily_hours']}) d", "date", "date x"),
    "anomalies": ("anomaly_days", "date", "date play_hours zscore"),
    "histogram": ("daily_histogram", "bin", "bin range_start range_end count"),
    "overlay": ("normal_overlay", "i", "i x"),
}, {
    "confidenceInterval": (SQL["daily_ci"], "lower upper"),
    "hypothesis": (f"SELECT 'ok' AS status, t_stat, p_value FROM ({SQL['weekend_p']}) w", "status t_stat p_value"),
    "report": (_count(), "rows"),
})

_report("report_artist_song", RP.artist_song_analytics, {
    "featuredTrack": ("featured_track", "track", "track artist album streams listening_minutes first_play last_play track_uri"),
    "topAlbums": ("album_spotlight", "play_count desc, play_minutes desc, album, artist", "album artist play_count play_minutes"),
    "topArtists": (f"SELECT rank, artist, total_plays, total_minutes, round(share, 2) AS share FROM ({SQL['artist_spotlight']}) a",
                   "rank", "rank artist total_plays total_minutes share"),
    "wrapped.lateNightTrack": ("wrapped_late_night", _TRACK, f"{_TRACK} plays"),
    "wrapped.mostReplayedArtist": ("wrapped_top_artist", _ARTIST, f"{_ARTIST} plays"),
    "wrapped.weekendAnthem": ("wrapped_weekend", _TRACK, f"{_TRACK} plays"),
    "wrapped.topArtistYear.items": ("wrapped_artist_year", _ARTIST, f"{_ARTIST} plays"),
    "rankings.topArtists": ("ranking_artists", f"plays desc, {_ARTIST}", f"{_ARTIST} plays hours"),
    "rankings.topTracks": ("ranking_tracks", f"plays desc, {_TRACK}, {_ARTIST}", f"{_TRACK} {_ARTIST} plays hours"),
    "rankings.topAlbums": ("ranking_albums", f"plays desc, {_ALBUM}", f"{_ALBUM} plays hours"),
    "rankings.repeatedTracks": ("repeated_tracks", f"play_count desc, {_TRACK}, {_ARTIST}", f"{_TRACK} {_ARTIST} play_count"),
}, {
    "wrapped.topArtistYear": (f"SELECT year FROM ({SQL['wrapped_artist_year']}) y", "year"),
    "report": (f"SELECT (SELECT rows FROM ({_count()}) c) AS rows, diversity_score AS diversityScore FROM ({SQL['artist_diversity']}) a",
               "rows diversityScore"),
})

# a selection that no play of the log belongs to: every frame is empty, every figure 0
_NONE = "SELECT * FROM ({}) q WHERE FALSE"
_report("report_empty", lambda p: RP.dashboard(p, artists=["no artist of this name"]), {
    "hourly": (_NONE.format(SQL["hourly_hours"]), *_HOURLY[1:]),
    "weekday": (_NONE.format(SQL["weekday_hours"]), *_WEEKDAY[1:]),
    "daily": (_NONE.format(SQL["daily_hours"]), *_DAILY[1:]),
    "topArtists": (_NONE.format(SQL["top_artists_hours"]), "artist", "artist play_hours"),
    "topTracks": (_NONE.format(SQL["top_tracks_hours"]), "track", "track play_hours"),
    "favoriteAlbums": (_NONE.format(SQL["favorite_albums"]), "album, artist", "album artist play_hours"),
}, {"kpis": ("SELECT 0 AS totalHours, 0 AS tracksPlayed, 0 AS uniqueArtists, 0 AS uniqueAlbums, 0 AS skipRate, "
             "0 AS shuffleRate, 0 AS rows", _KPIS[1])})
