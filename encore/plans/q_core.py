"""Registered queries over the curated plays table, each with its DuckDB oracle.

Output conventions shared with the oracle: dates and timestamps leave as ISO text (as the
dashboard's records do), counts are BIGINT, statistics are rounded to 6 decimals (their
summation order differs between engines; sums of whole milliseconds are exact and are not
rounded).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from encore.operators import aggregates as A
from encore.operators import filters as FL
from encore.operators import rankings as R
from encore.operators import statistics as S
from encore.operators import trends
from encore.plans.oracle import with_plays
from encore.plans.registry import plays, register
from encore.schema import ARTIST, TRACK
from encore.sources.curated import curated_columns

H = "coalesce(sum(ms_played), 0.0) / 3600000.0"
MIN = "coalesce(sum(ms_played), 0.0) / 60000.0"
RATE = "CAST(sum(CAST(is_skipped AS BIGINT)) AS DOUBLE) / count(*)"
D = "strftime({c}, '%Y-%m-%d')"
TS = "strftime({c}, '%Y-%m-%d %H:%M:%S')"


def iso_ts(c: str, name: str | None = None) -> Column:
    return F.date_format(F.col(c), "yyyy-MM-dd HH:mm:ss").alias(name or c)


def r6(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), 6) for c in cols})


def dated(df: DataFrame, col: str = "date") -> DataFrame:
    return df.withColumn(col, F.date_format(F.col(col), "yyyy-MM-dd"))


# --- cleaning / projections ----------------------------------------------------------------


_PREPARED = with_plays(f"""
SELECT * REPLACE ({TS.format(c='ts')} AS ts, {D.format(c='date')} AS date, CAST(skipped AS VARCHAR) AS skipped)
FROM plays
""", sessions=True)


def _prepared(p):
    # the raw, nullable ``skipped`` flag leaves as text so NULL stays NULL in every client
    return curated_columns(p).withColumns({
        "ts": F.date_format("ts", "yyyy-MM-dd HH:mm:ss"),
        "date": F.date_format("date", "yyyy-MM-dd"),
        "skipped": F.col("skipped").cast("string"),
    })


@register("prepared_plays", _PREPARED)
def q_prepared_plays(spark, sf):
    return _prepared(plays(spark, sf))


@register("incremental_plays", _PREPARED)
def q_incremental_plays(spark, sf):
    """The curated table by two arrivals that share a third of the log, which is joined and stored once for both."""
    from encore.sources import fs
    from encore.sources.incremental import apply_arrivals, read_incremental
    from encore.sources.star import star_plays

    path, log = fs.temporary(spark, "incremental"), fs.temporary(spark, "log")
    star_plays(spark, sf).write.parquet(log)
    part = F.pmod(F.xxhash64("track_uri", "ts", "ms_played"), F.lit(3))
    for parts in ((0, 1), (1, 2)):
        apply_arrivals(spark, spark.read.parquet(log).where(part.isin(*parts)), path, stored=log)
    return _prepared(read_incremental(spark, path))


@register("calendar_parts", with_plays(f"""
SELECT {D.format(c='date')} AS date, year, month, weekday_num, weekday_name, listening_hour,
  CAST(count(*) AS BIGINT) AS plays
FROM plays GROUP BY date, year, month, weekday_num, weekday_name, listening_hour
"""))
def q_calendar_parts(spark, sf):
    g = plays(spark, sf).groupBy("date", "year", "month", "weekday_num", "weekday_name", "listening_hour").agg(
        F.count(F.lit(1)).cast("long").alias("plays")
    )
    return dated(g)


@register("content_flags", with_plays("""
SELECT is_podcast, is_audiobook, is_song, is_skipped, is_fully_played, CAST(count(*) AS BIGINT) AS plays
FROM plays GROUP BY ALL
"""))
def q_content_flags(spark, sf):
    return plays(spark, sf).groupBy("is_podcast", "is_audiobook", "is_song", "is_skipped", "is_fully_played").agg(
        F.count(F.lit(1)).cast("long").alias("plays")
    )


@register("track_uri_parts", with_plays("""
SELECT track_uri,
  CASE WHEN starts_with(track_uri, 'music:') AND len(string_split(track_uri, ':')) = 3
       THEN string_split(track_uri, ':')[2] END AS uri_kind,
  CASE WHEN starts_with(track_uri, 'music:') AND len(string_split(track_uri, ':')) = 3
       THEN string_split(track_uri, ':')[3] END AS uri_id,
  CAST(count(*) AS BIGINT) AS plays
FROM plays GROUP BY track_uri
"""))
def q_track_uri_parts(spark, sf):
    from encore.functions.columns import uri_id, uri_kind

    g = plays(spark, sf).groupBy("track_uri").agg(F.count(F.lit(1)).cast("long").alias("plays"))
    return g.select(
        "track_uri", uri_kind("track_uri").alias("uri_kind"), uri_id("track_uri").alias("uri_id"),
        "plays",
    )


@register("day_night", with_plays(f"""
SELECT CASE WHEN listening_hour >= 6 AND listening_hour < 18 THEN 'Day' ELSE 'Night' END AS day_period,
  {H} AS hours, CAST(count(*) AS BIGINT) AS plays
FROM plays GROUP BY 1
"""))
def q_day_night(spark, sf):
    return A.day_night(plays(spark, sf))


@register("week_segment", with_plays("""
SELECT CASE WHEN weekday_num >= 5 THEN 'Weekend' ELSE 'Weekday' END AS week_segment,
  coalesce(sum(ms_played), 0.0) / 3600000.0 AS hours, sum(ms_played) / count(*) / 60000.0 AS avg_minutes
FROM plays GROUP BY 1
"""))
def q_week_segment(spark, sf):
    return A.week_segment_hours(plays(spark, sf))


# --- trends --------------------------------------------------------------------------------


@register("daily_trend", with_plays(f"""
SELECT {D.format(c='d')} AS date, day_ms / 3600000.0 AS play_hours,
  sum(day_ms) OVER w7 / count(*) OVER w7 / 3600000.0 AS rolling_7d,
  sum(day_ms) OVER (ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / 3600000.0 AS cumulative_hours
FROM (SELECT date AS d, coalesce(sum(ms_played), 0.0) AS day_ms FROM plays GROUP BY date)
WINDOW w7 AS (ORDER BY d ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)
"""))
def q_daily_trend(spark, sf):
    return dated(trends.daily_trend(plays(spark, sf)))


@register("daily_hours", with_plays(f"""
SELECT {D.format(c='d')} AS date, play_hours FROM (SELECT date AS d, {H} AS play_hours FROM plays GROUP BY date)
"""))
def q_daily_hours(spark, sf):
    return dated(trends.daily_hours(plays(spark, sf)))


_CAL = """
WITH d AS (SELECT date, coalesce(sum(ms_played), 0.0) AS day_ms FROM plays GROUP BY date),
b AS (SELECT {label} AS bin, day_ms FROM d),
s AS (SELECT bin, sum(day_ms) AS bin_ms FROM b GROUP BY bin),
m AS (SELECT min(bin) AS lo, max(bin) AS hi FROM b),
cal AS ({calendar})
SELECT strftime(cal.bin, '%Y-%m-%d') AS date, coalesce(s.bin_ms, 0.0) / 3600000.0 AS play_hours
FROM cal LEFT JOIN s ON cal.bin = s.bin
"""

_WEEK = _CAL.format(
    label="CAST(date + CAST(7 - isodow(date) AS INTEGER) AS DATE)",
    calendar="SELECT CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 7 DAY)) AS DATE)"
    " AS bin FROM m WHERE lo IS NOT NULL",
)
_MONTH = _CAL.format(
    label="last_day(date)",
    calendar="SELECT last_day(CAST(unnest(generate_series(CAST(date_trunc('month', lo) AS TIMESTAMP), CAST(hi AS TIMESTAMP),"
    " INTERVAL 1 MONTH)) AS DATE)) AS bin FROM m WHERE lo IS NOT NULL",
)
_YEAR = _CAL.format(
    label="make_date(year(date), 12, 31)",
    calendar="SELECT make_date(CAST(unnest(generate_series(year(lo), year(hi))) AS BIGINT), 12, 31) AS bin"
    " FROM m WHERE lo IS NOT NULL",
)


@register("weekly_hours", with_plays(_WEEK))
def q_weekly_hours(spark, sf):
    return dated(trends.weekly_hours(plays(spark, sf)))


@register("monthly_hours", with_plays(_MONTH))
def q_monthly_hours(spark, sf):
    return dated(trends.monthly_hours(plays(spark, sf)))


@register("yearly_hours", with_plays(_YEAR))
def q_yearly_hours(spark, sf):
    return dated(trends.yearly_hours(plays(spark, sf)))


# --- plain aggregates ----------------------------------------------------------------------


@register("kpis", with_plays(f"""
SELECT {H} AS total_hours,
  CAST(count_if(is_song) AS BIGINT) AS tracks_played,
  CAST(count(DISTINCT master_metadata_album_artist_name) AS BIGINT) AS unique_artists,
  CAST(count(DISTINCT master_metadata_album_album_name) AS BIGINT) AS unique_albums,
  coalesce(CAST(sum(CAST(is_skipped AS BIGINT)) AS DOUBLE) / count(*) * 100.0, 0.0) AS skip_rate,
  coalesce(CAST(sum(CAST(shuffle AS BIGINT)) AS DOUBLE) / count(*) * 100.0, 0.0) AS shuffle_rate,
  CAST(count(*) AS BIGINT) AS row_count
FROM plays
"""))
def q_kpis(spark, sf):
    return A.kpis(plays(spark, sf)).withColumnRenamed("rows", "row_count")


@register("hourly_hours", with_plays(f"SELECT listening_hour, {H} AS play_hours FROM plays GROUP BY listening_hour"))
def q_hourly_hours(spark, sf):
    return A.hourly_hours(plays(spark, sf))


@register("weekday_hours", with_plays(
    f"SELECT weekday_num, weekday_name, {H} AS play_hours FROM plays GROUP BY weekday_num, weekday_name"))
def q_weekday_hours(spark, sf):
    return A.weekday_hours(plays(spark, sf))


@register("content_mix", with_plays("""
SELECT 'Songs' AS name, CAST(count_if(is_song) AS DOUBLE) AS value FROM plays
UNION ALL SELECT 'Podcasts', CAST(count_if(is_podcast) AS DOUBLE) FROM plays
UNION ALL SELECT 'Audiobooks', CAST(count_if(is_audiobook) AS DOUBLE) FROM plays
"""))
def q_content_mix(spark, sf):
    return A.content_mix(plays(spark, sf))


@register("platform_share", with_plays(
    f"SELECT platform AS name, {H} AS value FROM plays GROUP BY platform ORDER BY value DESC, name ASC LIMIT 8"))
def q_platform_share(spark, sf):
    return A.platform_share(plays(spark, sf))


@register("start_reason_counts", with_plays(
    "SELECT reason_start, CAST(count(*) AS BIGINT) AS count FROM plays GROUP BY reason_start"))
def q_start_reason_counts(spark, sf):
    return A.value_counts(plays(spark, sf), "reason_start")


@register("end_reason_counts", with_plays(
    "SELECT reason_end, CAST(count(*) AS BIGINT) AS count FROM plays GROUP BY reason_end"))
def q_end_reason_counts(spark, sf):
    return A.value_counts(plays(spark, sf), "reason_end")


@register("skip_by_reason", with_plays(
    f"SELECT reason_end, {RATE} AS skip_rate, CAST(count(*) AS BIGINT) AS count FROM plays GROUP BY reason_end"))
def q_skip_by_reason(spark, sf):
    return A.skip_by_reason(plays(spark, sf))


@register("shuffle_compare", with_plays(f"""
SELECT CASE WHEN shuffle THEN 'Shuffle On' ELSE 'Shuffle Off' END AS shuffle, {RATE} AS skip_rate,
  sum(ms_played) / count(*) / 60000.0 AS avg_minutes, CAST(count(*) AS BIGINT) AS count
FROM plays GROUP BY plays.shuffle
"""))
def q_shuffle_compare(spark, sf):
    return A.shuffle_compare(plays(spark, sf))


@register("offline_share", with_plays(f"""
SELECT CASE WHEN offline THEN 'Offline' ELSE 'Online' END AS offline, {H} AS hours, {RATE} AS skip_rate
FROM plays GROUP BY plays.offline
"""))
def q_offline_share(spark, sf):
    return A.offline_share(plays(spark, sf))


@register("incognito_share", with_plays(f"""
SELECT CASE WHEN incognito_mode THEN 'Incognito' ELSE 'Normal' END AS incognito_mode, {H} AS hours,
  CAST(count(*) AS BIGINT) AS plays
FROM plays GROUP BY plays.incognito_mode
"""))
def q_incognito_share(spark, sf):
    return A.incognito_share(plays(spark, sf))


@register("platform_usage", with_plays(f"""
SELECT platform, CAST(count(*) AS BIGINT) AS plays, {H} AS hours, {RATE} AS skip_rate FROM plays GROUP BY platform
"""))
def q_platform_usage(spark, sf):
    return A.platform_usage(plays(spark, sf))


@register("monthly_seasonality", with_plays(f"SELECT month, {H} AS play_hours FROM plays GROUP BY month"))
def q_monthly_seasonality(spark, sf):
    return A.monthly_seasonality(plays(spark, sf))


_GRID = """
WITH cells AS (SELECT weekday_num, listening_hour, coalesce(sum(ms_played), 0.0) / 60000.0 AS m
               FROM plays GROUP BY weekday_num, listening_hour),
grid AS (SELECT CAST(w.range AS INTEGER) AS weekday_num, CAST(h.range AS INTEGER) AS listening_hour
         FROM range(7) w, range(24) h),
long AS (SELECT g.weekday_num,
    ['Monday','Tuesday','Wednesday','Thursday','Friday','Saturday','Sunday'][g.weekday_num + 1] AS weekday_name,
    g.listening_hour, coalesce(c.m, 0.0) AS play_minutes
  FROM grid g LEFT JOIN cells c ON g.weekday_num = c.weekday_num AND g.listening_hour = c.listening_hour)
"""


@register("heatmap_long", with_plays(_GRID + "SELECT * FROM long"))
def q_heatmap_long(spark, sf):
    return A.heatmap_long(plays(spark, sf))


@register("heatmap_wide", with_plays(
    _GRID
    + "SELECT weekday_num, weekday_name, "
    + ", ".join(f"coalesce(max(CASE WHEN listening_hour = {h} THEN play_minutes END), 0.0) AS h{h:02d}" for h in range(24))
    + " FROM long GROUP BY weekday_num, weekday_name"
))
def q_heatmap_wide(spark, sf):
    return A.heatmap_wide(plays(spark, sf))


@register("heatmap_present", with_plays("""
WITH cells AS (SELECT weekday_num, weekday_name, listening_hour, coalesce(sum(ms_played), 0.0) / 60000.0 AS m
               FROM plays GROUP BY weekday_num, weekday_name, listening_hour)
SELECT d.weekday_num, d.weekday_name, h.listening_hour, coalesce(c.m, 0.0) AS play_minutes
FROM (SELECT DISTINCT weekday_num, weekday_name FROM cells) d
CROSS JOIN (SELECT DISTINCT listening_hour FROM cells) h
LEFT JOIN cells c ON c.weekday_num = d.weekday_num AND c.listening_hour = h.listening_hour
"""))
def q_heatmap_present(spark, sf):
    return A.heatmap_present(plays(spark, sf))


@register("peak_hour_day", with_plays(f"""
SELECT h.listening_hour AS most_active_hour, d.weekday_name AS most_active_day
FROM (SELECT listening_hour, {H} AS v FROM plays GROUP BY listening_hour ORDER BY v DESC, listening_hour LIMIT 1) h,
     (SELECT weekday_num, weekday_name, {H} AS v FROM plays GROUP BY weekday_num, weekday_name
      ORDER BY v DESC, weekday_num LIMIT 1) d
"""))
def q_peak_hour_day(spark, sf):
    return A.peak_hour_day(plays(spark, sf))


@register("filter_options", with_plays(f"""
SELECT a.artist, {D.format(c='s.min_date')} AS min_date, {D.format(c='s.max_date')} AS max_date, s.files_loaded
FROM (SELECT DISTINCT master_metadata_album_artist_name AS artist FROM plays) a,
     (SELECT min(date) AS min_date, max(date) AS max_date, CAST(count(DISTINCT source_file) AS BIGINT) AS files_loaded
      FROM plays) s
"""))
def q_filter_options(spark, sf):
    o = A.filter_options(plays(spark, sf))
    return o.withColumns({"min_date": F.date_format("min_date", "yyyy-MM-dd"), "max_date": F.date_format("max_date", "yyyy-MM-dd")})


# --- filters -------------------------------------------------------------------------------

_ROWS = f"""SELECT {TS.format(c='ts')} AS ts, master_metadata_track_name, master_metadata_album_artist_name,
  ms_played, is_song, is_podcast, is_audiobook FROM plays"""


def _rows(df: DataFrame) -> DataFrame:
    return df.select(iso_ts("ts"), TRACK, ARTIST, "ms_played", "is_song", "is_podcast", "is_audiobook")


@register("filter_date_range", with_plays(_ROWS + " WHERE date BETWEEN DATE '1996-03-01' AND DATE '1997-02-28'"))
def q_filter_date_range(spark, sf):
    return _rows(FL.date_range(plays(spark, sf), "1996-03-01", "1997-02-28"))


_ARTISTS = ["Brand#11", "Brand#23", "Brand#35", "Unknown Artist"]


@register("filter_artists", with_plays(
    _ROWS + " WHERE master_metadata_album_artist_name IN (" + ", ".join(f"'{a}'" for a in _ARTISTS) + ")"))
def q_filter_artists(spark, sf):
    return _rows(FL.artists(plays(spark, sf), _ARTISTS))


@register("filter_content_types", with_plays(_ROWS + " WHERE is_podcast OR is_audiobook"))
def q_filter_content_types(spark, sf):
    return _rows(FL.content_types(plays(spark, sf), ["Podcasts", "Audiobooks", "Vinyl"]))


@register("filter_combined", with_plays(
    _ROWS + " WHERE date BETWEEN DATE '1995-06-01' AND DATE '1998-12-31' AND is_song"
    " AND master_metadata_album_artist_name IN ('Brand#12', 'Brand#21', 'Brand#33')"))
def q_filter_combined(spark, sf):
    return _rows(FL.apply_filters(plays(spark, sf), "1995-06-01", "1998-12-31", ["Brand#12", "Brand#21", "Brand#33"], ["Songs"]))


@register("content_subsets", with_plays("""
SELECT 'songs' AS subset, CAST(count_if(is_song) AS BIGINT) AS plays,
  coalesce(sum(CASE WHEN is_song THEN ms_played END), 0.0) / 3600000.0 AS hours FROM plays
UNION ALL SELECT 'podcasts', CAST(count_if(is_podcast) AS BIGINT),
  coalesce(sum(CASE WHEN is_podcast THEN ms_played END), 0.0) / 3600000.0 FROM plays
UNION ALL SELECT 'audiobooks', CAST(count_if(is_audiobook) AS BIGINT),
  coalesce(sum(CASE WHEN is_audiobook THEN ms_played END), 0.0) / 3600000.0 FROM plays
"""))
def q_content_subsets(spark, sf):
    p = plays(spark, sf)
    aggs = []
    for name, flag in [("songs", "is_song"), ("podcasts", "is_podcast"), ("audiobooks", "is_audiobook")]:
        aggs += [
            F.count_if(F.col(flag)).cast("long").alias(f"{name}_n"),
            (F.coalesce(F.sum(F.when(F.col(flag), F.col("ms_played"))), F.lit(0.0)) / F.lit(3600000.0)).alias(f"{name}_h"),
        ]
    one = p.agg(*aggs)  # one pass over the data, three subsets
    return one.select(F.expr(
        "stack(3, 'songs', songs_n, songs_h, 'podcasts', podcasts_n, podcasts_h, "
        "'audiobooks', audiobooks_n, audiobooks_h) AS (subset, plays, hours)"
    ))


# --- rankings ------------------------------------------------------------------------------


def _top(select: str, group: str, order: str, k: int | None, where: str = "") -> str:
    lim = f" LIMIT {k}" if k else ""
    w = f" WHERE {where}" if where else ""
    return with_plays(f"SELECT {select} FROM plays{w} GROUP BY {group} ORDER BY {order}{lim}")


@register("top_artists_hours", _top(f"master_metadata_album_artist_name AS artist, {H} AS play_hours",
                                    "1", "play_hours DESC, artist", 10))
def q_top_artists_hours(spark, sf):
    return R.top_artists_hours(plays(spark, sf))


@register("top_tracks_hours", _top(f"master_metadata_track_name AS track, {H} AS play_hours",
                                   "1", "play_hours DESC, track", 10))
def q_top_tracks_hours(spark, sf):
    return R.top_tracks_hours(plays(spark, sf))


@register("favorite_albums", _top(
    f"master_metadata_album_album_name AS album, master_metadata_album_artist_name AS artist, {H} AS play_hours",
    "1, 2", "play_hours DESC, album, artist", 10))
def q_favorite_albums(spark, sf):
    return R.favorite_albums(plays(spark, sf))


@register("featured_track", _top(
    f"""master_metadata_track_name AS track, master_metadata_album_artist_name AS artist,
  master_metadata_album_album_name AS album, CAST(count(*) AS BIGINT) AS streams, {MIN} AS listening_minutes,
  {D.format(c='min(ts)')} AS first_play, {D.format(c='max(ts)')} AS last_play,
  arg_min(track_uri, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') || track_uri) FILTER (WHERE track_uri IS NOT NULL) AS track_uri""",
    "1, 2, 3", "streams DESC, listening_minutes DESC, track, artist, album", 1, "is_song"))
def q_featured_track(spark, sf):
    return R.featured_track(plays(spark, sf))


@register("album_spotlight", _top(
    f"""master_metadata_album_album_name AS album, master_metadata_album_artist_name AS artist,
  CAST(count(*) AS BIGINT) AS play_count, {MIN} AS play_minutes""",
    "1, 2", "play_count DESC, play_minutes DESC, album, artist", 8, "is_song"))
def q_album_spotlight(spark, sf):
    return R.album_spotlight(plays(spark, sf))


@register("artist_spotlight", with_plays(f"""
SELECT CAST(row_number() OVER (ORDER BY total_plays DESC, total_minutes DESC, artist) AS INTEGER) AS rank,
  artist, total_plays, total_minutes,
  CAST(100 AS DOUBLE) * total_plays / (SELECT greatest(count(*), 1) FROM plays WHERE is_song) AS share
FROM (SELECT master_metadata_album_artist_name AS artist, CAST(count(*) AS BIGINT) AS total_plays,
        {MIN} AS total_minutes
      FROM plays WHERE is_song GROUP BY 1 ORDER BY total_plays DESC, total_minutes DESC, artist LIMIT 5)
"""))
def q_artist_spotlight(spark, sf):
    return R.artist_spotlight(plays(spark, sf), digits=None)


@register("wrapped_late_night", _top(
    "master_metadata_track_name, CAST(count(*) AS BIGINT) AS plays", "1", "plays DESC, 1", 1,
    "is_song AND listening_hour BETWEEN 0 AND 4"))
def q_wrapped_late_night(spark, sf):
    return R.wrapped_late_night(plays(spark, sf))


@register("wrapped_top_artist", _top(
    "master_metadata_album_artist_name, CAST(count(*) AS BIGINT) AS plays", "1", "plays DESC, 1", 1, "is_song"))
def q_wrapped_top_artist(spark, sf):
    return R.wrapped_top_artist(plays(spark, sf))


@register("wrapped_weekend", _top(
    "master_metadata_track_name, CAST(count(*) AS BIGINT) AS plays", "1", "plays DESC, 1", 1,
    "is_song AND weekday_num >= 5"))
def q_wrapped_weekend(spark, sf):
    return R.wrapped_weekend(plays(spark, sf))


@register("wrapped_artist_year", with_plays("""
SELECT m.y AS year, t.master_metadata_album_artist_name, t.plays
FROM (SELECT max(year) AS y FROM plays WHERE is_song) m,
     (SELECT master_metadata_album_artist_name, CAST(count(*) AS BIGINT) AS plays FROM plays
      WHERE is_song AND year = (SELECT max(year) FROM plays WHERE is_song)
      GROUP BY 1 ORDER BY plays DESC, 1 LIMIT 1) t
"""))
def q_wrapped_artist_year(spark, sf):
    return R.wrapped_artist_year(plays(spark, sf))


_PH = f"CAST(count(*) AS BIGINT) AS plays, {H} AS hours"


@register("ranking_artists", _top(f"master_metadata_album_artist_name, {_PH}", "1",
                                  "plays DESC, master_metadata_album_artist_name", 10, "is_song"))
def q_ranking_artists(spark, sf):
    return R.ranking_artists(plays(spark, sf), 10)


@register("ranking_tracks", _top(f"master_metadata_track_name, master_metadata_album_artist_name, {_PH}", "1, 2",
                                 "plays DESC, master_metadata_track_name, master_metadata_album_artist_name", 10,
                                 "is_song"))
def q_ranking_tracks(spark, sf):
    return R.ranking_tracks(plays(spark, sf), 10)


@register("ranking_track_labels", with_plays(f"""
SELECT master_metadata_track_name, master_metadata_album_artist_name, {_PH},
  master_metadata_track_name || ' - ' || master_metadata_album_artist_name AS label
FROM plays WHERE is_song GROUP BY 1, 2
ORDER BY plays DESC, master_metadata_track_name, master_metadata_album_artist_name LIMIT 10
"""))
def q_ranking_track_labels(spark, sf):
    return R.with_track_label(R.ranking_tracks(plays(spark, sf), 10))


@register("ranking_albums", _top(f"master_metadata_album_album_name, {_PH}", "1",
                                 "plays DESC, master_metadata_album_album_name", 10, "is_song"))
def q_ranking_albums(spark, sf):
    return R.ranking_albums(plays(spark, sf), 10)


@register("repeated_tracks", with_plays("""
SELECT master_metadata_track_name, master_metadata_album_artist_name, CAST(count(*) AS BIGINT) AS play_count
FROM plays WHERE is_song GROUP BY 1, 2 HAVING count(*) >= 5
"""))
def q_repeated_tracks(spark, sf):
    return R.repeated_tracks(plays(spark, sf))


# --- statistics ----------------------------------------------------------------------------

_DAILY = "WITH d AS (SELECT date, coalesce(sum(ms_played), 0.0) / 3600000.0 AS x FROM plays GROUP BY date)"


@register("daily_stats", with_plays(_DAILY + """
SELECT CAST(count(*) AS BIGINT) AS n, round(avg(x), 6) AS mean, round(quantile_cont(x, 0.5), 6) AS median,
  round(CASE WHEN count(*) = 1 THEN 0.0 ELSE var_samp(x) END, 6) AS variance,
  round(CASE WHEN count(*) = 1 THEN 0.0 ELSE stddev_samp(x) END, 6) AS std_dev,
  round(quantile_cont(x, 0.25), 6) AS p25, round(quantile_cont(x, 0.5), 6) AS p50,
  round(quantile_cont(x, 0.75), 6) AS p75, round(quantile_cont(x, 0.9), 6) AS p90
FROM d HAVING count(*) > 0
"""))
def q_daily_stats(spark, sf):
    return r6(S.daily_stats(plays(spark, sf)), "mean", "median", "variance", "std_dev", "p25", "p50", "p75", "p90")


@register("daily_ci_moments", with_plays(_DAILY + """
SELECT CAST(count(*) AS BIGINT) AS n, round(avg(x), 6) AS mean, round(stddev_samp(x) / sqrt(count(*)), 6) AS std_err
FROM d
"""))
def q_daily_ci_moments(spark, sf):
    return r6(S.ci_moments(S.daily_values(plays(spark, sf))), "mean", "std_err")


@register("anomaly_days", with_plays(_DAILY + """
, m AS (SELECT avg(x) AS mu, stddev_pop(x) AS sd FROM d)
SELECT strftime(date, '%Y-%m-%d') AS date, play_hours, round(zscore, 6) AS zscore FROM (
  SELECT d.date, d.x AS play_hours, coalesce((d.x - m.mu) / nullif(m.sd, 0.0), 0.0) AS zscore FROM d, m)
WHERE abs(zscore) >= 2.5
"""))
def q_anomaly_days(spark, sf):
    return r6(dated(S.anomaly_days(plays(spark, sf), 2.5)), "zscore")


@register("weekend_test", with_plays("""
WITH d AS (SELECT coalesce(sum(ms_played), 0.0) / 60000.0 AS m, isodow(date) >= 6 AS we FROM plays GROUP BY date),
a AS (SELECT CAST(count_if(NOT we) AS BIGINT) AS n1, CAST(count_if(we) AS BIGINT) AS n2,
        avg(CASE WHEN NOT we THEN m END) AS m1, avg(CASE WHEN we THEN m END) AS m2,
        var_samp(CASE WHEN NOT we THEN m END) AS v1, var_samp(CASE WHEN we THEN m END) AS v2 FROM d)
SELECT CASE WHEN n1 >= 2 AND n2 >= 2 THEN 'ok' ELSE 'insufficient_data' END AS status,
  n1 AS weekday_days, n2 AS weekend_days,
  round(CASE WHEN n1 >= 2 AND n2 >= 2 THEN m1 END, 6) AS weekday_mean,
  round(CASE WHEN n1 >= 2 AND n2 >= 2 THEN m2 END, 6) AS weekend_mean,
  round(CASE WHEN n1 >= 2 AND n2 >= 2 AND v1 / n1 + v2 / n2 > 0 THEN (m1 - m2) / sqrt(v1 / n1 + v2 / n2) END, 6) AS t_stat,
  round(CASE WHEN n1 >= 2 AND n2 >= 2 AND v1 / n1 + v2 / n2 > 0 THEN pow(v1 / n1 + v2 / n2, 2)
        / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1)) END, 6) AS dof
FROM a
"""))
def q_weekend_test(spark, sf):
    return r6(S.weekend_moments(plays(spark, sf)), "weekday_mean", "weekend_mean", "t_stat", "dof")


@register("artist_diversity", with_plays("""
SELECT round(CASE WHEN sum(c) > 0 THEN 1.0 - sum(c * c) / (sum(c) * sum(c)) ELSE 0.0 END, 6) AS diversity_score
FROM (SELECT CAST(count(*) AS DOUBLE) AS c FROM plays WHERE is_song GROUP BY master_metadata_album_artist_name)
"""))
def q_artist_diversity(spark, sf):
    return r6(S.artist_diversity(R.songs(plays(spark, sf))), "diversity_score")


@register("daily_histogram", with_plays(_DAILY + """
, m AS (SELECT min(x) AS lo, max(x) AS hi, count(*) AS n FROM d),
c AS (SELECT CASE WHEN m.hi = m.lo THEN 0
                  ELSE CAST(least(floor((d.x - m.lo) / ((m.hi - m.lo) / 20.0)), 19) AS INTEGER) END AS bin,
             CAST(count(*) AS BIGINT) AS cnt
      FROM d, m GROUP BY 1),
b AS (SELECT CAST(i.range AS INTEGER) AS bin, m.lo, m.hi, m.n FROM range(20) i, m
      WHERE m.n > 0 AND (m.hi > m.lo OR i.range = 0))
SELECT b.bin,
  round(CASE WHEN hi = lo THEN lo ELSE lo + b.bin * ((hi - lo) / 20.0) END, 6) AS range_start,
  round(CASE WHEN hi = lo THEN hi ELSE lo + b.bin * ((hi - lo) / 20.0) + (hi - lo) / 20.0 END, 6) AS range_end,
  coalesce(c.cnt, 0) AS count,
  round(CASE WHEN hi = lo THEN NULL ELSE coalesce(c.cnt, 0) / (n * ((hi - lo) / 20.0)) END, 6) AS density
FROM b LEFT JOIN c ON b.bin = c.bin
"""))
def q_daily_histogram(spark, sf):
    return r6(S.daily_histogram(plays(spark, sf)), "range_start", "range_end", "density")


@register("normal_overlay", with_plays(_DAILY + """
, m AS (SELECT min(x) AS lo, max(x) AS hi, avg(x) AS mu, stddev_samp(x) AS sd, count(*) AS n FROM d),
p AS (SELECT CAST(i.range AS INTEGER) AS i,
        CASE WHEN i.range = 299 THEN hi ELSE lo + i.range * ((hi - lo) / 299.0) END AS x, mu, sd
      FROM range(300) i, m WHERE n > 1 AND sd > 0)
SELECT i, round(x, 6) AS x, round(exp(-pow(x - mu, 2) / (2.0 * pow(sd, 2))) / (sd * sqrt(2 * pi())), 6) AS density FROM p
"""))
def q_normal_overlay(spark, sf):
    return r6(S.daily_normal_overlay(plays(spark, sf)), "x", "density")
