"""Registered queries: sessions, de-duplication, record sink, metadata enrichment."""

from __future__ import annotations

import threading

from pyspark.sql import functions as F

from encore.operators import enrich as EN
from encore.operators import rankings as R
from encore.operators import statistics as S
from encore.operators.prepare import dedup_plays
from encore.operators.sessions import sessionize
from encore.plans.oracle import with_plays, with_raw
from encore.plans.registry import plays, register
from encore.schema import ARTIST, EXPORT_KEYS, RAW_COLUMNS, TRACK
from encore.sources import catalog as C
from encore.sources.records import to_records
from encore.sources.star import read_table, star_plays

def _r6(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


# --- W3: sessions --------------------------------------------------------------------------

_EVENT_SESSIONS = """
WITH t AS (SELECT DISTINCT ts FROM events WHERE ts IS NOT NULL),
l AS (SELECT ts, epoch_us(ts) - lag(epoch_us(ts)) OVER (ORDER BY ts) AS gap FROM t),
s AS (SELECT ts, CAST(1 + sum(CASE WHEN gap > 1800000000 THEN 1 ELSE 0 END)
                 OVER (ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS session_id FROM l)
"""


@register("sessionize", _EVENT_SESSIONS + "SELECT e.event_id, s.session_id FROM events e LEFT JOIN s USING (ts)")
def q_sessionize(spark, sf):
    ev = read_table(spark, sf, "events").select("event_id", "ts")
    return sessionize(ev, "ts", 30).select("event_id", "session_id")


@register("event_sessions", _EVENT_SESSIONS + """
SELECT s.session_id, CAST(count(*) AS BIGINT) AS events, min(e.event_id) AS first_event_id,
  max(e.event_id) AS last_event_id, round(sum(e.value), 6) AS value
FROM events e JOIN s USING (ts) GROUP BY s.session_id
""")
def q_event_sessions(spark, sf):
    ev = read_table(spark, sf, "events").select("event_id", "ts", "value")
    s = sessionize(ev, "ts", 30)
    return s.where(F.col("session_id").isNotNull()).groupBy("session_id").agg(
        F.count(F.lit(1)).cast("long").alias("events"),
        F.min("event_id").alias("first_event_id"),
        F.max("event_id").alias("last_event_id"),
        F.round(F.sum("value"), 6).alias("value"),
    )


@register("listening_sessions", with_plays("""
SELECT session_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start,
  strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS session_end, CAST(count(*) AS BIGINT) AS plays,
  coalesce(sum(ms_played), 0.0) / 3600000.0 AS play_hours
FROM plays GROUP BY session_id
""", sessions=True))
def q_listening_sessions(spark, sf):
    return plays(spark, sf).groupBy("session_id").agg(
        F.date_format(F.min("ts"), "yyyy-MM-dd HH:mm:ss").alias("session_start"),
        F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("session_end"),
        F.count(F.lit(1)).cast("long").alias("plays"),
        (F.coalesce(F.sum("ms_played"), F.lit(0.0)) / F.lit(3600000.0)).alias("play_hours"),
    )


# --- F2: exact duplicates (every play exported twice under the same file name) --------------


@register("dedup_plays", with_raw("""
SELECT * REPLACE (strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, CAST(skipped AS VARCHAR) AS skipped)
FROM (SELECT DISTINCT * FROM (SELECT * FROM raw UNION ALL SELECT * FROM raw) WHERE ts IS NOT NULL)
"""))
def q_dedup_plays(spark, sf):
    raw = star_plays(spark, sf)
    # every play exported twice (the same multiset as a union of the mapping with itself,
    # from one evaluation of the joins)
    twice = raw.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("_copy")).drop("_copy")
    d = dedup_plays(twice)
    return d.withColumns({
        "ts": F.date_format("ts", "yyyy-MM-dd HH:mm:ss"),
        "skipped": F.col("skipped").cast("string"),
    }).select(*RAW_COLUMNS, "source_file", "extra_json")


# --- S5: record sink with NULL filling --------------------------------------------------------


@register("records_nullfill", with_raw("""
SELECT coalesce(strftime(ts, '%Y-%m-%d %H:%M:%S'), '') AS ts, coalesce(ms_played, 0) AS ms_played,
  coalesce(master_metadata_track_name, '') AS master_metadata_track_name,
  coalesce(episode_name, '') AS episode_name, coalesce(audiobook_title, '') AS audiobook_title,
  coalesce(reason_end, '') AS reason_end
FROM raw
"""))
def q_records_nullfill(spark, sf):
    raw = star_plays(spark, sf).withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return to_records(raw, ["ts", "ms_played", TRACK, "episode_name", "audiobook_title", "reason_end"])


# --- J1-J3: enrichment ------------------------------------------------------------------------

_AP = """SELECT p_brand AS artist,
  CASE WHEN p_brand LIKE '%5' THEN NULL ELSE 'https://img.primary.example/artist/' || replace(p_brand, '#', '-') END
    AS image_url,
  CASE WHEN p_brand LIKE '%4' THEN NULL ELSE 'https://open.primary.example/artist/' || replace(p_brand, '#', '-') END
    AS external_url,
  'genre-a, genre-' || substring(p_brand, 7, 1) AS genres, CAST(substring(p_brand, 7, 2) AS INTEGER) AS popularity
FROM (SELECT DISTINCT p_brand FROM part) WHERE p_brand NOT LIKE '%3'"""
_AF = """SELECT p_brand AS artist,
  CASE WHEN p_brand LIKE '%1' THEN NULL ELSE 'https://cdn.fallback.example/xl/' || replace(p_brand, '#', '-') END
    AS picture_xl,
  'https://cdn.fallback.example/big/' || replace(p_brand, '#', '-') AS picture_big,
  'https://cdn.fallback.example/medium/' || replace(p_brand, '#', '-') AS picture_medium,
  'https://www.fallback.example/artist/' || replace(p_brand, '#', '-') AS link
FROM (SELECT DISTINCT p_brand FROM part)"""
_ACODE = "replace(p_type, ' ', '_') || '/' || replace(p_brand, '#', '-')"
_LP = f"""SELECT p_type AS album, p_brand AS artist,
  CASE WHEN p_brand LIKE '%1' THEN NULL ELSE 'https://img.primary.example/album/' || {_ACODE} END AS image_url,
  CASE WHEN p_brand LIKE '%5' THEN NULL ELSE 'https://open.primary.example/album/' || {_ACODE} END AS external_url,
  '2001-01-01' AS release_date
FROM (SELECT DISTINCT p_type, p_brand FROM part) WHERE p_brand NOT LIKE '%4'"""
_LF = f"""SELECT p_type AS album, p_brand AS artist,
  CASE WHEN p_brand LIKE '%2' THEN NULL ELSE 'https://cdn.fallback.example/cover-xl/' || {_ACODE} END AS cover_xl,
  CASE WHEN p_brand LIKE '%2' THEN NULL ELSE 'https://cdn.fallback.example/cover-big/' || {_ACODE} END AS cover_big,
  'https://cdn.fallback.example/cover-medium/' || {_ACODE} AS cover_medium,
  'https://www.fallback.example/album/' || {_ACODE} AS link
FROM (SELECT DISTINCT p_type, p_brand FROM part)"""
_TID = "CASE WHEN p_brand LIKE 'Brand#1%' THEN 'c' || CAST(p_partkey AS VARCHAR) ELSE CAST(p_partkey AS VARCHAR) END"
_TC = f"""SELECT {_TID} AS track_id, p_name AS track, p_brand AS artist, CAST(p_size AS INTEGER) AS popularity,
  'https://open.primary.example/track/' || {_TID} AS external_url, p_type AS album_name,
  CAST(1950 + p_size AS VARCHAR) || '-01-01' AS album_release_date,
  'https://img.primary.example/cover/' || CAST(p_partkey AS VARCHAR) AS album_image
FROM part"""


@register("enrich_artists", with_plays(f"""
WITH top AS (SELECT master_metadata_album_artist_name AS artist, coalesce(sum(ms_played), 0.0) / 3600000.0 AS play_hours
             FROM plays GROUP BY 1 ORDER BY play_hours DESC, artist LIMIT 10),
ap AS ({_AP}), af AS ({_AF})
SELECT t.artist, t.play_hours,
  CASE WHEN ap.artist IS NOT NULL THEN ap.image_url ELSE coalesce(af.picture_xl, af.picture_big, af.picture_medium) END
    AS image_url,
  CASE WHEN ap.artist IS NOT NULL THEN ap.external_url ELSE af.link END AS external_url,
  coalesce(ap.genres, '') AS genres, CAST(ap.popularity AS DOUBLE) AS popularity
FROM top t LEFT JOIN ap ON ap.artist = t.artist AND t.artist <> '' LEFT JOIN af ON af.artist = t.artist AND t.artist <> ''
"""))
def q_enrich_artists(spark, sf):
    top = R.top_artists_hours(plays(spark, sf), 10)
    out = EN.enrich_artists(top, C.artist_primary(spark, sf), C.artist_fallback(spark, sf))
    return out.withColumn("popularity", F.col("popularity").cast("double"))


@register("enrich_albums", with_plays(f"""
WITH top AS (SELECT master_metadata_album_album_name AS album, master_metadata_album_artist_name AS artist,
               coalesce(sum(ms_played), 0.0) / 3600000.0 AS play_hours
             FROM plays GROUP BY 1, 2 ORDER BY play_hours DESC, album, artist LIMIT 10),
lp AS ({_LP}), lf AS ({_LF})
SELECT t.album, t.artist, t.play_hours,
  CASE WHEN lp.album IS NOT NULL THEN lp.image_url ELSE coalesce(lf.cover_xl, lf.cover_big, lf.cover_medium) END
    AS image_url,
  CASE WHEN lp.album IS NOT NULL THEN lp.external_url ELSE lf.link END AS external_url, lp.release_date
FROM top t LEFT JOIN lp ON lp.album = t.album AND lp.artist = t.artist
LEFT JOIN lf ON lf.album = t.album AND lf.artist = t.artist
"""))
def q_enrich_albums(spark, sf):
    top = R.favorite_albums(plays(spark, sf), 10)
    return EN.enrich_albums(top, C.album_primary(spark, sf), C.album_fallback(spark, sf))


def _fields(alias_i: str, alias_n: str) -> str:
    cols = ["track_id", "popularity", "external_url", "album_name", "album_release_date", "album_image"]
    return ", ".join(
        f"CASE WHEN {alias_i}.track_id IS NOT NULL THEN {alias_i}.{c} ELSE {alias_n}.{c} END AS {c}" for c in cols
    )


@register("enrich_tracks", with_plays(f"""
WITH top AS (SELECT master_metadata_track_name AS track, master_metadata_album_artist_name AS artist,
               CAST(count(*) AS BIGINT) AS plays, coalesce(sum(ms_played), 0.0) / 3600000.0 AS hours,
               arg_min(track_uri, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') || track_uri) FILTER (WHERE track_uri IS NOT NULL)
                 AS track_uri
             FROM plays WHERE is_song GROUP BY 1, 2 ORDER BY plays DESC, track, artist LIMIT 10),
cat AS ({_TC}),
t AS (SELECT *, CASE WHEN starts_with(track_uri, 'music:') AND len(string_split(track_uri, ':')) = 3
                      AND string_split(track_uri, ':')[2] = 'track' THEN string_split(track_uri, ':')[3] END AS tid
      FROM top),
bn AS (SELECT t.track, t.artist, min(c.track_id) AS track_id FROM t JOIN cat c
       ON c.track = t.track AND (t.artist IS NULL OR t.artist = '' OR c.artist = t.artist)
       WHERE t.track <> '' GROUP BY 1, 2)
SELECT t.track, t.artist, t.plays, t.hours, t.track_uri, {_fields('ci', 'cn')},
  CASE WHEN ci.track_id IS NOT NULL THEN 'id' WHEN cn.track_id IS NOT NULL THEN 'name' END AS matched_by
FROM t LEFT JOIN cat ci ON ci.track_id = t.tid
LEFT JOIN bn ON bn.track = t.track AND bn.artist = t.artist
LEFT JOIN cat cn ON cn.track_id = bn.track_id
"""))
def q_enrich_tracks(spark, sf):
    p = R.songs(plays(spark, sf))
    g = p.groupBy(F.col(TRACK).alias("track"), F.col(ARTIST).alias("artist")).agg(
        F.count(F.lit(1)).cast("long").alias("plays"),
        (F.coalesce(F.sum("ms_played"), F.lit(0.0)) / F.lit(3600000.0)).alias("hours"),
    )
    top = R.first_uri(p.withColumnsRenamed({TRACK: "track", ARTIST: "artist"}), R.top_k(g, ["track", "artist"], ["plays"], 10),
                      ["track", "artist"])
    return EN.enrich_tracks(top, C.track_catalog(spark, sf))


# --- M1-M9: skip model ------------------------------------------------------------------------

_models: dict[str, object] = {}
_models_lock = threading.Lock()


def _skip_result(spark, sf):
    """The skip model of one input, trained once per process (the three skip queries share it)."""
    from encore.operators.skip_model import train_skip_model
    from encore.sources.curated import star_curated_path

    key = star_curated_path(spark, sf)
    with _models_lock:
        if key not in _models:
            _models[key] = train_skip_model(plays(spark, sf))
    return _models[key]


_SKIP_ROWS = """SELECT is_skipped::INTEGER AS label, play_minutes, listening_hour, platform, reason_start, reason_end,
  shuffle, offline, incognito_mode,
  CAST('0x' || substr(md5(concat_ws('|', '42', strftime(ts, '%Y-%m-%d %H:%M:%S'), CAST(ms_played AS BIGINT),
    master_metadata_track_name, platform, reason_start, reason_end, source_file)), 1, 4) AS BIGINT) AS slot
FROM plays WHERE is_song"""
_SKIP_CUTS = """s AS (SELECT label, slot, count(*) AS c FROM d GROUP BY ALL),
u AS (SELECT label, slot, sum(c) OVER (PARTITION BY label ORDER BY slot) AS upto, sum(c) OVER (PARTITION BY label) AS n FROM s),
k AS (SELECT label, min(n) AS n, min(slot) AS cut, min(upto) AS n_test FROM u WHERE upto >= n * 0.25 GROUP BY label)"""


def _newton_sql(rows: str, steps: int = 8) -> str:
    """The same fit in SQL: ``w`` (feature, weight) and ``scored`` (label, p of the test rows). Every step adds up gradient
    and Hessian over the rows' non-zero features and solves by Gauss-Jordan elimination."""
    parts = [f"""d AS MATERIALIZED (SELECT row_number() OVER () AS rid, * FROM ({rows})), {_SKIP_CUTS},
t AS MATERIALIZED (SELECT d.*, d.slot > k.cut AS train FROM d JOIN k ON d.label = k.label),
o AS (SELECT avg(play_minutes) AS m1, stddev_samp(play_minutes) AS s1, avg(listening_hour) AS m2, stddev_samp(listening_hour) AS s2,
  count(*) AS n, count(*) FILTER (WHERE label = 1) AS n1 FROM t WHERE train),
l AS MATERIALIZED (SELECT rid, label, train, unnest(['intercept', 'play_minutes', 'listening_hour', 'platform=' || platform,
    'reason_start=' || reason_start, 'reason_end=' || reason_end, 'shuffle', 'offline', 'incognito_mode']) AS feature,
  unnest([1.0, (play_minutes - m1) / s1, (listening_hour - m2) / s2, 1.0, 1.0, 1.0, shuffle::INTEGER, offline::INTEGER,
    incognito_mode::INTEGER]::DOUBLE[]) AS x FROM t, o),
f AS MATERIALIZED (SELECT feature, row_number() OVER (ORDER BY feature) AS i, CASE WHEN feature = 'intercept' THEN 0.0 ELSE 1.0 END AS ridge
  FROM (SELECT DISTINCT feature FROM l WHERE train)),
x AS MATERIALIZED (SELECT rid, i, x, label AS y, CASE WHEN label = 1 THEN n / (2.0 * n1) ELSE n / (2.0 * (n - n1)) END AS c
  FROM l JOIN f USING (feature), o WHERE train AND x <> 0),
xx AS MATERIALIZED (SELECT a.rid, a.i, b.i AS j, a.x * b.x AS v FROM x a JOIN x b ON a.rid = b.rid),
w0 AS (SELECT i, 0.0::DOUBLE AS v FROM f)"""]
    for s in range(steps):
        parts.append(f"""q{s} AS MATERIALIZED (SELECT rid, any_value(y) AS y, any_value(c) AS c, 1 / (1 + exp(-sum(x.x * w{s}.v))) AS p
  FROM x JOIN w{s} USING (i) GROUP BY rid),
g{s} AS (SELECT i, sum(c * (p - q{s}.y) * x) AS v FROM x JOIN (SELECT rid, y, p FROM q{s}) q{s} USING (rid) GROUP BY i),
h{s} AS (SELECT i, j, sum(c * p * (1 - p) * v) AS v FROM xx JOIN q{s} USING (rid) GROUP BY i, j),
m{s} AS (SELECT a.i, list_append(list(coalesce(h.v, 0) + CASE WHEN a.i = b.i THEN a.ridge ELSE 0 END ORDER BY b.i),
    any_value(-coalesce(g.v, 0) - a.ridge * w.v)) AS r
  FROM f a CROSS JOIN f b LEFT JOIN h{s} h ON h.i = a.i AND h.j = b.i LEFT JOIN g{s} g ON g.i = a.i JOIN w{s} w ON w.i = a.i GROUP BY a.i),
e{s} AS (SELECT 0::BIGINT AS step, i, r FROM m{s} UNION ALL
  SELECT a.step + 1, a.i, CASE WHEN a.i = a.step + 1 THEN list_transform(a.r, lambda u: u / a.r[a.i])
    ELSE list_transform(list_zip(a.r, b.r), lambda u: u[1] - u[2] * a.r[a.step + 1] / b.r[a.step + 1]) END
  FROM e{s} a JOIN e{s} b ON b.i = a.step + 1 WHERE a.step < (SELECT count(*) FROM f)),
w{s + 1} AS MATERIALIZED (SELECT i, w{s}.v + e.r[len(e.r)] AS v FROM e{s} e JOIN w{s} USING (i) WHERE e.step = (SELECT count(*) FROM f))""")
    parts.append(f"""w AS (SELECT feature, v FROM w{steps} JOIN f USING (i)),
scored AS MATERIALIZED (SELECT any_value(label) AS label, 1 / (1 + exp(-sum(x * coalesce(v, 0)))) AS p
  FROM l LEFT JOIN w USING (feature) WHERE NOT train GROUP BY rid)""")
    return "WITH RECURSIVE " + ",\n".join(parts)


_NEWTON = _newton_sql(_SKIP_ROWS)


# equal rows have equal scores up to the order of a sum, hence the rounding before ranks
_SKIP_METRICS = """WITH r AS (SELECT label, p, rank() OVER (ORDER BY p) AS lo, count(*) OVER (PARTITION BY p) AS same
    FROM (SELECT label, round(p, 12) AS p FROM ({scored})))
SELECT CAST(count(*) AS BIGINT) AS n_test, round(avg(CASE WHEN label = (p > 0.5)::INTEGER THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
  round((sum(CASE WHEN label = 1 THEN lo + (same - 1) / 2.0 END) - sum(label) * (sum(label) + 1) / 2.0)
        / (sum(label) * CAST(sum(1 - label) AS DOUBLE)), 6) AS roc_auc FROM r"""


@register("skip_model_metrics", with_plays(f"""
SELECT 'ok' AS status, CAST((SELECT count(*) FROM plays WHERE is_song) - n_test AS BIGINT) AS n_train, n_test, accuracy, roc_auc
FROM ({_SKIP_METRICS.format(scored=_NEWTON + " SELECT label, p FROM scored")})
"""))
def q_skip_model_metrics(spark, sf):
    from encore.operators.skip_model import metrics

    r = _skip_result(spark, sf)
    if r.status != "ok":
        return spark.createDataFrame([(r.status, 0, 0, None, None)],
                                     "status string, n_train long, n_test long, accuracy double, roc_auc double")
    m = _r6(metrics(r.scored.withColumn("probability", F.round("probability", 12))), "accuracy", "roc_auc")
    return m.select(F.lit("ok").alias("status"), F.lit(r.n_train).cast("long").alias("n_train"),
                    "n_test", "accuracy", "roc_auc")


@register("skip_scores", with_plays(f"""
SELECT CAST(label AS DOUBLE) AS label, CAST((p > 0.5)::INTEGER AS DOUBLE) AS prediction, round(p, 6) AS probability
FROM ({_NEWTON} SELECT label, p FROM scored)
"""))
def q_skip_scores(spark, sf):
    r = _skip_result(spark, sf)
    if r.status != "ok":
        return spark.createDataFrame([], "label double, prediction double, probability double")
    return _r6(r.scored, "probability")


@register("skip_weights", with_plays(f"""
SELECT feature, round(v, 6) AS weight FROM ({_NEWTON} SELECT feature, v FROM w)
"""))
def q_skip_weights(spark, sf):
    """The fitted coefficients by feature, the intercept too."""
    r = _skip_result(spark, sf)
    if r.status != "ok":
        return spark.createDataFrame([], "feature string, weight double")
    rows = [(n, float(v)) for n, v in zip(r.model.feature_names(), r.model.coefficients) if n is not None]
    return _r6(spark.createDataFrame([*rows, ("intercept", r.model.intercept)], "feature string, weight double"), "weight")

_REPORT = """c AS (SELECT k, CAST(count(*) FILTER (WHERE label = k AND prediction = k) AS DOUBLE) AS hit,
  CAST(count(*) FILTER (WHERE prediction = k) AS DOUBLE) AS named, CAST(count(*) FILTER (WHERE label = k) AS DOUBLE) AS support
  FROM d, (VALUES (0), (1)) v(k) GROUP BY k),
m AS (SELECT k, coalesce(hit / nullif(named, 0), 0) AS pr, coalesce(hit / nullif(support, 0), 0) AS re, support, hit FROM c),
f AS (SELECT *, coalesce(2 * pr * re / nullif(pr + re, 0), 0) AS f1 FROM m),
t AS (SELECT sum(support) AS n, sum(hit) / sum(support) AS acc FROM f)
SELECT CAST(k AS VARCHAR) AS label, round(pr, 6) AS precision, round(re, 6) AS recall, round(f1, 6) AS f1_score, support FROM f
UNION ALL SELECT 'accuracy', round(acc, 6), round(acc, 6), round(acc, 6), n FROM t
UNION ALL SELECT 'macro avg', round(avg(pr), 6), round(avg(re), 6), round(avg(f1), 6), sum(support) FROM f
UNION ALL SELECT 'weighted avg', round(sum(pr * support) / sum(support), 6), round(sum(re * support) / sum(support), 6),
  round(sum(f1 * support) / sum(support), 6), sum(support) FROM f
"""
_PREDICTED = "SELECT label, (p > 0.5)::INTEGER AS prediction"


@register("skip_report", with_plays(f"""
WITH d AS MATERIALIZED ({_PREDICTED} FROM ({_NEWTON} SELECT label, p FROM scored)), {_REPORT}"""))
def q_skip_report(spark, sf):
    from encore.operators.skip_model import classification_report

    r = _skip_result(spark, sf)
    if r.status != "ok":
        return spark.createDataFrame([], "label string, precision double, recall double, f1_score double, support double")
    return _r6(classification_report(r.scored), "precision", "recall", "f1_score")


# R9 over a selection, and M1: a selection whose songs are all of one class has no model
_SINCE = "1994-01-01"


@register("report_skip_model", with_plays(f"""
WITH z AS MATERIALIZED ({_newton_sql(_SKIP_ROWS + f" AND date >= DATE '{_SINCE}'")} SELECT label, p FROM scored),
d AS (SELECT label, (p > 0.5)::INTEGER AS prediction FROM z),
k AS (SELECT accuracy, roc_auc FROM ({_SKIP_METRICS.format(scored="SELECT label, p FROM z")}))
SELECT 'recent' AS selection, 'ok' AS status, accuracy, roc_auc, q.* FROM k, (WITH {_REPORT}) q
UNION ALL SELECT 'skipped', CASE WHEN count(DISTINCT is_skipped) < 2 THEN 'insufficient_data' ELSE 'ok' END, NULL, NULL, NULL,
  NULL, NULL, NULL, NULL FROM plays WHERE is_song AND is_skipped
"""))
def q_report_skip_model(spark, sf):
    from encore.plans import reports

    p = plays(spark, sf)
    rows = []
    for name, r in (("recent", reports.skip_model(p, start=_SINCE)), ("skipped", reports.skip_model(p.where("is_skipped")))):
        if r["status"] != "ok":
            rows.append((name, r["status"], *[None] * 7))
            continue
        figures = [(k, *(float(v[c]) for c in ("precision", "recall", "f1-score", "support"))) for k, v in r["report"].items()]
        rows += [(name, "ok", float(r["accuracy"]), float(r["roc_auc"]), *f) for f in figures]
    out = spark.createDataFrame(rows, "selection string, status string, accuracy double, roc_auc double, label string, "
                                      "precision double, recall double, f1_score double, support double")
    return _r6(out, "accuracy", "roc_auc", "precision", "recall", "f1_score")


@register("skip_split", with_plays(f"""
WITH d AS ({_SKIP_ROWS}), {_SKIP_CUTS}
SELECT CAST(label AS DOUBLE) AS label, CAST(n AS BIGINT) AS n, CAST(cut AS BIGINT) AS cut, CAST(n_test AS BIGINT) AS n_test FROM k
"""))
def q_skip_split(spark, sf):
    from encore.operators.skip_model import class_cuts, model_frame

    return class_cuts(model_frame(plays(spark, sf))).select(
        "label", F.col("n").cast("long").alias("n"), F.col("cut").cast("long").alias("cut"), F.col("n_test").cast("long").alias("n_test"))


@register("skip_features", with_plays(f"""
WITH d AS ({_SKIP_ROWS}), {_SKIP_CUTS},
t AS (SELECT d.* FROM d JOIN k ON d.label = k.label AND d.slot > k.cut)
SELECT 'play_minutes' AS feature, round(avg(play_minutes), 6) AS mean, round(stddev_samp(play_minutes), 6) AS deviation,
  CAST(0 AS BIGINT) AS categories FROM t
UNION ALL SELECT 'listening_hour', round(avg(listening_hour), 6), round(stddev_samp(listening_hour), 6), 0 FROM t
UNION ALL SELECT 'platform', 0.0, 0.0, count(DISTINCT platform) FROM t
UNION ALL SELECT 'reason_start', 0.0, 0.0, count(DISTINCT reason_start) FROM t
UNION ALL SELECT 'reason_end', 0.0, 0.0, count(DISTINCT reason_end) FROM t
"""))
def q_skip_features(spark, sf):
    """What the fitted pipeline's scaler and indexer hold."""
    from encore.operators.skip_model import FEATURES_CATEGORICAL, FEATURES_NUMERIC

    r = _skip_result(spark, sf)
    schema = "feature string, mean double, deviation double, categories long"
    if r.status != "ok":
        return spark.createDataFrame([], schema)
    scaler, indexer = r.model.features.stages[2], r.model.features.stages[3]
    rows = [(f, round(float(m), 6), round(float(d), 6), 0) for f, m, d in zip(FEATURES_NUMERIC, scaler.mean, scaler.std)]
    rows += [(f, 0.0, 0.0, len(x)) for f, x in zip(FEATURES_CATEGORICAL, indexer.labelsArray)]
    return spark.createDataFrame(rows, schema)


# The metric operators over a score that SQL can repeat.
_FIXED = """SELECT is_skipped::INTEGER AS label, CASE WHEN play_minutes < 3 THEN 1 ELSE 0 END AS prediction,
  1 / (1 + play_minutes) AS p FROM plays WHERE is_song"""


def _fixed_score(spark, sf):
    s = plays(spark, sf).where("is_song")
    return s.select(F.col("is_skipped").cast("double").alias("label"),
                    F.when(F.col("play_minutes") < 3, 1.0).otherwise(0.0).alias("prediction"),
                    (1 / (1 + F.col("play_minutes"))).alias("probability"))


@register("score_metrics", with_plays(f"""
WITH d AS ({_FIXED}), r AS (SELECT label, p, prediction, rank() OVER (ORDER BY p) AS lo, count(*) OVER (PARTITION BY p) AS same FROM d)
SELECT CAST(count(*) AS BIGINT) AS n_test, round(avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
  round((sum(CASE WHEN label = 1 THEN lo + (same - 1) / 2.0 END) - sum(label) * (sum(label) + 1) / 2.0)
        / (sum(label) * CAST(sum(1 - label) AS DOUBLE)), 6) AS roc_auc FROM r
"""))
def q_score_metrics(spark, sf):
    from encore.operators.skip_model import metrics

    return _r6(metrics(_fixed_score(spark, sf)), "accuracy", "roc_auc")


@register("score_report", with_plays(f"""
WITH d AS ({_FIXED}),
{_REPORT}"""))
def q_score_report(spark, sf):
    from encore.operators.skip_model import classification_report

    return _r6(classification_report(_fixed_score(spark, sf)), "precision", "recall", "f1_score")


# --- S1-S4: the JSON export ingest, on exports Spark derives from the given tables -----------


_exports_lock = threading.Lock()


def _exports_dir(spark, sf):
    """JSON exports of the star mapping (line-delimited part files, compressed: as plain text they take a multiple of
    the tables' disk), written once per input."""
    from encore.session import shared_dir
    from encore.sources.curated import is_written, star_curated_path

    path = f"{shared_dir(spark)}/encore/exports-gz/{star_curated_path(spark, sf).rsplit('/', 1)[-1]}"
    if not is_written(spark, path):
        with _exports_lock:
            if not is_written(spark, path):
                raw = star_plays(spark, sf).drop("source_file", "extra_json")
                raw.withColumnsRenamed(EXPORT_KEYS).write.mode("overwrite").json(path, compression="gzip")
    return path


@register("ingest_exports", with_plays("""
SELECT strftime(date, '%Y-%m-%d') AS date, CAST(count(*) AS BIGINT) AS plays,
  coalesce(sum(ms_played), 0.0) / 3600000.0 AS play_hours, CAST(count_if(is_song) AS BIGINT) AS songs,
  CAST(count_if(is_skipped) AS BIGINT) AS skipped
FROM plays GROUP BY date
"""))
def q_ingest_exports(spark, sf):
    from encore.operators.prepare import prepare_plays
    from encore.sources.exports import read_exports

    p = prepare_plays(read_exports(spark, _exports_dir(spark, sf), "*.json.gz"), with_sessions=False)
    g = p.groupBy("date").agg(
        F.count(F.lit(1)).cast("long").alias("plays"),
        (F.coalesce(F.sum("ms_played"), F.lit(0.0)) / F.lit(3600000.0)).alias("play_hours"),
        F.count_if(F.col("is_song")).cast("long").alias("songs"),
        F.count_if(F.col("is_skipped")).cast("long").alias("skipped"),
    )
    return g.withColumn("date", F.date_format("date", "yyyy-MM-dd"))


# --- S1-S4: every file shape, with missing, extra and broken parts ------------------------------


def _shapes_dir(spark, sf):
    """Export files of all shapes made from ``orders`` and ``nation``, written once per input: arrays
    on one line, line-delimited files with bad lines, files that begin with a bad line, pretty-printed
    arrays and, one per nation, pretty-printed objects in a subfolder. Each file is one text row, so
    that it can hold anything."""
    from encore.session import shared_dir
    from encore.sources import fs
    from encore.sources.curated import is_written, star_curated_path

    path = f"{shared_dir(spark)}/encore/shapes/{star_curated_path(spark, sf).rsplit('/', 1)[-1]}"
    with _exports_lock:
        if is_written(spark, path):
            return path
        o = read_table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
        rec = F.to_json(F.struct(
            F.date_format("o_orderdate", "yyyy-MM-dd'T'00:00:00'Z'").alias("ts"),
            (F.col("o_orderkey") % 100000).alias("ms_played"),
            F.concat(F.lit("order-"), F.col("o_orderkey").cast("string")).alias(TRACK),
            F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).alias("platform"),
            F.when(F.col("o_orderkey") % 7 == 0, F.col("o_orderkey")).alias("zz"),
        ))  # a NULL field is left out: a missing key
        shape = F.element_at(F.array(*[F.lit(x) for x in ("array", "lines", "late", "pretty")]),
                             (F.col("o_orderkey") % 4 + 1).cast("int"))
        name = F.concat(shape, F.lit("-"), F.floor(F.col("o_orderkey") / 20000).cast("string"))
        files = o.groupBy(name.alias("name")).agg(F.collect_list(rec).alias("r"))  # <= 5000 records a file
        text = (
            F.when(F.col("name").startswith("array"), F.concat(F.lit("["), F.array_join("r", ","), F.lit(", 7]")))
            .when(F.col("name").startswith("lines"), F.concat(F.array_join("r", "\noops\n"), F.lit("\n\n{\n")))
            .when(F.col("name").startswith("late"), F.concat(F.lit("not json\n"), F.array_join("r", "\r\n")))
            .otherwise(F.concat(F.lit("[\n  "), F.array_join("r", ",\n  "), F.lit("\n]\n")))
        )
        n = read_table(spark, sf, "nation").select(
            F.concat(F.lit("deep/nation-"), F.col("n_nationkey").cast("string")).alias("name"),
            F.concat(F.lit('{\n "ts": "2020-01-01T00:00:00Z",\n "conn_country": "'), F.col("n_name"), F.lit('"\n}')).alias("value"),
        )
        rows = files.select("name", text.alias("value")).unionByName(n).withColumn("_f", F.regexp_replace("name", "/", "~"))
        rows.select("_f", "value").write.mode("overwrite").partitionBy("_f").text(f"{path}-rows")
        for part, _, _ in fs.listing(spark, f"{path}-rows"):
            target = part.rsplit("/", 2)[-2].removeprefix("_f=").replace("%7E", "~").replace("~", "/")
            fs.move(spark, part, f"{path}/{target}.json")
        fs.touch(spark, f"{path}/_SUCCESS")
        fs.remove(spark, f"{path}-rows")
    return path


@register("ingest_shapes", """
WITH o AS (
  SELECT o_orderkey AS k, o_orderdate, o_orderpriority,
    CASE o_orderkey % 4 WHEN 0 THEN 'array' WHEN 1 THEN 'lines' WHEN 2 THEN 'late' ELSE 'pretty' END
      || '-' || CAST(CAST(floor(o_orderkey / 20000) AS BIGINT) AS VARCHAR) || '.json' AS source_file
  FROM orders)
SELECT source_file, strftime(o_orderdate, '%Y-%m-%d') || 'T00:00:00Z' AS ts, CAST(k % 100000 AS DOUBLE) AS ms_played,
  'order-' || CAST(k AS VARCHAR) AS track, CASE WHEN k % 3 <> 0 THEN o_orderpriority END AS platform,
  CAST(NULL AS VARCHAR) AS country, CASE WHEN k % 7 = 0 THEN '{"zz":' || CAST(k AS VARCHAR) || '}' END AS extra_json
FROM o
UNION ALL
SELECT 'nation-' || CAST(n_nationkey AS VARCHAR) || '.json', '2020-01-01T00:00:00Z', NULL, NULL, NULL, n_name, NULL FROM nation
""")
def q_ingest_shapes(spark, sf):
    from encore.sources.exports import read_exports

    return read_exports(spark, _shapes_dir(spark, sf)).select(
        "source_file", "ts", "ms_played", F.col(TRACK).alias("track"), "platform",
        F.col("conn_country").alias("country"), "extra_json",
    )


# --- S1, S2: the file listing, and large arrays read in ranges -----------------------------------


@register("export_files", """
SELECT CASE o_orderkey % 4 WHEN 0 THEN 'array' WHEN 1 THEN 'lines' WHEN 2 THEN 'late' ELSE 'pretty' END
  || '-' || CAST(CAST(floor(o_orderkey / 20000) AS BIGINT) AS VARCHAR) || '.json' AS file_name FROM orders GROUP BY 1
UNION ALL SELECT 'nation-' || CAST(n_nationkey AS VARCHAR) || '.json' FROM nation
""")
def q_export_files(spark, sf):
    from encore.sources.exports import json_files

    return json_files(spark, _shapes_dir(spark, sf)).select("file_name")


RANGE_BYTES = 262_144  # of the ranges that the arrays below are read in


def _arrays_dir(spark, sf):
    """One-line arrays of nested records, with brackets and quotes in texts, made from ``orders``: files
    far larger than ``RANGE_BYTES``. Every seventh file misses its closing bracket."""
    from encore.session import shared_dir
    from encore.sources import fs
    from encore.sources.curated import is_written, star_curated_path

    path = f"{shared_dir(spark)}/encore/arrays/{star_curated_path(spark, sf).rsplit('/', 1)[-1]}"
    with _exports_lock:
        if is_written(spark, path):
            return path
        o = read_table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus", "o_orderpriority")
        rec = F.to_json(F.struct(
            F.date_format("o_orderdate", "yyyy-MM-dd'T'00:00:00'Z'").alias("ts"),
            (F.col("o_orderkey") % 100000).alias("ms_played"),
            F.concat("o_orderstatus", F.lit('}, {"ts": "\\'), "o_orderpriority").alias(TRACK),
            F.struct(F.array(F.struct(F.col("o_orderkey").cast("string").alias("k")), F.struct(F.lit("]}").alias("k"))).alias("b")).alias("zz"),
        ))
        files = o.groupBy(F.floor(F.col("o_orderkey") / 20000).alias("f")).agg(F.collect_list(rec).alias("r"))  # <= 20000 records
        end = F.when(F.col("f") % 7 == 3, "").otherwise("]")
        rows = files.select(F.col("f").alias("_f"), F.concat(F.lit("["), F.array_join("r", ", "), end).alias("value"))
        rows.write.mode("overwrite").partitionBy("_f").text(f"{path}-rows")
        for part, _, _ in fs.listing(spark, f"{path}-rows"):
            fs.move(spark, part, f"{path}/{part.rsplit('/', 2)[-2].removeprefix('_f=')}.json")
        fs.touch(spark, f"{path}/_SUCCESS")
        fs.remove(spark, f"{path}-rows")
    return path


@register("ingest_arrays", """
SELECT CAST(CAST(floor(o_orderkey / 20000) AS BIGINT) AS VARCHAR) || '.json' AS source_file,
  strftime(o_orderdate, '%Y-%m-%d') || 'T00:00:00Z' AS ts, CAST(o_orderkey % 100000 AS DOUBLE) AS ms_played,
  o_orderstatus || '}, {"ts": "\\' || o_orderpriority AS track,
  '{"zz":{"b":[{"k":"' || CAST(o_orderkey AS VARCHAR) || '"},{"k":"]}"}]}}' AS extra_json
FROM orders WHERE CAST(floor(o_orderkey / 20000) AS BIGINT) % 7 <> 3
""")
def q_ingest_arrays(spark, sf):
    from encore.sources.exports import read_exports

    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(RANGE_BYTES))
    try:  # arrays are cut while the frame is made
        raw = read_exports(spark, _arrays_dir(spark, sf))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    return raw.select("source_file", "ts", "ms_played", F.col(TRACK).alias("track"), "extra_json")


# --- U1: union of frames with columns of unlike types --------------------------------------------


@register("union_unlike", """
WITH a AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_orderkey % 100 AS DOUBLE) AS size, CAST(o_orderdate AS DATE) AS day, CAST(o_orderkey % 2 = 0 AS VARCHAR) AS flag,
    CAST(o_custkey AS DOUBLE) AS in_k, NULL AS in_s, o_orderstatus AS only_here, NULL AS segment FROM orders),
b AS (
  SELECT c_name AS id, c_acctbal AS size, CAST(NULL AS DATE) AS day, CAST(c_custkey AS VARCHAR) AS flag,
    c_acctbal AS in_k, c_mktsegment AS in_s, NULL AS only_here, c_mktsegment AS segment FROM customer),
u AS (SELECT * FROM a UNION ALL SELECT * FROM b)
SELECT n AS first, id, size, strftime(day, '%Y-%m-%d') AS day, flag, in_k, in_s, only_here, segment
FROM u, (VALUES ('orders'), ('customer')) AS o(n)
""")
def q_union_unlike(spark, sf):
    """Orders and customers as one frame, in either order: numbers beside texts, flags beside numbers,
    dates beside timestamps, structs of unlike fields."""
    from encore.sources.exports import union_frames

    a = read_table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 100).cast("int").alias("size"), F.to_date("o_orderdate").alias("day"),
        (F.col("o_orderkey") % 2 == 0).alias("flag"), F.struct(F.col("o_custkey").alias("k")).alias("in"), F.col("o_orderstatus").alias("only_here"))
    b = read_table(spark, sf, "customer").select(
        F.col("c_name").alias("id"), F.col("c_acctbal").alias("size"), F.lit(None).cast("timestamp").alias("day"), F.col("c_custkey").alias("flag"),
        F.struct(F.col("c_mktsegment").alias("s"), F.col("c_acctbal").alias("k")).alias("in"), F.col("c_mktsegment").alias("segment"))
    columns = ["id", "size", F.date_format("day", "yyyy-MM-dd").alias("day"), "flag", F.col("in.k").alias("in_k"), F.col("in.s").alias("in_s"), "only_here", "segment"]
    first = union_frames([a, b]).select(F.lit("orders").alias("first"), *columns)
    return first.unionByName(union_frames([b, a]).select(F.lit("customer").alias("first"), *columns))


# --- A21, A22: interval bounds and p-value as columns ------------------------------------------

# The oracle has no Student distribution. The quantile is its expansion in 1/dof around the normal
# one, which for hundreds of days is exact to far more digits than are compared; the tail is an
# integral of the density, after t = sqrt(dof) * tan(angle), by Simpson's rule.
_Z = "1.959963984540054"  # fixed value: 97.5 % quantile of the normal distribution
_T975 = f"""({_Z} + (pow({_Z}, 3) + {_Z}) / (4 * v) + (5 * pow({_Z}, 5) + 16 * pow({_Z}, 3) + 3 * {_Z}) / (96 * v * v)
  + (3 * pow({_Z}, 7) + 19 * pow({_Z}, 5) + 17 * pow({_Z}, 3) - 15 * {_Z}) / (384 * v * v * v))"""
_SIMPSON = """(SELECT sum(CASE WHEN i = 0 OR i = 20000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END
    * pow(cos({a} + (pi() / 2 - {a}) * i / 20000.0), v - 1)) * (pi() / 2 - {a}) FROM generate_series(0, 20000) g(i))"""


@register("daily_ci", with_plays(f"""
WITH d AS (SELECT date, coalesce(sum(ms_played), 0.0) / 3600000.0 AS x FROM plays GROUP BY date),
m AS (SELECT CAST(count(*) AS BIGINT) AS n, avg(x) AS mean, stddev_samp(x) / sqrt(count(*)) AS se, count(*) - 1.0 AS v FROM d)
SELECT n, round(mean, 6) AS mean, round(mean - {_T975} * se, 6) AS lower, round(mean + {_T975} * se, 6) AS upper FROM m
"""))
def q_daily_ci(spark, sf):
    return _r6(S.daily_ci(plays(spark, sf)), "mean", "lower", "upper")


@register("weekend_p", with_plays(f"""
WITH d AS (SELECT date, coalesce(sum(ms_played), 0.0) / 60000.0 AS m FROM plays GROUP BY date),
g AS (SELECT count(*) FILTER (WHERE isodow(date) < 6) AS n1, count(*) FILTER (WHERE isodow(date) >= 6) AS n2,
  avg(m) FILTER (WHERE isodow(date) < 6) AS m1, avg(m) FILTER (WHERE isodow(date) >= 6) AS m2,
  var_samp(m) FILTER (WHERE isodow(date) < 6) AS v1, var_samp(m) FILTER (WHERE isodow(date) >= 6) AS v2 FROM d),
t AS (SELECT (m1 - m2) / sqrt(v1 / n1 + v2 / n2) AS t,
  pow(v1 / n1 + v2 / n2, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1)) AS v FROM g)
SELECT round(t, 6) AS t_stat, round(v, 6) AS dof,
  round({_SIMPSON.format(a="atan(abs(t) / sqrt(v))")} / {_SIMPSON.format(a="0.0")}, 6) AS p_value FROM t
"""))
def q_weekend_p(spark, sf):
    return _r6(S.weekend_p(plays(spark, sf)).select("t_stat", "dof", "p_value"), "t_stat", "dof", "p_value")

