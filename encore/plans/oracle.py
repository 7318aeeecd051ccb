"""DuckDB SQL oracle: the same plays mapping, cleaning and operators written in plain SQL.

Every statement starts from the pre-registered star-schema views, so the oracle is
independent of the Spark code path (no shared curated table).
"""

from __future__ import annotations

_OFF = "((l.l_orderkey * 7919 + l.l_linenumber * 4801) % 86400)"

RAW_SQL = f"""
SELECT CASE WHEN (l.l_orderkey * 3 + l.l_linenumber) % 59 <> 0 THEN o.o_orderdate + to_seconds({_OFF}) END AS ts,
  c.c_mktsegment AS platform,
  CASE WHEN (l.l_orderkey + l.l_linenumber) % 97 = 0 THEN NULL
       WHEN (l.l_orderkey + l.l_linenumber) % 89 = 0 THEN -1.0E0
       ELSE CAST(FLOOR(l.l_quantity * 6000) AS DOUBLE) END AS ms_played,
  n.n_name AS conn_country,
  CAST(NULL AS VARCHAR) AS ip_addr,
  CASE WHEN p.p_size % 10 = 0 OR p.p_size % 11 = 0 THEN NULL ELSE p.p_name END AS master_metadata_track_name,
  CASE WHEN p.p_size % 10 = 0 OR p.p_size % 11 = 0 THEN NULL ELSE p.p_brand END AS master_metadata_album_artist_name,
  CASE WHEN p.p_size % 10 = 0 OR p.p_size % 11 = 0 THEN NULL ELSE p.p_type END AS master_metadata_album_album_name,
  CASE WHEN p.p_size % 10 = 0 OR p.p_size % 11 = 0 THEN NULL
       ELSE CONCAT('music:track:', CAST(p.p_partkey AS VARCHAR)) END AS track_uri,
  CASE WHEN p.p_size % 10 = 0 THEN p.p_name END AS episode_name,
  CAST(NULL AS VARCHAR) AS episode_show_name,
  CAST(NULL AS VARCHAR) AS episode_uri,
  CASE WHEN p.p_size % 11 = 0 OR p.p_size = 30 THEN p.p_name END AS audiobook_title,
  CAST(NULL AS VARCHAR) AS audiobook_uri,
  CAST(NULL AS VARCHAR) AS audiobook_chapter_uri,
  CAST(NULL AS VARCHAR) AS audiobook_chapter_title,
  o.o_orderpriority AS reason_start,
  CASE WHEN l.l_suppkey % 13 = 0 THEN NULL ELSE CONCAT('end_', CAST(l.l_suppkey % 5 AS VARCHAR)) END AS reason_end,
  (l.l_linestatus = 'O') AS shuffle,
  CASE l.l_returnflag WHEN 'R' THEN TRUE WHEN 'A' THEN FALSE END AS skipped,
  (l.l_tax > 0.06) AS offline,
  CAST(NULL AS VARCHAR) AS offline_timestamp,
  (l.l_discount > 0.08) AS incognito_mode,
  'star_schema' AS source_file,
  CAST(NULL AS VARCHAR) AS extra_json
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN part p ON l.l_partkey = p.p_partkey
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey
"""

PLAYS_SQL = """
SELECT ts, coalesce(platform, 'unknown') AS platform,
  greatest(coalesce(CASE WHEN isnan(ms_played) THEN NULL ELSE ms_played END, 0.0), 0.0) AS ms_played,
  conn_country, ip_addr,
  coalesce(master_metadata_track_name, 'Unknown Track') AS master_metadata_track_name,
  coalesce(master_metadata_album_artist_name, 'Unknown Artist') AS master_metadata_album_artist_name,
  coalesce(master_metadata_album_album_name, 'Unknown Album') AS master_metadata_album_album_name,
  track_uri, episode_name, episode_show_name, episode_uri, audiobook_title, audiobook_uri,
  audiobook_chapter_uri, audiobook_chapter_title,
  coalesce(reason_start, 'unknown') AS reason_start, coalesce(reason_end, 'unknown') AS reason_end,
  coalesce(shuffle, FALSE) AS shuffle, skipped, coalesce(offline, FALSE) AS offline, offline_timestamp,
  coalesce(incognito_mode, FALSE) AS incognito_mode, source_file, extra_json,
  greatest(coalesce(CASE WHEN isnan(ms_played) THEN NULL ELSE ms_played END, 0.0), 0.0) / 60000.0 AS play_minutes,
  greatest(coalesce(CASE WHEN isnan(ms_played) THEN NULL ELSE ms_played END, 0.0), 0.0) / 3600000.0 AS play_hours,
  CAST(ts AS DATE) AS date, CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month,
  dayname(ts) AS weekday_name, CAST(isodow(ts) - 1 AS INTEGER) AS weekday_num,
  CAST(hour(ts) AS INTEGER) AS listening_hour,
  (episode_name IS NOT NULL OR episode_show_name IS NOT NULL OR episode_uri IS NOT NULL) AS is_podcast,
  (audiobook_title IS NOT NULL OR audiobook_uri IS NOT NULL OR audiobook_chapter_uri IS NOT NULL) AS is_audiobook,
  NOT ((episode_name IS NOT NULL OR episode_show_name IS NOT NULL OR episode_uri IS NOT NULL)
       OR (audiobook_title IS NOT NULL OR audiobook_uri IS NOT NULL OR audiobook_chapter_uri IS NOT NULL)) AS is_song,
  coalesce(skipped, FALSE) AS is_skipped,
  (NOT coalesce(skipped, FALSE))
    AND greatest(coalesce(CASE WHEN isnan(ms_played) THEN NULL ELSE ms_played END, 0.0), 0.0) / 60000.0 >= 2.0
    AS is_fully_played
FROM (SELECT DISTINCT * FROM raw WHERE ts IS NOT NULL) d
"""

# Sessions by the plain global definition: gap to the previous play > 30 minutes.
SESSIONS_SQL = """
SELECT ts, 1 + sum(CASE WHEN epoch_us(ts) - prev_us > 1800000000 THEN 1 ELSE 0 END)
         OVER (ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session_id
FROM (SELECT ts, lag(epoch_us(ts)) OVER (ORDER BY ts) AS prev_us FROM (SELECT DISTINCT ts FROM plays0))
"""


def _merge(prefix: str, body: str) -> str:
    b = body.lstrip()
    if b[:5].upper() == "WITH ":
        return prefix + ",\n" + b[5:]
    return prefix + "\n" + b


def with_plays(body: str, sessions: bool = False) -> str:
    """Wrap ``body`` (which reads ``plays``; may start with its own WITH) with the mapping
    and cleaning CTEs."""
    if sessions:
        prefix = (
            f"WITH raw AS ({RAW_SQL}), plays0 AS ({PLAYS_SQL}), sess AS ({SESSIONS_SQL}), "
            "plays AS (SELECT p.*, CAST(s.session_id AS BIGINT) AS session_id FROM plays0 p JOIN sess s USING (ts))"
        )
    else:
        prefix = f"WITH raw AS ({RAW_SQL}), plays AS ({PLAYS_SQL})"
    return _merge(prefix, body)


def with_raw(body: str) -> str:
    return _merge(f"WITH raw AS ({RAW_SQL})", body)
