"""Column names, raw schema and fixed constants of the plays data model."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import types as T

# The export files' own names: keys that differ from the column names here, and URI schemes.
_FORMAT = json.loads((Path(__file__).parent / "export_format.json").read_text())
EXPORT_KEYS: dict[str, str] = _FORMAT["keys"]
URI_SCHEMES: list[str] = _FORMAT["uri_schemes"]

# ---------------------------------------------------------------------------
# These must equal the export format and the dashboard's labels.
# ---------------------------------------------------------------------------

# The 23 columns an export record is expected to carry, in export order (see ``export_key``).
RAW_COLUMNS = [
    "ts",
    "platform",
    "ms_played",
    "conn_country",
    "ip_addr",
    "master_metadata_track_name",
    "master_metadata_album_artist_name",
    "master_metadata_album_album_name",
    "track_uri",
    "episode_name",
    "episode_show_name",
    "episode_uri",
    "audiobook_title",
    "audiobook_uri",
    "audiobook_chapter_uri",
    "audiobook_chapter_title",
    "reason_start",
    "reason_end",
    "shuffle",
    "skipped",
    "offline",
    "offline_timestamp",
    "incognito_mode",
]

WEEKDAY_NAMES = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
CONTENT_TYPES = ["Songs", "Podcasts", "Audiobooks"]
SHUFFLE_LABELS = ("Shuffle On", "Shuffle Off")        # (true, false)
OFFLINE_LABELS = ("Offline", "Online")                # (true, false)
INCOGNITO_LABELS = ("Incognito", "Normal")            # (true, false)
DAY_PERIOD_LABELS = ("Day", "Night")                  # (6 <= hour < 18, otherwise)
WEEK_SEGMENT_LABELS = ("Weekend", "Weekday")          # (weekday >= 5, otherwise)
UNKNOWN_TRACK = "Unknown Track"
UNKNOWN_ARTIST = "Unknown Artist"
UNKNOWN_ALBUM = "Unknown Album"
UNKNOWN_CATEGORY = "unknown"
SESSION_GAP_MINUTES = 30
FULL_PLAY_MINUTES = 2.0
DAY_START_HOUR = 6  # Day is 6 <= hour < 18
DAY_END_HOUR = 18
LATE_NIGHT_HOURS = (0, 4)  # inclusive
REPEAT_MIN_PLAYS = 5
HISTOGRAM_BINS = 20
OVERLAY_POINTS = 300
MS_PER_MINUTE = 60000.0
MS_PER_HOUR = 3600000.0

# ---------------------------------------------------------------------------

TRACK = "master_metadata_track_name"
ARTIST = "master_metadata_album_artist_name"
ALBUM = "master_metadata_album_album_name"
TRACK_URI = "track_uri"


def export_key(column: str) -> str:
    """The key of a raw column in an export record."""
    return EXPORT_KEYS.get(column, column)


_STRING_COLS = {
    "platform", "conn_country", "ip_addr", TRACK, ARTIST, ALBUM, "track_uri",
    "episode_name", "episode_show_name", "episode_uri", "audiobook_title",
    "audiobook_uri", "audiobook_chapter_uri", "audiobook_chapter_title", "reason_start",
    "reason_end", "offline_timestamp",
}
_BOOL_COLS = {"shuffle", "skipped", "offline", "incognito_mode"}


def raw_type(name: str) -> T.DataType:
    if name == "ts":
        return T.TimestampType()
    if name == "ms_played":
        return T.DoubleType()
    if name in _BOOL_COLS:
        return T.BooleanType()
    return T.StringType()


RAW_SCHEMA = T.StructType(
    [T.StructField(c, raw_type(c), True) for c in RAW_COLUMNS]
    + [T.StructField("source_file", T.StringType(), True), T.StructField("extra_json", T.StringType(), True)]
)

# Columns the curated table adds after cleaning.
CURATED_EXTRA = [
    "play_minutes", "play_hours", "date", "year", "month", "weekday_name", "weekday_num",
    "listening_hour", "is_podcast", "is_audiobook", "is_song", "is_skipped", "is_fully_played",
]
