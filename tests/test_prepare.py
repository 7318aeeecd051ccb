"""Cleaning semantics: fills, flags, de-duplication, filters."""

from pyspark.sql import functions as F

from encore.operators import aggregates as A
from encore.operators import filters as FL
from encore.operators.prepare import dedup_plays

from conftest import raw_rows, ts


def test_fills_and_flags(make_plays):
    p = make_plays([
        {"ts": ts("2024-01-01 10:00:00"), "ms_played": -1.0, "episode_name": "e", "audiobook_title": "b"},
        {"ts": ts("2024-01-01 11:00:00"), "ms_played": None, "skipped": True},
        {"ts": None, "ms_played": 5.0},
    ], sessions=False).orderBy("ts").collect()
    assert len(p) == 2  # NULL ts dropped
    a, b = p
    assert a["ms_played"] == 0.0 and b["ms_played"] == 0.0
    assert a["is_podcast"] and a["is_audiobook"] and not a["is_song"]
    assert b["is_song"] and b["is_skipped"] and not b["is_fully_played"]
    assert a["platform"] == "unknown" and a["reason_end"] == "unknown"
    assert a["master_metadata_album_artist_name"] == "Unknown Artist"
    assert a["shuffle"] is False and a["offline"] is False and a["incognito_mode"] is False


def test_content_mix_counts_overlap_twice(make_plays):
    p = make_plays([{"ts": ts("2024-01-01 10:00:00"), "episode_name": "e", "audiobook_title": "b"}], sessions=False)
    mix = {r["name"]: r["value"] for r in A.content_mix(p).collect()}
    assert mix == {"Songs": 0.0, "Podcasts": 1.0, "Audiobooks": 1.0}


def test_calendar_parts(make_plays):
    r = make_plays([{"ts": ts("2024-01-07 23:30:00")}], sessions=False).first()
    assert (r["weekday_num"], r["weekday_name"], r["listening_hour"], r["month"], r["year"]) == (6, "Sunday", 23, 1, 2024)


def test_dedup_includes_source_file(spark):
    rows = [
        {"ts": ts("2024-01-01 10:00:00"), "ms_played": 1.0, "source_file": "a.json"},
        {"ts": ts("2024-01-01 10:00:00"), "ms_played": 1.0, "source_file": "a.json"},
        {"ts": ts("2024-01-01 10:00:00"), "ms_played": 1.0, "source_file": "b.json"},
    ]
    d = dedup_plays(raw_rows(spark, rows))
    assert d.count() == 2
    assert dedup_plays(d).count() == 2  # idempotent


def test_filters(make_plays):
    p = make_plays([
        {"ts": ts("2024-01-01 00:00:00"), "master_metadata_album_artist_name": "A"},
        {"ts": ts("2024-01-31 23:59:59"), "master_metadata_album_artist_name": "B", "episode_name": "x"},
        {"ts": ts("2024-02-01 00:00:00"), "master_metadata_album_artist_name": "A"},
    ], sessions=False)
    assert FL.date_range(p, "2024-01-01", "2024-01-31").count() == 2  # inclusive both ends
    assert FL.date_range(p, None, None).count() == 3
    assert FL.artists(p, []).count() == 3  # empty list = no filter
    assert FL.artists(p, ["A"]).count() == 2
    assert FL.content_types(p, ["Vinyl"]).count() == 0  # unknown name matches nothing
    assert FL.content_types(p, ["Podcasts"]).count() == 1
    assert FL.content_types(p, ["Songs", "Podcasts", "Audiobooks"]).count() == 3
    assert FL.apply_filters(p, "2024-01-01", "2024-01-31", ["A", "B"], ["Songs"]).count() == 1


def test_date_filter_prunes_year_partitions(spark):
    from encore.sources import curated

    from conftest import SF_SMALL

    plan = FL.date_range(curated.plays(spark, SF_SMALL), "1996-01-01", "1996-12-31")._jdf.queryExecution() \
        .executedPlan().toString()
    assert "PartitionFilters" in plan and "year" in plan


def test_kpis_empty_selection_is_zero(make_plays):
    p = make_plays([{"ts": ts("2024-01-01 00:00:00")}], sessions=False).where(F.lit(False))
    k = A.kpis(p).first()
    assert (k["total_hours"], k["tracks_played"], k["skip_rate"], k["shuffle_rate"], k["rows"]) == (0.0, 0, 0.0, 0.0, 0)
