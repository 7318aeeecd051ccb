"""Calendar bins, windows, rankings and their plans."""

import datetime as dt

from encore.operators import rankings as R
from encore.operators import trends as TR
from encore.sources import curated

from conftest import SF_SMALL, ts


def test_week_labels_and_gap_fill(make_plays):
    p = make_plays([
        {"ts": ts("2024-01-07 10:00:00"), "ms_played": 3600000.0},   # Sunday
        {"ts": ts("2024-01-08 10:00:00"), "ms_played": 7200000.0},   # Monday
        {"ts": ts("2024-01-29 10:00:00"), "ms_played": 3600000.0},
    ], sessions=False)
    w = {r["date"]: r["play_hours"] for r in TR.weekly_hours(p).collect()}
    assert w == {dt.date(2024, 1, 7): 1.0, dt.date(2024, 1, 14): 2.0, dt.date(2024, 1, 21): 0.0,
                 dt.date(2024, 1, 28): 0.0, dt.date(2024, 2, 4): 1.0}
    m = {r["date"]: r["play_hours"] for r in TR.monthly_hours(p).collect()}
    assert m == {dt.date(2024, 1, 31): 4.0}
    y = {r["date"]: r["play_hours"] for r in TR.yearly_hours(p).collect()}
    assert y == {dt.date(2024, 12, 31): 4.0}


def test_rolling_over_observed_days(make_plays):
    rows = [{"ts": ts(f"2024-01-{d:02d} 10:00:00"), "ms_played": 3600000.0 * d} for d in (1, 2, 10)]
    t = TR.daily_trend(make_plays(rows, sessions=False)).orderBy("date").collect()
    assert [r["rolling_7d"] for r in t] == [1.0, 1.5, 13 / 3]  # rows, not calendar days
    assert [r["cumulative_hours"] for r in t] == [1.0, 3.0, 13.0]


def test_sums_agree_across_resolutions(spark):
    p = curated.plays(spark, SF_SMALL)
    total = sum(r["play_hours"] for r in TR.daily_hours(p).collect())
    for f in (TR.weekly_hours, TR.monthly_hours, TR.yearly_hours):
        assert abs(sum(r["play_hours"] for r in f(p).collect()) - total) < 1e-6


def test_ties_broken_by_key(make_plays):
    rows = [{"ts": ts(f"2024-01-01 10:0{i}:00"), "master_metadata_album_artist_name": a, "ms_played": 60000.0}
            for i, a in enumerate(["B", "A", "C", "C"])]
    top = R.top_artists_hours(make_plays(rows, sessions=False), 2).collect()
    assert [r["artist"] for r in top] == ["C", "A"]


def test_topk_plan_is_take_ordered(spark):
    p = curated.plays(spark, SF_SMALL)
    plan = R.ranking_artists(p, 10)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_top_n_bounds(spark):
    import pytest

    p = curated.plays(spark, SF_SMALL)
    with pytest.raises(ValueError):
        R.ranking_artists(p, 4)
    with pytest.raises(ValueError):
        R.ranking_artists(p, 51)


def test_per_listener_series(make_plays):
    from pyspark.sql import functions as F

    rows = [{"ts": ts("2024-01-01 10:00:00"), "ms_played": 3600000.0, "source_file": "u1"},
            {"ts": ts("2024-01-03 10:00:00"), "ms_played": 7200000.0, "source_file": "u1"},
            {"ts": ts("2024-01-02 10:00:00"), "ms_played": 3600000.0, "source_file": "u2"}]
    p = make_plays(rows, sessions=False).withColumn("listener", F.col("source_file"))
    t = {(r["listener"], str(r["date"])): r["cumulative_hours"] for r in TR.daily_trend(p, by=["listener"]).collect()}
    assert t == {("u1", "2024-01-01"): 1.0, ("u1", "2024-01-03"): 3.0, ("u2", "2024-01-02"): 1.0}
    plan = TR.daily_trend(p, by=["listener"])._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    w = TR.weekly_hours(p, by=["listener"]).collect()
    assert sorted((r["listener"], str(r["date"]), r["play_hours"]) for r in w) == [
        ("u1", "2024-01-07", 3.0), ("u2", "2024-01-07", 1.0)]
