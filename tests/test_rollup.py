"""Rollups stand in for plays; reports scan the log at most twice."""

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from encore.operators import aggregates as A
from encore.operators import rankings as R
from encore.operators import statistics as S
from encore.operators import trends as TR
from encore.operators.rollup import LATE, WEEKEND, late_night, rollup, weekend
from encore.plans import reports as RP
from encore.schema import ALBUM, ARTIST, TRACK, TRACK_URI
from encore.sources import curated

from conftest import SF_SMALL, ts

TIMES = ["date", "month", "weekday_num", "weekday_name", "listening_hour", "is_song", "is_podcast", "is_audiobook"]
KINDS = ["reason_start", "reason_end", "platform", "shuffle", "offline", "incognito_mode", "is_skipped"]
OVER_TIMES = [A.hourly_hours, A.weekday_hours, A.content_mix, A.monthly_seasonality, A.day_night, A.week_segment_hours,
              A.heatmap_wide, A.heatmap_present, A.peak_hour_day, TR.daily_trend, TR.weekly_hours, S.daily_stats]
OVER_KINDS = [A.skip_by_reason, A.shuffle_compare, A.offline_share, A.incognito_share, A.platform_usage, A.platform_share,
              lambda p: A.value_counts(p, "reason_end")]
OVER_NAMES = [A.kpis, R.top_artists_hours, R.top_tracks_hours, R.favorite_albums, R.featured_track, R.album_spotlight,
              R.artist_spotlight, R.wrapped_late_night, R.wrapped_top_artist, R.wrapped_weekend, R.wrapped_artist_year,
              R.ranking_tracks, R.repeated_tracks, lambda p: S.artist_diversity(R.songs(p))]


def names(plays):
    flags = [late_night(plays).alias(LATE), weekend(plays).alias(WEEKEND)]
    return rollup(plays, TRACK, ARTIST, ALBUM, TRACK_URI, "year", "is_song", "is_skipped", "shuffle", *flags, span=True)


def rows(df: DataFrame):
    """Comparable rows; means over days depend in their last digits on the order of addition."""
    return df.columns, sorted(repr([round(v, 9) if isinstance(v, float) else v for v in r]) for r in df.collect())


def same_over(plays):
    for cells, operators in ((rollup(plays, *TIMES), OVER_TIMES), (rollup(plays, *KINDS), OVER_KINDS), (names(plays), OVER_NAMES)):
        for operator in operators:
            assert rows(operator(cells)) == rows(operator(plays)), operator


def test_operators_over_a_rollup_equal_those_over_plays(spark):
    same_over(curated.plays(spark, SF_SMALL))


def test_rollups_of_odd_plays(make_plays):
    play = {"ts": ts("2024-03-02T02:00:00"), "ms_played": 1000.0, TRACK: "a", ARTIST: "x", TRACK_URI: "u:track:2"}
    plays = [play, {**play, TRACK_URI: "u:track:1"}, {**play, "ms_played": None}, {**play, ARTIST: None, "reason_end": None},
             {**play, "ts": ts("2023-01-01T12:00:00"), TRACK_URI: None}, {"ts": ts("2023-01-01T12:00:00")},
             {**play, "ts": None}]
    same_over(make_plays(plays))
    same_over(make_plays(plays).where("false"))


def frames(report):
    for value in report.values():
        if isinstance(value, dict):
            yield from frames(value)
        elif isinstance(value, DataFrame):
            yield value


REPORTS = [RP.dashboard, RP.overview, RP.listening_trends, RP.behavior_analysis, RP.time_patterns, RP.statistical_insights,
           RP.artist_song_analytics]


@pytest.mark.parametrize("report", REPORTS, ids=lambda r: r.__name__)
def test_reports_scan_the_log_at_most_twice(spark, monkeypatch, report):
    plays = curated.plays(spark, SF_SMALL)
    log, made = set(plays.inputFiles()), []
    monkeypatch.setattr(RP, "rollup", lambda *a, **k: made.append(1) or rollup(*a, **k))
    result = report(plays)
    assert 1 <= len(made) <= 2
    selection = result.pop("_selection")
    assert log & set(selection.inputFiles())
    shown = list(frames(result))
    assert shown and not any(log & set(f.inputFiles()) for f in shown)


def test_scalars_of_a_report_come_from_its_rollups(spark):
    """The numbers read while a report is built cost no scan of their own either."""
    plays = curated.plays(spark, SF_SMALL)
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(ms):
        seen.add(1)
        return ms

    watched = plays.withColumn("ms_played", counted.asNondeterministic()("ms_played"))
    report = RP.artist_song_analytics(watched)
    for f in frames({k: v for k, v in report.items() if k != "_selection"}):
        f.collect()
    assert seen.value == plays.count()
