"""Sessions: boundary semantics and equality with the plain global-lag definition."""

import duckdb
from pyspark.sql import functions as F

from encore.operators import sessions
from encore.operators.sessions import sessionize
from encore.sources.star import read_table

from conftest import SF_SMALL, ts


def test_gap_boundary(make_plays):
    p = make_plays([
        {"ts": ts("2024-01-01 00:00:00")},
        {"ts": ts("2024-01-01 00:30:00")},   # exactly 1800 s: same session
        {"ts": ts("2024-01-01 01:00:01")},   # 1801 s: new session
        {"ts": ts("2024-01-01 01:00:01"), "ms_played": 5.0},   # tie (a different play): same session
    ])
    assert [r["session_id"] for r in p.orderBy("ts").collect()] == [1, 1, 2, 2]


def _reference(sf):
    return dict(duckdb.sql(f"""
        WITH t AS (SELECT DISTINCT ts FROM '{sf}/events.parquet'),
        l AS (SELECT ts, epoch_us(ts) - lag(epoch_us(ts)) OVER (ORDER BY ts) AS g FROM t),
        s AS (SELECT ts, 1 + sum(CASE WHEN g > 1800000000 THEN 1 ELSE 0 END)
                         OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM l)
        SELECT e.event_id, s.sid FROM '{sf}/events.parquet' e JOIN s USING (ts)""").fetchall())


def test_equal_to_the_global_definition(spark, monkeypatch):
    ev = read_table(spark, SF_SMALL, "events").select("event_id", "ts")
    ref = _reference(SF_SMALL)
    for slots in (sessions.SLOTS, 1, 3, 50):  # parts of few slots: every border case of the offsets
        monkeypatch.setattr(sessions, "SLOTS", slots)
        got = {r[0]: r[1] for r in sessionize(ev, "ts", 30).select("event_id", "session_id").collect()}
        assert got == ref, slots


def test_partition_invariance(spark):
    ev = read_table(spark, SF_SMALL, "events").select("event_id", "ts")
    base = sorted(sessionize(ev, "ts", 30).select("event_id", "session_id").collect())
    for n in (1, 7, 64):
        assert sorted(sessionize(ev.repartition(n), "ts", 30).select("event_id", "session_id").collect()) == base


def test_building_starts_no_job_and_one_task_sees_parts_only(spark):
    ev = read_table(spark, SF_SMALL, "events").select("event_id", "ts", "value")
    sc = spark.sparkContext
    sc.setJobGroup("sessions-build", "no job may carry this name")
    try:
        out = sessionize(ev, "ts", 30)
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert not sc.statusTracker().getJobIdsForGroup("sessions-build")
    # the one exchange to a single task carries the part table: an aggregate by part
    lines = plan.split("\n")
    single = [i for i, line in enumerate(lines) if "SinglePartition" in line]
    assert len(single) == 1 and "Aggregate(keys=[_part" in lines[single[0] + 1]
    assert out.where(F.col("session_id").isNull()).count() == 0


def test_null_timestamps_small_gaps_and_times_before_the_epoch(spark):
    import datetime as dt

    base = dt.datetime(1969, 12, 31, 23, 59, 58)
    rows = [(i, base + dt.timedelta(seconds=i)) for i in range(5)] + [(10, None), (11, None), (12, base + dt.timedelta(seconds=9))]
    df = spark.createDataFrame(rows, "id long, ts timestamp_ntz")
    one = dict(tuple(r) for r in sessionize(df, "ts", 1 / 60).select("id", "session_id").collect())
    assert one == {0: 1, 1: 1, 2: 1, 3: 1, 4: 1, 10: None, 11: None, 12: 2}
    none = dict(tuple(r) for r in sessionize(df, "ts", 0).select("id", "session_id").collect())
    assert none == {0: 1, 1: 2, 2: 3, 3: 4, 4: 5, 10: None, 11: None, 12: 6}
    assert sessionize(df.limit(0), "ts").count() == 0


def test_wall_clock_gaps_ignore_session_zone(spark):
    """TIMESTAMP_NTZ gaps are wall-clock gaps even in a zone with a daylight-saving jump."""
    import datetime as dt

    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        rows = [(1, dt.datetime(2024, 3, 10, 1, 50)), (2, dt.datetime(2024, 3, 10, 2, 10)),
                (3, dt.datetime(2024, 3, 10, 2, 45))]
        df = spark.createDataFrame(rows, "id long, ts timestamp_ntz")
        got = sorted(tuple(r) for r in sessionize(df, "ts", 30).select("id", "session_id").collect())
        assert got == [(1, 1), (2, 1), (3, 2)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_hot_timestamp_third_of_rows(spark):
    """A third of all rows on one timestamp: combined before any shuffle, numbers unchanged."""
    import datetime as dt

    base = dt.datetime(2024, 1, 1)
    rows = [(i, base + dt.timedelta(minutes=7 * i)) for i in range(600)]
    rows += [(1000 + i, base + dt.timedelta(minutes=7 * 300)) for i in range(300)]  # hot timestamp
    rows += [(5000, base + dt.timedelta(minutes=7 * 600 + 31))]  # a gap > 30 minutes
    df = spark.createDataFrame(rows, "id long, ts timestamp_ntz").repartition(8)
    got = dict(tuple(r) for r in sessionize(df, "ts", 30).select("id", "session_id").collect())
    assert set(got.values()) == {1, 2}
    assert got[5000] == 2 and got[1000] == 1 and got[1299] == 1


def test_per_listener_sessions_equal_partitioned_definition(spark, monkeypatch):
    """``by`` keys: numbering per listener equals a per-listener global-lag window."""
    ref = dict(((u, e), s) for e, u, s in duckdb.sql(f"""
        WITH t AS (SELECT DISTINCT user_id, ts FROM '{SF_SMALL}/events.parquet'),
        l AS (SELECT user_id, ts, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM t),
        s AS (SELECT user_id, ts, 1 + sum(CASE WHEN g > 1800000000 THEN 1 ELSE 0 END)
                 OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM l)
        SELECT e.event_id, e.user_id, s.sid FROM '{SF_SMALL}/events.parquet' e JOIN s USING (user_id, ts)""").fetchall())
    ev = read_table(spark, SF_SMALL, "events").select("event_id", "user_id", "ts")
    for slots in (sessions.SLOTS, 2):
        monkeypatch.setattr(sessions, "SLOTS", slots)
        got = {(r[1], r[0]): r[2] for r in
               sessionize(ev, "ts", 30, by=["user_id"]).select("event_id", "user_id", "session_id").collect()}
        assert got == ref, slots
