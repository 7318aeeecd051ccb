"""The curated build: whole rows are shuffled once, nothing spills into a second sort, copies are dropped exactly."""

import datetime as dt

from pyspark.sql import functions as F

from encore.operators.prepare import prepare_plays
from encore.sources import curated, fs

from conftest import raw_rows


def _raw(spark):
    start = dt.datetime(2023, 12, 31, 22)
    rows = [{"ts": start + dt.timedelta(minutes=7 * (i % 90)), "ms_played": float(i % 5),
             "master_metadata_track_name": f"t{i % 11}"} for i in range(1200)]
    raw = raw_rows(spark, rows)
    hot = raw_rows(spark, [{"ts": dt.datetime(2024, 1, 1), "ms_played": 0.0}]).crossJoin(spark.range(700)).drop("id")
    signed = raw_rows(spark, [{"ts": dt.datetime(2024, 1, 1), "ms_played": -0.0}, {"ts": None, "ms_played": 1.0}])
    return raw.unionByName(hot).unionByName(signed).repartition(5)


def test_build_equals_the_plain_cleaning(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(curated, "TASK_ROWS", 100)  # many time ranges, and rows with more copies than a task takes
    raw = _raw(spark)
    got = curated.read_curated(spark, curated.build_from_raw(spark, raw, str(tmp_path / "t")))
    want = prepare_plays(raw)
    cols = sorted(want.columns)
    rows = [sorted(map(str, d.select(cols).collect())) for d in (got, want)]
    assert rows[0] == rows[1] and len(rows[0]) < 1200
    assert len(fs.listing(spark, str(tmp_path / "t"))) > 5


def test_copies_are_merged_before_the_time_shuffle(spark, monkeypatch):
    monkeypatch.setattr(curated, "TASK_ROWS", 100)
    staged = _raw(spark).withColumn(curated._ROW, F.xxhash64("ts", "ms_played", "master_metadata_track_name"))
    merged = curated.merge_copies(staged, staged.count())
    most = merged.groupBy(curated._ROW).count().agg(F.max("count")).first()[0]
    assert most <= 60 < 700
    assert merged.distinct().count() == staged.distinct().count()


def test_rows_are_shuffled_once_and_sorted_once(spark, tmp_path, monkeypatch):
    """Before, the whole rows went through three shuffles, and the writer sorted them once more."""
    plans = []
    write = curated.write_curated

    def look(plays, path, mode="overwrite"):
        plans.append(plays.sortWithinPartitions("year", "ts")._jdf.queryExecution().executedPlan().toString())
        return write(plays, path, mode)

    monkeypatch.setattr(curated, "write_curated", look)
    monkeypatch.setattr(curated, "TASK_ROWS", 300)
    curated.build_from_raw(spark, _raw(spark).distinct(), str(tmp_path / "t"))
    wide = [line for line in plans[0].splitlines() if "Exchange" in line and "Broadcast" not in line]
    assert len(wide) == 1 and "rangepartitioning(ts" in wide[0]
    assert plans[0].count("Sort [") == 1
