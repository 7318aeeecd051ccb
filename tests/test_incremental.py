"""The curated table kept by arrivals equals one full build, row for row."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from encore.operators.prepare import prepare_plays
from encore.sources import fs
from encore.sources import incremental as I
from encore.streaming.ingest import start_curated_ingest

from conftest import raw_rows, ts


def _same(spark, path, raw):
    whole = prepare_plays(raw)
    got = I.read_incremental(spark, path)
    cols = [F.to_json(F.struct(*sorted(got.columns)), {"ignoreNullFields": "false"})]
    assert sorted(got.columns) == sorted(whole.columns)
    assert sorted(r[0] for r in got.select(*cols).collect()) == sorted(r[0] for r in whole.select(*cols).collect())


def _log(n, seed):
    r = random.Random(seed)
    rows = []
    for _ in range(n):
        day, minute = r.choice([1, 2, 28, 29, 30, 31]), r.choice([0, 5, 31, 1400, 1410, 1435, 1439])
        rows.append({"ts": ts(f"2024-0{r.choice([1, 3])}-{min(day, 31):02d} {minute // 60:02d}:{minute % 60:02d}:00"),
                     "ms_played": r.choice([None, 0.0, -0.0, -5.0, 60000.0]), "skipped": r.choice([None, True, False]),
                     "source_file": r.choice(["a", "b"])})
    return rows


@pytest.mark.parametrize("unit", ["month", "day"])
def test_arrivals_equal_a_full_build(spark, tmp_path, unit):
    path = str(tmp_path / "t")
    rows = _log(120, 5) + [{"ts": None, "ms_played": 1.0, "source_file": "a"}]
    parts = [rows[:40], rows[30:80], rows[80:], rows[:10]]  # some rows arrive again
    seen = []
    for part in parts:
        I.apply_arrivals(spark, raw_rows(spark, part), path, unit)
        seen += part
        _same(spark, path, raw_rows(spark, seen))


def test_sessions_across_slices_and_gaps_filled_later(spark, tmp_path):
    """A session over three days, and one that only a late arrival makes one."""
    path = str(tmp_path / "t")
    at = ["2024-01-01 23:50:00", "2024-01-02 00:10:00", "2024-01-05 23:45:00", "2024-01-06 00:30:00"]
    first = [{"ts": ts(x), "ms_played": 1.0} for x in at]
    late = [{"ts": ts("2024-01-06 00:05:00"), "ms_played": 1.0}, {"ts": ts("2023-12-01 00:00:00"), "ms_played": 1.0}]
    I.apply_arrivals(spark, raw_rows(spark, first), path, "day")
    got = I.read_incremental(spark, path).orderBy("ts").select("session_id").collect()
    assert [r[0] for r in got] == [1, 1, 2, 3]
    I.apply_arrivals(spark, raw_rows(spark, late), path, "day")
    got = I.read_incremental(spark, path).orderBy("ts").select("session_id").collect()
    assert [r[0] for r in got] == [1, 2, 2, 3, 3, 3]
    _same(spark, path, raw_rows(spark, first + late))


def test_only_reached_slices_are_written_and_repeats_change_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = [{"ts": ts(f"2024-{m:02d}-01 10:00:00"), "ms_played": 1.0} for m in (1, 2, 3)]
    assert len(I.apply_arrivals(spark, raw_rows(spark, rows), path)) == 3
    before = {r["slice"]: r["batch"] for r in I._slices(spark, path)}
    more = [rows[0], {"ts": ts("2024-02-01 10:05:00"), "ms_played": 1.0}]  # January's row is known
    assert [str(d) for d in I.apply_arrivals(spark, raw_rows(spark, more), path)] == ["2024-02-01"]
    after = {r["slice"]: r["batch"] for r in I._slices(spark, path)}
    assert sorted(str(d) for d in after if after[d] != before[d]) == ["2024-02-01"]
    assert I.apply_arrivals(spark, raw_rows(spark, more), path) == []
    assert I.apply_arrivals(spark, raw_rows(spark, []), path) == []
    assert {r["slice"]: r["batch"] for r in I._slices(spark, path)} == after


def test_a_crash_before_the_commit_leaves_the_table_as_it_was(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    rows = [{"ts": ts("2024-01-01 10:00:00"), "ms_played": 1.0}]
    more = [{"ts": ts("2024-01-01 10:05:00"), "ms_played": 2.0}]
    I.apply_arrivals(spark, raw_rows(spark, rows), path)
    with monkeypatch.context() as m:
        m.setattr(fs, "publish_version", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            I.apply_arrivals(spark, raw_rows(spark, more), path)
    assert I.read_incremental(spark, path).count() == 1
    for _ in range(3):  # a reader of the version before keeps its files; older ones go
        I.apply_arrivals(spark, raw_rows(spark, more), path)
    _same(spark, path, raw_rows(spark, rows + more))
    assert len([d for d in os.listdir(tmp_path / "t" / "data") if os.listdir(tmp_path / "t" / "data" / d)]) <= 3


def test_wall_clock_timestamps_and_microseconds(spark, tmp_path):
    """Rows that differ in microseconds only are different rows, also without a time zone."""
    path = str(tmp_path / "t")
    rows = [{"ts": ts("2024-01-01 10:00:00.000001"), "ms_played": 1.0}, {"ts": ts("2024-01-01 10:00:00.000002"), "ms_played": 1.0}]
    raw = raw_rows(spark, rows).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    for _ in range(2):
        I.apply_arrivals(spark, raw, path)
    assert I.read_incremental(spark, path).count() == 2


def test_no_table(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        I.read_incremental(spark, str(tmp_path / "none"))


def test_streamed_files(spark, tmp_path):
    src, table = str(tmp_path / "exports"), str(tmp_path / "t")
    os.makedirs(src)
    for name, text in (("a", '[{"ts":"2024-01-31T23:50:00Z","ms_played":60000}]'),
                       ("b", '{"ts":"2024-02-01T00:10:00Z","ms_played":1}\nbad\n')):
        with open(f"{src}/{name}.json", "w") as f:
            f.write(text)
        start_curated_ingest(spark, src, table).awaitTermination(180)
    assert [r[0] for r in I.read_incremental(spark, table).orderBy("ts").select("session_id").collect()] == [1, 1]


def _shuffles(plan):
    return [line for line in plan.split("\n") if re.search(r"[^s]Exchange (hash|range|Single)", line)]


def test_rows_are_shuffled_once_and_stored_ones_stay(spark, tmp_path, monkeypatch):
    """Whole rows pass one shuffle, by ranges of time; an arrival writes new rows only."""
    path, plans = str(tmp_path / "t"), []
    write = I._write

    def watched(rows, to):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        write(rows, to)

    monkeypatch.setattr(I, "_write", watched)
    rows = _log(60, 7)
    for part in (rows[:40], rows[20:]):
        I.apply_arrivals(spark, raw_rows(spark, part), path)
    for plan in plans:
        assert len(_shuffles(plan)) == 1 and "REPARTITION_BY_NUM" in plan, plan  # a range of time each, of one task here
    stored = I._slices(spark, path)
    distinct = prepare_plays(raw_rows(spark, rows), with_sessions=False).count()
    assert sum(r["rows"] for r in stored) == distinct == I.read_incremental(spark, path).count()
    assert len({r["batch"] for r in stored}) == 2


def test_parts_of_a_slice_are_merged(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    monkeypatch.setattr(I, "PARTS", 2)
    rows = [{"ts": ts(f"2024-01-01 {h:02d}:00:00"), "ms_played": 1.0} for h in range(6)]
    parts = []
    for r in rows[::-1]:
        I.apply_arrivals(spark, raw_rows(spark, [r, rows[-1]]), path)
        parts.append(len(I._slices(spark, path)))
    assert parts == [1, 2, 1, 2, 1, 2]
    _same(spark, path, raw_rows(spark, rows))


def test_nulls_do_not_shift_a_row_into_another(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = [{"ts": ts("2024-01-01 10:00:00"), c: "a"} for c in ("episode_name", "episode_show_name", "episode_uri")]
    for part in (rows[:1], rows):
        I.apply_arrivals(spark, raw_rows(spark, part), path)
    _same(spark, path, raw_rows(spark, rows))


def test_very_many_copies_are_merged_before_the_shuffle(spark, tmp_path, monkeypatch):
    from encore.sources import curated

    path = str(tmp_path / "t")
    monkeypatch.setattr(curated, "TASK_ROWS", 20)
    rows = [{"ts": ts("2024-01-01 10:00:00"), "ms_played": -0.0}] * 90 + _log(40, 9)
    for part in (rows[:100], rows[50:]):
        I.apply_arrivals(spark, raw_rows(spark, part), path)
    _same(spark, path, raw_rows(spark, rows))


def test_a_table_of_the_layout_before_is_refused(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(1).write.parquet(f"{path}/staged")
    fs.publish_version(spark, f"{path}/staged", f"{path}/manifest")
    with pytest.raises(ValueError, match="older layout"):
        I.read_incremental(spark, path)
