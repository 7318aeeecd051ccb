"""Versions of a table: what a reader sees between the steps of a commit, and after a crash."""

import pytest
from pyspark.sql import functions as F

from encore.operators.numbering import numbered
from encore.sources import curated, fs


def _stage(spark, folder, n):
    path = f"{folder}/stage-{n}"
    spark.range(n).write.parquet(path)
    return path


def _seen(spark, path):
    at = fs.current(spark, path)
    return None if at is None else spark.read.parquet(at).count()


def test_readers_see_the_old_or_the_new_table(spark, tmp_path, monkeypatch):
    path, seen = str(tmp_path / "t"), []
    assert fs.current(spark, path) is None
    fs.publish_version(spark, _stage(spark, tmp_path, 3), path)
    assert _seen(spark, path) == 3
    reader = spark.read.parquet(fs.current(spark, path))
    real = fs._path

    def watched(s, p):
        monkeypatch.setattr(fs, "_path", real)
        seen.append(_seen(spark, path))
        monkeypatch.setattr(fs, "_path", watched)
        return real(s, p)

    monkeypatch.setattr(fs, "_path", watched)
    fs.publish_version(spark, _stage(spark, tmp_path, 5), path)
    monkeypatch.setattr(fs, "_path", real)
    assert len(seen) > 4 and set(seen) == {3} and _seen(spark, path) == 5
    assert reader.count() == 3  # the version before stays for its readers


@pytest.mark.parametrize("step", ["rename", "marker", "cleaning"])
def test_a_crash_after_any_step_leaves_a_whole_table(spark, tmp_path, monkeypatch, step):
    path = str(tmp_path / "t")
    for n in (3, 4):
        fs.publish_version(spark, _stage(spark, tmp_path, n), path)
    real = fs._path
    stops = {"rename": "v0000000003", "marker": "_v0000000003.done", "cleaning": "_v0000000001.done"}

    def crash(s, p):
        if p.endswith("/" + stops[step]):
            raise RuntimeError("lost")
        return real(s, p)

    monkeypatch.setattr(fs, "_path", crash)
    with pytest.raises(RuntimeError):
        fs.publish_version(spark, _stage(spark, tmp_path, 6), path)
    monkeypatch.setattr(fs, "_path", real)
    assert _seen(spark, path) == (6 if step == "cleaning" else 4)
    fs.publish_version(spark, _stage(spark, tmp_path, 7), path)  # the next build goes on
    assert _seen(spark, path) == 7


def test_a_rename_that_fails_is_noticed(spark, tmp_path):
    path = str(tmp_path / "t")
    fs.publish_version(spark, _stage(spark, tmp_path, 3), path)
    with pytest.raises(Exception):
        fs.publish_version(spark, f"{tmp_path}/nothing", path)
    assert _seen(spark, path) == 3


def test_curated_table_is_rebuilt_as_a_version(spark, tmp_path):
    from conftest import raw_rows, ts

    path = str(tmp_path / "plays")
    for n in (2, 3):
        raw = raw_rows(spark, [{"ts": ts(f"2024-01-0{i + 1}T00:00:00"), "ms_played": 1.0} for i in range(n)])
        curated.build_from_raw(spark, raw, path)
        assert curated.is_written(spark, path) and curated.read_curated(spark, path).count() == n


@pytest.mark.parametrize("n,parts", [(0, 3), (1, 1), (1000, 7)])
def test_numbered_is_row_number(spark, n, parts):
    df = spark.range(n).select((F.col("id") * 7919 % 1009).alias("k"), (F.col("id") % 3).alias("g")).repartition(parts)
    got = numbered(df, [F.col("g").desc(), F.col("k").asc()])
    want = sorted(((r["g"], r["k"]) for r in df.collect()), key=lambda x: (-x[0], x[1]))
    rows = sorted((r["position"], r["g"], r["k"]) for r in got.collect())
    assert rows == [(i, g, k) for i, (g, k) in enumerate(want, 1)]
