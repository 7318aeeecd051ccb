"""Stored tables: changed inputs are noticed, builds are published whole, streams keep apart."""

import os
import shutil

from encore.sources import curated, fs
from encore.streaming.ingest import start_ingest

from conftest import SF_SMALL


def _copy(spark, tmp_path):
    """The star tables as folders of part files."""
    for t in ("lineitem", "orders", "part", "customer", "nation"):
        spark.read.parquet(f"{SF_SMALL}/{t}.parquet").repartition(2).write.parquet(str(tmp_path / f"{t}.parquet"))
    return str(tmp_path)


def test_a_rewritten_part_file_is_noticed(spark, tmp_path):
    sf = _copy(spark, tmp_path)
    first, n = curated.star_curated_path(spark, sf), curated.plays(spark, sf).count()
    assert curated.star_curated_path(spark, sf) == first
    part = next(f for f in sorted(os.listdir(tmp_path / "lineitem.parquet")) if f.endswith(".parquet"))
    gone = str(tmp_path / "lineitem.parquet" / part)
    spark.read.parquet(gone).limit(10).coalesce(1).write.parquet(str(tmp_path / "less"))
    less = next(f for f in os.listdir(tmp_path / "less") if f.endswith(".parquet"))
    shutil.copy(tmp_path / "less" / less, gone)  # the folder itself keeps its listing of names
    crc = tmp_path / "lineitem.parquet" / f".{part}.crc"
    crc.unlink(missing_ok=True)
    assert curated.star_curated_path(spark, sf) != first
    assert curated.plays(spark, sf).count() < n


def test_publishing_never_mixes_two_builds(spark, tmp_path):
    a, b, target = (str(tmp_path / x) for x in ("a", "b", "deep/target"))
    spark.range(3).write.parquet(a)
    spark.range(5).write.parquet(b)
    assert fs.publish(spark, a, target)
    assert not fs.publish(spark, b, target) and spark.read.parquet(target).count() == 3
    assert fs.publish(spark, b, target, replace=True) and spark.read.parquet(target).count() == 5


def test_paths_are_asked_of_the_default_file_system(spark, tmp_path):
    conf = spark._jsc.hadoopConfiguration()
    old = conf.get("fs.defaultFS")
    (tmp_path / "here").mkdir()
    try:
        conf.set("fs.viewfs.mounttable.t.link./store", f"file://{tmp_path}")
        conf.set("fs.defaultFS", "viewfs://t/")
        # the folder exists on the default file system only, and only there is it looked for
        assert fs.exists(spark, "/store/here") and not os.path.exists("/store/here")
        assert not fs.exists(spark, str(tmp_path / "here"))
    finally:
        conf.set("fs.defaultFS", old)


def test_two_streams_keep_their_own_checkpoints(spark, tmp_path):
    for name, n in (("x", 1), ("y", 2)):
        (tmp_path / name).mkdir()
        for i in range(n):
            (tmp_path / name / f"{i}.json").write_text('{"ts":"2024-01-01T00:00:00Z"}')
        start_ingest(spark, str(tmp_path / name), str(tmp_path / f"raw-{name}")).awaitTermination(120)
    assert [spark.read.parquet(str(tmp_path / f"raw-{n}")).count() for n in "xy"] == [1, 2]
