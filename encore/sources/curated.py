"""Curated plays table: cleaned once, written as Parquet, read by every operator.

This replaces the dashboard's process-wide memoised frame with a written table in the
cluster-shared folder (``spark.checkpoint.dir``), which also cuts the lineage of the
ingest joins/sessions: a lost executor re-reads files instead of recomputing the ingest.

Layout: ``partitionBy("year")`` (date filters also emit a ``year`` predicate, so whole
years are pruned), range-partitioned and sorted by ``ts`` inside each file so Parquet
row-group min/max statistics prune date ranges within a year.
"""

from __future__ import annotations

import hashlib
import math
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from encore.operators.prepare import clean_plays, valid_plays
from encore.session import SPLIT_BYTES, configure, shared_dir, small_splits
from encore.sources import fs
from encore.sources.star import star_plays

# Bump when the cleaning logic changes so stale curated tables are not reused.
CURATED_VERSION = "8"

TASK_ROWS = 200_000  # rows of one task of the time-range shuffle: what it groups and sorts stays in memory
TASK_BYTES = 2 * SPLIT_BYTES  # the same in stored bytes, for long texts
_ROW = "_row"  # hash of a whole raw row

_build_lock = threading.Lock()  # one build per table even when queries run on several threads


def write_curated(plays: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Writes ``plays``, which are range-partitioned by time. The order begins with the folders' column, so the
    writer adds no sort of its own."""
    plays.sortWithinPartitions("year", "ts").write.mode(mode).partitionBy("year").parquet(path)
    return path


def time_tasks(spark: SparkSession, stage: str, rows: int) -> int:
    """Tasks for a shuffle of the stage's rows by time: of a bounded size each, and enough to go round."""
    stored = sum(size for _, size, _ in fs.listing(spark, stage))
    spread = min(spark.sparkContext.defaultParallelism, math.ceil(rows / 20_000))
    return max(1, spread, math.ceil(rows / TASK_ROWS), math.ceil(stored / TASK_BYTES))


def merge_copies(staged: DataFrame, rows: int) -> DataFrame:
    """Merges the copies of rows that have more copies than half a task's share, before they are shuffled by time; of all
    others every row stays. Which hashes are looked at has no effect on the final rows, since all copies of a row
    have the same one."""
    if rows <= TASK_ROWS:
        return staged
    support = max(2e-4, min(0.5, TASK_ROWS / 2 / rows))
    often = staged.freqItems([_ROW], support).first()[0]  # at most 1 / support hashes, all that are as frequent among them
    counts = staged.where(F.col(_ROW).isin(often)).groupBy(_ROW).agg(F.count(F.lit(1)).alias("n"))
    hot = [r[_ROW] for r in counts.where(F.col("n") >= support * rows).collect()]
    if not hot:
        return staged
    return staged.where(~F.col(_ROW).isin(hot)).unionByName(staged.where(F.col(_ROW).isin(hot)).dropDuplicates())


def read_curated(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of a curated table; a frame keeps to the version it was made from."""
    return spark.read.parquet(fs.current(spark, path) or path)


def _fingerprint(spark: SparkSession, sf_dir: str, tables: list[str]) -> str:
    """Identity of the inputs: every data file's path, size and modification time, listed anew on
    each call, so that a changed input never reuses a stale curated table."""
    h = hashlib.sha1(CURATED_VERSION.encode())
    for t in tables:
        h.update(repr(fs.listing(spark, f"{sf_dir.rstrip('/')}/{t}.parquet")).encode())
    return h.hexdigest()[:16]


def is_written(spark: SparkSession, path: str) -> bool:
    """A completed write leaves ``_SUCCESS``; a partial one does not and is rebuilt."""
    return fs.exists(spark, f"{path.rstrip('/')}/_SUCCESS") or fs.current(spark, path) is not None


def star_curated_path(spark: SparkSession, sf_dir: str) -> str:
    key = _fingerprint(spark, sf_dir, ["lineitem", "orders", "part", "customer", "nation"])
    return f"{shared_dir(spark)}/encore/curated/plays-{key}"


def build_from_raw(spark: SparkSession, raw: DataFrame, path: str, replace: bool = True) -> str:
    """Clean ``raw`` into the curated table at ``path``.

    The valid raw rows are first written next to it (same shared folder) with a hash of the whole row: the
    expensive ingest (joins / JSON decoding) runs once, the session passes read only the ``ts`` column of that
    stage, and a lost executor re-reads files instead of recomputing the ingest. The whole rows are then shuffled once,
    by ranges of time and row hash: copies of a row come together there and are dropped, a timestamp with
    a large share of all rows is split over tasks, and the files are sorted by time. Rows with very many copies are
    merged before that shuffle. Session numbers come from a small stored table, a row per slot of time.

    All is written under names of this build's own; the
    finished table then becomes the newest version of ``path``, whose readers see it whole or not at all.
    Without ``replace`` it is renamed to ``path``, unless another build was first.
    """
    from encore.operators.sessions import session_slots, sessionize

    configure(spark)
    own = f"{path.rstrip('/')}-{uuid.uuid4().hex}"
    try:
        valid = valid_plays(raw)
        stage = valid.withColumn(_ROW, F.xxhash64(*valid.columns)).write.option("maxRecordsPerFile", TASK_ROWS)
        stage.parquet(f"{own}-stage")
        staged = spark.read.parquet(f"{own}-stage")
        rows = staged.count()
        session_slots(staged, "ts").write.parquet(f"{own}-slots")
        with small_splits(spark):
            plays = sessionize(merge_copies(staged, rows), "ts", ids=spark.read.parquet(f"{own}-slots"))
            plays = plays.repartitionByRange(time_tasks(spark, f"{own}-stage", rows), "ts", _ROW).dropDuplicates()
            plays = clean_plays(plays.drop(_ROW))
            write_curated(plays.select(*[c for c in plays.columns if c != "session_id"], "session_id"), own)
        if replace:
            fs.publish_version(spark, own, path)
        else:
            fs.publish(spark, own, path)
    finally:
        fs.remove(spark, f"{own}-stage")
        fs.remove(spark, f"{own}-slots")
        fs.remove(spark, own)  # only there if another build was first
    return path


def build(spark: SparkSession, sf_dir: str, replace: bool = False) -> str:
    """Build the curated table of ``sf_dir``. Its path names the inputs, so a table that another build
    published meanwhile is the same and stays."""
    return build_from_raw(spark, star_plays(spark, sf_dir), star_curated_path(spark, sf_dir), replace)


def plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curated plays built from the star-schema tables in ``sf_dir`` (built on first use, and anew
    when the tables' files change)."""
    configure(spark)
    path = star_curated_path(spark, sf_dir)
    if not is_written(spark, path):
        with _build_lock:
            if not is_written(spark, path):
                build(spark, sf_dir)
    return read_curated(spark, path)


def curated_columns(df: DataFrame) -> DataFrame:
    """Stable column order (partition discovery moves ``year`` to the end)."""
    from encore.schema import CURATED_EXTRA, RAW_COLUMNS

    cols = RAW_COLUMNS + ["source_file", "extra_json"] + CURATED_EXTRA + ["session_id"]
    return df.select(*[F.col(c) for c in cols if c in df.columns])
