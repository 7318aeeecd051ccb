"""Curated plays kept up to date by arrivals (S6, F2, W3) instead of rebuilt.

Time is cut into slices (calendar months, or days for dense logs). Equal raw rows have equal timestamps, so an
arriving row can only repeat a row of its own slice, and a session can only cross to the slice next to it:

- every stored row carries a 128-bit digest of its raw row. Arriving rows are shuffled once, by ranges of time, together
  with the timestamps and digests (nothing else) of the stored rows of the slices they touch; equal ones meet there,
  and what is new is written as one more part of its slices. Stored rows are neither moved nor written again;
- a slice of more than ``PARTS`` parts is written anew as one, so that files stay few;
- sessions are numbered inside a slice from 1 in a table of its slots of time (``session_slots``), made anew from the
  timestamps of a slice that gains rows. A manifest holds a row per part, and with a slice's newest part where its
  slots are, its first and last timestamp and how many sessions it has;
- readers turn local numbers into those of the whole log by one offset per slice, which takes a session that goes on
  over a slice's border once. An old slice's rows need no change when earlier ones gain sessions.

The work of a refresh is that of the arrivals and, of the slices they reach, of the timestamps and digests. Applying the
same arrivals again changes nothing, so a stream that repeats a batch after a crash is harmless. The manifest is published
as a version whose marker file is the commit: readers see the table before or after a refresh. One writer per table;
files that neither of the two newest versions names are removed.

Defined results: rows without a readable timestamp are dropped; arrivals without a new row leave the table alone; arrivals
must have the same column types each time. Columns other than the export's own are not kept. A table in the layout
before this one (``manifest`` without ``parts``) is refused and must be built anew.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from encore.operators.prepare import clean_plays, valid_plays
from encore.operators.sessions import epoch_us, session_slots, sessionize
from encore.schema import CURATED_EXTRA, RAW_COLUMNS, SESSION_GAP_MINUTES
from encore.session import configure, small_splits
from encore.sources import fs
from encore.sources.curated import _ROW, TASK_ROWS, merge_copies, time_tasks

_ROW2 = "_row2"  # the digest's other half
_RAW = [*RAW_COLUMNS, "source_file", "extra_json"]
_COLUMNS = [*_RAW, *CURATED_EXTRA]
_MANIFEST = "slice date, batch string, nth long, rows long, slots string, first_us long, last_us long, sessions long"

PARTS = 8  # of a slice, beyond which it is written anew as one
BROADCAST_BYTES = 64 << 20  # of stored slots that readers send to every task


def _digest(df: DataFrame) -> list:
    """A row's identity over all its columns, in two longs: NULL is told from any value, timestamps keep microseconds."""
    def plain(f: T.StructField):
        times = isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType))
        return epoch_us(f.name, f.dataType) if times else F.col(f.name)

    # a hash goes on from the one before it and skips NULL, so it also takes whether a value is there
    parts = [x for f in sorted(df.schema.fields, key=lambda f: f.name) for x in (F.col(f.name).isNull(), plain(f))]
    return [F.xxhash64(F.lit(half), *parts).alias(name) for half, name in enumerate((_ROW, _ROW2))]


def _slices(spark: SparkSession, path: str) -> list:
    """The newest manifest's rows by slice, one per part, oldest part first."""
    version = fs.current(spark, f"{path}/parts")
    if version is None and fs.current(spark, f"{path}/manifest"):
        raise ValueError(f"{path} has an older layout; build it anew")
    return spark.read.schema(_MANIFEST).parquet(version).orderBy("slice", "nth").collect() if version else []


def _folder(path: str, row) -> str:
    return f"{path}/data/batch={row['batch']}/year={row['slice'].year}/slice={row['slice']}"


def _rows(spark: SparkSession, path: str, parts: list) -> DataFrame:
    return spark.read.option("basePath", f"{path}/data").parquet(*[_folder(path, r) for r in parts]).drop("batch")


def _vacuum(spark: SparkSession, path: str) -> None:
    """Removes folders of parts and slots that neither kept version names."""
    named, slots = set(), set()
    for n in fs.versions(spark, f"{path}/parts"):
        kept = spark.read.schema(_MANIFEST).parquet(n).collect()
        named |= {_folder("", r) for r in kept}
        slots |= {f"/slots/batch={r['slots']}" for r in kept}
    for folder in {f[0].rsplit("/", 1)[0] for f in fs.listing(spark, f"{path}/data")}:
        if "/" + re.search(r"data/batch=.*", folder)[0] not in named:
            fs.remove(spark, folder)
    for folder in {f[0].rsplit("/", 1)[0] for f in fs.listing(spark, f"{path}/slots")}:
        if "/" + re.search(r"slots/batch=.*", folder)[0] not in slots:
            fs.remove(spark, folder)


def _write(rows: DataFrame, path: str) -> None:
    """Rows of a frame in the order of ``year, slice``, which the writer's folders need."""
    rows.select(*_COLUMNS, _ROW, _ROW2, "slice").write.partitionBy("year", "slice").parquet(path)


def apply_arrivals(spark: SparkSession, raw: DataFrame, path: str, unit: str = "month",
                   gap_minutes: float = SESSION_GAP_MINUTES, stored: str | None = None) -> list:
    """Adds the new rows of ``raw`` to the table at ``path`` and gives the slices that changed. ``unit`` (``month`` or
    ``day``) and ``gap_minutes`` must stay the same over a table's life. ``raw`` is read several times and is first written
    next to the table, unless it is a mere selection from files in the folder ``stored``."""
    configure(spark)
    path = path.rstrip("/")
    batch = f"b{uuid.uuid4().hex}"
    work = f"{path}/work/{batch}"
    try:
        raw = valid_plays(raw).select(*_RAW)
        numbers = [f.name for f in raw.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
        raw = raw.withColumns({c: F.when(F.col(c) == 0, F.lit(0.0)).otherwise(F.col(c)).cast(raw.schema[c].dataType) for c in numbers})  # -0.0 is 0.0
        if stored is None:
            stored = f"{work}/arrived"
            raw.write.option("maxRecordsPerFile", TASK_ROWS).parquet(stored)
            raw = spark.read.parquet(stored)
        arrived = raw.withColumns(dict(zip((_ROW, _ROW2), _digest(raw))))
        slice_ = F.date_trunc(unit, "ts").cast("date")

        manifest = _slices(spark, path)
        counts = {r["slice"]: r["count"] for r in arrived.groupBy(slice_.alias("slice")).count().collect()}  # bounded by the calendar
        if not counts:
            return []
        old = [r for r in manifest if r["slice"] in counts]
        with small_splits(spark):
            arrived = merge_copies(arrived, sum(counts.values())).withColumn("_known", F.lit(False))
            if old:
                known = _rows(spark, path, old).select("ts", _ROW, _ROW2, F.lit(True).alias("_known"))
                arrived = arrived.unionByName(known, allowMissingColumns=True)
            tasks = time_tasks(spark, stored, sum(counts.values()) + sum(r["rows"] for r in old))
            # one sort serves the comparison and the folders; the range of a row's time and hash holds its copies
            arrived = arrived.repartitionByRange(tasks, "ts", _ROW).withColumns({"slice": slice_, "year": F.year("ts")})
            copies = Window.partitionBy("year", "slice", "ts", _ROW, _ROW2).orderBy(F.col("_known").desc())
            fresh = arrived.withColumn("_nth", F.row_number().over(copies)).where("_nth = 1 AND NOT _known")
            _write(clean_plays(fresh.drop("_nth", "_known")), f"{path}/data/batch={batch}")
        if not fs.listing(spark, f"{path}/data/batch={batch}"):
            fs.remove(spark, f"{path}/data/batch={batch}")
            return []

        written = spark.read.parquet(f"{path}/data/batch={batch}")
        gained = {r["slice"]: r["count"] for r in written.groupBy("slice").count().collect()}
        times = written.select("slice", "ts")
        old = [r for r in manifest if r["slice"] in gained]
        if old:
            times = times.unionByName(_rows(spark, path, old).select("slice", "ts"))
        slots = f"{path}/slots/batch={batch}"
        session_slots(times, "ts", gap_minutes, "_local", by=["slice"]).write.parquet(slots)
        us = epoch_us("ts", times.schema["ts"].dataType)
        ends = times.groupBy("slice").agg(F.min(us).alias("first_us"), F.max(us).alias("last_us"))
        sessions = spark.read.parquet(slots).groupBy("slice").agg(F.max("_local").alias("sessions"))
        ends = {r["slice"]: r for r in ends.join(sessions, "slice").collect()}

        nth = 1 + max([r["nth"] for r in manifest], default=0)

        def part(s, name: str, rows: int) -> tuple:
            return s, name, nth, rows, batch, ends[s]["first_us"], ends[s]["last_us"], ends[s]["sessions"]

        new = {s: part(s, batch, n) for s, n in gained.items()}
        many = {s for s in gained if sum(r["slice"] == s for r in old) >= PARTS}
        if many:
            new |= _merged(spark, path, [r for r in old if r["slice"] in many], {s: new[s] for s in many}, f"{batch}m")
        kept = [tuple(r) for r in manifest if r["slice"] not in many]
        spark.createDataFrame([*kept, *new.values()], _MANIFEST).repartition(1).write.parquet(f"{work}/manifest")
        fs.publish_version(spark, f"{work}/manifest", f"{path}/parts")
        _vacuum(spark, path)
        return sorted(gained)
    finally:
        fs.remove(spark, work)


def _merged(spark: SparkSession, path: str, old: list, new: dict, batch: str) -> dict:
    """Writes the parts of slices, the newest ones of which are in ``new``, as one part each: their manifest rows."""
    fields = [c.split()[0] for c in _MANIFEST.split(", ")]
    newest = {s: dict(zip(fields, p)) for s, p in new.items()}
    size = {s: p["rows"] + sum(r["rows"] for r in old if r["slice"] == s) for s, p in newest.items()}
    rows = _rows(spark, path, [*old, *newest.values()])
    rows = rows.repartitionByRange(-(-sum(size.values()) // TASK_ROWS), "ts", _ROW).sortWithinPartitions("year", "slice", "ts")
    _write(rows, f"{path}/data/batch={batch}")
    return {s: tuple({**p, "batch": batch, "rows": size[s]}.values()) for s, p in newest.items()}


def read_incremental(spark: SparkSession, path: str, gap_minutes: float = SESSION_GAP_MINUTES) -> DataFrame:
    """The curated table as of its newest version, with sessions numbered over the whole log."""
    path = path.rstrip("/")
    manifest = _slices(spark, path)
    if not manifest:
        raise FileNotFoundError(f"no arrivals have been applied to {path}")
    newest = {r["slice"]: r for r in manifest}  # its latest part tells of a whole slice
    offsets, total, last = [], 0, None
    for r in newest.values():
        goes_on = last is not None and r["first_us"] - last <= gap_minutes * 60_000_000
        offsets.append((r["slice"], r["slots"], total - int(goes_on)))
        total += r["sessions"] - int(goes_on)
        last = r["last_us"]
    base = F.broadcast(spark.createDataFrame(offsets, "slice date, batch string, _base long"))  # a row per slice
    folders = sorted({f"{path}/slots/batch={r['slots']}" for r in newest.values()})
    ids = spark.read.option("basePath", f"{path}/slots").parquet(*folders).join(base, ["slice", "batch"])
    ids = ids.select("slice", "_slot", (F.col("_base") + F.col("_local")).alias("session_id"))
    if sum(size for f in folders for _, size, _ in fs.listing(spark, f)) <= BROADCAST_BYTES:
        ids = F.broadcast(ids)
    rows = sessionize(_rows(spark, path, manifest), "ts", gap_minutes, by=["slice"], ids=ids)
    return rows.select(*_COLUMNS, "session_id")
