"""Large JSON files read in byte ranges, by many tasks, their text once.

A JSON text can be cut safely only where one of its records ends, and where that is depends on all
quotes and brackets before. So the text is read in pieces that end at every ``}`` (Spark's text reader with
that line separator splits files over tasks), and

1. every task goes through its file ranges once. It notes what a range does to the state of the text -
   how many quotes it holds, and how the depth changes, for a start outside and inside a string - and
   cuts it at the record ends it finds when it takes the range to start between two records. The range
   that begins a file also notes its kind, so that no other step looks at its layout;
2. a prefix scan over the ranges of a file (one row each) composes those notes to the true state at
   every start. Where a guess was wrong (nested records, quoted braces), that file's ranges are cut once
   more, from their true states;
3. what lies between the last cut of a range and the first one of a later range is put together, a
   record that spans ranges. It must fit in a row, as any record.

Every chunk is then decoded strictly. An array or object all of whose chunks are sound is one JSON
value; a line-delimited file all of whose chunks are one record on a line of its own needs no second
look either. Other files are the caller's to read by lines.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROW_BYTES = 1 << 29  # of a record that spans ranges

FULL, HEAD, TAIL, WHOLE, NOTE = range(5)  # parts: between two cuts, before the first, after the last, without a cut; the note
_SCHEMA = "path string, at long, part int, text binary, bytes long, quotes long, outside long, inside long, cuts int, size long"
_NAMES = [c.split()[0] for c in _SCHEMA.split(", ")]
_ESCAPE = re.compile(rb"\\.", re.DOTALL)
_BRACKET = re.compile(rb"[\[\]{]")


def _depth(text: bytes) -> int:
    return text.count(b"{") + text.count(b"[") - text.count(b"]")


class Range:
    """One range of a file, piece by piece, from a state: ``quoted`` (inside a string) and ``depth``.
    Records end at the depth ``level``."""

    def __init__(self, level: int = 0, quoted: int = 0, depth: int = 0):
        self.level, self.quoted, self.depth = level, quoted, depth
        self.parity, self.quotes, self.bytes = 0, 0, 0
        self.change = [0, 0]  # of the depth, from a start outside and one inside a string
        self.held: list[bytes] = []  # since the last cut
        self.sound, self.cuts = True, 0

    def read(self, piece: bytes, last: bool) -> tuple[int, bytes | None] | None:
        """Takes a piece and the brace after it. At a record's end, the part that it ends; nothing
        is cut after the last piece, which may end with the file instead of a brace."""
        text = _ESCAPE.sub(b"", piece) if b"\\" in piece else piece
        parts = text.split(b'"')
        n = len(parts) - 1
        between = b"".join(parts[::2]), b"".join(parts[1::2])
        change = [_depth(b) for b in between]
        change[n % 2] -= 1  # the brace
        outside = between[self.quoted]
        if b"]" in outside:
            self._check(outside)
        self.depth += change[self.quoted]
        self.quoted ^= n % 2
        for start in (0, 1):
            self.change[start] += change[start ^ self.parity]
        self.parity ^= n % 2
        self.quotes += n
        self.bytes += len(piece) + 1
        self.held.append(piece)
        if last or self.quoted or self.depth != self.level:
            return None
        return self._part(FULL if self.cuts else HEAD, b"}")

    def _check(self, outside: bytes) -> None:
        """Nothing but blanks may follow the end of the outermost array."""
        depth = self.depth
        for m in _BRACKET.finditer(outside):
            depth += -1 if m[0] == b"]" else 1
            if depth < self.level and outside[m.end() :].strip():
                self.sound = False

    def _part(self, part: int, end: bytes) -> tuple[int, bytes | None]:
        out = part, b"}".join(self.held) + end if self.sound else None
        self.held, self.sound, self.cuts = [], True, 1
        return out

    def rest(self) -> tuple[int, bytes | None]:
        return self._part(TAIL if self.cuts else WHOLE, b"")


ARRAY, OBJECT, LINES, OTHER = "[", "{", "l", "-"  # kinds of files
_BLANK_BYTES = b" \t\r\n\xef\xbb\xbf"  # and a byte order mark


def _kind(first: bytes) -> str:
    """What a file may be, by the text up to its first cut. If its first record stands on one line it
    can only be line-delimited."""
    text = first.strip(_BLANK_BYTES)
    if text[:1] == b"{":
        return OBJECT if re.search(rb"[\r\n]", text) else LINES
    return ARRAY if text[:1] == b"[" else OTHER


def _cutter(states: dict):
    """The task side: pieces ``path, at, size, value`` in file order -> rows of ``_SCHEMA``. ``states`` has
    ``(level, quoted, depth)`` of the ranges whose start is known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, range_, held, kind, rows, waiting = None, None, None, None, [], 0

        def add(part: int, text: bytes | None) -> None:
            nonlocal waiting, kind
            if kind is None and not key[1]:
                kind = _kind(text or b"")
            rows.append((*key[:2], part, text, None, None, None, None, None, None))
            waiting += len(text or b"")

        def close() -> None:
            if key is None:
                return
            range_.read(held, last=True)
            cuts = range_.cuts
            add(*range_.rest())
            rows.append((*key[:2], NOTE, kind and kind.encode(), range_.bytes, range_.quotes, *range_.change, cuts, key[2]))

        def batch() -> pa.RecordBatch:
            nonlocal rows, waiting
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * len(types), types)], _NAMES)
            rows, waiting = [], 0
            return out

        types = [pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
        for b in batches:
            for path, at, size, piece in zip(*(c.to_pylist() for c in b.columns)):
                if (path, at, size) != key:
                    close()
                    key, held, kind = (path, at, size), None, None
                    begins_array = not at and piece.lstrip(_BLANK_BYTES)[:1] == b"["
                    range_ = Range(*states.get((path, at), (int(begins_array), 0, 0)))
                if held is not None:
                    found = range_.read(held, last=False)
                    if found:
                        add(*found)
                held = piece
                if waiting > 1 << 22:
                    yield batch()
        close()
        yield batch()

    return run


def _cut(spark: SparkSession, paths: list[str], states: dict, tasks: int) -> DataFrame:
    pieces = spark.read.text(paths, lineSep="}").select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"),
        F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("value"))
    # a task takes several ranges, one after the other, where there are more of them than ``tasks``
    return pieces.coalesce(tasks).mapInArrow(_cutter(states), _SCHEMA)


def _states(notes: DataFrame) -> DataFrame:
    """The true state at the start of every range: ``path, at, quoted, depth``."""
    before = Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    s = notes.withColumn("quoted", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2)
    s = s.withColumn("change", F.when(F.col("quoted") == 0, F.col("outside")).otherwise(F.col("inside")))
    return s.select("path", "at", "quoted", F.coalesce(F.sum("change").over(before), F.lit(0)).alias("depth"))


TASK_BYTES = 16 << 20  # of text that a task goes through at least, however small its ranges are


def cut_files(spark: SparkSession, paths: list[str], stage: str, size: int) -> DataFrame:
    """The chunks of the files, ``size`` bytes together: ``path, kind, first, last, text``. ``stage`` is a folder for the cut pieces; each is
    written once, and once more for an array or object whose ranges do not start between records. (A
    line-delimited file with such ranges is better read by lines; its kind is then ``OTHER``.)"""
    tasks = max(2 * spark.sparkContext.defaultParallelism, -(-size // TASK_BYTES))
    _cut(spark, paths, {}, tasks).write.partitionBy("part").parquet(f"{stage}/guessed")
    cut = spark.read.schema(_SCHEMA).parquet(f"{stage}/guessed")
    notes = cut.where(F.col("part") == NOTE)
    kinds = notes.where("at = 0").select("path", F.col("text").cast("string").alias("kind"))
    level = (F.col("kind") == ARRAY).cast("int")
    true = _states(notes).join(kinds, "path").withColumn("level", level)
    off = true.where((F.col("at") > 0) & ((F.col("quoted") != 0) | (F.col("depth") != F.col("level")))).select("path").distinct()
    wrong = true.join(off, "path", "left_semi")
    # one row per range of the files to be cut again
    again = {(r["path"], r["at"]): (r["level"], r["quoted"], r["depth"]) for r in wrong.where(F.col("kind").isin(ARRAY, OBJECT)).collect()}
    if again:
        names = sorted({p for p, _ in again})
        _cut(spark, [plain_path(spark, p) for p in names], again, tasks).write.partitionBy("part").parquet(f"{stage}/known")
        known = spark.read.schema(_SCHEMA).parquet(f"{stage}/known")
        cut = cut.join(spark.createDataFrame([(p,) for p in names], "path string"), "path", "left_anti").unionByName(known)
    by_line = wrong.where(F.col("kind") == LINES).select("path", F.lit(OTHER).alias("other")).distinct()
    kinds = kinds.join(by_line, "path", "left").select("path", F.coalesce("other", "kind").alias("kind"))
    return _joined(cut).join(kinds, "path")


def _joined(cut: DataFrame) -> DataFrame:
    notes = cut.where(F.col("part") == NOTE)
    before = Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    ranges = notes.select("path", "at", F.coalesce(F.sum("cuts").over(before), F.lit(0)).alias("before"))
    missing = F.col("size") - F.col("bytes")  # 3: a byte order mark; one less: the file ends without a brace
    files = notes.groupBy("path").agg(F.sum("cuts").alias("cuts"), F.sum("bytes").alias("bytes"), F.max("size").alias("size"))
    files = files.select("path", "cuts", missing.isin(0, 3).alias("closed"))
    parts = cut.where(F.col("part").isin(HEAD, TAIL, WHOLE)).select("path", "at", "part", F.col("text").cast("string").alias("text"))
    parts = parts.join(ranges, ["path", "at"]).withColumn("nth", F.col("before") + (F.col("part") == TAIL).cast("int"))
    lengths = parts.groupBy("path", "nth").agg(F.sum(F.octet_length("text")).alias("length"), F.max(F.col("text").isNull()).alias("bad"))
    fits = lengths.where(~F.col("bad") & (F.col("length") <= ROW_BYTES)).select("path", "nth")
    whole = parts.join(fits, ["path", "nth"]).groupBy("path", "nth").agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("t"))
    spanning = lengths.select("path", "nth").join(whole, ["path", "nth"], "left").join(files, "path")
    last = F.col("nth") == F.col("cuts")
    text = F.concat(F.array_join(F.col("t.text"), "}"), F.when(last & F.col("closed"), "}").otherwise(""))
    spanning = spanning.select("path", (F.col("nth") == 0).alias("first"), last.alias("last"), F.when(F.col("t").isNotNull(), text).alias("text"))
    full = cut.where(F.col("part") == FULL).select("path", F.lit(False).alias("first"), F.lit(False).alias("last"), F.col("text").cast("string").alias("text"))
    return full.unionByName(spanning)


_BLANKS = "' \\t\\r\\n\\ufeff'"
_T = f"trim(BOTH {_BLANKS} FROM text)"


def elements(chunks: DataFrame) -> DataFrame:
    """``path, sound, elements array<variant>``: the values of each chunk, and whether it is as a chunk of
    its file's kind must be."""
    t = chunks.select("path", "kind", "first", "last", "text", F.expr(_T).alias("t"))
    # of an array: brackets at its ends, a comma before every other chunk
    t = t.withColumn("body", F.expr(f"""CASE WHEN kind <> '{ARRAY}' THEN NULL WHEN first AND left(t, 1) = '[' THEN substr(t, 2)
        WHEN NOT first AND left(t, 1) = ',' THEN substr(t, 2) WHEN NOT first AND last AND t = ']' THEN t END"""))
    t = t.withColumn("body", F.expr(f"""CASE WHEN NOT last THEN body
        WHEN right(body, 1) = ']' THEN trim(BOTH {_BLANKS} FROM left(body, length(body) - 1)) END"""))
    t = t.withColumn("a", F.expr("CASE WHEN body <> '' THEN from_json(concat('[[', body, ']]'), 'array<array<variant>>') END"))
    # of a single object: the object, then blanks; of lines: objects, each on a line of its own
    t = t.withColumn("lines", F.expr(rf"""CASE WHEN kind = '{OBJECT}' AND first THEN array(t)
        WHEN kind = '{LINES}' AND (first OR left(text, instr(text, '{{')) RLIKE '[\\r\\n]') THEN split(t, '[\\r\\n]+') END"""))
    t = t.withColumn("o", F.expr("""CASE WHEN forall(lines, l -> left(ltrim(l), 1) = '{') THEN
        transform(lines, l -> from_json(concat('[', l, ']'), 'array<variant>')) END"""))
    t = t.withColumn("o", F.expr("CASE WHEN forall(o, x -> size(x) = 1) THEN flatten(o) END"))
    nothing = f"kind = '{ARRAY}' AND body = '' AND last AND (first OR t = ']') OR kind IN ('{OBJECT}', '{LINES}') AND NOT first AND last AND t = ''"
    return t.select(
        "path", F.expr(f"coalesce(size(a) = 1, false) OR o IS NOT NULL OR coalesce({nothing}, false)").alias("sound"),
        F.expr("CASE WHEN size(a) = 1 THEN a[0] ELSE o END").alias("elements"))


def plain_path(spark: SparkSession, uri: str) -> str:
    """A path as the reader wants it, from the escaped form in a row's metadata."""
    path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(uri)).toString()
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", path)
