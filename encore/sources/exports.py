"""Tolerant JSON ingest of play-history exports.

Files are found recursively (``*.json`` only). Each is decoded leniently, like a JSON parser with a
line-by-line fallback:

* a JSON array -> its elements; a single object -> one record;
* otherwise every line is decoded on its own and bad lines are skipped;
* elements that are not objects are dropped; a blank file gives nothing.

A file of one reader split (at most ``WHOLE_BYTES``) is one row and decoded whole. A larger one that begins with a whole
object on a line can only be line-delimited and is read by lines, by many tasks at once. Another larger one, of any
length, is cut into chunks at its records' ends by many tasks (``split_json``): an array, an object, or lines without bad
ones. Either way its text is read once (of line-delimited files, the first ``HEAD_BYTES`` twice). What is
not sound as a whole is read once more, by lines. A compressed file (``*.json.gz``, where the pattern asks for such) can
only be read from its start: beyond ``WHOLE_BYTES / TEXT_RATIO`` it is streamed by lines if it begins with a whole object
on a line, and is one row otherwise.
``file_report`` tells per file how it was read, its records and its skipped lines.

Decoding uses VARIANT: wrapping the text in brackets makes the decode strict (the outer array
must close), arrays are decoded element by element (one VARIANT has a size limit), and
``try_variant_get`` extracts the expected columns with their types, in one pass over a record's keys. Keys outside the
expected columns survive as canonical JSON in ``extra_json`` (``to_json`` of a variant map sorts keys,
so it can take part in de-duplication).
"""

from __future__ import annotations

import json
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from encore.schema import RAW_COLUMNS, RAW_SCHEMA, export_key, raw_type
from encore.session import configure
from encore.sources import fs, split_json
from encore.sources.fs import exists

# Each candidate decoding is parsed once, in its own projection; a line or file that is not
# exactly one JSON value (wrapped in brackets it must give an array of size 1) contributes
# nothing.
_WHOLE_ARRAY = "CASE WHEN left(t, 1) = '[' THEN from_json(concat('[', t, ']'), 'array<array<variant>>') END"
_WHOLE_OBJECT = "CASE WHEN left(t, 1) = '{' THEN from_json(concat('[', t, ']'), 'array<variant>') END"
# Files without a carriage return split on LF alone (JSON treats a trailing CR as whitespace);
# others split on CRLF, LF or a lone CR, like ``str.splitlines``.
_LINES = "CASE WHEN instr(t, '\\r') = 0 THEN split(t, '\\n') ELSE split(t, '\\r\\n|\\n|\\r') END"
_PER_LINE = f"""flatten(transform(
    transform({_LINES}, l -> from_json(concat('[', l, ']'), 'array<variant>')),
    a -> CASE WHEN size(a) = 1 THEN a ELSE CAST(array() AS array<variant>) END))"""
# An element is a record when it is a JSON object (it casts to a map).
_IS_OBJECT = "try_variant_get(e, '$', 'map<string,variant>') IS NOT NULL"


def empty_raw(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], RAW_SCHEMA)


_ONE = "from_json(concat('[', t, ']'), 'array<variant>')"
_TRIMMED = "trim(BOTH ' \t\r\n\ufeff' FROM value)"  # blanks and a byte order mark


def decode(text: DataFrame) -> DataFrame:
    """``source_file, value`` (a file's text) -> ``source_file, e``: one VARIANT object per record.
    Shared by the batch reader and the streaming ingest."""
    t = text.select("source_file", F.expr(_TRIMMED).alias("t"))
    parsed = t.select("source_file", "t", F.expr(_WHOLE_ARRAY).alias("_arr"), F.expr(_WHOLE_OBJECT).alias("_obj"))
    recs = parsed.select(
        "source_file",
        F.when(F.size("_arr") == 1, F.col("_arr")[0])
        .when(F.size("_obj") == 1, F.col("_obj"))
        .otherwise(F.expr(_PER_LINE))  # only files that are not one JSON value go line by line
        .alias("_recs"),
    )
    return recs.select("source_file", F.explode("_recs").alias("e")).where(F.expr(_IS_OBJECT))


def decode_lines(text: DataFrame) -> DataFrame:
    """``source_file, value`` (one line) -> ``source_file, e`` as ``decode``."""
    t = F.when(F.col("value").startswith("{") & F.col("value").endswith("}"), F.col("value")).otherwise(F.expr(_TRIMMED))
    one = text.select("source_file", t.alias("t")).select("source_file", F.expr(_ONE).alias("a"))
    # exploded, since a filter would parse every line a second time
    e = F.explode(F.expr("slice(a, 1, CASE WHEN size(a) = 1 THEN 1 ELSE 0 END)"))
    return one.select("source_file", e.alias("e")).where(F.expr(_IS_OBJECT))


PATTERN = "*.json"


def base_name(path: str | Column) -> Column:
    """Base name of a file from its path in a row's metadata, where odd characters are escaped."""
    last = F.substring_index(path, "/", -1)
    return F.when(F.instr(path, "%") == 0, last).otherwise(F.url_decode(F.replace(last, F.lit("+"), F.lit("%2B"))))


def _find(pattern: str) -> dict:
    return {"recursiveFileLookup": True, "pathGlobFilter": pattern}


def typed(rec: DataFrame, *more: str) -> DataFrame:
    """VARIANT records -> raw plays: expected columns typed (absent -> NULL; ``ts`` kept as
    text for ``prepare`` to parse), unexpected keys as canonical JSON in ``extra_json``."""
    fields = [f"`{export_key(c)}`: {'string' if c == 'ts' else raw_type(c).simpleString()}" for c in RAW_COLUMNS]
    # exploded, since a filter on a column would extract them all a second time
    rec = rec.select("*", F.explode(F.expr(f"array(try_variant_get(e, '$', 'struct<{', '.join(fields)}>'))")).alias("_r"))
    cols = [F.col("_r").getField(export_key(c)).alias(c) for c in RAW_COLUMNS]
    expected = ", ".join(f"'{export_key(c)}'" for c in RAW_COLUMNS)
    keys = "try_variant_get(e, '$', 'map<string,variant>')"
    extra = F.expr(f"""CASE WHEN exists(map_keys({keys}), k -> k NOT IN ({expected})) THEN
        to_json(map_filter({keys}, (k, v) -> k NOT IN ({expected}))) END""")
    return rec.select(*cols, F.col("source_file"), extra.alias("extra_json"), *more)


WHOLE_BYTES = 16 << 20  # of a file that is decoded in one row

def _whole_bytes(spark: SparkSession) -> int:
    """A file beyond this is not one row: a reader split, at most ``WHOLE_BYTES``."""
    split = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    return min(WHOLE_BYTES, split)


def _named(text: DataFrame) -> DataFrame:
    return text.select(base_name("_metadata.file_path").alias("source_file"), "value")


COMPRESSED = (".gz", ".bz2", ".deflate", ".zst")
TEXT_RATIO = 16  # bytes of JSON text in a byte of a compressed file, about


def _is_large(spark: SparkSession) -> Column:
    """Whether a file is beyond what is decoded in one row. The sizes prune the file listing."""
    whole, name = _whole_bytes(spark), F.col("_metadata.file_name")
    packed = reduce(lambda a, b: a | b, [name.endswith(x) for x in COMPRESSED])
    return F.col("_metadata.file_size") > F.when(packed, whole // TEXT_RATIO).otherwise(whole)


def _small(spark: SparkSession, data_dir: str, pattern: str) -> DataFrame:
    """``source_file, value``: the small files, one row each."""
    text = spark.read.text(data_dir, wholetext=True, **_find(pattern))
    return _named(text.where(~_is_large(spark)))


def _by_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    return _named(spark.read.text(paths))


def _files(spark: SparkSession, data_dir: str, pattern: str, large: list[str]) -> DataFrame:
    """``source_file, value``: the files that are one row each."""
    files = _small(spark, data_dir, pattern)
    return files.unionByName(_named(spark.read.text(large, wholetext=True))) if large else files


HEAD_BYTES = 1 << 16  # of a large file, to see whether its first record stands on one line


def _by_line(spark: SparkSession, path: str) -> bool:
    """Whether a file begins with a whole object on a line of its own, so that it can only be line-delimited."""
    head = re.split(rb"[\r\n]", fs.head(spark, path, HEAD_BYTES).lstrip(b" \t\r\n\xef\xbb\xbf"), maxsplit=1)
    try:
        return len(head) == 2 and isinstance(json.loads(head[0]), dict)
    except (ValueError, RecursionError):
        return False


def _large(spark: SparkSession, data_dir: str, pattern: str, by_line: bool = False) -> tuple[list[str], list[str], DataFrame | None]:
    """``(by_lines, whole, plays)``: paths of the large files that are read by lines, those of compressed ones that are one
    row each, and the typed rows of those that are one JSON value, also of elements that are no records (``is_record``);
    None if there are none. The paths come from the listing. With ``by_line``, files that can only be line-delimited are not
    cut first; compressed ones cannot be cut."""
    listed = spark.read.format("binaryFile").options(**_find(pattern)).load(data_dir)
    found = listed.where(_is_large(spark)).select(F.col("_metadata.file_path").alias("path"), "length").collect()
    packed = {r["path"] for r in found if r["path"].endswith(COMPRESSED)}
    lined = {r["path"] for r in found if (by_line or r["path"] in packed) and _by_line(spark, r["path"])}
    plain = [split_json.plain_path(spark, p) for p in sorted(lined)]
    whole = [split_json.plain_path(spark, p) for p in sorted(packed - lined)]
    found = [r for r in found if r["path"] not in lined | packed]
    paths = [r["path"] for r in found]
    if not paths:
        return plain, whole, None
    stage = fs.temporary(spark, "ingest")
    chunks = split_json.cut_files(spark, [split_json.plain_path(spark, p) for p in paths], stage, sum(r["length"] for r in found))
    rec = split_json.elements(chunks).select("path", "sound", F.explode_outer("elements").alias("e"))
    rec = rec.withColumn("source_file", base_name("path")).withColumn("is_record", F.expr(f"coalesce({_IS_OBJECT}, false)"))
    typed(rec, "path", "sound", "is_record").write.parquet(f"{stage}/plays")
    plays = spark.read.parquet(f"{stage}/plays")
    lines = sorted(r["path"] for r in plays.where("NOT sound").select("path").distinct().collect())
    if lines:
        plays = plays.join(spark.createDataFrame([(p,) for p in lines], "path string"), "path", "left_anti")
    return plain + [split_json.plain_path(spark, p) for p in lines], whole, plays


def file_report(spark: SparkSession, data_dir: str, pattern: str = PATTERN) -> DataFrame:
    """Per file name: ``read_as`` ('lines', 'file', or 'parts' for one JSON value that was cut into
    chunks), ``records`` and ``skipped_lines`` (not blank, not decodable; 0 for a file that is one JSON value)."""
    configure(spark)
    paths, whole, plays = _large(spark, data_dir, pattern)
    files = _files(spark, data_dir, pattern, whole)
    n = decode(files).groupBy("source_file").agg(F.count(F.lit(1)).alias("records"))
    t = files.select("source_file", F.expr(_TRIMMED).alias("t")).select(
        "source_file", "t", F.expr(_WHOLE_ARRAY).alias("x"), F.expr(_WHOLE_OBJECT).alias("y"))
    bad = F.expr(f"size(filter(transform({_LINES}, l -> {_TRIMMED.replace('value', 'l')}), "
                 f"t -> t <> '' AND coalesce(size({_ONE}), 0) <> 1))")
    one = (F.coalesce(F.size("x") == 1, F.lit(False))) | (F.coalesce(F.size("y") == 1, F.lit(False)))
    first = f"element_at(filter(transform({_LINES}, l -> {_TRIMMED.replace('value', 'l')}), l -> l <> ''), 1)"
    by_line = F.expr(f"coalesce(left(t, 1) = '{{' AND size({_ONE.replace('t,', first + ',')}) = 1, false)")
    s = t.groupBy("source_file").agg(
        F.max(F.when(by_line, "lines").otherwise("file")).alias("read_as"), F.sum(F.when(one, 0).otherwise(bad)).alias("skipped_lines"))
    out = s.join(n, "source_file", "left").select("source_file", "read_as", F.coalesce("records", F.lit(0)).alias("records"), "skipped_lines")
    if paths:
        t = _by_lines(spark, paths).select("source_file", F.expr(_TRIMMED).alias("t")).where("t <> ''").withColumn("a", F.expr(_ONE))
        e = t.withColumn("e", F.when(F.size("a") == 1, F.col("a")[0]))
        out = out.unionByName(e.groupBy("source_file").agg(
            F.lit("lines").alias("read_as"), F.count_if(F.expr(_IS_OBJECT)).alias("records"),
            F.count_if(F.coalesce(F.size("a") != 1, F.lit(True))).alias("skipped_lines")))
    if plays is not None:
        out = out.unionByName(plays.groupBy("source_file").agg(
            F.lit("parts").alias("read_as"), F.count_if("is_record").alias("records"), F.lit(0).alias("skipped_lines")))
    return out


def read_exports(spark: SparkSession, data_dir: str, pattern: str = PATTERN) -> DataFrame:
    """Raw plays (``RAW_SCHEMA``): expected columns typed (absent -> NULL), ``source_file`` is
    the base file name, unexpected keys in ``extra_json`` (NULL when there are none)."""
    if not exists(spark, data_dir):
        return empty_raw(spark)
    configure(spark)
    paths, whole, plays = _large(spark, data_dir, pattern, by_line=True)
    out = typed(decode(_files(spark, data_dir, pattern, whole)))
    if paths:
        out = out.unionByName(typed(decode_lines(_by_lines(spark, paths))))
    return out if plays is None else out.unionByName(plays.where("is_record").select(out.columns))


def json_files(spark: SparkSession, data_dir: str) -> DataFrame:
    """Sorted list of ``*.json`` files (path, name); missing directory -> empty.

    Uses the binary-file source with the content column pruned, so only listings are read.
    """
    if not exists(spark, data_dir):
        return spark.createDataFrame([], "path string, file_name string")
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.json")
        .load(data_dir)
        .select("path")
    )
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("file_name")).orderBy("path")


_WIDER = ["tinyint", "smallint", "int", "bigint", "float", "double"]


def common_type(a: T.DataType, b: T.DataType) -> T.DataType:
    """The smallest type that holds the values of both: of two numbers the wider one (a decimal beside
    anything but a whole number is a double), timestamps over dates, arrays, maps and structs by their parts;
    text for all that have nothing in common."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if isinstance(a, T.NumericType) and isinstance(b, T.NumericType):
        names = [t.simpleString() for t in (a, b)]
        if all(n in _WIDER for n in names):
            i, j = sorted(map(_WIDER.index, names))
            # single precision holds no int and no bigint
            return T.DoubleType() if _WIDER[j] == "float" and i >= 2 else (a if names[0] == _WIDER[j] else b)
        digits = [(t.precision - t.scale, t.scale) if isinstance(t, T.DecimalType) else {"tinyint": (3, 0), "smallint": (5, 0), "int": (10, 0), "bigint": (20, 0)}.get(n) for t, n in zip((a, b), names)]
        if None in digits or max(d[0] for d in digits) + max(d[1] for d in digits) > 38:
            return T.DoubleType()
        whole, scale = max(d[0] for d in digits), max(d[1] for d in digits)
        return T.DecimalType(whole + scale, scale)
    times = (T.DateType, T.TimestampType, T.TimestampNTZType)
    if isinstance(a, times) and isinstance(b, times):
        return T.TimestampNTZType() if {type(a), type(b)} == {T.DateType, T.TimestampNTZType} else T.TimestampType()
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(common_type(a.elementType, b.elementType), True)
    if isinstance(a, T.MapType) and isinstance(b, T.MapType):
        return T.MapType(common_type(a.keyType, b.keyType), common_type(a.valueType, b.valueType), True)
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        return common_schema(a, b)
    return T.StringType()


def common_schema(a: T.StructType, b: T.StructType) -> T.StructType:
    """All fields of both by name, in order of appearance, each of their common type."""
    of_b = {f.name: f.dataType for f in b.fields}
    fields = [(f.name, common_type(f.dataType, of_b.pop(f.name, f.dataType))) for f in a.fields]
    return T.StructType([T.StructField(n, t, True) for n, t in [*fields, *of_b.items()]])


_NESTED = (T.StructType, T.ArrayType, T.MapType)


def as_type(c: Column, have: T.DataType, want: T.DataType) -> Column:
    """``c`` in a wider type; text of nested values is JSON."""
    if have == want:
        return c
    if isinstance(have, T.StructType) and isinstance(want, T.StructType):
        of = {f.name: f.dataType for f in have.fields}
        parts = [(as_type(c.getField(f.name), of[f.name], f.dataType) if f.name in of else F.lit(None).cast(f.dataType)).alias(f.name) for f in want.fields]
        return F.when(c.isNotNull(), F.struct(*parts))
    if isinstance(have, T.ArrayType) and isinstance(want, T.ArrayType):
        return F.transform(c, lambda x: as_type(x, have.elementType, want.elementType))
    if isinstance(have, T.MapType) and isinstance(want, T.MapType):
        keys = F.transform(F.map_keys(c), lambda x: as_type(x, have.keyType, want.keyType))
        return F.map_from_arrays(keys, F.transform(F.map_values(c), lambda x: as_type(x, have.valueType, want.valueType)))
    if isinstance(want, T.StringType) and isinstance(have, _NESTED):
        return F.to_json(c)
    return c.cast(want)


def union_frames(frames: list[DataFrame]) -> DataFrame:
    """Union by column name of unlike frames: missing columns are NULL, columns of unlike types get a
    type that holds the values of all frames (``common_type``), whatever the frames' order."""
    if not frames:
        raise ValueError("no frames")
    # text absorbs every other type, so it is known before two others meet
    schema = reduce(common_schema, [f.schema for f in frames])
    schema = reduce(common_schema, [f.schema for f in frames], schema)
    out = None
    for f in frames:
        of = {x.name: x.dataType for x in f.schema.fields}
        one = f.select(*[
            (as_type(F.col(f"`{x.name}`"), of[x.name], x.dataType) if x.name in of else F.lit(None).cast(x.dataType)).alias(x.name)
            for x in schema.fields
        ])
        out = one if out is None else out.unionByName(one)
    return out
