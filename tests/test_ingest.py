"""Tolerant JSON decoding of export folders (shapes from FIXTURES §5)."""

import json
import os

from pyspark.sql import functions as F

from encore.sources import exports as E
from encore.sources.exports import file_report, json_files, read_exports


def _write(d, name, text):
    p = os.path.join(d, name)
    os.makedirs(os.path.dirname(p), exist_ok=True)
    with open(p, "w") as f:
        f.write(text)


def _rows(spark, d):
    return read_exports(spark, str(d)).orderBy("source_file", "ts").collect()


def test_array_file(spark, tmp_path):
    _write(tmp_path, "a.json", '[{"ts":"2024-01-01T00:00:00Z","ms_played":1},{"ts":"2024-01-01T00:30:00Z","ms_played":"x"}]')
    r = _rows(spark, tmp_path)
    assert len(r) == 2
    assert r[0]["ms_played"] == 1.0 and r[1]["ms_played"] is None
    assert r[0]["source_file"] == "a.json"


def test_line_delimited_with_bad_line(spark, tmp_path):
    _write(tmp_path, "b.json", '{"ts":"2024-01-02T00:00:00Z"}\nnot json\n{"ts":"2024-01-03T00:00:00Z"}\n')
    assert len(_rows(spark, tmp_path)) == 2


def test_pretty_printed_single_object(spark, tmp_path):
    _write(tmp_path, "c.json", '{\n"ts": "2024-01-01T00:00:00Z",\n"ms_played": 3\n}')
    r = _rows(spark, tmp_path)
    assert len(r) == 1 and r[0]["ms_played"] == 3.0


def test_mixed_array_keeps_objects(spark, tmp_path):
    _write(tmp_path, "d.json", '[{"ts":"2024-01-01T00:00:00Z"},7]')
    assert len(_rows(spark, tmp_path)) == 1


def test_truncated_array(spark, tmp_path):
    _write(tmp_path, "e.json", '[\n{"ts":"2024-01-01T00:00:00Z"}\n{"ts":"2024-01-02T00:00:00Z"}\n')
    assert len(_rows(spark, tmp_path)) == 2


def test_blank_file_and_other_extensions(spark, tmp_path):
    _write(tmp_path, "f.json", "   \n ")
    _write(tmp_path, "g.txt", '[{"ts":"2024-01-01T00:00:00Z"}]')
    assert _rows(spark, tmp_path) == []


def test_repeated_key_keeps_last(spark, tmp_path):
    _write(tmp_path, "h.json", '[{"ts":"a","ts":"2024-01-01T00:00:00Z"},{"ts":"2024-01-02T00:00:00Z"}]')
    r = _rows(spark, tmp_path)
    assert [x["ts"] for x in r] == ["2024-01-01T00:00:00Z", "2024-01-02T00:00:00Z"]


def test_nan_becomes_zero_after_cleaning(spark, tmp_path):
    from encore.operators.prepare import prepare_plays

    _write(tmp_path, "i.json", '{"ts":"2024-01-01T00:00:00Z","ms_played":NaN}')
    p = prepare_plays(read_exports(spark, str(tmp_path)), with_sessions=False).collect()
    assert len(p) == 1 and p[0]["ms_played"] == 0.0


def test_recursive_discovery_extras_and_missing_dir(spark, tmp_path):
    _write(tmp_path, "sub/deeper/j.json", '[{"ts":"2024-01-01T00:00:00Z","zz":5,"shuffle":true}]')
    r = _rows(spark, tmp_path)
    assert r[0]["source_file"] == "j.json"
    assert r[0]["extra_json"] == '{"zz":5}'
    assert r[0]["shuffle"] is True
    assert read_exports(spark, str(tmp_path / "nope")).count() == 0
    assert json_files(spark, str(tmp_path)).count() == 1


def test_each_file_is_read_its_own_way_and_reported(spark, tmp_path):
    day = '{"ts":"2024-01-0%dT00:00:00Z"}'
    _write(tmp_path, "lines.json", f"\n  {day % 2}\nbad\n[{day % 3}]\n{day % 4}\n")
    _write(tmp_path, "array.json", f"[{day % 1},{day % 2}]")
    _write(tmp_path, "late.json", f"oops\n{day % 5}\n")
    _write(tmp_path, "a b[1]{x}.json", f"{day % 6}")
    _write(tmp_path, "sub dir/pretty.json", "{\n" + day[1:] % 7)
    _write(tmp_path, "blank.json", " \n ")
    got = [(r["source_file"], r["ts"][8:10]) for r in _rows(spark, tmp_path)]
    assert got == [("a b[1]{x}.json", "06"), ("array.json", "01"), ("array.json", "02"), ("late.json", "05"),
                   ("lines.json", "02"), ("lines.json", "04"), ("pretty.json", "07")]
    report = {r["source_file"]: tuple(r)[1:] for r in file_report(spark, str(tmp_path)).collect()}
    assert report == {"lines.json": ("lines", 2, 1), "array.json": ("file", 2, 0), "late.json": ("file", 1, 1),
                      "a b[1]{x}.json": ("lines", 1, 0), "pretty.json": ("file", 1, 0), "blank.json": ("file", 0, 0)}


def test_large_line_files_are_split(spark, tmp_path):
    _write(tmp_path, "big.json", "".join('{"ts":"2024-01-01T00:00:00Z","ms_played":%d}\n' % i for i in range(20000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        df = read_exports(spark, str(tmp_path))
        assert df.rdd.getNumPartitions() > 4 and df.count() == 20000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_end_to_end_prepare_from_files(spark, tmp_path):
    from encore.operators.prepare import prepare_plays

    _write(tmp_path, "a.json", '[{"ts":"2024-01-01T00:00:00Z","ms_played":1},{"ts":"2024-01-01T00:30:00Z","ms_played":"x"}]')
    p = prepare_plays(read_exports(spark, str(tmp_path))).orderBy("ts").collect()
    assert [r["ms_played"] for r in p] == [1.0, 0.0]
    assert [r["session_id"] for r in p] == [1, 1]
    assert p[0]["master_metadata_track_name"] == "Unknown Track"
    assert p[0]["is_song"] is True
    assert F is not None


def test_json_exports_equal_star_path(spark, tmp_path):
    """Spark-written JSON exports of the star mapping ingest to the same plays."""
    from encore.operators import trends as TR
    from encore.operators.prepare import prepare_plays
    from encore.schema import EXPORT_KEYS
    from encore.sources import curated
    from encore.sources.star import star_plays

    from conftest import SF_SMALL

    out = str(tmp_path / "exports")
    raw = star_plays(spark, SF_SMALL).drop("source_file", "extra_json").withColumnsRenamed(EXPORT_KEYS)
    raw.repartition(4).write.json(out)
    from_json = prepare_plays(read_exports(spark, out))
    from_star = curated.plays(spark, SF_SMALL)
    assert from_json.count() == from_star.count()
    a = sorted(tuple(r) for r in TR.daily_trend(from_json).collect())
    b = sorted(tuple(r) for r in TR.daily_trend(from_star).collect())
    assert a == b
    sa = from_json.groupBy("session_id").count().count()
    sb = from_star.groupBy("session_id").count().count()
    assert sa == sb
    assert from_json.where(F.col("source_file").startswith("part-")).count() == from_json.count()


def test_crlf_and_lone_cr_lines(spark, tmp_path):
    _write(tmp_path, "crlf.json", '{"ts":"2024-01-02T00:00:00Z"}\r\n{"ts":"2024-01-03T00:00:00Z"}\r\nbad\r\n')
    _write(tmp_path, "cr.json", '{"ts":"2024-01-04T00:00:00Z"}\r{"ts":"2024-01-05T00:00:00Z"}\r')
    r = _rows(spark, tmp_path)
    assert sorted(x["ts"][:10] for x in r) == ["2024-01-02", "2024-01-03", "2024-01-04", "2024-01-05"]


def test_line_files_are_decoded_once_without_a_cut(spark, tmp_path, monkeypatch):
    """A large file that begins with a whole object on a line is read by lines at once; a line is parsed once, and
    its columns are extracted together, also below a filter on one of them."""
    from encore.operators.prepare import valid_plays

    d = tmp_path / "in"
    d.mkdir()
    rows = [json.dumps({"ts": f"2024-01-{i % 28 + 1:02d}T00:00:00Z", "ms_played": i, "zz": i % 2}) for i in range(300)]
    (d / "a b%.json").write_text("\ufeff" + "\n".join(rows) + "\noops\n[1]\n")
    (d / "array.json").write_text("[" + ",\n".join(rows) + "]")
    (d / "object.json").write_text('{\n "ts": "2024-02-01T00:00:00Z", "x": "' + "y" * 9000 + '"}')
    (d / "late.json").write_text("oops\n" + "\n".join(rows))
    cut, cut_files = [], E.split_json.cut_files
    monkeypatch.setattr(E, "_whole_bytes", lambda spark: 4096)
    monkeypatch.setattr(E.split_json, "cut_files", lambda spark, paths, *a: cut.extend(paths) or cut_files(spark, paths, *a))
    got = {r[0]: r[1:] for r in E.read_exports(spark, str(d)).groupBy("source_file").agg(
        F.count("ts"), F.sum("ms_played"), F.count("extra_json")).collect()}
    assert got == {"a b%.json": (300, 44850.0, 300), "array.json": (300, 44850.0, 300), "late.json": (300, 44850.0, 300),
                   "object.json": (1, None, 1)}
    assert sorted(p.rsplit("/", 1)[1] for p in cut) == ["array.json", "late.json", "object.json"]
    lines = valid_plays(E.typed(E.decode_lines(spark.createDataFrame([("a", rows[0])], "source_file string, value string"))))
    plan = lines._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1 and plan.count("StructField(ts,StringType,true)") == 1, plan


def test_columns_are_typed_as_one_by_one(spark):
    from encore.schema import RAW_COLUMNS, export_key, raw_type

    values = ['"x"', '""', '"12"', '"true"', "1", "-0.0", "1.50", "1e3", "99999999999999999999", "true", "null", "{}", '{"a":1}', "[1]"]
    lines = ["{" + f'"{export_key(c)}":{v}, "zz":{v}' + "}" for c in RAW_COLUMNS for v in values] + ["{}", "1", "[]", '{"ts":1,"ts":"b"}']
    rec = E.decode_lines(spark.createDataFrame([("a", x) for x in lines], "source_file string, value string"))
    kinds = {c: "string" if c == "ts" else raw_type(c).simpleString() for c in RAW_COLUMNS}
    single = rec.select(*[F.expr(f"try_variant_get(e, '$.{export_key(c)}', '{t}')").alias(c) for c, t in kinds.items()])
    got = E.typed(rec)
    assert sorted(map(repr, got.select(*RAW_COLUMNS).collect())) == sorted(map(repr, single.collect()))
    assert got.where("extra_json IS NOT NULL").count() == len(RAW_COLUMNS) * len(values)


def test_compressed_files_give_the_rows_of_plain_ones(spark, tmp_path, monkeypatch):
    """Of any shape, below and beyond the size of one row; other patterns leave them alone."""
    import gzip

    rows = [json.dumps({"ts": f"2024-01-{i % 28 + 1:02d}T00:00:00Z", "ms_played": i, "zz": i * 7919 % 211}) for i in range(300)]
    texts = {
        "lines 1": "﻿" + "\n".join(rows) + "\noops\n[1]\n", "cr": "\r\n".join(rows), "array": "[" + ",\n".join(rows) + ", 7]",
        "late": "oops\n" + "\n".join(rows), "object": '{\n "ts": "2024-02-01T00:00:00Z",\n "x": {"y": [1]}}', "one": rows[0], "blank": "\n",
    }
    for folder in ("plain", "packed"):
        (tmp_path / folder).mkdir()
    for name, text in texts.items():
        (tmp_path / "plain" / f"{name}.json").write_text(text, newline="")
        (tmp_path / "packed" / f"{name}.json.gz").write_bytes(gzip.compress(text.encode()))

    def got(folder, pattern):
        d = str(tmp_path / folder)
        r = read_exports(spark, d, pattern).withColumn("source_file", F.regexp_replace("source_file", r"\.gz$", ""))
        f = file_report(spark, d, pattern).where("read_as <> 'parts'").select("source_file", "records", "skipped_lines")
        return sorted(map(repr, r.collect())), sorted((x[0].removesuffix(".gz"), *x[1:]) for x in f.collect())

    want = got("plain", "*.json")
    assert len(want[0]) == 4 * 300 + 2
    for limit in (E.WHOLE_BYTES, 4096):
        monkeypatch.setattr(E, "_whole_bytes", lambda spark, limit=limit: limit)
        assert got("packed", "*.json.gz") == want
    seen, lines = [], E._by_lines
    monkeypatch.setattr(E, "_by_lines", lambda spark, paths: seen.extend(paths) or lines(spark, paths))
    assert read_exports(spark, str(tmp_path / "packed"), "*.json.gz").count() == len(want[0])
    assert sorted(p.rsplit("/", 1)[1] for p in seen) == ["cr.json.gz", "lines 1.json.gz"]
    assert read_exports(spark, str(tmp_path / "packed")).count() == 0


def test_exports_of_the_tables_take_less_disk_than_their_text(spark):
    """Before, they stood there as plain text, a multiple of the tables they are made of."""
    from encore.plans.registry import q_more
    from encore.sources import fs

    from conftest import SF_SMALL

    d = q_more._exports_dir(spark, SF_SMALL)
    text = spark.read.text(d).agg(F.sum(F.octet_length("value"))).first()[0]
    assert sum(size for _, size, _ in fs.listing(spark, d)) < text / 5
