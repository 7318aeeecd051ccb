"""Large JSON files read in ranges give what the same files give as one row each."""

import json
import random

import pytest

from encore.sources import exports
from encore.sources.split_json import Range


def _rec(i, r, nested=False, plain=False):
    x = {"ts": f"2024-01-{i % 28 + 1:02d}T00:00:00Z", "ms_played": i, "platform": "phone" if plain else r.choice(["a", "b}{", 'c\\"]', "d[1]", "é}", "}, {"])}
    if nested:
        x["zz"] = {"a": [{"b": i}, {"c": "}"}], "q": "\\"}
    return json.dumps(x, ensure_ascii=False)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d, r = tmp_path_factory.mktemp("exports"), random.Random(1)

    def rows(n, nested=False, plain=False):
        return [_rec(i, r, nested, plain) for i in range(n)]

    files = {
        "flat": "[" + ",".join(rows(120)) + ", 7]",
        "nested": "[\n  " + ",\n  ".join(rows(60, True)) + "\n]\n",
        "truncated": "[\n" + "\n".join(rows(130)) + "\n",
        "cut short": "[" + ",".join(rows(60))[:-30],
        "trailing": "[" + ",".join(rows(130)) + "] x",
        "two": "[" + ",".join(rows(40)) + "]\n[" + ",".join(rows(40)) + "]",
        "open quote": '[{"ts":"2024-01-01T00:00:00Z","platform":"abc},' + ",".join(rows(130)) + "]",
        "double comma": "[" + ",,".join(rows(50)) + "]",
        "lines": "\n".join(rows(90, True)),
        "clean lines": "\n".join(rows(130, plain=True)) + "\n",
        "late": "{oops\n" + "\n".join(rows(60)),
        "object": json.dumps({"ts": "2024-01-01T00:00:00Z", "platform": "p" * 7000, "zz": [{"q": k} for k in range(50)]}, indent=1),
        "open object": '{\n"ts": "2024-01-01T00:00:00Z",\n"platform": "' + "q" * 7000 + '"\n',
        "numbers": "[1,2,[3,{}]," + "7," * 4000 + '"x"]',
        "marked": "\ufeff[" + ",".join(rows(130)) + "]",
        "long record": "[" + _rec(1, r) + ',{"ts":"2024-01-02T00:00:00Z","platform":"' + "}" * 9000 + '"},' + _rec(2, r) + "]",
    }
    for name, text in files.items():
        (d / f"{name}.json").write_text(text, encoding="utf-8")
    return d


def test_ranges_give_what_whole_files_give(spark, folder):
    want = sorted(map(str, exports.read_exports(spark, str(folder)).collect()))
    whole = {r["source_file"]: tuple(r)[2:] for r in exports.file_report(spark, str(folder)).collect()}
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "6k")
    try:
        got = sorted(map(str, exports.read_exports(spark, str(folder)).collect()))
        report = {r["source_file"]: tuple(r)[1:] for r in exports.file_report(spark, str(folder)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(want) > 400 and got == want
    assert {n: r[1:] for n, r in report.items()} == whole
    parts = {n[:-5] for n, r in report.items() if r[0] == "parts"}
    assert parts == {"flat", "nested", "object", "numbers", "marked", "long record", "clean lines"}


def test_an_array_is_read_by_many_tasks_and_its_text_once(spark, tmp_path):
    r = random.Random(2)
    text = "[" + ",".join(_rec(i, r, plain=True) for i in range(150_000)) + "]"  # one line
    (tmp_path / "big.json").write_text(text)
    stats = spark._jvm.org.apache.hadoop.fs.FileSystem.getGlobalStorageStatistics().get("file")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2m")
    try:
        before = stats.getLong("bytesRead")
        df = exports.read_exports(spark, str(tmp_path))
        assert df.count() == 150_000
        read = stats.getLong("bytesRead") - before
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert read / len(text.encode()) < 2  # the text, the ranges' heads, and the stored pieces


def _plain(pieces, level, quoted, depth):
    """State after pieces by looking at every character."""
    escaped = False
    for piece in pieces:
        for c in piece + "}":
            if escaped:
                escaped = False
            elif c == "\\":
                escaped = True
            elif c == '"':
                quoted = not quoted
            elif not quoted:
                depth += (c in "[{") - (c in "]}")
    return int(quoted), depth


@pytest.mark.parametrize("seed", range(30))
def test_a_range_notes_what_it_does_to_any_start(seed):
    r = random.Random(seed)
    pieces = ["".join(r.choices(['"', "{", "[", "]", "x", '\\"', "\\\\", ",", " "], k=r.randrange(9))) for _ in range(12)]
    noted = Range(1, 0, 1)
    for p in pieces:
        noted.read(p.encode(), False)
    for quoted in (0, 1):
        q, d = _plain(pieces, 1, bool(quoted), 5)
        assert (quoted + noted.quotes) % 2 == q and 5 + noted.change[quoted] == d


def test_small_ranges_share_tasks(spark, tmp_path):
    """Before, every range was a task of its own, with a Python worker and several files."""
    from encore.sources import split_json

    r = random.Random(3)
    text = "[" + ",".join(_rec(i, r) for i in range(20_000)) + "]"
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "big.json").write_text(text)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        path, size = str(tmp_path / "in" / "big.json"), len(text.encode())
        cut = split_json._cut(spark, [path], {}, 4)
        assert cut.rdd.getNumPartitions() == 4 and cut.where(f"part = {split_json.NOTE}").count() > 50
        chunks = split_json.cut_files(spark, [path], str(tmp_path / "stage"), size)
        assert split_json.elements(chunks).selectExpr("sum(size(elements)) AS n", "min(sound) AS s").first()[:] == (20_000, True)
        assert len(list((tmp_path / "stage" / "guessed" / f"part={split_json.NOTE}").glob("*.parquet"))) <= 2 * spark.sparkContext.defaultParallelism
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
