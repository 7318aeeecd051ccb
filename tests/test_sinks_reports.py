"""Record sink, frame union, catalog-enriched reports, file listing."""

import json
import os

from encore.operators import aggregates as A
from encore.plans import reports as RP
from encore.sources import catalog as C
from encore.sources import curated
from encore.sources.exports import json_files, union_frames
from encore.sources.records import to_json_lines, to_records

from conftest import SF_SMALL, ts


def test_records_fill_nulls(spark):
    df = spark.createDataFrame([(None, None, None), (1.5, "a", 2)], "x double, s string, n int")
    got = [tuple(r) for r in to_records(df, ["x", "s", "n"]).collect()]
    assert got == [(0.0, "", 0), (1.5, "a", 2)]
    lines = [json.loads(r["value"]) for r in to_json_lines(df, ["x", "s"]).collect()]
    assert lines == [{"x": 0.0, "s": ""}, {"x": 1.5, "s": "a"}]


def test_union_by_name(spark):
    a = spark.createDataFrame([(1, "p")], "k int, a string")
    b = spark.createDataFrame([(2, "q")], "k int, b string")
    u = union_frames([a, b]).orderBy("k").collect()
    assert [(r["k"], r["a"], r["b"]) for r in u] == [(1, "p", None), (2, None, "q")]


def test_json_file_listing(spark, tmp_path):
    for name in ["b.json", "a.json", "sub/c.json", "d.txt"]:
        p = tmp_path / name
        os.makedirs(p.parent, exist_ok=True)
        p.write_text("[]")
    names = [r["file_name"] for r in json_files(spark, str(tmp_path)).collect()]
    assert sorted(names) == ["a.json", "b.json", "c.json"]
    opts = RP.filter_options(curated.plays(spark, SF_SMALL), str(tmp_path))
    assert opts["filesLoaded"] == 3 and opts["contentTypes"] == ["Songs", "Podcasts", "Audiobooks"]


def test_reports_with_catalogs(spark):
    p = curated.plays(spark, SF_SMALL)
    cats = {
        "artist_primary": C.artist_primary(spark, SF_SMALL), "artist_fallback": C.artist_fallback(spark, SF_SMALL),
        "album_primary": C.album_primary(spark, SF_SMALL), "album_fallback": C.album_fallback(spark, SF_SMALL),
        "track_catalog": C.track_catalog(spark, SF_SMALL),
    }
    d = RP.dashboard(p, catalogs=cats)
    assert {"image_url", "external_url"} <= set(d["topArtists"].columns)
    known = [r for r in d["topArtists"].collect() if r["artist"].startswith("Brand#")]
    assert known and all(r["external_url"] for r in known)
    a = RP.artist_song_analytics(p, catalogs=cats)
    f = a["featuredTrack"].collect()
    assert len(f) == 1 and f[0]["matched_by"] in ("id", "name")


def test_heatmap_present_only_seen_axes(make_plays):
    p = make_plays([{"ts": ts("2024-01-01 10:00:00"), "ms_played": 60000.0},   # Monday 10h
                    {"ts": ts("2024-01-03 22:00:00"), "ms_played": 120000.0}], sessions=False)  # Wednesday 22h
    got = {(r["weekday_name"], r["listening_hour"]): r["play_minutes"] for r in A.heatmap_present(p).collect()}
    assert got == {("Monday", 10): 1.0, ("Monday", 22): 0.0, ("Wednesday", 10): 0.0, ("Wednesday", 22): 2.0}
    assert A.heatmap_long(p).count() == 168


def test_union_of_unlike_types_does_not_depend_on_the_order(spark):
    import datetime as dt
    import itertools

    frames = [
        spark.createDataFrame([(1, [1, 2], (1, "a"), {"k": 1})], "v int, l array<int>, s struct<a:int,b:string>, m map<string,int>"),
        spark.createDataFrame([("x", [1.5], (True,), {"k": "z"})], "v string, l array<double>, s struct<a:boolean>, m map<string,string>"),
        spark.createDataFrame([(dt.date(2024, 1, 2), None)], "v date, extra float"),
        spark.createDataFrame([(True, 3)], "v boolean, extra bigint"),
    ]
    seen = set()
    for order in itertools.permutations(frames):
        u = union_frames(list(order))
        got = sorted(str(r) for r in u.select("v", "l", "s.a", "s.b", "m", "extra").collect())
        seen.add((tuple(got), u.schema["v"].dataType.simpleString(), u.schema["extra"].dataType.simpleString(), u.schema["l"].dataType.simpleString()))
    assert len(seen) == 1
    rows, v, extra, arrays = seen.pop()
    assert (v, extra, arrays) == ("string", "double", "array<double>")
    assert any("v='2024-01-02'" in r for r in rows) and any("m={'k': '1'}" in r for r in rows) and any("a='true'" in r for r in rows)


def test_common_type_of_numbers():
    from pyspark.sql import types as T

    from encore.sources.exports import common_type

    def both(a, b):
        assert common_type(a, b) == common_type(b, a)
        return common_type(a, b)

    assert both(T.IntegerType(), T.LongType()) == T.LongType()
    assert both(T.IntegerType(), T.FloatType()) == T.DoubleType()
    assert both(T.ShortType(), T.FloatType()) == T.FloatType()
    assert both(T.DecimalType(10, 2), T.IntegerType()) == T.DecimalType(12, 2)
    assert both(T.DecimalType(38, 20), T.LongType()) == T.DoubleType()
    assert both(T.DateType(), T.TimestampType()) == T.TimestampType()
    assert both(T.BooleanType(), T.IntegerType()) == T.StringType()
    assert both(T.NullType(), T.StructType([])) == T.StructType([])
