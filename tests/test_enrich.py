"""Lookup order of the enrichment joins (primary, fallback, id, name)."""

from encore.operators import enrich as EN


def test_artists_primary_then_fallback(spark):
    top = spark.createDataFrame([("A", 3.0), ("B", 2.0), ("C", 1.0), ("", 0.5)], "artist string, play_hours double")
    prim = spark.createDataFrame([("A", None, "p/A")], "artist string, image_url string, external_url string")
    fb = spark.createDataFrame(
        [("B", None, "big/B", "med/B", "f/B"), ("A", "xl/A", "big/A", "med/A", "f/A"), ("", "xl/", "b", "m", "f/")],
        "artist string, picture_xl string, picture_big string, picture_medium string, link string")
    got = {r["artist"]: (r["image_url"], r["external_url"]) for r in EN.enrich_artists(top, prim, fb).collect()}
    assert got == {"A": (None, "p/A"), "B": ("big/B", "f/B"), "C": (None, None), "": (None, None)}


def test_a_record_without_a_link_or_image_still_counts(spark):
    """A primary record is a hit whatever it lacks; of several the first by link wins, one without last."""
    top = spark.createDataFrame([("A", 4.0), ("B", 3.0), ("C", 2.0)], "artist string, play_hours double")
    prim = spark.createDataFrame(
        [("A", "i/A", None, ["x", "y"], 7), ("B", None, None, None, None), ("C", "i/C0", None, ["z"], 1), ("C", None, "p/C", [], 2)],
        "artist string, image_url string, external_url string, genres array<string>, popularity int")
    fb = spark.createDataFrame([(a, f"xl/{a}", "b", "m", f"f/{a}") for a in "ABC"],
                               "artist string, picture_xl string, picture_big string, picture_medium string, link string")
    got = {r["artist"]: tuple(r)[2:] for r in EN.enrich_artists(top, prim, fb).collect()}
    assert got == {"A": ("i/A", None, "x, y", 7), "B": (None, None, "", None), "C": (None, "p/C", "", 2)}


def test_album_records_without_a_link(spark):
    top = spark.createDataFrame([("X", "A", 1.0)], "album string, artist string, play_hours double")
    prim = spark.createDataFrame([("X", "A", "i/X", None, "1999-05-01")],
                                 "album string, artist string, image_url string, external_url string, release_date string")
    fb = spark.createDataFrame([("X", "A", "xl", "b", "m", "f/X")], "album string, artist string, cover_xl string, "
                               "cover_big string, cover_medium string, link string")
    r = EN.enrich_albums(top, prim, fb).first()
    assert (r["image_url"], r["external_url"], r["release_date"]) == ("i/X", None, "1999-05-01")


def test_albums_artist_optional(spark):
    top = spark.createDataFrame([("X", "A", 1.0), ("Y", None, 1.0)], "album string, artist string, play_hours double")
    prim = spark.createDataFrame([("X", "A", "i/XA", "p/XA"), ("Y", "Z", "i/YZ", "p/YZ"), ("Y", "B", "i/YB", "p/YB")],
                                 "album string, artist string, image_url string, external_url string")
    fb = spark.createDataFrame([], "album string, artist string, cover_xl string, cover_big string, "
                                   "cover_medium string, link string")
    got = {r["album"]: r["external_url"] for r in EN.enrich_albums(top, prim, fb).collect()}
    assert got == {"X": "p/XA", "Y": "p/YB"}  # album-only match: first record by its url


def test_tracks_id_first_then_name(spark):
    top = spark.createDataFrame(
        [("t1", "a", "music:track:1"), ("t2", "a", "music:track:99"), ("t3", "a", "music:a:b:c")],
        "track string, artist string, track_uri string")
    cat = spark.createDataFrame(
        [("1", "t1", "a", 5, "u1", "al", "2000", "img"), ("2", "t2", "a", 6, "u2", "al", "2000", "img")],
        "track_id string, track string, artist string, popularity int, external_url string, album_name string, "
        "album_release_date string, album_image string")
    got = {r["track"]: (r["track_id"], r["matched_by"]) for r in EN.enrich_tracks(top, cat).collect()}
    assert got == {"t1": ("1", "id"), "t2": ("2", "name"), "t3": (None, None)}


def test_uri_parse(spark):
    from pyspark.sql import functions as F

    from encore.functions.columns import uri_id, uri_kind

    df = spark.createDataFrame([("music:track:abc",), ("music:a:b:c",), (None,), ("other:track:x",)], "u string")
    got = [(r[0], r[1]) for r in df.select(uri_kind("u"), uri_id("u")).collect()]
    assert got == [("track", "abc"), (None, None), (None, None), (None, None)]
    assert F is not None
