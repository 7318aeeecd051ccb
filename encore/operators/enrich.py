"""Metadata enrichment of small ranked results.

The dashboard looks up every ranked row over HTTP, one request after another. Here a lookup
is a join against a catalog table: the ranked side has k rows (a proven bound, since it is a
``limit(k)`` result), so it is the broadcast side — the catalog is scanned once, filtered by a
broadcast hash join against the k keys, and reduced to the first record per key before it is
joined back. No catalog row is broadcast and no per-row request is made. The ranked frame is used
several times (keys, result), so it is computed once, into the shared checkpoint folder.

Of several records of a key the first by link wins, records without a link last, so a record
that lacks one still counts and keeps its image.

Lookup order follows the dashboard: primary catalog first, fallback second, else NULL; an
empty name finds nothing. Albums match on (album, artist), on album alone when the artist is
empty. Tracks match by the id in their URI first, then by (track, artist).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from encore.functions.columns import uri_id, uri_kind
from encore.operators.rankings import once


def _blank(c: Column) -> Column:
    return c.isNull() | (c == "")


def first_match(
    catalog: DataFrame,
    keys: DataFrame,
    key_cols: list[str],
    condition,
    value_cols: list[str],
    order_cols: list[str],
) -> DataFrame:
    """For each row of the small ``keys`` frame, the first catalog record by ``order_cols``
    (NULLs last) among those satisfying ``condition(catalog, keys)``.

    Returns ``_k_<key>`` columns (the keys) plus ``value_cols``; at most one row per key.
    """
    k = keys.select(*[F.col(c).alias(f"_k_{c}") for c in key_cols]).distinct()
    # Catalyst prunes the catalog scan to the columns used here.
    hits = catalog.join(F.broadcast(k), condition(catalog, k), "inner")
    order = F.struct(*[e for c in order_cols for e in (F.col(c).isNull(), F.col(c))])
    rec = F.min_by(F.struct(*[F.col(c) for c in value_cols]), order).alias("_rec")
    return hits.groupBy(*[f"_k_{c}" for c in key_cols]).agg(rec).select(*[f"_k_{c}" for c in key_cols], "_rec.*")


def _join_back(top: DataFrame, found: DataFrame, key_cols: list[str], prefix: str) -> DataFrame:
    renamed = found.select(
        *[F.col(f"_k_{c}") for c in key_cols],
        *[F.col(c).alias(f"{prefix}{c}") for c in found.columns if not c.startswith("_k_")],
        F.lit(True).alias(f"{prefix}hit"),
    )
    cond = None
    for c in key_cols:
        e = top[c].eqNullSafe(renamed[f"_k_{c}"])
        cond = e if cond is None else cond & e
    # ``found`` has at most one row per ranked row: bounded by k.
    return top.join(F.broadcast(renamed), cond, "left").drop(*[f"_k_{c}" for c in key_cols])


def _complete(catalog: DataFrame, optional: dict[str, str]) -> DataFrame:
    """The catalog with NULL for optional columns that it does not have."""
    missing = {c: F.lit(None).cast(t) for c, t in optional.items() if c not in catalog.columns}
    return catalog.withColumns(missing) if missing else catalog


def enrich_artists(top: DataFrame, primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """Adds ``image_url``, ``external_url``, ``genres`` (comma-separated) and ``popularity`` to a
    ranked frame with an ``artist`` column; the last two come from the primary catalog alone."""
    top = once(top)
    keys = top.select("artist").where(~_blank(F.col("artist")))
    primary = _complete(primary, {"genres": "array<string>", "popularity": "int"})
    p = first_match(primary, keys, ["artist"], lambda c, k: c["artist"] == k["_k_artist"],
                    ["image_url", "external_url", "genres", "popularity"], ["external_url", "image_url"])
    f = first_match(fallback, keys, ["artist"], lambda c, k: c["artist"] == k["_k_artist"],
                    ["picture_xl", "picture_big", "picture_medium", "link"], ["link", "picture_xl", "picture_big", "picture_medium"])
    out = _join_back(_join_back(top, p, ["artist"], "_p_"), f, ["artist"], "_f_")
    hit = F.coalesce(F.col("_p_hit"), F.lit(False))
    out = out.withColumns({
        "image_url": F.when(hit, F.col("_p_image_url")).otherwise(
            F.coalesce(F.col("_f_picture_xl"), F.col("_f_picture_big"), F.col("_f_picture_medium"))),
        "external_url": F.when(hit, F.col("_p_external_url")).otherwise(F.col("_f_link")),
        "genres": F.concat_ws(", ", F.col("_p_genres")),
        "popularity": F.col("_p_popularity"),
    })
    return out.drop(*[c for c in out.columns if c.startswith("_p_") or c.startswith("_f_")])


def _album_cond(c: DataFrame, k: DataFrame) -> Column:
    return (c["album"] == k["_k_album"]) & (_blank(k["_k_artist"]) | (c["artist"] == k["_k_artist"]))


def enrich_albums(top: DataFrame, primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """Adds ``image_url``, ``external_url`` and (from the primary catalog) ``release_date`` to a ranked
    frame with ``album`` and ``artist``."""
    top = once(top)
    keys = top.select("album", "artist").where(~_blank(F.col("album")))
    primary = _complete(primary, {"release_date": "string"})
    p = first_match(primary, keys, ["album", "artist"], _album_cond,
                    ["image_url", "external_url", "release_date"], ["external_url", "image_url"])
    f = first_match(fallback, keys, ["album", "artist"], _album_cond,
                    ["cover_xl", "cover_big", "cover_medium", "link"], ["link", "cover_xl", "cover_big", "cover_medium"])
    out = _join_back(_join_back(top, p, ["album", "artist"], "_p_"), f, ["album", "artist"], "_f_")
    hit = F.coalesce(F.col("_p_hit"), F.lit(False))
    out = out.withColumns({
        "image_url": F.when(hit, F.col("_p_image_url")).otherwise(
            F.coalesce(F.col("_f_cover_xl"), F.col("_f_cover_big"), F.col("_f_cover_medium"))),
        "external_url": F.when(hit, F.col("_p_external_url")).otherwise(F.col("_f_link")),
        "release_date": F.col("_p_release_date"),
    })
    return out.drop(*[c for c in out.columns if c.startswith("_p_") or c.startswith("_f_")])


_TRACK_FIELDS = ["track_id", "popularity", "external_url", "album_name", "album_release_date", "album_image"]


def enrich_tracks(top: DataFrame, catalog: DataFrame) -> DataFrame:
    """Adds catalog fields to a ranked frame with ``track``, ``artist`` and ``track_uri``.

    The record found by URI id wins; otherwise the one found by (track, artist); ``matched_by``
    says which ('id', 'name' or NULL).
    """
    t = once(top).withColumn("_tid", F.when(uri_kind("track_uri") == "track", uri_id("track_uri")))
    by_id = first_match(catalog, t.where(F.col("_tid").isNotNull()), ["_tid"],
                        lambda c, k: c["track_id"] == k["_k__tid"], _TRACK_FIELDS, ["track_id"])
    name_keys = t.where(~_blank(F.col("track")))
    by_name = first_match(
        catalog, name_keys, ["track", "artist"],
        lambda c, k: (c["track"] == k["_k_track"]) & (_blank(k["_k_artist"]) | (c["artist"] == k["_k_artist"])),
        _TRACK_FIELDS, ["track_id"],
    )
    out = _join_back(_join_back(t, by_id, ["_tid"], "_i_"), by_name, ["track", "artist"], "_n_")
    hit_i = F.coalesce(F.col("_i_hit"), F.lit(False))
    hit_n = F.coalesce(F.col("_n_hit"), F.lit(False))
    out = out.withColumns({f: F.when(hit_i, F.col(f"_i_{f}")).otherwise(F.col(f"_n_{f}")) for f in _TRACK_FIELDS})
    out = out.withColumn("matched_by", F.when(hit_i, F.lit("id")).when(hit_n, F.lit("name")))
    return out.drop("_tid", *[c for c in out.columns if c.startswith("_i_") or c.startswith("_n_")])
