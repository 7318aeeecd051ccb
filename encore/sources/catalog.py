"""Metadata dimension tables (artist / album / track catalogs).

In production these are tables the caller supplies (a catalog export, a lookup cache). For
the test data they are derived from ``part`` by fixed rules with deliberate holes, so both
lookup paths (primary, fallback; by id, by name) are exercised. The oracle repeats the rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from encore.sources.star import read_table

# URL prefixes of the synthetic catalogs.
PRIMARY = "https://open.primary.example"
PRIMARY_IMG = "https://img.primary.example"
FALLBACK = "https://www.fallback.example"
FALLBACK_IMG = "https://cdn.fallback.example"


def _brand_code(c: str = "p_brand"):
    return F.regexp_replace(F.col(c), "#", "-")


def artist_primary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """artist, image_url, external_url, genres, popularity. Brands ending in 3 are missing;
    brands ending in 5 have no image, those ending in 4 no link."""
    p = read_table(spark, sf_dir, "part").select("p_brand").distinct().where(~F.col("p_brand").endswith("3"))
    code = _brand_code()
    return p.select(
        F.col("p_brand").alias("artist"),
        F.when(F.col("p_brand").endswith("5"), F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit(PRIMARY_IMG + "/artist/"), code)).alias("image_url"),
        F.when(~F.col("p_brand").endswith("4"), F.concat(F.lit(PRIMARY + "/artist/"), code)).alias("external_url"),
        F.array(F.lit("genre-a"), F.concat(F.lit("genre-"), F.substring("p_brand", 7, 1))).alias("genres"),
        F.substring("p_brand", 7, 2).cast("int").alias("popularity"),
    )


def artist_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """artist, picture_xl, picture_big, picture_medium, link. Brands ending in 1 lack the xl picture."""
    p = read_table(spark, sf_dir, "part").select("p_brand").distinct()
    code = _brand_code()
    return p.select(
        F.col("p_brand").alias("artist"),
        F.when(F.col("p_brand").endswith("1"), F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit(FALLBACK_IMG + "/xl/"), code)).alias("picture_xl"),
        F.concat(F.lit(FALLBACK_IMG + "/big/"), code).alias("picture_big"),
        F.concat(F.lit(FALLBACK_IMG + "/medium/"), code).alias("picture_medium"),
        F.concat(F.lit(FALLBACK + "/artist/"), code).alias("link"),
    )


def _album_code():
    return F.concat(F.regexp_replace(F.col("p_type"), " ", "_"), F.lit("/"), _brand_code())


def album_primary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """album, artist, image_url, external_url, release_date. Brands ending in 4 are missing, those
    ending in 1 have no image and those ending in 5 no link."""
    p = read_table(spark, sf_dir, "part").select("p_type", "p_brand").distinct().where(~F.col("p_brand").endswith("4"))
    return p.select(
        F.col("p_type").alias("album"),
        F.col("p_brand").alias("artist"),
        F.when(~F.col("p_brand").endswith("1"), F.concat(F.lit(PRIMARY_IMG + "/album/"), _album_code())).alias("image_url"),
        F.when(~F.col("p_brand").endswith("5"), F.concat(F.lit(PRIMARY + "/album/"), _album_code())).alias("external_url"),
        F.lit("2001-01-01").alias("release_date"),
    )


def album_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """album, artist, cover_xl, cover_big, cover_medium, link. Brands ending in 2 lack xl and big."""
    p = read_table(spark, sf_dir, "part").select("p_type", "p_brand").distinct()
    no_big = F.col("p_brand").endswith("2")
    return p.select(
        F.col("p_type").alias("album"),
        F.col("p_brand").alias("artist"),
        F.when(no_big, F.lit(None).cast("string")).otherwise(F.concat(F.lit(FALLBACK_IMG + "/cover-xl/"), _album_code()))
        .alias("cover_xl"),
        F.when(no_big, F.lit(None).cast("string")).otherwise(F.concat(F.lit(FALLBACK_IMG + "/cover-big/"), _album_code()))
        .alias("cover_big"),
        F.concat(F.lit(FALLBACK_IMG + "/cover-medium/"), _album_code()).alias("cover_medium"),
        F.concat(F.lit(FALLBACK + "/album/"), _album_code()).alias("link"),
    )


def track_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """track_id, track, artist, popularity, external_url, album_name, album_release_date, album_image.

    Parts of brands ``Brand#1x`` are catalogued under a different id (``c<partkey>``), so a
    lookup by the play's URI misses and the name lookup has to find them.
    """
    p = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    tid = F.when(F.col("p_brand").startswith("Brand#1"), F.concat(F.lit("c"), F.col("p_partkey").cast("string"))).otherwise(
        F.col("p_partkey").cast("string")
    )
    return p.select(
        tid.alias("track_id"),
        F.col("p_name").alias("track"),
        F.col("p_brand").alias("artist"),
        F.col("p_size").cast("int").alias("popularity"),
        F.concat(F.lit(PRIMARY + "/track/"), tid).alias("external_url"),
        F.col("p_type").alias("album_name"),
        F.concat((F.lit(1950) + F.col("p_size")).cast("string"), F.lit("-01-01")).alias("album_release_date"),
        F.concat(F.lit(PRIMARY_IMG + "/cover/"), F.col("p_partkey").cast("string")).alias("album_image"),
    )
