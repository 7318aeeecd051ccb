"""Raw plays derived from the driver's star-schema tables (one line item = one play).

The mapping is the one documented in FIXTURES.md; ``oracle`` SQL repeats it in DuckDB. All
joins are inner equi-joins left to Catalyst/AQE (broadcast only under the planner's own size
check, sort-merge at scale). The order-side dimensions are joined first, so the line items are
shuffled only on their two keys. Only the referenced columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from encore.schema import RAW_COLUMNS, raw_type

STAR_SOURCE_FILE = "star_schema"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def star_plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw plays in ``RAW_SCHEMA`` column order (untyped cleaning is left to ``prepare``)."""
    l = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_tax", "l_discount", "l_returnflag", "l_linestatus",
    )
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    p = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")

    # Order-side dimensions first: orders x customer x nation is orders-sized, so the big
    # lineitem side is shuffled only twice (orderkey, partkey), not three times. The join
    # strategy is left to the planner and AQE.
    oc = o.join(c.join(n, c.c_nationkey == n.n_nationkey), o.o_custkey == c.c_custkey)
    j = l.join(oc, l.l_orderkey == oc.o_orderkey).join(p, l.l_partkey == p.p_partkey)

    key = F.col("l_orderkey") + F.col("l_linenumber")
    offset = (F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 4801) % 86400
    no_meta = (F.col("p_size") % 10 == 0) | (F.col("p_size") % 11 == 0)

    def meta(col: str) -> Column:
        return F.when(no_meta, F.lit(None)).otherwise(F.col(col))

    exprs: dict[str, Column] = {
        # some plays have no time, and some are podcast and audiobook at once (see FIXTURES.md)
        "ts": F.when((F.col("l_orderkey") * 3 + F.col("l_linenumber")) % 59 != 0,
                     F.timestamp_add("SECOND", offset.cast("int"), F.col("o_orderdate"))),
        "platform": F.col("c_mktsegment"),
        "ms_played": F.when(key % 97 == 0, F.lit(None))
        .when(key % 89 == 0, F.lit(-1.0))
        .otherwise(F.floor(F.col("l_quantity") * 6000).cast("double")),
        "conn_country": F.col("n_name"),
        "master_metadata_track_name": meta("p_name"),
        "master_metadata_album_artist_name": meta("p_brand"),
        "master_metadata_album_album_name": meta("p_type"),
        "track_uri": F.when(no_meta, F.lit(None)).otherwise(
            F.concat(F.lit("music:track:"), F.col("p_partkey").cast("string"))
        ),
        "episode_name": F.when(F.col("p_size") % 10 == 0, F.col("p_name")),
        "audiobook_title": F.when((F.col("p_size") % 11 == 0) | (F.col("p_size") == 30), F.col("p_name")),
        "reason_start": F.col("o_orderpriority"),
        "reason_end": F.when(F.col("l_suppkey") % 13 == 0, F.lit(None)).otherwise(
            F.concat(F.lit("end_"), (F.col("l_suppkey") % 5).cast("string"))
        ),
        "shuffle": F.col("l_linestatus") == "O",
        "skipped": F.when(F.col("l_returnflag") == "R", True).when(F.col("l_returnflag") == "A", False),
        "offline": F.col("l_tax") > 0.06,
        "incognito_mode": F.col("l_discount") > 0.08,
    }
    cols = []
    for name in RAW_COLUMNS:
        e = exprs.get(name, F.lit(None))
        if name != "ts":
            e = e.cast(raw_type(name))
        cols.append(e.alias(name))
    cols += [F.lit(STAR_SOURCE_FILE).alias("source_file"), F.lit(None).cast("string").alias("extra_json")]
    return j.select(*cols)
