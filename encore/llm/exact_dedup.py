"""Exact de-duplication with a heavy-hitter split.

Misra-Gries summaries, one per task, name every digest that holds more than ``2 / (counters + 1)``
of the rows. Their exact counts and winners (at most ``counters + 1`` rows) are broadcast, so the
rows of large groups are settled where they lie. All other digests meet by an ordinary shuffle, in
which no group can hold more than about ``2 / counters`` of the rows.

Defined cases: a null text counts as empty; equal texts are byte-identical; the largest id stays, a
null id sorts lowest; of repeated rows with the same id exactly one stays; an empty table gives an
empty result. Only the id and text columns of the input are read, so others may have any name.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from encore.llm.common import cut, table

COUNTERS = 1024


def misra_gries(values: Iterator[list], counters: int) -> Counter:
    """Misra-Gries summary of batches: a value seen more than ``n / (counters + 1)`` times is in it,
    with a count that is low by at most that much."""
    kept: Counter = Counter()
    for batch in values:
        kept.update(batch)
        if len(kept) > counters:
            floor = sorted(kept.values(), reverse=True)[counters]
            kept = Counter({v: c - floor for v, c in kept.items() if c > floor})
    return kept


def frequent(rows: DataFrame, column: str, counters: int = COUNTERS) -> DataFrame:
    """Candidates for the heavy hitters of a binary column: at most ``counters + 1`` rows, among them
    every value that holds more than ``2 / (counters + 1)`` of the rows. (The summed counts are low
    by at most ``n / (counters + 1)`` and add up to ``n`` at most.)"""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0

        def lists():
            nonlocal n
            for b in batches:
                n += b.num_rows
                yield b.column(0).to_pylist()

        kept = misra_gries(lists(), counters)
        yield pa.RecordBatch.from_pydict(
            {"v": pa.array([None, *kept], pa.binary()), "c": pa.array([n, *kept.values()], pa.int64())}
        )

    # the row without a value carries the number of rows of its task
    parts = rows.select(column).mapInArrow(summarise, "v binary, c long").groupBy("v").agg(F.sum("c").alias("c"))
    total = parts.where("v is null").select(F.col("c").alias("n"))
    return (
        parts.where("v is not null")
        .join(F.broadcast(total), F.col("c") * (counters + 1) >= F.col("n"))
        .select(F.col("v").alias(column))
    )


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``, and ``rid``, the
    number that ``monotonically_increasing_id`` gives the row."""
    rows = cut(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)).alias("digest"),
            F.monotonically_increasing_id().alias("rid"),
        )
    )
    heavy = cut(frequent(rows, "digest", counters))  # at most counters + 1 digests
    best = F.struct("doc_id", F.col("rid"))
    # large groups: partial counts are all that is shuffled, the verified winners are broadcast
    hot = rows.join(F.broadcast(heavy), "digest", "left_semi")
    winners = hot.groupBy("digest").agg(F.max(best).alias("best"), F.count("*").alias("group_size"))
    settled = rows.join(F.broadcast(winners), "digest")
    # the others: one shuffle by digest
    same = Window.partitionBy("digest")
    rest = rows.join(F.broadcast(heavy), "digest", "left_anti").select(
        "digest", "doc_id", "rid", F.max(best).over(same).alias("best"), F.count("*").over(same).alias("group_size")
    )
    return settled.select("digest", "doc_id", "rid", "best", "group_size").unionByName(rest).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("rid") == F.col("best.rid")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "rid",
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without exact copies, all columns kept. ``docs`` is read twice and must be
    stored or otherwise the same both times, since rows are told apart by their number."""
    gone = exact_groups(docs, id_col, text_col).where("not kept").select(F.col("rid").alias("__rid"))
    rows = docs.withColumn("__rid", F.monotonically_increasing_id())
    return rows.join(gone, "__rid", "left_anti").select(docs.columns)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents")).drop("rid")


OP8_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""
