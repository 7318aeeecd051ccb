"""Ranked lexical search, reversed: the items are indexed and the documents are streamed through.

The items (the queries of the search) are few and the documents many, so it is the items that get an
inverted index: term -> the items that hold it, and how often. Items are dealt into blocks of about
``BLOCK_TERMS`` different (item, term) pairs; a block's index is broadcast, which bounds it whatever
the number of items, and every block is one pass. A first step turns each document into its number of
terms and the counts of those in the block's vocabulary, stored for the second; the number of documents
holding a term, and the lengths, are summed from that table over all documents. The second step adds up the
scores of batches of documents over the postings they touch and offers them to one bounded heap per
item; the heaps of all tasks are merged by rank, first inside ``SALTS`` groups of tasks, so that no
task gets the heaps of all others.

All arithmetic is whole numbers, but for the logarithm of a term's weight.

Defined cases: null and empty texts have no term, as item (no row) or as document (counted neither in
the number of documents nor in their length); texts are read whole, in chunks between terms; every
row is a document or an item of its own, also where ids repeat; equal scores by ascending id, a null
id last; a null item id is returned as such; no documents or no items give an empty result. Only id
and text columns are read, so others may have any name.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from encore.llm.bpe import slices
from encore.llm.common import map_texts, stored, table

K = 10
BLOCK_TERMS = 200_000  # (item, term) pairs of an index; some 20 MB with the terms themselves
SALTS = 64
CHUNK = 1 << 20  # bytes of a text that are split at a time
CELLS = 500_000  # (document, item) sums of a batch
POSTINGS = 1_000_000  # postings of a batch

# ASCII letters and digits are parts of terms, A-Z in lower case, and so is everything beyond ASCII
_PART = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(128)) + bytes(range(128, 256))
TERM_BYTES = _PART.lower()


def term_counts(text: bytes) -> Counter:
    """How often each term occurs in a text (UTF-8)."""
    flat, counts, at = text.translate(TERM_BYTES), Counter(), 0
    while at < len(flat):
        end = flat.find(b" ", at + CHUNK)
        end = len(flat) if end < 0 else end
        counts.update(flat[at:end].split())
        at = end
    return counts


def _texts(batch: pa.RecordBatch) -> list:
    return batch.column(1).cast(pa.binary()).to_pylist()


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``item_id, rid, term, n``: the terms of every item, ``rid`` numbering the items' rows."""
    rows = items.select(F.col(id_col).alias("item_id"), F.coalesce(text_col, F.lit("")).alias("text"), F.monotonically_increasing_id().alias("rid"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole):
                found = [term_counts(t) for t in _texts(b)]
                row = pa.array(np.repeat(np.arange(b.num_rows), [len(c) for c in found]))
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).take(row),
                        b.column(2).take(row),
                        pa.array([t for c in found for t in c], pa.binary()),
                        pa.array([n for c in found for n in c.values()], pa.int64()),
                    ],
                    ["item_id", "rid", "term", "n"],
                )

    kind = items.schema[id_col].dataType.simpleString()
    return map_texts(rows, run, f"item_id {kind}, rid long, term binary, n long")


class Index:
    """Inverted index of a block of items: ``rids``, ``item_ids``, ``vocabulary`` (term -> number) and,
    by term number, the postings ``items[at[t]:at[t + 1]]`` with the term's count in each item."""

    def __init__(self, rows: list):
        self.item_ids = {r["rid"]: r["item_id"] for r in rows}
        self.rids = sorted(self.item_ids)
        self.item_ids = [self.item_ids[r] for r in self.rids]
        place = {r: i for i, r in enumerate(self.rids)}
        self.vocabulary = {t: i for i, t in enumerate(sorted({bytes(r["term"]) for r in rows}))}
        term = np.array([self.vocabulary[bytes(r["term"])] for r in rows], np.int64)
        order = np.argsort(term, kind="stable")
        self.at = np.searchsorted(term[order], np.arange(len(self.vocabulary) + 1))
        self.items = np.array([place[r["rid"]] for r in rows], np.int64)[order]
        self.times = np.array([r["n"] for r in rows], np.int64)[order]


def document_counts(docs: DataFrame, id_col: str, text_col: str, index) -> DataFrame:
    """``doc_id, n, term array, tf array`` of every document with a term: ``n`` counts all its terms,
    the arrays hold those of the (broadcast) index."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = index.value.vocabulary
        for whole in batches:
            for b in slices(whole):
                n, term, tf = [], [], []
                for text in _texts(b):
                    counts = term_counts(text)
                    n.append(counts.total())
                    known = [(number[t], c) for t, c in counts.items() if t in number]
                    term.append([t for t, _ in known])
                    tf.append([c for _, c in known])
                out = pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(n, pa.int64()), pa.array(term, pa.list_(pa.int32())), pa.array(tf, pa.list_(pa.int64()))],
                    ["doc_id", "n", "term", "tf"],
                )
                yield out.filter(pc.greater(out.column("n"), 0))

    kind = docs.schema[id_col].dataType.simpleString()
    return map_texts(rows, run, f"doc_id {kind}, n long, term array<int>, tf array<long>")


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def batch_scores(index: Index, weights: np.ndarray, exact_float: bool, m: np.ndarray, size: np.ndarray, term: np.ndarray, tf: np.ndarray) -> np.ndarray:
    """Scores (documents x items) of some documents, whose ``size`` terms each lie one after another."""
    doc = np.repeat(np.arange(len(size)), size)
    part = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
    many = index.at[term + 1] - index.at[term]
    ends = np.cumsum(many)
    posting = np.arange(ends[-1] if len(ends) else 0) + np.repeat(index.at[term] - (ends - many), many)
    cell = np.repeat(doc, many) * len(index.rids) + index.items[posting]
    value = np.repeat(part, many) * index.times[posting]
    if exact_float:
        sums = np.bincount(cell, weights=value, minlength=len(size) * len(index.rids)).astype(np.int64)
    else:
        sums = np.zeros(len(size) * len(index.rids), np.int64)
        np.add.at(sums, cell, value)
    return sums.reshape(len(size), len(index.rids))


def _cuts(size: np.ndarray, postings: np.ndarray, n_items: int) -> Iterator[tuple[int, int]]:
    """Runs of documents that keep to ``CELLS`` and ``POSTINGS``, one document at least."""
    total, most, at = np.cumsum(postings), max(1, CELLS // max(1, n_items)), 0
    while at < len(size):
        done = total[at - 1] if at else 0
        end = int(np.searchsorted(total, done + POSTINGS, side="right"))
        end = max(at + 1, min(end, at + most))
        yield at, end
        at = end


def best_documents(counts: DataFrame, index, weights: np.ndarray, n_docs: int, n_terms: int, item_type: DataType, k: int) -> DataFrame:
    """``item_id, rid, doc_id, score``: every task's best ``k`` documents of each item of the (broadcast) index."""
    id_type = counts.schema["doc_id"].dataType
    item_arrow, id_arrow = to_arrow_type(item_type), to_arrow_type(id_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix: Index = index.value
        terms = np.repeat(np.arange(len(ix.at) - 1), np.diff(ix.at))
        # no sum is above this; doubles add whole numbers exactly up to 2^53
        most = np.bincount(ix.items, weights=ix.times * weights[terms] * 1e6).max(initial=0)
        heaps: list[list] = [[] for _ in ix.rids]
        floor = np.ones(len(ix.rids), np.int64)  # scores below are of no use
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            m = np.array([100 - 75 + (75 * n * n_docs) // n_terms for n in batch.column("n").to_pylist()], np.int64)
            size = np.diff(batch.column("term").offsets.to_numpy())
            term = batch.column("term").flatten().to_numpy().astype(np.int64)
            tf = batch.column("tf").flatten().to_numpy()
            first = np.concatenate([[0], np.cumsum(size)])
            postings = np.concatenate([[0], np.cumsum(ix.at[term + 1] - ix.at[term])])
            for a, b in _cuts(size, np.diff(postings[first]), len(ix.rids)):
                at, end = first[a], first[b]
                sums = batch_scores(ix, weights, most < 1 << 52, m[a:b], size[a:b], term[at:end], tf[at:end])
                for doc, item in zip(*(x.tolist() for x in np.nonzero(sums >= floor))):
                    entry = (int(sums[doc, item]), -math.inf if ids[a + doc] is None else -ids[a + doc])
                    heap = heaps[item]
                    if len(heap) < k:
                        heapq.heappush(heap, entry)
                    elif entry > heap[0]:
                        heapq.heapreplace(heap, entry)
                    if len(heap) == k:
                        floor[item] = heap[0][0]
        flat = [(i, s, None if d == -math.inf else -d) for i, h in enumerate(heaps) for s, d in h]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([ix.item_ids[i] for i, _, _ in flat], item_arrow),
                pa.array([ix.rids[i] for i, _, _ in flat], pa.int64()),
                pa.array([d for _, _, d in flat], id_arrow),
                pa.array([s for _, s, _ in flat], pa.int64()),
            ],
            ["item_id", "rid", "doc_id", "score"],
        )

    return map_texts(counts, run, f"item_id {item_type.simpleString()}, rid long, doc_id {id_type.simpleString()}, score long")


def merged(found: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of each item from all tasks' heaps, with their ``rank``."""
    best = [F.desc("score"), F.asc_nulls_last("doc_id")]
    salted = Window.partitionBy("rid", "salt").orderBy(*best)
    found = found.withColumn("salt", F.spark_partition_id() % SALTS)
    found = found.withColumn("place", F.row_number().over(salted)).where(F.col("place") <= k)
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("rid").orderBy(*best)))
    return found.where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def search(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    doc_text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    k: int = K,
) -> DataFrame:
    """The ``k`` documents of the highest score above 0 of every item: ``item_id, rank, doc_id, score``.
    Document ids are whole numbers; item ids whole numbers or text."""
    spark = docs.sparkSession
    of_items = stored(item_terms(items, item_id, item_text))
    blocks = max(1, -(-of_items.count() // BLOCK_TERMS))
    of_items = of_items.withColumn("block", F.pmod(F.xxhash64("rid"), F.lit(blocks)))
    out = None
    for block in range(blocks):
        # one block of the index: bounded by BLOCK_TERMS, so it may pass through the driver
        index = Index(of_items.where(F.col("block") == block).collect())
        shared = spark.sparkContext.broadcast(index)
        counts = stored(document_counts(docs, doc_id, doc_text, shared))
        total = counts.agg(F.count("*").alias("n"), F.sum("n").alias("l")).first()
        df = counts.select(F.explode("term").alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect()
        weights = np.zeros(max(1, len(index.vocabulary)), np.int64)
        for r in df:
            weights[r["t"]] = weight(total["n"], r["n"])
        found = merged(best_documents(counts, shared, weights, total["n"], total["l"], items.schema[item_id].dataType, k), k)
        out = found if out is None else out.unionByName(found)
    return out


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS did, doc_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents WHERE text IS NOT NULL
),
i AS (
  SELECT row_number() OVER () AS iid, item_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM benchmark WHERE text IS NOT NULL
),
total AS (SELECT count(*) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS n_terms FROM d WHERE len(terms) > 0),
dt AS (SELECT did, term, count(*) AS tf FROM (SELECT did, unnest(terms) AS term FROM d) GROUP BY did, term),
it AS (SELECT iid, term, count(*) AS times FROM (SELECT iid, unnest(terms) AS term FROM i) GROUP BY iid, term),
w AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(n_docs) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM dt, total GROUP BY term
),
m AS (SELECT did, doc_id, 100 - 75 + ((75 * len(terms) * n_docs) // n_terms) AS m FROM d, total WHERE len(terms) > 0),
part AS (SELECT dt.did, m.doc_id, dt.term, w.w * ((1000000000 * dt.tf) // (1000 * dt.tf + 8 * m.m)) AS p FROM dt JOIN m USING (did) JOIN w USING (term)),
s AS (SELECT it.iid, part.did, any_value(part.doc_id) AS doc_id, CAST(sum(part.p * it.times) AS BIGINT) AS score FROM part JOIN it USING (term) GROUP BY it.iid, part.did),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score > 0)
SELECT i.item_id, r.rank, r.doc_id, r.score FROM r JOIN i USING (iid) WHERE r.rank <= 10
"""
