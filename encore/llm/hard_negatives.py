"""Hard-negative mining by Kronecker-packed products.

The rows are dealt into cells of about ``CELL_ROWS`` rows, in bands of ``BAND`` cells; the anchors, a
stated set far smaller than the table, into blocks. Every block meets every band, as both lie, in one
join; a task goes through a band's cells with one block at a time and keeps a bounded heap of the best
rows per anchor, so a block and a band give a bounded number of rows, which are merged by rank.

A tile (block x cell) is multiplied in packed form: the rows' components are biased to be non-negative
and those of several rows put side by side into the fields of one wide integer, a field wide enough
for the largest sum. Each word is multiplied once by each (biased) component of an anchor and added
up; the fields then hold the sums of all its rows at once, and the biases are taken off again. The
scores are exact. Words are 64-bit numbers, or Python's integers where sums might not fit.

Two passes: the first gives each anchor its positives from the rows of its label (rows of a cell lie
in order of label, so only these are multiplied), the second the negatives from all rows.

Defined cases: rows with a null id, label or vector, an empty vector, or a component that is null or,
scaled, not finite take no part; an anchor's own id is no positive; vectors of different lengths never
meet; rows and anchors with repeated ids count each; ties go to the smaller id; an anchor without
positives, or a positive whose range holds no row, gives no row; scores beyond 64 bits count as the end
of that range; an empty table gives an empty result. Only the id, vector and label columns are read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from encore.llm.common import cut, map_texts, table

POSITIVES = 5
NEGATIVES = 10
LOW, HIGH = 30, 90  # a negative scores this many hundredths of the positive
SCALE = 256
CELL_ROWS = 2048
BAND = 16  # cells
BLOCK_ROWS = 256
TILE = 64  # anchors per product
WORD = 64  # bits
FIELDS = 8  # rows in one of Python's integers
END = (1 << 63) - 1


# --- Kronecker-packed products -----------------------------------------------------------------


def whole(x: np.ndarray) -> np.ndarray:
    """Whole numbers held by doubles as integers: 64-bit ones if they fit, else Python's."""
    if np.abs(x).max(initial=0) < 1 << 62:
        return x.astype(np.int64)
    return np.array([int(v) for v in x.ravel().tolist()], object).reshape(x.shape)


def _longest(x: np.ndarray) -> int:
    """At least the largest squared length of a row."""
    if x.dtype == object:
        return max((sum(v * v for v in row) for row in x.tolist()), default=0)
    return int((x.astype(np.float64) ** 2).sum(axis=1).max(initial=0) * (1 + 1e-9)) + 1


class Packed:
    """The rows of an integer matrix in wide integers, for products with rows of ``anchors``."""

    def __init__(self, rows: np.ndarray, anchors: np.ndarray):
        self.n, self.dim = rows.shape
        self.bias, self.anchor_bias = max(0, -int(rows.min(initial=0))), max(0, -int(anchors.min(initial=0)))
        row_top, anchor_top = int(rows.max(initial=0)) + self.bias, int(anchors.max(initial=0)) + self.anchor_bias
        tops = max(1, row_top, self.bias) * max(1, anchor_top, self.anchor_bias)
        self.kind = np.uint64 if self.dim * tops < 1 << 62 else object
        if self.kind is object:
            rows, anchors = rows.astype(object), anchors.astype(object)
        up = rows + self.bias
        # no sum of products is above the product of the lengths
        self.width = (math.isqrt(_longest(up) * _longest(anchors + self.anchor_bias)) + 1).bit_length()
        self.fields = WORD // self.width if self.kind is np.uint64 else FIELDS
        n_words = -(-self.n // self.fields)
        full = np.zeros((n_words * self.fields, self.dim), up.dtype)
        full[: self.n] = up
        full = full.reshape(n_words, self.fields, self.dim).astype(self.kind)
        self.words = np.zeros((self.dim, n_words), self.kind)
        for f in range(self.fields):
            self.words += full[:, f].T << self._bits(f)
        self.sums = rows.sum(axis=1)

    def _bits(self, field: int):
        return field * self.width if self.kind is object else np.uint64(field * self.width)

    def products(self, anchors: np.ndarray) -> np.ndarray:
        """Inner products (anchors x rows), 64-bit."""
        anchors = anchors.astype(object if self.kind is object else np.int64)
        up = (anchors + self.anchor_bias).astype(self.kind)
        total = np.zeros((len(anchors), self.words.shape[1]), self.kind)
        for j in range(self.dim):
            total += up[:, j, None] * self.words[j]
        mask = (1 << self.width) - 1
        fields = [(total >> self._bits(f)) & (mask if self.kind is object else np.uint64(mask)) for f in range(self.fields)]
        sums = np.stack(fields, axis=2).reshape(len(anchors), -1)[:, : self.n]
        # (a + A)(c + B) = ac + aB + Ac + AB, summed over the components
        taken = anchors.sum(axis=1)[:, None] * self.bias + (self.anchor_bias * (self.sums + self.dim * self.bias))[None, :]
        if self.kind is object:
            return np.clip(sums - taken, -END, END).astype(np.int64)
        return sums.astype(np.int64) - taken


# --- matrices as rows of a table ---------------------------------------------------------------


def usable(rows: DataFrame, id_col: str, vec_col: str, label: Column) -> DataFrame:
    """``id, label, vec`` of the rows that take part."""
    scaled = F.transform(vec_col, lambda x: SCALE * x.cast("double"))
    finite = F.forall(scaled, lambda x: x.isNotNull() & ((x - x) == 0))  # not so for NaN and infinite ones
    rows = rows.where(F.col(id_col).isNotNull() & finite & (F.size(vec_col) > 0))
    rows = rows.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vec_col).alias("vec"))
    return rows.where("label IS NOT NULL")


def dealt(rows: DataFrame, per_group: int, n: int) -> DataFrame:
    """Rows (``id, label, vec`` and other long columns) packed into matrices of about ``per_group`` rows,
    by label, then id: ``part, dim`` and the columns' bytes. Components are scaled and floored."""
    names = [c for c in rows.columns if c != "vec"]
    parts = max(1, -(-n // per_group))
    rows = rows.withColumn("dim", F.size("vec")).withColumn("part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(parts)))

    def pack(group: pa.Table) -> pa.Table:
        group = group.sort_by([("label", "ascending"), ("id", "ascending")])
        vec = group["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        # the floor of a single-precision number has no more digits than the number
        vec = np.floor(vec.astype(np.float64) * SCALE).astype(vec.dtype)
        out = {"part": group["part"][:1], "dim": group["dim"][:1]}
        out |= {c: pa.array([group[c].to_numpy().tobytes()], pa.binary()) for c in names}
        return pa.table(out | {"vec": pa.array([vec.tobytes()], pa.binary())})

    schema = "part long, dim int, " + ", ".join(f"{c} binary" for c in [*names, "vec"])
    return rows.groupBy("part", "dim").applyInArrow(pack, schema)


def _matrix(batch: pa.RecordBatch, at: int, prefix: str) -> dict[str, np.ndarray]:
    """One side's columns of a joined row."""
    size = batch.column("dim")[at].as_py()
    names = [n for n in batch.schema.names if n.startswith(prefix)]
    raw = {n[len(prefix) :]: batch.column(n)[at].as_buffer() for n in names}
    out = {n: np.frombuffer(b, np.int64) for n, b in raw.items() if n != "vec"}
    kind = np.float32 if raw["vec"].size == 4 * size * len(out["id"]) else np.float64
    return out | {"vec": whole(np.frombuffer(raw["vec"], kind).reshape(-1, size))}


def tiles(blocks: DataFrame, cells: DataFrame, n_cells: int, visit: Callable, keys: list[str], k: int) -> DataFrame:
    """Every block against every band of cells: ``keys..., id, score``. ``visit(block, cell)`` yields
    ``(key, scores, ids)`` for its tile, best first; of each key the best ``k`` of the band are returned."""
    last = -(-n_cells // BAND) - 1
    left = blocks.select("dim", F.col("part").alias("block"), *[F.col(c).alias(f"a_{c}") for c in blocks.columns[2:]])
    left = left.withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(last))))
    band = F.floor(F.col("part") / BAND).cast("int").alias("band")
    right = cells.select("dim", band, *[F.col(c).alias(f"c_{c}") for c in cells.columns[2:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block, heaps = None, None, {}

        def best() -> pa.RecordBatch:
            flat = [(*key, -i, s) for key, heap in heaps.items() for s, i in heap]
            columns = list(zip(*flat)) or [[]] * (len(keys) + 2)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [*keys, "id", "score"])

        for batch in batches:
            for at in range(batch.num_rows):
                place = tuple(batch.column(c)[at].as_py() for c in ("block", "dim", "band"))
                if place != now:
                    yield best()
                    now, block, heaps = place, _matrix(batch, at, "a_"), {}
                for key, scores, ids in visit(block, _matrix(batch, at, "c_")):
                    heap = heaps.setdefault(key, [])
                    for entry in zip(scores.tolist(), (-ids).tolist()):
                        if len(heap) < k:
                            heapq.heappush(heap, entry)
                        elif entry > heap[0]:
                            heapq.heapreplace(heap, entry)
        yield best()

    # merged by sorting, a block goes through all cells of its band, one after the other
    met = left.hint("merge").join(right, ["band", "dim"])
    return map_texts(met, run, ", ".join(f"{c} long" for c in [*keys, "id", "score"]))


def ranked(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The best ``k`` of each key, with their ``rank``."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


# --- the two passes ----------------------------------------------------------------------------


def same_label(k: int) -> Callable:
    """Of a tile, the best ``k`` rows of each anchor's label but those of its own id."""

    def visit(block: dict, cell: dict):
        for label in np.unique(block["label"]).tolist():
            mine = np.nonzero(block["label"] == label)[0]
            first, end = np.searchsorted(cell["label"], label), np.searchsorted(cell["label"], label, side="right")
            if first == end:
                continue
            ids, packed = cell["id"][first:end], Packed(cell["vec"][first:end], block["vec"][mine])
            for at in range(0, len(mine), TILE):
                some = mine[at : at + TILE]
                scores = packed.products(block["vec"][some])
                # a label's rows lie in order of their ids, so ties do
                order = np.argsort(-scores, axis=1, kind="stable")
                for anchor, s, o in zip(some.tolist(), scores, order):
                    o = o[ids[o] != block["id"][anchor]][:k]
                    yield (int(block["rid"][anchor]),), s[o], ids[o]

    return visit


def in_range(n_positives: int, k: int, low: int, high: int) -> Callable:
    """Of a tile, for each anchor and positive the best ``k`` rows of other labels in the range that
    the positive's score sets."""

    def visit(block: dict, cell: dict):
        by_id = np.argsort(cell["id"], kind="stable")
        ids, labels, packed = cell["id"][by_id], cell["label"][by_id], Packed(cell["vec"][by_id], block["vec"])
        for at in range(0, len(block["id"]), TILE):
            for anchor, scores in enumerate(packed.products(block["vec"][at : at + TILE]), at):
                positive = [int(block[f"s{p}"][anchor]) for p in range(n_positives)]
                ranges = [(-(-low * s // 100), high * s // 100) for s in positive]
                least, most = min(a for a, _ in ranges), max(b for _, b in ranges)
                some = np.nonzero((scores >= least) & (scores <= most) & (labels != block["label"][anchor]))[0]
                some = some[np.argsort(-scores[some], kind="stable")]
                down = -scores[some]
                for p, (a, b) in enumerate(ranges):
                    first = np.searchsorted(down, -b)
                    end = min(first + k, np.searchsorted(down, -a, side="right"))
                    if first < end:
                        yield (int(block["rid"][anchor]), p), scores[some[first:end]], ids[some[first:end]]

    return visit


def mine(
    rows: DataFrame,
    anchors: DataFrame,
    label: Column | str = "label",
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    n_positives: int = POSITIVES,
    n_negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
) -> DataFrame:
    """For each anchor and each of its ``n_positives`` best rows of its label, the ``n_negatives`` best
    rows of other labels that score ``low`` to ``high`` hundredths of the positive: ``anchor_id,
    positive_id, rank, negative_id, positive_score, negative_score``."""
    label = F.col(label) if isinstance(label, str) else label
    rows = cut(usable(rows, id_col, vec_col, label))
    anchors = cut(usable(anchors, id_col, vec_col, label).withColumn("rid", F.monotonically_increasing_id()))
    n, n_anchors = rows.count(), anchors.count()
    n_cells = max(1, -(-n // CELL_ROWS))
    cells = cut(dealt(rows, CELL_ROWS, n))

    found = tiles(dealt(anchors, BLOCK_ROWS, n_anchors), cells, n_cells, same_label(n_positives), ["anchor"], n_positives)
    positives = cut(ranked(found, ["anchor"], n_positives))
    # no row scores in the range of -1
    score = [F.coalesce(F.max(F.when(F.col("rank") == p + 1, F.col("score"))), F.lit(-1)).alias(f"s{p}") for p in range(n_positives)]
    scores = positives.groupBy("anchor").agg(*score).withColumnRenamed("anchor", "rid")
    second = dealt(cut(anchors.join(scores, "rid")), BLOCK_ROWS, n_anchors)
    found = tiles(second, cells, n_cells, in_range(n_positives, n_negatives, low, high), ["anchor", "place"], n_negatives)

    best = ranked(found, ["anchor", "place"], n_negatives).select(
        "anchor", "place", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    of = positives.select("anchor", (F.col("rank") - 1).cast("long").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    names = anchors.select(F.col("rid").alias("anchor"), F.col("id").alias("anchor_id"))
    out = best.join(of, ["anchor", "place"]).join(names, "anchor")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows, rows.where("vec_id % 100 = 0"), label)


OP12_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT a.rid, a.vec_id AS anchor_id, c.rid AS cid, c.vec_id, a.label = c.label AS same,
    CAST(list_inner_product(a.e, c.e) AS BIGINT) AS score
  FROM v a JOIN v c ON a.rid <> c.rid WHERE a.vec_id % 100 = 0
),
p AS (
  SELECT rid, cid, vec_id AS positive_id, score AS positive_score FROM s WHERE same AND vec_id <> anchor_id
  QUALIFY row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) <= 5
),
n AS (
  SELECT s.anchor_id, p.positive_id, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY s.rid, p.cid ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM p JOIN s ON s.rid = p.rid AND NOT s.same AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
