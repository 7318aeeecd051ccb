"""Nearest neighbours by a block matrix join.

Candidate rows are dealt into cells of about ``CELL_ROWS`` rows and queries into blocks; every query
block is sent to every cell (the query set is stated and far smaller than the table, and all pairs of
blocks are the work itself). In a tile both sides are matrices: the product of the int8-quantised
vectors, scaled back, gives every inner product with an error bound, from the vectors' norms and the
norms of what rounding took away. Only pairs whose upper bound reaches the k-th best lower bound, and
the worst score in the query's heap, are computed again in double precision from the original
vectors and pushed on the heap. The cells' heaps are merged by rank. So the result is exact.

Defined cases: vectors that are null, empty, zero, or hold a null or non-finite component take no
part, as query or candidate; all others do, of any magnitude; vectors of different lengths never meet; rows with the query's own id
are no candidates; a query with fewer than ``k`` candidates returns them all; ties go to the smaller
id; repeated rows count as rows; an empty table gives an empty result. Only the id and vector
columns are read; rows with a null id take no part.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from encore.llm.common import cut, table

K = 20
CELL_ROWS = 4096
BLOCK_ROWS = 512
TILE = 128  # queries per product


def usable(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    v = F.col(vec_col)
    # NaN fails the comparison with itself minus itself; an infinite value makes that NaN
    finite = F.forall(v, lambda x: x.isNotNull() & ((x - x) == 0))
    rows = rows.where(F.col(id_col).isNotNull() & finite & F.exists(v, lambda x: x != 0))
    return rows.select(F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("vec"))


def dealt(rows: DataFrame, per_group: int, n: int) -> DataFrame:
    """Rows packed into matrices: ``part, dim, ids, rids, vecs`` (binary), about ``per_group`` rows each."""
    parts = max(1, -(-n // per_group))
    rows = rows.withColumn("rid", F.monotonically_increasing_id()).withColumn("dim", F.size("vec"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("rid"), F.lit(parts)))

    def pack(group: pa.Table) -> pa.Table:
        vec = group["vec"].combine_chunks()
        return pa.table(
            {
                "part": group["part"][:1],
                "dim": group["dim"][:1],
                "ids": pa.array([group["id"].to_numpy().tobytes()], pa.binary()),
                "rids": pa.array([group["rid"].to_numpy().tobytes()], pa.binary()),
                "vecs": pa.array([vec.flatten().to_numpy(zero_copy_only=False).tobytes()], pa.binary()),
            }
        )

    return rows.groupBy("part", "dim").applyInArrow(pack, "part long, dim int, ids binary, rids binary, vecs binary")


class Quantised:
    """int8 form of the rows of a matrix, with what is needed to bound its errors. Every row is first
    scaled by a power of two to components below 1, so that no norm overflows."""

    def __init__(self, x: np.ndarray):
        self.exponent = np.frexp(np.abs(x).max(axis=1))[1]
        x = np.ldexp(x, -self.exponent[:, None])
        self.scale = np.abs(x).max(axis=1) / 127
        self.codes = np.rint(x / self.scale[:, None]).astype(np.int8)
        back = self.codes * self.scale[:, None]
        self.rounding = np.linalg.norm(x - back, axis=1)
        self.norm = np.linalg.norm(x, axis=1)
        self.back_norm = np.linalg.norm(back, axis=1)


def bounds(q: Quantised, c: Quantised, rows: slice) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products of some queries with all candidates, and how far they may be off."""
    # sums of products of int8 are whole numbers that single precision holds up to 2^24
    kind = np.float32 if q.codes.shape[1] * 127 * 127 < 1 << 24 else np.float64
    whole = q.codes[rows].astype(kind) @ c.codes.T.astype(kind)
    guess = whole.astype(np.float64) * q.scale[rows, None] * c.scale[None, :]
    off = q.back_norm[rows, None] * c.rounding[None, :] + q.rounding[rows, None] * c.norm[None, :]
    off = off * (1 + 1e-9) + 1e-12 * q.norm[rows, None] * c.norm[None, :]
    power = q.exponent[rows, None] + c.exponent[None, :]
    # the products of such pairs may leave the range of doubles: nothing is known of what they add up to
    loose = (power > 950) | (power < -900)
    power = np.where(loose, 0, power)
    return np.where(loose, 0.0, np.ldexp(guess, power)), np.where(loose, np.inf, np.ldexp(off, power))


def search_tile(
    queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int
) -> list[list[tuple[float, int]]]:
    """For each query the best ``k`` of the rows as ``(score, -id)``, in a heap. A score that is not a
    number (sums of infinite products of both signs) is above all others, as in SQL."""
    q, c = Quantised(queries), Quantised(rows)
    heaps: list[list[tuple[float, int]]] = [[] for _ in queries]
    for at in range(0, len(queries), TILE):
        part = slice(at, min(at + TILE, len(queries)))
        guess, off = bounds(q, c, part)
        own = query_ids[part, None] == row_ids[None, :]
        low = np.where(own, -np.inf, guess - off)
        kth = np.partition(low, -k, axis=1)[:, -k] if low.shape[1] > k else np.full(len(low), -np.inf)
        one, two = np.nonzero((guess + off >= kth[:, None]) & ~own)
        for i in range(0, len(one), 20_000):
            a, b = one[i : i + 20_000] + at, two[i : i + 20_000]
            # added in the order of the components, so that equal vectors get equal scores everywhere
            with np.errstate(over="ignore", invalid="ignore"):
                score = np.cumsum(queries[a] * rows[b], axis=1)[:, -1]
            no_number = np.isnan(score)
            keys = zip(no_number.tolist(), np.where(no_number, 0.0, score).tolist(), (-row_ids[b]).tolist())
            for query, entry in zip(a.tolist(), keys):
                heap = heaps[query]
                if len(heap) < k:
                    heapq.heappush(heap, entry)
                elif entry > heap[0]:
                    heapq.heapreplace(heap, entry)
    return [[(math.nan if no_number else s, row) for no_number, s, row in heap] for heap in heaps]


def nearest(queries: DataFrame, rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K) -> DataFrame:
    """The ``k`` rows of the largest inner product for each query: ``query_id, rank, vec_id, score``."""
    queries, rows = cut(usable(queries, id_col, vec_col)), cut(usable(rows, id_col, vec_col))
    n = rows.count()
    cells = max(1, -(-n // CELL_ROWS))
    cell = dealt(rows, CELL_ROWS, n).withColumnRenamed("part", "cell")
    block = dealt(queries, BLOCK_ROWS, queries.count()).select(
        "dim", *[F.col(c).alias(f"q_{c}") for c in ("ids", "rids", "vecs")],
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cells - 1).cast("long"))).alias("cell"),
    )

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                t = {name: batch.column(name)[at].as_py() for name in batch.schema.names}
                ids, rids, row_ids = (np.frombuffer(t[c], np.int64) for c in ("q_ids", "q_rids", "ids"))
                q, r = (np.frombuffer(t[c], np.float64).reshape(-1, t["dim"]) for c in ("q_vecs", "vecs"))
                heaps = search_tile(q, ids, r, row_ids, k)
                size = [len(h) for h in heaps]
                flat = [x for h in heaps for x in h]
                yield pa.RecordBatch.from_pydict(
                    {
                        "query_id": pa.array(np.repeat(ids, size), pa.int64()),
                        "rid": pa.array(np.repeat(rids, size), pa.int64()),
                        "vec_id": pa.array([-i for _, i in flat], pa.int64()),
                        "score": pa.array([s for s, _ in flat], pa.float64()),
                    }
                )

    found = block.join(cell, ["cell", "dim"]).mapInArrow(tiles, "query_id long, rid long, vec_id long, score double")
    order = Window.partitionBy("query_id", "rid").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows.where("vec_id % 20 = 0"), rows)


OP2_SQL = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0
),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
