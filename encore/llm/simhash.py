"""SimHash near-duplicates: Golay-code fuzzy keys, join, verification, components.

A 64-bit fingerprint is cut into four 16-bit segments. Each segment, padded to 23 bits, is decoded
with the perfect binary Golay code; a word three errors from its codeword also gets the codewords at
distance four. So a word has one or six codeword indices, and two words that differ in at most one
bit share an index. At most four differing bits over four segments (pigeonhole) leave either

* a segment without error, and among the other three one with at most one: the exact segment with an
  index of the other is a common key; or
* one error in every segment: then indices of the first two segments agree and every segment's
  parity is flipped; the parities up to complement go into the key.

Copies of a fingerprint are merged before keys are made. In a bucket every member is verified
against one centre (the fingerprint of most documents); only buckets that still mix components are
compared further, and there only members outside the centre's component against the bucket, with the
bit count as join condition, so that the pairs of a group are never emitted.

Defined cases: a null text counts as empty; a text without words has fingerprint zero and links like
any other; fewer words than a shingle form one shingle; a null id takes its component's smallest id;
repeated rows are kept; an empty table gives an empty result. Only id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations, permutations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from encore.llm.common import components, cut, map_texts, table

SHINGLE = 4
MAX_BITS = 4
GENERATOR = 0b101011100011  # fixed value: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1, the binary Golay code
CHUNK_SHINGLES = 200_000


# --- fingerprints -----------------------------------------------------------------------------


@cache
def _lanes() -> np.ndarray:
    """Byte -> its eight bits in the eight bytes of a word, for counting eight bits in one addition."""
    byte = np.arange(256, dtype=np.uint64)
    return sum(((byte >> np.uint64(b)) & np.uint64(1)) << np.uint64(8 * b) for b in range(8))


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the 64-bit ``hashes`` have each bit set (64 counts)."""
    lanes = _lanes()[hashes.astype("<u8").view(np.uint8).reshape(-1, 8)]
    total = np.zeros(64, np.int64)
    # a lane holds up to 255; sums of 255 rows are widened before they are added
    sums = np.add.reduceat(lanes, np.arange(0, len(lanes), 255), axis=0)
    total += np.ascontiguousarray(sums).astype("<u8").view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return total


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of a text over XXH64 (seed 42) of its word shingles, repeats included."""
    # bytes.lower() changes A-Z only and bytes.split() cuts at 0x20 and 0x09-0x0D only
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    if len(words) <= shingle:
        starts, stops = [0], [len(joined)]
    else:
        stops = (ends[shingle - 1 :] - 1).tolist()
        starts = [0, *ends[: len(words) - shingle].tolist()]
    total = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for i in range(0, len(starts), CHUNK_SHINGLES):
        part = [digest(joined[a:b], 42) for a, b in zip(starts[i : i + CHUNK_SHINGLES], stops[i : i + CHUNK_SHINGLES])]
        total += bit_counts(np.array(part, dtype=np.uint64))
    return int(np.packbits(total * 2 > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Rows ``(doc_id, rid, fp)``: ``fp`` holds the fingerprint's bits as a signed long, ``rid`` is the
    number that ``monotonically_increasing_id`` gives the row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py(), shingle) for t in b.column(1)), np.uint64, b.num_rows)
            cols = [b.column(0), b.column(2), pa.array(fp.view(np.int64))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "rid", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(id_col, text_col, F.monotonically_increasing_id().alias("rid"))
    return map_texts(rows, run, f"doc_id {kind}, rid long, fp long")


# --- Golay keys -------------------------------------------------------------------------------


def remainder(words: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit words by the generator: the syndrome."""
    r = words.copy()
    for bit in range(22, 10, -1):
        r = np.where((r >> bit) & 1, r ^ (GENERATOR << (bit - 11)), r)
    return r


@cache
def golay_indices(width: int = 16) -> np.ndarray:
    """For each word of ``width`` bits its six codeword indices (repeated where there is one)."""
    info = np.arange(4096, dtype=np.int64) << 11
    code = info | remainder(info)
    errors = np.array([sum(1 << b for b in c) for w in range(4) for c in combinations(range(23), w)], dtype=np.int64)
    leader = np.zeros(2048, np.int64)
    leader[remainder(errors)] = errors  # the code is perfect: each syndrome has one error of weight <= 3
    words = np.arange(1 << width, dtype=np.int64)
    error = leader[remainder(words)]
    near = words ^ error
    heavy = code[np.bitwise_count(code) == 7]
    out = np.repeat(near[:, None], 6, axis=1)
    for e in np.unique(error[np.bitwise_count(error) == 3]):
        others = heavy[(heavy & e) == e]  # the five codewords of weight seven that hold the three errors
        at = error == e
        out[at, 1:] = near[at, None] ^ others[None, :]
    return (out >> 11).astype(np.int64)


def golay_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(keys, row)``: the distinct keys of each fingerprint, ``row`` its position in ``fp``."""
    table16 = golay_indices()
    segment = [((fp >> np.uint64(16 * s)) & np.uint64(0xFFFF)).astype(np.int64) for s in range(4)]
    index = [table16[s] for s in segment]
    row = np.arange(len(fp))
    keys, rows = [], []

    def add(kind: int, value: np.ndarray) -> None:
        value = np.sort(value | (kind << 40), axis=1)
        new = np.ones(value.shape, bool)
        new[:, 1:] = value[:, 1:] != value[:, :-1]
        keys.append(value[new])
        rows.append(np.broadcast_to(row[:, None], value.shape)[new])

    for kind, (exact, fuzzy) in enumerate(permutations(range(4), 2)):
        add(kind, (segment[exact][:, None] << 12) | index[fuzzy])
    parity = sum((np.bitwise_count(s).astype(np.int64) & 1) << i for i, s in enumerate(segment))
    parity = np.minimum(parity, parity ^ 15)
    both = (index[0][:, :, None] << 12 | index[1][:, None, :]).reshape(len(fp), 36)
    add(12, parity[:, None] << 24 | both)
    return np.concatenate(keys), np.concatenate(rows)


def keyed(fps: DataFrame) -> DataFrame:
    """Rows ``(key, fp, n)`` for fingerprints ``(fp, n)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                fp, n = (part.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                key, row = golay_keys(fp.view(np.uint64))
                yield pa.RecordBatch.from_pydict({"key": key, "fp": fp[row], "n": n[row]})

    return fps.select("fp", "n").mapInArrow(run, "key long, fp long, n long")


# --- links and groups -------------------------------------------------------------------------


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints ``(fp, n)`` that connect exactly those chains
    which all pairs within ``max_bits`` (at most four) would."""
    if not 0 <= max_bits <= 4:
        raise ValueError("the keys are complete up to four differing bits")

    def close(a: str, b: str):
        return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= max_bits

    keys = keyed(fps)
    centre = keys.groupBy("key").agg(F.max(F.struct("n", "fp")).alias("c"), F.count("*").alias("members"))
    # stored, so that the join reads two plain shuffles, of which a hot key's partition can be split
    centre = cut(centre.where("members > 1").select("key", F.col("c.fp").alias("centre"), "members"))
    buckets = cut(keys.join(centre, "key").select("key", "fp", "centre", "members"))
    stars = buckets.where(close("fp", "centre") & (F.col("fp") != F.col("centre")))
    stars = cut(stars.select(F.col("fp").alias("a"), F.col("centre").alias("b")).distinct())
    # members beyond the centre's reach: compared with their bucket unless already connected
    root = components(stars)
    large = buckets.where("members > 2")
    part = large.join(root.withColumnRenamed("node", "fp"), "fp", "left")
    part = part.withColumn("part", F.coalesce("root", "fp")).drop("root")
    heart = root.select(F.col("node").alias("centre"), F.col("root").alias("heart"))
    part = part.join(heart, "centre", "left").withColumn("heart", F.coalesce("heart", "centre"))
    part = cut(part.select("key", "fp", "part", "heart"))
    left = part.where("part <> heart").select("key", F.col("fp").alias("a"), F.col("part").alias("pa"))
    mixed = part.select("key", F.col("fp").alias("b"), F.col("part").alias("pb"))
    more = left.join(mixed, (left["key"] == mixed["key"]) & (F.col("pa") != F.col("pb")) & close("a", "b"))
    return stars.unionByName(more.select("a", "b").distinct())


def near_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS
) -> DataFrame:
    """One row per input row: ``doc_id``, ``fingerprint`` (16 hex digits), ``component_id`` (the
    smallest id reachable over links of at most ``max_bits`` differing bits), ``kept`` (whether the
    row is the first of its component) and ``rid`` (the row's number)."""
    rows = cut(fingerprints(docs, id_col, text_col, shingle))
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "rid")
    fps = cut(rows.groupBy("fp").agg(F.count("*").alias("n"), F.min(place).alias("least")))
    root = components(links(fps, max_bits)).withColumnRenamed("node", "fp")
    named = fps.join(root, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    # stored, so that the join reads plain shuffles and the partition of a large component can be split
    least = cut(named.groupBy("root").agg(F.min("least").alias("first")))
    named = named.join(least, "root").select("fp", "first")
    return rows.join(named, "fp").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("first.doc_id").alias("component_id"),
        (F.col("rid") == F.col("first.rid")).alias("kept"),
        "rid",
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each component the row with the smallest id, all columns kept. ``docs`` is read twice and
    must be stored or otherwise the same both times, since rows are told apart by their number."""
    gone = near_groups(docs, id_col, text_col).where("not kept").select(F.col("rid").alias("__rid"))
    rows = docs.withColumn("__rid", F.monotonically_increasing_id())
    return rows.join(gone, "__rid", "left_anti").select(docs.columns)


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents")).drop("rid", "kept")
