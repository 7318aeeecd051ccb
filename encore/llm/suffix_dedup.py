"""Removal of repeated byte passages by longest-previous-factor arrays.

A window of ``length`` bytes repeats if it also starts elsewhere. In the order of all suffixes,
truncated to ``length`` bytes and with ties in text order, equal windows are neighbours: the previous
smaller position of a suffix tells an earlier match, the next one a later match. Two things make that
order fit Spark:

1. Windows are dealt into zones. A window's anchor is the leftmost smallest of the hashes of its
   ``gram``-byte pieces, so equal windows have equal anchors at equal offsets. A run of windows with
   the same anchor is a zone; its key is the anchor's hash, its content the bytes its windows cover.
   There is about one zone per 70 bytes. Counts per key (with partial aggregation) settle zones whose
   key is unique (no window repeats) and those whose key has a single content (all windows do).
2. For keys with several contents one copy of each is fetched and the suffix order of a bounded batch
   of keys is built by prefix doubling; windows with the same key never leave their batch. Keys with
   more than ``BATCH_CONTENTS`` contents are settled without order: their windows are counted by
   their 128-bit hashes, again with partial aggregation, so no key is ever gathered in one task.

``keep="none"`` removes every byte of a repeated window, ``keep="first"`` spares the earliest copy
in reading order (row, position). Hashes of 64 bits name contents within a key, and pairs of them
windows.

Defined cases: a null text is empty; matches never cross texts; texts shorter than a window lose
nothing; equal rows, null ids and repeated ids are texts of their own; texts longer than ``CHUNK``
are scanned in overlapping chunks; an empty table gives an empty result. Only the id and text
columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from encore.llm.common import map_texts, stored, table

LENGTH = 200
GRAM = 64
CHUNK = 1 << 17  # bytes of text scanned at a time; what is computed per byte then stays in the cache
BATCH_BYTES = 1 << 20  # content sorted at a time, in some 40 times that much memory of each Python worker
BATCH_CONTENTS = 4096  # contents of a key that one suffix order takes

_ODD = np.uint64(0x9E3779B97F4A7C15)
_SPREAD = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


# --- hashes of all pieces of a text ---------------------------------------------------------------


@cache
def _byte_values(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64)


@cache
def _powers(n: int, inverse: bool) -> np.ndarray:
    with np.errstate(over="ignore"):
        steps = np.full(n, _INVERSE if inverse else _ODD, np.uint64)
        steps[0] = 1
        return np.cumprod(steps, dtype=np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))


class Hashes:
    """Hashes of any pieces of a byte string, from sums of powers."""

    def __init__(self, data: np.ndarray, seed: int = 1):
        size = 1 << max(12, int(len(data)).bit_length())
        self.back = _powers(size, True)
        with np.errstate(over="ignore"):
            sums = np.cumsum(_byte_values(seed)[data] * _powers(size, False)[: len(data)], dtype=np.uint64)
        self.sums = np.concatenate([np.zeros(1, np.uint64), sums])

    def order(self, gram: int) -> np.ndarray:
        """For every piece of ``gram`` bytes, 32 hash bits above the 32 bits of its place."""
        n = len(self.sums) - gram
        with np.errstate(over="ignore"):
            h = (self.sums[gram:] - self.sums[:n]) * self.back[:n] * _SPREAD
        return (h & ~np.uint64(0xFFFFFFFF)) | np.arange(n, dtype=np.uint64)

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return _mixed((self.sums[stop] - self.sums[start]) * self.back[start])


# --- zones ----------------------------------------------------------------------------------------


def zones(data: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """``(start, windows, key, content)`` of the zones of joined texts that end at ``ends``: a zone's
    windows start at ``start, start + 1, ...``; key and content are hashes."""
    n = len(data) - length + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none.view(np.uint64), none.view(np.uint64)
    hashes = Hashes(data)
    least = hashes.order(gram)  # the smallest is the leftmost of the smallest hashes
    span, have = length - gram + 1, 1
    while 2 * have <= span:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    least = np.minimum(least[:n], least[span - have : span - have + n])
    anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    last_fit = ends - length  # the last window of each text
    inside = np.arange(n) <= np.repeat(last_fit, np.diff(ends, prepend=0))[:n]
    new = np.ones(n, bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | ~inside[:-1]
    start = np.flatnonzero(new & inside)
    if not len(start):
        return none, none, none.view(np.uint64), none.view(np.uint64)
    # a zone ends before the next start, or where windows no longer fit in the text
    stop = np.append(start[1:], n)
    stop = np.minimum(stop, last_fit[np.searchsorted(ends, start, side="right")] + 1)
    key = hashes.of(anchor[start], anchor[start] + gram)
    # content: the covered bytes, and where the anchor lies in them
    with np.errstate(over="ignore"):
        content = _mixed(hashes.of(start, stop + length - 1) + (anchor[start] - start).astype(np.uint64))
    return start, stop - start, key, content


def runs_of_text(batch: pa.RecordBatch, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The binary column 1 of a batch in joined runs of about ``CHUNK`` bytes: ``(data, ends, row,
    shift)``; text ``i`` of a run is part of row ``row[i]`` from byte ``shift[i]`` on. A longer text
    comes in chunks that share ``length - 1`` bytes, so each window lies in one of them."""
    held: list[np.ndarray] = []
    row: list[int] = []
    shift: list[int] = []
    total = 0

    def flush():
        nonlocal total
        out = np.concatenate(held), np.cumsum([len(h) for h in held]), np.array(row), np.array(shift)
        held.clear(), row.clear(), shift.clear()
        total = 0
        return out

    for r, value in enumerate(batch.column(1)):
        data = np.frombuffer(value.as_buffer() or b"", np.uint8)
        for at in range(0, max(1, len(data) - length + 1), CHUNK):
            part = data[at : at + CHUNK + length - 1]
            if len(part) >= length:
                held.append(part), row.append(r), shift.append(at)
                total += len(part)
            if total >= CHUNK:
                yield flush()
    if held:
        yield flush()


# --- suffix order of a batch of contents ---------------------------------------------------------


def window_ranks(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Ranks of the windows at ``starts`` in the order of their first ``length`` bytes (equal windows
    have equal ranks), by prefix doubling."""
    n = len(data)
    rank = np.zeros(n, np.uint64)  # ranks begin as the first eight bytes
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    for i in range(8):
        rank <<= np.uint64(8)
        rank |= padded[i : i + n]
    have = min(8, length)
    if have < 8:
        rank >>= np.uint64(8 * (8 - have))
    while True:
        number = _dense(rank)
        if have >= length:
            return number[starts].astype(np.int64)
        step = min(have, length - have)
        rank[:] = number
        rank <<= np.uint64(32)
        rank[: n - step] |= number[step:]
        have += step


def _dense(rank: np.ndarray) -> np.ndarray:
    """Numbers from 0 in the order of the ranks, equal ones for equal ranks; as ``np.unique`` does, in half the memory."""
    order = np.argsort(rank)
    ordered = rank[order]
    new = np.zeros(len(rank), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    del ordered
    number = np.empty(len(rank), np.uint32)
    number[order] = np.cumsum(new, dtype=np.uint32)
    return number


def longest_previous_factors(rank: np.ndarray, position: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For windows with ranks in the truncated suffix order: whether an earlier and whether a later
    position has the same window. With ties in text order the suffix before a window in the order is
    its previous smaller position if it has the same rank, and the one after it its next."""
    order = np.lexsort((position, rank))
    r = rank[order]
    same = np.zeros(len(r) + 1, bool)
    same[1:-1] = r[1:] == r[:-1]
    earlier, later = np.empty(len(r), bool), np.empty(len(r), bool)
    earlier[order], later[order] = same[:-1], same[1:]
    return earlier, later


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """Runs of true values as ``(from, to)``."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def judge(pieces: list[bytes], rid: np.ndarray, start: np.ndarray, length: int) -> list[tuple[list, list]]:
    """For contents that hold all copies of their keys once: runs of windows with an earlier match,
    and with any."""
    data = np.frombuffer(b"".join(pieces), np.uint8)
    size = np.array([len(p) for p in pieces])
    begin = np.cumsum(size) - size
    windows = size - length + 1
    owner = np.repeat(np.arange(len(pieces)), windows)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    rank = window_ranks(data, begin[owner] + offset, length)
    # positions in the order of all texts
    order = np.lexsort((start[owner] + offset, rid[owner]))
    position = np.empty(len(order), np.int64)
    position[order] = np.arange(len(order))
    earlier, later = longest_previous_factors(rank, position)
    cut_at = np.cumsum(windows)[:-1]
    return [(runs(e), runs(a)) for e, a in zip(np.split(earlier, cut_at), np.split(earlier | later, cut_at))]


# --- Spark ---------------------------------------------------------------------------------------

RUNS = "array<struct<from:int,to:int>>"
_RUN = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))


def _run_array(lists: list[list[tuple[int, int]]]) -> pa.Array:
    return pa.array([[{"from": a, "to": b} for a, b in r] for r in lists], _RUN)


def shared_zones(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """``key, content, rid, start, windows, single``: zones whose key occurs more than once;
    ``single`` if all of them have one content. ``texts`` has ``rid`` and ``text`` (binary)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rid = b.column(0).to_numpy()
            for data, ends, row, shift in runs_of_text(b, length):
                start, n, key, content = zones(data, ends, length, gram)
                which = np.searchsorted(ends, start, side="right")
                begin = np.concatenate([[0], ends[:-1]])[which]
                yield pa.RecordBatch.from_pydict(
                    {
                        "key": key.view(np.int64),
                        "content": content.view(np.int64),
                        "rid": rid[row[which]],
                        "start": (start - begin + shift[which]).astype(np.int64),
                        "windows": n.astype(np.int32),
                    }
                )

    found = map_texts(texts.select("rid", "text"), scan, "key long, content long, rid long, start long, windows int")
    per_key = found.groupBy("key").agg(F.count("*").alias("n"), F.min("content").alias("lo"), F.max("content").alias("hi"))
    # stored, so that the join reads two plain shuffles, of which a hot key's partition can be split
    per_key = stored(per_key.where("n > 1").select("key", (F.col("lo") == F.col("hi")).alias("single")))
    return found.join(per_key, "key")


def pieces(copies: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """The bytes of zones: ``key, content, rid, start, piece``."""

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                rid, text = b.column(0)[row].as_py(), b.column(1)[row].as_buffer()
                wanted = b.column(2)[row].values
                key, content, start, windows = (wanted.field(i).to_numpy() for i in range(4))
                held = [text[a : a + n + length - 1].to_pybytes() for a, n in zip(start.tolist(), windows.tolist())]
                yield pa.RecordBatch.from_pydict(
                    {
                        "key": key,
                        "content": content,
                        "rid": np.full(len(key), rid, np.int64),
                        "start": start,
                        "piece": pa.array(held, pa.binary()),
                    }
                )

    wanted = copies.groupBy("rid").agg(F.collect_list(F.struct("key", "content", "start", "windows")).alias("wanted"))
    both = texts.join(wanted, "rid").select("rid", "text", "wanted")
    return map_texts(both, fetch, "key long, content long, rid long, start long, piece binary")


def judged(copies: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """``key, content, earlier, any`` for the copies of keys with several contents, where a window
    repeats; ``earlier`` and ``any`` are runs of windows of the zone."""

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settle(rows: list[tuple]) -> pa.RecordBatch:
            key, content, rid, start, piece = (list(c) for c in zip(*rows))
            out = judge(piece, np.array(rid), np.array(start), length)
            return pa.RecordBatch.from_pydict(
                {
                    "key": pa.array(key, pa.int64()),
                    "content": pa.array(content, pa.int64()),
                    "earlier": _run_array([e for e, _ in out]),
                    "any": _run_array([a for _, a in out]),
                }
            )

        rows: list[tuple] = []
        held = 0
        for b in batches:
            for row in zip(*[c.to_pylist() for c in b.columns]):
                if held >= BATCH_BYTES and row[0] != rows[-1][0]:
                    yield settle(rows)
                    rows, held = [], 0
                rows.append(row)
                held += len(row[4])
        if rows:
            yield settle(rows)

    def window_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, content, rid, start, piece in zip(*[c.to_pylist() for c in b.columns]):
                data = np.frombuffer(piece, np.uint8)
                at = np.arange(len(data) - length + 1)
                h = [Hashes(data, seed).of(at, at + length).view(np.int64) for seed in (1, 2)]
                yield pa.RecordBatch.from_pydict(
                    {
                        "key": np.full(len(at), key, np.int64),
                        "content": np.full(len(at), content, np.int64),
                        "rid": np.full(len(at), rid, np.int64),
                        "start": start + at,
                        "w": at.astype(np.int32),
                        "h1": h[0],
                        "h2": h[1],
                    }
                )

    schema = f"key long, content long, earlier {RUNS}, any {RUNS}"
    large = copies.groupBy("key").count().where(F.col("count") > BATCH_CONTENTS).select("key")
    held = pieces(copies, texts, length)
    small = held.join(large, "key", "left_anti").select("key", "content", "rid", "start", "piece")
    small = small.repartition("key").sortWithinPartitions("key").mapInArrow(sort, schema)
    # keys of very many contents: their windows are counted, which needs no key in one place
    hashed = held.join(large, "key", "left_semi").select("key", "content", "rid", "start", "piece")
    hashed = hashed.mapInArrow(window_hashes, "key long, content long, rid long, start long, w int, h1 long, h2 long")
    place = F.struct("rid", "start")
    counted = hashed.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1")
    run = F.struct(F.col("w").alias("from"), (F.col("w") + 1).alias("to"))
    hot = hashed.join(counted, ["h1", "h2"]).groupBy("key", "content").agg(
        F.collect_list(F.when(place != F.col("first"), run)).alias("earlier"), F.collect_list(run).alias("any")
    )
    return small.unionByName(hot.select("key", "content", F.col("earlier").cast(RUNS), F.col("any").cast(RUNS))).where(
        F.size("any") > 0
    )


def numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text")
    return docs.select(F.col(id_col).alias("doc_id"), text, F.monotonically_increasing_id().alias("rid"))


def repeated_spans(texts: DataFrame, length: int, gram: int, keep: str) -> DataFrame:
    """``rid, spans``: byte spans to remove, as they come from the zones (they may overlap)."""
    shared = stored(shared_zones(texts, length, gram))
    copies = shared.groupBy("key", "content").agg(
        F.min(F.struct("rid", "start", "windows", "single")).alias("c"), F.count("*").alias("n")
    )
    copies = stored(copies.select("key", "content", "n", "c.*"))
    found = judged(copies.where("not single"), texts, length)
    known = copies.select("key", "content", "n", F.col("rid").alias("rid1"), F.col("start").alias("start1"))
    rows = shared.join(known, ["key", "content"])
    if keep == "none":
        whole, part = F.col("n") > 1, F.col("any")
    else:
        whole, part = (F.col("rid") != F.col("rid1")) | (F.col("start") != F.col("start1")), F.col("earlier")
    # Only one zone of a content can still need its runs. The others, of which there may be very
    # many alike, take a key of their own that meets nothing.
    apart = F.xxhash64("rid", "start")
    rows = rows.select(
        "rid", "start", "windows", whole.alias("whole"),
        F.when(whole, apart).otherwise(F.col("key")).alias("key"), F.when(whole, apart).otherwise(F.col("content")).alias("content"),
    )
    rows = rows.join(found, ["key", "content"], "left")
    whole = F.col("whole")
    all_ = F.array(F.struct(F.lit(0).alias("from"), F.col("windows").alias("to"))).cast(RUNS)
    rows = rows.select("rid", "start", F.explode(F.when(whole, all_).otherwise(part)).alias("r"))
    span = F.struct((F.col("start") + F.col("r.from")).alias("from"), (F.col("start") + F.col("r.to") - 1 + length).alias("to"))
    return rows.groupBy("rid").agg(F.collect_list(span).alias("spans"))


def merged(start: np.ndarray, stop: np.ndarray) -> list[tuple[int, int]]:
    """Spans joined where they overlap or touch."""
    if not len(start):
        return []
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(stop[order])
    new = np.append(True, start[1:] > reach[:-1])
    first = np.flatnonzero(new)
    return list(zip(start[first].tolist(), reach[np.append(first[1:] - 1, len(start) - 1)].tolist()))


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    gram: int | None = None,
    keep: str = "first",
) -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, spans, kept``: removed byte spans and the bytes that
    are left. ``docs`` is read several times and must be stored or otherwise the same each time."""
    if keep not in ("first", "none"):
        raise ValueError("keep is 'first' or 'none'")
    gram = gram or min(GRAM, max(1, length // 3))
    texts = numbered(docs, id_col, text_col)
    spans = repeated_spans(texts, length, gram, keep)
    kind = docs.schema[id_col].dataType.simpleString()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, gone, kept = [], [], []
            for row in range(b.num_rows):
                text = b.column(1)[row].as_py()
                s = b.column(2)[row].values
                cuts_ = merged(s.field(0).to_numpy(), s.field(1).to_numpy()) if s is not None and len(s) else []
                edges = [0, *[e for c in cuts_ for e in c], len(text)]
                sizes.append(len(text))
                gone.append(cuts_)
                kept.append(b"".join(text[x:y] for x, y in zip(edges[::2], edges[1::2])) if cuts_ else text)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.array([[{"from": x, "to": y} for x, y in g] for g in gone], pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))),
                    pa.array(kept, pa.binary()),
                ],
                ["doc_id", "n_bytes", "spans", "kept"],
            )

    rows = texts.join(spans, "rid", "left").select("doc_id", "text", "spans")
    schema = f"doc_id {kind}, n_bytes long, spans array<struct<from:long,to:long>>, kept binary"
    return map_texts(rows, apply, schema)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = remove_repeats(table(spark, sf_dir, "documents"), keep="none")
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["to"] - s["from"])
    return rows.select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
