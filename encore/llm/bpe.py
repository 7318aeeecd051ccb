"""Byte-level BPE by prefix dynamic programming.

For every prefix of a piece there is exactly one token that can end its encoding: the one whose
token before it, the last token of the shorter prefix, may stand next to it. Storing that token per
prefix gives the encoding by walking back, makes appending exact (older prefixes never change), and
after an edit only the prefixes from the edit until the stored tokens agree again are computed anew.

Defined cases: a null text is empty and has no ids; a text of any length is encoded whole, piece by
piece; repeated rows and null row ids are kept; an empty table gives an empty result. Only the id
and text columns are read.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from encore.llm.common import map_texts, table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
# What a worker remembers at most; only its speed depends on these.
CACHED_CHUNKS = 400_000
CACHED_PAIRS = 600_000
SLICE_BYTES = 8 << 20  # text handed on per output batch

# Unicode white space, as the pattern's \s has it (Python's own \s also takes 0x1c-0x1f).
SPACE = "\t-\r \x85\xa0  -     　"
# A run without white space, with the space before it, holds whole matches of the pattern only; so
# do the runs of white space between. Chunks repeat a lot and can be remembered.
CHUNKS = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Vocabulary:
    """Ranks of byte tokens, and which two tokens may stand next to each other."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {rank: token for token, rank in ranks.items()}
        self.halves: dict[int, tuple[int, int]] = {}  # the last merge that makes a token
        self.pairs: dict[int, bool] = {}  # apart() by left << 32 | right
        self.longest = 1
        self.single = [ranks.get(bytes([b]), -1) for b in range(256)]
        self.endings = ahocorasick.Automaton()  # the tokens of several bytes that end at a byte, longest first
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) < 2:
                continue
            parts = self._merged(token, rank)
            if len(parts) != 2:
                continue  # merging never reaches it
            self.halves[rank] = (ranks[parts[0]], ranks[parts[1]])
            self.longest = max(self.longest, len(token))
            self.endings.add_word(token.decode("latin-1"), (rank, len(token)))
        self.endings.make_automaton()

    def _merged(self, token: bytes, below: int) -> list[bytes]:
        """The token's bytes after all merges of a rank under ``below``."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], below))
            if self.ranks.get(parts[best] + parts[best + 1], below) >= below:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def apart(self, a: int, b: int) -> bool:
        """Whether merging leaves the two tokens apart. Their last merges are undone, latest first;
        at no time may the tokens at the border have a merge that would have come earlier."""
        token, halves, ranks = self.token, self.halves, self.ranks
        next_merge = 1 << 60
        while True:
            across = ranks.get(token[a] + token[b])
            if across is not None and across < next_merge:
                return False
            made_a, made_b = a if a in halves else -1, b if b in halves else -1
            if made_a > made_b:
                next_merge, a = a, halves[a][1]
            elif made_b >= 0:
                # of equal merges the left one comes first, so one across the border comes before b
                next_merge, b = b + 1, halves[b][0]
            else:
                return True

    def fill(self, data: bytes, start: int, last: list[int]) -> None:
        """Sets the last token of the prefixes longer than ``start`` (``last`` holds the others). Where
        no token of several bytes fits, it is the byte itself."""
        pairs, known, single = self.pairs, self.pairs.get, self.single
        last.extend([-1] * (len(data) + 1 - len(last)))
        back = max(0, start - self.longest)
        for at, (t, n) in self.endings.iter(data[back:].decode("latin-1") if back else data.decode("latin-1")):
            end = back + at + 1
            if end <= start or last[end] >= 0:
                continue
            if n < end:
                before = last[end - n]
                if before < 0:
                    before = last[end - n] = single[data[end - n - 1]]
                key = before << 32 | t
                fits = known(key)
                if fits is None:
                    if len(pairs) >= CACHED_PAIRS:
                        pairs.clear()
                    fits = pairs[key] = self.apart(before, t)
                if not fits:
                    continue
            last[end] = t
        for end in range(start + 1, len(last)):
            if last[end] < 0:
                last[end] = single[data[end - 1]]


class Prefixes:
    """Encoding of a growing, editable byte string: the last token of each of its prefixes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", [-1]
        self.append(data)

    def append(self, more: bytes) -> None:
        old, self.data = len(self.data), self.data + more
        self.vocabulary.fill(self.data, old, self.last)

    def replace(self, start: int, stop: int, new: bytes) -> int:
        """Bytes ``start:stop`` become ``new``; returns how many prefixes were computed anew."""
        data = self.data[:start] + new + self.data[stop:]
        last, old, shift = self.last[: start + 1], self.last, len(new) - (stop - start)
        longest = self.vocabulary.longest
        end, changed = start, start + len(new)
        while end < len(data):
            step = min(len(data), end + longest)
            self.vocabulary.fill(data[:step], end, last)
            # once the last `longest` prefixes agree with the old ones, so do all later ones
            if step - longest > changed and last[step - longest : step] == old[step - longest - shift : step - shift]:
                last.extend(old[step - shift + 1 :])
                end = step
                break
            end = step
        self.data, self.last = data, last
        return end - start

    def ids(self) -> list[int]:
        out, end = [], len(self.data)
        while end:
            out.append(self.last[end])
            end -= len(self.vocabulary.token[self.last[end]])
        return out[::-1]


class Encoder:
    """Encodes texts the way the tiktoken library does, without special tokens."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        self.vocabulary = Vocabulary(read_ranks(path))
        self.pattern = regex.compile(pattern)
        self.pieces: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        known = self.pieces.get(piece)
        if known is None:
            if len(self.pieces) >= CACHED_CHUNKS:
                self.pieces.clear()
            data = piece.encode("utf-8", "replace")
            whole = self.vocabulary.ranks.get(data)
            ids = [whole] if whole is not None else Prefixes(self.vocabulary, data).ids()
            known = self.pieces[piece] = array("i", ids).tobytes()
        return known

    def _chunk(self, chunk: str) -> bytes:
        if len(self.chunks) >= CACHED_CHUNKS:
            self.chunks.clear()
        out = self.chunks[chunk] = b"".join(map(self._piece, self.pattern.findall(chunk)))
        return out

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of a text (int32)."""
        known = self.chunks
        parts = [known.get(c) or self._chunk(c) for c in CHUNKS.findall(text or "")]
        return np.frombuffer(b"".join(parts), dtype=np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.vocabulary.token.__getitem__, ids.tolist()))


@cache
def encoder(path: str, pattern: str) -> Encoder:
    """One encoder per worker process."""
    return Encoder(path, pattern)


def slices(batch: pa.RecordBatch, column: int = 1, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about ``limit`` bytes of text, one row at least."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        done = size[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(size, done + limit, side="right")))
        yield batch.slice(at, end - at)
        at = end


def encode(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    path: str | None = None,
    pattern: str = public_tokenizers.PATTERN,
    decoded: bool = False,
) -> DataFrame:
    """Rows ``(doc_id, ids array<int>)``; with ``decoded`` also the bytes the ids stand for."""
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for whole in batches:
            for b in slices(whole):
                ids = [enc.encode(t.as_py()) for t in b.column(1)]
                ends = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
                cols = [b.column(0), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(ids)))]
                if decoded:
                    cols.append(pa.array([enc.decode(i) for i in ids], pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "ids", "decoded"][: len(cols)])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, ids array<int>" + ", decoded binary" * decoded
    return map_texts(docs.select(id_col, text_col), run, schema)


def decode(rows: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Rows ``(doc_id, decoded binary)`` for rows ``(doc_id, ids)``; null ids give empty bytes."""
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, pattern)
        for b in batches:
            out = [enc.decode(np.array(i.as_py() or [], dtype=np.int32)) for i in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["doc_id", "decoded"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, decoded binary")


def op3_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = encode(table(spark, sf_dir, "documents"), decoded=True)
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
