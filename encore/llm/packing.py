"""Order-preserving packing of documents into training sequences.

The documents of a task, in the order they are read, form one token stream (each document closed by
a separator). The stream is taken in blocks of whole documents, and a dynamic program chooses the
window cuts of a block: a window holds at most ``length`` tokens, costs its padding (none at a power
of two) and, where it ends inside a document, a penalty that is larger within a sentence. For a cut
at ``c`` the best earlier cut minimises ``cost + position``, which a monotone queue yields; the few
windows of a power of two are tried beside it. No shuffle is needed, and every id lies in one piece.

Defined cases: a null or empty text is one separator; a text of any length is packed whole; null and
repeated ids are kept as they are; an empty table gives an empty result. Only the id and text
columns are read.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from tokenizers import Tokenizer

from encore.llm.bpe import SPACE, slices
from encore.llm.common import map_texts, table

VOCABULARY = "word_bpe_49k.json"
LENGTH = 4096
SEPARATOR = 2
SENTENCE_CUT = 24  # a cut between two sentences of a document weighs as much as so much padding
WORD_CUT = 256  # a cut within a sentence
WINDOW_COST = 4  # a further sequence
BLOCK_WINDOWS = 128  # a block closes with the document that reaches so many windows

# The tokenizer splits at white space and drops it, so words between it are encoded independently
# and can be remembered. 0x1c-0x1f are no white space to the tokenizer, though str.split() thinks so.
ODD_SPACE = re.compile("[\x1c-\x1f]")
WORDS = re.compile(f"[^{SPACE}]+")
PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # ASCII without the apostrophe, which may begin a token


class Remembered(dict):
    """A bounded memory of what ``make`` gives for a key. Two generations: at the limit the entries
    become the old ones and the former old ones go, unless they were asked for again since."""

    limit = 0

    def __init__(self):
        self.old: dict[str, bytes] = {}

    def __missing__(self, key: str) -> bytes:
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        self[key] = found
        return found

    def trim(self) -> None:
        if len(self) > self.limit:
            self.old = dict(self)
            self.clear()


class Stems(Remembered):
    """Ids of words without closing punctuation, as bytes; the tokenizer is asked once.

    A word of Latin letters passes the normaliser as its lower case and the splitter in one piece,
    so the vocabulary's merges are applied to it directly (in the byte alphabet they are written in).
    """

    limit = 450_000

    def __init__(self, tokenizer: Tokenizer):
        super().__init__()
        self.tokenizer = tokenizer
        self.merges = tokenizer.model
        # the byte alphabet: printable Latin-1 stands for itself, other bytes for 256, 257, ...
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        other = [b for b in range(256) if b not in plain]
        self.letters = {**{b: chr(b) for b in plain}, **{b: chr(256 + i) for i, b in enumerate(other)}}

    def make(self, stem: str) -> bytes:
        if stem.isalpha() and (stem.isascii() or (max(stem) < "\u0180" and "\u0130" not in stem)):
            word = stem.lower()
            if not word.isascii():
                word = "".join(map(self.letters.__getitem__, word.encode()))
            ids = [t.id for t in self.merges.tokenize(word)]
        else:
            ids = self.tokenizer.encode(stem, add_special_tokens=False).ids
        return array("i", ids).tobytes()


class Words(Remembered):
    """Ids of whole words, as bytes."""

    limit = 700_000

    def __init__(self, stems: Stems):
        super().__init__()
        self.stems = stems

    def make(self, word: str) -> bytes:
        stem, tail = parts(word)
        return self.stems[stem] + self.stems[tail] if tail else self.stems[stem]


class WordTokenizer:
    """Ids of whole texts by a ``tokenizers`` file, remembered word by word."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.stems = Stems(self.tokenizer)
        self.words = Words(self.stems)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends_sentence = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            self.ends_sentence[i] = bool(re.search(r"[.!?][^\w]*(</w>)$", token))

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of a text (int32)."""
        text = text or ""
        words = WORDS.findall(text) if ODD_SPACE.search(text) else text.split()
        self.words.trim()
        self.stems.trim()
        return np.frombuffer(b"".join(map(self.words.__getitem__, words)), np.int32)


def parts(word: str) -> tuple[str, str]:
    """The word without the punctuation at its end, in lower case where it is plain ASCII (as the
    tokenizer's normaliser has it), and that punctuation. The tokenizer splits at this place, since
    the character before it is a letter or digit."""
    stem = word.rstrip(PUNCTUATION)
    if not stem or not stem[-1].lower()[-1].isalnum():
        return word, ""
    return stem.lower() if stem.isascii() else stem, word[len(stem) :]


@cache
def word_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def padding(tokens: int, length: int) -> int:
    """Padding of a sequence: up to ``length``, none at a power of two."""
    return 0 if tokens & (tokens - 1) == 0 else length - tokens


def cuts(ends: np.ndarray, sentences: np.ndarray, length: int = LENGTH) -> list[int]:
    """Window cuts of a block, from 0 to its last token's end, of the least total cost.

    ``ends``: positions after each document; ``sentences``: positions after each sentence. Where
    those lie further apart than an eighth of a window, places between are added, so that a plan
    exists; they count as cuts within a sentence.
    """
    total = int(ends[-1])
    powers = [1 << p for p in range(8, length.bit_length()) if 1 << p <= length] or [length]
    natural = np.unique(np.concatenate([[0], ends, sentences, [total]]))
    gap, step = np.diff(natural), max(1, length // 8)
    extra = [np.arange(natural[i] + step, natural[i + 1], step) for i in np.flatnonzero(gap > step)]
    at = np.unique(np.concatenate([natural, *extra, [total - p for p in powers if p < total]])).astype(np.int64)
    price = np.full(len(at), WORD_CUT + WINDOW_COST)
    price[np.isin(at, sentences)] = SENTENCE_CUT + WINDOW_COST
    price[np.isin(at, ends)] = WINDOW_COST
    exact: list[list[int] | None] = [None] * len(at)  # earlier cuts that are a power of two away
    for p in powers:
        i = np.minimum(np.searchsorted(at, at - p), len(at) - 1)
        hit = np.flatnonzero(at[i] == at - p)
        for j, k in zip(hit.tolist(), i[hit].tolist()):
            if exact[j] is None:
                exact[j] = [k]
            else:
                exact[j].append(k)
    place, price = at.tolist(), price.tolist()
    cost, back = [0] * len(place), [0] * len(place)
    keys, cuts_, head = [0], [0], 0  # the queue from ``head`` on: cost + position, rising, and its cut
    for j in range(1, len(place)):
        here = place[j]
        while place[cuts_[head]] < here - length:
            head += 1
        low, best = keys[head] + length - here, cuts_[head]
        near = exact[j]
        if near:
            for i in near:
                if cost[i] < low:
                    low, best = cost[i], i
        low += price[j]
        cost[j], back[j] = low, best
        key = low + here
        while len(keys) > head and keys[-1] >= key:
            keys.pop()
            cuts_.pop()
        keys.append(key)
        cuts_.append(j)
    out, j = [total], len(place) - 1
    while j:
        j = back[j]
        out.append(place[j])
    return out[::-1]


def pack_block(docs: list[np.ndarray], ends_sentence: np.ndarray, length: int = LENGTH) -> dict[str, np.ndarray | list]:
    """Pieces of a block of documents: ``doc`` (position in the block), ``start``, ``length``,
    ``doc_tokens``, ``window`` (from 0), ``offset`` and ``ids`` (little-endian 32-bit)."""
    ids = np.concatenate(docs)
    size = np.array([len(d) for d in docs])
    ends = np.cumsum(size)
    window = np.array(cuts(ends, np.flatnonzero(ends_sentence[ids]) + 1, length))
    edges = np.unique(np.concatenate([[0], ends, window]))
    at, to = edges[:-1], edges[1:]
    doc = np.searchsorted(ends, at, side="right")
    win = np.searchsorted(window, at, side="right") - 1
    return {
        "doc": doc,
        "start": at - (ends - size)[doc],
        "length": to - at,
        "doc_tokens": size[doc],
        "window": win,
        "offset": at - window[win],
        "ids": [ids[a:b].astype("<u4").tobytes() for a, b in zip(at.tolist(), to.tolist())],
    }


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    path: str | None = None,
    length: int = LENGTH,
    separator: int = SEPARATOR,
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, doc_tokens, sequence_id, offset, ids`` (binary,
    little-endian unsigned 32-bit). Sequence ids carry the task's number above the 40th bit."""
    path = path or public_tokenizers.path(VOCABULARY)
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = word_tokenizer(path)
        sequence = TaskContext.get().partitionId() << 40
        names: list = []
        block: list[np.ndarray] = []
        tokens = 0

        def flush() -> pa.RecordBatch:
            nonlocal sequence, tokens
            p = pack_block(block, tok.ends_sentence, length)
            out = {
                "doc_id": pa.chunked_array(names).combine_chunks().take(pa.array(p["doc"])),
                **{k: pa.array(p[k].astype(np.int64)) for k in ("start", "length", "doc_tokens")},
                "sequence_id": pa.array(p["window"].astype(np.int64) + sequence),
                "offset": pa.array(p["offset"].astype(np.int64)),
                "ids": pa.array(p["ids"], pa.binary()),
            }
            sequence += int(p["window"][-1]) + 1
            names.clear(), block.clear()
            tokens = 0
            return pa.RecordBatch.from_pydict(out)

        end = np.array([separator], np.int32)
        for whole in batches:
            for b in slices(whole, limit=1 << 20):
                names.append(b.column(0))
                for text in b.column(1):
                    ids = tok.encode(text.as_py())
                    block.append(np.concatenate([ids, end]))
                    tokens += len(ids) + 1
                if tokens >= BLOCK_WINDOWS * length:
                    yield flush()
        if block:
            yield flush()

    schema = f"doc_id {kind.simpleString()}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    return map_texts(docs.select(id_col, text_col), run, schema)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents")).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
