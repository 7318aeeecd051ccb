"""Hashed subword bags: the vectors that the toxicity and the language model share.

A word (a run of letters, lower-cased) is the bag of its bytes' n-grams with border marks, and of
itself; each is hashed to a row of an embedding table and the word's vector is their mean. A linear
softmax stands on means of word vectors, so for scoring the table times the softmax weights is all
that is needed: one row of class logits per bucket.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np

BUCKETS = 1 << 17
GRAMS = (3, 4, 5)
CACHED_WORDS = 250_000  # words whose logits a worker remembers; only speed depends on it
LETTERS = re.compile(r"[^\W\d_]+")

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    return LETTERS.findall((text or "").lower())


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def subwords(words: list[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """``(ids, starts)``: bucket ids of all words' subwords, and where each word's begin."""
    data = [b"<" + w.encode("utf-8", "surrogatepass") + b">" for w in words]
    size = np.array([len(d) for d in data], dtype=np.int64)
    text = np.frombuffer(b"".join(data), np.uint8).astype(np.uint64)
    end = np.cumsum(size)
    stop = np.repeat(end, size)  # of the word that a byte is in
    at = np.arange(len(text))
    owner = np.repeat(np.arange(len(words)), size)
    found, whose = [], []
    h = np.zeros(len(text), np.uint64)
    longest = max(GRAMS)
    with np.errstate(over="ignore"):
        for n in range(1, longest + 1):
            reach = len(text) - n + 1
            if reach <= 0:
                break
            h[:reach] = h[:reach] * _MULTIPLIER + text[n - 1 :] + np.uint64(1)
            if n in GRAMS:
                inside = np.flatnonzero(at[:reach] + n <= stop[:reach])
                found.append(_mix(h[inside] + np.uint64(n)))
                whose.append(owner[inside])
        # the word itself: a sum over its bytes by place
        place = (at - (stop - np.repeat(size, size))).astype(np.uint64)
        whole = np.add.reduceat(_mix((text + np.uint64(257) * place) * _MULTIPLIER), end - size)
        found.append(_mix(whole + np.uint64(99)))
        whose.append(np.arange(len(words)))
    ids, whose = np.concatenate(found), np.concatenate(whose)
    order = np.argsort(whose, kind="stable")
    starts = np.searchsorted(whose[order], np.arange(len(words)))
    return (ids[order] % np.uint64(buckets)).astype(np.int64), starts


class Corpus:
    """Texts as numbers of words, and the words' subwords; built text by text in little memory."""

    def __init__(self, texts: Iterable[str | None]):
        number: dict[str, int] = {}
        self.docs = [
            np.array([number.setdefault(w, len(number)) for w in words_of(t)], dtype=np.int32) for t in texts
        ]
        words = list(number)
        parts = [subwords(words[i : i + 20_000]) for i in range(0, len(words), 20_000)]
        shift = np.cumsum([0, *[len(ids) for ids, _ in parts]])
        self.ids = np.concatenate([ids for ids, _ in parts] or [np.zeros(0)]).astype(np.int32)
        self.starts = np.concatenate([s + d for (_, s), d in zip(parts, shift)] or [np.zeros(0)]).astype(np.int64)
        self.stops = np.append(self.starts[1:], len(self.ids))

    def bag(self, words: np.ndarray) -> np.ndarray:
        """The subwords of some words."""
        return np.concatenate([self.ids[self.starts[w] : self.stops[w]] for w in words.tolist()])


def means(rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Means of the runs of ``rows`` that begin at ``starts``."""
    count = np.diff(np.append(starts, len(rows)))
    return np.add.reduceat(rows, starts, axis=0) / count.reshape(-1, *[1] * (rows.ndim - 1))


def word_logits(words: list[str], projected: np.ndarray) -> np.ndarray:
    """A row of logits per word, from the projected table (bucket by class)."""
    ids, starts = subwords(words, len(projected))
    return means(projected[ids], starts).astype(np.float32)


class WordScores:
    """Logits of the words of texts, remembered word by word."""

    def __init__(self, projected: np.ndarray):
        self.projected = projected
        self._clear()

    def _clear(self) -> None:
        self.place: dict[str, int] = {}
        self.rows = np.zeros((1024, self.projected.shape[1]), np.float32)

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        """For each text, its words' logits in order."""
        if len(self.place) > CACHED_WORDS:
            self._clear()
        place = self.place
        split = [words_of(t) for t in texts]
        new = list({w for ws in split for w in ws if w not in place})
        for i in range(0, len(new), 50_000):
            part = new[i : i + 50_000]
            need = len(place) + len(part)
            if need > len(self.rows):
                grown = np.zeros((2 * need, self.rows.shape[1]), np.float32)
                grown[: len(place)] = self.rows[: len(place)]
                self.rows = grown
            self.rows[len(place) : need] = word_logits(part, self.projected)
            place.update(zip(part, range(len(place), need)))
        return [self.rows[[place[w] for w in ws]] for ws in split]


class Bag:
    """Embeddings and softmax weights, trained jointly by stochastic gradient descent on bags of
    words with a label."""

    def __init__(self, classes: int, width: int = 16, buckets: int = BUCKETS, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.rng = rng
        self.table = rng.uniform(-1 / width, 1 / width, (buckets, width)).astype(np.float32)
        self.weights = rng.normal(0, 0.5, (width, classes)).astype(np.float32)
        self.bias = np.zeros(classes, np.float32)

    def projected(self) -> np.ndarray:
        return self.table @ self.weights

    def step(self, bags: list[np.ndarray], labels: np.ndarray, rate: float, share: np.ndarray | None = None) -> float:
        """One step on bags of subword ids; returns the mean loss. ``share`` weighs the examples."""
        size = np.array([len(b) for b in bags])
        ids = np.concatenate(bags)
        starts = np.cumsum(size) - size
        x = np.add.reduceat(self.table[ids], starts, axis=0) / size[:, None]
        z = x @ self.weights + self.bias
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(axis=1, keepdims=True)
        hit = p[np.arange(len(labels)), labels]
        g = p
        g[np.arange(len(labels)), labels] -= 1
        if share is not None:
            g = g * share[:, None]
        # fastText's rule: the rate is not divided by the batch, each example moves its own rows
        back = (g @ self.weights.T) / size[:, None]
        self.weights -= rate * (x.T @ g) / len(bags) ** 0.5
        self.bias -= rate * g.mean(axis=0)
        np.add.at(self.table, ids, -rate * np.repeat(back, size, axis=0).astype(np.float32))
        return float(-np.log(np.maximum(hit, 1e-9)).mean())
