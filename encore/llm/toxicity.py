"""Toxicity: a linear softmax on averaged subword-bag embeddings, trained jointly in numpy.

Labels belong to documents while toxic words are few, so an average over a long text would drown
them. A text's score is that of its worst window of a few words: training goes back and forth
between finding each labelled text's worst window under the current model and a pass of stochastic
gradient descent on the windows' bags. Misspelled words share the n-gram vectors of the known ones.
A logistic curve over the worst window's logit, fitted on the same rows, calibrates the score.

Training reads at most ``MAX_ROWS`` labelled texts per class, picked by a hash of their id, and of them
as many, in the hash's order, as have ``MAX_CHARS`` characters together, so that what the driver holds is
bounded. They are read whole, as a label may rest on any part of a text, and so are the texts that are
scored; a labelled text longer than ``MAX_CHARS`` alone teaches nothing, but is scored as any other.

Defined cases: a null text, or one without letters, gets the score of an empty window; labels that
are null, or of ids the documents lack, are ignored; without words of
both classes every text scores next to 0; of several rows of an id the highest label and the first text
in order count; repeated rows are scored alike; an empty table gives an empty result. Only
the id and text columns of the documents are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from encore.llm.bpe import slices
from encore.llm.common import cut, map_texts, small_batches, table
from encore.llm.subword import BUCKETS, Bag, Corpus, WordScores, means, words_of

MAX_ROWS = 2000  # labelled rows per class that training reads at most
MAX_CHARS = 32_000_000  # characters per class that they have together at most
WINDOW = 4  # words
ROUNDS = 12
FOLDS, HELD_OUT = 5, 0


@dataclass(frozen=True)
class Model:
    """``projected``: margin of class 1 per subword bucket; a text scores the logistic function of
    ``slope * worst + shift``, ``worst`` being the largest mean margin of its windows plus ``bias``."""

    projected: np.ndarray
    bias: float
    slope: float
    shift: float


def windows(margins: np.ndarray, width: int = WINDOW) -> np.ndarray:
    """Mean of every ``width`` neighbouring margins, or of all where there are fewer."""
    if len(margins) <= width:
        return np.array([margins.mean() if len(margins) else 0.0])
    total = np.concatenate([[0.0], np.cumsum(margins, dtype=np.float64)])
    return (total[width:] - total[:-width]) / width


def fit(texts: Iterable[str | None], labels: np.ndarray, seed: int = 7) -> Model:
    corpus = Corpus(texts)
    docs = corpus.docs
    if not len(corpus.ids):
        raise ValueError("no words to learn from")
    model = Bag(2, seed=seed)
    usable = [i for i, d in enumerate(docs) if len(d)]
    share = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum())) * len(labels)

    def margins() -> np.ndarray:
        p = model.projected()
        return means((p[:, 1] - p[:, 0])[corpus.ids], corpus.starts)

    for r in range(ROUNDS):
        # the first rounds see samples of whole texts, so that frequent signs of a class stand out
        at_word = margins()
        picked = []
        for i in usable:
            d = docs[i]
            if r < 3:
                picked.append(d if len(d) <= 60 else d[np.sort(model.rng.choice(len(d), 60, replace=False))])
            else:
                best = int(np.argmax(windows(at_word[d])))
                picked.append(d[best : best + WINDOW])
        order = model.rng.permutation(len(usable))
        rate = 0.5 * (1 - r / ROUNDS)
        for at in range(0, len(order), 32):
            some = order[at : at + 32]
            rows = [usable[j] for j in some]
            model.step([corpus.bag(picked[j]) for j in some], labels[rows], rate, share[rows])
    p = model.projected()
    projected = (p[:, 1] - p[:, 0]).astype(np.float32)
    bias = float(model.bias[1] - model.bias[0])
    at_word = margins()
    worst = np.array([windows(at_word[d]).max() + bias for d in docs])
    # a window of unknown words, a margin of nothing, is a clean example too
    blank = max(1, len(docs) // 10)
    slope, shift = logistic(np.append(worst, np.full(blank, bias)), np.append(labels, np.zeros(blank)))
    return Model(projected, bias, slope, shift)


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and intercept of a logistic regression of ``y`` on one value, by damped Newton steps."""
    mean, scale = x.mean(), x.std() or 1.0
    z = np.stack([(x - mean) / scale, np.ones(len(x))], axis=1)
    w = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (p - y) + 1e-2 * w
        h = (z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(2)
        step = np.linalg.solve(h, g)
        w -= step / max(1.0, float(np.abs(step).max()))
    return float(w[0] / scale), float(w[1] - w[0] * mean / scale)


def training_rows(
    docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, max_rows: int, max_chars: int = MAX_CHARS
) -> DataFrame:
    """At most ``max_rows`` labelled texts, of ``max_chars`` characters together, per class from the
    folds that may be learned from."""
    known = labels.select(F.col("doc_id").alias("__id"), F.col("toxic").cast("int").alias("y"))
    # of several labels of an id the higher one counts, of several texts the first in order
    known = known.where("__id is not null and y in (0, 1)").groupBy("__id").agg(F.max("y").alias("y"))
    known = known.join(docs.select(F.col(id_col).alias("__id")).distinct(), "__id", "left_semi")
    known = known.where(fold("__id", FOLDS) != HELD_OUT)
    mixed = F.xxhash64("__id")
    some = [known.where(f"y = {y}").orderBy(mixed, "__id").limit(max_rows) for y in (0, 1)]
    picked = some[0].unionByName(some[1])  # at most 2 * max_rows ids
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("t"))
    rows = cut(rows.join(F.broadcast(picked), "__id").groupBy("__id", "y").agg(F.min("t").alias("t")))
    # running sums over ids and lengths only; texts stay where they are
    sizes = rows.select("__id", "y", F.coalesce(F.length("t"), F.lit(0)).cast("long").alias("size"))
    upto = F.sum("size").over(Window.partitionBy("y").orderBy(mixed, "__id"))
    fitting = sizes.where(F.col("size") <= max_chars).withColumn("upto", upto).where(F.col("upto") <= max_chars)
    return rows.join(F.broadcast(fitting.select("__id")), "__id", "left_semi")


def fold(column: str, folds: int):
    return F.crc32(F.col(column).cast("string").cast("binary")) % folds


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_rows: int = MAX_ROWS,
    max_chars: int = MAX_CHARS,
) -> Model:
    """A model from the labelled texts; ``labels`` has ``doc_id`` and ``toxic`` (1 or 0). Without texts of
    both classes it is one that scores every text 0."""
    rows = sorted(training_rows(docs, labels, id_col, text_col, max_rows, max_chars).collect(), key=lambda r: r["__id"])
    if len({r["y"] for r in rows}) < 2 or not any(words_of(r["t"]) for r in rows):
        return Model(np.zeros(BUCKETS, np.float32), 0.0, 0.0, -math.inf)
    return fit((r["t"] for r in rows), np.array([r["y"] for r in rows]))


def chances(model: Model, scores: WordScores, texts: list[str | None]) -> np.ndarray:
    """Scores of texts; a few hundred at a time, so that their words' margins stay small."""
    worst: list[float] = []
    for at in range(0, len(texts), 256):
        worst += [windows(s[:, 0]).max() + model.bias for s in scores(texts[at : at + 256])]
    return 1 / (1 + np.exp(-np.clip(model.slope * np.array(worst, np.float64) + model.shift, -30, 30)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``(doc_id, score)``, score from 0 to 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2^17 floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        scores = WordScores(m.projected[:, None])
        for whole in batches:
            for b in slices(whole, limit=1 << 20):
                out = chances(m, scores, b.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.float64())], ["doc_id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_texts(docs.select(id_col, text_col), run, f"doc_id {kind}, score double")


def clean(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score under ``threshold``, all columns kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scores = WordScores(shared.value.projected[:, None])
        for texts in parts:
            yield pd.Series(chances(shared.value, scores, texts.tolist()), dtype=float)

    small_batches(docs.sparkSession)
    return docs.where(scored(F.coalesce(F.col(text_col), F.lit(""))) < threshold)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    held_out = F.coalesce(fold("doc_id", FOLDS) == HELD_OUT, F.lit(False))
    return score(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
