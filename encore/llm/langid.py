"""Language identification: averaged hashed subword embeddings with a linear softmax, trained by
stochastic gradient descent in numpy, with calibrated rejection.

Training reads about ``MAX_ROWS`` texts of every language, picked by a hash of their id, from the
documents that may be learned from; of a long one it gets ``WINDOWS`` runs of ``WINDOW`` words from
anywhere in the text. Where that makes more than
``TOTAL_ROWS``, the languages share that total evenly, ``LEAST_ROWS`` each at least. A tenth of them is kept back to
calibrate: a temperature makes the largest softmax share a probability, and the rejection threshold
is the lowest at which the accepted texts are right in ``PRECISION`` of all cases. Prediction reads
whole texts.

Defined cases: a null text, or one without a letter, is ``und`` with score 0 and rejected; texts with
a null language are not learned from; with a single language every text with a letter gets it;
without any language every text is ``und`` with score 0; of several rows of an id one is learned
from, the first by language, then text; repeated rows are predicted alike; an empty
table to predict gives an empty result. Only the id, text and language columns are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from encore.llm.bpe import slices
from encore.llm.common import map_texts, table
from encore.llm.subword import BUCKETS, Bag, Corpus, WordScores, words_of

MAX_ROWS = 1500  # texts per language that training reads, give or take a few per cent
WINDOW = 20  # words of a training bag
WINDOWS = 16  # bags of a text that training draws from
TOTAL_ROWS = 600_000  # texts that training reads in all, unless the languages' least shares are more
LEAST_ROWS = 20  # texts per language that a shared total leaves
EPOCHS = 8
PRECISION = 0.99
FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"


@dataclass(frozen=True)
class Model:
    languages: list[str]
    projected: np.ndarray  # logits per subword bucket
    bias: np.ndarray
    temperature: float
    threshold: float  # predictions with a lower score are rejected


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(texts: list[str], languages: list[str], seed: int = 11) -> Model:
    names = sorted(set(languages))
    if not names:
        raise ValueError("no language to learn from")
    corpus = Corpus(texts)
    docs = corpus.docs
    keep = [i for i, d in enumerate(docs) if len(d)]
    if not keep:
        raise ValueError("no words to learn from")
    label = np.array([names.index(x) for x in languages])
    model = Bag(len(names), seed=seed)
    kept_back = set(keep[::10]) if len(keep) >= 100 else set()
    learn = np.array([i for i in keep if i not in kept_back])
    for epoch in range(EPOCHS):
        rate = 0.5 * (1 - epoch / EPOCHS)
        order = model.rng.permutation(learn)
        for at in range(0, len(order), 32):
            rows = order[at : at + 32]
            bags = []
            for i in rows:
                d = docs[i]
                first = int(model.rng.integers(max(1, len(d) - WINDOW)))  # any twenty words of the text
                bags.append(corpus.bag(d[first : first + WINDOW]))
            model.step(bags, label[rows], rate)
    projected = model.projected().astype(np.float32)
    check = sorted(kept_back) or learn.tolist()
    scores = WordScores(projected)([texts[i] for i in check])
    logits = np.array([s.mean(axis=0) for s in scores]) + model.bias
    truth = label[check]
    grid = np.geomspace(0.05, 20, 80)
    loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(truth)), truth], 1e-12)).mean() for t in grid]
    temperature = float(grid[int(np.argmin(loss))])
    p = softmax(logits / temperature)
    sure, right = p.max(axis=1), p.argmax(axis=1) == truth
    order = np.argsort(-sure)
    precision = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
    good = np.flatnonzero(precision >= PRECISION)
    threshold = float(sure[order][good[-1]]) if len(good) else 1.0
    return Model(names, projected, model.bias, temperature, threshold)


def fold(column: str):
    return F.crc32(F.col(column).cast("string").cast("binary")) % FOLDS


def train(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    max_rows: int = MAX_ROWS,
) -> Model:
    """A model from the documents outside the held-out fold. Without words of a known language it is one
    that knows no language. Of several rows of an id the first by language, then text, counts."""
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("t"), F.col(lang_col).alias("y"))
    rows = rows.where("__id is not null and y is not null and t is not null").where(fold("__id") != HELD_OUT)
    size = rows.groupBy("y").count()
    languages = size.agg(F.count("*").alias("languages"))
    share = F.least(F.lit(max_rows), F.greatest(F.lit(LEAST_ROWS), F.lit(TOTAL_ROWS) / F.col("languages")))
    size = size.crossJoin(F.broadcast(languages)).select("y", (share / F.col("count")).alias("share"))
    # every row decides by its id's hash, so that no language meets in one task
    chance = F.pmod(F.xxhash64("__id"), F.lit(1 << 30)) / float(1 << 30)
    picked = rows.join(F.broadcast(size), "y").where(chance < F.col("share"))
    picked = picked.groupBy("__id").agg(F.min(F.struct("y", "t")).alias("r")).select("__id", "r.y", "r.t")
    sample = drawn(picked).toPandas().sort_values("__id")
    if not any(map(words_of, sample["t"])):
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0, 1.0)
    return fit(sample["t"].tolist(), sample["y"].tolist())


def drawn(rows: DataFrame) -> DataFrame:
    """``__id, y, t`` with longer texts replaced by ``WINDOWS`` runs of ``WINDOW`` words from anywhere in them, so
    that a bounded part of each travels; where they lie follows from the text."""

    def some(text: str) -> str:
        words = words_of(text)
        if len(words) <= WINDOWS * WINDOW:
            return text
        at = np.random.default_rng(zlib.crc32(text.encode())).integers(len(words) - WINDOW + 1, size=WINDOWS)
        return " ".join(w for a in at for w in words[a : a + WINDOW])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, column=2):
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([some(t) for t in b.column(2).to_pylist()], pa.string())], b.schema.names)

    return map_texts(rows.select("__id", "y", "t"), run, rows.select("__id", "y", "t").schema)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``(doc_id, lang_pred, score, accepted)``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2^17 floats per language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        if not m.languages:
            for b in batches:
                n = b.num_rows
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array([UNKNOWN] * n, pa.string()), pa.array(np.zeros(n)), pa.array(np.zeros(n, bool))],
                    ["doc_id", "lang_pred", "score", "accepted"],
                )
            return
        scores = WordScores(m.projected)
        for whole in batches:
            for b in slices(whole, limit=1 << 20):
                texts = b.column(1).to_pylist()
                lettered = np.array([any(map(str.isalpha, t or "")) for t in texts], bool)
                rows = scores(texts)
                mean = np.array([r.mean(axis=0) if len(r) else np.zeros(len(m.languages)) for r in rows], np.float64)
                p = softmax((mean + m.bias) / m.temperature)
                sure = np.where(lettered, p.max(axis=1), 0.0)
                name = [m.languages[k] if ok else UNKNOWN for k, ok in zip(p.argmax(axis=1), lettered)]
                accepted = lettered & (sure >= m.threshold)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(name, pa.string()), pa.array(sure, pa.float64()), pa.array(accepted)],
                    ["doc_id", "lang_pred", "score", "accepted"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, lang_pred string, score double, accepted boolean"
    return map_texts(docs.select(id_col, text_col), run, schema)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = predict(docs, train(docs))
    held_out = F.coalesce(fold("doc_id") == HELD_OUT, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "accepted")
