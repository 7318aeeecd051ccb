"""Token counts as delta-maintained rollups.

Changes to documents become signed rows: an insert adds a document and its tokens, a delete takes
them away, a revision takes the old count away and adds the new one (under a new tokenizer version,
language or source, if those changed). Rows are summed by source, language and tokenizer version and
committed per batch: a batch owns one folder of the rollup, written aside and renamed, so committing it
again, after a retry or twice by mistake, leaves the totals as they are. Totals are sums over the
committed batches; nothing already counted is read again.

Defined cases: a null text has no tokens but its document counts; a null source, language or version
is a group of its own; repeated rows count as often as they occur; groups that come back to nothing
are left out; an empty batch commits an empty delta; an empty rollup has no totals. Only the named
columns are read.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import cache

import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from encore.llm.bpe import read_ranks, slices
from encore.llm.common import cut, map_texts, shared_folder, table
from encore.sources import fs

KEYS = ["source", "lang", "tokenizer"]
ROLLUP = T.StructType(
    [T.StructField(k, T.StringType()) for k in KEYS]
    + [T.StructField("n_docs", T.LongType()), T.StructField("n_tokens", T.LongType())]
)


@cache
def tokenizer(name: str) -> tiktoken.Encoding:
    ranks = read_ranks(public_tokenizers.path(f"{name}.tiktoken"))
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def counted(docs: DataFrame, versions: dict[str, Column], text_col: str = "text") -> DataFrame:
    """``docs`` without the text, with a long column per tokenizer: its token count of the whole text
    where the version's condition holds, else null."""
    keep = [F.col(c) for c in docs.columns if c != text_col]
    wanted = F.concat_ws(",", *[F.when(c, F.lit(name)) for name, c in versions.items()])
    names = list(versions)
    rows = docs.select(F.struct(*keep).alias("row"), F.col(text_col).alias("text"), wanted.alias("wanted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole):
                texts, wants = b.column(1).to_pylist(), b.column(2).to_pylist()
                cols = [b.column(0)]
                for name in names:
                    encode = tokenizer(name).encode_ordinary
                    n = [len(encode(t or "")) if name in w.split(",") else None for t, w in zip(texts, wants)]
                    cols.append(pa.array(n, pa.int64()))
                yield pa.RecordBatch.from_arrays(cols, ["row", *names])

    kind = rows.schema["row"].dataType
    schema = T.StructType([T.StructField("row", kind), *[T.StructField(v, T.LongType()) for v in names]])
    return map_texts(rows, run, schema).select("row.*", *names)


def inserts(rows: DataFrame, version: str, tokens: str) -> DataFrame:
    return _signed(rows, version, tokens, 1)


def deletes(rows: DataFrame, version: str, tokens: str) -> DataFrame:
    return _signed(rows, version, tokens, -1)


def revisions(rows: DataFrame, old: tuple[str, str], new: tuple[str, str]) -> DataFrame:
    """Rows counted under ``old`` (version, column) that now count under ``new``."""
    return deletes(rows, *old).unionByName(inserts(rows, *new))


def _signed(rows: DataFrame, version: str, tokens: str, sign: int) -> DataFrame:
    return rows.select(
        F.col("source").cast("string").alias("source"),
        F.col("lang").cast("string").alias("lang"),
        F.lit(version).alias("tokenizer"),
        F.lit(sign).cast("long").alias("n_docs"),
        (F.coalesce(tokens, F.lit(0)) * sign).cast("long").alias("n_tokens"),
    )


def summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


class Rollup:
    """Totals in a folder that all executors share; one subfolder per committed batch."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def commit(self, batch: str, deltas: DataFrame) -> None:
        """Makes ``deltas`` (signed rows) the content of the batch, whatever it held before. They are
        written aside and become the batch's newest version when complete, so a lost task or a commit
        that breaks off at any step adds and takes nothing, and a reader sees the batch as it was or as
        it will be."""
        if not re.fullmatch(r"[A-Za-z0-9_-]+", batch):
            raise ValueError("a batch name has letters, digits, - and _ only")
        aside = f"{self.path}/_aside-{uuid.uuid4().hex}"
        summed(deltas).write.parquet(aside)
        fs.publish_version(self.spark, aside, f"{self.path}/batch={batch}")

    def batches(self) -> list[str]:
        """Names of the committed batches."""
        return sorted(self._versions())

    def _versions(self) -> dict[str, str]:
        """The folder of each committed batch."""
        files = [path.split("/") for path, _, _ in fs.listing(self.spark, self.path)]
        names = {part.removeprefix("batch=") for f in files for part in f[-3:-1] if part.startswith("batch=")}
        found = {name: fs.current(self.spark, f"{self.path}/batch={name}") for name in names}
        return {name: folder for name, folder in found.items() if folder}

    def totals(self) -> DataFrame:
        """``source, lang, tokenizer, n_docs, n_tokens`` over all committed batches."""
        folders = sorted(self._versions().values())
        rows = self.spark.read.schema(ROLLUP).parquet(*folders) if folders else self.spark.createDataFrame([], ROLLUP)
        return summed(rows).where("n_docs <> 0 or n_tokens <> 0")


FIRST, SECOND = "byte_bpe_50k", "byte_bpe_multi_50k"
SHORT = 200  # characters


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of ``documents`` after three batches: all documents arrive under the first tokenizer;
    those that are not English are counted anew under the multilingual one; documents of less than
    ``SHORT`` characters are deleted under whichever version they had. The second batch is committed
    twice, as after a retry."""
    docs = table(spark, sf_dir, "documents").select("source", "lang", "text", F.length("text").alias("size"))
    other = ~F.col("lang").eqNullSafe("en")
    rows = cut(counted(docs, {FIRST: F.lit(True), SECOND: other}))
    rollup = Rollup(spark, f"{shared_folder(spark)}/token-counts-{uuid.uuid4().hex}")
    rollup.commit("arrivals", inserts(rows, FIRST, FIRST))
    for _ in range(2):
        rollup.commit("multilingual", revisions(rows.where(other), (FIRST, FIRST), (SECOND, SECOND)))
    short = rows.where(F.coalesce("size", F.lit(0)) < SHORT)
    gone = deletes(short.where(~other), FIRST, FIRST).unionByName(deletes(short.where(other), SECOND, SECOND))
    rollup.commit("removals", gone)
    return rollup.totals()
