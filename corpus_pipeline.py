"""Corpus pipeline: toxicity, exact de-duplication, SimHash near-duplicates, personal data, packing.

Every stage works on all rows its predecessor kept. All but the last return the columns of
``documents``; the personal data found in a text is replaced by the name of its kind in brackets.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from encore.llm import exact_dedup, packing, pii, simhash, toxicity
from encore.llm.common import shared_folder, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; it learns from ``labels``."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.clean(docs, model).select(COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id stays."""
    return exact_dedup.keep_one(docs).select(COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash component the document with the smallest id stays."""
    return simhash.keep_one(docs).select(COLUMNS)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked in the text; ``n_chars`` follows."""
    rows = pii.redact(docs)
    return rows.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long"))).select(COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, with the ids themselves."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxic),
    ("exact_dedup", exact),
    ("simhash_near_dedup", near),
    ("pii", private),
    ("packing", packed),
]

ORACLE_SQL = None  # SQL can express neither the classifier nor the tokenizer


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
