"""Incremental ingest of export folders with Structured Streaming.

New ``*.json`` files dropped into the export folder are picked up by a file-source stream,
decoded with the same lenient VARIANT decoding as the batch reader, and go one of two ways:

- ``start_ingest`` appends them to a raw Parquet table (exactly-once through the stream's checkpoint), from which
  ``refresh_curated`` rebuilds the whole curated table;
- ``start_curated_ingest`` applies every micro-batch to a curated table that is kept by slices of time
  (``encore.sources.incremental``), with work in proportion to the arrivals. A micro-batch that is repeated after
  a crash changes nothing.

The checkpoint location must be in the shared folder (``spark.checkpoint.dir``) on a cluster.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from encore.session import configure, shared_dir
from encore.sources.exports import base_name, decode, typed


def export_stream(spark: SparkSession, export_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming raw plays from files arriving under ``export_dir``."""
    configure(spark)
    reader = spark.readStream
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    text = reader.text(export_dir, wholetext=True, pathGlobFilter="*.json", recursiveFileLookup=True)
    named = text.select(base_name(F.input_file_name()).alias("source_file"), "value")
    return typed(decode(named))


def start_ingest(
    spark: SparkSession,
    export_dir: str,
    raw_table: str,
    checkpoint: str | None = None,
    available_now: bool = True,
    processing_time: str | None = None,
) -> StreamingQuery:
    """Append newly arrived records to ``raw_table`` (Parquet). ``available_now`` processes
    everything present and stops; otherwise a ``processing_time`` trigger keeps it running."""
    # one checkpoint per pair of folders: two streams must never resume each other's log
    pair = hashlib.sha1(f"{export_dir.rstrip('/')}\n{raw_table.rstrip('/')}".encode()).hexdigest()[:16]
    ckpt = checkpoint or f"{shared_dir(spark)}/encore/streams/ingest-{pair}"
    w = (
        export_stream(spark, export_dir)
        .writeStream.format("parquet")
        .option("path", raw_table)
        .option("checkpointLocation", ckpt)
        .outputMode("append")
    )
    if available_now:
        w = w.trigger(availableNow=True)
    elif processing_time:
        w = w.trigger(processingTime=processing_time)
    return w.start()


def refresh_curated(spark: SparkSession, raw_table: str, curated_path: str) -> str:
    """Rebuild the curated table from everything ingested so far."""
    from encore.sources.curated import build_from_raw

    return build_from_raw(spark, spark.read.parquet(raw_table), curated_path)


def start_curated_ingest(
    spark: SparkSession,
    export_dir: str,
    curated_table: str,
    checkpoint: str | None = None,
    unit: str = "month",
    max_files_per_trigger: int | None = None,
    processing_time: str | None = None,
) -> StreamingQuery:
    """Applies newly arrived records to the incremental curated table, until all present files are
    done or, with ``processing_time``, for good."""
    from encore.sources.incremental import apply_arrivals

    pair = hashlib.sha1(f"{export_dir.rstrip('/')}\n{curated_table.rstrip('/')}".encode()).hexdigest()[:16]
    ckpt = checkpoint or f"{shared_dir(spark)}/encore/streams/curated-{pair}"

    def apply(batch: DataFrame, _: int) -> None:
        apply_arrivals(batch.sparkSession, batch, curated_table, unit)

    w = export_stream(spark, export_dir, max_files_per_trigger).writeStream.foreachBatch(apply).option("checkpointLocation", ckpt)
    return (w.trigger(processingTime=processing_time) if processing_time else w.trigger(availableNow=True)).start()
