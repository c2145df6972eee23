"""Continuous ingest: JSON-lines batches in, measurement rows and rejects out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ingest import ingest_receipt, reshape_batches, validate_batches
from ..sources.epochs import serial_epoch
from ..sources.tables import with_day

RAW_SCHEMA = "batch_id string, raw string"


def read_batches(spark: SparkSession, source_dir: str, max_files: int | None = None) -> DataFrame:
    """Stream of raw requests ``(batch_id, raw)`` from JSON-lines files."""
    r = spark.readStream.schema(RAW_SCHEMA)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.json(source_dir)


def write_ingest_batch(batch: DataFrame, epoch_id: int, rows_dir: str, reject_dir: str,
                       receipt_dir: str | None = None) -> None:
    """One micro-batch: validate, stamp every row with the batch's arrival
    time (``current_timestamp`` is fixed for a micro-batch, like ``now()`` in
    a transaction), write rows (partitioned by day) and rejects under ``epoch=<id>``, and, with
    ``receipt_dir``, one receipt per request (``new_records``, ``ts``). Ids are
    serial over all epochs, by request and place in it. A replayed epoch
    overwrites its own folders, so output is exactly once."""
    batch = batch.persist()
    try:
        good, rejected = validate_batches(batch)
        rows = reshape_batches(good, F.current_timestamp(), ntz=False)
        rows = serial_epoch(rows, ("batch_id", "pos"), f"{rows_dir}/_ids", epoch_id).persist()
        with_day(rows).write.mode("overwrite").partitionBy("day").parquet(f"{rows_dir}/epoch={epoch_id}")
        if receipt_dir is not None:
            ingest_receipt(rows, F.current_timestamp(), ntz=False) \
                .write.mode("overwrite").parquet(f"{receipt_dir}/epoch={epoch_id}")
        rows.unpersist()
        if not rejected.isEmpty():
            rejected.write.mode("overwrite").parquet(f"{reject_dir}/epoch={epoch_id}")
    finally:
        batch.unpersist()


def ingest_stream(spark: SparkSession, source_dir: str, rows_dir: str, reject_dir: str,
                  checkpoint: str, trigger: dict | None = None,
                  receipt_dir: str | None = None) -> StreamingQuery:
    """Start the ingest stream; ``trigger`` e.g. ``{"availableNow": True}`` or
    ``{"processingTime": "10 seconds"}``."""
    w = (read_batches(spark, source_dir).writeStream
         .foreachBatch(lambda df, i: write_ingest_batch(df, i, rows_dir, reject_dir, receipt_dir))
         .option("checkpointLocation", checkpoint))
    return w.trigger(**(trigger or {"processingTime": "10 seconds"})).start()
