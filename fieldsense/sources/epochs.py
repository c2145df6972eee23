"""Epochs of a table written by a stream: whether one is there, and the serial
ids of its rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ids import with_serial_ids


def done(spark: SparkSession, path: str) -> bool:
    """Whether a write to ``path`` has been committed."""
    return exists(spark, f"{path}/_SUCCESS")


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def serial_epoch(rows: DataFrame, order_by, ledger_dir: str, epoch: int) -> DataFrame:
    """``rows`` of an epoch with serial ids that follow those of the epochs
    before it. ``ledger_dir`` keeps the last id of each epoch in a folder of its
    own; an epoch that is tried again starts where its first try did."""
    spark, start = rows.sparkSession, 0
    if exists(spark, ledger_dir):
        before = spark.read.schema("last bigint, epoch bigint").parquet(ledger_dir).where(F.col("epoch") < int(epoch))
        start = before.agg(F.max("last")).first()[0] or 0
    out = with_serial_ids(rows, order_by, start)
    last = out.agg(F.coalesce(F.max("id"), F.lit(start)).alias("last"))
    last.coalesce(1).write.mode("overwrite").parquet(f"{ledger_dir}/epoch={int(epoch)}")
    return out
