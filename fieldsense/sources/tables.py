"""Table scans and writes with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import is_ntz, utc_day


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None,
               fmt: str = "parquet") -> DataFrame:
    """Scan a table. With a schema the files are read against it (no
    inference); Parquet scans keep filter pushdown and column pruning."""
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path)


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON-lines files read against ``schema``; malformed lines keep NULLs."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def append(df: DataFrame, path: str, partition_by=None, fmt: str = "parquet") -> None:
    """Append rows (the returned rows of an insert are the DataFrame itself)."""
    w = df.write.mode("append").format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def write_version(df: DataFrame, path: str, partition_by=None, fmt: str = "parquet") -> None:
    """Write a rewritten table into a new version folder ``path`` (the caller
    picks a fresh one, e.g. ``.../v=<n>``); readers switch to it once the
    write has committed. Without a lakehouse format there is no in-place
    update, and a rewrite must never overwrite the folder it reads from."""
    w = df.write.mode("overwrite").format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def with_day(df: DataFrame, ts: str = "ts", day_col: str = "day") -> DataFrame:
    """Add the ``day`` partition column: the date of ``ts`` in UTC."""
    return df.withColumn(day_col, utc_day(F.col(ts), is_ntz(df, ts)))


def write_measurements(df: DataFrame, path: str, mode: str = "append") -> None:
    """Store measurements partitioned by day, the layout the time-range,
    trailing-window and sync operators prune on."""
    with_day(df).write.mode(mode).partitionBy("day").parquet(path)


def overwrite_partitions(df: DataFrame, path: str, partition_by, fmt: str = "parquet") -> None:
    """Replace only the partitions present in ``df`` (dynamic partition
    overwrite); other partitions of the table stay as they are. When ``df``
    was derived from the same table, pass it through ``cut_lineage`` first
    so the job never re-reads the files it replaces."""
    (df.write.mode("overwrite").format(fmt).partitionBy(*partition_by)
     .option("partitionOverwriteMode", "dynamic").save(path))


def read_observations(spark: SparkSession, path: str, streaming: bool = False,
                      schema: T.StructType | None = None) -> DataFrame:
    """State observations ``(device_id, id, segment, data, ts)`` from
    JSON-lines files, as a batch or a stream (``data`` is the JSON text)."""
    from ..schemas import OBSERVATIONS
    s = schema or OBSERVATIONS
    if streaming:
        return spark.readStream.schema(s).json(path)
    return spark.read.schema(s).json(path)


def read_measurements(spark: SparkSession, path: str, streaming: bool = False,
                      schema: T.StructType | None = None) -> DataFrame:
    """The measurements table (Parquet, partition columns allowed)."""
    from ..schemas import MEASUREMENTS
    s = schema or MEASUREMENTS
    if streaming:
        return spark.readStream.schema(s).parquet(path)
    return spark.read.schema(s).parquet(path)
