"""Streaming calendar rollup over tumbling windows with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import is_ntz, round_numeric
from ..operators.readings import SERIES_KEYS, STRICT_60, Bounds


def rollup_stream(readings: DataFrame, n_hours: int = 12, bounds: Bounds = STRICT_60,
                  late: str = "1 hour", keys=SERIES_KEYS) -> DataFrame:
    """Streaming twin of ``rollup``: tumbling windows of ``n_hours`` with a
    watermark of ``late`` so finished windows are emitted (append mode) and
    their state dropped. Spark windows start at the epoch, so they equal the
    midnight-anchored buckets of the batch rollup only when ``n_hours``
    divides 24 and the session zone is UTC."""
    if 24 % int(n_hours):
        raise ValueError("streaming buckets need n_hours dividing 24")
    ntz = is_ntz(readings, "ts")
    rows = readings.where(bounds.predicate(F.col("val"), F.col("type")))
    # watermarks need TIMESTAMP: wall-clock times are read in the session zone
    rows = rows.withColumn("_et", F.col("ts").cast("timestamp")) if ntz else rows.withColumn("_et", F.col("ts"))
    out = (rows.withWatermark("_et", late)
           .groupBy(F.window("_et", f"{int(n_hours)} hours"), *keys)
           .agg(round_numeric(F.avg("val")).alias("val_avg"),
                round_numeric(F.stddev_pop("val")).alias("val_stddev"),
                F.count("val").alias("val_count")))
    start = F.col("window.start").cast("timestamp_ntz") if ntz else F.col("window.start")
    return out.select(start.alias("time"), *keys, "val_avg", "val_stddev", "val_count")
