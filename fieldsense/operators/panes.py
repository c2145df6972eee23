"""Moment panes: count, mean and squared deviations for each hour and series,
from which any coarser rollup is made without reading the readings again.

A pane is mergeable: late readings add a second pane of the same hour, and
readers merge what there is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bucket_start, calendar_bucket, is_ntz, round_numeric
from .readings import SERIES_KEYS, STRICT_60, Bounds, _time_range, filter_readings


def hour_panes(df: DataFrame, bounds: Bounds = STRICT_60, keys=SERIES_KEYS, value: str = "val", ts: str = "ts",
               start=None, end=None, day_col: str | None = None) -> DataFrame:
    """(time, *keys, n, mean, m2) of the readings inside the bounds: for each
    hour and series the count, the mean and the sum of squared deviations."""
    rows = filter_readings(df, bounds, start, end, sort=False, value=value, ts=ts, day_col=day_col)
    return (rows.groupBy(bucket_start(F.col(ts), 1, is_ntz(df, ts)).alias("time"), *keys)
            .agg(F.count(value).alias("n"), F.avg(value).alias("mean"), (F.var_pop(value) * F.count(value)).alias("m2")))


def merge_panes(panes: DataFrame, time: Column | None = None, keys=SERIES_KEYS) -> DataFrame:
    """One pane for each ``time`` (the panes' own by default) and series.

    With N = sum n and M = sum n * mean / N, the squared deviations are those
    of the panes and n * (mean - M) ** 2 for each: differences of means, never of
    sums of squares, so nothing cancels. The window and the aggregate share one
    shuffle by time and series, of as many rows as there are panes."""
    group = ["time", *keys]
    rows = panes.select((F.col("time") if time is None else time).alias("time"), *keys, "n", "mean", "m2")
    all_of = Window.partitionBy(*group)
    rows = rows.withColumn("_n", F.sum("n").over(all_of))
    rows = rows.withColumn("_mean", F.sum(F.col("n") * F.col("mean") / F.col("_n")).over(all_of))
    away = F.col("mean") - F.col("_mean")
    return rows.groupBy(*group).agg(F.sum("n").alias("n"), F.max("_mean").alias("mean"),
                                    F.sum(F.col("m2") + F.col("n") * away * away).alias("m2"))


def rollup_from_panes(panes: DataFrame, n_hours: int | None = 12, every: str | None = None, start=None, end=None,
                      keys=SERIES_KEYS, sort: bool = True, anchor: str | None = None) -> DataFrame:
    """``rollup`` of ``n_hours``, or of the calendar interval ``every``, from
    hour panes: time, *keys, val_avg, val_stddev, val_count.

    ``start`` and ``end`` (inclusive) choose panes by their hour, so they are
    whole hours."""
    ntz = is_ntz(panes, "time")
    rows = panes.where(_time_range(panes, "time", start, end))
    time = calendar_bucket(F.col("time"), every, ntz, anchor) if every else bucket_start(F.col("time"), n_hours, ntz)
    merged = merge_panes(rows, time, keys)
    out = merged.select("time", *keys, round_numeric(F.col("mean")).alias("val_avg"),
                        round_numeric(F.sqrt(F.col("m2") / F.col("n"))).alias("val_stddev"), F.col("n").alias("val_count"))
    return out.orderBy("time", *keys) if sort else out
