"""Calendar rollup of a stream in local time: a bucket is closed by a timer at
its own end, so buckets may begin at local midnight, be cut short by it, or
have 23 or 25 hours."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import calendar_bucket, calendar_next, round_numeric
from ..operators.readings import SERIES_KEYS, STRICT_60, Bounds


class _Buckets(StatefulProcessor):
    """Per series: for each open bucket its end, count, mean and squared
    deviations. A bucket's timer is its end; it fires once the watermark is
    past it. What a series holds is bounded by the buckets that the watermark's
    delay spans."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "start BIGINT", "until BIGINT, n BIGINT, mean DOUBLE, m2 DOUBLE")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        late: dict[tuple[int, int], int] = {}
        for batch in rows:
            for (start, until), g in batch.groupby(["start", "until"]):
                start, until, vals = int(start), int(until), g["val"].astype("float64")
                if until <= now * 1000:  # its bucket is closed
                    late[start, until] = late.get((start, until), 0) + len(vals)
                    continue
                n, mean = len(vals), float(vals.mean())
                m2 = float(((vals - mean) ** 2).sum())
                if self.open.containsKey((start,)):
                    _, n0, mean0, m20 = self.open.getValue((start,))
                    n, mean, m2 = _merged(n0, mean0, m20, n, mean, m2)
                else:
                    self.handle.registerTimer(-(-until // 1000))
                self.open.updateValue((start,), (until, n, mean, m2))
        if late:
            yield _frame(key, [(s, u, None, None, 0, n) for (s, u), n in sorted(late.items())])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at, out = expiredTimerInfo.getExpiryTimeInMs(), []
        for k, v in list(self.open.iterator()):
            if -(-v[0] // 1000) <= at:
                out.append((k[0], v[0], v[2], (v[3] / v[1]) ** 0.5, v[1], 0))
                self.open.removeKey(k)
        if out:
            yield _frame(key, sorted(out))

    def close(self) -> None:
        pass


def _merged(n0: int, mean0: float, m20: float, n1: int, mean1: float, m21: float) -> tuple[int, float, float]:
    n, away = n0 + n1, mean1 - mean0
    return n, mean0 + away * n1 / n, m20 + m21 + away * away * n0 * n1 / n


def _frame(key, rows: list[tuple]) -> pd.DataFrame:
    mac, sid, kind = key
    return pd.DataFrame({
        "start": [r[0] for r in rows], "until": [r[1] for r in rows], "mac": mac, "sid": sid, "type": kind,
        "mean": [r[2] for r in rows], "std": [r[3] for r in rows], "n": [r[4] for r in rows], "late": [r[5] for r in rows]})


def calendar_stream(readings: DataFrame, every: str = "1 day", bounds: Bounds = STRICT_60, late: str = "1 hour",
                    anchor: str | None = None) -> DataFrame:
    """Streaming twin of ``rollup(..., every=...)``: time, time_end, mac, sid, type,
    val_avg, val_stddev, val_count, late, in append mode.

    A bucket of any interval of ``calendar_bucket``, in the session's zone, comes
    out once, when the watermark (``late`` behind the latest reading) has passed
    its end. Readings for a bucket that is closed don't change it: they come out
    as a row with ``val_count`` 0 and their number in ``late``. ``ts`` is a
    TIMESTAMP. The state needs the RocksDB provider
    (``spark.sql.streaming.stateStore.providerClass``) and holds, for each
    series, a few numbers for each bucket that the watermark hasn't passed."""
    ts = F.col("ts")
    start = calendar_bucket(ts, every, False, anchor)
    rows = (readings.where(bounds.predicate(F.col("val"), F.col("type"))).withWatermark("ts", late)
            # without ``ts``, whose late rows Spark would drop uncounted
            .select(*SERIES_KEYS, "val", F.unix_micros(start).alias("start"),
                    F.unix_micros(calendar_next(start, every, False, anchor)).alias("until")))
    out = rows.groupBy(*SERIES_KEYS).transformWithStateInPandas(
        _Buckets(), "start bigint, until bigint, mac string, sid smallint, type string, mean double, std double, n bigint, late bigint",
        "Append", "EventTime")
    return out.select(F.timestamp_micros("start").alias("time"), F.timestamp_micros("until").alias("time_end"), *SERIES_KEYS,
                      round_numeric(F.col("mean")).alias("val_avg"), round_numeric(F.col("std")).alias("val_stddev"),
                      F.col("n").alias("val_count"), "late")
