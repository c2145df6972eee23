"""Reading-level operators: outlier filter, calendar rollups, nested rollup,
trailing aggregate that consumes each reading once.

All are DataFrame -> DataFrame and carry no clock: "now" is ``as_of``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import (bucket_start, calendar_bucket, calendar_next, day_range, is_ntz, minutes, round_numeric, round_to_short,
                         ts_literal)

SERIES_KEYS = ("mac", "sid", "type")


@dataclass(frozen=True)
class Bounds:
    """Type-dependent value bounds.

    ``per_type`` maps a reading type to ``(low, high)``; ``other`` applies to
    every other type, or, when None, rows of other types are dropped.
    ``closed`` picks ``low <= v <= high`` instead of ``low < v < high``.
    """

    per_type: dict = field(default_factory=dict)
    other: tuple | None = S.OTHER_TYPE_BOUNDS
    closed: bool = False

    def _edge(self, type_col: Column, idx: int) -> Column:
        expr = None
        for t, pair in self.per_type.items():
            cond = type_col == F.lit(t)
            lit = F.lit(float(pair[idx]))
            expr = F.when(cond, lit) if expr is None else expr.when(cond, lit)
        fallback = F.lit(float(self.other[idx])) if self.other is not None else F.lit(None).cast("double")
        return fallback if expr is None else expr.otherwise(fallback)

    def predicate(self, val: Column, type_col: Column) -> Column:
        """Row-level test. Adds the implied coarse range (min low, max high)
        and, without ``other``, the type list: both are plain comparisons
        Parquet can use for row-group skipping, while the CASE itself is not."""
        lo, hi = self._edge(type_col, 0), self._edge(type_col, 1)
        v = val.cast("double")
        exact = (v >= lo) & (v <= hi) if self.closed else (v > lo) & (v < hi)
        pairs = list(self.per_type.values()) + ([self.other] if self.other is not None else [])
        if not pairs:
            return F.lit(False)
        min_lo = float(min(p[0] for p in pairs))
        max_hi = float(max(p[1] for p in pairs))
        coarse = (val >= F.lit(min_lo)) & (val <= F.lit(max_hi)) if self.closed else \
            (val > F.lit(min_lo)) & (val < F.lit(max_hi))
        pred = coarse & exact
        if self.other is None:
            pred = type_col.isin(list(self.per_type)) & pred
        return pred


# presets
STRICT_70 = Bounds(S.STRICT_70, S.OTHER_TYPE_BOUNDS, closed=False)
STRICT_60 = Bounds(S.STRICT_60, S.OTHER_TYPE_BOUNDS, closed=False)
LEGACY_CLOSED = Bounds(S.LEGACY_CLOSED, None, closed=True)


def _time_range(df: DataFrame, ts: str, start, end, day_col: str | None = None) -> Column:
    """Closed time range on ``ts``. With ``day_col``, the partition column of a
    table stored by ``sources.tables.write_measurements``, also a range of days
    with a day of slack on either side, so whole partitions are pruned at
    planning time in whatever zone writer and reader are; the ``ts`` bounds
    stay exact."""
    ntz = is_ntz(df, ts)
    pred = F.lit(True)
    if start is not None:
        pred = pred & (F.col(ts) >= ts_literal(start, ntz))
    if end is not None:
        pred = pred & (F.col(ts) <= ts_literal(end, ntz))
    if day_col is not None:
        pred = pred & day_range(F.col(day_col), None if start is None else ts_literal(start, ntz),
                                None if end is None else ts_literal(end, ntz), ntz)
    return pred


def filter_readings(df: DataFrame, bounds: Bounds = STRICT_70, start=None, end=None,
                    sort: bool = True, value: str = "val", type_col: str = "type",
                    ts: str = "ts", day_col: str | None = None) -> DataFrame:
    """Readings whose value is inside the type's bounds and whose time is in
    the closed range ``[start, end]`` (an ``end`` given as a date is its
    midnight, so that day itself is left out). NULL values drop out.
    Ordered by time when ``sort``."""
    out = df.where(_time_range(df, ts, start, end, day_col) & bounds.predicate(F.col(value), F.col(type_col)))
    return out.orderBy(ts) if sort else out


def outliers(df: DataFrame, bounds: Bounds = STRICT_70, start=None, end=None, value: str = "val",
             type_col: str = "type", ts: str = "ts", day_col: str | None = None) -> DataFrame:
    """The side output of ``filter_readings``: readings of the same time range
    that it drops, NULL values included."""
    inside = F.coalesce(bounds.predicate(F.col(value), F.col(type_col)), F.lit(False))
    return df.where(_time_range(df, ts, start, end, day_col) & ~inside)


def retain(df: DataFrame, as_of, keep_minutes: int, dest: str = S.CLOUD, ts: str = "ts",
           sync: str = "sync", day_col: str | None = None) -> DataFrame:
    """The rows a clean-up at ``as_of`` leaves: everything younger than
    ``keep_minutes`` and everything that ``dest`` has not acknowledged."""
    ntz = is_ntz(df, ts)
    since = ts_literal(as_of, ntz) - minutes(keep_minutes)
    return df.where((F.col(ts) > since) | ~F.coalesce(F.col(sync).getItem(dest), F.lit(False)))


def rollup(df: DataFrame, n_hours: int = 12, bounds: Bounds = STRICT_60, start=None, end=None,
           keys=SERIES_KEYS, series: DataFrame | None = None, types=None, sort: bool = True,
           value: str = "val", ts: str = "ts", day_col: str | None = None, every: str | None = None,
           anchor: str | None = None) -> DataFrame:
    """Calendar rollup: per ``n_hours`` bucket (anchored at local midnight) and
    series, the average and population deviation rounded to 2 places, and
    the count of values. ``every`` (``"1 day"``, ``"2 weeks"``, ``"1 month"``, ...)
    takes calendar intervals from ``anchor`` on instead of ``n_hours``.

    ``types`` keeps only these reading types; ``series`` (a DataFrame of
    ``keys`` columns) keeps only those series through a semi join, which
    adaptive execution turns into a broadcast when the measured side is small.
    Output: time, *keys, val_avg, val_stddev, val_count.
    """
    rows = filter_readings(df, bounds, start, end, sort=False, value=value, ts=ts, day_col=day_col)
    if types is not None:
        rows = rows.where(F.col("type").isin(list(types)))
    if series is not None:
        rows = rows.join(series.select(*keys), list(keys), "left_semi")
    ntz = is_ntz(df, ts)
    bucket = (calendar_bucket(F.col(ts), every, ntz, anchor) if every else bucket_start(F.col(ts), n_hours, ntz)).alias("time")
    out = (rows.groupBy(bucket, *keys)
           .agg(round_numeric(F.avg(value)).alias("val_avg"),
                round_numeric(F.stddev_pop(value)).alias("val_stddev"),
                F.count(value).alias("val_count")))
    return out.orderBy("time", *keys) if sort else out


@dataclass(frozen=True)
class Mirror:
    """The fixed parameters with which aggregated data is mirrored elsewhere:
    being fixed, a time says what the mirror has already."""

    intervals: tuple = S.MIRROR_INTERVALS
    bounds: Bounds = STRICT_60
    keys: tuple = SERIES_KEYS


def mirror_rollup(df: DataFrame, as_of, sent_until=None, mirror: Mirror = Mirror(), ts: str = "ts", sort: bool = True,
                  day_col: str | None = None) -> DataFrame:
    """The rows to add to a mirror at ``as_of``: for each interval of
    ``mirror`` the buckets that end by then, and after ``sent_until``, the time
    of the last delivery. With each delivery from where the last one ended,
    every bucket is delivered once, when it is over.

    Output: every, time, time_end, *keys, val_avg, val_stddev, val_count. Each
    interval reads only readings that its buckets can hold."""
    ntz = is_ntz(df, ts)
    now = ts_literal(as_of, ntz)
    out = None
    for every in mirror.intervals:
        rows, until = df.where(F.col(ts) < now), None
        if sent_until is not None:
            # buckets that end after the last delivery begin at or after the one that held it
            until = ts_literal(sent_until, ntz)
            rows = rows.where(F.col(ts) >= calendar_bucket(until, every, ntz))
        if day_col is not None:
            rows = rows.where(day_range(F.col(day_col), None if until is None else calendar_bucket(until, every, ntz), now, ntz))
        r = rollup(rows, bounds=mirror.bounds, keys=mirror.keys, every=every, sort=False, ts=ts)
        end = calendar_next(F.col("time"), every, ntz)
        over = end <= now if until is None else (end <= now) & (end > until)
        r = r.where(over).select(F.lit(every).alias("every"), "time", end.alias("time_end"), *mirror.keys,
                                 "val_avg", "val_stddev", "val_count")
        out = r if out is None else out.unionByName(r)
    return out.orderBy("every", "time", *mirror.keys) if sort else out


def series_key(keys=SERIES_KEYS) -> Column:
    """``mac || '_' || sid || '_' || type``; NULL when any part is NULL."""
    parts = []
    for i, k in enumerate(keys):
        if i:
            parts.append(F.lit("_"))
        parts.append(F.col(k).cast("string"))
    return F.concat(*parts)


def rollup_nested(rollup_df: DataFrame, keys=SERIES_KEYS, parts: int = 64, as_json: bool = True,
                  sort: bool = True) -> DataFrame:
    """One row per bucket holding all its series as an array of
    ``{key, val_avg, val_stddev, val_count}`` sorted by key (JSON text when
    ``as_json``).

    An array has one element per series, so it grows with the fleet, not with
    the readings. A bucket is split into ``parts`` rows by a hash of the key
    (column ``part``; parts without a series have no row), so that no row
    and no task holds a whole fleet; ``parts=1`` gives one row per bucket.
    """
    item = F.struct(series_key(keys).alias("key"), "val_avg", "val_stddev", "val_count")
    group = [F.col("time")]
    if parts > 1:
        group.append((F.conv(F.substring(F.md5(F.coalesce(series_key(keys), F.lit(""))), 1, 6), 16, 10).cast("int") % parts).alias("part"))
    arr = F.array_sort(F.collect_list(item))
    out = rollup_df.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_series"),
        (F.to_json(arr) if as_json else arr).alias("readings_json" if as_json else "readings"))
    if not sort:
        return out
    return out.orderBy("time", "part") if parts > 1 else out.orderBy("time")


def _trailing_predicate(df: DataFrame, as_of, window_minutes: int, bounds: Bounds,
                        value: str, ts: str, day_col: str | None = None) -> Column:
    ntz = is_ntz(df, ts)
    # now() - ts < interval, written as ts > now() - interval so the scan can
    # use it; rows stamped in the future stay inside, as in the original
    since = ts_literal(as_of, ntz) - minutes(window_minutes)
    pred = (F.col(ts) > since) & bounds.predicate(F.col(value), F.col("type"))
    if day_col is not None:
        pred = pred & day_range(F.col(day_col), since, None, ntz)
    return pred


def trailing_aggregate(df: DataFrame, as_of, window_minutes: int, bounds: Bounds = LEGACY_CLOSED,
                       value: str = "val", ts: str = "ts", sort: bool = True,
                       day_col: str | None = None, run_id: int = 0) -> DataFrame:
    """Per (mac, sid, type, description), over readings younger than
    ``window_minutes`` at ``as_of`` whose value is inside the bounds and that
    no earlier run consumed (``agg = false``; NULL counts as consumed): mean and
    population deviation as float, count, run time, rounded mean battery and
    ``sync = false``. One pass covers every type of ``bounds``.

    ``id`` tells the rows of all runs apart and orders them by run:
    ``run_id`` in the upper bits, a hash of the series in the lower 40."""
    ntz = is_ntz(df, ts)
    rows = df.where(_trailing_predicate(df, as_of, window_minutes, bounds, value, ts, day_col)
                    & (F.col("agg") == F.lit(False)))
    series = F.xxhash64("mac", "sid", "type", "description").bitwiseAND(F.lit((1 << 40) - 1))
    out = (rows.groupBy("mac", "sid", "type", "description")
           .agg(F.avg(value).cast("float").alias("avg"),
                F.stddev_pop(value).cast("float").alias("stddev"),
                F.count(value).alias("n"),
                round_to_short(F.avg("battery")).alias("battery"))
           .select((F.lit(int(run_id) << 40).cast("bigint") + series).alias("id"),
                   "mac", "sid", "type", "description", "avg", "stddev", "n",
                   ts_literal(as_of, ntz).alias("ts"), "battery", F.lit(False).alias("sync")))
    if sort:
        out = out.orderBy("mac", "sid", "type", F.col("description").asc_nulls_last())
    return out


def mark_used(df: DataFrame, as_of, window_minutes: int, bounds: Bounds = LEGACY_CLOSED,
              value: str = "val", ts: str = "ts") -> DataFrame:
    """The table with ``agg = true`` on every reading the trailing aggregate
    at ``as_of`` covers (same window and bounds; consumed rows stay consumed)."""
    used = _trailing_predicate(df, as_of, window_minutes, bounds, value, ts)
    return df.withColumn("agg", F.when(used, F.lit(True)).otherwise(F.col("agg")))


def mark_used_days(df: DataFrame, as_of, window_minutes: int, bounds: Bounds = LEGACY_CLOSED,
                   value: str = "val", ts: str = "ts", day_col: str = "day") -> DataFrame:
    """``mark_used`` restricted to the days the run can change: only readings
    of a day at or after the window start (less the slack) can gain the flag. Written with
    dynamic partition overwrite into a table partitioned by day
    (``sources.tables.overwrite_partitions``), a run rewrites the few days of
    its window instead of the whole table; the day filter prunes partitions
    at the scan."""
    ntz = is_ntz(df, ts)
    since = ts_literal(as_of, ntz) - minutes(window_minutes)
    recent = df.where(day_range(F.col(day_col), since, None, ntz))
    return mark_used(recent, as_of, window_minutes, bounds, value, ts)


def aggregate_and_mark(df: DataFrame, as_of, window_minutes: int, bounds: Bounds = LEGACY_CLOSED,
                       value: str = "val", ts: str = "ts", day_col: str | None = None, run_id: int = 0):
    """One aggregation run: ``(aggregates, measurements_with_new_agg)`` for the
    same ``as_of``. Write both in one job (or stage the aggregates first) so a
    failed run consumes nothing."""
    return (trailing_aggregate(df, as_of, window_minutes, bounds, value, ts, sort=False, day_col=day_col, run_id=run_id),
            mark_used(df, as_of, window_minutes, bounds, value, ts))
