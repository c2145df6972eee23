"""Time helpers that behave the same for TIMESTAMP and TIMESTAMP_NTZ columns."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def is_ntz(df: DataFrame, column: str) -> bool:
    """True when ``column`` of ``df`` is TIMESTAMP_NTZ (wall-clock, no zone)."""
    return isinstance(df.schema[column].dataType, T.TimestampNTZType)


def ts_literal(value, ntz: bool) -> Column:
    """A typed timestamp literal built from text, so the Python process time
    zone never enters: NTZ literals are wall-clock, TIMESTAMP literals are read
    in the session time zone (as PostgreSQL reads a timestamptz literal)."""
    if isinstance(value, Column):
        return value.cast("timestamp_ntz" if ntz else "timestamp")
    if isinstance(value, (_dt.datetime, _dt.date)):
        value = value.isoformat(sep=" ") if isinstance(value, _dt.datetime) else value.isoformat()
    kind = "TIMESTAMP_NTZ" if ntz else "TIMESTAMP"
    return F.expr(f"{kind} '{value}'")


def hours(n) -> Column:
    """Day-time interval of ``n`` hours (``n`` may be a column)."""
    return F.make_dt_interval(F.lit(0), n if isinstance(n, Column) else F.lit(int(n)))


def minutes(n) -> Column:
    """Day-time interval of ``n`` minutes; NULL minutes give a NULL interval."""
    return F.make_dt_interval(F.lit(0), F.lit(0), n if isinstance(n, Column) else F.lit(int(n)))


def day_start(ts: Column, ntz: bool) -> Column:
    """Midnight of the day of ``ts`` (session zone for TIMESTAMP)."""
    if ntz:
        return ts.cast("date").cast("timestamp_ntz")
    return F.date_trunc("DAY", ts)


def bucket_start(ts: Column, n_hours: int, ntz: bool) -> Column:
    """Start of the ``n_hours`` bucket of ``ts``, anchored at local midnight:
    day start + (hour div n) * n hours. This is not ``F.window`` (which is
    anchored at the epoch); the two agree only when n divides 24 in UTC.
    With n not dividing 24 the last bucket of a day is short."""
    if not 1 <= int(n_hours) <= 24:
        raise ValueError("n_hours must be within 1..24")
    n = int(n_hours)
    offset = F.floor(F.hour(ts) / F.lit(n)).cast("int") * F.lit(n)
    return day_start(ts, ntz) + hours(offset)


def micros_between(start: Column, end: Column) -> Column:
    """Exact microseconds from ``start`` to ``end`` (both same timestamp kind)."""
    return F.timestamp_diff("MICROSECOND", start, end)


def utc_day(ts: Column, ntz: bool) -> Column:
    """The date that stored tables are partitioned by: that of ``ts`` in UTC
    (of the wall clock for NTZ), whatever the session zone."""
    if ntz:
        return ts.cast("date")
    return F.date_from_unix_date(F.floor(F.unix_micros(ts) / F.lit(86_400_000_000)).cast("int"))


def day_range(day: Column, start: Column | None, end: Column | None, ntz: bool) -> Column:
    """Partitions that can hold times from ``start`` to ``end``, with a day of
    slack on either side; rows without a day are kept."""
    pred = F.lit(True)
    if start is not None:
        pred = pred & (day >= F.date_sub(utc_day(start, ntz), 1))
    if end is not None:
        pred = pred & (day <= F.date_add(utc_day(end, ntz), 1))
    return pred | day.isNull()


#: Days of a week, months of a month, quarter and year.
_DAYS, _MONTHS = {"day": 1, "week": 7}, {"month": 1, "quarter": 3, "year": 12}
#: Where buckets are counted from: a Monday for weeks, the start of 1970 for all else.
_MONDAY, _EPOCH = "1970-01-05", "1970-01-01"


def parse_interval(every: str) -> tuple[int, str]:
    """``"12 hours"``, ``"1 day"``, ``"2 weeks"``, ``"month"`` as (number, unit)."""
    words = every.lower().split()
    n, unit = (words[0], words[1]) if len(words) == 2 else ("1", words[0] if words else "")
    unit = unit[:-1] if unit.endswith("s") else unit
    if not n.isdigit() or int(n) < 1 or len(words) > 2 or unit not in ("hour", *_DAYS, *_MONTHS):
        raise ValueError(f"not an interval of hours, days, weeks, months, quarters or years: {every!r}")
    return int(n), unit


def _wall(ts: Column, ntz: bool) -> Column:
    return ts if ntz else ts.cast("timestamp_ntz")  # wall clock of the session zone


def _from_wall(wall: Column, ntz: bool) -> Column:
    return wall.cast("timestamp_ntz") if ntz else wall.cast("timestamp_ntz").cast("timestamp")


def calendar_bucket(ts: Column, every: str, ntz: bool, anchor: str | None = None) -> Column:
    """Start of the calendar interval that holds ``ts``.

    Days, weeks, months, quarters and years begin at local midnight, counted
    from ``anchor`` (a date; the start of 1970, or for weeks a Monday), so a day
    of 23 or 25 hours is one bucket, whatever its length. Hours up to 24 are those
    of ``bucket_start``; more are counted on the wall clock from the anchor's midnight."""
    n, unit = parse_interval(every)
    if unit == "hour" and n <= 24 and anchor is None:
        return bucket_start(ts, n, ntz)
    start = F.lit(anchor or (_MONDAY if unit == "week" else _EPOCH)).cast("date")
    wall = _wall(ts, ntz)
    if unit == "hour":
        past = F.timestamp_diff("HOUR", start.cast("timestamp_ntz"), F.date_trunc("HOUR", wall).cast("timestamp_ntz"))
        return _from_wall(start.cast("timestamp_ntz") + hours((F.floor(past / n) * n).cast("int")), ntz)
    if unit in _DAYS:
        days = n * _DAYS[unit]
        past = F.floor(F.datediff(wall.cast("date"), start) / days) * days
        return _from_wall(F.date_add(start, past.cast("int")), ntz)
    months = n * _MONTHS[unit]
    of = lambda d: F.year(d) * 12 + F.month(d)
    first = F.trunc(start, "MM")
    past = F.floor((of(wall) - of(start)) / months) * months
    return _from_wall(F.add_months(first, past.cast("int")), ntz)


def calendar_next(start: Column, every: str, ntz: bool, anchor: str | None = None) -> Column:
    """Where the interval that begins at ``start`` ends: the start of the next.
    The last hour bucket of a day ends with the day."""
    n, unit = parse_interval(every)
    wall = _wall(start, ntz)
    if unit == "hour" and n <= 24 and anchor is None:
        return F.least(start + hours(n), _from_wall(F.date_add(wall.cast("date"), 1), ntz))
    if unit == "hour":
        return _from_wall(wall + hours(n), ntz)
    if unit in _DAYS:
        return _from_wall(F.date_add(wall.cast("date"), n * _DAYS[unit]), ntz)
    return _from_wall(F.add_months(wall.cast("date"), n * _MONTHS[unit]), ntz)
