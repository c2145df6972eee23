"""Acknowledgements kept as a table of their own and merged when read.

An answer appends the ids it acknowledges and rewrites nothing. Readers see a
row's flag as its stored one changed by the last acknowledgement of its id.
Now and then the acknowledgements are folded into the stored rows, day by day;
from then on a reader starts after the folded tick. Marks say which days have no
row left to send, so that a tick reads only the others (``sources.acked`` keeps
all of this in folders).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import is_ntz, set_flag, utc_day
from .sync import ids_from_json, pending_predicate

#: One row for each row of a message; one for each id an answer takes; one for each change of a day.
SENT = "source string, id bigint, day date, version string"
ACKS = "source string, id bigint, day date, version string, dest string, value boolean, tick bigint"
MARKS = "source string, dest string, day date, seq bigint, open boolean"


def _version(version_col: str | None) -> Column:
    return (F.col(version_col) if version_col else F.lit(None)).cast("string")


def sent_rows(source: str, rows: DataFrame, ts: str = "ts", id_col: str = "id", version_col: str | None = None) -> DataFrame:
    """(source, id, day, version) of a message's rows, kept until it is answered.

    ``version_col`` (such as a run's ``ts_end``) is for rows that can change
    after they were sent: an acknowledgement then holds for that version alone."""
    return rows.select(F.lit(source).alias("source"), F.col(id_col).cast("bigint").alias("id"),
                       utc_day(F.col(ts), is_ntz(rows, ts)).alias("day"), _version(version_col).alias("version"))


def acknowledgements(reply: DataFrame, sent: DataFrame, tick: int, dest: str = S.CLOUD, value: bool = True) -> DataFrame:
    """The rows that an answer adds: one for each id of ``reply`` (source,
    reply) that was sent. An id that the message didn't hold, or that is echoed
    twice, adds nothing."""
    echoed = ids_from_json(reply, "reply", "source").distinct()
    return (sent.join(echoed, ["source", "id"], "left_semi").distinct()
            .select("source", "id", "day", "version", F.lit(dest).alias("dest"), F.lit(value).alias("value"),
                    F.lit(int(tick)).cast("bigint").alias("tick")))


def last_acks(acks: DataFrame, source: str, dest: str = S.CLOUD, after: int | None = None) -> DataFrame:
    """(id, last): what the latest tick says of each id, of those after the
    tick ``after`` (which prunes a table partitioned by tick). Partial
    aggregates only, so an id that is echoed very often costs one row a task."""
    own = acks.where((F.col("source") == source) & (F.col("dest") == dest))
    if after is not None:
        own = own.where(F.col("tick") > F.lit(int(after)))
    return own.groupBy("id").agg(F.max(F.struct("tick", "value", "version")).alias("last"))


def _joined(rows: DataFrame, acks: DataFrame, source: str, dest: str, after: int | None, id_col: str,
            version_col: str | None) -> DataFrame:
    """``rows`` with ``_acked``: the flag an acknowledgement sets, NULL where none holds."""
    last = last_acks(acks, source, dest, after).select(F.col("id").alias("_ack_id"), F.col("last").alias("_last"))
    holds = F.lit(True)
    if version_col:
        holds = F.col("_last.version").isNull() | (F.col("_last.version") == _version(version_col))
    joined = rows.join(last, rows[id_col] == last["_ack_id"], "left")
    return joined.withColumn("_acked", F.when(holds, F.col("_last.value"))).drop("_last", "_ack_id")


def with_acks(df: DataFrame, acks: DataFrame, source: str, dest: str = S.CLOUD, after: int | None = None,
              id_col: str = "id", sync: str = "sync", version_col: str | None = None) -> DataFrame:
    """The table with its flags as the acknowledgements leave them. A plain
    join: adaptive execution broadcasts the unfolded ids when they are few.

    With ``version_col`` an acknowledgement of another version changes nothing."""
    joined = _joined(df, acks, source, dest, after, id_col, version_col)
    flag = (F.when(F.col("_acked"), set_flag(F.col(sync), dest, True))
            .when(~F.col("_acked"), set_flag(F.col(sync), dest, False)).otherwise(F.col(sync)))
    return joined.withColumn(sync, flag).select(*df.columns)


def closed_days(marks: DataFrame, source: str, dest: str = S.CLOUD) -> DataFrame:
    """(day): the days whose last mark says that no row is left to send. A day
    without a mark may hold some, and of two marks with one number the open one counts."""
    last = (marks.where((F.col("source") == source) & (F.col("dest") == dest))
            .groupBy("day").agg(F.max(F.struct("seq", "open")).alias("last")))
    return last.where(~F.col("last.open")).select("day")


def pending_delta(df: DataFrame, acks: DataFrame, source: str, dest: str = S.CLOUD, limit: int | None = S.DEFAULT_SYNC_LIMIT,
                  columns=None, order_by="id", after: int | None = None, closed=(), day_col: str = "day",
                  id_col: str = "id", sync: str = "sync", version_col: str | None = None) -> DataFrame:
    """``pending`` of a table whose acknowledgements lie apart: the oldest
    ``limit`` rows that the last acknowledgement, or without one the stored flag,
    leaves to send.

    ``closed`` (days, of ``closed_days``) leaves those partitions unread; rows
    without a day are always read."""
    rows = df
    if closed:
        days = [F.lit(str(d)).cast("date") for d in closed]
        rows = rows.where(~F.col(day_col).isin(days) | F.col(day_col).isNull())
    joined = _joined(rows, acks, source, dest, after, id_col, version_col)
    left = joined.where(F.when(F.col("_acked").isNotNull(), ~F.col("_acked")).otherwise(pending_predicate(rows, dest, sync)))
    out = left.select(*(columns if columns is not None else df.columns))
    out = out.orderBy(*([order_by] if isinstance(order_by, str) else order_by))
    return out.limit(limit) if limit is not None else out
