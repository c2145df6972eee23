"""Incremental sync: oldest pending rows, the envelope sent to the remote
store, and marking the acknowledged ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from ..functions import is_ntz, is_pending, set_flag, utc_day, whole_json

MEASUREMENT_COLUMNS = ("id", "mac", "sid", "type", "description", "val", "ts", "battery")
STATE_COLUMNS = ("id", "segment", "data", "ts_start", "ts_end")
AGGREGATE_COLUMNS = ("id", "mac", "sid", "type", "description", "avg", "stddev", "n", "ts", "battery")


def pending_predicate(df: DataFrame, dest: str = S.CLOUD, sync: str = "sync") -> Column:
    """Not yet acknowledged by ``dest``. Map form: flag absent, NULL or false.
    Legacy boolean form: ``sync = false`` (NULL is not pending there)."""
    dt = df.schema[sync].dataType
    if isinstance(dt, T.BooleanType):
        return F.col(sync) == F.lit(False)
    return is_pending(F.col(sync), dest)


def pending(df: DataFrame, dest: str = S.CLOUD, limit: int | None = S.DEFAULT_SYNC_LIMIT,
            columns=None, order_by="id", sync: str = "sync", from_day=None,
            day_col: str = "day") -> DataFrame:
    """The ``limit`` oldest (by ``order_by``, a column or several, such as
    ``("batch_id", "pos")`` of ingested rows) rows still to send to ``dest``.
    A limit under an order becomes a top-k (each task keeps its own k, one
    small merge), not a full sort.

    The flag sits in a map, which Parquet cannot filter on, so every tick
    would scan the whole table. ``from_day`` prunes a day-partitioned table to
    the recent partitions. It must be a date before which every row is
    acknowledged: what ``oldest_pending_day`` returns, and nothing else (ids
    need not follow days). Rows without a day are always kept; a full resync
    (``reset_sync``) needs it taken anew."""
    out = df.where(pending_predicate(df, dest, sync))
    if from_day is not None and day_col in df.columns:
        out = out.where((F.col(day_col) >= F.lit(str(from_day)).cast("date")) | F.col(day_col).isNull())
    if columns is not None:
        out = out.select(*columns)
    out = out.orderBy(*([order_by] if isinstance(order_by, str) else order_by))
    return out.limit(limit) if limit is not None else out


def oldest_pending_day(df: DataFrame, dest: str = S.CLOUD, day_col: str = "day", sync: str = "sync"):
    """Day of the oldest row still to send (one aggregate pass; None when
    nothing is pending): the ``from_day`` watermark for later ticks."""
    row = df.where(pending_predicate(df, dest, sync)).agg(F.min(day_col).alias("d")).collect()[0]
    return row["d"]


def _iso(df: DataFrame, c: str) -> Column:
    dt = df.schema[c].dataType
    if isinstance(dt, T.TimestampNTZType):
        return F.date_format(F.col(c), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    if isinstance(dt, T.TimestampType):
        return F.date_format(F.col(c), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    return F.col(c)


def _payload(df: DataFrame, json_columns=()) -> Column:
    fields = []
    for f in df.schema.fields:
        if f.name in json_columns:
            fields.append(F.parse_json(F.col(f.name)).alias(f.name))
        else:
            fields.append(_iso(df, f.name).alias(f.name))
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def sync_envelope(measurements: DataFrame, log_state: DataFrame,
                  state_json_columns=("data",)) -> DataFrame:
    """Rows of one sync message: ``(source, id, payload)`` with source
    ``measurements`` or ``logState`` and the row as JSON (timestamps ISO-8601,
    ``data`` embedded as JSON). Both inputs empty -> no rows, so the sender
    skips the request (check with ``isEmpty()``)."""
    m = measurements.select(F.lit("measurements").alias("source"), F.col("id"),
                            _payload(measurements).alias("payload"))
    s = log_state.select(F.lit("logState").alias("source"), F.col("id"),
                         _payload(log_state, state_json_columns).alias("payload"))
    return m.unionByName(s)


def envelope_document(envelope: DataFrame, max_rows: int = 2 * S.DEFAULT_SYNC_LIMIT) -> DataFrame:
    """Fold the envelope rows into the single document
    ``{"measurements": [...], "logState": [...]}`` sorted by id.

    The document is made in one task, so an envelope of more than ``max_rows``
    rows (twice the limit of its ``pending`` inputs) fails the job; no more
    than that are ever gathered."""
    item = F.struct("id", "payload")
    g = envelope.limit(max_rows + 1).groupBy().agg(
        F.array_sort(F.collect_list(F.when(F.col("source") == "measurements", item))).alias("m"),
        F.array_sort(F.collect_list(F.when(F.col("source") == "logState", item))).alias("s"),
        F.count(F.lit(1)).alias("n"))
    doc = F.struct(F.transform("m", lambda x: F.parse_json(x["payload"])).alias("measurements"),
                   F.transform("s", lambda x: F.parse_json(x["payload"])).alias("logState"))
    much = F.raise_error(F.lit(f"the envelope has more than {max_rows} rows")).cast("string")
    return g.where(F.col("n") > 0).select(F.when(F.col("n") > max_rows, much).otherwise(F.to_json(doc)).alias("document"))


def mark_synced(df: DataFrame, acked: DataFrame, dest: str = S.CLOUD, value: bool = True,
                id_col: str = "id", sync: str = "sync", version_col: str | None = None) -> DataFrame:
    """Set ``sync[dest] = value`` on the rows whose id the receiver echoed;
    unknown ids change nothing, other rows keep their flags.

    A plain join: adaptive execution broadcasts the ack set when its measured
    size is small, which one sync message's is. With ``version_col`` (e.g. ``ts_end``) the ack must also carry that column
    and only rows still at the acknowledged version are flagged, so a run
    extended after it was sent stays pending."""
    keys = [id_col] + ([version_col] if version_col else [])
    ack = acked.select(*keys).dropDuplicates().withColumn("_acked", F.lit(True))
    joined = df.join(ack, keys, "left")
    flag = F.when(F.col("_acked"), set_flag(F.col(sync), dest, value)).otherwise(F.col(sync))
    return joined.withColumn(sync, flag).drop("_acked").select(*df.columns)


def mark_synced_days(df: DataFrame, acked: DataFrame, dest: str = S.CLOUD, value: bool = True,
                     day_col: str = "day", ts_col: str = "ts") -> DataFrame:
    """``mark_synced`` for a table partitioned by day (``with_day``), returning
    only the days that hold acknowledged rows (to be written back with
    ``overwrite_partitions``). ``acked`` carries ``id`` and ``ts`` (both are in
    the envelope); the semi join on the partition column prunes the scan
    at run time."""
    days = acked.select(utc_day(F.col(ts_col), is_ntz(acked, ts_col)).alias(day_col))
    return mark_synced(df.join(days, day_col, "left_semi").select(*df.columns), acked.select("id"), dest, value)


def apply_reply(status: int, reply: DataFrame, tables: dict[str, DataFrame], dest: str = S.CLOUD) -> dict[str, DataFrame]:
    """The acknowledge step: the receiver's answer to one message.

    ``reply`` has one row for each table of the message, ``(source, reply)``,
    the reply being the JSON array of the rows it took. With ``status`` 200
    each table of ``tables`` gets its ids flagged for ``dest``; with any
    other nothing changes, so the rows are sent again."""
    if status != 200:
        return dict(tables)
    out = {}
    for name, table in tables.items():
        acked = ids_from_json(reply.where(F.col("source") == name), "reply")
        out[name] = mark_synced(table, acked, dest)
    return out


def reset_sync(df: DataFrame, dest: str = S.CLOUD, sync: str = "sync") -> DataFrame:
    """Mark every row unsynced for ``dest`` (full resync). Boolean legacy
    flags become false; map flags get ``dest: false`` (a NULL map becomes
    ``{dest: false}``, deliberately, so the row is sent)."""
    dt = df.schema[sync].dataType
    if isinstance(dt, T.BooleanType):
        return df.withColumn(sync, F.lit(False))
    return df.withColumn(sync, set_flag(F.col(sync), dest, False))


ACK_SCHEMA = "struct<id:bigint>"


def ids_from_json(df: DataFrame, col: str = "reply", *keep: str) -> DataFrame:
    """Acknowledged ids from the receiver's JSON reply (``[{"id": 1}, ...]``
    or a single object), one row per id with the columns ``keep``; other keys
    are ignored. A text that is not one JSON value acknowledges nothing."""
    one, many = whole_json(F.col(col), ACK_SCHEMA), whole_json(F.col(col), f"array<{ACK_SCHEMA}>")
    items = F.when(F.ltrim(F.col(col)).startswith("{"), F.array(one)).otherwise(many)
    return df.select(*keep, F.inline(items)).where(F.col("id").isNotNull())
