"""Periodic sync and change notification driven by streaming triggers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schemas as S
from ..functions import is_ntz
from ..operators.readings import LEGACY_CLOSED, Bounds, aggregate_and_mark, mark_used, mark_used_days
from ..sources.epochs import done as _done, serial_epoch
from ..session import cut_lineage
from ..sources.acked import AckedTable
from ..sources.tables import overwrite_partitions
from ..operators.sync import (AGGREGATE_COLUMNS, MEASUREMENT_COLUMNS, STATE_COLUMNS, apply_reply, envelope_document,
                              pending, sync_envelope)


def sync_tick(measurements: DataFrame, log_state: DataFrame, outbox_dir: str, tick_id: int,
              limit: int = S.DEFAULT_SYNC_LIMIT, from_day=None) -> bool:
    """One sync: the oldest ``limit`` pending rows of both tables as one
    document written to ``outbox_dir/tick=<id>``; nothing is written when
    both are empty. Returns whether a document was written. Acknowledged ids
    come back later and go through ``mark_synced``. ``from_day`` (the day
    watermark of ``pending``) limits the measurement scan to recent days."""
    env = sync_envelope(pending(measurements, limit=limit, columns=MEASUREMENT_COLUMNS, from_day=from_day),
                        pending(log_state, limit=limit, columns=STATE_COLUMNS))
    document = envelope_document(env, 2 * limit).first()  # one document of 2 * limit rows at most
    if document is None:
        return False
    spark = measurements.sparkSession
    spark.createDataFrame([tuple(document)], "document string").write.mode("overwrite").text(f"{outbox_dir}/tick={tick_id}")
    return True


def tick_stream(spark: SparkSession, action: Callable[[int], None], checkpoint: str,
                interval: str = "5 minutes") -> StreamingQuery:
    """Run ``action(tick_id)`` once per ``interval`` from a processing-time
    trigger over the built-in rate source (a timer without a scheduler)."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return (ticks.writeStream.foreachBatch(lambda df, i: action(i))
            .option("checkpointLocation", checkpoint)
            .trigger(processingTime=interval).start())


def acked_tick(measurements: AckedTable, log_state: AckedTable, outbox_dir: str, tick_id: int,
               limit: int = S.DEFAULT_SYNC_LIMIT) -> bool:
    """``sync_tick`` over tables that keep their acknowledgements apart: it
    reads the days that can hold rows to send, and keeps the ids of the message
    before it goes out, so that its answer can be told from others."""
    rows, runs = measurements.pending(limit).persist(), log_state.pending(limit).persist()  # one message
    try:
        document = envelope_document(sync_envelope(rows.select(*MEASUREMENT_COLUMNS), runs.select(*STATE_COLUMNS)), 2 * limit).first()
        if document is None:
            return False
        measurements.note_sent(rows, tick_id)
        log_state.note_sent(runs, tick_id)
        spark = measurements.spark
        spark.createDataFrame([tuple(document)], "document string").write.mode("overwrite").text(f"{outbox_dir}/tick={tick_id}")
        return True
    finally:
        rows.unpersist()
        runs.unpersist()


def sync_stream(spark: SparkSession, measurements: AckedTable, log_state: AckedTable, outbox_dir: str, checkpoint: str,
                interval: str = "5 minutes", limit: int = S.DEFAULT_SYNC_LIMIT) -> StreamingQuery:
    """Periodic sync: each tick ships what is pending in both tables."""
    return tick_stream(spark, lambda i: acked_tick(measurements, log_state, outbox_dir, i, limit), checkpoint, interval)


def answer_tick(reply: DataFrame, tables: list[AckedTable], tick_id: int, status: int) -> bool:
    """The answer (source, reply) to the message of ``tick_id``: its ids are
    added to each table's acknowledgements. Returns whether any were."""
    return any([t.acknowledge(reply, tick_id, status) for t in tables])


def ack_tick(reply: DataFrame, tables: dict[str, DataFrame], dirs: dict[str, str], tick_id: int, status: int) -> bool:
    """The answer to the message of ``tick_id``: with status 200 each table is
    written anew, acknowledged rows flagged, to ``dirs[name]/v=<tick>``; with any
    other nothing is written. Returns whether it was."""
    if status != 200:
        return False
    for name, table in apply_reply(status, reply, tables).items():
        table.write.mode("overwrite").parquet(f"{dirs[name]}/v={tick_id}")
    return True


def notify_stream(spark: SparkSession, agg_dir: str, schema, outbox_dir: str, checkpoint: str,
                  load_aggregates: Callable[[], DataFrame], limit: int,
                  debounce: str = "5 seconds", trigger: dict | None = None) -> StreamingQuery:
    """Change notification on the aggregate table: new files in ``agg_dir``
    trigger (at most once per ``debounce``) shipping all pending aggregates, in
    messages of ``limit`` rows in the order of their ids, to
    ``outbox_dir/batch=<id>/message=<n>``."""
    def on_batch(df: DataFrame, i: int) -> None:
        if df.isEmpty():
            return
        left, n = load_aggregates(), 0
        while rows := pending(left, limit=limit, columns=AGGREGATE_COLUMNS).collect():  # one message
            spark.createDataFrame(rows, left.select(*AGGREGATE_COLUMNS).schema).coalesce(1) \
                .write.mode("overwrite").json(f"{outbox_dir}/batch={i}/message={n}")
            left, n = left.where(left["id"] > rows[-1]["id"]), n + 1

    return (spark.readStream.schema(schema).parquet(agg_dir).writeStream
            .foreachBatch(on_batch).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"processingTime": debounce})).start())


def _kept_as_of(spark: SparkSession, path: str, as_of) -> str:
    """The time of the tick's first try, kept as text."""
    if not _done(spark, path):
        spark.createDataFrame([(str(as_of),)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return spark.read.text(path).first()["value"]


def aggregate_tick(measurements: DataFrame, agg_dir: str, marked_dir: str, tick_id: int, as_of,
                   window_minutes: int, bounds: Bounds = LEGACY_CLOSED, day_col: str = "day") -> None:
    """One run of the trailing aggregate: the aggregates go to
    ``agg_dir/tick=<id>``, then the consumed flags are written. The first try
    of a tick keeps its ``as_of`` in ``agg_dir/_as_of/tick=<id>``; a replay takes
    that and overwrites the tick's own folder, so it repeats the same run and
    no reading counts twice, wherever the first try failed. Ids go on where the
    ticks before this one ended.

    When the measurements carry a ``day_col`` partition column, ``marked_dir``
    is that day-partitioned table and only the days of the window are
    rewritten (dynamic partition overwrite); otherwise the whole marked table
    is written as a new version ``marked_dir/v=<tick>``."""
    spark = measurements.sparkSession
    as_of = _kept_as_of(spark, f"{agg_dir}/_as_of/tick={tick_id}", as_of)
    by_day = day_col if day_col in measurements.columns else None
    if not _done(spark, f"{agg_dir}/tick={tick_id}"):
        aggs, _ = aggregate_and_mark(measurements, as_of, window_minutes, bounds, day_col=by_day, run_id=tick_id)
        aggs = serial_epoch(aggs, ("mac", "sid", "type", "description"), f"{agg_dir}/_ids", tick_id).select(*aggs.columns)
        aggs.write.mode("overwrite").parquet(f"{agg_dir}/tick={tick_id}")
    if by_day:
        changed = cut_lineage(mark_used_days(measurements, as_of, window_minutes, bounds))
        overwrite_partitions(changed, marked_dir, [day_col])
    else:
        mark_used(measurements, as_of, window_minutes, bounds) \
            .write.mode("overwrite").parquet(f"{marked_dir}/v={tick_id}")


def literal_text(instant: Column, ntz: bool) -> Column:
    """An instant as the text of a time literal: with its offset, as the hour that
    a zone repeats has two instants for each time of day; wall-clock time of the
    session's zone for columns that have no zone."""
    return F.date_format(instant, "yyyy-MM-dd HH:mm:ss" + ("" if ntz else "xxx"))


def aggregate_stream(spark: SparkSession, load_measurements: Callable[[], DataFrame], agg_dir: str,
                     marked_dir: str, checkpoint: str, window_minutes: int,
                     bounds: Bounds = LEGACY_CLOSED, interval: str = "30 minutes") -> StreamingQuery:
    """Periodic trailing aggregate: every ``interval`` aggregate what the
    last ``window_minutes`` brought, with the trigger time as ``as_of``."""
    def run(i: int) -> None:
        measurements = load_measurements()
        now = spark.range(1).select(literal_text(F.current_timestamp(), is_ntz(measurements, "ts"))).first()[0]
        aggregate_tick(measurements, agg_dir, marked_dir, i, now, window_minutes, bounds)

    return tick_stream(spark, run, checkpoint, interval)
