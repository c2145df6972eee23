"""The registered queries: each maps the supplied tables through the
adapters and runs one operator over the whole tables. ``ORACLE`` holds the
DuckDB twin of each (same column names)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ts_literal
from ..operators import acks as AK
from ..operators import ids as ID
from ..operators import ingest as IN
from ..operators import panes as PA
from ..operators import queue as QU
from ..operators import readings as R
from ..operators import state as ST
from ..operators import sync as SY
from ..sources import adapters as A
from . import oracle as O

Query = Callable[[SparkSession, str], DataFrame]


# --- readings ---------------------------------------------------------------

def outlier_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = A.measurements(spark, sf_dir)
    out = R.filter_readings(m, A.EVENTS_BOUNDS_70, A.EVENTS_START, A.EVENTS_END)
    return out.select("id", "mac", "sid", "type", "description", "val", "ts", "battery")


def _readings(spark, sf_dir):
    """Measurements to aggregate: a task of few, long row groups would hold nearly
    a group for each of its readings, so they are dealt out before."""
    return A.measurements(spark, sf_dir, spread=True)


def rollup_1h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.rollup(_readings(spark, sf_dir), 1, A.EVENTS_BOUNDS, A.EVENTS_START, A.EVENTS_END)


def rollup_12h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.rollup(_readings(spark, sf_dir), 12, A.EVENTS_BOUNDS, A.EVENTS_START, A.EVENTS_END)


def rollup_nested_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = R.rollup(_readings(spark, sf_dir), 12, A.EVENTS_BOUNDS, A.EVENTS_START, A.EVENTS_END,
                 sort=False)
    return R.rollup_nested(r)


def rollup_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.rollup(_readings(spark, sf_dir), 6, A.EVENTS_BOUNDS,
                    "2024-01-05 00:00:00", "2024-01-20 00:00:00", types=("view", "click", "purchase"))


def rollup_from_panes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 12-hour rollup from hour panes, those of the readings already
    aggregated and those of the readings that came later."""
    m = _readings(spark, sf_dir)
    panes = [PA.hour_panes(m.where(late), A.EVENTS_BOUNDS, start=A.EVENTS_START, end=A.EVENTS_END)
             for late in (F.col("agg"), ~F.col("agg"))]
    return PA.rollup_from_panes(panes[0].unionByName(panes[1]), 12)


def rollup_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rollups of days, weeks, months and spans of ten days."""
    m, out = _readings(spark, sf_dir), None
    for every in ("1 day", "1 week", "1 month", "10 days"):
        r = R.rollup(m, bounds=A.EVENTS_BOUNDS, every=every, sort=False).select(F.lit(every).alias("every"), "*")
        out = r if out is None else out.unionByName(r)
    return out


def mirror_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mirror of hourly and daily rollups lacks two days after its last delivery."""
    return R.mirror_rollup(_readings(spark, sf_dir), A.MIRROR_AS_OF, A.SYNC_CUTOFF, R.Mirror(bounds=A.EVENTS_BOUNDS))


def trailing_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.trailing_aggregate(_readings(spark, sf_dir), A.EVENTS_AS_OF, 14400, A.EVENTS_LEGACY).drop("id")


def trailing_mark_used(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, marked = R.aggregate_and_mark(A.measurements(spark, sf_dir), A.EVENTS_AS_OF, 14400,
                                     A.EVENTS_LEGACY)
    return marked.select("id", "type", "val", "ts", "agg")


# --- sync -------------------------------------------------------------------

def _pending_measurements(spark, sf_dir):
    return SY.pending(A.measurements(spark, sf_dir), columns=SY.MEASUREMENT_COLUMNS)


def pending_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pending_measurements(spark, sf_dir)


def pending_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SY.pending(A.aggregates(spark, sf_dir), columns=SY.AGGREGATE_COLUMNS)


def _acked_runs(spark, sf_dir):
    runs = _runs(spark, sf_dir)
    acked = runs.where(F.col("ts_end") < F.expr(f"TIMESTAMP_NTZ '{A.SYNC_CUTOFF}'")).select("id")
    return SY.mark_synced(runs, acked)


def _pending_state(spark, sf_dir):
    return SY.pending(_acked_runs(spark, sf_dir), columns=("device_id",) + SY.STATE_COLUMNS)


def pending_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pending_state(spark, sf_dir)


def sync_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SY.sync_envelope(_pending_measurements(spark, sf_dir), _pending_state(spark, sf_dir))


def mark_synced(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = A.measurements(spark, sf_dir)
    acked = _pending_measurements(spark, sf_dir).select("id")
    out = SY.mark_synced(m, acked)
    return out.select("id", F.to_json("sync").alias("sync_json"))


def apply_ack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answer to one message of measurements: what was pending is flagged."""
    m = A.measurements(spark, sf_dir)
    doc = F.to_json(F.collect_list(F.struct("id")))
    reply = _pending_measurements(spark, sf_dir).agg(doc.alias("reply")).withColumn("source", F.lit("measurements"))
    out = SY.apply_reply(200, reply, {"measurements": m})["measurements"]
    return out.select("id", F.to_json("sync").alias("sync_json"))


def ack_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flags of all measurements, acknowledgements merged when read."""
    m = A.measurements(spark, sf_dir)
    return AK.with_acks(m, A.acknowledged(spark, sf_dir), "measurements").select("id", F.to_json("sync").alias("sync_json"))


def pending_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All measurements that the acknowledgements leave to send."""
    out = AK.pending_delta(A.measurements(spark, sf_dir), A.acknowledged(spark, sf_dir), "measurements", limit=None)
    return out.select("id", "mac", "sid", "type", "val", "ts")


def pending_delta_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next message: the oldest of them."""
    return AK.pending_delta(A.measurements(spark, sf_dir), A.acknowledged(spark, sf_dir), "measurements",
                            columns=SY.MEASUREMENT_COLUMNS)


def ingest_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a sync would send of freshly ingested rows."""
    rows = _ingest_rows(spark, sf_dir)
    out = SY.pending(rows, order_by=("batch_id", "pos"), columns=SY.MEASUREMENT_COLUMNS + ("batch_id", "pos"))
    return out.drop("id")


def agg_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a notification would send of a fresh trailing aggregate."""
    rows = R.trailing_aggregate(_readings(spark, sf_dir), A.EVENTS_AS_OF, 14400, A.EVENTS_LEGACY, sort=False)
    out = SY.pending(rows, limit=None, columns=SY.AGGREGATE_COLUMNS, order_by="id")
    return out.drop("id")


def outlier_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.outliers(A.measurements(spark, sf_dir), A.EVENTS_BOUNDS_70, A.EVENTS_START, A.EVENTS_END)
    return out.select("id", "mac", "sid", "type", "val", "ts")


def retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After a clean-up of what was sent more than ten days before."""
    return R.retain(A.measurements(spark, sf_dir), A.EVENTS_AS_OF, 14400).select("id", "ts")


def reset_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = SY.reset_sync(A.measurements(spark, sf_dir))
    return out.select("id", F.to_json("sync").alias("sync_json"))


# --- state log --------------------------------------------------------------

def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.raw_observations(spark, sf_dir)


def _valid(spark, sf_dir):
    return ST.check_observations(A.raw_observations(spark, sf_dir))[0]


def state_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _valid(spark, sf_dir)


def state_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    rej = ST.check_observations(A.raw_observations(spark, sf_dir))[1]
    return rej.select("device_id", "id", "reason")


def restart_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ST.restart_epochs(_valid(spark, sf_dir)).select("device_id", "id", "segment", "epoch")


def _runs(spark, sf_dir):
    return ST.collapse_runs(_valid(spark, sf_dir))


def state_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runs(spark, sf_dir).drop("sync")


def state_runs_chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with chunks of few ids, so that most runs cross a border."""
    return ST.collapse_runs(_valid(spark, sf_dir), chunk_ids=97).drop("sync")


def state_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations up to an id collapsed and sent, the others merged in: the
    runs of all, with the flags that sending and extending leave."""
    valid = _valid(spark, sf_dir)
    early = F.col("id") < A.MERGE_AT
    stored = ST.collapse_runs(valid.where(early)).withColumn("sync", F.create_map(F.lit("cloud"), F.lit(True)))
    out = ST.merge_runs(stored, valid.where(~early))
    return out.withColumn("sent", F.coalesce(F.col("sync").getItem("cloud"), F.lit(False))).drop("sync")


def latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ST.latest_state(_runs(spark, sf_dir)).select(
        "device_id", "segment", "id", "data", "ts_start", "ts_end")


# --- ingest -----------------------------------------------------------------

def _checked(spark, sf_dir):
    return IN.validate_batches(A.raw_batches(spark, sf_dir))


def ingest_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = _checked(spark, sf_dir)[0]
    return good.select("batch_id", "mac", F.size("items").alias("n_items"))


def ingest_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checked(spark, sf_dir)[1].select("batch_id", "reason")


def _ingest_rows(spark, sf_dir):
    return IN.reshape_batches(_checked(spark, sf_dir)[0], A.EVENTS_AS_OF)


def ingest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ingest_rows(spark, sf_dir).drop("sync", "id")


def ingest_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Serial ids of ingested rows where some requests came twice, after those stored."""
    raw = A.raw_batches(spark, sf_dir)
    again = raw.where(F.col("batch_id").like("1%"))
    rows = IN.reshape_batches(IN.validate_batches(raw.unionByName(again))[0], A.EVENTS_AS_OF)
    start = ID.last_id(A.measurements(spark, sf_dir))
    return ID.with_serial_ids(rows, ("batch_id", "pos"), start).drop("sync")


def agg_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Serial ids of two runs of the trailing aggregate, by run and series."""
    m, out = _readings(spark, sf_dir), None
    for as_of in (A.SYNC_CUTOFF, A.EVENTS_AS_OF):
        run = R.trailing_aggregate(m.where(F.col("ts") <= ts_literal(as_of, True)), as_of, 7200, A.EVENTS_LEGACY, sort=False)
        out = run if out is None else out.unionByName(run)
    return ID.with_serial_ids(out, ("ts", "mac", "sid", "type", "description")).select("id", "ts", "mac", "sid", "type", "description", "n")


def ingest_receipt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return IN.ingest_receipt(_ingest_rows(spark, sf_dir), A.EVENTS_AS_OF)


def insert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = IN.insert_measurements(A.raw_inserts(spark, sf_dir), A.EVENTS_AS_OF)[0]
    return rows.drop("sync", "id")


def insert_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return IN.insert_measurements(A.raw_inserts(spark, sf_dir), A.EVENTS_AS_OF)[1].select("req", "reason")


def upgrade_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = IN.upgrade_measurements(A.measurements_v1(spark, sf_dir))
    return out.select("id", "mac", "sid", "type", "description", "val", "ts", "battery", "sync_old",
                      F.to_json("sync").alias("sync_json"))


# --- queue ------------------------------------------------------------------

def queue_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QU.queue_pending(A.queue(spark, sf_dir), A.QUEUE_AS_OF)


def queue_ttf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QU.with_time_to_finish(A.queue(spark, sf_dir), A.QUEUE_AS_OF).select("id", "time_to_finish")


def queue_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = QU.queue_decode(A.raw_jobs(spark, sf_dir), A.QUEUE_AS_OF)[0]
    return rows.select("id", "job_type", "delay", "ts_created", "ts_executed")


def queue_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QU.queue_decode(A.raw_jobs(spark, sf_dir), A.QUEUE_AS_OF)[1].select("id", "reason")


def queue_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = A.queue(spark, sf_dir)
    due = QU.queue_pending(q, A.QUEUE_AS_OF, sort=False).where(F.col("time_to_finish") <= 0).select("id")
    return QU.queue_complete(q, due, A.QUEUE_AS_OF).select("id", "ts_executed")


QUERIES: dict[str, Query] = {
    "outlier_filter": outlier_filter,
    "rollup_1h": rollup_1h,
    "rollup_12h": rollup_12h,
    "rollup_nested_json": rollup_nested_json,
    "rollup_from_panes": rollup_from_panes,
    "rollup_calendar": rollup_calendar,
    "mirror_rollup": mirror_rollup,
    "ack_merge": ack_merge,
    "pending_delta": pending_delta,
    "pending_delta_top": pending_delta_top,
    "ingest_ids": ingest_ids,
    "agg_ids": agg_ids,
    "rollup_params": rollup_params,
    "trailing_aggregate": trailing_aggregate,
    "trailing_mark_used": trailing_mark_used,
    "pending_measurements": pending_measurements,
    "pending_agg": pending_agg,
    "pending_state": pending_state,
    "sync_envelope": sync_envelope,
    "mark_synced": mark_synced,
    "reset_sync": reset_sync,
    "observations": observations,
    "state_valid": state_valid,
    "state_rejected": state_rejected,
    "restart_epoch": restart_epoch,
    "state_runs": state_runs,
    "state_runs_chunked": state_runs_chunked,
    "state_merge": state_merge,
    "apply_ack": apply_ack,
    "ingest_pending": ingest_pending,
    "agg_pending": agg_pending,
    "outlier_rejected": outlier_rejected,
    "retained": retained,
    "latest_state": latest_state,
    "ingest_valid": ingest_valid,
    "ingest_rejected": ingest_rejected,
    "ingest_rows": ingest_rows,
    "ingest_receipt": ingest_receipt,
    "insert_rows": insert_rows,
    "insert_rejected": insert_rejected,
    "upgrade_layout": upgrade_layout,
    "queue_pending": queue_pending,
    "queue_ttf": queue_ttf,
    "queue_insert": queue_insert,
    "queue_rejected": queue_rejected,
    "queue_complete": queue_complete,
}

_M = O.with_(O.MEASUREMENTS)

ORACLE: dict[str, str] = {
    "outlier_filter": _M + f"""SELECT id, mac, sid, type, description, val, ts, battery FROM m
WHERE {O.STRICT_EVENTS_70} AND {O.RANGE} ORDER BY ts""",
    "rollup_1h": _M + O.rollup_sql(1, f"AND {O.RANGE}"),
    "rollup_12h": _M + O.rollup_sql(12, f"AND {O.RANGE}"),
    "rollup_nested_json": _M + f""", r AS ({O.rollup_sql(12, f"AND {O.RANGE}")})
SELECT time, part, COUNT(*) AS n_series,
       CAST(to_json(list({{'key': mac || '_' || CAST(sid AS VARCHAR) || '_' || type,
                           'val_avg': val_avg, 'val_stddev': val_stddev, 'val_count': val_count}}
                         ORDER BY mac || '_' || CAST(sid AS VARCHAR) || '_' || type,
                                  val_avg, val_stddev, val_count)) AS VARCHAR) AS readings_json
FROM (SELECT *, {O.key_part("mac || '_' || CAST(sid AS VARCHAR) || '_' || type", 64)} AS part FROM r)
GROUP BY time, part ORDER BY time, part""",
    "rollup_params": _M + O.rollup_sql(
        6, "AND ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-20 00:00:00' "
           "AND type IN ('view', 'click', 'purchase')"),
    "trailing_aggregate": _M + f"""SELECT mac, sid, type, description,
       CAST(AVG(val) AS FLOAT) AS avg, CAST(STDDEV_POP(val) AS FLOAT) AS stddev, COUNT(val) AS n,
       TIMESTAMP '2024-01-31 00:00:00' AS ts, CAST(ROUND(AVG(battery)) AS SMALLINT) AS battery,
       FALSE AS sync
FROM m
WHERE ts > TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 14400 MINUTE AND {O.LEGACY_EVENTS} AND agg = FALSE
GROUP BY mac, sid, type, description
ORDER BY mac, sid, type, description NULLS LAST""",
    "trailing_mark_used": _M + f"""SELECT id, type, val, ts,
       CASE WHEN ts > TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 14400 MINUTE AND {O.LEGACY_EVENTS}
            THEN TRUE ELSE agg END AS agg
FROM m""",
}

_PM = f"""SELECT id, mac, sid, type, description, val, ts, battery FROM m
WHERE COALESCE(sync_cloud, FALSE) = FALSE ORDER BY id LIMIT 500"""

_RUNS = O.with_(O.OBSERVATIONS, O.RUNS)

_PS = """SELECT device_id, id, segment, data, ts_start, ts_end FROM runs
WHERE NOT (ts_end < TIMESTAMP '2024-01-15 00:00:00') ORDER BY id LIMIT 500"""

_TS = "'%Y-%m-%dT%H:%M:%S.%f'"

ORACLE.update({
    "pending_measurements": _M + _PM,
    "pending_agg": O.with_(O.MEASUREMENTS, O.AGGREGATES) + """SELECT id, mac, sid, type, description, avg,
       stddev, n, ts, battery FROM ag WHERE sync = FALSE ORDER BY id LIMIT 500""",
    "pending_state": _RUNS + _PS,
    "sync_envelope": O.with_(O.MEASUREMENTS, O.OBSERVATIONS, O.RUNS) + f""", pm AS ({_PM}), ps AS ({_PS})
SELECT 'measurements' AS source, id,
       CAST(to_json({{'id': id, 'mac': mac, 'sid': sid, 'type': type, 'description': description,
                     'val': CAST(CAST(val AS VARCHAR) AS JSON), 'ts': strftime(ts, {_TS}), 'battery': battery}}) AS VARCHAR) AS payload
FROM pm
UNION ALL
SELECT 'logState' AS source, id,
       CAST(to_json({{'device_id': device_id, 'id': id, 'segment': segment, 'data': CAST(data AS JSON),
                     'ts_start': strftime(ts_start, {_TS}), 'ts_end': strftime(ts_end, {_TS})}}) AS VARCHAR) AS payload
FROM ps""",
    "mark_synced": _M + f""", pm AS ({_PM})
SELECT m.id, CASE WHEN pm.id IS NOT NULL THEN '{{"cloud":true}}'
                  WHEN sync_cloud IS NULL THEN '{{}}'
                  ELSE '{{"cloud":' || CAST(sync_cloud AS VARCHAR) || '}}' END AS sync_json
FROM m LEFT JOIN pm ON m.id = pm.id""",
    "agg_pending": _M + f"""SELECT mac, sid, type, description,
       CAST(AVG(val) AS FLOAT) AS avg, CAST(STDDEV_POP(val) AS FLOAT) AS stddev, COUNT(val) AS n,
       TIMESTAMP '2024-01-31 00:00:00' AS ts, CAST(ROUND(AVG(battery)) AS SMALLINT) AS battery
FROM m
WHERE ts > TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 14400 MINUTE AND {O.LEGACY_EVENTS} AND agg = FALSE
GROUP BY mac, sid, type, description""",
    "outlier_rejected": _M + f"""SELECT id, mac, sid, type, val, ts FROM m
WHERE {O.RANGE} AND NOT COALESCE({O.STRICT_EVENTS_70}, FALSE)""",
    "retained": _M + """SELECT id, ts FROM m
WHERE ts > TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 14400 MINUTE OR NOT COALESCE(sync_cloud, FALSE)""",
    "reset_sync": _M + """SELECT id, '{"cloud":false}' AS sync_json FROM m""",
    "observations": O.with_(O.OBSERVATIONS) + "SELECT device_id, id, segment, data, ts FROM o",
    "state_valid": O.with_(O.OBSERVATIONS) + "SELECT device_id, id, segment, data, ts FROM ov",
    "state_rejected": O.with_(O.OBSERVATIONS) + """SELECT device_id, id,
       CASE WHEN segment NOT IN ('gpio', 'connectivity', 'cloud', 'app') THEN 'segment' ELSE 'data' END AS reason
FROM o WHERE segment NOT IN ('gpio', 'connectivity', 'cloud', 'app') OR canon IS NULL""",
    "restart_epoch": _RUNS + "SELECT device_id, id, segment, epoch FROM ep",
    "state_runs": _RUNS + "SELECT device_id, id, segment, data, ts_start, ts_end, epoch, n_obs FROM runs",
    "state_runs_chunked": _RUNS + "SELECT device_id, id, segment, data, ts_start, ts_end, epoch, n_obs FROM runs",
    "state_merge": _RUNS + """, mx AS (SELECT device_id, run_id, MAX(id) AS last_id FROM rn GROUP BY device_id, run_id)
SELECT r.device_id, r.id, segment, data, ts_start, ts_end, epoch, n_obs, last_id < 5000 AS sent
FROM runs r JOIN mx ON r.device_id = mx.device_id AND r.id = mx.run_id""",
    "latest_state": _RUNS + """, cur AS (
  SELECT device_id, MAX(id) AS cur FROM runs
  WHERE segment = 'app' AND data = '{"value":"restart"}' GROUP BY device_id
), lat AS (
  SELECT device_id, segment, arg_max(id, id) AS id, arg_max(data, id) AS data,
         arg_max(ts_start, id) AS ts_start, arg_max(ts_end, id) AS ts_end
  FROM runs GROUP BY device_id, segment
)
SELECT lat.* FROM lat LEFT JOIN cur USING (device_id) WHERE lat.id > COALESCE(cur.cur, -1)""",
})

_B = O.with_(O.BATCHES)
_Q = O.with_(O.QUEUE)

ORACLE.update({
    "ingest_valid": _B + """SELECT batch_id, mac, CAST(COUNT(*) AS INTEGER) AS n_items FROM b
WHERE batch_id IN (SELECT batch_id FROM bv) GROUP BY batch_id, mac""",
    "ingest_rejected": _B + "SELECT batch_id, reason FROM br WHERE reason IS NOT NULL",
    "ingest_pending": _B + """SELECT mac, sid, type, description, val, TIMESTAMP '2024-01-31 00:00:00' AS ts, battery, batch_id,
       CAST(ROW_NUMBER() OVER (PARTITION BY batch_id ORDER BY event_id) - 1 AS INTEGER) AS pos
FROM b WHERE batch_id IN (SELECT batch_id FROM bv) ORDER BY batch_id, pos LIMIT 500""",
    "ingest_rows": _B + """SELECT batch_id,
       CAST(ROW_NUMBER() OVER (PARTITION BY batch_id ORDER BY event_id) - 1 AS INTEGER) AS pos,
       mac, sid, type, description, val, battery, TIMESTAMP '2024-01-31 00:00:00' AS ts
FROM b WHERE batch_id IN (SELECT batch_id FROM bv)""",
    "ingest_receipt": _B + """SELECT batch_id, COUNT(*) AS new_records, TIMESTAMP '2024-01-31 00:00:00' AS ts
FROM b WHERE batch_id IN (SELECT batch_id FROM bv) GROUP BY batch_id""",
    "insert_rows": f"""SELECT event_id AS req, 0 AS pos, CAST(user_id AS VARCHAR) AS mac,
       CAST({O.K} % 4 AS SMALLINT) AS sid, event_type AS type,
       CASE WHEN {O.K} % 10 = 0 THEN NULL ELSE 'd' END AS description,
       CAST(value AS FLOAT) AS val, CAST({O.K} AS SMALLINT) AS battery,
       TIMESTAMP '2024-01-31 00:00:00' AS ts
FROM events WHERE event_type <> 'error' AND event_id % 37 > 6""",
    "insert_rejected": """SELECT event_id AS req, CASE WHEN event_id % 37 < 3 THEN 'json' ELSE 'row' END AS reason
FROM events WHERE event_type = 'error' OR event_id % 37 <= 6""",
    "upgrade_layout": _M + """SELECT id, mac, sid, type, description, val, ts, battery, sync_cloud AS sync_old,
       CASE WHEN sync_cloud IS NULL THEN NULL
            ELSE '{"cloud":' || CAST(sync_cloud AS VARCHAR) || '}' END AS sync_json
FROM m""",
    "queue_pending": _Q + f"""SELECT id, job_type, ts_created, delay, {O.QUEUE_TTF} AS time_to_finish
FROM qq WHERE ts_executed IS NULL ORDER BY id""",
    "queue_ttf": _Q + f"SELECT id, {O.QUEUE_TTF} AS time_to_finish FROM qq",
    "queue_insert": """SELECT o_orderkey AS id,
       CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN 'irrigation_on'
            ELSE 'irrigation_off' END AS job_type,
       CASE WHEN o_orderstatus = 'F' THEN NULL ELSE CAST(o_custkey AS INTEGER) END AS delay,
       TIMESTAMP '1998-01-01 00:00:00' AS ts_created, CAST(NULL AS TIMESTAMP) AS ts_executed
FROM orders
WHERE o_orderpriority <> '4-NOT SPECIFIED' AND NOT (o_orderstatus = 'P' AND o_orderpriority = '5-LOW')
  AND o_orderkey % 31 NOT IN (0, 2) AND NOT (o_orderkey % 31 = 1 AND o_orderstatus <> 'F')""",
    "queue_rejected": """SELECT * FROM (SELECT o_orderkey AS id,
  CASE WHEN o_orderkey % 31 IN (0, 2) THEN 'json'
       WHEN o_orderpriority = '4-NOT SPECIFIED' OR (o_orderstatus = 'P' AND o_orderpriority = '5-LOW') THEN 'job_type'
       WHEN o_orderkey % 31 = 1 AND o_orderstatus <> 'F' THEN 'delay' END AS reason FROM orders)
WHERE reason IS NOT NULL""",
    "queue_complete": _Q + f"""SELECT id,
       CASE WHEN ts_executed IS NULL AND {O.QUEUE_TTF} <= 0 THEN TIMESTAMP '1998-01-01 00:00:00'
            ELSE ts_executed END AS ts_executed
FROM qq""",
})

ORACLE["apply_ack"] = ORACLE["mark_synced"]

ORACLE["rollup_from_panes"] = ORACLE["rollup_12h"]

_WEEK = "date_trunc('week', ts)"
_TEN = "DATE '1970-01-01' + CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) // 10 * 10 AS INTEGER)"

ORACLE.update({
    "rollup_calendar": _M + " UNION ALL ".join(
        f"SELECT '{every}' AS every, * FROM ({O.rollup_sql(time=time)})" for every, time in
        (("1 day", "date_trunc('day', ts)"), ("1 week", _WEEK), ("1 month", "date_trunc('month', ts)"), ("10 days", _TEN))),
    "mirror_rollup": _M + " UNION ALL ".join(
        f"""SELECT '1 {unit}' AS every, time, time + INTERVAL 1 {unit} AS time_end, mac, sid, type, val_avg, val_stddev, val_count
FROM ({O.rollup_sql(time=f"date_trunc('{unit}', ts)")})
WHERE time + INTERVAL 1 {unit} <= TIMESTAMP '2024-01-17 09:30:00' AND time + INTERVAL 1 {unit} > TIMESTAMP '2024-01-15 00:00:00'"""
        for unit in ("hour", "day")),
    "ack_merge": O.with_(O.MEASUREMENTS, O.ACKED) + """SELECT id, CASE WHEN acked IS NOT NULL THEN '{"cloud":' || CAST(acked AS VARCHAR) || '}'
            WHEN sync_cloud IS NULL THEN '{}' ELSE '{"cloud":' || CAST(sync_cloud AS VARCHAR) || '}' END AS sync_json
FROM ak""",
    "pending_delta": O.with_(O.MEASUREMENTS, O.ACKED) + """SELECT id, mac, sid, type, val, ts FROM ak
WHERE NOT COALESCE(acked, sync_cloud, FALSE)""",
    "pending_delta_top": O.with_(O.MEASUREMENTS, O.ACKED) + """SELECT id, mac, sid, type, description, val, ts, battery FROM ak
WHERE NOT COALESCE(acked, sync_cloud, FALSE) ORDER BY id LIMIT 500""",
    "ingest_ids": O.with_(O.BATCHES) + """SELECT (SELECT MAX(event_id) FROM events)
       + ROW_NUMBER() OVER (ORDER BY batch_id, pos) AS id, * FROM (
  SELECT batch_id, CAST(ROW_NUMBER() OVER (PARTITION BY batch_id ORDER BY event_id) - 1 AS INTEGER) AS pos,
         mac, sid, type, description, val, battery, TIMESTAMP '2024-01-31 00:00:00' AS ts
  FROM b WHERE batch_id IN (SELECT batch_id FROM bv)
  UNION ALL
  SELECT batch_id, CAST(ROW_NUMBER() OVER (PARTITION BY batch_id ORDER BY event_id) - 1 AS INTEGER) AS pos,
         mac, sid, type, description, val, battery, TIMESTAMP '2024-01-31 00:00:00' AS ts
  FROM b WHERE batch_id IN (SELECT batch_id FROM bv) AND batch_id LIKE '1%')""",
    "agg_ids": _M + f"""SELECT ROW_NUMBER() OVER (ORDER BY ts, mac, sid, type, description NULLS LAST) AS id, * FROM (
  SELECT run AS ts, mac, sid, type, description, COUNT(val) AS n
  FROM m, (VALUES (TIMESTAMP '2024-01-15 00:00:00'), (TIMESTAMP '2024-01-31 00:00:00')) AS r(run)
  WHERE ts <= run AND ts > run - INTERVAL 7200 MINUTE AND {O.LEGACY_EVENTS} AND agg = FALSE
  GROUP BY ALL)""",
})
