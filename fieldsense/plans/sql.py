"""SQL surface: temporary SQL functions and views over the operators, for
users who query with ``spark.sql``. SQL functions are inlined by the
analyzer, so they stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import schemas as S
from ..operators.queue import queue_pending
from ..operators.sync import AGGREGATE_COLUMNS, MEASUREMENT_COLUMNS, STATE_COLUMNS, pending

FUNCTIONS = {
    # whole minutes until ts_created + delay, half to even; NULL delay -> NULL
    "queue_event_ttf": """(ts_created TIMESTAMP_NTZ, delay_minutes INT, as_of TIMESTAMP_NTZ) RETURNS INT
        RETURN CAST(bround(timestampdiff(MICROSECOND, as_of,
                    ts_created + make_dt_interval(0, 0, delay_minutes)) / 60000000.0, 0) AS INT)""",
    # not yet acknowledged by dest: flag absent, NULL or false
    "sync_pending": """(flags MAP<STRING, BOOLEAN>, dest STRING) RETURNS BOOLEAN
        RETURN NOT coalesce(flags[dest], false)""",
    # mac || '_' || sid || '_' || type (NULL when a part is NULL)
    "series_key": """(mac STRING, sid SMALLINT, type STRING) RETURNS STRING
        RETURN concat(mac, '_', CAST(sid AS STRING), '_', type)""",
}


def register_functions(spark: SparkSession) -> list[str]:
    """Create the temporary SQL functions; returns their names."""
    for name, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    return list(FUNCTIONS)


def register_views(spark: SparkSession, measurements: DataFrame | None = None,
                   log_state: DataFrame | None = None, limit: int = S.DEFAULT_SYNC_LIMIT,
                   queue: DataFrame | None = None, aggregates: DataFrame | None = None, as_of=None) -> list[str]:
    """Temporary views of the tables and of their pending rows
    (``sync_measurements``, ``sync_log_state``, ``sync_agg``: oldest ``limit``
    rows not yet acknowledged by the cloud; ``pending_queue``: jobs not
    executed, with the minutes to finish at ``as_of``)."""
    made = []
    if measurements is not None:
        measurements.createOrReplaceTempView("t_measurements")
        pending(measurements, limit=limit, columns=MEASUREMENT_COLUMNS).createOrReplaceTempView("sync_measurements")
        made += ["t_measurements", "sync_measurements"]
    if log_state is not None:
        log_state.createOrReplaceTempView("t_log_state")
        pending(log_state, limit=limit, columns=STATE_COLUMNS).createOrReplaceTempView("sync_log_state")
        made += ["t_log_state", "sync_log_state"]
    if aggregates is not None:
        aggregates.createOrReplaceTempView("t_agg")
        pending(aggregates, limit=limit, columns=AGGREGATE_COLUMNS).createOrReplaceTempView("sync_agg")
        made += ["t_agg", "sync_agg"]
    if queue is not None:
        queue.createOrReplaceTempView("t_queue")
        queue_pending(queue, as_of).createOrReplaceTempView("pending_queue")
        made += ["t_queue", "pending_queue"]
    return made
