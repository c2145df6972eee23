"""Delayed-job queue: pending jobs with minutes to finish, decoding insert
requests, completing jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import empty_flags, integer_text, is_ntz, micros_between, minutes, ts_literal, whole_json, with_computed

INT_MIN, INT_MAX = -(2 ** 31), 2 ** 31 - 1


def minutes_to_finish(ts_created: Column, delay: Column, as_of: Column) -> Column:
    """Whole minutes from ``as_of`` until ``ts_created + delay minutes``:
    negative once overdue, NULL when ``delay`` is NULL. The fraction is
    rounded half to even (the float-to-int cast of the original)."""
    due = ts_created + minutes(delay)
    return F.bround(micros_between(as_of, due) / F.lit(60_000_000.0), 0).cast("int")


def with_time_to_finish(queue: DataFrame, as_of) -> DataFrame:
    now = ts_literal(as_of, is_ntz(queue, "ts_created"))
    return queue.withColumn("time_to_finish", minutes_to_finish(F.col("ts_created"), F.col("delay"), now))


def queue_pending(queue: DataFrame, as_of, sort: bool = True) -> DataFrame:
    """Jobs not executed yet, with minutes to finish, ordered by id."""
    out = (with_time_to_finish(queue.where(F.col("ts_executed").isNull()), as_of)
           .select("id", "job_type", "ts_created", "delay", "time_to_finish"))
    return out.orderBy("id") if sort else out


def queue_decode(raw: DataFrame, as_of, raw_col: str = "raw", job_types=S.JOB_TYPES,
                 ntz: bool = True):
    """Decode insert requests ``{job_type, delay?}`` into queue rows created
    at ``as_of``: ``(rows, rejected)``. Rejected (``reason``): not a JSON
    object, ``job_type`` missing or not one of ``job_types``, ``delay`` not
    written as an integer. A missing delay stays NULL (the column default is not applied)."""
    doc = F.col(raw_col)
    j = whole_json(doc, S.RAW_JOB)
    d = integer_text(F.col("_j.delay"), INT_MIN, INT_MAX)
    reason = (F.when(F.col("_j").isNull() | ~F.ltrim(doc).startswith("{"), F.lit("json"))
              .when(F.col("_j.job_type").isNull() | ~F.col("_j.job_type").isin(list(job_types)),
                    F.lit("job_type"))
              .when(F.col("_j.delay").isNotNull() & d.isNull(), F.lit("delay")))
    tagged = with_computed(with_computed(raw, _j=j), reason=reason)
    keep = [c for c in raw.columns if c != raw_col]
    rows = (tagged.where(F.col("reason").isNull())
            .select(*keep, F.col("_j.job_type").alias("job_type"),
                    F.lit("{}").alias("data"),
                    ts_literal(as_of, ntz).alias("ts_created"),
                    d.cast("int").alias("delay"),
                    F.lit(None).cast("timestamp_ntz" if ntz else "timestamp").alias("ts_executed"),
                    empty_flags().alias("sync")))
    rejected = tagged.where(F.col("reason").isNotNull()).select(*keep, raw_col, "reason")
    return rows, rejected


def queue_complete(queue: DataFrame, ids: DataFrame, as_of, strict: bool = True) -> DataFrame:
    """Set ``ts_executed = as_of`` on the given ids (re-completing overwrites).
    With ``strict`` an id missing from the queue fails the job that reads the
    result, with "no job with id"; else such ids change nothing. One join of
    the two tables, nothing runs when the plan is built."""
    done = ids.select(F.col("id").alias("_id")).where(F.col("_id").isNotNull()).dropDuplicates()
    now = ts_literal(as_of, is_ntz(queue, "ts_created"))
    rows = queue.withColumn("_queued", F.lit(True))
    rows = rows.join(done, rows["id"] == done["_id"], "full_outer" if strict else "left")
    unknown = F.raise_error(F.concat(F.lit("no job with id "), F.col("_id").cast("string"))).cast(queue.schema["ts_executed"].dataType)
    at = F.when(F.col("_queued").isNull(), unknown).when(F.col("_id").isNotNull(), now).otherwise(F.col("ts_executed"))
    return rows.withColumn("ts_executed", at).select(*queue.columns)
