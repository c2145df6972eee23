"""State-change log: observations collapse into runs of an unchanged state.

A run of a (device, segment) is extended while the observed ``data`` stays
equal (as JSON) and opens anew when it changes or when the device restarted
since the run began; the run that a change replaces ends at the change.
A restart never spans runs and does not close open runs.

Everything is computed with windows partitioned by (device, segment, id
chunk). A device that sends a third of all rows is split into chunks of at
most ``chunk_ids`` consecutive ids; what a window needs from earlier or later
chunks (last restart, previous row, next row, current run) is carried over
from a per-chunk summary (one row per device, segment and chunk), the usual
two-level form of a prefix scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import drop_flag, marked_json, object_key_count, unmarked_json, whole_variant, with_computed, with_default_key
from ..session import cut_lineage

CHUNK_ROWS = 1 << 20
KEYS = ("device_id", "segment")


def is_restart(segment: Column, data: Column) -> Column:
    """An app restart observation: segment app and ``data->>'value'`` restart."""
    return (segment == F.lit(S.RESTART_SEGMENT)) & \
        (F.get_json_object(data, "$.value") == F.lit(S.RESTART_VALUE))


def tag_observations(obs: DataFrame, segments=S.SEGMENTS) -> DataFrame:
    """Add ``reason`` (NULL when valid) and canonicalise ``data``.

    Rejected: no device ('device'); segment missing or unknown ('segment');
    data not one JSON object, or with no key ('data'); of repeated keys the
    last counts; numbers are compared in all their digits. A gpio row without a (non-null) ``userId`` gets ``userId: 0``."""
    seg, data = F.col("segment"), F.col("data")
    parsed = with_computed(with_computed(obs, _m=marked_json(data)), _v=whole_variant(F.col("_m"), checked=True))   # one parse per row
    v = F.col("_v")
    canon = F.when(seg == F.lit(S.GPIO_SEGMENT),
                   with_default_key(v, S.GPIO_USER_KEY, str(S.GPIO_DEFAULT_USER), unmarked_json)) \
        .otherwise(unmarked_json(v))
    # invalid JSON parses to NULL; non-objects have no key count
    reason = (F.when(F.col("device_id").isNull(), F.lit("device"))
              .when(seg.isNull() | ~seg.isin(list(segments)), F.lit("segment"))
              .when(F.coalesce(object_key_count(v), F.lit(0)) == 0, F.lit("data")))
    tagged = with_computed(parsed, _canon=canon, reason=reason)
    return (tagged.withColumn("data", F.when(F.col("reason").isNull(), F.col("_canon")).otherwise(data))
            .drop("_canon", "_v", "_m"))


def check_observations(obs: DataFrame, segments=S.SEGMENTS):
    """``(valid, rejected)``; rejected keeps the row and adds ``reason``.
    Writing both from one job: tag once, then ``partitionBy`` on the
    presence of ``reason`` or ``foreachBatch`` with a persisted frame."""
    tagged = tag_observations(obs, segments)
    valid = tagged.where(F.col("reason").isNull()).drop("reason")
    rejected = tagged.where(F.col("reason").isNotNull())
    return valid, rejected


def _with_markers(valid: DataFrame, chunk_ids: int | None, segments) -> DataFrame:
    """Observations plus one marker row per restart in every other segment of
    the device, with the id chunk. One pass over the input: a restart row is
    exploded into all segments. The frame is written once to the checkpoint
    folder, as several windows and summaries read it.

    Without ``chunk_ids`` a chunk is as wide as holds ``CHUNK_ROWS`` rows on
    average, counted on the frame, so that sparse ids make no tiny chunks."""
    others = F.array(*[F.lit(s) for s in segments if s != S.RESTART_SEGMENT])
    own = F.array("segment")
    rows = valid.select("device_id", "id", "segment", "data", "ts",
                        is_restart(F.col("segment"), F.col("data")).alias("_restart"))
    rows = rows.select("*", F.explode(F.when(F.col("_restart"), F.concat(own, others)).otherwise(own)).alias("_to"))
    marker = F.col("_to") != F.col("segment")
    u = cut_lineage(rows.select("device_id", "id", F.col("_to").alias("segment"), F.when(~marker, F.col("data")).alias("data"),
                                F.when(~marker, F.col("ts")).alias("ts"), (F.col("_restart") & ~marker).alias("_restart"),
                                marker.alias("_marker")))
    if chunk_ids is None:
        n, low, high = u.agg(F.count("*"), F.min("id"), F.max("id")).first()
        chunk_ids = max(1, -(-(high - low + 1) // -(-n // CHUNK_ROWS))) if n else 1
    # integer division keeps chunks exact for any 64-bit id (non-decreasing in id)
    return u.withColumn("_chunk", F.expr(f"id div {int(chunk_ids)}"))


# Window and summary steps are written as one SQL statement over the
# partitioned frame: the same logical plan as chained DataFrame calls, built
# in a single round trip to the JVM.
_LOCAL_EPOCH = """
e AS (
  SELECT *,
         max(CASE WHEN _restart OR _marker THEN id END)
           OVER (PARTITION BY device_id, segment, _chunk ORDER BY id
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS _lep
  FROM {u}
),
ce AS (
  SELECT device_id, segment, _chunk, _rmax,
         max(_rmax) OVER (PARTITION BY device_id, segment ORDER BY _chunk
                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS _ce
  FROM (SELECT device_id, segment, _chunk, max(CASE WHEN _restart OR _marker THEN id END) AS _rmax
        FROM {u} GROUP BY device_id, segment, _chunk)
)"""

# plain equality on exactly the windows' keys, so the big side of each join
# keeps their partitioning (device and segment are never NULL here)
_SAME_CHUNK = "l.device_id = r.device_id AND l.segment = r.segment AND l._chunk = r._chunk"


def restart_epochs(valid: DataFrame, chunk_ids: int | None = None, segments=S.SEGMENTS) -> DataFrame:
    """Valid observations with ``epoch``: the id of the device's last restart
    strictly before the row (-1 when none), so a restart row belongs to the
    epoch before it. Restarts are copied as marker rows into every other
    segment of the device, so the lookup is a per-segment window (an as-of
    join without a join), never a window over the whole device; the epoch
    carried into a chunk comes from a per-chunk summary."""
    u = _with_markers(valid, chunk_ids, segments)
    return valid.sparkSession.sql(f"""WITH {_LOCAL_EPOCH}
SELECT l.device_id, l.id, l.segment, l.data, l.ts, coalesce(greatest(l._lep, r._ce), -1) AS epoch
FROM e l LEFT JOIN ce r ON {_SAME_CHUNK}
WHERE NOT l._marker""", u=u)


def collapse_runs(valid: DataFrame, chunk_ids: int | None = None, segments=S.SEGMENTS) -> DataFrame:
    """Runs ``(device_id, id, segment, data, ts_start, ts_end, epoch, n_obs,
    sync)`` of valid, canonical observations. ``id`` is the id of the
    observation that opened the run; ``ts_end`` is the start of the next run
    of the segment in the same epoch, else the time of the run's last
    observation. ``sync`` is empty: every run is still to be sent.

    Plan: rows are shuffled by (device, segment, chunk); inside a chunk, windows
    find each row's previous/next row, local epoch and local run starts;
    what only earlier or later chunks know (epoch carried in, the last row of
    the previous chunk, the first row of the next one, the run in effect) is
    resolved on a per-chunk summary table and joined back on the same keys.
    Every observation of a run has the same data, so ``data`` is a grouping
    key of the last aggregate and its buffers stay fixed-width (hash
    aggregate, no sort).
    """
    u = _with_markers(valid, chunk_ids, segments)
    return valid.sparkSession.sql(f"""WITH {_LOCAL_EPOCH},
nb AS (
  SELECT device_id, segment, _chunk, id, data, ts, _lep,
         lag(named_struct('data', data, 'lep', _lep)) OVER c AS _p,
         lead(named_struct('ts', ts, 'lep', _lep)) OVER c AS _n
  FROM e WHERE NOT _marker
  WINDOW c AS (PARTITION BY device_id, segment, _chunk ORDER BY id)
),
loc AS (
  SELECT device_id, segment, _chunk, id, data, ts, _lep,
         CASE WHEN _p IS NOT NULL THEN NOT (_p.lep <=> _lep) OR coalesce(_p.data <> data, false) END AS _lstart,
         CASE WHEN _n IS NOT NULL THEN CASE WHEN _n.lep <=> _lep THEN _n.ts ELSE ts END END AS _lend
  FROM nb
),
w AS (
  SELECT *, max(CASE WHEN _lstart THEN id END)
              OVER (PARTITION BY device_id, segment, _chunk ORDER BY id
                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS _ls
  FROM loc
),
edge AS (
  SELECT device_id, segment, _chunk,
         min(named_struct('id', id, 'data', data, 'lep', _lep, 'ts', ts)) AS _first,
         max(named_struct('id', id, 'data', data, 'lep', _lep, 'ts', ts)) AS _last,
         max(CASE WHEN _lstart THEN id END) AS _max_ls
  FROM w GROUP BY device_id, segment, _chunk
),
s1 AS (
  SELECT r.device_id, r.segment, r._chunk, r._ce, l._first, l._last, l._max_ls,
         coalesce(greatest(l._first.lep, r._ce), -1) AS _first_ep,
         coalesce(greatest(l._last.lep, r._ce), -1) AS _last_ep
  FROM ce r LEFT JOIN edge l ON {_SAME_CHUNK}
),
s2 AS (
  SELECT *,
         last(CASE WHEN _last IS NOT NULL THEN named_struct('data', _last.data, 'ep', _last_ep) END, true)
           OVER (PARTITION BY device_id, segment ORDER BY _chunk
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS _prev_last,
         last(CASE WHEN _first IS NOT NULL THEN named_struct('ts', _first.ts, 'ep', _first_ep) END, true)
           OVER (PARTITION BY device_id, segment ORDER BY _chunk DESC
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS _next_first
  FROM s1
),
s3 AS (
  SELECT device_id, segment, _chunk, _ce, _max_ls,
         CASE WHEN _prev_last IS NULL OR _prev_last.ep <> _first_ep
                   OR coalesce(_prev_last.data <> _first.data, false) THEN _first.id END AS _first_start_id,
         CASE WHEN _next_first IS NOT NULL AND _next_first.ep = _last_ep THEN _next_first.ts
              ELSE _last.ts END AS _last_end
  FROM s2 WHERE _first IS NOT NULL
),
summ AS (
  SELECT device_id, segment, _chunk, _ce, _first_start_id, _last_end,
         max(greatest(_max_ls, _first_start_id))
           OVER (PARTITION BY device_id, segment ORDER BY _chunk
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS _run_carry
  FROM s3
),
z AS (
  SELECT l.device_id, l.segment, l.id, l.data, l.ts,
         coalesce(greatest(l._lep, r._ce), -1) AS epoch,
         greatest(l._ls, r._first_start_id, r._run_carry) AS run_id,
         coalesce(l._lend, r._last_end) AS _end
  FROM w l LEFT JOIN summ r ON {_SAME_CHUNK}
)
SELECT device_id, run_id AS id, segment, data,
       min_by(ts, id) AS ts_start, max_by(_end, id) AS ts_end,
       min(epoch) AS epoch, count(*) AS n_obs, CAST(map() AS MAP<STRING, BOOLEAN>) AS sync
FROM z GROUP BY device_id, segment, run_id, data""", u=u)


def latest_state(runs: DataFrame) -> DataFrame:
    """Current run of each (device, segment): the latest run opened after the
    device's last restart. A segment with no run since then (and the app
    segment right after a restart) has no row.

    One pass: the greatest row of each (device, segment) and of each device's
    restarts come from partial aggregates, whose results have a row for each
    device and segment at most."""
    fields = [c for c in runs.columns if c not in (*KEYS, "id", "sync")]
    restart = F.when(is_restart(F.col("segment"), F.col("data")), F.col("id"))
    rest = F.struct(*fields, *(F.map_entries(c).alias(c) for c in runs.columns if c == "sync"))
    last = runs.groupBy(*KEYS).agg(F.max_by(F.struct("id", rest.alias("rest")), "id").alias("last"), F.max(restart).alias("_restart"))
    current = F.max("_restart").over(Window.partitionBy("device_id"))  # a row for each segment
    last = last.withColumn("_current", F.coalesce(current, F.lit(-1).cast("long"))).where(F.col("last.id") > F.col("_current"))
    out = last.select(*KEYS, F.col("last.id").alias("id"), *(F.col(f"last.rest.{c}").alias(c) for c in fields),
                      *(F.map_from_entries(F.col(f"last.rest.{c}")).alias(c) for c in runs.columns if c == "sync"))
    return out.select(*runs.columns)


def merge_runs(stored: DataFrame, new_obs: DataFrame, dest: str = S.CLOUD, chunk_ids: int | None = None,
               segments=S.SEGMENTS) -> DataFrame:
    """The run table after ``new_obs`` (valid observations whose ids are all
    greater than those that made ``stored``): stored runs are extended or
    closed and new ones added, as if all observations had been collapsed at
    once. A run that is extended loses its flag for ``dest`` and is sent
    again; one that is only closed keeps its flags.

    Only the last run of each (device, segment) and each device's last restart
    can still matter: they go into the collapse as observations of their own."""
    tail = stored.groupBy(*KEYS).agg(F.max_by(F.struct("id", "data", "ts_end"), "id").alias("r"))
    restart = (stored.where(is_restart(F.col("segment"), F.col("data"))).groupBy("device_id")
               .agg(F.max_by(F.struct("segment", "id", "data", "ts_end"), "id").alias("r")))
    columns = ("device_id", "id", "segment", "data", "ts")
    seeds = (tail.select("device_id", "r.id", "segment", "r.data", F.col("r.ts_end").alias("ts"))
             .union(restart.select("device_id", "r.id", "r.segment", "r.data", F.col("r.ts_end").alias("ts"))).distinct())
    runs = collapse_runs(seeds.select(*columns).unionByName(new_obs.select(*columns)), chunk_ids, segments)
    new = runs.select(*(F.col(c).alias(f"_{c}") for c in ("device_id", "id", "segment", "data", "ts_start", "ts_end", "epoch", "n_obs")))
    both = stored.join(new, (F.col("device_id") == F.col("_device_id")) & (F.col("id") == F.col("_id")), "full_outer")
    extended = F.col("n_obs") + F.col("_n_obs") - 1
    return both.select(
        *(F.coalesce(c, f"_{c}").alias(c) for c in ("device_id", "id", "segment", "data", "ts_start")),
        F.coalesce("_ts_end", "ts_end").alias("ts_end"), F.coalesce("epoch", "_epoch").alias("epoch"),
        F.coalesce(extended, F.col("n_obs"), F.col("_n_obs")).alias("n_obs"),
        F.when(F.col("id").isNull(), F.create_map().cast(S.SYNC_MAP)).when(F.col("_n_obs") > 1, drop_flag(F.col("sync"), dest))
        .otherwise(F.col("sync")).alias("sync"))
