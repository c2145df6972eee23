"""Streaming run collapse: one stateful group per device and segment.

A restart is copied to each segment's group of its device. The state of a group is
the last restart id and the run that can still be extended (id, data, start, end,
count, epoch): a handful of values, whatever the stream length, and none of a run
that a restart has cut off. Each micro-batch emits the runs it opened or
changed (output mode ``update``); the latest version of a run is the row
with the greatest ``n_obs``/``ts_end``.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from .. import schemas as S
from ..operators.state import check_observations, is_restart

RUN_FIELDS = ["device_id", "id", "segment", "data", "ts_start", "ts_end", "epoch", "n_obs"]
STATE_SCHEMA = T.StructType([T.StructField("json", T.StringType())])


def run_schema(ts_type: T.DataType) -> T.StructType:
    return T.StructType([
        T.StructField("device_id", T.StringType()), T.StructField("id", T.LongType()),
        T.StructField("segment", T.StringType()), T.StructField("data", T.StringType()),
        T.StructField("ts_start", ts_type), T.StructField("ts_end", ts_type),
        T.StructField("epoch", T.LongType()), T.StructField("n_obs", T.LongType()),
    ])


def with_restarts(valid: DataFrame) -> DataFrame:
    """(device_id, segment, id, data, ts, restart, own): each observation under
    its segment and, where it is a restart, a marker (not ``own``, no data) under each
    other segment of its device."""
    restart = is_restart(F.col("segment"), F.col("data"))
    each = F.explode(F.when(F.col("restart"), F.array(*map(F.lit, S.SEGMENTS))).otherwise(F.array("segment"))).alias("to")
    own = F.col("to") == F.col("segment")
    return (valid.select("device_id", "segment", "id", "data", "ts", F.coalesce(restart, F.lit(False)).alias("restart"))
            .select("*", each)
            .select("device_id", F.col("to").alias("segment"), "id", F.when(own, F.col("data")).alias("data"), "ts", "restart",
                    own.alias("own")))


def _touched_runs(g: pd.DataFrame, open_run: dict | None) -> list[dict]:
    """Runs touched by a group's rows (sorted by id, data as a code) of a
    micro-batch, given the run left open by earlier batches; the last is the one left open."""
    prev_data, prev_ep = g["data"].shift(1), g["epoch"].shift(1)
    if open_run is not None:
        prev_data.iloc[0], prev_ep.iloc[0] = open_run["data"], open_run["epoch"]
    start = prev_ep.isna() | (prev_ep != g["epoch"]) | (prev_data != g["data"])
    # the row's run, -1 for leading rows that extend the open run
    run = np.maximum.accumulate(np.where(start, np.arange(len(g)), -1))
    end = np.where(g["epoch"].shift(-1) == g["epoch"], g["ts"].shift(-1, fill_value=0), g["ts"])
    touched, cont = [], int((run < 0).sum())
    if open_run is not None:
        if cont:
            touched.append(dict(open_run, end=int(end[cont - 1]), n=open_run["n"] + cont))
        elif open_run["epoch"] == g["epoch"].iloc[0]:
            # the first row changes the data: the open run ends there
            touched.append(dict(open_run, end=int(g["ts"].iloc[0])))
        # else it was opened before a restart and is left as it is
    first = np.flatnonzero(start)
    last = np.r_[first[1:], len(g)] - 1
    ids, data, ts, epoch = (g[c].to_numpy() for c in ("id", "data", "ts", "epoch"))
    touched += [{"id": int(ids[a]), "data": int(data[a]), "start": int(ts[a]), "end": int(end[b]), "n": int(b - a + 1),
                 "epoch": int(epoch[a])} for a, b in zip(first, last[:len(first)])]
    return touched


def _coded(batches, codes: dict[str | None, int]) -> pd.DataFrame:
    """The rows of all batches in id order, their data as numbers of ``codes``, so
    that a row held costs some bytes and each different state is held once."""
    frames = [pd.DataFrame({
        "id": b["id"].astype("int64"), "ts": pd.to_datetime(b["ts"]).dt.as_unit("us").astype("int64"),
        "data": np.fromiter((codes.setdefault(d, len(codes)) for d in b["data"]), np.int64, len(b)),
        "restart": b["restart"].astype(bool), "own": b["own"].astype(bool)}) for b in batches if len(b)]
    return pd.concat(frames).sort_values("id", kind="stable").reset_index(drop=True) if frames else pd.DataFrame()


def _advance(expire_ms: int | None):
    def advance(key, batches, state):
        """Apply one micro-batch of a group's observations and restarts in id order."""
        device, segment = key
        if state.hasTimedOut:
            state.remove()
            return
        held = json.loads(state.get[0]) if state.exists else {"restart": -1, "open": None}
        open_run, codes = held["open"], {}
        if open_run is not None:
            codes[open_run["data"]] = 0
            open_run = dict(open_run, data=0)
        rows = _coded(batches, codes)
        if not len(rows):
            return
        # epoch: last restart strictly before the row (a restart belongs to the epoch before it)
        rows["epoch"] = rows["id"].where(rows["restart"]).shift(1).ffill().fillna(held["restart"]).astype("int64")
        if rows["restart"].any():
            held["restart"] = int(rows.loc[rows["restart"], "id"].iloc[-1])
        own = rows[rows["own"]].reset_index(drop=True)
        touched = _touched_runs(own, open_run) if len(own) else []
        texts = list(codes)
        touched = [dict(t, data=texts[t["data"]]) for t in touched]
        last = touched[-1] if touched else held["open"]
        held["open"] = last if last is not None and last["epoch"] == held["restart"] else None
        state.update((json.dumps(held),))
        if expire_ms is not None:
            state.setTimeoutDuration(expire_ms)
        if touched:
            yield pd.DataFrame({
                "device_id": device, "id": [t["id"] for t in touched], "segment": segment,
                "data": [t["data"] for t in touched],
                "ts_start": pd.to_datetime([t["start"] for t in touched], unit="us"),
                "ts_end": pd.to_datetime([t["end"] for t in touched], unit="us"),
                "epoch": [t["epoch"] for t in touched], "n_obs": [t["n"] for t in touched]})

    return advance


def state_runs_stream(observations: DataFrame, expire_hours: float | None = None) -> DataFrame:
    """Streaming observations -> run upserts of the valid ones; the others are
    the stream of ``rejected_stream``. Sorting happens inside each group, since arrival order within a
    micro-batch is not guaranteed; a task holds some bytes for each of its groups'
    rows of a micro-batch, and each different state once.

    With ``expire_hours``, a group that nothing came for in so many hours of processing
    time, a restart included, is forgotten, its last restart with it: the next
    observation opens a run, of epoch -1, even if the state is unchanged."""
    valid, _ = check_observations(observations)
    ts_type = observations.schema["ts"].dataType
    expire_ms = None if expire_hours is None else max(1, round(expire_hours * 3_600_000))
    return (with_restarts(valid)
            .groupBy("device_id", "segment")
            .applyInPandasWithState(_advance(expire_ms), run_schema(ts_type), STATE_SCHEMA, "update",
                                    GroupStateTimeout.NoTimeout if expire_ms is None else GroupStateTimeout.ProcessingTimeTimeout))


def rejected_stream(observations: DataFrame) -> DataFrame:
    """The observations that ``state_runs_stream`` doesn't take, with the reason."""
    return check_observations(observations)[1]


def latest_versions(updates: DataFrame) -> DataFrame:
    """Fold run upserts into the current run table (latest version per run)."""
    return (updates.groupBy("device_id", "id")
            .agg(F.max_by(F.struct(*[c for c in RUN_FIELDS if c not in ("device_id", "id")]),
                          F.struct("n_obs", "ts_end")).alias("r"))
            .select("device_id", "id", "r.*"))


def live_state_rows(updates: DataFrame, segment: str = S.GPIO_SEGMENT, keep=()) -> DataFrame:
    """The live push of a segment's state: ``{state, updatedAt}`` JSON per
    run update (second sink of the state stream, see ``outbox.live_stream``)
    with the device and the columns ``keep``."""
    doc = F.struct(F.get_json_object("data", "$.value").cast("int").alias("state"),
                   F.date_format("ts_end", "yyyy-MM-dd'T'HH:mm:ss.SSS").alias("updatedAt"))
    return updates.where(F.col("segment") == segment).select("device_id", *keep, F.to_json(doc).alias("payload"))
