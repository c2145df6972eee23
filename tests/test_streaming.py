import datetime as dt
import json
import os
import random
import tempfile

from pyspark.sql import functions as F

from fieldsense.operators import readings as R
from fieldsense.operators import state as ST
from fieldsense.sources import fixtures as FX
from fieldsense.streaming import (ingest_stream, latest_versions, rollup_stream, state_runs_stream,
                                  sync_tick)
from fieldsense.streaming.state import with_restarts

from .test_state import _random_observations


def _tmp():
    return tempfile.mkdtemp(prefix="fs-test-")


_MTIME = [1_700_000_000]


def _write_jsonl(folder, name, records):
    """Write one JSON-lines file with a distinct, increasing modification
    time: the file source takes files oldest first, so arrival order is the
    writing order."""
    path = os.path.join(folder, name)
    with open(path, "w") as f:
        for r in records:
            f.write(json.dumps(r) + "\n")
    _MTIME[0] += 10
    os.utime(path, (_MTIME[0], _MTIME[0]))


def test_state_stream_in_order_equals_batch(spark):
    obs = _random_observations(22, n=300)
    obs.sort(key=lambda r: r[1])
    src = _tmp()
    for part in range(4):
        chunk = obs[part * 75:(part + 1) * 75]
        _write_jsonl(src, f"part-{part}.json", [
            {"device_id": d, "id": i, "segment": s, "data": data, "ts": ts.isoformat()} for d, i, s, data, ts in chunk])
    stream = spark.readStream.schema(FX.OBS_SCHEMA).option("maxFilesPerTrigger", 1).json(src)
    q = (state_runs_stream(stream).writeStream.format("memory").queryName("runs_updates_ordered")
         .outputMode("update").option("checkpointLocation", _tmp())
         .trigger(availableNow=True).start())
    q.awaitTermination(300)
    got = {tuple(r) for r in latest_versions(spark.table("runs_updates_ordered")).select(
        "device_id", "id", "segment", "data", "ts_start", "ts_end", "epoch", "n_obs").collect()}
    df = spark.createDataFrame(obs, FX.OBS_SCHEMA)
    want = {tuple(r) for r in ST.collapse_runs(ST.check_observations(df)[0]).drop("sync").collect()}
    assert got == want


def test_ingest_stream(spark):
    src, rows_dir, rej_dir = _tmp(), _tmp(), _tmp()
    reqs = [{"batch_id": f"r{i + 1}", "raw": FX.request_json(*req)} for i, req in enumerate(FX.INGEST_REQUESTS)]
    reqs.append({"batch_id": "bad", "raw": '{"mac": "x", "data": []}'})
    _write_jsonl(src, "a.json", reqs[:4])
    _write_jsonl(src, "b.json", reqs[4:])
    rec_dir = _tmp()
    q = ingest_stream(spark, src, rows_dir, rej_dir, _tmp(), trigger={"availableNow": True},
                      receipt_dir=rec_dir)
    q.awaitTermination(300)
    rows = spark.read.parquet(rows_dir)
    assert rows.count() == 10
    receipts = {r.batch_id: r.new_records for r in spark.read.parquet(rec_dir).collect()}
    assert receipts["r7"] == 2 and len(receipts) == 8
    assert rows.where(F.col("ts").isNull()).count() == 0
    assert [r.batch_id for r in spark.read.parquet(rej_dir).collect()] == ["bad"]


def test_rollup_stream(spark):
    src = _tmp()
    FX.readings(spark).drop("sync").write.mode("overwrite").parquet(src + "/r")
    schema = FX.readings(spark).drop("sync").schema
    stream = spark.readStream.schema(schema).parquet(src + "/r")
    q = (rollup_stream(stream, 12, R.STRICT_60).writeStream.format("memory").queryName("roll12")
         .outputMode("update").option("checkpointLocation", _tmp()).trigger(availableNow=True).start())
    q.awaitTermination(300)
    got = {(r.time, r.mac, r.sid, r.type, r.val_avg, r.val_count) for r in spark.table("roll12").collect()}
    want = {(r.time, r.mac, r.sid, r.type, r.val_avg, r.val_count)
            for r in R.rollup(FX.readings(spark), 12, R.STRICT_60).collect()}
    assert got == want


def test_sync_tick(spark):
    out = _tmp()
    m = FX.readings(spark)
    state = spark.createDataFrame([(1, "gpio", '{"value":1}', FX.T0, FX.T0, {})],
                                  "id long, segment string, data string, ts_start timestamp_ntz, ts_end timestamp_ntz, sync map<string,boolean>")
    assert sync_tick(m, state, out, 0, limit=5)
    doc = json.loads(spark.read.text(f"{out}/tick=0").collect()[0].value)
    assert [r["id"] for r in doc["measurements"]] == [1, 2, 3, 4, 5] and len(doc["logState"]) == 1
    assert not sync_tick(m.where("false"), state.where("false"), out, 1)


def _stream_runs(spark, obs, parts, name):
    src = _tmp()
    size = (len(obs) + parts - 1) // parts
    for part in range(parts):
        chunk = obs[part * size:(part + 1) * size]
        _write_jsonl(src, f"part-{part:03d}.json", [
            {"device_id": d, "id": i, "segment": s, "data": data, "ts": ts.isoformat()} for d, i, s, data, ts in chunk])
    stream = spark.readStream.schema(FX.OBS_SCHEMA).option("maxFilesPerTrigger", 1).json(src)
    q = (state_runs_stream(stream).writeStream.format("memory").queryName(name)
         .outputMode("update").option("checkpointLocation", _tmp())
         .trigger(availableNow=True).start())
    q.awaitTermination(300)
    return {tuple(r) for r in latest_versions(spark.table(name)).select(
        "device_id", "id", "segment", "data", "ts_start", "ts_end", "epoch", "n_obs").collect()}


def test_state_stream_fixture_split(spark):
    obs = [("d1", i, seg, data, FX.T0 + dt.timedelta(minutes=m)) for i, m, seg, data in FX.STATE_SEQUENCE]
    got = _stream_runs(spark, obs, 3, "runs_fixture")
    df = spark.createDataFrame(obs, FX.OBS_SCHEMA)
    want = {tuple(r) for r in ST.collapse_runs(ST.check_observations(df)[0]).drop("sync").collect()}
    assert got == want and len(got) == 7


def test_state_stream_many_batches(spark):
    for seed in (31, 32):
        obs = sorted(_random_observations(seed, n=500, devices=2), key=lambda r: r[1])
        got = _stream_runs(spark, obs, 9, f"runs_many_{seed}")
        df = spark.createDataFrame(obs, FX.OBS_SCHEMA)
        want = {tuple(r) for r in ST.collapse_runs(ST.check_observations(df)[0]).drop("sync").collect()}
        assert got == want


def test_state_stream_of_a_hot_device(spark):
    rnd = random.Random(5)
    obs = sorted(_random_observations(41, n=400, devices=6), key=lambda r: r[1])
    top = obs[-1][1]
    # one device has a third of all rows, nearly all in one segment, and restarts that cut it
    hot = [("hot", top + 1 + i, "app" if i % 67 == 0 else "gpio" if i % 5 else "cloud",
            '{"value":"restart"}' if i % 67 == 0 else json.dumps({"value": rnd.randrange(2)}),
            FX.T0 + dt.timedelta(minutes=i)) for i in range(200)]
    obs = [r for pair in zip(obs[::2], hot, obs[1::2]) for r in pair]
    obs = [(d, i, s, data, ts) for i, (d, _, s, data, ts) in enumerate(obs, 1)]
    got = _stream_runs(spark, obs, 5, "runs_hot")
    df = spark.createDataFrame(obs, FX.OBS_SCHEMA)
    valid, _ = ST.check_observations(df)
    assert got == {tuple(r) for r in ST.collapse_runs(valid).drop("sync").collect()}
    # a group has its own rows and the device's restarts, whatever its other segments have
    groups = {(r.device_id, r.segment): r.n for r in with_restarts(valid).groupBy("device_id", "segment").agg(
        F.count("*").alias("n")).collect()}
    restarts = sum(d == "hot" and s == "app" for d, _, s, _, _ in obs)
    assert groups["hot", "cloud"] == sum(d == "hot" and s == "cloud" for d, _, s, _, _ in obs) + restarts
    assert groups["hot", "connectivity"] == restarts


def test_state_of_idle_groups_expires(spark):
    src = _tmp()
    one = {"segment": "gpio", "data": '{"value":1,"userId":0}'}
    for k, (device, i) in enumerate([("d1", 1), ("d1", 2), ("d2", 3), ("d1", 4)]):
        _write_jsonl(src, f"part-{k}.json", [dict(one, device_id=device, id=i, ts=(FX.T0 + dt.timedelta(minutes=i)).isoformat())])
    stream = spark.readStream.schema(FX.OBS_SCHEMA).option("maxFilesPerTrigger", 1).json(src)
    runs = {}
    for name, hours in (("runs_kept", None), ("runs_expired", 1e-9)):
        q = (state_runs_stream(stream, hours).writeStream.format("memory").queryName(name).outputMode("update")
             .option("checkpointLocation", _tmp()).trigger(availableNow=True).start())
        q.awaitTermination(300)
        runs[name] = {(r.device_id, r.id, r.n_obs) for r in latest_versions(spark.table(name)).collect()}
    assert runs["runs_kept"] == {("d1", 1, 3), ("d2", 3, 1)}
    assert runs["runs_expired"] == {("d1", 1, 2), ("d2", 3, 1), ("d1", 4, 1)}
