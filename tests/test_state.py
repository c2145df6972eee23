import datetime as dt
import random

import pytest

from fieldsense.operators import state as ST
from fieldsense.sources import fixtures as FX

from .state_model import canonical, collapse

T0 = FX.T0


def _m(minute):
    return T0 + dt.timedelta(minutes=minute)


def test_run_sequence(spark):
    valid, rejected = ST.check_observations(FX.state_observations(spark))
    assert rejected.count() == 0
    runs = sorted(ST.collapse_runs(valid).collect(), key=lambda r: r.id)
    got = [(r.id, r.segment, r.data, r.ts_start, r.ts_end) for r in runs]
    g0 = '{"pin":7,"userId":0,"value":0}'
    g1 = '{"pin":7,"userId":0,"value":1}'
    assert got == [
        (1, "app", '{"value":"restart"}', _m(0), _m(0)),
        (2, "gpio", g0, _m(1), _m(3)),
        (4, "gpio", g1, _m(3), _m(3)),
        (5, "connectivity", '{"value":1}', _m(4), _m(4)),
        (6, "app", '{"value":"restart"}', _m(5), _m(5)),
        (7, "gpio", g1, _m(6), _m(6)),
        (8, "connectivity", '{"value":1}', _m(7), _m(7)),
    ]
    assert [r.n_obs for r in runs] == [1, 2, 1, 1, 1, 1, 1]
    assert all(r.sync == {} for r in runs)


def test_epochs_and_latest(spark):
    valid, _ = ST.check_observations(FX.state_observations(spark))
    ep = {r.id: r.epoch for r in ST.restart_epochs(valid).collect()}
    assert ep == {1: -1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: 6, 8: 6}
    latest = {r.segment: r.id for r in ST.latest_state(ST.collapse_runs(valid)).collect()}
    assert latest == {"gpio": 7, "connectivity": 8}


def test_rejects(spark):
    rows = [("d", 1, "x", '{"a":1}', T0), ("d", 2, "gpio", "{}", T0), ("d", 3, "gpio", "[1]", T0),
            ("d", 4, None, '{"a":1}', T0), ("d", 5, "cloud", "nope", T0), ("d", 6, "cloud", '{"a":1,"a":2}', T0),
            ("d", 7, "cloud", '{"value": 1.0}', T0), ("d", 8, "gpio", '{"userId": 3, "value": 1}', T0),
            ("d", 9, "gpio", '{"userId": null, "value": 1}', T0), ("d", 10, "cloud", '{"a":1} tail', T0),
            ("d", 11, "cloud", '{"a":1},{"a":2}', T0), ("d", 12, "cloud", '{"v":1e2}', T0),
            ("d", 13, "cloud", '{"v":[1e2, 15e-1], "s": "1.0,"}', T0)]
    valid, rejected = ST.check_observations(spark.createDataFrame(rows, FX.OBS_SCHEMA))
    assert {r.id: r.reason for r in rejected.collect()} == {
        1: "segment", 2: "data", 3: "data", 4: "segment", 5: "data", 10: "data", 11: "data"}
    assert {r.id: r.data for r in valid.collect()} == {
        6: '{"a":2}', 12: '{"v":100}', 13: '{"s":"1.0,","v":[100,1.5]}', 7: '{"value":1}', 8: '{"userId":3,"value":1}', 9: '{"userId":0,"value":1}'}


def _random_observations(seed, n=400, devices=3):
    rnd = random.Random(seed)
    out = []
    segs = ["gpio", "connectivity", "cloud", "app"]
    for i in range(n):
        dev = f"d{rnd.randrange(devices)}"
        seg = rnd.choice(segs)
        if seg == "app":
            data = '{"value":"restart"}' if rnd.random() < 0.6 else '{"value":"other"}'
        else:
            data = canonical(f'{{"value": {rnd.randrange(2)}}}')
        out.append((dev, i * 3 + rnd.randrange(3), seg, data, T0 + dt.timedelta(seconds=i)))
    return out


@pytest.mark.parametrize("seed,chunk", [(1, None), (2, 7), (3, 50), (4, 1)])
def test_runs_equal_sequential_model(spark, seed, chunk):
    obs = _random_observations(seed)
    df = spark.createDataFrame(obs, FX.OBS_SCHEMA)
    got = {r.id: (r.device_id, r.segment, r.data, r.ts_start, r.ts_end, r.epoch, r.n_obs)
           for r in ST.collapse_runs(df, chunk_ids=chunk).collect()}
    assert got == collapse(obs)


def test_sparse_ids_make_no_tiny_chunks(spark, monkeypatch):
    monkeypatch.setattr(ST, "CHUNK_ROWS", 100)
    obs = [(d, i << 22, s, data, ts) for d, i, s, data, ts in _random_observations(5, n=300)]
    df = spark.createDataFrame(obs, FX.OBS_SCHEMA)
    chunks = ST._with_markers(df, None, ("gpio", "connectivity", "cloud", "app")).select("_chunk").distinct().count()
    assert chunks <= 10
    got = {r.id: (r.device_id, r.segment, r.data, r.ts_start, r.ts_end, r.epoch, r.n_obs) for r in ST.collapse_runs(df).collect()}
    assert got == collapse(obs)


@pytest.mark.parametrize("seed,cut", [(6, 400), (7, 30), (8, 1150)])
def test_merge_equals_collapse_at_once(spark, seed, cut):
    obs = _random_observations(seed)
    early, late = [o for o in obs if o[1] < cut], [o for o in obs if o[1] >= cut]
    stored = ST.collapse_runs(spark.createDataFrame(early, FX.OBS_SCHEMA))
    from pyspark.sql import functions as F
    stored = stored.withColumn("sync", F.create_map(F.lit("cloud"), F.lit(True), F.lit("other"), F.lit(True)))
    merged = ST.merge_runs(stored, spark.createDataFrame(late, FX.OBS_SCHEMA)).collect()
    assert {r.id: (r.device_id, r.segment, r.data, r.ts_start, r.ts_end, r.epoch, r.n_obs) for r in merged} == collapse(obs)
    before = {k: v[-1] for k, v in collapse(early).items()}
    for r in merged:  # extended runs are sent again, closed ones are not
        want = {} if r.id not in before else {"other": True} if r.n_obs > before[r.id] else {"cloud": True, "other": True}
        assert r.sync == want
