import datetime as dt
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from fieldsense.operators import readings as R
from fieldsense.streaming import calendar_stream

SCHEMA = "mac string, sid short, type string, val float, ts timestamp"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture(params=["2024-03-30", "2024-10-26"])
def lisbon(spark, request):
    """A session in a zone whose clock changes on the day after the given one."""
    conf = {"spark.sql.session.timeZone": "Europe/Lisbon", "spark.sql.streaming.stateStore.providerClass": ROCKS}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield dt.datetime.fromisoformat(request.param)
    for k, v in before.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def _write(folder, n, rows):
    path = f"{folder}/{n}.json"
    with open(path, "w") as f:
        for mac, sid, kind, val, utc in rows:
            f.write(json.dumps({"mac": mac, "sid": sid, "type": kind, "val": val, "ts": utc.isoformat() + "Z"}) + "\n")
    os.utime(path, (1_700_000_000 + 10 * n, 1_700_000_000 + 10 * n))


def _run(spark, folder, ck, name, every):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(folder)
    q = (calendar_stream(stream, every, late="2 hours").writeStream.format("memory").queryName(name).outputMode("append")
         .option("checkpointLocation", ck).trigger(availableNow=True).start())
    q.awaitTermination(300)
    assert q.exception() is None
    return spark.table(name).collect()


@pytest.mark.parametrize("every", ["5 hours", "1 day"])
def test_stream_equals_batch_across_the_change(spark, tmp_path, lisbon, every):
    rnd, folder = random.Random(1), str(tmp_path / "src")
    os.makedirs(folder)
    rows = [(f"m{rnd.randrange(3)}", 1, rnd.choice("th"), float(rnd.randrange(1, 50)), lisbon + dt.timedelta(minutes=rnd.randrange(3 * 24 * 60)))
            for _ in range(400)]
    rows.sort(key=lambda r: r[4])
    for n in range(4):
        part = rows[n * 100:(n + 1) * 100]
        rnd.shuffle(part)
        _write(folder, n, part)
    _write(folder, 4, [("far", 1, "t", 5.0, lisbon + dt.timedelta(days=9))])  # the clock of the stream goes on
    got = _run(spark, folder, str(tmp_path / "ck"), f"cal_{every[0]}_{lisbon.month}", every)
    assert all(r.late == 0 for r in got)
    batch = R.rollup(spark.read.schema(SCHEMA).json(folder).where("mac <> 'far'"), **(
        {"n_hours": 5} if every == "5 hours" else {"every": every}))
    assert sorted((r.time, r.mac, r.sid, r.type, r.val_avg, r.val_stddev, r.val_count) for r in got) == sorted(tuple(r) for r in batch.collect())
    if every == "1 day":
        assert dt.timedelta(hours=23 if lisbon.month == 3 else 25) in {r.time_end - r.time for r in got}


def test_late_readings_are_counted(spark, tmp_path, lisbon):
    folder = str(tmp_path / "src")
    os.makedirs(folder)
    at = lambda h: lisbon + dt.timedelta(hours=h)
    _write(folder, 0, [("m", 1, "t", 10.0, at(12)), ("m", 1, "t", 20.0, at(13))])
    _write(folder, 1, [("m", 1, "t", 30.0, at(60))])
    _write(folder, 2, [("m", 1, "t", 40.0, at(60.5))])
    _write(folder, 3, [("m", 1, "t", 33.0, at(12)), ("m", 1, "t", 50.0, at(61))])  # the first day is over
    _write(folder, 4, [("far", 1, "t", 5.0, at(400))])
    got = _run(spark, folder, str(tmp_path / "ck"), f"cal_late_{lisbon.month}", "1 day")
    closed = sorted((r.val_avg, r.val_count) for r in got if r.val_count)
    assert closed == [(15.0, 2), (40.0, 3)]
    assert [(r.val_count, r.late) for r in got if not r.val_count] == [(0, 1)]
