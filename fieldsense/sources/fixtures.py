"""Small literal inputs used by the tests (and handy for trying operators)."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values of the literal reading set (54 rows).
#   series (mac, sid, type) and first value at 2016-09-01 12:00 (aa:cc at 12:03):
#     aa:bb 1 t 20.0 | aa:bb 1 h 70.1 | aa:bb 2 t 20.2 | aa:bb 2 h 70.3 | aa:cc 1 t 20.4 | aa:cc 2 t 20.5
#   slots: 12:00, 12:30, 13:00, 13:30 on 2016-09-01 and 2016-09-02, +1.0 per slot
#   invalid readings, 2016-09-02 13:50 (aa:cc 13:53), same series order:
#     -11, -2, 65, 111, -10, 80
# ---------------------------------------------------------------------------
SERIES = [("aa:bb", 1, "t", 20.0), ("aa:bb", 1, "h", 70.1), ("aa:bb", 2, "t", 20.2),
          ("aa:bb", 2, "h", 70.3), ("aa:cc", 1, "t", 20.4), ("aa:cc", 2, "t", 20.5)]
SLOT_DAYS = (dt.date(2016, 9, 1), dt.date(2016, 9, 2))
SLOT_TIMES = ((12, 0), (12, 30), (13, 0), (13, 30))
INVALID = (-11.0, -2.0, 65.0, 111.0, -10.0, 80.0)
INVALID_TIME = (13, 50)
LATE_MAC = "aa:cc"
LATE_MINUTES = 3

READINGS_SCHEMA = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("mac", T.StringType(), False),
    T.StructField("sid", T.ShortType(), False),
    T.StructField("type", T.StringType(), False),
    T.StructField("description", T.StringType(), True),
    T.StructField("val", T.FloatType(), True),
    T.StructField("ts", T.TimestampNTZType(), False),
    T.StructField("battery", T.ShortType(), True),
    T.StructField("agg", T.BooleanType(), True),
    T.StructField("sync", T.MapType(T.StringType(), T.BooleanType()), True),
])


def reading_rows() -> list[tuple]:
    """The 54 readings in insertion order (id = position + 1)."""
    rows = []
    step = 0
    for day in SLOT_DAYS:
        for hh, mm in SLOT_TIMES:
            for mac, sid, typ, first in SERIES:
                late = LATE_MINUTES if mac == LATE_MAC else 0
                ts = dt.datetime(day.year, day.month, day.day, hh, mm) + dt.timedelta(minutes=late)
                rows.append((mac, sid, typ, round(first + step, 1), ts))
            step += 1
    last = SLOT_DAYS[-1]
    for (mac, sid, typ, _), bad in zip(SERIES, INVALID):
        late = LATE_MINUTES if mac == LATE_MAC else 0
        ts = dt.datetime(last.year, last.month, last.day, *INVALID_TIME) + dt.timedelta(minutes=late)
        rows.append((mac, sid, typ, bad, ts))
    return [(i + 1, mac, sid, typ, None, val, ts, None, False, {})
            for i, (mac, sid, typ, val, ts) in enumerate(rows)]


def readings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(reading_rows(), READINGS_SCHEMA)


# ---------------------------------------------------------------------------
# Fixed values of the manual ingest script: 8 requests, 10 readings,
# given as (mac, battery or None, [(sid, value, type, desc), ...]); every
# field arrives as text, as in a query string.
# ---------------------------------------------------------------------------
INGEST_REQUESTS = [
    ("999-888-777", "294.12", [("1234", "10.1", "t", "microfone_1")]),
    ("999-888-777", "293.12", [("1234", "20.1", "t", "microfone_1")]),
    ("999-888-777", "292.12", [("1234", "80.1", "h", "microfone_1")]),
    ("999-888-777", "290.12", [("1234", "3000", "h", "microfone_1")]),
    ("999-888-666", None, [("1235", "90.1", "h", "probe_2")]),
    ("999-888-666", None, [("1235", "99.9", "h", "probe_2")]),
    ("999-888-666", None, [("1235", "99.9", "h", "probe_2"), ("1235", "20.1", "t", "probe_2")]),
    ("999-888-666", None, [("1235", "4000.9", "h", "probe_2"), ("1235", "-40.1", "t", "probe_2")]),
]


def request_json(mac, battery, items) -> str:
    doc = {"mac": mac}
    if battery is not None:
        doc["battery"] = battery
    doc["data"] = [{"sid": s, "value": v, "type": t, "desc": d} for s, v, t, d in items]
    return json.dumps(doc)


def ingest_batches(spark: SparkSession) -> DataFrame:
    rows = [(f"r{i + 1}", request_json(*req)) for i, req in enumerate(INGEST_REQUESTS)]
    return spark.createDataFrame(rows, "batch_id string, raw string")


# state observations of the run test: (id, minute, segment, data)
STATE_SEQUENCE = [
    (1, 0, "app", '{"value":"restart"}'),
    (2, 1, "gpio", '{"value":0,"pin":7}'),
    (3, 2, "gpio", '{"pin":7,"value":0}'),
    (4, 3, "gpio", '{"value":1,"pin":7}'),
    (5, 4, "connectivity", '{"value":1}'),
    (6, 5, "app", '{"value":"restart"}'),
    (7, 6, "gpio", '{"value":1,"pin":7}'),
    (8, 7, "connectivity", '{"value":1}'),
]

OBS_SCHEMA = T.StructType([
    T.StructField("device_id", T.StringType(), True),
    T.StructField("id", T.LongType(), False),
    T.StructField("segment", T.StringType(), True),
    T.StructField("data", T.StringType(), True),
    T.StructField("ts", T.TimestampNTZType(), False),
])

T0 = dt.datetime(2024, 1, 1, 0, 0)


def state_observations(spark: SparkSession, device: str = "d1") -> DataFrame:
    rows = [(device, i, seg, data, T0 + dt.timedelta(minutes=m)) for i, m, seg, data in STATE_SEQUENCE]
    return spark.createDataFrame(rows, OBS_SCHEMA)
