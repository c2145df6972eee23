import json

import pytest

from fieldsense.operators import ingest as IN
from fieldsense.operators import readings as R
from fieldsense.sources import fixtures as FX

AS_OF = "2024-01-31 00:00:00"


def test_ingest_script_batches(spark):
    good, rejected = IN.validate_batches(FX.ingest_batches(spark))
    assert good.count() == 8 and rejected.count() == 0
    rows = IN.reshape_batches(good, AS_OF)
    assert rows.count() == 10
    r = rows.where("batch_id = 'r1'").collect()[0]
    assert (r.mac, r.sid, r.type, r.description, r.battery) == ("999-888-777", 1234, "t", "microfone_1", None)
    assert r.val == pytest.approx(10.1)
    kept = R.filter_readings(rows.withColumnRenamed("pos", "p"), R.STRICT_60, sort=False)
    assert kept.count() == 7
    receipt = {x.batch_id: x.new_records for x in IN.ingest_receipt(rows, AS_OF).collect()}
    assert receipt["r7"] == 2 and receipt["r1"] == 1


BAD = {
    "no_mac": ({"data": [{"sid": 1, "value": 1, "type": "t"}]}, "mac"),
    "empty_mac": ({"mac": "", "data": [{"sid": 1, "value": 1, "type": "t"}]}, "mac"),
    "battery": ({"mac": "m", "battery": "x", "data": [{"sid": 1, "value": 1, "type": "t"}]}, "battery"),
    "empty_data": ({"mac": "m", "data": []}, "data"),
    "no_data": ({"mac": "m"}, "data"),
    "sid_frac": ({"mac": "m", "data": [{"sid": "1.5", "value": 1, "type": "t"}]}, "sid"),
    "sid_big": ({"mac": "m", "data": [{"sid": 40000, "value": 1, "type": "t"}]}, "sid"),
    "type_x": ({"mac": "m", "data": [{"sid": 1, "value": 1, "type": "x"}]}, "type"),
    "value_abc": ({"mac": "m", "data": [{"sid": 1, "value": "abc", "type": "t"}]}, "value"),
    "no_value": ({"mac": "m", "data": [{"sid": 1, "type": "t"}]}, "value"),
    "one_bad": ({"mac": "m", "data": [{"sid": 1, "value": 1, "type": "t"},
                                      {"sid": 2, "value": 2, "type": "q"}]}, "type"),
    "null_item": ({"mac": "m", "data": [None]}, "sid"),
    "data_object": ({"mac": "m", "data": {"sid": 1, "value": 1, "type": "t"}}, "data"),
    "item_battery": ({"mac": "m", "data": [{"sid": 1, "value": 1, "type": "t", "battery": "x"}]}, "battery"),
    "value_inf": ({"mac": "m", "data": [{"sid": 1, "value": "Infinity", "type": "t"}]}, "value"),
    "sid_float_suffix": ({"mac": "m", "data": [{"sid": "1f", "value": 1, "type": "t"}]}, "sid"),
    "value_suffix": ({"mac": "m", "data": [{"sid": 1, "value": "10d", "type": "t"}]}, "value"),
    "value_hex": ({"mac": "m", "data": [{"sid": 1, "value": "0x1p3", "type": "t"}]}, "value"),
    "value_no_float": ({"mac": "m", "data": [{"sid": 1, "value": 1e300, "type": "t"}]}, "value"),
    "mac_number": ({"mac": 5, "data": [{"sid": 1, "value": 1, "type": "t"}]}, "mac"),
    "mac_object": ({"mac": {"x": 1}, "data": [{"sid": 1, "value": 1, "type": "t"}]}, "mac"),
    "desc_object": ({"mac": "m", "data": [{"sid": 1, "value": 1, "type": "t", "desc": {"x": 1}}]}, "desc"),
    "desc_number": ({"mac": "m", "data": [{"sid": 1, "value": 1, "type": "t", "desc": 3}]}, "desc"),
    "sid_bool": ({"mac": "m", "data": [{"sid": True, "value": 1, "type": "t"}]}, "sid"),
}


OK = '{"mac": "m", "data": [{"sid": 1, "value": 1, "type": "t"}]}'
NOT_ONE = {"tail": OK + " xyz", "two": OK + "," + OK, "bracket": OK + " ]garbage", "list": f"[{OK}]", "number": "5", "empty": ""}


def test_rejects(spark):
    rows = [(k, json.dumps(doc)) for k, (doc, _) in BAD.items()] + [("not_json", "{oops")] + list(NOT_ONE.items())
    good, rejected = IN.validate_batches(spark.createDataFrame(rows, "batch_id string, raw string"))
    assert good.count() == 0
    got = {r.batch_id: r.reason for r in rejected.collect()}
    want = {k: reason for k, (_, reason) in BAD.items()} | {"not_json": "json"} | dict.fromkeys(NOT_ONE, "json")
    assert got == want


def test_unknown_keys_and_numeric_text(spark):
    doc = {"mac": "m", "extra": 1, "data": [{"sid": "3", "value": "1e1", "type": "h", "desc": "", "x": 1}]}
    good, _ = IN.validate_batches(spark.createDataFrame([("a", json.dumps(doc))], "batch_id string, raw string"))
    r = IN.reshape_batches(good, AS_OF).collect()[0]
    assert (r.sid, r.val, r.description) == (3, 10.0, "")


def test_insert_measurements_object_or_array(spark):
    one = {"sid": 1235, "value": 99.9, "type": "h", "desc": "pt", "mac": "999", "description": "pt", "val": 99.9}
    two = [one, dict(one, val=20.1, type="t")]
    bad = [dict(one, sid=1.5)]
    raw = spark.createDataFrame([(1, json.dumps(one)), (2, json.dumps(two)), (3, json.dumps(bad))],
                                "req long, raw string")
    rows, rejected = IN.insert_measurements(raw, AS_OF)
    got = sorted((r.req, r.pos, r.type) for r in rows.collect())
    assert got == [(1, 0, "h"), (2, 0, "h"), (2, 1, "t")]
    assert [r.req for r in rejected.collect()] == [3]
    assert set(rows.columns) >= {"mac", "sid", "type", "description", "val", "battery", "ts", "sync"}


def test_upgrade_layout(spark):
    df = spark.createDataFrame([(1, True, False), (2, False, True), (3, None, None)],
                               "id long, sync boolean, agg boolean")
    out = {r.id: (r.sync_old, r.sync) for r in IN.upgrade_measurements(df).collect()}
    assert out == {1: (True, {"cloud": True}), 2: (False, {"cloud": False}), 3: (None, None)}
    assert "agg" not in IN.upgrade_measurements(df).columns
