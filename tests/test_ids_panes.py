import datetime as dt

import pytest
from pyspark.sql import functions as F

from fieldsense.functions import calendar_bucket, calendar_next, is_one_json, integer_text, whole_json
from fieldsense.functions.timefn import parse_interval
from fieldsense.operators import ids as ID
from fieldsense.operators import panes as PA
from fieldsense.operators import readings as R
from fieldsense.sources import fixtures as FX
from fieldsense.sources.epochs import serial_epoch


def test_ids_are_gapless_and_ordered(spark):
    rows = [(f"b{k % 7}", k % 5, "x" * (k % 3), {"a": True}) for k in range(500)]
    schema = "batch_id string, pos int, note string, sync map<string,boolean>"
    runs = []
    for parts in (1, 13):
        df = spark.createDataFrame(rows, schema).repartition(parts)
        out = ID.with_serial_ids(df, ("batch_id", "pos"), 1000)
        assert out.columns == ["id", "batch_id", "pos", "note", "sync"]
        runs.append(sorted(tuple(r)[:4] for r in out.collect()))
    assert runs[0] == runs[1] and [r[0] for r in runs[0]] == list(range(1001, 1501))
    assert [r[1:] for r in runs[0]] == sorted(r[:3] for r in rows)


def test_ids_of_null_keys_and_empty_tables(spark):
    df = spark.createDataFrame([(None, 1), ("a", 2), (None, None)], "k string, v int")
    assert [tuple(r) for r in ID.with_serial_ids(df, "k").orderBy("id").collect()] == [(1, "a", 2), (2, None, 1), (3, None, None)]
    assert ID.with_serial_ids(df.where("false"), "k").count() == 0 and ID.last_id(df.selectExpr("v AS id").where("false")) == 0


def test_epochs_go_on_and_repeat(spark, tmp_path):
    df = spark.range(5).selectExpr("id AS k")
    get = lambda e: [r.id for r in serial_epoch(df, "k", str(tmp_path / "_ids"), e).orderBy("id").collect()]
    assert get(0) == [1, 2, 3, 4, 5] and get(1) == [6, 7, 8, 9, 10] and get(1) == [6, 7, 8, 9, 10]
    assert get(2) == [11, 12, 13, 14, 15] and get(0) == [1, 2, 3, 4, 5]


def test_panes_equal_rollup_with_late_rows(spark):
    m = FX.readings(spark)
    parts = [m.where(F.col("id") % 3 == k) for k in range(3)]
    panes = None
    for p in parts:  # each part is late for the panes before it
        own = PA.hour_panes(p, R.STRICT_60)
        panes = own if panes is None else panes.unionByName(own)
    merged = PA.merge_panes(panes)
    for n in (1, 5, 12):
        want = [tuple(r) for r in R.rollup(m, n, R.STRICT_60).collect()]
        assert [tuple(r) for r in PA.rollup_from_panes(panes, n).collect()] == want
        assert [tuple(r) for r in PA.rollup_from_panes(merged, n).collect()] == want
    week = [tuple(r) for r in R.rollup(m, bounds=R.STRICT_60, every="1 week").collect()]
    assert [tuple(r) for r in PA.rollup_from_panes(panes, every="1 week").collect()] == week and len(week) == 6


def test_panes_do_not_cancel(spark):
    rows = [(dt.datetime(2024, 1, 1, k % 20), "m", 1, "x", 1e8 + (k % 2)) for k in range(2000)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, mac string, sid int, type string, val double")
    wide = R.Bounds({}, (-1e12, 1e12))
    assert [r.val_stddev for r in PA.rollup_from_panes(PA.hour_panes(df, wide), 24).collect()] == [0.5]


def _zone(spark, name):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", name)
    return before


CASES = ["2024-03-30 23:30:00", "2024-03-31 00:10:00", "2024-03-31 03:30:00", "2024-03-31 23:59:59", "2024-04-01 00:00:00",
         "2024-10-26 12:00:00", "2024-10-27 00:30:00", "2024-10-27 23:59:00", "2024-10-28 00:00:00", "2023-12-31 23:00:00"]


def _expected(wall, every):
    n, unit = parse_interval(every)
    day = dt.datetime(wall.year, wall.month, wall.day)
    if unit in ("day", "week"):
        start = dt.datetime(1970, 1, 5 if unit == "week" else 1)
        span = n * (7 if unit == "week" else 1)
        return start + dt.timedelta(days=(day - start).days // span * span)
    if unit == "hour":
        start, hours = dt.datetime(1970, 1, 1), int((wall - dt.datetime(1970, 1, 1)).total_seconds() // 3600)
        return start + dt.timedelta(hours=hours // n * n)
    months = (wall.year - 1970) * 12 + wall.month - 1
    span = n * {"month": 1, "quarter": 3, "year": 12}[unit]
    months = months // span * span
    return dt.datetime(1970 + months // 12, months % 12 + 1, 1)


@pytest.mark.parametrize("every", ["1 day", "10 days", "week", "2 weeks", "1 month", "1 quarter", "2 years", "36 hours"])
def test_calendar_in_a_zone_with_daylight_saving(spark, every):
    before = _zone(spark, "Europe/Lisbon")
    try:
        df = spark.createDataFrame([(c,) for c in CASES], "wall string").select(F.col("wall").cast("timestamp").alias("t"), F.col("wall").cast("timestamp_ntz").alias("n"))
        for c, ntz in (("t", False), ("n", True)):
            b = calendar_bucket(F.col(c), every, ntz)
            got = df.select(F.col("n"), b.cast("timestamp_ntz").alias("b"), calendar_next(b, every, ntz).cast("timestamp_ntz").alias("e")).collect()
            for r in got:
                assert r.b == _expected(r.n, every)
                assert r.b <= r.n < r.e and _expected(r.e, every) == r.e
        # the bucket of the day the clock goes forward has 23 hours, the other 25
        if every == "1 day":
            b = calendar_bucket(F.col("t"), every, False)
            hours = {str(r.n)[:10]: r.h for r in df.select("n", ((F.unix_timestamp(calendar_next(b, every, False)) - F.unix_timestamp(b)) / 3600).alias("h")).collect()}
            assert hours["2024-03-31"] == 23 and hours["2024-10-27"] == 25 and hours["2024-04-01"] == 24
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_calendar_anchor_and_bad_intervals(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ '2024-05-17 13:00:00' AS t")
    at = lambda every, anchor: df.select(calendar_bucket(F.col("t"), every, True, anchor)).first()[0]
    assert at("10 days", "2024-05-10") == dt.datetime(2024, 5, 10)
    assert at("1 week", "2024-05-01") == dt.datetime(2024, 5, 15)
    assert at("3 months", "2024-02-01") == dt.datetime(2024, 5, 1)
    assert at("7 hours", "2024-05-17") == dt.datetime(2024, 5, 17, 7)
    for bad in ("", "0 days", "1.5 days", "1 fortnight", "day 1", "-1 days", "1 day x"):
        with pytest.raises(ValueError):
            parse_interval(bad)


def test_mirror_delivers_every_bucket_once(spark):
    m = FX.readings(spark)
    times = ["2016-09-01 12:40:00", "2016-09-01 13:00:00", "2016-09-02 00:00:00", "2016-09-02 13:10:00", "2016-09-04 00:00:00"]
    got, last = [], None
    for t in times:
        got += [tuple(r) for r in R.mirror_rollup(m, t, last).collect()]
        last = t
    whole = [tuple(r) for r in R.mirror_rollup(m, times[-1]).collect()]
    assert sorted(got) == sorted(whole) and len(set(got)) == len(got)
    hourly = [r for r in whole if r[0] == "1 hour"]
    assert [(r[1], *r[3:]) for r in hourly] == [tuple(r) for r in R.rollup(m, 1, R.STRICT_60).collect()]
    first = R.mirror_rollup(m, times[0]).collect()
    assert first == []  # no bucket is over


def test_one_json_value(spark):
    good = ['{"a":1}', " [1, 2] ", "5", '"x"', "null", '{"a":[{"b":"],{"}]}', "[]"]
    bad = ['{"a":1},{}] junk', "[],[]] junk", "1,2] junk", "1] x", "1,2", "", " ", "{", '{"a":1} x', '{"a":1}]', '1,"x"] y', "1,0] z", "1,0,0]", '"a']
    df = spark.createDataFrame([(t, True) for t in good] + [(t, False) for t in bad] + [(None, None)], "t string, ok boolean")
    for r in df.select("t", "ok", is_one_json(F.col("t")).alias("got"), whole_json(F.col("t"), "struct<a:string>").alias("v")).collect():
        assert r.got == r.ok or (r.t is None and not r.got), r
        assert r.v is None or r.ok


def test_integer_text(spark):
    df = spark.createDataFrame([("5",), (" -7 ",), ("1.0",), ("1e2",), ("70000",), ("x",), (None,), ("9" * 60,)], "t string")
    assert [r[0] for r in df.select(integer_text(F.col("t"), -32768, 32767).cast("int")).collect()] == [5, -7] + [None] * 6
