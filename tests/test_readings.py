import datetime as dt

import pytest
from pyspark.sql import functions as F

from fieldsense.operators import readings as R
from fieldsense.sources import fixtures as FX

START, END = "2016-01-01 00:00:00", "2016-12-31 00:00:00"
SERIES_ORDER = ["aa:bb_1_t", "aa:bb_1_h", "aa:bb_2_t", "aa:bb_2_h", "aa:cc_1_t", "aa:cc_2_t"]


@pytest.fixture(scope="module")
def readings(spark):
    return FX.readings(spark).cache()


def test_fixture_shape(readings):
    assert readings.count() == 54


def test_strict_70(readings):
    out = R.filter_readings(readings, R.STRICT_70, START, END)
    rows = out.collect()
    assert len(rows) == 49
    assert [r.ts for r in rows] == sorted(r.ts for r in rows)
    assert 65.0 in [r.val for r in rows]


def test_strict_60(readings):
    assert R.filter_readings(readings, R.STRICT_60, START, END).count() == 48


def test_null_values_drop_out(spark):
    df = spark.createDataFrame([(1, "t", None, dt.datetime(2016, 9, 1))], "id long, type string, val float, ts timestamp_ntz")
    assert R.filter_readings(df, R.STRICT_70).count() == 0


def test_time_range_end_is_midnight(readings):
    out = R.filter_readings(readings, R.STRICT_70, "2016-09-01 00:00:00", "2016-09-02 00:00:00")
    assert out.count() == 24


def test_rollup_1h(readings):
    rows = R.rollup(readings, 1, R.STRICT_60, START, END).collect()
    assert len(rows) == 24
    assert {r.val_count for r in rows} == {2}
    assert {r.val_stddev for r in rows} == {0.5}


def test_rollup_12h(readings):
    rows = R.rollup(readings, 12, R.STRICT_60, START, END).collect()
    assert len(rows) == 12
    assert {r.val_count for r in rows} == {4}
    assert {r.val_stddev for r in rows} == {1.12}
    by = {(r.time, f"{r.mac}_{r.sid}_{r.type}"): r.val_avg for r in rows}
    day1 = [by[(dt.datetime(2016, 9, 1, 12), k)] for k in SERIES_ORDER]
    day2 = [by[(dt.datetime(2016, 9, 2, 12), k)] for k in SERIES_ORDER]
    assert day1 == [21.5, 71.6, 21.7, 71.8, 21.9, 22.0]
    assert day2 == [pytest.approx(v + 4.0) for v in day1]


def test_rollup_nested(readings):
    r = R.rollup(readings, 12, R.STRICT_60, START, END, sort=False)
    rows = R.rollup_nested(r, parts=1).collect()
    assert len(rows) == 2
    assert {r.n_series for r in rows} == {6}
    import json
    doc = json.loads(rows[0].readings_json)
    assert [d["key"] for d in doc] == sorted(SERIES_ORDER)
    assert doc[0] == {"key": "aa:bb_1_h", "val_avg": 71.6, "val_stddev": 1.12, "val_count": 4}


def test_rollup_nested_parts_keep_every_series(readings):
    r = R.rollup(readings, 12, R.STRICT_60, START, END, sort=False)
    rows = R.rollup_nested(r, parts=4, as_json=False).collect()
    assert sum(len(x.readings) for x in rows) == 12
    rows = R.rollup_nested(r).collect()
    assert sum(x.n_series for x in rows) == 12 and len({(x.time, x.part) for x in rows}) == len(rows)


def test_rollup_series_selection(readings, spark):
    series = spark.createDataFrame([("aa:bb", 1, "t")], "mac string, sid short, type string")
    rows = R.rollup(readings, 12, R.STRICT_60, START, END, series=series).collect()
    assert len(rows) == 2 and {r.mac for r in rows} == {"aa:bb"}
    rows = R.rollup(readings, 24, R.STRICT_60, START, END, types=["h"]).collect()
    assert len(rows) == 4


def test_bucket_not_dividing_day(spark):
    df = spark.createDataFrame([(1, "t", 1.0, dt.datetime(2016, 9, 1, 22, 30))],
                               "id long, type string, val float, ts timestamp_ntz")
    row = R.rollup(df, 5, R.STRICT_60, keys=("type",)).collect()[0]
    assert row.time == dt.datetime(2016, 9, 1, 20)


EXPECTED_CLOSED = {
    "aa:bb_1_t": (19.6667, 11.0554, 9), "aa:bb_1_h": (73.6, 2.2913, 8),
    "aa:bb_2_t": (28.2889, 13.1579, 9), "aa:bb_2_h": (77.9333, 11.8887, 9),
    "aa:cc_1_t": (20.1333, 10.8706, 9), "aa:cc_2_t": (30.2222, 17.7312, 9),
}


def test_trailing_aggregate_closed_bounds(readings):
    as_of = "2016-09-03 00:00:00"
    rows = R.trailing_aggregate(readings, as_of, 3 * 24 * 60, R.LEGACY_CLOSED).collect()
    assert sum(r.n for r in rows) == 53
    for r in rows:
        avg, sd, n = EXPECTED_CLOSED[f"{r.mac}_{r.sid}_{r.type}"]
        assert r.avg == pytest.approx(avg, abs=1e-4)
        assert r.stddev == pytest.approx(sd, abs=1e-4)
        assert r.n == n
        assert r.ts == dt.datetime(2016, 9, 3) and r.sync is False


def test_trailing_window_is_strict_and_skips_used(readings):
    as_of = "2016-09-02 13:50:00"
    rows = R.trailing_aggregate(readings, as_of, 20, R.LEGACY_CLOSED).collect()
    # window (13:30, ...]: two 13:33 readings, three valid at 13:50, two at 13:53 (future rows count)
    assert sum(r.n for r in rows) == 2 + 3 + 2
    used = readings.withColumn("agg", F.lit(True))
    assert R.trailing_aggregate(used, as_of, 20, R.LEGACY_CLOSED).count() == 0


def test_aggregate_and_mark(readings):
    as_of = "2016-09-03 00:00:00"
    agg, marked = R.aggregate_and_mark(readings, as_of, 3 * 24 * 60, R.LEGACY_CLOSED)
    assert marked.where("agg").count() == 53
    # a second run with the marked table consumes nothing
    assert R.trailing_aggregate(marked, as_of, 3 * 24 * 60, R.LEGACY_CLOSED).count() == 0


def test_battery_rounds_half_away(spark):
    df = spark.createDataFrame(
        [(1, "a", 1, "t", None, 1.0, dt.datetime(2016, 9, 1), 49, False),
         (2, "a", 1, "t", None, 2.0, dt.datetime(2016, 9, 1), 50, False)],
        "id long, mac string, sid short, type string, description string, val float, ts timestamp_ntz, battery short, agg boolean")
    row = R.trailing_aggregate(df, "2016-09-01 00:10:00", 60, R.LEGACY_CLOSED).collect()[0]
    assert row.battery == 50


def test_mark_used_days_rewrites_only_window_days(readings, spark, tmp_path):
    from fieldsense.sources.tables import overwrite_partitions
    path = str(tmp_path / "m")
    table = readings.drop("sync").withColumn("day", F.to_date("ts"))
    table.write.partitionBy("day").parquet(path)
    stored = spark.read.parquet(path)
    as_of = "2016-09-02 14:00:00"
    changed = R.mark_used_days(stored, as_of, 60, R.LEGACY_CLOSED)
    assert {r.day for r in changed.select("day").distinct().collect()} == {dt.date(2016, 9, 1), dt.date(2016, 9, 2)}
    want = R.mark_used(stored.drop("day"), as_of, 60, R.LEGACY_CLOSED).where("agg").count()
    from fieldsense.session import cut_lineage
    overwrite_partitions(cut_lineage(changed), path, ["day"])
    after = spark.read.parquet(path)
    assert after.count() == 54
    assert after.where("agg").count() == want > 0
