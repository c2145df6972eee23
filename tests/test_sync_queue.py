import datetime as dt

import pytest
from pyspark.sql import functions as F

from fieldsense.functions import ts_literal
from fieldsense.operators import queue as QU
from fieldsense.operators import sync as SY
from fieldsense.streaming.sync import literal_text

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i, "m", T0 + dt.timedelta(minutes=i), flags) for i, flags in
            [(1, {"cloud": True}), (2, {"cloud": False}), (3, {}), (4, None), (5, {"cloud": True, "other": False}),
             (6, {"other": True})]]
    return spark.createDataFrame(rows, "id long, mac string, ts timestamp_ntz, sync map<string,boolean>")


def test_pending(table):
    assert [r.id for r in SY.pending(table).collect()] == [2, 3, 4, 6]
    assert [r.id for r in SY.pending(table, limit=2).collect()] == [2, 3]
    assert [r.id for r in SY.pending(table, dest="other").collect()] == [1, 2, 3, 4, 5]


def test_pending_boolean_flag(spark):
    df = spark.createDataFrame([(1, True), (2, False), (3, None)], "id long, sync boolean")
    assert [r.id for r in SY.pending(df).collect()] == [2]


def test_mark_synced_and_unknown_ids(table, spark):
    acked = spark.createDataFrame([(2,), (3,), (99,), (3,)], "id long")
    out = {r.id: r.sync for r in SY.mark_synced(table, acked).collect()}
    assert out[2] == {"cloud": True} and out[3] == {"cloud": True}
    assert out[1] == {"cloud": True} and out[4] is None and out[6] == {"other": True}
    assert len(out) == 6


def test_mark_synced_with_version(table, spark):
    acked = spark.createDataFrame([(2, T0 + dt.timedelta(minutes=2)), (3, T0)], "id long, ts timestamp_ntz")
    out = {r.id: r.sync for r in SY.mark_synced(table, acked, version_col="ts").collect()}
    assert out[2] == {"cloud": True} and out[3] == {}


def test_reset_sync(table):
    out = {r.id: r.sync for r in SY.reset_sync(table).collect()}
    assert out[1] == {"cloud": False} and out[4] == {"cloud": False}
    assert out[5] == {"other": False, "cloud": False}


def test_envelope(table, spark):
    state = spark.createDataFrame([(7, "gpio", '{"value":1}', T0, T0)],
                                  "id long, segment string, data string, ts_start timestamp_ntz, ts_end timestamp_ntz")
    env = SY.sync_envelope(SY.pending(table, columns=["id", "mac", "ts"]), state)
    rows = {(r.source, r.id): r.payload for r in env.collect()}
    assert rows[("logState", 7)] == ('{"id":7,"segment":"gpio","data":{"value":1},'
                                     '"ts_start":"2024-01-01T00:00:00.000000","ts_end":"2024-01-01T00:00:00.000000"}')
    assert len(rows) == 5
    doc = SY.envelope_document(env).collect()
    assert len(doc) == 1 and doc[0].document.startswith('{"measurements":[{"id":2,')
    empty = SY.sync_envelope(table.where("false").select("id", "mac", "ts"), state.where("false"))
    assert empty.isEmpty() and SY.envelope_document(empty).count() == 0


@pytest.fixture(scope="module")
def jobs(spark):
    rows = [(1, "irrigation_on", T0, 30, None), (2, "irrigation_off", T0, 5, None),
            (3, "irrigation_on", T0, None, None), (4, "irrigation_on", T0, 1, T0)]
    return spark.createDataFrame(rows, "id long, job_type string, ts_created timestamp_ntz, delay int, ts_executed timestamp_ntz")


def test_queue_pending(jobs):
    rows = QU.queue_pending(jobs, "2024-01-01 00:10:00").collect()
    assert [(r.id, r.time_to_finish) for r in rows] == [(1, 20), (2, -5), (3, None)]


def test_minutes_round_half_even(spark):
    df = spark.createDataFrame([(1, T0, 1)], "id long, ts_created timestamp_ntz, delay int")
    f = lambda s: QU.with_time_to_finish(df, s).collect()[0].time_to_finish
    assert f("2024-01-01 00:00:30") == 0      # 0.5 -> 0
    assert f("2023-12-31 23:59:30") == 2      # 1.5 -> 2


def test_queue_decode(spark):
    raw = spark.createDataFrame([(1, '{"job_type": "irrigation_on", "delay": 3}'), (2, '{"job_type": "x"}'),
                                 (3, '{"delay": 3}'), (4, '{"job_type": "irrigation_off"}'),
                                 (5, '{"job_type": "irrigation_off", "delay": 1.5}'), (6, "nope")],
                                "id long, raw string")
    rows, rej = QU.queue_decode(raw, "2024-01-01 00:00:00")
    assert {r.id: (r.job_type, r.delay) for r in rows.collect()} == {1: ("irrigation_on", 3), 4: ("irrigation_off", None)}
    assert {r.id: r.reason for r in rej.collect()} == {2: "job_type", 3: "job_type", 5: "delay", 6: "json"}


def test_queue_complete(jobs, spark):
    ids = spark.createDataFrame([(1,), (4,)], "id long")
    out = {r.id: r.ts_executed for r in QU.queue_complete(jobs, ids, "2024-01-02 00:00:00").collect()}
    assert out[1] == dt.datetime(2024, 1, 2) and out[4] == dt.datetime(2024, 1, 2) and out[2] is None
    unknown = spark.createDataFrame([(42,), (None,)], "id long")
    with pytest.raises(Exception, match="no job with id 42"):
        QU.queue_complete(jobs, unknown, "2024-01-02 00:00:00").collect()
    assert QU.queue_complete(jobs, unknown, "2024-01-02 00:00:00", strict=False).count() == 4


def test_mark_synced_days(spark, tmp_path):
    from pyspark.sql import functions as F

    from fieldsense.session import cut_lineage
    from fieldsense.sources import fixtures as FX
    from fieldsense.sources.tables import overwrite_partitions
    path = str(tmp_path / "m")
    FX.readings(spark).withColumn("day", F.to_date("ts")).write.partitionBy("day").parquet(path)
    stored = spark.read.parquet(path)
    envelope = SY.pending(stored, limit=3, columns=["id", "ts"])
    changed = SY.mark_synced_days(stored, envelope)
    assert {r.day for r in changed.select("day").distinct().collect()} == {dt.date(2016, 9, 1)}
    overwrite_partitions(cut_lineage(changed), path, ["day"])
    after = {r.id: r.sync for r in spark.read.parquet(path).collect()}
    assert len(after) == 54
    assert [i for i, m in sorted(after.items()) if m.get("cloud")] == [1, 2, 3]


def test_pending_from_day(spark, tmp_path):
    from pyspark.sql import functions as F

    from fieldsense.sources import fixtures as FX
    path = str(tmp_path / "p")
    rows = FX.readings(spark).withColumn("sync", F.when(F.col("id") <= 30, F.create_map(F.lit("cloud"), F.lit(True)))
                                         .otherwise(F.col("sync")))
    rows.withColumn("day", F.to_date("ts")).write.partitionBy("day").parquet(path)
    t = spark.read.parquet(path)
    day = SY.oldest_pending_day(t)
    assert day == dt.date(2016, 9, 2)
    full = [r.id for r in SY.pending(t, limit=5).collect()]
    pruned = SY.pending(t, limit=5, from_day=day)
    assert [r.id for r in pruned.collect()] == full == [31, 32, 33, 34, 35]


def test_envelope_document_is_bounded(table):
    env = SY.sync_envelope(SY.pending(table, columns=["id", "mac", "ts"]), SY.pending(table, columns=["id", "mac", "ts"]), ())
    assert SY.envelope_document(env, 8).count() == 1
    with pytest.raises(Exception, match="more than 7 rows"):
        SY.envelope_document(env, 7).collect()


def test_pending_keeps_rows_of_no_day(spark):
    df = spark.createDataFrame([(1, None, {}), (2, dt.date(2024, 1, 5), {}), (3, dt.date(2024, 1, 1), {"cloud": True})],
                               "id long, day date, sync map<string,boolean>")
    assert [r.id for r in SY.pending(df, from_day="2024-01-05").collect()] == [1, 2]


def test_reply(table, spark):
    reply = spark.createDataFrame([("measurements", '[{"id": 2}, {"id": 99}]'), ("logState", '{"id": 4} tail')], "source string, reply string")
    done = SY.apply_reply(200, reply, {"measurements": table, "logState": table})
    assert {r.id for r in done["measurements"].collect() if (r.sync or {}).get("cloud")} == {1, 2, 5}
    assert {r.id for r in done["logState"].collect() if (r.sync or {}).get("cloud")} == {1, 5}
    for status in (0, 404, 500):
        same = SY.apply_reply(status, reply, {"measurements": table})["measurements"]
        assert {r.id: r.sync for r in same.collect()} == {r.id: r.sync for r in table.collect()}


def test_ingest_to_pending_to_ack(spark):
    from fieldsense.operators import ingest as IN
    from fieldsense.sources import fixtures as FX
    rows = IN.reshape_batches(IN.validate_batches(FX.ingest_batches(spark))[0], "2024-01-31 00:00:00")
    first = SY.pending(rows, limit=4, columns=SY.MEASUREMENT_COLUMNS).collect()
    assert len({r.id for r in first}) == 4 and first == SY.pending(rows, limit=4, columns=SY.MEASUREMENT_COLUMNS).collect()
    after = SY.mark_synced(rows, spark.createDataFrame([(r.id,) for r in first], "id long"))
    left = SY.pending(after, limit=None, columns=SY.MEASUREMENT_COLUMNS).collect()
    assert len(left) == 6 and not {r.id for r in first} & {r.id for r in left}


def test_tick_time_in_a_repeated_hour(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Lisbon")
    try:
        first = 1_729_989_000  # 00:30 UTC on 27 October 2024, 01:30 in summer time; an hour later it is 01:30 again
        for second in (first, first + 3600):
            text = spark.range(1).select(literal_text(F.timestamp_seconds(F.lit(second)), False)).first()[0]
            assert text.startswith("2024-10-27 01:30:00")
            assert spark.range(1).select(F.unix_timestamp(ts_literal(text, False))).first()[0] == second
            plain = spark.range(1).select(literal_text(F.timestamp_seconds(F.lit(second)), True)).first()[0]
            assert plain == "2024-10-27 01:30:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
