import datetime as dt
import json
import re

from fieldsense.operators import acks as AK
from fieldsense.operators import sync as SY
from fieldsense.sources import fixtures as FX
from fieldsense.sources.acked import AckedTable
from fieldsense.streaming import acked_tick, answer_tick

D1, D2 = dt.date(2016, 9, 1), dt.date(2016, 9, 2)


def _reply(spark, ids, source="measurements", tail=""):
    return spark.createDataFrame([(source, json.dumps([{"id": i} for i in ids]) + tail)], "source string, reply string")


def _table(spark, tmp_path):
    t = AckedTable(spark, str(tmp_path / "m"), "measurements")
    t.append(FX.readings(spark), 0)
    return t


def _state(spark, tmp_path):
    t = AckedTable(spark, str(tmp_path / "s"), "logState", ts="ts_start", version_col="ts_end")
    t.append(spark.createDataFrame([(1, "gpio", '{"value":1}', FX.T0, FX.T0, {}), (2, "app", '{"value":2}', FX.T0, FX.T0, {})],
                                   "id long, segment string, data string, ts_start timestamp_ntz, ts_end timestamp_ntz, sync map<string,boolean>"), 0)
    return t


def test_message_answer_fold(spark, tmp_path):
    m, s, out = _table(spark, tmp_path), _state(spark, tmp_path), str(tmp_path / "out")
    base = sorted(m.base().inputFiles())
    assert acked_tick(m, s, out, 1, limit=30)
    sent = json.loads(spark.read.text(f"{out}/tick=1").first().value)
    assert [r["id"] for r in sent["measurements"]] == list(range(1, 31)) and len(sent["logState"]) == 2
    assert not answer_tick(_reply(spark, [1]), [m, s], 1, 503)
    # an id that wasn't sent, one twice, and a table that wasn't named
    assert answer_tick(_reply(spark, [*range(1, 28), 2, 50]), [m, s], 1, 200)
    assert sorted(m.base().inputFiles()) == base  # only ids were written
    assert m.acks().count() == 27
    assert [r.id for r in m.pending(columns=["id"]).collect()] == list(range(28, 55))
    plain = SY.mark_synced(m.base(), m.acks().select("id"))
    assert {(r.id, str(r.sync)) for r in m.merged().collect()} == {(r.id, str(r.sync)) for r in plain.collect()}
    # the fold writes only the days that have acknowledgements, and closes the one that is done
    assert m.fold(2) == [D1, D2] and m.closed() == [D1] and m.folded() == 1
    assert m.base().where("sync['cloud']").count() == 27 and m.base().count() == 54
    assert [r.id for r in m.pending(columns=["id"]).collect()] == list(range(28, 55))
    assert m.fold(3) == []


def test_closed_days_are_not_read(spark, tmp_path):
    m, s, out = _table(spark, tmp_path), _state(spark, tmp_path), str(tmp_path / "out")
    assert acked_tick(m, s, out, 1, limit=24)
    answer_tick(_reply(spark, range(1, 25)), [m, s], 1, 200)
    assert m.fold(2) == [D1] and m.closed() == [D1]
    before = m.pending(columns=["id"])
    scan = re.search(r"PartitionFilters: \[(.*)\]", before._jdf.queryExecution().explainString(
        before.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")))
    assert "2016-09-01" in scan.group(1) and "isnull(day" in scan.group(1)
    assert [r.id for r in before.collect()] == list(range(25, 55))
    # a late reading opens its day again
    late = FX.readings(spark).where("id = 1").selectExpr("* EXCEPT (id)", "99L AS id").select(*FX.readings(spark).columns)
    m.append(late, 3)
    assert m.closed() == [] and 99 in {r.id for r in m.pending(columns=["id"]).collect()}


def test_run_extended_after_it_was_sent(spark, tmp_path):
    m, s, out = _table(spark, tmp_path), _state(spark, tmp_path), str(tmp_path / "out")
    acked_tick(m, s, out, 1, limit=10)
    answer_tick(_reply(spark, [1, 2], "logState"), [m, s], 1, 200)
    assert s.pending().count() == 0
    longer = s.base().selectExpr("* EXCEPT (ts_end)", "if(id = 2, ts_end + INTERVAL 1 HOUR, ts_end) AS ts_end")
    left = AK.pending_delta(longer, s.acks(), "logState", version_col="ts_end")
    assert [r.id for r in left.collect()] == [2]
    flags = {r.id: r.sync for r in AK.with_acks(longer, s.acks(), "logState", version_col="ts_end").collect()}
    assert flags == {1: {"cloud": True}, 2: {}}


def test_junk_replies_and_reset(spark, tmp_path):
    m, s, out = _table(spark, tmp_path), _state(spark, tmp_path), str(tmp_path / "out")
    acked_tick(m, s, out, 1, limit=24)
    for tail in (" x", ",[]] junk", ",[]]"):
        answer_tick(_reply(spark, [1], tail=tail), [m, s], 1, 200)
        assert m.acks().count() == 0
    assert not answer_tick(_reply(spark, [1]), [m, s], 7, 200)  # no such message
    answer_tick(_reply(spark, range(1, 25)), [m, s], 1, 200)
    m.fold(2)
    assert m.pending(limit=None).count() == 30
    m.reset(3, 1)
    assert m.closed() == [] and m.pending(limit=None).count() == 54


def test_last_word_counts(spark):
    acks = spark.createDataFrame([("m", 1, None, None, "cloud", True, 1), ("m", 1, None, None, "cloud", False, 2),
                                  ("m", 2, None, None, "cloud", False, 1), ("m", 2, None, None, "cloud", True, 2),
                                  ("m", 3, None, None, "other", True, 1), ("x", 3, None, None, "cloud", True, 1)], AK.ACKS)
    rows = spark.createDataFrame([(1, {"cloud": True}), (2, None), (3, {}), (4, {"cloud": True})], "id long, sync map<string,boolean>")
    assert [r.id for r in AK.pending_delta(rows, acks, "m").collect()] == [1, 3]
    assert [r.id for r in AK.pending_delta(rows, acks, "m", after=2).collect()] == [2, 3]
    marks = spark.createDataFrame([("m", "cloud", D1, 1, False), ("m", "cloud", D1, 2, True), ("m", "cloud", D2, 2, False),
                                   ("x", "cloud", D1, 9, False), ("m", "cloud", dt.date(2020, 1, 1), 1, True),
                                   ("m", "cloud", dt.date(2020, 1, 1), 1, False)], AK.MARKS)
    assert [r.day for r in AK.closed_days(marks, "m").collect()] == [D2]
