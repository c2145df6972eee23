"""Tables whose files have one row group are dealt out by their number of rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fieldsense.plans import catalog as C
from fieldsense.sources import adapters as A

ROWS, LIMIT = 3000, 200


@pytest.fixture(scope="module")
def one_group(tmp_path_factory):
    """A folder with events of one row group, none of whose rows is equal to another."""
    pa, pq = pytest.importorskip("pyarrow"), pytest.importorskip("pyarrow.parquet")
    path, kinds = tmp_path_factory.mktemp("one_group"), ("view", "click", "signup", "error", "purchase")
    day = dt.datetime(2024, 1, 1)
    pq.write_table(pa.table({
        "event_id": pa.array(range(ROWS), pa.int64()),
        "ts": pa.array([day + dt.timedelta(minutes=11 * i) for i in range(ROWS)], pa.timestamp("us")),
        "user_id": pa.array([i % 700 for i in range(ROWS)], pa.int64()),
        "event_type": [kinds[i % 5] for i in range(ROWS)],
        "value": [float(i % 97) for i in range(ROWS)],
        "props": ['{"k": %d}' % (i % 100) for i in range(ROWS)]}), f"{path}/events.parquet", row_group_size=ROWS)
    return str(path)


@pytest.fixture
def many_splits(spark, monkeypatch):
    """More splits than cores, of which one has all the rows, and few rows to a partition."""
    monkeypatch.setattr(A, "SPREAD_ROWS", LIMIT)
    names = {"spark.sql.files.maxPartitionBytes": "1k", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def _largest(df):
    """The most rows that a partition has, and all the rows."""
    return tuple(df.groupBy(F.spark_partition_id()).count().agg(F.max("count"), F.sum("count")).first())


def test_readings_to_aggregate_are_dealt_out(spark, one_group, many_splits):
    assert A.events(spark, one_group).rdd.getNumPartitions() > spark.sparkContext.defaultParallelism
    assert _largest(A.events(spark, one_group)) == (ROWS, ROWS)
    largest, rows = _largest(C._readings(spark, one_group))
    assert rows == ROWS and largest <= 1.5 * LIMIT


def test_calendar_rollups_share_one_dealt_out_scan(spark, one_group, many_splits):
    out = C.rollup_calendar(spark, one_group)
    got = out.collect()   # run it: final adaptive plan
    plan = out._jdf.queryExecution().executedPlan().toString().partition("== Initial Plan ==")[0]
    assert plan.count("RoundRobinPartitioning") >= 1 and plan.count("ReusedExchange") == 3
    want = {tuple(r) for r in C.R.rollup(A.measurements(spark, one_group), bounds=A.EVENTS_BOUNDS, every="1 week").collect()}
    assert {tuple(r)[1:] for r in got if r.every == "1 week"} == want and want


def test_observations_are_dealt_out_before_their_json_is_read(spark, one_group, many_splits):
    valid, rejected = C.state_valid(spark, one_group), C.state_rejected(spark, one_group)
    assert valid.rdd.getNumPartitions() >= ROWS // LIMIT
    # rejected rows are few: what a task reads is what the partitions of all observations hold
    largest, rows = _largest(A.raw_observations(spark, one_group))
    assert rows == ROWS and largest <= 1.5 * LIMIT
    assert valid.count() + rejected.count() == ROWS and rejected.count() > 0


@pytest.mark.parametrize("name", ["raw_batches", "raw_inserts"])
def test_partitions_grow_with_the_rows(spark, one_group, many_splits, monkeypatch, name):
    dealt = []
    monkeypatch.setattr(A, "_spread", lambda df, spread=A._spread: dealt.append(spread(df)) or dealt[-1])
    getattr(A, name)(spark, one_group)
    few = dealt[-1].rdd.getNumPartitions()
    monkeypatch.setattr(A, "SPREAD_ROWS", LIMIT // 4)
    getattr(A, name)(spark, one_group)
    assert few >= ROWS // LIMIT and dealt[-1].rdd.getNumPartitions() == -(-ROWS // (LIMIT // 4)) > few


def test_runs_and_envelope_are_dealt_out(spark, one_group, many_splits, monkeypatch):
    kept = []
    monkeypatch.setattr(C.ST, "cut_lineage", lambda df, cut=C.ST.cut_lineage: kept.append(_largest(df)) or cut(df))
    runs, envelope = C.state_runs_chunked(spark, one_group), C.sync_envelope(spark, one_group)
    assert len(kept) == 2 and all(largest <= 3 * LIMIT < rows for largest, rows in kept)   # with copies of restarts
    assert runs.agg(F.sum("n_obs")).first()[0] == C.state_valid(spark, one_group).count()
    assert envelope.groupBy("source").count().count() == 2
