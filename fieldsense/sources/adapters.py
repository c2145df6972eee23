"""Derive the engine's tables from the supplied test tables.

There are no sensor tables in the supplied data, so ``events`` and ``orders``
are mapped onto the telemetry schemas with plain column expressions. Every
derivation has a twin in ``fieldsense.plans.oracle`` written in DuckDB SQL.
All scans read only the columns they need.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import day_start, empty_flags, hours, minutes, ts_literal
from ..operators.readings import Bounds

# as-of instants of the test mapping (never the wall clock)
EVENTS_AS_OF = "2024-01-31 00:00:00"
QUEUE_AS_OF = "1998-01-01 00:00:00"
SYNC_CUTOFF = "2024-01-15 00:00:00"
MIRROR_AS_OF = "2024-01-17 09:30:00"

# bounds of the test mapping: reading type = event type
EVENTS_BOUNDS = Bounds({"view": (1.0, 60.0), "click": (2.0, 101.0)}, other=(-99999.0, 99999.0))
EVENTS_BOUNDS_70 = Bounds({"view": (1.0, 70.0), "click": (2.0, 101.0)}, other=(-99999.0, 99999.0))
EVENTS_START = "2024-01-01 00:00:00"
EVENTS_END = "2024-01-30 00:00:00"
EVENTS_LEGACY = Bounds({"view": (1.0, 60.0), "click": (2.0, 101.0)}, other=None, closed=True)

MERGE_AT = 5_000  # observations of smaller ids are stored before the others come
# one in so many batches, observations, jobs and inserts is spoilt in each of the ways below
SPOILT_BATCHES, SPOILT_OBSERVATIONS, SPOILT_JOBS, SPOILT_INSERTS = 40, 29, 31, 37
BATCH_SPAN = 64  # consecutive event ids that may share one ingest batch
SPREAD_ROWS = 1 << 18  # rows of a partition that a table is dealt out to


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet")


def _spread(df: DataFrame) -> DataFrame:
    """For derivations with heavy work per row, and for aggregates that have
    nearly a group for each row. A file may have a single row group, which one
    task reads whatever the number of its splits, so the rows are always dealt
    out: to the cores, and to more partitions as the table grows, of about
    ``SPREAD_ROWS`` rows each. The count reads the files' footers only."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, -(-df.count() // SPREAD_ROWS)))


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def measurements(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """events -> current measurements layout; ``spread`` deals the rows out, for
    aggregates by time and series. Filters still reach the scan."""
    ev = events(spark, sf_dir)
    if spread:
        ev = _spread(ev)
    k = _k()
    cloud = (F.when(F.col("event_id") % 3 == 0, F.create_map(F.lit("cloud"), F.lit(True)))
             .when(F.col("event_id") % 3 == 1, F.create_map(F.lit("cloud"), F.lit(False)))
             .otherwise(empty_flags()))
    return ev.select(
        F.col("event_id").alias("id"),
        F.col("user_id").cast("string").alias("mac"),
        (k % 4).cast("smallint").alias("sid"),
        F.col("event_type").alias("type"),
        F.when(k % 10 == 0, F.lit(None).cast("string")).otherwise(F.lit("d")).alias("description"),
        F.col("value").cast("float").alias("val"),
        F.col("ts"),
        k.cast("smallint").alias("battery"),
        (F.col("event_id") % 5 == 0).alias("agg"),
        cloud.cast("map<string,boolean>").alias("sync"),
    )


def acknowledged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acknowledgements of two ticks, in the layout of ``operators.acks``: the
    first takes all views and purchases up to the cutoff, the second, later one
    takes back every purchase (twin: ``plans.oracle.ACKED``)."""
    m = measurements(spark, sf_dir)
    first = m.where(F.col("type").isin("view", "purchase") & (F.col("ts") < ts_literal(SYNC_CUTOFF, True)))
    back = m.where(F.col("type") == "purchase")
    both = first.select("id", "ts", F.lit(True).alias("value"), F.lit(1).cast("bigint").alias("tick")) \
        .unionByName(back.select("id", "ts", F.lit(False).alias("value"), F.lit(2).cast("bigint").alias("tick")))
    return both.select(F.lit("measurements").alias("source"), "id", F.to_date("ts").alias("day"), F.lit(None).cast("string").alias("version"),
                       F.lit("cloud").alias("dest"), "value", "tick")


def measurements_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows in the first layout (boolean sync, agg present)."""
    m = measurements(spark, sf_dir)
    return m.withColumn("sync", F.col("sync").getItem("cloud"))


def aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legacy aggregate table as daily runs would have filled it: one row per
    day and (mac, sid, type, description) over the legacy bounds; id = first
    reading id of the group; runs up to the cutoff have been shipped."""
    m = measurements(spark, sf_dir, spread=True)
    ntz = True
    day = day_start(F.col("ts"), ntz)
    rows = m.where(EVENTS_LEGACY.predicate(F.col("val"), F.col("type")))
    g = (rows.groupBy(day.alias("day"), "mac", "sid", "type", "description")
         .agg(F.min("id").alias("id"),
              F.avg("val").cast("float").alias("avg"),
              F.stddev_pop("val").cast("float").alias("stddev"),
              F.count("val").alias("n"),
              F.round(F.avg("battery")).cast("smallint").alias("battery")))
    ts = F.col("day") + hours(24)
    return g.select("id", "mac", "sid", "type", "description", "avg", "stddev", "n",
                    ts.alias("ts"), "battery",
                    (ts <= ts_literal(SYNC_CUTOFF, ntz)).alias("sync"))


def _reading_type() -> Column:
    et = F.col("event_type")
    return (F.when(et.isin("view", "purchase"), F.lit("t"))
            .when(et.isin("click", "signup"), F.lit("h"))
            .otherwise(et))


def raw_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ingest requests: the readings of one device within a span of
    ``BATCH_SPAN`` consecutive event ids form one batch (bounded size).
    ``error`` events keep their own type and so reject their batch. Some
    batches, by user and span, are spoilt in one of twelve ways, so that every
    reason for a reject occurs (twin: ``plans.oracle.BATCHES``)."""
    ev = _spread(events(spark, sf_dir))
    k = _k()
    item = F.struct(
        F.col("event_id").alias("_order"),
        (k % 4).alias("sid"),
        F.col("value").alias("value"),
        _reading_type().alias("type"),
        F.when(k % 10 == 0, F.lit(None).cast("string")).otherwise(F.lit("d")).alias("desc"),
        k.alias("battery"),
    )
    batch_id = F.concat_ws("-", F.col("user_id").cast("string"),
                          F.floor(F.col("event_id") / BATCH_SPAN).cast("string"))
    grouped = (ev.groupBy(batch_id.alias("batch_id"), F.col("user_id"))
               .agg(F.array_sort(F.collect_list(item)).alias("items")))
    data = F.transform("items", lambda x: x.dropFields("_order"))
    raw = F.to_json(F.struct(F.col("user_id").cast("string").alias("mac"), data.alias("data")))
    kind = (F.col("user_id") + F.element_at(F.split("batch_id", "-"), -1).cast("bigint")) % SPOILT_BATCHES
    r = F.col("raw")
    spoilt = {0: F.concat(r, F.lit(",{}] xyz")), 1: F.concat(r, F.lit(","), r), 2: F.concat(F.lit("["), r, F.lit("]")),
              3: F.regexp_replace(r, r'"mac":"(\d+)"', '"mac":{"x":$1}'), 4: F.regexp_replace(r, r'"mac":"(\d+)"', '"mac":$1'),
              5: F.regexp_replace(r, r'"mac":"\d+"', '"mac":""'), 6: F.regexp_replace(r, r'^\{', '{"battery":"5d",'),
              7: F.regexp_replace(r, r'"data":\[.*\]', '"data":[]'), 8: F.regexp_replace(r, r'"sid":\d+', '"sid":"1f"'),
              9: F.regexp_replace(r, r'"value":[-+0-9.E]+', '"value":"0x1p3"'),
              10: F.regexp_replace(r, r'"value":[-+0-9.E]+', '"value":1e300'), 11: F.replace(r, F.lit('"desc":"d"'), F.lit('"desc":{"a":1}'))}
    return _spoil(grouped.select("batch_id", raw.alias("raw"), kind.alias("_kind")), spoilt)


def _spoil(df, ways: dict):
    """``raw`` changed as ``ways`` says for the row's ``_kind``."""
    out = F.col("raw")
    for k, changed in ways.items():
        out = F.when(F.col("_kind") == k, changed).otherwise(out)
    return df.withColumn("raw", out).drop("_kind")


def raw_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State observations: signup = app restart; error events with k >= 95 get
    an unknown segment and with 90 <= k < 95 an empty data object (rejects);
    the rest go to gpio / connectivity / cloud by k % 3. By id, some data
    have text after the document, an exponent, or a repeated key."""
    ev = _spread(events(spark, sf_dir))
    k = _k()
    bit = (k % 2).cast("string")
    is_err = F.col("event_type") == "error"
    by_k = (F.when(k % 3 == 0, F.lit("gpio")).when(k % 3 == 1, F.lit("connectivity"))
            .otherwise(F.lit("cloud")))
    segment = (F.when(F.col("event_type") == "signup", F.lit("app"))
               .when(is_err & (k >= 95), F.lit("x"))
               .otherwise(by_k))
    data = (F.when(F.col("event_type") == "signup", F.lit('{"value": "restart"}'))
            .when(is_err & (k >= 90) & (k < 95), F.lit("{}"))
            .when(by_k == "gpio", F.concat(F.lit('{"pin": 7, "value": '), bit, F.lit("}")))
            .otherwise(F.concat(F.lit('{"value": '), bit, F.lit("}"))))
    kind = F.col("event_id") % SPOILT_OBSERVATIONS
    data = (F.when(kind == 0, F.concat(data, F.lit(",2] tail")))
            .when(kind == 1, F.regexp_replace(data, r'"value": ([01])\}', '"value": $1e0}'))
            .when(kind == 2, F.regexp_replace(data, r'^\{', '{"value": 9, ')).otherwise(data))
    return ev.select(F.col("user_id").cast("string").alias("device_id"),
                     F.col("event_id").alias("id"), segment.alias("segment"),
                     data.alias("data"), F.col("ts"))


def _job_type(priority: Column) -> Column:
    return F.when(priority.isin("1-URGENT", "2-HIGH", "3-MEDIUM"), F.lit("irrigation_on")) \
        .otherwise(F.lit("irrigation_off"))


def queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders -> job queue: delay = customer key minutes (NULL when the
    priority is not specified); open orders are still pending, the others ran
    at their due time."""
    o = orders(spark, sf_dir)
    delay = F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.lit(None).cast("int")) \
        .otherwise(F.col("o_custkey").cast("int"))
    due = F.col("o_orderdate") + minutes(F.coalesce(delay, F.lit(0)))
    executed = F.when(F.col("o_orderstatus") == "O", F.lit(None).cast("timestamp_ntz")).otherwise(due)
    return o.select(F.col("o_orderkey").alias("id"), _job_type(F.col("o_orderpriority")).alias("job_type"),
                    F.lit("{}").alias("data"), F.col("o_orderdate").alias("ts_created"),
                    delay.alias("delay"), executed.alias("ts_executed"),
                    empty_flags().alias("sync"))


def raw_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queue insert requests: job_type missing for unspecified priority and
    unknown ('irrigation_pause') for low-priority pending orders; no delay for
    finished orders. By key, some have text after the document, two documents,
    or a delay that an integer column refuses."""
    o = _spread(orders(spark, sf_dir))
    p, s = F.col("o_orderpriority"), F.col("o_orderstatus")
    jt = (F.when(p == "4-NOT SPECIFIED", F.lit(None).cast("string"))
          .when((s == "P") & (p == "5-LOW"), F.lit("irrigation_pause"))
          .otherwise(_job_type(p)))
    delay = F.when(s == "F", F.lit(None).cast("long")).otherwise(F.col("o_custkey"))
    raw = F.to_json(F.struct(jt.alias("job_type"), delay.alias("delay")))
    r = F.col("raw")
    return _spoil(o.select(F.col("o_orderkey").alias("id"), raw.alias("raw"), (F.col("o_orderkey") % SPOILT_JOBS).alias("_kind")),
                  {0: F.concat(r, F.lit(",{}] x")), 1: F.regexp_replace(r, r'"delay":(\d+)', '"delay":$1.0'), 2: F.concat(r, F.lit(","), r)})


def raw_inserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direct insert documents, one per event: the table's own keys plus
    ignored extra ones; signup events come as a one-element array, error
    events lack ``sid`` (a NOT NULL column, so their document is refused).
    By id, some documents are followed by text or by another document, or have
    a value of the wrong kind."""
    ev = _spread(events(spark, sf_dir))
    k = _k()
    obj = F.struct(
        F.col("user_id").cast("string").alias("mac"),
        F.when(F.col("event_type") != "error", k % 4).alias("sid"),
        F.col("event_type").alias("type"),
        F.when(k % 10 == 0, F.lit(None).cast("string")).otherwise(F.lit("d")).alias("description"),
        F.col("value").alias("val"),
        k.alias("battery"),
        F.col("value").alias("value"),
        F.lit("extra").alias("desc"),
    )
    doc = F.when(F.col("event_type") == "signup", F.to_json(F.array(obj))).otherwise(F.to_json(obj))
    r = F.col("raw")
    return _spoil(ev.select(F.col("event_id").alias("req"), doc.alias("raw"), (F.col("event_id") % SPOILT_INSERTS).alias("_kind")),
                  {0: F.concat(r, F.lit(",[]] tail")), 1: F.concat(r, F.lit(","), r), 2: F.concat(r, F.lit(" ]garbage")),
                   3: F.regexp_replace(r, r'"mac":"(\d+)"', '"mac":$1'), 4: F.regexp_replace(r, r'"val":[-+0-9.E]+', '"val":"10d"'),
                   5: F.regexp_replace(r, r'"val":[-+0-9.E]+', '"val":1e300'), 6: F.regexp_replace(r, r'"battery":(\d+)', '"battery":$1.0')})
