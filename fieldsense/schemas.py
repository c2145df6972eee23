"""Explicit schemas, enum sets and preset bounds of the telemetry tables.

Readers and decoders of telemetry take one of these ``StructType`` objects; only
the supplied test tables (``sources.adapters``) come with the schema of their files.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# These must equal the behaviour being reproduced.
#   reading types accepted at ingest:          t, h
#   state segments (enum):                     gpio, connectivity, cloud, app
#   job types (enum):                          irrigation_on, irrigation_off
#   restart observation:                       segment app, data {"value": "restart"}
#   gpio default user id when absent or null:  userId = 0
#   sync destination key used today:           cloud
#   default sync batch size:                   500 rows
#   outlier bounds, strict, t upper 70:        t (-10, 70), h (-1, 101), other (-99999, 99999)
#   outlier bounds, strict, t upper 60:        t (-10, 60), h (-1, 101), other (-99999, 99999)
#   legacy trailing bounds, closed:            t [-20, 80], h [-1, 2000], other types skipped
# ---------------------------------------------------------------------------
READING_TYPES = ("t", "h")
SEGMENTS = ("gpio", "connectivity", "cloud", "app")
JOB_TYPES = ("irrigation_on", "irrigation_off")
RESTART_SEGMENT = "app"
RESTART_VALUE = "restart"
GPIO_SEGMENT = "gpio"
GPIO_USER_KEY = "userId"
GPIO_DEFAULT_USER = 0
CLOUD = "cloud"
DEFAULT_SYNC_LIMIT = 500
# intervals of the rollups that are mirrored unless others are asked for
MIRROR_INTERVALS = ("1 hour", "1 day")
OTHER_TYPE_BOUNDS = (-99999.0, 99999.0)
STRICT_70 = {"t": (-10.0, 70.0), "h": (-1.0, 101.0)}
STRICT_60 = {"t": (-10.0, 60.0), "h": (-1.0, 101.0)}
LEGACY_CLOSED = {"t": (-20.0, 80.0), "h": (-1.0, 2000.0)}

SYNC_MAP = T.MapType(T.StringType(), T.BooleanType(), valueContainsNull=True)

# one sensor reading per row (current layout)
MEASUREMENTS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("mac", T.StringType(), False),
    T.StructField("sid", T.ShortType(), False),
    T.StructField("type", T.StringType(), False),
    T.StructField("description", T.StringType(), True),
    T.StructField("val", T.FloatType(), True),
    T.StructField("ts", T.TimestampType(), False),
    T.StructField("battery", T.ShortType(), True),
    T.StructField("agg", T.BooleanType(), True),
    T.StructField("sync", SYNC_MAP, True),
])

# first layout: boolean sync flag, "agg" flag still present
MEASUREMENTS_V1 = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("mac", T.StringType(), False),
    T.StructField("sid", T.ShortType(), False),
    T.StructField("type", T.StringType(), False),
    T.StructField("description", T.StringType(), True),
    T.StructField("val", T.FloatType(), True),
    T.StructField("ts", T.TimestampType(), False),
    T.StructField("battery", T.ShortType(), True),
    T.StructField("agg", T.BooleanType(), True),
    T.StructField("sync", T.BooleanType(), True),
])

# one row per aggregation run and series (legacy aggregate table)
AGGREGATES = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("mac", T.StringType(), False),
    T.StructField("sid", T.ShortType(), False),
    T.StructField("type", T.StringType(), False),
    T.StructField("description", T.StringType(), True),
    T.StructField("avg", T.FloatType(), True),
    T.StructField("stddev", T.FloatType(), True),
    T.StructField("n", T.LongType(), True),
    T.StructField("ts", T.TimestampType(), True),
    T.StructField("battery", T.ShortType(), True),
    T.StructField("sync", T.BooleanType(), True),
])

# one state observation (input of the run collapse)
OBSERVATIONS = T.StructType([
    T.StructField("device_id", T.StringType(), True),
    T.StructField("id", T.LongType(), False),
    T.StructField("segment", T.StringType(), True),
    T.StructField("data", T.StringType(), True),
    T.StructField("ts", T.TimestampType(), False),
])

# one row per run of an unchanged state
RUNS = T.StructType([
    T.StructField("device_id", T.StringType(), True),
    T.StructField("id", T.LongType(), False),
    T.StructField("segment", T.StringType(), True),
    T.StructField("data", T.StringType(), True),
    T.StructField("ts_start", T.TimestampType(), False),
    T.StructField("ts_end", T.TimestampType(), False),
    T.StructField("epoch", T.LongType(), True),
    T.StructField("n_obs", T.LongType(), False),
    T.StructField("sync", SYNC_MAP, True),
])

# delayed jobs
QUEUE = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("job_type", T.StringType(), False),
    T.StructField("data", T.StringType(), True),
    T.StructField("ts_created", T.TimestampType(), False),
    T.StructField("delay", T.IntegerType(), True),
    T.StructField("ts_executed", T.TimestampType(), True),
    T.StructField("sync", SYNC_MAP, True),
])

# raw ingest batch as it arrives: leaves are read as text, so that bad values
# can be told apart from absent ones (from_json would silently NULL them), or
# as VARIANT where only a JSON string will do
RAW_ITEM = T.StructType([
    T.StructField("sid", T.StringType(), True),
    T.StructField("value", T.StringType(), True),
    T.StructField("type", T.StringType(), True),
    T.StructField("desc", T.VariantType(), True),
    T.StructField("battery", T.StringType(), True),
])
RAW_BATCH = T.StructType([
    T.StructField("mac", T.VariantType(), True),
    T.StructField("battery", T.StringType(), True),
    T.StructField("data", T.ArrayType(RAW_ITEM), True),
])

# raw queue insert
RAW_JOB = T.StructType([
    T.StructField("job_type", T.StringType(), True),
    T.StructField("delay", T.StringType(), True),
    T.StructField("data", T.StringType(), True),
])
