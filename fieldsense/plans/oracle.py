"""DuckDB SQL twins of the test-table derivations and of every catalog query.

They run on the pre-registered views (events, orders, ...) and are written
from the stated semantics, not generated from the Spark plans.
"""

from __future__ import annotations

# --- derivations (twins of fieldsense.sources.adapters) --------------------

K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"

MEASUREMENTS = f"""
m AS (
  SELECT event_id AS id,
         CAST(user_id AS VARCHAR) AS mac,
         CAST({K} % 4 AS SMALLINT) AS sid,
         event_type AS type,
         CASE WHEN {K} % 10 = 0 THEN NULL ELSE 'd' END AS description,
         CAST(value AS FLOAT) AS val,
         ts,
         CAST({K} AS SMALLINT) AS battery,
         event_id % 5 = 0 AS agg,
         CASE event_id % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE ELSE NULL END AS sync_cloud
  FROM events
)"""

# EVENTS_BOUNDS, strict: view (1, 60), click (2, 101), other (-99999, 99999)
STRICT_EVENTS = """(
  CAST(val AS DOUBLE) > CASE type WHEN 'view' THEN 1 WHEN 'click' THEN 2 ELSE -99999 END
  AND CAST(val AS DOUBLE) < CASE type WHEN 'view' THEN 60 WHEN 'click' THEN 101 ELSE 99999 END)"""

STRICT_EVENTS_70 = STRICT_EVENTS.replace("THEN 60", "THEN 70")

RANGE = "ts >= TIMESTAMP '2024-01-01 00:00:00' AND ts <= TIMESTAMP '2024-01-30 00:00:00'"

# EVENTS_LEGACY, closed, other types skipped: view [1, 60], click [2, 101]
LEGACY_EVENTS = """(
  (type = 'view' AND CAST(val AS DOUBLE) BETWEEN 1 AND 60)
  OR (type = 'click' AND CAST(val AS DOUBLE) BETWEEN 2 AND 101))"""

AGGREGATES = f"""
ag AS (
  SELECT MIN(id) AS id, mac, sid, type, description,
         CAST(AVG(val) AS FLOAT) AS avg,
         CAST(STDDEV_POP(val) AS FLOAT) AS stddev,
         COUNT(val) AS n,
         date_trunc('day', ts) + INTERVAL 24 HOUR AS ts,
         CAST(ROUND(AVG(battery)) AS SMALLINT) AS battery,
         date_trunc('day', ts) + INTERVAL 24 HOUR <= TIMESTAMP '2024-01-15 00:00:00' AS sync
  FROM m WHERE {LEGACY_EVENTS}
  GROUP BY date_trunc('day', ts), mac, sid, type, description
)"""

# one message of all views and purchases up to the cutoff, answered; then one of all purchases taken back
ACKED = """
ak AS (
  SELECT *, CASE WHEN type = 'purchase' THEN FALSE
                 WHEN type = 'view' AND ts < TIMESTAMP '2024-01-15 00:00:00' THEN TRUE END AS acked
  FROM m
)"""

READING_TYPE = """CASE WHEN event_type IN ('view', 'purchase') THEN 't'
                       WHEN event_type IN ('click', 'signup') THEN 'h' ELSE event_type END"""

BATCHES = f"""
b AS (
  SELECT CAST(user_id AS VARCHAR) || '-' || CAST(event_id // 64 AS VARCHAR) AS batch_id,
         CAST(user_id AS VARCHAR) AS mac,
         event_id, (user_id + event_id // 64) % 40 AS kind,
         CAST({K} % 4 AS SMALLINT) AS sid,
         CAST(CAST(value AS FLOAT) AS FLOAT) AS val,
         {READING_TYPE} AS type,
         CASE WHEN {K} % 10 = 0 THEN NULL ELSE 'd' END AS description,
         CAST({K} AS SMALLINT) AS battery
  FROM events
),
br AS (
  SELECT batch_id,
         CASE WHEN any_value(kind) IN (0, 1, 2) THEN 'json' WHEN any_value(kind) IN (3, 4, 5) THEN 'mac'
              WHEN any_value(kind) = 6 THEN 'battery' WHEN any_value(kind) = 7 THEN 'data'
              WHEN any_value(kind) = 8 THEN 'sid' WHEN any_value(kind) IN (9, 10) THEN 'value'
              WHEN NOT bool_and(type IN ('t', 'h')) THEN 'type'
              WHEN any_value(kind) = 11 AND bool_or(description IS NOT NULL) THEN 'desc' END AS reason
  FROM b GROUP BY batch_id
),
bv AS (
  SELECT batch_id FROM br WHERE reason IS NULL
)"""

OBSERVATIONS = f"""
oo AS (
  SELECT CAST(user_id AS VARCHAR) AS device_id, event_id AS id, ts,
         CASE WHEN event_type = 'signup' THEN 'app'
              WHEN event_type = 'error' AND {K} >= 95 THEN 'x'
              WHEN {K} % 3 = 0 THEN 'gpio' WHEN {K} % 3 = 1 THEN 'connectivity' ELSE 'cloud' END AS segment,
         CASE WHEN event_type = 'signup' THEN '{{"value": "restart"}}'
              WHEN event_type = 'error' AND {K} >= 90 AND {K} < 95 THEN '{{}}'
              WHEN {K} % 3 = 0 THEN '{{"pin": 7, "value": ' || CAST({K} % 2 AS VARCHAR) || '}}'
              ELSE '{{"value": ' || CAST({K} % 2 AS VARCHAR) || '}}' END AS data,
         CASE WHEN event_type = 'signup' THEN '{{"value":"restart"}}'
              WHEN event_type = 'error' AND {K} >= 90 AND {K} < 95 THEN NULL
              WHEN {K} % 3 = 0 THEN '{{"pin":7,"userId":0,"value":' || CAST({K} % 2 AS VARCHAR) || '}}'
              ELSE '{{"value":' || CAST({K} % 2 AS VARCHAR) || '}}' END AS canon
  FROM events
),
o AS (
  SELECT device_id, id, ts, segment,
         CASE id % 29 WHEN 0 THEN data || ',2] tail'
              WHEN 1 THEN regexp_replace(data, '"value": ([01])}}', '"value": \\1e0}}')
              WHEN 2 THEN regexp_replace(data, '^.', '{{"value": 9, ') ELSE data END AS data,
         CASE WHEN id % 29 = 0 THEN NULL ELSE canon END AS canon
  FROM oo
),
ov AS (
  SELECT device_id, id, segment, canon AS data, ts FROM o
  WHERE segment IN ('gpio', 'connectivity', 'cloud', 'app') AND canon IS NOT NULL
)"""

RUNS = """
ep AS (
  SELECT ov.*,
         COALESCE(MAX(CASE WHEN segment = 'app' AND data = '{"value":"restart"}' THEN id END)
                  OVER (PARTITION BY device_id ORDER BY id
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS epoch
  FROM ov
),
fl AS (
  SELECT *, LAG(data) OVER w AS prev_data, LAG(epoch) OVER w AS prev_epoch,
         LEAD(ts) OVER w AS next_ts, LEAD(epoch) OVER w AS next_epoch
  FROM ep WINDOW w AS (PARTITION BY device_id, segment ORDER BY id)
),
st AS (
  SELECT *, CASE WHEN prev_epoch IS NULL OR prev_epoch <> epoch OR prev_data <> data THEN id END AS start_id,
         CASE WHEN next_epoch = epoch THEN next_ts ELSE ts END AS end_candidate
  FROM fl
),
rn AS (
  SELECT *, MAX(start_id) OVER (PARTITION BY device_id, segment ORDER BY id
                                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run_id
  FROM st
),
runs AS (
  SELECT device_id, run_id AS id, segment, arg_min(data, id) AS data, arg_min(ts, id) AS ts_start,
         arg_max(end_candidate, id) AS ts_end, MIN(epoch) AS epoch, COUNT(*) AS n_obs
  FROM rn GROUP BY device_id, segment, run_id
)"""

QUEUE = """
q AS (
  SELECT o_orderkey AS id,
         CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN 'irrigation_on'
              ELSE 'irrigation_off' END AS job_type,
         o_orderdate AS ts_created,
         CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL ELSE CAST(o_custkey AS INTEGER) END AS delay,
         o_orderstatus
  FROM orders
),
qq AS (
  SELECT id, job_type, ts_created, delay,
         CASE WHEN o_orderstatus = 'O' THEN NULL
              ELSE ts_created + to_minutes(CAST(COALESCE(delay, 0) AS BIGINT)) END AS ts_executed
  FROM q
)"""

QUEUE_TTF = """CAST(round_even(
    (epoch_us(ts_created + to_minutes(CAST(delay AS BIGINT))) - epoch_us(TIMESTAMP '1998-01-01 00:00:00'))
    / 60000000.0, 0) AS INTEGER)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",".join(ctes) + "\n"


def bucket(n: int) -> str:
    return f"date_trunc('day', ts) + to_hours(CAST(hour(ts) // {n} * {n} AS BIGINT))"


def key_part(key: str, parts: int) -> str:
    """The first six hex digits of the key's MD5, modulo ``parts``."""
    digits = [f"(strpos('0123456789abcdef', substr(md5({key}), {k}, 1)) - 1) * {16 ** (6 - k)}" for k in range(1, 7)]
    return f"CAST(({' + '.join(digits)}) % {parts} AS INTEGER)"


def rollup_sql(n: int = 1, extra_where: str = "", time: str = "") -> str:
    return f"""SELECT {f"CAST({time} AS TIMESTAMP)" if time else bucket(n)} AS time, mac, sid, type,
       CAST(ROUND(CAST(AVG(val) AS DECIMAL(38,12)), 2) AS DOUBLE) AS val_avg,
       CAST(ROUND(CAST(STDDEV_POP(val) AS DECIMAL(38,12)), 2) AS DOUBLE) AS val_stddev,
       COUNT(val) AS val_count
FROM m
WHERE {STRICT_EVENTS} {extra_where}
GROUP BY 1, mac, sid, type"""
