"""Records, spans and captures made from the test tables, as SQL that Spark and DuckDB read alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_CURRENCY = "CASE WHEN o_custkey % 4 = 0 THEN NULL WHEN o_custkey % 4 = 1 THEN 'EUR' ELSE 'USD' END"
_REFERENCE = "CASE WHEN o_orderkey % 5 = 0 THEN concat('REF', CAST(o_orderkey AS STRING)) END"

LEDGER = f"""SELECT concat('L', CAST(o_orderkey AS STRING)) AS id, CAST(o_custkey AS STRING) AS account, CAST(o_totalprice AS DECIMAL(18,2)) AS amount,
  CAST(o_orderdate AS DATE) AS value_date, {_REFERENCE} AS reference, {_CURRENCY} AS currency FROM orders WHERE o_orderkey % 3 <> 0"""

_MOVED = "CAST(o_orderdate AS DATE) + CAST(o_orderkey % 4 AS INT)"
_PART = "CAST(round(CAST(o_totalprice AS DECIMAL(18,2)) * 0.6, 2) AS DECIMAL(18,2))"
FEED = f"""SELECT concat('R', CAST(o_orderkey AS STRING)) AS id, CAST(o_custkey AS STRING) AS account,
  CAST(CAST(o_totalprice AS DECIMAL(18,2)) + CAST(o_orderkey % 5 - 2 AS DECIMAL(9,0)) * 0.10 AS DECIMAL(18,2)) AS amount,
  {_MOVED} AS value_date, {_REFERENCE} AS reference, {_CURRENCY} AS currency FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0
UNION ALL SELECT concat('R', CAST(o_orderkey AS STRING), '.1'), CAST(o_custkey AS STRING), {_PART}, {_MOVED}, NULL, {_CURRENCY} FROM orders WHERE o_orderkey % 11 = 0
UNION ALL SELECT concat('R', CAST(o_orderkey AS STRING), '.2'), CAST(o_custkey AS STRING), CAST(CAST(o_totalprice AS DECIMAL(18,2)) - {_PART} AS DECIMAL(18,2)), {_MOVED}, NULL, {_CURRENCY} FROM orders WHERE o_orderkey % 11 = 0"""

# One request in four points: events seen outbound, and again inbound a little later; some keys are used twice.
SPANS = """SELECT 'out' AS source, event_id AS seq, concat('p', CAST(user_id % 3 AS STRING)) AS point, 'outbound' AS side,
  concat('k', CAST(event_id - (CASE WHEN event_id % 97 = 0 THEN 1 ELSE 0 END) AS STRING)) AS trace,
  CASE WHEN event_id % 13 <> 0 THEN concat('c', CAST(user_id AS STRING), '/', CAST(event_id AS STRING)) END AS conn,
  event_id * 1000 AS start_us, event_id * 1000 + 300 + event_id % 50 AS end_us FROM events
UNION ALL SELECT 'in', event_id, concat('p', CAST(user_id % 3 AS STRING)), 'inbound', concat('k', CAST(event_id AS STRING)),
  CASE WHEN event_id % 17 <> 0 THEN concat('c', CAST(user_id AS STRING), '/', CAST(event_id + (CASE WHEN event_id % 101 = 0 THEN 1 ELSE 0 END) AS STRING)) END,
  event_id * 1000 + 40 + event_id % 30, event_id * 1000 + 280 + event_id % 50 FROM events WHERE event_id % 19 <> 0"""

# Decisions on records by day and source, with their captures.
DECISIONS = """SELECT CASE WHEN event_id % 2 = 0 THEN 'left' ELSE 'right' END AS side, event_type AS source, CAST(ts AS DATE) AS day,
  CASE WHEN event_id % 10 < CASE WHEN CAST(ts AS DATE) >= DATE '1995-01-20' THEN 6 ELSE 8 END THEN 'M0_REFERENCE' WHEN event_id % 23 = 0 THEN 'LATE' ELSE 'NO_CANDIDATE+AGGREGATE_NOT_FOUND' END AS outcome,
  event_id % 89 = 0 AS forced FROM events"""


# The same as decisions in effect on records, some still provisional; right records of even numbers follow their left one.
STATES = """SELECT CASE WHEN event_id % 2 = 0 THEN 'left' ELSE 'right' END AS side, CAST(event_id AS STRING) AS id, event_type AS source, CAST(ts AS DATE) AS day,
  CASE WHEN event_id % 31 = 0 THEN 'PROVISIONAL' ELSE 'FINAL' END AS status, CASE WHEN event_id % 4 = 0 THEN 'M0_REFERENCE' WHEN event_id % 4 = 1 THEN 'AS_COUNTERPART' ELSE 'NO_CANDIDATE' END AS reason,
  split(concat(CAST(event_id - 1 AS STRING), ',', CAST(event_id AS STRING)), ',') AS input_ids, event_id % 89 = 0 AS forced FROM events"""

# When records of sources came in.
ARRIVALS = "SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'left' ELSE 'right' END AS side, CAST(o_orderkey AS STRING) AS id, concat('s', CAST(o_custkey % 100 AS STRING)) AS source, CAST(o_orderdate AS DATE) AS day FROM orders"

TABLES = ("orders", "events", "load_gen_rows", "timed_obs", "timed_probe", "flow_decisions")


def make(spark: SparkSession, d: str, sql: str) -> DataFrame:
    """The rows of one of these statements over the tables in ``d``."""
    for name in TABLES:
        sql = re.sub(rf"FROM {name}\b", "FROM {" + name + "}", sql)
    used = {n: spark.read.parquet(f"{d}/{n}.parquet") for n in TABLES if "{" + n + "}" in sql}
    return spark.sql(sql, **used)
