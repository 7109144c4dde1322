"""Queries of links by identifier, by connection and by time, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import links, timing, topology
from tallyloom.plans.inputs import SPANS, make
from tallyloom.session import table

TOPOLOGY = """
[points.p0]
host = "a"
visibility = "kernel"
clock = "a"
timestamps = "kernel_monotonic"
inbound = ["traceparent", "tuple5"]
outbound = ["traceparent", "tuple5"]
[points.p1]
host = "a"
visibility = "kernel"
clock = "a"
timestamps = "kernel_monotonic"
inbound = ["traceparent", "tuple5"]
outbound = ["tuple5"]
[points.p2]
host = "b"
visibility = "log"
clock = "a"
timestamps = "log_ms"
inbound = ["traceparent"]
outbound = ["traceparent"]
propagates = { traceparent = "app" }
[[hops]]
from = "p0"
to = "p1"
[[hops]]
from = "p1"
to = "p2"
rate = 500
[[hops]]
from = "p2"
to = "p0"
"""
PARAMS = timing.JoinParams((timing.Signal("start", 55, 20), timing.Signal("end", 20, 30)), margin_us=2, max_component=8, local_span_us=1_500, local_limit_permille=40)


def _observations(spark: SparkSession, d: str) -> DataFrame:
    spans = make(spark, d, SPANS)
    keys = F.map_filter(F.create_map(F.lit("traceparent"), "trace", F.lit("tuple5"), "conn"), lambda k, v: v.isNotNull())
    return spans.select("source", "seq", "point", "side", keys.alias("keys"))


def _joins(spark: SparkSession, keys: list[str]) -> DataFrame:
    rows = [(f"{p}.{'+'.join(keys)}", keys, p, "outbound", p, "inbound") for p in ("p0", "p1", "p2")]
    return spark.createDataFrame(rows, "place string, keys array<string>, up_point string, up_side string, down_point string, down_side string")


def _values(spark: SparkSession, d: str, *keys: str) -> DataFrame:
    return links.values(_observations(spark, d), _joins(spark, list(keys)))


def exact_links(spark: SparkSession, d: str) -> DataFrame:
    return links.links(links.told_apart(_values(spark, d, "traceparent")))


def observed_links(spark: SparkSession, d: str) -> DataFrame:
    return links.links(links.told_apart(_values(spark, d, "traceparent", "tuple5"))).withColumn("value", F.replace("value", F.lit(links.UNIT), F.lit("|")))


def exact_collisions(spark: SparkSession, d: str) -> DataFrame:
    return links.outcomes(_values(spark, d, "traceparent")).filter("kind = 'COLLIDED'").select("place", "value", "n_up", "n_down")


def exact_unlinked(spark: SparkSession, d: str) -> DataFrame:
    return links.unlinked(links.told_apart(_values(spark, d, "traceparent")))


def two_signal_outcome(spark: SparkSession, d: str) -> DataFrame:
    bare = lambda *k: _values(spark, d, *k).withColumn("place", F.substring("place", 1, 2))
    return links.combined(bare("traceparent"), bare("tuple5"))


def topology_ceilings(spark: SparkSession, d: str) -> DataFrame:
    return topology.loads(TOPOLOGY).ceilings_frame(spark)


def topology_links(spark: SparkSession, d: str) -> DataFrame:
    """Links of the declared hops and crossings, counted by kind."""
    declared = topology.loads(TOPOLOGY)
    found = links.values(_observations(spark, d), declared.joins_frame(spark))
    return links.outcomes(found).groupBy("place", "key", "kind").agg(F.count("*").alias("n"))


def dedupe_deliveries(spark: SparkSession, d: str) -> DataFrame:
    o = _observations(spark, d)
    return links.checked_distinct(o.unionByName(o.filter("seq % 7 = 0")), ["point", "side", "keys"]).groupBy("point", "side").agg(F.count("*").alias("observations"), F.sum(F.col("deliveries") - 1).alias("dropped"))


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    spans = make(spark, d, SPANS)
    crowded = (F.floor(F.col("seq") / 400) % 2 == 0).cast("long") * 970  # every other stretch is far denser
    spans = spans.select("source", "seq", "side", *[(F.col(c) - (F.col("seq") % 400) * crowded).alias(c) for c in ("start_us", "end_us")])
    return spans.filter("side = 'outbound'"), spans.filter("side = 'inbound'")


def timing_candidates(spark: SparkSession, d: str) -> DataFrame:
    return timing.candidates(*_sides(spark, d), PARAMS)


def timing_links(spark: SparkSession, d: str) -> DataFrame:
    return timing.timed_links(*_sides(spark, d), PARAMS)


def timing_status(spark: SparkSession, d: str) -> DataFrame:
    return timing_links(spark, d).groupBy("side", "status").agg(F.count("*").alias("n"))


def component_sizes(spark: SparkSession, d: str) -> DataFrame:
    found = timing_candidates(spark, d).select(F.concat(F.lit("u"), F.col("up_seq").cast("string")).alias("a"), F.concat(F.lit("d"), F.col("down_seq").cast("string")).alias("b"))
    return timing.components(found, "a", "b").groupBy("component").count().groupBy(F.col("count").alias("size")).agg(F.count("*").alias("components"))


def graph_refusals(spark: SparkSession, d: str) -> DataFrame:
    """What a strict reading of the candidate links refuses."""
    name = lambda c: F.concat(F.col(f"{c}.source"), F.lit("/"), F.col(f"{c}.seq").cast("string"))
    edges = table(spark, d, "candidate_links").filter("hop = 'edge-gw -> checkout-api'").select(name("upstream").alias("left"), name("downstream").alias("right"), "weight")
    seen = table(spark, d, "timed_obs").select(F.concat("source", F.lit("/"), F.col("seq").cast("string")).alias("id"), "point", "side")
    at = lambda point, side: seen.filter((F.lower(F.trim("point")) == point) & (F.col("side") == side)).select("id")
    return timing.graph_refusals(at("edge-gw", "outbound"), at("checkout-api", "inbound"), edges)


def density_guard(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "timed_obs").filter("start_us is not null").select("source", "seq", "point", "start_us")
    near = timing.others_near(o, "start_us", 20_000, ["point"])
    return near.filter("point is not null").groupBy("point").agg(F.max("others").alias("most"), F.sum("others").alias("total"), F.count_if(F.col("others") > 10).alias("crowded"))


def queries() -> dict:
    own = (exact_links, observed_links, exact_collisions, exact_unlinked, two_signal_outcome, topology_ceilings, topology_links, dedupe_deliveries, timing_candidates, timing_links, timing_status, component_sizes, density_guard, graph_refusals)
    return {f.__name__: f for f in own}


def _grouped(value: str, name: str, where: str) -> str:
    return f"""g AS (SELECT concat(point, '.{name}') AS place, '{name}' AS key, {value} AS value, count(*) FILTER (side = 'outbound') AS n_up, count(*) FILTER (side = 'inbound') AS n_down,
      min(seq) FILTER (side = 'outbound') AS up_seq, min(seq) FILTER (side = 'inbound') AS down_seq FROM ({SPANS}) WHERE {where} GROUP BY ALL)"""


_TRACE = "WITH " + _grouped("trace", "traceparent", "trace IS NOT NULL")
_CROWD = f"""s AS (SELECT source, seq, side, start_us - (seq % 400) * (CASE WHEN (seq // 400) % 2 = 0 THEN 970 ELSE 0 END) AS start_us,
  end_us - (seq % 400) * (CASE WHEN (seq // 400) % 2 = 0 THEN 970 ELSE 0 END) AS end_us FROM ({SPANS})),
pairs AS (SELECT u.source AS up_source, u.seq AS up_seq, d.source AS down_source, d.seq AS down_seq, 1 + 20 - abs(d.start_us - u.start_us - 55) + 30 - abs(u.end_us - d.end_us - 20) AS weight
  FROM s u JOIN s d ON u.side = 'outbound' AND d.side = 'inbound' AND d.start_us BETWEEN u.start_us + 35 AND u.start_us + 75 AND u.end_us - d.end_us BETWEEN -10 AND 50)"""

_TWO = f"""
WITH v AS (SELECT point AS place, 1 AS s, trace AS value, side, source, seq FROM ({SPANS}) UNION ALL SELECT point, 2, conn, side, source, seq FROM ({SPANS}) WHERE conn IS NOT NULL),
g AS (SELECT *, count(*) FILTER (side = 'outbound') OVER w AS u, count(*) FILTER (side = 'inbound') OVER w AS d, min(CASE WHEN side = 'outbound' THEN seq END) OVER w AS us, min(CASE WHEN side = 'inbound' THEN seq END) OVER w AS ds FROM v WINDOW w AS (PARTITION BY place, s, value)),
k AS (SELECT *, CASE WHEN u > 1 OR d > 1 THEN 'COLLIDED' WHEN u = 1 AND d = 1 THEN 'LINKED' ELSE 'UNLINKED' END AS kind, CASE WHEN u = 1 AND d = 1 THEN CASE WHEN side = 'outbound' THEN 'in' ELSE 'out' END END AS ps, CASE WHEN u = 1 AND d = 1 THEN CASE WHEN side = 'outbound' THEN ds ELSE us END END AS pq FROM g),
b AS (SELECT coalesce(x.place, y.place) AS place, coalesce(x.source, y.source) AS source, coalesce(x.seq, y.seq) AS seq, x.kind AS k1, y.kind AS k2, x.pq AS q1, y.pq AS q2, coalesce(x.ps, y.ps) AS ps, coalesce(x.pq, y.pq) AS pq
  FROM (SELECT * FROM k WHERE s = 1) x FULL JOIN (SELECT * FROM k WHERE s = 2) y ON x.place = y.place AND x.source = y.source AND x.seq = y.seq),
h AS (SELECT b.*, p.k1 IS NOT NULL AS h1, p.k2 IS NOT NULL AS h2 FROM b LEFT JOIN b p ON p.place = b.place AND p.source = b.ps AND p.seq = b.pq)
SELECT place, source, seq, CASE WHEN k1 IS NOT DISTINCT FROM 'COLLIDED' OR k2 IS NOT DISTINCT FROM 'COLLIDED' THEN 'COLLIDED'
  WHEN k1 IS NOT DISTINCT FROM 'LINKED' AND k2 IS NOT DISTINCT FROM 'LINKED' THEN CASE WHEN q1 = q2 THEN 'CORROBORATED' ELSE 'SIGNAL_OTHER_PARTNER' END
  WHEN k1 IS NOT DISTINCT FROM 'LINKED' THEN CASE WHEN k2 IS NOT NULL AND h2 THEN 'SIGNAL_UNMATCHED' ELSE 'SIGNAL_ABSENT' END
  WHEN k2 IS NOT DISTINCT FROM 'LINKED' THEN CASE WHEN k1 IS NOT NULL AND h1 THEN 'SIGNAL_UNMATCHED' ELSE 'SIGNAL_ABSENT' END ELSE 'UNLINKED' END AS verdict, ps AS partner_source, pq AS partner_seq FROM h
"""


# Components of these observations are stars of at most two edges (one of the smallest table has three in a row, with the best at an end): the best edge is taken, and what deciding otherwise costs is its lead over the other.
_DECIDED = f"""WITH {_CROWD}, o AS (SELECT side, source, seq, start_us, count(start_us) OVER (PARTITION BY side ORDER BY start_us RANGE BETWEEN 1500 PRECEDING AND 1500 FOLLOWING) - 1 AS others FROM s),
e AS (SELECT *, greatest(count(*) OVER (PARTITION BY up_seq), count(*) OVER (PARTITION BY down_seq)) AS n,
  greatest(max(weight) OVER (PARTITION BY up_seq), max(weight) OVER (PARTITION BY down_seq)) AS best, least(min(weight) OVER (PARTITION BY up_seq), min(weight) OVER (PARTITION BY down_seq)) AS least_ FROM pairs),
r AS (SELECT 'outbound' AS side, up_source AS source, up_seq AS seq, down_source AS ps, down_seq AS pq, * EXCLUDE (up_source, up_seq, down_source, down_seq) FROM e UNION ALL SELECT 'inbound', down_source, down_seq, up_source, up_seq, * EXCLUDE (up_source, up_seq, down_source, down_seq) FROM e),
t AS (SELECT side, source, seq, bool_or(CASE WHEN n = 1 THEN best <= 2 ELSE best - least_ <= 2 END) AS unsure, max(CASE WHEN weight = best THEN {{'s': ps, 'q': pq, 'w': weight}} END) AS p FROM r GROUP BY ALL),
m AS (SELECT o.*, t.p, CASE WHEN t.side IS NULL THEN 'NO_CANDIDATE' WHEN unsure THEN 'AMBIGUOUS' WHEN p IS NULL THEN 'UNMATCHED' ELSE 'MATCHED' END AS status FROM o LEFT JOIN t USING (side, source, seq)),
f AS (SELECT m.side, m.source, m.seq, CASE WHEN m.status = 'MATCHED' AND greatest(m.others, k.others) * 20000 > 60000 THEN 'DENSE' ELSE m.status END AS status, m.p FROM m LEFT JOIN o k ON k.side <> m.side AND k.source = m.p.s AND k.seq = m.p.q)"""


def oracle_sql() -> dict[str, str]:
    ceilings = [("p0 -> p1", "authored", "shared_header", "'traceparent'", "NULL"), ("p1 -> p2", "derived", "nested_timing", "NULL", "'1/2'"), ("p2 -> p0", "authored", "shared_header", "'traceparent'", "NULL"), ("p0", "observed", "inside_process", "NULL", "NULL"), ("p1", "observed", "inside_process", "NULL", "NULL"), ("p2", "authored", "propagated", "'traceparent'", "NULL")]  # read off the rules
    return {
        "topology_ceilings": " UNION ALL ".join(f"SELECT '{place}' AS place, '{evidence}' AS evidence, '{link}' AS link, CAST({key} AS VARCHAR) AS key, CAST({density} AS VARCHAR) AS density" for place, evidence, link, key, density in ceilings),
        "timing_links": _DECIDED + "SELECT side, source, seq, status, CASE status WHEN 'MATCHED' THEN p.s END AS partner_source, CASE status WHEN 'MATCHED' THEN p.q END AS partner_seq, CASE status WHEN 'MATCHED' THEN p.w END AS weight FROM f",
        "timing_status": _DECIDED + "SELECT side, status, count(*) AS n FROM f GROUP BY ALL",
        "exact_links": _TRACE + "SELECT place, key, value, 'out' AS up_source, up_seq, 'in' AS down_source, down_seq FROM g WHERE n_up = 1 AND n_down = 1",
        "observed_links": "WITH " + _grouped("concat(trace, '|', conn)", "traceparent+tuple5", "trace IS NOT NULL AND conn IS NOT NULL") + "SELECT place, key, value, 'out' AS up_source, up_seq, 'in' AS down_source, down_seq FROM g WHERE n_up = 1 AND n_down = 1",
        "exact_collisions": _TRACE + "SELECT place, value, n_up, n_down FROM g WHERE n_up > 1 OR n_down > 1",
        "exact_unlinked": _TRACE + "SELECT place, key, value, CASE WHEN n_up = 1 THEN 'out' ELSE 'in' END AS source, coalesce(up_seq, down_seq) AS seq FROM g WHERE n_up + n_down = 1",
        "two_signal_outcome": _TWO,
        "topology_links": f"""WITH j AS (SELECT 'p0 -> p1' AS place, 'p0' AS up, 'outbound' AS us, 'p1' AS dn, 'inbound' AS ds UNION ALL SELECT 'p2 -> p0', 'p2', 'outbound', 'p0', 'inbound' UNION ALL SELECT 'p2', 'p2', 'inbound', 'p2', 'outbound'),
          g AS (SELECT place, trace, count(*) FILTER (point = up AND side = us) AS u, count(*) FILTER (point = dn AND side = ds) AS d FROM ({SPANS}) JOIN j ON (point = up AND side = us) OR (point = dn AND side = ds) GROUP BY ALL)
          SELECT place, 'traceparent' AS key, CASE WHEN u > 1 OR d > 1 THEN 'COLLIDED' WHEN u = 1 AND d = 1 THEN 'LINKED' ELSE 'UNLINKED' END AS kind, count(*) AS n FROM g GROUP BY ALL""",
        "dedupe_deliveries": f"SELECT point, side, count(*) AS observations, count(*) FILTER (seq % 7 = 0) AS dropped FROM ({SPANS}) GROUP BY ALL",
        "graph_refusals": """WITH e AS (SELECT concat(upstream.source, '/', upstream.seq) AS l, concat(downstream.source, '/', downstream.seq) AS r, weight FROM candidate_links WHERE hop = 'edge-gw -> checkout-api'),
          a AS (SELECT concat(source, '/', seq) AS id FROM timed_obs WHERE lower(trim(point)) = 'edge-gw' AND side = 'outbound'), b AS (SELECT concat(source, '/', seq) AS id FROM timed_obs WHERE lower(trim(point)) = 'checkout-api' AND side = 'inbound')
          SELECT 'duplicate left id' AS what, id, count(*) AS times FROM a GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'duplicate right id', id, count(*) FROM b GROUP BY id HAVING count(*) > 1
          UNION ALL SELECT 'duplicate edge', l || ' -> ' || r, count(*) FROM e GROUP BY l, r HAVING count(*) > 1 UNION ALL SELECT 'unknown left id', l, count(*) FROM e WHERE l NOT IN (SELECT id FROM a) GROUP BY l
          UNION ALL SELECT 'unknown right id', r, count(*) FROM e WHERE r NOT IN (SELECT id FROM b) GROUP BY r UNION ALL SELECT 'weight out of range', l || ' -> ' || r, count(*) FROM e WHERE weight IS NULL OR weight NOT BETWEEN 1 AND 1000000000 GROUP BY l, r""",
        "timing_candidates": f"WITH {_CROWD} SELECT * FROM pairs",
        "component_sizes": f"""WITH RECURSIVE {_CROWD}, e AS (SELECT DISTINCT concat('u', up_seq) AS a, concat('d', down_seq) AS b FROM pairs), both_ AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
          reach AS (SELECT a, a AS b FROM both_ UNION SELECT r.a, x.b FROM reach r JOIN both_ x ON r.b = x.a), c AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
          SELECT size, count(*) AS components FROM (SELECT c, count(*) AS size FROM c GROUP BY c) GROUP BY size""",
        "density_guard": """WITH n AS (SELECT point, count(*) OVER (PARTITION BY point ORDER BY start_us RANGE BETWEEN 20000 PRECEDING AND 20000 FOLLOWING) - 1 AS others FROM timed_obs WHERE start_us IS NOT NULL AND point IS NOT NULL)
          SELECT point, max(others) AS most, sum(others)::BIGINT AS total, count(*) FILTER (others > 10) AS crowded FROM n GROUP BY point""",
    }
