"""The p queries of the general problems, over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import differences, late_events, nested, redelivery
from tallyloom.session import table

RECON_FIELDS = ["amount", "value_date", "account", "currency", "reference"]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    both = [table(spark, d, t).select(F.lit(t).alias("feed"), "source", "seq", "captured_at") for t in ("timed_obs", "timed_probe")]
    return redelivery.repeats(both[0].unionByName(both[1]), ["feed", "source", "seq"], "captured_at").select("source", "seq").distinct()


def p1_once(spark: SparkSession, d: str) -> DataFrame:
    both = [table(spark, d, t).withColumn("feed", F.lit(t)) for t in ("timed_obs", "timed_probe")]
    return redelivery.exactly_one(both[0].unionByName(both[1]), ["feed", "source", "seq"], "captured_at", ["batch_id"])


def _folded(spark: SparkSession, d: str) -> DataFrame:
    return late_events.late_events(table(spark, d, "flow_journal"), table(spark, d, "flow_config"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return late_events.beyond_cutoff(_folded(spark, d)).select("flow_id", "pos")


def p3_period_counts(spark: SparkSession, d: str) -> DataFrame:
    return late_events.period_counts(_folded(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    links = nested.Captures(table(spark, d, "agent_payloads"), ("request", "span")).span_links()
    return links.select("raw_id", "conn_key", "span_id", "parent_span_id").distinct()


def p5_attributes(spark: SparkSession, d: str) -> DataFrame:
    """Spans' method and clientAddr, one row for each occurrence."""
    captures = nested.Captures(table(spark, d, "agent_payloads"), ("span", "attribute"))
    ids = captures.spans().select(F.col("hash").alias("parent_hash"), "span_id")
    named = captures.attributes().filter(F.col("name").isin("method", "clientAddr"))
    return captures.bridge("attribute").join(named, "hash").join(ids, "parent_hash").select("raw_id", F.coalesce("span_id", F.lit("")).alias("span_id"), "name", "value")


def _differences(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "recon_records")
    return differences.differences(r.filter("side = 'left'"), r.filter("side = 'right'"), "id", RECON_FIELDS, ["reference"])


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _differences(spark, d).filter("field <> 'copies'").select("id", "field").distinct()


def p6_values(spark: SparkSession, d: str) -> DataFrame:
    return _differences(spark, d)


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_once, p3_found, p3_period_counts, p5_found, p5_attributes, p6_found, p6_values)}


_ONCE = """
SELECT feed, source, seq, point, side, start_us, end_us, batch_id, captured_at FROM (
  SELECT *, row_number() OVER (PARTITION BY feed, source, seq ORDER BY captured_at NULLS LAST, batch_id NULLS LAST, point NULLS LAST, side NULLS LAST, start_us NULLS LAST, end_us NULLS LAST) AS n
  FROM (SELECT 'timed_obs' AS feed, * FROM timed_obs UNION ALL SELECT 'timed_probe', * FROM timed_probe)) WHERE n = 1
"""

_JOURNAL = """
WITH j AS (SELECT flow_id, pos, source, seq, kind, CASE kind WHEN 'seen' THEN coalesce(at_us, end_us) ELSE until_us END AS t FROM flow_journal),
told AS (SELECT * FROM j WHERE t IS NOT NULL),
s AS (SELECT flow_id, unnest(sources) AS src FROM flow_config),
c AS (SELECT told.flow_id, told.pos, s.src, max(CASE WHEN told.source = s.src THEN told.t END) OVER (PARTITION BY told.flow_id, s.src ORDER BY told.pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS clock
      FROM told JOIN s USING (flow_id)),
clocks AS (SELECT flow_id, pos, CASE WHEN count(clock) = count(*) THEN min(clock) END AS clock FROM c GROUP BY ALL),
f AS (SELECT flow_id, min(pos) AS pos, arg_min(t, pos) AS t FROM told WHERE kind = 'seen' GROUP BY flow_id, source, seq),
x AS (SELECT f.flow_id, f.pos, f.t, clock, lateness_us, period_us FROM f JOIN clocks USING (flow_id, pos) JOIN flow_config USING (flow_id))
"""

_FIELDS = "\nUNION ALL ".join(f"SELECT id, '{f}' AS field, CAST(l.{f} AS VARCHAR) AS left_value, CAST(r.{f} AS VARCHAR) AS right_value FROM l JOIN r USING (id) WHERE l.{f} IS DISTINCT FROM r.{f}" for f in RECON_FIELDS)
_COPIES = """
WITH n AS (SELECT side, id, account, amount, value_date, nullif(reference, '') AS reference, currency, count(*) AS n FROM recon_records WHERE id IS NOT NULL GROUP BY ALL),
l AS (SELECT * FROM n WHERE side = 'left'), r AS (SELECT * FROM n WHERE side = 'right')
"""

_SPANS = """
WITH RECURSIVE ok AS (SELECT raw_id, CAST(payload AS JSON) AS p FROM agent_payloads WHERE json_valid(payload)),
rec AS (SELECT raw_id, unnest(CASE WHEN json_exists(p, '$.rows') THEN CAST(p->'rows' AS JSON[]) ELSE [p] END) AS r FROM ok WHERE json_type(p) = 'OBJECT'),
top AS (SELECT raw_id, coalesce(r->'load_gen_row'->>'conn_key', '') AS conn_key, r->'span' AS one,
  CASE json_type(r->'spans') WHEN 'VARCHAR' THEN CAST(r->>'spans' AS JSON) ELSE r->'spans' END AS many FROM rec),
outer_ AS (SELECT raw_id, conn_key, one AS s FROM top WHERE json_type(one) = 'OBJECT'
  UNION ALL SELECT raw_id, conn_key, unnest(CAST(many AS JSON[])) FROM top WHERE json_type(many) = 'ARRAY'
  UNION ALL SELECT raw_id, conn_key, many FROM top WHERE json_type(many) = 'OBJECT'),
tree AS (SELECT raw_id, conn_key, s, coalesce(s->>'spanID', '') AS span_id, '' AS parent_span_id FROM outer_ WHERE json_type(s) = 'OBJECT'
  UNION ALL SELECT raw_id, conn_key, c, coalesce(c->>'spanID', ''), span_id FROM (
    SELECT raw_id, conn_key, span_id, unnest(CAST(s->'children' AS JSON[])) AS c FROM tree WHERE json_type(s->'children') = 'ARRAY') WHERE json_type(c) = 'OBJECT')
"""

_ATTRIBUTES = (
    _SPANS
    + """, held AS (SELECT raw_id, span_id, CASE json_type(s->'attributes') WHEN 'VARCHAR' THEN CAST(s->>'attributes' AS JSON) ELSE s->'attributes' END AS a FROM tree),
each_ AS (SELECT raw_id, span_id, n AS name, a->>('$."' || n || '"') AS value FROM (SELECT *, unnest(json_keys(a)) AS n FROM held WHERE json_type(a) = 'OBJECT')
  UNION ALL SELECT raw_id, span_id, coalesce(x->>'key', x->>'name'), x->>'value' FROM (SELECT raw_id, span_id, unnest(CAST(a AS JSON[])) AS x FROM held WHERE json_type(a) = 'ARRAY') WHERE json_type(x) = 'OBJECT')
SELECT raw_id, span_id, name, value FROM each_ WHERE name IN ('method', 'clientAddr')
"""
)


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": "SELECT DISTINCT source, seq FROM (SELECT source, seq FROM timed_obs GROUP BY ALL HAVING count(*) > 1 UNION ALL SELECT source, seq FROM timed_probe GROUP BY ALL HAVING count(*) > 1)",
        "p1_once": _ONCE,
        "p3_found": _JOURNAL + "SELECT flow_id, pos FROM x WHERE t < clock - lateness_us",
        "p3_period_counts": _JOURNAL
        + """SELECT flow_id, CAST(floor(t / period_us) AS BIGINT) * period_us AS period_start_us,
            count(*) FILTER (clock IS NULL OR t >= clock - lateness_us) AS rows,
            count(*) FILTER (t >= clock - lateness_us AND clock >= (t // period_us + 1) * period_us) AS corrections,
            count(*) FILTER (t < clock - lateness_us) AS refused FROM x GROUP BY ALL""",
        "p5_found": _SPANS + "SELECT DISTINCT raw_id, conn_key, span_id, parent_span_id FROM tree",
        "p5_attributes": _ATTRIBUTES,
        "p6_found": _COPIES + f"SELECT DISTINCT id, field FROM ({_FIELDS} UNION ALL SELECT id, 'missing_right', NULL, NULL FROM l WHERE id NOT IN (SELECT id FROM r) UNION ALL SELECT id, 'missing_left', NULL, NULL FROM r WHERE id NOT IN (SELECT id FROM l))",
        "p6_values": _COPIES
        + f"""{_FIELDS} UNION ALL SELECT id, 'missing_right', NULL, NULL FROM l WHERE id NOT IN (SELECT id FROM r) UNION ALL SELECT id, 'missing_left', NULL, NULL FROM r WHERE id NOT IN (SELECT id FROM l)
            UNION ALL SELECT l.id, 'copies', CAST(l.n AS VARCHAR), CAST(r.n AS VARCHAR) FROM l JOIN r ON l.id = r.id AND l.account IS NOT DISTINCT FROM r.account AND l.amount IS NOT DISTINCT FROM r.amount
              AND l.value_date IS NOT DISTINCT FROM r.value_date AND l.reference IS NOT DISTINCT FROM r.reference AND l.currency IS NOT DISTINCT FROM r.currency WHERE l.n <> r.n""",
    }
