"""Queries of the correlation journal, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import flow
from tallyloom.plans.correlation import PARAMS
from tallyloom.plans.inputs import SPANS, make
from tallyloom.session import table


def _told(spark: SparkSession, d: str) -> DataFrame:
    seen = F.col("kind") == "seen"
    return table(spark, d, "flow_journal").withColumn("time", F.when(seen, F.coalesce("at_us", "end_us")).otherwise(F.col("until_us")))


def _seen(spark: SparkSession, d: str) -> DataFrame:
    own = _told(spark, d).filter("kind = 'seen' and time is not null and flow_id is not null and source is not null and seq is not null")
    first = own.groupBy("flow_id", "source", "seq").agg(F.min_by(F.struct("pos", "point", "side", "keys", "time"), "pos").alias("f"))
    return first.select("flow_id", "source", "seq", "f.*")


def _joins(spark: SparkSession, d: str) -> DataFrame:
    hops = table(spark, d, "candidate_links").select("hop").distinct().filter("hop like '% -> %'")
    ends = hops.select(F.col("hop").alias("place"), F.split("hop", " -> ").alias("e"), F.explode(F.array(F.lit(True), F.lit(False))).alias("authored"))
    return ends.select("place", F.array(F.when(F.col("authored"), "traceparent").otherwise("tuple5")).alias("keys"), "authored", F.col("e")[0].alias("up_point"), F.lit("outbound").alias("up_side"), F.col("e")[1].alias("down_point"), F.lit("inbound").alias("down_side"))


def flow_watermark(spark: SparkSession, d: str) -> DataFrame:
    return flow.timeline(_told(spark, d), table(spark, d, "flow_config")).select("flow_id", "pos", "mark")


def late_arrivals(spark: SparkSession, d: str) -> DataFrame:
    marks = flow.timeline(_told(spark, d), table(spark, d, "flow_config"))
    return _seen(spark, d).join(marks, ["flow_id", "pos"]).filter("time < mark_before").select("flow_id", "pos", "source", "seq")


def flow_decisions_final(spark: SparkSession, d: str) -> DataFrame:
    """Final decisions, and the last step of what is still open."""
    marks = flow.timeline(_told(spark, d), table(spark, d, "flow_config"))
    return flow.in_effect(flow.replay(_seen(spark, d), marks, table(spark, d, "flow_config"), _joins(spark, d)))


def flow_observed_once(spark: SparkSession, d: str) -> DataFrame:
    """How each observation of the journal ends: late, after its value was final, or by its place."""
    told = flow_decisions_final(spark, d)
    late = F.max((F.col("kind") == "LATE").cast("int"))
    return told.groupBy("flow_id", "source", "seq").agg(late.cast("boolean").alias("late")).filter("late").select("flow_id", "source", "seq")


def flow_refusals(spark: SparkSession, d: str) -> DataFrame:
    """What a strict reading of the journal refuses, by flow and reason."""
    told = flow.refused(table(spark, d, "flow_journal"), table(spark, d, "flow_config"))
    return told.filter("refusal is not null").groupBy("flow_id", "refusal").agg(F.count("*").alias("n"))


def signal_counts(spark: SparkSession, d: str) -> DataFrame:
    return flow_decisions_final(spark, d).filter("status = 'FINAL'").groupBy("place", "kind", "corroboration").agg(F.count("*").alias("n"))


def flow_timed_links(spark: SparkSession, d: str) -> DataFrame:
    """The timed join within a journal: two flows of spans in the order of their ends, with nothing late."""
    spans = make(spark, d, SPANS).withColumn("flow_id", F.concat(F.lit("f"), (F.floor(F.col("seq") / 5) % 2).cast("string")))
    crowded = (F.floor(F.col("seq") / 400) % 2 == 0).cast("long") * 970
    spans = spans.withColumns({c: F.col(c) - (F.col("seq") % 400) * crowded for c in ("start_us", "end_us")})
    odd = spans.select("flow_id", "source", "seq", F.lit("p").alias("point"), "side", F.when(F.col("seq") % 53 != 0, F.col("start_us")).alias("start_us"), F.when(F.col("seq") % 59 == 0, F.col("start_us") + 5_000).otherwise(F.col("end_us")).alias("end_us"))
    seen = odd.withColumn("time", F.col("end_us")).withColumn("pos", F.col("end_us") * 10_000_000 + F.col("seq") * 2 + F.when(F.col("side") == "inbound", 1).otherwise(0))
    marks = seen.select("flow_id", "pos", F.lit(None).cast("long").alias("mark_before"))
    return flow.timed(seen, marks, {"p -> p": ("p", "p")}, {"p -> p": PARAMS}, 2_000)


def queries() -> dict:
    return {f.__name__: f for f in (flow_watermark, late_arrivals, flow_decisions_final, flow_observed_once, flow_refusals, flow_timed_links, signal_counts)}


_MARKS = """
WITH j AS (SELECT flow_id, pos, source, seq, kind, CASE kind WHEN 'seen' THEN coalesce(at_us, end_us) ELSE until_us END AS t FROM flow_journal),
told AS (SELECT *, min(t) OVER (PARTITION BY flow_id ORDER BY pos) AS first_at FROM j WHERE t IS NOT NULL),
s AS (SELECT flow_id, lateness_us, unnest(sources) AS src FROM flow_config),
c AS (SELECT told.flow_id, told.pos, first_at, lateness_us, max(CASE WHEN told.source = s.src THEN told.t END) OVER (PARTITION BY told.flow_id, s.src ORDER BY told.pos) AS clock FROM told JOIN s USING (flow_id)),
m AS (SELECT flow_id, pos, min(coalesce(clock, first_at)) - any_value(lateness_us) AS mark FROM c GROUP BY ALL)
"""


def _timed() -> str:
    """Decided by flow as ``timing_links`` is; components are stars of at most two edges here too."""
    return f"""WITH s0 AS (SELECT source, seq, side, concat('f', (seq // 5) % 2) AS flow_id, start_us - (seq % 400) * (CASE WHEN (seq // 400) % 2 = 0 THEN 970 ELSE 0 END) AS start_us,
  end_us - (seq % 400) * (CASE WHEN (seq // 400) % 2 = 0 THEN 970 ELSE 0 END) AS end_us FROM ({SPANS})),
s AS (SELECT source, seq, side, flow_id, CASE WHEN seq % 53 <> 0 THEN start_us END AS start_us, CASE WHEN seq % 59 = 0 THEN start_us + 5000 ELSE end_us END AS end_us FROM s0),
k AS (SELECT *, CASE WHEN start_us IS NULL THEN 'TIME_ABSENT' WHEN end_us - start_us > 2000 THEN 'TOO_LONG' END AS out FROM s), ok AS (SELECT * FROM k WHERE out IS NULL),
pairs AS (SELECT u.flow_id, u.source AS us, u.seq AS uq, d.source AS ds, d.seq AS dq, 1 + 20 - abs(d.start_us - u.start_us - 55) + 30 - abs(u.end_us - d.end_us - 20) AS w
  FROM ok u JOIN ok d ON u.flow_id = d.flow_id AND u.side = 'outbound' AND d.side = 'inbound' AND d.start_us BETWEEN u.start_us + 35 AND u.start_us + 75 AND u.end_us - d.end_us BETWEEN -10 AND 50),
o AS (SELECT *, count(start_us) OVER (PARTITION BY flow_id, side ORDER BY start_us RANGE BETWEEN 1500 PRECEDING AND 1500 FOLLOWING) - 1 AS others FROM ok),
e AS (SELECT *, greatest(count(*) OVER (PARTITION BY flow_id, uq), count(*) OVER (PARTITION BY flow_id, dq)) AS n, greatest(max(w) OVER (PARTITION BY flow_id, uq), max(w) OVER (PARTITION BY flow_id, dq)) AS best,
  least(min(w) OVER (PARTITION BY flow_id, uq), min(w) OVER (PARTITION BY flow_id, dq)) AS low FROM pairs),
r AS (SELECT flow_id, us AS source, uq AS seq, ds AS ps, dq AS pq, w, n, best, low FROM e UNION ALL SELECT flow_id, ds, dq, us, uq, w, n, best, low FROM e),
t AS (SELECT flow_id, source, seq, bool_or(CASE WHEN n = 1 THEN best <= 2 ELSE best - low <= 2 END) AS unsure, max(CASE WHEN w = best THEN {{'s': ps, 'q': pq, 'w': w}} END) AS p FROM r GROUP BY ALL),
m AS (SELECT o.*, t.p, CASE WHEN t.source IS NULL THEN 'NO_CANDIDATE' WHEN unsure THEN 'AMBIGUOUS' WHEN p IS NULL THEN 'UNMATCHED' ELSE 'MATCHED' END AS status FROM o LEFT JOIN t USING (flow_id, source, seq)),
f AS (SELECT m.flow_id, m.source, m.seq, m.p, CASE WHEN m.status = 'MATCHED' AND greatest(m.others, b.others) * 20000 > 60000 THEN 'DENSE' ELSE m.status END AS status FROM m LEFT JOIN o b ON b.flow_id = m.flow_id AND b.source = m.p.s AND b.seq = m.p.q),
z AS (SELECT flow_id, source, seq, status, p FROM f UNION ALL SELECT flow_id, source, seq, out, NULL FROM k WHERE out IS NOT NULL)
SELECT flow_id, 'p -> p' AS place, source, seq, CASE status WHEN 'MATCHED' THEN 'LINKED' ELSE 'UNDECIDED' END AS kind, CASE WHEN status <> 'MATCHED' THEN status END AS reason,
  CASE status WHEN 'MATCHED' THEN p.s END AS partner_source, CASE status WHEN 'MATCHED' THEN p.q END AS partner_seq, CASE status WHEN 'MATCHED' THEN p.w END AS weight FROM z"""


def oracle_sql() -> dict[str, str]:
    late = (
        _MARKS
        + """, b AS (SELECT flow_id, pos, lag(mark) OVER (PARTITION BY flow_id ORDER BY pos) AS mark_before FROM m),
        f AS (SELECT flow_id, source, seq, min(pos) AS pos, arg_min(t, pos) AS t FROM told WHERE kind = 'seen' GROUP BY ALL)
        SELECT f.flow_id, f.pos, f.source, f.seq FROM f JOIN b USING (flow_id, pos) WHERE t < mark_before"""
    )
    return {
        "flow_observed_once": f"SELECT flow_id, source, seq FROM ({late})",
        "flow_refusals": """WITH j AS (SELECT j.*, list_contains(c.sources, j.source) AS known FROM flow_journal j LEFT JOIN flow_config c USING (flow_id)),
          r AS (SELECT flow_id, CASE WHEN kind IS NULL OR kind NOT IN ('seen', 'advance') THEN 'unknown kind' WHEN NOT coalesce(known, false) THEN 'undeclared source' WHEN kind = 'advance' AND until_us IS NULL THEN 'no time'
            WHEN kind = 'advance' THEN NULL WHEN start_us IS NULL AND end_us IS NULL AND at_us IS NULL THEN 'no time' WHEN (start_us IS NULL) <> (end_us IS NULL) THEN 'start and end are given together, or not at all'
            WHEN end_us < start_us THEN 'ends before it starts' WHEN end_us IS NOT NULL AND at_us IS DISTINCT FROM end_us THEN 'happens at its end if it is timed' END AS refusal FROM j)
          SELECT flow_id, refusal, count(*) AS n FROM r WHERE refusal IS NOT NULL GROUP BY ALL""",
        "flow_timed_links": _timed(),
        "flow_watermark": _MARKS + "SELECT * FROM m",
        "late_arrivals": late,
    }
