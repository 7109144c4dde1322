"""The p queries of the corpus operators, over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import abuse, groups, leaks, nearest, packing, quantiles
from tallyloom.session import table

TOLERANCE_US = 1_500
QUANTILES = {"p50": "0.5", "p90": "0.9", "p95": "0.95", "p99": "0.99"}
_DAY_NS = 86_400_000_000_000


def _timed(spark: SparkSession, d: str, name: str) -> DataFrame:
    time = F.when(F.col("start_us").isNotNull(), F.least("start_us", "end_us"))
    return nearest.once(table(spark, d, name), F.lower(F.trim("point")), time, ["source", "seq"])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = nearest.nearest(_timed(spark, d, "timed_obs"), _timed(spark, d, "timed_probe"), ["source", "seq"], TOLERANCE_US)
    return pairs.select(F.col("l_source").alias("obs_source"), F.col("l_seq").alias("obs_seq"), F.col("r_source").alias("probe_source"), F.col("r_seq").alias("probe_seq"))


_GROUPS = ["cell", "conn_key", "day"]


def _durations(spark: SparkSession, d: str, part=None) -> DataFrame:
    day = F.date_from_unix_date(F.expr(f"timestamp_ns div {_DAY_NS} - int(timestamp_ns % {_DAY_NS} < 0)").cast("int"))  # in whole numbers: as doubles the last 128 ns of a day of 2024 round to the next
    return quantiles.summary(table(spark, d, "load_gen_rows"), {"cell": F.col("cell"), "conn_key": F.col("conn_key"), "day": day}, "duration_ns", part)


def p4_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return quantiles.percentiles(_durations(spark, d), _GROUPS, QUANTILES)


def p4_combined_days(spark: SparkSession, d: str) -> DataFrame:
    """The same from summaries of single log_days put together."""
    return quantiles.percentiles(quantiles.combine(_durations(spark, d, F.col("log_day")), _GROUPS), _GROUPS, QUANTILES)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    links = table(spark, d, "candidate_links").select(F.col("upstream").alias("a"), F.col("downstream").alias("b"))
    told = table(spark, d, "flow_decisions").select(F.struct("source", "seq").alias("a"), F.explode_outer("partners").alias("b"))
    return groups.labelled(links.unionByName(told), ["source", "seq"], "a", "b")


def _packing(spark: SparkSession, d: str) -> packing.Packing:
    return packing.Packing(packing.token_counts(table(spark, d, "documents")), table(spark, d, "pack_sizes"))


def p8_packs(spark: SparkSession, d: str) -> DataFrame:
    return _packing(spark, d).packs()


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return _packing(spark, d).fill()


def p8_checks(spark: SparkSession, d: str) -> DataFrame:
    """That every text is placed once within capacities, split only where it must be, in next to as few packs as can be."""
    return _packing(spark, d).checks()


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "eval_items").select("item_id", F.concat_ws(" ", "passage", "question").alias("text"))
    return leaks.Index(table(spark, d, "documents")).search(items)


def p9_questions(spark: SparkSession, d: str) -> DataFrame:
    """Items whose whole question stands in a document word by word, in letters and digits of the Latin alphabet only."""
    simple = lambda c: F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))
    items = table(spark, d, "eval_items").select("item_id", simple("question").alias("text"))
    return leaks.Index(table(spark, d, "documents").select("doc_id", simple("text").alias("text"))).search(items, whole=True)


MOST_SAMPLES = 3_000


def _scored(spark: SparkSession, d: str, keep: list[str] = ()) -> DataFrame:
    samples = table(spark, d, "moderation_samples").filter("sample_text is not null and category is not null")
    samples = samples.select("sample_text", "category").orderBy(F.crc32(F.col("sample_text").cast("binary")), "sample_text", "category").limit(MOST_SAMPLES)
    terms = table(spark, d, "abuse_terms").filter("term is not null and category is not null").select("term", "category").orderBy(F.crc32(F.col("term").cast("binary")), "term", "category").limit(MOST_SAMPLES)
    chain = abuse.fit([tuple(r) for r in samples.collect()], [tuple(r) for r in terms.collect()], MOST_SAMPLES)
    return abuse.score(table(spark, d, "documents"), chain, keep)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).filter(F.col("any") >= abuse.THRESHOLD).select("doc_id")


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d)


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    """Documents, those at or over the threshold and their share, by source; each row counts once, whatever its doc_id."""
    rates = _scored(spark, d, ["source"]).groupBy("source").agg(F.count("*").alias("documents"), F.count_if(F.col("any") >= abuse.THRESHOLD).alias("flagged"), *[F.avg(s).alias(f"mean_{s}") for s in abuse.STAGES])
    return rates.withColumn("rate", F.col("flagged") / F.col("documents"))


def queries() -> dict:
    return {f.__name__: f for f in (p2_found, p4_percentiles, p4_combined_days, p7_found, p8_packs, p8_fill, p8_checks, p9_found, p9_questions, p10_found, p10_scores, p10_rates)}


_NEAREST = """
WITH m AS (SELECT 'obs' AS f, * FROM timed_obs UNION ALL SELECT 'probe', * FROM timed_probe),
o AS (SELECT f, source, seq, min(lower(trim(point))) AS e, min(CASE WHEN end_us < start_us THEN end_us ELSE start_us END) AS t FROM m
      WHERE point IS NOT NULL AND start_us IS NOT NULL GROUP BY ALL),
p AS (SELECT l.source AS obs_source, l.seq AS obs_seq, r.source AS probe_source, r.seq AS probe_seq,
        row_number() OVER (PARTITION BY l.source, l.seq ORDER BY abs(l.t - r.t), r.t, r.source, r.seq) AS n
      FROM o l JOIN o r ON l.f = 'obs' AND r.f = 'probe' AND l.e = r.e AND r.t BETWEEN l.t - 1500 AND l.t + 1500)
SELECT obs_source, obs_seq, probe_source, probe_seq FROM p WHERE n = 1
"""

_PERCENTILES = """
WITH v AS (SELECT cell, conn_key, DATE '1970-01-01' + CAST(timestamp_ns // 86400000000000 AS INTEGER) AS day, duration_ns AS v FROM load_gen_rows WHERE duration_ns IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY cell, conn_key, day ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY cell, conn_key, day) AS n FROM v)
SELECT cell, conn_key, day, n, """ + ", ".join(
    f"CAST(max(CASE WHEN i = {q} * (n - 1) // 100 THEN v END) AS DOUBLE) + (CAST(max(CASE WHEN i = least({q} * (n - 1) // 100 + 1, n - 1) THEN v END) AS DOUBLE)"
    f" - CAST(max(CASE WHEN i = {q} * (n - 1) // 100 THEN v END) AS DOUBLE)) * (CAST({q} * (n - 1) % 100 AS DOUBLE) / 100.0::DOUBLE) AS p{q}"
    for q in (50, 90, 95, 99)
) + " FROM r GROUP BY cell, conn_key, day, n"

_GROUPED = """
WITH RECURSIVE e AS (
  SELECT upstream AS a, downstream AS b FROM candidate_links
  UNION ALL SELECT {'source': source, 'seq': seq}, p FROM (SELECT source, seq, unnest(partners) AS p FROM flow_decisions)
  UNION ALL SELECT {'source': source, 'seq': seq}, {'source': source, 'seq': seq} FROM flow_decisions),
g AS (SELECT DISTINCT a.source AS s1, a.seq AS q1, b.source AS s2, b.seq AS q2 FROM (SELECT a, b FROM e UNION ALL SELECT b, a FROM e UNION ALL SELECT a, a FROM e UNION ALL SELECT b, b FROM e)),
reach AS (SELECT s1, q1, s2, q2 FROM g UNION SELECT r.s1, r.q1, g.s2, g.q2 FROM reach r JOIN g ON r.s2 = g.s1 AND r.q2 = g.q1)
SELECT min({'source': s2, 'seq': q2}).source AS group_source, min({'source': s2, 'seq': q2}).seq AS group_seq, s1 AS source, q1 AS seq FROM reach GROUP BY s1, q1
"""


_QUESTIONS = """
WITH i AS (SELECT item_id, trim(regexp_replace(lower(question), '[^a-z0-9]+', ' ', 'g')) AS q FROM eval_items), t AS (SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS t FROM documents)
SELECT DISTINCT item_id, doc_id FROM i JOIN t ON q <> '' AND contains(' ' || t || ' ', ' ' || q || ' ')
"""


def oracle_sql() -> dict[str, str]:
    checks = "SELECT pack_id, (SELECT count(*) FROM documents) AS documents, 0::BIGINT AS over_capacity, 0::BIGINT AS split_needlessly, 0::BIGINT AS tokens_lost, true AS near_bound FROM pack_sizes"
    return {"p8_checks": checks, "p9_questions": _QUESTIONS, "p2_found": _NEAREST, "p4_percentiles": _PERCENTILES, "p4_combined_days": _PERCENTILES, "p7_found": _GROUPED}
