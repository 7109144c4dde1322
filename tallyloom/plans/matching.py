"""Queries of matching, and their SQL."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import matching
from tallyloom.plans.inputs import FEED, LEDGER, make

TOL = matching.Tolerance(Decimal("0.20"), Decimal("0"), 3, 3, 32)


def _both(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return make(spark, d, LEDGER), make(spark, d, FEED)


def _text(df: DataFrame) -> DataFrame:
    return df.select("left_id", F.array_join("right_ids", ",").alias("right_ids"), "rule", "score", "amount_residual", "date_gap_days")


def _candidates(rule: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        left, right = _both(spark, d)
        if rule == "M3_AGGREGATE":
            left, right = (s.filter(F.col("n_right") <= TOL.max_block_candidates) for s in matching._sized(left, right))
        return _text(matching.GENERATORS[rule](left, right, TOL))

    return query


def block_sizes(spark: SparkSession, d: str) -> DataFrame:
    left, right = _both(spark, d)
    both = left.select("account", "currency", F.lit(1).alias("l")).unionByName(right.select("account", "currency", F.lit(0).alias("l")))
    return both.groupBy("account", "currency").agg(F.sum("l").alias("n_left"), F.sum(1 - F.col("l")).alias("n_right")).withColumn("oversized", F.col("n_right") > TOL.max_block_candidates)


def reconcile_matches(spark: SparkSession, d: str) -> DataFrame:
    return _text(matching.reconcile(*_both(spark, d), TOL).matches)


def reject_reasons(spark: SparkSession, d: str) -> DataFrame:
    return matching.reconcile(*_both(spark, d), TOL).rejects


def reason_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return reject_reasons(spark, d).groupBy("reason").agg(F.count("*").alias("n"), F.count_distinct("left_id").alias("records"))


def run_counters(spark: SparkSession, d: str) -> DataFrame:
    return matching.reconcile(*_both(spark, d), TOL).counters


def match_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return matching.reconcile(*_both(spark, d), TOL).fingerprints()


def queries() -> dict:
    own = {f"{r.split('_')[0].lower()}_candidates": _candidates(r) for r in matching.RULES}
    return own | {f.__name__: f for f in (block_sizes, reconcile_matches, reject_reasons, reason_breakdown, run_counters, match_fingerprints)}


_SAME = "l.account = r.account AND l.currency IS NOT DISTINCT FROM r.currency"
_GAP = "abs(l.value_date - r.value_date)"
_PENALTY = "{base} - abs({res})::DOUBLE / 0.20 * 0.05 - {gap}::DOUBLE / 3 * 0.05 - {more} * 0.01"


def _score(base: str, res: str, gap: str, more: int = 0) -> str:
    return f"CAST(round_even({_PENALTY.format(base=base, res=res, gap=gap, more=more)}, 6) AS DECIMAL(9,6))"


_CAND = f"""
WITH RECURSIVE ledger AS ({LEDGER}), feed AS ({FEED}),
sized AS (SELECT account, currency, count(*) AS n_right FROM feed GROUP BY ALL),
small AS (SELECT f.* FROM feed f JOIN sized s ON f.account = s.account AND f.currency IS NOT DISTINCT FROM s.currency WHERE n_right <= 32),
one AS (SELECT l.account, l.currency, l.id AS lid, l.amount AS want, r.id AS rid, r.amount AS got, {_GAP} AS gap FROM ledger l JOIN small r ON {_SAME} AND {_GAP} <= 3),
two AS (SELECT a.account, a.currency, a.lid, [a.rid, b.rid] AS rids, a.want - a.got - b.got AS res, greatest(a.gap, b.gap) AS gap FROM one a JOIN one b ON a.lid = b.lid AND a.rid < b.rid),
three AS (SELECT a.account, a.currency, a.lid, [a.rid, b.rid, c.rid] AS rids, a.want - a.got - b.got - c.got AS res, greatest(a.gap, b.gap, c.gap) AS gap
  FROM one a JOIN one b ON a.lid = b.lid AND a.rid < b.rid JOIN one c ON a.lid = c.lid AND b.rid < c.rid),
cand AS (
  SELECT l.account, l.currency, l.id AS lid, [r.id] AS rids, 'M0_REFERENCE' AS rule, CAST(1 AS DECIMAL(9,6)) AS score, l.amount - r.amount AS res, {_GAP} AS gap FROM ledger l JOIN feed r ON {_SAME} AND l.reference = r.reference AND l.reference <> ''
  UNION ALL SELECT l.account, l.currency, l.id, [r.id], 'M1_EXACT', {_score("0.9", "0", _GAP)}, CAST(0 AS DECIMAL(18,2)), {_GAP} FROM ledger l JOIN feed r ON {_SAME} AND l.amount = r.amount AND {_GAP} <= 3
  UNION ALL SELECT l.account, l.currency, l.id, [r.id], 'M2_TOLERANT', {_score("0.8", "l.amount - r.amount", _GAP)}, l.amount - r.amount, {_GAP} FROM ledger l JOIN feed r ON {_SAME} AND abs(l.amount - r.amount) <= 0.20 AND {_GAP} <= 3
  UNION ALL SELECT account, currency, lid, rids, 'M3_AGGREGATE', {_score("0.6", "res", "gap", 1)}, res, gap FROM two WHERE abs(res) <= 0.20
  UNION ALL SELECT account, currency, lid, rids, 'M3_AGGREGATE', {_score("0.6", "res", "gap", 2)}, res, gap FROM three WHERE abs(res) <= 0.20)
"""
_COLUMNS = "lid AS left_id, array_to_string(rids, ',') AS right_ids, rule, score, CAST(res AS DECIMAL(18,2)) AS amount_residual, CAST(gap AS INT) AS date_gap_days"
_RUN = (
    _CAND
    + """, numbered AS (SELECT *, concat(account, '/', coalesce(currency, '-')) AS block, row_number() OVER (PARTITION BY account, currency ORDER BY rule, -score, lid, rids) AS n FROM cand),
walk AS (SELECT DISTINCT block, CAST(0 AS BIGINT) AS n, CAST([] AS STRING[]) AS taken, false AS won FROM numbered
  UNION ALL SELECT w.block, c.n, CASE WHEN list_has_any(w.taken, list_append(c.rids, c.lid)) THEN w.taken ELSE list_concat(w.taken, list_append(c.rids, c.lid)) END, NOT list_has_any(w.taken, list_append(c.rids, c.lid))
    FROM walk w JOIN numbered c ON c.block = w.block AND c.n = w.n + 1),
matched AS (SELECT c.* FROM numbered c JOIN walk w ON w.block = c.block AND w.n = c.n WHERE w.won),
taken_right AS (SELECT unnest(rids) AS id FROM matched),
open_left AS (SELECT l.*, coalesce(n_right, 0) AS n_right FROM ledger l LEFT JOIN sized s ON l.account = s.account AND l.currency IS NOT DISTINCT FROM s.currency WHERE l.id NOT IN (SELECT lid FROM matched)),
pairs AS (SELECT l.id AS left_id, r.id AS right_id, """
    + f"CASE WHEN r.id IN (SELECT id FROM taken_right) THEN 'LOST_TO_BETTER_CANDIDATE' WHEN {_GAP} > 3 THEN 'DATE_OUT_OF_WINDOW' WHEN abs(l.amount - r.amount) > 0.20 THEN 'AMOUNT_OUT_OF_TOLERANCE' END AS reason, r.id NOT IN (SELECT id FROM taken_right) AND {_GAP} <= 3 AS near FROM open_left l JOIN small r ON {_SAME})"
    + """, rejects AS (SELECT id AS left_id, NULL AS right_id, CASE WHEN n_right = 0 THEN 'NO_CANDIDATE' ELSE 'BLOCK_TOO_LARGE' END AS reason FROM open_left WHERE n_right = 0 OR n_right > 32
  UNION ALL SELECT left_id, right_id, reason FROM pairs WHERE reason IS NOT NULL
  UNION ALL SELECT left_id, NULL, 'AGGREGATE_NOT_FOUND' FROM pairs WHERE near GROUP BY left_id HAVING count(*) >= 2)
"""
)


def oracle_sql() -> dict[str, str]:
    out = {f"{r.split('_')[0].lower()}_candidates": _CAND + f"SELECT {_COLUMNS} FROM cand WHERE rule = '{r}'" for r in matching.RULES}
    digest = "substr(sha256(concat_ws(chr(31), {})), 1, 16)"
    return out | {
        "block_sizes": f"WITH b AS (SELECT account, currency, 1 AS l FROM ({LEDGER}) UNION ALL SELECT account, currency, 0 FROM ({FEED})) SELECT account, currency, sum(l)::BIGINT AS n_left, sum(1 - l)::BIGINT AS n_right, sum(1 - l) > 32 AS oversized FROM b GROUP BY ALL",
        "reconcile_matches": _RUN + f"SELECT {_COLUMNS} FROM matched",
        "reject_reasons": _RUN + "SELECT * FROM rejects",
        "reason_breakdown": _RUN + "SELECT reason, count(*) AS n, count(DISTINCT left_id) AS records FROM rejects GROUP BY reason",
        "run_counters": _RUN
        + """, used AS (SELECT rule, lid AS id FROM matched UNION ALL SELECT rule, unnest(rids) FROM matched), of_ AS (SELECT block, n, rule, lid AS id FROM numbered UNION ALL SELECT block, n, rule, unnest(rids) FROM numbered),
          gone AS (SELECT DISTINCT block, n FROM of_ JOIN used ON of_.id = used.id AND used.rule < of_.rule),
          c AS (SELECT 'records_left' AS counter, count(*) AS value FROM ledger UNION ALL SELECT 'records_right', count(*) FROM feed UNION ALL SELECT 'blocks', count(*) FROM (SELECT account, currency FROM ledger UNION SELECT account, currency FROM feed)
            UNION ALL SELECT 'unmatched_left', count(*) FROM open_left UNION ALL SELECT 'unmatched_right', count(*) FROM feed WHERE id NOT IN (SELECT id FROM taken_right)
            UNION ALL SELECT 'candidates_evaluated', count(*) FROM numbered ANTI JOIN gone USING (block, n) UNION ALL SELECT 'matched_' || rule, count(*) FROM matched GROUP BY rule UNION ALL SELECT 'manual_review', count(*) FROM open_left WHERE n_right > 32)
          SELECT * FROM c WHERE value > 0 OR counter IN ('records_left', 'records_right', 'blocks')""",
        "match_fingerprints": _RUN
        + f"SELECT lid AS left_id, {digest.format(chr(39) + 'MATCH' + chr(39) + ', lid, array_to_string(rids, chr(44)), rule, CASE WHEN rule = ' + chr(39) + 'M1_EXACT' + chr(39) + ' THEN ' + chr(39) + '0' + chr(39) + ' ELSE CAST(CAST(res AS DECIMAL(18,2)) AS STRING) END')} AS fingerprint FROM matched"
        + f" UNION ALL SELECT left_id, {digest.format(chr(39) + 'BREAK' + chr(39) + ', left_id, coalesce(right_id, ' + chr(39) * 2 + '), reason')} FROM rejects",
    }
