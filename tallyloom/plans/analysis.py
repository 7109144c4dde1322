"""Queries over request logs, decisions and journals, and their SQL."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.durations import duration_ns
from tallyloom.operators import analyses, gates, observe, replay, runs
from tallyloom.operators.matching import Tolerance
from tallyloom.plans.inputs import ARRIVALS, DECISIONS, FEED, LEDGER, STATES, make
from tallyloom.plans.matching import _GAP, _RUN, _SAME
from tallyloom.session import table

DRIFT = observe.DriftRule(reference_days=5, min_decisions=5, margin=Decimal("0.01"))


def _rows(spark: SparkSession, d: str, side: str) -> DataFrame:
    return table(spark, d, "load_gen_rows").filter(F.col("side") == side)


def _traced(df: DataFrame) -> DataFrame:
    return df.filter(~analyses.no_trace(F.col("trace_id")))


def ordinal_join(spark: SparkSession, d: str) -> DataFrame:
    out = analyses.ordinal_join(_traced(_rows(spark, d, "load-gen")), _traced(_rows(spark, d, "fake-upstream")), ["cell", "conn_key", "stream_id"], "trace_id")
    return out.groupBy("cell", "outcome").agg(F.count("*").alias("n"))


def shuffled_control(spark: SparkSession, d: str) -> DataFrame:
    """Traces moved among the requests of all cells: none is lost or made up, and next to none stays with its request."""
    own = _traced(_rows(spark, d, "load-gen")).groupBy("trace_id").agg(F.min(F.struct("timestamp_ns", "stream_id")).alias("m")).select("trace_id", "m.*")
    moved = analyses.shuffled(own, "trace_id", ["timestamp_ns", "stream_id", "trace_id"], 7)
    before = own.select("trace_id", F.col("timestamp_ns").alias("t"), F.col("stream_id").alias("s"))
    both = moved.join(before, "trace_id", "full")
    return both.agg(F.count("*").alias("n"), F.count_if(F.col("timestamp_ns").isNull() | F.col("t").isNull()).alias("lost"), (F.count_if((F.col("timestamp_ns") == F.col("t")) & F.col("stream_id").eqNullSafe(F.col("s"))) * 100 < F.count("*")).alias("unlinked"))


def self_authored_rate(spark: SparkSession, d: str) -> DataFrame:
    """Upstream rows whose trace no load-generator row of the cell sent."""
    known = _traced(_rows(spark, d, "load-gen")).select("cell", "trace_id").distinct().withColumn("_known", F.lit(True))
    seen = _traced(_rows(spark, d, "fake-upstream")).join(known, ["cell", "trace_id"], "left")
    return analyses.rate_of(seen, ["cell"], F.col("_known").isNull())


def delay_quantiles(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "load_gen_rows").withColumn("wait_us", F.floor((F.col("timestamp_ns") - F.col("arrival_ns")) / 1000))
    return analyses.floor_index(rows.filter("side = 'fake-upstream'"), ["cell"], "wait_us", {"p50": "0.5", "p99": "0.99"})


def percentile_nearest_rank(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "load_gen_rows").filter("duration_ns is not null")
    return runs.order_statistics(rows, ["protocol"], "duration_ns", {n: ("nearest", p) for n, p in (("p50", "0.5"), ("p95", "0.95"), ("p99", "0.99"))})


def freeze_detection(spark: SparkSession, d: str) -> DataFrame:
    """At the usual bounds, with time run through ten million times as fast: the rows of a day are few."""
    rows = _rows(spark, d, "load-gen").filter("duration_ns is not null")
    return analyses.freezes(rows, F.floor(F.col("duration_ns") / 1000), F.floor(F.col("timestamp_ns") / 10_000_000), ["cell"])


def tuple_generations(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "load_gen_rows").select("cell", "conn_key", "timestamp_ns", "stream_id", "side", "trace_id")
    return analyses.generations(rows, ["conn_key"], ["timestamp_ns", "stream_id", "side", "trace_id", "cell"])


def id_consistency(spark: SparkSession, d: str) -> DataFrame:
    return analyses.id_consistency(_rows(spark, d, "load-gen").select(F.col("trace_id").alias("id")), _rows(spark, d, "fake-upstream").select(F.col("trace_id").alias("id")))


def rank_bucket_match(spark: SparkSession, d: str) -> DataFrame:
    sides = _ranked_orders(spark, d)
    return analyses.bucket_match(*sides, "measure", F.lit(2_000).cast("decimal(18,2)"))


def sliding_window_match(spark: SparkSession, d: str) -> DataFrame:
    """By month."""
    sides = _ranked_orders(spark, d, ["month"])
    return analyses.window_match(*sides, "measure", F.lit(2_000).cast("decimal(18,2)"), 5, ["month"])


def _ranked_orders(spark: SparkSession, d: str, by: list[str] = ()) -> list[DataFrame]:
    out = []
    for sql in (LEDGER, FEED):
        rows = make(spark, d, sql).select("id", "value_date", F.trunc("value_date", "month").alias("month"), F.col("amount").alias("measure"))
        out.append(analyses.rank_buckets(rows, ["value_date", "id"], 10, by))
    return out


def pairs_in_order(spark: SparkSession, d: str) -> DataFrame:
    """Ledger and feed entries of an account paired in time order, where both have as many."""
    sides = [make(spark, d, sql).select("account", "value_date", "id") for sql in (LEDGER, FEED)]
    return analyses.paired_in_order(*sides, ["account"], ["value_date", "id"], ["id"])


def hop_score(spark: SparkSession, d: str) -> DataFrame:
    """Candidate links scored against decided ones, by hop."""
    links = table(spark, d, "candidate_links").groupBy("hop", "upstream").agg(F.min("downstream").alias("down")).select(F.col("hop").alias("place"), F.col("upstream").alias("up"), "down")
    told = table(spark, d, "flow_decisions").filter("kind = 'LINKED' and size(partners) > 0")
    truth = told.groupBy(F.col("hop").alias("place"), F.struct("source", "seq").alias("up")).agg(F.min(F.col("partners")[0]).alias("down"))
    return analyses.link_score(links, truth)


def _counts(spark: SparkSession, d: str) -> DataFrame:
    return make(spark, d, DECISIONS).groupBy("side", "source", "day", "outcome", "forced").agg(F.count("*").alias("n"))


def series(spark: SparkSession, d: str) -> DataFrame:
    """Final decisions, of which counterparts take the rule of the left record that leads them."""
    decided = make(spark, d, STATES)
    return observe.series(decided.select("side", "id", "status", "reason", "input_ids", "forced"), decided.select("side", "id", "source", "day"))


def drift_verdicts(spark: SparkSession, d: str) -> DataFrame:
    out = observe.drift_verdicts(_counts(spark, d), "M0_REFERENCE", DRIFT)
    return out.select("side", "source", "day", "hits", "total", "ref_hits", "ref_total", "verdict", F.col("upper").cast("double").alias("upper"))


def undecided_jump(spark: SparkSession, d: str) -> DataFrame:
    drift = observe.DriftRule(reference_days=5, min_decisions=5, margin=Decimal("0"), z=Decimal("0.2"))
    return observe.undecided_jumps(_counts(spark, d), drift).select("side", "source", "day", "hits", "total", "ref_hits", "ref_total")


def _origins(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "recon_records").filter("captured_at is not null")
    own = own.withColumn("day", observe.capture_day(own, "captured_at"))
    return own.groupBy("side", "id").agg(F.min(F.struct("day", "adapter_version")).alias("o")).select("side", "id", F.col("o.adapter_version").alias("source"), F.col("o.day").alias("day"))


def _arrivals(spark: SparkSession, d: str) -> DataFrame:
    return make(spark, d, ARRIVALS)


def silent_sources(spark: SparkSession, d: str) -> DataFrame:
    return observe.silent_sources(_arrivals(spark, d), observe.EvidenceRule()).select("side", "source", "last_day", "end_day", "silent_days")


def alerts(spark: SparkSession, d: str) -> DataFrame:
    """Everything that deserves attention, in the order of days and kinds, without its text."""
    failures = table(spark, d, "recon_records").filter("currency is null").select("side", F.col("adapter_version").alias("source"), F.to_date("captured_at").alias("day"))
    origins = _origins(spark, d).unionByName(_arrivals(spark, d).select("side", "id", "source", "day"))
    told = observe.alerts(_counts(spark, d), origins, failures, ["M0_REFERENCE"], DRIFT, observe.EvidenceRule())
    return observe.in_order(told).select("kind", "side", "source", "day")


def capture_failures(spark: SparkSession, d: str) -> DataFrame:
    failures = table(spark, d, "recon_records").filter("currency is null").select("side", F.col("adapter_version").alias("source"), F.to_date("captured_at").alias("day"))
    return observe.capture_failures(_origins(spark, d), failures, DRIFT, observe.EvidenceRule()).select("side", "source", "day", "failed", "total")


def latency_gate(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select(F.concat(F.lit("n"), (F.col("user_id") % 3).cast("string")).alias("node"), F.col("event_id").cast("double").alias("event_time"), (F.col("event_id") + (F.col("event_id") % 100) / 125.0).cast("double").alias("ingest_time"))
    skew = spark.createDataFrame([("n0", 0.0), ("n1", -0.25), ("n2", -0.5)], "node string, skew_s double")
    # the clock of n1 is a quarter of a second behind, so its events happened later than it says
    shifted = events.withColumn("event_time", F.col("event_time") + F.when(F.col("node") == "n1", -0.25).when(F.col("node") == "n2", -0.5).otherwise(0.0))
    return gates.latency_gate(gates.availability(shifted, skew))


def stability_spreads(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("rep", F.col("event_id") % 5).withColumn("seed", F.when(F.col("user_id") % 2 == 0, "fixed").otherwise("variable"))
    reps = e.groupBy("seed", "rep").agg(F.count("*").alias("ops"), F.count_if(F.col("event_type") == "view").alias("a"), F.count_if(F.col("event_id") % 2 == 0).alias("b"))
    long = reps.select("seed", "rep", "ops", F.explode(F.array(F.struct(F.lit("a").alias("metric"), F.col("a").alias("k")), F.struct(F.lit("b").alias("metric"), F.col("b").alias("k")))).alias("m"))
    return gates.spreads(long.select("seed", "rep", "ops", "m.metric", F.round(F.col("m.k").cast("decimal(18,6)") / F.col("ops").cast("decimal(18,6)"), 4).cast("decimal(10,4)").alias("value")))


def _journal(spark: SparkSession, d: str) -> DataFrame:
    both = make(spark, d, LEDGER).withColumn("side", F.lit("left")).unionByName(make(spark, d, FEED).withColumn("side", F.lit("right")))
    number = (F.col("id").substr(F.lit(2), F.length("id")).cast("double") * 10).cast("long")
    arrivals = both.withColumn("pos", F.unix_date("value_date").cast("long") * DAY_POSITIONS + number * 10 + F.when(F.col("side") == "left", 0).otherwise(1))
    again = arrivals.filter(number % 500 == 0).withColumn("pos", F.col("pos") + 5)
    records = arrivals.unionByName(again).withColumn("kind", F.lit("arrival")).withColumn("until", F.lit(None).cast("date"))
    ends = both.select(F.last_day("value_date").alias("until"), F.last_day("value_date").alias("at")).distinct()
    ends = ends.unionByName(ends.agg(F.max("at").alias("at")).select(F.date_add("at", 60).alias("until"), F.date_add("at", 1).alias("at")))
    told = ends.withColumn("side", F.explode(F.array(F.lit("left"), F.lit("right")))).withColumn("pos", F.unix_date("at").cast("long") * DAY_POSITIONS + DAY_POSITIONS - 10 + F.when(F.col("side") == "left", 0).otherwise(1))
    return records.unionByName(told.select("until", "side", "pos", F.lit("progress").alias("kind")), allowMissingColumns=True)


DAY_POSITIONS = 10_000_000_000
STREAM = replay.StreamConfig(Tolerance(Decimal("0.20"), Decimal("0"), 3, 3, 32), lateness_days=2)


def journal_positions(spark: SparkSession, d: str) -> DataFrame:
    return replay.positions(_journal(spark, d)).select("position", "kind", "side", "id", "deliveries")


def replay_decisions(spark: SparkSession, d: str) -> DataFrame:
    return replay.replay(_journal(spark, d), STREAM)


def effective_state(spark: SparkSession, d: str) -> DataFrame:
    """What holds at the end of a journal in order: that of one run over all records."""
    own = replay.effective(replay_decisions(spark, d))
    return own.select("side", "id", "status", "decision_type", F.array_join("input_ids", ",").alias("inputs"), "reason")


def superseded_chain(spark: SparkSession, d: str) -> DataFrame:
    """By record: whether its chain begins at 1 and has no gap, how many decisions are in effect and how many are final."""
    told = replay.with_status(replay_decisions(spark, d))
    whole = (F.min("chain_version") == 1) & (F.max("chain_version") == F.count("*")) & (F.count_distinct("chain_version") == F.count("*"))
    return told.groupBy("side", "id").agg(whole.alias("whole"), F.count_if(F.col("status") != "SUPERSEDED").alias("in_effect"), F.count_if(F.col("final_at").isNotNull()).alias("final"))


def duration_texts(spark: SparkSession, d: str) -> DataFrame:
    ms = table(spark, d, "load_gen_rows").filter("duration_ns >= 0").select(F.col("duration_ns"), F.concat(F.floor(F.col("duration_ns") / 1_000_000_000).cast("string"), F.lit("s"), F.floor(F.col("duration_ns") / 1000 % 1_000_000).cast("string"), F.lit("µs")).alias("t"))
    return ms.select(F.sum(duration_ns(F.col("t"))).alias("total_ns"), F.count("*").alias("n"))


def queries() -> dict:
    own = (
        ordinal_join, shuffled_control, self_authored_rate, delay_quantiles, percentile_nearest_rank, freeze_detection, tuple_generations, id_consistency, rank_bucket_match, sliding_window_match, hop_score,
        series, drift_verdicts, undecided_jump, silent_sources, alerts, pairs_in_order, capture_failures, latency_gate, stability_spreads, journal_positions, replay_decisions, effective_state, superseded_chain, duration_texts,
    )
    return {f.__name__: f for f in own}


_TRACED = "trace_id IS NOT NULL AND NOT regexp_full_match(trace_id, '0*')"
_SERIES = f"s AS (SELECT side, source, day, outcome, forced, count(*) AS n FROM ({DECISIONS}) GROUP BY ALL)"


def _daily(hit: str, where: str) -> str:
    return f"""x AS (SELECT side, source, day, sum(CASE WHEN {hit} THEN n ELSE 0 END)::BIGINT AS hits, sum(n)::BIGINT AS total FROM s WHERE {where} GROUP BY ALL),
    y AS (SELECT *, coalesce(sum(hits) OVER w, 0)::BIGINT AS ref_hits, coalesce(sum(total) OVER w, 0)::BIGINT AS ref_total FROM x
      WINDOW w AS (PARTITION BY side, source ORDER BY day RANGE BETWEEN INTERVAL 5 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING))"""


def _wilson(h: str, n: str, sign: str, z: str) -> str:
    return f"(({h}::DOUBLE/{n} + {z}*{z}/(2*{n})) {sign} {z}*sqrt({h}::DOUBLE/{n}*(1-{h}::DOUBLE/{n})/{n} + {z}*{z}/(4.0*{n}*{n}))) / (1 + {z}*{z}/{n})"


_UNDECIDED = "(forced OR list_has_any(string_split(outcome, '+'), ['LATE', 'REFERENCE_AFTER_FINAL', 'BLOCK_TOO_LARGE']))"
_ORIGINS = "o AS (SELECT side, id, min({'d': CAST(captured_at AS DATE), 'a': adapter_version}) AS m FROM recon_records WHERE captured_at IS NOT NULL GROUP BY ALL), p AS (SELECT side, m.a AS source, m.d AS day FROM o)"


def _greedy(rank: str, block: str, pairs: str) -> str:
    """Greedy taking in blocks that share no record, in the order of difference, then ids."""
    side = lambda sql: f"SELECT id, amount AS measure, date_trunc('month', value_date) AS month, row_number() OVER ({rank} ORDER BY value_date, id) - 1 AS rank FROM ({sql})"
    return f"""WITH RECURSIVE l AS ({side(LEDGER)}), r AS ({side(FEED)}),
    c AS (SELECT {block} AS block, l.id AS a, r.id AS b, abs(l.measure - r.measure) AS off FROM l JOIN r ON {pairs} AND abs(l.measure - r.measure) <= 2000),
    n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY block ORDER BY off, a, b) AS n FROM c),
    w AS (SELECT DISTINCT block, CAST(0 AS BIGINT) AS n, CAST([] AS STRING[]) AS taken, false AS won FROM n
      UNION ALL SELECT w.block, n.n, CASE WHEN list_has_any(w.taken, [n.a, n.b]) THEN w.taken ELSE list_concat(w.taken, [n.a, n.b]) END, NOT list_has_any(w.taken, [n.a, n.b]) FROM w JOIN n ON n.block = w.block AND n.n = w.n + 1)
    SELECT a AS left_id, b AS right_id, off FROM n JOIN w ON w.block = n.block AND w.n = n.n WHERE won"""


_DROPS = f"""{_daily("outcome = 'M0_REFERENCE'", "NOT forced")}, z AS (SELECT *, CASE WHEN total >= 5 AND ref_total >= 5 THEN least(1, {_wilson("hits", "total", "+", "1.96")}) END AS upper, CASE WHEN total >= 5 AND ref_total >= 5 THEN {_wilson("ref_hits", "ref_total", "-", "1.96")} END AS low FROM y),
  v AS (SELECT side, source, day, hits, total, ref_hits, ref_total, CASE WHEN total < 5 THEN 'INSUFFICIENT' WHEN ref_total < 5 THEN 'NO_REFERENCE' WHEN upper < low - 0.01 THEN 'DROP' ELSE 'NORMAL' END AS verdict, upper FROM z)"""
_SILENT = "SELECT side, source, last_day, (SELECT max(day) FROM p) AS end_day, CAST((SELECT max(day) FROM p) - last_day AS INT) AS silent_days FROM (SELECT side, source, max(day) AS last_day FROM p GROUP BY ALL) WHERE (SELECT max(day) FROM p) - last_day > 2"
_FAILURES = f"""f AS (SELECT side, adapter_version AS source, CAST(captured_at AS DATE) AS day, count(*) AS failed FROM recon_records WHERE currency IS NULL GROUP BY ALL),
  a AS (SELECT side, source, day, count(*) AS arrived FROM p GROUP BY ALL), b AS (SELECT f.*, failed + coalesce(arrived, 0) AS total FROM f LEFT JOIN a USING (side, source, day)),
  cf AS (SELECT side, source, day, failed, total FROM b WHERE total >= 5 AND {_wilson("failed", "total", "-", "1.96")} > 0.01)"""
_BOTH = f"(SELECT 'left' AS side, id, value_date FROM ({LEDGER}) UNION ALL SELECT 'right', id, value_date FROM ({FEED}))"
_POSITIONS = f"""WITH k AS (SELECT side, id, value_date, CAST(CAST(substr(id, 2) AS DOUBLE) * 10 AS BIGINT) AS n FROM {_BOTH}),
  j AS (SELECT side, id, date_diff('day', DATE '1970-01-01', value_date) * {DAY_POSITIONS} + n * 10 + CASE side WHEN 'left' THEN 0 ELSE 1 END AS pos, CASE WHEN n % 500 = 0 THEN 2::BIGINT ELSE 1::BIGINT END AS deliveries FROM k),
  m AS (SELECT DISTINCT last_day(value_date) AS last_ FROM k UNION ALL SELECT max(last_day(value_date)) + 1 FROM k),
  e AS (SELECT pos, 'arrival' AS kind, side, id, deliveries FROM j UNION ALL SELECT date_diff('day', DATE '1970-01-01', last_) * {DAY_POSITIONS} + {DAY_POSITIONS} - 10 + x, 'progress', CASE x WHEN 0 THEN 'left' ELSE 'right' END, NULL, 1::BIGINT FROM m, (SELECT unnest([0, 1]) AS x))
  SELECT row_number() OVER (ORDER BY pos) - 1 AS position, kind, side, id, deliveries FROM e"""
_STATE = (
    _RUN
    + f""", near AS (SELECT l.id AS lid, r.id AS rid, r.id IN (SELECT id FROM taken_right) AS gone, abs(l.amount - r.amount) > 0.20 AS off FROM open_left l JOIN small r ON {_SAME} AND {_GAP} <= 3),
  why AS (SELECT lid, concat_ws('+', CASE WHEN bool_or(NOT gone AND off) THEN 'AMOUNT_OUT_OF_TOLERANCE' END, CASE WHEN count(*) FILTER (NOT gone) >= 2 THEN 'AGGREGATE_NOT_FOUND' END, CASE WHEN bool_or(gone) THEN 'LOST_TO_BETTER_CANDIDATE' END) AS reason FROM near GROUP BY lid)
  SELECT 'left' AS side, lid AS id, 'FINAL' AS status, 'MATCH' AS decision_type, lid || ',' || array_to_string(rids, ',') AS inputs, rule AS reason FROM matched
  UNION ALL SELECT 'right', unnest(rids), 'FINAL', 'MATCH', lid || ',' || array_to_string(rids, ','), 'AS_COUNTERPART' FROM matched
  UNION ALL SELECT 'left', id, 'FINAL', 'BREAK', id, coalesce(reason, 'NO_CANDIDATE') FROM open_left LEFT JOIN why ON lid = id
  UNION ALL SELECT 'right', id, 'FINAL', 'BREAK', id, CASE WHEN id IN (SELECT rid FROM near) THEN 'AMOUNT_OUT_OF_TOLERANCE' ELSE 'NO_CANDIDATE' END FROM feed WHERE id NOT IN (SELECT id FROM taken_right)"""
)


def oracle_sql() -> dict[str, str]:
    return {
        "ordinal_join": f"""WITH a AS (SELECT cell, conn_key, stream_id, min(trace_id) AS e, count(*) AS n FROM load_gen_rows WHERE side = 'load-gen' AND {_TRACED} GROUP BY ALL),
          b AS (SELECT cell, conn_key, stream_id, min(trace_id) AS g, count(*) AS m FROM load_gen_rows WHERE side = 'fake-upstream' AND {_TRACED} GROUP BY ALL)
          SELECT cell, CASE WHEN n > 1 OR coalesce(m, 0) > 1 THEN 'ambiguous' WHEN m IS NULL THEN 'missing' WHEN e = g THEN 'correct' ELSE 'wrong' END AS outcome, count(*) AS n FROM a LEFT JOIN b USING (cell, conn_key, stream_id) GROUP BY ALL""",
        "shuffled_control": f"SELECT count(DISTINCT trace_id) AS n, 0::BIGINT AS lost, true AS unlinked FROM load_gen_rows WHERE side = 'load-gen' AND {_TRACED}",
        "self_authored_rate": f"""SELECT u.cell, count(*) AS n, count(*) FILTER (k.trace_id IS NULL) AS hits, count(*) FILTER (k.trace_id IS NULL)::DOUBLE / count(*) AS rate
          FROM (SELECT * FROM load_gen_rows WHERE side = 'fake-upstream' AND {_TRACED}) u LEFT JOIN (SELECT DISTINCT cell, trace_id FROM load_gen_rows WHERE side = 'load-gen' AND {_TRACED}) k ON u.cell = k.cell AND u.trace_id = k.trace_id GROUP BY u.cell""",
        "delay_quantiles": """WITH v AS (SELECT cell, list_sort(list(CAST(floor((timestamp_ns - arrival_ns) / 1000) AS BIGINT))) AS x, count(*) AS n FROM load_gen_rows WHERE side = 'fake-upstream' AND arrival_ns IS NOT NULL AND timestamp_ns IS NOT NULL GROUP BY cell)
          SELECT cell, n, x[least(n, n * 5 // 10 + 1)] AS p50, x[least(n, n * 99 // 100 + 1)] AS p99 FROM v""",
        "percentile_nearest_rank": "WITH v AS (SELECT protocol, list_sort(list(duration_ns)) AS x, count(*) AS n FROM load_gen_rows WHERE duration_ns IS NOT NULL GROUP BY protocol) SELECT protocol, n, x[(n * 50 + 99) // 100] AS p50, x[(n * 95 + 99) // 100] AS p95, x[(n * 99 + 99) // 100] AS p99 FROM v",
        "freeze_detection": "SELECT cell, timestamp_ns // 10000000 // 1000000 AS ms, count(*) AS n FROM load_gen_rows WHERE side = 'load-gen' AND floor(duration_ns / 1000) > 20000 GROUP BY ALL HAVING count(*) >= 10",
        "tuple_generations": "SELECT cell, conn_key, timestamp_ns, stream_id, side, trace_id, row_number() OVER (PARTITION BY conn_key ORDER BY timestamp_ns NULLS FIRST, stream_id NULLS FIRST, side NULLS FIRST, trace_id NULLS FIRST, cell) - 1 AS generation FROM load_gen_rows",
        "id_consistency": """WITH e AS (SELECT DISTINCT trace_id AS id FROM load_gen_rows WHERE side = 'load-gen' AND trace_id IS NOT NULL), s AS (SELECT trace_id AS id, count(*) AS n FROM load_gen_rows WHERE side = 'fake-upstream' AND trace_id IS NOT NULL GROUP BY ALL)
          SELECT count(*) FILTER (n IS NULL) AS missing, count(*) FILTER (n > 1 AND e.id IS NOT NULL) AS duplicated, count(*) FILTER (e.id IS NULL) AS unknown FROM e FULL JOIN s ON e.id = s.id""",
        "hop_score": """WITH k AS (SELECT hop AS place, upstream AS up, min(downstream) AS told FROM candidate_links GROUP BY ALL), t AS (SELECT hop AS place, {'source': source, 'seq': seq} AS up, min(partners[1]) AS real_ FROM flow_decisions WHERE kind = 'LINKED' AND len(partners) > 0 GROUP BY ALL)
          SELECT coalesce(k.place, t.place) AS place, count(told) AS links, count(*) FILTER (told = real_) AS correct, count(*) FILTER (told IS NOT NULL AND told IS DISTINCT FROM real_) AS wrong, count(*) FILTER (told IS NULL) AS lost FROM k FULL JOIN t ON k.place = t.place AND k.up = t.up GROUP BY 1""",
        "series": f"SELECT side, source, day, CASE WHEN side = 'left' OR reason <> 'AS_COUNTERPART' THEN reason ELSE 'M0_REFERENCE' END AS outcome, forced, count(*) AS n FROM ({STATES}) WHERE status = 'FINAL' GROUP BY ALL",
        "drift_verdicts": f"WITH {_SERIES}, {_DROPS} SELECT * FROM v",
        "undecided_jump": f"""WITH {_SERIES}, {_daily(_UNDECIDED, "true")} SELECT side, source, day, hits, total, ref_hits, ref_total FROM y WHERE total >= 5 AND ref_total >= 5 AND greatest(0, {_wilson("hits", "total", "-", "0.2")}) > least(1, {_wilson("ref_hits", "ref_total", "+", "0.2")})""",
        "silent_sources": f"WITH p AS ({ARRIVALS}) {_SILENT}",
        "capture_failures": f"WITH {_ORIGINS}, {_FAILURES} SELECT * FROM cf",
        "alerts": f"""WITH {_SERIES}, {_DROPS}, {_ORIGINS.replace(', p AS', ', p0 AS')}, p AS (SELECT side, source, day FROM p0 UNION ALL SELECT side, source, day FROM ({ARRIVALS})), {_FAILURES}, {_daily(_UNDECIDED, "true").replace("x AS", "x2 AS").replace("FROM x", "FROM x2").replace("y AS", "y2 AS")}
          SELECT 'MATCH_RATE_DROP' AS kind, side, source, day FROM v WHERE verdict = 'DROP' UNION ALL SELECT 'SOURCE_SILENT', side, source, end_day FROM ({_SILENT}) UNION ALL SELECT 'CAPTURE_FAILURE', side, source, day FROM cf
          UNION ALL SELECT 'UNDECIDED_JUMP', side, source, day FROM y2 WHERE total >= 5 AND ref_total >= 5 AND greatest(0, {_wilson("hits", "total", "-", "1.96")}) > least(1, {_wilson("ref_hits", "ref_total", "+", "1.96")}) + 0.01""",
        "pairs_in_order": f"""WITH a AS (SELECT account, id, row_number() OVER (PARTITION BY account ORDER BY value_date, id) - 1 AS rank, count(*) OVER (PARTITION BY account) AS n FROM ({LEDGER})), b AS (SELECT account, id, row_number() OVER (PARTITION BY account ORDER BY value_date, id) - 1 AS rank, count(*) OVER (PARTITION BY account) AS n FROM ({FEED}))
          SELECT account, rank, a.id AS id_left, b.id AS id_right FROM a JOIN b USING (account, rank) WHERE a.n = b.n""",
        "latency_gate": """WITH x AS (SELECT (event_id + (event_id % 100)::DOUBLE / 125.0::DOUBLE) - ((event_id::DOUBLE + CASE user_id % 3 WHEN 1 THEN -0.25 WHEN 2 THEN -0.5 ELSE 0 END) - CASE user_id % 3 WHEN 1 THEN -0.25 WHEN 2 THEN -0.5 ELSE 0 END) AS v FROM events),
          y AS (SELECT list_sort(list(v)) AS x, count(*) AS n, count(*) FILTER (v < 0) AS negative FROM x)
          SELECT n, x[(n * 95 + 99) // 100] AS p95, x[(n * 99 + 99) // 100] AS p99, CASE WHEN n < 100 THEN 'TOO_FEW' WHEN negative > 0 THEN 'NEGATIVE' WHEN x[(n * 95 + 99) // 100] <= 1 AND x[(n * 99 + 99) // 100] <= 2 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM y""",
        "journal_positions": _POSITIONS,
        "effective_state": _STATE,
        "superseded_chain": f"SELECT side, id, true AS whole, 1::BIGINT AS in_effect, 1::BIGINT AS final FROM {_BOTH}",
        "stability_spreads": """WITH r AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'fixed' ELSE 'variable' END AS seed, event_id % 5 AS rep, count(*) AS ops, count(*) FILTER (event_type = 'view') AS a, count(*) FILTER (event_id % 2 = 0) AS b FROM events GROUP BY ALL),
          m AS (SELECT seed, 'a' AS metric, round(a::DOUBLE / ops, 4) AS v, ops FROM r UNION ALL SELECT seed, 'b', round(b::DOUBLE / ops, 4), ops FROM r),
          s AS (SELECT seed, metric, count(*) AS n, stddev_samp(v) AS sd, min(ops) AS ops FROM m GROUP BY ALL) SELECT seed, min(n) AS reps, max(n) AS most_reps, min(ops) AS ops, bool_or(sd > 0.015) AS wide FROM s GROUP BY seed""",
        "duration_texts": "SELECT sum((duration_ns // 1000) * 1000)::BIGINT AS total_ns, count(*) AS n FROM load_gen_rows WHERE duration_ns >= 0",
        "rank_bucket_match": _greedy("", "l.rank // 10", "l.rank // 10 = r.rank // 10"),
        "sliding_window_match": _greedy("PARTITION BY date_trunc('month', value_date)", "l.month", "l.month = r.month AND abs(l.rank - r.rank) <= 5"),
    }
