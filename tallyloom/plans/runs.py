"""Queries over measured runs, and their SQL. Paths are labelled here, as those of the test tables carry no truth id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import runs
from tallyloom.plans.correlation import _DECIDED
from tallyloom.plans.inputs import SPANS, make

# Requests sent, and what the receiver logged: some unlabelled, some with another or no id.
SENT = """SELECT cell, trace_id, timestamp_ns, duration_ns, stream_id, CASE WHEN stream_id % 5 <> 0 THEN 'run=main' END AS baggage
  FROM load_gen_rows WHERE side = 'load-gen' AND trace_id IS NOT NULL AND trace_id <> '00000000000000000000000000000000'"""
GOT = """SELECT cell, CASE WHEN stream_id % 19 = 0 THEN '/plain' ELSE concat('/truth-', trace_id, '?n=1') END AS path, timestamp_ns + 150000 + stream_id % 97 * 1000 AS arrival_ns,
  timestamp_ns + 170000 + CAST(floor(abs(duration_ns) * 0.75) AS BIGINT) AS timestamp_ns, CASE WHEN stream_id % 15 = 0 THEN '' WHEN stream_id % 7 <> 0 THEN 'run=main' END AS baggage,
  CASE WHEN stream_id % 17 = 0 THEN (SELECT min(trace_id) FROM load_gen_rows WHERE side = 'load-gen' AND trace_id > '1') WHEN stream_id % 11 = 0 THEN reverse(trace_id) WHEN stream_id % 23 = 0 THEN '' ELSE trace_id END AS trace_id
  FROM load_gen_rows WHERE side = 'load-gen' AND trace_id IS NOT NULL AND trace_id <> '00000000000000000000000000000000' AND duration_ns IS NOT NULL AND stream_id % 13 <> 0"""
# Spans and samples of an agent, made from events.
AGENT = """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'SPAN_KIND_CLIENT' ELSE 'SPAN_KIND_SERVER' END AS kind, CASE WHEN user_id % 2 = 0 THEN '8443' ELSE '80' END AS host_port,
  concat('hop-', CAST(event_id % 5 AS STRING)) AS server, CASE WHEN event_id % 4 = 0 THEN 'other' ELSE concat('hop-', CAST(user_id % 4 AS STRING)) END AS client,
  CASE WHEN event_id % 7 = 0 THEN 'broken' ELSE concat('00-', lpad(CAST(event_id AS STRING), 32, '0'), '-0123456789abcdef-01') END AS header, event_type FROM events"""
SAMPLES = "SELECT CAST(event_id % 50 AS STRING) AS second, user_id % 4 AS core, CAST(event_id * 7 % 101 AS DOUBLE) AS busy, event_type AS process, CAST(event_id % 90 AS DOUBLE) AS cpu FROM events"
POINTS = ["load-gen", "relay", "upstream"]


def _sent(spark: SparkSession, d: str) -> DataFrame:
    return make(spark, d, SENT)


def _got(spark: SparkSession, d: str) -> DataFrame:
    return make(spark, d, GOT).withColumn("truth", runs.truth_id(F.col("path")))


def run_validity(spark: SparkSession, d: str) -> DataFrame:
    """Every 29th stream is warm-up traffic."""
    sent = _sent(spark, d)
    warm = sent.filter("stream_id % 29 = 0").select("cell", "trace_id", F.col("trace_id").alias("id"))
    measured = runs.without_known(sent, warm, "trace_id").dropDuplicates(["cell", "trace_id"])
    return runs.validity(measured, _got(spark, d).select("cell", "truth", F.col("trace_id").alias("reported")), warm, ["cell"])


def wire_received(spark: SparkSession, d: str) -> DataFrame:
    return runs.wire(_sent(spark, d), _got(spark, d), ["cell"])


def adjacent_points(spark: SparkSession, d: str) -> DataFrame:
    got = _got(spark, d)
    told = [_sent(spark, d).select("cell", F.lit(POINTS[0]).alias("point"), F.col("trace_id").alias("truth"), F.col("trace_id").alias("id"))]
    told += [got.select("cell", F.lit(POINTS[1]).alias("point"), "truth", F.col("trace_id").alias("id")), got.select("cell", F.lit(POINTS[2]).alias("point"), "truth", F.col("truth").alias("id"))]
    return runs.adjacent(told[0].unionByName(told[1]).unionByName(told[2]), POINTS, ["cell"])


def arrival_answer_delays(spark: SparkSession, d: str) -> DataFrame:
    each = runs.delays(_sent(spark, d).filter("duration_ns is not null"), _got(spark, d).filter("truth is not null"), ["cell"])
    return runs.order_statistics(each, ["cell", "kind"], "delay_us", {"p50": ("floor", "0.5"), "p99": ("floor", "0.99"), "p999": ("floor", "0.999")})


def _ends(spark: SparkSession, d: str) -> DataFrame:
    us = lambda c: F.floor(c / 1000).cast("long")
    up = _sent(spark, d).filter("duration_ns is not null").select("cell", F.lit("load-gen").alias("point"), F.lit("outbound").alias("side"), F.col("trace_id").alias("truth"), us(F.col("timestamp_ns")).alias("start"), us(F.col("timestamp_ns") + F.col("duration_ns")).alias("end"), us(F.col("timestamp_ns")).alias("handler"))
    down = _got(spark, d).select("cell", F.lit("upstream").alias("point"), F.lit("inbound").alias("side"), "truth", us(F.col("arrival_ns")).alias("start"), us(F.col("timestamp_ns")).alias("end"), us((F.col("arrival_ns") + F.col("timestamp_ns")) / 2).alias("handler"))
    return up.unionByName(down)


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = _ends(spark, d).withColumn("_order", F.struct("start", "end", "handler"))
    return runs.true_pairs(rows, ["cell"], ("load-gen", "outbound"), ("upstream", "inbound"), ["start", "end", "handler"], "_order")


def interval_containment(spark: SparkSession, d: str) -> DataFrame:
    return runs.contained(_pairs(spark, d), ["cell"])


def calibration_statistics(spark: SparkSession, d: str) -> DataFrame:
    return runs.signal_statistics(_pairs(spark, d), ["cell"]).drop("place")


def calibration_choice(spark: SparkSession, d: str) -> DataFrame:
    return runs.chosen_signals(runs.signal_statistics(_pairs(spark, d), ["cell"]), ["cell"])


def time_trust(spark: SparkSession, d: str) -> DataFrame:
    off = _pairs(spark, d).select("cell", (F.col("down.start") - F.col("up.start")).alias("offset_us"), F.col("down.start").alias("value"))
    return runs.trust(off, ["cell"]).withColumn("sd_us", F.round("sd_us", 3))


def request_rate(spark: SparkSession, d: str) -> DataFrame:
    return runs.request_rate(_ends(spark, d).filter("point = 'load-gen'"), ["cell"]).withColumn("rate_per_s", F.round("rate_per_s", 6))


def order_statistics(spark: SparkSession, d: str) -> DataFrame:
    """All definitions in use, of durations by protocol, where null is a group too."""
    rows = make(spark, d, "SELECT negotiated_protocol AS protocol, duration_ns FROM load_gen_rows")
    wanted = {"nearest_95": ("nearest", "0.95"), "floor_95": ("floor", "0.95"), "half": ("half", "0.5"), "median_low": ("median_low", "0.5"), "median": ("median", "0.5"), "floor_99": ("floor", "0.99")}
    return runs.order_statistics(rows, ["protocol"], "duration_ns", wanted)


_TIMED = "SELECT concat(source, '/', CAST(seq AS STRING)) AS id, lower(trim(point)) AS point, min(start_us) AS t, max(end_us) - min(start_us) AS duration FROM {} WHERE point IS NOT NULL AND start_us IS NOT NULL AND end_us IS NOT NULL GROUP BY source, seq, lower(trim(point))"
LEFTS, RIGHTS = _TIMED.format("timed_obs"), _TIMED.format("timed_probe")


def time_duration_candidates(spark: SparkSession, d: str) -> DataFrame:
    limit = F.lit(100) + F.abs(F.floor(F.col("l.duration") / 10))
    return runs.time_and_duration_candidates(make(spark, d, LEFTS), make(spark, d, RIGHTS), ["point"], 400, limit)


def correlator_scores(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of one partner on either side count as decided; the truth is the partner with the least difference."""
    found = time_duration_candidates(spark, d).select(F.col("left_id").alias("left"), F.col("right_id").alias("right"), "off")
    one = [found.groupBy(s).agg(F.count("*").alias(f"n_{s}")) for s in ("left", "right")]
    degrees = found.join(one[0], "left").join(one[1], "right")
    single = (F.col("n_left") == 1) & (F.col("n_right") == 1)
    decided = degrees.groupBy("left").agg(F.max(F.when(single, F.col("right"))).alias("right")).withColumn("status", F.when(F.col("right").isNotNull(), "MATCHED").otherwise("AMBIGUOUS"))
    truth = make(spark, d, RIGHTS).select(F.col("id").alias("right"), F.substring_index("id", "/", -1).alias("n")).join(make(spark, d, LEFTS).select(F.col("id").alias("left"), F.substring_index("id", "/", -1).alias("n")), "n").groupBy("left").agg(F.min("right").alias("right"))
    return runs.correlator_score(found, decided, truth, make(spark, d, LEFTS).select(F.col("id").alias("left")))


def join_scores(spark: SparkSession, d: str) -> DataFrame:
    """Links by trace, scored by the number that both ends of a request share."""
    from tallyloom.plans.correlation import exact_links

    links = exact_links(spark, d).select(F.substring("place", 1, 2).alias("place"), F.col("up_seq").alias("up_truth"), F.col("down_seq").alias("down_truth"))
    seen = make(spark, d, SPANS).select("point", "side", F.col("seq").alias("truth"), (F.col("conn").isNotNull()).alias("keyed"))
    ends = spark.createDataFrame([(p, p, "outbound", p, "inbound") for p in ("p0", "p1", "p2")], "place string, up_point string, up_side string, down_point string, down_side string")
    return runs.join_score(links, seen, ends)


def timing_scores(spark: SparkSession, d: str) -> DataFrame:
    """The timed links of spans, whose two ends have one number."""
    from tallyloom.operators import timing
    from tallyloom.plans import correlation

    decided = correlation.timing_links(spark, d).select("side", "status", (F.col("seq") == F.col("partner_seq")).alias("right"))
    found = correlation.timing_candidates(spark, d).select(F.concat(F.lit("u"), F.col("up_seq").cast("string")).alias("a"), F.concat(F.lit("d"), F.col("down_seq").cast("string")).alias("b"))
    sizes = timing.components(found, "a", "b").groupBy("component").agg(F.count("*").alias("size")).select("size")
    return runs.timing_score(decided, sizes, 1_000.0, correlation.PARAMS.signals[0].window_us)


def replay_scores(spark: SparkSession, d: str) -> DataFrame:
    """Final decisions scored by the point at which each message was seen."""
    finals = make(spark, d, "SELECT hop AS place, source, seq, kind, partners FROM flow_decisions WHERE status = 'FINAL'")
    truth = make(spark, d, "SELECT source, seq, min(lower(trim(point))) AS truth FROM timed_obs GROUP BY source, seq")
    return runs.replay_score(finals, truth)


def span_places(spark: SparkSession, d: str) -> DataFrame:
    spans = make(spark, d, AGENT)
    own = runs.placed(F.col("kind"), F.col("host_port"), F.col("server"), F.col("client"), 8443, 3)
    return spans.withColumn("p", own).groupBy("p.point", "p.side").agg(F.count("*").alias("n"))


def selected_spans(spark: SparkSession, d: str) -> DataFrame:
    spans = make(spark, d, AGENT).select("event_id", "kind", F.col("host_port").alias("hostPort"), F.create_map(F.lit("type"), "event_type", F.lit("peer"), "server").alias("attributes"))
    return spans.filter(runs.selected(runs.SERVER, 80, {"type": "view", "peer": "hop-1"})).select("event_id")


def header_traces(spark: SparkSession, d: str) -> DataFrame:
    return make(spark, d, AGENT).select("event_id", runs.trace_of(F.col("header")).alias("trace"))


def core_saturation(spark: SparkSession, d: str) -> DataFrame:
    return runs.saturation(make(spark, d, SAMPLES), 99.0)


def process_load(spark: SparkSession, d: str) -> DataFrame:
    samples = make(spark, d, SAMPLES)
    seconds = F.lit(samples.select("second").distinct().count())
    return runs.top(runs.foreign_load(samples, seconds, ["view", "click"], "purchase").withColumn("cores", F.round("cores", 6)), "cores", "process")


def missing_positions(spark: SparkSession, d: str) -> DataFrame:
    expected = _sent(spark, d).groupBy(F.col("trace_id").alias("id")).agg(F.min("timestamp_ns").alias("at"))
    return runs.missing_positions(expected, _got(spark, d).select(F.col("trace_id").alias("id")), ["at", "id"])


def queries() -> dict:
    own = (
        run_validity, wire_received, adjacent_points, arrival_answer_delays, interval_containment, calibration_statistics, calibration_choice, time_trust, request_rate, order_statistics, time_duration_candidates,
        correlator_scores, join_scores, timing_scores, replay_scores, span_places, selected_spans, header_traces, core_saturation, process_load, missing_positions,
    )
    return {f.__name__: f for f in own}


_LOGS = f"""WITH sent AS ({SENT}), got AS (SELECT *, nullif(regexp_extract(path, '/truth-([0-9a-f]{{32}})($|[/?])', 1), '') AS truth FROM ({GOT}))"""
_PAIRED = (
    _LOGS
    + """, u AS (SELECT cell, trace_id AS truth, max({'s': CAST(floor(timestamp_ns / 1000) AS BIGINT), 'e': CAST(floor((timestamp_ns + duration_ns) / 1000) AS BIGINT)}) AS u FROM sent WHERE duration_ns IS NOT NULL GROUP BY ALL),
d AS (SELECT cell, truth, max({'s': CAST(floor(arrival_ns / 1000) AS BIGINT), 'e': CAST(floor(timestamp_ns / 1000) AS BIGINT), 'h': CAST(floor((arrival_ns + timestamp_ns) / 2 / 1000) AS BIGINT)}) AS d FROM got WHERE truth IS NOT NULL GROUP BY ALL),
p AS (SELECT u.cell, u.u.s AS us, u.u.e AS ue, d.d.s AS ds, d.d.e AS de, d.d.h AS dh FROM u JOIN d USING (cell, truth))"""
)
_GAPS = (
    _PAIRED
    + """, g AS (SELECT cell, r AS receiver_start, unnest([0, 1, 2]) AS place, unnest(['start', 'end', 'duration']) AS signal, unnest([b - us, ue - de, (ue - us) - (de - b)]) AS gap
  FROM (SELECT *, unnest(['start', 'handlerStart']) AS r, unnest([ds, dh]) AS b FROM p)),
o AS (SELECT cell, receiver_start, place, signal, list_sort(list(gap))[(count(*) - 1) // 2 + 1] AS offset_us FROM g GROUP BY ALL),
q AS (SELECT cell, receiver_start, place, signal, offset_us, list_sort(list(abs(gap - offset_us))) AS x, count(*) AS n FROM g JOIN o USING (cell, receiver_start, place, signal) GROUP BY ALL),
s AS (SELECT cell, receiver_start, place, signal, offset_us, n, x[least(n, n * 5 // 10 + 1)] AS p50, x[least(n, n * 99 // 100 + 1)] AS p99, x[least(n, n * 999 // 1000 + 1)] AS p999, x[n] AS most FROM q)"""
)


def oracle_sql() -> dict[str, str]:
    return {
        "run_validity": _LOGS
        + """, warm AS (SELECT DISTINCT cell, trace_id AS id FROM sent WHERE stream_id % 29 = 0),
          m AS (SELECT DISTINCT cell, trace_id FROM sent WHERE trace_id NOT IN (SELECT id FROM warm)),
          o AS (SELECT got.cell, truth, trace_id AS reported, warm.id IS NOT NULL AS away FROM got LEFT JOIN warm ON warm.cell = got.cell AND warm.id = coalesce(truth, trace_id)),
          e AS (SELECT cell, truth, count(*) AS n, any_value(reported) AS reported FROM o WHERE NOT away AND truth IS NOT NULL GROUP BY ALL),
          x AS (SELECT coalesce(m.cell, e.cell) AS cell, m.trace_id AS t, e.truth, n, reported, EXISTS (FROM m k WHERE k.cell = coalesce(m.cell, e.cell) AND k.trace_id = reported) AS named FROM m FULL JOIN e ON m.cell = e.cell AND m.trace_id = e.truth),
          a AS (SELECT cell, count(t) AS attempted, count(*) FILTER (t IS NOT NULL AND n = 1 AND reported = truth) AS correct, count(*) FILTER (t IS NOT NULL AND n = 1 AND reported <> truth AND named) AS swapped, count(*) FILTER (t IS NOT NULL AND n = 1 AND NOT named) AS unknown,
            count(*) FILTER (t IS NOT NULL AND n IS NULL) AS missing, count(*) FILTER (t IS NOT NULL AND n > 1) AS duplicated, coalesce(sum(n) FILTER (t IS NULL), 0)::BIGINT AS unexpected FROM x GROUP BY cell),
          b AS (SELECT cell, count(*) FILTER (away) AS outside, count(*) FILTER (NOT away AND truth IS NULL) AS unlabelled, count(*) FILTER (NOT away) AS selected FROM o GROUP BY cell)
          SELECT *, CASE WHEN unlabelled + unexpected + duplicated = 0 AND selected > 0 THEN 'VALID' ELSE 'INVALID' END AS status, CASE WHEN unlabelled + unexpected + duplicated = 0 AND selected > 0 THEN correct::DOUBLE / attempted END AS accuracy FROM a JOIN b USING (cell)""",
        "wire_received": _LOGS
        + """, s AS (SELECT cell, trace_id AS t, max(baggage) AS b FROM sent GROUP BY ALL), r AS (SELECT cell, truth AS t, any_value(trace_id) AS trace_id, max(baggage) AS g FROM got WHERE truth IS NOT NULL GROUP BY ALL HAVING count(*) = 1)
          SELECT cell, count(*) AS measured, count(r.t) AS reached_once, count(*) FILTER (r.trace_id = s.t) AS received_once, count(*) FILTER (r.trace_id = '') AS traceparent_absent,
            count(*) FILTER (r.t IS NOT NULL AND b IS NOT DISTINCT FROM g) AS baggage_exact, count(*) FILTER (r.t IS NOT NULL AND coalesce(g, '') = '') AS baggage_absent FROM s LEFT JOIN r USING (cell, t) GROUP BY cell""",
        "adjacent_points": _LOGS
        + """, r AS (SELECT cell, 0 AS p, trace_id AS t, trace_id AS id FROM sent UNION ALL SELECT cell, 1, truth, trace_id FROM got WHERE truth IS NOT NULL UNION ALL SELECT cell, 2, truth, truth FROM got WHERE truth IS NOT NULL),
          o AS (SELECT cell, p, t, any_value(id) AS id FROM r GROUP BY ALL HAVING count(*) = 1)
          SELECT a.cell, ['load-gen', 'relay', 'upstream'][a.p + 1] AS "from", ['load-gen', 'relay', 'upstream'][a.p + 2] AS "to", count(*) AS both_seen, count(*) FILTER (a.id = b.id) AS same_id FROM o a JOIN o b ON a.cell = b.cell AND a.t = b.t AND b.p = a.p + 1 GROUP BY a.cell, a.p""",
        "arrival_answer_delays": _LOGS
        + """, b AS (SELECT s.cell, arrival_ns, s.timestamp_ns AS sent_ns, s.timestamp_ns + duration_ns AS back_ns, g.timestamp_ns AS done_ns FROM sent s JOIN got g ON s.cell = g.cell AND s.trace_id = g.truth WHERE duration_ns IS NOT NULL AND arrival_ns <> 0),
          k AS (SELECT cell, 'arrival' AS kind, CAST(floor((arrival_ns - sent_ns) / 1000) AS BIGINT) AS v FROM b UNION ALL SELECT cell, 'answer', CAST(floor((back_ns - done_ns) / 1000) AS BIGINT) FROM b),
          x AS (SELECT cell, kind, list_sort(list(v)) AS x, count(*) AS n FROM k GROUP BY ALL)
          SELECT cell, kind, n, x[least(n, n * 5 // 10 + 1)] AS p50, x[least(n, n * 99 // 100 + 1)] AS p99, x[least(n, n * 999 // 1000 + 1)] AS p999 FROM x""",
        "interval_containment": _PAIRED + "SELECT cell, count(*) AS pairs, count(*) FILTER (us <= ds AND de <= ue) AS inside, count(*) FILTER (us <= ds AND de <= ue)::DOUBLE / count(*) AS share FROM p GROUP BY cell",
        "calibration_statistics": _GAPS + "SELECT cell, receiver_start, signal, offset_us, n, p50, p99, p999, most FROM s",
        "calibration_choice": _GAPS
        + """, a AS (SELECT *, row_number() OVER (PARTITION BY cell, receiver_start ORDER BY p999, place) AS r FROM s WHERE signal <> 'duration' QUALIFY r = 1),
          b AS (SELECT s.*, row_number() OVER (PARTITION BY s.cell, s.receiver_start ORDER BY s.p999, s.place) AS r FROM s JOIN a USING (cell, receiver_start) WHERE s.signal <> a.signal QUALIFY r = 1),
          k AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY p999, receiver_start <> 'start') AS c FROM a QUALIFY c = 1)
          SELECT cell, receiver_start, signal, 1 AS rank, offset_us, greatest(1, p999) AS window_us, p99 AS margin_us FROM k
          UNION ALL SELECT b.cell, b.receiver_start, b.signal, 2, b.offset_us, greatest(1, b.p999), k.p99 FROM k JOIN b USING (cell, receiver_start) WHERE b.p999 <= 3 * k.p999""",
        "time_trust": _PAIRED
        + """, m AS (SELECT cell, ds - us AS o, ds AS v FROM p), x AS (SELECT cell, list_sort(list(o)) AS x, count(*) AS n, count(DISTINCT v) AS k, stddev_pop(o) AS sd FROM m GROUP BY cell),
          c AS (SELECT *, (x[(n - 1) // 2 + 1] + x[n // 2 + 1]) / 2 AS mid FROM x), y AS (SELECT cell, list_sort(list(abs(o - mid))) AS y FROM m JOIN c USING (cell) GROUP BY cell)
          SELECT cell, n, k::DOUBLE / n AS distinct_ratio, round(sd, 3) AS sd_us, (y[(n - 1) // 2 + 1] + y[n // 2 + 1]) / 2 AS p50_us, y[(n * 99 + 99) // 100] AS p99_us, y[n] AS max_us,
            CASE WHEN k::DOUBLE / n < 0.99 THEN 'FAILS' WHEN y[(n * 99 + 99) // 100] <= 100 THEN 'HOLDS' WHEN y[(n * 99 + 99) // 100] <= 1000 THEN 'PARTIAL' ELSE 'FAILS' END AS verdict FROM c JOIN y USING (cell)""",
        "request_rate": _LOGS
        + """, r AS (SELECT cell, CAST(floor(timestamp_ns / 1000) AS BIGINT) AS s, CAST(floor((timestamp_ns + duration_ns) / 1000) AS BIGINT) AS e FROM sent WHERE duration_ns IS NOT NULL)
          SELECT cell, count(*) AS n, max(e) - min(s) AS span_us, round(CASE WHEN max(e) > min(s) THEN count(*) / ((max(e) - min(s)) / 1e6) ELSE 0 END, 6) AS rate_per_s FROM r GROUP BY cell""",
        "order_statistics": """WITH x AS (SELECT negotiated_protocol AS protocol, list_sort(list(duration_ns)) AS x, count(*) AS n FROM load_gen_rows WHERE duration_ns IS NOT NULL GROUP BY ALL)
          SELECT protocol, n, x[(n * 95 + 99) // 100] AS nearest_95, x[least(n, n * 95 // 100 + 1)] AS floor_95, x[n // 2 + 1] AS half, x[(n - 1) // 2 + 1] AS median_low, (x[(n - 1) // 2 + 1] + x[n // 2 + 1]) / 2 AS median, x[least(n, n * 99 // 100 + 1)] AS floor_99 FROM x""",
        "time_duration_candidates": f"SELECT l.point, l.id AS left_id, r.id AS right_id, abs(l.duration - r.duration) AS off FROM ({LEFTS}) l JOIN ({RIGHTS}) r ON l.point = r.point AND r.t BETWEEN l.t - 400 AND l.t + 400 AND abs(l.duration - r.duration) <= 100 + abs(floor(l.duration / 10))",
        "correlator_scores": f"""WITH l AS ({LEFTS}), r AS ({RIGHTS}), c AS (SELECT l.id AS a, r.id AS b FROM l JOIN r ON l.point = r.point AND r.t BETWEEN l.t - 400 AND l.t + 400 AND abs(l.duration - r.duration) <= 100 + abs(floor(l.duration / 10))),
          g AS (SELECT a, b, count(*) OVER (PARTITION BY a) AS na, count(*) OVER (PARTITION BY b) AS nb FROM c), dec AS (SELECT a, max(CASE WHEN na = 1 AND nb = 1 THEN b END) AS told FROM g GROUP BY a),
          tr AS (SELECT l.id AS a, min(r.id) AS b FROM l JOIN r ON string_split(l.id, '/')[-1] = string_split(r.id, '/')[-1] GROUP BY l.id), e AS (SELECT DISTINCT id AS a FROM l),
          x AS (SELECT e.a, tr.b, dec.a IS NOT NULL AS any_, dec.told, EXISTS (FROM c WHERE c.a = e.a AND c.b = tr.b) AS rec FROM e LEFT JOIN tr ON e.a = tr.a LEFT JOIN dec ON e.a = dec.a)
          SELECT count(*) AS total, count(*) FILTER (rec) AS recalled, count(*) FILTER (told = b) AS correct, count(*) FILTER (told IS NOT NULL AND told IS DISTINCT FROM b) AS wrong, count(*) FILTER (any_ AND told IS NULL) AS ambiguous, 0::BIGINT AS oversized, count(*) FILTER (NOT any_) AS no_candidate,
            count(*) FILTER (rec)::DOUBLE / count(*) AS r, count(*) FILTER (told = b)::DOUBLE / count(*) AS t FROM x""",
        "join_scores": f"""WITH g AS (SELECT point AS place, trace, count(*) FILTER (side = 'outbound') AS u, count(*) FILTER (side = 'inbound') AS d, min(seq) FILTER (side = 'outbound') AS us, min(seq) FILTER (side = 'inbound') AS ds FROM ({SPANS}) WHERE trace IS NOT NULL GROUP BY ALL),
          l AS (SELECT place, us, ds FROM g WHERE u = 1 AND d = 1), s AS (SELECT point AS place, side, seq, max(conn IS NOT NULL) AS k FROM ({SPANS}) GROUP BY ALL),
          b AS (SELECT x.place, x.seq, x.k AND y.k AS k, EXISTS (FROM l WHERE l.place = x.place AND us = x.seq AND ds = x.seq) AS ok FROM s x JOIN s y ON x.place = y.place AND x.seq = y.seq AND x.side = 'outbound' AND y.side = 'inbound')
          SELECT *, links - correct AS wrong FROM (SELECT place, count(*) AS both_seen, count(*) FILTER (NOT k) AS keyless, count(*) FILTER (k AND NOT ok) AS lost FROM b GROUP BY place) JOIN (SELECT place, count(*) AS links, count(*) FILTER (us = ds) AS correct FROM l GROUP BY place) USING (place)""",
        "timing_scores": _DECIDED.replace("WITH ", "WITH RECURSIVE ", 1)
        + """, g AS (SELECT DISTINCT concat('u', up_seq) AS a, concat('d', down_seq) AS b FROM pairs), both_ AS (SELECT a, b FROM g UNION ALL SELECT b, a FROM g),
          reach AS (SELECT a, a AS b FROM both_ UNION SELECT reach.a, both_.b FROM reach JOIN both_ ON reach.b = both_.a),
          sizes AS (SELECT list_sort(list(n)) AS x, count(*) AS n FROM (SELECT c, count(*) AS n FROM (SELECT a, min(b) AS c FROM reach GROUP BY a) GROUP BY c))
          SELECT *, links - correct AS wrong, 0.04::DOUBLE AS density, true AS feasible FROM (SELECT count(*) FILTER (status = 'MATCHED') AS links, count(*) FILTER (status = 'MATCHED' AND seq = p.q) AS correct, count(*) FILTER (status = 'AMBIGUOUS') AS ambiguous, count(*) FILTER (status = 'UNMATCHED') AS unmatched, 0::BIGINT AS oversized,
            count(*) FILTER (status = 'NO_CANDIDATE') AS no_candidate, count(*) FILTER (status = 'DENSE') AS dense FROM f WHERE side = 'outbound'),
          (SELECT x[n // 2 + 1] AS component_p50, x[least(n, n * 99 // 100 + 1)] AS component_p99, x[n] AS component_max FROM sizes)""",
        "replay_scores": """WITH t AS (SELECT source, seq, min(lower(trim(point))) AS truth FROM timed_obs GROUP BY ALL),
          f AS (SELECT d.hop AS place, d.kind = 'LINKED' AS linked, a.truth AS x, b.truth AS y FROM (SELECT *, partners[1] AS p FROM flow_decisions WHERE status = 'FINAL') d LEFT JOIN t a ON a.source = d.source AND a.seq = d.seq LEFT JOIN t b ON b.source = d.p.source AND b.seq = d.p.seq)
          SELECT place, count(*) AS decisions, count(*) FILTER (linked) AS linked, count(*) FILTER (linked AND x = y) AS correct, count(*) FILTER (linked AND x IS DISTINCT FROM y) AS wrong, count(*) FILTER (NOT linked) AS undecided FROM f GROUP BY place""",
        "span_places": f"""SELECT CASE WHEN up THEN 'fake-upstream' WHEN srv THEN server WHEN cli THEN client END AS point, CASE WHEN up OR srv THEN 'inbound' WHEN cli THEN 'outbound' END AS side, count(*) AS n FROM (
          SELECT server, client, kind = 'SPAN_KIND_SERVER' AND host_port = '8443' AS up, kind = 'SPAN_KIND_SERVER' AND server IN ('hop-1', 'hop-2', 'hop-3') AS srv, kind = 'SPAN_KIND_CLIENT' AND client IN ('hop-1', 'hop-2', 'hop-3') AS cli FROM ({AGENT})) GROUP BY ALL""",
        "selected_spans": f"SELECT event_id FROM ({AGENT}) WHERE kind = 'SPAN_KIND_SERVER' AND host_port = '80' AND event_type = 'view' AND server = 'hop-1'",
        "header_traces": f"SELECT event_id, CASE WHEN header = 'broken' THEN '' ELSE substr(header, 4, 32) END AS trace FROM ({AGENT})",
        "core_saturation": f"SELECT second, max(busy) AS busiest, max(busy) >= 99 AS saturated FROM ({SAMPLES}) GROUP BY second",
        "process_load": f"SELECT process, round(sum(cpu) / (SELECT count(DISTINCT second) FROM ({SAMPLES})) / 100, 6) AS cores, CASE WHEN process IN ('view', 'click') THEN 'own' WHEN process = 'purchase' THEN 'declared' ELSE 'foreign' END AS whose FROM ({SAMPLES}) GROUP BY process ORDER BY cores DESC, process LIMIT 6",
        "missing_positions": _LOGS
        + """, e AS (SELECT trace_id AS id, row_number() OVER (ORDER BY min(timestamp_ns), trace_id) - 1 AS position FROM sent GROUP BY trace_id)
          SELECT position, id FROM e WHERE id NOT IN (SELECT trace_id FROM got) ORDER BY position LIMIT 20""",
    }
