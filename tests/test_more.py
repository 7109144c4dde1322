"""Links, timing, topology, gates, sources, store and streams."""

import functools
import itertools
import random
from datetime import datetime, timedelta, timezone
from decimal import Decimal as D

import numpy as np
import pytest

from tallyloom.functions.durations import duration_ns
from tallyloom.operators import analyses, flow, gates, links, observe, replay, runs, timing, topology
from tallyloom.operators.matching import Tolerance
from tallyloom.operators.redelivery import DeliveryStore
from tallyloom.plans.correlation import TOPOLOGY
from tallyloom.session import cut
from tallyloom.sources import logs, reports, statements, synthetic
from tallyloom.sources.store import Store
from tallyloom.streaming import live
from pyspark.sql import functions as F


def test_assignment_is_optimal():
    rng = np.random.default_rng(0)
    for _ in range(200):
        n = int(rng.integers(1, 6))
        cost = rng.integers(-9, 9, (n, n))
        total, column = timing.best_assignment(cost)
        assert total == min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n))) and sorted(column) == list(range(n))


def test_decide_by_margin():
    edges = [("a", "x", 10), ("a", "y", 9), ("b", "y", 5)]
    assert {(r[1], r[2]) for r in timing.decide(edges, 1)} == {("a", "MATCHED"), ("x", "MATCHED"), ("b", "MATCHED"), ("y", "MATCHED")}
    assert {r[2] for r in timing.decide(edges, 6)} == {"AMBIGUOUS"}
    assert timing.decide([("a", "x", 1)], 0)[0][2] == "MATCHED" and timing.decide([("a", "x", 1)], 1)[0][2] == "AMBIGUOUS"


def test_timing_against_all_pairs(spark):
    rng = random.Random(2)
    rows = [(side, i, s := rng.randrange(2_000), s + rng.randrange(200)) for side in ("u", "d") for i in range(60)]
    schema = "source string, seq long, start_us long, end_us long"
    up, down = (spark.createDataFrame([r for r in rows if r[0] == s] + [(s, 999, None, 5)], schema) for s in "ud")
    for signals in ((timing.Signal("start", -20, 30),), (timing.Signal("end", 15, 40), timing.Signal("duration", 5, 60))):
        params = timing.JoinParams(signals, margin_us=2, max_component=4, local_span_us=50, local_limit_permille=500)
        found = {(r.up_seq, r.down_seq): r.weight for r in timing.candidates(up, down, params).collect()}
        expected = {}
        for _, i, s, e in (r for r in rows if r[0] == "u"):
            for _, j, t, f in (r for r in rows if r[0] == "d"):
                gaps = {"start": t - s, "end": e - f, "duration": (e - s) - (f - t)}
                if all(abs(gaps[x.name] - x.offset_us) <= x.window_us for x in signals):
                    expected[i, j] = 1 + sum(x.window_us - abs(gaps[x.name] - x.offset_us) for x in signals)
        assert found == expected
        out = timing.timed_links(up, down, params).collect()
        assert len(out) == 122
        matched = {(r.seq, r.partner_seq) for r in out if r.side == "outbound" and r.status == "MATCHED"}
        assert matched == {(r.partner_seq, r.seq) for r in out if r.side == "inbound" and r.status == "MATCHED"} and matched <= set(expected)


def test_bad_timing_parameters():
    for signals, more in (((), {}), ((timing.Signal("start", 0, 0),), {}), ((timing.Signal("odd", 0, 1),), {}), ((timing.Signal("end", 0, 1),), {"local_limit_permille": 0})):
        with pytest.raises(ValueError):
            timing.JoinParams(signals, **more)


OBS = "source string, seq long, point string, side string, keys map<string,string>"


def test_links_collide_and_stay_alone(spark):
    joins = spark.createDataFrame([("p -> q", ["k"], "p", "outbound", "q", "inbound")], "place string, keys array<string>, up_point string, up_side string, down_point string, down_side string")
    obs = spark.createDataFrame([("a", 1, "p", "outbound", {"k": "1"}), ("b", 1, "q", "inbound", {"k": "1"}), ("a", 2, "p", "outbound", {"k": "2"}), ("a", 3, "p", "outbound", {"k": "2"}), ("b", 2, "q", "inbound", {"k": "3"}), ("b", 3, "q", "inbound", {}), ("b", 4, "q", "inbound", None), ("c", 1, "q", "outbound", {"k": "1"})], OBS)
    kinds = {r.value: (r.kind, r.n_up, r.n_down) for r in links.outcomes(links.values(obs, joins)).collect()}
    assert kinds == {"1": ("LINKED", 1, 1), "2": ("COLLIDED", 2, 0), "3": ("UNLINKED", 0, 1)}
    assert {r.value: r.ups for r in links.outcomes(links.values(obs, joins), 1).collect()}["2"] is None
    assert links.checked_distinct(obs.unionByName(obs), ["point", "side", "keys"]).count() == 8
    with pytest.raises(Exception, match="different content"):
        links.checked_distinct(obs.unionByName(obs.withColumn("point", F.lit("z"))), ["point", "side", "keys"]).collect()


def test_two_signals_of_a_hot_value(spark):
    n = spark.range(1_201)
    obs = n.select(F.lit("a").alias("source"), "id", F.lit("p").alias("point"), F.lit("outbound").alias("side"), F.when(F.col("id") == 0, F.create_map(F.lit("k"), F.lit("hot"), F.lit("c"), F.lit("own"))).otherwise(F.create_map(F.lit("k"), F.lit("hot"))).alias("keys"))
    obs = obs.withColumnRenamed("id", "seq").unionByName(spark.createDataFrame([("b", 0, "q", "inbound", {"c": "own"}), ("b", 1, "q", "inbound", {"k": "new"})], OBS))
    ends = "place string, keys array<string>, up_point string, up_side string, down_point string, down_side string"
    first, second = (links.values(obs, spark.createDataFrame([("p -> q", [k], "p", "outbound", "q", "inbound")], ends)) for k in ("k", "c"))
    out = {(r.source, r.seq): r.verdict for r in links.combined(first, second).collect()}
    assert out == {("a", i): "COLLIDED" for i in range(1_201)} | {("b", 0): "SIGNAL_ABSENT", ("b", 1): "UNLINKED"}


def test_topology_ceilings_and_refusals():
    t = topology.loads(TOPOLOGY)
    assert {f"{h['src']} -> {h['dst']}": (h["evidence"], h["link"], h["key"], h["observed"]) for h in t.hops} == {
        "p0 -> p1": ("authored", "shared_header", "traceparent", ["tuple5"]),
        "p1 -> p2": ("derived", "nested_timing", None, None),
        "p2 -> p0": ("authored", "shared_header", "traceparent", None),
    }
    assert [(c["point"], c["evidence"]) for c in t.crossings] == [("p0", "observed"), ("p1", "observed"), ("p2", "authored")]
    with pytest.raises(topology.TopologyError) as e:
        topology.loads('[points.a]\nvisibility = "kernel"\nodd = 1\n[[hops]]\nfrom = "a"\nto = "b"\nrelation = "fanout"\n')
    assert {r for r, _, _ in e.value.refusals} == {"MISSING_FIELD", "UNKNOWN_FIELD", "UNKNOWN_POINT", "FANOUT_UNBOUNDED"}
    with pytest.raises(topology.TopologyError, match="DENSITY_ABOVE_BOUND"):
        topology.loads(TOPOLOGY.replace("rate = 500", "rate = 5000"))
    with pytest.raises(topology.TopologyError, match="missing: no_message_key, no_shared_header"):
        topology.loads(TOPOLOGY.replace("rate = 500", 'expect = "authored"'))


def _metrics(**more):
    own = {"d_cov": D("0.9800"), "d_acc": D("0.9995"), "r": D("0.9000"), "t": D("0.8500"), "truth_coverage": D("0.9990"), "capture_failure": D("0.0010"), "n": 10_000, "n_residual": 10_000}
    return gates.Metrics(**(own | more))


def test_attribution():
    th = gates.Thresholds(D("0.90"))
    assert gates.decide(_metrics(), th)["nominal"] == "A"
    assert gates.decide(_metrics(t=D("0.5000")), th)["nominal"] == "A_WITH_WEAK_RESIDUAL"
    assert gates.decide(_metrics(d_acc=D("0.9800")), th)["nominal"] == "NEEDS_DIFFERENT_MECHANISM"
    assert gates.decide(_metrics(d_cov=D("0.5000")), th)["nominal"] == "B_HYBRID"
    assert gates.decide(_metrics(d_cov=D("0.5000"), t=D("0.1000")), th)["nominal"] == "C_SCORING_REQUIRED"
    assert gates.decide(_metrics(r=None, t=None, n_residual=None), th) == {"run": "VALID", "verdict": "CORRELATOR_NOT_MEASURED", "nominal": "CORRELATOR_NOT_MEASURED", "checked": False}
    assert gates.decide(_metrics(d_cov=D("0.9510")), th)["verdict"] == "BORDERLINE"
    assert gates.decide(_metrics(capture_failure=D("0.0200")), th)["run"] == "NULL"
    with pytest.raises(ValueError):
        _metrics(d_cov=D("0.12345"))
    with pytest.raises(ValueError):
        _metrics(t=D("0.9500"))


def test_stability_and_latency(spark):
    def reps(spread, n=5):
        rows = [(s, i, "m", D("0.9000") + (D(spread) if i % 2 and s == "fixed" else 0), 10_000) for s in ("fixed", "variable") for i in range(n)]
        return spark.createDataFrame(rows, "seed string, rep int, metric string, value decimal(10,4), ops long")

    assert gates.stability(reps("0")) == "STABLE" and gates.stability(reps("0.0500")) == "EXTEND_TO_10" and gates.stability(reps("0.0500", 10)) == "UNSTABLE" and gates.stability(reps("0", 4)) == "INSUFFICIENT"
    df = lambda v: spark.createDataFrame([(x,) for x in v], "latency_s double")
    verdict = lambda v: gates.latency_gate(df(v)).first().verdict
    assert verdict([0.5] * 100) == "PASS" and verdict([0.5] * 90 + [1.5] * 10) == "FAIL" and verdict([0.5] * 99) == "TOO_FEW" and verdict([0.5] * 99 + [float("nan")]) == "NOT_FINITE" and verdict([0.5] * 99 + [-0.1]) == "NEGATIVE"
    with pytest.raises(Exception, match="no skew"):
        gates.availability(spark.createDataFrame([("n", 1.0, 2.0)], "node string, event_time double, ingest_time double"), spark.createDataFrame([], "node string, skew_s double")).collect()


def test_durations(spark):
    texts = {"1m2.5s": 62_500_000_000, "850µs": 850_000, "41.5ms": 41_500_000, "1h": 3_600_000_000_000, "7ns": 7, "": None, "5": None, "5 s": None, "abc": None, "1.2.3s": None}
    rows = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string").select("t", duration_ns(F.col("t")).alias("n")).collect()
    assert {r.t: r.n for r in rows} == texts | {None: None}


SPAN_LINE = '[{"spanID":"a","start":"1","attributes":{"url":"/x"}},{"spanID":"b"}]'
PRINTED = "2026-01-01 12:00:00 (1m2.5s[850µs]) HTTP(subType=0) 200 GET /x(/x) [10.0.0.1]->[10.0.0.2] size svc=[edge go] traceparent=[00-0123456789abcdef0123456789abcdef-0123456789abcdef-01]"


def test_logs(spark, tmp_path):
    (tmp_path / "agent.log").write_text("\n".join(["starting", SPAN_LINE, "[{broken", PRINTED, "x HTTP(subType=0) odd", SPAN_LINE.replace('"a"', '"c"')]))
    lines = logs.numbered_lines(spark, f"file://{tmp_path}/agent.log").cache()
    assert [(r.seq, r.spanID) for r in logs.agent_spans(lines).orderBy("seq").collect()] == [(1, "a"), (2, "b"), (3, "c"), (4, "b")]
    assert logs.corrupt_arrays(lines).first().corrupt == 1
    events = {r.parsed: r for r in logs.printed_events(lines).collect()}
    assert (events[True].event, events[True].status, events[True].service, events[True].trace_id, events[True].duration_ns) == ("HTTP", 200, "edge", "0123456789abcdef" * 2, 62_500_000_000) and False in events
    assert logs.line_range(lines, 1, 3).count() == 2
    (tmp_path / "cores.txt").write_text("12:00:01 3 1 1 1 1 1 1 1 1 1 40.0\nheader\n")
    assert [tuple(r) for r in logs.core_samples(logs.numbered_lines(spark, f"file://{tmp_path}/cores.txt")).collect()] == [("12:00:01", 3, 60.0)]


def _statement(entry="", account="<IBAN>DE1</IBAN>", head=""):
    own = entry or '<Ntry><Amt Ccy="EUR">12.50</Amt><CdtDbtInd>DBIT</CdtDbtInd><Sts><Cd>BOOK</Cd></Sts><ValDt><Dt>2026-01-02</Dt></ValDt></Ntry>'
    return f'{head}<Document xmlns="{statements.NAMESPACE}"><BkToCstmrStmt><Stmt><Id>1</Id><Acct><Id>{account}</Id></Acct>{own}</Stmt></BkToCstmrStmt></Document>'.encode()


def test_statements_and_store(spark, tmp_path):
    good = statements.entries(_statement())
    assert good == [("/Document/BkToCstmrStmt/Stmt[1]/Ntry[1]", "DE1", D("-12.50"), "-12.50", datetime(2026, 1, 2).date(), "EUR")]
    base = _statement().decode()
    for bad in (base.replace("12.50", "1e3"), base.replace("BOOK", "PDNG"), base.replace("001.08", "001.02"), base.replace("2026-01-02", "2026-1-2"), base.replace("<IBAN>DE1</IBAN>", ""), base.replace("EUR", "eur"), "<!DOCTYPE x>" + base, base.replace("DBIT", "X"), "<Document"):
        with pytest.raises((ValueError, SyntaxError)):
            statements.entries(bad.encode())
    store = Store(spark, f"file://{tmp_path}/store")
    at = datetime(2026, 1, 3, tzinfo=timezone.utc)
    raw = spark.createDataFrame([("bank", at, _statement()), ("bank", at, _statement()), ("bank", at, b"<x/>"), ("other", at, _statement(account="<Othr><Id>9</Id></Othr>"))], "source string, received_at timestamp, payload binary")
    records, errors = store.ingest(raw)
    assert sorted(r.account for r in records.collect()) == ["9", "DE1"] and errors.count() == 1
    assert store.ingest(raw)[0].count() == 0 and store.raw().count() == 3
    rows = records.select(F.col("record_id").alias("id"), F.lit("x").alias("account"), "amount", "value_date", F.lit(None).cast("string").alias("reference"), "currency").collect()
    schema = "id string, account string, amount decimal(18,2), value_date date, reference string, currency string"
    left, right = (spark.createDataFrame([r], schema) for r in rows)
    run_id, outcome = store.run(left, right, Tolerance(), "v1")
    assert outcome.matches.first().rule == "M1_EXACT"
    assert store.replay(run_id, left, right, Tolerance(), "v1").matches.count() == 1
    with pytest.raises(ValueError):
        store.replay(run_id, left, right, Tolerance(), "v2")
    with pytest.raises(ValueError):
        store.run(left, left, Tolerance(), "v1")
    assert store.lineage(run_id).count() == 2
    one = left.first()["id"]
    assert [r.record_id for r in store.lineage(run_id, one).collect()] == [one] and store.records(left.select(F.col("id").alias("record_id"))).count() == 1
    for bad in (lambda: store.lineage(run_id, "other"), lambda: store.read_run("other")):
        with pytest.raises(ValueError):
            bad()
    known = spark.read.parquet(f"{tmp_path}/store/records")
    with pytest.raises(ValueError, match="other content"):
        store._add("records", known.limit(1).withColumn("currency", F.lit("XXX")), "record_id", ["currency"])
    known.withColumn("amount_text", F.lit("1.00")).withColumn("record_id", F.concat("record_id", F.lit("x"))).write.mode("append").parquet(f"{tmp_path}/store/records")
    with pytest.raises(Exception, match="damaged record"):
        store.records().collect()


def test_flow_finals(spark):
    ends = [("p", "outbound"), ("q", "inbound")]
    rows = [("f", 10 * n + i, s, n, *ends[i], {"traceparent": f"t{n}"} | ({"tuple5": f"c{n}"} if n != 2 else {}), 100 * n + i) for n in range(6) for i, s in enumerate(("x", "y")) if (n, i) != (3, 1)]
    rows += [("f", 58, "x", 70, "p", "outbound", {"traceparent": "t0"}, 501), ("f", 59, "x", 71, "p", "outbound", {"traceparent": "z"}, 20)]
    seen = spark.createDataFrame(rows, "flow_id string, pos long, source string, seq long, point string, side string, keys map<string,string>, time long")
    config = spark.createDataFrame([("f", ["x", "y"], 50, 30, None)], "flow_id string, sources array<string>, window_us long, lateness_us long, max_silence_us long")
    joins = spark.createDataFrame([("p -> q", [k], a, "p", "outbound", "q", "inbound") for k, a in (("traceparent", True), ("tuple5", False))], "place string, keys array<string>, authored boolean, up_point string, up_side string, down_point string, down_side string")
    steps = flow.replay(seen, flow.timeline(seen, config), config, joins).cache()
    out = {(r.source, r.seq): (r.kind, r.corroboration, r.status) for r in flow.in_effect(steps).collect()}
    assert out["x", 0] == out["y", 0] == ("LINKED", "CORROBORATED", "FINAL") and out["x", 2] == ("LINKED", "SIGNAL_ABSENT", "FINAL") and out["x", 3] == ("UNLINKED", None, "FINAL")
    assert out["x", 5][2] == "PROVISIONAL" and out["x", 70][0] == "VALUE_AFTER_FINAL" and out["x", 71][0] == "LATE"
    chain = sorted((r.chain_version, r.status, r.kind, r.supersedes, r.decision_id) for r in steps.filter("source = 'x' and seq = 0").collect())
    assert [c[1:3] for c in chain] == [("PROVISIONAL", "UNLINKED"), ("PROVISIONAL", "LINKED"), ("FINAL", "LINKED")] and [c[3] for c in chain] == [None, *(c[4] for c in chain[:-1])]
    assert {(r.observations, r.decisions, r.forced) for r in flow.proofs(steps).collect()} == {(2, 2, False), (1, 1, False)}
    assert [(m.source, m.seq) for m in next(r for r in steps.collect() if (r.source, r.seq, r.status) == ("y", 2, "FINAL")).missing_on] == [("x", 2), ("y", 2)]


def _flow_by_the_book(rows, window, lateness, sources, joins, most):
    """Decisions in effect of one flow, matching all open observations anew whenever a group closes, straight from the definition."""
    reached, first, open_, closed, done = dict.fromkeys(sources), None, {}, set(), {}
    mark = lambda: None if first is None else min(first if r is None else r for r in reached.values()) - lateness
    value = lambda m, keys: None if any(k not in m["keys"] for k in keys) else (keys, tuple(m["keys"][k] for k in keys))

    def groups():
        left, found = set(open_), []
        while left:
            group, new = set(), {min(left)}
            while new:
                group |= new
                held = {v for i in new for ks, *_ in joins if (v := value(open_[i], ks))}
                new = {j for j in left - group for ks, *_ in joins if value(open_[j], ks) in held}
            left -= group
            found.append(group)
        return found

    def outcome(group, identity, join):
        keys, authored, up, down = join
        m = open_[identity]
        at = (m["point"], m["side"])
        if at not in (up, down) or value(m, keys) is None:
            return None
        same = [i for i in group if value(open_[i], keys) == value(m, keys)]
        ends = [[i for i in same if (open_[i]["point"], open_[i]["side"]) == e] for e in (up, down)]
        other = ends[1] if at == up else ends[0]
        if max(map(len, ends)) > 1:
            return "COLLIDED", sorted(other) if authored and sum(map(len, ends)) <= most else []
        return ("LINKED" if other else "UNLINKED"), other

    def verdict(group, identity):
        a, b = (outcome(group, identity, j) for j in joins)
        for o in (a, b):
            if o and o[0] == "COLLIDED":
                return (*o, None)
        linked = [o for o in (a, b) if o and o[0] == "LINKED"]
        if len(linked) == 2:
            return ("LINKED", a[1], "CORROBORATED") if a[1] == b[1] else ("CONFLICTED", sorted({*a[1], *b[1]}), "SIGNAL_OTHER_PARTNER")
        if linked:
            lacking = [i for i in (identity, *linked[0][1]) if not outcome(group, i, joins[1] if linked[0] is a else joins[0])]
            return ("LINKED", linked[0][1], "SIGNAL_ABSENT") if lacking else ("CONFLICTED", linked[0][1], "SIGNAL_UNMATCHED")
        return (*(a or b), None) if a or b else None

    def settle(at):
        for group in groups():
            if at is not None and max(open_[i]["time"] for i in group) + window < at:
                done.update({i: (*v, "FINAL") for i in group if (v := verdict(group, i))})
                for i in group:
                    closed.update((k, v) for k, v in open_[i]["keys"].items() if (k,) == joins[0][0])
                for i in group:
                    del open_[i]

    for m in rows:
        identity, before = (m["source"], m["seq"]), mark()
        settle(before)
        first = m["time"] if first is None else min(first, m["time"])
        reached[m["source"]] = max(m["time"], reached[m["source"]] if reached[m["source"]] is not None else m["time"])
        if before is not None and m["time"] < before:
            done[identity] = ("LATE", [], None, "FINAL")
        elif any((k, v) in closed for k, v in m["keys"].items() if (k,) == joins[0][0]):
            done[identity] = ("VALUE_AFTER_FINAL", [], None, "FINAL")
        else:
            open_[identity] = m
    settle(mark())
    for group in groups():
        done.update({i: (*v, "PROVISIONAL") for i in group if (v := verdict(group, i))})
    return done


def test_flow_against_the_definition(spark):
    rows, expected = [], {}
    joins = [(("traceparent",), True, ("p", "outbound"), ("q", "inbound")), (("tuple5",), False, ("p", "outbound"), ("q", "inbound"))]
    for seed in range(25):
        rng, own = random.Random(seed), []
        for pos in range(40):
            keys = {k: v for k, v in (("traceparent", f"t{rng.randrange(12)}"), ("tuple5", f"c{rng.randrange(12)}")) if rng.random() < 0.8}
            point, side = rng.choice([("p", "outbound"), ("q", "inbound"), ("q", "outbound")])
            own.append({"source": rng.choice("xy"), "seq": pos, "point": point, "side": side, "keys": keys, "time": pos * 10 + rng.randrange(-60, 20)})
        expected |= {(f"f{seed}", *i): v for i, v in _flow_by_the_book(own, 50, 30, "xy", joins, 3).items()}
        rows += [(f"f{seed}", pos, m["source"], m["seq"], m["point"], m["side"], m["keys"], m["time"]) for pos, m in enumerate(own)]
    seen = spark.createDataFrame(rows, "flow_id string, pos long, source string, seq long, point string, side string, keys map<string,string>, time long")
    config = spark.createDataFrame([(f"f{s}", ["x", "y"], 50, 30, None) for s in range(25)], "flow_id string, sources array<string>, window_us long, lateness_us long, max_silence_us long")
    declared = spark.createDataFrame([("p -> q", list(k), a, *u, *d) for k, a, u, d in joins], "place string, keys array<string>, authored boolean, up_point string, up_side string, down_point string, down_side string")
    out = flow.in_effect(flow.replay(seen, flow.timeline(seen, config), config, declared, 3)).collect()
    assert {(r.flow_id, r.source, r.seq): (r.kind, [(p.source, p.seq) for p in r.partners], r.corroboration, r.status) for r in out} == expected
    assert {v[0] for v in expected.values()} == {"LATE", "VALUE_AFTER_FINAL", "LINKED", "UNLINKED", "COLLIDED", "CONFLICTED"}


def test_flow_entry_checks(spark):
    config = spark.createDataFrame([("f", ["x"])], "flow_id string, sources array<string>")
    schema = "flow_id string, pos long, kind string, source string, at_us long, start_us long, end_us long, until_us long"
    good = [("f", 0, "seen", "x", 5, None, None, None), ("f", 1, "seen", "x", 9, 5, 9, None), ("f", 2, "advance", "x", None, None, None, 9)]
    bad = [("f", 3, "scene", "x", 5, None, None, None), ("f", 4, "seen", "z", 5, None, None, None), ("g", 5, "advance", "x", None, None, None, 9), ("f", 6, "advance", "x", None, None, None, None), ("f", 7, "seen", "x", 9, 5, None, None), ("f", 8, "seen", "x", 4, 5, 4, None), ("f", 9, "seen", "x", 8, 5, 9, None), (None, 10, "seen", "x", 1, None, None, None)]
    told = {r.pos: r.refusal for r in flow.refused(spark.createDataFrame(good + bad, schema), config).collect()}
    assert [p for p, r in sorted(told.items()) if r is None] == [0, 1, 2]
    assert flow.checked(spark.createDataFrame(good, schema), config).count() == 3
    with pytest.raises(Exception, match="undeclared source"):
        flow.checked(spark.createDataFrame(good + bad[1:2], schema), config).collect()


def test_timed_links_of_a_flow(spark):
    end = timing.Signal("end", 0, 10)
    for params, longest in ((timing.JoinParams((timing.Signal("start", 0, 5),)), None), (timing.JoinParams((end,), local_span_us=5), None)):
        with pytest.raises(ValueError):
            flow.timed(None, None, {}, {"p -> q": params}, longest)
    assert flow.horizon_us(timing.JoinParams((timing.Signal("end", -7, 10),), local_span_us=9), 40) == 49
    rows = [("f", 0, "x", 0, "p", "outbound", 10, 0, 10), ("f", 1, "y", 0, "q", "inbound", 12, 3, 12), ("f", 2, "x", 1, "p", "outbound", 30, None, 30), ("f", 3, "y", 1, "q", "inbound", 90, 0, 90), ("f", 4, "x", 2, "p", "outbound", 1, 0, 1), ("g", 5, "y", 2, "q", "inbound", 1, 0, 1)]
    seen = spark.createDataFrame(rows, "flow_id string, pos long, source string, seq long, point string, side string, time long, start_us long, end_us long")
    marks = spark.createDataFrame([(r[0], r[1], 5 if r[1] == 4 else None) for r in rows], "flow_id string, pos long, mark_before long")
    out = {(r.flow_id, r.source, r.seq): (r.kind, r.reason, r.partner_seq) for r in flow.timed(seen, marks, {"p -> q": ("p", "q")}, {"p -> q": timing.JoinParams((end,))}, 50).collect()}
    assert out == {("f", "x", 0): ("LINKED", None, 0), ("f", "y", 0): ("LINKED", None, 0), ("f", "x", 1): ("UNDECIDED", "TIME_ABSENT", None), ("f", "y", 1): ("UNDECIDED", "TOO_LONG", None), ("g", "y", 2): ("UNDECIDED", "NO_CANDIDATE", None)}


def test_flow_crowded_value(spark):
    """A value of over 512 holders collides as one of few does, and a connection that comes back as often still links."""
    rows = []
    for f, many in (("few", 20), ("many", 600)):
        rows += [(f, 2 * n + i, s, n, *e, k, n * 40 // many) for n in range(many) for i, (s, e, k) in enumerate((("x", ("p", "outbound"), {"traceparent": "hot", "tuple5": f"c{n}"}), ("y", ("q", "inbound"), {"tuple5": f"c{n}"})))]
    rows += [("back", 4 * n + i, s, n, *e, {"tuple5": "c"}, 1000 * n + i) for n in range(600) for i, (s, e) in enumerate((("x", ("p", "outbound")), ("y", ("q", "inbound"))))]
    seen = spark.createDataFrame(rows, "flow_id string, pos long, source string, seq long, point string, side string, keys map<string,string>, time long")
    config = spark.createDataFrame([(f, ["x", "y"], 50, 30, None) for f in ("few", "many", "back")], "flow_id string, sources array<string>, window_us long, lateness_us long, max_silence_us long")
    joins = spark.createDataFrame([("p -> q", [k], a, "p", "outbound", "q", "inbound") for k, a in (("traceparent", True), ("tuple5", False))], "place string, keys array<string>, authored boolean, up_point string, up_side string, down_point string, down_side string")
    moved = seen.select("flow_id", "pos", "source", "time").unionByName(spark.createDataFrame([("back", 4 * n + 2 + i, s, 1000 * n + 500) for n in range(600) for i, s in enumerate("xy")], "flow_id string, pos long, source string, time long"))
    told = {f: [] for f in ("few", "many", "back")}
    for r in flow.in_effect(flow.replay(seen, flow.timeline(moved, config), config, joins)).collect():
        told[r.flow_id].append((r.source, r.kind, r.key, r.value if r.key == "traceparent" else None, len(r.partners), r.status))
    assert len(told["many"]) == 1_200 and set(told["many"]) == set(told["few"]) and ("x", "COLLIDED", "traceparent", "hot", 0, "PROVISIONAL") in told["many"]
    assert len(told["back"]) == 1_200 and {t[1] for t in told["back"]} == {"LINKED"}


def test_analyses(spark):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(40)], "k long, t string")
    moved = analyses.shuffled(df, "t", ["k"], 3)
    assert sorted(r.t for r in moved.collect()) == sorted(r.t for r in df.collect())
    score = analyses.ordinal_join(df, moved, ["k"], "t").groupBy("outcome").count().collect()
    assert {r["outcome"]: r["count"] for r in score}.get("correct", 0) < 8
    paired = analyses.paired_in_order(df.withColumn("g", F.lit(1)), df.withColumn("g", F.lit(1)), ["g"], ["k"], ["t"]).collect()
    assert len(paired) == 40 and all(r.t_left == r.t_right for r in paired)


def test_window_match_against_all_pairs(spark):
    rng = random.Random(6)
    sides = [[(f"{p}{i:02d}", i, rng.randrange(100)) for i in range(40)] for p in "lr"]
    schema = "id string, rank long, measure long"
    found = {(r.left_id, r.right_id) for r in analyses.window_match(*(spark.createDataFrame(s, schema) for s in sides), "measure", F.lit(20), 3).collect()}
    used, expected = set(), set()
    for _, a, b in sorted((abs(x - y), a, b) for a, i, x in sides[0] for b, j, y in sides[1] if abs(i - j) <= 3 and abs(x - y) <= 20):
        if not used & {a, b}:
            used |= {a, b}
            expected.add((a, b))
    assert found == expected


def test_made_traffic(spark):
    sent = synthetic.requests(spark, 2_000, 1_000.0, 3)
    assert sent.select("trace_id").distinct().count() == 2_000 and {tuple(r) for r in sent.collect()} == {tuple(r) for r in synthetic.requests(spark, 2_000, 1_000.0, 3).collect()}
    fresh = synthetic.relayed(sent, 3, fresh=True)
    assert synthetic.relayed(sent, 3).filter("trace_id <> ''").count() == 0 and fresh.join(sent, "trace_id").count() == 0 and fresh.join(sent, "path").count() == 2_000
    answered = synthetic.upstream(sent, 3).withColumn("s", (F.col("timestamp_ns") - F.col("arrival_ns")) / 1e9)
    told = answered.agg(F.median("s").alias("m"), F.count_if(F.col("s") > 0.9).alias("stalls"), F.max("response_size").alias("b"), F.min("s").alias("low")).first()
    assert 0.018 < told.m < 0.022 and 1 <= told.stalls <= 25 and told.b <= 4096 and told.low > 0
    left, right = synthetic.two_sided_events(spark, 500, 1_000.0, 2_000, 5)
    pairs = left.select(F.substring("id", 2, 9).alias("n"), "t").join(right.select(F.substring("id", 2, 9).alias("n"), F.col("t").alias("u")), "n")
    assert pairs.count() == 500 and pairs.filter("abs(t - u) > 2000").count() == 0 and pairs.filter("t <> u").count() > 400


def test_flow_on_journals_with_faults(spark):
    """What each fault does to the final links, beside a journal without any."""
    names = ["none", "reuse", "swap", "swap_inside", "loss", "late", "duplicates", "keyless"]
    parts, configs = [], []
    for name in names:
        made = synthetic.journal(spark, 60, 1, synthetic.Faults(**({} if name == "none" else {name: 0.2}), disorder_us=300), 11)
        parts.append(made[0].withColumn("flow_id", F.lit(name)))
        configs.append(made[1].withColumn("flow_id", F.lit(name)))
    journal, config = (cut(functools.reduce(lambda a, b: a.unionByName(b), x)) for x in (parts, configs))
    marks = flow.timeline(journal, config)
    seen = journal.filter("kind = 'seen'").groupBy("flow_id", "source", "seq").agg(F.min_by(F.struct("pos", "point", "side", "keys", "time", "exchange", "fault"), "pos").alias("f")).select("flow_id", "source", "seq", "f.*")
    out = flow.in_effect(flow.replay(seen.drop("exchange", "fault"), marks, config, synthetic.hops_of(spark, 1))).collect()
    truth = {(r.flow_id, r.source, r.seq): (r.exchange, r.fault) for r in seen.collect()}
    faults = {(r.flow_id, r.fault): r["count"] for r in journal.groupBy("flow_id", "fault").count().collect()}
    assert {r.status for r in out} == {"FINAL"}
    kinds = {n: {r.kind for r in out if r.flow_id == n} for n in names}
    said = {n: {r.corroboration for r in out if r.flow_id == n and r.kind == "LINKED"} for n in names}
    assert all(truth[r.flow_id, r.source, r.seq][0] == truth[r.flow_id, r.partners[0].source, r.partners[0].seq][0] for r in out if r.kind == "LINKED")
    for n in ("none", "duplicates"):
        assert kinds[n] == {"LINKED"} and said[n] == {"CORROBORATED"} and sum(r.flow_id == n for r in out) == 240
    assert faults["duplicates", "duplicate"] > 10 and faults["swap_inside", "swap_inside"] > 0
    assert kinds["reuse"] & {"COLLIDED", "CONFLICTED"} and kinds["swap"] & {"COLLIDED", "CONFLICTED"}  # the connection contradicts the id
    assert kinds["swap_inside"] == {"LINKED"}  # both ends of the hop behind the relay carry the other id: nothing tells
    assert kinds["loss"] == {"LINKED", "UNLINKED"}
    assert {(r.source, r.seq) for r in out if r.flow_id == "late" and r.kind == "LATE"} == {k[1:] for k, v in truth.items() if v[1] == "late"} != set()
    assert kinds["keyless"] == {"LINKED"} and said["keyless"] == {"CORROBORATED", "SIGNAL_ABSENT"}


def test_reports_and_calibrations(spark, tmp_path):
    cell = tmp_path / "c1"
    cell.mkdir()
    (tmp_path / "cells.txt").write_text("c0: x\nc1: run-mask propagation=headers\n")
    (cell / "port").write_text("8443\n")
    assert reports.cell_metadata(cell) == {"hops": 0, "kinds": [], "port": 8443, "propagation": "headers", "masked": True}
    (cell / "cell.json").write_text('{"hops": 2, "hop_kind": "relay", "fake_upstream_port": 80}')
    assert reports.cell_metadata(cell) == {"hops": 2, "kinds": ["relay", "relay"], "port": 80, "propagation": "agent-default", "masked": False}
    params = {'a -> "b"': ("handlerStart", timing.JoinParams((timing.Signal("end", -3, 20), timing.Signal("duration", 1, 5)), margin_us=7))}
    inputs = [reports.fingerprint([cell / "port"]), reports.fingerprint([cell / "cell.json"])]
    text = reports.calibration_text(params, inputs)
    assert reports.calibration(text, inputs[::-1]) == params
    with pytest.raises(ValueError):
        reports.calibration(text, inputs[:1])
    chosen = spark.createDataFrame([("a -> b", "start", "end", 1, 4, 9, 3), ("a -> b", "start", "duration", 2, 0, 20, 3)], "place string, receiver_start string, signal string, rank int, offset_us long, window_us long, margin_us long")
    assert reports.params_of(chosen, "place") == {"a -> b": ("start", timing.JoinParams((timing.Signal("end", 4, 9), timing.Signal("duration", 0, 20)), margin_us=3))}
    df = spark.createDataFrame([(2, None), (1, "x")], "n long, t string")
    assert reports.table_text(df, ["n"]) == "n  t\n1  x\n2  -\n"
    reports.write_truth(df, f"file://{tmp_path}/truth")
    reports.write_truth(df, f"file://{tmp_path}/truth")
    reports.write_report(df, f"file://{tmp_path}/report")
    assert spark.read.json(f"file://{tmp_path}/truth").count() == 4 and spark.read.json(f"file://{tmp_path}/report").count() == 2


def test_derived_metrics_and_capture_days(spark):
    th = gates.Thresholds(D("0.9"))
    m = gates.Metrics(D("0.90"), D("0.99"), D("0.80"), D("0.40"), D("0.97"), D("0.00"), 10_000, 10_000)
    assert m.derived(th) == {"d": D("0.8910"), "f": D("0.1090"), "e": D("0.8910") + D("0.1090") * D("0.40"), "q": D("0.5")}
    assert gates.Metrics(D("0.90"), D("0.99"), D("0.70"), D("0.40"), D("0.97"), D("0.00"), 10_000, 10_000).derived(th)["q"] is None
    for bad in ({"silent_days": -1}, {"max_capture_failure": D("1.5")}):
        with pytest.raises(ValueError):
            observe.EvidenceRule(**bad)
    at = spark.createDataFrame([(datetime(2026, 1, 1, 23, 59, tzinfo=timezone.utc),)], "t timestamp")
    assert at.select(observe.capture_day(at, "t").alias("d")).first().d == datetime(2026, 1, 1).date()
    with pytest.raises(ValueError, match="zone"):
        observe.capture_day(at.select(F.col("t").cast("timestamp_ntz").alias("t")), "t")
    none = at.select(F.lit(None).cast("timestamp").alias("t"))
    with pytest.raises(Exception, match="no time"):
        none.select(observe.capture_day(none, "t")).collect()


def test_truth_ids_headers_and_places(spark):
    t = "0123456789abcdef" * 2
    paths = {f"/truth-{t}": t, f"/x/truth-{t}/y": t, f"/truth-{t}?q": t, f"/truth-{t}0": None, "/truth-abc": None, "": None, None: None}
    assert {r.p: r.t for r in spark.createDataFrame([(p,) for p in paths], "p string").select("p", runs.truth_id(F.col("p")).alias("t")).collect()} == paths
    headers = {f"00-{t}-1-01": t, "a-b-c": "", "": "", "a-b-c-d-e": ""}
    assert {r.h: r.t for r in spark.createDataFrame([(h,) for h in headers], "h string").select("h", runs.trace_of(F.col("h")).alias("t")).collect()} == headers
    few = spark.createDataFrame([("a", None), ("a", 5), ("b", None)], "g string, v long")
    assert [tuple(r) for r in runs.order_statistics(few, ["g"], "v", {"p": ("nearest", "0.5"), "m": ("median", "0.5")}).collect()] == [("a", 1, 5, 5.0)]
    assert runs.order_statistics(few.limit(0), ["g"], "v", {"p": ("floor", "0.5")}).count() == 0


def test_streams_equal_batches(spark, tmp_path):
    rng = random.Random(4)
    rows = [("f", pos, rng.choice("xy"), pos, rng.random() < 0.8, pos + rng.randrange(-120, 20)) for pos in range(300)]
    rows = [(*rows[pos - 1][:1], pos, *rows[pos - 1][2:]) if pos % 7 == 0 and pos else r for pos, r in enumerate(rows)]  # some come twice
    schema = "flow_id string, pos long, source string, seq long, seen boolean, time long"
    results = []
    for parts in (1, 4):
        src = tmp_path / f"in{parts}"
        src.mkdir()
        for i in range(parts):
            size = 300 // parts
            spark.createDataFrame(rows[i * size : (i + 1) * size], schema).coalesce(1).write.parquet(f"{src}/b{i}")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(src))
        counts = live.period_counts(stream, {"f": ["x", "y"]}, {"f": 30}, {"f": 25})
        q = counts.writeStream.format("memory").queryName(f"periods{parts}").outputMode("append").option("checkpointLocation", f"{tmp_path}/c{parts}").start()
        q.processAllAvailable()
        q.stop()
        told = {}
        for r in spark.table(f"periods{parts}").orderBy("pos").collect():
            if not r.refused:
                told[r.period_start_us] = (r.rows, r.corrections)
        assert spark.table(f"periods{parts}").filter("refused > 0").count() > 0
        results.append(told)
    assert results[0] == results[1]


def test_delivered_stream(spark, tmp_path):
    schema = "source string, seq long, captured_at timestamp"
    at = datetime(2026, 1, 1, tzinfo=timezone.utc)
    (tmp_path / "in").mkdir()
    for i in range(2):
        spark.createDataFrame([("a", n, at) for n in range(10 * i, 10 * i + 20)] * 2, schema).coalesce(1).write.parquet(f"{tmp_path}/in/b{i}")
    store = DeliveryStore(f"file://{tmp_path}/store", ["source", "seq"], "captured_at")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    q = live.deliver(stream, store, f"{tmp_path}/check")
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(f"{tmp_path}/store/rows").groupBy("seq").count().filter("count > 1").count() == 0
    assert spark.read.parquet(f"{tmp_path}/store/rows").count() == 30


def test_reconciliation_in_batches_equals_one_replay(spark, tmp_path):
    rng = random.Random(9)
    rows, day = [], datetime(2026, 1, 1).date()
    for pos in range(120):
        if pos % 10 == 9:
            rows.append((pos, "progress", rng.choice(["left", "right"]), None, None, None, None, None, None, day + timedelta(pos // 10)))
        else:
            rows.append((pos, "arrival", rng.choice(["left", "right"]), f"r{pos}", rng.choice("ab"), D(rng.randrange(1, 4)), day + timedelta(pos // 10 + rng.randrange(-2, 2)), rng.choice([None, "A", "B"]), rng.choice([None, "EUR"]), None))
    rows += [(120 + i, *rows[i][1:]) for i in (3, 70)]  # delivered again
    schema = "pos long, kind string, side string, id string, account string, amount decimal(18,2), value_date date, reference string, currency string, until date"
    config = replay.StreamConfig(Tolerance(D("1"), D(0), 2, 2, 8), lateness_days=1, max_component_days=4)
    whole = {(r.decided_at, r.side, r.id, r.decision_id, r.supersedes, r.status) for r in replay.replay(spark.createDataFrame(rows, schema), config).collect()}
    own = live.Reconciliation(f"file://{tmp_path}/r", config)
    for n, low in enumerate(range(0, len(rows), 50)):
        own.accept(spark.createDataFrame(rows[low : low + 50], schema), n)
        if n == 1:
            own.accept(spark.createDataFrame(rows[low : low + 50], schema), n)  # given again
    assert {(r.decided_at, r.side, r.id, r.decision_id, r.supersedes, r.status) for r in own.decisions(spark).collect()} == whole
    with pytest.raises(Exception, match="different content"):
        own.accept(spark.createDataFrame([(200, "arrival", *rows[0][2:5], D(77), *rows[0][6:])], schema), 3)
