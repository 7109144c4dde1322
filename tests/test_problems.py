"""The general problems on small inputs: nulls, ties, repeats, empty tables, clashing names, and against brute force."""

import json
import random
from datetime import datetime, timedelta, timezone

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyloom.operators import differences, late_events, nested, redelivery
from tallyloom.operators.ranking import ranked

T0 = datetime(2026, 1, 1, tzinfo=timezone.utc)
MESSAGES = "source string, seq long, captured_at timestamp, _h string, _bucket string, k0 string, row string"


def _messages(spark, rows):
    return spark.createDataFrame([(s, q, None if t is None else T0 + timedelta(seconds=t), a, "b", "c", "d") for s, q, t, a in rows], MESSAGES)


@pytest.mark.parametrize("most", [64 << 20, 0])
def test_redelivery_against_counts(spark, most):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), rng.randrange(400), rng.choice([None, 5, 9_000, 100_000, 90_000_000]), str(i)) for i in range(600)] + [("hot", 1, 7, "x")] * 300
    df = _messages(spark, rows)
    counts = {}
    for s, q, *_ in rows:
        counts[s, q] = counts.get((s, q), 0) + 1
    found = redelivery.repeats(df, ["source", "seq"], "captured_at", max_filter_bytes=most)
    assert {(r.source, r.seq): r.copies for r in found.collect()} == {k: n for k, n in counts.items() if n > 1}
    once = redelivery.exactly_one(df, ["source", "seq"], "captured_at", max_filter_bytes=most).collect()
    assert sorted((r.source, r.seq) for r in once) == sorted(counts)
    first = {}
    for s, q, t, a in rows:
        key = (t is None, t, a)
        first[s, q] = min(first.get((s, q), key), key) if (s, q) in first and (first[s, q][1] is None) == (t is None) else min(first.get((s, q), key), key, key=lambda k: k[0])
    assert {(r.source, r.seq): r["_h"] for r in once} == {k: v[2] for k, v in first.items()}


def test_redelivery_without_identity_and_empty(spark):
    df = _messages(spark, [(None, 1, 1, "a"), (None, 1, 1, "a"), ("s", None, None, "a"), ("s", None, None, "a"), ("s", 1, 1, "a")])
    assert redelivery.repeats(df, ["source", "seq"], "captured_at").count() == 0
    assert redelivery.exactly_one(df, ["source", "seq"], "captured_at").count() == 5
    none = df.limit(0)
    assert redelivery.repeats(none, ["source", "seq"], "captured_at").count() == 0
    assert redelivery.exactly_one(none, ["source", "seq"], "captured_at").columns == df.columns


def test_delivery_store_takes_each_message_once(spark, tmp_path):
    store = redelivery.DeliveryStore(f"file://{tmp_path}/s", ["source", "seq"], "captured_at")
    a = _messages(spark, [("a", i, i * 900, "x") for i in range(50)] + [("a", 3, 2, "y")])
    b = _messages(spark, [("a", i, i * 900 + 40_000, "x") for i in range(40, 70)])
    assert store.accept(a).count() == 50
    assert store.accept(a).count() == 0
    assert sorted(r.seq for r in store.accept(b).collect()) == list(range(50, 70))
    narrow = redelivery.DeliveryStore(store.path, store.keys, store.time, buckets_at_once=2, most_files=0)  # several ranges of buckets, a new generation each time
    assert narrow.accept(a).count() == 0 and narrow.accept(b).count() == 0
    assert narrow._generations(spark) == [0, 1, 2]


TIMES = st.integers(0, 60)
ROWS = st.lists(st.tuples(st.sampled_from("xyz"), st.integers(0, 8), TIMES, st.booleans()), max_size=60)


def _brute(rows, declared, lateness, period):
    """Refused rows and accepted counts, straight from the definition."""
    refused, counts, seen = [], {}, set()
    for pos, (source, seq, time, is_seen) in enumerate(rows):
        clocks = [max((r[2] for r in rows[:pos] if r[0] == s), default=None) for s in declared]
        clock = None if None in clocks or not clocks else min(clocks)
        if is_seen and (source, seq) not in seen:
            seen.add((source, seq))
            if clock is not None and time < clock - lateness:
                refused.append(pos)
            else:
                own = counts.setdefault(time // period, [0, 0])
                own[0] += 1
                own[1] += clock is not None and clock >= (time // period + 1) * period
    return refused, counts


@settings(max_examples=200, deadline=None)
@given(ROWS, st.integers(0, 10), st.integers(1, 15))
def test_fold_against_the_definition(rows, lateness, period):
    seen, events = set(), []
    for pos, (source, seq, time, is_seen) in enumerate(rows):
        if is_seen and (source, seq) not in seen:
            seen.add((source, seq))
            events.append((pos, source, time, True))
        events.append((pos, source, time, False))
    refused, periods = late_events.fold(events, {"x": None, "y": None}, lateness, period)
    told = {}
    for p, n, m, _ in periods:
        own = told.setdefault(p, [0, 0])
        own[0] += n
        own[1] += m
    assert ([r[0] for r in refused], told) == _brute(rows, "xy", lateness, period)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 3_000), min_size=1, max_size=1_500), st.integers(0, 3_000))
def test_finger_tree_sums(keys, cut):
    tree = late_events.FingerTree()
    for k in keys:
        tree.add(k, 1, k % 2)
    assert tree.below(cut) == [sum(k < cut for k in keys), sum(k % 2 for k in keys if k < cut)]
    tree.evict(cut)
    rest = [k for k in keys if k >= cut]
    assert tree.below(10**6) == [len(rest), sum(k % 2 for k in rest)]
    tree.add(cut, 5)
    assert tree.below(10**6)[0] == len(rest) + 5


JOURNAL = "pos long, kind string, flow_id string, source string, seq long, at_us long, end_us long, until_us long, part string, time string"


def test_late_events_in_stretches(spark):
    rng = random.Random(5)
    rows = []
    for pos in range(800):
        t = pos + rng.randrange(-300, 60)
        if rng.random() < 0.2:
            rows.append((pos * 3, "advance", "f", rng.choice("xy"), None, None, None, t, "p", "t"))
        else:
            rows.append((pos * 3, "seen", "f", rng.choice("xyz"), rng.randrange(300), None if rng.random() < 0.1 else t, t if rng.random() < 0.5 else None, None, "p", "t"))
    rows += [(None, "seen", "f", "x", 1, 1, 1, None, "p", "t"), (5_000, None, "f", "x", 1, 1, 1, None, "p", "t"), (5_001, "seen", None, "x", 1, 1, 1, None, "p", "t"), (5_002, "seen", "other", "x", 1, 1, 1, None, "p", "t")]
    journal = spark.createDataFrame(rows, JOURNAL)
    config = spark.createDataFrame([("f", ["x", "y", "y", None], 40, 50)], "flow_id string, sources array<string>, lateness_us long, period_us long")
    plain = [(s, q, a if a is not None else e, True) if kind == "seen" else (s, q, u, False) for _, kind, _, s, q, a, e, u, *_ in rows[:800]]
    at = [i for i, r in enumerate(plain) if r[2] is not None]
    refused, counts = _brute([plain[i] for i in at], "xy", 40, 50)
    for stretch in (64, 10_000):
        folded = late_events.late_events(journal, config, stretch)
        assert sorted(r.pos for r in late_events.beyond_cutoff(folded).collect()) == [at[i] * 3 for i in refused]
        told = {r.period_start_us: [r.rows, r.corrections] for r in late_events.period_counts(folded).collect() if r.flow_id == "f" and r.rows}
        assert told == {p * 50: n for p, n in counts.items()}
    assert late_events.late_events(journal.limit(0), config).count() == 0
    assert late_events.beyond_cutoff(late_events.late_events(journal, config.limit(0))).count() == 0


SPAN = {"spanID": "a", "start": "1", "attributes": {"method": "GET", "x": [1]}, "children": [{"spanID": "b", "attributes": [{"key": "clientAddr", "value": None}, "odd"], "children": {"spanID": "c"}}, None, 7]}


def test_nested_forms_and_links(spark):
    deep = {"spanID": "d0"}
    for i in range(1, 300):
        deep = {"spanID": f"d{i}", "children": [deep]}
    payloads = [
        {"load_gen_row": {"conn_key": "k"}, "span": SPAN, "spans": json.dumps([SPAN])},
        {"rows": [{"load_gen_row": None, "spans": {"1": {"spanID": "m"}, "2": {"spanID": "n"}}}, {"load_gen_row": {"conn_key": None}, "spans": []}, 5, {}]},
        [], None, {}, {"load_gen_row": {"conn_key": "k2"}, "spans": [deep]}, {"spans": "not json"},
    ]
    rows = [(i, json.dumps(p), "x", "y") for i, p in enumerate(payloads)] + [(90, "{", "x", "y"), (91, None, "x", "y"), (92, "", "x", "y"), (93, '{"spans": NaN}', "x", "y"), (94, json.dumps(payloads[0]), "x", "y")]
    captures = nested.Captures(spark.createDataFrame(rows, "raw_id long, payload string, rec string, hash string"))
    links = {(r.raw_id, r.conn_key, r.span_id, r.parent_span_id) for r in captures.span_links().collect()}
    one = {("k", "a", ""), ("k", "b", "a"), ("k", "c", "b")}
    expected = {(i, *x) for i in (0, 94) for x in one} | {(1, "", "m", ""), (1, "", "n", "")} | {(5, "k2", f"d{i}", f"d{i + 1}" if i < 299 else "") for i in range(300)}
    assert links == expected
    assert {r.raw_id for r in captures.unparsed().collect()} == {90, 91, 92, 93}
    assert captures.span_links().filter("raw_id = 0").count() == 6  # every occurrence, each object once
    assert captures.spans().filter("span_id = 'a'").count() == 1
    assert {(r.name, r.value) for r in captures.attributes().collect()} == {("method", "GET"), ("x", "[1]"), ("clientAddr", None)}
    assert nested.Captures(spark.createDataFrame([], "raw_id long, payload string")).span_links().count() == 0


def test_redelivery_groups_need_their_own_blocks_only(spark, monkeypatch):
    monkeypatch.setattr(redelivery, "GROUP_BYTES", 2 * redelivery.BLOCK_BITS // 8)
    rows = [("a", i, 3_600 * (i % 3 if i % 100 else 3), str(i)) for i in range(60_000)] + [("a", i, 9_000, "again") for i in range(0, 60_000, 1_000)] + [("hot", 1, 90_000, "x")] * 20_000
    df = _messages(spark, rows)
    own = redelivery.screen(df, ["source", "seq"], "captured_at", max_filter_bytes=0)
    blocks, buckets = own.layout.blocks, len(own.layout.blocks)
    assert own.groups >= 16 and all(n % own.groups == 0 or own.groups % n == 0 for n in blocks)
    held = {r.g: r["count"] for r in own._wanted().groupBy("g").count().collect()}
    assert max(held.values()) <= sum(max(1, n // own.groups) for n in blocks) < 3 * buckets
    found = redelivery.repeats(df, ["source", "seq"], "captured_at", max_filter_bytes=0)
    assert {(r.source, r.seq): r.copies for r in found.collect()} == {("a", i): 2 for i in range(0, 60_000, 1_000)} | {("hot", 1): 20_000}


RECORDS = "id string, a long, b string, n_left string"


def test_differences(spark):
    left = spark.createDataFrame([("1", 1, "x", "q"), ("1", 1, "x", "q"), ("2", 2, "", "q"), ("3", None, None, "q"), ("4", 4, "x", "q"), ("5", 5, "y", "q"), ("5", 5, "y", "q"), (None, 1, "x", "q"), ("7", None, None, "q")], RECORDS)
    right = spark.createDataFrame([("1", 1, "x", "q"), ("2", 2, None, "q"), ("3", 3, None, "q"), ("5", 5, "z", "q"), ("6", 6, "x", "q"), ("7", None, None, "q")], RECORDS)
    told = {(r.id, r.field, r.left_value, r.right_value) for r in differences.differences(left, right, "id", ["a", "b"], ["b"]).collect()}
    assert told == {("1", "copies", "2", "1"), ("3", "a", None, "3"), ("4", "missing_right", None, None), ("5", "b", "y", "z"), ("6", "missing_left", None, None)}
    assert differences.differences(left.limit(0), right.limit(0), "id", ["a", "b"]).count() == 0
    assert differences.differences(left, left, "id", ["a", "b"]).count() == 0


def test_differences_of_keys_with_several_rows(spark):
    a, b, c = ((n, n * 10, n, "q") for n in range(3))
    row = lambda k, r: (k, r[1], str(r[2]), "q")
    left = [row("1", a), row("1", b), row("2", a), row("2", a), row("2", b), row("3", a), row("3", b), row("4", a)]
    right = [row("1", a), row("2", a), row("3", b), row("3", a), row("4", a), row("4", c), row("4", c)]
    found = differences.differences(spark.createDataFrame(left, RECORDS), spark.createDataFrame(right, RECORDS), "id", ["a", "b"])
    expected = []
    for k in "1234":
        ls, rs = ({r: rows.count(r) for r in rows if r[0] == k} for rows in (left, right))
        res = [sorted(x for x in own if own[x] > other.get(x, 0)) for own, other in ((ls, rs), (rs, ls))]
        for i in range(max(map(len, res))):
            x, y = (r[i] if i < len(r) else None for r in res)
            if (x or y) in ls and (x or y) in rs:
                expected.append((k, "copies", str(ls[x or y]), str(rs[x or y])))
                continue
            x, y = x or min(ls), y or min(rs)
            expected += [(k, f, str(x[i]), str(y[i])) for i, f in ((1, "a"), (2, "b")) if x[i] != y[i]]
    assert sorted(tuple(r) for r in found.collect()) == sorted(expected)


def test_differences_of_a_key_held_by_many_rows(spark):
    sides = [spark.createDataFrame([("1", i * 2 + n, str(n), "q") for i in range(1_000)], RECORDS) for n in (0, 1)]
    assert differences.differences(*sides, "id", ["a", "b"]).count() == 2_000


def test_ranked_counts_on_over_partitions(spark):
    df = spark.createDataFrame([(None if i % 5 == 0 else i % 3, i * 7 % 101) for i in range(500)], "g long, v long")
    rows = ranked(df, ["g"], ["v"]).collect()
    for g in (None, 0, 1, 2):
        own = sorted((r["rank"], r["v"]) for r in rows if r["g"] == g)
        assert [r for r, _ in own] == list(range(len(own))) and [v for _, v in own] == sorted(v for _, v in own)


def _hashes(payload):
    return [(n[1], n[2], n[5]) for n in nested.nodes_of(json.loads(payload))]


def test_identities_do_not_depend_on_the_order_of_members():
    a = '{"load_gen_row":{"conn_key":"c","x":1},"spans":[{"spanID":"s","attributes":{"method":"GET","url":"/"}}]}'
    b = '{"spans":[{"attributes":{"url":"/","method":"GET"},"spanID":"s"}],"load_gen_row":{"x":1,"conn_key":"c"}}'
    assert sorted(_hashes(a)) == sorted(_hashes(b))
    swapped = '{"load_gen_row":{},"spans":[{"spanID":"t"},{"spanID":"s"}]}'
    assert _hashes(swapped)[0] != _hashes('{"load_gen_row":{},"spans":[{"spanID":"s"},{"spanID":"t"}]}')[0]


def test_spans_without_id_and_all_fields_at_any_depth():
    payload = {
        "agent": "a1",
        "rows": [
            {
                "cell": "t1",
                "load_gen_row": {"conn_key": "c", "tags": ["x", {"deep": {"deeper": 1}}], "none": {}},
                "spans": {"m1": {"start": "1", "attributes": {"method": "GET"}, "statusCode": 7, "events": [{"at": 3}], "children": [{"attributes": {"method": "PUT"}}]}, "m2": {"spanID": "s2", "links": []}},
            }
        ],
    }
    nodes = nested.nodes_of(payload)
    spans = [n for n in nodes if n[1] == "span"]
    assert len(spans) == 3 and [n[4].get("spanID") for n in spans] == [None, None, "s2"]
    assert spans[0][4]["statusCode"] == "7" and spans[2][4]["links"] == "[]"
    parts = {(n[2], json.dumps(n[4], sort_keys=True)) for n in nodes if n[1] == "part"}
    assert parts == {("envelope", '{"agent": "a1"}'), ("record", '{"cell": "t1"}'), ("events", '{"at": "3"}'), ("tags", '{"": "x"}'), ("tags", "{}"), ("deep", '{"deeper": "1"}')}
    assert all(n[0] < i for i, n in enumerate(nodes))


def test_stretches_do_not_depend_on_the_spread_of_positions(spark):
    rows = [(i if i < 999 else 10**12, "x") for i in range(1_000)]
    parts = late_events.in_stretches(spark.createDataFrame(rows, "pos long, source string"), 100).groupBy("part").agg({"pos": "max", "*": "count"}).collect()
    assert max(r["count(1)"] for r in parts) <= 100
