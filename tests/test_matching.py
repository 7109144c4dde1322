"""Matching: golden fingerprints, the plain twin, invariants and each boundary."""

import random
from datetime import date, timedelta
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyloom.operators import block, matching, observe, replay
from tallyloom.operators.matching import Tolerance
from tallyloom.functions.intervals import wilson

SCHEMA = "id string, account string, amount decimal(18,2), value_date date, reference string, currency string"
TOL = Tolerance(Decimal("0.50"), Decimal("0"), 3, 3, 32)


def _df(spark, rows):
    return spark.createDataFrame([(i, a, Decimal(m), date.fromisoformat(d), r, c) for i, a, m, d, r, c in rows], SCHEMA)


def test_worked_example(spark):
    left = _df(spark, [("L1", "x", "1000.00", "2026-03-02", None, "EUR"), ("L2", "x", "250.00", "2026-03-05", "INV-1", "EUR")])
    right = _df(spark, [("R1", "x", "600.00", "2026-03-02", None, "EUR"), ("R2", "x", "400.00", "2026-03-03", None, "EUR"), ("R3", "x", "251.50", "2026-03-07", "INV-1", "EUR")])
    out = matching.reconcile(left, right, TOL)
    found = {r.left_id: (r.right_ids, r.rule, r.score, r.amount_residual, r.date_gap_days) for r in out.matches.collect()}
    assert found["L2"] == (["R3"], "M0_REFERENCE", Decimal("1"), Decimal("-1.50"), 2)
    assert found["L1"] == (["R1", "R2"], "M3_AGGREGATE", Decimal("0.573333"), Decimal("0.00"), 1)
    assert {r.counter: r.value for r in out.counters.collect()} == {"records_left": 2, "records_right": 3, "blocks": 1, "candidates_evaluated": 2, "matched_M0_REFERENCE": 1, "matched_M3_AGGREGATE": 1}
    assert out.rejects.count() == 0
    assert len(out.result_hash()) == 16


def test_golden_ids():
    assert TOL.ruleset_id() == "514101369862cbf6"
    assert replay.StreamConfig(Tolerance(date_days=3)).ruleset_id() == "82a31d4469f76094"
    assert observe.DriftRule().rule_id() == "63df2949b68d7ac9"
    assert observe.EvidenceRule().rule_id() == "2c90e3f12ebc7676"
    assert Tolerance(Decimal("0.5")).ruleset_id() != Tolerance(Decimal("0.50")).ruleset_id()


def test_wilson():
    low, high = wilson(90, 100)
    assert (round(low, 4), round(high, 4)) == (Decimal("0.8256"), Decimal("0.9448"))
    assert wilson(0, 5)[0] == 0 and wilson(5, 5)[1] == 1


def _random_sides(rng, n=40):
    refs, money = [None, "", "A", "B"], ["100.00", "100.20", "60.00", "40.00", "200.00"]
    make = lambda p, i: (f"{p}{i:02d}", rng.choice(["a", "b"]), rng.choice(money), str(date(2026, 1, 1) + timedelta(rng.randrange(12))), rng.choice(refs), rng.choice([None, "EUR"]))
    return [make("L", i) for i in range(n)], [make("R", i) for i in range(n)]


def test_frames_equal_the_plain_twin(spark):
    for seed, tol in ((1, TOL), (2, Tolerance(Decimal("0.20"), Decimal("0.01"), 2, 2, 9)), (3, Tolerance(date_days=0, max_aggregate_size=1))):
        lefts, rights = _random_sides(random.Random(seed))
        out = matching.reconcile(_df(spark, lefts), _df(spark, rights), tol)
        found = {(r.left_id, tuple(r.right_ids), r.rule, r.score) for r in out.matches.collect()}
        told = {(r.left_id, r.right_id, r.reason) for r in out.rejects.collect()}
        matches, rejects = set(), set()
        for key in {(x[1], x[5]) for x in lefts + rights}:
            sides = [[{"id": i, "amount": Decimal(m), "value_date": date.fromisoformat(d), "reference": r} for i, a, m, d, r, c in s if (a, c) == key] for s in (lefts, rights)]
            m, r = block.evaluate(*sides, tol)
            matches |= {(x[0], x[1], x[2], x[3]) for x in m}
            rejects |= set(r)
        assert found == matches and told == rejects
        used = [i for x in found for i in (x[0], *x[1])]
        assert len(used) == len(set(used))  # nobody is matched twice


def test_order_of_input_does_not_matter(spark):
    lefts, rights = _random_sides(random.Random(9), 20)
    a = matching.reconcile(_df(spark, lefts), _df(spark, rights), TOL).result_hash()
    assert a == matching.reconcile(_df(spark, lefts[::-1]), _df(spark, rights[::-1]), TOL).result_hash()


def test_empty_sides(spark):
    none = _df(spark, []) if False else spark.createDataFrame([], SCHEMA)
    one = _df(spark, [("L1", "x", "1.00", "2026-01-01", None, None)])
    out = matching.reconcile(one, none, TOL)
    assert [(r.left_id, r.reason) for r in out.rejects.collect()] == [("L1", "NO_CANDIDATE")] and out.matches.count() == 0


ENTRIES = st.lists(st.tuples(st.sampled_from(["left", "right"]), st.integers(0, 9), st.sampled_from(["100.00", "200.00"]), st.integers(0, 8), st.sampled_from([None, "A"])), max_size=14)


@settings(max_examples=60, deadline=None)
@given(ENTRIES)
def test_fold_ends_every_record_once(entries):
    fold, seen = replay.BlockReplay(replay.StreamConfig(Tolerance(date_days=2), lateness_days=1)), set()
    for pos, (side, i, money, day, ref) in enumerate(entries):
        if (side, i) not in seen:
            seen.add((side, i))
            fold.record(pos, side, {"id": str(i), "amount": Decimal(money), "value_date": date(2026, 1, 1) + timedelta(day), "reference": ref})
    for side in replay.SIDES:
        fold.progress(99, side, date(2026, 3, 1))
    finals = [d for d in fold.out if d["status"] == "FINAL"]
    assert sorted((d["side"], d["id"]) for d in finals) == sorted((s, str(i)) for s, i in seen) and not fold.open.group
    for d in finals:  # a match is final on both sides or on none
        if d["decision_type"] == "MATCH" and d["side"] == "left":
            assert all(any(e["side"] == "right" and e["id"] == r and e["input_ids"] == d["input_ids"] for e in finals) for r in d["input_ids"][1:])


JOURNAL = "pos long, kind string, side string, id string, account string, amount decimal(18,2), value_date date, reference string, currency string, until date"


def test_replay_closes_and_refuses(spark):
    d = lambda n: date(2026, 1, n)
    rows = [
        (1, "arrival", "left", "A", "x", Decimal("10.00"), d(1), None, None, None), (2, "arrival", "right", "B", "x", Decimal("10.00"), d(1), None, None, None), (3, "arrival", "left", "A", "x", Decimal("10.00"), d(1), None, None, None),
        (4, "progress", "left", None, None, None, None, None, None, d(9)), (5, "progress", "right", None, None, None, None, None, None, d(9)), (6, "arrival", "left", "C", "x", Decimal("10.00"), d(2), None, None, None),
    ]
    out = replay.replay(spark.createDataFrame(rows, JOURNAL), replay.StreamConfig(Tolerance(date_days=1)))
    last = {(r.side, r.id): (r.status, r.reason, r.decided_at) for r in replay.effective(out).collect()}
    assert last == {("left", "A"): ("FINAL", "M1_EXACT", 3), ("right", "B"): ("FINAL", "AS_COUNTERPART", 3), ("left", "C"): ("FINAL", "LATE", 4)}
    assert replay.with_status(out).filter("status = 'SUPERSEDED'").count() == 3
    assert replay.replay(spark.createDataFrame([], JOURNAL), replay.StreamConfig()).count() == 0


def _by_the_book(entries, config):
    """Decisions of a block, matching all open records anew at every entry, straight from the definition."""
    tol, open_, told, out, settled, reached = config.tolerance, {}, {}, [], set(), {}
    horizon = lambda r: r["value_date"] + timedelta(tol.date_days if not r["reference"] or config.reference_horizon_days is None else config.reference_horizon_days)
    mark = lambda: min(reached.values()) - timedelta(config.lateness_days) if len(reached) == 2 else None

    def tell(key, kind, inputs, reason, final=False, forced=False):
        told[key] = (kind, inputs, reason)
        out.append((*key, kind, inputs, reason, final, forced))

    def match_all():
        sides = {s: {k[1]: r for k, r in open_.items() if k[0] == s} for s in replay.SIDES}
        matches, rejects = block.evaluate(list(sides["left"].values()), list(sides["right"].values()), tol)
        now = {k: ("BREAK", [k[1]], block.reason_text({x[2] for x in rejects if k[1] == x[0 if k[0] == "left" else 1] and (x[1] is None or block.days_apart(sides["left"][x[0]], sides["right"][x[1]]) <= tol.date_days)})) for k in open_}
        for left, rights, rule, *_ in matches:
            now |= {("left", left): ("MATCH", [left, *rights], rule)} | {("right", r): ("MATCH", [left, *rights], "AS_COUNTERPART") for r in rights}
        ends = {k: max(horizon(open_[("left" if i == 0 and v[0] == "MATCH" else "right" if v[0] == "MATCH" else k[0], x)]) for i, x in enumerate(v[1])) for k, v in now.items()}
        for k in sorted(now):
            if told.get(k) != now[k]:
                tell(k, *now[k])
        return ends

    def groups():
        left, found = set(open_), []
        while left:
            group, new = set(), {min(left)}
            while new:
                group |= new
                new = {b for a in new for b in left - group if a[0] != b[0] and (block.days_apart(open_[a], open_[b]) <= tol.date_days or (open_[a]["reference"] and open_[a]["reference"] == open_[b]["reference"]))}
            left -= group
            found.append(sorted(group))
        return found

    ends = {}
    for kind, side, x in entries:
        if kind == "arrival":
            late = mark() is not None and x["value_date"] < mark()
            if late or (side != "left" and ("left", x["reference"]) in settled) or (side == "left" and ("right", x["reference"]) in settled):
                tell((side, x["id"]), "BREAK", [x["id"]], "LATE" if late else "REFERENCE_AFTER_FINAL", True)
                continue
            open_[side, x["id"]] = x
        day = x["value_date"] if kind == "arrival" else x
        reached[side] = max(day, reached.get(side, day))
        ends = match_all() if kind == "arrival" else ends
        while mark() is not None:
            closing = []
            for g in groups():
                days = [open_[k]["value_date"] for k in g]
                if max(horizon(open_[k]) for k in g) < mark():
                    closing += [(k, False) for k in g]
                elif config.max_component_days is not None and (max(days) - min(days)).days > config.max_component_days:
                    closing += [(k, True) for k in g if ends[k] < mark()]
            if not closing:
                break
            for k, forced in closing:
                tell(k, *told[k], True, forced)
                r = open_.pop(k)
                settled |= {(k[0], r["reference"])} if r["reference"] else set()
            ends = match_all() if open_ else {}
    return out


@pytest.mark.parametrize("seed", range(40))
def test_block_replay_against_the_definition(seed):
    rng = random.Random(seed)
    tol = Tolerance(Decimal(rng.choice(["0", "0.5", "1"])), Decimal(0), rng.choice([0, 1, 3]), rng.choice([1, 2, 3]), rng.choice([2, 4, 32]))
    config = replay.StreamConfig(tol, rng.choice([0, 1, 2]), rng.choice([None, 5, 9]), rng.choice([None, 0, 2, 5]))
    entries, day = [], 0
    for pos in range(50):
        day += rng.choice([0, 0, 0, 1])
        side = rng.choice(replay.SIDES)
        if rng.random() < 0.15:
            entries.append(("progress", side, date(2026, 1, 1) + timedelta(day + rng.randrange(-3, 3))))
        else:
            entries.append(("arrival", side, {"id": f"{side[0]}{rng.randrange(1000)}-{pos}", "amount": Decimal(rng.randrange(1, 6)) / 2, "value_date": date(2026, 1, 1) + timedelta(day + rng.randrange(-4, 2)), "reference": rng.choice([None, None, "", "a", "b", f"r{rng.randrange(9)}"])}))
    own = replay.BlockReplay(config)
    for pos, (kind, side, x) in enumerate(entries):
        (own.record if kind == "arrival" else own.progress)(pos, side, x)
    assert [(d["side"], d["id"], d["decision_type"], d["input_ids"], d["reason"], d["status"] == "FINAL", d["forced"]) for d in own.out] == _by_the_book(entries, config)


def test_unknown_entries_are_an_error(spark):
    with pytest.raises(Exception, match="unknown entry"):
        replay.replay(spark.createDataFrame([(1, "arival", "left", "A", "x", None, None, None, None, None)], JOURNAL), replay.StreamConfig()).count()


def test_taking_in_rounds_equals_taking_in_order(spark):
    rng = random.Random(4)
    rows = [("a", "c", f"l{rng.randrange(30)}", [f"r{rng.randrange(30)}"], "M2_TOLERANT", Decimal(rng.randrange(5)) / 10, Decimal(0), 0) for _ in range(200)]
    df = spark.createDataFrame(rows, "account string, currency string, left_id string, right_ids array<string>, rule string, score decimal(9,6), amount_residual decimal(18,2), date_gap_days int").dropDuplicates(["left_id", "right_ids"])
    told = [sorted((r.left_id, r.right_ids[0]) for r in matching.take(df, few).collect()) for few in (0, 1_000)]
    assert told[0] == told[1]


def test_rules_of_the_callers_own(spark):
    """A rule that pairs what is left by account alone."""

    def by_account(left, right, tol):
        return matching._candidate(left.alias("l").join(right.alias("r"), matching._block()), "X_ACCOUNT", F.lit(Decimal("0.1")).cast("decimal(9,6)"), matching._residual(), matching._gap())

    left, right = _df(spark, [("L1", "x", "10.00", "2026-01-01", None, None), ("L2", "x", "99.00", "2026-01-01", None, None)]), _df(spark, [("R1", "x", "10.00", "2026-01-01", None, None), ("R2", "x", "500.00", "2026-05-01", None, None)])
    out = matching.reconcile(left, right, TOL, {"X_ACCOUNT": by_account})
    assert {(r.left_id, r.right_ids[0], r.rule) for r in out.matches.collect()} == {("L1", "R1", "M1_EXACT"), ("L2", "R2", "X_ACCOUNT")}
    assert {r.counter: r.value for r in out.counters.collect()}["matched_X_ACCOUNT"] == 1
