"""A journal of observations replayed into final links of requests.

The watermark of every entry is a matter of the journal alone: the least of the
holding sources' clocks less the lateness, a source that hasn't told anything
holding the journal's first time, and one that lags more than ``max_silence``
being left out, which makes what closes then forced. It is computed by
stretches of the journal, as in ``late_events``.

Observations that share a value, directly or through others, can only meet in
one super-component, so each of these is folded by itself in the order of the
journal: late entries are final at once; a group closes when the watermark has
passed its latest event by more than the window; an entry on time that carries
an authored value of a closed group is told as such and links to nothing.
Every entry tells what it changes, as a provisional step of a chain of
decisions; a closing group's last steps become final, with a proof over its
observations and decisions. What a value gives depends on who holds it on either
side, so an entry concerns the holders of its values only; a value with over
``max_collision_members`` collides whoever joins, and names no partners.

A super-component is one task, as it is a sequence by its meaning, but it streams
through it: open observations are held, and the authored values that are closed.

Links by time (``timed``) wait for the end of the journal: as a journal's bounded
wait is made to decide as all observations at once would, they are decided at once.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from heapq import heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.digests import UNIT, digest_text
from tallyloom.operators.late_events import carried_clocks, in_stretches
from tallyloom.operators.timing import JoinParams, components, timed_links
from tallyloom.session import cut, partitions

IDENTITY = "struct<source:string,seq:long>"
SCHEMA = f"flow_id string, place string, source string, seq long, chain_version int, status string, kind string, key string, value string, partners array<{IDENTITY}>, evidence string, corroboration string, missing_on array<{IDENTITY}>, forced boolean, supersedes string, decision_id string, pos long, dossier string"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
KINDS = ("seen", "advance")


def checked(journal: DataFrame, config: DataFrame) -> DataFrame:
    """The journal's entries (flow_id, pos, kind, source, seq, at_us, start_us, end_us, until_us); one of an unknown kind, of an undeclared source or with times that can't be is an error."""
    wrong = refused(journal, config)
    told = F.raise_error(F.concat(F.lit("entry "), F.col("pos").cast("string"), F.lit(" of "), F.coalesce("flow_id", F.lit("no flow")), F.lit(": "), F.col("refusal")))
    return wrong.withColumn("kind", F.when(F.col("refusal").isNull(), F.col("kind")).otherwise(told)).select(*journal.columns)


def refused(journal: DataFrame, config: DataFrame) -> DataFrame:
    """The entries with ``refusal``, what is wrong with them first of all, null where nothing is."""
    declared = config.select("flow_id", F.array_distinct("sources").alias("_sources")).dropDuplicates(["flow_id"])
    seen, start, end = F.col("kind") == "seen", F.col("start_us"), F.col("end_us")
    reason = (
        F.when(~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False)), "unknown kind")
        .when(~F.coalesce(F.array_contains("_sources", F.col("source")), F.lit(False)), "undeclared source")
        .when(~seen & F.col("until_us").isNull(), "no time")
        .when(seen & start.isNull() & end.isNull() & F.col("at_us").isNull(), "no time")
        .when(seen & (start.isNull() != end.isNull()), "start and end are given together, or not at all")
        .when(seen & (end < start), "ends before it starts")
        .when(seen & end.isNotNull() & ~F.col("at_us").eqNullSafe(end), "happens at its end if it is timed")
    )
    return journal.join(declared, "flow_id", "left").withColumn("refusal", reason).drop("_sources")


def timeline(journal: DataFrame, config: DataFrame, stretch: int = 50_000) -> DataFrame:
    """flow_id, pos, mark_before, mark, forced of every entry that tells a time (flow_id, pos, source, time)."""
    j = journal.select("flow_id", "pos", "source", "time").filter("time is not null and flow_id is not null and pos is not null and source is not null")
    j = in_stretches(j, stretch)

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            clocks = {s: (None if pd.isna(c) else int(c)) for s, c in zip(right["source"], right["clock"]) if s is not None}
            firsts = [int(x) for x in right["first_at"] if not pd.isna(x)]
            first_at = min(firsts) if firsts else None
            late, silence = (None if pd.isna(right[c].iloc[0]) else int(right[c].iloc[0]) for c in ("lateness_us", "max_silence_us"))
            mark, forced = _mark(clocks, first_at, late or 0, silence)
            for flow, pos, source, time in left.sort_values("pos")[["flow_id", "pos", "source", "time"]].itertuples(index=False):
                before = mark
                if source in clocks and (clocks[source] is None or time > clocks[source]) or first_at is None or time < first_at:
                    if source in clocks:
                        clocks[source] = time if clocks[source] is None else max(clocks[source], time)
                    first_at = time if first_at is None else min(first_at, time)
                    mark, forced = _mark(clocks, first_at, late or 0, silence)
                out.append((flow, pos, before, mark, forced))
        return pd.DataFrame(out, columns=["flow_id", "pos", "mark_before", "mark", "forced"]).astype({"mark_before": "Int64", "mark": "Int64"})

    return j.groupBy("flow_id", "part").cogroup(carried_clocks(j, config).groupBy("f", "p")).applyInPandas(run, "flow_id string, pos long, mark_before long, mark long, forced boolean")


def _mark(clocks: dict[str, int | None], first_at: int | None, lateness: int, silence: int | None) -> tuple[int | None, bool]:
    if first_at is None or not clocks:
        return None, False
    reached = [first_at if c is None else c for c in clocks.values()]
    holding = [c for c in reached if silence is None or max(reached) - c <= silence]
    return min(holding) - lateness, len(holding) < len(reached)


def _together(first: tuple | None, second: tuple | None, lacking) -> tuple:
    """kind, key, value, partners, evidence, corroboration and who lacks a signal, from what two signals tell of an observation."""
    known = [o for o in (first, second) if o is not None]
    if any(o[0] == "COLLIDED" for o in known):
        return (*next(o for o in known if o[0] == "COLLIDED"), None, None, [])
    linked = [o for o in known if o[0] == "LINKED"]
    if not linked:
        return (*known[0], None, None, [])
    one = linked[0]
    if len(linked) == 2:
        if first[3] == second[3]:
            return (*first, "AUTHORED", "CORROBORATED", [])
        return ("CONFLICTED", *first[1:3], sorted({*first[3], *second[3]}), None, "SIGNAL_OTHER_PARTNER", [])
    missing = lacking(one is first, one[3])
    if missing:
        return (*one, "AUTHORED" if one is first else "OBSERVED", "SIGNAL_ABSENT", missing)
    return ("CONFLICTED", *one[1:], None, "SIGNAL_UNMATCHED", [])


def replay(seen: DataFrame, marks: DataFrame, config: DataFrame, joins: DataFrame, max_collision_members: int = 8) -> DataFrame:
    """All steps of all decisions: provisional ones as entries come in, final ones as groups close.

    ``seen``: flow_id, pos, source, seq, point, side, keys, time, one row for each observation (its first delivery).
    ``joins``: place, keys, authored, up_point, up_side, down_point, down_side; tens of rows.
    """
    declared = [r.asDict() for r in joins.limit(10_001).collect()]
    if len(declared) > 10_000:
        raise ValueError("more joins than a topology may declare")
    seen = cut(seen.withColumn("node", F.concat_ws(UNIT, "flow_id", "source", F.col("seq").cast("string"))))
    shared = F.array(*[F.when(F.forall(F.array(*[F.lit(k) for k in ks]), lambda k: F.col("keys")[k].isNotNull()), F.concat_ws(UNIT, F.col("flow_id"), F.lit("+".join(ks)), *[F.col("keys")[k] for k in ks])) for ks in sorted({tuple(j["keys"]) for j in declared})])
    held = seen.select("node", F.explode(shared).alias("value")).filter("value is not null")
    edges = held.select("node", F.concat(F.lit("="), "value").alias("value"))
    groups = components(edges, "node", "value")
    rows = seen.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    end = marks.groupBy("flow_id").agg(F.max_by(F.struct("mark", "forced"), "pos").alias("end"))
    rows = rows.join(marks.select("flow_id", "pos", "mark_before", "forced"), ["flow_id", "pos"], "left").join(end, "flow_id", "left").join(config.select("flow_id", "window_us").dropDuplicates(["flow_id"]), "flow_id", "left")
    rows = rows.select("component", "flow_id", "pos", "source", "seq", "point", "side", F.to_json("keys").alias("keys"), "time", F.col("mark_before").cast("string").alias("mark_before"), F.col("end.mark").cast("string").alias("end_mark"), F.col("forced"), F.col("window_us").cast("string").alias("window_us"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own: _Component | None = None
        for pdf in batches:
            out: list[tuple] = []
            for r in (dict(zip(pdf.columns, x)) for x in zip(*[pdf[c] for c in pdf.columns])):
                if own is None or r["component"] != own.name:
                    out += own.ended() if own else []
                    own = _Component(r, declared, max_collision_members)
                own.take(r)
                out += own.told()
            yield pd.DataFrame(out, columns=COLUMNS)
        if own is not None:
            yield pd.DataFrame(own.ended(), columns=COLUMNS)

    return rows.repartition(partitions(seen.sparkSession), "component").sortWithinPartitions("component", "pos").mapInPandas(run, SCHEMA)


def in_effect(decisions: DataFrame) -> DataFrame:
    """The last decision of each chain."""
    return decisions.groupBy("flow_id", "place", "source", "seq").agg(F.max_by(F.struct(*decisions.columns), "chain_version").alias("d")).select("d.*")


def proofs(decisions: DataFrame) -> DataFrame:
    """One row for each closed group: dossier, its observations and final decisions, and whether a silent source forced it."""
    final = decisions.filter("dossier is not null")
    return final.groupBy("flow_id", "dossier").agg(F.count_distinct("source", "seq").alias("observations"), F.count("*").alias("decisions"), F.bool_or("forced").alias("forced"))


class _Component:
    """One super-component, its rows taken in the order of the journal."""

    def __init__(self, first: dict, joins: list[dict], most: int) -> None:
        self.name, self.joins, self.most, self.rows = first["component"], joins, most, 0
        self.window = int(first["window_us"]) if isinstance(first["window_us"], str) else 0
        self.end = int(first["end_mark"]) if isinstance(first["end_mark"], str) else None
        self.authored = {j["keys"][0] for j in joins if j["authored"]}
        self.signals: dict[str, dict[bool, int]] = {}
        for i, j in enumerate(joins):
            self.signals.setdefault(j["place"], {})[bool(j["authored"])] = i
        self.members: dict[tuple, dict] = {}  # the open observations
        self.held: dict[tuple[int, str], tuple[dict, dict]] = {}  # who holds a join's value on its upper and on its lower end
        self.owner: dict[tuple[str, str], dict] = {}  # an open holder of each value
        self.pending: list[tuple[int, int, dict]] = []  # the latest member of an open group is always in it
        self.closed: set[tuple[str, str]] = set()
        self.last: dict[tuple, tuple] = {}  # version, decision id and content of each open chain
        self.out: list[tuple] = []

    def told(self) -> list[tuple]:
        out, self.out = self.out, []
        return out

    def ended(self) -> list[tuple]:
        self.settle(self.end, False)
        return self.told()

    def take(self, r: dict) -> None:
        mark = int(r["mark_before"]) if isinstance(r["mark_before"], str) else None
        self.settle(mark, bool(r["forced"]))
        keys = json.loads(r["keys"] or "{}")
        values = {("+".join(j["keys"]), UNIT.join(keys[k] for k in j["keys"])) for j in self.joins if all(keys.get(k) is not None for k in j["keys"])}
        m = r | {"keys": keys, "identity": (r["source"], r["seq"]), "values": values, "own": {}}
        self.rows += 1
        if mark is not None and m["time"] < mark:
            self.decide(m, "", ("LATE", None, None, [], None, None, []), "FINAL")
            return
        again = sorted((k, keys[k]) for k in self.authored & set(keys) if (k, keys[k]) in self.closed)
        if again:
            self.decide(m, "", ("VALUE_AFTER_FINAL", *again[0], [], None, None, []), "FINAL")
            return
        self.members[m["identity"]] = m
        self.join_group(m)
        concerned = set()
        for i, j in enumerate(self.joins):
            own = [keys.get(k) for k in j["keys"]]
            end = 0 if (m["point"], m["side"]) == (j["up_point"], j["up_side"]) else 1 if (m["point"], m["side"]) == (j["down_point"], j["down_side"]) else None
            if end is None or None in own:
                continue
            value = UNIT.join(own)
            sides = self.held.setdefault((i, value), ({}, {}))
            sides[end][m["identity"]] = None
            m["own"][i] = (value, end)
            few = len(sides[0]) + len(sides[1]) <= self.most + 1  # one more than named: these learn that they are many
            concerned |= {(j["place"], x) for x in ((*sides[0], *sides[1]) if few else (m["identity"],))}
        for place, identity in sorted(concerned):
            self.decide(self.members[identity], place, self.proposal(place, identity), "PROVISIONAL", pos=m["pos"])

    def join_group(self, m: dict) -> None:
        m["group"] = {"members": [m], "last": m["time"]}
        for v in m["values"]:
            less, more = sorted((m["group"], self.owner.setdefault(v, m)["group"]), key=lambda g: len(g["members"]))
            if less is not more:
                more["last"] = max(less["last"], more["last"])
                more["members"] += less["members"]
                for x in less["members"]:
                    x["group"] = more
        heappush(self.pending, (m["time"], self.rows, m))

    def outcome(self, i: int, identity: tuple) -> tuple | None:
        """kind, key, value and partners by one join; none without its value or away from its ends."""
        own = self.members[identity]["own"].get(i)
        if own is None:
            return None
        value, end = own
        sides, j = self.held[i, value], self.joins[i]
        key, many = "+".join(j["keys"]), len(sides[0]) + len(sides[1]) > self.most
        if max(map(len, sides)) > 1:
            return "COLLIDED", key, value, sorted(sides[1 - end]) if j["authored"] and not many else []
        return ("LINKED" if sides[1 - end] else "UNLINKED"), key, value, list(sides[1 - end])

    def proposal(self, place: str, identity: tuple) -> tuple:
        signals = self.signals[place]
        first, second = (self.outcome(signals[a], identity) if a in signals else None for a in (True, False))
        if len(signals) == 2:
            return _together(first, second, lambda authored, partners: sorted(x for x in (identity, *partners) if signals[not authored] not in self.members[x]["own"]))
        one = first or second
        return (*one, ("AUTHORED" if first else "OBSERVED") if one[0] == "LINKED" else None, None, [])

    def decide(self, m: dict, place: str, told: tuple, status: str, forced: bool = False, pos: int | None = None) -> int | None:
        """Tells a step of a chain, unless it is provisional and changes nothing; its place in what is told."""
        kind, key, value, partners, evidence, corroboration, missing = told
        content = digest_text(kind, key or "", value or "", *[f"{s}{UNIT}{q}" for s, q in partners], *(["corroboration", corroboration] if corroboration else []))
        version, before, same = self.last.get((place, m["identity"]), (0, None, None))
        if status == "PROVISIONAL" and same == content:
            return None
        own = digest_text(place, m["source"], str(m["seq"]), *((str(version + 1), content) if status == "PROVISIONAL" else (content, "FORCED" if forced else status)))
        self.last[place, m["identity"]] = (version + 1, own, content)
        named = [[{"source": s, "seq": q} for s, q in x] for x in (partners, missing)]
        self.out.append((m["flow_id"], place, m["source"], m["seq"], version + 1, status, kind, key, value, named[0], evidence, corroboration, named[1], forced, before, own, m["pos"] if pos is None else pos, None))
        if not place:
            del self.last[place, m["identity"]]
        return len(self.out) - 1

    def settle(self, mark: int | None, forced: bool) -> None:
        while mark is not None and self.pending and self.pending[0][0] + self.window < mark:
            group = heappop(self.pending)[-1]["group"]
            if group is not None and group["last"] + self.window < mark:
                self.close(group, forced)

    def close(self, group: dict, forced: bool) -> None:
        ends = sorted({(self.joins[i]["place"], m["identity"]) for m in group["members"] for i in m["own"]})
        told = [self.decide(self.members[identity], place, self.proposal(place, identity), "FINAL", forced) for place, identity in ends]
        proof = digest_text("dossier", *sorted(f"{s}{UNIT}{q}" for s, q in (m["identity"] for m in group["members"])), *sorted(self.out[i][COLUMNS.index("decision_id")] for i in told))
        for i in told:
            self.out[i] = (*self.out[i][:-1], proof)
        for end in ends:
            self.last.pop(end, None)
        for m in group["members"]:
            for i, (value, end) in m["own"].items():
                sides = self.held[i, value]
                sides[end].pop(m["identity"], None)
                if not any(sides):
                    del self.held[i, value]
            self.closed.update((k, m["keys"][k]) for k in self.authored & set(m["keys"]))
            for v in m["values"]:
                self.owner.pop(v, None)
            m["group"] = None
            del self.members[m["identity"]]


def _check_timed(params: dict[str, JoinParams], max_duration_us: int | None) -> None:
    for place, p in params.items():
        names = [s.name for s in p.signals]
        if "end" not in names:
            raise ValueError(f"{place}: a join in a flow needs an end signal")
        if p.local_span_us and max_duration_us is None:
            raise ValueError(f"{place}: the density guard needs a bound on durations")
        if p.local_span_us and names[0] == "duration":
            raise ValueError(f"{place}: the density guard needs a first signal in time")


def horizon_us(p: JoinParams, max_duration_us: int | None) -> int:
    """How far past an observation's end something on time can still concern it."""
    end = next(s for s in p.signals if s.name == "end")
    return max(abs(end.offset_us) + end.window_us, p.local_span_us + (max_duration_us or 0) if p.local_span_us else 0)


def timed(seen: DataFrame, marks: DataFrame, ends: dict[str, tuple[str, str]], params: dict[str, JoinParams], max_duration_us: int | None = None) -> DataFrame:
    """Final decisions by time: flow_id, place, source, seq, kind (LINKED, UNDECIDED), reason, partner_source, partner_seq, weight.

    ``seen``: flow_id, pos, source, seq, point, side, time, start_us, end_us, one row for each observation; ``ends``: the upper and the
    lower point of each place. Late observations take no part. Reasons: those of ``timed_links``, TIME_ABSENT, TOO_LONG.
    """
    _check_timed(params, max_duration_us)
    on_time = seen.join(marks.select("flow_id", "pos", "mark_before"), ["flow_id", "pos"]).filter("mark_before is null or time >= mark_before")
    on_time = cut(on_time.select("flow_id", "source", "seq", "point", "side", "start_us", "end_us"))
    absent = F.col("start_us").isNull() | F.col("end_us").isNull()
    long_ = F.lit(False) if max_duration_us is None else F.col("end_us") - F.col("start_us") > max_duration_us
    out = None
    for place, p in sorted(params.items()):
        up, down = ends[place]
        own = on_time.filter(((F.col("point") == up) & (F.col("side") == "outbound")) | ((F.col("point") == down) & (F.col("side") == "inbound")))
        own = own.withColumn("reason", F.when(absent, "TIME_ABSENT").when(long_, "TOO_LONG"))
        left_out = own.filter("reason is not null").select("flow_id", F.lit(place).alias("place"), "source", "seq", F.lit("UNDECIDED").alias("kind"), "reason", F.lit(None).cast("string").alias("partner_source"), F.lit(None).cast("long").alias("partner_seq"), F.lit(None).cast("long").alias("weight"))
        sides = [own.filter((F.col("side") == s) & F.col("reason").isNull()).select("flow_id", "source", "seq", "start_us", "end_us") for s in ("outbound", "inbound")]
        found = timed_links(*sides, p, by=["flow_id"])
        matched = F.col("status") == "MATCHED"
        told = found.select("flow_id", F.lit(place).alias("place"), "source", "seq", F.when(matched, "LINKED").otherwise("UNDECIDED").alias("kind"), F.when(~matched, F.col("status")).alias("reason"), "partner_source", "partner_seq", "weight")
        both = told.unionByName(left_out)
        out = both if out is None else out.unionByName(both)
    return out
