"""Declared points and hops, the strongest evidence that each hop can give, and the joins that follow.

A declaration is read whole and every refusal told at once. The tables below
state what fields may hold and, for each kind of link, what it needs; the first
kind of the ladder that lacks nothing is the hop's ceiling. Tens of rows, so it
is worked out on the driver; ``joins_frame`` hands the joins to Spark.
"""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession

# The vocabulary of declarations.
IDENTIFIERS = {"traceparent", "baggage", "request_id", "message_id", "tuple5", "h2_stream_id", "socket_cookie"}
CARRIED = {"traceparent", "baggage", "request_id", "message_id"}
HEADERS = ["request_id", "traceparent"]
PRECISION_NS = {"kernel_monotonic": 1_000, "precise_sync": 10_000, "network_sync": 1_000_000, "log_ms": 1_000_000, "log_s": 1_000_000_000}
EVIDENCE = ["unresolved", "derived", "observed", "authored"]
LADDER = [("shared_header", "authored"), ("message_key", "authored"), ("same_connection", "observed"), ("same_socket", "observed"), ("nested_timing", "derived")]
POINT_CHOICES = {"visibility": {"kernel", "log", "app", "none"}, "timestamps": set(PRECISION_NS)}
HOP_CHOICES = {"relation": {"call", "async", "fanout"}, "nat": {"none", "snat", "dnat"}, "nat_mapping": {"none", "conntrack", "logged_both_sides"}, "expect": set(EVIDENCE)}
POINT_FIELDS = {"host": str, "visibility": str, "clock": str, "timestamps": str, "inbound": list, "outbound": list, "propagates": dict, "sets": list, "trusts_incoming": bool}
HOP_FIELDS = {"from": str, "to": str, "relation": str, "nat": str, "nat_mapping": str, "pooling": bool, "rate": int, "noise_us": int, "expect": str, "max_fanout": int}
LEAST = {"rate": 1, "noise_us": 0, "max_fanout": 1}


class TopologyError(ValueError):
    def __init__(self, refusals: list[tuple[str, str, str]]) -> None:
        self.refusals = sorted(set(refusals))
        super().__init__("; ".join(f"{reason} at {where or 'declaration'}: {detail}" for reason, where, detail in self.refusals))


@dataclass
class Topology:
    points: dict[str, dict]
    hops: list[dict]
    crossings: list[dict]

    def joins(self, observed: bool = False) -> list[tuple]:
        """(place, keys, up_point, up_side, down_point, down_side) of the authored joins, or of the second signals."""
        out = []
        for h in self.hops:
            keys = h["observed"] if observed else [h["key"]] if h["key"] else None
            if keys:
                out.append((f"{h['src']} -> {h['dst']}", keys, h["src"], "outbound", h["dst"], "inbound"))
        if not observed:
            out += [(c["point"], [c["key"]], c["point"], "inbound", c["point"], "outbound") for c in self.crossings if c["key"]]
        return out

    def joins_frame(self, spark: SparkSession, observed: bool = False) -> DataFrame:
        return spark.createDataFrame(self.joins(observed), "place string, keys array<string>, up_point string, up_side string, down_point string, down_side string")

    def ceilings_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(f"{h['src']} -> {h['dst']}", h["evidence"], h["link"], h["key"], str(h["density"]) if h["density"] is not None else None) for h in self.hops]
        rows += [(c["point"], c["evidence"], c["link"], c["key"], None) for c in self.crossings]
        return spark.createDataFrame(rows, "place string, evidence string, link string, key string, density string")


@dataclass
class _Reader:
    refusals: list = field(default_factory=list)

    def refuse(self, reason: str, where: str, detail: str) -> None:
        self.refusals.append((reason, where, detail))

    def table(self, raw: object, where: str, fields: dict, choices: dict, required: set) -> dict | None:
        """The table with only sound values, or None if any was refused."""
        before = len(self.refusals)
        if not isinstance(raw, dict):
            self.refuse("INVALID_VALUE", where, "not a table")
            return None
        for name in sorted(required - set(raw)):
            self.refuse("MISSING_FIELD", where, f"{name} is required")
        for name, value in sorted(raw.items()):
            kind = fields.get(name)
            if kind is None:
                self.refuse("UNKNOWN_FIELD", where, f"unknown field {name!r}")
            elif not isinstance(value, kind) or (kind is int and (isinstance(value, bool) or value < LEAST[name])):
                self.refuse("INVALID_VALUE", where, f"{name} = {value!r}")
            elif name in choices and value not in choices[name]:
                self.refuse("UNKNOWN_VALUE", where, f"{name} = {value!r}")
            elif kind is list:
                self.identifiers(value, where, name, CARRIED if name == "sets" else IDENTIFIERS)
            elif kind is dict:
                self.identifiers(list(value), where, name, CARRIED)
                for k, who in sorted(value.items()):
                    if who not in ("agent", "app", "proxy"):
                        self.refuse("UNKNOWN_VALUE", where, f"{name}.{k} = {who!r}")
        return raw if len(self.refusals) == before else None

    def identifiers(self, names: list, where: str, name: str, known: set) -> None:
        if not all(isinstance(n, str) for n in names) or len(set(names)) < len(names):
            self.refuse("INVALID_VALUE", where, f"{name} must list identifiers once each")
        for n in sorted(str(n) for n in names if n not in known):
            self.refuse("UNKNOWN_IDENTIFIER", where, f"{name}: unknown identifier {n!r}")


def loads(text: str) -> Topology:
    try:
        return load(tomllib.loads(text))
    except tomllib.TOMLDecodeError as e:
        raise TopologyError([("INVALID_VALUE", "", f"not TOML: {e}")]) from None


def load(declared: dict) -> Topology:
    r = _Reader()
    for name in sorted(set(declared) - {"points", "hops"}):
        r.refuse("UNKNOWN_FIELD", "", f"unknown field {name!r}")
    raw_points, raw_hops = declared.get("points"), declared.get("hops", [])
    if "points" not in declared:
        r.refuse("MISSING_FIELD", "", "points is required")
    elif not isinstance(raw_points, dict) or not raw_points:
        r.refuse("INVALID_VALUE", "", "points must be a table with entries")
    if not isinstance(raw_hops, list):
        r.refuse("INVALID_VALUE", "", "hops must be a list of tables")
    raw_points = raw_points if isinstance(raw_points, dict) else {}
    points: dict[str, dict] = {}
    for name, raw in sorted(raw_points.items()):
        timed = isinstance(raw, dict) and raw.get("visibility") in ("kernel", "log", "app")
        own = r.table(raw, name, POINT_FIELDS, POINT_CHOICES, {"host", "visibility"} | ({"clock", "timestamps"} if timed else set()))
        if own is not None:
            points[name] = {"inbound": [], "outbound": [], "sets": [], "propagates": {}, "trusts_incoming": True, "clock": None, "timestamps": None} | own
            _point_rules(name, points[name], r)
    hops, seen = [], set()
    for raw in raw_hops if isinstance(raw_hops, list) else []:
        where = f"{raw.get('from', '?')} -> {raw.get('to', '?')}" if isinstance(raw, dict) else ""
        own = r.table(raw, where, HOP_FIELDS, HOP_CHOICES, {"from", "to"})
        if own is None:
            continue
        own = {"relation": "call", "nat": "none", "nat_mapping": "none", "pooling": False} | own
        faults = [("UNKNOWN_POINT", f"{own[e]!r} is not declared") for e in ("from", "to") if own[e] not in raw_points]
        if own["from"] == own["to"]:
            faults.append(("INVALID_VALUE", "a hop joins two different points"))
        if (own["relation"] == "fanout") != ("max_fanout" in own):
            faults.append(("FANOUT_UNBOUNDED", "needs max_fanout") if own["relation"] == "fanout" else ("INVALID_VALUE", "max_fanout is for fanout only"))
        if not faults and where in seen:
            faults.append(("DUPLICATE_HOP", "declared twice"))
        for reason, detail in faults:
            r.refuse(reason, where, detail)
        seen.add(where)
        if not faults and own["from"] in points and own["to"] in points:
            hops.append(_ceiling(own, where, points[own["from"]], points[own["to"]], r))
    if r.refusals:
        raise TopologyError(r.refusals)
    both = {h["src"] for h in hops} & {h["dst"] for h in hops}
    return Topology(points, sorted(hops, key=lambda h: (h["src"], h["dst"])), [_crossing(n, points[n]) for n in sorted(both)])


def _lacks(hop: dict, src: dict, dst: dict) -> dict[str, list[str]]:
    """What each kind of link lacks at this hop."""
    both = set(src["outbound"]) & set(dst["inbound"])
    later = hop["relation"] == "async"
    conditions = {
        "shared_header": {"NO_SHARED_HEADER": _header(src, dst) is None},
        "message_key": {"NO_MESSAGE_KEY": not later or "message_id" not in both},
        "same_connection": {"ASYNC_RELATION": later, "MISSING_TUPLE5": "tuple5" not in both, "MISSING_NAT_MAPPING": hop["nat"] != "none" and hop["nat_mapping"] == "none", "MISSING_STREAM_ID": hop["pooling"] and "h2_stream_id" not in both},
        "same_socket": {"ASYNC_RELATION": later, "MISSING_SOCKET_COOKIE": "socket_cookie" not in both, "CROSS_HOST_SOCKET": src["host"] != dst["host"]},
        "nested_timing": {"ASYNC_RELATION": later, "NOT_TIMESTAMPED": "none" in (src["visibility"], dst["visibility"]), "NO_SHARED_CLOCK": "none" not in (src["visibility"], dst["visibility"]) and src["clock"] != dst["clock"]},
    }
    return {kind: [name for name, holds in needs.items() if holds] for kind, needs in conditions.items()}


def _header(src: dict, dst: dict) -> str | None:
    """A header that both ends record as it was on the wire; the kernel's record of a point that sets its own shows the old one."""
    usable = [h for h in HEADERS if h in src["outbound"] and h in dst["inbound"] and not (h in src["sets"] and src["visibility"] == "kernel")]
    return usable[0] if usable else None


def _ceiling(hop: dict, where: str, src: dict, dst: dict, r: _Reader) -> dict:
    lacks = _lacks(hop, src, dst)
    link, evidence = next(((k, e) for k, e in LADDER if not lacks[k]), ("none", "unresolved"))
    density = None
    if link == "nested_timing" and "rate" in hop:
        window = max(PRECISION_NS[src["timestamps"]], PRECISION_NS[dst["timestamps"]], 1_000 * hop.get("noise_us", 0))
        density = Fraction(hop["rate"] * window, 10**9)
        if density > 1:
            r.refuse("DENSITY_ABOVE_BOUND", where, f"density {float(density):g} over 1")
    expected = hop.get("expect")
    if expected and EVIDENCE.index(evidence) < EVIDENCE.index(expected):
        missing = sorted({x for k, e in LADDER if e == expected for x in lacks[k]})
        r.refuse("CEILING_BELOW_EXPECTED", where, f"expected {expected}, at most {evidence}; missing: {', '.join(missing).lower()}")
    observed = None
    if not lacks["same_connection"] and hop["nat"] == "none":
        observed = ["tuple5", "h2_stream_id"] if hop["pooling"] else ["tuple5"]
    key = {"shared_header": _header(src, dst), "message_key": "message_id"}.get(link)
    return {"src": hop["from"], "dst": hop["to"], "relation": hop["relation"], "evidence": evidence, "link": link, "density": density, "max_fanout": hop.get("max_fanout"), "key": key, "observed": observed}


def _crossing(name: str, p: dict) -> dict:
    copied = [h for h in [*HEADERS, "message_id"] if h in p["propagates"] and h in p["inbound"] and h in p["outbound"] and h not in p["sets"]]
    if copied:
        return {"point": name, "evidence": "authored", "link": "propagated", "key": copied[0]}
    evidence, link = {"kernel": ("observed", "inside_process"), "log": ("derived", "logged_timing"), "app": ("derived", "logged_timing")}.get(p["visibility"], ("unresolved", "none"))
    return {"point": name, "evidence": evidence, "link": link, "key": None}


def _point_rules(name: str, p: dict, r: _Reader) -> None:
    by_agent = sorted(k for k, who in p["propagates"].items() if who == "agent")
    if by_agent and p["visibility"] != "kernel":
        r.refuse("AGENT_NOT_PRESENT", name, "an agent propagates where it doesn't see")
    if "baggage" in by_agent:
        r.refuse("AGENT_BAGGAGE", name, "agents don't carry baggage")
    for k in by_agent if not p["trusts_incoming"] else []:
        if k not in p["sets"]:
            r.refuse("UNTRUSTED_ENTRY_PROPAGATED", name, f"an outside {k} would be carried on")
