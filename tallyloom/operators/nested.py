"""Deeply nested captures as related flat tables, by Merkle identities of their subtrees.

Every object of a capture is put into canonical form and hashed together with
the hashes of its children, from the leaves up: requests, spans, attributes,
and, as parts, any other object or array element at whatever depth, so no field
is lost. Members of an object have no order and are hashed sorted by name;
elements of an array keep theirs. Equal subtrees have equal hashes wherever
they occur, so the object tables hold each object once; every occurrence is a
row of the bridge, which names the capture, the hash of the object and of the
object around it, the field there and the ordinal among its siblings.

Defined results: a capture that isn't valid JSON gives no objects and is
counted as such; null, empty or missing parts give no rows; ``spans`` may be an
array, one object, a map of spans or any of these as JSON text, ``attributes``
a map, or an array of key and value, or JSON text. An object is a span if it
has a field that spans have, or any that is no object or array; otherwise it is
a map of spans. Numbers and booleans are kept as their JSON text, empty objects
and arrays as {} and []. A capture's fields beside its records are a part with
the role 'envelope', a record's fields beside its request and spans one with
the role 'record'.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.session import written

KINDS = ("request", "span", "attribute", "part")
SPAN_FIELDS = ("spanID", "parentSpanID", "kind", "type", "start", "handlerStart", "end", "duration", "host", "hostName", "hostPort", "peer", "peerName", "peerPort", "traceID", "attributes", "children")
_COLUMNS = ["rec", "raw_id", "occurrence", "parent", "kind", "role", "ordinal", "hash", "parent_hash", "request_hash", "content"]
_SCHEMA = "rec string, raw_id long, occurrence int, parent int, kind string, role string, ordinal int, hash string, parent_hash string, request_hash string, content map<string,string>"


def _refuse(name: str) -> None:
    raise ValueError(name)


def parse(text: str | None) -> Any:
    """Strict JSON; raises ValueError (or RecursionError where it is nested beyond the parser's depth)."""
    return json.loads(text, parse_constant=_refuse)


def text_of(value: Any) -> str | None:
    if value is None:
        return None
    if isinstance(value, str):  # half a surrogate pair can't be stored
        return value if value.isascii() else value.encode("utf-8", "replace").decode("utf-8")
    return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def _unwrapped(value: Any) -> Any:
    if isinstance(value, str):
        try:
            return parse(value)
        except (ValueError, RecursionError):
            return None
    return value


def spans_in(value: Any) -> list[dict]:
    """The spans that a value holds at its outermost level, in order, in whatever form."""
    value = _unwrapped(value)
    if isinstance(value, dict):
        if not all(isinstance(v, (dict, list)) for v in value.values()) or not value.keys().isdisjoint(SPAN_FIELDS):
            return [value]
        return [s for k in sorted(value) for s in spans_in(value[k])]
    if isinstance(value, list):
        return [s for v in value for s in spans_in(v)]
    return []


def attributes_in(value: Any) -> list[tuple[str, str | None]]:
    value = _unwrapped(value)
    if isinstance(value, dict):
        return [(text_of(k), text_of(v)) for k, v in value.items()]
    if isinstance(value, list):
        pairs = [(a.get("key", a.get("name")), a.get("value")) for a in value if isinstance(a, dict)]
        return [(text_of(k), text_of(v)) for k, v in pairs if k is not None]
    return []


def records_in(value: Any) -> list[dict]:
    value = _unwrapped(value)
    if isinstance(value, dict):
        rows = _unwrapped(value.get("rows")) if "rows" in value else [value]
        return [r for r in (rows if isinstance(rows, list) else [rows]) if isinstance(r, dict)]
    return [r for r in value if isinstance(r, dict)] if isinstance(value, list) else []


def _identity(kind: str, content: dict[str, str | None], children: list[tuple]) -> str:
    own = json.dumps([kind, sorted(content.items()), children], ensure_ascii=False, separators=(",", ":"))
    return hashlib.blake2b(own.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def _split(fields: dict) -> tuple[dict[str, str | None], list[tuple[str, Any]]]:
    """What a row of the object can hold, and the fields that are objects or arrays of their own."""
    inner = [(k, v) for k, v in fields.items() if isinstance(v, (dict, list)) and v]
    return {text_of(k): text_of(v) for k, v in fields.items() if v is not None and not (isinstance(v, (dict, list)) and v)}, inner


def nodes_of(value: Any) -> list[list]:
    """All objects of one parsed capture, parents before children: [parent, kind, role, ordinal, content, hash, request]."""
    nodes: list[list] = []
    children: list[list[int]] = []
    waiting: list[tuple] = []

    def begin(parent: int, kind: str, role: str, ordinal: int, fields: dict, request: int) -> int:
        content, inner = _split(fields)
        nodes.append([parent, kind, role, ordinal, content, "", request])
        children.append([])
        own = len(nodes) - 1
        if parent >= 0:
            children[parent].append(own)
        for name, part in inner:
            each = enumerate(part) if isinstance(part, list) else [(0, part)]
            waiting.extend((own, "part", text_of(name), i, x if isinstance(x, dict) else {"": x}, request) for i, x in each)
        return own

    whole = _unwrapped(value)
    if isinstance(whole, dict) and "rows" in whole and (around := {k: v for k, v in whole.items() if k != "rows"}):
        begin(-1, "part", "envelope", 0, around, -1)
    for n, record in enumerate(records_in(value)):
        row = _unwrapped(record.get("load_gen_row"))
        request = begin(-1, "request", "", n, row if isinstance(row, dict) else {}, len(nodes))
        spans = [*spans_in(record.get("span")), *spans_in(record.get("spans"))]
        known = {"span", "spans", "load_gen_row"} if isinstance(row, dict) or row is None else {"span", "spans"}
        if rest := {k: v for k, v in record.items() if k not in known}:
            begin(request, "part", "record", 0, rest, request)
        waiting += [(request, "span", "", i, s, request) for i, s in enumerate(spans)][::-1]
        while waiting:
            parent, kind, role, ordinal, fields, request = waiting.pop()
            if kind == "part":
                begin(parent, kind, role, ordinal, fields, request)
                continue
            own = begin(parent, kind, role, ordinal, {k: v for k, v in fields.items() if k not in ("attributes", "children")}, request)
            for i, (k, v) in enumerate(attributes_in(fields.get("attributes"))):
                nodes.append([own, "attribute", "", i, {"name": k, "value": v}, "", request])
                children.append([])
                children[own].append(len(nodes) - 1)
            waiting += [(own, "span", "", i, s, request) for i, s in enumerate(spans_in(fields.get("children")))][::-1]
    for i in range(len(nodes) - 1, -1, -1):
        below = sorted((nodes[c][1], nodes[c][2], 0 if nodes[c][1] == "attribute" else nodes[c][3], nodes[c][5]) for c in children[i])
        nodes[i][5] = _identity(nodes[i][1], nodes[i][4], below)
    return nodes


def _exploder(kinds: tuple[str, ...]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        told: set[str] = set()
        for pdf in batches:
            rows: list[tuple] = []
            for raw_id, payload in zip(pdf["raw_id"], pdf["payload"]):
                try:
                    nodes = nodes_of(parse(payload)) if isinstance(payload, str) else None
                except (ValueError, RecursionError):
                    nodes = None
                if nodes is None:
                    rows.append(("unparsed", raw_id, None, None, None, None, None, None, None, None, None))
                    continue
                for i, (parent, kind, role, ordinal, content, own, request) in enumerate(nodes):
                    if kind not in kinds:
                        continue
                    if own not in told:
                        told.add(own)
                        rows.append(("object", None, None, None, kind, None, None, own, None, None, content))
                    rows.append(("bridge", raw_id, i, parent, kind, role, ordinal, own, nodes[parent][5] if parent >= 0 else "", nodes[request][5] if request >= 0 else "", None))
                if len(told) > 200_000:
                    told.clear()
                if len(rows) > 20_000:
                    yield pd.DataFrame(rows, columns=_COLUMNS)
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=_COLUMNS)

    return run


class Captures:
    """The flat tables of a set of captures (raw_id, payload); those of ``kinds`` are made, identities take in everything."""

    def __init__(self, payloads: DataFrame, kinds: tuple[str, ...] = KINDS) -> None:
        narrow = payloads.select(F.col("raw_id").cast("long"), F.col("payload").cast("string"))
        self.records = written(narrow.mapInPandas(_exploder(kinds), _SCHEMA), "rec", "kind")

    def objects(self, kind: str) -> DataFrame:
        """Each object once: hash, content."""
        own = self.records.filter((F.col("rec") == "object") & (F.col("kind") == kind)).select("hash", "content")
        return own.groupBy("hash").agg(F.first("content").alias("content"))

    def bridge(self, kind: str) -> DataFrame:
        """Every occurrence of an object of this kind, with the object around it and its ordinal there."""
        return self.records.filter((F.col("rec") == "bridge") & (F.col("kind") == kind)).select("raw_id", "occurrence", "parent", "role", "ordinal", "hash", "parent_hash", "request_hash")

    def unparsed(self) -> DataFrame:
        return self.records.filter("rec = 'unparsed'").select("raw_id")

    def requests(self) -> DataFrame:
        return self.objects("request").select("hash", F.coalesce(F.col("content")["conn_key"], F.lit("")).alias("conn_key"), "content")

    def spans(self) -> DataFrame:
        fields = [F.col("content")[k].alias(n) for k, n in (("spanID", "span_id"), ("parentSpanID", "told_parent_span_id"), ("type", "type"), ("kind", "span_kind"), ("hostName", "host_name"), ("peer", "peer"))]
        times = [F.expr(f"try_cast(content['{k}'] AS bigint)").alias(n) for k, n in (("start", "start_us"), ("handlerStart", "handler_start_us"), ("end", "end_us"))]
        return self.objects("span").select("hash", *fields, *times)

    def attributes(self) -> DataFrame:
        return self.objects("attribute").select("hash", F.col("content")["name"].alias("name"), F.col("content")["value"].alias("value"))

    def parts(self) -> DataFrame:
        return self.objects("part")

    def span_links(self) -> DataFrame:
        """Every span occurrence with its request's conn_key, its own id and that of the span around it ('' for outermost ones)."""
        ids = self.objects("span").select("hash", F.coalesce(F.col("content")["spanID"], F.lit("")).alias("span_id"))
        own = self.bridge("span").join(ids, "hash")
        own = own.join(ids.select(F.col("hash").alias("parent_hash"), F.col("span_id").alias("parent_span_id")), "parent_hash", "left")
        own = own.join(self.requests().select(F.col("hash").alias("request_hash"), "conn_key"), "request_hash")
        return own.select("raw_id", "occurrence", "parent", "ordinal", "conn_key", "span_id", F.coalesce("parent_span_id", F.lit("")).alias("parent_span_id"))
