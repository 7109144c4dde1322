"""Booked entries of bank statements (camt.053.001.08) as canonical records.

Strict: other namespaces, document type declarations, and missing, empty or
repeated fields that are used make a statement an error, told with its raw id.
"""

from __future__ import annotations

import hashlib
import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from datetime import date
from decimal import Decimal, InvalidOperation

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAMESPACE = "urn:iso:std:iso:20022:tech:xsd:camt.053.001.08"  # fixed value
SCHEMA = "raw_event_id string, locator string, account string, amount decimal(18,2), amount_text string, value_date date, currency string, error string"


class _Plain(ET.TreeBuilder):
    def doctype(self, *_: object) -> None:
        raise ValueError("a document type declaration")


class _Node:
    """An element whose children are found by path, within the one namespace."""

    def __init__(self, element: ET.Element) -> None:
        self.element = element

    def all(self, path: str) -> list[_Node]:
        found = [self.element]
        for name in path.split("/"):
            found = [c for e in found for c in e if c.tag == f"{{{NAMESPACE}}}{name}"]
        return [_Node(e) for e in found]

    def only(self, path: str) -> _Node:
        found = self.all(path)
        if len(found) != 1:
            raise ValueError(f"{len(found)} of {path}, not one")
        return found[0]

    def text(self, pattern: str = r".+", what: str = "text") -> str:
        own = (self.element.text or "").strip()
        if not re.fullmatch(pattern, own, re.S):
            raise ValueError(f"{what}: {own!r}")
        return own


def _entry(node: _Node) -> tuple[Decimal, str, date, str]:
    node.only("Sts/Cd").text("BOOK", "only booked entries")
    sign = node.only("CdtDbtInd").text("CRDT|DBIT", "CdtDbtInd")
    money = node.only("Amt")
    text = money.text(r"[0-9]+(\.[0-9]+)?", "Amt is unsigned, without exponent")
    amount = -Decimal(text) if sign == "DBIT" else Decimal(text)  # a reversal tells its own direction
    value = node.only("ValDt")
    if [c.tag for c in value.element] != [f"{{{NAMESPACE}}}Dt"]:
        raise ValueError("ValDt holds a date only")
    day = date.fromisoformat(value.only("Dt").text(r"\d{4}-\d{2}-\d{2}", "ValDt/Dt"))
    currency = money.element.get("Ccy", "")
    if not re.fullmatch("[A-Z]{3}", currency):
        raise ValueError(f"currency {currency!r}")
    for r in [node.only("RvslInd")] if node.all("RvslInd") else []:
        r.text("true|false|0|1", "RvslInd")
    return amount, str(amount), day, currency


def entries(payload: bytes) -> list[tuple]:
    """(locator, account, amount, amount text, value date, currency) of each entry."""
    root = ET.fromstring(payload, ET.XMLParser(target=_Plain()))
    if root.tag != f"{{{NAMESPACE}}}Document":
        raise ValueError("not a camt.053.001.08 document")
    out = []
    statements = _Node(root).only("BkToCstmrStmt").all("Stmt")
    if not statements:
        raise ValueError("no statement")
    for i, statement in enumerate(statements, 1):
        statement.only("Id").text()
        names = statement.only("Acct/Id").all("IBAN") + statement.only("Acct/Id").all("Othr/Id")
        if len(names) != 1:
            raise ValueError("not one account")
        account = names[0].text()
        for j, entry in enumerate(statement.all("Ntry"), 1):
            at = f"/Document/BkToCstmrStmt/Stmt[{i}]/Ntry[{j}]"
            try:
                amount, text, day, currency = _entry(entry)
            except (ValueError, InvalidOperation) as e:
                raise ValueError(f"{at}: {e}") from e
            out.append((at, account, amount, text, day, currency))
    return out


def statement_records(raw: DataFrame) -> DataFrame:
    """``raw``: raw_event_id, payload. One row for each entry, or one with ``error`` for a payload that is refused whole."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows: list[tuple] = []
            for raw_id, payload in zip(pdf["raw_event_id"], pdf["payload"]):
                try:
                    rows += [(raw_id, *e, None) for e in entries(bytes(payload) if payload is not None else b"")]
                except (ValueError, ET.ParseError) as e:
                    rows.append((raw_id, None, None, None, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return raw.select("raw_event_id", "payload").mapInPandas(run, SCHEMA)


def canonical_json(value: object) -> str:
    """JSON with sorted keys and no spaces: the same bytes for the same content."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def record_id(*parts: str) -> str:
    return hashlib.sha256(canonical_json(list(parts)).encode()).hexdigest()


def identity(adapter: Column, normalizer: Column) -> Column:
    """Content-addressed: the same entry of the same payload read by the same adapter has the same id."""
    return F.sha2(F.to_json(F.array("raw_event_id", "locator", adapter, normalizer, "account", "amount_text", F.col("value_date").cast("string"), "currency")), 256)


def with_record_ids(records: DataFrame, adapter: str, normalizer: str) -> DataFrame:
    return records.filter("error is null").withColumn("record_id", identity(F.lit(adapter), F.lit(normalizer)))
