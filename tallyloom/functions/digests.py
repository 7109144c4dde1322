"""Content fingerprints: the first 16 hex digits of SHA-256 over parts that no part can run into."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

UNIT = "\x1f"


def digest(*parts: Column) -> Column:
    """Null parts count as empty."""
    return F.substring(F.sha2(F.concat_ws(UNIT, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, 16)


def short_hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def digest_text(*parts: str) -> str:
    return short_hash(UNIT.join(parts))
