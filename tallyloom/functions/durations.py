"""Durations as text with units ('1m2.5s', '850µs') in nanoseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Nanoseconds of each unit.
UNITS = {"ns": 1, "µs": 1_000, "us": 1_000, "ms": 1_000_000, "s": 1_000_000_000, "m": 60_000_000_000, "h": 3_600_000_000_000}


def duration_ns(text: Column) -> Column:
    """Null where the text is no such duration."""
    parts = F.regexp_extract_all(text, F.lit(r"([0-9.]+)(ns|µs|us|ms|s|m|h)"), F.lit(0))
    unit = F.create_map(*[F.lit(x) for pair in UNITS.items() for x in pair])

    def one(part: Column) -> Column:
        number = F.regexp_extract(part, r"^[0-9.]+", 0).try_cast("decimal(28,9)")
        return number * unit[F.regexp_extract(part, r"[a-zµ]+$", 0)].cast("decimal(14,0)")

    total = F.aggregate(F.transform(parts, one), F.lit(0).cast("decimal(38,9)"), lambda a, x: (a + x).cast("decimal(38,9)"))
    return F.when(text.rlike(r"^(?:[0-9.]+(?:ns|µs|us|ms|s|m|h))+$"), F.floor(total).cast("long"))
