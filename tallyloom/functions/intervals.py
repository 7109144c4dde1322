"""Wilson score bounds of a share, in decimals of 28 digits."""

from __future__ import annotations

from decimal import Context, Decimal, localcontext

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def wilson(hits: int, total: int, z: Decimal = Decimal("1.96")) -> tuple[Decimal, Decimal]:
    if total < 1 or not 0 <= hits <= total:
        raise ValueError(f"{hits} of {total} is no share")
    with localcontext(Context(prec=28)):
        n, share, square = Decimal(total), Decimal(hits) / total, z * z
        middle = share + square / (2 * n)
        half = z * (share * (1 - share) / n + square / (4 * n * n)).sqrt()
        whole = 1 + square / n
        return max(Decimal(0), (middle - half) / whole), min(Decimal(1), (middle + half) / whole)


def wilson_bound(hits: Column, total: Column, upper: bool, z: Decimal = Decimal("1.96")) -> Column:
    """The bound as DECIMAL(20,18); null where there is nothing to share."""

    @F.pandas_udf("decimal(20,18)")
    def bound(h: pd.Series, n: pd.Series) -> pd.Series:
        known = {}
        for a, b in set(zip(h, n)):
            known[a, b] = wilson(int(a), int(b), z)[upper].quantize(Decimal("1e-18")) if b == b and b and b > 0 else None
        return pd.Series([known[x] for x in zip(h, n)], dtype=object)

    return bound(hits, total)
