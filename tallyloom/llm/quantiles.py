"""Exact percentiles per group of very large columns, by one distributed sort.

``summary`` counts equal values per group and part (a day's log, a partition):
an exact form that is smaller than the rows, and ``combine`` adds summaries up,
so parts can be kept and put together later in any order. ``percentiles`` sorts
a summary by group and value over the cluster. Each partition then tells how
many rows of its first and of its last group it holds, the only groups that can
reach into other partitions; from these counts every piece of a group gets its
offset and the group its size. In a second pass each partition locates the
target positions that fall to it, and the two order statistics around each
target are interpolated.

The stated error is zero: results equal sorting each group by itself. Position
q * (n - 1) is interpolated linearly.

Defined results: null values are not counted, groups of null values only give no
row; null group keys are groups; rows repeated exactly count each.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.session import cut, partitions


def summary(df: DataFrame, groups: dict[str, Column], value: str, part: Column | None = None) -> DataFrame:
    """Counts of equal values: the groups' columns, part, value, rows."""
    kept = df.filter(F.col(value).isNotNull()).select(*[c.alias(n) for n, c in groups.items()], (part if part is not None else F.lit(0)).alias("part"), F.col(value).cast("long").alias("value"))
    return kept.groupBy(*groups, "part", "value").agg(F.count("*").alias("rows"))


def combine(summaries: DataFrame, groups: list[str]) -> DataFrame:
    return summaries.groupBy(*groups, "value").agg(F.sum("rows").alias("rows"))


def _edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Size of the first and of the last group of a partition, in sorted order of its rows."""
    edge: list[list] = []
    for pdf in batches:
        if not len(pdf):
            continue
        g, n, pid = pdf["g"].to_numpy(), pdf["rows"].to_numpy(np.int64), int(pdf["pid"].iloc[0])
        starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        sums = np.add.reduceat(n, starts)
        for name, size in [(g[starts[0]], sums[0]), *([(g[starts[-1]], sums[-1])] if len(starts) > 1 else [])]:
            if edge and edge[-1][1] == name:
                edge[-1][2] += int(size)
            else:
                edge = [edge[0], [pid, name, int(size)]] if edge else [[pid, name, int(size)]]
    if edge:
        yield pd.DataFrame(edge, columns=["pid", "g", "rows"])


def _locate(offsets: dict[tuple[int, str], tuple[int, int]], wanted: list[Fraction]):
    """For each group piece, the values at the target positions that it holds."""

    def piece(pid: int, name: str, values: np.ndarray, rows: np.ndarray) -> list[tuple]:
        ends = np.cumsum(rows)
        before, total = offsets.get((pid, name), (0, int(ends[-1])))
        out = []
        for i, q in enumerate(wanted):
            at = q * (total - 1)
            low = at.numerator // at.denominator
            for which, target in ((0, low), (1, min(low + 1, total - 1))):
                if before <= target < before + int(ends[-1]):
                    out.append((name, i, which, int(values[np.searchsorted(ends, target - before, side="right")]), total))
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        name, pid, out = None, 0, []
        for pdf in batches:
            if not len(pdf):
                continue
            g, v, n, pid = pdf["g"].to_numpy(), pdf["value"].to_numpy(np.int64), pdf["rows"].to_numpy(np.int64), int(pdf["pid"].iloc[0])
            starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
            for a, z in zip(starts, [*starts[1:], len(g)]):
                if held and g[a] != name:
                    out += piece(pid, name, *map(np.concatenate, zip(*held)))
                    held = []
                name = g[a]
                held.append((v[a:z], n[a:z]))
            yield pd.DataFrame(out, columns=["g", "q", "which", "value", "n"])
            out = []
        if held:
            yield pd.DataFrame(piece(pid, name, *map(np.concatenate, zip(*held))), columns=["g", "q", "which", "value", "n"])

    return run


def percentiles(counts: DataFrame, groups: list[str], at: dict[str, str]) -> DataFrame:
    """``counts`` has the groups, value and rows, each value once a group. ``at`` gives result columns their quantile as decimal text, {'p50': '0.5'}."""
    spark = counts.sparkSession
    wanted = [Fraction(q) for q in at.values()]
    named = counts.withColumn("g", F.to_json(F.struct(*groups), {"ignoreNullFields": "false"}))
    keys = named.select("g", "value", "rows").repartitionByRange(partitions(spark), "g", "value").sortWithinPartitions("g", "value")
    ordered = cut(keys.withColumn("pid", F.spark_partition_id()))
    edges = sorted(ordered.mapInPandas(_edges, "pid int, g string, rows long").collect())  # at most two rows a partition
    totals: Counter[str] = Counter()
    pieces = Counter(g for _, g, _ in edges)
    for _, g, n in edges:
        totals[g] += n
    offsets, before = {}, Counter()
    for pid, g, n in edges:
        if pieces[g] > 1:
            offsets[pid, g] = (before[g], totals[g])
            before[g] += n
    found = ordered.mapInPandas(_locate(offsets, wanted), "g string, q int, which int, value long, n long")
    one = [F.max(F.when((F.col("q") == i) & (F.col("which") == w), F.col("value"))).alias(f"v{i}_{w}") for i in range(len(wanted)) for w in (0, 1)]
    wide = found.groupBy("g").agg(F.max("n").alias("n"), *one)

    def value(i: int, q: Fraction) -> Column:
        rest = (F.lit(q.numerator) * (F.col("n") - 1)) % F.lit(q.denominator)
        low, high = F.col(f"v{i}_0").cast("double"), F.col(f"v{i}_1").cast("double")
        return low + (high - low) * (rest.cast("double") / F.lit(float(q.denominator)))

    schema = named.select(*groups).schema
    own = F.from_json("g", schema)
    return wide.select(*[own[g].alias(g) for g in groups], "n", *[value(i, q).alias(name) for i, (name, q) in enumerate(zip(at, wanted))])
