"""Groups of records that are linked directly or through others, by deterministic Borůvka hooking.

Records are numbered in the order of their keys, by a range sort, so a smaller
number is a smaller key. In each round every component selects its smallest
outgoing edge (by the lesser and then the greater component), which hooks it to
the component at the other end; two components that select the same edge would
point at one another, and the lesser becomes the root. Pointer doubling
collapses each tree onto its root. Edges are then relabelled with the roots,
those inside a component dropped and parallel ones merged, until none remain.
Each round at least halves the components that still have edges. Once no more
than ``few`` edges are left (some 16 MB) the remaining rounds are made by one task
in memory. The rounds' maps are composed backwards from the last, smallest one.

Copies of an edge are merged before anything else, a component's choice is a
minimum that is pre-aggregated where the rows are, and pointers that have
reached a root leave the doubling, so no step gathers a large component.

Defined results: pairs with a null end name the other end only; a record named
only alone or with itself is its own group; the group's identifier is its least
record.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.session import cut, partitions


def _numbered(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Each record once with a number that follows the order of the keys."""
    sorted_ = nodes.distinct().repartitionByRange(partitions(nodes.sparkSession), *keys).sortWithinPartitions(*keys)
    return cut(sorted_.withColumn("id", F.monotonically_increasing_id()))


def _hooks(edges: DataFrame) -> DataFrame:
    """(c, p): what each component's smallest edge hooks it to; of two that choose one another the lesser has none and is a root."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("c"), F.col("u").alias("lo"), F.col("v").alias("hi")), F.struct(F.col("v").alias("c"), F.col("u").alias("lo"), F.col("v").alias("hi")))).alias("e")).select("e.*")
    low = ends.groupBy("c").agg(F.min(F.struct("lo", "hi")).alias("e")).select("c", F.when(F.col("e.lo") == F.col("c"), F.col("e.hi")).otherwise(F.col("e.lo")).alias("p"))
    other = low.select(F.col("c").alias("p"), F.col("p").alias("back"))
    mutual = low.join(other, "p", "left")
    return mutual.select("c", F.when((F.col("back") == F.col("c")) & (F.col("c") < F.col("p")), F.col("c")).otherwise(F.col("p")).alias("p"))


def _collapsed(pointers: DataFrame) -> DataFrame:
    """The same components with their roots, by pointer doubling, twice at a time; those that have found their root rest and are only looked up."""
    state = cut(pointers.withColumn("there", F.col("c") == F.col("p")))
    while True:
        look = state.select(F.col("c").alias("p"), F.col("p").alias("q"), F.col("there").alias("rests"))
        once = state.filter("not there").join(look, "p").select("c", F.col("q").alias("p"), F.col("rests").alias("there"))
        again = state.filter("there").unionByName(once).select(F.col("c").alias("p"), F.col("p").alias("q"), F.col("there").alias("rests"))
        stepped = cut(once.join(again, "p").select("c", F.col("q").alias("p"), F.col("rests").alias("there")))
        state = state.filter("there").unionByName(stepped)
        if stepped.filter("not there").isEmpty():
            return state.select("c", "p")


def _finished(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The remaining rounds over edges (u, v) held by one task: c, p of all components that have edges."""
    parts = [pdf[["u", "v"]].to_numpy(np.int64) for pdf in batches]
    edges = np.concatenate(parts) if parts else np.empty((0, 2), np.int64)
    names, ends = np.unique(edges, return_inverse=True)
    ends = ends.reshape(-1, 2)
    root = np.arange(len(names))
    while len(ends):
        n = len(names)
        lo, hi = ends.min(axis=1), ends.max(axis=1)
        rank = np.lexsort((hi, lo))  # place of each edge in the order of lesser and greater component
        order = np.empty(len(rank), np.int64)
        order[rank] = np.arange(len(rank))
        least = np.full(n, len(rank))
        np.minimum.at(least, lo, order)
        np.minimum.at(least, hi, order)
        live = np.flatnonzero(least < len(rank))
        chosen = rank[least[live]]
        hook = np.arange(n)
        hook[live] = lo[chosen] + hi[chosen] - live
        mutual = (hook[hook] == np.arange(n)) & (np.arange(n) < hook)
        hook[mutual] = np.flatnonzero(mutual)
        while not np.array_equal(hook, hook[hook]):
            hook = hook[hook]
        root = hook[root]
        ends = hook[ends]
        ends = np.unique(np.sort(ends[ends[:, 0] != ends[:, 1]], axis=1), axis=0)
    yield pd.DataFrame({"c": names, "p": names[root]})


def labelled(pairs: DataFrame, keys: list[str], left: str, right: str, few: int = 1_000_000) -> DataFrame:
    """``pairs`` has two structs of ``keys``, ``left`` and ``right``. Returns group_<key> and <key> for every record named."""
    whole = lambda s: F.coalesce(*[F.when(F.col(f"{s}.{k}").isNull(), F.lit(False)) for k in keys], F.col(s).isNotNull())
    pairs = pairs.select(F.when(whole(left), F.struct(*[F.col(f"{left}.{k}") for k in keys])).alias("a"), F.when(whole(right), F.struct(*[F.col(f"{right}.{k}") for k in keys])).alias("b")).distinct()
    pairs = cut(pairs)
    nodes = _numbered(pairs.select("a").union(pairs.select("b")).filter("a is not null").select("a.*"), keys)
    node = nodes.select(F.struct(*keys).alias("k"), "id")
    edges = pairs.filter("a is not null and b is not null and a <> b")
    edges = edges.join(node.select(F.col("k").alias("a"), F.col("id").alias("u")), "a").join(node.select(F.col("k").alias("b"), F.col("id").alias("v")), "b")
    edges = cut(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    maps: list[DataFrame] = []
    while (rest := edges.count()) > 0:
        if rest <= few:
            maps.append(cut(edges.repartition(1).mapInPandas(_finished, "c long, p long")))
            break
        roots = _collapsed(_hooks(edges))
        maps.append(roots)
        relabelled = edges.join(roots.select(F.col("c").alias("u"), F.col("p").alias("ru")), "u").join(roots.select(F.col("c").alias("v"), F.col("p").alias("rv")), "v")
        edges = cut(relabelled.filter("ru <> rv").select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct())
    final = None
    for step in reversed(maps):
        if final is not None:
            after = final.select(F.col("c").alias("p"), F.col("p").alias("q"))
            step = step.join(after, "p", "left").select("c", F.coalesce("q", "p").alias("p"))
        final = step
    if final is None:
        return nodes.select(*[F.col(k).alias(f"group_{k}") for k in keys], *keys)
    labels = nodes.join(final.select(F.col("c").alias("id"), "p"), "id", "left").withColumn("p", F.coalesce("p", "id"))
    named = labels.groupBy("p").agg(F.min(F.struct("id", *keys)).alias("least")).select("p", *[F.col(f"least.{k}").alias(f"group_{k}") for k in keys])
    return labels.join(named, "p").select(*[f"group_{k}" for k in keys], *keys)
