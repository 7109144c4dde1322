"""Aggregates by event time over a journal, corrected as late rows arrive, with a cut-off.

The journal is folded in order of arrival. A flow's clock is the least of its
declared sources' clocks, a source's clock the largest time that it has told so
far; the cut-off lies ``lateness`` behind the flow's clock. On-time and late
rows go into a finger B-tree of partial aggregates keyed by event time: a row
near the newest time is added at the right finger, a late one further left, and
the partial aggregates of the nodes above it are updated on the way to the
root. When the cut-off passes the end of a period the period's aggregate is
read from the tree and everything older is dropped as whole subtrees. Rows older
than the cut-off are refused.

To hold flows of any size the journal is divided into stretches of successive
entries by a range sort of their positions, so their sizes don't depend on how
the positions are spread. What the clocks have reached before each stretch is a
running maximum over one row per source and stretch, so every (flow, stretch)
folds on its own, and the counts of a period are the sums over its stretches.

Defined results: rows without a time tell nothing and are no case; of a
redelivered row only the first position counts; there is no cut-off until every
declared source has told a time; flows without a declaration have none.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.session import cut, partitions

WIDTH = 64


class _Node:
    __slots__ = ("keys", "parts", "total", "up")

    def __init__(self, keys: list, parts: list, total: list, up: _Node | None = None) -> None:
        self.keys, self.parts, self.total, self.up = keys, parts, total, up


class FingerTree:
    """Partial aggregates (rows, corrections) by event time; inner nodes hold the sums of what is below them.

    ``keys`` of a leaf are event times, those of an inner node the least key of each child.
    """

    def __init__(self) -> None:
        self.right = self.root = _Node([], [], [0, 0])

    def add(self, key: int, rows: int = 1, corrections: int = 0) -> None:
        node = self.right
        while node.up is not None and (not node.keys or key < node.keys[0]):  # from the finger up to a node that spans the key
            node = node.up
        while node.parts and isinstance(node.parts[0], _Node):
            node = node.parts[max(0, bisect_right(node.keys, key) - 1)]
        at = bisect_left(node.keys, key)
        if at < len(node.keys) and node.keys[at] == key:
            node.parts[at][0] += rows
            node.parts[at][1] += corrections
        else:
            node.keys.insert(at, key)
            node.parts.insert(at, [rows, corrections])
        low, n = key, node
        while n is not None:
            n.total[0] += rows
            n.total[1] += corrections
            if n.up is not None and at == 0:
                i = n.up.parts.index(n)
                n.up.keys[i] = min(n.up.keys[i], low)
            n = n.up
        if len(node.keys) > WIDTH:
            self._split(node)

    def _split(self, node: _Node) -> None:
        half = len(node.keys) // 2
        new = _Node(node.keys[half:], node.parts[half:], [0, 0], node.up)
        for part in new.parts:
            inner = isinstance(part, _Node)
            if inner:
                part.up = new
            for i in (0, 1):
                new.total[i] += (part.total if inner else part)[i]
        del node.keys[half:], node.parts[half:]
        node.total[0] -= new.total[0]
        node.total[1] -= new.total[1]
        if node is self.right:
            self.right = new
        if node.up is None:
            self.root = _Node([node.keys[0], new.keys[0]], [node, new], [node.total[0] + new.total[0], node.total[1] + new.total[1]])
            node.up = new.up = self.root
            return
        i = node.up.parts.index(node) + 1
        node.up.keys.insert(i, new.keys[0])
        node.up.parts.insert(i, new)
        if len(node.up.keys) > WIDTH:
            self._split(node.up)

    def below(self, key: int) -> list[int]:
        """The aggregate of everything older than ``key``, from the partial aggregates along one path."""
        out, node = [0, 0], self.root
        while True:
            inner = bool(node.parts) and isinstance(node.parts[0], _Node)
            last = bisect_left(node.keys, key)
            whole = last - 1 if inner else last
            for part in node.parts[: max(0, whole)]:
                for i in (0, 1):
                    out[i] += (part.total if inner else part)[i]
            if not inner or last == 0:
                return out
            node = node.parts[last - 1]

    def evict(self, key: int) -> None:
        """Drops everything older than ``key``: whole subtrees at each level of one path."""
        node, path = self.root, []
        while True:
            inner = bool(node.parts) and isinstance(node.parts[0], _Node)
            path.append((node, inner))
            last = bisect_left(node.keys, key)
            drop = max(0, last - 1) if inner else last
            del node.keys[:drop], node.parts[:drop]
            if not inner or last == 0:
                break
            node = node.parts[0]
        for node, inner in reversed(path):
            if inner and not node.parts[0].keys:
                del node.keys[0], node.parts[0]
            if inner and node.keys:
                node.keys[0] = node.parts[0].keys[0]
            node.total = [sum((p.total if inner else p)[i] for p in node.parts) for i in (0, 1)]
        if not self.root.keys:
            self.root = _Node([], [], [0, 0])
        while isinstance(self.root.parts and self.root.parts[0], _Node) and len(self.root.parts) == 1:
            self.root = self.root.parts[0]
            self.root.up = None
        self.right = self.root
        while self.right.parts and isinstance(self.right.parts[0], _Node):
            self.right = self.right.parts[-1]

    def close(self, size: int, until: float) -> list[tuple[int, int, int]]:
        """Reads and drops the periods before period number ``until``, oldest first, as (period, rows, corrections)."""
        out = []
        while self.root.keys and self.root.keys[0] // size < until:
            p = self.root.keys[0] // size
            out.append((p, *self.below((p + 1) * size)))
            self.evict((p + 1) * size)
        return out


def fold(rows, clocks: dict[str, int | None], lateness: int, period: int):
    """Folds (pos, source, time, counts) in order of pos, ``counts`` telling first deliveries from mere clock readings.

    Returns refused rows as (pos, time, cut-off) and, for each period, (period, rows, corrections, closing pos or None).
    """
    tree, refused, done = FingerTree(), [], []
    clock = None if None in clocks.values() or not clocks else min(clocks.values())
    edge = None if clock is None else (clock - lateness) // period
    for pos, source, time, counts in rows:
        if counts:
            if clock is not None and time < clock - lateness:
                refused.append((pos, time, clock - lateness))
            else:
                tree.add(time, 1, int(clock is not None and clock >= (time // period + 1) * period))
        if source in clocks and (clocks[source] is None or time > clocks[source]):
            held = clocks[source] == clock
            clocks[source] = time
            if held or clock is None:
                clock = None if None in clocks.values() else min(clocks.values())
                if clock is not None and (edge is None or (clock - lateness) // period > edge):
                    edge = (clock - lateness) // period
                    done += [(*x, pos) for x in tree.close(period, edge)]
    return refused, done + [(*x, None) for x in tree.close(period, float("inf"))]


def in_stretches(entries: DataFrame, stretch: int) -> DataFrame:
    """The entries with ``part``: stretches of at most ``stretch`` entries that follow one another in ``pos``, kept so that all uses see the same ones."""
    placed = entries.repartitionByRange(partitions(entries.sparkSession), "pos").sortWithinPartitions("pos")
    return cut(placed.withColumn("part", F.floor(F.monotonically_increasing_id() / F.lit(stretch)).cast("long")))


def carried_clocks(told: DataFrame, config: DataFrame) -> DataFrame:
    """What each declared source's clock has reached before each stretch: f, p (flow and stretch), source, clock as text, and the flow's settings.

    ``told``: flow_id, part, source, time. One row for each source and stretch, however many rows these hold.
    """
    settings = [c for c in ("lateness_us", "period_us", "window_us", "max_silence_us") if c in config.columns]
    declared = config.select("flow_id", *settings, F.array_distinct(F.filter("sources", lambda s: s.isNotNull())).alias("sources")).dropDuplicates(["flow_id"])
    tops = told.groupBy("flow_id", "part", "source").agg(F.max("time").alias("top"), F.min("time").alias("low"))
    parts = tops.groupBy("flow_id", "part").agg(F.min("low").alias("low"))
    grid = parts.join(declared, "flow_id", "left").select("flow_id", "part", "low", *settings, F.explode_outer("sources").alias("source"))
    before = Window.partitionBy("flow_id", "source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = grid.join(tops.drop("low"), ["flow_id", "part", "source"], "left").withColumn("clock", F.max("top").over(before).cast("string")).withColumn("first_at", F.min("low").over(before).cast("string"))
    return carried.select(F.col("flow_id").alias("f"), F.col("part").alias("p"), *settings, "source", "clock", "first_at")


def late_events(journal: DataFrame, config: DataFrame, stretch: int = 50_000) -> DataFrame:
    """The fold over a whole journal: rows of ``kind`` 'refused' (flow_id, pos, at_us, cutoff_us) and 'partial' (flow_id, period, rows, corrections, pos of closing)."""
    seen = F.col("kind") == "seen"
    j = journal.select("flow_id", "pos", "source", "seq", seen.alias("seen"), F.when(seen, F.coalesce("at_us", "end_us")).when(F.col("kind") == "advance", F.col("until_us")).alias("time"))
    j = j.filter("time is not null and flow_id is not null and pos is not null and source is not null")
    j = in_stretches(j, stretch)
    first = j.filter("seen and seq is not null").groupBy("flow_id", "source", "seq").agg(F.min_by(F.struct("pos", "time", "part"), "pos").alias("f"))
    first = first.select("flow_id", "f.pos", "source", "f.time", F.lit(True).alias("counts"), "f.part")
    told = j.select("flow_id", "pos", "source", "time", F.lit(False).alias("counts"), "part")
    rows = first.unionByName(told)

    carried = carried_clocks(told, config)

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        columns = ["flow_id", "kind", "pos", "at_us", "cutoff_us", "period_us", "period", "rows", "corrections"]
        if not len(left):
            return pd.DataFrame(columns=columns)
        left = left.sort_values(["pos", "counts"], ascending=[True, False])
        clocks = {s: (None if pd.isna(c) else int(c)) for s, c in zip(right["source"], right["clock"]) if s is not None}
        lateness, period = (None if not len(right) or pd.isna(right[c].iloc[0]) else int(right[c].iloc[0]) for c in ("lateness_us", "period_us"))
        if lateness is None:
            clocks = {}
        refused, periods = fold(zip(left["pos"].tolist(), left["source"].tolist(), left["time"].tolist(), left["counts"].tolist()), clocks, lateness or 0, period or 1 << 62)
        flow = left["flow_id"].iloc[0]
        out = [(flow, "refused", p, t, c, period, None, None, None) for p, t, c in refused] + [(flow, "partial", pos, None, None, period, p, n, m) for p, n, m, pos in periods]
        out = pd.DataFrame(out, columns=columns)
        return out.astype({c: "Int64" for c in columns[2:]})

    return rows.groupBy("flow_id", "part").cogroup(carried.groupBy("f", "p")).applyInPandas(run, "flow_id string, kind string, pos long, at_us long, cutoff_us long, period_us long, period long, rows long, corrections long")


def beyond_cutoff(folded: DataFrame) -> DataFrame:
    return folded.filter("kind = 'refused'").select("flow_id", "pos", "at_us", "cutoff_us")


def period_counts(folded: DataFrame) -> DataFrame:
    """Rows per flow and period, and how many of them came after the flow's clock had left the period, corrections of a count already told; and rows refused."""
    counted = folded.filter("kind = 'partial'").select("flow_id", (F.col("period") * F.col("period_us")).alias("period_start_us"), "rows", "corrections", F.lit(0).alias("refused"))
    cut_off = folded.filter("kind = 'refused'").select("flow_id", (F.floor(F.col("at_us") / F.col("period_us")) * F.col("period_us")).alias("period_start_us"), F.lit(0).alias("rows"), F.lit(0).alias("corrections"), F.lit(1).alias("refused"))
    return counted.unionByName(cut_off).groupBy("flow_id", "period_start_us").agg(*[F.sum(c).cast("long").alias(c) for c in ("rows", "corrections", "refused")])
