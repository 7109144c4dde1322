"""Texts put into packs of fixed capacity with little room left, by a configuration linear program.

Lengths are counted into a histogram, at most one row for each length up to the
capacity, however many texts there are. Over it the linear program "cover every
length's count with as few packs as possible", with a variable for each way to
fill a pack, is solved by multiplicative weights: lengths that are covered
least weigh most, and the pack that is worth most at these weights, found by
dynamic programming over the capacity (a knapsack), is added to the mix. The
weights also price the lengths so that no pack is worth more than one, which
makes their sum a lower bound on the number of packs. The program is stopped
after a number of rounds, whether its mix covers all lengths or not. The mix is
scaled to the histogram and rounded down; what is left over, most of the tokens
in general, is packed best-fit, the longest first, again on the histogram.

The plan tells for each length which of its texts, by rank, go to which packs.
Ranks come from a distributed sort with counts per partition. The plan's size
depends on the capacity, not on the texts.

Only a text longer than the capacity is split: into full packs and a rest.

Defined results: null and empty texts take no room and stand in pack 1; texts
of equal length are taken in the order of doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.ranking import ranked
from tallyloom.session import cut

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id and the number of tokens of its text; strings of special tokens count as ordinary text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(tokenizer)
        t.encode_special_tokens = True
        encode = getattr(t, "encode_batch_fast", t.encode_batch)
        for pdf in batches:
            texts = [x if isinstance(x, str) else "" for x in pdf["text"]]
            counts = []
            for i in range(0, len(texts), 128):
                counts += [len(e.ids) for e in encode(texts[i : i + 128], add_special_tokens=False)]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "tokens": counts})

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(run, "doc_id long, tokens long")


def knapsack(lengths: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    """How many of each length (ascending) fill a pack of the greatest worth, and that worth."""
    best = np.zeros(capacity + 1)
    choice = np.full(capacity + 1, -1, np.int32)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(int(lengths[0]), capacity + 1):
        k = fits[c]
        value = best[c - lengths[:k]] + worth[:k]
        i = int(value.argmax())
        best[c], choice[c] = value[i], i
    out = np.zeros(len(lengths), np.int64)
    c = capacity
    while choice[c] >= 0:
        out[choice[c]] += 1
        c -= int(lengths[choice[c]])
    return out, float(best[capacity])


def mixture(lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int) -> tuple[list[tuple[np.ndarray, float]], float]:
    """Packs with fractional multiplicities that cover the counts, and a lower bound on the number of packs."""
    covered = np.zeros(len(lengths))
    mix: list[tuple[np.ndarray, float]] = []
    bound = float(np.ceil((lengths * counts).sum() / capacity))
    eta = 8.0
    for _ in range(rounds):
        weight = np.exp(-eta * (covered - covered.min()))
        # what is covered already is worth little, the rest by its room
        worth = weight * lengths / capacity
        pack, value = knapsack(lengths, worth, capacity)
        bound = max(bound, float(np.ceil((counts * worth).sum() / value - 1e-9)))
        some = pack > 0
        times = max(1.0, float((counts[some] / pack[some]).min()) / 2)
        mix.append((pack, times))
        covered[some] += pack[some] * times / counts[some]
        if covered.min() >= 1:
            break
    return mix, bound


def plan(lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = 250) -> tuple[list[tuple[np.ndarray, int]], int]:
    """Packs and how often each is made; together they hold every count. And the lower bound."""
    left = counts.astype(np.int64).copy()
    packs: list[tuple[np.ndarray, int]] = []
    full = lengths == capacity
    if full.any():
        packs.append((full.astype(np.int64), int(left[full][0])))
        left[full] = 0
    live = left > 0
    bound = 0
    if live.any():
        own, n = lengths[live], left[live].astype(float)
        mix, bound = mixture(own, n, capacity, rounds)
        scale = (own * n).sum() / max(1.0, sum(float((own * p).sum()) * x for p, x in mix))
        at = np.flatnonzero(live)
        for pack, times in sorted(mix, key=lambda m: -m[1] * float((own * m[0]).sum())):
            some = pack > 0
            made = min(int(times * min(1.0, scale)), int((left[at][some] // pack[some]).min()))
            if made > 0:
                whole = np.zeros(len(lengths), np.int64)
                whole[at] = pack
                packs.append((whole, made))
                left -= whole * made
    while left.any():  # best fit, the longest first; a pack that can be made again is made as often as it can
        whole, room = np.zeros(len(lengths), np.int64), capacity
        while True:
            free = np.flatnonzero((left - whole > 0) & (lengths <= room))
            if not len(free):
                break
            i = free[-1]
            take = min(int((left - whole)[i]), room // int(lengths[i]))
            whole[i] += take
            room -= take * int(lengths[i])
        some = whole > 0
        made = int((left[some] // whole[some]).min())
        packs.append((whole, made))
        left -= whole * made
    return packs, bound + (int(counts[full][0]) if full.any() else 0)


def _solve(rounds: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("length")
        lengths, counts, capacity = pdf["length"].to_numpy(np.int64), pdf["pieces"].to_numpy(np.int64), int(pdf["capacity_tokens"].iloc[0])
        packs, bound = plan(lengths, counts, capacity, rounds)
        rows, first, ranks = [], 1, np.zeros(len(lengths), np.int64)
        for pack, made in packs:
            for i in np.flatnonzero(pack):
                rows.append((pdf["pack_id"].iloc[0], int(lengths[i]), int(ranks[i]), int(pack[i]), first, made, bound))
                ranks[i] += int(pack[i]) * made
            first += made
        return pd.DataFrame(rows, columns=["pack_id", "length", "from_rank", "each", "first_pack", "made", "lower_bound"])

    return run


def _declared(capacities: DataFrame, most: int = 1_000) -> list[tuple[int, int]]:
    declared = sorted({(r["pack_id"], r["capacity_tokens"]) for r in capacities.filter("pack_id is not null and capacity_tokens > 0").select("pack_id", "capacity_tokens").limit(most + 1).collect()})
    if len(declared) > most or len({p for p, _ in declared}) < len(declared):
        raise ValueError(f"pack ids must have one capacity each, and be {most} at most")
    return declared


def _each(declared: list[tuple[int, int]], rows: DataFrame, *columns: str) -> DataFrame:
    """The rows (tokens and ``columns``) for each capacity, with ``full``: how many packs a text fills by itself before its last piece."""
    packs = F.array(*[F.struct(F.lit(p).cast("long").alias("pack_id"), F.lit(c).cast("long").alias("capacity_tokens")) for p, c in declared]) if declared else F.array().cast("array<struct<pack_id:long,capacity_tokens:long>>")
    each = rows.select(*columns, "tokens", F.explode(packs).alias("p")).select("p.*", *columns, "tokens")
    return each.withColumn("full", F.floor(F.greatest(F.col("tokens") - 1, F.lit(0)) / F.col("capacity_tokens")).cast("int"))


def pieces(counts: DataFrame, declared: list[tuple[int, int]]) -> DataFrame:
    """Every text for every capacity; those longer than it in pieces: pack_id, capacity_tokens, doc_id, piece, length."""
    cut_ = _each(declared, counts, "doc_id").withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("full"))))
    return cut_.select("pack_id", "capacity_tokens", "doc_id", "piece", F.least(F.col("capacity_tokens"), F.col("tokens") - F.col("piece").cast("long") * F.col("capacity_tokens")).alias("length"))


class Packing:
    def __init__(self, counts: DataFrame, capacities: DataFrame, rounds: int = 250) -> None:
        self.declared = _declared(capacities)
        self.counts = cut(counts.filter("doc_id is not null"))
        self.lengths = cut(self.counts.groupBy("tokens").agg(F.count("*").alias("texts")))  # one row for each length there is
        each = _each(self.declared, self.lengths, "texts")
        parts = F.array(F.struct(F.col("capacity_tokens").alias("length"), (F.col("full") * F.col("texts")).alias("n")), F.struct((F.col("tokens") - F.col("full") * F.col("capacity_tokens")).alias("length"), F.col("texts").alias("n")))
        histogram = each.select("pack_id", "capacity_tokens", F.explode(parts).alias("x")).filter("x.length > 0 and x.n > 0").groupBy("pack_id", "capacity_tokens", F.col("x.length").alias("length")).agg(F.sum("x.n").alias("pieces"))
        schema = "pack_id long, length long, from_rank long, each long, first_pack long, made long, lower_bound long"
        self.plan = cut(histogram.groupBy("pack_id").applyInPandas(_solve(rounds), schema))

    def packs(self) -> DataFrame:
        """pack_id, pack_no, doc_id, piece, length: where each text, or each piece of one that is too long, goes."""
        every = pieces(self.counts, self.declared).drop("capacity_tokens")
        sized = ranked(every.filter("length > 0"), ["pack_id", "length"], ["doc_id", "piece"])
        rows = self.plan.orderBy("pack_id", "length", "from_rank").select("pack_id", "length", "from_rank", "each", "first_pack").toPandas()  # its size depends on the capacities only
        groups = rows.groupby(["pack_id", "length"], sort=True).indices
        own = {k: rows.iloc[i][["from_rank", "each", "first_pack"]].to_numpy(np.int64) for k, i in groups.items()}
        shared = sized.sparkSession.sparkContext.broadcast(own)

        @F.pandas_udf("long")
        def pack_no(pack_id: pd.Series, length: pd.Series, rank: pd.Series) -> pd.Series:
            out = np.zeros(len(rank), np.int64)
            at = rank.to_numpy(np.int64)
            for key, some in pd.DataFrame({"p": pack_id, "l": length}).groupby(["p", "l"]).indices.items():
                table = shared.value[key]
                row = table[np.searchsorted(table[:, 0], at[some], side="right") - 1]
                out[some] = row[:, 2] + (at[some] - row[:, 0]) // row[:, 1]
            return pd.Series(out)

        placed = sized.select("pack_id", pack_no("pack_id", "length", "rank").alias("pack_no"), "doc_id", "piece", "length")
        return placed.unionByName(every.filter("length = 0").select("pack_id", F.lit(1).cast("long").alias("pack_no"), "doc_id", "piece", "length"))

    def fill(self) -> DataFrame:
        """Packs, tokens, share of room used and the lower bound on the number of packs, by capacity."""
        made = self.plan.select("pack_id", "first_pack", "made", "lower_bound").distinct().groupBy("pack_id").agg(F.sum("made").alias("packs"), F.max("lower_bound").alias("lower_bound"))
        tokens = _each(self.declared, self.lengths, "texts").groupBy("pack_id", "capacity_tokens").agg(F.sum(F.col("tokens") * F.col("texts")).alias("tokens"))
        return tokens.join(made, "pack_id").withColumn("used", F.col("tokens") / (F.col("packs") * F.col("capacity_tokens")))

    def checks(self) -> DataFrame:
        """What holds of a packing, by capacity: texts placed, packs over capacity, texts split without need, tokens lost, and whether no more than one pack in a hundred is beyond the lower bound."""
        packs = self.packs()
        loads = packs.groupBy("pack_id", "pack_no").agg(F.sum("length").alias("load"))
        capacity = F.coalesce(*[F.when(F.col("pack_id") == p, F.lit(c)) for p, c in self.declared])
        over = loads.groupBy("pack_id").agg(F.count_if(F.col("load") > capacity).alias("over_capacity"))
        texts = packs.groupBy("pack_id", "doc_id").agg(F.count("*").alias("n"), F.sum("length").alias("placed")).join(self.counts, "doc_id", "full")
        told = texts.groupBy("pack_id").agg(F.count("n").alias("documents"), F.count_if((F.col("n") > 1) & (F.col("tokens") <= capacity)).alias("split_needlessly"), F.sum(F.abs(F.col("tokens") - F.coalesce("placed", F.lit(0)))).alias("tokens_lost"))
        near = self.fill().select("pack_id", (F.col("packs") * 100 <= F.col("lower_bound") * 101 + 100).alias("near_bound"))
        return told.join(over, "pack_id").join(near, "pack_id").select("pack_id", "documents", "over_capacity", "split_needlessly", "tokens_lost", "near_bound")
