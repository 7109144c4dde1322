"""What a run's logs tell: joins by ordinal, by rank and by rank windows, scores against the truth, delays and freezes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.digests import digest
from tallyloom.operators.matching import take
from tallyloom.operators.ranking import ranked
from tallyloom.operators.runs import order_statistics


def no_trace(trace: Column) -> Column:
    """Missing, or all zeros."""
    return trace.isNull() | trace.rlike("^0*$")


def ordinal_join(left: DataFrame, right: DataFrame, keys: list[str], truth: str) -> DataFrame:
    """One-to-one join on ``keys`` that are unique on both sides: expected and got ``truth`` of every left row. Keys that repeat are left out and told as ambiguous."""
    sides = [s.groupBy(*keys).agg(F.min(truth).alias("t"), F.count("*").alias("n")) for s in (left, right)]
    a = sides[0].select(*keys, F.col("t").alias("expected"), F.col("n").alias("n_left"))
    b = sides[1].select(*keys, F.col("t").alias("got"), F.col("n").alias("n_right"))
    out = a.join(b, keys, "left")
    state = F.when((F.col("n_left") > 1) | (F.coalesce("n_right", F.lit(0)) > 1), "ambiguous").when(F.col("n_right").isNull(), "missing").when(F.col("expected") == F.col("got"), "correct").otherwise("wrong")
    return out.withColumn("outcome", state)


def shuffled(df: DataFrame, column: str, order: list[str], seed: int) -> DataFrame:
    """The rows with ``column`` taken from another row: a permutation that depends on the seed only. A control that should match next to nothing."""
    own = ranked(df.withColumn("_one", F.lit(0)), ["_one"], order)
    other = ranked(df.select(F.col(column).alias("_moved"), digest(F.lit(str(seed)), *[F.col(c) for c in order]).alias("_r")).withColumn("_one", F.lit(0)), ["_one"], ["_r", "_moved"])
    return own.join(other.select("_moved", "rank"), "rank").withColumn(column, F.col("_moved")).select(*df.columns)


def rank_buckets(df: DataFrame, order: list[str], size: int, by: list[str] = ()) -> DataFrame:
    """The rows with ``bucket``: every ``size`` rows in ``order``."""
    group = list(by) or ["_one"]
    own = df if by else df.withColumn("_one", F.lit(0))
    return ranked(own, group, order).withColumn("bucket", F.floor(F.col("rank") / size)).select(*df.columns, "rank", "bucket")


def bucket_match(left: DataFrame, right: DataFrame, measure: str, most: Column, keep: list[str] = ()) -> DataFrame:
    """Greedy pairs within equal buckets whose measures differ least, within ``most`` of the left one. Both have id, bucket, measure."""
    pairs = left.alias("l").join(right.alias("r"), F.col("l.bucket") == F.col("r.bucket"))
    return _nearest_pairs(pairs, measure, most)


def window_match(left: DataFrame, right: DataFrame, measure: str, most: Column, reach: int, by: list[str] = ()) -> DataFrame:
    """Greedy pairs among left rows and the right rows of the same ``by`` up to ``reach`` ranks away, joined by buckets of ranks."""
    width = 2 * reach + 1
    low = F.floor((F.col("rank") - reach) / width)
    l = left.withColumn("b", F.explode(F.array(low, low + 1))).alias("l")  # noqa: E741
    r = right.withColumn("b", F.floor(F.col("rank") / width)).alias("r")
    same = (F.col("l.b") == F.col("r.b")) & (F.abs(F.col("l.rank") - F.col("r.rank")) <= reach)
    for c in by:
        same = same & (F.col(f"l.{c}") == F.col(f"r.{c}"))
    pairs = l.join(r, same)
    return _nearest_pairs(pairs, measure, most)


def _nearest_pairs(pairs: DataFrame, measure: str, most: Column) -> DataFrame:
    off = F.abs(F.col(f"l.{measure}") - F.col(f"r.{measure}"))
    found = pairs.filter(off <= most).select(F.col("l.id").alias("left_id"), F.array("r.id").alias("right_ids"), (-off).alias("score"))
    return take(found).select("left_id", F.col("right_ids")[0].alias("right_id"), (-F.col("score")).alias("off"))


def link_score(links: DataFrame, truth: DataFrame) -> DataFrame:
    """By place: links, correct, wrong, lost. ``links``: place, up, down; ``truth``: place, up, down, one row for each expected link."""
    both = links.select("place", "up", F.col("down").alias("told")).join(truth.select("place", "up", F.col("down").alias("real")), ["place", "up"], "full")
    return both.groupBy("place").agg(F.count("told").alias("links"), F.count_if(F.col("told") == F.col("real")).alias("correct"), F.count_if(F.col("told").isNotNull() & ~F.col("told").eqNullSafe(F.col("real"))).alias("wrong"), F.count_if(F.col("told").isNull()).alias("lost"))


def id_consistency(expected: DataFrame, seen: DataFrame) -> DataFrame:
    """missing, duplicated and unknown ids (column id on both)."""
    counted = seen.filter("id is not null").groupBy("id").agg(F.count("*").alias("n"))
    both = expected.filter("id is not null").select("id").distinct().withColumn("known", F.lit(True)).join(counted, "id", "full")
    return both.agg(F.count_if(F.col("n").isNull()).alias("missing"), F.count_if((F.col("n") > 1) & F.col("known")).alias("duplicated"), F.count_if(F.col("known").isNull()).alias("unknown"))


def rate_of(df: DataFrame, by: list[str], hit: Column) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(hit).alias("hits")).withColumn("rate", F.col("hits") / F.col("n"))


def floor_index(df: DataFrame, by: list[str], value: str, quantiles: dict[str, str]) -> DataFrame:
    """Order statistics at index floor(p n), capped at the last, in groups of any size."""
    return order_statistics(df, by, value, {name: ("floor", p) for name, p in quantiles.items()})


def freezes(df: DataFrame, delay_us: Column, released_ns: Column, by: list[str], least_us: int = 20_000, least_n: int = 10) -> DataFrame:
    """Milliseconds in which at least ``least_n`` requests that had waited long were let go at once."""
    return df.filter(delay_us > least_us).groupBy(*by, F.floor(released_ns / 1_000_000).alias("ms")).agg(F.count("*").alias("n")).filter(F.col("n") >= least_n)


def generations(df: DataFrame, tuple_: list[str], order: list[str]) -> DataFrame:
    """The rows with ``generation``: how often the same tuple was used before."""
    return ranked(df, tuple_, order).withColumnRenamed("rank", "generation")


def paired_in_order(left: DataFrame, right: DataFrame, by: list[str], order: list[str], keep: list[str]) -> DataFrame:
    """Rows of both sides paired in time order within ``by``, where both have as many."""
    sides = [ranked(s.select(*by, *keep, *[o for o in order if o not in keep]), by, order) for s in (left, right)]
    counts = [s.groupBy(*by).agg(F.count("*").alias(f"n{i}")) for i, s in enumerate(sides)]
    equal = counts[0].join(counts[1], by).filter("n0 = n1").select(*by)
    a, b = (s.join(equal, by).select(*by, "rank", *[F.col(k).alias(f"{k}_{x}") for k in keep]) for s, x in zip(sides, ("left", "right")))
    return a.join(b, [*by, "rank"])
