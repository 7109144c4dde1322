"""Observations of one request linked by identifiers that both ends recorded.

``joins`` has one row for each declared hop or crossing and signal: ``place``
(what it is called), ``keys`` (the identifiers that make its value, all needed),
``up_point``, ``up_side``, ``down_point``, ``down_side``. A value seen once on
each side links; one seen more often on either side collides and links nothing;
one seen on one side only is unlinked. Observations without the value are outside.

Values are counted where the rows are; the observations of a value are gathered
only up to ``most_members`` a side, beyond that a collision is told by its counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.digests import UNIT


def checked_distinct(observations: DataFrame, content: list[str]) -> DataFrame:
    """One row for each (source, seq); the same identity with different content is an error, the same content again is dropped."""
    told = F.struct(*[F.to_json(c) if dict(observations.dtypes)[c].startswith("map") else F.col(c) for c in content])
    first = observations.groupBy("source", "seq").agg(F.min(told).alias("_low"), F.max(told).alias("_high"), *[F.first(c).alias(c) for c in content], F.count("*").alias("deliveries"))
    ok = F.col("_low").eqNullSafe(F.col("_high"))
    return first.withColumn("deliveries", F.when(ok, F.col("deliveries")).otherwise(F.raise_error(F.concat(F.lit("delivered with different content: "), "source", F.lit("/"), F.col("seq").cast("string"))).cast("long"))).drop("_low", "_high")


def values(observations: DataFrame, joins: DataFrame) -> DataFrame:
    """place, key, value, is_up, source, seq for each join that an observation takes part in."""
    own = F.transform("keys", lambda k: F.col("o_keys")[k])
    o = observations.select("source", "seq", "point", "side", F.col("keys").alias("o_keys"))
    ends = joins.select("place", "keys", F.explode(F.array(F.struct(F.lit(True).alias("is_up"), F.col("up_point").alias("point"), F.col("up_side").alias("side")), F.struct(F.lit(False).alias("is_up"), F.col("down_point").alias("point"), F.col("down_side").alias("side")))).alias("e")).select("place", "keys", "e.*")
    met = o.join(ends, ["point", "side"])  # declared rows, which Spark broadcasts while they are few
    return met.filter(F.forall(own, lambda v: v.isNotNull())).select("place", F.array_join("keys", "+").alias("key"), F.array_join(own, UNIT).alias("value"), "is_up", "source", "seq")


def _kind():
    return F.when((F.col("n_up") > 1) | (F.col("n_down") > 1), "COLLIDED").when((F.col("n_up") == 1) & (F.col("n_down") == 1), "LINKED").otherwise("UNLINKED")


def told_apart(found: DataFrame) -> DataFrame:
    """place, key, value, kind, up, down; the ids are those of a value with one observation a side. No ids are gathered."""
    one = F.struct("source", "seq")
    counted = found.groupBy("place", "key", "value").agg(F.count_if("is_up").alias("n_up"), F.count_if(~F.col("is_up")).alias("n_down"), F.max(F.when(F.col("is_up"), one)).alias("up"), F.max(F.when(~F.col("is_up"), one)).alias("down"))
    return counted.select("place", "key", "value", _kind().alias("kind"), "up", "down")


def outcomes(found: DataFrame, most_members: int = 1_000) -> DataFrame:
    """place, key, value, kind (LINKED, COLLIDED, UNLINKED), n_up, n_down, ups, downs; ids sorted, empty where there are too many."""
    counted = found.groupBy("place", "key", "value").agg(F.count_if("is_up").alias("n_up"), F.count_if(~F.col("is_up")).alias("n_down"))
    few = found.join(counted.filter((F.col("n_up") > most_members) | (F.col("n_down") > most_members)).select("place", "key", "value"), ["place", "key", "value"], "left_anti")
    one = F.struct("source", "seq")
    ids = few.groupBy("place", "key", "value").agg(F.sort_array(F.collect_list(F.when(F.col("is_up"), one))).alias("ups"), F.sort_array(F.collect_list(F.when(~F.col("is_up"), one))).alias("downs"))
    return counted.join(ids, ["place", "key", "value"], "left").withColumn("kind", _kind())


def links(told: DataFrame) -> DataFrame:
    """The pairs of ``told_apart``."""
    return told.filter("kind = 'LINKED'").select("place", "key", "value", F.col("up.source").alias("up_source"), F.col("up.seq").alias("up_seq"), F.col("down.source").alias("down_source"), F.col("down.seq").alias("down_seq"))


def unlinked(told: DataFrame) -> DataFrame:
    """The observations of ``told_apart`` whose value nothing else has."""
    return told.filter("kind = 'UNLINKED'").withColumn("o", F.coalesce("up", "down")).select("place", "key", "value", "o.source", "o.seq")


def combined(first: DataFrame, second: DataFrame) -> DataFrame:
    """What two signals say together of the pairs of a place: CORROBORATED, SIGNAL_OTHER_PARTNER, SIGNAL_UNMATCHED, SIGNAL_ABSENT, COLLIDED or UNLINKED.

    ``first`` and ``second`` are ``values`` of the two signals. One row for each observation that either signal knows.
    """
    told = []
    for n, found in ((1, first), (2, second)):
        each = found.join(told_apart(found), ["place", "key", "value"])
        told.append(each.select("place", F.struct("source", "seq").alias("o"), F.col("kind").alias(f"kind{n}"), F.when(F.col("kind") == "LINKED", F.when(F.col("is_up"), F.col("down")).otherwise(F.col("up"))).alias(f"partner{n}")))
    both = told[0].join(told[1], ["place", "o"], "full")
    has = both.select("place", F.col("o").alias("p"), F.col("kind1").isNotNull().alias("p1"), F.col("kind2").isNotNull().alias("p2"))
    linked = F.coalesce("partner1", "partner2").alias("p")
    both = both.withColumn("p", linked).join(has, ["place", "p"], "left")
    l1, l2 = F.coalesce(F.col("kind1") == "LINKED", F.lit(False)), F.coalesce(F.col("kind2") == "LINKED", F.lit(False))
    verdict = (
        F.when(F.coalesce(F.col("kind1") == "COLLIDED", F.lit(False)) | F.coalesce(F.col("kind2") == "COLLIDED", F.lit(False)), "COLLIDED")
        .when(l1 & l2, F.when(F.col("partner1") == F.col("partner2"), "CORROBORATED").otherwise("SIGNAL_OTHER_PARTNER"))
        .when(l1, F.when(F.col("kind2").isNotNull() & F.col("p2"), "SIGNAL_UNMATCHED").otherwise("SIGNAL_ABSENT"))
        .when(l2, F.when(F.col("kind1").isNotNull() & F.col("p1"), "SIGNAL_UNMATCHED").otherwise("SIGNAL_ABSENT"))
        .otherwise("UNLINKED")
    )
    return both.select("place", F.col("o.source").alias("source"), F.col("o.seq").alias("seq"), verdict.alias("verdict"), F.col("p.source").alias("partner_source"), F.col("p.seq").alias("partner_seq"))
