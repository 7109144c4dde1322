"""Differences between two copies of the same records.

Both sides are normalised and counted by one aggregation: how often each row,
equal in all compared columns, is on either side. Rows more often on the left
are EXCEPT ALL of left and right, those more often on the right the other way
round. These two residues are joined by key in full: the i-th row of a key's
left residue meets the i-th of its right one, in the order of the fields. A
residue row that meets none is told as copies if the other side has the same
row in another number, else it is compared with the least row that the other
side has of its key, or told as one-sided if that side hasn't the key.

So a key's result grows with the number of its rows, not with that of its
pairs, and keys of any size are ranked by a distributed sort.

Defined results: null equals null and differs from every value; fields named in
``blank_as_null`` take '' as null; rows with a null key can't be compared and
are left out; repeated rows differ in number only, which is told as 'copies'.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.ranking import ranked


def _normalised(df: DataFrame, key: str, fields: list[str], blank_as_null: list[str]) -> DataFrame:
    values = [F.when(F.col(f) != "", F.col(f)).alias(f"f{i}") if f in blank_as_null else F.col(f).alias(f"f{i}") for i, f in enumerate(fields)]
    return df.filter(F.col(key).isNotNull()).select(F.col(key).alias("k"), *values)


def residues(left: DataFrame, right: DataFrame, key: str, fields: list[str], blank_as_null: list[str] = ()) -> DataFrame:
    """k, v (the fields' values), n_left, n_right of all rows whose numbers differ, and the least row of the key on each side (null: it hasn't the key)."""
    sides = [_normalised(df, key, fields, list(blank_as_null)).withColumn("_l", F.lit(n)) for df, n in ((left, 1), (right, 0))]
    names = [f"f{i}" for i in range(len(fields))]
    rows = sides[0].unionByName(sides[1]).groupBy("k", *names).agg(F.sum("_l").alias("n_left"), F.sum(1 - F.col("_l")).alias("n_right"))
    rows = rows.select("k", F.struct(*names).alias("v"), "n_left", "n_right")
    own = [F.min(F.when(F.col(f"n_{s}") > 0, F.col("v"))).alias(f"least_{s}") for s in ("left", "right")]
    odd = F.col("n_left") != F.col("n_right")
    keys = rows.groupBy("k").agg(*own, F.bool_or(odd).alias("_odd")).filter("_odd").drop("_odd")
    return rows.filter(odd).join(keys, "k")


def differences(left: DataFrame, right: DataFrame, key: str, fields: list[str], blank_as_null: list[str] = ()) -> DataFrame:
    """(key, field, left_value, right_value): a field that differs, 'missing_left' or 'missing_right' for a key absent there, or 'copies'."""
    rest = ranked(residues(left, right, key, fields, blank_as_null).withColumn("is_left", F.col("n_left") > F.col("n_right")), ["k", "is_left"], ["v"])
    sides = [rest.filter(F.col("is_left") == own).select("k", "rank", *[F.col(c).alias(f"{c}_{s}") for c in ("v", "n_left", "n_right", "least_left", "least_right")]) for s, own in (("a", True), ("b", False))]
    pairs = sides[0].join(sides[1], ["k", "rank"], "full")
    both = F.col("v_a").isNotNull() & F.col("v_b").isNotNull()
    n_left, n_right = F.coalesce("n_left_a", "n_left_b"), F.coalesce("n_right_a", "n_right_b")
    l_row = F.when(F.col("v_a").isNotNull(), F.col("v_a")).otherwise(F.col("least_left_b"))
    r_row = F.when(F.col("v_b").isNotNull(), F.col("v_b")).otherwise(F.col("least_right_a"))
    pairs = pairs.select("k", both.alias("both"), n_left.alias("n_left"), n_right.alias("n_right"), l_row.alias("l"), r_row.alias("r"))
    nothing = F.lit(None).cast("string")

    def case(name: str, left_value=nothing, right_value=nothing):
        return F.struct(F.lit(name).alias("field"), left_value.alias("left_value"), right_value.alias("right_value"))

    told = [F.when(~F.col(f"l.f{i}").eqNullSafe(F.col(f"r.f{i}")), case(f, F.col(f"l.f{i}").cast("string"), F.col(f"r.f{i}").cast("string"))) for i, f in enumerate(fields)]
    out = (
        F.when(F.col("l").isNull(), F.array(case("missing_left")))
        .when(F.col("r").isNull(), F.array(case("missing_right")))
        .when(~F.col("both") & (F.col("n_left") > 0) & (F.col("n_right") > 0), F.array(case("copies", F.col("n_left").cast("string"), F.col("n_right").cast("string"))))
        .otherwise(F.filter(F.array(*told), lambda x: x.isNotNull()))
    )
    return pairs.select("k", F.explode(out).alias("d")).select(F.col("k").alias(key), "d.field", "d.left_value", "d.right_value")
