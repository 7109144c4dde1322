"""Pairs each record with the record of another table that is nearest in time at the same entity.

Both tables are put under one another and sorted by entity and time; the last
right-side record before a left row and the next one after it are carried onto
that row, and the nearer within the tolerance is taken.

An entity may hold any share of all rows, so its time is cut into slices of
``slice_us`` and each slice is sorted by itself; right-side records within the
tolerance of a slice's edge are also given to the neighbour. Of right-side
records at the same entity and time only the least counts, so a slice holds at
most one for each point of time. Slices with more than ``most`` left rows are
divided once more by salt, with the right side given to each part.

Defined results: rows without entity or time are paired with none; equal
distance goes to the earlier record, then the lesser order columns; several
left rows may share a right-side record; rows repeated exactly are paired each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def once(df: DataFrame, entity: Column, time: Column, keys: list[str]) -> DataFrame:
    """One row for each message (keys), with its entity and time; of copies that tell different ones, the least that is complete."""
    told = df.select(*keys, F.when(time.isNotNull(), F.struct(time.cast("long").alias("t"), entity.alias("e"))).alias("m")).filter("m.e is not null")
    for k in keys:
        told = told.filter(F.col(k).isNotNull())
    return told.groupBy(*keys).agg(F.min("m").alias("m")).select(*keys, F.col("m.e").alias("entity"), F.col("m.t").alias("time"))


def nearest(left: DataFrame, right: DataFrame, keys: list[str], tolerance: int, slice_us: int | None = None, most: int = 200_000) -> DataFrame:
    """``left`` and ``right`` have entity, time and ``keys``; returns l_<key>, r_<key> and distance for the left rows that have a partner."""
    width = max(slice_us or 0, 64 * tolerance, 1)
    at = lambda shift: F.floor((F.col("time") + F.lit(shift)) / F.lit(width))
    left, right = (s.select("entity", F.col("time").cast("long").alias("time"), *keys) for s in (left, right))
    right = right.filter("entity is not null and time is not null").groupBy("entity", "time").agg(F.min(F.struct(*keys)).alias("r"))
    right = right.withColumn("slice", F.explode(F.array_distinct(F.array(at(-tolerance), at(0), at(tolerance)))))
    left = left.filter("entity is not null and time is not null").withColumn("slice", at(0))
    crowded = left.groupBy("entity", "slice").count().filter(F.col("count") > most).withColumn("salts", F.ceil(F.col("count") / most).cast("int")).drop("count")
    left = left.join(crowded, ["entity", "slice"], "left").withColumn("salt", F.when(F.col("salts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*keys), F.col("salts")).cast("int")))
    right = right.join(crowded, ["entity", "slice"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)))
    union = left.select("entity", "slice", "salt", "time", F.struct(*keys).alias("l"), F.lit(None).alias("r")).unionByName(
        right.select("entity", "slice", "salt", "time", F.lit(None).alias("l"), F.struct("time", "r").alias("r")), allowMissingColumns=True
    )
    side = F.col("r").isNull()  # at equal times the right-side record comes first
    part = Window.partitionBy("entity", "slice", "salt")
    carried = union.withColumn("last", F.last("r", ignorenulls=True).over(part.orderBy("time", side).rowsBetween(Window.unboundedPreceding, 0)))
    carried = carried.withColumn("next", F.last("r", ignorenulls=True).over(part.orderBy(F.desc("time"), side).rowsBetween(Window.unboundedPreceding, 0)))
    near = carried.filter("l is not null").withColumn("d_last", F.col("time") - F.col("last.time")).withColumn("d_next", F.col("next.time") - F.col("time"))
    pick = F.when(F.col("d_next").isNull() | (F.col("d_last") <= F.col("d_next")), F.struct(F.col("d_last").alias("d"), F.col("last.r").alias("r"))).otherwise(F.struct(F.col("d_next").alias("d"), F.col("next.r").alias("r")))
    return near.withColumn("pick", pick).filter(F.col("pick.d") <= tolerance).select(*[F.col(f"l.{k}").alias(f"l_{k}") for k in keys], *[F.col(f"pick.r.{k}").alias(f"r_{k}") for k in keys], F.col("pick.d").alias("distance"))
