"""Ranks in groups of any size, by one distributed sort and counts per partition."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.session import cut, partitions


def ranked(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """The rows with ``rank`` from 0 in each group, in ``order`` (nulls first).

    A group may reach over any number of partitions of the sort; only one count for each group and partition is
    brought together. Null group values are a group.
    """
    keys = [*group, *order]
    placed = df.repartitionByRange(partitions(df.sparkSession), *keys).sortWithinPartitions(*keys)
    placed = cut(placed.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    held = placed.groupBy(*group, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_low"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select(*[F.col(g).alias(f"_g_{g}") for g in group], F.col("_part").alias("_p"), "_low", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    same = F.col("_part") == F.col("_p")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    return placed.join(held, same).withColumn("rank", F.col("_at") - F.col("_low") + F.col("_before")).select(*df.columns, "rank")
