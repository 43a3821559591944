"""Exact positions in a distributed order, with no task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets into which each group is dealt by hash; one window task sees one bucket of one group.
BUCKETS = 16_384


def prefix_offsets(df: DataFrame, group: str, weight: Column, ties: list[Column], seed: int, out: str, strata: Column | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Add ``out``: the sum of ``weight`` over the rows of the same group that come before, in a seeded pseudo-random order.

    A group's rows go to ``buckets`` buckets by a hash of ``ties``; bucket totals are summed per group (at most ``buckets`` rows a
    stratum in a task), and a window inside (group, bucket) adds the rest, so a group that holds a third of all rows is still split.
    ``strata`` (a small number) orders before the hash: rows of a lower stratum come first. Rows equal in all ``ties`` are interchangeable. Null groups form one group.
    """
    h = F.xxhash64(F.lit(seed), *ties)
    t = df.withColumn("__w", weight.cast("long")).withColumn("__h", h).withColumn("__b", F.coalesce(strata if strata is not None else F.lit(0), F.lit(0)).cast("long") * buckets + F.pmod("__h", F.lit(buckets)))
    sums = t.groupBy(F.col(group).alias("__g"), F.col("__b").alias("__gb")).agg(F.sum("__w").alias("__bw"))
    before = Window.partitionBy("__g").orderBy("__gb").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("__start", F.coalesce(F.sum("__bw").over(before), F.lit(0))).drop("__bw")
    inner = Window.partitionBy(group, "__b").orderBy("__h", *ties).rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("__in", F.coalesce(F.sum("__w").over(inner), F.lit(0)))
    j = t.join(sums, t[group].eqNullSafe(sums["__g"]) & (t["__b"] == sums["__gb"]))
    return j.withColumn(out, F.col("__start") + F.col("__in")).drop("__w", "__h", "__b", "__g", "__gb", "__start", "__in")
