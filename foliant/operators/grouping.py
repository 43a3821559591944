"""Grouping of result rows (file_path, similarity, file_tags, rank, ...)."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.paths import under
from foliant.scale import sized

UNTAGGED, ELSEWHERE = "未标记", "其他"


class GroupMode(Enum):
    FLAT = "flat"
    BY_FILE = "file"
    BY_TAG = "tag"
    BY_SOURCE = "source"


def distinct_rows(rows: DataFrame) -> DataFrame:
    return rows.dropDuplicates(["file_path", "start_line", "end_line"])


def best_per_group(rows: DataFrame, group: str, score: str, key: str) -> DataFrame:
    """(group, key, score) of each group's greatest score, least key on ties; partial aggregation, no sort of a group."""
    return rows.groupBy(group).agg(F.min(F.struct((-F.col(score)).alias("s"), F.col(key).alias("k"))).alias("b")).select(group, F.col("b.k").alias(key), (-F.col("b.s")).alias(score))


def by_file(rows: DataFrame) -> DataFrame:
    return rows.groupBy("file_path").agg(F.min("rank").alias("first_rank"), F.count(F.lit(1)).alias("n_hits"), F.max("similarity").alias("best_similarity")).orderBy("first_rank")


def by_tag(rows: DataFrame) -> DataFrame:
    tags = F.when(F.size(F.coalesce("file_tags", F.array().cast("array<string>"))) > 0, F.col("file_tags")).otherwise(F.array(F.lit(UNTAGGED)))
    return rows.select("*", F.explode(tags).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n_hits"), F.min("rank").alias("first_rank")).orderBy(F.col("tag") == UNTAGGED, "tag")


def source_of(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """``rows`` with the first source (by ord) whose folder holds the file, null if none; sources are the user's few folders."""
    s = sized(sources.select(F.col("source").alias("__s"), F.col("ord").alias("__o")))
    hit = rows.join(s, under(F.col("file_path"), F.col("__s")), "left")
    first = F.row_number().over(Window.partitionBy("file_path", "rank").orderBy(F.asc_nulls_last("__o")))
    return hit.withColumn("__n", first).where("__n = 1").withColumnRenamed("__s", "source_root").drop("__n")


def by_source(rows: DataFrame, sources: DataFrame) -> DataFrame:
    t = source_of(rows, sources)
    return t.groupBy(F.coalesce("source_root", F.lit(ELSEWHERE)).alias("source")).agg(F.count(F.lit(1)).alias("n_hits"), F.min(F.coalesce("__o", F.lit(1 << 30))).alias("ord")).orderBy("ord").drop("ord")


def group_results(rows: DataFrame, mode: GroupMode, sources: DataFrame | None = None) -> DataFrame:
    if mode is GroupMode.BY_FILE:
        return by_file(rows)
    if mode is GroupMode.BY_TAG:
        return by_tag(rows)
    if mode is GroupMode.BY_SOURCE:
        return by_source(rows, sources)
    return rows.orderBy("rank")


def per_file_cap(rows: DataFrame, cap: int = 5) -> DataFrame:
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy("file_path").orderBy("rank"))).where(F.col("nth") <= cap)
