"""Rollups over the index tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions.paths import under
from foliant.operators.tags import tag_counts
from foliant.scale import sized


def files_per_source(files: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, n_files) of enabled sources, whole path segments compared; sources are the user's few folders."""
    s = sources.where("enabled") if "enabled" in sources.columns else sources
    hit = files.select("file_path").join(sized(s.select("source")), under(F.col("file_path"), F.col("source"))).groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return s.select("source").distinct().join(hit, "source", "left").select("source", F.coalesce("n", F.lit(0)).alias("n_files"))


def overview(files: DataFrame, chunks: DataFrame, file_tags: DataFrame, starred: DataFrame) -> DataFrame:
    """One row of counts."""
    a = files.agg(F.count(F.lit(1)).alias("indexed_files"))
    b = chunks.agg(F.count(F.lit(1)).alias("total_chunks"), F.sum(F.length("content")).alias("total_chars"))
    c = file_tags.agg(F.count_distinct("tag").alias("n_tags"))
    d = starred.agg(F.count(F.lit(1)).alias("starred_count"))
    return a.crossJoin(b).crossJoin(c).crossJoin(d)  # one row each


def rollup(files: DataFrame, chunks: DataFrame, file_tags: DataFrame, starred: DataFrame, postings: DataFrame, clusters: DataFrame) -> DataFrame:
    """``overview`` with lexical_chunks, tag_distribution (tag, n_files) and cluster_distribution (label, n_files), largest first."""
    lexical = postings.select("id").distinct().agg(F.count(F.lit(1)).alias("lexical_chunks"))
    pack = lambda t, k, out: t.agg(F.array_sort(F.collect_list(F.struct((-F.col("n_files")).alias("n"), F.col(k).alias("k")))).alias("s")).select(F.transform("s", lambda x: F.struct(x["k"].alias(k), (-x["n"]).alias("n_files"))).alias(out))
    sizes = clusters.select("label", F.size("files").cast("long").alias("n_files"))
    return overview(files, chunks, file_tags, starred).crossJoin(lexical).crossJoin(pack(tag_counts(file_tags), "tag", "tag_distribution")).crossJoin(pack(sizes, "label", "cluster_distribution"))  # one row each


def top_tags(file_tags: DataFrame, n: int = 15) -> DataFrame:
    return tag_counts(file_tags).orderBy(F.desc("n_files"), "tag").limit(n)


def recent_updates(files: DataFrame, n: int = 10, time: str = "modified_time") -> DataFrame:
    return files.orderBy(F.desc(time), "file_path").limit(n)


def starred_first(files: DataFrame, starred: DataFrame) -> DataFrame:
    t = files.join(starred.select("file_path", F.lit(True).alias("starred")), "file_path", "left").withColumn("starred", F.coalesce("starred", F.lit(False)))
    return t.orderBy(F.desc("starred"), F.lower("file_name"), "file_path")


def exact_duplicates(files: DataFrame) -> DataFrame:
    """(md5_hash, n_files, first_path) of contents that several files share; counts only, so a hot hash stays one row."""
    return files.groupBy("md5_hash").agg(F.count(F.lit(1)).alias("n_files"), F.min("file_path").alias("first_path")).where("n_files > 1")
