"""Rank fusion and score scaling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 60


def rrf(semantic: DataFrame, lexical: DataFrame, key: str = "id", k: int = K, top_n: int | None = None) -> DataFrame:
    """(key, rrf_score, sem_rank, lex_rank, rank) and the lists' other columns, of two lists (key, rank from 1, ...).

    Rows with a null key don't count. Order: score, then rank in the first list (absent last), then in the second, then key. Scores are rounded after sorting.
    """
    s = semantic.where(F.col(key).isNotNull()).withColumnRenamed("rank", "sem_rank")
    x = lexical.where(F.col(key).isNotNull()).withColumnRenamed("rank", "lex_rank")
    part = lambda c: F.coalesce(1.0 / (F.lit(float(k)) + F.col(c)), F.lit(0.0))
    t = s.join(x, key, "full_outer").withColumn("rrf_score", part("sem_rank") + part("lex_rank"))
    order = [F.desc("rrf_score"), F.asc_nulls_last("sem_rank"), F.asc_nulls_last("lex_rank"), key]
    t = t.orderBy(*order).limit(top_n) if top_n else t
    return t.withColumn("rank", F.row_number().over(Window.orderBy(*order))).withColumn("rrf_score", F.round("rrf_score", 6))


def min_max(df: DataFrame, score: str) -> DataFrame:
    """``df`` with score_norm in 0 to 1; a flat list is all 1 if its value is positive, else all 0."""
    ends = df.agg(F.min(score).alias("__lo"), F.max(score).alias("__hi"))
    t = df.crossJoin(F.broadcast(ends))  # one row
    span = F.col("__hi") - F.col("__lo")
    flat = F.when(F.col("__hi") > 0, 1.0).otherwise(0.0)
    return t.withColumn(f"{score}_norm", F.when(span < 1e-9, flat).otherwise((F.col(score) - F.col("__lo")) / span)).drop("__lo", "__hi")


def display_score(score: Column) -> Column:
    """A score relative to the greatest of the (few) result rows; a greatest of zero counts as one."""
    return score / F.coalesce(F.nullif(F.max(score).over(Window.partitionBy()), F.lit(0.0)), F.lit(1.0))
