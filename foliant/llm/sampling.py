"""Held-out folds and bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.scale import sized, stash

#: Rows whose crc32(doc_id as text) mod FOLDS is this one are never learned from.
FOLDS, HELD_OUT = 4, 2


def held_out(doc_id: Column) -> Column:
    """True for held-out rows; rows without an id are not held out, and never learned from either."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % FOLDS == HELD_OUT, F.lit(False))


def bounded_sample(labelled: DataFrame, label: str, per_class: int) -> DataFrame:
    """Rows (doc_id, label) of which about ``per_class`` of each class stay, chosen by a hash of doc_id; the class counts are one small stored table."""
    sizes = labelled.groupBy(label).agg(F.count(F.lit(1)).alias("__n")).withColumnRenamed(label, "__l")
    j = labelled.join(sized(stash(sizes)), labelled[label] == F.col("__l"))
    share = F.lit(float(per_class)) / F.col("__n")
    return j.where(F.pmod(F.xxhash64(F.lit(77), "doc_id"), F.lit(1_000_000)) < share * 1_000_000).drop("__n", "__l")
