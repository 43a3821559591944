"""From raw documents to shards: five stages, each over all rows that the one before has kept.

A stage's result is written before the next stage begins, so each stage first deletes the temporary tables of the one whose
result it reads. Nulls, repeated rows, empty tables and further columns are treated as the operators' docstrings say: all columns
of the input pass through, and names that begin with two underscores are the operators' own.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession

from foliant.llm import op1_sharding, op3_mixing, op4_quality, op6_jaccard, op9_decontamination
from foliant.scale import made, read_table, release, stash

#: Near duplicates: five-word shingles, similarity 0.8 or more.
SHINGLE, PERCENT = 5, 80

#: Temporary tables by the mark that a stage leaves on its result's first column; Parquet keeps such marks.
_temporary: dict[str, list[str]] = {}
_MARK = "foliant.scratch"


def tidy(stage):
    """Delete the temporary tables of the stage that wrote ``docs``, unless ``docs`` still reads them; mark the result with its own."""

    @functools.wraps(stage)
    def wrapped(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        mark = docs.schema.fields[0].metadata.get(_MARK)
        old = _temporary.get(mark, [])
        if old and not any(p.rsplit("/", 1)[-1] in f for p in old for f in docs.inputFiles()):
            release(spark, _temporary.pop(mark))
        before = set(made())
        out = stage(spark, docs, sf_dir)
        mark = uuid.uuid4().hex
        _temporary[mark] = [p for p in made() if p not in before]
        return out.withMetadata(out.columns[0], {_MARK: mark})

    return wrapped


@tidy
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are not depleted; lines that too many of their host's documents hold are cut."""
    return op4_quality.accepted(docs)


@tidy
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the least id) of each group that similarity links hold together."""
    return op6_jaccard.representatives(docs, SHINGLE, PERCENT)


@tidy
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs."""
    return op9_decontamination.decontaminated(docs, read_table(spark, sf_dir, "benchmark"))


@tidy
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the proportions of the target weights, as often as their blocks are drawn, up to three times each."""
    return op3_mixing.mixed(docs)


@tidy
def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with shard and slot, in Hilbert order of source, language and size."""
    return op1_sharding.hilbert_shards(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: Hilbert order, drawn blocks and cross-document verdicts aren't expressible in SQL; tests/llm compares with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Results between stages are stashes too: they go at the end of a ``scratch`` block or the program."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
