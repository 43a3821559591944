"""Line dedup by a log-template tree of fixed depth.

A line goes down the tree by its token count, then by its leading tokens (tokens with a digit are variable). In a leaf that
enough documents reach, tokens that are frequent at their position stay and all others become variable; the outcome is the
line's template. Lines are dropped if enough of their tokens are fixed and enough documents hold the template. Copies and near
copies of one text count as one document there. DataFrame expressions only; tokens are exploded for the distinct lines of busy
leaves alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions.text import let
from foliant.llm.folding import near_copy_classes, with_plain_spaces
from foliant.scale import read_table, sized, stash

#: Leading tokens on the path to a leaf.
LEADING = 2
#: Texts that make a leaf busy and a token fixed, documents that make a template recurrent, whatever the table's size.
MIN_DOCS = 10
#: Least share of fixed tokens of a line that may be dropped.
SIMILARITY = 0.6
ANY = "<*>"


def spaced(line: Column) -> Column:
    """The line's tokens, single-spaced; most lines are so already, and are only searched for what would not be."""
    odd = line.startswith(" ") | line.endswith(" ") | line.contains("  ")
    for c in "\t\x0b\x0c\r":
        odd = odd | line.contains(c)
    return F.when(odd, F.trim(F.regexp_replace(line, r"[\x20\x09-\x0D]+", " "))).otherwise(line)


def variable(flat: Column) -> Column:
    """A single-spaced line with its tokens that have a digit made variable."""
    return F.when(flat.rlike("[0-9]"), F.regexp_replace(flat, r"(?<![^ ])[^ 0-9]*+[0-9][^ ]*+", ANY)).otherwise(flat)


def masked(line: Column) -> Column:
    return variable(spaced(line))


def line_leaves(text: Column) -> Column:
    """Array of (n, leaf, line), null for a line without a token; a line of one token has only that on its path."""

    def of(x: Column) -> Column:
        def leaf(tokens: Column) -> Column:
            n = F.size(tokens)
            path = F.concat_ws(" ", *[F.get(tokens, F.lit(i)) for i in range(LEADING)])
            return F.when(n > 0, F.struct(n.alias("n"), F.xxhash64(n, variable(path)).alias("leaf"), x.alias("line")))

        return let(F.array_remove(F.split(x, " "), ""), leaf)

    return F.transform(F.split(with_plain_spaces(text, "\t\x0b\x0c\r"), "\n"), of)


def lines_with_tokens(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: F.ltrim(x, F.lit("\t\x0b\x0c\r ")) != "")


def text_hash(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    return F.xxhash64(t, F.octet_length(t))


def recurrent_lines(df: DataFrame, min_docs: int = MIN_DOCS, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(lines, held): ``lines`` (h, template, n_docs) to drop, ``held`` (h, text_hash) of lines in busy leaves."""
    t = df.select(text_hash(F.col("text")).alias("text_hash"), line_leaves(F.coalesce("text", F.lit(""))).alias("keys"))
    # explode_outer: for explode the optimiser would add a filter that computes the keys once more.
    leaves = t.select("text_hash", F.explode_outer(F.array_distinct(F.transform("keys", lambda x: x["leaf"]))).alias("leaf")).where("leaf is not null")
    # Copies of a text meet in (leaf, text_hash) before texts are counted.
    busy = leaves.distinct().groupBy("leaf").agg(F.count(F.lit(1)).alias("leaf_docs")).where(F.col("leaf_docs") >= min_docs).select("leaf")
    busy = sized(stash(busy))
    each = t.select("text_hash", F.explode_outer("keys").alias("x")).where("x is not null").select("text_hash", "x.leaf", "x.n", "x.line")
    each = each.join(busy, "leaf").withColumn("line", masked(F.col("line"))).withColumn("h", F.xxhash64("line"))
    held = stash(each.groupBy("h", "text_hash").agg(F.first("leaf").alias("leaf"), F.first("n").alias("n"), F.first("line").alias("line")))
    lines = stash(held.groupBy("h").agg(F.first("leaf").alias("leaf"), F.first("n").alias("n"), F.first("line").alias("line"), F.count(F.lit(1)).alias("docs")))
    tokens = lines.select("h", "leaf", "n", "docs", F.posexplode(F.split("line", " ")).alias("pos", "token")).where(F.col("token") != ANY)
    fixed = tokens.groupBy("leaf", "pos", "token").agg(F.sum("docs").alias("token_docs")).where(F.col("token_docs") >= min_docs).select("leaf", "pos", "token")
    kept = tokens.join(sized(stash(fixed)), ["leaf", "pos", "token"], "left_semi").groupBy("h", "leaf", "n").agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("tokens"))
    kept = kept.where(F.size("tokens") >= similarity * F.col("n")).select("h", F.xxhash64("leaf", "tokens").alias("template"))
    kept = sized(stash(kept))
    # Templates that enough texts hold; only these texts are read again, for their classes.
    holders = stash(held.select("h", "text_hash").join(kept, "h").select("template", "text_hash").distinct())
    often = sized(stash(holders.groupBy("template").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs).select("template")))
    holders = holders.join(often, "template", "left_semi")
    keys = sized(stash(holders.select(F.col("text_hash").alias("key")).distinct()))
    texts = df.select(F.lit(0).alias("grp"), text_hash(F.col("text")).alias("key"), "text").join(keys, "key", "left_semi")
    classes = sized(stash(near_copy_classes(texts).select(F.col("key").alias("text_hash"), "label")))
    recur = holders.join(classes, "text_hash").select("template", "label").distinct().groupBy("template").agg(F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") >= min_docs)
    return kept.join(sized(stash(recur)), "template"), held.select("h", "text_hash")


def drop_recurrent(df: DataFrame, **limits) -> DataFrame:
    """All rows and columns of ``df``; ``text`` without the recurrent lines, and n_lines (with a token), n_dropped, dropped_words.

    Null texts stay null and empty ones empty, without lines; repeated rows and copies are treated alike; an empty table gives
    no rows; input columns named like the results are replaced; names that begin with two underscores are the operator's own.
    """
    df = df.drop("n_lines", "n_dropped", "dropped_words")
    lines, held = recurrent_lines(df, **limits)
    lines = sized(stash(lines))
    per = held.join(lines, "h").groupBy("text_hash").agg(F.collect_set("h").alias("__drop")).withColumnRenamed("text_hash", "__th")
    per = sized(stash(per))
    t = df.withColumn("__hash", text_hash(F.col("text"))).join(per, F.col("__hash") == F.col("__th"), "left")
    every = F.split(F.coalesce("text", F.lit("")), "\n")
    flagged = F.when(F.col("__drop").isNotNull(), F.transform(every, lambda x: F.struct(x.alias("x"), F.array_contains("__drop", F.xxhash64(masked(x))).alias("d"))))
    t = t.withColumn("n_lines", F.size(lines_with_tokens(F.coalesce("text", F.lit("")))).cast("long"))
    words = lambda x: F.regexp_count(x, F.lit(r"[^\x20\x09-\x0D]+"))
    done = let(flagged, lambda f: F.struct(F.filter(f, lambda s: s["d"]).alias("gone"), F.array_join(F.transform(F.filter(f, lambda s: ~s["d"]), lambda s: s["x"]), "\n").alias("text")))
    t = t.withColumn("__done", F.when(F.col("__drop").isNotNull(), done)).withColumn("__gone", F.coalesce("__done.gone", F.array().cast("array<struct<x:string,d:boolean>>")))
    t = t.withColumn("n_dropped", F.size("__gone").cast("long")).withColumn("dropped_words", F.aggregate("__gone", F.lit(0).cast("long"), lambda a, s: a + words(s["x"])))
    t = t.withColumn("text", F.when(F.col("__drop").isNull(), F.col("text")).otherwise(F.col("__done.text")))
    return t.drop("__hash", "__th", "__drop", "__done", "__gone")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_recurrent(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
