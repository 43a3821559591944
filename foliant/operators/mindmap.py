"""Mind maps as flat tree rows: (root_id, node_id, parent_id, ord, level, label, weight)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.paths import stem
from foliant.functions.text import let, one_line
from foliant.operators.grouping import per_file_cap
from foliant.operators.tags import keyword_array, keyword_tags
from foliant.scale import ship, spread, stash
from foliant.sources.parsing import PARAGRAPHS, paragraph_array, parse_html, parse_markdown

ROWS = "root_id string, node_id string, parent_id string, ord int, level int, label string, weight double"
NODE = "struct<node_id:string,parent_id:string,ord:int,level:int,label:string,weight:double>"
#: Sections of a map and keywords of a file; least length and cut of a paragraph's label, under a heading and in a
#: text without headings (there only the first paragraphs count); weights of main headings, others, paragraphs, keyword nodes, shared topics.
SECTIONS, KEYWORDS, PLAIN = 20, 8, 10
LONGER_THAN, CUT, PLAIN_LONGER_THAN, PLAIN_CUT = 20, 40, 30, 50
MAIN, MINOR, LEAF, GROUP, TOPICS = 1.0, 0.7, 0.5, 0.8, 0.9
KEYWORD_LABEL, TOPICS_LABEL = "关键词", "共同主题"


def node(node_id: Column, parent: Column, at: Column, level: Column | int, label: Column, weight: Column | float) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(node_id, parent, at.cast("int"), lit(level).cast("int"), label, lit(weight).cast("double")).cast(NODE)


def _texts(paragraphs: Column, longer: int) -> Column:
    return F.filter(paragraphs, lambda p: p["type"].isin("paragraph", "list") & (F.length(p["content"]) > longer))


def section_nodes(ps: Column) -> Column:
    """Tree nodes of a file's paragraphs: each of the first headings with the longer texts up to the next heading; without
    headings, the longer ones of the first paragraphs."""
    place = lambda *parts: F.concat_ws(".", F.lit("0"), *[x.cast("string") for x in parts])

    def section(heads: Column, h: Column, k: Column) -> Column:
        end = F.coalesce(F.get(heads, k + 1)["i"], F.size(ps))
        own = node(place(k), F.lit("0"), k, F.greatest(h["p"]["level"], F.lit(1)), h["p"]["content"], F.when(h["p"]["level"] <= 2, MAIN).otherwise(MINOR))
        below = _texts(F.slice(ps, h["i"] + 2, F.greatest(end - h["i"] - 1, F.lit(0))), LONGER_THAN)
        return F.concat(F.array(own), F.transform(below, lambda p, j: node(place(k, j), place(k), j, 3, one_line(p["content"], CUT), LEAF)))

    heads = F.filter(F.transform(ps, lambda p, i: F.struct(i.alias("i"), p.alias("p"))), lambda h: h["p"]["type"] == "heading")
    plain = F.transform(_texts(F.slice(ps, 1, PLAIN), PLAIN_LONGER_THAN), lambda p, k: node(place(k), F.lit("0"), k, 1, one_line(p["content"], PLAIN_CUT), LEAF))
    return let(heads, lambda hs: F.when(F.size(hs) > 0, F.flatten(F.transform(F.slice(hs, 1, SECTIONS), lambda h, k: section(hs, h, k)))).otherwise(plain))


def _parse(batches):
    for b in batches:
        for cut in (b.slice(at, 64) for at in range(0, b.num_rows, 64)):
            found = [(parse_html if html else parse_markdown)(text or "") for text, html in zip(cut.column(1).to_pylist(), cut.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([cut.column(0), cut.column(1), paragraph_array(found)], names=["file_path", "text", "ps"])


def from_files(files: DataFrame) -> DataFrame:
    """The map of each file of (file_path, text): its sections, then a node of at most eight keywords.

    Parsing, the one Python step, hands the text on, so trees, titles and keywords are Columns of one row, and nothing is shuffled.
    The trees are stored, small as they are, so that parsing is done once.
    """
    ship(files.sparkSession)
    html = F.lower("file_path").rlike(r"\.html?$")
    parsed = spread(files.select("file_path", "text"), "file_path").select("file_path", "text", html.alias("is_html")).mapInArrow(_parse, f"file_path string, text string, ps {PARAGRAPHS}")
    first = F.get(F.filter("ps", lambda p: (p["type"] == "heading") & (p["level"] <= 2)), F.lit(0))["content"]
    parsed = parsed.select("file_path", "text", F.coalesce(first, stem(F.col("file_path"))).alias("title"), section_nodes(F.col("ps")).alias("nodes"))
    words = F.slice(F.transform(keyword_array(F.col("text"), F.col("title")), lambda w: w["tag"]), 1, KEYWORDS)
    parsed = stash(parsed.select("file_path", "title", "nodes", F.when(F.col("file_path").isNotNull(), words).alias("words")))
    root = node(F.lit("0"), F.lit(None).cast("string"), F.lit(0), 0, F.col("title"), MAIN)
    head = node(F.lit("0.k"), F.lit("0"), F.lit(1000), 1, F.lit(KEYWORD_LABEL), GROUP)
    leaves = F.transform("words", lambda w, i: node(F.concat(F.lit("0.k."), (i + 1).cast("string")), F.lit("0.k"), i + 1, 2, w, LEAF))
    keywords = F.when(F.size("words") > 0, F.concat(F.array(head), leaves)).otherwise(F.array().cast(f"array<{NODE}>"))
    return parsed.select(F.col("file_path").alias("root_id"), F.explode(F.concat(F.array(root), F.col("nodes"), keywords)).alias("n")).select("root_id", "n.*")


def from_many(files: DataFrame, label: str, top: int = 10) -> DataFrame:
    """One map of many files: a root, each file's map below it one level down under the file's stem, and a node of the keywords
    that files share, each with the number of its files."""
    maps = stash(from_files(files))
    top_node = F.col("parent_id").isNull()
    below = maps.select(F.lit("files").alias("root_id"), F.concat_ws("/", "root_id", "node_id").alias("node_id"), F.when(top_node, F.lit("0")).otherwise(F.concat_ws("/", "root_id", "parent_id")).alias("parent_id"), "ord", (F.col("level") + 1).alias("level"), F.when(top_node, stem(F.col("root_id"))).otherwise(F.col("label")).alias("label"), "weight")
    words = keyword_tags(files.select("file_path", "text", stem(F.col("file_path")).alias("title"))).select("file_path", "tag")
    shared = shared_keywords(words, top).select(F.row_number().over(Window.orderBy(F.desc("n_files"), "tag")).alias("ord"), "tag", "n_files", "weight")  # at most ``top`` rows
    topics = shared.agg(F.array_sort(F.collect_list(F.struct("ord", "tag", "n_files", "weight"))).alias("w")).where(F.size("w") > 0)
    leaves = F.transform("w", lambda x: node(F.concat(F.lit("t."), x["ord"].cast("string")), F.lit("t"), x["ord"], 2, F.format_string("%s (%d)", x["tag"], x["n_files"]), x["weight"]))
    topics = topics.select(F.explode(F.concat(F.array(node(F.lit("t"), F.lit("0"), F.lit(1 << 20), 1, F.lit(TOPICS_LABEL), TOPICS)), leaves)).alias("n"))
    root = files.sparkSession.range(1).select(node(F.lit("0"), F.lit(None).cast("string"), F.lit(0), 0, F.lit(label), MAIN).alias("n"))
    return root.unionByName(topics).select(F.lit("files").alias("root_id"), "n.*").unionByName(below)


def shared_keywords(keywords: DataFrame, top: int = 10) -> DataFrame:
    """(tag, n_files, weight) of keywords in two files or more."""
    t = keywords.groupBy("tag").agg(F.count_distinct("file_path").alias("n_files")).orderBy(F.desc("n_files"), "tag").limit(top)
    return t.where("n_files >= 2").withColumn("weight", F.col("n_files") * 0.3)


def from_results(rows: DataFrame) -> DataFrame:
    """Files in rank order, each with its first five matches (100 characters and three dots; weight: similarity)."""
    t = per_file_cap(rows, 5).withColumn("file_rank", F.min("rank").over(Window.partitionBy("file_path")))
    files = t.groupBy("file_path", "file_rank").agg(F.count(F.lit(1)).alias("n"))
    top = files.select(F.lit("results").alias("root_id"), F.col("file_path").alias("node_id"), F.lit("0").alias("parent_id"), F.col("file_rank").alias("ord"), F.lit(1).alias("level"), stem(F.col("file_path")).alias("label"), F.lit(0.8).alias("weight"))
    leaf = t.where("content <> ''").select(F.lit("results").alias("root_id"), F.concat_ws("#", "file_path", F.col("nth").cast("string")).alias("node_id"), F.col("file_path").alias("parent_id"), F.col("nth").alias("ord"), F.lit(2).alias("level"), F.concat(F.substring("content", 1, 100), F.lit("...")).alias("label"), F.coalesce("similarity", F.lit(0.0)).alias("weight"))
    return top.unionByName(leaf)
