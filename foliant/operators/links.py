"""Link graph: extraction, resolution, nodes and edges as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.paths import MARKDOWN, basename, extension, normal_path, stem

#: Fixed values, by the link syntax of Markdown and of wikis: the target between double brackets, or in round ones after a label.
WIKILINK = r"\[\[([^\[\]]+)\]\]"
LABELLED = r"(?<!!)\[[^\]]*\]\(([^)]+)\)"
FENCE = r"(?md)^ *```.*$"
#: Targets that leave the corpus.
EXTERNAL = ("http://", "https://", "mailto:", "ftp://", "data:", "#", "//")


def guess_type(raw: Column) -> Column:
    return F.when(raw.startswith("/"), "abspath").when(extension(raw).isin(*MARKDOWN) | raw.contains("/") | raw.contains("\\"), "relpath").otherwise("wikilink")


def outside_fences(text: Column) -> Column:
    """Array of (start, body): the runs of text between fenced blocks, with the line number that each begins on.

    The text is cut at its fence lines; every second piece is fenced. A fence line's own rest is an empty first line.
    """
    add = lambda a, piece: F.struct((a["line"] + F.length(piece) - F.length(F.replace(piece, F.lit("\n"), F.lit("")))).cast("int").alias("line"), F.concat(a["all"], F.array(F.struct(a["line"].alias("start"), piece.alias("body")))).alias("all"))
    none = F.struct(F.lit(0).alias("line"), F.array().cast("array<struct<start:int,body:string>>").alias("all"))
    return F.filter(F.aggregate(F.split(text, FENCE, -1), none, add, lambda a: a["all"]), lambda _, i: i % 2 == 0)


def extract_links(files: DataFrame) -> DataFrame:
    """(source, target_raw, link_type, line, context) of (file_path, text), fenced blocks left out. No shuffle."""
    t = files.select("file_path", F.explode(outside_fences(F.col("text"))).alias("p")).where(F.contains("p.body", F.lit("](")) | F.contains("p.body", F.lit("[[")))
    t = t.select("file_path", "p.start", F.posexplode(F.split("p.body", "\n")).alias("at", "x")).select("file_path", (F.col("start") + F.col("at")).alias("i"), "x")
    wiki = F.transform(F.regexp_extract_all("x", F.lit(WIKILINK), F.lit(1)), lambda m: F.struct(F.trim(F.substring_index(F.substring_index(F.trim(m), "|", 1), "#", 1)).alias("raw"), F.lit("wikilink").alias("kind")))
    md = F.transform(F.regexp_extract_all("x", F.lit(LABELLED), F.lit(1)), lambda m: F.struct(F.trim(m).alias("raw"), F.when(F.trim(m).startswith("/"), "abspath").otherwise("relpath").alias("kind")))
    external = F.lit(False)
    for p in EXTERNAL:
        external = external | F.lower(F.col("k.raw")).startswith(p)
    t = t.select("file_path", "i", "x", F.explode(F.concat(wiki, md)).alias("k")).where("k.raw <> ''").where((F.col("k.kind") == "wikilink") | ~external)
    return t.select(F.col("file_path").alias("source"), F.col("k.raw").alias("target_raw"), F.col("k.kind").alias("link_type"), F.col("i").alias("line"), F.substring(F.trim("x"), 1, 200).alias("context"))


def joined_path(source: Column, raw: Column, root: Column) -> Column:
    """Target path of a link as written: against its folder, or against the source's root."""
    path = F.regexp_replace(raw, "[#?].*$", "")
    folder = F.when(source.contains("/"), F.regexp_replace(source, "[^/]*$", "")).otherwise("")
    return normal_path(F.when(path.startswith("/"), F.concat(F.coalesce(root, F.lit("")), path)).otherwise(F.concat(folder, path)))


def resolve_links(links: DataFrame, files: DataFrame) -> DataFrame:
    """``links`` with target: for paths the exact path, then the same base name in the same source, then in any; for wikilinks
    title in the same source, stem in the same source, any title, any stem. Within a level the least path; null if none.

    Each level is one equi-join on a key of which the files table keeps the least path, so no join multiplies rows.
    """
    f = files.select("file_path", "source", F.lower(F.coalesce("title", F.lit(""))).alias("title"), F.lower(stem(F.col("file_path"))).alias("stem"), F.lower(basename(F.col("file_path"))).alias("base"))
    t = links.join(f.select(F.col("file_path").alias("source_path"), F.col("source").alias("root")), links["source"] == F.col("source_path"), "left").drop("source_path")
    is_path = F.col("link_type") != "wikilink"
    t = t.withColumn("__exact", F.when(is_path, joined_path(F.col("source"), F.col("target_raw"), F.col("root"))))
    clean = F.regexp_replace("target_raw", "[#?].*$", "")
    t = t.withColumn("__base", F.when(is_path, F.lower(basename(clean)))).withColumn("__name", F.when(~is_path, F.lower(F.regexp_replace(basename(F.col("target_raw")), r"(?i)\.(md|markdown|mdown|mkd|mdx|mdwn)$", ""))))

    def least(t: DataFrame, key: str, left: str, same: bool, out: str) -> DataFrame:
        keys = [F.col(key).alias("__k"), *([F.col("source").alias("__r")] if same else [])]
        m = f.where(F.col(key) != "").groupBy(*keys).agg(F.min("file_path").alias(out))
        on = t[left] == m["__k"]
        return t.join(m, on & (t["root"] == m["__r"]) if same else on, "left").drop("__k", "__r")

    t = least(t, "file_path", "__exact", False, "c1")
    for i, (key, left, same) in enumerate([("base", "__base", True), ("base", "__base", False), ("title", "__name", True), ("stem", "__name", True), ("title", "__name", False), ("stem", "__name", False)], 2):
        t = least(t, key, left, same, f"c{i}")
    return t.withColumn("target", F.coalesce(*[f"c{i}" for i in range(1, 8)])).drop("root", "__exact", "__base", "__name", *[f"c{i}" for i in range(1, 8)])


def graph(files: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): nodes (path, title, kind article or missing); edges keep repeats, a dangling target is its own text."""
    edges = resolve_links(links, files).withColumn("resolved", F.col("target").isNotNull()).withColumn("target", F.coalesce("target", "target_raw"))
    articles = files.where(extension(F.col("file_path")).isin(*MARKDOWN)).select(F.col("file_path").alias("path"), F.coalesce("title", stem(F.col("file_path"))).alias("title"))
    hit = edges.where("resolved").select(F.col("target").alias("path")).join(files.select(F.col("file_path").alias("path"), F.coalesce("title", stem(F.col("file_path"))).alias("title")), "path")
    missing = edges.where("not resolved").select(F.col("target").alias("path"), F.col("target").alias("title"), F.lit("missing").alias("kind")).distinct()
    nodes = articles.unionByName(hit).distinct().withColumn("kind", F.lit("article")).unionByName(missing)
    return nodes, edges.select("source", "target", "link_type", "line", "context")


def incoming(edges: DataFrame) -> DataFrame:
    return edges.groupBy("target").agg(F.array_sort(F.collect_set("source")).alias("sources"))


def neighbours(edges: DataFrame, path: str) -> DataFrame:
    """(path, direction) one hop away."""
    out = edges.where(F.col("source") == path).select(F.col("target").alias("path"), F.lit("out").alias("direction"))
    back = edges.where(F.col("target") == path).select(F.col("source").alias("path"), F.lit("in").alias("direction"))
    return out.unionByName(back).distinct()


def render_cap(nodes: DataFrame, cap: int = 500) -> DataFrame:
    return nodes.orderBy("path").limit(cap)


def html_links(pages: DataFrame) -> DataFrame:
    """(page_id, pos, href) of the anchors in raw HTML, in order."""
    hrefs = F.regexp_extract_all("html", F.lit(r'(?i)<a\s[^>]*href="([^"]*)"'), F.lit(1))
    return pages.select("page_id", F.posexplode(hrefs).alias("pos", "href"))
