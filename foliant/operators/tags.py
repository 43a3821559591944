"""Tags: keyword extraction, counts, and the user's own tags, stars and clusters as small tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import STOP_WORDS, count_of, let, runs, tag_tokens
from foliant.scale import spread

TITLE_WEIGHT, MAX_TAGS = 3, 5


def keyword_array(text: Column, title: Column, max_tags: int = MAX_TAGS, body_chars: int | None = None) -> Column:
    """(n, r, tag) structs of a text's keywords, the best first; n is the negative count. Null for a null text.

    Words of the whole text are counted (with ``body_chars``, of its first characters) by sorting them within the row, a title
    word as often as it weighs: nothing is shuffled.
    """
    placed = lambda words, at: F.transform(words, lambda w, i: F.struct(w.alias("w"), (i + at).alias("pos")))
    good = lambda w: (F.length(w) > 1) & ~w.isin(*STOP_WORDS)
    body = tag_tokens(text if body_chars is None else F.substring(text, 1, body_chars))
    words = let(tag_tokens(F.coalesce(title, F.lit(""))), lambda a: F.concat(*[placed(a, F.lit(0))] * TITLE_WEIGHT, placed(body, F.size(a))))
    found = runs(F.sort_array(F.filter(words, lambda x: good(x["w"]))), lambda x: x["w"])
    ranked = F.sort_array(F.transform(found, lambda x: F.struct((-x["n"]).alias("weight"), x["item"]["pos"].alias("first"), x["item"]["w"].alias("w"))))
    best = F.slice(ranked, 1, 2 * max_tags)
    again = let(F.lower(text), lambda low: F.transform(best, lambda x, r: F.struct((-count_of(low, x["w"])).alias("n"), r.alias("r"), x["w"].alias("tag"))))
    return F.slice(F.sort_array(F.filter(again, lambda x: x["n"] < 0)), 1, max_tags)


def keyword_tags(files: DataFrame, key: str = "file_path", text: str = "text", title: str = "title", max_tags: int = MAX_TAGS, body_chars: int | None = None) -> DataFrame:
    """(key, tag, ord, n): words of the title (weight 3) and of the body (all of it, or its first ``body_chars`` characters), stop
    words and single characters out; the 2 * max_tags heaviest (ties: first seen), re-ranked by occurrences in the whole text, absent ones out.

    A row is a file; rows without a key give nothing. All is done within the row.
    """
    files = spread(files.select(key, text, title).where(F.col(key).isNotNull()), key)
    # posexplode_outer: for posexplode the optimiser would add a filter that computes the keywords once more.
    t = files.select(key, F.posexplode_outer(keyword_array(F.col(text), F.col(title), max_tags, body_chars)).alias("pos", "x")).where("x is not null")
    return t.select(key, "x.tag", (F.col("pos") + 1).alias("ord"), (-F.col("x.n")).alias("n"))


def tag_counts(file_tags: DataFrame) -> DataFrame:
    return file_tags.groupBy("tag").agg(F.count_distinct("file_path").alias("n_files"))


def all_tags(file_tags: DataFrame) -> DataFrame:
    return file_tags.select("tag").distinct().orderBy("tag")


def files_by_tag(file_tags: DataFrame, tag: str) -> DataFrame:
    return file_tags.where(F.col("tag") == tag).select("file_path").distinct()


def tags_of(file_tags: DataFrame) -> DataFrame:
    """(file_path, file_tags) in tag order."""
    return file_tags.groupBy("file_path").agg(F.array_sort(F.collect_list(F.struct("ord", "tag"))).alias("s")).select("file_path", F.transform("s", lambda x: x["tag"]).alias("file_tags"))


def add_tags(file_tags: DataFrame, added: DataFrame) -> DataFrame:
    """Both sets of (file_path, tag, ord), each tag once a file at its first place; old tags before new ones."""
    both = file_tags.select("file_path", "tag", F.lit(0).alias("g"), "ord").unionByName(added.select("file_path", "tag", F.lit(1).alias("g"), "ord"))
    t = both.groupBy("file_path", "tag").agg(F.min(F.struct("g", "ord")).alias("at"))
    return t.select("file_path", "tag", F.row_number().over(Window.partitionBy("file_path").orderBy("at", "tag")).alias("ord"))


def set_tags(file_tags: DataFrame, new: DataFrame) -> DataFrame:
    """The tags of the files in ``new`` replaced."""
    return file_tags.join(new.select("file_path").distinct(), "file_path", "left_anti").unionByName(add_tags(new.limit(0), new))


def drop_files(table: DataFrame, files: DataFrame) -> DataFrame:
    return table.join(files, "file_path", "left_anti")


def star(starred: DataFrame, files: DataFrame) -> DataFrame:
    return add_tags(starred.withColumn("tag", F.lit("*")).select("file_path", "tag", "ord"), files.withColumn("tag", F.lit("*")).withColumn("ord", F.lit(1 << 30))).select("file_path", F.row_number().over(Window.orderBy("ord", "file_path")).alias("ord"))


def unstar(starred: DataFrame, files: DataFrame) -> DataFrame:
    return drop_files(starred, files)


def merge_clusters(clusters: DataFrame, ids: list[int], label: str) -> DataFrame:
    """Clusters (id, label, files) with those of ``ids`` made one, files in first-seen order, under the first of the ids."""
    hit = clusters.where(F.col("id").isin(ids))
    order = F.array_position(F.array(*map(F.lit, ids)), F.col("id"))
    one = hit.agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), "files"))).alias("s")).where(F.size("s") > 0)
    one = one.select(F.lit(ids[0]).alias("id"), F.lit(label).alias("label"), F.array_distinct(F.flatten(F.transform("s", lambda x: x["files"]))).alias("files"))
    return clusters.where(~F.col("id").isin(ids)).select("id", "label", "files").unionByName(one)


def dismiss_cluster(clusters: DataFrame, cluster_id: int) -> DataFrame:
    return clusters.where(F.col("id") != cluster_id)


def filter_names(files: DataFrame, text: str, members: DataFrame | None = None) -> DataFrame:
    """Files whose name or path holds the text, optionally those of a cluster only."""
    hit = F.contains(F.lower("file_name"), F.lit(text.lower())) | F.contains(F.lower("file_path"), F.lit(text.lower()))
    t = files.where(hit)
    return t.join(members, "file_path", "left_semi") if members is not None else t


def filter_tags(counts: DataFrame, text: str) -> DataFrame:
    return counts.where(F.contains(F.lower("tag"), F.lit(text.lower()))).orderBy(F.desc("n_files"), "tag")
