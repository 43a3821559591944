"""Quality rules with cross-document line frequency.

Per document, in its own row: word, symbol, repeated-line and repeated-window figures. Across documents: normalised lines are
hashed, the distinct documents that hold each are counted per host, lines above the limit are removed, and documents left
with too little are rejected. Near copies of one text count as one document, so a text that is copied with small changes keeps
its lines, and one of its copies can go on. DataFrame expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions.text import let
from foliant.llm.folding import WORD, near_copy_classes
from foliant.scale import read_table, sized, stash

SPACES = "\t\n\x0b\x0c\r "
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: A line is boilerplate on a host when more documents than this hold it, whatever the host's size; near copies count once.
LINE_DOCS = 10
#: A document is depleted when fewer words, or a smaller share of its words, are left.
LEFT_WORDS = 10
LEFT_SHARE = 0.3
RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "text_hash", "lines", "words_removed", "removed", "kept")


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words that lie in windows which occur twice or more in the array (64-bit window hashes)."""

    def covered(hashes: Column) -> Column:
        n = F.size(hashes)
        placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def marks(s: Column) -> Column:
            same = lambda x, j: F.get(s, j)["h"] == x["h"]
            twice = F.filter(s, lambda x, i: ((i > 0) & same(x, i - 1)) | ((i < n - 1) & same(x, i + 1)))
            return let(F.sort_array(F.transform(twice, lambda x: x["i"])), spans)

        def spans(at: Column) -> Column:
            gaps = F.transform(at, lambda x, i: F.when(i == F.size(at) - 1, F.lit(window)).otherwise(F.least(F.lit(window), F.get(at, i + 1) - x)))
            return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

        return F.when(F.size(F.array_distinct(hashes)) == n, F.lit(0).cast("long")).otherwise(let(placed, marks))

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - window), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(window)]))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) < window + 1, F.lit(0).cast("long")).otherwise(let(hashed, lambda w: let(windows(w), covered)))


def normal_line(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), r"[\x20\x09-\x0D]+", " "))


def line_rows(text: Column) -> Column:
    """Array of (h, n, raw): normal hash, words and raw hash of each line that holds a word."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    return F.transform(lines, lambda x: F.struct(F.xxhash64(normal_line(x)).alias("h"), F.regexp_count(x, F.lit(WORD)).alias("n"), F.xxhash64(x).alias("raw")))


def text_key(text: Column) -> Column:
    """Identity of a text; a null one counts as empty."""
    t = F.coalesce(text, F.lit(""))
    return F.xxhash64(t, F.length(t))


def document_stats(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the base figures, ``base_failed``, ``text_hash`` and ``lines``; null text counts as empty."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.regexp_extract_all(t, F.lit(WORD), F.lit(0))
    dense = F.translate(t, SPACES, "")
    return (
        df.withColumn("__pair", let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("r"))))
        .withColumn("lines", line_rows(t))
        .withColumn("word_chars", F.length(dense).cast("long"))
        .withColumn("n_symbols", (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"))
        .withColumn("text_hash", text_key(F.col(text)))
        .withColumn("n_words", F.col("__pair")["n"])
        .withColumn("n_repeat_words", F.col("__pair")["r"])
        .withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct(F.transform("lines", lambda x: x["raw"])))).cast("long"))
        .withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
        .drop("__pair")
    )


def frequent_lines(stats: DataFrame, df: DataFrame, host: str, text: str = "text", min_docs: int = LINE_DOCS) -> DataFrame:
    """(__host, h, n_docs) of lines that more than ``min_docs`` documents of a host hold; copies and near copies count once.

    Texts are counted first; only those that hold a line of more than ``min_docs`` texts are read again and put into classes.
    """
    seen = stats.groupBy(F.col(host).alias("__host"), "text_hash").agg(F.first("lines").alias("lines"))
    seen = stash(seen.select("__host", "text_hash", F.array_distinct(F.transform("lines", lambda x: x["h"])).alias("hs"))).select("__host", "text_hash", F.explode("hs").alias("h"))
    often = seen.groupBy(F.col("__host").alias("__oh"), F.col("h").alias("__ol")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > min_docs)
    often = sized(stash(often.drop("n")))
    holders = stash(seen.join(often, seen["__host"].eqNullSafe(often["__oh"]) & (seen["h"] == often["__ol"])).select("__host", "text_hash", "h"))
    keys = sized(stash(holders.select(F.col("__host").alias("__kh"), F.col("text_hash").alias("__kt")).distinct()))
    texts = df.select(F.col(host).alias("grp"), text_key(F.col(text)).alias("key"), F.col(text).alias("text"))
    texts = texts.join(keys, texts["grp"].eqNullSafe(keys["__kh"]) & (texts["key"] == keys["__kt"]), "left_semi")
    classes = sized(stash(near_copy_classes(texts)))
    found = holders.join(classes, holders["__host"].eqNullSafe(classes["grp"]) & (holders["text_hash"] == classes["key"]))
    docs = found.select("__host", "h", "label").distinct().groupBy("__host", "h").agg(F.count(F.lit(1)).alias("n_docs"))
    return docs.where(F.col("n_docs") > min_docs)


def judge(stats: DataFrame, frequent: DataFrame, host: str, key: tuple[str, ...] = ("doc_id", "text_hash")) -> DataFrame:
    """One row per (key, host): words_removed, removed (hashes of removed lines) of documents that hold a frequent line."""
    frequent = sized(stash(frequent))
    each = stats.select(*key, F.col(host).alias("__on"), F.explode("lines").alias("x")).select(*key, "__on", F.col("x.h").alias("__h"), F.col("x.n").alias("__n"))
    hit = each.join(frequent, each["__on"].eqNullSafe(frequent["__host"]) & (each["__h"] == frequent["h"]))
    # Identical rows (same key, same host) are counted once: their lines are summed per line hash first.
    per_line = hit.groupBy(*key, "__on", "__h").agg(F.sum("__n").alias("__n"), F.count(F.lit(1)).alias("__c"))
    return per_line.groupBy(*key, "__on").agg(F.sum("__n").alias("words_removed"), F.collect_set("__h").alias("removed"))


def quality_verdicts(df: DataFrame, host: str = "source", text: str = "text", keep_text: bool = False, min_docs: int = LINE_DOCS) -> DataFrame:
    """All rows of ``df`` with the base figures, words_removed, removed (line hashes) and ``kept``.

    Null and empty texts have zero figures and fail the base rule; a null host is a host of its own; repeated rows get the
    same verdict; an empty table gives no rows. Input columns named like a result (RESULTS) are replaced; names that begin
    with two underscores are the operator's own.
    """
    df = df.drop(*RESULTS)
    copies = "__copies"
    stats = document_stats(df, text)
    stats = stash(stats if keep_text else stats.drop(text))
    key = ("doc_id", "text_hash")
    # A repeated row would add its lines twice under one key: divide by how often the key occurs (usually once).
    removed = judge(stats, frequent_lines(stats, df, host, text, min_docs), host, key)
    times = stats.groupBy(*key, F.col(host).alias("__on")).agg(F.count(F.lit(1)).alias(copies)).where(F.col(copies) > 1)
    on = lambda a, b: [a[k].eqNullSafe(b[f"__k{i}"]) for i, k in enumerate((*key, "__on"))]
    named = lambda x: x.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate((*key, "__on"))], *[c for c in x.columns if c not in (*key, "__on")])
    times = named(times)
    cond = on(removed, times)
    removed = removed.join(times, cond[0] & cond[1] & cond[2], "left").withColumn("words_removed", F.expr(f"words_removed div coalesce({copies}, 1)")).select(*key, "__on", "words_removed", "removed")
    removed = sized(named(stash(removed)))
    cond = [stats[k].eqNullSafe(removed[f"__k{i}"]) for i, k in enumerate((*key, host))]
    out = stats.join(removed, cond[0] & cond[1] & cond[2], "left").drop("__k0", "__k1", "__k2")
    gone = F.coalesce("words_removed", F.lit(0))
    left = F.col("n_words") - gone
    depleted = (gone > 0) & ((left < LEFT_WORDS) | (left < LEFT_SHARE * F.col("n_words")))
    return out.withColumn("words_removed", gone.cast("long")).withColumn("kept", ~F.col("base_failed") & ~depleted)


def clean_text(text: Column, removed: Column) -> Column:
    """The text without the lines whose normal hash is in ``removed``."""
    stay = F.filter(F.split(text, "\n"), lambda x: ~F.array_contains(removed, F.xxhash64(normal_line(x))))
    return F.when(removed.isNull(), text).otherwise(F.array_join(stay, "\n"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    out = quality_verdicts(d)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "words_removed")


def accepted(df: DataFrame, host: str = "source") -> DataFrame:
    """The rows of ``df`` that are kept, same columns: frequent lines are out of the text, n_chars follows where text changed.

    Nulls, repeated rows and empty tables are treated as in ``quality_verdicts``; other columns pass through, whatever their names.
    """
    found = quality_verdicts(df.select("doc_id", "text", host), host)
    odd = found.where("not kept or removed is not null").select(F.col("doc_id").alias("__d"), F.col("text_hash").alias("__t"), F.col(host).alias("__o"), F.col("kept").alias("__kept"), F.col("removed").alias("__removed"))
    odd = sized(stash(odd.dropDuplicates(["__d", "__t", "__o"])))
    d = df.withColumn("__hash", text_key(F.col("text")))
    d = d.join(odd, d["doc_id"].eqNullSafe(odd["__d"]) & (d["__hash"] == odd["__t"]) & d[host].eqNullSafe(odd["__o"]), "left")
    d = d.where("coalesce(__kept, true)").withColumn("text", clean_text(F.col("text"), F.col("__removed")))
    if "n_chars" in df.columns:
        d = d.withColumn("n_chars", F.when(F.col("__removed").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(df.schema["n_chars"].dataType)))
    return d.select(*[F.col(f"`{c}`") for c in df.columns])
