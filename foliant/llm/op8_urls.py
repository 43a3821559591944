"""URL filter: rules first, then a character language-model ratio.

Two smoothed variable-order Markov models, of URLs that the rules accept and of URLs that they reject, are counted with
DataFrame aggregations. A URL's score is the mean over its characters of the log-likelihood difference, each taken from the
longest stored context; the threshold is calibrated on labelled URLs that the counts leave out. Rules look at host and path, the
models at the whole lower-cased URL. No Python code runs on rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.scale import read_table, sized, stash

#: (verdict, rule): a rule is a host, then a path prefix.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Characters of the longest gram (context and character).
ORDER = 5
#: A gram is stored if it occurs this often, whatever the table's size: the model grows with the input.
LEAST = 2
#: Weight of the shorter context's estimate, in characters, and the alphabet's size for the shortest.
BACKOFF, ALPHABET = 5.0, 256
#: One labelled URL in this many is held back for calibration.
FOLDS = 5
START = "\x02"


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty if the url is null or has no ``://``."""
    rest = F.when(F.locate("://", url) > 0, F.expr("substring({0}, locate('://', {0}) + 3)".format("url")))
    host = F.regexp_extract(F.coalesce(rest, F.lit("")), r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(F.coalesce(rest, F.lit("")), r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def apply_rules(df: DataFrame, rules=RULES) -> DataFrame:
    """``df`` with host, path, rule and by_rule (its verdict): the longest rule that fits, else null."""
    df = df.drop("host", "path", "rule", "by_rule")
    host, path = host_path(F.col("url"))
    df = df.withColumn("host", host).withColumn("path", path)
    longest = sorted(rules, key=lambda r: -len(r[1]))

    def fits(rule: str) -> Column:
        h, p = rule.split("/", 1)
        return ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith("/" + p)

    pick = lambda k: reduce(lambda c, r: c.when(fits(r[1]), F.lit(r[k])), longest[1:], F.when(fits(longest[0][1]), F.lit(longest[0][k])))
    return df.withColumn("rule", pick(1)).withColumn("by_rule", pick(0))


def grams(df: DataFrame, keep: list[str]) -> DataFrame:
    """One row a character of ``url_text``: g1 to gORDER, the grams that end there."""
    s = F.concat(F.lit(START * (ORDER - 1)), F.col("url_text"))
    at = F.when(F.length("url_text") > 0, F.sequence(F.lit(1), F.length("url_text")))
    t = df.withColumn("__s", s).select(*keep, "__s", F.explode_outer(at).alias("__i"))
    return t.select(*keep, *[F.expr(f"substring(__s, __i + {ORDER - k}, {k})").alias(f"g{k}") for k in range(1, ORDER + 1)])


def train(labelled: DataFrame) -> DataFrame:
    """(gram, delta) from rows (url_text, accepted): log P(last character | rest) under the accepted model minus the rejected."""
    per = grams(labelled, ["accepted"]).where("g1 is not null")
    each = per.select("accepted", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"g{k}").alias("gram")) for k in range(1, ORDER + 1)])).alias("x"))
    counts = each.groupBy("x.k", "x.gram").agg(F.count_if(F.col("accepted")).alias("a"), F.count_if(~F.col("accepted")).alias("r"))
    counts = stash(counts.groupBy("k", "gram").agg(F.sum("a").alias("a"), F.sum("r").alias("r")))
    n = counts.where("k = 1").agg(F.sum("a"), F.sum("r")).first()
    na, nr = (n[0] or 0), (n[1] or 0)
    stored = counts.where(F.col("a") + F.col("r") >= LEAST)
    prob = lambda c, total, shorter: (F.col(c) + BACKOFF * shorter) / (F.coalesce(F.col(total), F.lit(0)) + BACKOFF)
    model = stored.where("k = 1").select("gram", ((F.col("a") + 1) / F.lit(float(na + ALPHABET))).alias("pa"), ((F.col("r") + 1) / F.lit(float(nr + ALPHABET))).alias("pr"))
    parts = [model]
    for k in range(2, ORDER + 1):
        level = counts.where(f"k = {k}")
        context = level.groupBy(F.substring("gram", 1, k - 1).alias("context")).agg(F.sum("a").alias("ca"), F.sum("r").alias("cr"))
        t = level.where(F.col("a") + F.col("r") >= LEAST).withColumn("context", F.substring("gram", 1, k - 1)).withColumn("shorter", F.substring("gram", 2, k - 1))
        t = t.join(context, "context").join(parts[-1].select(F.col("gram").alias("shorter"), F.col("pa").alias("sa"), F.col("pr").alias("sr")), "shorter")
        parts.append(stash(t.select("gram", prob("a", "ca", F.col("sa")).alias("pa"), prob("r", "cr", F.col("sr")).alias("pr"))))
    return stash(reduce(DataFrame.unionByName, parts).select("gram", F.log(F.col("pa") / F.col("pr")).alias("delta")))


def score(df: DataFrame, model: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns of every row of ``df`` and ``score``; rows without url_text score 0. Equal rows stay apart.

    Each different gram of ORDER characters finds its longest stored ending once; characters then meet that one table, which is
    broadcast or shuffled by its measured size.
    """
    wide = F.col(f"g{ORDER}")
    found = grams(df, []).select(wide.alias("__g")).where("__g is not null").distinct()
    for k in range(ORDER, 0, -1):
        order = model.where(F.length("gram") == k).select(F.col("gram").alias(f"__m{k}"), F.col("delta").alias(f"__d{k}"))
        found = found.join(order, F.expr(f"substring(__g, {ORDER - k + 1}, {k})") == F.col(f"__m{k}"), "left").drop(f"__m{k}")
    deltas = found.select("__g", F.coalesce(*[F.col(f"__d{k}") for k in range(ORDER, 0, -1)], F.lit(0.0)).alias("__delta"))
    deltas = sized(stash(deltas))
    t = grams(df.withColumn("__row", F.monotonically_increasing_id()), ["__row", *keep]).select("__row", *keep, wide.alias("__w"))
    t = t.join(deltas, F.col("__w") == F.col("__g"), "left")
    return t.groupBy("__row", *keep).agg(F.avg(F.coalesce("__delta", F.lit(0.0))).alias("score")).drop("__row")


def threshold(scored: DataFrame) -> float:
    """The score from which on URLs are accepted: least sum of both error rates on (accepted, score); nearest 0 on ties."""
    bins = scored.groupBy(F.least(F.greatest(F.floor(F.col("score") * 100), F.lit(-1000)), F.lit(1000)).cast("int").alias("bin")).agg(F.count_if(F.col("accepted")).alias("a"), F.count_if(~F.col("accepted")).alias("r"))
    rows = {r.bin: (r.a, r.r) for r in bins.collect()}  # at most 2001 rows
    na, nr = sum(a for a, _ in rows.values()), sum(r for _, r in rows.values())
    if not na or not nr:
        return float("-inf")
    best = []
    for cut in range(-1000, 1002):
        lost = sum(a for b, (a, _) in rows.items() if b < cut) / na
        let = sum(r for b, (_, r) in rows.items() if b >= cut) / nr
        best.append((lost + let, abs(cut), cut))
    return min(best)[2] / 100


def judge(pages: DataFrame, rules=RULES, id_col: str = "page_id") -> DataFrame:
    """(id, url, host, path, rule, verdict, score) for every row of ``pages``.

    verdict is the rule's, else allow if score reaches the threshold. Null urls and urls without ``://`` have empty host and path
    and so no rule; the latter are scored by their raw text, null and empty ones score 0. If the rules label no URL of one kind,
    all others are allowed. Repeated rows are judged alike; an empty table gives no rows; of other input columns none is read.
    """
    t = apply_rules(pages.select(id_col, "url"), rules)
    t = t.withColumn("url_text", F.lower(F.coalesce("url", F.lit(""))))
    labelled = t.where("by_rule is not null").select("url_text", (F.col("by_rule") == "allow").alias("accepted"), (F.pmod(F.xxhash64("url_text"), F.lit(FOLDS)) == 0).alias("held"))
    model = train(labelled.where("not held"))
    cut = threshold(score(labelled.where("held"), model, ["accepted"]))
    keep = [id_col, "url", "host", "path", "rule", "by_rule"]
    out = score(t, model, keep)
    verdict = F.coalesce("by_rule", F.when(F.col("score") >= F.lit(cut), "allow").otherwise("block"))
    return out.withColumn("verdict", verdict).drop("by_rule")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", F.round("score", 9).alias("score"))
