"""Near copies as one: classes of texts that are nearly the same, from DataFrame expressions only.

Two texts are near copies if the sets of their SHINGLE-word windows have a Jaccard similarity of PERCENT or more, which is what
the pipeline's near-duplicate stage takes as well: texts that share much boilerplate but say different things stay apart.
Sketches, the SKETCH least window hashes of a text, only propose: in each group of texts, every sketch hash names the first
text (by digest) that holds it, and if two sketches have ALIKE hashes or more in common (of pairs of texts at PERCENT, about one
in 4,000 has fewer), the whole sets decide. A text's class is the first of its near copies so found, or that one's own class.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import let
from foliant.scale import sized, stash

SHINGLE = 5
PERCENT = 80
SKETCH, ALIKE = 16, 7
WORD = r"[^\x20\x09-\x0D]+"
#: White space other than the space itself.
OTHER_SPACES = "\t\n\x0b\x0c\r"


def with_plain_spaces(text: Column, others: str) -> Column:
    """The text with a space for each of ``others``; most texts hold none of them but line ends, and are only searched."""
    rare = [c for c in others if c != "\n"]
    odd = reduce(lambda a, b: a | b, [F.contains(text, F.lit(c)) for c in rare])
    plain = F.when(odd, F.translate(text, "".join(rare), " " * len(rare))).otherwise(text)
    return F.replace(plain, F.lit("\n"), F.lit(" ")) if "\n" in others else plain


def window_set(text: Column) -> Column:
    """Distinct 64-bit hashes of a text's windows, single-spaced; a text of fewer words than a window is one window, one without words has none."""
    words = F.array_remove(F.split(with_plain_spaces(F.coalesce(text, F.lit("")), OTHER_SPACES), " "), "")

    def hashes(w: Column) -> Column:
        n = F.size(w)
        # Past the end ``get`` is null, which ``concat_ws`` skips: the first window of a short text is the whole text.
        each = F.transform(w, lambda x, i: F.xxhash64(F.concat_ws(" ", x, *[F.get(w, i + j) for j in range(1, SHINGLE)])))
        return F.slice(each, 1, F.greatest(n - (SHINGLE - 1), F.least(n, F.lit(1))))

    return F.array_distinct(let(words, hashes))


def near_copy_classes(texts: DataFrame) -> DataFrame:
    """(grp, key, label) from (grp, key, text), a key for each different text; a null group is a group of its own.

    Rows that share group and key count once. Each row goes to SKETCH buckets by hash, of which only the first text is kept: no
    pair of texts other than (text, first of its bucket) is made. The window sets of the pairs with alike sketches are computed
    from the texts, which are read a second time.
    """
    least = F.slice(F.sort_array(window_set(F.col("text"))), 1, SKETCH)
    t = texts.select("grp", "key", F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias("own"), least.alias("least"))
    t = stash(t.groupBy("grp", "key").agg(F.first("own").alias("own"), F.first("least").alias("least")))
    each = t.select("grp", "key", "own", F.explode("least").alias("v"))
    first = each.groupBy(F.col("grp").alias("__g"), F.col("v").alias("__v")).agg(F.min(F.struct("own", "key")).alias("r"), F.count(F.lit(1)).alias("__c")).where("__c > 1")
    first = sized(stash(first.select("__g", "__v", F.col("r.own").alias("__own"), F.col("r.key").alias("__lead"))))
    met = each.join(first, each["grp"].eqNullSafe(first["__g"]) & (each["v"] == first["__v"])).where("own > __own")
    pairs = _alike(t, stash(met.select("grp", "key", "own", "__lead", "__own").distinct()))
    near = _verified(texts, stash(pairs))
    label = stash(near.groupBy("grp", "key").agg(F.min("own").alias("own"), F.min("__own").alias("label")))
    up = sized(label.select(F.col("grp").alias("__ug"), F.col("own").alias("__uo"), F.col("label").alias("__ul")))
    label = label.join(up, label["grp"].eqNullSafe(up["__ug"]) & (label["label"] == up["__uo"]), "left")
    label = sized(stash(label.select(F.col("grp").alias("__lg"), F.col("key").alias("__lk"), F.coalesce("__ul", "label").alias("__label"))))
    out = t.join(label, t["grp"].eqNullSafe(label["__lg"]) & (t["key"] == label["__lk"]), "left")
    return out.select("grp", "key", F.coalesce("__label", "own").alias("label"))


def _alike(t: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows of ``pairs`` (grp, key, own, __lead, __own) whose sketches have enough in common."""
    sketches = lambda n: t.select(F.col("grp").alias(f"__g{n}"), F.col("key").alias(f"__k{n}"), F.col("least").alias(f"__s{n}"))
    leads = pairs.select(F.col("grp").alias("__g"), F.col("__lead").alias("__l")).distinct()
    theirs = sketches(1)
    theirs = sized(stash(theirs.join(leads, theirs["__g1"].eqNullSafe(leads["__g"]) & (theirs["__k1"] == leads["__l"]), "left_semi")))
    mine = sketches(0)
    j = pairs.join(theirs, pairs["grp"].eqNullSafe(theirs["__g1"]) & (pairs["__lead"] == theirs["__k1"]))
    j = j.join(mine, j["grp"].eqNullSafe(mine["__g0"]) & (j["key"] == mine["__k0"]))
    enough = SKETCH * F.size(F.array_intersect("__s0", "__s1")) >= ALIKE * F.greatest(F.size("__s0"), F.size("__s1"))
    return j.where(enough).select("grp", "key", "own", "__lead", "__own")


def _verified(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows of ``pairs`` (grp, key, own, __lead, __own) whose window sets are similar enough; a key has SKETCH leads at most."""
    lead = sized(stash(pairs.select(F.col("grp").alias("__g"), F.col("__lead").alias("__k")).distinct()))
    asked = pairs.groupBy(F.col("grp").alias("__g"), F.col("key").alias("__k")).agg(F.first("own").alias("own"), F.collect_set(F.struct("__lead", "__own")).alias("leads"))
    asked = sized(stash(asked))
    there = lambda other: texts["grp"].eqNullSafe(other["__g"]) & (texts["key"] == other["__k"])
    held = window_set(F.col("text")).alias("set")
    sets = texts.join(lead, there(lead)).select("grp", "key", held).dropDuplicates(["grp", "key"])
    sets = sized(stash(sets.select(F.col("grp").alias("__sg"), F.col("key").alias("__sk"), F.col("set").alias("__set"))))
    mine = texts.join(asked, there(asked)).select("grp", "key", "own", held, F.explode("leads").alias("l")).select("grp", "key", "own", "set", "l.__lead", "l.__own")
    j = mine.join(sets, mine["grp"].eqNullSafe(sets["__sg"]) & (mine["__lead"] == sets["__sk"]))
    common = F.size(F.array_intersect("set", "__set"))
    near = let(common, lambda c: 100 * c >= PERCENT * (F.size("set") + F.size("__set") - c))
    return j.where(near).select("grp", "key", "own", "__lead", "__own")
