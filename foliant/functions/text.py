"""Text functions as Columns: tokenizers, snippets, matched terms, counts, escapes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that never become keywords.
STOP_WORDS = (
    *"的 了 在 是 我 有 和 就 不 人 都 一 一个 上 也 很 到 说 要 去 你 会 着 没有 看 好 自己 这 他 她 它 们 那".split(),
    *"the a an is are was were be been being have has had do does did will would could should may might shall can need".split(),
    *"dare ought used to of in for on with at by from as into through during before after above below between under".split(),
    *"again further then once here there when where why how all each few more most other some such no nor not only own".split(),
    *"same so than too very just because but and or if while about against this that these those i me my myself we our".split(),
    *"ours you your yours he him his she her hers it its they them their what which who whom".split(),
)
CJK = "一-鿿"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, whatever the optimiser inlines."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def runs(items: Column, key=lambda x: x) -> Column:
    """(item, n) of each run of equal keys in a sorted array: its first item and its length. Counts within a row, without a shuffle."""

    def cut(s: Column) -> Column:
        start = lambda i: (i == 0) | (i == F.size(s)) | (key(F.get(s, i)) != key(F.get(s, i - 1)))
        starts = F.filter(F.sequence(F.lit(0), F.size(s)), start)
        each = lambda a: F.transform(F.slice(a, 1, F.size(a) - 1), lambda i, k: F.struct(F.get(s, i).alias("item"), (F.get(a, k + 1) - i).alias("n")))
        return let(starts, each)

    return let(items, cut)


def ngrams(word: Column, sizes: tuple[int, ...]) -> Column:
    """All n-grams of a word by start, then by size."""
    n = F.length(word)
    at = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    each = F.transform(at, lambda i: F.filter(F.array(*[F.when(i + k - 1 <= n, F.substring(word, i, F.lit(k))) for k in sizes]), lambda g: g.isNotNull()))
    return F.flatten(each)


def lexical_tokens(text: Column) -> Column:
    """[a-z0-9]+ runs of the lower-cased text, then 2- and 3-grams of its CJK runs; a single CJK character gives none."""
    low = F.lower(text)
    words = F.regexp_extract_all(low, F.lit("[a-z0-9]+"), F.lit(0))
    runs = F.filter(F.regexp_extract_all(low, F.lit(f"[{CJK}]+"), F.lit(0)), lambda r: F.length(r) > 1)
    return F.when(low.rlike(f"[{CJK}]"), F.concat(words, F.flatten(F.transform(runs, lambda r: ngrams(r, (2, 3)))))).otherwise(words)


def tag_tokens(text: Column) -> Column:
    """Words (letters, digits, underscore) in order; a word that starts with CJK gives its 2- to 4-grams, less plain ones."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda w: F.length(w) > 0)
    grams = lambda w: F.filter(ngrams(w, (2, 3, 4)), lambda g: g.rlike(r"[^\x00-\x7F]") & ~g.rlike(r"^\p{N}+$"))
    cut = F.flatten(F.transform(words, lambda w: F.when(w.rlike(f"^[{CJK}]"), grams(w)).otherwise(F.array(w))))
    return F.when(F.lower(text).rlike(f"[{CJK}]"), cut).otherwise(words)  # one search spares most texts a look at each word


def has_term(content: Column, term: str | Column) -> Column:
    term = F.lit(term) if isinstance(term, str) else term
    return F.contains(F.lower(content), F.lower(term))


def any_term(content: Column, terms: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [has_term(content, t) for t in terms if t], F.lit(False))


def matched_terms(content: Column, candidates: list[str]) -> Column:
    """Sorted distinct candidates that occur in the content."""
    terms = sorted({c for c in candidates if c})
    if not terms:
        return F.array().cast("array<string>")
    return F.filter(F.array(*map(F.lit, terms)), lambda c: has_term(content, c))


def snippet(content: Column, terms: Column, size: int = 240, before: int = 40) -> Column:
    """Window of ``size`` characters that starts ``before`` the earliest hit; an ellipsis where text is cut."""
    n = F.length(content)
    first = F.array_min(F.filter(F.transform(terms, lambda t: F.position(F.lower(t), F.lower(content))), lambda i: i > 0))
    start0 = F.greatest(F.lit(0), F.coalesce(first - 1, n) - before)
    end = F.least(n, start0 + size)
    start = F.greatest(F.lit(0), end - size)
    body = F.concat(F.when(start > 0, "…").otherwise(""), F.substring(content, start + 1, end - start), F.when(end < n, "…").otherwise(""))
    plain = F.when(n > size, F.concat(F.substring(content, 1, size), F.lit("…"))).otherwise(content)
    return F.when(F.size(terms) > 0, body).otherwise(plain)


def count_of(text: Column, word: Column) -> Column:
    """Non-overlapping occurrences of a word."""
    return F.floor((F.length(text) - F.length(F.replace(text, word, F.lit("")))) / F.length(word))


def one_line(text: Column, size: int) -> Column:
    """White space collapsed, cut to ``size`` characters with an ellipsis of three dots."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > size, F.concat(F.substring(flat, 1, size), F.lit("..."))).otherwise(flat)


def html_escape(text: Column) -> Column:
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")], text)


def split_tags(text: Column) -> Column:
    return F.filter(F.split(text, r"[,，\s]+"), lambda t: F.length(t) > 0)


def highlights(content: Column, terms: list[str]) -> Column:
    """Spans (start, end) of term hits, from 0; the longest terms first, and terms inside longer ones left out."""
    keep: list[str] = []
    for t in sorted({t.lower() for t in terms if t}, key=lambda t: (-len(t), t)):
        if not any(t in k for k in keep):
            keep.append(t)
    out = F.array().cast("array<struct<start:int,end:int>>")
    for t in keep:
        out = F.concat(out, _spans(F.lower(content), t))
    return F.array_sort(out)


def _spans(low: Column, term: str) -> Column:
    """Places of a term, overlapping ones too: the text is cut before each, and the lengths of the pieces add up to the places."""
    quoted = "".join(c if c.isalnum() else f"\\x{{{ord(c):x}}}" for c in term)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))
    add = lambda a, piece: F.struct((a["at"] + F.length(piece)).cast("int").alias("at"), F.concat(a["all"], F.array(a["at"])).alias("all"))
    places = F.aggregate(F.split(low, f"(?={quoted})", -1), start, add, lambda a: a["all"])
    found = F.filter(places, lambda i: (i > 0) | low.startswith(F.lit(term)))
    found = F.when(F.contains(low, F.lit(term)), found).otherwise(F.array().cast("array<int>"))
    return F.transform(found, lambda i: F.struct(i.alias("start"), (i + len(term)).cast("int").alias("end")))


def time_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm")
