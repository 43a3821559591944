"""Language identification by language-bitmask n-gram filters.

Each language's characteristic character n-grams are put into Bloom filters of one shape, stored bit-sliced: position p holds a
bitmask of the languages whose filter has bit p. One lookup per hash, and an AND, gives all languages that contain an n-gram.
Per-language popcounts over a text, corrected for each filter's false-positive rate, decide.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.llm import grams
from foliant.llm.sampling import bounded_sample, held_out
from foliant.scale import read_table, ship, stash

#: Characters of the n-grams; a boundary counts as a character at either end.
SIZES = (3, 4, 5)
#: Labelled documents per language that are learned from, and n-grams stored per language.
TRAIN_DOCS = 1500
TRAIN_GRAMS = 30_000
#: A language's n-gram occurs in this many of its sample documents, and at this share of the best language's rate.
LEAST_DOCS = 2
RATE_SHARE = 0.3
POSITIONS = 1 << 20
HASHES = 3
UNKNOWN = "und"


@functools.cache
def letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def text_grams(text: str | None) -> np.ndarray:
    """Hashes of all n-grams of the text's words, with repeats; empty if it has no letter."""
    if not text:
        return np.zeros(0, np.uint64)
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters()[np.minimum(c, 0x10FFFF)]
    if not is_letter.any():
        return np.zeros(0, np.uint64)
    c = np.concatenate([[0], np.where(is_letter, c, 0), [0]]).astype(np.uint64)
    c = c[np.append(True, (c[1:] != 0) | (c[:-1] != 0))]
    inside = c != 0
    out = []
    for n in SIZES:
        k = len(c) - n + 1
        if k <= 0:
            continue
        h, ok = np.full(k, n, np.uint64), np.ones(k, bool)
        for j in range(n):
            h = h * np.uint64(0x100000001B3) + c[j : j + k]
            if 0 < j < n - 1:
                ok &= inside[j : j + k]
        out.append(h[ok])
    return grams.mix(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def slots(h: np.ndarray, i: int) -> np.ndarray:
    step = (h >> np.uint64(32)) | np.uint64(1)
    return ((h + np.uint64(i) * step) & np.uint64(POSITIONS - 1)).astype(np.int64)


class Filters:
    """The bit-sliced filters of several languages."""

    def __init__(self, stored: dict[str, np.ndarray], usual: dict[str, float] | None = None):
        self.stored, self.languages = {k: frozenset(v.tolist()) for k, v in stored.items()}, sorted(stored)
        self.words = max(1, -(-len(self.languages) // 64))
        self.bits = np.zeros((POSITIONS, self.words), np.uint64)
        for k, lang in enumerate(self.languages):
            for i in range(HASHES):
                self.bits[np.unique(slots(stored[lang], i)), k // 64] |= np.uint64(1 << (k % 64))
        fill = np.array([((self.bits[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean() for k in range(len(self.languages))])
        self.false = np.minimum(fill**HASHES, 0.999)
        self.usual = np.array([(usual or {}).get(x, 1.0) for x in self.languages])

    def masks(self, h: np.ndarray) -> np.ndarray:
        """Bitmask of the languages that (may) contain each n-gram."""
        out = self.bits[slots(h, 0)]
        for i in range(1, HASHES):
            out = out & self.bits[slots(h, i)]
        return out

    def rates(self, h: np.ndarray) -> np.ndarray:
        """Per language the share of n-grams that its filter contains, without the false positives to expect."""
        counts = np.zeros(len(self.languages))
        masks = self.masks(h)
        for w in range(self.words):
            value, n = np.unique(masks[:, w], return_counts=True)
            for k in range(64 * w, min(64 * w + 64, len(self.languages))):
                counts[k] = n[(value >> np.uint64(k % 64)) & np.uint64(1) == 1].sum()
        return np.maximum(0, (counts / len(h) - self.false) / (1 - self.false))

    def decide(self, h: np.ndarray) -> tuple[str, float]:
        """(language, score): the highest rate relative to what is usual in the language; first by name on ties."""
        if not len(h) or not len(self.languages):
            return UNKNOWN, 0.0
        r = self.rates(h) / self.usual
        best = int(np.argmax(r))
        return self.languages[best], float(r[best] / r.sum()) if r.sum() > 0 else 1.0 / len(r)


def _sample_grams(batches):
    for b in batches:
        for lang, text in zip(b.column("label").to_pylist(), b.column("text").to_pylist(), strict=True):
            h = np.unique(text_grams(text))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(h), pa.string()), pa.array(h.view(np.int64))], names=["label", "gram"])


def train(docs: DataFrame) -> Filters:
    """Filters from (doc_id, text, lang) rows outside the held-out fold: a sample bounded per language, n-grams bounded too.

    Rows without an id or a language are not learned from; repeated rows are chosen and counted together; n-grams of one rate
    are taken by hash; an empty table gives filters of no language, which call every text ``und``.
    """
    ship(docs.sparkSession)
    known = docs.where("lang is not null and doc_id is not null").where(~held_out(F.col("doc_id"))).select("doc_id", "text", F.col("lang").alias("label"))
    sample = stash(bounded_sample(known, "label", TRAIN_DOCS))
    counts = sample.select("label", "text").mapInArrow(_sample_grams, "label string, gram long").groupBy("gram", "label").agg(F.count(F.lit(1)).alias("n"))
    sizes = {r.label: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    per_gram = counts.where(F.col("n") >= LEAST_DOCS).groupBy("gram").agg(F.collect_list(F.struct("label", "n")).alias("by"))
    drawn = F.create_map(*[x for k, v in sizes.items() for x in (F.lit(k), F.lit(float(min(v, TRAIN_DOCS))))]) if sizes else F.create_map().cast("map<string,double>")
    rate = F.transform("by", lambda x: F.struct(x["label"].alias("label"), (x["n"] / F.try_element_at(drawn, x["label"])).alias("rate")))
    rates = per_gram.select("gram", rate.alias("by")).withColumn("top", F.array_max(F.transform("by", lambda x: x["rate"])))
    flat = rates.select("gram", "top", F.explode("by").alias("x")).where(F.col("x.rate") >= RATE_SHARE * F.col("top")).select("gram", F.col("x.label").alias("label"), F.col("x.rate").alias("rate"))
    best = Window.partitionBy("label").orderBy(F.desc("rate"), "gram")  # the window's limit holds in each task before rows move
    top = flat.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= TRAIN_GRAMS).select("label", "gram").toPandas()
    stored = {lang: np.zeros(0, np.uint64) for lang in sizes}  # at most TRAIN_GRAMS numbers each reach the driver
    stored |= {lang: g["gram"].to_numpy(np.int64).view(np.uint64) for lang, g in top.groupby("label")}
    first = Filters(stored)
    usual = sample.select("label", "text").mapInArrow(_own_rates(first), "label string, rate double").groupBy("label").agg(F.avg("rate").alias("rate")).collect()
    return Filters(stored, {r.label: max(r.rate, 1e-3) for r in usual})


def _own_rates(filters: Filters):
    at = {x: i for i, x in enumerate(filters.languages)}

    def run(batches):
        for b in batches:
            out = [(lang, filters.rates(h)[at[lang]]) for lang, t in zip(b.column("label").to_pylist(), b.column("text").to_pylist(), strict=True) if len(h := text_grams(t))]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([float(x[1]) for x in out], pa.float64())], names=["label", "rate"])

    return run


def identify(docs: DataFrame, filters: Filters) -> DataFrame:
    """(doc_id, lang_pred, score) for every row of (doc_id, text): map-only, each row by itself, so repeated rows agree.

    ``und`` and 0 for a null text or one without letters; of languages that tie the first by name; long texts are read whole; an
    empty table gives no rows; other columns are not read, so their names can't clash.
    """
    ship(docs.sparkSession)

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                cut = b.slice(at, 256)
                out = [filters.decide(text_grams(t)) for t in cut.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([cut.column(0), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = identify(docs, train(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
