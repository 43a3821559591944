"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

The lexicon (words and word beginnings that mark toxic documents), the trees and the calibration are learned from a bounded
sample of labelled rows outside the held-out fold. Scoring is map-only and reads whole texts.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.sampling import bounded_sample, held_out
from foliant.scale import read_table, ship, sized, stash

#: Labelled documents that are learned from, classes as they come; one in CALIBRATION of them fits the calibration alone.
#: Each quarter's features come from a lexicon that the other three gave.
TRAIN_DOCS = 24_000
CALIBRATION = FOLDS = 4
#: Entries of the lexicon, least log odds, least share and number of toxic sample rows, lengths of word beginnings.
LEXICON, LOG_ODDS, SUPPORT, LEAST_ROWS, STEMS = 1000, 2.5, 0.01, 4, (8, 7, 6, 5, 4)
#: Words between a second-person pronoun and a lexicon word that count as near.
NEAR = 6
TREES, DEPTH, RATE, BINS, LEAST = 60, 3, 0.2, 32, 10
THRESHOLD = 0.3
#: Second-person words of four languages.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch euer tu te ti tus tuyo vos usted ustedes vosotros toi ton ta tes vous votre vos".split())
#: Signs that stand for letters in disguised words.
DISGUISE = str.maketrans("013457@$!|", "oieastasil")
WORD = re.compile(r"[^\W\d_]+")
DISGUISED = re.compile(r"(?<!\S)(?=\S*[^\W\d_])(?=\S*[^\W\d_][013457@$!|*]+[^\W_])[^\s]+")
FEATURES = ("words", "hits", "density", "weight", "distinct", "near", "near_rate", "disguised", "disguised_hits", "capitals", "shouts", "marks", "repeated_marks")


class Lexicon:
    def __init__(self, entries: dict[str, float]):
        """``entries``: a word, or a word beginning followed by ``*`` -> log odds."""
        self.words = {k: v for k, v in entries.items() if not k.endswith("*")}
        self.stems = {k[:-1]: v for k, v in entries.items() if k.endswith("*")}
        self.lengths = [n for n in STEMS if any(len(k) == n for k in self.stems)]

    def weight(self, w: str) -> float:
        """Log odds of the word, else of its longest beginning that is listed, else 0."""
        v = self.words.get(w)
        if v is None:
            v = next((x for n in self.lengths if len(w) >= n and (x := self.stems.get(w[:n]))), 0.0)
        return v

    def features(self, text: str | None) -> list[float]:
        text = text or ""
        words = WORD.findall(text.lower())
        n = len(words)
        found = [(i, v) for i, w in enumerate(words) if (v := self.weight(w))]
        odd = DISGUISED.findall(text)
        odd_hits = sum(bool(self.weight("".join(WORD.findall(x.lower().translate(DISGUISE))))) for x in odd)
        near = 0
        for i, _ in found:
            near += any(w in SECOND_PERSON for w in words[max(0, i - NEAR) : i + NEAR + 1])
        upper, alpha = sum(map(str.isupper, text)), sum(map(len, words))
        shouts = sum(len(w) > 2 for w in re.findall(r"\b[A-Z]{3,}\b", text))
        marks = text.count("!") + text.count("?")
        d = max(n, 1)
        return [np.log1p(n), np.log1p(len(found)), len(found) / d, sum(v for _, v in found) / d, np.log1p(len({words[i] for i, _ in found})), np.log1p(near), near / d, len(odd) / d, np.log1p(odd_hits), upper / max(alpha, 1), shouts / d, marks / d, len(re.findall(r"[!?]{2,}", text)) / d]


class Trees:
    """Logistic gradient boosting with quantile bins; deterministic."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        b = self.bin(x)
        p = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.base, self.trees = float(np.log(p / (1 - p))), []
        raw = np.full(len(y), self.base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-raw))
            tree = self.grow(b, y - p, p * (1 - p), np.arange(len(y)), DEPTH)
            self.trees.append(tree)
            raw += self.walk(tree, b)
        return self

    def bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, v, "left") for c, v in zip(self.cuts, x.T, strict=True)], 1)

    def grow(self, b, g, h, rows, depth):
        total_g, total_h = g[rows].sum(), h[rows].sum()
        best = (1e-6, None)
        if depth and len(rows) >= 2 * LEAST:
            for f in range(b.shape[1]):
                v = b[rows, f]
                cg, ch, cn = (np.cumsum(np.bincount(v, w, BINS + 1)) for w in (g[rows], h[rows], None))
                gain = cg**2 / (ch + 1) + (total_g - cg) ** 2 / (total_h - ch + 1) - total_g**2 / (total_h + 1)
                gain[(cn < LEAST) | (len(rows) - cn < LEAST)] = -1
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], (f, k))
        if best[1] is None:
            return float(RATE * total_g / (total_h + 1))
        f, k = best[1]
        left = b[rows, f] <= k
        return f, k, self.grow(b, g, h, rows[left], depth - 1), self.grow(b, g, h, rows[~left], depth - 1)

    def walk(self, tree, b):
        if isinstance(tree, float):
            return np.full(len(b), tree)
        f, k, low, high = tree
        return np.where(b[:, f] <= k, self.walk(low, b), self.walk(high, b))

    def raw(self, x: np.ndarray) -> np.ndarray:
        b = self.bin(x)
        return self.base + sum(self.walk(t, b) for t in self.trees)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: rising steps as (x, value) knots for linear interpolation."""
    at, where = np.unique(x, return_inverse=True)
    blocks: list[list[float]] = []
    for a, s, n in zip(at, np.bincount(where, y), np.bincount(where), strict=True):
        blocks.append([s, n, a, a])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            s, n, _, hi = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, blocks[-1][2], hi]
    kx = np.array([e for b in blocks for e in ((b[2], b[3]) if b[3] > b[2] else (b[2],))])
    ky = np.array([b[0] / b[1] for b in blocks for _ in range(2 if b[3] > b[2] else 1)])
    return kx, ky


class Model:
    def __init__(self, lexicon: Lexicon, trees: Trees | None, knots, prior: float):
        self.lexicon, self.trees, self.knots, self.prior = lexicon, trees, knots, prior

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.trees is None or not texts:
            return np.full(len(texts), self.prior)
        return np.clip(np.interp(self.trees.raw(np.array([self.lexicon.features(t) for t in texts])), *self.knots), 0.0, 1.0)


def _units(batches):
    for b in batches:
        for y, fold, text in zip(b.column("label").to_pylist(), b.column("fold").to_pylist(), b.column("text").to_pylist(), strict=True):
            w = set(WORD.findall((text or "").lower()))
            out = sorted(w | {f"{x[:n]}*" for x in w for n in STEMS if len(x) >= n})
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), pa.array([y] * len(out), pa.int32()), pa.array([fold] * len(out), pa.int32())], names=["unit", "label", "fold"])


def _lexicon(rows: list, sizes: dict, without: int | None) -> Lexicon:
    """The best units by log odds over all folds but one."""
    folds = [f for f in range(FOLDS) if f != without]
    n1, n0 = (sum(sizes.get((y, f), 0) for f in folds) for y in (1, 0))
    out = []
    for r in rows:
        p, q = sum(r[f"p{f}"] for f in folds), sum(r[f"q{f}"] for f in folds)
        odds = float(np.log((p + 0.5) / (n1 + 1)) - np.log((q + 0.5) / (n0 + 1)))
        if odds >= LOG_ODDS and p >= max(LEAST_ROWS, SUPPORT * n1):
            out.append((-odds, r["unit"]))
    return Lexicon({u: -o for o, u in sorted(out)[:LEXICON]})


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """From (doc_id, text) and (doc_id, toxic). Several labels of an id: the highest counts; null labels are not used.

    Without labels of both kinds every document gets the labels' mean (0 without any). Repeated rows of a labelled id are learned
    from as often as they occur; lexicon entries that tie are taken by name; other columns are not read.
    """
    ship(docs.sparkSession)
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("label"))
    known = bounded_sample(known.where(~held_out(F.col("doc_id"))).withColumn("one", F.lit(1)), "one", TRAIN_DOCS).drop("one")
    fold = F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(FOLDS)).cast("int")
    sample = stash(docs.select("doc_id", "text").join(sized(stash(known)), "doc_id").withColumn("fold", fold))
    sizes = {(r.label, r.fold): r["n"] for r in sample.groupBy("label", "fold").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = (sum(n for (y, _), n in sizes.items() if y == k) for k in (1, 0))
    if not n1 or not n0:
        return Model(Lexicon({}), None, None, 1.0 if n1 else 0.0)
    when = lambda y, f: F.count_if((F.col("label") == y) & (F.col("fold") == f))
    units = sample.select("label", "fold", "text").mapInArrow(_units, "unit string, label int, fold int")
    units = units.groupBy("unit").agg(*[when(y, f).alias(f"{k}{f}") for k, y in (("p", 1), ("q", 0)) for f in range(FOLDS)])
    p, q = (sum((F.col(f"{k}{f}") for f in range(FOLDS)), F.lit(0)) for k in "pq")
    odds = F.log((p + 0.5) / (n1 + 1.0)) - F.log((q + 0.5) / (n0 + 1.0))
    top = units.where((p >= max(LEAST_ROWS, SUPPORT * n1)) & (odds >= LOG_ODDS - 1)).orderBy(F.desc(odds), "unit").limit(4 * LEXICON).collect()
    folds = [_lexicon(top, sizes, f) for f in range(FOLDS)]
    table = sample.mapInArrow(_features(folds), "doc_id long, label int, fold int, x array<double>").toPandas().sort_values(["doc_id", "label"])
    x, y = np.array(table["x"].tolist()), table["label"].to_numpy(float)
    held = (np.arange(len(y)) % CALIBRATION == 0) if min(n1, n0) >= 20 * CALIBRATION else np.zeros(len(y), bool)
    trees = Trees().fit(x[~held], y[~held])
    on = held if held.any() else ~held  # few rows calibrate on those that the trees saw, whose lexicons are others' at least
    return Model(_lexicon(top, sizes, None), trees, isotonic(trees.raw(x[on]), y[on]), float(y.mean()))


def _features(lexicons: list[Lexicon]):
    def run(batches):
        for b in batches:
            fold = b.column("fold").to_pylist()
            x = [lexicons[f].features(t) for f, t in zip(fold, b.column("text").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), b.column("fold"), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "label", "fold", "x"])

    return run


def rate(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted) for every row of (doc_id, text): map-only, each row by itself, so repeated rows agree.

    Null and empty texts get the score of a text without words; long texts are read whole; an empty table gives no rows; other
    columns are not read, so their names can't clash.
    """
    ship(docs.sparkSession)

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                cut = b.slice(at, 256)
                s = model.score(cut.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([cut.column(0), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = rate(docs, train(docs, read_table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
