"""The n-gram Jaccard join against all pairs."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.llm import grams, op6_jaccard
from foliant.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text, k=4):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in WORD.findall(text or "")]
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(rows, k=4, percent=85):
    sets = [(i, shingle_set(t, k)) for i, t in rows]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by = defaultdict(set)
    for i, (_, s) in enumerate(sets):
        for g in s:
            by[g].add(i)
    for i, (_, s) in enumerate(sets):
        for j in {j for g in s for j in by[g] if j < i}:
            both = len(s & sets[j][1])
            if 100 * both >= percent * (len(s) + len(sets[j][1]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(s), least.get(find(i))) for i, (d, s) in enumerate(sets) if d is not None)


def near_copies(seed, n_groups=30):
    rng, rows, vocab = random.Random(seed), [], [f"w{i}" for i in range(5000)]
    for _ in range(n_groups):
        base = rng.choices(vocab, k=rng.choice([3, 5, 9, 14, 25, 40, 80, 200, 600]))
        for _ in range(rng.choice([1, 2, 3, 8])):
            w = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3, max(1, len(w) // 60), max(1, len(w) // 45)])):
                at = rng.randrange(len(w))
                w[at : at + rng.choice([0, 1, 1])] = [rng.choice(vocab)]
            rows.append((len(rows) * 3 + 1, " ".join(x.upper() if rng.random() < 0.2 else x for x in w)))
    return rows


def test_words_and_shingles():
    import pyarrow as pa

    texts = ["Éa b\tC", None, "", "x", "x", "a\x0bb  a b", "ab", "end "]
    got = []
    for row, data, starts, ends in grams.text_chunks(pa.array(texts)):
        w, c = grams.word_hashes(data, starts, ends, grams.NOT_SPACE)
        at = 0
        for n in c:
            got.append(w[at : at + n].tolist())
            at += n
    words = [[re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in WORD.findall(t or "")] for t in texts]
    assert [len(x) for x in got] == [len(x) for x in words]
    flat = [(h, w) for a, b in zip(got, words, strict=True) for h, w in zip(a, b, strict=True)]
    assert len({h for h, _ in flat}) == len({w for _, w in flat}) == len(set(flat))


def test_signatures_meet():
    rng = np.random.default_rng(5)
    for n in [*range(2, 60), 100, 333, 1000]:
        for _ in range(20):
            a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
            top = n * 15 // 185  # differing elements on each side
            k = int(rng.integers(0, top + 1))
            b = np.unique(np.concatenate([a[k:], rng.integers(0, 2**63, k, dtype=np.uint64)]))
            both = len(np.intersect1d(a, b))
            if 100 * both >= 85 * (len(a) + len(b) - both) and k:
                assert len(np.intersect1d(op6_jaccard.signatures(a), op6_jaccard.signatures(b)))


@pytest.mark.parametrize("seed", [1, 2])
def test_planted(spark, seed):
    rows = near_copies(seed)
    rows += [(5000, None), (5001, ""), (5002, rows[0][1]), (5003, rows[0][1]), (5003, rows[0][1]), (5004, "long " * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in op6_jaccard.jaccard_components(df).collect())
    assert got == brute(rows)


def test_tables(spark):
    d = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in op6_jaccard.query(spark, d).collect())
    assert got == brute(rows)


def test_odd(spark):
    df = spark.createDataFrame([], "doc_id long, text string, c1 string")
    assert op6_jaccard.jaccard_components(df).count() == 0
    one = spark.createDataFrame([(None, "a b c d e"), (4, "a b c d e"), (7, "a b c d e")], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in op6_jaccard.jaccard_components(one).collect()} == {(None, 4), (4, 4), (7, 4)}


def test_texts_without_an_id_link_others(spark):
    word = [f"w{i}" for i in range(60)]
    a, b, middle = [*word[:56], "x", "y", "z", "u"], ["p", "q", "r", "s", *word[4:]], word
    assert [len(x & y) / len(x | y) >= 0.85 for x, y in ((shingle_set(" ".join(a)), shingle_set(" ".join(middle))), (shingle_set(" ".join(a)), shingle_set(" ".join(b))))] == [True, False]
    rows = [(1, " ".join(a)), (2, " ".join(b)), (None, " ".join(middle)), (None, " ".join(middle)), (None, "alone in its class here"), (7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", F.lit("clash")).withColumn("rep", F.lit(1))
    got = [(r.doc_id, r.component_id) for r in op6_jaccard.jaccard_components(df).collect()]
    assert sorted(got, key=str) == sorted([(1, 1), (2, 1), (None, 1), (None, 1), (None, None), (7, 7)], key=str)


@pytest.mark.parametrize("limit", [None, 0])
def test_hubs(spark, monkeypatch, limit):
    if limit is not None:
        monkeypatch.setattr("foliant.scale.BROADCAST_BYTES", limit)
    star = [(1000, i) for i in range(400)] + [(2000, 399), (2000, 2001)]
    got = {r.node: r.label for r in components(spark.createDataFrame(star, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(400)}, 1000: 0, 2000: 0, 2001: 0}


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges for x in e}
    for _ in range(100):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {k: v for k, v in root.items() if any(a != b and k in (a, b) for a, b in edges)}


def test_residual_blocks(spark, monkeypatch):
    monkeypatch.setattr(op6_jaccard, "BLOCK", 3)
    rows = near_copies(9, 12)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in op6_jaccard.jaccard_components(df).collect())
    assert got == brute(rows)


def test_all_links_are_counted(spark, monkeypatch):
    monkeypatch.setattr(op6_jaccard, "BLOCK", 5)
    word = [f"w{i}" for i in range(200)]
    alike = [" ".join([*word[:k], f"x{k}", *word[k + 1 :]]) for k in range(10, 190, 15)]
    rows = [*near_copies(4, 15), *[(9000 + i, t) for i, t in enumerate([*alike, alike[0]])], (9990, None), (9991, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.n_links for r in op6_jaccard.jaccard_components(df, count_links=True).collect()}
    sets = {i: shingle_set(t) for i, t in rows}

    def links(s):
        return sum(s != o and 100 * len(s & o) >= 85 * len(s | o) for o in set(sets.values()) if s and o)

    assert got == {i: links(s) for i, s in sets.items()}
    assert {got[9000 + i] for i in range(13)} == {11}
