"""Decontamination against a plain scan."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from foliant.llm import op9_decontamination as op9

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    grams = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            grams.setdefault(tuple(w[k : k + 10]), set()).add(str(i))
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(g) for g in grams}:
            for k in range(len(w) - n + 1):
                if (g := tuple(w[k : k + n])) in grams:
                    hit |= set(range(k, k + n))
                    found |= grams[g]
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("slice_bytes", [1 << 25, 600])
def test_tables(spark, monkeypatch, slice_bytes):
    monkeypatch.setattr(op9, "QUERY_BYTES", slice_bytes)
    d = "/root/testdata/sf0.01" if slice_bytes > 1000 else "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    got = sorted([tuple(r) for r in op9.query(spark, d).collect()], key=str)
    assert got == brute(docs, items)
    assert any(r[-1] for r in got)


@pytest.mark.parametrize("joined", [False, True])
def test_odd(spark, monkeypatch, joined):
    long = " ".join(f"t{i % 977}" for i in range(60000))
    items = [(1, "alpha beta gamma"), (2, None), (3, ""), (10, "a a a a a a a a a a a a"), (4, "Été, NAÏVE x1"), (5, " ".join(f"t{i}" for i in range(900, 930)))]
    docs = [(1, "x alpha-BETA, gamma. alpha beta gamma"), (2, None), (3, ""), (4, "a " * 25), (4, "a " * 25), (5, "été naïve x1 Été"), (6, long), (None, "alpha beta gamma"), (7, "alpha beta"), (8, "gamma alpha beta")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    it = spark.createDataFrame(items, "item_id long, text string")
    for name in ("spans", "items", "n_hit", "block", "terms", "item", "win"):
        df, it = df.withColumn(name, F.lit("clash")), it.withColumn(name, F.lit("clash"))
    if joined:
        monkeypatch.setattr(op9, "QUERY_BYTES", 0)
        monkeypatch.setattr(op9, "GROUP", 3)
    got = op9.contamination(df, it).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
    assert sorted(map(tuple, got), key=str) == brute(docs, items)
    assert op9.contamination(df.where("false"), it).count() == 0
    assert op9.contamination(df, it.where("false")).where("contaminated").count() == 0


def test_phrases_and_proximity(spark):
    docs = [(1, "the quick brown fox jumps"), (2, "quick the fox was brown"), (3, "brown " + "x " * 30 + "quick"), (4, "quick brown quick brown")]
    index = op9.build_index(spark.createDataFrame(docs, "doc_id long, text string"))
    rows = op9.phrase_matches(index, ["Quick brown", "missing", ""], slop=2).collect()
    assert {(r.doc_id, r.position) for r in rows if r.exact} == {(1, 1), (4, 0), (4, 2)}
    assert {r.doc_id for r in rows if not r.exact} == {1, 2, 4}
    stats = op9.term_statistics(index).agg({"n_words": "sum"}).first()[0]
    assert stats == sum(len(words(t)) for _, t in docs)
