"""Fill-in-middle against a plain version on strings, and the chunk machinery against whole-text scans."""

import hashlib
import re

import numpy as np
from pyspark.sql import functions as F

from foliant.llm import op11_infill as op

KIND = "doc_id long, text string"
LONG = "añb 字\U0001f600 c\n" * 3000
ODD = [(1, None), (2, ""), (3, "a"), (4, "é"), (5, "holds <S> already"), (6, LONG), (7, "same text twice " * 5), (7, "same text twice " * 5), (None, "no key at all, but some words"), (8, "< <P <S <<M" * 30), (9, "\U0001f600" * 5000)]


def plain_version(key, text, seed=1):
    h = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    t = text or ""
    n = len(t)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, t
    p, m, s = t[:a], t[a:b], t[b:]
    form = "spm" if h[3] % 100 < 20 else "psm"
    return n, form, a, b - a, f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def test_infill_is_the_plain_version(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame(ODD, KIND))
    forms = set()
    for chunk in (1, 7, op.CHUNK):
        made = op.infill(docs.withColumn("form", F.lit("clash")).withColumn("extra", F.lit(1)), chunk=chunk)
        assert made.columns == ["doc_id", "text", "extra", "n", "form", "prefix_units", "middle_units", "output"]
        for r in made.withColumn("back", op.restore(F.col("output"), F.col("form"))).collect():
            assert (r.n, r.form, r.prefix_units, r.middle_units, r.output) == plain_version(r.doc_id, r.text)
            assert r.back == (r.text or "")
            forms.add(r.form)
    assert forms == {"plain", "psm", "spm"}
    assert op.infill(docs.where("false")).count() == 0
    assert op.query(spark, sf).count() == 200


def test_words_and_lines(spark):
    texts = [" two  words\nthen three more \n", "one", "\n\n", LONG]
    for unit, begins in (("word", r"^|(?<=[ \t-\r])(?![ \t-\r])."), ("line", r"^|(?<=\n)(?=.|\n)")):
        for t in texts:
            data = t.encode()
            starts = [m.start() for m in re.finditer(begins.encode(), data, re.S) if m.start() < len(data)]
            for chunk in (1, 3, 4096):
                n, ranks, places = op.locate(np.frombuffer(data, np.uint8), np.array([0, len(data)]), [np.array([len(starts) // 2]), np.array([len(starts)])], unit, chunk)
                assert n[0] == len(starts)
                assert [p[0] for p in places] == [starts[len(starts) // 2], len(data)]


def test_only_the_owning_chunks_are_scanned_again(monkeypatch):
    data = np.frombuffer(LONG.encode(), np.uint8)
    offsets = np.array([0, len(data)])
    seen = []
    begins = op._begins
    monkeypatch.setattr(op, "_begins", lambda d, lo, hi, first, unit: seen.append(hi - lo) or begins(d, lo, hi, first, unit))
    monkeypatch.setattr(op, "BLOCK", 64)
    op.locate(data, offsets, [np.array([5]), np.array([20_000])], "char", 64)
    assert max(seen) <= 64
    assert sum(seen) <= len(data) + 2 * 64


def test_nothing_is_shuffled(spark, sf):
    plan = op.infill(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("ArrowEvalPython") == 1
