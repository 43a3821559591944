"""Token counts, language, toxicity, URL and template operators against plain versions or held-out rows."""

import functools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from foliant.llm import op2_tokens, op5_language, op7_toxicity, op8_urls, op10_templates
from tests.llm.test_native_ops import brute_classes

BIG = "/root/testdata/sf0.01"
ODD = [(1, None), (2, ""), (3, "!!! 123"), (4, "a"), (5, "word " * 20000), (6, "x" * 5000), (7, "naïve Été  \n\n ok"), (7, "naïve Été  \n\n ok"), (None, "the end of it")]


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def plain_tokens(text, scores, longest):
    n = 0
    for w, k in Counter(regex.findall(op2_tokens.PATTERN, text or "")).items():
        s = w.encode()
        best = [(0.0, 0)] + [(-math.inf, 0)] * len(s)
        for e in range(1, len(s) + 1):
            best[e] = max(((best[b][0] + scores[s[b:e]], best[b][1] - 1) for b in range(max(0, e - longest), e) if s[b:e] in scores), default=(-math.inf, 0))
        n += k * -best[-1][1]
    return n


def test_token_counts(spark, monkeypatch):
    scores = op2_tokens.load_vocabulary(op2_tokens.default_vocabulary())
    longest = max(map(len, scores))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(60).unionByName(spark.createDataFrame(ODD, "doc_id long, text string"))
    rows = docs.collect()
    want = sorted((str(r.doc_id), plain_tokens(r.text, scores, longest)) for r in rows)
    assert sorted((str(r.doc_id), r.n_tokens) for r in op2_tokens.token_counts(docs).collect()) == want
    trie = op2_tokens.CountTrie({b"a": -1.0, b"b": -1.0, b"ab": -1.5, b"ba": -5.0})
    assert [trie.tokens(x) for x in (b"ab", b"aba", b"abab", b"", b"abc")] == [1, 2, 2, 0, 3]
    assert op2_tokens.token_counts(docs.where("false")).count() == 0


def test_language(spark):
    docs = spark.read.parquet(f"{BIG}/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = op5_language.query(spark, BIG).collect()
    assert len(rows) == len(lang) and all(0 <= r.score <= 1 and r.held_out == held(r.doc_id) for r in rows)
    test = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in test) >= 0.97 * len(test)
    filters = op5_language.train(docs.withColumn("label", F.lit("clash")).withColumn("gram", F.lit(1)))
    odd = spark.createDataFrame(ODD, "doc_id long, text string")
    got = {r.doc_id: r.lang_pred for r in op5_language.identify(odd, filters).collect()}
    assert len(got) == 8 and got[1] == got[2] == got[3] == "und" and got[None] == "en"
    # A plain version: one set of n-grams a language, the share of a text's n-grams in it against the language's usual share.
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    usual = dict(zip(filters.languages, filters.usual, strict=True))
    for r in rows[:: len(rows) // 150]:
        g = op5_language.text_grams(texts[r.doc_id]).tolist()
        if not g:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        share = {k: sum(x in filters.stored[k] for x in g) / len(g) / usual[k] for k in usual}
        best = sorted(share.values())[-2:]
        assert sum(share.values()) == 0 or abs(r.score - max(share.values()) / sum(share.values())) < 0.02
        assert best[1] - best[0] < 0.02 or r.lang_pred == max(share, key=share.get)
    # Bit-sliced lookups against one plain set a language.
    sets = {"x": np.arange(1, 4000, dtype=np.uint64), "y": np.arange(3000, 9000, dtype=np.uint64)}
    sets = {k: op5_language.grams.mix(v) for k, v in sets.items()}
    f = op5_language.Filters(sets)
    assert all(((f.masks(v)[:, 0] >> np.uint64(k)) & np.uint64(1)).all() for k, v in enumerate(sets.values()))
    other = op5_language.grams.mix(np.arange(10**6, 2 * 10**6, dtype=np.uint64))
    assert f.rates(other).max() < 1e-3
    many = op5_language.Filters({f"l{i:03}": op5_language.grams.mix(np.arange(i * 100, i * 100 + 100, dtype=np.uint64)) for i in range(130)})
    assert many.decide(op5_language.grams.mix(np.arange(7050, 7090, dtype=np.uint64)))[0] == "l070"
    empty = op5_language.train(docs.where("false"))
    assert empty.decide(op5_language.text_grams("abc")) == ("und", 0.0)
    assert op5_language.identify(odd.where("false"), filters).count() == 0


def test_toxicity(spark):
    d = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = op7_toxicity.query(spark, d).collect()
    assert len(rows) == 10_000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out == held(r.doc_id) for r in rows)
    test = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(y == p for y, p in test) >= 0.98 * len(test)
    assert sum(y and p for y, p in test) >= 0.9 * sum(y for y, _ in test)
    docs = spark.createDataFrame(ODD, "doc_id long, text string")
    none = op7_toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.score for r in op7_toxicity.rate(docs, none).collect()} == {0.0}
    both = spark.createDataFrame([(1, 0), (5, 1)], "doc_id long, toxic int").withColumn("label", F.lit("clash"))
    model = op7_toxicity.train(docs.withColumn("fold", F.lit("clash")).withColumn("toxic", F.lit("clash")), both)
    twice = [tuple(r) for r in op7_toxicity.rate(docs.withColumn("score", F.lit("clash")), model).collect() if r.doc_id == 7]
    assert len(twice) == 2 and twice[0] == twice[1]
    assert op7_toxicity.rate(docs.where("false"), model).count() == 0
    assert {r.score for r in op7_toxicity.rate(docs, op7_toxicity.train(docs.where("false"), both)).collect()} == {0.0}
    x, y = op7_toxicity.isotonic(np.array([1.0, 2, 2, 3, 4, 5]), np.array([0.0, 1, 0, 0, 1, 1]))
    assert (np.diff(y) >= 0).all() and (np.diff(x) > 0).all()
    assert np.interp([1, 2.5, 5], x, y) == pytest.approx([0, 1 / 3, 1])


def plain_raw(tree, row):
    while not isinstance(tree, float):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def test_toxicity_scores_follow_the_trees(spark):
    """Each document's score from its features, tree by tree and knot by knot."""
    d = BIG
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    model = op7_toxicity.train(docs, spark.read.parquet(f"{d}/labels.parquet"))
    text = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r.score for r in op7_toxicity.rate(docs, model).collect()}
    kx, ky = model.knots
    for i in sorted(got)[::9]:
        x = model.lexicon.features(text[i])
        words = re.findall(r"[^\W\d_]+", (text[i] or "").lower())
        hits = [w for w in words if model.lexicon.weight(w)]
        assert x[0] == pytest.approx(math.log1p(len(words))) and x[1] == pytest.approx(math.log1p(len(hits)))
        row = [sum(v > c for c in cuts) for v, cuts in zip(x, model.trees.cuts, strict=True)]
        raw = model.trees.base + sum(plain_raw(t, row) for t in model.trees.trees)
        k = int(np.searchsorted(kx, raw))
        want = ky[0] if k == 0 else ky[-1] if k == len(kx) else ky[k - 1] + (ky[k] - ky[k - 1]) * (raw - kx[k - 1]) / (kx[k] - kx[k - 1])
        assert got[i] == pytest.approx(min(max(want, 0), 1), abs=1e-9)


def plain_url(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"(?s)[^/?#]*", rest)[0]
    path = re.match(r"(?s)[^?#]*", rest[len(host) :])[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def plain_rule(host, path):
    best = None
    for verdict, rule in op8_urls.RULES:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return best or (None, None)


def plain_model(rows):
    counts = defaultdict(lambda: [0, 0])
    for text, accepted in rows:
        s = op8_urls.START * (op8_urls.ORDER - 1) + text
        for i in range(op8_urls.ORDER - 1, len(s)):
            for k in range(1, op8_urls.ORDER + 1):
                counts[s[i - k + 1 : i + 1]][not accepted] += 1
    context = defaultdict(lambda: [0, 0])
    for g, (a, r) in counts.items():
        context[len(g), g[:-1]][0] += a
        context[len(g), g[:-1]][1] += r
    stored = {g for g, v in counts.items() if sum(v) >= 2}

    @functools.cache
    def p(g, c):
        if len(g) == 1:
            return (counts[g][c] + 1) / (context[1, ""][c] + op8_urls.ALPHABET)
        return (counts[g][c] + op8_urls.BACKOFF * p(g[1:], c)) / (context[len(g), g[:-1]][c] + op8_urls.BACKOFF)

    return {g: math.log(p(g, 0) / p(g, 1)) for g in stored}


def test_urls(spark):
    rows = [(r.page_id, r.url) for r in spark.read.parquet(f"{BIG}/pages.parquet").collect()]
    rows += [(-1, None), (-2, "no scheme"), (-3, "http://"), (-4, "ftp://EXAMPLE.com/en/x?y#z"), (-5, "https://www.Example.com/en/"), (-6, "http://com"), (-7, "http://xcom/a"), (-8, "http://a.net/es"), (-9, "http://x.org/é?://q"), (-9, "http://x.org/é?://q"), (-10, "http://h.net/fr/" + "a" * 9000)]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("rule", F.lit("clash"))
    got = op8_urls.judge(df).collect()
    assert len(got) == len(rows)
    url = dict(rows)
    text = lambda u: (u or "").lower()
    for r in got:
        assert (r.host, r.path) == plain_url(url[r.page_id])
        verdict, rule = plain_rule(r.host, r.path)
        assert r.rule == rule and r.verdict in ("allow", "block") and (verdict is None or r.verdict == verdict)
    t = op8_urls.apply_rules(df).withColumn("url_text", F.lower(F.coalesce("url", F.lit(""))))
    fold = {r.page_id: r.h for r in t.select("page_id", (F.pmod(F.xxhash64("url_text"), F.lit(op8_urls.FOLDS)) == 0).alias("h")).collect()}
    lab = [(i, text(u), plain_rule(*plain_url(u))[0] == "allow") for i, u in rows if plain_rule(*plain_url(u))[0]]
    model = plain_model([(s, a) for i, s, a in lab if not fold[i]])

    def score(s):
        padded = op8_urls.START * (op8_urls.ORDER - 1) + s
        out = []
        for i in range(op8_urls.ORDER - 1, len(padded)):
            out.append(next((model[g] for k in range(op8_urls.ORDER, 0, -1) if (g := padded[i - k + 1 : i + 1]) in model), 0.0))
        return sum(out) / len(out) if out else 0.0

    assert all(r.score == pytest.approx(score(text(url[r.page_id])), abs=1e-9) for r in got)
    cal = [(score(s), a) for i, s, a in lab if fold[i]]
    na, nr = sum(a for _, a in cal), sum(not a for _, a in cal)
    assert na and nr
    cut = min((sum(a and math.floor(x * 100) < c for x, a in cal) / na + sum(not a and math.floor(x * 100) >= c for x, a in cal) / nr, abs(c), c) for c in range(-1000, 1002))[2] / 100
    assert all(r.verdict == ("allow" if r.score >= cut else "block") for r in got if r.rule is None and abs(r.score - cut) > 1e-9)
    assert op8_urls.judge(df.where("false")).count() == 0
    lone = spark.createDataFrame([(1, "http://a.org/x")], "page_id long, url string")
    assert op8_urls.judge(lone).first().verdict == "allow"


def test_url_grams_of_large_tables(spark, monkeypatch):
    rare = spark.createDataFrame([("qzx", True), ("qzx", True)], "url_text string, accepted boolean")
    many = spark.range(2000).select(F.repeat(F.lit("ab"), 400).alias("url_text"), (F.col("id") % 2 == 0).alias("accepted"))
    model = op8_urls.train(many.unionByName(rare))  # 1.6 million characters
    assert {"q", "qz", "qzx"} <= {r.gram for r in model.collect()}
    urls = spark.createDataFrame([(1, "qzx"), (2, "abab"), (3, ""), (3, "")], "page_id long, url_text string")
    found = lambda: sorted((r.page_id, r.score) for r in op8_urls.score(urls, model, ["page_id"]).collect())
    want = found()
    monkeypatch.setattr("foliant.scale.BROADCAST_BYTES", 0)  # as if too large to broadcast
    assert [i for i, _ in want] == [1, 2, 3, 3] and [x for _, x in found()] == pytest.approx([x for _, x in want])


def mask(line):
    flat = re.sub(r"[\x20\x09-\x0D]+", " ", line).strip(" ")
    return re.sub(r"[^ ]*[0-9][^ ]*", "<*>", flat)


def plain_templates(rows):
    leaf_docs, held_lines = defaultdict(set), defaultdict(set)
    leaf = lambda m: (len(m), *m[:2])
    for _, t in rows:
        for x in (t or "").split("\n"):
            m = tuple(mask(x).split(" "))
            if m != ("",):
                leaf_docs[leaf(m)].add(t)
                held_lines[m].add(t)
    held_lines = {m: d for m, d in held_lines.items() if len(leaf_docs[leaf(m)]) >= 10}
    count = Counter()
    for m, d in held_lines.items():
        for i, w in enumerate(m):
            if w != "<*>":
                count[leaf(m), i, w] += len(d)
    docs, template = defaultdict(set), {}
    for m, d in held_lines.items():
        fixed = tuple((i, w) for i, w in enumerate(m) if count[leaf(m), i, w] >= 10)
        if len(fixed) >= 0.6 * len(m):
            template[m] = (leaf(m), fixed)
            docs[template[m]] |= d
    label = brute_classes({t for d in docs.values() for t in d if len(d) >= 10})
    drop = {m for m, t in template.items() if len(docs[t]) >= 10 and len({label[x] for x in docs[t]}) >= 10}
    out = []
    for i, t in rows:
        ls = (t or "").split("\n")
        gone = [x for x in ls if tuple(mask(x).split(" ")) in drop]
        out.append((i, t if not gone else "\n".join(x for x in ls if x not in gone), sum(bool(x.strip("\t\n\x0b\x0c\r ")) for x in ls), len(gone), sum(len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in gone)))
    return sorted(out, key=str)


def test_templates(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{BIG}/documents.parquet").collect()]
    got = sorted((tuple(r) for r in op10_templates.query(spark, BIG).collect()), key=str)
    assert got == plain_templates(rows)
    log = [(1000 + i, f"unique start {'abcdefghijklmnopq'[i]}{i}\nuser u{i} logged in from host{i} today\nplain line number {'abcdefghijklmnopq'[i]}") for i in range(17)]
    body = [" ".join(f"b{chr(97 + k)}{chr(97 + j)}" for j in range(12)) for k in range(10)]
    near = ["\n".join([*body[: i % 10], body[i % 10] + f" changed {i}", *body[i % 10 + 1 :]]) for i in range(40)]
    short = [(4000 + i, f"{' '.join(f'own{chr(97 + i)}{chr(97 + j)}' for j in range(20))}\nMenu\nHome page\nAll rights reserved.") for i in range(12)]
    rows = [*ODD, *log, *[(2000 + i, "copied text that recurs only as one text") for i in range(30)], *[(3000 + i, t) for i, t in enumerate(near)], *short]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("n_lines", "n_dropped", "dropped_words", "h", "leaf", "template", "key", "text_hash"):
        df = df.withColumn(name, F.lit("clash"))
    got = sorted((tuple(r) for r in op10_templates.drop_recurrent(df).select("doc_id", "text", "n_lines", "n_dropped", "dropped_words").collect()), key=str)
    assert got == plain_templates(rows)
    by = {r[0]: r for r in got}
    assert all(by[1000 + i][3] >= 1 for i in range(17)) and all(by[2000 + i][3] == 0 for i in range(30))
    assert all(by[3000 + i][3] == 0 for i in range(40)) and all(by[4000 + i][3] == 3 for i in range(12))
    assert op10_templates.drop_recurrent(df.where("false")).count() == 0
