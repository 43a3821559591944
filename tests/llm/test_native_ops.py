"""Sharding, mixing and quality rules against plain versions."""

import hashlib
import re
import time
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from foliant.llm import op1_sharding, op3_mixing, op4_quality, op10_templates

DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, "one line here\none line here", "en", "a", 27),
    (3, "one line here\none line here", "en", "a", 27),
    (4, "x " * 5000, "de", "b", 10000),
    (5, "w" * 40000, "de", None, 40000),
    (None, "id is null", "fr", "c", 10),
]


def test_hilbert_is_a_curve(spark):
    for n, bits in ((2, 3), (3, 2), (3, 3)):
        cells = [tuple((i >> (bits * k)) & ((1 << bits) - 1) for k in range(n)) for i in range(1 << (bits * n))]
        df = spark.createDataFrame([(list(c),) for c in cells], "x array<int>")
        got = sorted((r.h, tuple(r.x)) for r in df.select("x", op1_sharding.hilbert_index(F.col("x"), n, bits).alias("h")).collect())
        assert [h for h, _ in got] == list(range(len(cells)))
        assert all(sum(abs(a - b) for a, b in zip(x, y, strict=True)) == 1 for (_, x), (_, y) in zip(got, got[1:], strict=False))


def test_shards_follow_the_curve(spark, sf):
    """Shards hold runs of the curve: its index never falls from one shard to the next. And every column of the contract."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    t = docs.withColumn("cell", op1_sharding.curve_cells(docs))
    cell = {r.doc_id: r.cell for r in t.select("doc_id", "cell").collect()}
    coords = {c: [(c >> (5 * (2 - i))) & 31 for i in range(3)] for c in set(cell.values())}
    df = spark.createDataFrame([(c, v) for c, v in coords.items()], "cell int, x array<int>")
    curve = {r.cell: r.h for r in df.select("cell", op1_sharding.hilbert_index(F.col("x"), 3, 5).alias("h")).collect()}
    rows = op1_sharding.query(spark, sf).collect()
    placed = sorted((r.shard, r.slot, curve[cell[r.doc_id]]) for r in rows)
    assert [c for *_, c in placed] == sorted(curve[cell[r.doc_id]] for r in rows)
    text = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    assert all((r["size"], r.text_crc32, r.law, r.grown_shard) == (len(text[r.doc_id]) + 16, zlib.crc32(text[r.doc_id]), "rows", None) for r in rows)


def test_whole_curve_is_fast(spark):
    cells = spark.range(1 << 15).select(F.array(*[F.shiftright("id", 5 * i).bitwiseAND(F.lit(31)).cast("int") for i in range(3)]).alias("x")).coalesce(1)
    began = time.time()
    got = sorted((r.h, tuple(r.x)) for r in cells.select("x", op1_sharding.hilbert_index(F.col("x"), 3, 5).alias("h")).collect())
    assert time.time() - began < 20
    assert [h for h, _ in got] == list(range(1 << 15))
    assert all(sum(abs(a - b) for a, b in zip(x, y, strict=True)) == 1 for (_, x), (_, y) in zip(got, got[1:], strict=False))


def _check_shards(rows, n, shards):
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert sum(map(len, by.values())) == n
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    counts = [len(by.get(s, [])) for s in range(shards)]
    assert max(counts) - min(counts) <= 1


def test_sharding(spark, sf, tmp_path):
    rows = op1_sharding.query(spark, sf).collect()
    _check_shards(rows, 200, 40)
    odd = spark.createDataFrame(ODD, DOC).withColumn("shard", F.lit("clash"))
    _check_shards(op1_sharding.hilbert_shards(odd, 3).collect(), len(ODD), 3)
    assert op1_sharding.hilbert_shards(odd.where("false"), 3).count() == 0
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    done = op1_sharding.hilbert_shards(docs, 10)
    op1_sharding.write_shards(done, str(tmp_path / "w"))
    manifest = spark.read.parquet(str(tmp_path / "w/manifest"))
    hit = {r.shard for r in op1_sharding.prune_shards(manifest, lang=("fr", "fr")).collect()}
    have = {r.shard for r in done.where("lang = 'fr'").collect()}
    assert have <= hit and len(hit) < 10


def test_rows_without_an_id_are_dealt_out(spark, monkeypatch):
    """A third of all rows in one cell without an id: no bucket, so no window task, has more than a few of them."""
    df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), F.lit("en").alias("lang"), F.lit("a").alias("source"), F.lit(9).cast("long").alias("n_chars"))
    seen = []
    real = op1_sharding.prefix_offsets
    monkeypatch.setattr(op1_sharding, "prefix_offsets", lambda t, group, weight, ties, seed, out: seen.append(t.groupBy(group, F.pmod(F.xxhash64(F.lit(seed), *ties), F.lit(64)).alias("b")).count().agg(F.max("count")).first()[0]) or real(t, group, weight, ties, seed, out))
    _check_shards(op1_sharding.hilbert_shards(df, 7).collect(), 3000, 7)
    assert seen[0] < 3 * 3000 / 64


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        free = sum(w[s] for s in order if s not in capped)
        t = {s: 3.0 * sizes[s] if s in capped else left * w[s] / free for s in order}
        new = {s for s in order if s not in capped and t[s] > 3 * sizes[s]}
        if not new:
            return t
        capped |= new


def test_mixing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    text = {r.doc_id: (r.source, len(WORD.findall(r.text or ""))) for r in docs.collect()}
    sizes = Counter()
    for s, n in text.values():
        sizes[s] += n
    want = brute_targets(sizes)
    rows = op3_mixing.query(spark, sf).collect()
    assert len(rows) == len(text)
    took = Counter()
    for r in rows:
        assert (r.source, r.size) == text[r.doc_id] and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 3 * r.size
        took[r.source] += r.taken
    assert all(abs(took[s] - want[s]) <= max(3, 0.02 * want[s]) for s in want)
    again = {r.doc_id: r.taken for r in op3_mixing.query(spark, sf).collect()}
    assert again == {r.doc_id: r.taken for r in rows}


def test_mixing_odd(spark):
    df = spark.createDataFrame(ODD, DOC).withColumn("size", op3_mixing.word_count(F.col("text"))).select("doc_id", "source", "size")
    rows = op3_mixing.mix(df).collect()
    assert len(rows) == len(ODD) and all(0 <= r.taken <= 3 * r["size"] for r in rows)
    clash = df
    for name in (*op3_mixing.RESULTS, "block", "party", "weight", "number", "times"):
        clash = clash.withColumn(name, F.lit("clash"))
    again = op3_mixing.mix(clash)
    assert Counter((r.doc_id, r.target, r.taken) for r in again.collect()) == Counter((r.doc_id, r.target, r.taken) for r in rows)
    assert {r.block for r in again.collect()} == {"clash"}
    assert op3_mixing.mix(df.where("false")).count() == 0


def test_mixed_documents_follow_drawn_blocks(spark):
    """Whole documents: as often as their blocks are drawn, rounded only where a document lies in blocks that differ."""
    rows = [(i, " ".join(["w"] * (5 + i * 7919 % 60)), f"s{0 if i % 3 else i % 2 + 1}", i) for i in range(3000)] + [(9, "twice here", "s0", 1)] * 4 + [(10, None, "s0", 1), (11, "", None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, taken long")
    every = [F.col(c) for c in df.columns]
    items = df.select(F.xxhash64(*every, F.lit(1)).alias("doc_id"), "source", op3_mixing.word_count(F.col("text")).alias("size")).where("size > 0")
    items = items.groupBy("doc_id", "source").agg(F.first("size").alias("n"), F.count("*").alias("c")).withColumn("size", F.col("n") * F.col("c"))
    share = {r.doc_id: (r.taken / r.n, r.c, r.source, r.n, r.target) for r in op3_mixing.mix(items).collect()}
    got = Counter(r.k for r in op3_mixing.mixed(df).select(F.xxhash64(*every, F.lit(1)).alias("k")).collect())
    assert set(got) <= set(share)
    for k, (x, c, *_) in share.items():
        assert abs(got[k] - x) < 1 + 1e-3 and got[k] <= 3 * c and (x != int(x) or got[k] == x)
    assert {x for x, *_ in share.values()} >= {0, 1}
    for s in ("s0", "s1", "s2"):
        want = next(v[4] for v in share.values() if v[2] == s)
        assert abs(sum(got[k] * v[3] for k, v in share.items() if v[2] == s) - want) <= 65 + 0.01 * want
    assert op3_mixing.mixed(df.where("false")).count() == 0


def test_highest_quotients(spark):
    parties = [("h", p, float(w), 1000, n) for p, w, n in [("a", 5, 37), ("b", 2, 37), ("c", 1, 37), ("d", 5, 37), ("e", 0.2, 37)]]
    df = spark.createDataFrame(parties, "house string, party string, weight double, cap long, seats long")
    got = {r.party: r.got for r in op3_mixing.sainte_lague(df, "house", "party", "weight", "cap", "seats", "got").collect()}
    q = sorted(((-p[2] / (2 * k - 1), p[1]) for p in parties for k in range(1, 60)))[:37]
    assert got == {p[1]: sum(x == p[1] for _, x in q) for p in parties}


def brute_classes(texts):
    """Text -> label: the first text, by digest, that is similar enough on all five-word windows, or that one's label; all pairs."""
    md5 = {t: hashlib.md5(t.encode()).hexdigest() for t in texts}
    windows, held = {}, defaultdict(set)
    for t in texts:
        w = WORD.findall(t)
        windows[t] = {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
        for x in windows[t]:
            held[x].add(t)
    label = {}
    for t, s in windows.items():
        shared = Counter(f for x in s for f in held[x] if md5[f] < md5[t])
        near = [f for f, n in shared.items() if 100 * n >= 80 * (len(s) + len(windows[f]) - n)]
        label[t] = min(near, key=md5.get, default=t)
    return {t: md5[label[f]] for t, f in label.items()}


#: (shared words, own words) of documents that have the same menu and different texts.
MENUS = [(30, 30), (60, 60), (45, 15), (75, 15), (120, 15)]


def menu_documents(shared, own, host="host", first=0, n=200):
    """Documents with one menu of five-word lines, and a line of their own words."""
    letters = lambda i, j: f"{host}menu{chr(97 + i)}{chr(97 + j)}"
    menu = "\n".join(" ".join(letters(i, j) for j in range(5)) for i in range(shared // 5))
    return [(first + i, f"{menu}\n" + " ".join(f"{host}own{i}x{j}" for j in range(own)), "en", host, None) for i in range(n)]


def test_menus_of_unlike_documents_go(spark):
    """Documents that are mostly the same menu are no near copies: the menu is cut, and what is left of over 70 % is rejected."""
    rows = [r for k, (shared, own) in enumerate(MENUS) for r in menu_documents(shared, own, f"host{chr(97 + k)}", 1000 * k)]
    df = spark.createDataFrame(rows, DOC)
    kept = [own >= 0.3 * (shared + own) for shared, own in MENUS]
    got = op4_quality.quality_verdicts(df).collect()
    assert {(r.doc_id // 1000, r.kept, r.words_removed) for r in got} == {(k, kept[k], s) for k, (s, _) in enumerate(MENUS)} and len(got) == 1000
    assert {(r.doc_id // 1000, r.n_dropped, r.dropped_words) for r in op10_templates.drop_recurrent(df).collect()} == {(k, s // 5, s) for k, (s, _) in enumerate(MENUS)}
    left = op4_quality.accepted(df).collect()
    assert Counter(r.doc_id // 1000 for r in left) == {k: 200 for k in range(5) if kept[k]} and all("menu" not in r.text for r in left)


def test_menu_on_near_copies(spark):
    """Copies of one page in a crowd with the same menu: the menu goes, the copied page keeps its own lines."""
    page = [" ".join(f"page{i}x{j}" for j in range(12)) for i in range(10)]
    rows = menu_documents(30, 30) + [(1000 + i, "\n".join([*(" ".join(f"hostmenu{chr(97 + k)}{chr(97 + j)}" for j in range(5)) for k in range(6)), *page[: i % 10], f"{page[i % 10]} changed{i}", *page[i % 10 + 1 :]]), "en", "host", None) for i in range(60)]
    df = spark.createDataFrame(rows, DOC)
    assert {(r.kept, r.words_removed) for r in op4_quality.quality_verdicts(df).collect()} == {(True, 30)}
    assert {(r.n_dropped, r.dropped_words) for r in op10_templates.drop_recurrent(df).collect()} == {(6, 30)}


def brute_quality(rows):
    out, seen, hosts = {}, defaultdict(set), defaultdict(set)
    norm = lambda x: re.sub(r"[\x20\x09-\x0D]+", " ", x.lower()).strip(" ")
    for i, t, s in rows:
        t = t or ""
        hosts[s].add(t)
        for x in t.split("\n"):
            if WORD.search(x):
                seen[s, norm(x)].add(t)
    often = {k: v for k, v in seen.items() if len(v) > 10}
    labels = {s: brute_classes({t for k, v in often.items() if k[0] == s for t in v}) for s in hosts}
    bad = {k for k, v in often.items() if len({labels[k[0]][t] for t in v}) > 10}
    for i, t, s in rows:
        t = t or ""
        w = WORD.findall(t)
        at = defaultdict(list)
        for k in range(len(w) - 7):
            at[tuple(w[k : k + 8])].append(k)
        rep = {k + j for v in at.values() if len(v) > 1 for k in v for j in range(8)}
        ls = [x for x in t.split("\n") if WORD.search(x)]
        gone = sum(len(WORD.findall(x)) for x in ls if (s, norm(x)) in bad)
        base = len(w) < 20 or 100 * len(rep) > 30 * len(w)
        left = len(w) - gone
        kept = not base and not (gone and (left < 10 or left < 0.3 * len(w)))
        out[i] = (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(ls) - len(set(ls)), len(rep), base, kept, gone)
    return out


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_quality(spark, size):
    d = f"/root/testdata/{size}"
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    want = brute_quality(rows)
    got = {r.doc_id: tuple(r)[1:] for r in op4_quality.query(spark, d).collect()}
    assert got == want


def test_quality_planted(spark):
    body = [f"word{i} " * 1 + " ".join(f"w{i}x{j}" for j in range(30)) for i in range(40)]
    rows = [(i, f"{b}\nthe same  Footer line of all" if i < 20 else b, "h" if i % 2 else None) for i, b in enumerate(body)]
    rows += [(100 + i, "The same footer line of all\n" * 1 + "tiny rest " + " ".join("the same footer line of all".split()) + f"\n{i}", "h") for i in range(3)]
    rows += [(i, t, s) for i, t, s in rows[:5]] + [(200, None, "h"), (201, "", "h")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for name in (*op4_quality.RESULTS, "h", "x", "n"):
        df = df.withColumn(name, F.lit("clash"))
    got = {r.doc_id: (r.kept, r.words_removed) for r in op4_quality.quality_verdicts(df).collect()}
    want = brute_quality(rows)
    assert got == {k: (v[6], v[7]) for k, v in want.items()}
    assert op4_quality.quality_verdicts(df.where("false")).count() == 0


def test_near_copies_keep_their_lines(spark):
    """A text's many variants, a third of a host's rows, are one document; a line of 200 unlike documents goes on a large host too."""
    word = lambda a, b: " ".join(f"w{a}x{i}" for i in range(b))
    base = [word(f"base{k}", 12) for k in range(10)]
    rows = [(i, "\n".join([*base[: i % 10], f"{base[i % 10]} changed{i}", *base[i % 10 + 1 :]]), "hot") for i in range(300)]
    rows += [(1000 + i, f"{word(i, 25)}\n" + ("read more of this here now" if i < 200 else word(f"own{i}", 6)), "hot") for i in range(5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: (r.kept, r.words_removed) for r in op4_quality.quality_verdicts(df).collect()}
    assert {got[i] for i in range(300)} == {(True, 0)}
    assert {got[1000 + i] for i in range(200)} == {(True, 6)} and {got[1000 + i] for i in range(200, 5000)} == {(True, 0)}
    assert got == {k: (v[6], v[7]) for k, v in brute_quality(rows).items()}
