"""Query language, parsers, ranking, index, links, streaming and state on small cases."""

import csv
import html
import io
import json
import os
import pickle
import re
import sys
import types
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark import cloudpickle
from pyspark.sql import functions as F

from foliant import queries, scale
from foliant.functions.paths import excluded, normal_path, path_matches
from foliant.functions.text import highlights, lexical_tokens, tag_tokens
from foliant.operators import export, fusion, grouping, lexical, links, mindmap, snapshot, status, tags, vectors
from foliant.operators.clusters import estimate_k
from foliant.operators.indexer import Index
from foliant.operators.search import Engine
from foliant.plans.querylang import And, Not, Or, Tag, combine, parse_query, tag_query
from foliant.sources.parsing import ChunkConfig, chunk, parse_file, parse_html, parse_markdown, parse_text, section_ids, sections
from foliant.sources.scan import Source, SourceList, read_text
from foliant.streaming.watch import debounce, relevant


def test_flat_queries():
    q = parse_query('tag:技术 "深度学习" path:笔记 -广告 模型')
    assert (q.tag_filters, q.phrase, q.path_filters, q.exclude_terms, q.clean_query, q.has_boolean) == (["技术"], "深度学习", ["笔记"], ["广告"], "深度学习 模型", False)
    assert parse_query('深度学习 -"垃圾内容"').exclude_terms == ["垃圾内容"]
    bad = parse_query('tag:技术 "未闭合 深度学习')
    assert not bad.is_valid and bad.warn and bad.clean_query == 'tag:技术 "未闭合 深度学习'
    assert parse_query("tag: 内容 path: 文件").clean_query == "内容 文件"


def test_boolean_queries():
    assert parse_query("tag:ML OR tag:DL").expr == Or((Tag("ML"), Tag("DL")))
    assert parse_query("-tag:ML").expr == Not(Tag("ML"))
    assert parse_query("(tag:A OR tag:B) NOT tag:X").expr == And((Or((Tag("A"), Tag("B"))), Not(Tag("X"))))
    assert parse_query("NOT word other").clean_query == "other"
    assert combine(parse_query("x"), tag_query(["A", "B"], "OR")).has_boolean


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet='ab()-": ORANDNOTtagpath*', max_size=30))
def test_parser_never_raises(raw):
    parse_query(raw)


def test_parsers_and_chunks():
    md = parse_markdown("# T\npara one\nstill\n\n- item\n```\ncode\n```\nend\n```\nopen")
    assert [(p.type, p.line) for p in md] == [("heading", 0), ("paragraph", 1), ("list", 4), ("code", 5), ("paragraph", 8), ("code", 9)]
    assert [p.content for p in parse_text("a \n b\n\n\nc")] == ["a\nb", "c"]
    html = parse_html("<nav>no</nav><h1>Head</h1><p>long enough text<p>another paragraph here<pre>x = 1</pre>")
    assert [(p.type, p.level) for p in html] == [("heading", 1), ("paragraph", 0), ("paragraph", 0), ("code", 0)]
    two = chunk("/a.md", "a.md", "A", parse_markdown("# A\nfirst\n\n## B\nsecond"))
    assert [c["total_chunks"] for c in two] == [2, 2]
    many = chunk("/a.md", "a.md", "A", parse_markdown("# A\n" + "\n\n".join("word " * 12 for _ in range(6))), ChunkConfig(50, 10))
    assert len(many) > 1 and all(c["content"].strip() for c in many)


def test_text_functions(spark):
    r = spark.createDataFrame([("神经网络", "GPT-4 学")], "a string, b string").select(lexical_tokens(F.col("a")).alias("a"), lexical_tokens(F.col("b")).alias("b"), tag_tokens(F.col("b")).alias("t"), highlights(F.lit("abcabc"), ["ab", "abc"]).alias("h")).first()
    assert r.a == ["神经", "神经网", "经网", "经网络", "网络"] and r.b == ["gpt", "4"] and r.t == ["gpt", "4"]
    assert [(x.start, x.end) for x in r.h] == [(0, 3), (3, 6)]
    p = spark.createDataFrame([("/root/sub/Note.md",)], "p string")
    hit = lambda rule: p.select(excluded(F.col("p"), "/root", [rule])).first()[0]
    assert all(map(hit, ["sub/note.md", "note.md", "sub", "*.md", "sub/*.md"])) and not any(map(hit, ["other", "*.txt", " "]))
    assert p.select(path_matches(F.col("p"), "sub/*.md")).first()[0] and not p.select(path_matches(F.col("p"), "sub/*.md", True)).first()[0]


def test_rank_fusion(spark):
    t = lambda ids: spark.createDataFrame([(x, i + 1) for i, x in enumerate(ids)], "id string, rank int")
    rows = fusion.rrf(t(["s1", "s2", "s3"]), t(["l3", "l1", "l2"])).collect()
    assert len(rows) == 6 and rows[0].rrf_score == pytest.approx(1 / 61, abs=1e-6)
    assert fusion.rrf(t(["a"]), t(["a"])).first().rrf_score == round(2 / 61, 6)
    assert fusion.rrf(t([]), t([])).count() == 0


def test_vectors(spark):
    v = [("f1", [1, 0, 0, 0]), ("f2", [1, 0, 0, 0]), ("f3", [0, 1, 0, 0]), ("f4", [0.82, 0, 0.5724, 0]), ("f5", [0, 0.95, 0, 0.312]), ("f6", [0, 0, 0, 0])]
    df = spark.createDataFrame([(k, [float(x) for x in e]) for k, e in v], "k string, v array<double>")
    for block in (2048, 2):
        pairs = lambda t: {(r.a, r.b) for r in vectors.duplicate_pairs(df, t, "k", "v", block).collect()}  # noqa: B023, E731
        assert pairs(0.85) == {("f1", "f2"), ("f3", "f5")} and {("f1", "f4"), ("f2", "f4")} <= pairs(0.8)
    assert [estimate_k(n) for n in (0, 2, 3, 5, 50, 10**6)] == [0, 0, 2, 2, 5, 12]


def test_search_modes(spark):
    rows = [(i, f"/s/{n}.md", f"{n}.md", n, 0, 0, 0, t, tags) for i, (n, t, tags) in enumerate([("ml", "神经网络 深度学习 模型", ["A"]), ("cook", "苹果派 食谱", ["B"]), ("hist", "唐朝 历史", ["A", "B"])])]
    c = spark.createDataFrame(rows, "id int, file_path string, file_name string, title string, start_line int, end_line int, chunk_index int, content string, file_tags array<string>")
    e = Engine(vectors.embed(c, vectors.HashEmbedder(64)), vectors.HashEmbedder(64))
    assert e.search("神经网络 深度学习", 3).first().title == "ml"
    assert e.search("苹果", mode="keyword").first().title == "cook"
    assert {r.title for r in e.search("tag:A OR tag:B").collect()} == {"ml", "cook", "hist"}
    assert {r.title for r in e.search("tag:A NOT tag:B").collect()} == {"ml"}
    assert e.search("").count() == 0 and e.search("zzz", mode="keyword").count() == 0
    assert {r.title for r in e.search("tag:A OR 苹果", mode="keyword").collect()} == {"cook"}
    assert {r.title for r in e.search("tag:A OR 苹果", mode="keyword", compat=True).collect()} == set()
    assert grouping.group_results(e.search("tag:A"), grouping.GroupMode.BY_TAG).count() == 2
    with pytest.raises(ValueError):
        e.set_mode("other")


def test_index_and_relevance(spark, tmp_path):
    d = tmp_path / "docs"
    d.mkdir()
    (d / "ml.md").write_text("# 神经网络\n深度学习 模型")
    (d / "keep.txt").write_text("plain text\n\nmore")
    (d / "secret.md").write_text("x")
    sources = SourceList([Source(str(d), ["*secret*"]), Source(str(tmp_path / "none"), enabled=False)])
    index = Index(spark, str(tmp_path / "index"), vectors.HashEmbedder(32))
    assert index.sync(sources)["new"] == 2
    assert index.sync(sources)["unchanged"] == 2
    (d / "ml.md").write_text("# 神经网络\n改了")
    (d / "keep.txt").unlink()
    stats = index.sync(sources)
    assert (stats["updated"], stats["removed"]) == (1, 1) and index.table("files").count() == 1
    assert index.engine("keyword").search("神经网络").count() == 1 and index.engine("keyword").search("plain").count() == 0
    assert index.stale(vectors.HashEmbedder(64)) and not index.stale(vectors.HashEmbedder(32))
    assert Engine(index.searchable()).search("神经网络", mode="keyword").count() == 1
    path = lambda p: spark.range(1).select(relevant(F.lit(p), sources.items)).first()[0]
    assert path(f"{d}/ok.md") and not any(map(path, [f"{d}/~$r.docx", f"{d}/n.tmp", f"{d}/a.swp", f"{d}/secret.md", "/elsewhere/a.md"]))


def test_links(spark):
    files = spark.createDataFrame([("/A/notes.md", "/A", "Notes"), ("/A/ref.md", "/A", "Ref"), ("/B/other.md", "/B", "Other"), ("/A/helper.md", "/A", "Helper"), ("/B/helper.md", "/B", "Helper")], "file_path string, source string, title string")
    text = "[[Ref]] [[Ref|x]] [[Missing]] [a](./helper.md) ![i](x.png) [e](http://x)\n```\n[[Other]]\n```\n[[Other#s]] [r](/ref.md)"
    found = links.extract_links(spark.createDataFrame([("/A/notes.md", text)], "file_path string, text string"))
    nodes, edges = links.graph(files, found)
    assert sorted(r.target for r in edges.collect()) == ["/A/helper.md", "/A/ref.md", "/A/ref.md", "/A/ref.md", "/B/other.md", "Missing"]
    assert [r.path for r in nodes.where("kind = 'missing'").collect()] == ["Missing"]
    assert {r.path for r in links.neighbours(edges, "/A/ref.md").collect()} == {"/A/notes.md"}


def test_state(spark, tmp_path):
    s = snapshot.Settings()
    for i in range(60):
        s.push_search(f"q{i}")
    s.push_search("q30")
    s.push_search(" ")
    assert len(s.recent_searches) == 50 and s.recent_searches[0] == "q30"
    s.save(str(tmp_path / "c.json"))
    assert snapshot.Settings.load(str(tmp_path / "c.json")) == s
    data = tmp_path / "data"
    data.mkdir()
    (data / "tags.json").write_text(json.dumps([1]))
    z = snapshot.create_snapshot(str(data), str(tmp_path / "s.zip"), "m", 8)
    (data / "extra").write_text("x")
    with pytest.raises(snapshot.SnapshotError):
        snapshot.restore_snapshot(z, str(data), "m", 9)
    assert snapshot.restore_snapshot(z, str(data), "m", 8) and not (data / "extra").exists()
    e = spark.createDataFrame([(i,) for i in (0.0, 0.5, 1.0, 9.0, 9.2)], "t double").select(F.timestamp_millis((F.col("t") * 1000).cast("long")).alias("ts"))
    assert sorted(r.n_events for r in debounce(e).collect()) == [2, 3]
    docs = spark.createDataFrame([("a", "x y x"), ("b", "")], "id string, text string")
    assert lexical.postings(docs).where("term = 'x'").first().tf == 2


def test_knn_of_all_queries(spark):
    import numpy as np

    from foliant.operators import vectors

    rng = np.random.default_rng(3)
    m = rng.normal(size=(90, 6)).round(1)
    m[40] = m[7]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, embedding array<double>")
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    for block in (4, 2048):
        got = {(r.query, r["rank"]): (r.id, round(r.similarity, 9)) for r in vectors.knn_join(df, df.where("id % 20 = 0"), 3, block=block).collect()}
        want = {}
        for i in range(0, 90, 20):
            near = sorted(range(90), key=lambda j: (-round(float(u[i] @ u[j]), 9), j))[:3]
            want |= {(i, r + 1): (j, round(float(u[i] @ u[j]), 9)) for r, j in enumerate(near)}
        assert got == want
    assert vectors.knn_join(df, df.where("false"), 3).count() == vectors.knn_join(df.where("false"), df, 3).count() == 0


def test_texts_are_tokenised_once(spark):
    docs = spark.createDataFrame([(1, "Alpha beta beta"), (2, "beta"), (3, None), (4, "神经网络 beta"), (5, "alphabet")], "id long, text string")
    scored = lexical.bm25(docs, "beta 神经 alpha")
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[a-z0-9]+") <= 2  # two branches of one CASE
    got = {r.id: r.lexical_score for r in scored.collect()}
    post = lexical.postings(docs)
    indexed = {r.id: r.lexical_score for r in lexical.bm25_indexed(post, ["beta", "神经", "alpha"], stats=lexical.index_stats(post)).collect()}
    assert set(got) == {1, 2, 4} and got == pytest.approx(indexed)
    assert lexical.bm25(docs, "").count() == 0 and lexical.bm25(docs.where("false"), "beta").count() == 0


def test_spans_and_paths(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert [(x.start, x.end) for x in one(highlights(F.lit("aaa a.b A.B"), ["aa"]))] == [(0, 2), (1, 3)]
    assert [x.start for x in one(highlights(F.lit("aaa a.b A.Bacb"), ["a.b"]))] == [4, 8]
    import posixpath

    paths = ["/a/./b//c/../d", "a/../../b", "", "/..", "../x/./y/..", "/a/b/../../../c", "."]
    rows = spark.createDataFrame([(p,) for p in paths], "p string").select("p", normal_path(F.col("p")).alias("n")).collect()
    assert {r.p: r.n for r in rows} == {p: posixpath.normpath(p) for p in paths}
    text = "[[A]]\n  ```py\n[[B]]\n```\n[[C]] ![[D]]\n```\n[[E]]"
    found = links.extract_links(spark.createDataFrame([("/n.md", text), ("/e.md", ""), ("/z.md", None)], "file_path string, text string")).collect()
    assert [(r.target_raw, r.line) for r in found] == [("A", 0), ("C", 4), ("D", 4)]


def test_exports(spark):
    rows = spark.createDataFrame([("/a|b.md", "n", "t", 'one "two",\nthree <4>', 0.91234, None, 0.5, 1), ("/c.md", "", None, None, 0.55, 0.0512, None, 2)], "file_path string, file_name string, title string, snippet string, similarity double, rrf_score double, lexical_score double, rank int")
    md = export.to_markdown(rows)
    assert md.split("\n")[0] == export.TITLE and "共 2 条结果" in md and "| /a\\|b.md | n | one \"two\", three <4> | 0.9123 |" in md and "| /c.md |  |  | 0.0512 |" in md
    table = list(csv.reader(io.StringIO(export.to_csv(rows), newline="")))
    assert table[0][0] == "文件路径" and table[1][2] == 'one "two",\nthree <4>' and len(table) == 3
    assert json.loads(export.to_json(rows))[0]["score"] == "0.9123"
    assert "three &lt;4&gt;" in export.to_html(rows) and export.to_html(rows).count("<tr>") == 3
    assert export.to_csv(rows.where("false")).count("\r\n") == 1


def plain_map(ps, title):
    """Sections and their longer paragraphs, walked in order."""
    flat = lambda t, n: (lambda x: x if len(x) <= n else x[:n] + "...")(" ".join(t.split()))
    rows, heads = [("0", None, 0, 0, title, 1.0)], 0
    if any(p.type == "heading" for p in ps):
        for p in ps:
            if p.type == "heading":
                heads, below = heads + 1, 0
                if heads <= 20:
                    rows.append((f"0.{heads - 1}", "0", heads - 1, max(p.level, 1), p.content, 1.0 if p.level <= 2 else 0.7))
            elif 0 < heads <= 20 and p.type in ("paragraph", "list") and len(p.content) > 20:
                rows.append((f"0.{heads - 1}.{below}", f"0.{heads - 1}", below, 3, flat(p.content, 40), 0.5))
                below += 1
    else:
        long = [p for p in ps[:10] if p.type in ("paragraph", "list") and len(p.content) > 30]
        rows += [(f"0.{k}", "0", k, 1, flat(p.content, 50), 0.5) for k, p in enumerate(long)]
    return rows


def test_maps_against_a_plain_walk(spark, sf):
    files = queries.documents_as_files(spark.read.parquet(f"{sf}/documents.parquet")).select("file_path", "text")
    many = "\n".join(f"{'#' * (1 + i % 4)} head {i}\n\nshort\n\na longer paragraph with   more than forty characters, number {i}\n- a list item of more than twenty" for i in range(25))
    files = files.unionByName(spark.createDataFrame([("/x/many.md", many), ("/x/none.md", None), ("/x/page.html", "<h2>Top</h2><p>a paragraph that is longer than twenty")], "file_path string, text string"))
    got = {}
    for r in mindmap.from_files(files).collect():
        got.setdefault(r.root_id, []).append(tuple(r)[1:])
    for r in files.collect():
        ps = (parse_html if r.file_path.endswith("html") else parse_markdown)(r.text or "")
        title = next((p.content for p in ps if p.type == "heading" and p.level <= 2), r.file_path.split("/")[-1].rsplit(".", 1)[0])
        assert sorted((x for x in got[r.file_path] if not x[0].startswith("0.k")), key=str) == sorted(plain_map(ps, title), key=str)
        assert sum(x[1] == "0.k" for x in got[r.file_path]) <= 8
    two = spark.createDataFrame([("/a.md", "# A\nshared words here"), ("/b.md", "# B\nshared words there")], "file_path string, text string")
    rows = mindmap.from_many(two, "all").collect()
    assert {r.parent_id for r in rows if r.level == 1} == {"0"} and sum(r.parent_id is None for r in rows) == 1
    assert {(r.label, r.weight) for r in rows if r.parent_id == "t"} == {("shared (2)", 0.6), ("words (2)", 0.6)} and [r.weight for r in rows if r.node_id == "t"] == [0.9]
    assert {(r.label, r.weight) for r in rows if r.level == 1 and r.node_id != "t"} == {("a", 1.0), ("b", 1.0)} and {r.parent_id for r in rows} - {None} <= {r.node_id for r in rows}


def plain_chunks(text, size=800, keep=100):
    """Blocks between blank lines, put together up to the size; each chunk begins with the end of the one before."""
    blocks, at = [], 0
    for part in re.split(r"(?:\n[^\S\n]*)*\n[^\S\n]*(?=\n)|\Z", text):
        body = [(at + i, x.strip()) for i, x in enumerate(part.split("\n")) if x.strip()]
        at += part.count("\n")
        if body:
            blocks.append("\n".join(x for _, x in body))
    out, held = [], []
    for b in blocks:
        if held and sum(map(len, held)) + len(b) > size:
            out.append("\n\n".join(held))
            joined = "\n".join(held)
            tail = joined if len(joined) <= keep else joined[-keep:]
            cut = tail.find("\n") if len(joined) > keep else -1
            held = [tail[cut + 1 :] if cut > 0 else tail]
        held.append(b)
    return out + (["\n\n".join(held)] if held else [])


def test_chunks_against_plain_blocks(spark, sf):
    text = {str(r.doc_id): r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {}
    for r in queries.chunk_documents(spark, sf).orderBy("chunk_index").collect():
        got.setdefault(r.file_name.removesuffix(".txt"), []).append(r.content)
        assert r.total_chunks >= r.chunk_index + 1 and r.chunk_id.startswith(r.file_path)
    assert got == {k: plain_chunks(t) for k, t in text.items() if plain_chunks(t)}


def test_sections_and_page_paragraphs(spark, sf):
    ps = parse_markdown("intro\n\n# A\nx\n\n#### deep\ny\n\n## B\nz")
    df = spark.createDataFrame([("d", i, p.type, p.level) for i, p in enumerate(ps)], "id string, pos int, type string, level int")
    want = [k for k, group in enumerate(sections(ps)) for _ in group]
    assert [r.section for r in section_ids(df).orderBy("pos").collect()] == want
    pages = {str(r.page_id): r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = queries.parse_pages(spark, sf).collect()
    bare = {k: " ".join(html.unescape(re.sub(r"(?s)<[^>]*>", "", re.sub(r"(?s)<(script|style|nav|footer)\b.*?</\1>", "", h))).split()) for k, h in pages.items()}
    assert {r.id for r in rows} == set(pages) and all("".join(r.content.split()) in bare[r.id].replace(" ", "") for r in rows)
    assert all(r.level == int(r.type == "heading" and r.level) and (r.type != "paragraph" or len(r.content) > 10) for r in rows)


def test_clusters_hold_every_file_once(spark, sf):
    rows = queries.kmeans(spark, sf).collect()
    files = [f for r in rows for f in r.files]
    ids = {f"/v/{r.vec_id}": r for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    assert sorted(files) == sorted(ids) and len(rows) == estimate_k(len(ids))
    for r in rows:
        tags = Counter(f"t{ids[f].label}" for f in r.files)
        assert r.label == min(tags, key=lambda t: (-tags[t], t)) and set(r.sample_titles) <= set(r.files) and 1 <= len(r.sample_titles) <= 3


def test_embedder_contract_and_status(spark, tmp_path):
    loads = []

    def load():
        loads.append(1)
        return lambda texts, most: (np.array([[[float(len(t)), 1.0], [3.0, 4.0], [9.0, 9.0]] for t in texts]), np.array([[1, t != " ", 0] for t in texts]))

    e = vectors.PooledEmbedder(load, 2, "toy", batch=2)
    assert vectors.embedder_status(spark, e).first().asDict() == {"model": "toy", "backend": "PooledEmbedder", "dim": 2, "ready": True, "loaded": False}
    got = e.encode(["ab", "  ", "abc"])
    want = np.array([[2.5, 2.5], [1, 1], [3, 2.5]])
    assert np.allclose(got, want / np.linalg.norm(want, axis=1, keepdims=True)) and loads == [1]
    e.preload()
    assert loads == [1] and vectors.embedder_status(spark, e).first().loaded and pickle.loads(cloudpickle.dumps(e))._model is None
    assert not vectors.embedder_status(spark, None).first().ready
    (tmp_path / "a.md").write_bytes("# T\nü".encode() + b"\xff")
    assert read_text(spark, str(tmp_path / "a.md")) == "# T\nü" and read_text(spark, str(tmp_path / "no.md")) == ""
    c = queries.chunks(spark, "/root/testdata/sf0.001")
    post = lexical.postings(c.select("id", "content"), text="content")
    row = status.rollup(c, c, queries.file_tags(spark, "/root/testdata/sf0.001"), c.limit(0), post, queries._label_clusters(spark, "/root/testdata/sf0.001")).first()
    assert 0 < row.lexical_chunks <= row.total_chunks and [x.n_files for x in row.tag_distribution] == sorted((x.n_files for x in row.tag_distribution), reverse=True) and len(row.cluster_distribution) == 10


def test_pdf_by_a_stand_in(monkeypatch):
    class Page:
        def get_text(self, kind):
            return [(0, 0, 0, 0, " first block "), (0, 0, 0, 0, "  "), (0, 0, 0, 0, "second")]

    class Pdf(list):
        def __enter__(self):
            return self

        def __exit__(self, *_):
            return None

    monkeypatch.setitem(sys.modules, "fitz", types.SimpleNamespace(open=lambda stream, filetype: Pdf([Page(), Page()])))
    assert [(p.content, p.line) for p in parse_file(".PDF", b"x")] == [("first block", 0), ("second", 1), ("first block", 2), ("second", 3)]
    monkeypatch.setitem(sys.modules, "fitz", None)
    with pytest.raises(ValueError, match="unsupported"):
        parse_file(".pdf", b"x")


def test_broadcasts_are_measured_in_bytes(spark, monkeypatch):
    few_wide = spark.range(10).select("id", F.repeat(F.lit("x"), 1 << 18).alias("s"), F.array(F.struct(F.repeat(F.lit("y"), 4).alias("t"))).alias("a"))
    hinted = lambda df: "broadcast" in df._jdf.queryExecution().logical().toString()
    assert hinted(scale.sized(few_wide)) and not hinted(scale.sized(few_wide, 1 << 20)) and not hinted(scale.sized(spark.range(100), 1000))
    monkeypatch.setattr(type(spark.conf), "get", lambda _, k, d=None: {"spark.master": "spark://host:7077"}.get(k, d))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scale.shared_dir(spark)


def test_scratch_deletes_its_stashes(spark):
    with scale.scratch(spark):
        df = scale.stash(spark.range(3))
        at = df.inputFiles()[0].removeprefix("file://")
        assert df.count() == 3 and os.path.exists(at)
    assert not os.path.exists(at)


def test_indexed_scores_do_not_depend_on_the_order_of_postings(spark):
    """Copies of a text tie exactly, and as the scan scores them, in whatever order their postings come."""
    terms = list("abcdefg")
    rows = [(i, 100, t, 1 + 3 * ord(t) % 6) for i, order in enumerate([terms, terms[::-1], terms[3:] + terms[:3], terms[1::2] + terms[::2]]) for t in order]
    rows += [(10 + i, 17 + i, t, 1) for i, t in enumerate("aabbbbcddddddefffgggggg")]
    post = spark.createDataFrame(rows, "id long, dl int, term string, tf long").coalesce(1)
    stats = spark.createDataFrame([(1000, 61.7)], "n long, avgdl double")
    got = {r.id: r.lexical_score for r in lexical.bm25_indexed(post, terms, stats=stats).collect()}
    assert len({got[i] for i in range(4)}) == 1


def test_words_are_counted_without_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(scale, "SPREAD_BYTES", 0)
    docs = spark.createDataFrame([(1, "bb aa aa cc bb bb", "t"), (2, None, "t"), (3, "", None), (None, "dd", None)], "id long, text string, title string")
    post, words = lexical.postings(docs), tags.keyword_tags(docs, "id")
    maps = mindmap.from_files(docs.select(F.concat(F.col("id").cast("string"), F.lit(".md")).alias("file_path"), "text").where("id is not null"))
    assert not any("Exchange" in t._jdf.queryExecution().executedPlan().toString() for t in (post, words, maps))
    assert sorted(map(tuple, post.where("id is not null").collect())) == [(1, 6, "aa", 2), (1, 6, "bb", 3), (1, 6, "cc", 1)]
    assert sorted(map(tuple, words.collect())) == [(1, "aa", 2, 2), (1, "bb", 1, 3), (1, "cc", 3, 1)]
    assert [(r.label, r.ord) for r in maps.where("root_id = '1.md' and level = 2").orderBy("ord").collect()] == [("bb", 1), ("aa", 2), ("cc", 3)]


def test_keywords_of_a_map_come_from_the_whole_text(spark):
    text = "# Top\n\n" + "early word " * 600 + "\n\n" + "later " * 2000 + "last " * 1500
    files = spark.createDataFrame([("/a.md", text), ("/b.md", text)], "file_path string, text string")
    words = [r.label for r in mindmap.from_files(files).where("root_id = '/a.md' and parent_id = '0.k'").orderBy("ord").collect()]
    assert words == ["later", "last", "early", "word", "top"]
    topics = {r.label for r in mindmap.from_many(files, "all").collect() if r.parent_id == "t"}
    assert {"later (2)", "last (2)"} <= topics
    cut = tags.keyword_tags(files.select("file_path", "text", F.lit("").alias("title")), body_chars=5000)
    assert {r.tag for r in cut.collect()} == {"early", "word", "top"}


def test_a_semantic_search_embeds_the_chunks_once(spark, sf):
    out = queries.semantic_search(spark, sf)
    assert "MapInArrow" not in out._jdf.queryExecution().optimizedPlan().toString() and out.count() == 10
    v = vectors.HashEmbedder(8).encode(["a b a", ""])
    assert np.allclose(np.linalg.norm(v, axis=1), 1) and np.array_equal(v[0], vectors.HashEmbedder(8).encode(["b a a"])[0])
