"""The index: what a change reads and writes, one version for readers, statistics, merges, snapshots."""

import os

import pytest
from pyspark.sql import functions as F

from foliant.operators import indexer, lexical, vectors
from foliant.operators.indexer import Index
from foliant.sources import scan
from foliant.sources.scan import Source, SourceList


def folder(tmp_path, n=8):
    d = tmp_path / "docs"
    d.mkdir()
    for i in range(n):
        (d / f"n{i}.md").write_text(f"# Title {i}\ncommon words word{i} and more")
    return d, SourceList([Source(str(d), ["*secret*"])])


def truth(index):
    """n and avgdl counted from all live postings, and from the manifest."""
    post = index.table("postings")
    n, avgdl = lexical.index_stats(post).first()
    kept = index.stats().first()
    return (n, avgdl or 0.0), (kept.n, kept.avgdl)


def opened(monkeypatch):
    """The paths that syncs from now on open."""
    seen = []
    real = scan.read_contents

    def spy(files):
        seen.extend(os.path.basename(r.file_path) for r in files.select("file_path").collect())
        return real(files)

    monkeypatch.setattr(indexer, "read_contents", spy)
    return seen


def test_a_change_reads_and_writes_what_changed(spark, tmp_path, monkeypatch):
    d, sources = folder(tmp_path)
    (d / "secret.md").write_text("not for us")
    steps = []
    index = Index(spark, str(tmp_path / "index"), progress=lambda *a: steps.append(a))
    assert index.sync(sources) == {"new": 8, "updated": 0, "unchanged": 0, "removed": 0, "errors": [], "sources": 1}
    assert [s[0] for s in steps] == [0, 1, 2, 3]
    read = opened(monkeypatch)
    assert index.sync(sources)["unchanged"] == 8 and read == [] and index.info()["version"] == 1
    before = index.info()
    (d / "n3.md").write_text("# Title 3\nfresh words of it")
    os.utime(d / "n4.md", ns=(1, 10**18))  # touched: opened, found unchanged, and not opened again
    (d / "bad.docx").write_bytes(b"no zip")
    got = index.sync(sources)
    assert (got["new"], got["updated"], got["unchanged"], got["removed"]) == (1, 1, 7, 0) and "BadZipFile" in got["errors"][0]["error"]
    assert sorted(read) == ["bad.docx", "n3.md", "n4.md"]
    after = index.info()
    assert after["segments"][0] == before["segments"][0] and len(after["segments"]) == 2
    assert {r.file_name for r in spark.read.parquet(f"{index.root}/{after['segments'][1]['folder']}/files").collect()} == {"n3.md", "bad.docx"}
    del read[:]
    assert index.sync(sources)["unchanged"] == 9 and read == [] and index.info() == after  # what failed isn't new each time
    assert index.sync(sources, retry_failed=True)["errors"] and read == ["bad.docx"]
    assert index.table("files").count() == 9 and index.engine("keyword").search("common", 20).count() == 7
    want, kept = truth(index)
    assert want == kept
    (d / "n5.md").unlink()
    assert index.sync(sources)["removed"] == 1 and index.engine("keyword").search("word5").count() == 0
    want, kept = truth(index)
    assert want == kept and want[0] == 7


def test_reindex_and_remove_by_path(spark, tmp_path, monkeypatch):
    d, sources = folder(tmp_path, 4)
    index = Index(spark, str(tmp_path / "index"))
    index.sync(sources)
    (d / "bad.docx").write_bytes(b"no zip")
    (d / "n2.md").unlink()
    read = opened(monkeypatch)
    got = index.reindex(sources, [f"{d}/n1.md", f"{d}/n2.md", f"{d}/bad.docx", "/elsewhere/x.md"])
    assert got[f"{d}/n1.md"] is None and "not found" in got[f"{d}/n2.md"] and "BadZipFile" in got[f"{d}/bad.docx"] and "not found" in got["/elsewhere/x.md"]
    assert sorted(read) == ["bad.docx", "n1.md", "n2.md"]
    assert {r.file_name for r in index.table("files").collect()} == {"n0.md", "n1.md", "n3.md", "bad.docx"}
    index.remove([f"{d}/n{i}.md" for i in range(4)])
    assert [r.file_name for r in index.table("files").collect()] == ["bad.docx"] and index.table("postings").count() == 0
    assert truth(index) == ((0, 0.0), (0, 0.0))
    index.remove([f"{d}/n0.md"])


def test_a_crash_leaves_the_old_version(spark, tmp_path, monkeypatch):
    d, sources = folder(tmp_path, 3)
    index = Index(spark, str(tmp_path / "index"))
    index.sync(sources)
    before = index.info()
    (d / "n1.md").write_text("# Title\nlater words")
    with monkeypatch.context() as m:
        m.setattr(Index, "_commit", lambda *_: (_ for _ in ()).throw(RuntimeError("crash")))
        with pytest.raises(RuntimeError):
            index.sync(sources)
    assert index.info() == before and index.engine("keyword").search("later").count() == 0
    assert index.sync(sources)["updated"] == 1 and index.engine("keyword").search("later").count() == 1
    with pytest.raises(RuntimeError):
        index._commit(index.info())
    kept = {p.name for p in (tmp_path / "index").iterdir() if p.name.startswith("segment-")}
    assert kept == {s["folder"] for m in index._names("manifest-*.json") for s in index._read(m)["segments"]}


def test_merges_keep_every_answer(spark, tmp_path, monkeypatch):
    d, sources = folder(tmp_path, 3)
    index = Index(spark, str(tmp_path / "index"))
    monkeypatch.setattr(indexer, "MERGE", 100)
    monkeypatch.setattr(indexer, "MOST", 100)
    index.sync(sources)
    for i in range(2):
        (d / "n0.md").write_text(f"# Title\nturn{i} common words")
        index.sync(sources)
    (d / "n1.md").unlink()
    index.sync(sources)
    look = lambda: ([tuple(r) for r in index.engine("keyword").search("common turn1", 20).select("id", F.round("lexical_score", 9), "rank").collect()], sorted(map(tuple, index.table("seen").collect())), truth(index))
    before = look()
    assert len(index.info()["segments"]) == 4
    index.merge(2)  # the newest two: what they say of older rows still counts
    assert len(index.info()["segments"]) == 3 and look() == before
    index.merge()
    assert len(index.info()["segments"]) == 1 and index.info()["segments"][0]["gone"] == 0 and look() == before
    monkeypatch.setattr(indexer, "MERGE", 2)
    monkeypatch.setattr(indexer, "MOST", 1)
    (d / "n2.md").write_text("# Title\nturn1 at last")
    index.sync(sources)
    assert len(index.info()["segments"]) <= 2 and index.sync(sources)["unchanged"] == 2


def test_searches_read_the_terms_postings_only(spark, tmp_path):
    d, sources = folder(tmp_path, 5)
    index = Index(spark, str(tmp_path / "index"))
    index.sync(sources)
    (d / "n0.md").write_text("# Title\nother words")
    index.sync(sources)
    plan = index.engine("keyword").search("common word3")._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.split("\n") if "FileScan" in x and "term#" in x]
    assert scans and all("PushedFilters: [In(term, [common,word3])" in x for x in scans)


def test_snapshots_of_any_root(spark, tmp_path):
    d, sources = folder(tmp_path, 3)
    root = f"file://{tmp_path}/index"  # a URI, as any store's
    index = Index(spark, root, vectors.HashEmbedder(8))
    index.sync(sources)
    index.snapshot("first", {"why": "test"})
    with pytest.raises(ValueError):
        index.snapshot("first")
    (d / "n0.md").write_text("# Title\nchanged words")
    (d / "n1.md").unlink()
    (d / "new.md").write_text("# Title\nbrand new")
    index.sync(sources)
    names = lambda: {r.file_name: r.md5_hash for r in index.table("files").collect()}
    now = names()
    undo = index.restore("first")
    assert index.engine("keyword").search("word1").count() == 1 and index.engine("keyword").search("brand").count() == 0 and truth(index)[0] == truth(index)[1]
    assert index.restore(undo) and names() == now
    assert index.restore("first", "merge") is None
    merged = names()
    assert set(merged) == {"n0.md", "n1.md", "n2.md", "new.md"} and merged["n0.md"] != now["n0.md"] and truth(index)[0] == truth(index)[1]
    assert index.snapshots()["first"]["note"] == {"why": "test"}
    for _ in range(3):  # old versions go, the snapshot's segments stay
        index.merge()
    assert index.restore("first") and index.table("files").count() == 3
    index.drop_snapshot("first")
    assert "first" not in index.snapshots()
    other = Index(spark, root, vectors.HashEmbedder(16))
    assert other.stale(vectors.HashEmbedder(16)) and not other.stale(vectors.HashEmbedder(8))
    with pytest.raises(ValueError):
        index.restore("none of these modes", "replace")
