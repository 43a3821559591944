"""Each stage of the pipeline against plain versions on its own input."""

from collections import Counter
from pathlib import Path

import corpus_pipeline as cp
from pyspark.sql import functions as F
from tests.llm.test_decontamination import brute as brute_hits
from tests.llm.test_jaccard import brute as brute_groups
from tests.llm.test_native_ops import brute_quality, brute_targets

from foliant.llm.op4_quality import clean_text  # noqa: F401
from foliant.scale import stash


def test_stages(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "near_duplicates", "decontamination", "mixing", "sharding"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    for name, stage in cp.STAGES:
        before = docs.collect()
        docs = stash(stage(spark, docs, d), keep=True)
        after = docs.collect()
        if name != "sharding":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        ids = sorted(r.doc_id for r in after)
        if name == "quality_rules":
            want = brute_quality([(r.doc_id, r.text, r.source) for r in before])
            assert ids == sorted(i for i, v in want.items() if v[6])
            old = {r.doc_id: r for r in before}
            assert all(r == old[r.doc_id] for r in after if not want[r.doc_id][7])
            assert all(r.n_chars == len(r.text) and len(r.text) < len(old[r.doc_id].text) for r in after if want[r.doc_id][7])
        elif name == "near_duplicates":
            assert ids == sorted(i for i, _, c in brute_groups([(r.doc_id, r.text) for r in before], cp.SHINGLE, cp.PERCENT) if i == c)
        elif name == "decontamination":
            assert ids == sorted(r[0] for r in brute_hits([(r.doc_id, r.text) for r in before], items) if not r[-1])
        elif name == "mixing":
            size = {r.doc_id: len(r.text.split()) for r in before}
            per, took = Counter(), Counter()
            for r in before:
                per[r.source] += size[r.doc_id]
            for r in after:
                took[r.source] += size[r.doc_id]
            want = brute_targets(per)
            most = max(size.values())
            assert max(Counter(ids).values()) <= 3 and all(abs(took[s] - want[s]) <= most + 0.1 * want[s] for s in want)
        else:
            assert len(after) == len(before) and max(Counter(r.shard for r in after).values()) - min(Counter(r.shard for r in after).values()) <= 1


def test_odd_rows(spark, tmp_path):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "a b " * 40, "en", "a", 160), (3, "a b " * 40, "en", "a", 160)]
    text = " ".join(f"word{i}" for i in range(50))
    rows += [(4, text, "en", "a", len(text)), (4, text, "en", "a", len(text)), (None, text, "en", "b", 5), (5, text + " more", "en", "b", 5), (6, " ".join(f"v{i}" for i in range(20000)), "de", None, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for start in (df, df.where("false")):
        docs = start
        for _, stage in cp.STAGES:
            docs = stash(stage(spark, docs, str(tmp_path)), keep=True)
        assert {r.doc_id for r in docs.collect()} == ({4, 6} if start is df else set())


def test_clashing_columns_pass_through(spark, tmp_path):
    text = " ".join(f"word{i}" for i in range(50))
    df = spark.createDataFrame([(i, f"{text} {i}" if i < 3 else " ".join(f"v{i}x{j}" for j in range(60)), "en", "a", 1) for i in range(9)], "doc_id long, text string, lang string, source string, n_chars long")
    names = ["kept", "removed", "words_removed", "text_hash", "h", "component_id", "rep", "c1", "n_shingles", "spans", "items", "item", "taken", "target", "shards", "size", "times", "block", "party"]
    for name in names:
        df = df.withColumn(name, F.lit(name))
    spark.createDataFrame([(1, "v8x1 v8x2 v8x3 v8x4 v8x5 v8x6 v8x7 v8x8 v8x9 v8x10")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = df
    for name, stage in cp.STAGES:
        docs = stash(stage(spark, docs, str(tmp_path)), keep=True)
        assert docs.columns[: len(df.columns)] == df.columns
    rows = docs.collect()
    assert {r.doc_id for r in rows} == {0, 3, 4, 5, 6, 7} and all(r[n] == n for r in rows for n in names)


def test_temporary_tables_belong_to_their_run(spark):
    """A stage deletes what the stage that wrote its input has stashed; never another run's, nor what its input still reads."""
    made = []

    @cp.tidy
    def stage(spark, docs, sf_dir):
        made.append(stash(docs))
        return made[-1]

    there = lambda df: Path(df.inputFiles()[0].removeprefix("file://")).exists()
    start = spark.range(3).toDF("doc_id")
    a, b = stage(spark, start, ""), stage(spark, start, "")
    stage(spark, a, "")  # not written: still read by the next result
    assert there(made[0]) and there(made[1])
    written = stash(b, keep=True)
    last = stage(spark, written, "")
    assert there(made[0]) and not any(Path(f.removeprefix("file://")).exists() for f in [made[1]._jdf.inputFiles()[0]]) and last.count() == 3
