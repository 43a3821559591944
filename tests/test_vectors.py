"""The pruned duplicate search against all pairs, and the vector index's recall against the exact way."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.operators import vectors
from foliant.operators.vectorindex import VectorIndex


def clustered(n, groups=40, dim=16, spread=0.15, seed=1):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(groups, dim))
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    return c[rng.integers(0, groups, n)] + spread * rng.normal(size=(n, dim))


@pytest.mark.parametrize("block,threshold", [(16, 0.85), (2048, 0.5), (30, -1.0)])
def test_all_pairs_over_the_threshold(spark, block, threshold):
    m = clustered(300 if threshold > 0 else 70)
    m[7] = m[3]
    m[9] = 0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, vec array<double>")
    u = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    sims = u @ u.T
    want = {(i, j): sims[i, j] for i in range(len(m)) for j in range(i + 1, len(m)) if 9 not in (i, j) and sims[i, j] >= threshold - 1e-12}
    got = [tuple(r) for r in vectors.duplicate_pairs(df, threshold, block=block, ordered=True).collect()]
    assert len(got) == len(want) and all(want[a, b] == pytest.approx(s) for a, b, s in got)
    assert [s for *_, s in got] == sorted((s for *_, s in got), reverse=True)
    assert vectors.duplicate_pairs(df.where("id = 9")).count() == 0


def test_far_blocks_never_meet(spark, monkeypatch):
    """Clustered vectors: few rows are sent to blocks other than their own."""
    m = clustered(2000, groups=50, spread=0.05)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, vec array<double>")
    plain = type(df.groupBy("id"))
    sent = []
    real = plain.applyInArrow
    monkeypatch.setattr(plain, "applyInArrow", lambda self, f, kind: sent.append(self._df.groupBy("b", "g").agg(F.count_if("guest").alias("x"), F.count_if(~F.col("guest")).alias("y")).collect()) or real(self, f, kind))
    n = vectors.duplicate_pairs(df, 0.9, block=64).count()
    made = sum(r.x * r.y + r.y * (r.y - 1) // 2 * (r.g == 0) for r in sent[0])
    assert n <= made < 0.2 * len(m) ** 2 / 2
    assert max(max(r.x, r.y) for r in sent[0]) <= 64 * 2.5


def test_recall_of_the_index(spark, tmp_path):
    """All ids divisible by 20 as queries: at least 0.9 of the ten exact neighbours, on the embeddings table and on clusters."""
    real = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    made = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(clustered(3000))], "id long, embedding array<double>")
    for name, df in (("real", real), ("made", made)):
        index = VectorIndex.build(df, str(tmp_path / name))
        assert index.rows("long").count() == df.count()
        asked = df.where("id % 20 = 0")
        want = {(r.query, r.id) for r in vectors.knn_join(df, asked, 10).collect()}
        got = index.search_all(asked, 10).collect()
        assert len(want & {(r.query, r.id) for r in got}) >= 0.9 * len(want), name
        assert {r["rank"] for r in got} == set(range(1, 11))
    q = made.where("id = 40").first().embedding
    one = index.search(q, 10)
    want = {r.id for r in vectors.knn(made, q, 10).collect()}
    rows = one.collect()
    assert len(want & {r.id for r in rows}) >= 9 and rows[0].id == 40 and rows[0].similarity == pytest.approx(1.0)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [list" in plan.replace("isnotnull(", "").replace("#", " ") or "list#" in plan.split("PartitionFilters: [")[1][:80]
    odd = spark.createDataFrame([(1, [0.0, 0.0]), (2, None), (3, [1.0, 0.0])], "id long, embedding array<double>")
    assert [r.id for r in VectorIndex.build(odd, str(tmp_path / "odd")).search([1.0, 0.1], 3).collect()] == [3]


def sent_rows(monkeypatch, df):
    """Rows that the last grouped Arrow step got, filled in as it is planned."""
    plain, sent = type(df.groupBy("id")), []
    real = plain.applyInArrow
    monkeypatch.setattr(plain, "applyInArrow", lambda self, f, kind: sent.append(self._df.count()) or real(self, f, kind))
    return sent


def test_vectors_without_clusters_are_sent_once_a_block(spark, monkeypatch):
    """4,000 vectors in blocks of 500: no row goes to more places than there are blocks and groups of visitors, thin shells or not."""
    m = np.random.default_rng(3).normal(size=(4000, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, vec array<float>")
    sent = sent_rows(monkeypatch, df)
    u = m.astype("float32").astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    assert vectors.duplicate_pairs(df, 0.6, block=500).count() == int(np.triu(u @ u.T >= 0.6, 1).sum())
    assert sent[-1] <= len(m) * 40


def test_the_index_sends_few_rows_at_once(spark, tmp_path, monkeypatch):
    """A batch of queries is cut by the number of lists that each is sent to."""
    made = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.random.default_rng(4).normal(size=(2000, 16)))], "id long, embedding array<double>").coalesce(1)
    index = VectorIndex.build(made, str(tmp_path / "index"), lists=64)
    most = []
    real = type(made).mapInArrow

    def watched(self, f, kind):
        if kind.endswith("list long"):
            most.append(max(b.num_rows for b in f(iter(made.select(F.col("id").alias("k"), F.col("embedding").alias("v")).toArrow().to_batches()))))
        return real(self, f, kind)

    monkeypatch.setattr(type(made), "mapInArrow", watched)
    assert index.search_all(made, 5, probes=64).count() == 5 * 2000
    assert most and max(most) <= 1 << 14
