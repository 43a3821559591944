"""An index for nearest neighbours: inverted lists by coarse centre, vectors as bytes, exact scores at the end.

Centres are fitted on a bounded sample; every row is indexed. A list is a folder of a table partitioned by list, so a search reads
the probed lists only. There it reads a byte a dimension: the rest of the vector from its centre, in steps of the row's own
size. The best of these by approximate score get their exact cosine from the stored vectors. How many lists a search probes is
measured when the index is built: as many as hold TARGET of the exact neighbours of TUNE rows. Data without clusters needs most
of its lists, clustered data few. ``vectors.knn`` and ``knn_join`` stay the exact way.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.operators.vectors import _unit, doubles, dot, draw, knn_join, norm
from foliant.scale import ship

#: Rows that the centres are fitted on, rounds of that, rows of a list and queries that meet in one task.
SAMPLE, ROUNDS, BLOCK = 20_000, 8, 4096
#: Queries times lists that a task sends at once, and queries that it scores at once.
ROUTED, SLICE = 1 << 14, 512
TUNE, TARGET, NEIGHBOURS = 100, 0.97, 10
RESCORE = 10


def fit_centres(sample: np.ndarray, n: int, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means on unit vectors; a centre without members stays."""
    centres = sample[np.linspace(0, len(sample) - 1, n).astype(int)]
    for _ in range(rounds):
        near = (sample @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 1e-12, sums / np.maximum(length, 1e-12), centres)
    return centres


@dataclass
class VectorIndex:
    """A built index: folder ``rows``/list=<n>/ with (id, step, code, vector), and the centres in centres.json."""

    spark: SparkSession
    root: str

    @classmethod
    def build(cls, vectors: DataFrame, root: str, key: str = "id", vector: str = "embedding", lists: int | None = None) -> VectorIndex:
        """Index all vectors that are not null or zero. ``lists``: by default the square root of the rows, 4,096 at most."""
        spark = vectors.sparkSession
        ship(spark)
        t = vectors.select(F.col(key).alias("k"), doubles(F.col(vector)).alias("v")).where(norm(F.col("v")) > 0)
        n = t.count()
        lists = lists or max(1, min(4096, int(n**0.5)))
        sample = draw(t, max(SAMPLE, 4 * lists))
        centres = fit_centres(sample, min(lists, len(sample))) if len(sample) else np.zeros((0, 0))
        kind = vectors.schema[key].dataType.simpleString()

        def encode(batches):
            for b in batches:
                if b.num_rows:
                    m = _unit(b["v"])
                    near = (m @ centres.T).argmax(1)
                    rest = m - centres[near]
                    step = np.maximum(np.abs(rest).max(1), 1e-9) / 127
                    code = np.round(rest / step[:, None]).astype(np.int8)
                    cols = [b["k"], pa.array(near), pa.array(step), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(list(m.astype(np.float32)), pa.list_(pa.float32()))]
                    yield pa.RecordBatch.from_arrays(cols, ["id", "list", "step", "code", "vector"])

        rows = t.mapInArrow(encode, f"id {kind}, list long, step double, code binary, vector array<float>")
        # A list that holds much of the table is dealt to several tasks and files.
        rows.repartition("list", F.pmod(F.xxhash64("id"), F.lit(8))).sortWithinPartitions("list", "id").write.partitionBy("list").parquet(f"{root}/rows")
        index = cls(spark, root)
        probes = index._needed(centres, kind) if len(sample) else 0
        spark.createDataFrame([(json.dumps(centres.tolist()), kind, probes)], "centres string, kind string, probes int").coalesce(1).write.json(f"{root}/centres.json")
        return index

    def _needed(self, centres: np.ndarray, kind: str) -> int:
        """The least number of nearest lists that hold TARGET of the neighbours of TUNE rows, drawn by hash; these are searched exactly."""
        rows = self.rows(kind)
        asked = rows.select("id", "vector").orderBy(F.xxhash64(F.lit(13), "id"), "id").limit(TUNE)
        near = knn_join(rows, asked, NEIGHBOURS, vector="vector").select("query", "id").join(rows.select("id", "list"), "id")
        own = asked.select(F.col("id").alias("query"), "vector")
        places = [int((centres @ np.array(r.vector) > centres[r.list] @ np.array(r.vector)).sum()) for r in near.join(F.broadcast(own), "query").select("vector", "list").collect()]  # TUNE x NEIGHBOURS rows
        return int(np.quantile(places, TARGET)) + 1

    def _centres(self) -> tuple[np.ndarray, str, int]:
        r = self.spark.read.schema("centres string, kind string, probes int").json(f"{self.root}/centres.json").first()
        return np.array(json.loads(r.centres), float), r.kind, r.probes

    def rows(self, kind: str) -> DataFrame:
        return self.spark.read.schema(f"id {kind}, step double, code binary, vector array<float>, list long").parquet(f"{self.root}/rows")

    def search(self, query: list[float], k: int, probes: int | None = None, rescore: int = RESCORE) -> DataFrame:
        """(id, similarity) of about the k nearest rows: one top-k pass over the probed lists' codes, then rescore * k exact scores."""
        centres, kind, usual = self._centres()
        q = np.asarray(query, float) / max(float(np.linalg.norm(query)), 1e-12)
        near = np.argsort(-(centres @ q), kind="stable")[: probes or usual]
        part = self.rows(kind).where(F.col("list").isin([int(i) for i in near]))
        lead = {int(i): float(centres[i] @ q) for i in near}

        def score(batches):
            for b in batches:
                if b.num_rows:
                    code = np.frombuffer(b"".join(b["code"].to_pylist()), np.int8).reshape(b.num_rows, -1)
                    about = np.array([lead[i] for i in b["list"].to_pylist()]) + (code @ q) * b["step"].to_numpy()
                    best = np.argsort(-about, kind="stable")[: rescore * k]
                    yield pa.RecordBatch.from_arrays([b["list"].take(pa.array(best)), b["id"].take(pa.array(best)), pa.array(about[best])], ["list", "id", "about"])

        found = part.select("list", "id", "step", "code").mapInArrow(score, f"list long, id {kind}, about double").orderBy(F.desc("about"), "id").limit(rescore * k)
        exact = part.select("list", "id", "vector").join(F.broadcast(found), ["list", "id"])  # rescore * k rows
        sim = dot(doubles(F.col("vector")), F.array(*map(F.lit, q.tolist()))) / F.greatest(norm(doubles(F.col("vector"))), F.lit(1e-12))
        return exact.select("id", sim.alias("similarity")).orderBy(F.desc("similarity"), "id").limit(k)

    def search_all(self, queries: DataFrame, k: int, key: str = "id", vector: str = "embedding", probes: int | None = None, rescore: int = RESCORE) -> DataFrame:
        """(query, id, similarity, rank): the same for every row of ``queries``. A query goes to its probed lists; lists and queries
        meet in blocks, so a task holds BLOCK of each, and gives on rescore * k rows a query."""
        centres, kind, usual = self._centres()
        asked = queries.select(F.col(key).alias("k"), doubles(F.col(vector)).alias("v")).where(norm(F.col("v")) > 0)
        own = queries.schema[key].dataType.simpleString()
        few = max(1, ROUTED // max(1, min(probes or usual, len(centres))))  # a query is sent once a probed list

        def route(batches):
            for b in batches:
                for cut in (b.slice(at, few) for at in range(0, b.num_rows, few)):
                    m = _unit(cut["v"])
                    near = np.argsort(-(m @ centres.T), axis=1, kind="stable")[:, : probes or usual]
                    who = pa.array(np.repeat(np.arange(cut.num_rows), near.shape[1]))
                    yield pa.RecordBatch.from_arrays([cut["k"].take(who), cut["v"].take(who), pa.array(near.ravel())], ["k", "v", "list"])

        sent = asked.mapInArrow(route, f"k {own}, v array<double>, list long")
        rows = self.rows(kind)
        count = lambda t, name: t.groupBy("list").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.lit(1)).alias(name))
        blocks = count(rows.select("list"), "n_rows").join(count(sent.select("list"), "n_asked"), "list")  # a row a list
        place = lambda c, n: F.pmod(F.xxhash64(c), F.col(n))
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        empty = lambda c, t: F.lit(None).cast(t).alias(c)
        q = sent.join(F.broadcast(blocks), "list").withColumn("i", place("k", "n_asked")).withColumn("j", every("n_rows"))
        r = rows.select("list", "id", "step", "code").join(F.broadcast(blocks), "list").withColumn("j", place("id", "n_rows")).withColumn("i", every("n_asked"))
        both = q.select("list", "i", "j", "k", "v", empty("id", kind), empty("step", "double"), empty("code", "binary")).unionByName(r.select("list", "i", "j", empty("k", own), empty("v", "array<double>"), "id", "step", "code"))

        def score(keys: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(batches)
            asks = table["v"].is_valid().to_numpy()
            left, right = np.flatnonzero(asks), np.flatnonzero(~asks)
            if len(left) and len(right):
                c = centres[keys[0].as_py()]
                code = np.frombuffer(b"".join(table["code"].take(pa.array(right)).to_pylist()), np.int8).reshape(len(right), -1).astype(np.float32)
                step, n = table["step"].take(pa.array(right)).to_numpy(), min(rescore * k, len(right))
                asked_, ids = table["k"].combine_chunks(), table["id"].combine_chunks()
                for rows in (left[at : at + SLICE] for at in range(0, len(left), SLICE)):
                    m = _unit(table["v"].take(pa.array(rows)))
                    about = (m @ c)[:, None] + (m.astype(np.float32) @ code.T) * step[None]
                    best = np.argpartition(-about, n - 1, axis=1)[:, :n]
                    x, y = np.repeat(np.arange(len(rows)), n), best.ravel()
                    yield pa.RecordBatch.from_arrays([asked_.take(pa.array(rows[x])), pa.array(np.full(len(x), keys[0].as_py())), ids.take(pa.array(right[y])), pa.array(about[x, y])], ["query", "list", "id", "about"])

        near = both.groupBy("list", "i", "j").applyInArrow(score, f"query {own}, list long, id {kind}, about double")
        rank = lambda by: F.row_number().over(Window.partitionBy("query").orderBy(F.desc(by), "id"))
        near = near.withColumn("r", rank("about")).where(F.col("r") <= rescore * k).select("query", "list", "id")
        exact = near.join(rows.select("list", "id", "vector"), ["list", "id"]).join(asked.select(F.col("k").alias("query"), "v"), "query")
        sim = dot(doubles(F.col("vector")), F.col("v")) / F.greatest(norm(doubles(F.col("vector"))) * norm(F.col("v")), F.lit(1e-12))
        return exact.select("query", "id", sim.alias("similarity")).withColumn("rank", rank("similarity")).where(F.col("rank") <= k)
