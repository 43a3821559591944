"""Vectors: exact nearest neighbours, pooling, near-duplicate pairs, embedding."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.functions.text import lexical_tokens
from foliant.scale import ship, stash


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalise(v: Column) -> Column:
    n = F.greatest(norm(v), F.lit(1e-12))
    return F.transform(v, lambda x: x / n)


def knn(chunks: DataFrame, query: list[float], k: int, key: str = "id", vector: str = "embedding", where=None) -> DataFrame:
    """The k rows of greatest cosine with ``query``; ``where`` filters before scoring. Plans as one top-k pass: each task keeps
    k rows. The dot product unrolls to an expression that generated code evaluates."""
    q = np.asarray(query, float)
    q = q / max(float(np.linalg.norm(q)), 1e-12)
    t = chunks.where(where) if where is not None else chunks
    v = doubles(F.col(vector))
    sim = dot(v, F.array(*[F.lit(float(x)) for x in q])) / F.greatest(norm(v), F.lit(1e-12))
    t = t.withColumn("similarity", sim).withColumn("distance", 1 - F.col("similarity"))
    return t.orderBy(F.desc("similarity"), key).limit(k)


def knn_join(chunks: DataFrame, queries: DataFrame, k: int, key: str = "id", vector: str = "embedding", block: int = 2048) -> DataFrame:
    """(query, key, similarity, rank): the k nearest rows of ``chunks`` of every row of ``queries`` (same key and vector columns).

    Blocked: each block of queries meets each block of rows in one matrix product that keeps k a query, and those that tie. The
    number of blocks follows both row counts, so a task holds two blocks whatever the input.
    """
    ship(chunks.sparkSession)
    take = lambda df: df.select(F.col(key).alias("k"), doubles(F.col(vector)).alias("v"))
    rows, asked = take(chunks), take(queries)
    n_rows, n_asked = (max(1, -(-t.count() // block)) for t in (rows, asked))
    placed = lambda n: F.pmod(F.xxhash64("k"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    x = asked.select("k", "v", F.lit(True).alias("q"), placed(n_asked).alias("i"), every(n_rows).alias("j"))
    y = rows.select("k", "v", F.lit(False).alias("q"), every(n_asked).alias("i"), placed(n_rows).alias("j"))
    kind = chunks.schema[key].dataType.simpleString()

    def compare(table):
        q = table.column("q").to_numpy()
        m = np.array(table.column("v").to_pylist(), float)
        m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
        left, right, ids = np.flatnonzero(q), np.flatnonzero(~q), table.column("k").combine_chunks()
        a, b = np.zeros(0, int), np.zeros(0, int)
        if len(left) and len(right):
            sims = m[left] @ m[right].T
            n = min(k, len(right))
            kth = np.partition(sims, len(right) - n, axis=1)[:, len(right) - n, None]
            a, b = np.nonzero(sims >= kth - 1e-12)  # rows that tie with it all go on
            a, b = left[a], right[b]
        return pa.table({"query": ids.take(pa.array(a)), key: ids.take(pa.array(b)), "similarity": pa.array(np.einsum("ij,ij->i", m[a], m[b]), pa.float64())})

    near = x.unionByName(y).groupBy("i", "j").applyInArrow(compare, f"query {kind}, {key} {kind}, similarity double")
    w = Window.partitionBy("query").orderBy(F.desc("similarity"), key)
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def file_vectors(chunks: DataFrame, file: str = "file_path", vector: str = "embedding") -> DataFrame:
    """(file, vec): the element-wise mean of a file's vectors; positions are averaged separately, so no group is collected whole."""
    each = chunks.select(file, F.posexplode(doubles(F.col(vector))).alias("pos", "v")).groupBy(file, "pos").agg(F.avg("v").alias("v"))
    return each.groupBy(file).agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("s")).select(file, F.transform("s", lambda x: x["v"]).alias("vec"))


def similar_files(chunks: DataFrame, path: str, k: int = 5, file: str = "file_path", key: str = "id", vector: str = "embedding") -> DataFrame:
    """(file, similarity, key) of the k other files whose best chunk is nearest to the mean vector of ``path``."""
    query = file_vectors(chunks.where(F.col(file) == path), file, vector).select(F.col("vec").alias("__q"))
    others = chunks.where(F.col(file) != path).crossJoin(F.broadcast(query))  # one row
    v = doubles(F.col(vector))
    sim = dot(v, F.col("__q")) / F.greatest(norm(v) * norm(F.col("__q")), F.lit(1e-12))
    best = others.select(file, key, sim.alias("similarity")).groupBy(file).agg(F.max_by(F.struct("similarity", key), F.struct("similarity", -F.col(key) if dict(others.dtypes)[key] in ("int", "bigint") else key)).alias("b"))
    return best.select(file, "b.similarity", F.col(f"b.{key}").alias(key)).orderBy(F.desc("similarity"), file).limit(k)


#: Vectors drawn by hash as centres of the duplicate search, at most; shells by angle around each; rows compared at a time.
CENTRES, SHELLS, SLICE = 512, 48, 1024


def draw(t: DataFrame, n: int) -> np.ndarray:
    """About ``n`` vectors of (k, v) that are not zero, of unit length, chosen by a hash of the key: at most ``n`` reach the driver."""
    total = t.count()
    t = t.where(F.pmod(F.xxhash64(F.lit(11), "k"), F.lit(1_000_000)) < max(1.0, 2e6 * n / max(total, 1)))
    rows = t.select("v", F.xxhash64(F.lit(12), "k").alias("h")).orderBy("h", "v").limit(n).collect()
    m = np.array([r.v for r in rows], float)
    return m / np.linalg.norm(m, axis=1, keepdims=True) if len(rows) else m


def _matrix(column: pa.Array) -> np.ndarray:
    """The vectors of a list column as doubles, without a Python object for each number where all have one length and no nulls."""
    size = pc.unique(pc.list_value_length(column))
    if len(size) == 1 and size[0].is_valid and (flat := column.flatten()).null_count == 0:
        return flat.to_numpy(zero_copy_only=False).astype(float).reshape(len(column), size[0].as_py())
    return np.array(column.to_pylist(), float)


def _unit(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    m = _matrix(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _angles(m: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(m @ centres.T, -1, 1))


def _apart(centres: np.ndarray, reach: float) -> bool:
    """Whether blocks around most of the centres lie so far apart that no pair can join them, by the centres' own distances."""
    if len(centres) < 2:
        return False
    angle = _angles(centres, centres)
    np.fill_diagonal(angle, np.pi)
    return (angle <= 2 * np.median(angle.min(1)) + reach).mean() < 0.25


def duplicate_pairs(vectors: DataFrame, threshold: float = 0.85, key: str = "id", vector: str = "vec", block: int = 8192, ordered: bool = False) -> DataFrame:
    """(a, b, similarity), a < b, of all pairs with cosine >= threshold, most similar first if ``ordered``; zero vectors pair with nothing.

    Exact. Each vector belongs to its nearest centre and there to a shell of angles; blocks are parts of shells, and thin shells
    that lie side by side make one block. A row is sent to each block that it may have a pair in; where the centres aren't apart
    only some two a block are taken, so it is sent about as often as the table has full blocks. Angles obey the triangle inequality, so a vector within acos(threshold) of one in a block has an angle to the block's centre that is at most
    so far outside the shell's own angles: it is sent to those blocks alone, and of two blocks only to the later one. One matrix
    product a slice of a block emits the pairs over the threshold. Blocks and their visitors are split by size, so a task holds two
    blocks and a slice's pairs whatever the input; one row a shell reaches the driver.
    """
    spark = vectors.sparkSession
    ship(spark)
    reach = float(np.arccos(np.clip(threshold, -1, 1))) + 1e-6
    kept = "array<float>" if vectors.schema[vector].dataType.elementType == T.FloatType() else "array<double>"
    t = vectors.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(vector).cast(kept).alias("v")).where(norm(doubles(F.col("v"))) > 0)
    kind = vectors.schema[key].dataType.simpleString()
    centres = draw(t, CENTRES)
    if not len(centres):
        return spark.createDataFrame([], f"a {kind}, b {kind}, similarity double")

    if not _apart(centres, reach):
        centres = centres[: max(1, 2 * t.count() // block)]

    def place(batches):
        for b in batches:
            angle = _angles(_unit(b["v"]), centres) if b.num_rows else np.zeros((0, 1))
            near = angle.argmin(1)
            own = angle[np.arange(len(near)), near]
            yield pa.RecordBatch.from_arrays([b["k"], b["v"], pa.array(near * SHELLS + np.minimum((own / np.pi * SHELLS).astype(int), SHELLS - 1)), pa.array(own)], ["k", "v", "shell", "angle"])

    t = stash(t.mapInArrow(place, f"k {kind}, v {kept}, shell long, angle double").withColumn("h", F.xxhash64("k")))
    shells = sorted(map(tuple, t.groupBy("shell").agg(F.count(F.lit(1)), F.min("angle"), F.max("angle")).collect()))  # CENTRES x SHELLS at most
    number, joined = {}, []
    for s, n, near, far in shells:
        last = joined[-1] if joined else None
        if last and last[0] == s // SHELLS and last[1] + n <= block:
            last[1:] = last[1] + n, min(last[2], near), max(last[3], far)
        else:
            joined.append([s // SHELLS, n, near, far])
        number[s] = len(joined) - 1
    shells = joined
    centre = np.array([s[0] for s in shells])
    parts = np.array([-(-s[1] // block) for s in shells])
    low, high = np.array([s[2] for s in shells]), np.array([s[3] for s in shells])
    base = np.concatenate(([0], np.cumsum(parts)))

    def visited(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(own block, row, shell): which shells each row has to visit, its own among them where it has several parts."""
        own = np.array([number[s] for s in b["shell"].to_pylist()], int)
        at = base[own] + b["h"].to_numpy() % parts[own]
        angle = _angles(_unit(b["v"]), centres)[:, centre]
        row, shell = np.nonzero((angle - reach <= high) & (angle + reach >= low) & (np.arange(len(shells)) >= own[:, None]))
        return at, row, shell

    def count(batches):
        total = np.zeros(len(shells), int)
        for b in batches:
            if b.num_rows:
                total += np.bincount(visited(b)[2], minlength=len(shells))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(shells))), pa.array(total)], ["shell", "n"])

    visits = dict(map(tuple, t.mapInArrow(count, "shell long, n long").groupBy("shell").agg(F.sum("n")).collect()))
    groups = np.array([max(1, -(-visits.get(i, 0) // block)) for i in range(len(shells))])

    def send(batches):
        for b in batches:
            for cut in (b.slice(o, 512) for o in range(0, b.num_rows, 512)):
                at, row, shell = visited(cut)
                h = cut["h"].to_numpy()
                own = np.array([number[s] for s in cut["shell"].to_pylist()], int)
                # Residents are in all groups of their block; a visitor is in one group of each part.
                home = np.repeat(np.arange(len(at)), groups[own])
                seat = np.concatenate([np.arange(g) for g in groups[own]])
                guest = np.repeat(np.arange(len(row)), parts[shell])
                to = base[shell[guest]] + np.concatenate([np.arange(p) for p in parts[shell]]) if len(row) else np.zeros(0, int)
                later = to > at[row[guest]]
                guest, to = guest[later], to[later]
                group = (h[row[guest]] >> 20) % groups[shell[guest]]
                who = np.concatenate((home, row[guest]))
                cols = [cut["k"].take(pa.array(who)), cut["v"].take(pa.array(who)), pa.array(np.concatenate((at[home], to))), pa.array(np.concatenate((seat, group))), pa.array(np.arange(len(who)) >= len(home))]
                yield pa.RecordBatch.from_arrays(cols, ["k", "v", "b", "g", "guest"])

    def compare(keys: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        ids, guest, m = table["k"].combine_chunks(), table["guest"].to_numpy(), _unit(table["v"])
        k = ids.to_numpy(zero_copy_only=False)
        left, right = np.flatnonzero(guest), np.flatnonzero(~guest)
        home = m[right]
        # Slices of visitors meet all residents; in one group, slices of residents meet those that follow.
        slices = [(left[o : o + SLICE], 0, False) for o in range(0, len(left), SLICE)]
        if keys[1].as_py() == 0:
            slices += [(right[o : o + SLICE], o, True) for o in range(0, len(right), SLICE)]
        for rows, first, same in slices:
            sims = m[rows] @ home[first:].T
            over = sims >= threshold - 1e-12
            i, j = np.nonzero(np.triu(over, 1) if same else over)
            s, x, y = sims[i, j], rows[i], right[first + j]
            keep = k[x] != k[y]
            s, x, y = s[keep], x[keep], y[keep]
            swap = k[x] > k[y]
            x, y = np.where(swap, y, x), np.where(swap, x, y)
            for o in range(0, len(s), 1 << 17):
                cut = slice(o, o + (1 << 17))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(x[cut])), ids.take(pa.array(y[cut])), pa.array(s[cut])], ["a", "b", "similarity"])

    sent = t.mapInArrow(send, f"k {kind}, v {kept}, b long, g long, guest boolean")
    out = sent.groupBy("b", "g").applyInArrow(compare, f"a {kind}, b {kind}, similarity double")
    return out.orderBy(F.desc("similarity"), "a", "b") if ordered else out


class Embedder(Protocol):
    """What turns texts into unit vectors; one instance a worker."""

    dim: int

    def encode(self, texts: list[str]) -> np.ndarray: ...


@functools.lru_cache(1 << 16)
def _hashed(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")


class HashEmbedder:
    """Deterministic vectors of signed, hashed tokens; blank text is a single space."""

    def __init__(self, dim: int = 512):
        self.dim = dim

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for i, words in enumerate(texts):
            places = [_hashed(w) for w in words.split() or [" "]]
            out[i] = np.bincount([h % self.dim for h in places], [1.0 if h >> 63 else -1.0 for h in places], self.dim)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def masked_mean(tokens: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Mean of the token vectors (texts, tokens, dim) that the mask (texts, tokens) keeps, then of unit length."""
    kept = mask[..., None].astype(float)
    mean = (tokens * kept).sum(1) / np.maximum(kept.sum(1), 1e-9)
    return mean / np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-12)


class PooledEmbedder:
    """An embedder over a token model, which ``load`` makes where it is first used: once in each worker.

    The model takes texts and a number of tokens, and gives token vectors and their mask, (texts, tokens, dim) and (texts, tokens).
    Blank texts are a single space; texts go in batches; tokens beyond ``max_tokens`` are left out by the model and again here.
    """

    def __init__(self, load, dim: int, name: str = "", max_tokens: int = 512, batch: int = 32):
        self.load, self.dim, self.name, self.max_tokens, self.batch = load, dim, name, max_tokens, batch
        self._model = None

    def __getstate__(self):
        return self.__dict__ | {"_model": None}  # a loaded model stays where it is

    def preload(self) -> None:
        if self._model is None:
            self._model = self.load()

    def encode(self, texts: list[str]) -> np.ndarray:
        self.preload()
        out = [np.zeros((0, self.dim))]
        for at in range(0, len(texts), self.batch):
            tokens, mask = self._model([t if t.strip() else " " for t in texts[at : at + self.batch]], self.max_tokens)
            out.append(masked_mean(np.asarray(tokens, float)[:, : self.max_tokens], np.asarray(mask)[:, : self.max_tokens]))
        return np.concatenate(out)


def embedder_status(spark, embedder: Embedder | None) -> DataFrame:
    """One row: model, backend, dim, ready, loaded (in this process)."""
    loaded = embedder is not None and getattr(embedder, "_model", True) is not None
    row = (getattr(embedder, "name", None) or None, type(embedder).__name__ if embedder else None, embedder.dim if embedder else None, embedder is not None, loaded)
    return spark.createDataFrame([row], "model string, backend string, dim int, ready boolean, loaded boolean")


def embed(df: DataFrame, embedder: Embedder, text: str = "content", out: str = "embedding") -> DataFrame:
    """``df`` with a vector column; texts pass to the workers as their lexical tokens, in Arrow batches, 32 at a time."""
    ship(df.sparkSession)
    schema = T.StructType([*df.drop(out).schema.fields, T.StructField(out, T.ArrayType(T.FloatType()))])

    def encode(batches):
        for b in batches:
            for at in range(0, b.num_rows, 32):
                cut = b.slice(at, 32)
                v = embedder.encode(cut.column(cut.num_columns - 1).to_pylist()).astype("float32")
                vectors = pa.array(list(v), pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([*cut.columns[:-1], vectors], names=[*cut.schema.names[:-1], out])

    words = F.array_join(lexical_tokens(F.coalesce(F.col(text), F.lit(""))), " ")
    return df.drop(out).withColumn("__words", words).mapInArrow(encode, schema)


def cache_vectors(chunks: DataFrame) -> DataFrame:
    return stash(file_vectors(chunks))
