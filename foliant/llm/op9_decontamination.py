"""Benchmark decontamination over a distributed positional inverted index.

The index is partitioned by document: a block holds the postings (term -> word positions, sorted) of some 512 KB of whole
texts, and is one stored row. Searching a block needs no other block. For each test phrase that has all its terms in a block, the
offset-adjusted lists are intersected from the rarest term on. A query set that is small by its bytes goes to every block, and no
posting is shuffled; a larger one goes, by its windows' rarest terms, to the blocks that hold these terms, in a join that
shuffles whole blocks once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import grams
from foliant.scale import read_table, ship, sized, stash

#: Words of a window.
WINDOW = 10
#: Bytes of test texts that go to the driver and to every block; beyond these, windows meet their blocks in a join.
QUERY_BYTES = 2 << 20
#: Windows that one block is searched for at once.
GROUP = 20_000
INDEX = "block long, doc_ids array<long>, doc_words array<int>, terms binary, counts binary, positions binary"
FOUND = "block long, ordinal int, doc_id long, n_words long, spans array<struct<a:int,b:int>>, items array<string>"
MATCH = "phrase int, doc_id long, position int, exact boolean"


def _postings(batches):
    part, k = TaskContext.get().partitionId(), 0
    for batch in batches:
        ids = batch.column(0)
        for row, data, starts, ends in grams.text_chunks(batch.column(1)):
            words, counts = grams.word_hashes(data, starts, ends, grams.ALPHANUMERIC)
            order = np.argsort(words, kind="stable").astype(np.uint32)
            terms, sizes = np.unique(words, return_counts=True)
            cols = [[(part << 32) + k], [ids.slice(row, len(starts)).to_pylist()], [counts.tolist()], [terms.tobytes()], [sizes.astype(np.uint32).tobytes()], [order.tobytes()]]
            types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["block", "doc_ids", "doc_words", "terms", "counts", "positions"])
            k += 1


def build_index(df: DataFrame) -> DataFrame:
    """The stored index of (doc_id, text): every word of every text. Null and empty texts are documents without words."""
    ship(df.sparkSession)
    return stash(df.select("doc_id", "text").mapInArrow(grams.frugal(_postings), INDEX))


def term_statistics(index: DataFrame) -> DataFrame:
    """(term, n_words): how often each term hash occurs in the whole index."""

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                t = np.frombuffer(b.column(0)[i].as_py(), np.int64)
                n = np.frombuffer(b.column(1)[i].as_py(), np.uint32).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(n)], names=["term", "n"])

    return index.select("terms", "counts").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n_words"))


class Block:
    """One row of the index, opened for search."""

    def __init__(self, doc_words, terms, counts, positions):
        self.terms = np.frombuffer(terms, np.uint64)
        self.counts = np.frombuffer(counts, np.uint32).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.counts)])
        self.positions = np.frombuffer(positions, np.uint32).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(np.asarray(doc_words, np.int64))])

    def locate(self, wanted: np.ndarray) -> np.ndarray:
        """Number of each wanted term here, or -1."""
        if not len(self.terms):
            return np.full(len(wanted), -1)
        at = np.minimum(np.searchsorted(self.terms, wanted), len(self.terms) - 1)
        return np.where(self.terms[at] == wanted, at, -1)

    def list(self, term: int) -> np.ndarray:
        return self.positions[self.starts[term] : self.starts[term + 1]]

    def document(self, position):
        return np.searchsorted(self.first, position, "right") - 1

    def phrase(self, terms: list[int]) -> np.ndarray:
        """Positions where the phrase starts: offset-adjusted lists, the rarest first."""
        order = sorted(range(len(terms)), key=lambda i: self.counts[terms[i]])
        at = self.list(terms[order[0]]) - order[0]
        for i in order[1:]:
            other = self.list(terms[i])
            k = np.minimum(np.searchsorted(other, at + i), len(other) - 1)
            at = at[other[k] == at + i]
            if not len(at):
                return at
        at = at[(at >= 0) & (at + len(terms) <= self.first[-1])]
        return at[self.document(at) == self.document(at + len(terms) - 1)]

    def near(self, terms: list[int], reach: int) -> np.ndarray:
        """Positions of the rarest term with every other term within ``reach`` words, in the same document."""
        terms = sorted(set(terms), key=lambda t: self.counts[t])
        at = self.list(terms[0])
        for t in terms[1:]:
            other = self.list(t)
            doc = self.document(at)
            low, high = np.maximum(at - reach, self.first[doc]), np.minimum(at + reach, self.first[doc + 1] - 1)
            at = at[np.searchsorted(other, low) < np.searchsorted(other, high, "right")]
        return at


def windows(texts: list[str | None], size: int = WINDOW) -> list[list[np.ndarray]]:
    """Per text its distinct windows as arrays of term hashes; a text of fewer words, but not none, is one window."""
    out = []
    for _, data, starts, ends in grams.text_chunks(pa.array(texts, pa.string())):
        words, counts = grams.word_hashes(data, starts, ends, grams.ALPHANUMERIC)
        at = 0
        for n in counts.tolist():
            w = words[at : at + n]
            seen = {w[i : i + size].tobytes(): w[i : i + size] for i in range(max(1, n - size + 1))} if n else {}
            out.append(list(seen.values()))
            at += n
    return out


class Windows:
    """A query set's windows, ready to be searched for in blocks."""

    def __init__(self, flat: list[np.ndarray]):
        self.flat = flat
        self.wanted = np.unique(np.concatenate([np.zeros(0, np.uint64), *flat]))
        self.grid = np.full((len(flat), max([1, *map(len, flat)])), len(self.wanted), np.int64)  # the last number stands for no term
        for i, w in enumerate(flat):
            self.grid[i, : len(w)] = np.searchsorted(self.wanted, w)

    def found(self, b: Block):
        """(window, position, words) of every occurrence in the block."""
        if not len(self.flat):
            return
        found = np.append(b.locate(self.wanted), -2)[self.grid]
        for i in np.flatnonzero((found != -1).all(1)):
            terms = [int(t) for t in found[i] if t >= 0]
            for p in b.phrase(terms).tolist():
                yield int(i), p, len(terms)


def merged(spans) -> list[dict]:
    out: list[dict] = []
    for a, e in sorted(set(spans)):
        if out and a <= out[-1]["b"]:
            out[-1]["b"] = max(e, out[-1]["b"])
        else:
            out.append({"a": a, "b": e})
    return out


def _search(items: list[str], phrases: list[list[np.ndarray]]):
    """The map over blocks that finds every window of the items."""
    owner = [i for i, p in enumerate(phrases) for _ in p]
    asked = Windows([w for p in phrases for w in p])

    def block(row):
        b = Block(row["doc_words"], row["terms"], row["counts"], row["positions"])
        n_docs = len(row["doc_words"])
        spans, names = [[] for _ in range(n_docs)], [set() for _ in range(n_docs)]
        for i, p, n in asked.found(b):
            d = int(b.document(p))
            spans[d].append((p - int(b.first[d]), p - int(b.first[d]) + n))
            names[d].add(items[owner[i]])
        return list(map(merged, spans)), [sorted(x) for x in names]

    def run(batches):
        span = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
        for batch in batches:
            for i in range(batch.num_rows):
                row = {k: batch.column(k)[i].as_py() for k in batch.schema.names}
                s, names = block(row)
                n = len(s)
                cols = [pa.array([row["block"]] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(row["doc_words"], pa.int64()), pa.array(s, span), pa.array(names, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(cols, names=["block", "ordinal", "doc_id", "n_words", "spans", "items"])

    return run


def _window_rows(size: int):
    """(item, text) -> (item, win, place, term): each term of each window of an item, by a hash of the window."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                cut = batch.slice(at, 64)
                for item, found in zip(cut.column(0).to_pylist(), windows(cut.column(1).to_pylist(), size), strict=True):
                    for k in range(0, len(found), 4096):
                        part = found[k : k + 4096]
                        win = [int((grams.mix(w + np.arange(1, len(w) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64)).view(np.int64)) for w in part]
                        terms = pa.array([w.view(np.int64) for w in part], pa.list_(pa.int64()))
                        yield pa.RecordBatch.from_arrays([pa.array([item] * len(part), pa.string()), pa.array(win, pa.int64()), terms], names=["item", "win", "terms"])

    return run


def _block_terms(batches):
    for b in batches:
        for i in range(b.num_rows):
            t = np.frombuffer(b.column(1)[i].as_py(), np.int64)
            for k in range(0, len(t), 1 << 16):
                part = t[k : k + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), b.column(0)[i].as_py())), pa.array(part)], names=["block", "term"])


def _find_in_block(left: pa.Table, right: pa.Table) -> pa.Table:
    """One block (left, one row) and the windows to search for in it: (block, ordinal, win, spans)."""
    rows = []
    if left.num_rows and right.num_rows:
        row = {k: left.column(k)[0].as_py() for k in ("block", "doc_words", "terms", "counts", "positions")}
        b = Block(row["doc_words"], row["terms"], row["counts"], row["positions"])
        win, spans = right.column("win").to_pylist(), {}
        for i, p, n in Windows([np.array(w, np.int64).view(np.uint64) for w in right.column("words").to_pylist()]).found(b):
            d = int(b.document(p))
            spans.setdefault((d, win[i]), []).append((p - int(b.first[d]), p - int(b.first[d]) + n))
        rows = [(row["block"], d, w, merged(s)) for (d, w), s in spans.items()]
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["block", "ordinal", "win", "spans"])


def _joined(index: DataFrame, items: DataFrame, size: int) -> DataFrame:
    """What ``find_items`` gives, for a query set of any size: nothing of it reaches the driver, the index is searched once.

    Of each window the rarest term in the index names the blocks that may hold it; a window with a term that the index lacks
    occurs nowhere. A block is searched for at most some GROUP windows at once.
    """
    each = stash(items.mapInArrow(grams.frugal(_window_rows(size)), "item string, win long, terms array<long>"))
    asked = stash(each.groupBy("win").agg(F.first("terms").alias("words")))
    terms = asked.select(F.explode(F.array_distinct("words")).alias("term")).distinct()
    counts = stash(term_statistics(index).join(terms, "term", "left_semi"))
    per = asked.select("win", F.size(F.array_distinct("words")).alias("n"), F.explode(F.array_distinct("words")).alias("term")).join(counts, "term")
    rare = stash(per.groupBy("win", "n").agg(F.count(F.lit(1)).alias("known"), F.min(F.struct("n_words", "term")).alias("r")).where("known = n").select("win", F.col("r.term").alias("term")))
    held = index.select("block", "terms").mapInArrow(_block_terms, "block long, term long").join(rare.select("term").distinct(), "term", "left_semi")
    pairs = stash(held.join(rare, "term").select("block", "win"))
    groups = pairs.groupBy("block").agg(F.expr(f"int((count(*) + {GROUP - 1}) div {GROUP})").alias("groups"))
    groups = stash(groups)
    left = index.drop("doc_ids").join(groups, "block").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).drop("groups")
    right = pairs.join(groups.select(F.col("block").alias("__b"), F.col("groups").alias("__n")), F.col("block") == F.col("__b")).join(asked, "win")
    right = right.select("block", "win", "words", F.pmod(F.xxhash64("win"), F.col("__n")).cast("int").alias("part"))
    found = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(_find_in_block, "block long, ordinal int, win long, spans array<struct<a:int,b:int>>")
    found = stash(found)
    names = found.select("block", "ordinal", "win").join(each.select("win", "item"), "win").groupBy("block", "ordinal").agg(F.collect_set("item").alias("items"))
    hits = found.groupBy("block", "ordinal").agg(F.flatten(F.collect_list("spans")).alias("spans")).join(names, ["block", "ordinal"])
    docs = index.select("block", F.posexplode(F.arrays_zip("doc_ids", "doc_words")).alias("ordinal", "d"))
    out = docs.join(hits, ["block", "ordinal"], "left")
    none = F.array().cast("array<struct<a:int,b:int>>")
    return out.select("block", "ordinal", F.col("d.doc_ids").alias("doc_id"), F.col("d.doc_words").cast("long").alias("n_words"), F.coalesce("spans", none).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def find_items(index: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """One row a document: spans of its words inside windows of (item_id, text), and the items whose windows occur.

    Null item texts have no windows. Items that share an id count as one. A query set of up to QUERY_BYTES is collected and
    searched for in every block; a larger one is joined with the index by its windows' rarest terms. Both find the same.
    """
    items = items.where("text is not null").select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    if (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) > QUERY_BYTES:
        return _joined(index, items, size)
    rows = items.collect()
    return index.mapInArrow(grams.frugal(_search([r.item for r in rows], windows([r.text for r in rows], size))), FOUND)


def contamination(df: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans, items), one row for each row of ``df``.

    Null or empty texts have no words and are clean; repeated rows are judged alike; an empty table gives no rows, an empty
    query set leaves every document clean. Of ``df`` only doc_id and text are read, of ``items`` item_id and text, so other
    columns can't clash.
    """
    found = find_items(build_index(df), items, size)
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    step = lambda s, x: F.struct(F.greatest(s["end"], x["b"]).alias("end"), (s["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(s["end"], x["a"]))).cast("long").alias("n"))
    n_hit = F.aggregate(F.array_sort("spans"), start, step, lambda s: s["n"])
    out = found.withColumn("n_hit", n_hit).withColumn("n_items", F.size("items").cast("long"))
    sha = F.sha2(F.array_join(F.array_sort("items"), ","), 256)
    return out.withColumn("items_sha256", sha).withColumn("contaminated", F.col("n_hit") > 0).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans", "items")


def phrase_matches(index: DataFrame, phrases: list[str], slop: int | None = None) -> DataFrame:
    """(phrase, doc_id, position, exact): every exact occurrence of each phrase, and with ``slop`` every posting of its rarest
    term that has all other terms within len(phrase) + slop words. position counts the document's words from 0."""
    terms = [w[0] if w else None for w in windows(phrases, 1 << 30)]

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {k: batch.column(k)[i].as_py() for k in batch.schema.names}
                b, out = Block(row["doc_words"], row["terms"], row["counts"], row["positions"]), []
                for k, w in enumerate(terms):
                    here = b.locate(w) if w is not None else np.array([-1])
                    if (here < 0).any():
                        continue
                    found = [(p, True) for p in b.phrase(here.tolist())]
                    found += [(p, False) for p in b.near(here.tolist(), len(w) + slop)] if slop is not None else []
                    out += [(k, row["doc_ids"][int(b.document(p))], int(p - b.first[int(b.document(p))]), e) for p, e in found]
                cols = list(zip(*out, strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int32(), pa.bool_()), strict=True)], names=["phrase", "doc_id", "position", "exact"])

    return index.mapInArrow(run, MATCH)


def contaminated_ids(df: DataFrame, items: DataFrame) -> DataFrame:
    return sized(stash(contamination(df, items).where("contaminated").select("doc_id").distinct()))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def decontaminated(df: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``df`` whose doc_id has no contaminated text (rows without an id count as one id)."""
    bad = contaminated_ids(df, items).withColumnRenamed("doc_id", "__d")
    return df.join(bad, df["doc_id"].eqNullSafe(bad["__d"]), "left_anti")
