"""N-gram Jaccard join by PartEnum signatures.

Sets are banded by size. Two sets of Jaccard similarity g or more lie in the same or in neighbouring bands, and differ in at
most d elements, d following from the band. The feature domain is cut into d // 2 + 1 parts of three cells: in one part the
two sets differ in one cell at most, so among the three two-cell subsets of that part one projects both sets alike. Every set
therefore emits, for its own band and the next, one signature per part and subset; sets that link share one. Empty
projections, which many sets share, are spared by a few more parts (see ``band_shape``).

Copies (equal sets) are one class from the start. Buckets of a signature stream through one sorted pass, which keeps those of
two classes or more. Each class is first verified against the class that it meets in most buckets; what these links leave in
different components is compared, in blocks, by a lower bound of the difference (parity sketches), then exactly. So no link
between different texts is lost, and no group is expanded into all its pairs where a few links already connect it.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import grams
from foliant.llm.components import components
from foliant.scale import read_table, ship, sized, stash

#: Words of a shingle and least similarity, in hundredths, of this query and of near-duplicate stages.
SHINGLE = 4
PERCENT = 85
#: Classes of one bucket compared at once.
BLOCK = 2048
SKETCH_WORDS = 16
_PARTS_SEED = np.uint64(0xD6E8FEB86659FD93)


def text_hash(text):
    """Identity of a text (a null one counts as empty)."""
    t = F.coalesce(text, F.lit(""))
    return F.xxhash64(t, F.length(t))


@functools.cache
def bands(percent: int) -> np.ndarray:
    """Least size of each band; a band's greatest size times percent / 100 is at most its least."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(out[-1] * 100 // percent + 1)
    return np.array(out, np.int64)


def most_apart(top: int, percent: int) -> int:
    """Greatest symmetric difference of two linked sets of at most ``top`` elements."""
    return 2 * top * (100 - percent) // (100 + percent)


@functools.cache
def band_shape(band: int, percent: int) -> tuple[int, int, int]:
    """(difference d, parts p, spare z) of a band.

    d differing elements spoil at most p + d of the 3 p subsets (one element in a part spoils two subsets, a second the
    third), so 2 p - d or more agree. p is chosen so that more than z agree: a set with at most z empty subsets can then
    leave these out, as one of its other subsets agrees as well. z is what hashing rarely exceeds in the band's least set.
    """
    b = bands(percent)
    d, least = most_apart(int(b[band + 1]) - 1, percent), int(b[max(0, band - 1)])
    z, p = 0, d // 2 + 1
    for _ in range(8):
        mean = 3 * p * float(np.exp(-2 * least / (3 * p)))
        z = min(int(mean + 4 * mean**0.5) + 1, max(1, least // 8))
        p = (d + z) // 2 + 1
    return d, p, z


def signatures(h: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Signatures of one set of distinct hashes: of its own band and the next, for every part and each two of its three cells.

    Empty projections are left out by sets with at most z of them, and emitted by the few others, so that of any two linked
    sets either one has a non-empty agreeing projection, or both emit the empty ones.
    """
    n = len(h)
    if not n:
        return np.zeros(0, np.uint64)
    own = int(np.searchsorted(bands(percent), n, "right")) - 1
    out = []
    for band in (own, own + 1):
        d, parts, spare = band_shape(band, percent)
        if d == 0:  # only equal sets link here, and those are one class
            continue
        cell = ((grams.mix(h ^ (_PARTS_SEED + np.uint64(band))) >> np.uint64(11)) % np.uint64(3 * parts)).astype(np.int64)
        order = np.argsort(cell, kind="stable")
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(grams.mix(h[order] + np.uint64(0x632BE59BD9B4E019)), out=total[1:])
        size = np.bincount(cell, minlength=3 * parts)
        ends = np.concatenate([[0], np.cumsum(size)])
        s, size = (total[ends[1:]] - total[ends[:-1]]).reshape(parts, 3), size.reshape(parts, 3)
        pairs = (s + np.roll(s, -1, 1)).ravel()
        empty = (size + np.roll(size, -1, 1)).ravel() == 0
        place = np.arange(3 * parts, dtype=np.uint64) + (np.uint64(band) << np.uint64(40))
        sig = grams.mix(grams.mix(pairs) + place * np.uint64(0x9E3779B97F4A7C15))
        out.append(sig[~empty] if empty.sum() <= spare else sig)
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def class_hash(h: np.ndarray) -> tuple[int, int]:
    a = np.uint64(len(h)) + grams.mix(h).sum(dtype=np.uint64)
    b = grams.mix(h + np.uint64(0x2545F4914F6CDD1D)).sum(dtype=np.uint64)
    return int(grams.mix(np.array([a]))[0].view(np.int64)), int(grams.mix(np.array([b]))[0].view(np.int64))


def _sets(batch, column: int, shingle: int):
    """(first row, sets) over runs of a few rows, so that one run is in memory at a time."""
    for row, data, starts, ends in grams.text_chunks(batch.column(column)):
        words, counts = grams.word_hashes(data, starts, ends, grams.NOT_SPACE)
        yield row, grams.shingles(words, counts, shingle)


def _lists(arrays: list[np.ndarray | None]) -> pa.Array:
    """Arrays of 64-bit numbers, or None, as a list column without Python numbers in between."""
    sizes = np.array([0 if a is None else len(a) for a in arrays], np.int64)
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    flat = np.concatenate([np.zeros(0, np.uint64), *[a for a in arrays if a is not None]]).view(np.int64)
    none = np.array([a is None for a in arrays], bool)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat), mask=pa.array(none))


def _features(shingle: int):
    def run(batches):
        for batch in batches:
            for row, sets in _sets(batch, 1, shingle):
                keys, cut = [class_hash(h) for h in sets], batch.slice(row, len(sets))
                cols = [cut.column(0), cut.column(2), pa.array([len(h) for h in sets], pa.int64()), *[pa.array([k[i] for k in keys], pa.int64()) for i in (0, 1)]]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "text_hash", "n_shingles", "c1", "c2"])

    return run


def _signature_rows(shingle: int, percent: int):
    """(text) -> (c1, sig): signatures of each set; copies inside a batch emit theirs once."""

    def run(batches):
        for batch in batches:
            met: set[tuple[int, int]] = set()
            for _, sets in _sets(batch, 0, shingle):
                c1, sig = [], []
                for h in sets:
                    k = class_hash(h)
                    if k not in met and len(h):
                        met.add(k)
                        c1.append(k[0])
                        sig.append(signatures(h, percent))
                yield pa.RecordBatch.from_arrays([pa.array(c1, pa.int64()), _lists(sig)], names=["c1", "sig"])

    return run


def _buckets(batches):
    """Sorted (sig, c1) -> (sig, pivot, c1) of signatures with two classes or more; the pivot is the least class. O(1) state."""
    held: tuple[int, int] | None = None  # the last signature so far and its least class
    emitted, last = False, None
    for batch in batches:
        sig, c = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(sig):
            continue
        new = np.ones(len(sig), bool)
        new[1:] = (sig[1:] != sig[:-1]) | (c[1:] != c[:-1])
        if last == (sig[0], c[0]):
            new[0] = False
        last = (sig[-1], c[-1])
        sig, c = sig[new], c[new]
        if not len(sig):
            continue
        first = np.ones(len(sig), bool)
        first[1:] = sig[1:] != sig[:-1]
        runs = np.flatnonzero(first)
        pivot = c[runs][np.cumsum(first) - 1]
        sizes = np.diff(np.append(runs, len(sig)))
        keep = np.repeat(sizes > 1, sizes)
        extra = None
        if held is not None and held[0] == sig[0]:
            k = sizes[0]
            pivot[:k] = held[1]
            keep[:k] = True
            if not emitted:
                extra = held
            emitted = True
            if len(runs) > 1:
                emitted = bool(sizes[-1] > 1)
        else:
            emitted = bool(sizes[-1] > 1)
        held = (int(sig[-1]), int(pivot[-1]))
        s, p, m = sig[keep], pivot[keep], c[keep]
        if extra is not None:
            s, p, m = (np.concatenate([[x], y]) for x, y in zip((extra[0], extra[1], extra[1]), (s, p, m), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (s, p, m)], names=["sig", "pivot", "c1"])


def _class_sets(shingle: int):
    def run(batches):
        for batch in batches:
            for _, sets in _sets(batch, 1, shingle):
                sketch = []
                for h in sets:
                    bits = np.bincount((grams.mix(h ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(64 * SKETCH_WORDS)).astype(np.int64), minlength=64 * SKETCH_WORDS) & 1
                    sketch.append(np.packbits(bits.astype(np.uint8)).tobytes())
                cols = [pa.array([class_hash(h)[0] for h in sets], pa.int64()), pa.array([len(h) for h in sets], pa.int64()), _lists(sets), pa.array(sketch, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["c1", "n", "items", "sketch"])

    return run


def close_pairs(c1, label, n, sketch, left, percent: int, forest: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (one of ``left``, any other) of one block with different labels that the size and parity bounds allow.

    forest: of these only what joins all labels that they connect, closest first in each row: fewer pairs than labels.
    """
    a, b = [], []
    _, root = np.unique(label, return_inverse=True)
    for i in left.tolist():
        j = np.flatnonzero((root != root[i]) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i])))
        apart = np.bitwise_count(sketch[j] ^ sketch[i]).sum(1, dtype=np.int64)
        ok = apart * (100 + percent) <= (n[j] + n[i]) * (100 - percent)
        j = j[ok]
        if forest and len(j):
            j = j[np.lexsort((c1[j], apart[ok]))]
            j = j[np.sort(np.unique(root[j], return_index=True)[1])]
            root[np.isin(root, root[j])] = root[i]
        a.append(np.minimum(c1[j], c1[i]))
        b.append(np.maximum(c1[j], c1[i]))
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64),) * 2


def _compare(percent: int, forest: bool):
    """Rows sorted by (sig, i, j) -> close pairs of each group. A group, two blocks at most, is held at a time."""

    def close(t: pa.Table):
        sig, i, j, block, c1, label, n = (t.column(k).to_numpy() for k in ("sig", "i", "j", "block", "c1", "label", "n"))
        sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint64).reshape(-1, SKETCH_WORDS)
        cuts = np.flatnonzero((sig[1:] != sig[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
        out = [close_pairs(c1[s:e], label[s:e], n[s:e], sketch[s:e], np.flatnonzero(block[s:e] == i[s]), percent, forest) for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(sig)], strict=True)]
        a, b = (np.concatenate([x[k] for x in out]) for k in (0, 1))
        pairs = np.unique(np.stack([a, b], 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    def run(batches):
        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch]).combine_chunks()
            t = pa.concat_tables([held, t]).combine_chunks() if held is not None else t
            if not t.num_rows:
                continue
            sig, i, j = (t.column(k).to_numpy() for k in ("sig", "i", "j"))
            open_at = int(np.flatnonzero((sig != sig[-1]) | (i != i[-1]) | (j != j[-1]))[-1]) + 1 if (sig[0], i[0], j[0]) != (sig[-1], i[-1], j[-1]) else 0
            held = t.slice(open_at)
            if open_at:
                yield close(t.slice(0, open_at))
        if held is not None:
            yield close(held)

    return run


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) of ``pairs`` whose exact similarity reaches the threshold."""
    x, y = (sets.select(F.col("c1").alias(k), F.col("items").alias(f"{k}_items")) for k in "ab")
    both = F.size(F.array_intersect("a_items", "b_items"))
    joined = pairs.join(x, "a").join(y, "b").withColumn("both", both)
    return joined.where(100 * F.col("both") >= percent * (F.size("a_items") + F.size("b_items") - F.col("both"))).select("a", "b")


def jaccard_components(df: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, count_links: bool = False) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id): one row for each row of ``df`` (doc_id, text).

    component_id is the least doc_id reachable by links of similarity percent / 100 or more, itself included. With count_links
    also n_links: to how many other classes the document's class links (copies not counted). That verifies each pair of classes
    that the bounds allow, so its work is quadratic in a group of similar texts.
    Null and empty texts have no set and no links; copies and repeated rows share a class; texts with fewer words than a
    shingle are one shingle; an empty table gives no rows. Rows with a null doc_id link others but
    never name a component; if no reachable row has an id, component_id is null. Only doc_id and text are read, so other input
    columns can't clash.
    """
    ship(df.sparkSession)
    df = df.select("doc_id", "text", text_hash(F.col("text")).alias("text_hash"))
    feats = stash(df.mapInArrow(grams.frugal(_features(shingle)), "doc_id long, text_hash long, n_shingles long, c1 long, c2 long"))
    classes = stash(feats.where("n_shingles > 0").groupBy("c1", "c2").agg(F.min("doc_id").alias("rep"), F.coalesce(F.min_by("text_hash", "doc_id"), F.min("text_hash")).alias("rep_text"), F.max("n_shingles").alias("n"), F.count(F.lit(1)).alias("rows")))
    # Texts are read again rather than all signatures stored: those take more space than the input.
    rows = df.select("text").mapInArrow(grams.frugal(_signature_rows(shingle, percent)), "c1 long, sig array<long>").select(F.explode("sig").alias("sig"), "c1")
    sorted_rows = rows.repartition("sig").sortWithinPartitions("sig", "c1")
    members = stash(sorted_rows.mapInArrow(grams.frugal(_buckets), "sig long, pivot long, c1 long"))
    sets = class_sets(df, members, classes, shingle)
    labels = link_classes(members, sets, percent)
    return finish(feats, classes, labels, all_links(members, labels, sets, percent) if count_links else None)


def class_sets(df: DataFrame, members: DataFrame, classes: DataFrame, shingle: int) -> DataFrame:
    """(c1, n, items, sketch) of the classes that share a bucket with another: from one row of each, which may have no doc_id."""
    one = members.select("c1").distinct().join(classes.select("c1", "rep", "rep_text"), "c1").select("rep", "rep_text").distinct()
    one = sized(stash(one))
    found = df.join(one, df["doc_id"].eqNullSafe(one["rep"]) & (df["text_hash"] == one["rep_text"]), "left_semi").mapInArrow(grams.frugal(_class_sets(shingle)), "c1 long, n long, items array<long>, sketch binary")
    return stash(found.dropDuplicates(["c1"]))


def link_classes(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(node, label) of the classes that links connect."""
    # Round 1: each class against the class that it meets in most buckets.
    met = members.where("c1 <> pivot").groupBy("c1", "pivot").agg(F.count(F.lit(1)).alias("k"))
    best = met.groupBy("c1").agg(F.max(F.struct("k", "pivot")).alias("m")).select(F.col("c1").alias("b"), F.col("m.pivot").alias("a"))
    links = stash(verify(best, sets, percent))
    labels = stash(components(links))
    # Buckets that still span components, each membership once: twice what is closest, then every pair that the bounds allow.
    for forest in (True, True, False):
        more = stash(_residual(members, labels, sets, percent, forest))
        if not more.limit(1).count():
            break
        links = stash(links.unionByName(verify(more, sets, percent)))
        labels = stash(components(links))
    return labels


def all_links(members: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) of every two classes that link: without labels no pair that shares a bucket counts as connected already."""
    return stash(verify(stash(_residual(members, labels.where("false"), sets, percent, False)), sets, percent))


def _residual(members: DataFrame, labels: DataFrame, sets: DataFrame, percent: int, forest: bool) -> DataFrame:
    """Distinct pairs (a, b) to verify, of classes that share a bucket and have different labels."""
    tagged = members.select("sig", "c1").join(labels.withColumnRenamed("node", "c1"), "c1", "left").withColumn("label", F.coalesce("label", "c1"))
    per = tagged.groupBy("sig").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("size"), F.sum(F.xxhash64("c1").bitwiseAND(F.lit((1 << 40) - 1))).alias("sum"), F.min("c1").alias("c_lo"), F.max("c1").alias("c_hi")).where("lo <> hi")
    per = per.groupBy("size", "sum", "c_lo", "c_hi").agg(F.min("sig").alias("sig")).select("sig", F.expr(f"int((size + {BLOCK - 1}) div {BLOCK})").alias("blocks"))
    rest = tagged.join(sized(stash(per)), "sig").join(sets.select("c1", "n", "sketch"), "c1").withColumn("block", F.pmod(F.xxhash64("c1"), F.col("blocks")).cast("int"))
    spread = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("block")).alias("i"), F.greatest(o, F.col("block")).alias("j")))
    rest = rest.withColumn("ij", F.explode(spread)).select("sig", F.col("ij.i").alias("i"), F.col("ij.j").alias("j"), "block", "c1", "label", "n", "sketch")
    return rest.repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j").mapInArrow(grams.frugal(_compare(percent, forest)), "a long, b long").distinct()


def finish(feats: DataFrame, classes: DataFrame, labels: DataFrame, links: DataFrame | None) -> DataFrame:
    named = classes.join(labels, classes["c1"] == labels["node"], "left").withColumn("label", F.coalesce("label", "c1"))
    least = named.groupBy("label").agg(F.min("rep").alias("component"))
    linked = named.where("node is not null or rows > 1").select("label", F.col("c1").alias("k1"), F.col("c2").alias("k2")).join(least, "label").select("k1", "k2", "component")
    counted = []
    if links is not None:
        degree = links.select(F.col("a").alias("c")).unionByName(links.select(F.col("b").alias("c"))).groupBy("c").agg(F.count(F.lit(1)).alias("n_links"))
        linked = linked.join(degree, F.col("k1") == degree["c"], "left").drop("c")
        counted = [F.coalesce("n_links", F.lit(0)).alias("n_links")]
    linked = sized(stash(linked))
    out = feats.select("doc_id", "text_hash", "n_shingles", "c1", "c2").join(linked, (F.col("c1") == F.col("k1")) & (F.col("c2") == F.col("k2")) & (F.col("n_shingles") > 0), "left")
    return out.select("doc_id", "text_hash", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), *counted)


def representatives(df: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The rows of ``df`` with one document a component: the one with the least doc_id; repeats of that row go as well.

    Rows without a set (null or empty text) are in no group and stay. Rows without an id stay unless they link to one with an id.
    """
    found = stash(jaccard_components(df, shingle, percent))
    gone = found.where("n_shingles > 0 and not (doc_id <=> component_id)").select("doc_id", "text_hash").distinct()
    gone = sized(stash(gone.withColumnRenamed("doc_id", "__d").withColumnRenamed("text_hash", "__t")))
    t = df.withColumn("__hash", text_hash(F.col("text")))
    t = t.join(gone, t["doc_id"].eqNullSafe(gone["__d"]) & (t["__hash"] == gone["__t"]), "left_anti")
    if found.where("n_shingles > 0").groupBy("doc_id", "text_hash").count().where("count > 1").limit(1).count():
        has = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
        t = t.where(has).dropDuplicates(["doc_id", "__hash"]).unionByName(t.where(~has))
    return t.drop("__hash")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
