"""Fill-in-middle transformation by overlapping chunks.

A text's UTF-8 bytes are cut into chunks of CHUNK bytes. Each chunk also sees the one byte before it, so a predicate on adjacent
bytes tells, for every chunk by itself, how many units (characters, words or lines) begin there; all chunks of a batch are
counted side by side. Prefix sums over a text's chunks give its number of units and, for each cut rank, the chunk that owns it;
only the owning chunks are scanned again for the byte offset. Texts never leave their row: nothing is shuffled, and pieces are
put together from byte slices in the JVM. One task holds one Arrow batch, and of its texts BLOCK bytes of marks at a time.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions.text import let
from foliant.llm.grams import NOT_SPACE
from foliant.scale import read_table, ship

#: Bytes a chunk, without the byte of overlap; bytes of marks worked on at once.
CHUNK, BLOCK = 1 << 12, 1 << 20
#: Fixed values of the output forms: what marks prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 1
#: Of 100 draws, how many texts stay plain, and how many of the others put the suffix first.
PLAIN_PERCENT, SPM_PERCENT = 10, 20
RESULTS = ("n", "form", "prefix_units", "middle_units", "output")

#: Does a unit begin at the second of two adjacent bytes? A text's first byte always begins one.
UNITS: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {
    "char": lambda last, this: (this & 0xC0) != 0x80,
    "word": lambda last, this: NOT_SPACE[this] & ~NOT_SPACE[last],
    "line": lambda last, this: last == 0x0A,
}


def _begins(data: np.ndarray, lo: int, hi: int, first: np.ndarray, unit: str) -> np.ndarray:
    """Marks for data[lo:hi], which sees one byte before ``lo``; ``first`` are the offsets where texts begin."""
    last = np.empty(hi - lo, np.uint8)
    last[0] = data[lo - 1] if lo else 0
    last[1:] = data[lo : hi - 1]
    marks = UNITS[unit](last, data[lo:hi])
    marks[first[np.searchsorted(first, lo) : np.searchsorted(first, hi)] - lo] = True
    return marks


def chunk_bounds(offsets: np.ndarray, chunk: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, number of each text's first chunk) of the chunks of texts that lie end to end; an empty text has none."""
    size = np.diff(offsets)
    pieces = -(-size // chunk)
    first = np.concatenate(([0], np.cumsum(pieces)))
    owner = np.repeat(np.arange(len(size)), pieces)
    start = offsets[owner] + chunk * (np.arange(first[-1]) - first[owner])
    return start, np.minimum(start + chunk, offsets[owner + 1]), first


def count_chunks(data: np.ndarray, offsets: np.ndarray, start: np.ndarray, end: np.ndarray, unit: str) -> np.ndarray:
    """Units that begin in each chunk. Runs of chunks are marked together, at most BLOCK bytes or one chunk at a time."""
    first = offsets[:-1][np.diff(offsets) > 0]
    counts = np.empty(len(start), np.int64)
    a = 0
    while a < len(start):
        b = max(a + 1, int(np.searchsorted(end, start[a] + BLOCK, "right")))
        marks = _begins(data, int(start[a]), int(end[b - 1]), first, unit)
        counts[a:b] = np.add.reduceat(marks, start[a:b] - start[a], dtype=np.int64)
        a = b
    return counts


def locate(data: np.ndarray, offsets: np.ndarray, draws: list[np.ndarray], unit: str, chunk: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """(units of each text, ranks, byte offsets in the text) of one cut a draw: the cut lies after draw % (units + 1) units."""
    start, end, first = chunk_bounds(offsets, chunk)
    total = np.concatenate(([0], np.cumsum(count_chunks(data, offsets, start, end, unit))))
    before = total[first[:-1]]
    n = total[first[1:]] - before
    heads = offsets[:-1][np.diff(offsets) > 0]
    ranks, places = [], []
    for d in draws:
        rank = d % (n + 1)
        at = np.diff(offsets).copy()  # a cut after the last unit is the text's end
        inside = np.flatnonzero(rank < n)
        wanted = before[inside] + rank[inside]
        owners = np.searchsorted(total, wanted, "right") - 1
        for i, w, c in zip(inside.tolist(), wanted.tolist(), owners.tolist(), strict=True):
            lo = int(start[c])
            marks = _begins(data, lo, int(end[c]), heads, unit)
            at[i] = lo + np.flatnonzero(marks)[w - total[c]] - offsets[i]
        ranks.append(rank)
        places.append(at)
    return n, ranks, places


def two_cuts(unit: str = "char", chunk: int = CHUNK):
    """Arrow function (text, draw, draw) -> (n, low, high, low_byte, high_byte): units and the two cuts in order."""
    kind = "n long, low long, high long, low_byte long, high_byte long"

    @F.arrow_udf(kind)
    def run(text: pa.Array, x: pa.Array, y: pa.Array) -> pa.Array:
        text = text.cast(pa.large_binary()).fill_null(b"")
        _, offsets, data = text.buffers()
        offsets = np.frombuffer(offsets, np.int64, len(text) + 1, 8 * text.offset) if len(text) else np.zeros(1, np.int64)
        data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        n, ranks, places = locate(data, offsets, [d.to_numpy(zero_copy_only=False) for d in (x, y)], unit, chunk)
        out = [n, np.minimum(*ranks), np.maximum(*ranks), np.minimum(*places), np.maximum(*places)]
        return pa.StructArray.from_arrays([pa.array(v.astype(np.int64)) for v in out], ["n", "low", "high", "low_byte", "high_byte"])

    return run


def draws(key: Column, seed: int = SEED) -> list[Column]:
    """Four numbers below 2 ** 32 from a key: the first 32 hex digits of the SHA-256 of "seed:key"; a null key counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def restore(output: Column, form: Column) -> Column:
    """The text that ``output`` was made from. The marks aren't in the texts that carry them, so each mark's first place is its own."""
    tail = lambda s, mark: F.substring(s, F.locate(mark, s) + len(mark), F.length(s))
    head = lambda s, mark: F.substring_index(s, mark, 1)
    middle = tail(output, MIDDLE)
    front = head(output, MIDDLE)
    psm = F.concat(tail(head(front, SUFFIX), PREFIX), middle, tail(front, SUFFIX))
    spm = F.concat(tail(front, PREFIX), middle, tail(head(front, PREFIX), SUFFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def infill(df: DataFrame, key: str = "doc_id", text: str = "text", unit: str = "char", seed: int = SEED, plain_percent: int = PLAIN_PERCENT, spm_percent: int = SPM_PERCENT, chunk: int = CHUNK) -> DataFrame:
    """All rows and columns of ``df`` with n (units), form (plain, psm or spm), prefix_units, middle_units and output.

    A null text is an empty one, and an empty one is plain, with output "". A text that holds a mark is plain. Both cuts and
    the form depend on key, seed and text alone: repeated rows get the same result, and equal draws give an empty middle. A null
    key draws as an empty one. An empty table gives no rows. Input columns named like a result (RESULTS) are replaced; names
    that begin with two underscores are the operator's own. Very long texts are counted chunk by chunk.
    """
    ship(df.sparkSession)
    df = df.drop(*[c for c in RESULTS if c not in (key, text)])
    t = F.coalesce(F.col(text), F.lit(""))
    h1, h2, h3, h4 = draws(F.col(key), seed)
    marked = F.contains(t, F.lit(PREFIX)) | F.contains(t, F.lit(SUFFIX)) | F.contains(t, F.lit(MIDDLE))
    plain = (t == "") | marked | (h3 % 100 >= 100 - plain_percent)
    out = df.withColumn("__cut", two_cuts(unit, chunk)(t.cast("binary"), h1, h2))
    form = F.when(plain, "plain").when(h4 % 100 < spm_percent, "spm").otherwise("psm")
    whole, low, high = t.cast("binary"), F.col("__cut.low_byte").cast("int"), F.col("__cut.high_byte").cast("int")
    piece = lambda a, n: F.substring(whole, a + 1, n).cast("string")
    prefix, middle, suffix = piece(F.lit(0), low), piece(low, high - low), piece(high, F.octet_length(t) - high)
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    ranks = [("prefix_units", F.col("__cut.low")), ("middle_units", F.col("__cut.high") - F.col("__cut.low"))]
    out = out.withColumn("n", F.col("__cut.n")).withColumn("form", form)
    out = out.withColumns({k: F.when(F.col("form") != "plain", v) for k, v in ranks})
    return out.withColumn("output", F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(t)).drop("__cut")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infill(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    sha = lambda s: F.sha2(s.cast("binary"), 256)
    both = let(F.col("output"), lambda o: F.struct(sha(o).alias("o"), sha(restore(o, F.col("form"))).alias("r")))
    out = made.select("doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"), both.alias("__h"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.col("__h.o").alias("output_sha256"), F.col("__h.r").alias("restored_sha256"))
