"""Product codes of vectors by Elkan's form of Lloyd's algorithm, in whole numbers.

Vectors become integers and are cut into equal parts; every part position has a codebook, and a round assigns each part to its
nearest entry, then moves the entries to the floor of their parts' mean. Between rounds each part keeps an upper bound on the
distance to its entry and one lower bound for each entry. A round shifts the bounds by how far the entries moved, and computes a
distance only where the bounds and half the distance between entries leave room for an entry that is as near or nearer: pruning
is strict, so whatever could tie is compared by its integer squared distance, and the lower index wins.

One row a vector goes through each round's map; the state is a table in shared storage (lower bounds take a byte each, rounded
down in steps of a row's own scale), and the state before it is deleted once the next is written. Entry sums are added up in
each task, then by Spark: entries x parts rows at most reach the driver, which holds the codebooks and sends them out, whatever
the number of vectors.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.grams import frugal
from foliant.scale import made, read_table, release, ship, sized, stash

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Integers are kept within this, so that squared distances of a part fit 64 bits.
LIMIT = 1 << 26
#: Vectors handled at once: bounds the working memory to some rows x parts x entries x 20 bytes.
ROWS = 1 << 10
RESULTS = ("code", "error", "label_error", "codebooks_sha256")
_STATE = "id long, label {label}, parts binary, assigned binary, upper binary, lower binary, step float, computed long"


def _ints(col: pa.Array, dtype, rows: int) -> np.ndarray:
    """A binary column of equal widths as a matrix."""
    return np.frombuffer(b"".join(col.to_pylist()), dtype).reshape(rows, -1)


def _binary(x: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in np.ascontiguousarray(x)], pa.binary())


def _up(x: np.ndarray) -> np.ndarray:
    """Rounded up to float32."""
    return np.nextafter(x.astype(np.float32), np.float32(np.inf))


@dataclass
class Bounds:
    """State of some vectors' parts: assigned (rows, parts), upper (rows, parts) and lower (rows, parts, entries)."""

    assigned: np.ndarray
    upper: np.ndarray
    lower: np.ndarray


def first_bounds(parts: np.ndarray, books: np.ndarray) -> tuple[Bounds, np.ndarray]:
    """Every distance once: (bounds, squared distance of each part to its entry)."""
    n, p, _ = parts.shape
    lower = np.empty((n, p, books.shape[1]))
    assigned, best = np.empty((n, p), np.int64), np.empty((n, p), np.int64)
    for i in range(p):
        d = ((parts[:, i, None, :] - books[i][None]) ** 2).sum(2)
        assigned[:, i] = d.argmin(1)  # the first of equals
        best[:, i] = d.min(1)
        lower[:, i] = np.sqrt(d.astype(float))
    return Bounds(assigned, np.sqrt(best.astype(float)), lower), best


def next_bounds(parts: np.ndarray, books: np.ndarray, moved: np.ndarray, old: Bounds, exact: bool) -> tuple[Bounds, np.ndarray, int]:
    """Bounds and squared distances after the entries moved, and how many distances were computed.

    ``moved`` (parts, entries) is at least each entry's movement. An entry is left out only if a bound that is surely too small
    for its distance is above one that is surely too large for the present entry's: such an entry can't even tie. Squared
    distances of parts that needed no distance are -1, unless they shall be ``exact``.
    """
    n, p, _ = parts.shape
    computed = 0
    best = np.full((n, p), -1)
    upper, lower, assigned = old.upper.copy(), np.maximum(old.lower - moved[None], 0), old.assigned.copy()
    for i in range(p):
        book = books[i]
        between = np.sqrt(((book[:, None] - book[None]) ** 2).sum(2).astype(float)) * (1 - 1e-9)
        np.fill_diagonal(between, np.inf)
        upper[:, i] = (upper[:, i] + moved[i][assigned[:, i]]) * (1 + 1e-9)
        # Nothing can be as near as the present entry if all others are more than twice the upper bound away from it.
        rest = np.flatnonzero(between.min(1)[assigned[:, i]] <= 2 * upper[:, i])
        if exact:
            rest = np.arange(n)
        x, a = parts[rest, i], assigned[rest, i]
        own = ((x - book[a]) ** 2).sum(1)
        u = np.sqrt(own.astype(float)) * (1 + 1e-9)
        left = (lower[rest, i] <= u[:, None]) & (between[a] <= 2 * u[:, None])
        row, entry = np.nonzero(left)
        d = ((x[row] - book[entry]) ** 2).sum(1)
        computed += len(rest) + len(row)
        table = np.full((len(rest), len(book)), np.iinfo(np.int64).max)
        table[np.arange(len(rest)), a] = own
        table[row, entry] = d
        assigned[rest, i], best[rest, i] = table.argmin(1), table.min(1)
        lower[rest[row], i, entry] = np.sqrt(d.astype(float))
        lower[rest, i, a] = np.sqrt(own.astype(float))
        upper[rest, i] = np.sqrt(best[rest, i].astype(float))
    return Bounds(assigned, upper, lower), best, computed


def pack(b: Bounds) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(assigned, upper, lower, step) as stored: a byte an entry's bound, in steps of the row's own size, rounded down."""
    step = np.maximum(b.lower.reshape(len(b.lower), -1).max(1, initial=0) / 255, 1e-6).astype(np.float32)
    lower = np.floor(b.lower / step[:, None, None].astype(float) * (1 - 1e-6)).clip(0, 255).astype(np.uint8)
    return b.assigned.astype(np.uint16), _up(b.upper), lower.reshape(len(lower), -1), step


def unpack(rows: int, shape: tuple[int, int], assigned, upper, lower, step) -> Bounds:
    p, k = shape
    low = _ints(lower, np.uint8, rows).reshape(rows, p, k) * step.to_numpy(zero_copy_only=False).astype(float)[:, None, None]
    return Bounds(_ints(assigned, np.uint16, rows).astype(np.int64), _ints(upper, np.float32, rows).astype(float), low * (1 - 1e-6))


def _assign(books: np.ndarray, moved: np.ndarray | None, last: bool):
    """Map of one round: from (id, label, parts[, state]) to the state, or after the last round to (id, label, code, error)."""
    p, k, width = books.shape

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                n = b.num_rows
                parts = _ints(b["parts"], np.int32, n).reshape(n, p, width).astype(np.int64)
                if moved is None:
                    state, best = first_bounds(parts, books)
                    computed = n * p * k
                else:
                    state, best, computed = next_bounds(parts, books, moved, unpack(n, (p, k), b["assigned"], b["upper"], b["lower"], b["step"]), last)
                if last:
                    code = pa.array(["".join(f"{v:0{2 if k <= 256 else 4}x}" for v in r) for r in state.assigned.tolist()])
                    yield pa.RecordBatch.from_arrays([b["id"], b["label"], code, pa.array(best.sum(1)), pa.array([computed] + [0] * (n - 1), pa.int64())], ["id", "label", "code", "error", "computed"])
                else:
                    assigned, upper, lower, step = pack(state)
                    cols = [b["id"], b["label"], b["parts"], _binary(assigned), _binary(upper), _binary(lower), pa.array(step), pa.array([computed] + [0] * (n - 1), pa.int64())]
                    yield pa.RecordBatch.from_arrays(cols, ["id", "label", "parts", "assigned", "upper", "lower", "step", "computed"])

    return frugal(run)


def _sums(shape: tuple[int, int, int]):
    """Map from (parts, assigned) to one row (part, entry, n, total) an entry in use a task."""
    p, k, width = shape

    def run(batches):
        total, count = np.zeros((p * k, width), np.int64), np.zeros(p * k, np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                n = b.num_rows
                entry = (_ints(b["assigned"], np.uint16, n).astype(np.int64) + k * np.arange(p)).ravel()
                np.add.at(total, entry, _ints(b["parts"], np.int32, n).reshape(n * p, width))
                count += np.bincount(entry, minlength=p * k)
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(used // k), pa.array(used % k), pa.array(count[used]), pa.array(total[used].tolist(), pa.list_(pa.int64()))], ["part", "entry", "n", "total"])

    return frugal(run)


def integer_vectors(df: DataFrame, key: str, vector: str, label: str | None, parts: int, scale: int = SCALE) -> DataFrame:
    """(id, label, ints) of the vectors that can be coded; see ``train``."""
    v = F.transform(F.col(f"`{vector}`"), lambda x: x.cast("double"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    t = df.select(F.col(f"`{key}`").cast("long").alias("id"), (F.lit(None).cast("int") if label is None else F.col(f"`{label}`")).alias("label"), v.alias("v"))
    t = t.where(F.coalesce((F.size("v") > 0) & (F.size("v") % parts == 0) & fine, F.lit(False)))
    # Bounded before it is cast: a huge component is cut off, not turned over.
    whole = lambda x: F.floor(F.greatest(F.least(x * scale, F.lit(float(LIMIT - 1))), F.lit(-float(LIMIT)))).cast("int")
    return t.select("id", "label", F.transform("v", whole).alias("ints"))


def _packed(batches):
    """(id, label, ints) with the integers as one binary value a row."""
    for b in batches:
        yield pa.RecordBatch.from_arrays([b["id"], b["label"], pa.array([np.asarray(x, np.int32).tobytes() for x in b["ints"].to_pylist()], pa.binary())], ["id", "label", "parts"])


@dataclass
class Codes:
    """``rows`` (id, label, code, error), the codebooks (parts, entries, width), and how many distances each assignment computed."""

    rows: DataFrame | None
    books: np.ndarray
    computed: list[int]

    def digest(self) -> str:
        """SHA-256 of all entries' components in decimal, by part, entry and place, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()

    def decode(self, code: str) -> list[int]:
        """The integer vector that a code stands for."""
        digits = len(code) // len(self.books)
        return [x for i, book in enumerate(self.books.tolist()) for x in book[int(code[i * digits : (i + 1) * digits], 16)]]


def train(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str | None = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codes:
    """Codebooks from all vectors, and every vector's code and error.

    Dropped: vectors that are null, hold a null or non-finite component, are empty, or can't be cut into equal parts; and, where
    lengths differ, those that aren't as long as most (the longer of equally many). Components are floor(256 * x), kept within
    2 ** 26. Each codebook starts as the parts of the ``entries`` vectors of least key (null keys last, ties by components), or of all if there
    are fewer. Unused entries stay. Repeated rows count as often as they occur, and get the same code. Extra columns aren't
    read. An empty table gives no rows and empty codebooks.
    """
    ship(df.sparkSession)
    ints = integer_vectors(df, key, vector, label, parts)
    sizes = ints.groupBy(F.size("ints").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if sizes is None:
        return Codes(None, np.zeros((parts, 0, 0), np.int64), [])
    ints = ints.where(F.size("ints") == sizes.d)
    width = sizes.d // parts
    start = ints.orderBy(F.asc_nulls_last("id"), "ints").limit(entries).collect()
    books = np.array([r.ints for r in start], np.int64).reshape(len(start), parts, width).transpose(1, 0, 2)
    kind = ints.schema["label"].dataType.simpleString()
    state = ints.mapInArrow(frugal(_packed), f"id long, label {kind}, parts binary")
    moved, before, computed = None, [], []
    for _ in range(rounds):
        state = stash(state.mapInArrow(_assign(books, moved, False), _STATE.format(label=kind)))
        release(df.sparkSession, before)
        before = made()[-1:]
        computed.append(state.agg(F.sum("computed")).first()[0])
        each = state.select("parts", "assigned").mapInArrow(_sums(books.shape), "part long, entry long, n long, total array<long>")
        added = each.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("total")[j]).alias(f"t{j}") for j in range(width)])
        new = books.copy()
        for r in added.collect():  # parts x entries rows at most
            new[r.part, r.entry] = [r[f"t{j}"] // r.n for j in range(width)]
        moved, books = np.sqrt(((new - books) ** 2).sum(2).astype(float)) * (1 + 1e-9), new
    rows = stash(state.mapInArrow(_assign(books, moved, True), f"id long, label {kind}, code string, error long, computed long"))
    release(df.sparkSession, before)
    computed.append(rows.agg(F.sum("computed")).first()[0])
    return Codes(rows.drop("computed"), books, computed)


def compress(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", **sizes) -> DataFrame:
    """(key, code, error, label_error, codebooks_sha256): ``train`` with each label's summed error; null labels are one label."""
    found = train(df, key, vector, label, **sizes)
    if found.rows is None:
        return df.sparkSession.createDataFrame([], f"`{key}` long, code string, error long, label_error long, codebooks_sha256 string")
    sums = sized(stash(found.rows.groupBy(F.col("label").alias("__l")).agg(F.sum("error").alias("label_error"))))
    out = found.rows.join(sums, found.rows["label"].eqNullSafe(sums["__l"]), "left")
    return out.select(F.col("id").alias(key), "code", "error", "label_error", F.lit(found.digest()).alias("codebooks_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
