"""Sharding by Hilbert-curve order: quantise metadata dimensions, sort by curve index, cut equal runs.

All steps are DataFrame expressions. What reaches the driver: one row of minima and maxima, and one row of quantile cuts.
The table of curve cells, at most 2 ** (bits * dimensions) rows, is broadcast if its measured size allows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.functions.text import let
from foliant.llm.ordering import prefix_offsets
from foliant.scale import read_table, sized, stash

#: Bits a dimension: 32 bands each, so three dimensions give at most 32,768 cells.
BITS = 5
SHARDS = 40
DIMENSIONS = ("source", "lang", "n_chars")
_BYTES = 7


def hilbert_index(coords: Column, n: int, bits: int = BITS) -> Column:
    """Curve index of an array of ``n`` coordinates below 2 ** bits (transpose form of the curve, folded step by step)."""
    steps = F.array(*[F.struct(F.lit(1 << b).alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, 0, -1) for i in range(n)])
    at = lambda a, i: F.get(a, i)
    ints = T.ArrayType(T.IntegerType())

    def turn(x: Column, s: Column) -> Column:
        p = s["q"] - 1
        xi, x0 = at(x, s["i"]), at(x, F.lit(0))
        inverted = xi.bitwiseAND(s["q"]) != 0
        t = F.when(inverted, F.lit(0)).otherwise(x0.bitwiseXOR(xi).bitwiseAND(p))
        return let(t, lambda t: F.transform(x, lambda v, j: F.when(j == 0, F.when(inverted, x0.bitwiseXOR(p)).otherwise(x0.bitwiseXOR(t))).when(j == s["i"], v.bitwiseXOR(t)).otherwise(v)))

    def gray(x: Column) -> Column:
        """Each coordinate takes up the exclusive or of those before it."""
        start = F.struct(F.lit(0).alias("last"), F.array().cast(ints).alias("all"))

        def step(a: Column, v: Column) -> Column:
            return let(a["last"].bitwiseXOR(v), lambda w: F.struct(w.alias("last"), F.concat(a["all"], F.array(w)).alias("all")))

        return F.aggregate(x, start, step, lambda a: a["all"])

    def flip(x: Column) -> Column:
        """What the last coordinate's high bits turn over in all of them."""
        low = at(x, F.lit(n - 1))
        flips = reduce(lambda a, b: a.bitwiseXOR(b), [F.when(low.bitwiseAND(F.lit(1 << b)) != 0, F.lit((1 << b) - 1)).otherwise(F.lit(0)) for b in range(1, bits)], F.lit(0))
        return let(flips, lambda f: F.transform(x, lambda v: v.bitwiseXOR(f)))

    def interleaved(digits: Column) -> Column:
        places = F.array(*[F.struct(F.lit(1 << b).alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, -1, -1) for i in range(n)])
        bit = lambda s: F.when(at(digits, s["i"]).bitwiseAND(s["q"]) != 0, F.lit(1)).otherwise(F.lit(0))
        return F.aggregate(places, F.lit(0).cast("long"), lambda a, s: a * 2 + bit(s))

    turned = F.aggregate(steps, coords.cast(ints), turn) if bits > 1 else coords.cast(ints)
    return let(turned, lambda t: let(gray(t), lambda g: let(flip(g), interleaved)))


def _number(df: DataFrame, name: str, skip: dict[str, int]) -> Column:
    """An order-preserving number: strings give the bytes that follow the prefix all values share."""
    if not isinstance(df.schema[name].dataType, T.StringType):
        return F.col(f"`{name}`").cast("double")
    part = F.expr(f"substring(encode(`{name}`, 'UTF-8'), {skip[name] + 1}, {_BYTES})")
    return F.conv(F.rpad(F.hex(part), 2 * _BYTES, "0"), 16, 10).cast("double")


def _shared_prefix(a: bytes, b: bytes) -> int:
    return next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def curve_cells(df: DataFrame, dimensions=DIMENSIONS, bits: int = BITS) -> Column:
    """The cell number of each row: its bands by quantile, packed. Null is band 0. Cuts come from all rows."""
    strings = [d for d in dimensions if isinstance(df.schema[d].dataType, T.StringType)]
    skip = {}
    if strings:
        ends = df.agg(*[f(f"`{d}`").alias(f"{k}{i}") for i, d in enumerate(strings) for k, f in (("lo", F.min), ("hi", F.max))]).first()
        skip = {d: _shared_prefix((ends[f"lo{i}"] or "").encode(), (ends[f"hi{i}"] or "").encode()) for i, d in enumerate(strings)}
    numbers = [_number(df, d, skip) for d in dimensions]
    shares = [i / (1 << bits) for i in range(1, 1 << bits)]
    found = df.agg(*[F.percentile_approx(x, shares, 10_000).alias(f"c{i}") for i, x in enumerate(numbers)], *[F.min(x).alias(f"m{i}") for i, x in enumerate(numbers)]).first()
    cell = F.lit(0)
    for i, x in enumerate(numbers):
        cuts = sorted({c for c in found[f"c{i}"] or [] if c > found[f"m{i}"]})
        band = reduce(lambda a, b: a + b, [F.when(x >= c, 1).otherwise(0) for c in cuts], F.lit(0))
        cell = cell * (1 << bits) + band
    return cell.cast("int")


def hilbert_shards(df: DataFrame, n_shards: int = SHARDS, dimensions=DIMENSIONS, ties: tuple[str, ...] = ("doc_id",), bits: int = BITS) -> DataFrame:
    """All rows of ``df`` with ``shard`` (0 to n_shards - 1) and ``slot`` (0, 1, ... inside the shard).

    Rows are ordered by the Hilbert index of their (source, lang, size) cell, so a shard spans few values of each dimension;
    shard row counts differ by one at most. Within a cell the order is a seeded hash of ``ties`` and of the whole row, so rows
    that share a null or repeated id are dealt out as well, and only equal rows meet. One shuffle of the rows.
    Nulls take the first band; equal rows may trade places; an empty table gives no rows; input columns named shard or slot are
    replaced; names that begin with two underscores are the operator's own.
    """
    df = df.drop("shard", "slot")
    t = df.withColumn("__cell", curve_cells(df, dimensions, bits))
    n = len(dimensions)
    cells = t.groupBy("__cell").agg(F.count(F.lit(1)).alias("__n"))
    mask = (1 << bits) - 1
    coords = F.array(*[F.shiftright("__cell", bits * (n - 1 - i)).bitwiseAND(F.lit(mask)) for i in range(n)])
    ordered = Window.orderBy("__curve", "__cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("__curve", hilbert_index(coords, n, bits)).select(
        F.col("__cell").alias("__key"),
        F.coalesce(F.sum("__n").over(ordered), F.lit(0)).alias("__first"),
        F.sum("__n").over(Window.partitionBy()).alias("__total"),
    )
    t = t.withColumn("__row", F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema.fields if not isinstance(f.dataType, T.MapType)]))
    placed = prefix_offsets(t, "__cell", F.lit(1), [*[F.col(f"`{c}`") for c in ties], F.col("__row")], 17, "__off")
    placed = placed.join(sized(stash(cells)), F.col("__cell") == F.col("__key"))
    at = F.col("__first") + F.col("__off")
    placed = placed.withColumn("__at", at).withColumn("shard", F.expr(f"int((__at * {n_shards}) div __total)"))
    slot = F.col("__at") - F.expr(f"(shard * __total + {n_shards - 1}) div {n_shards}")
    return placed.withColumn("slot", slot.cast("long")).drop("__cell", "__key", "__first", "__total", "__off", "__at", "__row")


def shard_manifest(sharded: DataFrame, dimensions=DIMENSIONS) -> DataFrame:
    """One row a shard: its row count and the least and greatest value of each dimension, for pruning."""
    aggs = [f(f"`{d}`").alias(f"{k}_{d}") for d in dimensions for k, f in (("min", F.min), ("max", F.max))]
    nulls = [F.max(F.col(f"`{d}`").isNull()).alias(f"has_null_{d}") for d in dimensions]
    return sharded.groupBy("shard").agg(F.count(F.lit(1)).alias("n_rows"), *aggs, *nulls)


def prune_shards(manifest: DataFrame, **bounds) -> DataFrame:
    """Shards that may hold rows with every dimension in its (low, high) bounds, both included; None is open."""
    keep = F.lit(True)
    for d, (low, high) in bounds.items():
        if low is not None:
            keep &= F.col(f"max_{d}") >= F.lit(low)
        if high is not None:
            keep &= F.col(f"min_{d}") <= F.lit(high)
    return manifest.where(keep).select("shard")


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write one folder a shard, rows by slot, and the manifest beside them."""
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(f"{path}/data")
    shard_manifest(sharded).coalesce(1).write.parquet(f"{path}/manifest")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents")
    rows = d.select("doc_id", "source", "lang", "n_chars", (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"), F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"))
    out = hilbert_shards(rows)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source", "lang", "n_chars")
