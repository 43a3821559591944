"""Helpers that decide how a plan behaves at scale: cut lineage into shared storage, and broadcast only what was measured."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from contextlib import contextmanager, suppress
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Measured bytes up to which a side is broadcast. It is hashed in the driver and in each executor, at some three times this.
BROADCAST_BYTES = 16 << 20

#: Estimated input bytes below which rows are dealt out to all cores before work that is heavy for each row.
SPREAD_BYTES = 256 << 20

_own_dir: str | None = None
#: Stashes that ``release`` deletes.
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that is unset a local master gets a temporary one; on a cluster, whose machines don't share one, that is an error.
    """
    global _own_dir
    there = spark.conf.get("spark.checkpoint.dir", None)
    if there:
        return there.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that all machines share: master is {master}")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="foliant-")
        atexit.register(shutil.rmtree, _own_dir, ignore_errors=True)
    return f"file://{_own_dir}"


def stash(df: DataFrame, keep: bool = False) -> DataFrame:
    """Write ``df`` once to shared storage and read it back: lineage is cut, lost executors lose nothing, later reads prune columns.

    ``release`` and the end of a ``scratch`` block delete it, and so does the end of the program; with ``keep`` only the caller does.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stash-{uuid.uuid4().hex}"
    if not keep:
        if not _made:
            atexit.unregister(_release_rest)
            atexit.register(_release_rest, spark)
        _made.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def made() -> list[str]:
    """Paths of the stashes made so far, in order, but for those to keep."""
    return list(_made)


def release(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Delete these stashes, or all; call it when every result that reads one has been written."""
    for p in made() if paths is None else paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        if p in _made:
            _made.remove(p)


def _release_rest(spark: SparkSession) -> None:
    with suppress(Exception):  # the JVM may be gone
        release(spark)


@contextmanager
def scratch(spark: SparkSession):
    """Stashes made inside the block are deleted at its end: write the results inside."""
    before = set(_made)
    try:
        yield
    finally:
        release(spark, [p for p in made() if p not in before])


def value_bytes(value: Column, kind: T.DataType) -> Column:
    """About how many bytes a value takes in a hashed row."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.StructType, T.MapType)):
            return F.coalesce(F.aggregate(value, F.lit(24).cast("long"), lambda a, x: a + value_bytes(x, kind.elementType)), F.lit(8))
        return 8 * F.coalesce(F.size(value), F.lit(0)) + 24
    if isinstance(kind, T.StructType):
        return sum((value_bytes(value[f.name], f.dataType) for f in kind.fields), F.lit(16))
    if isinstance(kind, T.MapType):
        return value_bytes(F.map_keys(value), T.ArrayType(kind.keyType)) + value_bytes(F.map_values(value), T.ArrayType(kind.valueType))
    return F.lit(8)


def sized(df: DataFrame, limit: int | None = None) -> DataFrame:
    """``df`` with a broadcast hint if its rows take at most ``limit`` bytes, else as it is: the join then shuffles.

    No more rows are measured than may fit. ``df`` should be cheap to read twice: a stash.
    """
    limit = BROADCAST_BYTES if limit is None else limit
    most = limit // (16 + 8 * len(df.columns))
    width = sum((value_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(16)).cast("long")
    rows, total = df.limit(most + 1).agg(F.count(F.lit(1)), F.sum(width)).first()
    return F.broadcast(df) if rows <= most and (total or 0) <= limit else df


def input_bytes(df: DataFrame) -> int:
    """Estimated bytes of the tables that ``df`` reads, from the plan alone."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt out to all cores by ``key`` if its tables are small: a small file is one row group and so one task, however
    much work a row takes. Tables of SPREAD_BYTES or more have tasks enough, and are never shuffled by this."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, key) if input_bytes(df) < SPREAD_BYTES else df


def numbered(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """``df`` with ``out``: each row's place from 1 in a total order, with no task that holds all rows.

    Rows are dealt out by range and stored; a window numbers each range, and the ranges' counts, a row each, give their starts.
    """
    t = stash(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    sizes = t.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    place = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return t.withColumn(out, place).join(F.broadcast(starts), "__range").withColumn(out, F.col(out) + F.col("__start")).drop("__range", "__start")  # a row a range


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package: by path where the file system is shared with them, else as a zip."""
    sc = spark.sparkContext
    root = str(Path(__file__).resolve().parent.parent)
    paths = sc.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        sc.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
        if not sc.master.startswith("local"):
            made = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="foliant-"), "foliant"), "zip", root, "foliant")
            sc.addPyFile(made)
