"""Topic clusters: k-means on unit file vectors, labelled by the modal tag."""

from __future__ import annotations

import math

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.operators.vectors import dot, doubles, norm, normalise
from foliant.scale import stash


def estimate_k(n: int, cap: int = 12) -> int:
    return 0 if n < 3 else min(max(2, math.isqrt(n // 2)), cap)


def cluster_files(files: DataFrame, file_tags: DataFrame, k: int | None = None, cap: int = 12, seed: int = 0) -> DataFrame:
    """(id, label, files, sample_titles, centroid) of (file_path, title, vec). Fewer than three vectors give none.

    Label: the most frequent tag of the members (least on ties), else 主题簇 and the number; samples: three titles nearest the
    centre, a file without a title by its name or path.
    """
    t = files.where(norm(doubles(F.col("vec"))) > 0).withColumn("unit", normalise(doubles(F.col("vec"))))
    names = [F.nullif(F.col(c), F.lit("")) for c in ("title", "file_name", "file_path") if c in files.columns]
    t = stash(t.select("file_path", F.coalesce(*names).alias("title"), "unit"))
    n = t.count()
    if n < 3:
        return files.sparkSession.createDataFrame([], "id int, label string, files array<string>, sample_titles array<string>, centroid array<double>")
    k = min(max(k or estimate_k(n, cap), 2), n - 1)
    model = KMeans(k=k, seed=seed, maxIter=50, featuresCol="f").fit(t.withColumn("f", array_to_vector("unit")))
    assigned = stash(model.transform(t.withColumn("f", array_to_vector("unit"))).select("file_path", "title", "unit", F.col("prediction").alias("id")))
    spark = files.sparkSession
    centres = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "id int, centroid array<double>")
    counts = assigned.join(file_tags, "file_path").groupBy("id", "tag").agg(F.count_distinct("file_path").alias("n"))
    label = counts.groupBy("id").agg(F.min(F.struct((-F.col("n")).alias("n"), "tag")).alias("m")).select("id", F.col("m.tag").alias("label"))
    near = assigned.join(F.broadcast(centres), "id").withColumn("d", dot(F.col("unit"), F.col("centroid")))
    top = near.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("d"), "file_path"))).where("r <= 3")
    top = top.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("r", F.col("title").alias("t")))).alias("s"))
    members = assigned.groupBy("id").agg(F.array_sort(F.collect_list("file_path")).alias("files"))
    out = members.join(label, "id", "left").join(top, "id").join(centres, "id")
    name = F.coalesce("label", F.concat(F.lit("主题簇 "), (F.col("id") + 1).cast("string")))
    return out.select("id", name.alias("label"), "files", F.transform("s", lambda x: x["t"]).alias("sample_titles"), "centroid")


def cluster_sizes(clusters: DataFrame) -> DataFrame:
    return clusters.select("label", F.size("files").alias("n_files"))


def members(clusters: DataFrame, cluster_id: int) -> DataFrame:
    return clusters.where(F.col("id") == cluster_id).select(F.explode("files").alias("file_path"))
