"""Clustering: choice of k, algorithms, quality measures and what separates the groups."""

from __future__ import annotations

import math

from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grainfold.functions import columns as fc
from grainfold.functions.columns import ref
from grainfold.operators import stats
from grainfold.operators.ml import graph

SEED = 42


def kmeans(df: DataFrame, k: int, features: str = "features"):
    if k < 2:
        raise ValueError("give at least two clusters")
    return KMeans(k=k, seed=SEED, featuresCol=features, predictionCol="cluster").fit(df)


def silhouette(df: DataFrame, features: str = "features", cluster: str = "cluster") -> float:
    """Squared-distance silhouette, computed from cluster sums without pairs of rows."""
    return ClusteringEvaluator(featuresCol=features, predictionCol=cluster, metricName="silhouette").evaluate(df)


def scan_k(df: DataFrame, features: str = "features", k_max: int | None = None) -> DataFrame:
    """(k, silhouette, best) for k = 2 .. ``k_max``, by default the smaller of 10 and the root of the rows."""
    held = df.persist()
    n = held.count()
    top = k_max or min(10, int(math.sqrt(n)))
    rows = [(k, float(silhouette(kmeans(held, k, features).transform(held), features))) for k in range(2, top + 1)]
    held.unpersist()
    best = max(rows, key=lambda r: r[1])[0]
    return df.sparkSession.createDataFrame([(k, s, k == best) for k, s in rows], "k int, silhouette double, best boolean")


def hierarchical(df: DataFrame, k: int, features: str = "features") -> DataFrame:
    """Divisive hierarchy: the widest cluster is split until k are left."""
    return BisectingKMeans(k=k, seed=SEED, featuresCol=features, predictionCol="cluster").fit(df).transform(df)


def dbscan(df: DataFrame, key: str, eps: float = 0.5, min_points: int = 5, features: str = "features", **settings) -> DataFrame:
    points = df.select(F.col(key).alias("id"), vector_to_array(features).alias("v"))
    return df.join(graph.dbscan(points, eps, min_points, **settings).withColumnRenamed("id", key), key)



def davies_bouldin(df: DataFrame, vector: str = "v", cluster: str = "cluster") -> DataFrame:
    """One row: mean over clusters of the worst (spread + spread) / centre distance; ``vector`` is an array."""
    held = df.select(F.col(cluster).alias("c"), F.col(vector).alias("v"))
    size = F.size("v")
    d = held.select(F.max(size)).first()[0]
    centres = held.groupBy("c").agg(F.array(*[F.avg(F.col("v")[i]) for i in range(d)]).alias("m"))
    far = lambda a, b: F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    spread = held.join(centres, "c").groupBy("c").agg(F.avg(far(F.col("v").cast("array<double>"), "m")).alias("s"), F.first("m").alias("m"))
    # Clusters are few, so the table of all clusters fits one small array column.
    every = spread.agg(F.collect_list(F.struct("c", "s", "m")).alias("all"))
    worst = spread.join(every, F.lit(True)).select("c", F.array_max(F.transform(
        F.filter("all", lambda o: o["c"] != F.col("c")), lambda o: (F.col("s") + o["s"]) / far(F.col("m"), o["m"]))).alias("w"))
    return worst.agg(F.avg("w").alias("davies_bouldin"), F.count("*").alias("n_clusters"))


def separation(df: DataFrame, columns: dict, cluster: str = "cluster") -> DataFrame:
    """(feature, f, importance): ANOVA F of every feature over the clusters, scaled to 1."""
    rows = df.select(*stats.stacked(columns, [F.col(cluster).alias("g")])).where(F.col("v").isNotNull())
    per = rows.groupBy("c", "g").agg(F.count("*").alias("n"), F.avg("v").alias("m"), F.var_pop("v").alias("s"))
    whole = per.groupBy("c").agg(F.sum("n").alias("rows"), F.count("*").alias("k"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"))
    parts = per.join(whole, "c").groupBy("c").agg(
        F.sum(F.col("n") * F.pow(F.col("m") - F.col("mean"), 2)).alias("between"), F.sum(F.col("n") * F.col("s")).alias("within"),
        F.first("rows").alias("rows"), F.first("k").alias("k"))
    f = F.coalesce(F.try_divide(F.col("between") / (F.col("k") - 1), F.col("within") / (F.col("rows") - F.col("k"))), F.lit(0.0))
    scored = parts.where("k > 1").select(F.col("c").alias("feature"), f.alias("f"))
    top = scored.agg(F.max("f").alias("_top"))
    return scored.join(top, F.lit(True)).select("feature", "f", F.coalesce(F.try_divide("f", "_top"), F.lit(0.0)).alias("importance"))  # one row


def projection(df: DataFrame, features: str = "features", components: int = 2) -> tuple[DataFrame, list[float]]:
    """Rows with x and y on the first two principal axes, and the explained variance shares."""
    model = PCA(k=components, inputCol=features, outputCol="_pca").fit(df)
    xy = vector_to_array("_pca")
    return model.transform(df).withColumns({"x": xy[0], "y": xy[1]}).drop("_pca"), [float(v) for v in model.explainedVariance]


def board(df: DataFrame, key: str, numeric: list[str], k: int | None = None, eps: float = 0.5, min_points: int = 5) -> DataFrame:
    """(rank, algorithm, n_clusters, silhouette, davies_bouldin): clusterings of standardised columns, the best silhouette first.

    Missing values take the median of their column. Noise of the density clusters is not scored.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler

    raw = df.select(ref(key).alias("id"), *[fc.number_of(df, c).alias(f"n{i}") for i, c in enumerate(numeric)])
    names = [f"n{i}" for i in range(len(numeric))]
    ready = Pipeline(stages=[Imputer(inputCols=names, outputCols=names, strategy="median"), VectorAssembler(inputCols=names, outputCol="_raw"),
                             StandardScaler(inputCol="_raw", outputCol="features", withMean=True)]).fit(raw).transform(raw).select("id", "features").persist()
    best = k or scan_k(ready).where("best").first()["k"]
    runs = {"kmeans": kmeans(ready, best).transform(ready), "hierarchical": hierarchical(ready, best),
            "dbscan": dbscan(ready, "id", eps, min_points).where("cluster >= 0")}
    rows = []
    for name, clustered in runs.items():
        held = clustered.select(F.col("cluster").cast("string").alias("_name"), "features", vector_to_array("features").alias("v"))
        codes = held.select("_name").distinct().select("_name", (F.dense_rank().over(Window.orderBy("_name")) - 1).alias("cluster"))  # a row for each cluster
        held = held.join(F.broadcast(codes), "_name").persist()
        n = codes.count()
        score = silhouette(held) if n > 1 else None
        spread = davies_bouldin(held).first()["davies_bouldin"] if n > 1 else None
        rows.append((name, n, score, spread))
        held.unpersist()
    ready.unpersist()
    rows.sort(key=lambda r: -(r[2] if r[2] is not None else -2.0))
    return df.sparkSession.createDataFrame([(i + 1, *r) for i, r in enumerate(rows)], "rank int, algorithm string, n_clusters long, silhouette double, davies_bouldin double")
