"""Semi-supervised learning: self-training, label graphs, pseudo-label diagnostics."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainfold.functions.columns import ref
from grainfold.operators import stats
from grainfold.operators.ml import graph, metrics, models, prep
from grainfold.session import cut_lineage

THRESHOLD = 0.75
ROUNDS = 10


def self_train(rows: DataFrame, base: str, classes: int, threshold: float = THRESHOLD, rounds: int = ROUNDS, params: dict | None = None):
    """(model, rows): fit, adopt confident predictions of unlabelled rows, repeat.

    ``rows`` has ``features`` and ``label`` (null where unknown); adopted rows are
    marked with the round that labelled them.
    """
    work = cut_lineage(rows.withColumn("round", F.when(F.col("label").isNotNull(), 0)))
    for i in range(1, rounds + 1):
        known = work.where("label IS NOT NULL")
        model = models.build(base, 0, classes, params).fit(known.select("features", "label"))
        pool = work.where("label IS NULL")
        if pool.isEmpty():
            return model, work
        scored = model.transform(pool.drop("label")).withColumn("_c", F.array_max(vector_to_array("probability")))
        sure = F.col("_c") >= threshold
        taken = scored.select(*[F.when(sure, F.col("prediction")).alias("label") if c == "label" else
                                F.when(sure, i).alias("round") if c == "round" else F.col(c) for c in work.columns])
        after = cut_lineage(known.unionByName(taken))
        if after.where(F.col("round") == i).isEmpty():
            return model, after
        work = after
    return models.build(base, 0, classes, params).fit(work.where("label IS NOT NULL").select("features", "label")), work


def label_graph(rows: DataFrame, key: str, classes: int, spreading: bool = False, k: int = 7, rounds: int = 30, **settings) -> DataFrame:
    """(key, prediction, confidence) by propagation, or by spreading with alpha 0.2."""
    points = rows.select(F.col(key).alias("id"), vector_to_array("features").alias("v"), "label")
    out = graph.propagate(points, "label", [float(c) for c in range(classes)], k, 0.2 if spreading else None, rounds, **settings)
    return out.withColumnRenamed("id", key)


def pseudo_labels(predicted: DataFrame, label: str = "prediction", confidence: str = "confidence", bins: int = 10) -> tuple[DataFrame, DataFrame]:
    """(counts per label, histogram of confidence between 0.5 and 1)."""
    counts = predicted.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"), F.avg(confidence).alias("mean_confidence"))
    inside = predicted.where(F.col(confidence).between(0.5, 1.0))
    slots = inside.groupBy(stats.bin_of(F.col(confidence), 0.5, 1.0, bins).alias("bin")).agg(F.count("*").alias("n"))
    grid = predicted.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    lower = F.round(0.5 + F.col("bin") * F.lit(0.5 / bins), 4)
    return counts, grid.join(slots, "bin", "left").select("bin", lower.alias("lower"), F.coalesce("n", F.lit(0)).alias("n"))


def board(rows: DataFrame, key: str, classes: int, base: str = "logistic_regression", share: float = 0.2, **settings) -> DataFrame:
    """(rank, algorithm, accuracy, f1_weighted): self-training, propagation and spreading on held-back labels, the best first.

    A slice of every class, by a hash of the key, hides its labels from all of them.
    """
    held = cut_lineage(prep.split(rows.where("label IS NOT NULL"), [key], 1 - share, "label"))
    hidden = held.where("NOT is_train").select(ref(key).alias("_k"), F.col("label").alias("_truth"))
    shown = cut_lineage(rows.join(hidden, ref(key) == F.col("_k"), "left").withColumn("label", F.when(F.col("_k").isNull(), F.col("label"))).drop("_k", "_truth"))
    model, _ = self_train(shown, base, classes)
    tests = rows.join(hidden, ref(key) == F.col("_k")).drop("label", "_k")
    found = {"self_training": model.transform(tests).select(F.col("_truth").alias("label"), "prediction")}
    for name, spreading in (("label_propagation", False), ("label_spreading", True)):
        out = label_graph(shown, key, classes, spreading, **settings)
        found[name] = out.join(hidden, ref(key) == F.col("_k")).select(F.col("_truth").alias("label"), "prediction")
    scored = [(name, *metrics.classification(df).select("accuracy", "f1_weighted").first()) for name, df in found.items()]
    scored.sort(key=lambda r: -(r[2] or 0.0))
    return rows.sparkSession.createDataFrame([(i + 1, *r) for i, r in enumerate(scored)], "rank int, algorithm string, accuracy double, f1_weighted double")
