"""Model metrics as aggregates over (label, prediction, score) tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainfold.functions.columns import ref
from grainfold.operators import ordering


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(label, prediction, n)."""
    return df.select(ref(label).alias("label"), ref(prediction).alias("prediction")).na.drop().groupBy(
        "label", "prediction").agg(F.count("*").alias("n"))


def class_report(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """precision, recall, f1 and support of every class; 0 where a class is never predicted."""
    sides = confusion(df, label, prediction).select(F.inline(F.array(
        F.struct(F.col("label").alias("label"), F.col("n").alias("actual"), F.lit(0).cast("bigint").alias("predicted"),
                 F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col("prediction").alias("label"), F.lit(0).cast("bigint").alias("actual"), F.col("n").alias("predicted"),
                 F.lit(0).cast("bigint").alias("hit")),
    )))
    totals = sides.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("actual", "predicted", "hit")])
    zero = F.lit(0.0)
    p = F.coalesce(F.try_divide("hit", "predicted"), zero)
    r = F.coalesce(F.try_divide("hit", "actual"), zero)
    return totals.select(
        "label", p.alias("precision"), r.alias("recall"),
        F.coalesce(F.try_divide(2 * p * r, p + r), zero).alias("f1"), F.col("actual").alias("support"))


def classification(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """accuracy and support-weighted precision, recall and F1; one row."""
    report = class_report(df, label, prediction).where("support > 0")
    n = F.sum("support")
    weighted = lambda c: (F.sum(F.col(c) * F.col("support")) / n)
    return report.agg(
        weighted("recall").alias("accuracy"), weighted("f1").alias("f1_weighted"),
        weighted("precision").alias("precision_weighted"), weighted("recall").alias("recall_weighted"))


def regression(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """r2, rmse, mse, mae, and mape when enough actual values are away from zero; one row."""
    held = df.select(ref(label).cast("double").alias("y"), ref(prediction).cast("double").alias("p")).na.drop()
    err = F.col("y") - F.col("p")
    away = F.abs("y") > 1e-9
    sums = held.agg(
        F.count("*").alias("n"), F.avg(err * err).alias("mse"), F.avg(F.abs(err)).alias("mae"), F.var_pop("y").alias("var"),
        F.count_if(away).alias("k"), F.avg(F.when(away, F.abs(err / F.when(away, F.col("y"))))).alias("ape"))
    enough = F.col("k") >= F.greatest(F.lit(5), F.floor(F.col("n") * 0.5))
    return sums.select(
        (1 - F.try_divide("mse", "var")).alias("r2"), F.sqrt("mse").alias("rmse"), "mse", "mae",
        F.when(enough, F.col("ape")).alias("mape"))


def roc_steps(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """(score, tp, fp): running counts by falling score, one row per distinct score.

    Rows are first counted per score, so equal scores meet in the partial
    aggregate and the running totals go over distinct scores only.
    """
    per = df.select(ref(score).alias("score"), (ref(label) == 1).cast("bigint").alias("y")).na.drop().groupBy("score").agg(
        F.sum("y").alias("_p"), F.sum(1 - F.col("y")).alias("_f"))
    return ordering.add_running(per, [F.col("score").desc()], {"tp": F.col("_p"), "fp": F.col("_f")})


def roc(df: DataFrame, label: str = "label", score: str = "score", cap: int = 60) -> tuple[DataFrame, float]:
    """Curve of at most ``cap`` points (tpr, fpr) and the area under the full curve."""
    from grainfold.operators.frames import even_sample

    steps = roc_steps(df, label, score)
    ends = steps.agg(F.max("tp"), F.max("fp")).first()
    pos, neg = ends[0] or 0, ends[1] or 0
    # The area is the chance that a positive outranks a negative; ties count half.
    area = steps.agg(F.sum(F.col("_p") * (F.lit(neg) - F.col("fp") + F.col("_f") / 2))).first()[0]
    start = df.sparkSession.createDataFrame([(float("inf"), 0, 0)], "score double, tp bigint, fp bigint")
    curve = even_sample(start.unionByName(steps.select("score", "tp", "fp")), [F.col("score").desc()], cap)
    return (
        curve.select("position", (F.col("tp") / F.lit(max(pos, 1))).alias("tpr"), (F.col("fp") / F.lit(max(neg, 1))).alias("fpr")),
        float(area) / (pos * neg) if pos and neg else float("nan"),
    )


def auc(df: DataFrame, label: str = "label", score: str = "score") -> float:
    steps = roc_steps(df, label, score)
    row = steps.agg(F.max("tp"), F.max("fp"), F.sum(F.col("_p") * F.col("fp")), F.sum(F.col("_p") * F.col("_f"))).first()
    if not row[0] or not row[1]:
        return float("nan")
    return 1.0 - (row[2] - row[3] / 2) / (row[0] * row[1])


def auc_weighted(df: DataFrame, label: str, probability: str, classes: int) -> float:
    """One-versus-rest area averaged with class sizes; two classes use the second one's score."""
    from pyspark.ml.functions import vector_to_array

    held = df.select(ref(label).alias("y"), vector_to_array(ref(probability)).alias("p"))
    if classes == 2:
        return auc(held.select((F.col("y") == 1).cast("int").alias("label"), F.col("p")[1].alias("score")))
    sizes = {int(r["y"]): r["count"] for r in held.groupBy("y").count().collect()}
    parts = [
        (n, auc(held.select((F.col("y") == c).cast("int").alias("label"), F.col("p")[c].alias("score"))))
        for c, n in sizes.items()
    ]
    parts = [(n, a) for n, a in parts if a == a]
    return sum(n * a for n, a in parts) / sum(n for n, _ in parts) if parts else float("nan")


def residuals(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Mean and spread of label - prediction; one row."""
    e = ref(label).cast("double") - ref(prediction).cast("double")
    return df.agg(F.avg(e).alias("mean"), F.stddev_pop(e).alias("std"))


def residual_points(df: DataFrame, label: str = "label", prediction: str = "prediction", key: list[str] | None = None) -> DataFrame:
    """(key..., label, prediction, residual) of every row: the residual series and the points of actual against predicted."""
    y, p = ref(label).cast("double"), ref(prediction).cast("double")
    return df.select(*[ref(k) for k in key or []], y.alias("label"), p.alias("prediction"), (y - p).alias("residual")).where("residual IS NOT NULL")


def class_support(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(label, actual, predicted) counts of every class."""
    both = df.select(F.inline(F.array(
        F.struct(ref(label).alias("label"), F.lit(1).alias("a"), F.lit(0).alias("p")),
        F.struct(ref(prediction).alias("label"), F.lit(0).alias("a"), F.lit(1).alias("p")))))
    return both.groupBy("label").agg(F.sum("a").alias("actual"), F.sum("p").alias("predicted"))


def overfit(board: DataFrame) -> DataFrame:
    """Adds gap and verdict to rows with train_score and test_score."""
    gap = F.round(F.col("train_score") - F.col("test_score"), 4)
    return board.withColumn("gap", gap).withColumn(
        "verdict", F.when(gap >= 0.15, "high").when(gap >= 0.06, "moderate").otherwise("low"))


def confidence(board: DataFrame) -> DataFrame:
    """Adds confidence: score minus the overfit penalty minus the instability penalty."""
    penalty = F.when(F.col("verdict") == "low", 0.0).when(F.col("verdict") == "high", 0.2).otherwise(0.08)
    shaky = F.least(F.lit(0.2), F.coalesce("cv_std", F.lit(0.0)) * 2)
    base = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("test_score")))
    return board.withColumn("confidence", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), base - penalty - shaky)), 4))
