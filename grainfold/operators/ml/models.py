"""Model registry: Spark ML estimators, and the few models Spark ML lacks built on top of them.

Every entry has ``fit(df)`` on columns ``features`` and ``label`` and gives a model
whose ``transform`` adds ``prediction`` and, where the model has one, ``probability``.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml import classification as C
from pyspark.ml import regression as R
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainfold.operators.ml import neighbors
from grainfold.operators.ml.boosting import AdaBoostR2
from grainfold.operators.ml.kernels import KernelMachine
from grainfold.session import cut_lineage

SEED = 42


def _cols(**kw) -> dict:
    return {"featuresCol": "features", "labelCol": "label", "predictionCol": "prediction", **kw}


def votes_to_columns(df: DataFrame, shares: list[Column]) -> DataFrame:
    """probability and prediction from one share per class; ties go to the first class."""
    held = df.withColumn("_shares", F.array(*shares))
    best = F.array_position("_shares", F.array_max("_shares")) - 1
    return held.withColumns({"probability": array_to_vector("_shares"), "prediction": best.cast("double")}).drop("_shares")


@dataclass
class Knn:
    """k nearest neighbours: majority vote or mean of the k closest training rows."""

    classes: int = 0
    k: int = 5
    settings: dict | None = None

    def fit(self, df: DataFrame) -> KnnModel:
        held = df.select(F.monotonically_increasing_id().alias("id"), vector_to_array("features").alias("v"), "label")
        return KnnModel(cut_lineage(held), self)


@dataclass
class KnnModel:
    train: DataFrame
    spec: Knn

    def transform(self, df: DataFrame) -> DataFrame:
        queries = cut_lineage(df.withColumn("_q", F.monotonically_increasing_id()))
        near = neighbors.nearest(
            queries.select(F.col("_q").alias("id"), vector_to_array("features").alias("v")), self.train, self.spec.k,
            extra={"label": "double"}, **(self.spec.settings or {}))
        n = self.spec.classes
        if n:
            votes = near.groupBy("id").agg(*[F.avg((F.col("label") == c).cast("double")).alias(f"_s{c}") for c in range(n)])
            out = queries.join(votes, F.col("_q") == F.col("id")).drop("id", "_q")
            return votes_to_columns(out, [F.col(f"_s{c}") for c in range(n)]).drop(*[f"_s{c}" for c in range(n)])
        means = near.groupBy("id").agg(F.avg("label").alias("prediction"))
        return queries.join(means, F.col("_q") == F.col("id")).drop("id", "_q")


@dataclass
class AdaBoost:
    """SAMME: stumps fitted in turn, with the weight of wrongly predicted rows raised each time."""

    classes: int
    rounds: int = 50
    depth: int = 1

    def fit(self, df: DataFrame) -> WeightedVotes:
        work = cut_lineage(df.select("features", "label").withColumn("w", F.lit(1.0)))
        members, alphas = [], []
        for i in range(self.rounds):
            tree = C.DecisionTreeClassifier(**_cols(weightCol="w", maxDepth=self.depth, seed=SEED)).fit(work)
            missed = tree.transform(work).select("features", "label", "w", (F.col("prediction") != F.col("label")).alias("miss"))
            total, wrong = missed.agg(F.sum("w"), F.sum(F.when(F.col("miss"), F.col("w")).otherwise(0.0))).first()
            err = wrong / total
            if err >= 1 - 1 / self.classes and members:
                break
            alpha = math.log((1 - err) / max(err, 1e-10)) + math.log(self.classes - 1)
            members.append(tree)
            alphas.append(alpha)
            if err <= 1e-10:
                break
            work = missed.select("features", "label", (F.col("w") * F.when(F.col("miss"), math.exp(alpha)).otherwise(1.0) / F.lit(total)).alias("w"))
            if i % 5 == 4:
                work = cut_lineage(work)
        return WeightedVotes(members, alphas, self.classes)


@dataclass
class WeightedVotes:
    """Weighted hard votes of several classifiers."""

    members: list
    weights: list[float]
    classes: int

    def transform(self, df: DataFrame) -> DataFrame:
        out = apply_all(self.members, df)
        total = sum(self.weights) or 1.0
        shares = []
        for c in range(self.classes):
            share = F.lit(0.0)
            for i, w in enumerate(self.weights):
                share = share + F.when(F.col(f"_p{i}") == c, F.lit(w / total)).otherwise(0.0)
            shares.append(share)
        return votes_to_columns(out, shares).drop(*[f"_p{i}" for i in range(len(self.members))], *[f"_q{i}" for i in range(len(self.members))])


def apply_all(members: list, df: DataFrame) -> DataFrame:
    """Adds ``_p0, _p1 ...`` (predictions) and ``_q0 ...`` (probabilities, where given)."""
    out = df
    for i, m in enumerate(members):
        out = m.transform(out).drop("rawPrediction").withColumnRenamed("prediction", f"_p{i}")
        out = out.withColumnRenamed("probability", f"_q{i}") if "probability" in out.columns else out
    return out


@dataclass
class SoftVotes:
    """Weighted mean of class probabilities, or of predictions for regression."""

    members: list
    weights: list[float]
    classes: int

    def transform(self, df: DataFrame) -> DataFrame:
        out = apply_all(self.members, df)
        total = sum(self.weights)
        if not self.classes:
            mean = sum((F.col(f"_p{i}") * (w / total) for i, w in enumerate(self.weights)), F.lit(0.0))
            out = out.withColumn("prediction", mean)
        else:
            held = [vector_to_array(f"_q{i}") if f"_q{i}" in out.columns else F.array(
                *[(F.col(f"_p{i}") == c).cast("double") for c in range(self.classes)]) for i in range(len(self.members))]
            shares = [sum((held[i][c] * (w / total) for i, w in enumerate(self.weights)), F.lit(0.0)) for c in range(self.classes)]
            out = votes_to_columns(out, shares)
        return out.drop(*[f"_p{i}" for i in range(len(self.members))], *[f"_q{i}" for i in range(len(self.members))])


@dataclass
class Vote:
    """Several models side by side; hard or soft voting, mean for regression."""

    bases: list
    classes: int
    weights: list[float] | None = None
    voting: str = "soft"

    def fit(self, df: DataFrame):
        members = [b.fit(df) for b in self.bases]
        weights = self.weights or [1.0] * len(members)
        return (WeightedVotes if self.classes and self.voting == "hard" else SoftVotes)(members, weights, self.classes)


@dataclass
class Stack:
    """A meta model over out-of-fold predictions of the base models."""

    bases: list
    meta: object
    classes: int
    folds: int = 3

    def fit(self, df: DataFrame) -> StackModel:
        held = cut_lineage(df.select("features", "label").withColumn("_fold", F.pmod(_mark("features", "label"), F.lit(self.folds))))
        parts = []
        for f in range(self.folds):
            rest = held.where(F.col("_fold") != f).drop("_fold")
            parts.append(_meta_features([b.fit(rest) for b in self.bases], held.where(F.col("_fold") == f).drop("_fold"), self.classes))
        outside = parts[0]
        for p in parts[1:]:
            outside = outside.unionByName(p)
        meta = self.meta.fit(outside.select(F.col("_meta").alias("features"), "label"))
        return StackModel([b.fit(held.drop("_fold")) for b in self.bases], meta, self.classes)


def _mark(*columns: str):
    """A hash of the content of a row: the same whatever the partitions."""
    return F.xxhash64(*[vector_to_array(c) if c == "features" else F.col(c) for c in columns])


def _bootstrap(df: DataFrame, seed: int) -> DataFrame:
    """Every row as often as a Poisson number of mean 1 says that its hash and the seed draw."""
    u = F.pmod(F.xxhash64("_mark", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    times, share, total = F.lit(0), math.exp(-1), 0.0
    for k in range(8):
        total += share
        times = times + (u >= total).cast("int")
        share /= k + 1
    return df.withColumn("_times", times).where("_times > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).drop("_times", "_copy")


def _meta_features(members: list, df: DataFrame, classes: int) -> DataFrame:
    out = apply_all(members, df)
    cells = []
    for i in range(len(members)):
        if classes and f"_q{i}" in out.columns:
            cells += [vector_to_array(f"_q{i}")[c] for c in range(classes)]
        else:
            cells.append(F.col(f"_p{i}"))
    return out.withColumn("_meta", array_to_vector(F.array(*cells))).drop(
        *[f"_p{i}" for i in range(len(members))], *[f"_q{i}" for i in range(len(members))])


@dataclass
class StackModel:
    members: list
    meta: object
    classes: int

    def transform(self, df: DataFrame) -> DataFrame:
        held = _meta_features(self.members, df, self.classes).withColumnsRenamed({"features": "_own", "_meta": "features"})
        return self.meta.transform(held).drop("features", "rawPrediction").withColumnRenamed("_own", "features")


@dataclass
class Bag:
    """The same model on bootstrap samples, averaged."""

    base: Callable[[], object]
    classes: int
    rounds: int = 10

    def fit(self, df: DataFrame):
        held = cut_lineage(df.select("features", "label").withColumn("_mark", _mark("features", "label")))
        members = [self.base().fit(_bootstrap(held, SEED + i).drop("_mark")) for i in range(self.rounds)]
        return SoftVotes(members, [1.0] * len(members), self.classes)


class GradientBoosting:
    """Boosted trees; more than two classes are handled one against the rest."""

    def __new__(cls, classes: int, **kw):
        model = C.GBTClassifier(**_cols(seed=SEED, **kw))
        return model if classes == 2 else C.OneVsRest(**_cols(classifier=model, parallelism=4))


def _svc(classes: int, **kw):
    model = C.LinearSVC(**_cols(**{"maxIter": 50, **kw}))
    return model if classes == 2 else C.OneVsRest(**_cols(classifier=model, parallelism=4))


def _rbf(linear: Callable[..., object], gamma: float | None = None, size: int = 300, **kw) -> KernelMachine:
    return KernelMachine(linear(**kw), gamma, size)


@dataclass(frozen=True)
class Spec:
    key: str
    label: str
    task: str
    build: Callable[..., object]  # (rows, classes, **params)
    tags: tuple[str, ...] = ()


_CLF, _REG = "classification", "regression"
REGISTRY: dict[str, Spec] = {}


def register(spec: Spec) -> None:
    REGISTRY[spec.key] = spec


for _s in (
    Spec("logistic_regression", "Logistic Regression", _CLF, lambda n, c, **kw: C.LogisticRegression(**_cols(**{"maxIter": 100, **kw})), ("linear",)),
    Spec("decision_tree_clf", "Decision Tree", _CLF, lambda n, c, **kw: C.DecisionTreeClassifier(**_cols(seed=SEED, **{"maxDepth": 10, **kw})), ("tree",)),
    Spec("random_forest_clf", "Random Forest", _CLF, lambda n, c, **kw: C.RandomForestClassifier(**_cols(seed=SEED, **{"numTrees": 200, "maxDepth": 10, **kw})), ("tree",)),
    Spec("gradient_boosting_clf", "Gradient Boosting", _CLF, lambda n, c, **kw: GradientBoosting(c, **{"maxIter": 100, "maxDepth": 3, "stepSize": 0.1, **kw}), ("tree",)),
    Spec("adaboost_clf", "AdaBoost", _CLF, lambda n, c, **kw: AdaBoost(c, **kw), ("tree",)),
    Spec("svm_clf", "Linear SVM", _CLF, lambda n, c, **kw: _svc(c, **kw), ("linear",)),
    Spec("svm_rbf_clf", "SVM (RBF)", _CLF, lambda n, c, **kw: _rbf(lambda **own: _svc(c, **own), **kw), ("distance",)),
    Spec("knn_clf", "k-Nearest Neighbours", _CLF, lambda n, c, **kw: Knn(c, **kw), ("distance",)),
    Spec("naive_bayes", "Gaussian Naive Bayes", _CLF, lambda n, c, **kw: C.NaiveBayes(**_cols(modelType="gaussian", **kw)), ("bayes",)),
    Spec("linear_regression", "Linear Regression", _REG, lambda n, c, **kw: R.LinearRegression(**_cols(**kw)), ("linear",)),
    # The penalties of unit size, in Spark's scaling of the objective.
    Spec("ridge", "Ridge", _REG, lambda n, c, **kw: R.LinearRegression(**_cols(**{"regParam": 1.0 / max(n, 1), "elasticNetParam": 0.0, "standardization": False, **kw})), ("linear",)),
    Spec("lasso", "Lasso", _REG, lambda n, c, **kw: R.LinearRegression(**_cols(**{"regParam": 1.0, "elasticNetParam": 1.0, "standardization": False, **kw})), ("linear",)),
    Spec("elastic_net", "Elastic Net", _REG, lambda n, c, **kw: R.LinearRegression(**_cols(**{"regParam": 1.0, "elasticNetParam": 0.5, "standardization": False, **kw})), ("linear",)),
    Spec("decision_tree_reg", "Decision Tree", _REG, lambda n, c, **kw: R.DecisionTreeRegressor(**_cols(seed=SEED, **{"maxDepth": 10, **kw})), ("tree",)),
    Spec("random_forest_reg", "Random Forest", _REG, lambda n, c, **kw: R.RandomForestRegressor(**_cols(seed=SEED, **{"numTrees": 200, "maxDepth": 10, **kw})), ("tree",)),
    Spec("gradient_boosting_reg", "Gradient Boosting", _REG, lambda n, c, **kw: R.GBTRegressor(**_cols(seed=SEED, **{"maxIter": 100, "maxDepth": 3, "stepSize": 0.1, **kw})), ("tree",)),
    Spec("adaboost_reg", "AdaBoost", _REG, lambda n, c, **kw: AdaBoostR2(**kw), ("tree",)),
    Spec("kernel_ridge", "Kernel Ridge (RBF)", _REG, lambda n, c, **kw: _rbf(lambda **own: R.LinearRegression(**_cols(**{"regParam": 1.0 / max(n, 1), "elasticNetParam": 0.0, "standardization": False, **own})), **kw), ("distance",)),
    Spec("knn_reg", "k-Nearest Neighbours", _REG, lambda n, c, **kw: Knn(0, **kw), ("distance",)),
):
    register(_s)

DEFAULTS = {
    _CLF: ["logistic_regression", "decision_tree_clf", "random_forest_clf", "gradient_boosting_clf"],
    _REG: ["linear_regression", "ridge", "decision_tree_reg", "random_forest_reg", "gradient_boosting_reg"],
}


def build(key: str, rows: int, classes: int, params: dict | None = None):
    return REGISTRY[key].build(rows, classes, **(params or {}))


def settings_of(model) -> dict:
    """The settings of a fitted Spark ML model, scalars only."""
    if not hasattr(model, "extractParamMap"):
        return {k: v for k, v in vars(model).items() if isinstance(v, (bool, int, float, str))}
    return {p.name: v for p, v in model.extractParamMap().items() if isinstance(v, (bool, int, float, str))}
