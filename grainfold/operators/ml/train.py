"""Training: leaderboard, cross-validation, tuning, explanation, scoring, saved pipelines."""

from __future__ import annotations

import random
import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from itertools import product

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainfold.functions.columns import ref
from grainfold.operators import ordering
from grainfold.operators.ml import metrics, models, prep
from grainfold.operators.ml.prep import Plan, TrainingError

TOP = 3
ROWS_A_PART = 20_000
GRID_LIMIT = 48
LEARNING_SHARES = (0.1, 0.325, 0.55, 0.775, 1.0)
BOARD_SCHEMA = (
    "rank int, model string, task string, test_score double, train_score double, cv_mean double, cv_std double, "
    "metrics map<string,double>, seconds double, error string")


@dataclass
class Prepared:
    """Prepared training and test rows: key columns, ``features`` and ``label``."""

    plan: Plan
    key: list[str]
    rows: DataFrame
    pipeline: PipelineModel
    train: DataFrame
    test: DataFrame
    n_train: int

    @property
    def classes(self) -> int:
        return len(self.plan.classes)


def prepare(df: DataFrame, plan: Plan, key: list[str], share: float = 0.8) -> Prepared:
    """Label, split by key hash (stratified for classes), fit the preparation on the training rows."""
    data = prep.typed(df, plan, key).where(F.col("label").isNotNull())
    rows = prep.split(data, key, share, "label" if plan.task == "classification" else None).persist()
    n = rows.count()
    if n < prep.MIN_ROWS:
        raise TrainingError(f"need at least {prep.MIN_ROWS} labelled rows to train models")
    train = rows.where("is_train")
    pipeline = prep.preprocessor(train, plan).fit(train)
    ready = pipeline.transform(rows).select(*[ref(k) for k in key], "features", "label", "is_train")
    ready = ready.coalesce(max(1, -(-n // ROWS_A_PART))).persist()  # a model runs hundreds of jobs over these rows: no more tasks than they ask for
    n_train = ready.where("is_train").count()
    return Prepared(plan, key, rows, pipeline, ready.where("is_train").drop("is_train"), ready.where("NOT is_train").drop("is_train"), n_train)


def evaluate(df: DataFrame, plan: Plan, area: bool = True) -> dict[str, float]:
    """All metrics of a table with ``label`` and ``prediction``."""
    if plan.task == "regression":
        return {k: v for k, v in metrics.regression(df).first().asDict().items() if v is not None}
    out = {k: v for k, v in metrics.classification(df).first().asDict().items() if v is not None}
    if area and "probability" in df.columns:
        value = metrics.auc_weighted(df, "label", "probability", len(plan.classes))
        if value == value:
            out["roc_auc"] = value
    return out


def cross_validate(data: Prepared, key: str, params: dict | None = None, folds: int = 3) -> tuple[float, float]:
    """Mean and spread of the primary score; the whole preparation is fitted again in every fold."""
    fold = F.floor(prep.hash_share(*[ref(k) for k in data.key], F.lit("fold")) * folds)
    rows = data.rows.withColumn("_fold", fold)
    scores = []
    for f in range(folds):
        inside, outside = rows.where(F.col("_fold") != f), rows.where(F.col("_fold") == f)
        pipeline = prep.preprocessor(inside, data.plan).fit(inside)
        model = models.build(key, data.n_train, data.classes, params).fit(pipeline.transform(inside).coalesce(max(1, -(-data.n_train // ROWS_A_PART))))
        scores.append(evaluate(model.transform(pipeline.transform(outside)), data.plan, area=False).get(data.plan.primary, 0.0))
    mean = sum(scores) / folds
    return mean, (sum((s - mean) ** 2 for s in scores) / folds) ** 0.5


@dataclass
class Trained:
    """Result of a training run: the board, fitted models by key, and the data they saw."""

    data: Prepared
    board: DataFrame
    entries: list[dict]
    fitted: dict[str, object] = field(default_factory=dict)

    @property
    def best(self):
        return self.fitted[self.entries[0]["model"]]

    def predictions(self, train: bool = False) -> DataFrame:
        return self.best.transform(self.data.train if train else self.data.test)


def train(
    df: DataFrame, plan: Plan, key: list[str], keys: list[str] | None = None, params: dict[str, dict] | None = None,
    extra: dict[str, object] | None = None, balance: str | None = None, cv_folds: int = 3, cv_top: int = TOP,
) -> Trained:
    """Fit the candidates, rank them by the primary score, cross-validate the first few.

    ``extra`` adds ready estimators (ensembles) by name; ``balance`` is
    ``undersample``, ``weights`` or ``smote``.
    """
    data = prepare(df, plan, key)
    train_rows = _balanced(data, balance)
    candidates = {k: models.build(k, data.n_train, data.classes, (params or {}).get(k)) for k in (keys or models.DEFAULTS[plan.task])}
    if balance == "weights":
        for c in candidates.values():
            if hasattr(c, "setWeightCol"):
                c.setWeightCol("weight")
    candidates |= extra or {}
    entries, fitted = [], {}
    for name, estimator in candidates.items():
        start = time.perf_counter()
        entry = {"model": name, "task": plan.task}
        try:
            model = estimator.fit(train_rows)
            entry["metrics"] = evaluate(model.transform(data.test), plan)
            entry["test_score"] = entry["metrics"].get(plan.primary)
            entry["train_score"] = evaluate(model.transform(data.train), plan, area=False).get(plan.primary)
            fitted[name] = model
        except Exception as e:  # noqa: BLE001 - one model that fails must not end the run
            entry["error"] = str(e)[:200]
        entry["seconds"] = round(time.perf_counter() - start, 3)
        entries.append(entry)
    entries.sort(key=lambda e: (e.get("test_score") is None, -(e.get("test_score") or 0.0)))
    for i, e in enumerate(entries):
        e["rank"] = i + 1 if "error" not in e else None
        if i < cv_top and cv_folds and e["model"] in models.REGISTRY and "error" not in e:
            e["cv_mean"], e["cv_std"] = cross_validate(data, e["model"], (params or {}).get(e["model"]), cv_folds)
    if not fitted:
        raise TrainingError("all candidate models failed: " + "; ".join(e["error"] for e in entries))
    names = [f.split()[0] for f in BOARD_SCHEMA.split(", ")]
    board = df.sparkSession.createDataFrame([tuple(e.get(n) for n in names) for e in entries], BOARD_SCHEMA)
    return Trained(data, metrics.confidence(metrics.overfit(board)), entries, fitted)


def _balanced(data: Prepared, balance: str | None) -> DataFrame:
    if balance is None:
        return data.train
    if data.plan.task != "classification":
        raise TrainingError("class balance needs a class target")
    if balance == "undersample":
        return prep.undersample(data.train, "label", data.key)
    if balance == "weights":
        weights = prep.class_weights(data.train, "label").select(F.col("label").alias("_l"), "weight")
        return data.train.join(F.broadcast(weights), F.col("label") == F.col("_l")).drop("_l")  # a row for each class
    if balance == "smote":
        from pyspark.ml.functions import array_to_vector

        from grainfold.operators.ml import neighbors

        rows = data.train.select(F.concat_ws("-", *[ref(k) for k in data.key]).alias("id"), vector_to_array("features").alias("v"), "label")
        made = neighbors.smote(rows)
        return data.train.select("features", "label").unionByName(made.select(array_to_vector("v").alias("features"), "label"))
    raise TrainingError(f"unknown balance '{balance}'")


# --- tuning ----------------------------------------------------------------------------

# Settings tried per model.
GRIDS = {
    "logistic_regression": {"regParam": [0.001, 0.01, 0.1], "elasticNetParam": [0.0, 0.5]},
    "decision_tree_clf": {"maxDepth": [3, 5, 8], "minInstancesPerNode": [1, 5]},
    "random_forest_clf": {"numTrees": [50, 100, 200], "maxDepth": [5, 10]},
    "gradient_boosting_clf": {"maxIter": [20, 50], "maxDepth": [3, 5], "stepSize": [0.05, 0.1]},
    "ridge": {"regParam": [0.001, 0.01, 0.1, 1.0]},
    "lasso": {"regParam": [0.001, 0.01, 0.1, 1.0]},
    "elastic_net": {"regParam": [0.001, 0.01, 0.1, 1.0], "elasticNetParam": [0.2, 0.5, 0.8]},
    "decision_tree_reg": {"maxDepth": [3, 5, 8], "minInstancesPerNode": [1, 5]},
    "random_forest_reg": {"numTrees": [50, 100, 200], "maxDepth": [5, 10]},
    "gradient_boosting_reg": {"maxIter": [20, 50], "maxDepth": [3, 5], "stepSize": [0.05, 0.1]},
}


def tune(data: Prepared, key: str, grid: dict[str, list] | None = None, n_trials: int = 20, folds: int = 3, parallelism: int = 4) -> DataFrame:
    """(position, score, settings, method): all tried settings, the best first.

    Folds go by a hash of the key, and the preparation is fitted again in every fold. All
    combinations are tried up to a limit; beyond it a seeded sample of ``n_trials``.
    """
    grid = grid or GRIDS.get(key) or {}
    combos = [dict(zip(grid, values)) for values in product(*grid.values())]
    method = "grid"
    if len(combos) > GRID_LIMIT:
        combos, method = random.Random(models.SEED).sample(combos, n_trials), "random"
    fold = F.floor(prep.hash_share(*[ref(k) for k in data.key], F.lit("tune")) * folds)
    rows = data.rows.where("is_train").withColumn("_fold", fold)
    scores = [0.0] * len(combos)
    for f in range(folds):
        inside, outside = rows.where(F.col("_fold") != f), rows.where(F.col("_fold") == f)
        pipeline = prep.preprocessor(inside, data.plan).fit(inside)
        ready, held = pipeline.transform(inside).persist(), pipeline.transform(outside).persist()

        def tried(settings: dict, ready=ready, held=held) -> float:
            model = models.build(key, data.n_train, data.classes, settings).fit(ready)
            return evaluate(model.transform(held), data.plan, area=False).get(data.plan.primary) or 0.0

        with ThreadPoolExecutor(parallelism) as pool:  # independent Spark jobs
            scores = [s + t / folds for s, t in zip(scores, pool.map(tried, combos))]
        ready.unpersist()
        held.unpersist()
    ranked = sorted(zip(scores, combos), key=lambda p: -p[0])
    rows = [(i + 1, float(s), {k: str(v) for k, v in c.items()}, method) for i, (s, c) in enumerate(ranked)]
    return data.train.sparkSession.createDataFrame(rows, "position int, score double, settings map<string,string>, method string")


# --- explanation ------------------------------------------------------------------------

def permutation_importance(result: Trained, repeats: int = 5, k: int = 15) -> DataFrame:
    """(feature, importance): mean loss of score when the values of one feature are moved to other rows.

    Rows get a position in hash order; taking the value of the row some places on is
    a random permutation that needs only one join. All features and repeats are
    scored in one pass.
    """
    data, plan = result.data, result.data.plan
    raw = data.rows.where("NOT is_train").drop("is_train")
    columns = [c for c in raw.columns if c not in data.key and c != "label"]
    names = dict(zip(columns, plan.features))
    order = prep.fc.stable_order(*[ref(c) for c in data.key])
    placed = ordering.add_position(raw.select("*", order.alias("_o")), ["_o"], "_at").drop("_o")
    n = placed.count()
    other = F.struct(*[ref(c) for c in columns])
    copies = []
    for r in range(repeats):
        moved = placed.select(F.pmod(F.col("_at") + F.lit((r + 1) * max(1, n // (repeats + 1))), F.lit(n)).alias("_to"), other.alias("_other"))
        both = placed.join(moved, F.col("_at") == F.col("_to")).withColumn("_repeat", F.lit(r))
        variants = F.explode(F.array(*[
            F.struct(F.lit(names[c]).alias("feature"), *[(F.col(f"_other.{x}") if x == c else ref(x)).alias(x) for x in columns])
            for c in columns]))
        copies.append(both.select("label", "_repeat", variants.alias("_v")).select("label", "_repeat", "_v.*"))
    every = copies[0]
    for c in copies[1:]:
        every = every.unionByName(c)
    scored = result.best.transform(data.pipeline.transform(every).select("feature", "_repeat", "features", "label"))
    base = evaluate(result.predictions(), plan, area=False).get(plan.primary)
    by = grouped_score(scored, ["feature", "_repeat"], plan.task)
    return by.groupBy("feature").agg(F.avg(F.lit(base) - F.col("score")).alias("importance")).orderBy(
        F.desc("importance"), "feature").limit(k)


def grouped_score(df: DataFrame, by: list[str], task: str) -> DataFrame:
    """(by..., score): weighted F1 or R2 per group."""
    if task == "regression":
        err = F.pow(F.col("label") - F.col("prediction"), 2)
        return df.groupBy(*by).agg((1 - F.try_divide(F.avg(err), F.var_pop("label"))).alias("score"))
    counts = df.groupBy(*by, "label", "prediction").agg(F.count("*").alias("n"))
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)
    actual = counts.groupBy(*by, F.col("label").alias("c")).agg(F.sum("n").alias("a"), F.sum(hit).alias("h"))
    predicted = counts.groupBy(*by, F.col("prediction").alias("c")).agg(F.sum("n").alias("p"))
    f1 = 2 * F.col("h") / (F.col("a") + F.coalesce("p", F.lit(0)))
    return actual.join(predicted, [*by, "c"], "left").groupBy(*by).agg((F.sum(f1 * F.col("a")) / F.sum("a")).alias("score"))


def learning_curve(data: Prepared, key: str, params: dict | None = None, shares=LEARNING_SHARES) -> DataFrame:
    """(share, rows, train_score, test_score) for growing parts of the training rows, by key hash."""
    position = prep.hash_share(*[ref(k) for k in data.key], F.lit("curve"))
    rows = []
    for share in shares:
        part = data.train.where(position < share)
        n = part.count()
        model = models.build(key, n, data.classes, params).fit(part)
        scores = [evaluate(model.transform(d), data.plan, area=False).get(data.plan.primary) for d in (part, data.test)]
        rows.append((float(share), n, *scores))
    return data.train.sparkSession.createDataFrame(rows, "share double, rows bigint, train_score double, test_score double")


# --- scoring ------------------------------------------------------------------------------

def score(result_or_model, pipeline: PipelineModel, plan: Plan, df: DataFrame, key: list[str], schema: DataFrame | None = None) -> DataFrame:
    """Predictions for new rows: blanks take the defaults of the input schema; with class shares and confidence."""
    rows = prep.typed(df.drop(plan.target) if plan.target in df.columns else df, plan, key)
    if schema is not None:
        defaults = {r["name"]: (r["median"] if r["kind"] == "numeric" else r["mode"]) for r in schema.collect()}
        filled = {}
        for i, c in enumerate(plan.numeric):
            filled[f"n{i}"] = F.coalesce(F.col(f"n{i}"), F.lit(defaults.get(c)).cast("double"))
        for i, c in enumerate(plan.categorical):
            filled[f"c{i}"] = F.coalesce(F.nullif(F.col(f"c{i}"), F.lit("")), F.lit(defaults.get(c)).cast("string"))
        rows = rows.withColumns(filled)
    out = result_or_model.transform(pipeline.transform(rows))
    columns = [ref(k) for k in key]
    if plan.task == "regression":
        return out.select(*columns, "prediction")
    labels = F.array(*[F.lit(c) for c in plan.classes])
    columns.append(labels[F.col("prediction").cast("int")].alias("prediction"))
    if "probability" in out.columns:
        shares = vector_to_array("probability")
        columns += [F.map_from_arrays(labels, F.slice(shares, 1, len(plan.classes))).alias("probabilities"), F.array_max(shares).alias("confidence")]
    return out.select(*columns)


def save(model, pipeline: PipelineModel, path: str) -> None:
    """Write preparation and model as one pipeline."""
    PipelineModel(stages=[pipeline, model]).write().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)




def report_tables(result: Trained) -> DataFrame:
    """(section, name, value): leaderboard, metrics of the best model, its classes and importances, as one long table."""
    def rows(df: DataFrame, section: str, name: str, values: list[str]) -> DataFrame:
        cells = F.array(*[F.struct(F.concat_ws(".", ref(name).cast("string"), F.lit(v)).alias("name"), ref(v).cast("double").alias("value")) for v in values])
        return df.select(F.lit(section).alias("section"), F.inline(cells)).where("value IS NOT NULL")

    best = result.entries[0]
    spark = result.board.sparkSession
    numbers = spark.createDataFrame([("metrics", f"{best['model']}.{k}", float(v)) for k, v in sorted(best["metrics"].items())], "section string, name string, value double")
    out = rows(result.board, "leaderboard", "model", ["test_score", "train_score", "cv_mean", "gap", "confidence"]).unionByName(numbers)
    if result.data.plan.task == "classification":
        labels = F.array(*[F.lit(c) for c in result.data.plan.classes])
        report = metrics.class_report(result.predictions()).withColumn("label", labels[F.col("label").cast("int")])
        out = out.unionByName(rows(report, "classes", "label", ["precision", "recall", "f1", "support"]))
    return out.unionByName(rows(permutation_importance(result), "importance", "feature", ["importance"]))
