"""Target discovery: which columns can be predicted, and which only repeat other columns."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from itertools import combinations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainfold.functions import columns as fc
from grainfold.operators import stats
from grainfold.operators.ml import metrics, prep, train
from grainfold.operators.profile import Profile

LEAK_CORRELATION, HINT_CORRELATION = 0.9, 0.8
LEAK_PURITY = 0.97
LEAK_TREE_R2 = 0.95
PAIR_BLOCK = 64  # pairs of columns in one pass


def viable_targets(profile: Profile, max_targets: int | None = None) -> DataFrame:
    """Columns worth predicting: no text, dates, constants, mostly empty columns or near-unique categories."""
    kind, unique = F.col("semantic_type"), F.col("unique")
    near_unique = (kind == "categorical") & (unique >= 0.95 * profile.n_rows) & (unique > 20)
    found = profile.columns.where(~kind.isin("text", "datetime") & (unique > 1) & (F.col("missing_pct") <= 40) & ~near_unique).orderBy("position")
    return (found if max_targets is None else found.limit(max_targets)).select("position", F.col("name").alias("target"))


def single_leak(df: DataFrame, target: str, task: str, numeric: list[str], categorical: list[str]) -> DataFrame:
    """(feature, signal, value, verdict): single columns that give the target away, strongest first."""
    if task == "regression":
        found = prep.correlation_to_target(df, target, numeric).where("n >= 10 AND corr IS NOT NULL")
        value, bound, hint = F.abs("corr"), LEAK_CORRELATION, HINT_CORRELATION
        held = found.select("feature", F.lit("correlation").alias("signal"), value.alias("value"))
    else:
        found = prep.purity_table(df, target, categorical).where("groups >= 2")
        held = found.select("feature", F.lit("purity").alias("signal"), F.col("purity").alias("value"))
        bound, hint = LEAK_PURITY, None
    verdict = F.when(F.col("value") >= bound, "leak")
    if hint:
        verdict = verdict.when(F.col("value") >= hint, "hint")
    return held.withColumn("verdict", verdict.otherwise("none")).orderBy(F.desc("value"), "feature")


def pair_leaks(df: DataFrame, target: str, numeric: list[str]) -> DataFrame:
    """(driver, value, verdict): correlation of the target with ratios and products of all pairs of columns.

    Pairs are worked on in blocks of ``PAIR_BLOCK``, one pass over the table each, so that a row is not blown up without bound.
    """
    pairs = list(combinations(numeric, 2))
    out = None
    for i in range(0, len(pairs), PAIR_BLOCK):
        part = _pair_block(df, target, pairs[i : i + PAIR_BLOCK])
        out = part if out is None else out.unionByName(part)
    return out if out is not None else df.sparkSession.createDataFrame([], "driver string, value double, verdict string")


def _pair_block(df: DataFrame, target: str, pairs: list[tuple[str, str]]) -> DataFrame:
    x = {c: fc.number_of(df, c) for pair in pairs for c in pair}
    cells = []
    for a, b in pairs:
        cells += [F.struct(F.lit(f"{a} / {b}").alias("driver"), fc.ratio(x[a], x[b]).alias("x")),
                  F.struct(F.lit(f"{a} × {b}").alias("driver"), (x[a] * x[b]).alias("x"))]
    rows = df.select(fc.number_of(df, target).alias("y"), F.inline(F.array(*cells))).where("y IS NOT NULL AND abs(x) < double('Infinity')")
    found = rows.groupBy("driver").agg(F.count("*").alias("n"), F.abs(stats.correlation_complete(F.col("x"), F.col("y"))).alias("value"))
    verdict = F.when(F.col("value") >= LEAK_CORRELATION, "leak").when(F.col("value") >= HINT_CORRELATION, "hint").otherwise("none")
    return found.where("n >= 10 AND value IS NOT NULL").select("driver", "value", verdict.alias("verdict"))


def tree_leak(df: DataFrame, target: str, numeric: list[str], depth: int = 6) -> DataFrame:
    """One row: in-sample R2 of a shallow tree, whether it leaks, and its two main features."""
    held = df.select(F.coalesce(fc.number_of(df, target), F.lit(0.0)).alias("label"), *[
        F.coalesce(fc.number_of(df, c), F.lit(0.0)).alias(f"x{i}") for i, c in enumerate(numeric)])
    rows = VectorAssembler(inputCols=[f"x{i}" for i in range(len(numeric))], outputCol="features").transform(held)
    model = DecisionTreeRegressor(maxDepth=depth, seed=42).fit(rows)
    r2 = metrics.regression(model.transform(rows)).first()["r2"]
    ranked = sorted(((float(v), numeric[i]) for i, v in enumerate(model.featureImportances.toArray())), reverse=True)
    driver = ", ".join(n for v, n in ranked[:2] if v > 0.01)
    return df.sparkSession.createDataFrame([(target, r2, r2 is not None and r2 >= LEAK_TREE_R2, driver)],
                                           "target string, r2 double, leaky boolean, driver string")


def leak_driver(df: DataFrame, target: str, task: str, numeric: list[str], categorical: list[str]) -> tuple[bool, str | None]:
    """(leaky, driver): single column, then pair, then shallow tree."""
    first = single_leak(df, target, task, numeric, categorical).first() if (numeric if task == "regression" else categorical) else None
    if first and first["verdict"] == "leak":
        return True, first["feature"]
    if task == "regression" and numeric:
        pair = pair_leaks(df, target, numeric).orderBy(F.desc("value"), "driver").first()
        if pair and pair["verdict"] == "leak":
            return True, pair["driver"]
        tree = tree_leak(df, target, numeric).first()
        if tree["leaky"]:
            return True, tree["driver"]
    return False, first["feature"] if first and first["verdict"] == "hint" else None


# The model that stands for the reachable score, per task.
SCAN_MODELS = {"classification": ("random_forest_clf", {"numTrees": 40}), "regression": ("gradient_boosting_reg", {"maxIter": 60})}
SCAN_SCHEMA = ("target string, task string, primary_metric string, test_score double, cv_mean double, cv_std double, best_model string, "
               "n_features int, leaky boolean, driver string, error string")


PARALLEL = 6  # targets whose models are fitted at the same time; on small tables a single model leaves most cores idle


def scan(df: DataFrame, key: list[str], max_targets: int | None = None, cv_folds: int = 3, params: dict[str, dict] | None = None, parallel: int = PARALLEL) -> DataFrame:
    """One row per viable target with its reachable score and leak check; best first, failures last."""
    held = df.persist()
    profile = Profile(held)

    def one(target: str) -> dict:
        entry = {"target": target, "leaky": False}
        try:
            plan = prep.make_plan(held, target, profile=profile, features=[c for c in df.columns if c not in key])
            model, settings = SCAN_MODELS[plan.task]
            settings = settings | (params or {}).get(model, {})
            result = train.train(held, plan, key, [model], {model: settings}, cv_folds=cv_folds)
            top = result.entries[0]
            leaky, driver = leak_driver(held, target, plan.task, plan.numeric, plan.categorical)
            entry |= {"task": plan.task, "primary_metric": plan.primary, "test_score": top["test_score"], "cv_mean": top.get("cv_mean"),
                      "cv_std": top.get("cv_std"), "best_model": model, "n_features": len(plan.features), "leaky": leaky, "driver": driver}
        except Exception as e:  # noqa: BLE001 - one bad target must not end the scan
            entry["error"] = str(e)[:200]
        return entry

    targets = [r["target"] for r in viable_targets(profile, max_targets).collect() if r["target"] not in key]
    with ThreadPoolExecutor(max_workers=parallel) as pool:
        rows = list(pool.map(one, targets))
    rows.sort(key=lambda e: ("error" in e, -(e.get("test_score") or 0.0)))
    names = [f.split()[0] for f in SCAN_SCHEMA.split(", ")]
    held.unpersist()
    return df.sparkSession.createDataFrame([tuple(e.get(n) for n in names) for e in rows], SCAN_SCHEMA)


