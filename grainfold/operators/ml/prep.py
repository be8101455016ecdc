"""Feature preparation: task, feature choice, leakage, preprocessing, splits, class balance."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import Pipeline
from pyspark.ml.feature import (
    Imputer, MinMaxScaler, OneHotEncoder, RobustScaler, SQLTransformer, StandardScaler, StringIndexer, VectorAssembler)
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainfold.functions import columns as fc
from grainfold.functions.columns import ref
from grainfold.operators import frames, rules, stats
from grainfold.operators.frames import select_once
from grainfold.operators.profile import Profile

MAX_CATEGORY_VALUES = 40
LEAK_CORRELATION = 0.995
LEAK_PURITY = 0.999
MIN_ROWS = 20
FEATURES, LABEL = "features", "label"


class TrainingError(ValueError):
    """The data or the settings do not allow training."""


def infer_task(profile: Profile, target: str) -> DataFrame:
    """(target, task); distinct counts are compared with the non-null rows."""
    share = F.try_divide(F.col("unique") * 100.0, F.col("non_null"))
    return profile.columns.where(F.col("name") == target).select(
        F.col("name").alias("target"), rules.task_of(F.col("semantic_type"), F.col("unique"), share).alias("task"))


def feature_table(profile: Profile, target: str, max_values: int = MAX_CATEGORY_VALUES) -> DataFrame:
    """(feature, kind): usable numeric columns, and categorical ones of at most ``max_values`` values; ``dropped_features`` names the others."""
    kind = F.col("semantic_type")
    few = kind.isin("categorical", "boolean") & (F.col("unique") <= max_values)
    return profile.columns.where((F.col("name") != target) & (F.col("unique") > 1) & ((kind == "numeric") | few)).select(
        "position", F.col("name").alias("feature"), F.when(kind == "numeric", "numeric").otherwise("categorical").alias("kind"))


def dropped_features(profile: Profile, target: str, max_values: int = MAX_CATEGORY_VALUES) -> DataFrame:
    """(feature, unique): categorical columns that ``feature_table`` leaves out because they hold more than ``max_values`` values."""
    return profile.columns.where((F.col("name") != target) & F.col("semantic_type").isin("categorical", "boolean") & (F.col("unique") > max_values)).select(
        F.col("name").alias("feature"), "unique")


def purity_table(df: DataFrame, target: str, features: list[str]) -> DataFrame:
    """(feature, purity, groups): how far each category alone decides the target."""
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), ref(c).cast("string").alias("value")) for c in features])
    counts = df.select(ref(target).cast("string").alias("y"), F.inline(cells)).na.drop().groupBy("feature", "value", "y").agg(F.count("*").alias("n"))
    best = counts.groupBy("feature", "value").agg(F.max("n").alias("m"), F.sum("n").alias("t"))
    return best.groupBy("feature").agg((F.sum("m") / F.sum("t")).alias("purity"), F.count("*").alias("groups"))


def correlation_to_target(df: DataFrame, target: str, numeric: list[str]) -> DataFrame:
    """(feature, corr, n): correlation of each numeric column with the target, one pass."""
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), fc.number_of(df, c).alias("x")) for c in numeric])
    rows = df.select(fc.number_of(df, target).alias("y"), F.inline(cells)).na.drop()
    return rows.groupBy("feature").agg(stats.correlation_complete(F.col("x"), F.col("y")).alias("corr"), F.count("*").alias("n"))


def leakage(df: DataFrame, target: str, numeric: list[str], categorical: list[str], task: str) -> DataFrame:
    """(feature, signal, value): features that almost are the target."""
    if task == "regression":
        found = correlation_to_target(df, target, numeric).where((F.col("n") >= 10) & (F.abs("corr") >= LEAK_CORRELATION))
        return found.select("feature", F.lit("correlation").alias("signal"), F.col("corr").alias("value"))
    if not categorical:
        return df.sparkSession.createDataFrame([], "feature string, signal string, value double")
    found = purity_table(df, target, categorical).where((F.col("groups") >= 2) & (F.col("purity") >= LEAK_PURITY))
    return found.select("feature", F.lit("purity").alias("signal"), F.col("purity").alias("value"))


@dataclass
class Plan:
    """What to train on: columns, task and preparation settings."""

    target: str
    task: str
    numeric: list[str]
    categorical: list[str]
    scaling: str = "standard"
    encoding: str = "onehot"
    removed: list[dict] = field(default_factory=list)
    classes: list[str] = field(default_factory=list)

    @property
    def features(self) -> list[str]:
        return self.numeric + self.categorical

    @property
    def primary(self) -> str:
        return "f1_weighted" if self.task == "classification" else "r2"


def make_plan(df: DataFrame, target: str, task: str | None = None, features: list[str] | None = None,
              detect_leakage: bool = True, profile: Profile | None = None, **settings) -> Plan:
    """Choose task and features for a target and drop leaking features."""
    if target not in df.columns:
        raise TrainingError(f"target column '{target}' not found")
    profile = profile or Profile(select_once(df, [*features, target]) if features else df)
    chosen = infer_task(profile, target).first()
    task = task or chosen["task"]
    usable = [r for r in feature_table(profile, target).orderBy("position").collect() if not features or r["feature"] in features]
    plan = Plan(target, task, [r["feature"] for r in usable if r["kind"] == "numeric"],
                [r["feature"] for r in usable if r["kind"] == "categorical"], **settings)
    if detect_leakage and plan.features:
        plan.removed = [r.asDict() for r in leakage(df, target, plan.numeric, plan.categorical, task).collect()]
        gone = {r["feature"] for r in plan.removed}
        plan.numeric = [c for c in plan.numeric if c not in gone]
        plan.categorical = [c for c in plan.categorical if c not in gone]
    if not plan.features:
        raise TrainingError("no usable feature columns for this target")
    if task == "classification":
        held = frames.split_labelled(df, target)[0]
        plan.classes = sorted(r[0] for r in held.select(ref(target).cast("string")).distinct().take(1001))
        if not 2 <= len(plan.classes) <= 1000:
            raise TrainingError("a class target needs 2 to 1000 classes")
    return plan


def typed(df: DataFrame, plan: Plan, keep: list[str] = ()) -> DataFrame:
    """Feature columns as doubles and texts under plain names, and the label as a number."""
    out = [ref(k) for k in keep]
    out += [fc.number_of(df, c).alias(f"n{i}") for i, c in enumerate(plan.numeric)]
    out += [ref(c).cast("string").alias(f"c{i}") for i, c in enumerate(plan.categorical)]
    if plan.target in df.columns:
        if plan.task == "classification":
            index = F.array_position(F.array(*[F.lit(c) for c in plan.classes]), ref(plan.target).cast("string")) - 1
            out.append(F.when(index >= 0, index).cast("double").alias(LABEL))
        else:
            out.append(fc.number_of(df, plan.target).alias(LABEL))
    return df.select(*out)


def preprocessor(data: DataFrame, plan: Plan) -> Pipeline:
    """Impute, scale and encode into one vector column; ``data`` comes from ``typed``."""
    stages, parts = [], []
    if plan.numeric:
        names = [f"n{i}" for i in range(len(plan.numeric))]
        filled = [f"{n}_filled" for n in names]
        stages += [Imputer(strategy="median", relativeError=1e-4, inputCols=names, outputCols=filled),
                   VectorAssembler(inputCols=filled, outputCol="_numbers")]
        scaler = {
            "standard": lambda: StandardScaler(inputCol="_numbers", outputCol="_scaled", withMean=True),
            "minmax": lambda: MinMaxScaler(inputCol="_numbers", outputCol="_scaled"),
            "robust": lambda: RobustScaler(inputCol="_numbers", outputCol="_scaled", withCentering=True),
        }.get(plan.scaling)
        if scaler:
            stages.append(scaler())
        parts.append("_scaled" if scaler else "_numbers")
    if plan.categorical:
        names = [f"c{i}" for i in range(len(plan.categorical))]
        tops = stats.top_values(stats.value_counts(data, names), 1).collect()
        modes = {r["column"]: r["value"].replace("\\", "\\\\").replace("'", "\\'") for r in tops}
        fills = ", ".join(f"coalesce({n}, '{modes[n]}') AS {n}_filled" for n in names if n in modes)
        names = [n for n in names if n in modes]
        stages += [
            SQLTransformer(statement=f"SELECT *, {fills} FROM __THIS__"),
            StringIndexer(inputCols=[f"{n}_filled" for n in names], outputCols=[f"{n}_index" for n in names],
                          handleInvalid="keep", stringOrderType="alphabetAsc"),
        ]
        if plan.encoding == "ordinal":
            sizes = {r["c"]: r["u"] for r in stats.distinct_counts(data, names).collect()}
            codes = ", ".join(f"CASE WHEN {n}_index >= {sizes[n]} THEN -1D ELSE {n}_index END AS {n}_code" for n in names)
            stages.append(SQLTransformer(statement=f"SELECT *, {codes} FROM __THIS__"))
            parts += [f"{n}_code" for n in names]
        else:
            # The slot for unknown values is the last one; dropping it makes them all zeros.
            stages.append(OneHotEncoder(inputCols=[f"{n}_index" for n in names], outputCols=[f"{n}_hot" for n in names], dropLast=True))
            parts += [f"{n}_hot" for n in names]
    stages.append(VectorAssembler(inputCols=parts, outputCol=FEATURES))
    return Pipeline(stages=stages)


# --- splits and balance --------------------------------------------------------------

def hash_share(*keys: Column) -> Column:
    """Number in [0, 1) from the key, the same on every run."""
    return F.conv(F.substring(fc.stable_order(*keys), 1, 8), 16, 10).cast("double") / F.lit(2.0 ** 32)


def split(df: DataFrame, key: list[str], share: float = 0.8, stratify: str | None = None) -> DataFrame:
    """Adds ``is_train``: the hash of the key decides, so each class is split alike without a sort.

    With ``stratify`` the cut of each class is the exact quantile of its hashes, which
    gives every class the wanted share up to one row.
    """
    held = df.withColumn("_h", hash_share(*[ref(k) for k in key]))
    if not stratify:
        return held.withColumn("is_train", F.col("_h") < share).drop("_h")
    cuts = stats.quantiles(held, {"_q": F.col("_h")}, [share], by=[stratify])
    cuts = cuts.select(ref(stratify).alias("_s"), F.col("_q")[0].alias("_cut"))
    sizes = held.groupBy(ref(stratify).alias("_s2")).agg(F.count("*").alias("_n"))
    cuts = cuts.join(sizes, F.col("_s").eqNullSafe(F.col("_s2"))).drop("_s2")
    # A row for each class, at most 1000 in a plan: sent to the rows, which stay where they are. A class of one row stays in training.
    out = held.join(F.broadcast(cuts), ref(stratify).eqNullSafe(F.col("_s")))
    return out.withColumn("is_train", (F.col("_h") < F.col("_cut")) | (F.col("_n") < 2)).drop("_h", "_s", "_cut", "_n")


def class_sizes(df: DataFrame, label: str) -> DataFrame:
    return df.where(ref(label).isNotNull()).groupBy(ref(label).alias("label")).agg(F.count("*").alias("n"))


def undersample(df: DataFrame, label: str, key: list[str]) -> DataFrame:
    """Every class cut to the size of the smallest, in hash order of the key.

    The cut-off hash of each class is an exact quantile, so no class is sorted in one task.
    """
    sizes = class_sizes(df, label)
    least = sizes.agg(F.min("n")).first()[0]
    held = df.where(ref(label).isNotNull()).withColumn("_o", fc.stable_order(*[ref(k) for k in key]))
    ranked = _rank_within(held, label, "_o")
    return ranked.where(F.col("_rank") <= least).drop("_o", "_rank")


def _rank_within(df: DataFrame, label: str, order: str) -> DataFrame:
    """Rank inside each class along a hash, counted over hash prefixes first."""
    bucket = F.substring(order, 1, 3)  # 4096 buckets per class
    sizes = df.groupBy(ref(label).alias("_l"), bucket.alias("_b")).agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_l").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_l", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    held = df.withColumn("_b2", bucket)
    joined = held.join(starts, (ref(label) == F.col("_l")) & (F.col("_b2") == F.col("_b")))
    inside = Window.partitionBy("_l", "_b").orderBy(order)
    return joined.withColumn("_rank", F.col("_start") + F.row_number().over(inside)).drop("_l", "_b", "_b2", "_start")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, n, weight): weight = rows / (classes * class rows)."""
    sizes = class_sizes(df, label)
    total = sizes.agg(F.sum("n").alias("_t"), F.count("*").alias("_k"))
    return sizes.join(total, F.lit(True)).select(  # one row
        "label", "n", (F.col("_t") / (F.col("_k") * F.col("n"))).alias("weight"))


def input_schema(df: DataFrame, numeric: list[str], categorical: list[str], choices: int = 20) -> DataFrame:
    """(name, kind, min, max, median, choices, mode): what a scoring form has to ask for."""
    frames_ = []
    if numeric:
        values = {c: fc.number_of(df, c) for c in numeric}
        medians = stats.quantile_row(df, values, [0.5])
        ends = df.select(*stats.stacked(values)).groupBy(F.col("c").alias("name")).agg(
            F.round(F.min("v"), 4).alias("min"), F.round(F.max("v"), 4).alias("max"))
        at = F.create_map(*[F.lit(x) for c in numeric for x in (c, medians[c][0])])
        frames_.append(ends.select("name", F.lit("numeric").alias("kind"), "min", "max", F.round(at[F.col("name")], 4).alias("median"),
                                   F.lit(None).cast("array<string>").alias("choices"), F.lit(None).cast("string").alias("mode")))
    if categorical:
        top = stats.top_values(stats.value_counts(df, categorical), choices)
        lists = top.groupBy(F.col("column").alias("name")).agg(F.array_sort(F.collect_list(F.struct("rank", "value"))).alias("a"))
        values_ = F.transform("a", lambda s: s["value"])
        null = F.lit(None).cast("double")
        frames_.append(lists.select("name", F.lit("categorical").alias("kind"), null.alias("min"), null.alias("max"), null.alias("median"),
                                    values_.alias("choices"), values_[0].alias("mode")))
    out = frames_[0]
    for f in frames_[1:]:
        out = out.unionByName(f)
    return out
