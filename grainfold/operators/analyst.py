"""Analytic answers with explicit parameters: rankings, trends, distributions, findings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainfold.functions import columns as fc
from grainfold.functions.columns import ref
from grainfold.operators import frames, stats
from grainfold.operators.profile import Profile

# Words that make a column the default metric or group, best first.
METRIC_WORDS = ("revenue", "sales", "amount", "profit", "total", "price", "value")
GROUP_WORDS = ("product", "category", "region", "segment", "customer", "type")


def top_n(
    df: DataFrame, group_by: str, metric: str | None = None, agg: str = "sum", n: int = 10,
    ascending: bool = False, number: Column | None = None,
) -> DataFrame:
    """Groups ranked by an aggregate; for sums also the share of the total in percent."""
    if metric is None and number is None:
        agg = "count"
    every = stats.aggregate(df, [group_by], metric, agg, number=number)
    order = F.asc("value") if ascending else F.desc("value")
    if agg != "sum":
        return every.where(ref(group_by).isNotNull()).withColumn("share_pct", F.lit(None).cast("double")).orderBy(order, ref(group_by)).limit(n)
    total = every.agg(F.sum("value")).first()[0]  # over all groups, the null one too
    share = F.try_divide(F.col("value"), F.lit(total)) * 100
    return every.where(ref(group_by).isNotNull()).withColumn("share_pct", share).orderBy(order, ref(group_by)).limit(n)


def number_summary(df: DataFrame, metric: str) -> DataFrame:
    """sum, mean, count, min, max and median of one column."""
    v = fc.number_of(df, metric)
    median = stats.quantile_row(df, {"v": v}, [0.5])["v"][0]
    return df.select(v.alias("v")).agg(
        F.sum("v").alias("sum"), F.avg("v").alias("mean"), F.count("v").alias("count"), F.min("v").alias("min"),
        F.max("v").alias("max")).withColumn("median", F.lit(median))


def aggregate(df: DataFrame, metric: str, agg: str = "sum", group_by: str | None = None, n: int = 10) -> DataFrame:
    """(metric, value) rows: the asked number with its context, or a ranking when a group is given."""
    if group_by:
        return top_n(df, group_by, metric, agg, n)
    s = number_summary(df, metric)
    cells = [(f"{agg}({metric})", agg), ("min", "min"), ("max", "max"), ("mean", "mean"), ("median", "median")]
    return s.select(F.inline(F.array(*[
        F.struct(F.lit(label).alias("metric"), F.col(c).cast("double").alias("value")) for label, c in cells])))


def describe(df: DataFrame) -> DataFrame:
    return Profile(df).summary().select("rows", "columns", "numeric_columns", "total_missing_cells", "duplicate_rows")


def correlation(df: DataFrame, numeric: Sequence[str] | None = None, k: int = 8) -> DataFrame:
    """The strongest pairs with strength and direction."""
    names = list(numeric or Profile(df).names("numeric"))
    pairs = stats.correlation_pairs(df, {c: fc.number_of(df, c) for c in names}).where("corr IS NOT NULL")
    r = F.col("corr")
    return pairs.select(
        "a", "b", F.round(r, 3).alias("corr"), fc.strength_label(r).alias("strength"),
        F.when(r >= 0, "positive").otherwise("negative").alias("direction")).orderBy(F.desc(F.abs("corr")), "a", "b").limit(k)


def missing(df: DataFrame) -> DataFrame:
    """Columns with missing values, most first."""
    total = F.count("*")
    row = df.agg(total.alias("n"), *[(total - F.count(fc.present(df, c))).alias(f"m{i}") for i, c in enumerate(df.columns)])
    cells = [F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("missing"), F.lit(i).alias("position"))
             for i, c in enumerate(df.columns)]
    return row.select("n", F.inline(F.array(*cells))).where("missing > 0").select(
        "column", "missing", F.round(F.col("missing") / F.col("n") * 100, 2).alias("missing_pct"), "position",
    ).orderBy(F.desc("missing"), "position").drop("position")


def distribution(df: DataFrame, metric: str) -> DataFrame:
    """Histogram with 5 to 20 bins (root of the row count) and the label of the skewness."""
    v = fc.number_of(df, metric)
    n, skew = df.agg(F.count(v), stats.sample_skewness(v)).first()
    bins = stats.histogram(df, v, stats.root_bins(n, 5, 20))
    return bins.withColumn("skew", F.lit(skew)).withColumn("shape", fc.skew_label(F.col("skew")))


def trend(df: DataFrame, date: str, metric: str, agg: str = "sum") -> DataFrame:
    """Monthly values with the change from first to last month in percent and its label."""
    months = frames.by_month(df, date, metric, "sum" if agg == "count" else agg, fill_gaps=True)
    ends = months.agg(F.min_by("value", "period"), F.max_by("value", "period")).first()
    change = (ends[1] - ends[0]) / abs(ends[0]) * 100 if ends[0] else 0.0
    label = "upward" if change > 2 else "downward" if change < -2 else "flat"
    return months.withColumn("change_pct", F.lit(float(change))).withColumn("trend", F.lit(label))


def group_summary(df: DataFrame, group_by: str, metric: str, n: int = 10) -> DataFrame:
    """records, total and average by group, largest total first."""
    held = df.select(ref(group_by), fc.number_of(df, metric).alias("_v"))
    return held.groupBy(ref(group_by)).agg(
        F.count("*").alias("records"), F.sum("_v").alias("total"), F.avg("_v").alias("average"),
    ).orderBy(F.desc("total"), ref(group_by)).limit(n)


def stat(df: DataFrame, metric: str) -> DataFrame:
    """mean, median, standard deviation, variance and skewness of one column."""
    v = fc.number_of(df, metric)
    median = stats.quantile_row(df, {"v": v}, [0.5])["v"][0]
    return df.select(v.alias("v")).agg(
        F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.var_samp("v").alias("variance"),
        stats.sample_skewness(F.col("v")).alias("skew")).withColumn("median", F.lit(median))


def _first(df: DataFrame, k: int | None) -> DataFrame:
    return df if k is None else df.limit(k)


def diagnose(profile: Profile, k: int | None = None) -> DataFrame:
    """(finding, subject, value): missing cells, duplicates, outliers (of the first ``k`` columns if given), imbalance of a likely target."""
    s = profile.summary()
    found = [
        s.where("total_missing_cells > 0").select(F.lit("missing").alias("finding"), F.lit(None).cast("string").alias("subject"),
                                                  F.col("total_missing_cells").cast("double").alias("value")),
        s.where("duplicate_pct > 1").select(F.lit("duplicates"), F.lit(None).cast("string"), F.col("duplicate_pct")),
        _first(profile.columns.where("outlier_pct >= 5").orderBy("position"), k).select(
            F.lit("outliers"), F.col("name"), F.col("outlier_pct")),
        imbalanced_targets(profile, None).select(F.lit("imbalance"), F.col("column"), F.col("pct")),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out


def imbalanced_targets(profile: Profile, task: str | None = "classification") -> DataFrame:
    """The best suggested target of which one value holds at least 80 % of the rows."""
    targets = profile.target_suggestions()
    if task:
        targets = targets.where(F.col("task") == task)
    top = profile.top_values(1).where("pct >= 80").select(F.col("column").alias("_c"), "value", "pct")
    return targets.join(top, F.col("column") == F.col("_c")).orderBy(F.desc("confidence"), "position").limit(1).select(
        "column", "value", "pct")


def derived_features(df: DataFrame, profile: Profile | None = None) -> DataFrame:
    """The table with calendar parts, a ratio, a log and an encoded category added."""
    profile = profile or Profile(df)
    rows = profile.rows
    out = df
    date = next(iter(profile.names("datetime")), None)
    if date:
        d = fc.date_of(df, date)
        out = out.withColumns({
            f"{date}_year": F.year(d), f"{date}_month": F.month(d), f"{date}_weekday": F.weekday(d),
            f"{date}_is_weekend": fc.is_weekend(d)})
    numbers = [f.name for f in df.schema.fields if fc.is_numeric(f.dataType)]
    if len(numbers) >= 2:
        a, b = numbers[:2]
        out = out.withColumn(f"{a}_per_{b}", fc.ratio(fc.number_of(df, a), fc.number_of(df, b)))
    skewed = [r["name"] for r in rows if abs(r.get("skew") or 0) > 1]
    if skewed:
        out = out.withColumn(f"{skewed[0]}_log", fc.log1p_floor0(fc.number_of(df, skewed[0])))
    many = [r["name"] for r in rows if r["semantic_type"] in ("categorical", "text") and r["unique"] > 20]
    few = profile.names("categorical", "boolean")
    if many:
        out = frames.frequency_encode(out, many[0])
    elif few:
        from grainfold.operators.cleaning import one_hot

        out = one_hot(out, few[0], {})
    return out


def cleaning_plan(profile: Profile, k: int | None = None) -> DataFrame:
    """(step, subject, value): cleaning steps in the order they should be made, for all columns or the first ``k`` of each kind."""
    s = profile.summary()
    cols = profile.columns
    worst = cols.where("missing > 0").orderBy(F.desc("missing"), "position").limit(1)
    steps = [
        worst.select(F.lit(1).alias("step"), F.lit("missing").alias("action"), F.col("name").alias("subject"),
                     F.col("missing_pct").alias("value")),
        s.where("duplicate_rows > 0").select(F.lit(2), F.lit("duplicates"), F.lit(None).cast("string"), F.col("duplicate_pct")),
        _first(cols.where("outlier_pct >= 5").orderBy("position"), k).select(F.lit(3), F.lit("outliers"), F.col("name"), F.col("outlier_pct")),
        _first(cols.where(F.col("semantic_type").isin("categorical", "text")).orderBy("position"), k).select(
            F.lit(4), F.lit("text"), F.col("name"), F.lit(None).cast("double")),
    ]
    out = steps[0]
    for f in steps[1:]:
        out = out.union(f)
    return out


# Candidate models and metrics per task.
RECOMMENDED = {
    "classification": (["logistic_regression", "random_forest", "gradient_boosting"], "f1_weighted, roc_auc"),
    "regression": (["linear_regression", "random_forest", "gradient_boosting"], "rmse, r2"),
}


def recommend_models(profile: Profile) -> DataFrame:
    """Task, candidate models and metrics for the first suggested target."""
    first = profile.target_suggestions(1)
    is_class = F.col("task") == "classification"

    def pick(i: int) -> Column:
        a, b = RECOMMENDED["classification"][i], RECOMMENDED["regression"][i]
        lit = (lambda v: F.array(*[F.lit(x) for x in v])) if isinstance(a, list) else F.lit
        return F.when(is_class, lit(a)).otherwise(lit(b))

    return first.select(F.col("column").alias("target"), "task", pick(0).alias("models"), pick(1).alias("metrics"), "confidence")


def default_columns(profile: Profile) -> DataFrame:
    """One row: the metric and the group to use when none is named."""
    def best(kinds: tuple[str, ...], words: Sequence[str]) -> Column:
        rank = F.lit(len(words))
        for i, w in reversed(list(enumerate(words))):
            rank = F.when(F.contains(F.lower("name"), F.lit(w)), i).otherwise(rank)
        fits = F.col("semantic_type").isin(*kinds)
        return F.min_by(F.when(fits, F.col("name")), F.when(fits, F.struct(rank, F.col("position"))))

    return profile.columns.agg(
        best(("numeric",), METRIC_WORDS).alias("metric"),
        best(("categorical", "boolean", "text"), GROUP_WORDS).alias("group_by"))


