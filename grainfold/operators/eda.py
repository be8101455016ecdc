"""Automatic exploration: the data of a fixed set of charts for any table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainfold.functions import columns as fc
from grainfold.functions.columns import ref
from grainfold.operators import charts, frames, stats
from grainfold.operators.profile import Profile

HIST_BINS = 12


def histogram(df: DataFrame, column: str) -> DataFrame:
    """Up to twelve equal bins, with the skewness of the column and its label."""
    v = fc.number_of(df, column)
    distinct = df.select(v.alias("v")).where("v IS NOT NULL").distinct().limit(HIST_BINS).count()
    bins = stats.histogram(df, v, min(HIST_BINS, max(3, distinct)))
    skew = df.agg(F.coalesce(stats.sample_skewness(v), F.lit(0.0))).first()[0]
    return bins.withColumn("skew", F.lit(skew)).withColumn("shape", fc.skew_label(F.col("skew")))


def box(df: DataFrame, column: str) -> DataFrame:
    """Quartiles, whiskers inside the fences and the number of values beyond them."""
    v = fc.number_of(df, column)
    f = stats.fences(df, {"v": v})["v"]
    return df.select(v.alias("v")).where("v IS NOT NULL").agg(
        F.greatest(F.min("v"), F.lit(f["low"])).alias("low"), F.lit(f["q1"]).alias("q1"),
        F.lit(f["median"]).alias("median"), F.lit(f["q3"]).alias("q3"),
        F.least(F.max("v"), F.lit(f["high"])).alias("high"),
        F.count_if((F.col("v") < f["low"]) | (F.col("v") > f["high"])).alias("outliers"))


def strongest_pair(df: DataFrame, numeric: list[str]) -> tuple[str, str] | None:
    row = stats.correlation_pairs(df, {n: fc.number_of(df, n) for n in numeric}).where("corr IS NOT NULL").orderBy(
        F.desc(F.abs("corr")), "a", "b").first()
    return (row["a"], row["b"]) if row else None


def scatter(df: DataFrame, x: str, y: str, cap: int | None = None) -> DataFrame:
    """All points of a pair of columns (``cap`` bounds them for display)."""
    return charts.scatter(df, x, y, cap=cap)


def scatter_note(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: correlation over all rows, strength and direction."""
    r = df.agg(F.coalesce(stats.correlation(fc.number_of(df, x), fc.number_of(df, y)), F.lit(0.0)).alias("corr"))
    strength = F.when(F.abs("corr") > 0.7, "strong").when(F.abs("corr") > 0.4, "moderate").otherwise("weak")
    return r.select("corr", strength.alias("strength"), F.when(F.col("corr") > 0, "positive").otherwise("negative").alias("direction"))


def category_bar(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    """The commonest categories with their share of the non-null rows."""
    counts = df.select(ref(column).cast("string").alias("category")).where("category IS NOT NULL").groupBy("category").agg(
        F.count("*").alias("count"))
    total = df.agg(F.count(ref(column))).first()[0]
    return counts.withColumn("share", F.col("count") / F.lit(max(total, 1)) * 100).orderBy(F.desc("count"), "category").limit(k)


def pie(df: DataFrame, column: str) -> DataFrame:
    return category_bar(df, column, 8)


def grouped_mean(df: DataFrame, number: str, category: str, k: int = 10) -> DataFrame:
    means = stats.aggregate(df, [category], number, "mean", drop_null_groups=True)
    return means.select(ref(category).alias("category"), F.round("value", 3).alias("value")).orderBy(
        F.desc("value"), "category").limit(k)


def violin(df: DataFrame, number: str, category: str) -> DataFrame:
    return charts.violin(df, number, category, categories=5)


def time_series(df: DataFrame, date: str, value: str) -> DataFrame:
    """Monthly sums with the trend from the first to the last month (beyond 5 %)."""
    months = frames.by_month(df, date, value, "sum")
    ends = months.agg(F.min_by("value", "period"), F.max_by("value", "period")).first()
    first, last = ends[0] or 0.0, ends[1] or 0.0
    change = (last - first) / abs(first) if first else 0.0
    trend = "upward" if change > 0.05 else "downward" if change < -0.05 else "flat"
    return months.withColumn("trend", F.lit(trend))


def heatmap(df: DataFrame, columns: list[str]) -> DataFrame:
    return stats.correlation_cells(df, {c: fc.number_of(df, c) for c in columns}, 2)


def plan(df: DataFrame, profile: Profile | None = None, limit: int | None = None) -> list[dict]:
    """Which charts to make for a table, in order: every number and every category has its own; the first ``limit`` if given."""
    profile = profile or Profile(df)
    numeric, dates = profile.names("numeric"), profile.names("datetime")
    categories = profile.names("categorical", "boolean")
    out: list[dict] = []
    if len(numeric) >= 2:
        out.append({"chart": "heatmap", "columns": numeric})
    for c in numeric:
        out += [{"chart": "histogram", "columns": [c]}, {"chart": "box", "columns": [c]}]
    pair = strongest_pair(df, numeric) if len(numeric) >= 2 else None
    if pair:
        out.append({"chart": "scatter", "columns": list(pair)})
    for c in categories:
        out += [{"chart": "bar", "columns": [c]}, {"chart": "pie", "columns": [c]}]
    if numeric and categories:
        out += [{"chart": k, "columns": [numeric[0], categories[0]]} for k in ("grouped_mean", "violin")]
    if dates and numeric:
        out.append({"chart": "time_series", "columns": [dates[0], numeric[0]]})
    return out[:limit]


MAKERS = {
    "heatmap": lambda df, c: heatmap(df, c), "histogram": lambda df, c: histogram(df, *c), "box": lambda df, c: box(df, *c),
    "scatter": lambda df, c: scatter(df, *c), "bar": lambda df, c: category_bar(df, *c), "pie": lambda df, c: pie(df, *c),
    "grouped_mean": lambda df, c: grouped_mean(df, *c), "violin": lambda df, c: violin(df, *c),
    "time_series": lambda df, c: time_series(df, *c),
}


def explore(df: DataFrame) -> list[tuple[dict, DataFrame]]:
    """Every planned chart with its data."""
    return [(spec, MAKERS[spec["chart"]](df, spec["columns"])) for spec in plan(df)]
