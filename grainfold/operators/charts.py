"""Chart data: one aggregated DataFrame per chart type.

The whole table is aggregated on Spark; only category limits bound the output.
Charts of single points return all points and take an optional ``cap``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainfold.functions import columns as fc
from grainfold.functions.columns import ref
from grainfold.operators import stats
from grainfold.operators.profile import Profile

CATEGORY_LIMIT = 30
PIE_LIMIT = 10
VIOLIN_CATEGORIES = 8


class ChartError(ValueError):
    """The chart cannot be made from this table."""


def _text(df: DataFrame, name: str) -> Column:
    return ref(name).cast("string").alias(name)


def _cap(df: DataFrame, cap: int | None) -> DataFrame:
    return df if cap is None else df.limit(cap)


# --- distributions -----------------------------------------------------------------

def histogram(df: DataFrame, x: str, color: str | None = None, bins: int = 30) -> DataFrame:
    held = df.select(fc.number_of(df, x).alias("_x"), *([_text(df, color)] if color else []))
    return stats.histogram(held, F.col("_x"), bins, [color] if color else [])


def box(df: DataFrame, y: str, x: str | None = None, color: str | None = None) -> DataFrame:
    """Five-number summary per group; whiskers end at the fences."""
    by = list(dict.fromkeys(c for c in (x, color) if c))
    held = df.select(fc.number_of(df, y).alias("_y"), *[_text(df, c) for c in by]).where(F.col("_y").isNotNull())
    q = stats.quantiles(held, {"_q": F.col("_y")}, [0.25, 0.5, 0.75], by)
    ends = held.groupBy(*[ref(c) for c in by]).agg(F.min("_y").alias("_lo"), F.max("_y").alias("_hi"), F.count("*").alias("count"))
    both = ends.alias("e").join(q.alias("q"), _same(by))  # without groups one row on each side
    q1, q3 = F.col("_q")[0], F.col("_q")[2]
    low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    return both.select(
        *[F.col(f"e.`{c}`").alias(c) for c in by], F.greatest("_lo", low).alias("low"), q1.alias("q1"),
        F.col("_q")[1].alias("median"), q3.alias("q3"), F.least("_hi", high).alias("high"), "count")


def _same(by: Sequence[str]) -> Column:
    cond = F.lit(True)
    for c in by:
        cond = cond & F.col(f"e.`{c}`").eqNullSafe(F.col(f"q.`{c}`"))
    return cond


def violin(df: DataFrame, y: str, x: str | None = None, points: int = 21, categories: int = VIOLIN_CATEGORIES) -> DataFrame:
    """Evenly spaced quantiles of a column, per commonest category: the outline of a violin."""
    from grainfold.operators.frames import keep_top_categories

    held = df.select(fc.number_of(df, y).alias("_y"), *([_text(df, x)] if x else [])).where(F.col("_y").isNotNull())
    if x:
        held = keep_top_categories(held, x, categories)
    probs = [i / (points - 1) for i in range(points)]
    q = stats.quantiles(held, {"_q": F.col("_y")}, probs, [x] if x else [])
    return q.select(*([ref(x)] if x else []), F.posexplode("_q").alias("step", "value"))


def kde(df: DataFrame, x: str, color: str | None = None, points: int = 50, cells: int = 512) -> DataFrame:
    """Gaussian density curve on an even grid, from finely binned counts and Scott's bandwidth.

    Rows are first counted into ``cells`` bins (mean value kept per bin), so the
    kernel sum runs over bins and not over rows.
    """
    by = [color] if color else []
    held = df.select(fc.number_of(df, x).alias("_x"), *[_text(df, c) for c in by]).where(F.col("_x").isNotNull())
    low, high, std_all, n_all = held.agg(F.min("_x"), F.max("_x"), F.stddev_samp("_x"), F.count("*")).first()
    if not n_all or not std_all:
        raise ChartError(f"'{x}' has no spread")
    binned = held.groupBy(*by, stats.bin_of(F.col("_x"), low, high, cells).alias("_b")).agg(
        F.count("*").alias("_n"), F.avg("_x").alias("_m"))
    whole = held.groupBy(*by).agg(F.count("*").alias("_N"), F.stddev_samp("_x").alias("_s"))
    width = F.col("_s") * F.pow(F.col("_N").cast("double"), F.lit(-0.2))
    per = binned.groupBy(*by).agg(F.collect_list(F.struct("_m", "_n")).alias("_cells"))  # at most `cells` entries
    joined = per.alias("e").join(whole.alias("q"), _same(by))
    reach = 3 * std_all * n_all ** -0.2
    step = (high - low + 2 * reach) / (points - 1)
    grid = F.explode(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.lit(low - reach) + i * F.lit(step)))
    rows = joined.select(*[F.col(f"e.`{c}`").alias(c) for c in by], "_cells", "_N", width.alias("_h"), grid.alias("x")).where("_h > 0")
    weight = F.aggregate(
        "_cells", F.lit(0.0),
        lambda acc, c: acc + c["_n"] * F.exp(-0.5 * F.pow((F.col("x") - c["_m"]) / F.col("_h"), 2)))
    return rows.select(*[ref(c) for c in by], "x",
                       (weight / (F.col("_N") * F.col("_h") * F.lit(math.sqrt(2 * math.pi)))).alias("density"))


def distribution(df: DataFrame, x: str, color: str | None = None, bins: int = 30) -> tuple[DataFrame, DataFrame]:
    """Histogram and density curve."""
    if bins < 1:
        raise ChartError("a histogram needs at least one bin")
    return histogram(df, x, color, bins), kde(df, x, color)


# --- comparison and trends --------------------------------------------------------------

def bar(
    df: DataFrame, x: str, y: str | None = None, color: str | None = None, aggregation: str | None = None,
    sort: str | None = None, limit: int = CATEGORY_LIMIT,
) -> DataFrame:
    """Aggregate by category and colour; the first ``limit`` categories by total or by name."""
    agg = aggregation or ("mean" if y else "count")
    groups = list(dict.fromkeys(c for c in (x, color) if c))
    cells = stats.aggregate(df, groups, y, agg)
    totals = cells.groupBy(ref(x).alias("_x")).agg(F.sum("value").alias("_t"))
    first = {"desc": F.desc("_t"), "asc": F.asc("_t")}.get(sort, F.col("_x"))
    kept = totals.orderBy(first, "_x").limit(limit)
    return cells.join(F.broadcast(kept), ref(x).eqNullSafe(F.col("_x"))).select(  # at most `limit` rows
        *[ref(g) for g in groups], "value", F.col("_t").alias("total"))


def line(df: DataFrame, x: str, y: str, color: str | None = None, aggregation: str = "mean", kind: str | None = None) -> DataFrame:
    """Aggregate y by x (time, number or category) and series."""
    kind = kind or Profile(df.select(ref(x))).semantic_types[x]
    axis = fc.date_of(df, x) if kind == "datetime" else fc.number_of(df, x) if kind == "numeric" else ref(x).cast("string")
    held = df.select(axis.alias(x), fc.number_of(df, y).alias("_v"), *([_text(df, color)] if color else [])).na.drop(subset=[x, "_v"])
    keys = [x] + ([color] if color else [])
    if aggregation == "median":
        q = stats.quantiles(held, {"_q": F.col("_v")}, [0.5], keys)
        return q.select(*[ref(k) for k in keys], F.col("_q")[0].alias("value"))
    reduce = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "count": F.count}[aggregation]
    return held.groupBy(*[ref(k) for k in keys]).agg(reduce("_v").alias("value"))


# --- relationships ------------------------------------------------------------------------

def scatter(df: DataFrame, x: str, y: str, color: str | None = None, size: str | None = None, cap: int | None = None) -> DataFrame:
    """Points with both coordinates; size is a number, colour keeps its type."""
    extra = [] if not color else [ref(color).alias(color)]
    if size:
        extra.append(fc.number_of(df, size).alias(size))
    points = df.select(fc.number_of(df, x).alias(x), fc.number_of(df, y).alias(y), *extra)
    return _cap(points.na.drop(subset=[x, y]), cap)


def bubble(df: DataFrame, x: str, y: str, size: str, color: str | None = None, cap: int | None = None) -> DataFrame:
    return scatter(df, x, y, color, size, cap)


def trend_line(df: DataFrame, x: str, y: str) -> DataFrame:
    """Correlation and both ends of the least-squares line."""
    a, b = fc.number_of(df, x), fc.number_of(df, y)
    held = df.select(a.alias("a"), b.alias("b")).na.drop()
    fit = held.agg(
        F.count("*").alias("n"), stats.correlation_complete(F.col("a"), F.col("b")).alias("corr"),
        F.try_divide(F.covar_pop("a", "b"), F.var_pop("a")).alias("slope"), F.avg("a").alias("ma"),
        F.avg("b").alias("mb"), F.min("a").alias("x0"), F.max("a").alias("x1"))
    at = lambda c: F.col("mb") + F.col("slope") * (F.col(c) - F.col("ma"))
    return fit.select("n", "corr", "slope", "x0", at("x0").alias("y0"), "x1", at("x1").alias("y1"))


def density(df: DataFrame, x: str, y: str, bins: int = 20) -> DataFrame:
    """Counts of a two-dimensional grid; empty cells are left out."""
    held = df.select(fc.number_of(df, x).alias("_x"), fc.number_of(df, y).alias("_y")).na.drop()
    x0, x1, y0, y1 = held.agg(F.min("_x"), F.max("_x"), F.min("_y"), F.max("_y")).first()
    if x0 is None:
        raise ChartError("no rows with both values")
    return held.groupBy(
        stats.bin_of(F.col("_x"), x0, x1, bins).alias("x_bin"), stats.bin_of(F.col("_y"), y0, y1, bins).alias("y_bin")
    ).agg(F.count("*").alias("count"))


def heatmap(df: DataFrame, columns: Sequence[str] | None = None, digits: int = 2) -> DataFrame:
    names = list(columns or Profile(df).names("numeric"))
    if len(names) < 2:
        raise ChartError("a correlation heat map needs two numeric columns")
    return stats.correlation_cells(df, {n: fc.number_of(df, n) for n in names}, digits)


def pair_plot(df: DataFrame, columns: Sequence[str] | None = None, color: str | None = None, bins: int = 20) -> DataFrame:
    """(a, b, hue, a_bin, b_bin, count): a small two-dimensional histogram for every pair of columns."""
    names = list(columns or Profile(df).names("numeric"))
    held = df.select(*[fc.number_of(df, n).alias(n) for n in names],
                     (ref(color).cast("string") if color else F.lit(None).cast("string")).alias("_hue")).na.drop(subset=names)
    ends = held.agg(*[f(ref(n)) for n in names for f in (F.min, F.max)]).first()
    slot = {n: stats.bin_of(ref(n), ends[2 * i], ends[2 * i + 1], bins) for i, n in enumerate(names)}
    cells = [
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), slot[a].alias("a_bin"), slot[b].alias("b_bin"))
        for i, a in enumerate(names) for b in names[i:]
    ]
    return held.select(F.col("_hue").alias("hue"), F.inline(F.array(*cells))).groupBy(
        "a", "b", "hue", "a_bin", "b_bin").agg(F.count("*").alias("count"))


def joint_plot(df: DataFrame, x: str, y: str, bins: int = 20) -> DataFrame:
    """(part, x_bin, y_bin, count): the grid and both margins."""
    grid = density(df, x, y, bins)
    joint = grid.select(F.lit("joint").alias("part"), "x_bin", "y_bin", "count")
    mx = grid.groupBy("x_bin").agg(F.sum("count").alias("count")).select(
        F.lit("x").alias("part"), "x_bin", F.lit(None).cast("int").alias("y_bin"), "count")
    my = grid.groupBy("y_bin").agg(F.sum("count").alias("count")).select(
        F.lit("y").alias("part"), F.lit(None).cast("int").alias("x_bin"), "y_bin", "count")
    return joint.unionByName(mx).unionByName(my)


def polynomial_fit(df: DataFrame, x: str, y: str, order: int = 1) -> DataFrame:
    """Least-squares polynomial of order 1 to 3: one row per coefficient, lowest power first.

    One pass sums powers of the centred and scaled x; the small system of
    normal equations is solved on the driver.
    """
    import numpy as np

    order = max(1, min(int(order), 3))
    held = df.select(fc.number_of(df, x).alias("a"), fc.number_of(df, y).alias("b")).na.drop()
    mean, std, n = held.agg(F.avg("a"), F.stddev_pop("a"), F.count("*")).first()
    if not n or not std:
        raise ChartError(f"'{x}' has no spread")
    z = (F.col("a") - F.lit(mean)) / F.lit(std)
    sums = held.agg(*[F.sum(F.pow(z, F.lit(float(p)))) for p in range(2 * order + 1)],
                    *[F.sum(F.pow(z, F.lit(float(p))) * F.col("b")) for p in range(order + 1)]).first()
    left = np.array([[sums[i + j] for j in range(order + 1)] for i in range(order + 1)])
    scaled = np.linalg.solve(left, np.array(sums[2 * order + 1:], dtype=float))
    # Back to powers of x: substitute z = (x - mean) / std.
    poly = np.poly1d([0.0])
    for p, c in enumerate(scaled):
        poly = poly + c * np.poly1d([1 / std, -mean / std]) ** p
    coefficients = list(poly.coeffs[::-1]) + [0.0] * (order + 1 - len(poly.coeffs))
    return df.sparkSession.createDataFrame(
        [(i, float(c)) for i, c in enumerate(coefficients)], "power int, coefficient double")


def cluster_map(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Correlation cells with row positions that put similar columns side by side.

    The matrix is computed on Spark; only its k x k cells are ordered on the
    driver, by average linkage.
    """
    names = list(columns or Profile(df).names("numeric"))
    cells = stats.correlation_cells(df, {n: fc.number_of(df, n) for n in names}, 6)
    r = {(c["x"], c["y"]): c["value"] for c in cells.collect()}
    live = [n for n in names if (n, n) in r]
    if len(live) < 2:
        raise ChartError("a cluster map needs two numeric columns with spread")
    groups = [[n] for n in live]
    while len(groups) > 1:
        def gap(i, j):
            pairs = [(a, b) for a in groups[i] for b in groups[j]]
            return sum(1 - r.get(p, 0.0) for p in pairs) / len(pairs)
        i, j = min(((i, j) for i in range(len(groups)) for j in range(i + 1, len(groups))), key=lambda p: gap(*p))
        groups[i] += groups.pop(j)
    at = F.create_map(*[F.lit(v) for i, n in enumerate(groups[0]) for v in (n, i)])
    return cells.select(at[F.col("x")].alias("x_position"), at[F.col("y")].alias("y_position"), "x", "y", "value")


# --- composition --------------------------------------------------------------------------

def pie(df: DataFrame, names: str, values: str | None = None, aggregation: str | None = None, limit: int = PIE_LIMIT) -> DataFrame:
    """Largest ``limit - 1`` categories and one "Other" for the rest."""
    slices = stats.aggregate(df, [names], values, aggregation or ("sum" if values else "count"))
    head = slices.orderBy(F.desc("value"), ref(names)).take(limit + 1)  # the one run of the aggregate that decides
    if len(head) <= limit:
        return df.sparkSession.createDataFrame(head, slices.schema)
    known = F.lit(False)
    for r in head[: limit - 1]:
        known = known | ref(names).eqNullSafe(F.lit(r[names]))
    return slices.groupBy(F.when(known, ref(names)).otherwise("Other").alias(names)).agg(F.sum("value").alias("value"))


def hierarchy(df: DataFrame, path: Sequence[str], values: str | None = None, aggregation: str | None = None) -> DataFrame:
    """(id, label, parent, value) of every node of the tree; data of treemap and sunburst."""
    if not path:
        raise ChartError("give at least one hierarchy column")
    from grainfold.operators.frames import rollup_path

    agg = aggregation or ("sum" if values else "count")
    leaves = stats.aggregate(df, list(path), values, agg)
    nodes = rollup_path(leaves.na.fill("null", subset=list(path)), path, F.sum("value"), "value")
    up = F.slice(F.array(*[ref(p) for p in path]), 1, F.col("depth"))
    return nodes.select(
        F.array_join(up, "/").alias("id"), F.element_at(up, -1).alias("label"),
        F.array_join(F.slice(up, 1, F.col("depth") - 1), "/").alias("parent"), F.round("value", 4).alias("value"))


# --- catalog --------------------------------------------------------------------------------

_CATEGORY = ("categorical", "boolean")
# Required fields per chart, as column kinds any of which will do.
CHARTS = {
    "histogram": [("numeric",)], "box": [("numeric",)], "violin": [("numeric",)],
    "bar": [(*_CATEGORY, "datetime")], "line": [("datetime", "numeric", "categorical"), ("numeric",)],
    "area": [("datetime", "numeric", "categorical"), ("numeric",)],
    "scatter": [("numeric",), ("numeric",)], "bubble": [("numeric",), ("numeric",), ("numeric",)],
    "density_heatmap": [("numeric",), ("numeric",)], "heatmap": [], "pie": [_CATEGORY],
    "treemap": [_CATEGORY], "sunburst": [_CATEGORY], "pairplot": [], "jointplot": [("numeric",), ("numeric",)],
    "kde": [("numeric",)], "regression": [("numeric",), ("numeric",)], "distribution": [("numeric",)], "clustermap": [],
    "scatter_map": [("numeric",), ("numeric",)], "bubble_map": [("numeric",), ("numeric",), ("numeric",)],
    "density_map": [("numeric",), ("numeric",)], "heat_map": [("numeric",), ("numeric",)],
    "hexbin_map": [("numeric",), ("numeric",)], "cluster_map": [("numeric",), ("numeric",)],
    "choropleth": [_CATEGORY],
}
_TWO_NUMBERS = ("heatmap", "pairplot", "clustermap")


def catalog(profile: Profile) -> DataFrame:
    """(chart, enabled): which chart types the columns of a table can satisfy."""
    kinds = list(profile.semantic_types.values())
    numbers = kinds.count("numeric")
    rows = []
    for chart, fields in CHARTS.items():
        enabled = all(set(kinds) & set(f) for f in fields)
        if chart in _TWO_NUMBERS or (chart.endswith("_map")):
            enabled = enabled and numbers >= 2
        rows.append((chart, enabled))
    return profile.spark.createDataFrame(rows, "chart string, enabled boolean")


BUILDERS = {
    "histogram": histogram, "box": box, "violin": violin, "bar": bar, "line": line, "area": line,
    "scatter": scatter, "bubble": bubble, "density_heatmap": density, "heatmap": heatmap, "pie": pie,
    "treemap": hierarchy, "sunburst": hierarchy, "pairplot": pair_plot, "jointplot": joint_plot, "kde": kde,
    "regression": polynomial_fit, "clustermap": cluster_map, "distribution": distribution,
}


def build(df: DataFrame, chart: str, **fields) -> DataFrame:
    """Chart data by chart name."""
    from grainfold.operators import maps

    builder = BUILDERS.get(chart) or maps.BUILDERS.get(chart)
    if builder is None:
        raise ChartError(f"unknown chart type '{chart}'")
    return builder(df, **fields)

