"""Statistical building blocks: exact quantiles, moments, bins, correlations, value counts."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grainfold.functions.columns import is_atomic, is_fractional, is_temporal, ref

# The built-in percentile keeps one map entry per distinct value in the final
# task, and its time there grows faster than their number. Up to this many distinct
# values that is cheap; beyond it the ranks are found with shuffles only.
DISTINCT_LIMIT = 100_000
_BINS = 256
_FEW_GROUPS, _SALTS = 2_000, 32


def stacked(values: dict[str, Column], keep: Sequence[Column] = ()) -> list[Column]:
    """Columns for ``select`` that turn many value columns into (c, v) rows.

    One grouped aggregate over the rows replaces a long list of aggregates,
    which would grow past the size that the JVM compiles well.
    """
    pairs = [F.struct(F.lit(n).alias("c"), v.alias("v")) for n, v in values.items()]
    return [*keep, F.inline(F.array(*pairs)).alias("c", "v")]


def quantiles(
    df: DataFrame,
    values: dict[str, Column],
    probs: Sequence[float],
    by: Sequence[str] = (),
    distinct_limit: int = DISTINCT_LIMIT,
    bins: int = _BINS,
) -> DataFrame:
    """Exact, linearly interpolated quantiles: per group one array column per value."""
    held = df.select(*[ref(b) for b in by], *[v.cast("double").alias(n) for n, v in values.items()])
    distinct = held.agg(*[F.approx_count_distinct(ref(n)).alias(n) for n in values]).first()
    if max(distinct) > distinct_limit:
        return _ranked_quantiles(held, list(values), probs, list(by), bins)
    # Group keys travel as _g0, _g1 ... and columns as numbers: short keys aggregate fastest.
    keys = {f"_g{i}": b for i, b in enumerate(by)}
    cells = F.array(*[F.struct(F.lit(i).alias("_c"), ref(n).alias("_v")) for i, n in enumerate(values)])
    found = (
        held.select(*[ref(b).alias(k) for k, b in keys.items()], F.inline(cells))
        .groupBy(*keys, "_c", "_v").agg(F.count("_v").alias("_n"))
        .groupBy(*keys, "_c").agg(F.percentile("_v", F.array(*[F.lit(float(p)) for p in probs]), F.col("_n")).alias("_q"))
    )
    wide = found.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_c") == i, F.col("_q"))).alias(n) for i, n in enumerate(values)])
    return wide.select(*[F.col(k).alias(b) for k, b in keys.items()], *[ref(n) for n in values])


def _one_row_per_group(found: DataFrame, names: list[str], by: list[str]) -> DataFrame:
    wide = found.groupBy("g").agg(*[F.max(F.when(F.col("c") == n, F.col("q"))).alias(n) for n in names])
    return wide.select(*[F.col(f"g.`{b}`").alias(b) for b in by], *[ref(n) for n in names])


def _joined(rows: DataFrame, small: DataFrame, keys: list[str], n_groups: int) -> DataFrame:
    """``rows`` with a small row of their group: sent to the tasks, or for many groups joined by group and a salt, so that a large group spans many tasks."""
    if n_groups <= _FEW_GROUPS:
        return rows.join(F.broadcast(small), keys)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("v"), F.lit(_SALTS)).cast("int"))
    every = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    return salted.join(every, [*keys, "_salt"]).drop("_salt")


def _ranked_quantiles(held, names, probs, by, bins):
    """Quantiles by rank: value counts, narrow bins around each wanted rank, then only the bins that hold a rank.

    Approximate quantiles a little below and above each rank are the edges; bins are
    counted exactly, so an edge that is off costs time, never the result.
    """
    key = F.struct(F.lit(0).alias("_"), *[ref(b) for b in by])
    rows = held.select(*stacked({n: ref(n) for n in names}, [key.alias("g")])).where(F.col("v").isNotNull())
    counted = rows.groupBy("g", "c", "v").agg(F.count("*").alias("n"))
    cuts = sorted({min(1.0, max(0.0, p + side / (2 * bins))) for p in probs for side in (-1, 1)})
    edges = rows.groupBy("g", "c").agg(
        F.percentile_approx("v", F.array(*[F.lit(float(x)) for x in cuts]), F.lit(10 * bins)).alias("edges"),
        F.count("*").alias("total"),
    )
    n_groups = rows.agg(F.approx_count_distinct(F.struct("g", "c"))).first()[0] if by else len(names)
    at = [(F.col("total") - 1) * F.lit(float(p)) for p in probs]
    ranks = [side(x) for x in at for side in (F.floor, F.ceil)]
    above = sum(((F.col("edges")[i] < F.col("v")).cast("int") for i in range(len(cuts))), F.lit(0))
    binned = _joined(counted, edges, ["g", "c"], n_groups).withColumn("bin", above).drop("edges")
    sizes = binned.groupBy("g", "c", "bin").agg(F.sum("n").alias("size"), F.max("total").alias("total"))
    upto = Window.partitionBy("g", "c").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    wanted = (
        sizes.withColumn("start", F.sum("size").over(upto) - F.col("size"))
        .where(F.exists(F.array(*ranks), lambda r: (r >= F.col("start")) & (r < F.col("start") + F.col("size"))))
        .select("g", "c", "bin", "start")
    )
    inside = Window.partitionBy("g", "c", "bin").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    reached = (
        _joined(binned, wanted, ["g", "c", "bin"], n_groups)
        .withColumn("hi", F.col("start") + F.sum("n").over(inside))
        .withColumn("lo", F.col("hi") - F.col("n"))
    )

    def at_rank(i: int) -> Column:
        return F.max(F.when((ranks[i] >= F.col("lo")) & (ranks[i] < F.col("hi")), F.col("v")))

    found = reached.groupBy("g", "c").agg(
        F.array(*[at_rank(i) for i in range(2 * len(probs))]).alias("at"),
        F.max("total").alias("total"),
    )
    spots = []
    for i, p in enumerate(probs):
        rank = (F.col("total") - 1) * F.lit(float(p))
        low, high = F.col("at")[2 * i].cast("double"), F.col("at")[2 * i + 1].cast("double")
        spots.append(low + (high - low) * (rank - F.floor(rank)))
    return _one_row_per_group(found.withColumn("q", F.array(*spots)), names, by)


def quantile_row(df: DataFrame, values: dict[str, Column], probs: Sequence[float]) -> dict[str, list]:
    """The quantiles of whole columns as plain numbers."""
    row = quantiles(df, values, probs).first()
    return {n: (row[n] if row is not None and row[n] is not None else [None] * len(probs)) for n in values}


def values_and_quantiles(df: DataFrame, values: dict[str, Column], probs: Sequence[float]) -> DataFrame:
    """(c, u, q): distinct count and quantiles of each column from one table of value counts.

    For columns whose number of distinct values is known to be within bounds.
    """
    cells = F.array(*[F.struct(F.lit(i).alias("_c"), v.cast("double").alias("_v")) for i, v in enumerate(values.values())])
    counted = df.select(F.inline(cells)).groupBy("_c", "_v").agg(F.count("_v").alias("_n"))
    names = F.array(*[F.lit(n) for n in values])
    return counted.groupBy("_c").agg(
        F.count("_v").alias("u"), F.percentile("_v", F.array(*[F.lit(float(p)) for p in probs]), F.col("_n")).alias("q"),
    ).select(names[F.col("_c")].alias("c"), "u", "q")


def fence(q1: float, median: float, q3: float) -> dict[str, float]:
    return {"q1": q1, "median": median, "q3": q3, "low": q1 - 1.5 * (q3 - q1), "high": q3 + 1.5 * (q3 - q1)}


def fences(df: DataFrame, values: dict[str, Column]) -> dict[str, dict[str, float]]:
    """Quartiles and the 1.5 IQR fences of whole columns."""
    none = dict.fromkeys(("q1", "median", "q3", "low", "high"))
    return {n: none if q[0] is None else fence(*q) for n, q in quantile_row(df, values, [0.25, 0.5, 0.75]).items()}


def sample_skewness(c: Column) -> Column:
    """Skewness with the small-sample correction; null below three values or without spread."""
    n = F.count(c).cast("double")
    spread = F.stddev_pop(c)
    return F.when((n > 2) & (spread > 0), F.skewness(c) * F.sqrt(n * (n - 1)) / F.greatest(n - 2, F.lit(1.0)))


def correlation(a: Column, b: Column) -> Column:
    """Pearson's r over rows where both are present; null without spread."""
    both = a.isNotNull() & b.isNotNull()
    return correlation_complete(F.when(both, a), F.when(both, b))


def correlation_complete(x: Column, y: Column) -> Column:
    """Pearson's r of values that are null together. ``corr`` fails on a column without spread."""
    enough = (F.stddev_pop(x) > 0) & (F.stddev_pop(y) > 0)
    return F.when(enough, F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


_WIDE_PAIRS = 45  # more pairs than this and one long aggregate compiles badly


def correlation_pairs(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """(a, b, corr) for every pair of columns.

    A first pass takes the means, the second sums centred products of all
    pairs at once. Pairs of columns without nulls share their sums.
    """
    names = list(values)
    pairs = list(combinations(names, 2))
    if not pairs:
        return df.sparkSession.createDataFrame([], "a string, b string, corr double")
    held = df.select(*[v.cast("double").alias(n) for n, v in values.items()])
    if len(pairs) > _WIDE_PAIRS:
        cells = [F.struct(F.lit(i).alias("p"), ref(a).alias("x"), ref(b).alias("y")) for i, (a, b) in enumerate(pairs)]
        rows = held.select(F.inline(F.array(*cells))).where(F.col("x").isNotNull() & F.col("y").isNotNull())
        found = rows.groupBy("p").agg(correlation_complete(F.col("x"), F.col("y")).alias("corr"))
        labels = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs])
        return found.select(labels[F.col("p")].alias("l"), "corr").select("l.a", "l.b", "corr")
    first = held.agg(F.count("*"), *[F.avg(ref(n)) for n in names], *[F.count(ref(n)) for n in names]).first()
    total, means, counts = first[0], first[1:len(names) + 1], first[len(names) + 1:]
    mean = dict(zip(names, means))
    full = {n for n, k in zip(names, counts) if k == total}
    centred = held.select(*[(ref(n) - F.lit(mean[n] or 0.0)).alias(n) for n in names])
    sums: dict[str, Column] = {}

    def of(n: str, other: str, square: bool) -> str:
        key = ("q" if square else "s") + (n if n in full and other in full else f"{n}|{other}")
        c = ref(n) * ref(n) if square else ref(n)
        sums[key] = F.sum(c if n in full and other in full else F.when(ref(other).isNotNull(), c)).alias(key)
        return key

    cells = []
    for i, (a, b) in enumerate(pairs):
        sums[f"p{i}"], sums[f"n{i}"] = F.sum(ref(a) * ref(b)).alias(f"p{i}"), F.count(ref(a) * ref(b)).alias(f"n{i}")
        n = F.col(f"n{i}")
        sa, sb, qa, qb = (ref(of(*k)) for k in ((a, b, False), (b, a, False), (a, b, True), (b, a, True)))
        va, vb = qa - F.try_divide(sa * sa, n), qb - F.try_divide(sb * sb, n)
        spread = (va > 1e-20 * n * (mean[a] or 0.0) ** 2) & (vb > 1e-20 * n * (mean[b] or 0.0) ** 2)
        r = F.when(spread, F.try_divide(F.col(f"p{i}") - F.try_divide(sa * sb, n), F.sqrt(va) * F.sqrt(vb)))
        cells.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), r.alias("corr")))
    return centred.agg(*sums.values()).select(F.inline(F.array(*cells)))


def correlation_cells(df: DataFrame, values: dict[str, Column], digits: int = 2) -> DataFrame:
    """Every cell (x, y, value) of the correlation matrix; columns without spread are left out."""
    pairs = correlation_pairs(df, values)
    spread = df.select(*stacked({n: v.cast("double") for n, v in values.items()})).groupBy("c").agg(
        F.stddev_pop("v").alias("s"))
    diagonal = spread.where("s > 0").select(F.col("c").alias("x"), F.col("c").alias("y"), F.lit(1.0).alias("value"))
    both = pairs.select(F.explode(F.array(
        F.struct(F.col("a").alias("x"), F.col("b").alias("y"), F.col("corr").alias("value")),
        F.struct(F.col("b").alias("x"), F.col("a").alias("y"), F.col("corr").alias("value")),
    )).alias("cell")).select("cell.*")
    cells = diagonal.unionByName(both).where(F.col("value").isNotNull())
    return cells.select("x", "y", F.round("value", digits).alias("value"))


def bin_of(value: Column, low: float, high: float, bins: int) -> Column:
    """Equal-width bin number, right edge inside the last bin."""
    width = (high - low) / bins
    if width <= 0:
        # A single value sits in the middle of a unit range, as histograms do.
        low, width = low - 0.5, 1.0 / bins
    return F.least(F.floor((value - F.lit(low)) / F.lit(width)), F.lit(bins - 1)).cast("int")


def bin_edges(low: float, high: float, bins: int) -> tuple[float, float]:
    """(start, width) of the bins used by ``bin_of``."""
    width = (high - low) / bins
    return (low - 0.5, 1.0 / bins) if width <= 0 else (low, width)


def histogram(df: DataFrame, value: Column, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """(by..., bin, lower, upper, count); empty bins are kept for ungrouped histograms."""
    held = df.select(*[ref(b) for b in by], value.alias("_v")).where(F.col("_v").isNotNull())
    low, high = held.agg(F.min("_v"), F.max("_v")).first()
    if low is None:
        low, high = 0.0, 0.0
    start, width = bin_edges(low, high, bins)
    counted = held.withColumn("bin", bin_of(F.col("_v"), low, high, bins)).groupBy(
        *[ref(b) for b in by], "bin"
    ).agg(F.count("*").alias("count"))
    if not by:
        grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
        counted = grid.join(counted, "bin", "left").withColumn("count", F.coalesce("count", F.lit(0).cast("bigint")))
    return counted.select(
        *[ref(b) for b in by], "bin",
        (F.lit(start) + F.col("bin") * F.lit(width)).alias("lower"),
        (F.lit(start) + (F.col("bin") + 1) * F.lit(width)).alias("upper"),
        "count",
    )


def root_bins(n: int, low: int, high: int) -> int:
    return min(high, max(low, int(math.sqrt(n))))


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, count) of several columns with one shuffle; null is left out."""
    texts = df.select(*stacked({c: ref(c).cast("string") for c in columns}))
    return (
        texts.where(F.col("v").isNotNull())
        .groupBy(F.col("c").alias("column"), F.col("v").alias("value")).agg(F.count("*").alias("count"))
    )


def _families(df: DataFrame, columns: Sequence[str]) -> list[dict[str, Column]]:
    """Columns grouped so that each group shares one plain type to compare values in."""
    groups: dict[str, dict[str, Column]] = {}
    for c in columns:
        dtype = df.schema[c].dataType
        if is_fractional(dtype):
            groups.setdefault("double", {})[c] = ref(c).cast("double")
        elif isinstance(dtype, T.IntegralType):
            groups.setdefault("bigint", {})[c] = ref(c).cast("bigint")
        elif is_temporal(dtype):
            groups.setdefault("time", {})[c] = ref(c).cast("timestamp_ntz")
        else:
            groups.setdefault("string", {})[c] = ref(c).cast("string")
    return list(groups.values())


def _hashes(*values: Column) -> list[Column]:
    """A 128-bit hash as two numbers: what is shuffled in place of long values. Where a null stands is part of it."""
    marks = [v.isNull() for v in values]
    return [F.xxhash64(*values, *marks).alias("_h0"), F.xxhash64(F.lit("second"), *values, *marks).alias("_h1")]


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(c, u): number of distinct non-null values of each column; texts are told apart by a 128-bit hash."""
    parts = []
    for group in _families(df, columns):
        cells = df.select(*stacked(group)).where(F.col("v").isNotNull())
        if isinstance(cells.schema["v"].dataType, T.StringType):
            cells = cells.select("c", *_hashes(F.col("v")))
        parts.append(cells.distinct().groupBy("c").agg(F.count("*").alias("u")))
    return reduce(DataFrame.unionByName, parts)


def top_values(counts: DataFrame, k: int) -> DataFrame:
    """The ``k`` commonest values of every column, ties by value, with their rank.

    The rank filter is applied before the shuffle too (window group limit), so
    each task hands on at most ``k`` rows per column.
    """
    w = Window.partitionBy("column").orderBy(F.desc("count"), "value")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def mode_value(df: DataFrame, c: Column):
    """Most frequent value, ties to the smallest; None for an empty column."""
    row = (
        df.select(c.alias("v")).where(F.col("v").isNotNull())
        .groupBy("v").count().orderBy(F.desc("count"), "v").first()
    )
    return None if row is None else row["v"]


def aggregate(
    df: DataFrame, group_cols: Sequence[str], value: str | None = None, agg: str = "count",
    number: Column | None = None, out: str = "value", drop_null_groups: bool = False,
) -> DataFrame:
    """Reduce one value per group with mean, sum, count, median, min or max."""
    from grainfold.functions.columns import number_of

    keys = [ref(g).cast("string").alias(g) for g in group_cols]
    if value is None and number is None or agg == "count":
        held = df.select(*keys)
        if drop_null_groups:
            held = held.na.drop(subset=list(group_cols))
        return held.groupBy(*[ref(g) for g in group_cols]).agg(F.count("*").alias(out))
    number = number if number is not None else number_of(df, value)
    held = df.select(*keys, number.alias("_v")).where(F.col("_v").isNotNull())
    if drop_null_groups:
        held = held.na.drop(subset=list(group_cols))
    if agg == "median":
        q = quantiles(held, {"_q": F.col("_v")}, [0.5], by=list(group_cols))
        return q.select(*[ref(g) for g in group_cols], F.col("_q")[0].alias(out))
    reduce = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max}
    if agg not in reduce:
        raise ValueError(f"unknown aggregation '{agg}'")
    return held.groupBy(*[ref(g) for g in group_cols]).agg(reduce[agg]("_v").alias(out))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row: how many rows repeat an earlier one (null equals null); rows are told apart by a 128-bit hash."""
    return df.select(*_hashes(*[ref(c) for c in df.columns])).groupBy("_h0", "_h1").agg(F.count("*").alias("_n")).agg(
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("bigint").alias("duplicate_rows")
    )


def countable(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_atomic(f.dataType)]
