"""Small relational operators: projections, filters, splits, samples, lookups, group tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainfold.functions import columns as fc
from grainfold.functions.columns import ref
from grainfold.operators import ordering, stats


def need(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {', '.join(missing)}")


def select_once(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The named columns in order, each once."""
    need(df, *names)
    return df.select(*[ref(n) for n in dict.fromkeys(names)])


def drop(df: DataFrame, name: str) -> DataFrame:
    need(df, name)
    return df.drop(name)


def rename(df: DataFrame, name: str, new: str) -> DataFrame:
    need(df, name)
    if not new.strip():
        raise ValueError("the new name is blank")
    return df.withColumnRenamed(name, new.strip())


def within(df: DataFrame, name: str, low: float, high: float) -> DataFrame:
    """Rows whose value is missing or inside [low, high]."""
    return df.where(ref(name).isNull() | ref(name).between(low, high))


def keep_top_categories(df: DataFrame, name: str, k: int) -> DataFrame:
    """Rows of the ``k`` commonest categories (ties by name)."""
    top = (
        df.where(ref(name).isNotNull()).groupBy(ref(name).alias("_top")).count()
        .orderBy(F.desc("count"), "_top").limit(k)
    )
    return df.join(F.broadcast(top), ref(name) == F.col("_top"), "left_semi")  # k rows


def split_labelled(df: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    """(labelled, unlabelled): the target is present and not blank, or else."""
    has = ref(target).isNotNull() & (fc.strip(ref(target).cast("string")) != "")
    return df.where(has), df.where(~has)


def frequency_encode(df: DataFrame, name: str) -> DataFrame:
    """Share of each row's category among the non-null rows, as ``<name>_freq``."""
    counts = df.where(ref(name).isNotNull()).groupBy(ref(name).alias("_k")).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n")).first()[0] or 1
    out = df.join(counts, ref(name) == F.col("_k"), "left")
    return out.withColumn(f"{name}_freq", F.col("_n") / F.lit(total)).drop("_k", "_n")


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n) over rows where both are present."""
    return (
        df.select(ref(a).cast("string").alias("a"), ref(b).cast("string").alias("b")).na.drop()
        .groupBy("a", "b").agg(F.count("*").alias("n"))
    )


def purity(table: DataFrame) -> float:
    """Share of rows that the commonest ``b`` of each ``a`` accounts for."""
    row = table.groupBy("a").agg(F.max("n").alias("m"), F.sum("n").alias("t")).agg(F.sum("m"), F.sum("t")).first()
    return row[0] / row[1] if row[1] else 0.0


def by_month(df: DataFrame, date: str, value: str, agg: str, fill_gaps: bool = False) -> DataFrame:
    """(period, value) per calendar month; ``fill_gaps`` adds months without rows."""
    held = df.select(F.date_trunc("month", fc.date_of(df, date)).alias("m"), fc.number_of(df, value).alias("v")).na.drop()
    if agg == "median":
        q = stats.quantiles(held, {"q": F.col("v")}, [0.5], by=["m"])
        months = q.select("m", F.col("q")[0].alias("value"))
    else:
        reduce = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "count": F.count}[agg]
        months = held.groupBy("m").agg(reduce("v").alias("value"))
    if fill_gaps and agg in ("sum", "count"):
        span = months.agg(F.min("m").alias("a"), F.max("m").alias("b")).where("a IS NOT NULL")
        every = span.select(F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 MONTH"))).alias("m"))
        months = every.join(months, "m", "left").withColumn("value", F.coalesce("value", F.lit(0)))
    return months.select(fc.month_label(F.col("m")).alias("period"), "value")


def rollup_path(df: DataFrame, path: Sequence[str], total: Column, out: str) -> DataFrame:
    """Totals of every prefix of a path of columns, with its depth."""
    n = len(path)
    bits = F.grouping_id(*[ref(p) for p in path])
    rolled = df.rollup(*[ref(p) for p in path]).agg(total.alias(out), bits.cast("bigint").alias("_g"))
    depth = F.lit(0)
    for d in range(1, n + 1):
        depth = F.when(F.col("_g") == (1 << (n - d)) - 1, d).otherwise(depth)
    return rolled.withColumn("depth", depth).where("depth > 0").drop("_g")


def time_split(df: DataFrame, order_by: Sequence[str], share: float) -> DataFrame:
    """Marks the first ``share`` of the rows in order as training rows."""
    indexed = ordering.add_position(df, order_by, "_i")
    cut = int(share * indexed.count())
    return indexed.withColumn("is_train", F.col("_i") < cut).drop("_i")


def even_sample(df: DataFrame, order_by: Sequence[str], cap: int) -> DataFrame:
    """At most ``cap`` rows, evenly spaced in the sorted table, with their position."""
    indexed = ordering.add_position(df, order_by)
    n = indexed.count()
    if n <= cap:
        return indexed
    # Row p is taken when p = floor(i (n-1) / (cap-1)) for a whole i.
    step = (n - 1) / (cap - 1)
    i = F.ceil(F.col("position") / F.lit(step))
    return indexed.where(F.floor(i * F.lit(n - 1) / F.lit(cap - 1)) == F.col("position"))


def stable_sample(df: DataFrame, key: Sequence[str], n: int) -> DataFrame:
    """``n`` rows in hash order of the key: random-looking, the same on every run."""
    return df.orderBy(fc.stable_order(*[ref(k) for k in key]), *[ref(k) for k in key]).limit(n)


def page(df: DataFrame, name: str, text: str, order: Sequence[Column], page: int, size: int) -> DataFrame:
    """One page of the rows whose column contains a text, in the given order."""
    found = df.where(F.contains(F.lower(ref(name).cast("string")), F.lit(text.lower())))
    return found.orderBy(*order).offset(page * size).limit(size)
