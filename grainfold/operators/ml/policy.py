"""Policy tables: states from features, reward shares per action, the greedy policy and its value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainfold.functions import columns as fc
from grainfold.functions.columns import ref
from grainfold.operators import stats


def states(df: DataFrame, numeric: list[str], categorical: list[str], n_bins: int = 5) -> DataFrame:
    """Adds ``state``: quantile bin of every numeric feature, value of every category; -1 and empty for null."""
    parts: list[Column] = []
    if numeric:
        values = {c: fc.number_of(df, c) for c in numeric}
        cuts = stats.quantile_row(df, values, [i / n_bins for i in range(n_bins + 1)])
        for c in numeric:
            # Equal edges are merged; a value on an edge belongs to the lower bin.
            edges = sorted({e for e in cuts[c][1:-1] if e is not None and cuts[c][0] < e < cuts[c][-1]})
            code = sum((F.when(values[c] > e, 1).otherwise(0) for e in edges), F.lit(0))
            parts.append(F.when(values[c].isNull(), -1).otherwise(code).cast("string"))
    parts += [F.coalesce(ref(c).cast("string"), F.lit("")) for c in categorical]
    return df.withColumn("state", F.concat_ws("|", *parts))


def rewards(df: DataFrame, action: str) -> DataFrame:
    """(state, action, n, share): share of each action among the rows of its state."""
    counts = df.where(ref(action).isNotNull()).groupBy("state", ref(action).cast("string").alias("action")).agg(F.count("*").alias("n"))
    totals = counts.groupBy("state").agg(F.sum("n").alias("_t"))
    return counts.join(totals, "state").select("state", "action", "n", (F.col("n") / F.col("_t")).alias("share"))


def greedy(table: DataFrame, gamma: float = 0.9) -> DataFrame:
    """(state, action, rows, value): best action, ties by name; value = share / (1 - gamma), the limit of the backups."""
    return table.groupBy("state").agg(
        F.min_by("action", F.struct(-F.col("share"), F.col("action"))).alias("action"), F.sum("n").alias("rows"),
        (F.max("share") / (1 - gamma)).alias("value"))


def evaluate(holdout: DataFrame, action: str, policy: DataFrame) -> DataFrame:
    """One row: hold-out rows, share of states known, and accuracy; unknown states count as wrong."""
    chosen = policy.select("state", F.col("action").alias("_chosen"))
    both = holdout.where(ref(action).isNotNull()).join(chosen, "state", "left")
    return both.agg(
        F.count("*").alias("rows"), F.avg(F.col("_chosen").isNotNull().cast("double")).alias("known"),
        F.avg(F.coalesce((F.col("_chosen") == ref(action).cast("string")).cast("double"), F.lit(0.0))).alias("accuracy"))


def action_counts(policy: DataFrame) -> DataFrame:
    return policy.groupBy("action").agg(F.count("*").alias("states"), F.sum("rows").alias("rows"))


def busiest(policy: DataFrame, k: int = 6) -> DataFrame:
    return policy.orderBy(F.desc("rows"), "state").limit(k)
