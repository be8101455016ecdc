"""Time series baselines on an 80/20 split in time: last value and linear trend."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainfold.functions import columns as fc
from grainfold.functions.columns import ref
from grainfold.operators import ordering
from grainfold.operators.ml import metrics
from grainfold.operators.profile import Profile

MIN_POINTS = 30


def time_column(profile: Profile) -> DataFrame:
    """The first date column of a table."""
    return profile.dates().orderBy("position").limit(1).select("column")


def baselines(df: DataFrame, target: str, time: str, tie: list[str] | None = None, share: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(board, forecast). Rows are numbered in time order without gathering them in one task."""
    held = df.select(fc.date_of(df, time).alias("_t"), fc.number_of(df, target).alias("y"), *[ref(c) for c in tie or []]).na.drop(subset=["_t", "y"])
    rows = ordering.add_position(held, ["_t", *(tie or [])], "i")
    n = rows.count()
    if n < MIN_POINTS:
        raise ValueError(f"need at least {MIN_POINTS} ordered points")
    cut = int(n * share)
    first, last = rows.where(F.col("i") < cut), rows.where(F.col("i") >= cut)
    fit = first.agg(F.try_divide(F.covar_pop("i", "y"), F.var_pop("i")), F.avg("i"), F.avg("y"), F.max_by("y", "i")).first()
    slope, mi, my, recent = fit
    forecast = last.select("i", F.col("y").alias("label"), F.lit(recent).alias("last_value"),
                           (F.lit(my) + F.lit(slope) * (F.col("i") - F.lit(mi))).alias("linear_trend"))
    board = None
    for model in ("last_value", "linear_trend"):
        m = metrics.regression(forecast, "label", model).select(F.lit(model).alias("model"), "r2", "rmse", "mae", (F.col("mape") * 100).alias("mape"))
        board = m if board is None else board.unionByName(m)
    return board, forecast
