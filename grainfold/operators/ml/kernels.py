"""Kernel machines by explicit maps: random Fourier features before a linear solver."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEED = 42


@dataclass
class FourierMap:
    """Replaces ``features`` by cosines of random projections, whose inner products estimate exp(-gamma * squared distance).

    ``size`` features bound the memory of the solver, whatever the rows; the error of an inner product falls with its square root.
    """

    width: int
    gamma: float
    size: int = 300
    seed: int = SEED

    def transform(self, df: DataFrame) -> DataFrame:
        rng = np.random.default_rng(self.seed)
        turn = rng.normal(0.0, np.sqrt(2 * self.gamma), (self.width, self.size))
        shift, scale = rng.uniform(0, 2 * np.pi, self.size), np.sqrt(2 / self.size)

        @F.pandas_udf("array<double>")
        def waves(v: pd.Series) -> pd.Series:
            if not len(v):
                return pd.Series([], dtype=object)
            return pd.Series(list(scale * np.cos(np.vstack(v.to_numpy()) @ turn + shift)))

        return df.withColumn("features", array_to_vector(waves(vector_to_array("features"))))


@dataclass
class Mapped:
    """A linear model behind a map of the features; rows keep their own features."""

    through: FourierMap
    model: object

    def transform(self, df: DataFrame) -> DataFrame:
        held = df.withColumn("_own", F.col("features"))
        out = self.model.transform(self.through.transform(held))
        return out.drop("features").withColumnRenamed("_own", "features")


@dataclass
class KernelMachine:
    """A linear estimator on random Fourier features; ``gamma`` is one over (features times their variance) where none is given."""

    linear: object
    gamma: float | None = None
    size: int = 300

    def fit(self, df: DataFrame) -> Mapped:
        cells = df.select(vector_to_array("features").alias("v"))
        width, mean, square = cells.select(
            F.size("v").alias("n"), F.aggregate("v", F.lit(0.0), lambda a, x: a + x).alias("s"),
            F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x).alias("q"),
        ).agg(F.max("n"), F.sum("s") / F.sum("n"), F.sum("q") / F.sum("n")).first()
        spread = square - mean * mean
        through = FourierMap(width, self.gamma or 1.0 / (width * spread if spread > 0 else 1.0), self.size)
        return Mapped(through, self.linear.fit(through.transform(df)))
