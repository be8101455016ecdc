"""Boosted regression with loss weights and a weighted median (AdaBoost.R2)."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml import regression as R
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainfold.session import cut_lineage

SEED = 42


@dataclass
class MedianVotes:
    """The weighted median of the predictions of several models.

    It is the least prediction at which the weights of all predictions up to it make
    half of the total; equal predictions add up.
    """

    members: list
    weights: list[float]

    def transform(self, df: DataFrame) -> DataFrame:
        out = df
        for i, m in enumerate(self.members):
            out = m.transform(out).withColumnRenamed("prediction", f"_p{i}")
        votes = F.array_sort(F.array(*[F.struct(F.col(f"_p{i}").alias("p"), F.lit(w).alias("w")) for i, w in enumerate(self.weights)]))
        half = sum(self.weights) / 2
        start = F.struct(F.lit(0.0).alias("seen"), F.lit(None).cast("double").alias("p"))
        step = lambda at, vote: F.struct(
            (at["seen"] + vote["w"]).alias("seen"),
            F.when(at["p"].isNull() & (at["seen"] + vote["w"] >= half * (1 - 1e-12)), vote["p"]).otherwise(at["p"]).alias("p"))
        return out.withColumn("prediction", F.aggregate(votes, start, step)["p"]).drop(*[f"_p{i}" for i in range(len(self.members))])


@dataclass
class AdaBoostR2:
    """Trees fitted in turn; a row's weight falls the more, the smaller its loss is beside the largest one.

    ``power`` 1 takes the share of the largest error as the loss, 2 its square. The rounds end
    when a tree has no error, or when the weighted mean of its losses reaches one half. A round is one fit and one
    aggregate over the weighted rows; the rows are written to the shared folder every fifth round.
    """

    rounds: int = 50
    depth: int = 3
    rate: float = 1.0
    power: int = 1

    def fit(self, df: DataFrame) -> MedianVotes:
        work = cut_lineage(df.select("features", "label").withColumn("w", F.lit(1.0)))
        members, weights = [], []
        for i in range(self.rounds):
            tree = R.DecisionTreeRegressor(featuresCol="features", labelCol="label", weightCol="w", maxDepth=self.depth, seed=SEED).fit(work)
            off = tree.transform(work).select("features", "label", "w", F.abs(F.col("prediction") - F.col("label")).alias("off"))
            worst, lost, total = off.agg(F.max("off"), F.sum(F.col("w") * F.pow("off", F.lit(self.power))), F.sum("w")).first()
            if not worst:  # no error at all
                members, weights = [*members, tree], [*weights, 1.0]
                break
            mean = lost / worst**self.power / total
            if mean >= 0.5:
                if not members:
                    members, weights = [tree], [1.0]
                break
            beta = mean / (1 - mean)
            members.append(tree)
            weights.append(self.rate * math.log(1 / beta))
            loss = F.pow(F.col("off") / worst, F.lit(self.power))
            work = off.select("features", "label", (F.col("w") / total * F.pow(F.lit(beta), (1 - loss) * self.rate)).alias("w"))
            if i % 5 == 4:
                work = cut_lineage(work)
        return MedianVotes(members, weights)
