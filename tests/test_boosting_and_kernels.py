import math

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from grainfold.operators.ml import models
from grainfold.operators.ml.boosting import AdaBoostR2, MedianVotes
from grainfold.operators.ml.kernels import FourierMap


@pytest.fixture(scope="module")
def parts(spark, folder):
    part = spark.read.parquet(f"{folder}/part.parquet").where("p_retailprice IS NOT NULL")
    return part.select("p_partkey", array_to_vector(F.array(F.col("p_size").cast("double"), F.pmod("p_partkey", F.lit(10)).cast("double"))).alias("features"),
                       (F.col("p_retailprice") + F.col("p_size") * F.col("p_size")).cast("double").alias("label")).persist()


def weighted_median(values, weights):
    seen = 0.0
    for v, w in sorted(zip(values, weights)):
        seen += w
        if seen >= sum(weights) / 2 * (1 - 1e-12):
            return v


def test_weighted_median_is_the_literal_one(parts):
    fitted = AdaBoostR2(rounds=6, depth=2).fit(parts)
    assert len(fitted.members) > 1
    single = [{r.p_partkey: r.prediction for r in m.transform(parts).collect()} for m in fitted.members]
    out = fitted.transform(parts)
    assert set(out.columns) == {*parts.columns, "prediction"}
    for r in out.collect():
        assert r.prediction == weighted_median([s[r.p_partkey] for s in single], fitted.weights)


@pytest.mark.parametrize("power", [1, 2])
def test_weights_of_the_members_follow_the_losses(parts, power):
    fitted = AdaBoostR2(rounds=4, depth=2, power=power).fit(parts)
    rows = sorted(parts.collect(), key=lambda r: r.p_partkey)
    weight = np.ones(len(rows))
    for member, stated in zip(fitted.members, fitted.weights):
        said = {r.p_partkey: r.prediction for r in member.transform(parts).collect()}
        off = np.array([abs(said[r.p_partkey] - r.label) for r in rows])
        loss = (off / off.max()) ** power
        mean = (weight * loss).sum() / weight.sum()
        assert stated == pytest.approx(math.log((1 - mean) / mean), rel=1e-6)
        weight = weight * (mean / (1 - mean)) ** (1 - loss)


def test_no_error_ends_the_rounds_and_equal_predictions_add_up(spark, parts):
    flat = parts.withColumn("label", F.lit(3.0))
    fitted = AdaBoostR2(rounds=5).fit(flat)
    assert len(fitted.members) == 1 and {r.prediction for r in fitted.transform(flat).collect()} == {3.0}
    twice = MedianVotes(fitted.members * 2, [1.0, 5.0])
    assert {r.prediction for r in twice.transform(flat).collect()} == {3.0}


def test_inner_products_estimate_the_kernel(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 3))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, v array<double>").select("id", array_to_vector("v").alias("features"))
    rows = {r.id: r.features.toArray() for r in FourierMap(3, 0.5, 4000).transform(df).collect()}
    z = np.vstack([rows[i] for i in range(len(x))])
    exact = np.exp(-0.5 * ((x[:, None] - x[None]) ** 2).sum(axis=2))
    assert np.abs(z @ z.T - exact).max() < 0.1
    assert FourierMap(3, 0.5, 10).transform(df.where("id < 0")).count() == 0


def test_kernel_machine_separates_rings(spark):
    rng = np.random.default_rng(2)
    angle, outer = rng.uniform(0, 2 * np.pi, 600), np.arange(600) % 2
    radius = 1 + 2 * outer + rng.normal(0, 0.15, 600)
    rows = [(int(o), [float(r * np.cos(a)), float(r * np.sin(a))]) for o, r, a in zip(outer, radius, angle)]
    df = spark.createDataFrame(rows, "label int, v array<double>").select(F.col("label").cast("double"), array_to_vector("v").alias("features"))
    right = {}
    for key in ("svm_clf", "svm_rbf_clf"):
        out = models.build(key, 600, 2).fit(df).transform(df)
        assert out.select("features").first().features.size == 2
        right[key] = out.where("prediction = label").count() / 600
    assert right["svm_rbf_clf"] > 0.97 and right["svm_clf"] < 0.75
