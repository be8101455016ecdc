"""Profile values by hand, quantiles by both ways, order operators against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from grainfold.functions.columns import ref
from grainfold.operators import analyst, charts, eda, frames, ordering, rules, stats
from grainfold.operators.profile import Profile


@pytest.fixture(scope="module")
def frame(spark):
    revenue = [100.0, 110.0, 95.0, None, 105.0, 98.0, 102.0, 99.0, 101.0, 100000.0]
    rows = [(i, "NSEW"[i % 4], revenue[i], i % 2) for i in range(10)]
    return spark.createDataFrame(rows, "id int, region string, revenue double, churn int")


def test_profile(frame):
    report = Profile(frame).report()
    by_name = {c["name"]: c for c in report["columns"]}
    assert report["dataset_summary"]["rows"] == 10
    assert by_name["revenue"]["missing_pct"] == 10.0 and by_name["revenue"]["outliers"] == 1
    assert by_name["id"]["is_probable_id"] and report["probable_primary_keys"] == ["id"]
    assert by_name["region"]["semantic_type"] == "categorical"
    assert 0 <= report["quality"]["score"] <= 100
    assert report["missing_report"] == [{"column": "revenue", "missing": 1, "missing_pct": 10.0}]
    assert any(t["column"] == "churn" for t in report["target_suggestions"])


def test_profile_of_odd_columns(spark):
    df = spark.createDataFrame([(None, float("nan"), True, ["x"], "2023-01-01"), (None, 2.0, False, ["y"], "Jan 2, 2023")],
                               "n string, d double, b boolean, l array<string>, t string")
    p = Profile(df)
    assert p.semantic_types == {"n": "text", "d": "numeric", "b": "boolean", "l": "text", "t": "datetime"}
    rows = {r["name"]: r for r in p.rows}
    assert rows["n"]["missing"] == 2 and rows["d"]["missing"] == 1 and rows["d"]["mean"] == 2.0
    assert p.quality().first()["grade"] in "ABCDF"


def test_quantiles_agree(spark):
    random.seed(3)
    # One group and one value hold a third of all rows.
    rows = [("hot" if i % 3 == 0 else f"g{i % 4}", 7.0 if i % 3 == 1 else random.gauss(0, 50)) for i in range(3000)]
    rows += [("hot", None), ("empty", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = [0.0, 0.05, 0.5, 0.9, 1.0]
    want = {g: np.quantile([v for k, v in rows if k == g and v is not None], probs) for g in {k for k, v in rows if v is not None}}
    for limit in (10 ** 6, 0):
        got = {r["g"]: r["v"] for r in stats.quantiles(df, {"v": ref("v")}, probs, ["g"], distinct_limit=limit, bins=16).collect()}
        for g, q in want.items():
            assert np.allclose(got[g], q)


def test_ranked_quantiles_leave_no_column_to_one_task(spark, monkeypatch):
    random.seed(4)
    rows = [("hot" if i % 3 else f"g{i % 50}", random.choice([random.gauss(0, 9), float(i % 5), float("nan"), None])) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    plan = stats.quantiles(df, {"v": ref("v")}, probs, distinct_limit=0)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan  # else all values of a column meet at one key
    want = {by: stats.quantiles(df, {"v": ref("v")}, probs, by).orderBy(*(by or ("v",))).collect() for by in ((), ("g",))}
    for few in (2000, 0):  # the second time rows and groups meet by group and salt
        monkeypatch.setattr(stats, "_FEW_GROUPS", few)
        for by, rows in want.items():
            got = stats.quantiles(df, {"v": ref("v")}, probs, by, distinct_limit=0, bins=8).orderBy(*(by or ("v",))).collect()
            assert [r[:-1] for r in got] == [r[:-1] for r in rows] and np.allclose([r["v"] for r in got], [r["v"] for r in rows], equal_nan=True)


def test_many_distinct_values_meet_in_no_map_of_one_task(spark):
    df = spark.range(150_000).select((F.col("id") * 7 % 150_001).cast("double").alias("v"))
    found = stats.quantiles(df, {"v": ref("v")}, [0.25, 0.5])
    assert " percentile(" not in found._jdf.queryExecution().optimizedPlan().toString()
    want = np.quantile([i * 7 % 150_001 for i in range(150_000)], [0.25, 0.5])
    assert np.allclose(found.first()["v"], want)
    row = Profile(df).rows[0]
    assert row["unique"] == 150_000 and [row["q1"], row["median"]] == list(want)


def test_correlations(spark):
    random.seed(5)
    rows = [(float(i), random.random(), None if i % 4 == 0 else float(i * 2 + random.random()), 3.5) for i in range(200)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    got = {(r["a"], r["b"]): r["corr"] for r in stats.correlation_pairs(df, {c: ref(c) for c in "abcd"}).collect()}
    full = [(r[0], r[2]) for r in rows if r[2] is not None]
    assert abs(got[("a", "c")] - np.corrcoef(*zip(*full))[0, 1]) < 1e-12
    assert abs(got[("a", "b")] - np.corrcoef([r[0] for r in rows], [r[1] for r in rows])[0, 1]) < 1e-12
    assert got[("a", "d")] is None
    many = {f"x{i}": ref("a") * i + ref("b") for i in range(11)}  # above the one-aggregate limit
    wide = {(r["a"], r["b"]): r["corr"] for r in stats.correlation_pairs(df, many).collect()}
    assert len(wide) == 55 and wide[("x1", "x2")] > 0.99


def test_histogram_edges(spark):
    df = spark.createDataFrame([(float(v),) for v in [0, 1, 2, 3, 4, 10]], "v double")
    assert [r["count"] for r in stats.histogram(df, ref("v"), 5).orderBy("bin").collect()] == [2, 2, 1, 0, 1]
    same = spark.createDataFrame([(4.0,), (4.0,)], "v double")
    assert sum(r["count"] for r in stats.histogram(same, ref("v"), 4).collect()) == 2


def test_positions_and_running_totals_with_ties(spark):
    rows = [(i, 5 if i % 3 == 0 else i) for i in range(600)]
    df = spark.createDataFrame(rows, "id int, k int")
    got = sorted((r["position"], r["k"]) for r in ordering.add_position(df, ["k"]).collect())
    assert [p for p, _ in got] == list(range(600))
    assert [k for _, k in got] == sorted(k for _, k in rows)
    run = ordering.add_running(df, ["k", "id"], {"t": F.lit(1)}).collect()
    assert sorted(r["t"] for r in run) == list(range(1, 601))


@pytest.mark.parametrize("backward", [False, True])
@pytest.mark.parametrize("include", [True, False])
def test_carry_over_part_borders(spark, backward, include):
    random.seed(7)
    rows = [("hot" if i % 3 == 0 else f"k{i % 5}", i, None if random.random() < 0.7 else i) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, i int, v int").repartition(3)
    want, last = {}, {}
    for k, i, v in sorted(rows, key=lambda r: -r[1] if backward else r[1]):
        if not include:
            want[i] = last.get(k)
        last[k] = v if v is not None else last.get(k)
        if include:
            want[i] = last[k]
    got = {r["i"]: r["v"] for r in ordering.carry(df, ["v"], ["i"], ["k"], backward, include).collect()}
    assert got == want


def test_even_sample_matches_linspace(spark):
    df = spark.range(1000).withColumnRenamed("id", "i")
    got = sorted(r["i"] for r in frames.even_sample(df, ["i"], 60).collect())
    assert got == list(np.linspace(0, 999, 60).astype(int))


def test_rules_and_answers(spark):
    rows = [(i % 8, "ab"[i % 2] if i % 10 else None, float(i % 4), 1000.0 if i % 15 == 0 else float(i % 6)) for i in range(120)]
    df = spark.createDataFrame(rows, "customer_type int, churn string, x double, total double")
    p = Profile(df)
    found = {(r["kind"], r["rank"]): r for r in rules.signals(p).collect()}
    assert ("quality", 1) in found and ("missing", 1) in found and ("outliers", 1) in found
    first = rules.objectives(p).orderBy("rank").first()
    assert first["target"] == "churn" and first["title"] == "Predict Customer Churn" and first["recommended"]
    assert rules.narrative(p).first()["target"] == "churn"
    assert analyst.default_columns(p).first()["metric"] == "total"
    assert "small dataset" in rules.readiness(p).first()["issues"]
    assert analyst.trend(df.withColumn("d", F.lit("2024-01-05")), "d", "total").count() == 1


def test_trend_fills_empty_months(spark):
    df = spark.createDataFrame([("2024-01-05", 10.0), ("2024-04-02", 30.0)], "d string, v double")
    rows = analyst.trend(df, "d", "v").orderBy("period").collect()
    assert [(r["period"], r["value"]) for r in rows] == [("2024-01", 10.0), ("2024-02", 0.0), ("2024-03", 0.0), ("2024-04", 30.0)]
    assert rows[0]["change_pct"] == 200.0 and rows[0]["trend"] == "upward"


def test_chart_pieces(spark):
    df = spark.createDataFrame([(float(i), float(2 * i * i - i + 3)) for i in range(50)], "x double, y double")
    fit = {r["power"]: r["coefficient"] for r in charts.polynomial_fit(df, "x", "y", 2).collect()}
    assert np.allclose([fit[0], fit[1], fit[2]], [3, -1, 2], atol=1e-6)
    curve = charts.kde(df, "x").orderBy("x").collect()
    area = sum((b["x"] - a["x"]) * (a["density"] + b["density"]) / 2 for a, b in zip(curve, curve[1:]))
    assert abs(area - 1) < 0.01
    with pytest.raises(charts.ChartError):
        charts.build(df, "nope")
    assert [s["chart"] for s in eda.plan(df)][:3] == ["heatmap", "histogram", "box"]
