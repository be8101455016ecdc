"""Training, leakage, neighbours, clusters and label spreading on small tables with known structure."""

import random

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from grainfold.operators.ml import cluster, discovery, graph, metrics, models, neighbors, policy, prep, semi
from grainfold.operators.ml import train as tr
from grainfold.operators.profile import Profile


@pytest.fixture(scope="module")
def churn(spark):
    random.seed(1)
    rows = []
    for i in range(240):
        tenure, charge = random.randint(1, 71), round(random.uniform(20, 120), 2)
        contract = random.choice(["Month", "Year", "Two"])
        rows.append((f"c{i}", tenure, charge, contract, int(tenure < 24 and contract == "Month") if i % 40 else None))
    df = spark.createDataFrame(rows, "customer_id string, tenure int, monthly_charges double, contract string, churn int")
    return df.withColumns({"churn_flag": F.col("churn").cast("string"), "annual_value": F.col("tenure") * F.col("monthly_charges")}).persist()


def test_plan_drops_ids_and_leaks(churn):
    plan = prep.make_plan(churn, "churn")
    assert plan.task == "classification" and plan.classes == ["0", "1"]
    assert [r["feature"] for r in plan.removed] == ["churn_flag"]
    assert set(plan.features) == {"tenure", "monthly_charges", "contract", "annual_value"}
    with pytest.raises(prep.TrainingError):
        prep.make_plan(churn, "nope")


def test_training_beats_the_majority_and_scores(churn, tmp_path):
    base = churn.drop("churn_flag")
    plan = prep.make_plan(base, "churn")
    run = tr.train(base, plan, ["customer_id"], ["decision_tree_clf", "knn_clf"], cv_folds=2, cv_top=1)
    assert run.entries[0]["model"] == "decision_tree_clf" and run.entries[0]["test_score"] > 0.9
    assert run.board.where("rank = 1").first()["cv_mean"] > 0.8
    important = [r["feature"] for r in tr.permutation_importance(run, repeats=2).collect()]
    assert set(important[:2]) == {"tenure", "contract"}
    schema = prep.input_schema(base, plan.numeric, plan.categorical)
    blank = base.limit(5).withColumn("tenure", F.lit(None).cast("int")).withColumn("contract", F.lit(""))
    scored = tr.score(run.best, run.data.pipeline, plan, blank, ["customer_id"], schema).collect()
    assert all(abs(sum(r["probabilities"].values()) - 1) < 0.05 and r["confidence"] >= 0.5 for r in scored)
    tr.save(run.best, run.data.pipeline, str(tmp_path / "m"))
    again = tr.load(str(tmp_path / "m")).transform(prep.typed(base, plan, ["customer_id"]))
    assert again.where("prediction = label").count() > 200


@pytest.mark.parametrize("balance", ["undersample", "weights", "smote"])
def test_balance(churn, balance):
    base = churn.drop("churn_flag")
    run = tr.train(base, prep.make_plan(base, "churn"), ["customer_id"], ["decision_tree_clf"], balance=balance, cv_folds=0)
    assert run.entries[0]["test_score"] > 0.7


def test_ordinal_preparation_and_unknown_values(churn):
    base = churn.drop("churn_flag")
    plan = prep.make_plan(base, "churn", encoding="ordinal", scaling="robust")
    data = prep.typed(base, plan, ["customer_id"])
    fitted = prep.preprocessor(data, plan).fit(data)
    i = plan.categorical.index("contract")
    odd = fitted.transform(data.withColumn(f"c{i}", F.lit("Never seen"))).select("features").first()[0]
    assert odd[len(plan.numeric) + i] == -1


def test_target_leaks(churn):
    pairs = discovery.pair_leaks(churn, "annual_value", ["tenure", "monthly_charges"]).where("verdict = 'leak'").collect()
    assert [p["driver"] for p in pairs] == ["tenure × monthly_charges"]
    assert discovery.leak_driver(churn, "annual_value", "regression", ["tenure", "monthly_charges"], [])[0]
    names = [r["target"] for r in discovery.viable_targets(Profile(churn)).collect()]
    assert "customer_id" not in names and "churn" in names


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(2)
    centres = [(0, 0), (10, 0), (0, 10)]
    rows = []
    for i in range(400):
        c = 0 if i % 3 == 0 else i % 3  # ids are spread over the groups
        rows.append((i, [float(v) for v in rng.normal(centres[c], 0.6)], c))
    rows += [(900, [50.0, 50.0], -1), (901, [-40.0, 3.0], -1)]
    return spark.createDataFrame(rows, "id bigint, v array<double>, c int").persist()


BLOCKS = {"broadcast_points": 0, "block": 50, "pivots": 6}


def test_neighbours_by_blocks_and_broadcast(blobs):
    rows = {r["id"]: np.array(r["v"]) for r in blobs.collect()}
    for settings in ({}, BLOCKS):
        near = neighbors.nearest(blobs.select("id", "v"), blobs.select("id", "v"), 4, True, **settings).collect()
        got = {}
        for r in sorted(near, key=lambda r: r["rank"]):
            got.setdefault(r["id"], []).append(r["other"])
        for i, v in rows.items():
            want = sorted((round(float(np.linalg.norm(v - w)), 9), j) for j, w in rows.items() if j != i)[:4]
            assert got[i] == [j for _, j in want]


def test_a_row_goes_to_few_tasks_however_small_the_blocks(blobs):
    rows = blobs.select("id", "v")

    def kernel(a, b):
        assert len(a) <= 2 and len(b) <= 2
        return a[["id"]]

    seen = neighbors.block_join(rows, rows, kernel, "id bigint", reach=1e9, broadcast_points=0, block=2, pivots=6, fold=lambda x: x.drop_duplicates())
    n = rows.count()
    assert n <= seen.count() <= 2 * neighbors.GROUPS * n  # pairs of blocks were n / 2 for every row


def test_box_search_is_brute_force(monkeypatch):
    monkeypatch.setattr(neighbors, "LEAF", 4)
    random = np.random.default_rng(1)
    a, b = random.integers(0, 4, (30, 2)).astype(float), random.integers(0, 4, (50, 2)).astype(float)
    b[7], ids = np.nan, np.arange(50)
    for own in (None, np.arange(30)):
        found = {}
        for i, j, d in zip(*neighbors._search(a, b, 6, own, ids)):
            found.setdefault(int(i), []).append((round(float(d), 9), int(j)))
        for i in range(30):
            near = sorted((round(float(np.linalg.norm(a[i] - b[j])), 9), j) for j in range(50) if j != 7 and not (own is not None and i == j))
            assert sorted(found[i]) == near[:6]


def test_density_clusters(blobs):
    for settings in ({}, BLOCKS):
        got = {r["id"]: r["cluster"] for r in graph.dbscan(blobs.select("id", "v"), 1.5, 5, **settings).collect()}
        assert got[900] == got[901] == -1
        assert len({got[i] for i in range(400)} - {-1}) == 3
        found = {}
        for r in blobs.where("c >= 0").collect():
            found.setdefault(r["c"], set()).add(got[r["id"]])
        assert all(len(labels - {-1}) == 1 for labels in found.values())


def test_dense_cells_are_not_compared(spark, monkeypatch):
    random.seed(8)
    rows = [(i, [random.gauss(0, 0.3), random.gauss(i % 3 * 4.0, 0.3)]) for i in range(900)] + [(900 + i, [random.uniform(-3, 3), random.uniform(-3, 11)]) for i in range(60)]
    rows += [(7, [0.0, 8.0]), (2000, [float("nan"), 0.0]), (None, [0.0, 0.0])]  # an id in two groups, a point nowhere, no id
    df = spark.createDataFrame(rows, "id bigint, v array<double>")
    v, ids = np.array([r[1] for r in rows]), np.array([-1 if r[0] is None else r[0] for r in rows])
    near = neighbors.distances(v, v) <= 0.5
    core = np.isin(ids, [i for i in set(ids) - {-1} if near[ids == i].sum() >= 5])
    label = ids.copy()
    for _ in range(len(rows)):  # the least id in reach over core points, and over rows of one id
        label = np.array([min(label[(near[j] & core) | (ids == ids[j])]) if core[j] else -1 for j in range(len(rows))])
        if all(len(set(label[near[j] & core])) <= 1 and len(set(label[(ids == ids[j]) & core])) <= 1 for j in range(len(rows)) if core[j]):
            break
    want = {int(i): label[j] if core[j] else min(label[near[j] & core], default=-1) for j, i in enumerate(ids) if i >= 0}
    asked, join = [], neighbors.block_join
    monkeypatch.setattr(neighbors, "block_join", lambda q, *a, **kw: asked.append(q.count()) or join(q, *a, **kw))
    for settings in ({}, BLOCKS):
        asked.clear()
        got = graph.dbscan(df, 0.5, 5, **settings).collect()
        assert {r["id"]: r["cluster"] for r in got if r["id"] is not None} == want
        assert asked[0] < 300  # points of cells that hold five need no count


def test_queries_go_only_to_groups_in_their_reach(spark, monkeypatch):
    random.seed(9)
    rows = [(i % 590, [round(random.uniform(0, 100), 1), float(i % 5 == 0) * random.choice([0.0, 5.0])]) for i in range(600)] + [(700, [float("nan"), 1.0])]
    df = spark.createDataFrame(rows, "id bigint, v array<double>")
    v, ids = np.array([r[1] for r in rows]), np.array([r[0] for r in rows])
    d = np.round(neighbors.distances(v, v), 9)
    limits, reach = [], neighbors._in_reach
    monkeypatch.setattr(neighbors, "_in_reach", lambda *a: limits.append(reach(*a).select("pg").collect()) or reach(*a))
    monkeypatch.setattr(neighbors, "SAMPLE", 200)
    for own in (True, False):
        got = {}
        for r in neighbors.nearest(df, df, 3, own, broadcast_points=0, block=30, pivots=20).collect():
            got.setdefault(r["id"], []).append(r["distance"])
        for i in set(ids) - {700}:
            near = sorted(x for q in np.flatnonzero(ids == i) for x in d[q][np.isfinite(d[q]) & ~(own & (ids == i))])
            if (ids == i).sum() == 1:
                assert np.allclose(sorted(got[i]), near[:3])
        assert 700 not in got
    assert all(np.mean([len(r["pg"]) for r in found]) < max(g for r in found for g in r["pg"]) / 3 for found in limits)


def test_near_leaves_leave_out_what_is_far():
    v = np.array([[float(i % 100), 0.0] for i in range(3000)])
    read = 0
    for rows, leaves in neighbors.near_leaves(v, v, 1.0):
        seen = np.concatenate(leaves)
        read += len(rows) * len(seen)
        assert set(np.flatnonzero((neighbors.distances(v[rows], v) <= 1.0).any(0))) <= set(seen)
    assert read < len(v) ** 2 / 3


def test_smote_balances_inside_the_class(blobs):
    few = blobs.where("c = 1 OR (c = 2 AND id < 60)").withColumn("label", F.col("c").cast("double"))
    made = neighbors.smote(few, "label").collect()
    sizes = {r["label"]: r["count"] for r in few.groupBy("label").count().collect()}
    assert len(made) == sizes[1.0] - sizes[2.0] and {r["label"] for r in made} == {2.0}
    assert all(np.linalg.norm(np.array(r["v"]) - np.array([0, 10])) < 4 for r in made)
    assert len({r["id"] for r in made}) == len(made)


def test_labels_spread_over_the_graph(blobs):
    rows = blobs.where("c >= 0").select("id", array_to_vector("v").alias("features"), F.when(F.col("id") < 30, F.col("c").cast("double")).alias("label"), "c")
    for spreading in (False, True):
        out = semi.label_graph(rows.drop("c"), "id", 3, spreading, rounds=40).join(rows.select("id", "c"), "id")
        assert out.where(F.col("prediction") == F.col("c")).count() > 380
    _, adopted = semi.self_train(rows.drop("c"), "logistic_regression", 3, rounds=3)
    assert adopted.join(rows.select("id", "c"), "id").where(F.col("label") == F.col("c")).count() > 380


def test_best_k_and_measures(blobs):
    df = blobs.where("c >= 0").withColumn("features", array_to_vector("v"))
    assert cluster.scan_k(df, k_max=5).where("best").first()["k"] == 3
    assert cluster.davies_bouldin(df.withColumnRenamed("c", "cluster")).first()["davies_bouldin"] < 0.5


def test_metrics_against_definitions(spark):
    rng = random.Random(4)
    rows = [(float(rng.random() < 0.4), round(rng.random(), 1)) for _ in range(300)]
    df = spark.createDataFrame(rows, "label double, score double")
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
    assert abs(metrics.auc(df) - want) < 1e-9
    curve, area = metrics.roc(df)
    assert abs(area - want) < 1e-9 and curve.count() == 12


def test_hash_ranks_need_no_global_sort(spark):
    df = spark.range(500).withColumn("y", (F.col("id") % 5 == 0).cast("int"))
    out = prep.undersample(df, "y", ["id"])
    assert {r["count"] for r in out.groupBy("y").count().collect()} == {100}
    parts = prep.split(df, ["id"], 0.8, "y").groupBy("y", "is_train").count().collect()
    assert {(r["y"], r["is_train"]): r["count"] for r in parts} == {(0, True): 320, (0, False): 80, (1, True): 80, (1, False): 20}


def test_policy(spark):
    df = spark.createDataFrame([(1.0, "a", "x"), (2.0, "a", "x"), (9.0, "b", "y"), (8.0, "b", "x"), (None, "b", "y")], "n double, c string, act string")
    held = policy.states(df, ["n"], ["c"], 2)
    best = {r["state"]: (r["action"], round(r["value"], 6)) for r in policy.greedy(policy.rewards(held, "act")).collect()}
    assert best == {"0|a": ("x", 10.0), "1|b": ("x", 5.0), "-1|b": ("y", 10.0)}


def test_ensembles(churn):
    base = churn.drop("churn_flag")
    data = tr.prepare(base, prep.make_plan(base, "churn"), ["customer_id"])
    tree = lambda: models.build("decision_tree_clf", data.n_train, 2)
    for model in (models.Vote([tree(), models.build("naive_bayes", 0, 2)], 2, [3.0, 1.0], "hard"), models.Bag(tree, 2, 3),
                  models.Stack([tree()], models.build("logistic_regression", 0, 2), 2), models.AdaBoost(2, 3, 2)):
        out = model.fit(data.train).transform(data.test)
        assert tr.evaluate(out, data.plan)["accuracy"] > 0.8
