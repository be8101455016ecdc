"""Queries for feature preparation, models, metrics, clustering, series, label spreading, policies and discovery."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainfold.functions import columns as fc
from grainfold.functions.columns import ref
from grainfold.operators import cleaning
from grainfold.operators.ml import cluster, discovery, graph, linkage, metrics, models, neighbors, policy, prep, semi, series
from grainfold.operators.ml import train as tr
from grainfold.operators.profile import Profile
from grainfold.plans.base import Tables, query
from grainfold.plans.chart_queries import rounded
from grainfold.plans.cleaning_queries import ORDER_CP_SQL
from grainfold.plans.relational import ROC_SQL, scored_labels
from grainfold.session import scratch_path
from grainfold.streaming import admission

# --- tables to learn from -------------------------------------------------------------

DOCS_SQL = """SELECT d.doc_id, lang, n_chars, length(text) - length(replace(text, ' ', '')) AS blanks,
    length(text) - length(replace(text, chr(10), '')) AS lines, toxic, quality FROM documents d {} labels l ON d.doc_id = l.doc_id"""


def docs(t: Tables, how: str = "inner") -> DataFrame:
    text = F.col("text")
    blanks = F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))
    lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return t.documents.join(t.labels, "doc_id", how).select(
        "doc_id", "lang", "n_chars", blanks.alias("blanks"), lines.alias("lines"), "toxic", "quality")


FEATURES = ["lang", "n_chars", "blanks", "lines", "toxic"]


def doc_plan(df: DataFrame) -> prep.Plan:
    return prep.make_plan(df, "quality", features=FEATURES)


def parts(t: Tables) -> DataFrame:
    """Parts with their sales: a table to predict a number from."""
    sold = t.lineitem.groupBy("l_partkey").agg(F.sum("l_quantity").alias("units"), F.sum("l_extendedprice").alias("sales"), F.count("*").alias("orders"))
    return t.part.join(sold, F.col("p_partkey") == F.col("l_partkey")).select(
        "p_partkey", "p_type", "p_size", "p_retailprice", "units", "orders", "sales")


def vectors(t: Tables) -> DataFrame:
    return t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").cast("double").alias("label"))


_HASH = "CAST('0x' || substr(md5(CAST({} AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0"

# --- preparation -------------------------------------------------------------------------

_ORDER_TASKS = f"""SELECT name AS target, CASE WHEN semantic_type IN ('categorical', 'boolean', 'text') OR "unique" <= 2
    OR ("unique" <= 20 AND unique_pct < 5) THEN 'classification' ELSE 'regression' END AS task FROM ({ORDER_CP_SQL})"""


@query("ml_infer_task", f"{_ORDER_TASKS} WHERE name IN ('o_orderstatus', 'o_totalprice')")
def _(t):
    profile = Profile(t.orders)
    return prep.infer_task(profile, "o_orderstatus").unionByName(prep.infer_task(profile, "o_totalprice"))


@query("ml_select_features", f"""SELECT position, name AS feature, CASE WHEN semantic_type = 'numeric' THEN 'numeric' ELSE 'categorical' END AS kind
    FROM ({ORDER_CP_SQL}) WHERE name <> 'o_orderstatus' AND "unique" > 1 AND (semantic_type = 'numeric' OR (semantic_type = 'categorical' AND "unique" <= 40))""")
def _(t):
    return prep.feature_table(Profile(t.orders), "o_orderstatus")


@query("ml_leak_linear", """SELECT 'twin' AS feature, 'correlation' AS signal, round(corr(l_extendedprice * 2 + 1, l_extendedprice), 4) AS value FROM lineitem
    WHERE (SELECT abs(corr(l_quantity, l_extendedprice)) < 0.995 AND abs(corr(l_tax, l_extendedprice)) < 0.995 FROM lineitem)""")
def _(t):
    df = t.lineitem.withColumn("twin", F.col("l_extendedprice") * 2 + 1)
    return rounded(prep.leakage(df, "l_extendedprice", ["l_quantity", "l_tax", "twin"], [], "regression"), "value")


_PURITY_SQL = """SELECT '{0}' AS feature, sum(m) / sum(t) AS value, count(*) AS groups FROM (SELECT v, max(n) AS m, sum(n) AS t
    FROM (SELECT {1} AS v, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2) GROUP BY v)"""


@query("ml_leak_purity", f"""SELECT feature, 'purity' AS signal, value FROM ({_PURITY_SQL.format("copy", "'is ' || l_returnflag")} UNION ALL
    {_PURITY_SQL.format("l_linestatus", "l_linestatus")}) WHERE groups >= 2 AND value >= 0.999""")
def _(t):
    df = t.lineitem.withColumn("copy", F.concat(F.lit("is "), "l_returnflag"))
    return prep.leakage(df, "l_returnflag", [], ["copy", "l_linestatus"], "classification")


@query("ml_split", f"""WITH h AS (SELECT doc_id, quality, {_HASH.format('doc_id')} AS h FROM labels), c AS (SELECT quality, quantile_cont(h, 0.8) AS cut FROM h GROUP BY 1)
    SELECT doc_id, h.quality, h < cut AS is_train FROM h JOIN c ON h.quality = c.quality""")
def _(t):
    return prep.split(t.labels, ["doc_id"], 0.8, "quality").select("doc_id", "quality", "is_train")


@query("ml_undersample", """SELECT doc_id, quality FROM (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY md5(CAST(doc_id AS VARCHAR))) AS r FROM labels)
    WHERE r <= (SELECT min(n) FROM (SELECT count(*) AS n FROM labels GROUP BY quality))""")
def _(t):
    return prep.undersample(t.labels, "quality", ["doc_id"]).select("doc_id", "quality")


@query("ml_class_weight", """SELECT CAST(quality AS INTEGER) AS label, count(*) AS n, round((SELECT count(*) FROM labels) / ((SELECT count(DISTINCT quality) FROM labels) * count(*)), 6) AS weight
    FROM labels GROUP BY 1""")
def _(t):
    return rounded(prep.class_weights(t.labels, "quality"), "weight", digits=6)


@query("ml_preprocess")
def _(t):
    df = docs(t, "left")
    plan = doc_plan(df)
    data = prep.typed(df, plan, ["doc_id"])
    ready = prep.preprocessor(data, plan).fit(data).transform(data)
    return ready.select("doc_id", vector_to_array("features").alias("features"))


@query("ml_smote", """SELECT CAST(label AS DOUBLE) AS label, CAST((SELECT max(n) FROM (SELECT count(*) AS n FROM embeddings GROUP BY label)) - count(*) AS BIGINT) AS made FROM embeddings GROUP BY label
    HAVING made > 0""")
def _(t):
    return neighbors.smote(vectors(t)).groupBy("label").agg(F.count("*").alias("made"))


@query("ml_schema", """SELECT 'n_chars' AS name, 'numeric' AS kind, CAST(min(n_chars) AS DOUBLE) AS min, CAST(max(n_chars) AS DOUBLE) AS max, round(median(n_chars), 4) AS median, NULL AS mode, 0 AS choices FROM documents
    UNION ALL SELECT 'lang', 'categorical', NULL, NULL, NULL, (SELECT lang FROM documents GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1), CAST(count(DISTINCT lang) AS INTEGER) FROM documents""")
def _(t):
    s = prep.input_schema(t.documents, ["n_chars"], ["lang"])
    return s.withColumn("choices", F.when(F.col("choices").isNull(), 0).otherwise(F.size("choices")))


# --- models --------------------------------------------------------------------------------

def fit_one(name: str, key: str, table: str):
    """One query per model: fit on the training part and score the rest."""

    def run(t: Tables) -> DataFrame:
        df, id_, target, chosen = (docs(t), "doc_id", "quality", FEATURES) if table == "docs" else (
            parts(t), "p_partkey", "sales", ["p_type", "p_size", "p_retailprice", "units"])
        data = tr.prepare(df, prep.make_plan(df, target, features=chosen), [id_])
        model = models.build(key, data.n_train, data.classes).fit(data.train)
        return model.transform(data.test).select(id_, "label", "prediction")

    query(name)(run)


for _name, _key, _table in (
    ("ml_logreg", "logistic_regression", "docs"), ("ml_tree_clf", "decision_tree_clf", "docs"), ("ml_tree_reg", "decision_tree_reg", "parts"),
    ("ml_forest_clf", "random_forest_clf", "docs"), ("ml_forest_reg", "random_forest_reg", "parts"), ("ml_gbt_clf", "gradient_boosting_clf", "docs"),
    ("ml_gbt_reg", "gradient_boosting_reg", "parts"), ("ml_adaboost_clf", "adaboost_clf", "docs"), ("ml_svc_linear", "svm_clf", "docs"),
    ("ml_gnb", "naive_bayes", "docs"), ("ml_linear", "linear_regression", "parts"), ("ml_ridge", "ridge", "parts"), ("ml_lasso", "lasso", "parts"),
    ("ml_enet", "elastic_net", "parts"), ("ml_knn_reg", "knn_reg", "parts"), ("ml_adaboost_reg", "adaboost_reg", "parts"),
    ("ml_svc_rbf", "svm_rbf_clf", "docs"), ("ml_kernel_ridge", "kernel_ridge", "parts"),
):
    fit_one(_name, _key, _table)


def pair_sql(rest: str) -> str:
    return f"""WITH p AS (SELECT a.vec_id AS id, b.vec_id AS other, b.label, row_number() OVER (PARTITION BY a.vec_id ORDER BY
        round(list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9), b.vec_id) AS r
        FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id) {rest}"""


@query("ml_knn", pair_sql("""SELECT id, CAST(label AS DOUBLE) AS prediction, round(n / 5, 4) AS share FROM (SELECT id, label, count(*) AS n,
    row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, label) AS k FROM p WHERE r <= 5 GROUP BY 1, 2) WHERE k = 1"""))
def _(t):
    rows = vectors(t)
    near = neighbors.nearest(rows.select("id", "v"), rows, 5, exclude_self=True, extra={"label": "double"})
    votes = near.groupBy("id").agg(*[F.avg((F.col("label") == c).cast("double")).alias(f"s{c}") for c in range(10)])
    out = models.votes_to_columns(votes, [F.col(f"s{c}") for c in range(10)])
    return out.select("id", "prediction", F.round(F.array_max(vector_to_array("probability")), 4).alias("share"))


@query("ml_knn_blocks", pair_sql("SELECT id, other, CAST(r AS INTEGER) AS rank FROM p WHERE r <= 5"))
def _(t):
    rows = vectors(t).select("id", "v")
    return neighbors.nearest(rows, rows, 5, exclude_self=True, broadcast_points=0, block=128, pivots=8).select("id", "other", "rank")


def base_model(key: str, data: tr.Prepared):
    return models.build(key, data.n_train, data.classes)


@query("ml_vote")
def _(t):
    data = tr.prepare(docs(t), doc_plan(docs(t)), ["doc_id"])
    base = [base_model(k, data) for k in ("logistic_regression", "decision_tree_clf", "naive_bayes")]
    return models.Vote(base, 2, [2.0, 1.0, 1.0]).fit(data.train).transform(data.test).select("doc_id", "label", "prediction")


@query("ml_stack")
def _(t):
    data = tr.prepare(docs(t), doc_plan(docs(t)), ["doc_id"])
    base = [base_model(k, data) for k in ("decision_tree_clf", "naive_bayes")]
    return models.Stack(base, base_model("logistic_regression", data), 2).fit(data.train).transform(data.test).select("doc_id", "label", "prediction")


@query("ml_bag")
def _(t):
    data = tr.prepare(docs(t), doc_plan(docs(t)), ["doc_id"])
    bag = models.Bag(lambda: base_model("decision_tree_clf", data), 2)
    return bag.fit(data.train).transform(data.test).select("doc_id", "label", "prediction")


@query("ml_tune")
def _(t):
    data = tr.prepare(docs(t), doc_plan(docs(t)), ["doc_id"])
    return tr.tune(data, "decision_tree_clf").select("position", "score", "method")


@query("ml_cv")
def _(t):
    df = docs(t)
    mean, std = tr.cross_validate(tr.prepare(df, doc_plan(df), ["doc_id"]), "decision_tree_clf")
    return t.spark.range(1).select(F.lit("decision_tree_clf").alias("model"), F.lit(mean).alias("cv_mean"), F.lit(std).alias("cv_std"))


@query("ml_params")
def _(t):
    data = tr.prepare(docs(t), doc_plan(docs(t)), ["doc_id"])
    values = models.settings_of(base_model("decision_tree_clf", data).fit(data.train))
    return t.spark.createDataFrame([(k, str(v)) for k, v in sorted(values.items())], "name string, value string")


def doc_run(t: Tables) -> tr.Trained:
    df = docs(t)
    return tr.train(df, doc_plan(df), ["doc_id"], ["decision_tree_clf", "logistic_regression", "naive_bayes"])


@query("ml_leaderboard")
def _(t):
    return doc_run(t).board.select("rank", "model", "test_score", "train_score", "cv_mean", "gap", "verdict", "confidence")


@query("ml_score")
def _(t):
    df = docs(t, "left")
    plan = doc_plan(df.where("quality IS NOT NULL"))
    data = tr.prepare(df, plan, ["doc_id"])
    model = base_model("logistic_regression", data).fit(data.train)
    schema = prep.input_schema(df, plan.numeric, plan.categorical)
    return tr.score(model, data.pipeline, plan, df, ["doc_id"], schema).select("doc_id", "prediction", "confidence")


@query("ml_save")
def _(t):
    df = docs(t)
    plan = doc_plan(df)
    data = tr.prepare(df, plan, ["doc_id"])
    path = scratch_path(t.spark, "model")
    tr.save(base_model("decision_tree_clf", data).fit(data.train), data.pipeline, path)
    return tr.load(path).transform(prep.typed(df, plan, ["doc_id"])).select("doc_id", "label", "prediction")


@query("rul_advice")
def _(t):
    run = doc_run(t)
    sizes = prep.class_sizes(run.data.rows, "label")
    from grainfold.operators import rules

    return rules.advice(run.board, tr.permutation_importance(run), sizes)


# --- metrics ---------------------------------------------------------------------------------

PREDICTED_SQL = "SELECT doc_id, quality AS label, CASE WHEN doc_id % 5 = 0 THEN 1 - quality ELSE quality END AS prediction FROM labels"
REG_SQL = "SELECT o_totalprice AS label, o_totalprice * (0.9 + (o_orderkey % 7) / 30.0) AS prediction FROM orders"


def predicted(t: Tables) -> DataFrame:
    q = F.col("quality")
    return t.labels.select("doc_id", q.alias("label"), F.when(F.col("doc_id") % 5 == 0, 1 - q).otherwise(q).alias("prediction"))


def estimated(t: Tables) -> DataFrame:
    y = F.col("o_totalprice")
    return t.orders.select(y.alias("label"), (y * (0.9 + (F.col("o_orderkey") % 7) / 30.0)).alias("prediction"))


REPORT_SQL = f"""WITH p AS ({PREDICTED_SQL}), c AS (SELECT label AS l FROM p UNION SELECT prediction FROM p),
    s AS (SELECT l, (SELECT count(*) FROM p WHERE label = l) AS a, (SELECT count(*) FROM p WHERE prediction = l) AS q,
      (SELECT count(*) FROM p WHERE prediction = l AND label = l) AS h FROM c),
    r AS (SELECT l AS label, coalesce(h / nullif(q, 0), 0) AS precision, coalesce(h / nullif(a, 0), 0) AS recall, a AS support FROM s)
    SELECT label, precision, recall, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1, support FROM r"""


@query("met_report", f"SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM ({REPORT_SQL})")
def _(t):
    return rounded(metrics.class_report(predicted(t)), "precision", "recall", "f1", digits=6)


@query("met_clf", f"""SELECT round(sum(recall * support) / sum(support), 6) AS accuracy, round(sum(f1 * support) / sum(support), 6) AS f1_weighted,
    round(sum(precision * support) / sum(support), 6) AS precision_weighted, round(sum(recall * support) / sum(support), 6) AS recall_weighted FROM ({REPORT_SQL})""")
def _(t):
    return rounded(metrics.classification(predicted(t)), "accuracy", "f1_weighted", "precision_weighted", "recall_weighted", digits=6)


@query("met_auc", """WITH s AS (SELECT n_chars % 100 AS score, quality FROM documents JOIN labels USING (doc_id)),
    r AS (SELECT quality, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS r FROM s)
    SELECT round((sum(r) FILTER (WHERE quality = 1) - count(*) FILTER (WHERE quality = 1) * (count(*) FILTER (WHERE quality = 1) + 1) / 2)
      / (count(*) FILTER (WHERE quality = 1) * count(*) FILTER (WHERE quality = 0)), 6) AS auc FROM r""")
def _(t):
    return t.spark.range(1).select(F.round(F.lit(metrics.auc(scored_labels(t))), 6).alias("auc"))


@query("met_confusion", f"SELECT label, prediction, count(*) AS n FROM ({PREDICTED_SQL}) GROUP BY 1, 2")
def _(t):
    return metrics.confusion(predicted(t))


@query("met_reg", f"""SELECT round(1 - avg((label - prediction) ** 2) / var_pop(label), 6) AS r2, round(sqrt(avg((label - prediction) ** 2)), 3) AS rmse,
    round(avg((label - prediction) ** 2) / 1e6, 3) AS mse, round(avg(abs(label - prediction)), 3) AS mae, round(avg(abs((label - prediction) / label)), 6) AS mape FROM ({REG_SQL})""")
def _(t):
    m = metrics.regression(estimated(t))
    return m.select(F.round("r2", 6).alias("r2"), F.round("rmse", 3).alias("rmse"), F.round(F.col("mse") / 1e6, 3).alias("mse"),
                    F.round("mae", 3).alias("mae"), F.round("mape", 6).alias("mape"))


@query("dia_roc", f"""WITH s AS ({ROC_SQL}), a AS (SELECT NULL AS score, 0 AS tp, 0 AS fp UNION ALL SELECT score, tp, fp FROM s),
    o AS (SELECT *, row_number() OVER (ORDER BY score DESC NULLS FIRST) - 1 AS position, count(*) OVER () AS n FROM a),
    k AS (SELECT CAST(floor(i * (n - 1) / 59.0) AS BIGINT) AS position FROM (SELECT max(n) AS n FROM o), (SELECT unnest(range(0, 60)) AS i))
    SELECT position, round(tp / (SELECT max(tp) FROM s), 6) AS tpr, round(fp / (SELECT max(fp) FROM s), 6) AS fpr FROM o
    WHERE n <= 60 OR position IN (SELECT position FROM k)""")
def _(t):
    curve, _ = metrics.roc(scored_labels(t))
    return rounded(curve, "tpr", "fpr", digits=6)


@query("dia_perm")
def _(t):
    return tr.permutation_importance(doc_run(t))


@query("dia_learning")
def _(t):
    df = docs(t)
    return tr.learning_curve(tr.prepare(df, doc_plan(df), ["doc_id"]), "decision_tree_clf")


@query("dia_preddist", f"""WITH p AS ({PREDICTED_SQL}) SELECT label, (SELECT count(*) FROM p x WHERE x.label = c.label) AS actual,
    (SELECT count(*) FROM p x WHERE x.prediction = c.label) AS predicted FROM (SELECT label FROM p UNION SELECT prediction FROM p) c""")
def _(t):
    return metrics.class_support(predicted(t))


@query("dia_resid", f"SELECT round(avg(label - prediction), 3) AS mean, round(stddev_pop(label - prediction), 3) AS std FROM ({REG_SQL})")
def _(t):
    return rounded(metrics.residuals(estimated(t)), "mean", "std", digits=3)


_BOARD_SQL = "SELECT p_type AS model, avg(p_size) / 51 AS train_score, avg(p_size) / 51 - count(*) % 20 / 100.0 AS test_score, stddev_samp(p_size) / 1000 AS cv_std FROM part GROUP BY 1"


def scores(t: Tables) -> DataFrame:
    return t.part.groupBy(F.col("p_type").alias("model")).agg(
        (F.avg("p_size") / 51).alias("train_score"), (F.avg("p_size") / 51 - F.count("*") % 20 / 100.0).alias("test_score"),
        (F.stddev_samp("p_size") / 1000).alias("cv_std"))


@query("dia_overfit", f"""SELECT model, round(train_score - test_score, 4) AS gap, CASE WHEN round(train_score - test_score, 4) >= 0.15 THEN 'high'
    WHEN round(train_score - test_score, 4) >= 0.06 THEN 'moderate' ELSE 'low' END AS verdict FROM ({_BOARD_SQL})""")
def _(t):
    return metrics.overfit(scores(t)).select("model", "gap", "verdict")


@query("dia_conf", f"""SELECT model, round(greatest(0, least(1, test_score - CASE WHEN round(train_score - test_score, 4) >= 0.15 THEN 0.2
    WHEN round(train_score - test_score, 4) >= 0.06 THEN 0.08 ELSE 0 END - least(0.2, cv_std * 2))), 4) AS confidence FROM ({_BOARD_SQL})""")
def _(t):
    return metrics.confidence(metrics.overfit(scores(t))).select("model", "confidence")


@query("dia_resid_points", f"SELECT o_orderkey, label, prediction, label - prediction AS residual FROM ({REG_SQL.replace('SELECT', 'SELECT o_orderkey,')})")
def _(t):
    y = F.col("o_totalprice")
    rows = t.orders.select("o_orderkey", y.alias("label"), (y * (0.9 + (F.col("o_orderkey") % 7) / 30.0)).alias("prediction"))
    return metrics.residual_points(rows, key=["o_orderkey"])


@query("rep_model_tables")
def _(t):
    return tr.report_tables(doc_run(t))


# --- discovery ---------------------------------------------------------------------------------

@query("sig_targets", f"""SELECT position, name AS target FROM ({ORDER_CP_SQL}) WHERE semantic_type NOT IN ('text', 'datetime') AND "unique" > 1 AND missing_pct <= 40""")
def _(t):
    return discovery.viable_targets(Profile(t.orders))


@query("sig_leak_single", """SELECT f.feature, 'correlation' AS signal, round(abs(f.r), 4) AS value, CASE WHEN abs(f.r) >= 0.9 THEN 'leak' WHEN abs(f.r) >= 0.8 THEN 'hint' ELSE 'none' END AS verdict
    FROM (SELECT 'l_quantity' AS feature, corr(l_quantity, y) AS r FROM g UNION ALL SELECT 'l_extendedprice', corr(l_extendedprice, y) FROM g UNION ALL SELECT 'l_tax', corr(l_tax, y) FROM g) f
    """.replace("FROM g", "FROM (SELECT *, l_quantity * 1000 + l_extendedprice / 10 AS y FROM lineitem)"))
def _(t):
    df = t.lineitem.withColumn("y", F.col("l_quantity") * 1000 + F.col("l_extendedprice") / 10)
    return rounded(discovery.single_leak(df, "y", "regression", ["l_quantity", "l_extendedprice", "l_tax"], []), "value")


@query("sig_leak_pair", " UNION ALL ".join(
    f"""SELECT '{a} {o} {b}' AS driver, round(abs(r), 4) AS value, CASE WHEN abs(r) >= 0.9 THEN 'leak' WHEN abs(r) >= 0.8 THEN 'hint' ELSE 'none' END AS verdict
    FROM (SELECT corr({a} {s} nullif({b}, 0), l_quantity * l_extendedprice) AS r FROM lineitem)""" if s == "/" else
    f"""SELECT '{a} {o} {b}' AS driver, round(abs(r), 4) AS value, CASE WHEN abs(r) >= 0.9 THEN 'leak' WHEN abs(r) >= 0.8 THEN 'hint' ELSE 'none' END AS verdict
    FROM (SELECT corr({a} {s} {b}, l_quantity * l_extendedprice) AS r FROM lineitem)"""
    for a, b in (("l_quantity", "l_extendedprice"), ("l_quantity", "l_tax"), ("l_extendedprice", "l_tax")) for o, s in (("/", "/"), ("×", "*"))))
def _(t):
    df = t.lineitem.withColumn("amount", F.col("l_quantity") * F.col("l_extendedprice"))
    return rounded(discovery.pair_leaks(df, "amount", ["l_quantity", "l_extendedprice", "l_tax"]), "value")


@query("sig_leak_tree")
def _(t):
    df = t.lineitem.withColumn("amount", F.col("l_quantity") * F.col("l_extendedprice"))
    return discovery.tree_leak(df, "amount", ["l_quantity", "l_extendedprice", "l_tax"])


@query("sig_scan")
def _(t):
    return discovery.scan(docs(t), ["doc_id"])


# --- clustering -----------------------------------------------------------------------------------

def clustered(t: Tables) -> DataFrame:
    return vectors(t).select("id", "v", array_to_vector("v").alias("features"), F.col("label").cast("int").alias("cluster"))


@query("clu_kmeans")
def _(t):
    df = clustered(t).drop("cluster")
    best = cluster.scan_k(df).where("best").first()["k"]
    return cluster.kmeans(df, best).transform(df).select("id", "cluster", F.lit(best).alias("k"))


@query("clu_scan")
def _(t):
    return cluster.scan_k(clustered(t).drop("cluster"))


@query("clu_dbscan")
def _(t):
    rows = t.customer.select(F.col("c_custkey").alias("id"), F.array(F.col("c_acctbal") / 1000, F.col("c_nationkey") / 2.0).alias("v"))
    return graph.dbscan(rows, 0.5, 5)


@query("clu_hier")
def _(t):
    return cluster.hierarchical(clustered(t).drop("cluster"), 5).select("id", "cluster")


def customers(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("id"), F.array(F.col("c_acctbal") / 1000, F.col("c_nationkey") / 2.0).alias("v"))


def spanning_tree_sql(rounds: int = 11) -> str:
    """The rounds of the spanning tree written out, for up to 2 ** rounds customers: every component takes its least way out."""
    steps = ["p AS MATERIALIZED (SELECT c_custkey AS id, c_acctbal / 1000 AS x, c_nationkey / 2.0 AS y FROM customer)",
             "e AS MATERIALIZED (SELECT a.id AS a, b.id AS b, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d FROM p a JOIN p b ON a.id <> b.id)",
             "c0 AS MATERIALIZED (SELECT id, id AS c FROM p)"]
    for r in range(rounds):
        steps += [
            f"w{r} AS MATERIALIZED (SELECT s.c, min([d, least(a, b), greatest(a, b)]) AS w FROM e JOIN c{r} s ON s.id = a JOIN c{r} t ON t.id = b WHERE s.c <> t.c GROUP BY 1)",
            f"o{r} AS MATERIALIZED (SELECT w.c, w, CASE WHEN lo.c = w.c THEN hi.c ELSE lo.c END AS other FROM w{r} w JOIN c{r} lo ON lo.id = w[2] JOIN c{r} hi ON hi.id = w[3])",
            f"u{r}_0 AS MATERIALIZED (SELECT o.c, CASE WHEN back.w = o.w AND o.c < o.other THEN o.c ELSE o.other END AS up FROM o{r} o JOIN o{r} back ON back.c = o.other)",
            *[f"u{r}_{i + 1} AS MATERIALIZED (SELECT a.c, b.up FROM u{r}_{i} a JOIN u{r}_{i} b ON b.c = a.up)" for i in range(rounds)],
            f"c{r + 1} AS MATERIALIZED (SELECT id, coalesce(up, c.c) AS c FROM c{r} c LEFT JOIN u{r}_{rounds} u ON u.c = c.c)"]
    found = " UNION ".join(f"SELECT w[1] AS d, w[2]::BIGINT AS a, w[3]::BIGINT AS b FROM w{r}" for r in range(rounds))
    return ",\n".join([*steps, f"tree AS MATERIALIZED ({found})"])


@query("clu_linkage_tree", f"WITH {spanning_tree_sql()} SELECT a, b, round(sqrt(d), 6) AS height FROM tree")
def _(t):
    return linkage.tree(customers(t), "single").select("a", "b", F.round("height", 6).alias("height"))


@query("clu_linkage", f"""WITH RECURSIVE {spanning_tree_sql()},
    cut AS MATERIALIZED (SELECT * FROM tree ORDER BY d DESC, a DESC, b DESC LIMIT 6),
    kept AS MATERIALIZED (SELECT a, b FROM tree EXCEPT SELECT a, b FROM cut),
    both_ways AS MATERIALIZED (SELECT a, b FROM kept UNION ALL SELECT b, a FROM kept),
    reach(start, id) AS (SELECT DISTINCT a, a FROM (SELECT a FROM cut UNION SELECT b FROM cut) UNION SELECT start, b FROM reach JOIN both_ways ON a = id),
    least AS (SELECT start, min(id) AS root FROM reach GROUP BY 1)
    SELECT id, dense_rank() OVER (ORDER BY root) - 1 AS cluster FROM (SELECT id, min(root) AS root FROM reach JOIN least USING (start) GROUP BY 1)""")
def _(t):
    return linkage.agglomerative(customers(t), 7, "single")


@query("clu_ward")
def _(t):
    return linkage.agglomerative(customers(t), 5, "ward")


@query("clu_average")
def _(t):
    return linkage.agglomerative(vectors(t).select("id", "v"), 5, "average")


@query("clu_metrics", """WITH p AS (SELECT label AS c, unnest(range(1, len(embedding) + 1)) AS i, unnest(CAST(embedding AS DOUBLE[])) AS x, vec_id FROM embeddings),
    m AS (SELECT c, i, avg(x) AS m FROM p GROUP BY 1, 2),
    s AS (SELECT c, avg(d) AS s FROM (SELECT p.c, vec_id, sqrt(sum((x - m) ** 2)) AS d FROM p JOIN m ON p.c = m.c AND p.i = m.i GROUP BY 1, 2) GROUP BY 1),
    d AS (SELECT a.c AS a, b.c AS b, sqrt(sum((a.m - b.m) ** 2)) AS d FROM m a JOIN m b ON a.i = b.i AND a.c <> b.c GROUP BY 1, 2)
    SELECT round(avg(w), 5) AS davies_bouldin, count(*) AS n_clusters FROM (SELECT a, max((x.s + y.s) / d) AS w FROM d JOIN s x ON x.c = a JOIN s y ON y.c = b GROUP BY 1)""")
def _(t):
    return rounded(cluster.davies_bouldin(clustered(t)), "davies_bouldin", digits=5)


def anova_sql(features: list[str]) -> str:
    one = " UNION ALL ".join(
        f"""SELECT '{f}' AS feature, (sum(n * (m - gm) ** 2) / (count(*) - 1)) / (sum(n * s) / (sum(n) - count(*))) AS f FROM
        (SELECT l_returnflag, count(*) AS n, avg({f}) AS m, var_pop({f}) AS s FROM lineitem GROUP BY 1), (SELECT avg({f}) AS gm FROM lineitem)""" for f in features)
    return f"WITH a AS ({one}) SELECT feature, round(f, 4) AS f, round(f / (SELECT max(f) FROM a), 4) AS importance FROM a"


@query("clu_explain", anova_sql(["l_quantity", "l_extendedprice", "l_tax"]))
def _(t):
    columns = {c: ref(c) for c in ("l_quantity", "l_extendedprice", "l_tax")}
    return rounded(cluster.separation(t.lineitem, columns, "l_returnflag"), "f", "importance")


@query("clu_projection")
def _(t):
    rows, shares = cluster.projection(clustered(t))
    return rows.select("id", "x", "y", F.lit(sum(shares)).alias("explained"))


@query("clu_board")
def _(t):
    return cluster.board(t.customer, "c_custkey", ["c_acctbal", "c_nationkey"])


# --- time series --------------------------------------------------------------------------------------

@query("ts_column", """SELECT 'o_orderdate' AS "column" """)
def _(t):
    return series.time_column(Profile(t.orders))


SERIES_SQL = """WITH r AS (SELECT value AS y, row_number() OVER (ORDER BY ts, event_id) - 1 AS i, count(*) OVER () AS n FROM events),
    f AS (SELECT regr_slope(y, i) AS a, regr_intercept(y, i) AS b, max_by(y, i) AS l FROM r WHERE i < floor(n * 0.8)),
    p AS (SELECT y, l AS last_value, a * i + b AS linear_trend FROM r, f WHERE i >= floor(n * 0.8)) """


@query("ts_baselines", SERIES_SQL + " UNION ALL ".join(
    f"""SELECT '{m}' AS model, round(1 - avg((y - {m}) ** 2) / var_pop(y), 5) AS r2, round(sqrt(avg((y - {m}) ** 2)), 4) AS rmse, round(avg(abs(y - {m})), 4) AS mae,
    round(avg(abs((y - {m}) / nullif(y, 0))) * 100, 3) AS mape FROM p""" for m in ("last_value", "linear_trend")))
def _(t):
    board, _ = series.baselines(t.events, "value", "ts", ["event_id"])
    return rounded(rounded(rounded(board, "r2", digits=5), "rmse", "mae"), "mape", digits=3)


_FORECAST_SQL = SERIES_SQL.replace("SELECT y, l AS last_value", "SELECT i, y, l AS last_value")


@query("ts_naive", _FORECAST_SQL + "SELECT i, round(y, 4) AS label, round(last_value, 4) AS last_value FROM p")
def _(t):
    _, forecast = series.baselines(t.events, "value", "ts", ["event_id"])
    return rounded(forecast, "label", "last_value").drop("linear_trend")


@query("ts_trend", _FORECAST_SQL + "SELECT i, round(y, 4) AS label, round(linear_trend, 4) AS linear_trend FROM p")
def _(t):
    _, forecast = series.baselines(t.events, "value", "ts", ["event_id"])
    return rounded(forecast, "label", "linear_trend").drop("last_value")


# --- labels from few labels -------------------------------------------------------------------------------

def half_labelled(t: Tables) -> DataFrame:
    df = docs(t, "left")
    plan = doc_plan(df)
    data = prep.typed(df, plan, ["doc_id"])
    return prep.preprocessor(data, plan).fit(data).transform(data).select("doc_id", "features", "label")


@query("ssl_self")
def _(t):
    _, rows = semi.self_train(half_labelled(t), "logistic_regression", 2)
    return rows.select("doc_id", "label", "round")


@query("ssl_propagate")
def _(t):
    return semi.label_graph(half_labelled(t), "doc_id", 2)


@query("ssl_spread")
def _(t):
    return semi.label_graph(half_labelled(t), "doc_id", 2, spreading=True)


@query("ssl_pseudo", """SELECT CAST(b AS INTEGER) AS bin, CAST(round(0.5 + b * 0.05, 4) AS DOUBLE) AS lower, count(c) AS n FROM (SELECT unnest(range(0, 10)) AS b)
    LEFT JOIN (SELECT least(floor(((0.5 + n_chars % 500 / 998.0) - 0.5) / 0.05), 9) AS c FROM documents) ON b = c GROUP BY b""")
def _(t):
    scored = t.documents.select((F.col("n_chars") % 2).alias("prediction"), (0.5 + F.col("n_chars") % 500 / 998.0).alias("confidence"))
    _, bins = semi.pseudo_labels(scored)
    return bins


@query("ssl_board")
def _(t):
    return semi.board(half_labelled(t), "doc_id", 2)


# Values with no plain decimal reading are null; NaN has no code; a border point keeps an id above 2^53; an event without a moment comes back.
@query("num_decimal_only", """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN CAST(o_custkey AS DOUBLE) END AS number FROM orders""")
def _(t):
    text = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.col("o_custkey"), F.lit("d"))).when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit("0x"), F.col("o_custkey"), F.lit("p3"))).when(
        F.col("o_orderkey") % 4 == 2, F.concat(F.col("o_custkey"), F.lit("f"))).otherwise(F.concat(F.lit(" "), F.col("o_custkey"), F.lit(".0 ")))
    df = t.orders.select("o_orderkey", text.alias("text"))
    return df.select("o_orderkey", fc.number_of(df, "text").alias("number"))


@query("cln_label_nan", """SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN dense_rank() OVER (PARTITION BY event_id % 3 <> 0 ORDER BY round(value, 1)) - 1 END AS value FROM events""")
def _(t):
    df = t.events.select("event_id", F.when(F.col("event_id") % 3 == 0, F.lit(float("nan"))).otherwise(F.round("value", 1)).alias("value"))
    return cleaning.label_encode(df, "value", {})


@query("stm_admission_untimed", "SELECT event_id, user_id FROM events")
def _(t):
    held = t.events.select("event_id", "user_id", F.when(F.col("event_id") % 5 != 0, F.col("ts")).alias("ts"))
    return admission.admit(held, "user_id", "ts", "event_id", 3, 86_400).select("event_id", "user_id")


# --- policies ----------------------------------------------------------------------------------------------

_EDGE = "quantile_cont(o_totalprice, {})"
STATES_SQL = f"""SELECT o_orderkey, o_orderstatus, {_HASH.format('o_orderkey')} < 0.8 AS is_train,
    CAST((o_totalprice > q1)::INT + (o_totalprice > q2)::INT + (o_totalprice > q3)::INT + (o_totalprice > q4)::INT AS VARCHAR) || '|' || o_orderpriority AS state
    FROM orders, (SELECT {", ".join(f"{_EDGE.format(i / 5)} AS q{i}" for i in range(1, 5))} FROM orders)"""


def order_states(t: Tables) -> DataFrame:
    held = policy.states(t.orders, ["o_totalprice"], ["o_orderpriority"])
    return held.withColumn("is_train", prep.hash_share(F.col("o_orderkey")) < 0.8)


@query("pol_state", f"SELECT o_orderkey, state FROM ({STATES_SQL})")
def _(t):
    return order_states(t).select("o_orderkey", "state")


POLICY_SQL = f"""WITH s AS ({STATES_SQL}), c AS (SELECT state, o_orderstatus AS action, count(*) AS n FROM s WHERE is_train GROUP BY 1, 2),
    r AS (SELECT state, action, n, n / sum(n) OVER (PARTITION BY state) AS share, sum(n) OVER (PARTITION BY state) AS rows,
      row_number() OVER (PARTITION BY state ORDER BY n DESC, action) AS k FROM c),
    g AS (SELECT state, action, CAST(rows AS BIGINT) AS rows, share / 0.1 AS value FROM r WHERE k = 1) """


@query("pol_reward", POLICY_SQL + "SELECT state, action, rows, round(value, 6) AS value FROM g")
def _(t):
    return rounded(policy.greedy(policy.rewards(order_states(t).where("is_train"), "o_orderstatus")), "value", digits=6)


@query("pol_eval", POLICY_SQL + """SELECT count(*) AS rows, round(avg((g.action IS NOT NULL)::INT), 6) AS known,
    round(avg(coalesce((g.action = o_orderstatus)::INT, 0)), 6) AS accuracy FROM s LEFT JOIN g ON s.state = g.state WHERE NOT is_train""")
def _(t):
    held = order_states(t)
    table = policy.greedy(policy.rewards(held.where("is_train"), "o_orderstatus"))
    return rounded(policy.evaluate(held.where("NOT is_train"), "o_orderstatus", table), "known", "accuracy", digits=6)


@query("pol_busiest", POLICY_SQL + "SELECT state, action, rows, round(value, 6) AS value FROM g ORDER BY rows DESC, state LIMIT 6")
def _(t):
    table = policy.greedy(policy.rewards(order_states(t).where("is_train"), "o_orderstatus"))
    return rounded(policy.busiest(table), "value", digits=6)


