"""Queries for analytic answers, rule tables and conversation jobs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainfold.operators import analyst, rules, text
from grainfold.operators.profile import Profile
from grainfold.plans.base import Tables, query
from grainfold.plans.chart_queries import SKEW_LABEL, rounded
from grainfold.plans.cleaning_queries import (
    CP_SQL, LABELLED_SQL, NUMERIC_SQL, ORDER_CP_SQL, ORDER_KINDS, QUALITY_SQL, SPIKY_SQL, TARGETS_SQL, labelled_docs,
    numeric_sql, quality_sql, spiky)
from grainfold.plans.relational import LINE_NUMBERS, LINE_SQL, histogram_sql, line_amounts, pairs_sql, rounded_bins

TOP_SQL = """
    WITH g AS (SELECT c_mktsegment, sum(l_extendedprice * (1 - l_discount)) AS v FROM lineitem
      JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1)
    SELECT c_mktsegment, round(v, 2) AS value, round(v / (SELECT sum(v) FROM g) * 100, 4) AS share_pct FROM g ORDER BY v DESC LIMIT 10"""


def revenue_by_segment(t: Tables) -> DataFrame:
    """Revenue per market segment: the first query of the library."""
    sold = (t.lineitem.select("l_orderkey", "l_extendedprice", "l_discount")
            .join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
            .join(t.customer.select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey")))
    # Rows without an order or a customer take no part, so the shares add up to 100.
    revenue = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    top = analyst.top_n(sold, "c_mktsegment", agg="sum", number=revenue)
    return top.select("c_mktsegment", F.round("value", 2).alias("value"), F.round("share_pct", 4).alias("share_pct"))


query("ans_top_n", TOP_SQL)(revenue_by_segment)


@query("ans_aggregate", f"""WITH g AS ({SPIKY_SQL}) SELECT 'sum(v)' AS metric, round(sum(v), 2) AS value FROM g UNION ALL
    SELECT 'min', round(min(v), 2) FROM g UNION ALL SELECT 'max', round(max(v), 2) FROM g UNION ALL
    SELECT 'mean', round(avg(v), 2) FROM g UNION ALL SELECT 'median', round(median(v), 2) FROM g""")
def _(t):
    return rounded(analyst.aggregate(spiky(t), "v", "sum"), "value", digits=2)


@query("ans_describe", f"""WITH g AS ({LABELLED_SQL}) SELECT count(*) AS rows, CAST(4 AS BIGINT) AS columns, CAST(2 AS BIGINT) AS numeric_columns, count(*) - count(q) AS total_missing_cells,
    CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM g)) AS BIGINT) AS duplicate_rows FROM g""")
def _(t):
    return analyst.describe(labelled_docs(t))


@query("ans_correlation", f"""SELECT a, b, corr, CASE WHEN abs(corr) >= 0.7 THEN 'strong' WHEN abs(corr) >= 0.4 THEN 'moderate' ELSE 'weak' END AS strength,
    CASE WHEN corr >= 0 THEN 'positive' ELSE 'negative' END AS direction FROM ({pairs_sql(LINE_SQL, LINE_NUMBERS[:3] + ("amount",), 3)})""")
def _(t):
    names = [*LINE_NUMBERS[:3], "amount"]
    return analyst.correlation(line_amounts(t), names).withColumn("corr", F.col("corr") + 0.0)


@query("ans_missing", f"""SELECT name AS "column", missing, missing_pct FROM ({CP_SQL}) WHERE missing > 0""")
def _(t):
    return analyst.missing(spiky(t))


@query("ans_distribution", f"""SELECT h.*, round((SELECT skewness(n_chars) FROM documents), 4) AS skew,
    {SKEW_LABEL.format(s='(SELECT skewness(n_chars) FROM documents)')} AS shape
    FROM ({histogram_sql('documents', 'n_chars', 'least(20, greatest(5, floor(sqrt(count(*)))))')}) h""")
def _(t):
    return rounded(rounded_bins(analyst.distribution(t.documents, "n_chars")), "skew")


@query("ans_trend", """WITH m AS (SELECT date_trunc('month', o_orderdate) AS m, sum(o_totalprice) AS value FROM orders GROUP BY 1),
    e AS (SELECT (max_by(value, m) - min_by(value, m)) / abs(min_by(value, m)) * 100 AS c FROM m),
    k AS (SELECT unnest(generate_series(min(m), max(m), INTERVAL 1 MONTH)) AS m FROM m)
    SELECT strftime(k.m, '%Y-%m') AS period, round(coalesce(value, 0), 2) AS value, round(c, 4) AS change_pct,
      CASE WHEN c > 2 THEN 'upward' WHEN c < -2 THEN 'downward' ELSE 'flat' END AS trend FROM k LEFT JOIN m ON k.m = m.m, e""")
def _(t):
    return rounded(rounded(analyst.trend(t.orders, "o_orderdate", "o_totalprice"), "value", digits=2), "change_pct")


@query("ans_sql_summary", """SELECT o_custkey, count(*) AS records, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS average
    FROM orders GROUP BY 1 ORDER BY sum(o_totalprice) DESC, 1 LIMIT 10""")
def _(t):
    out = analyst.group_summary(t.orders, "o_custkey", "o_totalprice")
    return rounded(rounded(out, "total", digits=2), "average")


LABELLED_KINDS_SQL = " UNION ALL ".join(
    f"""SELECT {i} AS position, '{c}' AS name, '{k}' AS semantic_type, count(*) - count({c}) AS missing,
    round((count(*) - count({c})) / count(*) * 100, 2) AS missing_pct, count(DISTINCT {c}) AS "unique",
    round(count(DISTINCT {c}) / count(*) * 100, 2) AS unique_pct FROM ({LABELLED_SQL})"""
    for i, (c, k) in enumerate({"lang": "categorical", "source": "categorical", "size": "numeric", "q": "numeric"}.items()))
LABELLED_NUMERIC_SQL = numeric_sql(LABELLED_SQL, ("size", "q"))
DUP_PCT = f"""(SELECT round((count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM ({LABELLED_SQL})))) / count(*) * 100, 2) FROM ({LABELLED_SQL}))"""


@query("ans_diagnose", f"""WITH c AS ({LABELLED_KINDS_SQL}), m AS ({LABELLED_NUMERIC_SQL})
    SELECT 'missing' AS finding, NULL AS subject, CAST(sum(missing) AS DOUBLE) AS value FROM c HAVING sum(missing) > 0 UNION ALL
    SELECT 'duplicates', NULL, {DUP_PCT} WHERE {DUP_PCT} > 1 UNION ALL
    SELECT 'outliers', name, outlier_pct FROM m WHERE outlier_pct >= 5""")
def _(t):
    return analyst.diagnose(Profile(labelled_docs(t)))


@query("ans_features", """SELECT o_orderkey, o_custkey, o_orderdate, o_orderstatus, CAST(year(o_orderdate) AS INTEGER) AS o_orderdate_year,
    CAST(month(o_orderdate) AS INTEGER) AS o_orderdate_month, CAST(isodow(o_orderdate) - 1 AS INTEGER) AS o_orderdate_weekday,
    CASE WHEN isodow(o_orderdate) >= 6 THEN 1 ELSE 0 END AS o_orderdate_is_weekend, round(o_orderkey / nullif(o_custkey, 0), 6) AS o_orderkey_per_o_custkey,
    o_clerk, round(o_clerk_freq, 6) AS o_clerk_freq
    FROM (SELECT *, 'C' || o_custkey % 30 AS o_clerk, count(*) OVER (PARTITION BY o_custkey % 30) / (SELECT count(*) FROM orders) AS o_clerk_freq FROM orders)""")
def _(t):
    held = t.orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus",
                           F.concat(F.lit("C"), F.col("o_custkey") % 30).alias("o_clerk"))
    return rounded(analyst.derived_features(held), "o_orderkey_per_o_custkey", "o_clerk_freq", digits=6)


@query("ans_clean_plan", f"""WITH c AS ({LABELLED_KINDS_SQL}), m AS ({LABELLED_NUMERIC_SQL})
    SELECT 1 AS step, 'missing' AS action, name AS subject, missing_pct AS value FROM (SELECT * FROM c WHERE missing > 0 ORDER BY missing DESC LIMIT 1) UNION ALL
    SELECT 2, 'duplicates', NULL, {DUP_PCT} WHERE {DUP_PCT} > 0 UNION ALL
    SELECT 3, 'outliers', name, outlier_pct FROM m WHERE outlier_pct >= 5 UNION ALL
    SELECT 4, 'text', name, NULL FROM c WHERE semantic_type IN ('categorical', 'text')""")
def _(t):
    return analyst.cleaning_plan(Profile(labelled_docs(t)))


@query("ans_recommend", f"""SELECT "column" AS target, task, CASE WHEN task = 'classification' THEN ['logistic_regression', 'random_forest', 'gradient_boosting']
    ELSE ['linear_regression', 'random_forest', 'gradient_boosting'] END AS models, CASE WHEN task = 'classification' THEN 'f1_weighted, roc_auc'
    ELSE 'rmse, r2' END AS metrics, confidence FROM ({TARGETS_SQL}) ORDER BY confidence DESC, position LIMIT 1""")
def _(t):
    return analyst.recommend_models(Profile(t.orders))


@query("ans_stat", f"""SELECT round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS std, round(var_samp(v), 2) AS variance, round(skewness(v), 4) AS skew,
    round(median(v), 4) AS median FROM ({SPIKY_SQL})""")
def _(t):
    return rounded(rounded(analyst.stat(spiky(t), "v"), "mean", "std", "skew", "median"), "variance", digits=2)


@query("ans_default_cols", f"""SELECT (SELECT name FROM ({ORDER_CP_SQL}) WHERE semantic_type = 'numeric' ORDER BY CASE WHEN name LIKE '%total%' THEN 4
      WHEN name LIKE '%price%' THEN 5 ELSE 9 END, position LIMIT 1) AS metric,
    (SELECT name FROM ({ORDER_CP_SQL}) WHERE semantic_type = 'categorical' ORDER BY position LIMIT 1) AS group_by""")
def _(t):
    return analyst.default_columns(Profile(t.orders))


# --- rule tables -----------------------------------------------------------------------

@query("rul_clean", f"""WITH c AS ({LABELLED_KINDS_SQL}), m AS ({LABELLED_NUMERIC_SQL})
    SELECT 'missing_values' AS rule, name AS "column", CASE WHEN missing_pct >= 60 THEN 'drop_column' ELSE 'impute' END AS action,
      CASE WHEN missing_pct >= 40 THEN 'high' WHEN missing_pct >= 5 THEN 'medium' ELSE 'low' END AS severity, missing_pct < 5 AS auto_safe FROM c WHERE missing > 0
    UNION ALL SELECT 'duplicates', NULL, 'drop_duplicates', 'medium', false WHERE {DUP_PCT} > 0
    UNION ALL SELECT 'outliers', name, 'review_or_cap', 'medium', false FROM m WHERE outlier_pct >= 5""")
def _(t):
    return rules.cleaning_actions(Profile(labelled_docs(t)))


SIGNALS_SQL = f"""WITH c AS ({LABELLED_KINDS_SQL}), m AS ({LABELLED_NUMERIC_SQL}), s AS ({quality_sql(LABELLED_KINDS_SQL, LABELLED_NUMERIC_SQL, LABELLED_SQL)})
    SELECT 'quality' AS kind, 1 AS rank, grade AS subject, CAST(NULL AS VARCHAR) AS other, score AS value FROM s UNION ALL
    SELECT 'missing', CAST(row_number() OVER (ORDER BY missing_pct DESC, position) AS INTEGER), name, NULL, missing_pct FROM c WHERE missing > 0 UNION ALL
    SELECT 'duplicates', 1, NULL, NULL, {DUP_PCT} WHERE {DUP_PCT} > 1 UNION ALL
    SELECT 'outliers', CAST(row_number() OVER (ORDER BY name DESC) AS INTEGER), name, NULL, outlier_pct FROM m WHERE outlier_pct >= 5"""


@query("rul_signals", SIGNALS_SQL)
def _(t):
    return rules.signals(Profile(labelled_docs(t)))


INSIGHTS_SQL = f"""WITH g AS ({SIGNALS_SQL}), r AS (SELECT kind, subject, value, CASE kind WHEN 'quality' THEN CASE WHEN value < 60 THEN 'high' WHEN value < 80 THEN 'medium' ELSE 'info' END
      WHEN 'missing' THEN CASE WHEN value > 40 THEN 'high' ELSE 'medium' END WHEN 'correlation' THEN 'info' ELSE 'medium' END AS severity,
    CAST(CASE kind WHEN 'quality' THEN 0.9 WHEN 'missing' THEN 0.8 WHEN 'duplicates' THEN 0.85 WHEN 'outliers' THEN 0.7 ELSE 0.75 END AS DOUBLE) AS confidence FROM g WHERE rank = 1)
    SELECT *, CAST(row_number() OVER (ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END, confidence DESC, kind) AS INTEGER) AS position FROM r"""


@query("rul_insights", INSIGHTS_SQL)
def _(t):
    return rules.insights(Profile(labelled_docs(t)))


@query("rul_narrative")
def _(t):
    return rules.narrative(Profile(labelled_docs(t)))


@query("rul_risks", f"""WITH c AS ({LABELLED_KINDS_SQL}), m AS ({LABELLED_NUMERIC_SQL})
    SELECT 'duplicates' AS risk, NULL AS subject, {DUP_PCT} AS value WHERE {DUP_PCT} > 1 UNION ALL
    SELECT 'missing', string_agg(name, ', ' ORDER BY missing_pct DESC), max(missing_pct) FROM c WHERE missing_pct > 20 HAVING count(*) > 0 UNION ALL
    SELECT 'outliers', name, outlier_pct FROM (SELECT * FROM m WHERE outlier_pct > 5 ORDER BY name DESC LIMIT 1) UNION ALL
    SELECT kind, subject, value FROM ({INSIGHTS_SQL}) WHERE severity = 'high'""")
def _(t):
    return rules.risks(Profile(labelled_docs(t)))


@query("rul_objectives", f"""WITH c AS ({ORDER_CP_SQL}), m AS ({numeric_sql("SELECT * FROM orders", [k for k, v in ORDER_KINDS.items() if v == "numeric"])}),
    s AS ({quality_sql(ORDER_CP_SQL, numeric_sql("SELECT * FROM orders", [k for k, v in ORDER_KINDS.items() if v == "numeric"]), "SELECT * FROM orders")}),
    r AS (SELECT name AS target, name LIKE '%price%' AS named, position, CASE WHEN name LIKE '%price%' THEN 'Predict Price' ELSE 'Predict O ' || upper(name[3]) || name[4:] END AS title,
      CASE WHEN semantic_type = 'categorical' OR "unique" <= 2 OR ("unique" <= 20 AND unique_pct < 5) THEN 'classification' ELSE 'regression' END AS task,
      CAST(round_even(0.6 * (100 - missing_pct) + 0.4 * score, 0) AS INTEGER) AS data_quality FROM c, s
      WHERE NOT is_probable_id AND semantic_type <> 'datetime' AND (name LIKE '%price%' OR (semantic_type = 'categorical' AND "unique" BETWEEN 2 AND 10)
        OR (semantic_type = 'numeric' AND unique_pct > 5))),
    v AS (SELECT *, CASE WHEN named THEN 'high' WHEN task = 'classification' THEN 'medium' ELSE 'low' END AS business_value FROM r),
    k AS (SELECT *, CAST(row_number() OVER (ORDER BY named DESC, CASE business_value WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, data_quality DESC, position) AS INTEGER) AS rank FROM v)
    SELECT rank, target, title, task, business_value, CASE WHEN (SELECT count(*) FROM orders) < 1000 THEN 'medium' ELSE 'easy' END AS difficulty, data_quality, rank = 1 AS recommended FROM k WHERE rank <= 6""")
def _(t):
    return rules.objectives(Profile(t.orders))


@query("rul_readiness", f"""WITH c AS ({CP_SQL}), s AS ({QUALITY_SQL}) SELECT (SELECT count(*) FROM events) AS rows, count(*) AS columns,
    round(sum(missing) / ((SELECT count(*) FROM events) * count(*)) * 100, 2) AS missing_pct, CAST(0 AS DOUBLE) AS duplicate_pct,
    (SELECT score FROM s) AS quality_score, (SELECT grade FROM s) AS quality_grade,
    concat_ws('; ', CASE WHEN (SELECT count(*) FROM events) < 200 THEN 'small dataset' END,
      'identifiers: ' || string_agg(name, ', ' ORDER BY position) FILTER (WHERE is_probable_id)) AS issues FROM c""")
def _(t):
    return rules.readiness(Profile(spiky(t)))


@query("rul_report_tables", f"""SELECT 'missing' AS part, name AS subject, CAST(missing AS DOUBLE) AS value FROM ({CP_SQL}) WHERE missing > 0 UNION ALL
    SELECT 'outliers', name, CAST(outliers AS DOUBLE) FROM ({NUMERIC_SQL}) WHERE outliers > 0 UNION ALL
    SELECT 'statistics', name, mean FROM ({NUMERIC_SQL}) UNION ALL
    SELECT 'correlations', a || ' ~ ' || b, corr FROM ({pairs_sql(SPIKY_SQL, ("event_id", "user_id", "v"), 3)})""")
def _(t):
    tables = rules.report_tables(Profile(spiky(t)))
    made = lambda part, subject, value: tables[part].select(
        F.lit(part).alias("part"), subject.alias("subject"), (value.cast("double") + 0.0).alias("value"))
    return reduce(DataFrame.unionByName, [
        made("missing", F.col("column"), F.col("missing")), made("outliers", F.col("column"), F.col("outliers")),
        made("statistics", F.col("name"), F.round("mean", 4)).where("value IS NOT NULL"),
        made("correlations", F.concat_ws(" ~ ", "a", "b"), F.col("corr"))])


# --- conversations ---------------------------------------------------------------------

def intent_sql(column: str) -> str:
    cases = " ".join(f"WHEN regexp_matches(lower({column}), '{p.replace(chr(39), chr(39) * 2)}') THEN '{n}'" for n, p in text.INTENTS)
    return f"CASE {cases} ELSE 'general' END"


@query("txt_intent", f"SELECT conv_id, turn, {intent_sql('text')} AS intent FROM conversations")
def _(t):
    return text.tag_intents(t.conversations).select("conv_id", "turn", "intent")


@query("txt_follow_up", f"""WITH p AS (SELECT *, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM conversations),
    f AS (SELECT *, previous IS NOT NULL AND regexp_matches(lower(text), '{text.FOLLOW_UP}') AS follow_up FROM p)
    SELECT conv_id, turn, follow_up, CASE WHEN follow_up AND {intent_sql('text')} = 'general' THEN {intent_sql('previous')} ELSE {intent_sql('text')} END AS intent FROM f""")
def _(t):
    return text.resolve_follow_ups(t.conversations).select("conv_id", "turn", "follow_up", "intent")


def spelling_sql(columns: list[str]) -> str:
    """Every unknown token beside every word: the longest common block, then the same on both sides of it, until nothing is common."""
    words = ", ".join(f"('{w}')" for w in text.vocabulary(columns))
    stop = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
    same = "list_transform(range(0, least(ahi - i, bhi - j)), lambda k: substr(w, i + k, 1) = substr(t, j + k, 1))"
    letters = "list_sum(list_transform(list_distinct(string_split(w, '')), lambda c: least(length(w) - length(replace(w, c, '')), length(t) - length(replace(t, c, '')))))"
    return f"""WITH RECURSIVE voc AS (SELECT w FROM (VALUES {words}) AS v(w)),
    tok AS (SELECT DISTINCT t FROM (SELECT unnest(regexp_extract_all(lower(text), '[A-Za-z][A-Za-z0-9_]*')) AS t FROM conversations)
            WHERE length(t) >= 4 AND t NOT IN ({stop}) AND t NOT IN (SELECT w FROM voc)),
    pairs AS MATERIALIZED (SELECT t, w FROM tok JOIN voc ON 2.0 * least(length(t), length(w)) / (length(t) + length(w)) >= {text.SIMILARITY}
              WHERE 2.0 * {letters} / (length(t) + length(w)) >= {text.SIMILARITY}),
    blocks(t, w, alo, ahi, blo, bhi, got) AS (
      SELECT t, w, 1::BIGINT, length(w) + 1, 1::BIGINT, length(t) + 1, 0::BIGINT FROM pairs
      UNION ALL
      SELECT t, w, CASE WHEN side = 0 THEN alo ELSE best[1] - best[2] END, CASE WHEN side = 0 THEN -best[2] ELSE ahi END,
             CASE WHEN side = 0 THEN blo ELSE best[1] - best[3] END, CASE WHEN side = 0 THEN -best[3] ELSE bhi END, CASE WHEN side = 0 THEN best[1] ELSE 0 END
      FROM (SELECT *, unnest([0, 1]) AS side FROM (
        SELECT t, w, alo, ahi, blo, bhi, max([k, -i, -j]) AS best FROM (
          SELECT *, coalesce(list_position({same}, false) - 1, least(ahi - i, bhi - j))::BIGINT AS k FROM (
            SELECT *, unnest(range(blo, bhi)) AS j FROM (SELECT t, w, alo, ahi, blo, bhi, unnest(range(alo, ahi)) AS i FROM blocks WHERE alo < ahi AND blo < bhi)))
        GROUP BY t, w, alo, ahi, blo, bhi) WHERE best[1] > 0)),
    ratios AS (SELECT t, w, 2.0 * sum(got) / (length(t) + length(w)) AS ratio FROM blocks GROUP BY t, w),
    fixes AS MATERIALIZED (SELECT t, arg_max(w, [ratio::VARCHAR, w]) AS target FROM (SELECT *, rank() OVER (PARTITION BY t ORDER BY ratio DESC) AS r FROM ratios WHERE ratio >= {text.SIMILARITY}) WHERE r = 1 GROUP BY t),
    pieces AS (SELECT key, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM (
      SELECT concat(conv_id, '-', turn) AS key, regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_]*|[^A-Za-z]+') AS ps FROM conversations)),
    built AS (SELECT key, string_agg(CASE WHEN target IS NULL THEN p WHEN regexp_matches(p, '^[A-Z]') THEN concat(upper(target[1]), target[2:]) ELSE target END, '' ORDER BY i) AS fixed
              FROM pieces LEFT JOIN fixes ON t = lower(p) GROUP BY key)
    SELECT key, CASE WHEN text IS NOT NULL THEN coalesce(fixed, '') END AS corrected FROM (SELECT concat(conv_id, '-', turn) AS key, text FROM conversations) LEFT JOIN built USING (key)"""


SPELLED = ["customer_segment", "total_price"]


@query("txt_spell", spelling_sql(SPELLED))
def _(t):
    keyed = t.conversations.select(F.concat_ws("-", "conv_id", "turn").alias("key"), "text")
    return text.correct_spelling(keyed, "key", "text", SPELLED)
