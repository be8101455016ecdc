"""Queries for the cleaning operations, the step replay and the profile."""

from __future__ import annotations

from pyspark.sql import functions as F

from grainfold.operators import cleaning
from grainfold.operators.profile import TARGET_WORDS, Profile
from grainfold.plans.base import Tables, query
from grainfold.plans.relational import LINE_NUMBERS, LINE_SQL, gappy_events, line_amounts, pairs_sql

# Events with gaps and with outliers: one value in 97 is a hundred times too large.
SPIKY_SQL = """SELECT event_id, user_id, event_type, ts, CASE WHEN event_id % 7 = 0 THEN NULL
    WHEN event_id % 97 = 0 THEN value * 100 ELSE value END AS v FROM events"""
GAPPY_SQL = "SELECT event_id, user_id, event_type, ts, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS v FROM events"


def spiky(t: Tables):
    k, value = F.col("event_id"), F.col("value")
    v = F.when(k % 7 == 0, None).when(k % 97 == 0, value * 100).otherwise(value)
    return t.events.select("event_id", "user_id", "event_type", "ts", v.alias("v"))


def gappy(t: Tables):
    return gappy_events(t).select("event_id", "user_id", "event_type", "ts", "v")


def step(name: str, sql: str, source, op: str, column: str | None, params: dict | None = None, digits: int = 4):
    """Register one cleaning operation applied to one table."""

    def run(t: Tables):
        out = cleaning.apply_step(source(t), {"op": op, "column": column, "params": params or {}})
        return out.withColumn("v", F.round("v", digits)) if dict(out.dtypes).get("v") == "double" else out

    query(name, sql)(run)


KEYS = "event_id, user_id, event_type, ts"
for _m, _e in (("mean", "(SELECT avg(v) FROM g)"), ("median", "(SELECT median(v) FROM g)"), ("custom", "12.5")):
    step(f"cln_fill_{_m}", f"WITH g AS ({GAPPY_SQL}) SELECT {KEYS}, round(coalesce(v, {_e}), 4) AS v FROM g",
         gappy, "fill_missing", "v", {"method": _m, "value": "12.5"})
step("cln_fill_mode", f"""WITH g AS ({GAPPY_SQL}) SELECT {KEYS}, round(coalesce(v,
    (SELECT v FROM g WHERE v IS NOT NULL GROUP BY v ORDER BY count(*) DESC, v LIMIT 1)), 4) AS v FROM g""",
     gappy, "fill_missing", "v", {"method": "mode"})
step("cln_fill_ffill", f"""SELECT {KEYS}, round(last_value(v IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY event_id), 4) AS v
    FROM ({GAPPY_SQL})""", gappy, "fill_missing", "v", {"method": "ffill", "order_by": "event_id", "partition_by": ["event_type"]})
step("cln_fill_bfill", f"""SELECT {KEYS}, round(first_value(v IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW
    AND UNBOUNDED FOLLOWING), 4) AS v FROM ({GAPPY_SQL})""", gappy, "fill_missing", "v", {"method": "bfill", "order_by": ["event_id"]})
step("cln_drop_missing", f"SELECT {KEYS}, round(v, 4) AS v FROM ({GAPPY_SQL}) WHERE v IS NOT NULL", gappy, "drop_missing_rows", None)
step("cln_drop_column", "SELECT event_id, user_id, event_type, ts FROM events", gappy, "drop_column", "v")


def doubled(t: Tables):
    held = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus")
    return held.unionByName(held.where("o_orderkey % 50 = 0"))


DOUBLED_SQL = """(SELECT o_orderkey, o_custkey, o_orderstatus FROM orders UNION ALL
    SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey % 50 = 0)"""
step("cln_dedup_first", f"SELECT DISTINCT * FROM {DOUBLED_SQL}", doubled, "drop_duplicates", None, {"keep": "first"})
step("cln_dedup_none", f"SELECT * FROM {DOUBLED_SQL} GROUP BY ALL HAVING count(*) = 1", doubled, "drop_duplicates", None, {"keep": "none"})
step("cln_dedup_last", """SELECT o_orderkey, o_custkey, o_orderstatus FROM (SELECT *, row_number() OVER
    (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders) WHERE r = 1""",
     lambda t: t.orders.select("o_orderkey", "o_custkey", "o_orderstatus"), "drop_duplicates", "o_custkey",
     {"keep": "last", "order_by": ["o_orderkey"]})
step("cln_convert", "SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP) AS d FROM orders",
     lambda t: t.orders.select("o_orderkey", F.date_format("o_orderdate", "M/d/yyyy").alias("d")), "convert_type", "d", {"to": "date"})

FENCES = f"""WITH g AS ({SPIKY_SQL}), q AS (SELECT quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3, median(v) AS med,
    avg(v) AS mean, stddev_pop(v) AS std, quantile_cont(v, 0.05) AS p5, quantile_cont(v, 0.95) AS p95 FROM g),
    f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q) """
step("cln_out_iqr_remove", FENCES + f"SELECT {KEYS}, round(v, 4) AS v FROM g, f WHERE v IS NULL OR v BETWEEN lo AND hi",
     spiky, "handle_outliers", "v", {"method": "iqr_remove"})
step("cln_out_cap", FENCES + f"SELECT {KEYS}, round(CASE WHEN v < lo THEN lo WHEN v > hi THEN hi ELSE v END, 4) AS v FROM g, f",
     spiky, "handle_outliers", "v", {"method": "cap"})
step("cln_out_zscore", FENCES + f"SELECT {KEYS}, round(v, 4) AS v FROM g, f WHERE v IS NULL OR abs((v - mean) / std) <= 3",
     spiky, "handle_outliers", "v", {"method": "zscore_remove"})
step("cln_out_winsorize", FENCES + f"SELECT {KEYS}, round(CASE WHEN v < p5 THEN p5 WHEN v > p95 THEN p95 ELSE v END, 4) AS v FROM g, f",
     spiky, "handle_outliers", "v", {"method": "winsorize"})
step("cln_out_median", FENCES + f"SELECT {KEYS}, round(CASE WHEN v BETWEEN lo AND hi THEN v ELSE med END, 4) AS v FROM g, f",
     spiky, "handle_outliers", "v", {"method": "replace_median"})

_CUST = lambda t: t.customer.select("c_custkey", F.concat(F.lit(" "), F.lower("c_mktsegment"), F.lit(" ")).alias("s"))
_STEPS = [{"op": "string_op", "column": "s", "params": p} for p in (
    {"op": "trim"}, {"op": "title"}, {"op": "replace", "find": "e", "replace": "3"},
    {"op": "regex_replace", "pattern": "[aiou]", "replace": "*"}, {"op": "upper"}, {"op": "lower"},
    {"op": "split", "separator": "*", "index": 0})]


@query("cln_string", """SELECT c_custkey, string_split(lower(regexp_replace(replace(upper(c_mktsegment[1]) || lower(c_mktsegment[2:]),
    'e', '3'), '[aiou]', '*', 'g')), '*')[1] AS s FROM customer""")
def _(t):
    return cleaning.replay(_CUST(t), _STEPS)


step("cln_merge", "SELECT n_nationkey, n_name, n_regionkey, n_name || '/' || n_regionkey AS place FROM nation",
     lambda t: t.nation, "merge_columns", None, {"columns": ["n_name", "n_regionkey"], "separator": "/", "new_name": "place"})
step("cln_date_part", """SELECT o_orderkey, o_orderdate, CAST(quarter(o_orderdate) AS INTEGER) AS o_orderdate_quarter FROM orders""",
     lambda t: t.orders.select("o_orderkey", "o_orderdate"), "date_extract", "o_orderdate", {"part": "quarter"})
step("cln_one_hot", "SELECT o_orderkey, " + ", ".join(
    f"CASE WHEN o_orderstatus = '{s}' THEN 1 ELSE 0 END AS o_orderstatus_{s}" for s in "FOP") + " FROM orders",
     lambda t: t.orders.select("o_orderkey", "o_orderstatus"), "one_hot_encode", "o_orderstatus")
step("cln_label", """SELECT p_partkey, c.code AS p_brand FROM part JOIN (SELECT p_brand, dense_rank() OVER (ORDER BY p_brand) - 1 AS code
    FROM (SELECT DISTINCT p_brand FROM part)) c USING (p_brand)""",
     lambda t: t.part.select("p_partkey", "p_brand"), "label_encode", "p_brand")
step("cln_scale", f"WITH g AS ({GAPPY_SQL}) SELECT {KEYS}, round((v - (SELECT avg(v) FROM g)) / (SELECT stddev_pop(v) FROM g), 4) + 0.0 AS v FROM g",
     gappy, "scale_standard", "v")
step("cln_minmax", f"""WITH g AS ({GAPPY_SQL}) SELECT {KEYS}, round((v - (SELECT min(v) FROM g)) / (SELECT max(v) - min(v) FROM g), 6) AS v FROM g""",
     gappy, "normalize_minmax", "v", digits=6)
step("cln_log", f"SELECT {KEYS}, round(ln(1 + greatest(v, 0)), 6) AS v FROM ({GAPPY_SQL}) WHERE v IS NOT NULL UNION ALL "
     f"SELECT {KEYS}, NULL FROM ({GAPPY_SQL}) WHERE v IS NULL", gappy, "log_transform", "v", digits=6)
step("cln_rename", "SELECT r_regionkey, r_name AS region FROM region", lambda t: t.region, "rename_column", "r_name", {"to": " region "})


@query("cln_replay", FENCES + """, c AS (SELECT event_id, event_type, CASE WHEN v < lo THEN lo WHEN v > hi THEN hi ELSE v END AS v FROM g, f),
    m AS (SELECT median(v) AS med FROM c)
    SELECT event_id, upper(event_type) AS kind, round(coalesce(v, med), 4) AS v FROM c, m""")
def _(t):
    work = cleaning.Workspace(spiky(t).select("event_id", "event_type", "v"))
    work.apply({"op": "handle_outliers", "column": "v", "params": {"method": "cap"}})
    work.apply({"op": "drop_column", "column": "event_type"})
    work.undo()
    work.apply({"op": "fill_missing", "column": "v", "params": {"method": "median"}})
    work.apply({"op": "string_op", "column": "event_type", "params": {"op": "upper"}})
    out = work.apply({"op": "rename_column", "column": "event_type", "params": {"to": "kind"}})
    return out.withColumn("v", F.round("v", 4))


def profile_sql(source: str, kinds: dict[str, str]) -> str:
    """One line of counts per column; only SQL aggregates."""
    lines = []
    for i, (c, kind) in enumerate(kinds.items()):
        lines.append(f"""SELECT {i} AS position, '{c}' AS name, '{kind}' AS semantic_type, count(*) - count({c}) AS missing,
            round((count(*) - count({c})) / count(*) * 100, 2) AS missing_pct, count(DISTINCT {c}) AS "unique",
            round(count(DISTINCT {c}) / count(*) * 100, 2) AS unique_pct,
            count(DISTINCT {c}) / count(*) >= 0.95 AND count(*) = count({c}) AS is_probable_id FROM ({source})""")
    return " UNION ALL ".join(lines)


EVENT_KINDS = {"event_id": "numeric", "user_id": "numeric", "event_type": "categorical", "ts": "datetime", "v": "numeric"}
_CP = ("position", "name", "semantic_type", "missing", "missing_pct", "unique", "unique_pct", "is_probable_id")
CP_SQL = profile_sql(SPIKY_SQL, EVENT_KINDS)


@query("cln_preview", CP_SQL)
def _(t):
    columns, _, _ = cleaning.preview(spiky(t), ["event_id"])
    return columns.select(*_CP)


@query("prf_columns", CP_SQL)
def _(t):
    return Profile(spiky(t)).columns.select(*_CP)


def numeric_sql(source: str, names) -> str:
    return " UNION ALL ".join(f"""SELECT '{c}' AS name, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max,
        round(avg({c}), 4) AS mean, round(median({c}), 4) AS median, round(stddev_samp({c}), 4) AS std,
        round(skewness({c}), 4) AS skew, round(quantile_cont({c}, 0.25), 4) AS q1, round(quantile_cont({c}, 0.75), 4) AS q3,
        count(*) FILTER (WHERE {c} < lo OR {c} > hi) AS outliers,
        round(count(*) FILTER (WHERE {c} < lo OR {c} > hi) / count({c}) * 100, 2) AS outlier_pct,
        count(*) FILTER (WHERE {c} = 0) AS zeros, count(*) FILTER (WHERE {c} < 0) AS negatives
        FROM ({source}), (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM
          (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM ({source})))""" for c in names)


NUMERIC_SQL = numeric_sql(SPIKY_SQL, ("event_id", "user_id", "v"))


@query("prf_numeric", NUMERIC_SQL)
def _(t):
    rounded = [F.round(c, 4).alias(c) for c in ("mean", "median", "std", "skew", "q1", "q3")]
    return Profile(spiky(t)).columns.where("semantic_type = 'numeric'").select(
        "name", "min", "max", *rounded, "outliers", "outlier_pct", "zeros", "negatives")


def labelled_docs(t: Tables):
    return t.documents.join(t.labels, "doc_id", "left").select(
        "lang", "source", (F.col("n_chars") % 10).alias("size"), F.col("quality").alias("q"))


LABELLED_SQL = "SELECT lang, source, n_chars % 10 AS size, quality AS q FROM documents LEFT JOIN labels USING (doc_id)"


@query("prf_summary", f"""WITH g AS ({LABELLED_SQL}), d AS (SELECT count(*) AS n FROM (SELECT DISTINCT * FROM g))
    SELECT count(*) AS rows, CAST(4 AS BIGINT) AS columns, CAST(count(*) - max(d.n) AS BIGINT) AS duplicate_rows,
      round((count(*) - max(d.n)) / count(*) * 100, 2) AS duplicate_pct, count(*) - count(q) AS total_missing_cells,
      CAST(2 AS BIGINT) AS numeric_columns FROM g, d""")
def _(t):
    return Profile(labelled_docs(t)).summary().drop("bytes")


@query("prf_size", """SELECT CAST(sum(strlen(text)) + sum(strlen(lang)) + sum(strlen(source)) + 16 * count(*) AS BIGINT) AS bytes FROM documents""")
def _(t):
    return Profile(t.documents).summary().select("bytes")


def top_sql(source: str, names, k: int = 10) -> str:
    parts = " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", CAST({c} AS VARCHAR) AS value, count(*) AS count FROM ({source}) WHERE {c} IS NOT NULL GROUP BY 2"""
        for c in names)
    return f"""SELECT "column", value, count, round(count / (SELECT count(*) FROM ({source})) * 100, 2) AS pct, CAST(rank AS INTEGER) AS rank FROM
        (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY count DESC, value) AS rank FROM ({parts})) WHERE rank <= {k}"""


@query("prf_top_values", top_sql(LABELLED_SQL, ("lang", "source")))
def _(t):
    return Profile(labelled_docs(t)).top_values()


@query("prf_datetime", """SELECT 'o_orderdate' AS "column", CAST(min(o_orderdate) AS TIMESTAMP) AS min_date,
    CAST(max(o_orderdate) AS TIMESTAMP) AS max_date FROM orders""")
def _(t):
    text = t.orders.select("o_custkey", F.date_format("o_orderdate", "MMM d, yyyy").alias("o_orderdate"))
    return Profile(text).datetimes()


@query("prf_corr", pairs_sql(LINE_SQL, LINE_NUMBERS, 3))
def _(t):
    held = line_amounts(t).select(*LINE_NUMBERS, "l_returnflag")
    return Profile(held).correlations().withColumn("corr", F.col("corr") + 0.0)


@query("prf_missing", f"""SELECT name AS "column", missing, missing_pct FROM ({CP_SQL}) WHERE missing > 0""")
def _(t):
    return Profile(spiky(t)).missing_report()


@query("prf_types", f"SELECT semantic_type, count(*) AS columns FROM ({CP_SQL}) GROUP BY 1")
def _(t):
    return Profile(spiky(t)).type_counts()


@query("prf_categorical", f"""SELECT t."column", p."unique", t.value, t.count, t.pct, t.rank FROM ({top_sql(LABELLED_SQL, ("lang", "source"))}) t
    JOIN (SELECT 'lang' AS c, count(DISTINCT lang) AS "unique" FROM documents UNION ALL SELECT 'source', count(DISTINCT source) FROM documents) p
    ON p.c = t."column" """)
def _(t):
    return Profile(labelled_docs(t)).categorical()


@query("prf_keys", f"""SELECT position, name AS "column" FROM ({CP_SQL}) WHERE is_probable_id""")
def _(t):
    return Profile(spiky(t)).keys()


@query("prf_dates", f"""SELECT position, name AS "column" FROM ({CP_SQL}) WHERE semantic_type = 'datetime'""")
def _(t):
    return Profile(spiky(t)).dates()


ORDER_KINDS = {"o_orderkey": "numeric", "o_custkey": "numeric", "o_orderstatus": "categorical", "o_totalprice": "numeric",
               "o_orderdate": "datetime", "o_orderpriority": "categorical"}
ORDER_CP_SQL = profile_sql("SELECT * FROM orders", ORDER_KINDS)
TARGETS_SQL = f"""SELECT position, name AS "column", CASE WHEN semantic_type IN ('categorical', 'boolean') THEN 'classification' ELSE 'regression' END
      AS task, CAST(CASE WHEN regexp_matches(lower(name), '{"|".join(TARGET_WORDS)}') THEN 0.75
        WHEN semantic_type = 'categorical' AND "unique" BETWEEN 2 AND 10 THEN 0.6
        WHEN semantic_type = 'numeric' AND unique_pct > 5 THEN 0.5 END AS DOUBLE) AS confidence
    FROM ({ORDER_CP_SQL}) WHERE NOT is_probable_id AND missing_pct <= 40"""
TARGETS_SQL = f"SELECT * FROM ({TARGETS_SQL}) WHERE confidence IS NOT NULL ORDER BY confidence DESC, position LIMIT 5"


@query("prf_targets", TARGETS_SQL)
def _(t):
    return Profile(t.orders).target_suggestions()


def quality_sql(columns: str, numeric: str, source: str) -> str:
    return f"""WITH c AS ({columns}), m AS ({numeric}), g AS ({source}),
    p AS (SELECT greatest(0, 100 - (SELECT avg(missing_pct) FROM c)) AS completeness,
      greatest(0, 100 - (SELECT avg(outlier_pct) FROM m)) AS validity,
      100 - least(20, (SELECT count(*) FROM c WHERE semantic_type = 'text') * 2.0) AS consistency,
      100 - (SELECT (count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM g))) / count(*) * 100 FROM g) AS uniqueness),
    s AS (SELECT *, round(0.4 * completeness + 0.25 * uniqueness + 0.2 * validity + 0.15 * consistency, 1) AS score FROM p)
    SELECT CAST(score AS DOUBLE) AS score, CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C'
      WHEN score >= 60 THEN 'D' ELSE 'F' END AS grade, CAST(round(completeness, 1) AS DOUBLE) AS completeness,
      CAST(round(uniqueness, 1) AS DOUBLE) AS uniqueness, CAST(round(validity, 1) AS DOUBLE) AS validity,
      CAST(round(consistency, 1) AS DOUBLE) AS consistency FROM s"""


QUALITY_SQL = quality_sql(CP_SQL, NUMERIC_SQL, SPIKY_SQL)


@query("prf_quality", QUALITY_SQL)
def _(t):
    return Profile(spiky(t)).quality()


@query("prf_sample", "SELECT * FROM documents ORDER BY doc_id LIMIT 20")
def _(t):
    return Profile(t.documents).sample(["doc_id"], 20)


@query("prf_column_meta", f'SELECT name, semantic_type, "unique", missing_pct FROM ({CP_SQL})')
def _(t):
    return Profile(spiky(t)).column_meta()


@query("cln_catalog")
def _(t):
    # The operations that apply to each column of a table.
    kinds = Profile(t.orders).columns.select("name", "semantic_type")
    fits = F.when(F.col("op").isin("handle_outliers", "scale_standard", "normalize_minmax", "log_transform"), "numeric").when(
        F.col("op") == "date_extract", "datetime")
    catalog = cleaning.catalog(t.spark).withColumn("kind", fits)
    return kinds.join(catalog, F.col("kind").isNull() | (F.col("kind") == F.col("semantic_type"))).drop("kind")
