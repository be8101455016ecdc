"""Queries for sources, projections, filters, joins, aggregates, windows, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grainfold.functions import columns as fc
from grainfold.functions.columns import ref
from grainfold.operators import frames, ordering, stats, windows
from grainfold.operators.profile import Profile
from grainfold.plans.base import Tables, query
from grainfold.session import scratch_path
from grainfold.sources import catalog, readers, sinks

EVENTS_SQL = "SELECT *, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS v FROM events"


def gappy_events(t: Tables) -> DataFrame:
    """Events whose value is missing in every seventh row."""
    return t.events.withColumn("v", F.when(F.col("event_id") % 7 != 0, F.col("value")))


def sql(t: Tables, text: str, *names: str) -> DataFrame:
    catalog.register([(n, getattr(t, n)) for n in names])
    return t.spark.sql(text)


def same_sql(name: str, text: str, *tables: str, check: str | None = None) -> None:
    """A query given as one SQL text that both engines understand."""
    query(name, check or text)(lambda t: sql(t, text, *tables))


# --- sources and sinks -------------------------------------------------------------

@query("src_csv", "SELECT event_id, round(v, 4) AS v, user_id, event_type FROM (" + EVENTS_SQL + ")")
def _(t):
    path = scratch_path(t.spark, "csv")
    sinks.export_csv(gappy_events(t).select("event_id", "v", "user_id", "event_type"), path)
    return readers.load(t.spark, path, "csv").withColumn("v", F.round("v", 4))


@query("src_json", "SELECT conv_id, turn, role, text FROM conversations")
def _(t):
    path = scratch_path(t.spark, "json")
    t.conversations.write.json(path)
    return readers.load(t.spark, path, "json", lines=True).select("conv_id", "turn", "role", "text")


@query("src_flatten", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS \"props.k\" FROM events")
def _(t):
    return readers.expand_json(t.events.select("event_id", "props"), "props", "struct<k:bigint>")


@query("src_normalize", "SELECT r_regionkey, r_name FROM region")
def _(t):
    return readers.normalize(t.region.toDF(" r_regionkey ", "r_name  "))


@query("src_detect", "SELECT doc_id, n_chars FROM documents")
def _(t):
    return readers.load(t.spark, f"{t.folder}/documents.parquet").select("doc_id", "n_chars")


@query("src_parquet", "SELECT l_orderkey, l_quantity, l_shipdate FROM lineitem WHERE l_quantity >= 25")
def _(t):
    return readers.load(t.spark, f"{t.folder}/lineitem.parquet").where("l_quantity >= 25").select(
        "l_orderkey", "l_quantity", "l_shipdate")


@query("src_register", """
    SELECT count(*) AS n, round(sum(a.o_totalprice), 2) AS total
    FROM orders a JOIN customer b ON a.o_custkey = b.c_custkey""")
def _(t):
    views = list(catalog.register([("Sales 2024!", t.orders), ("sales_2024", t.customer)]))
    return t.spark.sql(
        f"SELECT count(*) AS n, round(sum(a.o_totalprice), 2) AS total FROM {views[0]} a "
        f"JOIN {views[1]} b ON a.o_custkey = b.c_custkey")


@query("src_catalog", """
    SELECT 'orders' AS name, 'orders' AS view, (SELECT count(*) FROM orders) AS rows, 6 AS columns
    UNION ALL SELECT 'region', 'region', (SELECT count(*) FROM region), 2""")
def _(t):
    entries = [
        {"name": n, "view": n, "status": s, "created": i, "rows": getattr(t, n).count(),
         "columns": len(getattr(t, n).columns)}
        for i, (n, s) in enumerate((("orders", "ready"), ("part", "error"), ("region", "ready")))
    ]
    return catalog.list_datasets(t.spark, entries).select("name", "view", "rows", "columns")


@query("snk_commit", "SELECT event_id, round(v, 4) AS v FROM (" + EVENTS_SQL + ") WHERE v IS NOT NULL")
def _(t):
    path = scratch_path(t.spark, "commit")
    sinks.commit(gappy_events(t).na.drop(subset=["v"]), path)
    return t.spark.read.parquet(f"{path}/data").select("event_id", F.round("v", 4).alias("v"))


@query("snk_export", "SELECT doc_id, text, lang FROM documents")
def _(t):
    path = scratch_path(t.spark, "export")
    sinks.export_csv(t.documents.select("doc_id", "text", "lang"), path)
    return t.spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"',
                            schema="doc_id bigint, text string, lang string")


@query("snk_ddl", """SELECT 'CREATE TABLE "customer" (' || chr(10) || string_agg(line, ',' || chr(10) ORDER BY p)
    || chr(10) || ');' AS ddl FROM (VALUES (0, '  "c_custkey" DOUBLE PRECISION'), (1, '  "c_name" TEXT'),
    (2, '  "c_nationkey" DOUBLE PRECISION'), (3, '  "c_acctbal" DOUBLE PRECISION'),
    (4, '  "c_mktsegment" VARCHAR(255)')) v(p, line)""")
def _(t):
    return sinks.table_definition(Profile(t.customer), "customer")


# --- projections and filters ---------------------------------------------------------

@query("prj_select", "SELECT c_mktsegment, c_acctbal FROM customer")
def _(t):
    return frames.select_once(t.customer, ["c_mktsegment", "c_acctbal", "c_mktsegment"])


@query("prj_drop", "SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer")
def _(t):
    return frames.drop(t.customer, "c_mktsegment")


@query("prj_rename", "SELECT r_regionkey, r_name AS region FROM region")
def _(t):
    return frames.rename(t.region, "r_name", "region")


@query("prj_numeric_coerce", """
    SELECT o_orderkey, TRY_CAST(CASE WHEN o_orderkey % 11 = 0 THEN 'x' ELSE CAST(o_custkey AS VARCHAR) END AS DOUBLE) AS n
    FROM orders""")
def _(t):
    text = F.when(F.col("o_orderkey") % 11 == 0, "x").otherwise(F.col("o_custkey").cast("string"))
    return t.orders.select("o_orderkey", fc.to_number(text).alias("n"))


@query("flt_notnull", "SELECT event_id, v FROM (" + EVENTS_SQL + ") WHERE v IS NOT NULL")
def _(t):
    return gappy_events(t).select("event_id", "v").na.drop(subset=["v"])


@query("flt_range", "SELECT event_id, v FROM (" + EVENTS_SQL + ") WHERE v IS NULL OR v BETWEEN 5 AND 20")
def _(t):
    return frames.within(gappy_events(t).select("event_id", "v"), "v", 5, 20)


@query("flt_isin_top", """
    SELECT p_partkey, p_brand FROM part WHERE p_brand IN
      (SELECT p_brand FROM part GROUP BY p_brand ORDER BY count(*) DESC, p_brand LIMIT 5)""")
def _(t):
    return frames.keep_top_categories(t.part, "p_brand", 5).select("p_partkey", "p_brand")


@query("flt_labelled", """
    SELECT CAST(quality IS NOT NULL AND trim(quality) <> '' AS BOOLEAN) AS labelled, count(*) AS n
    FROM (SELECT CASE WHEN d.doc_id % 9 = 0 THEN '  ' ELSE CAST(quality AS VARCHAR) END AS quality
          FROM documents d LEFT JOIN labels l USING (doc_id)) GROUP BY 1""")
def _(t):
    both = t.documents.join(t.labels, "doc_id", "left").withColumn(
        "quality", F.when(F.col("doc_id") % 9 == 0, "  ").otherwise(F.col("quality").cast("string")))
    labelled, rest = frames.split_labelled(both, "quality")
    return labelled.select(F.lit(True).alias("labelled")).unionByName(
        rest.select(F.lit(False).alias("labelled"))).groupBy("labelled").agg(F.count("*").alias("n"))


same_sql("flt_sql", """
    SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'big' ELSE 'small' END AS size
    FROM orders o WHERE o_orderpriority LIKE '1%' AND o_orderstatus IN ('O', 'F')
      AND o_totalprice BETWEEN 50000 AND 400000
      AND EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey AND c.c_acctbal > 0)""",
         "orders", "customer")


# --- joins -----------------------------------------------------------------------------

for _how, _kind in (("inner", "JOIN"), ("left", "LEFT JOIN"), ("right", "RIGHT JOIN"), ("full", "FULL JOIN")):
    def _join(t, how=_how):
        rich = t.customer.where("c_acctbal > 3000").select("c_custkey", "c_name")
        big = t.orders.where("o_totalprice > 200000").select("o_orderkey", "o_custkey", "o_totalprice")
        return big.join(rich, F.col("o_custkey") == F.col("c_custkey"), how)

    query(f"join_{_how}", f"""
        SELECT o_orderkey, o_custkey, o_totalprice, c_custkey, c_name
        FROM (SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_totalprice > 200000)
        {_kind} (SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 3000) ON o_custkey = c_custkey""")(_join)

same_sql("join_theta", """
    SELECT l_orderkey, l_linenumber, l_partkey, o_orderdate, l_shipdate FROM lineitem
    JOIN orders ON l_orderkey = o_orderkey AND l_shipdate > o_orderdate AND l_extendedprice * 10 > o_totalprice""",
         "lineitem", "orders")


@query("join_semi", """
    SELECT c_custkey, c_name FROM customer
    WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)""")
def _(t):
    return t.customer.join(t.orders.where("o_totalprice > 400000"), F.col("c_custkey") == F.col("o_custkey"),
                           "left_semi").select("c_custkey", "c_name")


@query("join_anti", """
    SELECT c_custkey, c_name FROM customer
    WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)""")
def _(t):
    return t.customer.join(t.orders.where("o_totalprice > 400000"), F.col("c_custkey") == F.col("o_custkey"),
                           "left_anti").select("c_custkey", "c_name")


same_sql("join_natural", """
    SELECT doc_id, lang, quality FROM (SELECT doc_id, lang FROM documents)
    NATURAL JOIN (SELECT doc_id, quality FROM labels)""", "documents", "labels")
same_sql("join_using", "SELECT doc_id, lang, toxic FROM documents LEFT JOIN labels USING (doc_id)",
         "documents", "labels")
same_sql("join_self", """
    SELECT a.conv_id, a.turn, CAST(length(b.text) - length(a.text) AS BIGINT) AS growth FROM conversations a
    JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""", "conversations")
same_sql("join_correlated", """
    SELECT o_orderkey, round(o_totalprice, 2) AS price FROM orders o
    WHERE o_totalprice > (SELECT avg(i.o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)""", "orders")


@query("join_lookup", """
    SELECT p_partkey, round(f.n / t.n, 6) AS p_brand_freq FROM part
    JOIN (SELECT p_brand, count(*) AS n FROM part GROUP BY 1) f USING (p_brand)
    CROSS JOIN (SELECT count(*) AS n FROM part) t""")
def _(t):
    return frames.frequency_encode(t.part, "p_brand").select("p_partkey", F.round("p_brand_freq", 6).alias("p_brand_freq"))


# --- aggregates ------------------------------------------------------------------------

for _agg, _fn in (("mean", "avg(v)"), ("sum", "sum(v)"), ("count", "count(*)"), ("median", "median(v)"),
                  ("min", "min(v)"), ("max", "max(v)")):
    def _grouped(t, agg=_agg):
        out = stats.aggregate(gappy_events(t), ["event_type"], "v", agg)
        return out if agg == "count" else out.withColumn("value", F.round("value", 4))

    query("agg_group_" + _agg, f"""SELECT event_type, {'count(*)' if _agg == 'count' else f'round({_fn}, 4)'} AS value
        FROM ({EVENTS_SQL}) {'' if _agg == 'count' else 'WHERE v IS NOT NULL'} GROUP BY event_type""")(_grouped)


@query("agg_global", """
    SELECT round(sum(v), 2) AS sum, round(avg(v), 4) AS mean, count(v) AS count, round(min(v), 4) AS min,
           round(max(v), 4) AS max, round(median(v), 4) AS median FROM (""" + EVENTS_SQL + ")")
def _(t):
    from grainfold.operators import analyst

    row = analyst.number_summary(gappy_events(t), "v")
    return row.select(F.round("sum", 2).alias("sum"), "count",
                      *[F.round(c, 4).alias(c) for c in ("mean", "min", "max", "median")])


@query("agg_count_distinct", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS distinct_values FROM orders"
    for c in ("o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")))
def _(t):
    return stats.distinct_counts(t.orders, ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate"]).select(
        F.col("c").alias("column"), F.col("u").alias("distinct_values"))


_QUANTILES_SQL = """
    SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.25), 4) AS q1,
           round(quantile_cont(l_extendedprice, 0.5), 4) AS q2, round(quantile_cont(l_extendedprice, 0.9), 4) AS q3
    FROM lineitem GROUP BY l_returnflag"""


@query("agg_quantile", _QUANTILES_SQL)
def _(t):
    q = stats.quantiles(t.lineitem, {"q": ref("l_extendedprice")}, [0.25, 0.5, 0.9], by=["l_returnflag"])
    return q.select("l_returnflag", *[F.round(F.col("q")[i], 4).alias(f"q{i + 1}") for i in range(3)])


@query("agg_quantile_ranked", _QUANTILES_SQL)
def _(t):
    q = stats.quantiles(t.lineitem, {"q": ref("l_extendedprice")}, [0.25, 0.5, 0.9], by=["l_returnflag"],
                        distinct_limit=0, bins=64)
    return q.select("l_returnflag", *[F.round(F.col("q")[i], 4).alias(f"q{i + 1}") for i in range(3)])


@query("agg_mode", """SELECT lang, source, n FROM (
    SELECT lang, source, count(*) AS n, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, source) AS r
    FROM documents GROUP BY 1, 2) WHERE r = 1""")
def _(t):
    counted = t.documents.groupBy("lang", "source").agg(F.count("*").alias("n"))
    best = counted.groupBy("lang").agg(F.max(F.struct("n")).alias("m"), F.min_by("source", F.struct(-F.col("n"), "source")).alias("source"))
    return best.select("lang", "source", F.col("m.n").alias("n"))


@query("agg_std_skew", """
    SELECT event_type, round(stddev_samp(v), 4) AS std, round(stddev_pop(v), 4) AS std_pop,
           round(skewness(v), 4) AS skew FROM (""" + EVENTS_SQL + ") GROUP BY event_type")
def _(t):
    return gappy_events(t).groupBy("event_type").agg(
        F.round(F.stddev_samp("v"), 4).alias("std"), F.round(F.stddev_pop("v"), 4).alias("std_pop"),
        F.round(stats.sample_skewness(F.col("v")), 4).alias("skew"))


_PAIRS = [("l_quantity", "l_extendedprice"), ("l_quantity", "x"), ("l_extendedprice", "x")]
_PAIR_SQL = "SELECT *, CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE l_quantity * l_discount END AS x FROM lineitem"


@query("agg_corr", " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 5) AS corr FROM ({_PAIR_SQL})" for a, b in _PAIRS))
def _(t):
    df = t.lineitem.withColumn("x", F.when(F.col("l_orderkey") % 5 != 0, F.col("l_quantity") * F.col("l_discount")))
    names = ("l_quantity", "l_extendedprice", "x")
    return stats.correlation_pairs(df, {n: ref(n) for n in names}).withColumn("corr", F.round("corr", 5))


def histogram_sql(source: str, value: str, bins: str, digits: int = 4) -> str:
    """Twelve-line check for equal-width bins with the right edge inside."""
    return f"""
    WITH d AS (SELECT CAST({value} AS DOUBLE) AS x FROM {source} WHERE {value} IS NOT NULL),
    m AS (SELECT min(x) AS lo, max(x) AS hi, {bins} AS k FROM d),
    b AS (SELECT least(floor((x - lo) / ((hi - lo) / k)), k - 1) AS bin FROM d, m),
    g AS (SELECT unnest(range(0, (SELECT CAST(k AS BIGINT) FROM m))) AS bin)
    SELECT CAST(g.bin AS INTEGER) AS bin, round(lo + g.bin * ((hi - lo) / k), {digits}) AS lower,
           round(lo + (g.bin + 1) * ((hi - lo) / k), {digits}) AS upper, count(b.bin) AS count
    FROM g CROSS JOIN m LEFT JOIN b ON b.bin = g.bin GROUP BY ALL"""


def rounded_bins(df: DataFrame) -> DataFrame:
    return df.withColumn("lower", F.round("lower", 4)).withColumn("upper", F.round("upper", 4))


@query("agg_histogram", histogram_sql("lineitem", "l_extendedprice", "12"))
def _(t):
    return rounded_bins(stats.histogram(t.lineitem, ref("l_extendedprice"), 12))


@query("agg_crosstab", """
    SELECT o_orderpriority AS a, o_orderstatus AS b, count(*) AS n,
           round((SELECT sum(m) / (SELECT count(*) FROM orders) FROM (SELECT max(c) AS m FROM
             (SELECT o_orderpriority, o_orderstatus, count(*) AS c FROM orders GROUP BY 1, 2) GROUP BY o_orderpriority)), 6) AS purity
    FROM orders GROUP BY 1, 2""")
def _(t):
    table = frames.crosstab(t.orders, "o_orderpriority", "o_orderstatus")
    return table.withColumn("purity", F.round(F.lit(frames.purity(table)), 6))


@query("agg_month", "SELECT strftime(o_orderdate, '%Y-%m') AS period, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1")
def _(t):
    return frames.by_month(t.orders, "o_orderdate", "o_totalprice", "sum").withColumn("value", F.round("value", 2))


HIERARCHY_SQL = """
    SELECT r_name, n_name, c_mktsegment, depth, round(total, 2) AS total FROM (
      SELECT r_name, n_name, c_mktsegment, 3 - (CASE grouping_id(r_name, n_name, c_mktsegment)
               WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 3 THEN 2 ELSE 3 END) AS depth, sum(c_acctbal) AS total
      FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
      GROUP BY ROLLUP (r_name, n_name, c_mktsegment)) WHERE depth > 0"""


def placed_customers(t: Tables) -> DataFrame:
    return (t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .join(t.region, F.col("n_regionkey") == F.col("r_regionkey")))


@query("agg_rollup_path", HIERARCHY_SQL)
def _(t):
    path = ["r_name", "n_name", "c_mktsegment"]
    out = frames.rollup_path(placed_customers(t), path, F.sum("c_acctbal"), "total")
    return out.select(*path, "depth", F.round("total", 2).alias("total"))


@query("agg_duplicates", """
    SELECT CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_returnflag, l_linestatus, l_quantity, l_tax FROM lineitem))
      AS BIGINT) AS duplicate_rows FROM lineitem""")
def _(t):
    return stats.duplicate_rows(t.lineitem.select("l_returnflag", "l_linestatus", "l_quantity", "l_tax"))


same_sql("agg_having", """
    SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders
    GROUP BY o_custkey HAVING count(*) > 10 AND sum(o_totalprice) > 2000000""", "orders")
same_sql("agg_filter", """
    SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS finished,
           round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'O'), 2) AS open_total
    FROM orders GROUP BY o_orderpriority""", "orders")
same_sql("agg_distinct", """
    SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_partkey) AS parts
    FROM lineitem GROUP BY l_returnflag""", "lineitem")
same_sql("agg_concat", """
    SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey""",
         "nation", check="SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY 1")


# --- windows -----------------------------------------------------------------------------

@query("win_ffill", f"""SELECT event_id, round(last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4) AS v FROM ({EVENTS_SQL})""")
def _(t):
    filled = ordering.carry(gappy_events(t).select("event_id", "user_id", "v"), ["v"], ["event_id"], ["user_id"])
    return filled.select("event_id", F.round("v", 4).alias("v"))


@query("win_bfill", f"""SELECT event_id, round(first_value(v IGNORE NULLS) OVER (ORDER BY event_id
    ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 4) AS v FROM ({EVENTS_SQL})""")
def _(t):
    filled = ordering.carry(gappy_events(t).select("event_id", "v"), ["v"], ["event_id"], backward=True)
    return filled.select("event_id", F.round("v", 4).alias("v"))


@query("win_keep", """SELECT doc_id, lang, source FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r
    FROM documents) WHERE r = 1""")
def _(t):
    from grainfold.operators.cleaning import drop_duplicates

    return drop_duplicates(t.documents, "text", {"keep": "first", "order_by": "doc_id"}).select("doc_id", "lang", "source")


@query("win_index", "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS position FROM events")
def _(t):
    return ordering.add_position(t.events.select("event_id", "ts"), ["ts", "event_id"]).select("event_id", "position")


@query("win_split", """SELECT event_id, r <= floor(0.8 * n) AS is_train FROM (
    SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS r, count(*) OVER () AS n FROM events)""")
def _(t):
    return frames.time_split(t.events.select("event_id", "ts"), ["ts", "event_id"], 0.8).select("event_id", "is_train")


ROC_SQL = """
    WITH s AS (SELECT n_chars % 100 AS score, sum(quality) AS p, sum(1 - quality) AS f
               FROM documents JOIN labels USING (doc_id) GROUP BY 1)
    SELECT CAST(score AS DOUBLE) AS score, CAST(sum(p) OVER (ORDER BY score DESC) AS BIGINT) AS tp,
           CAST(sum(f) OVER (ORDER BY score DESC) AS BIGINT) AS fp FROM s"""


def scored_labels(t: Tables) -> DataFrame:
    return t.documents.join(t.labels, "doc_id").select(
        "doc_id", (F.col("n_chars") % 100).cast("double").alias("score"), F.col("quality").alias("label"))


@query("win_roc", ROC_SQL)
def _(t):
    from grainfold.operators.ml import metrics

    return metrics.roc_steps(scored_labels(t), "label", "score").select("score", "tp", "fp")


@query("win_topk", """SELECT lang, source, n, CAST(r AS INTEGER) AS rank FROM (
    SELECT lang, source, count(*) AS n, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, source) AS r
    FROM documents GROUP BY 1, 2) WHERE r <= 3""")
def _(t):
    counted = t.documents.groupBy("lang", "source").agg(F.count("*").alias("n"))
    w = Window.partitionBy("lang").orderBy(F.desc("n"), "source")
    return counted.withColumn("rank", F.row_number().over(w)).where("rank <= 3")


@query("win_prev_turn", """SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS)
    OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM conversations""")
def _(t):
    from grainfold.operators.text import previous_user_turn

    return previous_user_turn(t.conversations).select("conv_id", "turn", "previous")


same_sql("win_sql", """
    SELECT o_orderkey, o_custkey,
      CAST(row_number() OVER w AS BIGINT) AS rn, CAST(rank() OVER w AS BIGINT) AS rk,
      CAST(dense_rank() OVER w AS BIGINT) AS dr, CAST(ntile(4) OVER w AS BIGINT) AS quarter,
      round(percent_rank() OVER w, 6) AS pr, round(cume_dist() OVER w, 6) AS cd,
      lag(o_totalprice, 1) OVER w AS before, lead(o_totalprice, 1) OVER w AS after,
      first_value(o_orderkey) OVER w AS first_key,
      nth_value(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey
        ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second_key,
      round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey
        ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS last3,
      round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate
        RANGE BETWEEN INTERVAL '90' DAY PRECEDING AND CURRENT ROW), 4) AS quarter_mean
    FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""", "orders")


def framed_sql(excludes: dict[str, str], frame: str) -> str:
    columns = ", ".join(f"round({fn}(o_totalprice) OVER (PARTITION BY o_orderpriority ORDER BY CAST(o_orderdate AS DATE) {frame} {exclude}), 2) AS {fn}_{name}"
                        for name, exclude in excludes.items() for fn in ("sum", "count", "min", "max"))
    return f"SELECT o_orderkey, {columns} FROM orders"


def framed_orders(t, excludes: dict[str, str], start, end) -> DataFrame:
    out = t.orders.select("o_orderkey", "o_orderpriority", "o_totalprice", F.col("o_orderdate").cast("date").alias("day"))
    for name, exclude in excludes.items():
        measures = {f"{fn}_{name}": (fn, "o_totalprice") for fn in ("sum", "count", "min", "max")}
        out = windows.framed(out, measures, ["o_orderpriority"], ["day"], "groups", start, end, exclude.lower().removeprefix("exclude "))
    return out.select("o_orderkey", *[F.round(f"{fn}_{name}", 2).alias(f"{fn}_{name}") for name in excludes for fn in ("sum", "count", "min", "max")])


@query("win_groups", framed_sql({"near": ""}, "GROUPS BETWEEN 2 PRECEDING AND 1 FOLLOWING"))
def _(t):
    return framed_orders(t, {"near": "EXCLUDE NO OTHERS"}, -2, 1)


@query("win_groups_open", framed_sql({"upto": ""}, "GROUPS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"))
def _(t):
    return framed_orders(t, {"upto": "EXCLUDE NO OTHERS"}, None, -1)


EXCLUDES = {"others": "EXCLUDE CURRENT ROW", "groups": "EXCLUDE GROUP", "ties": "EXCLUDE TIES"}


@query("win_exclude", framed_sql(EXCLUDES, "GROUPS BETWEEN 2 PRECEDING AND 1 FOLLOWING"))
def _(t):
    return framed_orders(t, EXCLUDES, -2, 1)


# --- sorts, limits, samples ------------------------------------------------------------------

@query("srt_topn", "SELECT o_custkey, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def _(t):
    total = t.orders.groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("value"))
    return total.orderBy(F.desc("value"), "o_custkey").limit(10)


@query("srt_value_counts", "SELECT source AS value, count(*) AS count FROM documents GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def _(t):
    return stats.value_counts(t.documents, ["source"]).select("value", "count").orderBy(F.desc("count"), "value").limit(10)


LINE_NUMBERS = ("l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "amount")
LINE_SQL = "SELECT *, l_quantity * l_extendedprice AS amount FROM lineitem"


def line_amounts(t: Tables) -> DataFrame:
    return t.lineitem.withColumn("amount", F.col("l_quantity") * F.col("l_extendedprice"))


def pairs_sql(source: str, names, digits: int) -> str:
    return " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), {digits}) + 0.0 AS corr FROM ({source})"
        for i, a in enumerate(names) for b in names[i + 1:])


@query("srt_pairs", f"SELECT * FROM ({pairs_sql(LINE_SQL, LINE_NUMBERS, 4)}) ORDER BY abs(corr) DESC, a, b LIMIT 8")
def _(t):
    pairs = stats.correlation_pairs(line_amounts(t), {n: ref(n) for n in LINE_NUMBERS})
    return pairs.withColumn("corr", F.round("corr", 4) + 0.0).orderBy(F.desc(F.abs("corr")), "a", "b").limit(8)


@query("srt_bar", """SELECT p_brand, p_type, round(s, 2) AS value FROM (
    SELECT p_brand, p_type, sum(p_retailprice) AS s FROM part GROUP BY 1, 2) WHERE p_brand IN (
    SELECT p_brand FROM part GROUP BY 1 ORDER BY sum(p_retailprice) DESC, 1 LIMIT 7)""")
def _(t):
    from grainfold.operators import charts

    bars = charts.bar(t.part, "p_brand", "p_retailprice", "p_type", "sum", sort="desc", limit=7)
    return bars.select("p_brand", "p_type", F.round("value", 2).alias("value"))


@query("lim_head", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 20")
def _(t):
    return t.orders.orderBy("o_orderkey").limit(20)


@query("lim_sql", "SELECT o_orderkey, o_totalprice, true AS truncated FROM orders ORDER BY o_orderkey LIMIT 1000")
def _(t):
    catalog.register([("orders", t.orders)])
    result = catalog.run_sql(t.spark, "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey")
    return result.rows.withColumn("truncated", F.lit(result.truncated))


@query("lim_even", """WITH r AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS position, count(*) OVER () AS n FROM events)
    SELECT event_id, position FROM r WHERE position IN
      (SELECT CAST(floor(i * (n - 1) / 59.0) AS BIGINT) FROM (SELECT unnest(range(0, 60)) AS i), (SELECT max(n) AS n FROM r))""")
def _(t):
    return frames.even_sample(t.events.select("event_id"), ["event_id"], 60)


@query("smp_rows", "SELECT doc_id, lang FROM documents ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id LIMIT 100")
def _(t):
    return frames.stable_sample(t.documents, ["doc_id"], 100).select("doc_id", "lang")


@query("srt_table", """SELECT p_partkey, p_name, p_retailprice FROM part WHERE contains(lower(p_name), 'bolt')
    ORDER BY p_retailprice DESC, p_partkey LIMIT 8 OFFSET 8""")
def _(t):
    return frames.page(t.part.select("p_partkey", "p_name", "p_retailprice"), "p_name", "bolt",
                       [F.desc("p_retailprice"), F.col("p_partkey")], page=1, size=8)


# --- set operations ------------------------------------------------------------------------

@query("set_union_other", """WITH g AS (SELECT p_brand, sum(p_retailprice) AS v FROM part GROUP BY 1),
    r AS (SELECT *, row_number() OVER (ORDER BY v DESC, p_brand) AS r FROM g)
    SELECT CASE WHEN r < 10 THEN p_brand ELSE 'Other' END AS p_brand, round(sum(v), 2) AS value FROM r GROUP BY 1""")
def _(t):
    from grainfold.operators import charts

    return charts.pie(t.part, "p_brand", "p_retailprice", "sum").withColumn("value", F.round("value", 2))


@query("set_union_all", """SELECT doc_id, CAST(quality AS VARCHAR) AS label FROM labels UNION ALL
    SELECT doc_id, NULL FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def _(t):
    both = t.documents.select("doc_id").join(t.labels, "doc_id", "left").select("doc_id", F.col("quality").cast("string").alias("label"))
    labelled, rest = frames.split_labelled(both, "label")
    return labelled.unionByName(rest)


same_sql("set_sql", """
    (SELECT o_custkey AS k FROM orders WHERE o_totalprice > 300000 INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 1000)
    UNION ALL (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)
    UNION (SELECT s_suppkey FROM supplier)""", "orders", "customer", "supplier")
