"""Queries for scalar functions: text, casts, dates, numbers, names, JSON."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from grainfold.functions import columns as fc
from grainfold.plans.base import query
from grainfold.plans.relational import same_sql

NOISY_SQL = "SELECT c_custkey, ' ' || chr(9) || lower(c_mktsegment) || '-' || lower(c_name) || ' ' AS s FROM customer"


def noisy(t):
    return t.customer.select("c_custkey", F.concat(
        F.lit(" \t"), F.lower("c_mktsegment"), F.lit("-"), F.lower("c_name"), F.lit(" ")).alias("s"))


@query("str_trim", f"SELECT c_custkey, regexp_replace(s, '^\\s+|\\s+$', '', 'g') AS s FROM ({NOISY_SQL})")
def _(t):
    return noisy(t).withColumn("s", fc.strip(F.col("s")))


@query("str_lower", "SELECT c_custkey, lower(c_mktsegment) AS s FROM customer")
def _(t):
    return t.customer.select("c_custkey", F.lower("c_mktsegment").alias("s"))


@query("str_upper", f"SELECT c_custkey, upper(s) AS s FROM ({NOISY_SQL})")
def _(t):
    return noisy(t).withColumn("s", F.upper("s"))


@query("str_title", f"""
    SELECT c_custkey, list_aggregate(list_transform(regexp_extract_all(s, '[a-zA-Z]+|[^a-zA-Z]+'),
      lambda p: upper(p[1]) || lower(p[2:])), 'string_agg', '') AS s FROM ({NOISY_SQL})""")
def _(t):
    return noisy(t).withColumn("s", fc.title_case(F.col("s")))


@query("str_replace", "SELECT c_custkey, replace(c_name, '#', ' no ') AS s FROM customer")
def _(t):
    return t.customer.select("c_custkey", F.replace("c_name", F.lit("#"), F.lit(" no ")).alias("s"))


@query("str_regex", "SELECT c_custkey, regexp_replace(c_name, '(\\d)0+', '\\1_', 'g') AS s FROM customer")
def _(t):
    return t.customer.select("c_custkey", F.regexp_replace("c_name", r"(\d)0+", "$1_").alias("s"))


@query("str_split", """SELECT o_orderkey, string_split(o_orderpriority, '-')[2] AS second,
    string_split(o_orderpriority, '-')[-1] AS last, string_split(o_orderpriority, '-')[9] AS none,
    string_split_regex(o_orderpriority, '[- ]+')[3] AS by_pattern FROM orders""")
def _(t):
    c = F.col("o_orderpriority")
    return t.orders.select("o_orderkey", fc.split_at(c, "-", 1).alias("second"), fc.split_at(c, "-", -1).alias("last"),
                           fc.split_at(c, "-", 8).alias("none"), fc.split_at(c, "[- ]+", 2).alias("by_pattern"))


@query("str_concat", """SELECT doc_id, coalesce(lang, '') || '_' || coalesce(CAST(quality AS VARCHAR), '') AS s
    FROM documents LEFT JOIN labels USING (doc_id)""")
def _(t):
    both = t.documents.join(t.labels, "doc_id", "left")
    return both.select("doc_id", fc.concat_keep([F.col("lang"), F.col("quality")], "_").alias("s"))


BAD_NUMBER_SQL = "CASE WHEN o_orderkey % 11 = 0 THEN 'x' WHEN o_orderkey % 13 = 0 THEN '7.0' ELSE CAST(o_custkey AS VARCHAR) END"


def bad_numbers(t):
    s = F.when(F.col("o_orderkey") % 11 == 0, "x").when(F.col("o_orderkey") % 13 == 0, "7.0").otherwise(
        F.col("o_custkey").cast("string"))
    return t.orders.select("o_orderkey", s.alias("s"))


@query("cast_int", f"SELECT o_orderkey, CAST(TRY_CAST({BAD_NUMBER_SQL} AS DOUBLE) AS BIGINT) AS n FROM orders")
def _(t):
    return bad_numbers(t).select("o_orderkey", fc.to_integer(F.col("s"), T.StringType()).alias("n"))


@query("cast_float", f"SELECT o_orderkey, TRY_CAST({BAD_NUMBER_SQL} AS DOUBLE) AS n FROM orders")
def _(t):
    return bad_numbers(t).select("o_orderkey", fc.to_number(F.col("s")).alias("n"))


_WORD_SQL = "(['Yes', 'NO', ' t ', 'f', '1', '0', 'maybe', 'TRUE'])[CAST(event_id % 8 AS INTEGER) + 1]"


@query("cast_bool", f"""SELECT event_id, CASE WHEN lower(trim(w)) IN ('true', '1', 'yes', 'y', 't') THEN true
    WHEN lower(trim(w)) IN ('false', '0', 'no', 'n', 'f') THEN false END AS b FROM (SELECT event_id, {_WORD_SQL} AS w FROM events)""")
def _(t):
    words = F.array(*[F.lit(w) for w in ("Yes", "NO", " t ", "f", "1", "0", "maybe", "TRUE")])
    return t.events.select("event_id", fc.to_boolean(words[(F.col("event_id") % 8).cast("int")]).alias("b"))


@query("cast_date", "SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP) AS d FROM orders")
def _(t):
    text = t.orders.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"))
    return text.withColumn("d", fc.date_of(text, "d"))


@query("cast_string", "SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS s FROM orders")
def _(t):
    return t.orders.select("o_orderkey", F.col("o_custkey").cast("string").alias("s"))


@query("cast_category", "SELECT p_partkey, CAST(p_size AS VARCHAR) AS s FROM part")
def _(t):
    from grainfold.operators.cleaning import convert_type

    return convert_type(t.part.select("p_partkey", F.col("p_size").alias("s")), "s", {"to": "category"})


@query("dt_parse", """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE CAST(o_orderdate AS TIMESTAMP) END AS d FROM orders""")
def _(t):
    k, d = F.col("o_orderkey") % 5, F.col("o_orderdate")
    text = (F.when(k == 0, F.date_format(d, "M/d/yyyy")).when(k == 1, F.date_format(d, "MMM d, yyyy"))
            .when(k == 2, F.date_format(d, "yyyy-MM-dd HH:mm:ss")).when(k == 3, F.date_format(d, "d MMMM yyyy"))
            .otherwise("2024"))
    held = t.orders.select("o_orderkey", text.alias("d"))
    return held.withColumn("d", fc.date_of(held, "d"))


@query("dt_part", """SELECT event_id, CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month,
    CAST(quarter(ts) AS INTEGER) AS quarter, CAST(weekofyear(ts) AS INTEGER) AS week, CAST(day(ts) AS INTEGER) AS day,
    CAST(isodow(ts) - 1 AS INTEGER) AS dayofweek, CAST(hour(ts) AS INTEGER) AS hour FROM events""")
def _(t):
    return t.events.select("event_id", *[f("ts").alias(n) for n, f in fc.DATE_PARTS.items()])


@query("dt_calendar", """SELECT o_orderkey, CAST(isodow(o_orderdate) - 1 AS INTEGER) AS weekday,
    CASE WHEN isodow(o_orderdate) >= 6 THEN 1 ELSE 0 END AS is_weekend FROM orders""")
def _(t):
    d = F.col("o_orderdate")
    return t.orders.select("o_orderkey", F.weekday(d).alias("weekday"), fc.is_weekend(d).alias("is_weekend"))


@query("dt_month_label", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS m FROM orders")
def _(t):
    return t.orders.select("o_orderkey", fc.month_label(F.col("o_orderdate")).alias("m"))


@query("num_log1p", "SELECT c_custkey, round(ln(1 + greatest(c_acctbal, 0)), 6) AS v FROM customer")
def _(t):
    return t.customer.select("c_custkey", F.round(fc.log1p_floor0(F.col("c_acctbal")), 6).alias("v"))


@query("num_clip", "SELECT c_custkey, greatest(least(c_acctbal, 5000), 100.0) AS v FROM customer")
def _(t):
    return t.customer.select("c_custkey", fc.clip(F.col("c_acctbal"), 100.0, 5000.0).alias("v"))


@query("num_ratio", """SELECT l_orderkey, l_partkey, l_linenumber, round(l_tax / nullif(l_discount, 0), 6) AS r,
    round(l_quantity * l_extendedprice, 2) AS p FROM lineitem""")
def _(t):
    return t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber",
                             F.round(fc.ratio(F.col("l_tax"), F.col("l_discount")), 6).alias("r"),
                             F.round(F.col("l_quantity") * F.col("l_extendedprice"), 2).alias("p"))


@query("num_grade", """SELECT p_partkey, CASE WHEN p_size * 2 >= 90 THEN 'A' WHEN p_size * 2 >= 80 THEN 'B'
    WHEN p_size * 2 >= 70 THEN 'C' WHEN p_size * 2 >= 60 THEN 'D' ELSE 'F' END AS grade FROM part""")
def _(t):
    return t.part.select("p_partkey", fc.grade(F.col("p_size") * 2).alias("grade"))


@query("name_humanize", """SELECT n_nationkey, array_to_string(list_transform(list_filter(string_split_regex(
      regexp_replace(regexp_replace('sale_Price-of.' || lower(n_name) || 'Total', '[_\\-.]+', ' ', 'g'), '([a-z0-9])([A-Z])', '\\1 \\2', 'g'),
      '\\s+'), lambda w: w <> ''), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS label FROM nation""")
def _(t):
    name = F.concat(F.lit("sale_Price-of."), F.lower("n_name"), F.lit("Total"))
    return t.nation.select("n_nationkey", fc.humanize(name).alias("label"))


@query("name_slug", """SELECT page_id, coalesce(nullif(lower(trim(regexp_replace(url, '[^a-zA-Z0-9]+', '_', 'g'), '_')), ''), 'dataset') AS slug FROM pages""")
def _(t):
    return t.pages.select("page_id", fc.slug(F.col("url")).alias("slug"))


@query("json_get", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def _(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


same_sql("sql_scalar", """
    SELECT c_custkey, abs(c_acctbal) AS a, round(c_acctbal, 1) AS r, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS c,
      ifnull(nullif(c_nationkey, 3), -1) AS i, substr(c_name, 10, 4) AS s, CAST(instr(c_name, '#') AS BIGINT) AS p, CAST(length(c_name) AS BIGINT) AS n,
      upper(c_name) || lower(c_mktsegment) AS u, trim('  x ') AS t, replace(c_name, '0', '') AS z
    FROM customer""", "customer", check="""
    SELECT c_custkey, abs(c_acctbal) AS a, round(c_acctbal, 1) AS r, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS c,
      ifnull(nullif(c_nationkey, 3), -1) AS i, substr(c_name, 10, 4) AS s, CAST(instr(c_name, '#') AS BIGINT) AS p, CAST(length(c_name) AS BIGINT) AS n,
      upper(c_name) || lower(c_mktsegment) AS u, trim('  x ') AS t, replace(c_name, '0', '') AS z FROM customer""")
