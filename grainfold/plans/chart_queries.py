"""Queries for automatic exploration, charts and maps."""

from __future__ import annotations

from pyspark.sql import functions as F

from grainfold.operators import charts, eda, maps
from grainfold.operators.profile import Profile
from grainfold.plans.base import Tables, query
from grainfold.plans.cleaning_queries import SPIKY_SQL, spiky
from grainfold.plans.relational import (
    LINE_NUMBERS, LINE_SQL, histogram_sql, line_amounts, placed_customers, rounded_bins)

SKEW_LABEL = "CASE WHEN {s} > 0.5 THEN 'right-skewed' WHEN {s} < -0.5 THEN 'left-skewed' ELSE 'roughly symmetric' END"


def rounded(df, *names, digits: int = 4):
    for n in names:
        df = df.withColumn(n, F.round(n, digits))
    return df


# --- automatic exploration ---------------------------------------------------------

@query("eda_hist", f"""SELECT h.*, round((SELECT skewness(v) FROM ({SPIKY_SQL})), 4) AS skew,
    {SKEW_LABEL.format(s=f'(SELECT skewness(v) FROM ({SPIKY_SQL}))')} AS shape FROM ({histogram_sql(f'({SPIKY_SQL})', 'v', '12')}) h""")
def _(t):
    return rounded(rounded_bins(eda.histogram(spiky(t), "v")), "skew")


BOX_SQL = f"""WITH g AS ({SPIKY_SQL}), q AS (SELECT quantile_cont(v, 0.25) AS q1, median(v) AS med, quantile_cont(v, 0.75) AS q3 FROM g),
    f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)
    SELECT round(greatest(min(v), max(lo)), 4) AS low, round(max(q1), 4) AS q1, round(max(med), 4) AS median, round(max(q3), 4) AS q3,
      round(least(max(v), max(hi)), 4) AS high, count(*) FILTER (WHERE v < lo OR v > hi) AS outliers FROM g, f"""


@query("eda_box", BOX_SQL)
def _(t):
    return rounded(eda.box(spiky(t), "v"), "low", "q1", "median", "q3", "high")


@query("eda_scatter", """SELECT l_quantity, l_extendedprice, round((SELECT corr(l_quantity, l_extendedprice) FROM lineitem), 4) AS corr,
    CASE WHEN (SELECT abs(corr(l_quantity, l_extendedprice)) FROM lineitem) > 0.7 THEN 'strong' WHEN
    (SELECT abs(corr(l_quantity, l_extendedprice)) FROM lineitem) > 0.4 THEN 'moderate' ELSE 'weak' END AS strength FROM lineitem""")
def _(t):
    note = eda.scatter_note(t.lineitem, "l_quantity", "l_extendedprice").first()
    return eda.scatter(t.lineitem, "l_quantity", "l_extendedprice").withColumns(
        {"corr": F.lit(round(note["corr"], 4)), "strength": F.lit(note["strength"])})


def _category_sql(k: int) -> str:
    return f"""SELECT source AS category, count(*) AS count, round(count(*) / (SELECT count(source) FROM documents) * 100, 4) AS share
        FROM documents GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT {k}"""


@query("eda_catbar", _category_sql(10))
def _(t):
    return rounded(eda.category_bar(t.documents, "source"), "share")


@query("eda_pie", _category_sql(8))
def _(t):
    return rounded(eda.pie(t.documents, "source"), "share")


@query("eda_gbar", f"SELECT event_type AS category, round(avg(v), 3) AS value FROM ({SPIKY_SQL}) GROUP BY 1 ORDER BY 2 DESC LIMIT 10")
def _(t):
    return eda.grouped_mean(spiky(t), "v", "event_type")


def violin_sql(source: str, y: str, x: str, k: int) -> str:
    return f"""WITH g AS ({source}), top AS (SELECT {x} FROM g WHERE {y} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT {k}),
    q AS (SELECT {x}, quantile_cont({y}, [i / 20.0 FOR i IN range(0, 21)]) AS a FROM g WHERE {x} IN (SELECT {x} FROM top) GROUP BY 1)
    SELECT {x}, CAST(unnest(range(0, 21)) AS INTEGER) AS step, round(unnest(a), 4) AS value FROM q"""


@query("eda_violin", violin_sql("SELECT * FROM documents", "n_chars", "source", 5))
def _(t):
    return rounded(eda.violin(t.documents, "n_chars", "source"), "value")


@query("eda_ts", """WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS period, sum(o_totalprice) AS value FROM orders GROUP BY 1),
    e AS (SELECT (max_by(value, period) - min_by(value, period)) / abs(min_by(value, period)) AS c FROM m)
    SELECT period, round(value, 2) AS value, CASE WHEN c > 0.05 THEN 'upward' WHEN c < -0.05 THEN 'downward' ELSE 'flat' END AS trend FROM m, e""")
def _(t):
    return rounded(eda.time_series(t.orders, "o_orderdate", "o_totalprice"), "value", digits=2)


def cells_sql(source: str, names) -> str:
    return " UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, round(corr({a}, {b}), 2) + 0.0 AS value FROM ({source})" for a in names for b in names)


@query("eda_heatmap", cells_sql(LINE_SQL, LINE_NUMBERS))
def _(t):
    return eda.heatmap(line_amounts(t), list(LINE_NUMBERS)).withColumn("value", F.col("value") + 0.0)


@query("eda_plan")
def _(t):
    # Every planned chart with the number of rows it draws.
    made = eda.explore(t.orders)
    rows = [data.agg(F.lit(i).alias("position"), F.lit(spec["chart"]).alias("chart"), F.lit(", ".join(spec["columns"])).alias("columns"),
                     F.count("*").alias("points")) for i, (spec, data) in enumerate(made)]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


# --- charts --------------------------------------------------------------------------

@query("viz_histogram", """WITH d AS (SELECT l_returnflag, l_extendedprice AS x FROM lineitem), m AS (SELECT min(x) AS lo, max(x) AS hi FROM d)
    SELECT l_returnflag, CAST(least(floor((x - lo) / ((hi - lo) / 15)), 14) AS INTEGER) AS bin,
      round(lo + least(floor((x - lo) / ((hi - lo) / 15)), 14) * ((hi - lo) / 15), 4) AS lower,
      round(lo + (least(floor((x - lo) / ((hi - lo) / 15)), 14) + 1) * ((hi - lo) / 15), 4) AS upper, count(*) AS count
    FROM d, m GROUP BY ALL""")
def _(t):
    return rounded_bins(charts.histogram(t.lineitem, "l_extendedprice", "l_returnflag", 15))


@query("viz_box", f"""WITH g AS ({SPIKY_SQL}), q AS (SELECT event_type, quantile_cont(v, 0.25) AS q1, median(v) AS median, quantile_cont(v, 0.75) AS q3,
      min(v) AS lo, max(v) AS hi, count(v) AS count FROM g GROUP BY 1)
    SELECT event_type, round(greatest(lo, q1 - 1.5 * (q3 - q1)), 4) AS low, round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3,
      round(least(hi, q3 + 1.5 * (q3 - q1)), 4) AS high, count FROM q""")
def _(t):
    return rounded(charts.box(spiky(t), "v", "event_type"), "low", "q1", "median", "q3", "high")


@query("viz_violin", violin_sql("SELECT * FROM documents", "n_chars", "source", 8))
def _(t):
    return rounded(charts.violin(t.documents, "n_chars", "source"), "value")


@query("viz_bar", """SELECT p_brand, p_type, round(avg(p_retailprice), 4) AS value FROM part WHERE p_brand IN (
    SELECT p_brand FROM (SELECT p_brand, p_type, avg(p_retailprice) AS m FROM part GROUP BY 1, 2) GROUP BY 1 ORDER BY sum(m), 1 LIMIT 12) GROUP BY 1, 2""")
def _(t):
    return rounded(charts.bar(t.part, "p_brand", "p_retailprice", "p_type", sort="asc", limit=12), "value").drop("total")


@query("viz_line", """SELECT CAST(o_orderdate AS TIMESTAMP) AS o_orderdate, o_orderstatus, round(avg(o_totalprice), 4) AS value FROM orders GROUP BY 1, 2""")
def _(t):
    return rounded(charts.line(t.orders, "o_orderdate", "o_totalprice", "o_orderstatus"), "value")


@query("viz_area", "SELECT CAST(l_quantity AS DOUBLE) AS l_quantity, round(sum(l_extendedprice), 2) AS value FROM lineitem GROUP BY 1")
def _(t):
    return rounded(charts.line(t.lineitem, "l_quantity", "l_extendedprice", aggregation="sum"), "value", digits=2)


@query("viz_scatter", """SELECT count(*) AS n, round(corr(l_extendedprice, l_quantity), 4) AS corr,
    round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, min(l_quantity) AS x0, max(l_quantity) AS x1,
    round(regr_intercept(l_extendedprice, l_quantity) + regr_slope(l_extendedprice, l_quantity) * min(l_quantity), 2) AS y0,
    round(regr_intercept(l_extendedprice, l_quantity) + regr_slope(l_extendedprice, l_quantity) * max(l_quantity), 2) AS y1 FROM lineitem""")
def _(t):
    return rounded(rounded(charts.trend_line(t.lineitem, "l_quantity", "l_extendedprice"), "corr", "slope"), "y0", "y1", digits=2)


@query("viz_bubble", "SELECT CAST(p_size AS DOUBLE) AS p_size, p_retailprice, CAST(p_partkey AS DOUBLE) AS p_partkey, p_type FROM part")
def _(t):
    return charts.bubble(t.part, "p_size", "p_retailprice", "p_partkey", "p_type")


def grid_sql(x: str, y: str, source: str, bins: int) -> str:
    return f"""WITH m AS (SELECT min({x}) AS a, max({x}) AS b, min({y}) AS c, max({y}) AS d FROM {source})
        SELECT CAST(least(floor(({x} - a) / ((b - a) / {bins})), {bins - 1}) AS INTEGER) AS x_bin,
        CAST(least(floor(({y} - c) / ((d - c) / {bins})), {bins - 1}) AS INTEGER) AS y_bin, count(*) AS count FROM {source}, m GROUP BY 1, 2"""


@query("viz_density", grid_sql("l_extendedprice", "l_quantity", "lineitem", 20))
def _(t):
    return charts.density(t.lineitem, "l_extendedprice", "l_quantity")


@query("viz_pie", """WITH g AS (SELECT source, count(*) AS v FROM documents GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY v DESC, source) AS r FROM g)
    SELECT CASE WHEN r < 8 THEN source ELSE 'Other' END AS source, CAST(sum(v) AS BIGINT) AS value FROM r GROUP BY 1""")
def _(t):
    return charts.pie(t.documents, "source", limit=8)


def tree_sql(value: str) -> str:
    j = "FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
    return f"""SELECT r_name AS id, r_name AS label, '' AS parent, {value} AS value {j} GROUP BY 1, 2 UNION ALL
        SELECT r_name || '/' || n_name, n_name, r_name, {value} {j} GROUP BY 1, 2, 3 UNION ALL
        SELECT r_name || '/' || n_name || '/' || c_mktsegment, c_mktsegment, r_name || '/' || n_name, {value} {j} GROUP BY 1, 2, 3"""


@query("viz_treemap", f"SELECT id, label, parent, round(value, 2) AS value FROM ({tree_sql('sum(c_acctbal)')})")
def _(t):
    return rounded(charts.hierarchy(placed_customers(t), ["r_name", "n_name", "c_mktsegment"], "c_acctbal"), "value", digits=2)


@query("viz_sunburst", tree_sql("count(*)"))
def _(t):
    return charts.hierarchy(placed_customers(t), ["r_name", "n_name", "c_mktsegment"])


@query("viz_heatmap", cells_sql(LINE_SQL, LINE_NUMBERS[1:]))
def _(t):
    return charts.heatmap(line_amounts(t), LINE_NUMBERS[1:]).withColumn("value", F.col("value") + 0.0)


@query("viz_pairplot", " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, l_returnflag AS hue, " + ", ".join(
        f"CAST(least(floor(({c} - (SELECT min({c}) FROM lineitem)) / ((SELECT max({c}) - min({c}) FROM lineitem) / 20)), 19) AS INTEGER) AS {o}"
        for c, o in ((a, "a_bin"), (b, "b_bin"))) + ", count(*) AS count FROM lineitem GROUP BY ALL"
    for i, a in enumerate(("l_quantity", "l_extendedprice", "l_linenumber"))
    for b in ("l_quantity", "l_extendedprice", "l_linenumber")[i:]))
def _(t):
    return charts.pair_plot(t.lineitem, ["l_quantity", "l_extendedprice", "l_linenumber"], "l_returnflag")


@query("viz_joint", f"""WITH g AS ({grid_sql("o_totalprice", "o_custkey", "orders", 20)}) SELECT 'joint' AS part, x_bin, y_bin, count FROM g
    UNION ALL SELECT 'x', x_bin, NULL, CAST(sum(count) AS BIGINT) FROM g GROUP BY x_bin UNION ALL SELECT 'y', NULL, y_bin, CAST(sum(count) AS BIGINT) FROM g GROUP BY y_bin""")
def _(t):
    return charts.joint_plot(t.orders, "o_totalprice", "o_custkey")


@query("viz_kde", """WITH d AS (SELECT o_totalprice AS x FROM orders), m AS (SELECT min(x) AS lo, max(x) AS hi, stddev_samp(x) AS s, count(*) AS n FROM d),
    b AS (SELECT least(floor((x - lo) / ((hi - lo) / 512)), 511) AS b, avg(x) AS mean, count(*) AS c FROM d, m GROUP BY 1),
    w AS (SELECT *, s * n ** -0.2 AS h FROM m), g AS (SELECT lo - 3 * h + i * ((hi - lo + 6 * h) / 49) AS x, h, n FROM w, (SELECT unnest(range(0, 50)) AS i))
    SELECT round(x, 2) AS x, round(1e6 * sum(c * exp(-0.5 * ((x - mean) / h) ** 2)) / (max(n) * max(h) * sqrt(2 * pi())), 6) AS density FROM g, b GROUP BY x""")
def _(t):
    curve = charts.kde(t.orders, "o_totalprice")
    return curve.select(F.round("x", 2).alias("x"), F.round(F.col("density") * 1e6, 6).alias("density"))


@query("viz_distribution", histogram_sql("orders", "o_totalprice", "30"))
def _(t):
    bins, _ = charts.distribution(t.orders, "o_totalprice")
    return rounded_bins(bins)


@query("viz_regplot", """SELECT 0 AS power, round(regr_intercept(l_extendedprice, l_quantity), 3) AS coefficient FROM lineitem UNION ALL
    SELECT 1, round(regr_slope(l_extendedprice, l_quantity), 3) FROM lineitem""")
def _(t):
    return rounded(charts.polynomial_fit(t.lineitem, "l_quantity", "l_extendedprice", 1), "coefficient", digits=3)


@query("viz_clustermap")
def _(t):
    return charts.cluster_map(line_amounts(t), LINE_NUMBERS)


@query("viz_catalog")
def _(t):
    return charts.catalog(Profile(t.orders))


# --- maps ----------------------------------------------------------------------------

PLACES_SQL = "SELECT c_custkey, c_mktsegment, c_acctbal, (c_custkey * 37 % 190) - 95.0 AS lat, (c_custkey * 91 % 360) - 180.0 AS lon FROM customer"
_VALID = f"SELECT * FROM ({PLACES_SQL}) WHERE lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180"


def places(t: Tables):
    k = F.col("c_custkey")
    return t.customer.select("c_custkey", "c_mktsegment", "c_acctbal", (k * 37 % 190 - 95.0).alias("lat"), (k * 91 % 360 - 180.0).alias("lon"))


@query("map_coords", f"SELECT CAST(lat AS DOUBLE) AS lat, CAST(lon AS DOUBLE) AS lon, c_custkey FROM ({_VALID})")
def _(t):
    return maps.coordinates(places(t), "lat", "lon", ["c_custkey"])


@query("map_center", f"""SELECT round(avg(lat), 4) AS lat, round(avg(lon), 4) AS lon,
    CAST(greatest(1, least(12, round_even(log2(360.0 / greatest(max(lat) - min(lat), max(lon) - min(lon), 0.02)), 0) - 1)) AS DOUBLE) AS zoom FROM ({_VALID})""")
def _(t):
    return rounded(maps.center_zoom(maps.coordinates(places(t), "lat", "lon"), "lat", "lon"), "lat", "lon")


@query("map_scatter", f"SELECT CAST(lat AS DOUBLE) AS lat, CAST(lon AS DOUBLE) AS lon, c_mktsegment FROM ({_VALID})")
def _(t):
    return maps.scatter_map(places(t), "lat", "lon", "c_mktsegment")


@query("map_bubble", f"SELECT CAST(lat AS DOUBLE) AS lat, CAST(lon AS DOUBLE) AS lon, c_acctbal FROM ({_VALID})")
def _(t):
    return maps.bubble_map(places(t), "lat", "lon", "c_acctbal")


@query("map_density", f"SELECT CAST(lat AS DOUBLE) AS lat, CAST(lon AS DOUBLE) AS lon FROM ({_VALID})")
def _(t):
    return maps.density_map(places(t), "lat", "lon")


@query("map_heat", f"SELECT CAST(lat AS DOUBLE) AS lat, CAST(lon AS DOUBLE) AS lon, c_acctbal FROM ({_VALID})")
def _(t):
    return maps.density_map(places(t), "lat", "lon", "c_acctbal")


@query("map_grid", f"""WITH p AS ({_VALID}), m AS (SELECT min(lat) AS a, (max(lat) - min(lat)) / 12 AS sa, min(lon) AS o, (max(lon) - min(lon)) / 12 AS so FROM p)
    SELECT CAST(floor((lat - a) / sa) AS BIGINT) AS row, CAST(floor((lon - o) / so) AS BIGINT) AS col, round(avg(lat), 4) AS lat, round(avg(lon), 4) AS lon,
    count(*) AS count FROM p, m GROUP BY 1, 2""")
def _(t):
    return rounded(maps.grid_map(places(t), "lat", "lon", 12), "lat", "lon")


@query("map_cluster")
def _(t):
    return maps.cluster_map(places(t), "lat", "lon", 5, ["c_custkey"])


@query("map_choropleth", "SELECT n_name, round(avg(c_acctbal), 4) AS value FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def _(t):
    return rounded(maps.choropleth(placed_customers(t), "n_name", "c_acctbal"), "value")
