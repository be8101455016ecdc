"""GROUPS frames and EXCLUDE against DuckDB, which has both."""

import random

import duckdb
import pytest

from grainfold.operators import windows

FUNCTIONS = ("sum", "count", "avg", "min", "max")
COLUMNS = "id bigint, p string, o int, v double"


@pytest.fixture(scope="module")
def rows():
    r = random.Random(4)
    out = [(i, r.choice(["a", "a", "a", "b", "c", None]), r.randrange(40), r.choice([None, *range(-5, 15)])) for i in range(400)]
    out += [(400 + i, "tied", 7, float(i % 6)) for i in range(60)] + [(500, "one", 1, 2.0), (501, "void", 3, None)]
    return [(i, p, o, None if v is None else float(v)) for i, p, o, v in out]


def duck(rows, frame, start, end, exclude, by="p", order="o"):
    con = duckdb.connect()
    con.execute("CREATE TABLE t (id BIGINT, p VARCHAR, o INTEGER, v DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?, ?)", rows)
    def edge(x, open_):
        if x is None:
            return f"UNBOUNDED {open_}"
        return "CURRENT ROW" if x == 0 else f"{abs(x)} {'PRECEDING' if x < 0 else 'FOLLOWING'}"

    over = f"({f'PARTITION BY {by}' if by else ''} ORDER BY {order} {frame} BETWEEN {edge(start, 'PRECEDING')} AND {edge(end, 'FOLLOWING')} EXCLUDE {exclude})"
    return con.sql(f"SELECT id, {', '.join(f'{f}(v) OVER {over} AS f_{f}' for f in FUNCTIONS)} FROM t ORDER BY id").fetchall()


def compare(got, want):
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert [x if x is None else round(x, 6) for x in g] == [x if x is None else round(x, 6) for x in w]


def spark_rows(spark, rows, functions, by=("p",), order=("o",), **how):
    df = spark.createDataFrame(rows, COLUMNS).repartition(4)
    out = windows.framed(df, {f"f_{f}": (f, "v") for f in functions}, by, order, **how)
    return [tuple(r) for r in out.select("id", *[f"f_{f}" for f in functions]).orderBy("id").collect()]


SPANS = [(-2, 1), (None, 0), (-3, -1), (1, 4), (None, 2), (None, -2), (0, None), (-1, None), (2, None), (None, None), (0, 0)]


@pytest.mark.parametrize("start,end", SPANS)
def test_groups(spark, rows, start, end):
    compare(spark_rows(spark, rows, FUNCTIONS, start=start, end=end), duck(rows, "GROUPS", start, end, "NO OTHERS"))


@pytest.mark.parametrize("exclude", windows.EXCLUDES[1:])
@pytest.mark.parametrize("start,end", [(-2, 1), (None, 0), (0, 0), (1, 2), (None, None)])
def test_groups_with_exclude(spark, rows, start, end, exclude):
    compare(spark_rows(spark, rows, FUNCTIONS, start=start, end=end, exclude=exclude), duck(rows, "GROUPS", start, end, exclude.upper()))


@pytest.mark.parametrize("exclude", windows.EXCLUDES)
@pytest.mark.parametrize("start,end", [(-6, 3), (None, 0), (0, 0)])
def test_range(spark, rows, start, end, exclude):
    functions = FUNCTIONS if exclude == "no others" else FUNCTIONS[:3]
    want = duck(rows, "RANGE", start, end, exclude.upper())
    compare(spark_rows(spark, rows, functions, frame="range", start=start, end=end, exclude=exclude), [w[: len(functions) + 1] for w in want])


@pytest.mark.parametrize("start,end", [(-4, 2), (None, 0), (1, 3)])
def test_rows_without_the_current_one(spark, rows, start, end):
    got = spark_rows(spark, rows, FUNCTIONS, order=("o", "id"), frame="rows", start=start, end=end, exclude="current row")
    compare(got, duck(rows, "ROWS", start, end, "CURRENT ROW", order="o, id"))


@pytest.mark.parametrize("exclude", ["group", "ties"])
@pytest.mark.parametrize("start,end", [(-2, 2), (-3, -1), (None, 0)])
def test_rows_without_peers(spark, start, end, exclude):
    # equal values inside each group of peers, so that the order of ties does not matter to what is left
    rows = [(i, "a", i // 3, float(i // 3) ** 2) for i in range(30)]
    got = spark_rows(spark, rows, ("sum", "count", "avg"), frame="rows", start=start, end=end, exclude=exclude)
    want = [w[:4] for w in duck(rows, "ROWS", start, end, exclude.upper())]
    # which of the tied rows stands where is open: compare the results of each group of peers
    group = lambda found: [(i // 3, *[x if x is None else round(x, 6) for x in rest]) for i, *rest in found]
    assert sorted(map(repr, group(got))) == sorted(map(repr, group(want)))


def test_two_order_columns_descending_without_partitions_and_with_clashing_names(spark, rows):
    con_rows = [(i, p, o, v) for i, p, o, v in rows if p is not None]
    df = spark.createDataFrame(con_rows, COLUMNS).selectExpr("*", "1 AS _g", "2 AS _key", "3 AS _row", "4 AS s")
    out = windows.framed(df, {"f_sum": ("sum", "v"), "f_max": ("max", "v"), "f_key": ("max", "_key")}, [], ["o", "p"], start=-1, end=2, descending=True, exclude="ties")
    assert out.columns == [*df.columns, "f_sum", "f_max", "f_key"]
    got = [tuple(r) for r in out.select("id", "f_sum", "f_max").orderBy("id").collect()]
    want = duck(con_rows, "GROUPS", -1, 2, "TIES", by=None, order="o DESC, p DESC")
    compare(got, [(w[0], w[1], w[5]) for w in want])
    assert {r["f_key"] for r in out.collect()} == {2}


def test_an_empty_table_and_wrong_frames(spark):
    none = spark.createDataFrame([], COLUMNS)
    assert windows.framed(none, {"f": ("sum", "v")}, ["p"], ["o"], start=-1).collect() == []
    for wrong in ({"frame": "peers"}, {"exclude": "me"}, {"start": 2, "end": 1}):
        with pytest.raises(ValueError):
            windows.framed(none, {"f": ("sum", "v")}, ["p"], ["o"], **wrong)


def test_one_partition_with_all_rows_goes_over_many_tasks(spark):
    from tests.test_plans import plan_of

    df = spark.range(5000).selectExpr("1 AS p", "id AS o", "id % 7 AS v")
    out = windows.framed(df, {"f": ("sum", "v")}, ["p"], ["o"], start=-2, end=2)
    assert "specifiedwindowframe(RangeFrame, -2, -1)" in plan_of(out) and "_b" in plan_of(out)
    assert out.where("o = 100").first()["f"] == sum(i % 7 for i in range(98, 103))
