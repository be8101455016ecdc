"""Readers, sinks and the SQL catalog."""

import json

import pytest

from grainfold.operators.profile import Profile
from grainfold.sources import catalog, readers, sinks


def test_csv_nulls_types_and_quotes(spark, tmp_path):
    (tmp_path / "a.csv").write_text(' id ,name,score,flag,mixed\n1,"x, y",1.5,True,1\n2,NA,n/a,False,b\n3,"say ""hi""",2,True,\n')
    rows = readers.load(spark, str(tmp_path / "a.csv"))
    assert rows.columns == ["id", "name", "score", "flag", "mixed"]
    assert [t for _, t in rows.dtypes] == ["bigint", "string", "double", "boolean", "string"]
    got = rows.orderBy("id").collect()
    assert [r["name"] for r in got] == ["x, y", None, 'say "hi"']
    assert [r["score"] for r in got] == [1.5, None, 2.0]


def test_csv_cells_over_lines(spark, tmp_path):
    (tmp_path / "b.csv").write_text('a,b\n1,"first\nsecond"\n2,plain\n')
    got = readers.load(spark, str(tmp_path / "b.csv")).orderBy("a").collect()
    assert [r["b"] for r in got] == ["first\nsecond", "plain"]


def test_empty_is_an_error(spark, tmp_path):
    (tmp_path / "c.csv").write_text("a,b\n")
    with pytest.raises(readers.ReadError):
        readers.load(spark, str(tmp_path / "c.csv"))


@pytest.mark.parametrize("body", [
    [{"a": 1, "n": {"x": 2}}, {"a": 3, "n": {"x": 4}}],
    {"records": [{"a": 1, "n": {"x": 2}}, {"a": 3, "n": {"x": 4}}]},
])
def test_json_shapes(spark, tmp_path, body):
    (tmp_path / "d.json").write_text(json.dumps(body))
    got = readers.load(spark, str(tmp_path / "d.json"))
    assert sorted(got.columns) == ["a", "n.x"]
    assert sorted(r["a"] for r in got.collect()) == [1, 3]


def test_json_object_and_lines(spark, tmp_path):
    (tmp_path / "e.json").write_text('{"a": 1, "b": "x"}')
    assert readers.load(spark, str(tmp_path / "e.json")).collect()[0]["b"] == "x"
    (tmp_path / "f.jsonl").write_text('{"a": 1}\n{"a": 2}\n')
    assert readers.load(spark, str(tmp_path / "f.jsonl")).count() == 2


def test_detect():
    assert readers.detect_source("x.JSON") == "json" and readers.detect_source("x", "text/csv") == "csv"
    assert readers.detect_source("x.parquet") == "parquet" and readers.detect_source("what") == "csv"
    with pytest.raises(readers.ReadError):
        readers.detect_source("x.xlsx")


def test_headers_are_kept_apart(spark):
    df = spark.createDataFrame([(1, 2)], "x int, y int").toDF("a", " A ")
    assert readers.normalize(df).columns == ["a", "A_1"]


def test_view_names_do_not_collide(spark):
    df = spark.range(1)
    views = catalog.register([("x", df), ("x", df), ("x 1", df), ("!!", df)])
    assert list(views) == ["x", "x_1", "x_1_1", "dataset"]


def test_sql_limit_and_flag(spark):
    catalog.register([("numbers", spark.range(30))])
    cut = catalog.run_sql(spark, "SELECT * FROM numbers", limit=10, count=True)
    assert cut.rows.count() == 10 and cut.truncated and cut.row_count == 30
    assert not catalog.run_sql(spark, "SELECT * FROM numbers", limit=30).truncated


def test_commit_keeps_the_source_and_refuses_to_overwrite(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, s string")
    sinks.commit(df, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out" / "profile_columns")).count() == 2
    with pytest.raises(Exception, match="exists"):
        sinks.commit(df, str(tmp_path / "out"))
    sinks.export_profile(Profile(df), str(tmp_path / "profile"))
    assert spark.read.json(str(tmp_path / "profile")).count() == 2
