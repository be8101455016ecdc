"""Physical plans: pruned scans, early limits, no products of tables, partial aggregates before shuffles."""

import io
from contextlib import redirect_stdout

import pytest

from grainfold.functions.columns import ref
from grainfold.operators import cleaning, stats
from grainfold.plans import QUERIES


def plan_of(df) -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_scans_read_only_what_is_needed(spark, folder):
    plan = plan_of(QUERIES["ans_top_n"](spark, folder))
    assert "ReadSchema: struct<l_orderkey:bigint,l_extendedprice:double,l_discount:double>" in plan
    assert "ReadSchema: struct<c_custkey:bigint,c_mktsegment:string>" in plan
    assert "IsNotNull(l_orderkey)" in plan.split("PushedFilters: ", 1)[1].split("]", 1)[0]


def test_filters_reach_the_scan(spark, folder):
    plan = plan_of(QUERIES["src_parquet"](spark, folder))
    assert "GreaterThanOrEqual(l_quantity,25.0)" in plan and "struct<l_orderkey:bigint,l_quantity:double,l_shipdate:timestamp_ntz>" in plan


@pytest.mark.parametrize("name", ["prf_top_values", "win_topk"])
def test_top_k_is_cut_before_the_shuffle(spark, folder, name):
    assert "WindowGroupLimit" in plan_of(QUERIES[name](spark, folder))


@pytest.mark.parametrize("name", ["srt_topn", "lim_head", "ans_top_n", "smp_rows"])
def test_limits_use_the_ordered_take(spark, folder, name):
    assert "TakeOrderedAndProject" in plan_of(QUERIES[name](spark, folder))


@pytest.mark.parametrize("name", ["join_inner", "join_theta", "join_correlated", "join_semi", "ans_top_n", "txt_intent", "agg_rollup_path", "stm_window_hits"])
def test_no_products_and_no_python_in_relational_plans(spark, folder, name):
    plan = plan_of(QUERIES[name](spark, folder))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "Python" not in plan and "ArrowEval" not in plan


def test_duplicates_are_reduced_without_a_window(spark, folder):
    df = spark.read.parquet(f"{folder}/documents.parquet")
    plan = plan_of(cleaning.drop_duplicates(df, "text", {"keep": "first", "order_by": "doc_id"}))
    assert "Window" not in plan and plan.count("Aggregate") >= 2


def test_all_pairs_need_one_scan(spark, folder):
    df = spark.read.parquet(f"{folder}/lineitem.parquet")
    pairs = stats.correlation_pairs(df, {c: ref(c) for c in ("l_quantity", "l_extendedprice", "l_tax", "l_discount")})
    assert plan_of(pairs).count("Scan parquet") <= 2  # once in the tree, once in the details
