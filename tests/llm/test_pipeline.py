"""The pipeline: every stage on what its predecessor kept, against brute force."""

import pytest

import corpus_pipeline
from tests.llm.test_operators import brute_classes, brute_contamination, brute_quality, brute_removed, plain_words


@pytest.fixture(scope="module")
def stages(spark, folder):
    docs = spark.read.parquet(folder + "/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], folder).cache())
    return [{r.doc_id: r.text for r in d.collect()} for d in out[:-1]], out


def test_columns_stay(stages):
    _, tables = stages
    assert all(t.columns == tables[0].columns and t.dtypes == tables[0].dtypes for t in tables[1:-1])


def test_quality_keeps_what_passes(stages):
    before, after = stages[0][0], stages[0][1]
    for i, text in before.items():
        n, _, _, _, again = brute_quality(text)
        if n < 20 or 100 * again > 30 * n:
            assert i not in after
    assert len(after) > 0.7 * len(before) and all(before[i] == t for i, t in after.items())


def test_one_of_each_group_stays(stages):
    before, after = stages[0][1], stages[0][2]
    classes = brute_classes(sorted(before.items()))
    assert set(after) == {i for i in before if classes.get(i, i) == i}


def test_repeated_strings_go(stages):
    before, after = stages[0][2], stages[0][3]
    for i, n, gone, _, _ in brute_removed(sorted(before.items())):
        assert (i not in after) if n and n == gone else (after[i] == before[i] if not gone else len(after[i].encode()) <= n - gone)


def test_benchmark_passages_go(stages, spark, folder):
    items = [(r.item_id, r.text) for r in spark.read.parquet(folder + "/benchmark.parquet").collect()]
    before, after = stages[0][3], stages[0][4]
    for i, n, hit, _ in brute_contamination(sorted(before.items()), items):
        if hit and 20 * hit >= n:
            assert i not in after or len(plain_words(after[i])) == n - hit
        else:
            assert after[i] == before[i]


def test_every_document_is_packed(stages, spark, folder):
    packed = stages[1][-1].toPandas()
    assert set(packed.doc_id) == set(stages[0][4])
    assert packed.groupby("sequence_id").length.sum().max() <= 2048
    assert corpus_pipeline.run(spark, folder).count() == len(packed)
