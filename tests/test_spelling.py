"""The spelling index against a comparison with all words."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from grainfold.operators import text


def plain(tokens, words):
    best = {t: difflib.get_close_matches(t, words, n=1, cutoff=text.SIMILARITY) for t in tokens if len(t) >= 4 and t not in text.STOP_WORDS and t not in words}
    return {t: b[0] for t, b in best.items() if b}


def damaged(r, word):
    letters = list(word)
    for _ in range(r.randint(1, max(1, len(word) // 5))):
        at, what = r.randrange(len(letters)), r.random()
        if what < 0.35 and len(letters) > 4:
            del letters[at]
        elif what < 0.7:
            letters.insert(at, r.choice("abcde"))
        else:
            letters[at] = r.choice("abcde")
    return "".join(letters)


@pytest.mark.parametrize("low,high", [(3, 9), (8, 18), (15, 30)])
def test_repairs_are_those_of_a_comparison_with_all_words(spark, low, high):
    r = random.Random(low)
    # few letters, so that many words are similar
    words = sorted({r.choice("abcde") + "".join(r.choice("abcde_0") for _ in range(r.randint(low, high))) for _ in range(250)})
    tokens = sorted({damaged(r, r.choice(words)) for _ in range(500)} | {"abcd", "the", "show", "count"})
    tokens = [t for t in tokens if t[0].isalpha()]
    texts = spark.createDataFrame([(" ".join(tokens[i::7]),) for i in range(7)] + [(None,), ("",)], "text string")
    found = text.spelling_table(texts, "text", words)
    want = plain(tokens, words)
    assert {x["token"]: x["target"] for x in found.collect()} == want and len(want) > 100


def test_no_similar_pair_is_left_out_and_dissimilar_ones_mostly_are(spark):
    r = random.Random(9)
    words = sorted({"".join(r.choice("abcdefghij") for _ in range(r.randint(4, 24))) for _ in range(300)})
    tokens = sorted({damaged(r, w) for w in words})
    pairs = text.spelling_candidates(spark.createDataFrame([(t,) for t in tokens], "token string"), spark.createDataFrame([(w,) for w in words], "word string"))
    got = {(p["token"], p["word"]) for p in pairs.collect()}
    assert len(got) == pairs.count() < len(words) * len(tokens) / 8
    assert {(t, w) for t in tokens for w in words if difflib.SequenceMatcher(None, w, t).ratio() >= text.SIMILARITY} <= got


def test_a_vocabulary_may_be_a_table_and_may_be_empty(spark):
    texts = spark.createDataFrame([("Show revenu by custmer_segment",)], "text string")
    words = spark.createDataFrame([("revenue",), ("customer_segment",), (None,), ("revenue",)], "w string")
    assert {x["token"]: x["target"] for x in text.spelling_table(texts, "text", words).collect()} == {"revenu": "revenue", "custmer_segment": "customer_segment"}
    assert text.spelling_table(texts, "text", words.limit(0)).collect() == []
    fixed = text.correct_spelling(texts.withColumn("k", F.lit(1)), "k", "text", ["Customer Segment"])
    assert fixed.first()["corrected"] == "Show revenue by custmer_segment"
