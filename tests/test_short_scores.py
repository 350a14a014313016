"""Scores of one- and two-word n-grams by look-up; what is scored is scored once."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from veil.operators import redaction as R

DOCS = [("a", "the cat sat"), ("a", "The  cat\tran"), ("b", "a dog ran"), ("b", "dog"), ("b", ""), ("a", None)]
ITEMS = [("the",), ("cat",), ("the cat",), ("THE cat",), ("dog dog",), ("never seen",), ("zebra",), (None,), ("the",)]


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def model(spark):
    return R.fit_naive_bayes(spark.createDataFrame(DOCS, "label string, text string"), "text", "label", 1, 2)


def _scores(df, col):
    return {(r[col], r["label"]): r["prob"] for r in df.collect()}


def test_short_items_score_as_by_the_general_form(spark, model):
    items = spark.createDataFrame(ITEMS, "gram string")
    want = _scores(R.nb_score(items, model, "gram"), "gram")
    got = _scores(R.nb_score(items, model, "gram", short=True), "gram")
    assert got.keys() == want.keys() and len(got) == 16
    assert all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_vocabulary_scores_as_by_the_general_form(model):
    want = _scores(R.nb_score(model["vocab"], model, "gram"), "gram")
    got = _scores(R.nb_score(model["vocab"], model, "gram", short=True), "gram")
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_probabilities_are_not_computed_again_to_filter(spark, model):
    s = R.nb_score(spark.createDataFrame(ITEMS, "gram string"), model, "gram", short=True)
    assert "size(array(" not in _plan(s.where(F.col("prob") >= 0.5))


def test_ngrams_are_looked_up_once_for_both_kinds_of_text(spark):
    docs = spark.createDataFrame([(1, "the cat sat"), (2, "the  cat"), (3, "x the cat"), (4, None), (5, ""), (6, "sat")],
                                 "id int, text string")
    bits = spark.createDataFrame([("the cat", 1), ("sat", 2)], "gram string, bits long")
    out = R.redacted_domains(docs, bits, "text", ["d", "e"], 1, 2)
    got = {r["id"]: r["redacted_in"] for r in out.collect()}
    # "the cat" is no part of the text with two blanks
    assert got == {1: ["d", "e"], 2: [], 3: ["d"], 4: None, 5: [], 6: ["e"]}
    plan = _plan(out)
    assert plan.count("InMemoryRelation") >= 1
    assert "(size(array_distinct" not in plan


@pytest.mark.parametrize("lo, hi", [(1, 1), (1, 2), (2, 3)])
def test_counts_of_the_fit(spark, lo, hi):
    m = R.fit_naive_bayes(spark.createDataFrame(DOCS, "label string, text string"), "text", "label", lo, hi)
    want = Counter()
    for label, text in DOCS:
        w = (text or "").lower().split()
        want.update((" ".join(w[i:i + n]), label) for n in range(lo, hi + 1) for i in range(len(w) - n + 1))
    sums = Counter()
    for (_, label), n in want.items():
        sums[label] += n
    grams = {g for g, _ in want}
    got = {(r["gram"], r["label"]): r["logp"] for r in m["logp"].collect()}
    assert got.keys() == want.keys()
    from math import log
    for (g, label), n in want.items():
        assert abs(got[g, label] - log((n + 1) / (sums[label] + len(grams)))) < 1e-9
