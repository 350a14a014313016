"""Look-ups of n-grams: what travels is what is asked for."""

from pyspark.sql import functions as F

from veil.operators import attack as A
from veil.operators import redaction as R


def _model(spark):
    train = spark.createDataFrame([("a", "one two three"), ("b", "four five six two")] * 3 + [("b", "many other words here")],
                                  "label string, text string")
    return R.fit_naive_bayes(train, "text", "label", 1, 2)


def test_only_candidate_grams_are_scored(spark):
    model = _model(spark)
    grams = spark.createDataFrame([("one",), ("one two",), ("one",), ("unseen",), ("one unseen",)], "gram string")
    got = {r.gram: r.bits for r in R.gram_bits(grams, model, 0.6).collect()}
    probs = {r.gram: r.probs for r in R.nb_probs(grams, model, "gram", space_joined=True).collect()}
    want = {g: sum(1 << i for i, x in enumerate(p) if x > 0.6) for g, p in probs.items()}
    assert got == {g: b for g, b in want.items() if b}


def test_a_small_dictionary_meets_the_ngrams_in_place(spark):
    rows = [(1, "see one two"), (2, "see  one"), (3, "one\ttwo"), (4, None), (5, "see one two"), (6, "<REDACTED> x"), (7, "none")]
    df = spark.createDataFrame(rows, "id int, text string")
    bits = R.keyword_bits(spark.createDataFrame([("A", "one two"), ("B", "one")], "domain string, phrase string"), ["A", "B"])
    got = R.redacted_domains(df, bits, "text", ["A", "B"], 1, 2, normalise=True)
    assert got.columns == ["id", "text", "redacted_in"]
    assert "SortMergeJoin [gram" not in got._jdf.queryExecution().executedPlan().toString()
    assert {r.id: r.redacted_in for r in got.collect()} == {
        1: ["A", "B"], 2: ["B"], 3: ["B"], 4: None, 5: ["A", "B"], 6: ["A", "B"], 7: []}


def test_distinct_bigrams_meet_the_counts(spark):
    lm = A.fit_ngram_lm(spark.createDataFrame([("a b a b c",)], "text string"))
    bg = A._bigrams(spark.createDataFrame([(i, "a b a z") for i in range(5)], "id int, t string"), "t", ["id"])
    got = A._pair_logprobs(bg, {"x": lm, "y": lm})
    assert got.count() == 3 and got.where(F.col("x") != F.col("y")).count() == 0
