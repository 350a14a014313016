import pytest
from pyspark.sql import functions as F

from tests import pyref
from veil.functions import text as T
from veil.operators import redaction as R

TEXTS = [
    "The cat sat on the mat.",
    "of the people, by the people",
    "Care for the car!  Double  space",
    "A man. A plan",
    "",
    "single",
    "two words",
    "tab\tseparated\nlines and the end",
]
KW = ["the", "car", "of the", "a", "two words", "people"]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id int, text string")


def test_word_ngrams_match_python(df):
    rows = T.with_ngrams(df, "text", 1, 3, out="g").select("id", "g").collect()
    for r in rows:
        assert list(r["g"]) == pyref.word_ngrams(TEXTS[r["id"]]), TEXTS[r["id"]]


def test_redact_array_form_matches_python(df):
    rows = R.redact_keywords(df, KW, "text", "red").select("id", "red").collect()
    for r in rows:
        assert r["red"] == pyref.redact(TEXTS[r["id"]], KW), TEXTS[r["id"]]


def test_redact_exploded_form_equals_array_form(spark, df):
    kw = spark.createDataFrame([(k,) for k in KW], "phrase string")
    a = {r["id"]: r["red"] for r in R.redact_keywords(df, KW, "text", "red").collect()}
    b = {r["id"]: r["red"] for r in R.redact_keywords(df, kw, "text", "red", key_cols=["id"]).collect()}
    assert a == b


def test_substring_quirk_and_case(df):
    # a private "car" also hits "Care"? no: replacement is case-sensitive on the surface form,
    # but "car" inside "scary" would be replaced (Q3)
    out = R.redact_keywords(df.limit(1).select(F.lit("scary car").alias("text")), ["car"], "text", "r").first()["r"]
    assert out == pyref.redact("scary car", ["car"]) == "s<REDACTED>y <REDACTED>"


def test_redaction_idempotent_on_keyword_free_text(df):
    out = R.redact_keywords(df, ["zzz"], "text", "red").collect()
    assert all(r["red"] == r["text"] for r in out)


def test_per_domain_dictionary(spark):
    d = spark.createDataFrame([(1, "the cat", "A"), (2, "the cat", "B")], "id int, text string, domain string")
    out = {r["id"]: r["red"] for r in R.redact_keywords(d, {"A": ["the"], "B": ["cat"]}, "text", "red",
                                                        domain_col="domain").collect()}
    assert out == {1: "<REDACTED> cat", 2: "the <REDACTED>"}


def test_unigram_redaction(spark):
    d = spark.createDataFrame([("The  cat, the dog",)], "text string")
    out = d.select(R.redact_unigrams("text", ["the"]).alias("r")).first()["r"]
    assert out == "<REDACTED> cat, <REDACTED> dog"


def test_merge_spans_cuts_at_median(spark):
    # distances: big, small, big -> median = big; only the small edge merges
    probs = [[1.0, 0.0], [0.0, 1.0], [0.1, 0.9], [0.9, 0.1]]
    toks = ["a", "b", "c", "d"]
    d = spark.createDataFrame([(1, i + 1, t, p) for i, (t, p) in enumerate(zip(toks, probs))],
                              "id int, tok_pos int, token string, probs array<double>")
    spans = [r["span"] for r in R.merge_spans(d, ["id"]).orderBy("span_pos").collect()]
    assert spans == ["a", "b c", "d"]


def test_single_token_unchanged(spark):
    d = spark.createDataFrame([(1, 1, "solo", [0.5, 0.5])], "id int, tok_pos int, token string, probs array<double>")
    assert [r["span"] for r in R.merge_spans(d, ["id"]).collect()] == ["solo"]


def test_multi_pattern_fold_equals_sequential():
    import random
    from veil.functions.fold import fold_text
    rng = random.Random(0)
    words = ["the", "cat", "he", "there", "a", "at", "A", "RED", "<x>", "th", "e"]
    for _ in range(500):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(0, 30)))
        grams = [rng.choice(words) + (" " + rng.choice(words) if rng.random() < 0.3 else "") for _ in range(rng.randint(0, 12))]
        seq = text
        for g in grams:
            seq = seq.replace(g, " ".join(["<REDACTED>"] * len(g.split(" "))))
        assert fold_text(text, grams) == seq, (text, grams)
