"""Rows with null keys, repeated keys and zero vectors are neither lost nor mixed."""

import pytest
from pyspark.sql import functions as F

from veil.functions import ranking as RK
from veil.operators import classify as C
from veil.operators import dialogue as D
from veil.operators import fewshot as FS
from veil.operators import metrics as M
from veil.operators import privacy as P
from veil.operators import redaction as R


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([("a", 1), ("a", 2), (None, 3), (None, 4)], "g string, v int")


def test_positions_and_running_sums_keep_null_groups(rows):
    got = {(r.g, r.v): r.pos for r in RK.positions(rows, ["g"], ["v"]).collect()}
    assert got == {("a", 1): 0, ("a", 2): 1, (None, 3): 0, (None, 4): 1}
    sums = {(r.g, r.v): (r.running_sum, r.running_n) for r in RK.running_sum(rows, ["g"], ["v"], "v").collect()}
    assert sums == {("a", 1): (1, 1), ("a", 2): (3, 2), (None, 3): (3, 1), (None, 4): (7, 2)}


def test_splits_and_matrices_keep_nulls(spark, rows):
    assert C.stratified_split(rows, "g", "v").count() == 4
    pairs = spark.createDataFrame([(None, "x"), ("y", "x"), (None, "z")], "label string, pred string")
    got = {(r.y, r.p): r.rate for r in C.confusion_matrix(pairs, "pred", "label").collect()}
    assert got == {(None, "x"): 0.5, (None, "z"): 0.5, ("y", "x"): 1.0}
    turns = spark.createDataFrame([(None, "1"), (None, "2"), ("d", "3")], "domain string, conversation_id string")
    manifest = D.split_conversations(turns)
    assert manifest.count() == 3 and D.apply_split_manifest(turns, manifest).count() == 3
    ranked = M.average_ranks(rows.withColumn("w", F.when(F.col("v") < 3, F.col("v"))), "w", "v", "r")
    assert ranked.count() == 4


def test_redaction_with_null_and_repeated_keys(spark):
    df = spark.createDataFrame([(None, "the cat"), (1, "the dog"), (1, "a the"), (1, "a the"), (2, None)],
                               "id int, text string")
    kw = spark.createDataFrame([("the",), ("a the",)], "phrase string")
    got = sorted((str(r.id), str(r.text)) for r in R.redact_keywords(df, kw, "text", key_cols=["id"]).collect())
    want = sorted((str(r.id), str(r.text)) for r in R.redact_keywords(df, ["the", "a the"], "text").collect())
    assert got == want and "the" not in " ".join(t for _, t in got)


def test_redact_dataset_takes_a_dictionary_table_per_domain(spark):
    df = spark.createDataFrame([(1, "the cat"), (2, "the cat")], "id int, utterance string")
    df = df.withColumn("domain", F.when(F.col("id") == 1, "A").otherwise("B"))
    kw = spark.createDataFrame([("the", "A"), ("cat", "B")], "phrase string, domain string")
    got = {r.id: r.utterance for r in R.redact_dataset(df, "key", keywords=kw, domain_col="domain").collect()}
    assert got == {1: "<REDACTED> cat", 2: "the <REDACTED>"}


def test_redact_dataset_scores_flat_and_per_domain(spark):
    df = spark.createDataFrame([(1, "one two three", "A"), (2, "one two three", "B")], "id int, utterance string, domain string")
    scores = spark.createDataFrame([("two", "A", 0.99), ("one two three", "A", 0.99), ("one", "B", 0.96)],
                                   "gram string, label string, prob double")
    flat = {r.id: r.utterance for r in R.redact_dataset(df, "scores", scores=scores, domain_col="domain").collect()}
    # n-grams of up to two words: the three-word score is not looked at
    assert flat == {1: "<REDACTED> <REDACTED> three", 2: "<REDACTED> <REDACTED> three"}
    own = {r.id: r.utterance for r in R.redact_dataset(df, "scores", scores=scores, domain_col="domain",
                                                       per_domain=True).collect()}
    assert own == {1: "one <REDACTED> three", 2: "<REDACTED> two three"}


def test_demo_filter_zero_vectors_empty_parts_and_two_lazy_results(spark):
    q = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0])], "k int, v array<double>")
    one = spark.createDataFrame([(10, [1.0, 0.0], 0), (11, [0.0, 1.0], 0)], "k int, v array<double>, y int")
    two = spark.createDataFrame([(20, [1.0, 0.0], 0), (21, [0.0, 1.0], 0)], "k int, v array<double>, y int")
    a = FS.demo_filter(q, one.repartition(5), "k", "v", "y", 1, 1.0)
    b = FS.demo_filter(q, two, "k", "v", "y", 1, 1.0, support_rows=1)
    assert sorted((r.query_id, r.support_id, r.rank) for r in a.collect()) == [(1, 10, 1), (1, 11, 2), (2, 10, 1), (2, 11, 2)]
    assert {r.support_id for r in b.collect()} == {20, 21}


def test_demo_filter_leaves_self_out(spark):
    s = spark.createDataFrame([(k, [1.0, float(k)], k % 2) for k in range(6)], "k int, v array<double>, y int")
    got = FS.demo_filter(s, s, "k", "v", "y", 2, 1.0, exclude_self=True).collect()
    assert all(r.query_id != r.support_id for r in got)
    assert {(r.query_id, r.label): 0 for r in got}.keys() == {(q, l) for q in range(6) for l in (0, 1)}


def test_templates_shift_by_whole_copies():
    assert FS.expand_template("*cls**sent_0*_is*mask*", num_labels=2) == \
        "*cls**sent_0*_is*mask**sent_1*_is*label_0**sent_2*_is*label_1*"
    assert FS.expand_template("*cls**sent_0**mask**+sentl_1*", num_labels=2) == \
        "*cls**sent_0**mask**+sentl_1**sent_2**label_0**+sentl_3**sent_4**label_1**+sentl_5*"
    assert FS.expand_template("*cls**sent_0**mask*", num_demos=2, head=True) == \
        "*sent_2**labelx_1**sent_1**labelx_0**cls**sent_0**mask*"


def test_label_search_takes_a_million_pairings(spark):
    import numpy as np
    rng = np.random.default_rng(1)
    logits = rng.normal(size=(30, 1000))
    y = rng.integers(0, 2, size=30)
    ex = spark.createDataFrame([(row.tolist(), int(c)) for row, c in zip(logits, y)], "l array<double>, y int")
    got = FS.search_label_words(ex, {0: range(1000), 1: range(1000)}, "l", "y", 3).collect()
    acc = ((logits[:, None, :] > logits[:, :, None]).astype(int) == y[:, None, None]).mean(axis=0)
    assert [r.accuracy for r in got] == sorted(acc.ravel(), reverse=True)[:3]


def test_lower_median_by_group_with_null_group(spark):
    d = spark.createDataFrame([(g, [x, 0.0]) for g, x in (("a", 1.0), ("a", 2.0), (None, 4.0), (None, 8.0), (None, 3.0))],
                              "g string, v array<double>")
    got = {r.g: r.coef_median for r in P.clip_stats(d, "v", 1.0, ["g"]).collect()}
    assert got["a"] == pytest.approx(0.5, rel=1e-5) and got[None] == pytest.approx(0.25, rel=1e-5)


def test_cap_without_single_partition(spark, capsys):
    from veil.operators import lmdata as L
    L.cap(spark.range(20_000), "id", 5_000).explain()
    assert "SinglePartition" not in capsys.readouterr().out


def test_lines_of_files_with_the_same_name(spark, tmp_path):
    from veil.sources import io
    paths = []
    for k, split in enumerate(("train", "valid")):
        p = f"{tmp_path}/{split}/airline.txt"
        io.write_lines(spark.range(3).select("id", F.concat(F.lit(f"{split} "), F.col("id").cast("string")).alias("value")), p, "id")
        paths.append(p)
    got = sorted((r.file_idx, r.line_no, r.value) for r in io.read_lines(spark, paths, keep_linebreaks=True).collect())
    assert got == [(k, n, f"{s} {n}\n") for k, s in enumerate(("train", "valid")) for n in range(3)]


def test_perplexities_of_null_and_repeated_keys(spark):
    from veil.operators import attack as A
    lm = A.fit_ngram_lm(spark.createDataFrame([("a b c a b",), ("b c d",)], "text string"))
    rows = [(None, "a b c"), (1, "a b"), (1, "c d e"), (None, None), (2, "a"), (3, "a b c")]
    got = A.perplexity(spark.createDataFrame(rows, "k int, text string"), lm, "text", ["k"]).collect()
    assert len(got) == 6 and {(r.k, r.ppl is None) for r in got} == {(None, False), (1, False), (None, True), (2, True), (3, False)}
    by = sorted(r.ppl for r in got if r.k in (None, 3) and r.ppl is not None)
    assert by[0] == by[1]                                        # equal texts, equal figures
    gens = [(None, "a b", "c d", "AIRLINE"), (7, "a b", "check c", "AIRLINE"), (7, "b", "c", "AIRLINE"), (7, "b", "c", "AIRLINE"),
            (8, "a b", "", "AIRLINE"), (9, None, "c", "AIRLINE")]
    out = A.attack_results(spark.createDataFrame(gens, "gen_id int, prompt string, gen string, domain string"), lm, lm, ["AIRLINE"]).collect()
    assert sorted(str(r.gen_id) for r in out) == ["7", "7", "7", "8", "9", "None"]
    assert [r.success for r in out if r.gen == "check c"] == [True] and [r.success for r in out if r.gen_id == 8] == [None]
    assert all((r.target_ppl is None) == (r.gen_id in (8, 9)) for r in out if r.gen != "c" or r.prompt is None)


def test_conversations_of_a_null_domain_stay(spark):
    from veil.operators import dialogue as D
    turns = spark.createDataFrame([(None, "c1", 0), ("x", "c2", 0), ("x", "c3", 0)], "domain string, conversation_id string, turn int")
    manifest = spark.createDataFrame([(None, "test", 0, "c1"), ("x", "test", 0, "c2"), ("x", "test", 1, "c3")],
                                     "domain string, split string, pos long, conversation_id string")
    got = D.limit_prompt_conversations(turns, manifest, 1).collect()
    assert sorted((str(r.domain), r.conversation_id, r.split) for r in got) == [("None", "c1", "test"), ("x", "c2", "test")]
