"""Gradient norms in three forms, domain decisions, packing, encoding, Poisson batches."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from veil.operators import factor_norms as FN
from veil.operators import lmdata as L
from veil.operators import privacy as P
from veil.operators import redaction as R

# --- per-example norms ------------------------------------------------------------------


def factor_rows(seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for key, t in ((1, 1), (2, 3), (3, 40), (None, 5), (4, 300)):
        rows += [(key, i, rng.normal(size=4).tolist(), rng.normal(size=3).tolist()) for i in range(t)]
    rows += [(2, 3, rows[1][2], rows[1][3])] * 2                         # equal positions count again
    return rows + [(5, 0, None, [1.0, 2.0, 3.0])]


@pytest.mark.parametrize("pos", [None, "t"])
def test_all_forms_give_the_norm_of_the_gradient(spark, pos):
    rows = factor_rows()
    want = {}
    for key in {r[0] for r in rows if r[2] is not None}:
        g = sum(np.outer(r[3], r[2]) for r in rows if r[0] == key and r[2] is not None)
        want[key] = float(np.linalg.norm(g))
    df = spark.createDataFrame(rows, "k int, t int, a array<double>, b array<double>").repartition(5)
    for form in ("auto", "gram", "direct"):
        got = {r.k: r.weight_norm for r in FN.factor_norms(df, "k", "a", "b", form, pos).collect()}
        assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want), form
    one = {r.k: r.weight_norm for r in FN.product_norms(df.where("k = 1"), "k", "a", "b").collect()}
    assert math.isclose(one[1], want[1], rel_tol=1e-12)


def test_a_form_by_its_name_only(spark):
    with pytest.raises(ValueError):
        FN.factor_norms(spark.createDataFrame([(1, [1.0], [1.0])], "k int, a array<double>, b array<double>"), "k", "a", "b", "other")


# --- which domains redact a text --------------------------------------------------------


def test_domains_equal_one_fold_per_domain(spark):
    """Blanks in a row, parts of words, unsafe n-grams, the token itself, nulls and repeated rows."""
    private = {"de": ["a b", "car", "<x>", "ACT", "y  z"], "es": ["b c", "Q", "RED"], "fr": []}
    texts = ["a b c", "a  b", "xa by", "care", "q", "<x> y", "a\tb c", "", None, "<REDACTED> here", "b  c care", "a b c", "y  z", "RED b c"]
    scores = spark.createDataFrame([(g, d, 0.9) for d, gs in private.items() for g in gs] + [("zzz", "de", 0.1)],
                                   "gram string, label string, prob double")
    domains = ["es", "de", "fr"]
    bits = R.score_bits(scores, domains, 0.5)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.redacted_in for r in R.redacted_domains(df, bits, "t", domains, 1, 2).collect()}
    want = {}
    for d in domains:
        hot = scores.where((F.col("label") == d) & (F.col("prob") > 0.5)).withColumn("label", F.lit("any"))
        out = R.redact_by_scores(df, hot, 0.5, "t", "r", lo=1, hi=2).select("i", R.is_redacted("r").alias("is")).collect()
        for r in out:
            want.setdefault(r.i, []).extend([d] if r["is"] else [])
    want[texts.index(None)] = None
    assert got == want


def test_too_many_domains(spark):
    with pytest.raises(ValueError):
        R.score_bits(spark.createDataFrame([("g", "d", 1.0)], "gram string, label string, prob double"),
                     [f"d{i}" for i in range(63)], 0.5)


# --- encoding and packing ---------------------------------------------------------------


def test_null_and_repeated_keys_keep_their_ids(spark):
    rows = [(None, "a b"), (2, "b c"), (2, "c"), (None, None), (3, ""), (4, "a " * 50), (5, "new a")]
    vocab = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "token string, id int")
    df = spark.createDataFrame(rows, "k int, t string")
    ids = {"a": 1, "b": 2, "c": 3}
    want = sorted((str(k), [ids.get(w, -1) for w in (t or "").split()]) for k, t in rows)
    for hot in (0, 1, 1000):
        got = L.tokenize(df, vocab, "t", ["k"], hot=hot)
        assert got.columns == ["k", "input_ids"]
        assert sorted((str(r.k), list(r.input_ids)) for r in got.collect()) == want


def test_packing_equals_the_concatenation(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.integers(1, 99, size=int(rng.choice([0, 1, 3, 7, 40]))).tolist()) for i in range(60)] + [(60, None)]
    df = spark.createDataFrame(rows, "k int, ids array<int>").repartition(4)
    got = {(r.map_batch, r.block): (list(r.input_ids), list(r.labels)) for r in L.pack_blocks(df, "ids", "k", 8, map_batch=10).collect()}
    want = {}
    for b in range(0, 61, 10):
        flat = [x for _, ids in rows[b:b + 10] for x in ids or []]
        for j in range(len(flat) // 8):
            want[b // 10, j] = (flat[8 * j:8 * j + 8],) * 2
    assert got == want


# --- batches ----------------------------------------------------------------------------


def poisson_by_steps(key, rate, steps, seed):
    out, at, j = [], -1, 0
    while True:
        u = (int(hashlib.md5(f"{seed}:{key}:{j}".encode()).hexdigest()[:13], 16) + 1) / 2**52
        at += 1 + math.floor(math.log(u) / math.log(1 - rate))
        if at >= steps:
            return out
        out.append(at)
        j += 1


def test_poisson_batches(spark):
    rows = [(i, f"k{i}") for i in range(400)] + [(400, "k3"), (401, None)]
    df = spark.createDataFrame(rows, "i int, k string")
    got = {}
    for r in P.poisson_batches(df, "k", 0.1, 50, 3).collect():
        got.setdefault(r.i, []).append(r.batch)
    want = {i: b for i, k in rows if (b := poisson_by_steps(k or "null", 0.1, 50, 3))}
    assert {k: sorted(v) for k, v in got.items()} == want
    n = sum(map(len, got.values()))
    assert abs(n / (402 * 50) - 0.1) < 0.01                              # the rate, and batches of unequal sizes
    assert P.poisson_batches(df, "k", 1.0, 3, 3).count() == 3 * 402
    assert P.poisson_batches(df, "k", 1e-15, 10, 3).count() == 0


def test_batches_of_null_groups_stay(spark):
    df = spark.createDataFrame([(i, None if i % 2 else "g") for i in range(12)], "i int, g string")
    assert P.assign_batches(df, 3, 1, "i", drop_last=True, group_cols=["g"]).count() == 12


def test_contents_of_mixed_batches(spark):
    mix = spark.createDataFrame([(0, True, 0, 0), (1, False, 1, 1), (2, True, 0, 2), (3, False, 1, 0)],
                                "step int, redacted boolean, private_batch int, public_batch int")
    private = spark.createDataFrame([(f"p{i}", i // 2) for i in range(4)], "item string, batch int")
    public = spark.createDataFrame([(f"u{i}", i // 3) for i in range(7)], "item string, batch int")
    got = {}
    for r in P.mixed_batch_rows(mix, private, public).collect():
        got.setdefault(r.step, set()).add(r.item)
    assert got == {0: {"u0", "u1", "u2"}, 1: {"p2", "p3"}, 2: {"u6"}, 3: {"p2", "p3"}}
