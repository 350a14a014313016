"""Checks for the operators without a SQL twin."""

import math
import zlib

import numpy as np
from pyspark.sql import functions as F

from veil.operators import attack as A
from veil.operators import lmdata as L
from veil.operators import privacy as P
from veil.operators import spectral as V


def test_zlib_entropy_matches_python(spark):
    texts = ["", "hello hello hello", "ünïcödé text", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(A.zlib_entropy(F.col("t"))).collect()]
    assert got == [None, len(zlib.compress(b"hello hello hello")), len(zlib.compress("ünïcödé text".encode())), None]


def test_mlm_mask_properties(spark):
    rows = [(i, list(range(1, 201))) for i in range(50)]
    df = spark.createDataFrame(rows, "k long, ids array<int>")
    inp, lab = L.mlm_mask("ids", 0, "k", special_ids=[1], mask_id=-1, vocab_size=1000)
    out = df.select("ids", inp.alias("inp"), lab.alias("lab")).collect()
    sel = total = 0
    for r in out:
        for x, i, l in zip(r["ids"], r["inp"], r["lab"]):
            total += 1
            if l == -100:
                assert i == x                    # unselected tokens are untouched
            else:
                sel += 1
                assert l == x and x != 1         # label = original, specials never selected
    assert 0.12 < sel / total < 0.18


def test_dp_noise_scale(spark):
    rng = np.random.default_rng(0)
    vecs = rng.normal(size=(300, 20))
    df = spark.createDataFrame([(v.tolist(),) for v in vecs], "v array<double>")
    clean = {r["pos"]: r["value"] for r in P.dp_clipped_sum(df, "v", 0.5, 0.0, 1).collect()}
    noisy = {r["pos"]: r["value"] for r in P.dp_clipped_sum(df, "v", 0.5, 4.0, 1, seed=1).collect()}
    diff = np.array([noisy[p] - clean[p] for p in range(20)])
    assert 0.5 * 2.0 < diff.std() < 2.0 * 2.0          # σC = 2


def test_geometric_median_reduces_loss(spark):
    rng = np.random.default_rng(0)
    beta = 0.2 + rng.normal(size=(400, 5)) * 0.1
    df = spark.createDataFrame([(b.tolist(),) for b in beta], "v array<double>")
    ar = P.geometric_median_weights(5, "linear")
    res = P.dp_geometric_median(df, df, "v", steps=30, lr=0.5, epsilon=1e6, delta=1e-5)
    assert res["train_loss"] < P.geometric_median_loss(df, "v", np.zeros(5), ar)


def test_quadrature_weights_sum_to_one(spark):
    rng = np.random.default_rng(0)
    A_ = rng.normal(size=(100, 8))
    df = spark.createDataFrame([(a.tolist(),) for a in A_], "a array<double>")
    T = V.lanczos(df, "a", iters=8)
    tri = spark.createDataFrame([(0, np.diag(T).tolist(), np.diag(T, 1).tolist())],
                                "draw long, alphas array<double>, betas array<double>")
    q = V.quadrature(tri).collect()
    assert math.isclose(sum(r["weight"] for r in q), 1.0, rel_tol=1e-9)
    assert [r["eig"] for r in q] == sorted(r["eig"] for r in q)
