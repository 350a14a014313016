"""Pairing search by bounds against the score of every pairing."""

import itertools

import numpy as np
import pytest

from veil.operators import fewshot, label_search


def data(spark, seed, n=60, v=12, classes=3, learnable=True):
    rng = np.random.default_rng(seed)
    y = rng.integers(classes, size=n)
    logits = rng.normal(size=(n, v))
    if learnable:
        logits[np.arange(n), y] += 1.5
    logits = logits.round(1)                                          # many ties
    rows = [(logits[i].tolist(), int(y[i])) for i in range(n)]
    return spark.createDataFrame(rows + [(None, 1), (logits[0].tolist(), None)], "l array<double>, y int"), logits, y


def brute(logits, y, words):
    out = []
    for m, pick in enumerate(itertools.product(*words)):
        out.append((int((np.argmax(logits[:, list(pick)], axis=1) == y).sum()), m))
    return sorted(out, key=lambda p: (-p[0], p[1]))


@pytest.mark.parametrize("seed,learnable", [(1, True), (2, False)])
def test_best_pairings_equal_brute_force(spark, seed, learnable):
    df, logits, y = data(spark, seed, learnable=learnable)
    words = [np.array([0, 3, 4, 7, 8]), np.array([1, 3, 5, 9]), np.array([2, 6, 10, 11, 0])]
    for boxes, top in ((4, 3), (64, 7)):
        assert label_search.best_pairings(df, words, "l", "y", top, boxes) == brute(logits, y, words)[:top]


def test_search_takes_both_ways_to_the_same_result(spark):
    df, logits, y = data(spark, 4)
    cands = {0: [0, 3, 4], 1: [1, 5, 9, 2], 2: [2, 6, 10]}
    rows = [fewshot.search_label_words(df, cands, "l", "y", 6, exhaustive=limit).collect() for limit in (1, 1000)]
    assert rows[0] == rows[1]
    want = brute(logits, y, [np.array(cands[c]) for c in range(3)])[:6]
    assert [(round(r.accuracy * len(y)), r.pairing) for r in rows[0]] == want


def test_tiles_are_all_scored(spark):
    df, logits, y = data(spark, 5, classes=2)
    words = [np.arange(12), np.arange(12)]
    got = {r.pairing: r.hits for r in label_search.tile_sums(df, words, "l", "y", tile=10).collect()}
    assert got == {m: h for h, m in brute(logits, y, words)}


def test_a_billion_pairings_in_bounded_memory(spark):
    """Three classes of a thousand words: the planted words are found by a few passes."""
    rng = np.random.default_rng(3)
    n, v = 40, 3000
    y = rng.integers(3, size=n)
    logits = rng.normal(size=(n, v)) * 0.01
    for c, w in enumerate((17, 1400, 2999)):
        logits[y == c, 1000 * c:1000 * (c + 1)] -= 5.0                # words of its own class that do not tell it
        logits[y == c, w] += 10.0
    df = spark.createDataFrame([(logits[i].tolist(), int(y[i])) for i in range(n)], "l array<double>, y int")
    words = [np.arange(0, 1000), np.arange(1000, 2000), np.arange(2000, 3000)]
    (hits, m), = label_search.best_pairings(df, words, "l", "y", 1)
    assert hits == n and m == (17 * 1000 + 400) * 1000 + 999
