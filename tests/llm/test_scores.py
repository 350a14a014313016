"""Class bigrams and quality rules against brute force."""

import collections
import math
import re
import zlib

import numpy as np
import pytest

from veil.llm import class_lm, quality
from veil.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
WORDS = re.compile("[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def tokens(text):
    return WORDS.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text)) + [""]


def test_base_score_and_gain_on_held_out_texts(spark, docs, monkeypatch):
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in docs}
    count = collections.Counter(t for i, x in docs.items() if not held[i] for t in tokens(x))
    n, v = sum(count.values()), len(count)
    # few listed words, so that most counts come through the join
    monkeypatch.setattr(class_lm, "LISTED", 5_000)
    rows = QUERIES["op1_class_lm"](spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ts = tokens(docs[r.doc_id])
        base = sum(math.log10((count[t] + 0.5) / (n + 0.5 * (v + 1))) for t in ts)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (
            held[r.doc_id], len(ts), sum(t in count for t in ts), n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9)
    out = [r for r in rows if r.held_out]
    assert sum(r.score for r in out) > 0.95 * sum(r.base_score for r in out)


def test_model_is_a_distribution(spark):
    texts = ["a b a c", "b a b", "d e f", "a a", "e d"] * 3
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    counts = class_lm.word_counts(df)
    model = class_lm.fit(df, counts)
    assert np.allclose((10 ** model.log_trans).sum(axis=1), 1)
    # known words, the unknown word of each group, and the end token, given any class before
    group_v = collections.Counter(i for w, (i, _) in model.listed.items() if i > class_lm.OWN)
    item_p = 10 ** model.log_item
    mass = np.zeros(class_lm.CLASSES)
    for i in range(class_lm._ITEMS):
        p = item_p[i]
        if i > class_lm.OWN:
            inside = [n for w, (k, n) in model.listed.items() if k == i]
            p = p * (sum(n + 0.5 for n in inside) + 0.5)
        mass[model.item_class[i]] += p
    used = np.unique(model.item_class)
    assert np.allclose(mass[used], 1), group_v


def test_exchange_separates_two_vocabularies():
    rng = np.random.default_rng(5)
    pairs = np.zeros((20, 20), dtype=int)
    for _ in range(4000):
        side = rng.integers(2) * 10
        pairs[side + rng.integers(10), side + rng.integers(10)] += 1
    cls = class_lm.exchange(pairs, classes=2)
    assert len(set(cls[:10])) == 1 and len(set(cls[10:])) == 1 and cls[0] != cls[10]


def rule_figures(text):
    w = WORDS.findall(text)
    grams = [tuple(w[k:k + 3]) for k in range(len(w) - 2)]
    n = collections.Counter(grams)
    hit = {j for k, g in enumerate(grams) if n[g] > 1 for j in (k, k + 1, k + 2)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORDS.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def test_rules_and_verdicts(spark, docs):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = QUERIES["op3_quality_rules"](spark, SF).collect()
    assert len(rows) == len(docs)
    good = [0, 0]
    for r in rows:
        n, chars, symbols, dup, repeat = rule_figures(docs[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeat)
        assert r.base_failed == (n < 50 or 100 * repeat > 50 * n)
        assert not (r.kept and r.base_failed)
        if r.doc_id in labels and not r.base_failed:
            good[labels[r.doc_id] == r.kept] += 1
    assert good[1] >= 0.98 * sum(good)


def test_score_is_the_mean_log_ratio(spark):
    rows = [(k, t, None) for k, t in enumerate(["good words here " * 3, "bad ### words", "", None, "good", "x y z x y z"])]
    df = spark.createDataFrame(rows, "doc_id long, text string, extra string")
    labels = spark.createDataFrame([(0, 1), (1, 0), (4, 1)], "doc_id long, quality int")
    model = quality.fit(df, labels)
    crc = lambda w: zlib.crc32(w.encode())

    def buckets(text):
        w = [crc(x) for x in (text or "").split()]
        m = (1 << 64) - 1
        one = [(h * 0x9E3779B97F4A7C15 & m) >> 48 for h in w]
        two = [(a * 0x9E3779B97F4A7C15 + b) & m for a, b in zip(w, w[1:])]
        return one + [((p ^ p >> 29) * 0x9E3779B97F4A7C15 & m) >> 48 for p in two]

    raw, good = collections.Counter(), collections.Counter()
    for k, t, _ in rows:
        raw.update(buckets(t))
        if k in (0, 4):
            good.update(buckets(t))
    raw_n, good_n = (sum(c.values()) + 0.5 * quality.BUCKETS for c in (raw, good))
    for r in quality.judge(df, model).collect():
        b = buckets(rows[r.doc_id][1])
        want = [math.log((good[x] + 0.5) / good_n) - math.log((raw[x] + 0.5) / raw_n) for x in b]
        assert math.isclose(r.score, sum(want) / len(b) if b else 0.0, rel_tol=1e-9, abs_tol=1e-12)


def test_cut_loses_few_of_the_good():
    good, bad = np.linspace(0, 1, 1001), np.linspace(-1, 0.3, 500)
    cut = quality.choose_cut(good, np.sort(bad))
    assert (good < cut).mean() <= quality.TRUSTED_LOSS and (bad < cut).mean() > 0.7
    assert quality.choose_cut(good, np.array([])) == -np.inf
