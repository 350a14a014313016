import math
from collections import Counter

from veil.operators import redaction as R

TRAIN = [("A", "the cat sat"), ("A", "the cat ran"), ("B", "dog ran far"), ("B", "the dog")]


def _py_nb(train, lo, hi, alpha=1.0):
    def feats(t):
        toks = t.lower().split()
        return [" ".join(toks[i:i + n]) for n in range(lo, hi + 1) for i in range(len(toks) - n + 1)]
    labels = sorted({l for l, _ in train})
    cnt = {l: Counter() for l in labels}
    for l, t in train:
        cnt[l].update(feats(t))
    vocab = set().union(*cnt.values())
    V = len(vocab)
    nd = Counter(l for l, _ in train)
    prior = {l: math.log(nd[l] / len(train)) for l in labels}

    def probs(text):
        jll = {}
        for l in labels:
            tot = sum(cnt[l].values())
            jll[l] = prior[l] + sum(math.log((cnt[l][f] + alpha) / (tot + alpha * V)) for f in feats(text) if f in vocab)
        m = max(jll.values())
        z = sum(math.exp(v - m) for v in jll.values())
        return {l: math.exp(jll[l] - m) / z for l in labels}
    return probs


def test_nb_scores_match_python(spark):
    train = spark.createDataFrame(TRAIN, "label string, text string")
    model = R.fit_naive_bayes(train, "text", "label", 1, 2)
    items = ["the cat", "dog", "unknown words", "The Dog ran"]
    df = spark.createDataFrame([(t,) for t in items], "gram string")
    got = {(r["gram"], r["label"]): r["prob"] for r in R.nb_score(df, model, "gram").collect()}
    ref = _py_nb(TRAIN, 1, 2)
    for t in items:
        for l, p in ref(t).items():
            assert math.isclose(got[(t, l)], p, rel_tol=1e-9), (t, l)


def test_classifier_redaction_threshold_is_strict(spark):
    train = spark.createDataFrame(TRAIN, "label string, text string")
    model = R.fit_naive_bayes(train, "text", "label", 1, 1)
    ref = _py_nb(TRAIN, 1, 1)
    thr = ref("dog")["B"]                       # exactly at the threshold: not private (strict >)
    df = spark.createDataFrame([(1, "dog cat")], "id int, utterance string")
    out = R.redact_by_classifier(df, model, thr - 1e-12, "utterance").first()["utterance"]
    assert "dog" not in out
    out2 = R.redact_by_classifier(df, model, thr + 1e-9, "utterance").first()["utterance"]
    assert out2.startswith("dog")
