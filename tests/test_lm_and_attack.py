import math
from collections import Counter

from pyspark.sql import functions as F

from veil.operators import attack as A
from veil.operators import lmdata as L


CORPUS = ["the cat sat on the mat", "the dog sat", "a cat and a dog", "solo"]


def _py_lm(corpus, k=1.0):
    pair, ctx, vocab = Counter(), Counter(), set()
    for t in corpus:
        toks = t.split()
        vocab |= set(toks)
        for a, b in zip(toks, toks[1:]):
            pair[(a, b)] += 1
            ctx[a] += 1
    V = len(vocab)

    def ppl(text):
        toks = text.split()
        if len(toks) < 2:
            return None
        lps = [math.log((pair[(a, b)] + k) / (ctx[a] + k * V)) for a, b in zip(toks, toks[1:])]
        return math.exp(-sum(lps) / len(lps))
    return ppl


def test_bigram_perplexity_matches_python(spark):
    corpus = spark.createDataFrame([(t,) for t in CORPUS], "text string")
    lm = A.fit_ngram_lm(corpus, "text", 1.0)
    items = ["the cat sat", "unknown words here", "x", "a dog sat on the mat"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id int, text string")
    got = {r["item_id"]: r["ppl"] for r in A.perplexity(df, lm, "text", ["item_id"]).collect()}
    ref = _py_lm(CORPUS)
    for i, t in enumerate(items):
        e = ref(t)
        assert (got[i] is None and e is None) or math.isclose(got[i], e, rel_tol=1e-12), t


def test_conditional_perplexity_and_empty(spark):
    corpus = spark.createDataFrame([(t,) for t in CORPUS], "text string")
    lm = A.fit_ngram_lm(corpus, "text", 1.0)
    g = spark.createDataFrame([(1, "the cat", "sat on"), (2, "the dog", "")], "gen_id int, prompt string, gen string")
    got = {r["gen_id"]: r["c"] for r in A.conditional_perplexity(g, lm, ["gen_id"], out="c").collect()}
    ref = _py_lm(CORPUS)
    assert math.isclose(got[1], ref("the cat sat on") / ref("the cat"), rel_tol=1e-12)
    assert got[2] is None


def test_attack_success_keyword_mode(spark):
    g = spark.createDataFrame([(1, "Your BOOKING, please!"), (2, "nothing here"), (3, "")], "id int, gen string")
    out = {r["id"]: r["success"] for r in A.attack_success_keyword(g, "gen", ["AIRLINE"]).collect()}
    assert out == {1: True, 2: False, 3: None}


def test_pack_blocks_matches_python(spark):
    rows = [(i, list(range(i * 10, i * 10 + (i % 7) + 1))) for i in range(2500)]
    df = spark.createDataFrame(rows, "k long, ids array<int>")
    got = {(r["map_batch"], r["block"]): list(r["input_ids"]) for r in L.pack_blocks(df, "ids", "k", 16).collect()}
    exp = {}
    for b in range(0, 2500, 1000):
        flat = [x for _, ids in rows[b:b + 1000] for x in ids]
        n = len(flat) // 16
        for j in range(n):
            exp[(b // 1000, j)] = flat[j * 16:(j + 1) * 16]
    assert got == exp


def test_mask_and_split_at_separator(spark):
    df = spark.createDataFrame([([5, 6, 9, 7, 8],)], "ids array<int>")
    src, tgt = L.split_at_separator("ids", F.lit(9))
    r = df.select(L.mask_source_labels("ids", F.lit(9)).alias("lab"), src.alias("s"), tgt.alias("t")).first()
    assert list(r["lab"]) == [-100, -100, -100, 7, 8]
    assert list(r["s"]) == [5, 6] and list(r["t"]) == [9, 7, 8]
