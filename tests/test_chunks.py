"""Look-ups a chunk of rows at a time, and the fold with n-grams that meet inserted tokens."""

import random

from pyspark.sql import functions as F

from veil.functions import chunks, fold
from veil.functions.ranking import positions
from veil.operators import attack as A
from veil.operators import lmdata as L
from veil.operators import redaction as R


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _loop(text, grams):
    for g in grams:
        text = text.replace(g, fold._redaction(g))
    return text


def test_pieces_of_the_token_need_no_loop(monkeypatch):
    """A word like "A" changes inserted tokens too: one pass over the text gives what the loop gives."""
    rng = random.Random(4)
    for _ in range(3000):
        letters = rng.choice(["abAB", "aAbEDR", "abA<>RT"])
        words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(1, 10))]
        text = rng.choice([" ", "  "]).join(words)
        grams = [g for g in [f"{a} {b}" for a, b in zip(words, words[1:])] + words if rng.random() < 0.6]
        grams = [g for i, g in enumerate(grams) if grams[:i].count(g) < 3]
        for most in (0, 1 << 40):
            monkeypatch.setattr(fold, "SEQUENTIAL", most)
            assert fold.fold_text(text, grams) == _loop(text, grams)
    calls = []
    monkeypatch.setattr(fold, "SEQUENTIAL", 0)
    monkeypatch.setattr(fold, "_replaced", lambda text, grams: calls.append(text) or _loop(text, grams))
    text = " ".join(f"w{i} A" for i in range(3))
    assert fold.fold_text(text, text.split()) == _loop(text, text.split())
    assert set(calls) == {"<REDACTED>"}                            # the loop ran over a token, not over the text


def test_numbers_of_words_and_neighbours():
    lists = [["b", "a", "b"], [], ["c"], ["a", "b"]]
    asked = chunks.words_and_pairs(7, lists)
    assert asked.column("w0").to_pylist() == ["a", "b", "c", "a", "b"]
    assert asked.column("w1").to_pylist() == [None, None, None, "b", "a"]
    x = chunks.Numbered(lists)
    assert x.words.take(x.codes).to_pylist() == ["b", "a", "b", "c", "a", "b"] and x.pair_of.tolist() == [1, 0, 0]
    words, pairs = x.known(asked.column("id").to_numpy()[[4, 1]], asked.column("id").to_numpy()[[4, 1]] * 2)
    assert words.tolist() == [0, 2, 0] and pairs[1] == 2 * asked.column("id")[4].as_py() and pairs[0] == 0


def test_texts_ask_by_chunk_for_their_scores(spark, monkeypatch):
    monkeypatch.setattr(chunks, "CHUNK_BYTES", 64)
    train = [("A", "the cat sat on A mat"), ("A", "the cat ran"), ("B", "dog ran far"), ("B", "the dog <b> far")]
    model = R.fit_naive_bayes(spark.createDataFrame(train, "label string, text string"), "text", "label", 1, 2)
    texts = ["the Cat sat", "A  cat A mat", "dog", "A", None, "", "far dog <b> far", "unknown", "the cat sat", " the\tcat "] * 3
    df = spark.createDataFrame([(i if i % 4 else None, "AB C"[i % 4], t) for i, t in enumerate(texts)], "id int, dom string, t string")
    probs = {r.gram: r.probs for r in R.nb_probs(spark.createDataFrame(
        [(g,) for t in texts if t for g in [*t.split(), *map(" ".join, zip(t.split(), t.split()[1:]))]], "gram string"), model).collect()}
    for dom in (None, "dom"):
        got = R.redact_by_classifier(df, model, 0.6, "t", "out", dom)
        assert "FlatMapCoGroupsInArrow" in _plan(got) and got.columns == ["id", "dom", "t", "out"]
        want = []
        for r in df.collect():
            toks = (r.t or "").split()
            pairs = [" ".join(x) for x in zip(toks, toks[1:])] if len(toks) > 1 else toks
            hot = [g for g in pairs + toks if any(p > 0.6 and (dom is None or label == r.dom)
                                                  for label, p in zip(model["labels"], probs[g]))]
            want.append((r.id, r.dom, r.t, None if r.t is None else _loop(r.t, hot)))
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_a_small_dictionary_table_meets_the_ngrams_where_they_stand(spark):
    rows = [(1, "en", "See one two, two."), (None, "de", "A one  A two"), (1, "en", "See one two, two."), (3, None, "one"), (4, "en", None),
            (5, "de", "nothing"), (6, "en", "")]
    df = spark.createDataFrame(rows, "id int, lang string, t string")
    words = [("en", "one two"), ("en", "TWO"), ("de", "a"), ("de", "one")]
    for dom in (None, "lang"):
        kw = spark.createDataFrame(words, "domain string, phrase string")
        got = R.redact_keywords(df, kw if dom else kw.select("phrase"), "t", "out", domain_col=dom)
        plan = _plan(got)
        assert "SortMergeJoin [__key" not in plan and "hashpartitioning(__key" not in plan.split("BroadcastExchange")[0]
        as_array = {d: [p for x, p in words if x == d] for d in ("en", "de")} if dom else [p for _, p in words]
        want = R.redact_keywords(df, as_array, "t", "out", domain_col=dom)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_only_asked_bigrams_are_counted(spark, monkeypatch):
    monkeypatch.setattr(chunks, "CHUNK_BYTES", 128)
    corpus = spark.createDataFrame([(t,) for t in ["a b a b c", "x y z w v u", None, "solo", "c A b"]], "text string")
    gens = spark.createDataFrame([(None, "a b", "A b c"), (1, "x", "q"), (1, "A", ""), (1, "a b", None), (2, None, "a b"),
                                  (None, "a b", "A b c"), (3, "", "a b a")], "cid int, prompt string, gen string")
    asked = A.asked_of_generations(gens)
    whole, part = A.fit_ngram_lm(corpus), A.fit_ngram_lm(corpus, asked=asked)
    assert {(r.prev, r.tok): r.c_pair for r in whole["pair"].collect()}[("a", "b")] == 2
    assert {tuple(r) for r in part["pair"].collect()} == {("a", "b", 2), ("b", "a", 1), ("b", "c", 1), ("A", "b", 1)}
    for name in ("ctx", "V"):                                  # contexts and V are of the whole corpus
        assert sorted(map(str, part[name].collect())) == sorted(map(str, whole[name].collect()))
    one, two = (A.attack_results(gens, lm, lm, ["AIRLINE"], with_zlib=False, near_cols=near) for lm, near in ((whole, ()), (part, ["cid"])))
    assert "posexplode" not in _plan(two) and one.columns == two.columns
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))
    # the prompt has one word: its perplexity is undefined
    assert [(r.target_ppl, r.lower_ppl is None) for r in two.where("prompt = 'x' or gen = 'a b a'").collect()] == [(None, True)] * 2
    p = A.perplexity(spark.createDataFrame([(1, "a b A b c"), (2, "a b")], "item_id int, text string"), whole)
    p = {r.item_id: r.ppl for r in p.collect()}
    assert all(abs(r.target_ppl - p[1] / p[2]) < 1e-12 for r in two.where("gen = 'A b c'").collect())


def test_positions_without_groups_do_not_shuffle_twice(spark):
    got = positions(spark.range(50).withColumn("x", F.col("id") % 7), [], ["x", "id"])
    assert "SortMergeJoin" not in _plan(got)
    assert [r.id for r in sorted(got.collect(), key=lambda r: r.pos)] == sorted(range(50), key=lambda i: (i % 7, i))


def test_tokens_travel_once_a_chunk_and_blocks_stay_in_their_partition(spark, monkeypatch):
    monkeypatch.setattr(L, "TOKEN_BYTES", 40)
    rng = random.Random(8)
    rows = [(i if i % 9 else None, None if i % 11 == 5 else " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 30)))) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, t string")
    vocab = spark.createDataFrame([(c, i) for i, c in enumerate("abcdefg")], "token string, id int")
    ids = L.tokenize(df, vocab, "t")
    assert "FlatMapCoGroupsInArrow" in _plan(ids) and "Generate" not in _plan(ids)
    want = [(k, ["abcdefg".find(w) for w in (t or "").split()]) for k, t in rows]
    assert sorted(map(str, ((r.k, list(r.input_ids)) for r in ids.collect()))) == sorted(map(str, want))
    one = [(i, x) for i, (_, x) in enumerate(want)]
    packed = L.pack_blocks(spark.createDataFrame(one, "k int, ids array<int>").repartition(3), "ids", "k", 16, map_batch=70)
    assert "Window" not in _plan(packed) and packed.columns == ["map_batch", "block", "input_ids", "labels"]
    got = {(r.map_batch, r.block): (list(r.input_ids), list(r.labels)) for r in packed.collect()}
    flat = [[x for _, ids in one[b:b + 70] for x in ids] for b in range(0, 200, 70)]
    assert got == {(b, j): (f[16 * j:16 * j + 16],) * 2 for b, f in enumerate(flat) for j in range(len(f) // 16)}
