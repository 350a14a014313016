"""BPE against the tokenizer library, token counts and language lattices against plain loops."""

import hashlib
import math
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from pyspark.sql import functions as F

from tests.llm.conftest import DATA
from veil.llm import bpe, common, language_id, token_counts
from veil.llm import pieces as P
from veil.llm.queries import QUERIES


@pytest.fixture(scope="module")
def library():
    ranks = bpe.Ranks(common.bounded_file(common.vocabulary_path("byte_bpe_50k.tiktoken")))
    return ranks, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks.ids, special_tokens={})


def test_random_texts_as_the_library(library):
    ranks, own = library
    random.seed(1)
    letters = "aab 'stlldre\n\t  éß\x85\xa0 \x1c　 日本語12３#!😀ẞ\r "
    texts = ["".join(random.choice(letters) for _ in range(random.randrange(60))) for _ in range(4000)]
    texts += ["", "  ", "\n\n a", "x" * 257, "a" * 3000, "ab" * 5000 + " x", "Don't we'll 'S I'm"]
    flat, counts = bpe.Encoder(ranks, public_tokenizers.PATTERN).encode(texts)
    ends = np.cumsum(counts)
    for text, end, n in zip(texts, ends, counts):
        assert flat[end - n:end].tolist() == own.encode_ordinary(text), text


def test_single_and_row_merges_agree(library):
    ranks, _ = library
    random.seed(2)
    pieces = ["".join(random.choice("theingéa") for _ in range(random.randrange(2, 60))).encode() for _ in range(500)]
    for size in (64, 128):
        part = [p for p in pieces if len(p) <= size]
        flat, counts = ranks.merge_rows(part, size)
        ends = np.cumsum(counts)
        assert [flat[e - n:e].tolist() for e, n in zip(ends, counts)] == [ranks.merge_long(p) for p in part]


def test_query_digests_and_round_trip(spark, library):
    _, own = library
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    rows = QUERIES["op2_byte_bpe"](spark, DATA).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = own.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (
            len(ids), sha(" ".join(map(str, ids)).encode()), sha(docs[r.doc_id].encode()))


PIECES = ["a", "b", "ab", "ba", "abc", "▁", "▁a", "bb", "c", "cab", "▁ab"]


def loop_forward(word, log_p, byte_log_p):
    """(tokens, best score, forward score) by the plain quadratic recurrences."""
    place = {p: k for k, p in enumerate(PIECES)}
    forward, best = [0.0], [(0.0, 0)]
    for j in range(1, len(word) + 1):
        sums, cands = [], []
        for i in range(j):
            if word[i:j] in place:
                lp = log_p[place[word[i:j]]]
                sums.append(forward[i] + lp)
                cands.append((-(best[i][0] + lp), best[i][1] + 1))
        if word[j - 1] not in place:
            n = len(word[j - 1].encode())
            sums.append(forward[-1] + n * byte_log_p)
            cands.append((-(best[-1][0] + n * byte_log_p), best[-1][1] + n))
        forward.append(np.logaddexp.reduce(sums))
        score, tokens = min(cands)
        best.append((-score, tokens))
    return best[-1][1], best[-1][0], forward[-1]


def test_trie_and_lattice_against_loops():
    random.seed(3)
    log_p, byte_log_p = P.rank_log_probs(len(PIECES))
    model = token_counts.Model(P.PieceTrie.of(PIECES), log_p, byte_log_p)
    words = list({"▁" + "".join(random.choice("abcxé日") for _ in range(random.randrange(9))) for _ in range(1500)})
    tokens, best, forward = token_counts.count_words(words, model)
    lattice = P.Lattice.of(words, model.trie)
    w = lattice.weights(log_p[:, None], np.array([byte_log_p]))
    alpha, beta = lattice.forward(w)[:, 0], lattice.backward(w)[:, 0]
    for k, word in enumerate(words):
        n, b, f = loop_forward(word, log_p, byte_log_p)
        assert tokens[k] == n and math.isclose(best[k], b, abs_tol=1e-9) and math.isclose(forward[k], f, abs_tol=1e-9)
        assert math.isclose(alpha[lattice.first[k] + lattice.lens[k]], f, abs_tol=1e-9)
        assert math.isclose(beta[lattice.first[k]], f, abs_tol=1e-9)


def test_token_counts_add_up_over_words(spark):
    rows = {r.doc_id: r for r in QUERIES["op5_token_counts"](spark, DATA).collect()}
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(20).collect()
    model = token_counts.read_model(common.vocabulary_path("piece_bpe_32k.model"))
    for d in docs:
        words = ["▁" + w for w in d.text.replace("\x0b", " ").split()]
        tokens, best, forward = token_counts.count_words(list(dict.fromkeys(words)), model)
        at = {w: k for k, w in enumerate(dict.fromkeys(words))}
        r = rows[d.doc_id]
        assert r.n_pretokens == len(words) and r.n_tokens == sum(int(tokens[at[w]]) for w in words)
        assert math.isclose(r.forward_score, sum(forward[at[w]] for w in words), rel_tol=1e-9)


def test_languages_held_out(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = QUERIES["op4_language_id"](spark, "/root/testdata/sf0.01").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(lang) and 200 < len(held) < 500
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_texts_without_letters(spark):
    docs = spark.createDataFrame([(1, "12 34 !!", "en"), (2, None, "en"), (3, "the and", "en"), (4, "der die", "de")],
                                 "doc_id long, text string, lang string")
    model = language_id.fit(docs, common.vocabulary_path("piece_bpe_32k.model"))
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(docs, model).collect()}
    assert got[1] == got[2] == ("und", 0.0) and got[3][0] == "en" and got[4][0] == "de"
    # piece probabilities of a language sum to one, bytes outside included
    assert np.allclose(np.exp(model.log_p).sum(axis=0) + 256 * np.exp(model.byte_log_p), 1)


def test_numerals_are_no_letters(spark):
    """Number characters that count as word characters have no language; letters around them do."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = language_id.fit(docs, common.vocabulary_path("piece_bpe_32k.model"))
    texts = ["½ ②", "Ⅷ", "²", "12 _ !", "", None, "der Tisch und die Stühle", "② der Tisch und die Stühle ½"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.lang_pred for r in language_id.predict(df, model).collect()}
    # a numeral sign of category Nl is a letter to no one but the regular expression
    assert [got[k] for k in range(6)] == ["und"] * 6 and got[6] == got[7] != "und"


def test_a_sample_never_shrinks_to_nothing(spark):
    ids = spark.range(20_000).select(F.col("id").cast("string").alias("id"))
    assert ids.where(common.in_sample("id", 5, 5)).count() == 20_000
    assert 800 < ids.where(common.in_sample("id", 1, 20)).count() < 1200
    share = ids.where(common.in_sample("id", 3_000, 10**13))._jdf.queryExecution().optimizedPlan().toString()
    assert "LocalRelation <empty>" not in share              # a share of 3e-10 still takes hashes
