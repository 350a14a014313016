"""Language identification with segmentation-marginalised unigrams.

Every language has a probability for each piece of a fixed public vocabulary.
The probability of a word is the sum over all its segmentations into pieces,
by the forward algorithm; a text is the product of its words.  The piece
probabilities are fitted by expectation maximisation (forward and backward
sums over the same lattice) on words of labelled training documents, counted
by Spark; a language's share of the sample is its prior.

The fit takes a sample of at most ``MAX_FIT_DOCS`` documents of each language
in expectation, by a hash of the id; every text is scored whole.

Results per case: null texts and texts without a letter are ``und`` with score
0; the same holds for all texts when no training row has a language; ties go
to the language first in alphabetical order; training rows with null language
are left out; repeated rows are scored alike; only the id, text and language
columns are read, the latter in the fit alone; texts are scored whole at any
length; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from functools import partial
from itertools import chain, groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veil.llm import common as C
from veil.llm import pieces as P

MAX_FIT_DOCS = 3_000
ROUNDS = 3                  # of expectation maximisation
SMOOTHING = 0.1             # expected count added to every piece
NONE = "und"
_LETTERS = re.compile(r"[^\W\d_]+")
_WORDS_KEPT = 300_000
_WORDS_AT_ONCE = 20_000
_FIXED_POINT = 1 << 20      # expected counts are summed as integers, so sums do not depend on their order


class Model(NamedTuple):
    langs: list[str]
    trie: P.PieceTrie
    log_p: np.ndarray       # [pieces, languages]
    byte_log_p: np.ndarray  # [languages]: a byte outside the pieces
    log_prior: np.ndarray


def _words(text: str) -> list[str]:
    """Runs of letters; numerals that are word characters but no letters part them."""
    out = []
    for w in _LETTERS.findall(text.lower()):
        if w.isalpha():
            out.append(w)
        else:
            out += ["".join(part) for letters, part in groupby(w, str.isalpha) if letters]
    return out


def _count_batches(batches):
    """Word counts of a task by language."""
    counts: dict[tuple[str, str], int] = {}

    def rows():
        keys = list(counts)
        out = pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array(
            [k[1] for k in keys], pa.string()), pa.array(list(counts.values()), pa.int64())], ["lang", "word", "n"])
        counts.clear()
        return out

    for batch in batches:
        for part in C.slices(batch, 1):
            for lang, text in zip(part.column(0).to_pylist(), C.texts_of(part, 1)):
                for w in _words(text):
                    counts[lang, w] = counts.get((lang, w), 0) + 1
            if len(counts) > _WORDS_KEPT:
                yield rows()
    yield rows()


def _expect_batches(batches, model):
    """Expected piece counts of a task's words, by language."""
    m = model.value
    total = np.zeros_like(m.log_p)
    number = {lang: k for k, lang in enumerate(m.langs)}
    for batch in batches:
        for a in range(0, batch.num_rows, _WORDS_AT_ONCE):
            part = batch.slice(a, _WORDS_AT_ONCE)
            k = np.array([number[x] for x in part.column(0).to_pylist()], dtype=np.int64)
            n = np.asarray(part.column(2), dtype=np.float64)
            words = [P.SPACE + w for w in part.column(1).to_pylist()]
            lattice = P.Lattice.of(words, m.trie)
            w = lattice.weights(m.log_p, m.byte_log_p)
            of_place = np.repeat(np.arange(len(words)), lattice.lens + 1)
            edge_lang = k[of_place[lattice.start]]
            w = np.take_along_axis(w, edge_lang[:, None], axis=1)       # each word in its own language
            alpha, beta = lattice.forward(w), lattice.backward(w)
            all_of = alpha[lattice.first + lattice.lens][of_place[lattice.start]]
            share = np.exp(alpha[lattice.start] + w + beta[lattice.end] - all_of)[:, 0] * n[of_place[lattice.start]]
            known = lattice.piece >= 0
            np.add.at(total, (lattice.piece[known], edge_lang[known]), share[known])
    piece, lang = np.nonzero(total > 0)
    fixed = np.round(total[piece, lang] * _FIXED_POINT).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(piece), pa.array(lang), pa.array(fixed)], ["piece", "lang", "n"])


def fit(df: DataFrame, piece_path: str, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
        max_docs: int = MAX_FIT_DOCS) -> Model:
    """Piece probabilities of every language of the rows of ``df``."""
    spark = df.sparkSession
    pieces = P.read_pieces(piece_path)
    trie = P.PieceTrie.of(pieces)
    rows = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"),
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"))
    seen = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}     # one row per language
    langs = sorted(seen)
    start, byte_log_p = P.rank_log_probs(len(pieces))
    log_p = np.repeat(start[:, None], len(langs), axis=1)
    prior = np.log(np.array([seen[x] for x in langs], dtype=float) / max(1, sum(seen.values())))
    model = Model(langs, trie, log_p, np.full(len(langs), byte_log_p), prior)
    if not langs:
        return model
    taken = F.lit(False)
    for lang, n in seen.items():
        taken = taken | ((F.col("lang") == lang) & C.in_sample("id", max_docs, n))
    words = (rows.where(taken).select("lang", "text")
             .mapInArrow(_count_batches, "lang string, word string, n long")
             .groupBy("lang", "word").agg(F.sum("n").alias("n")).persist())
    try:
        for _ in range(ROUNDS):
            shared = spark.sparkContext.broadcast(model)
            got = (words.mapInArrow(partial(_expect_batches, model=shared), "piece long, lang long, n long")
                   .groupBy("piece", "lang").agg(F.sum("n").alias("n")).collect())     # pieces x languages at most
            count = np.full((len(pieces), len(langs)), SMOOTHING)
            for r in got:
                count[r.piece, r.lang] += r.n / _FIXED_POINT
            whole = count.sum(axis=0) + SMOOTHING
            model = model._replace(log_p=np.log(count / whole), byte_log_p=np.log(SMOOTHING / 256 / whole))
    finally:
        words.unpersist()
    return model


class _Numbers(dict):
    """Numbers words in the order they are first seen."""

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def word_scores(words: list[str], model: Model) -> np.ndarray:
    """[words, languages] log probabilities, each summed over all segmentations."""
    out = [np.zeros((0, len(model.langs)))]
    for a in range(0, len(words), _WORDS_AT_ONCE):
        lattice = P.Lattice.of([P.SPACE + w for w in words[a:a + _WORDS_AT_ONCE]], model.trie)
        alpha = lattice.forward(lattice.weights(model.log_p, model.byte_log_p))
        out.append(alpha[lattice.first + lattice.lens])
    return np.concatenate(out)


def _predict_batches(batches, model):
    m = model.value
    numbers, scores, used = _Numbers(), np.zeros((0, len(m.langs))), 0
    for batch in batches:
        for part in C.slices(batch, 1):
            if len(numbers) > _WORDS_KEPT:
                numbers, used = _Numbers(), 0
            words = [_words(t) for t in C.texts_of(part, 1)]
            n = np.fromiter(map(len, words), np.int64, len(words))
            which = np.fromiter(map(numbers.__getitem__, chain.from_iterable(words)), np.int64, int(n.sum()))
            if len(numbers) > used:
                new = list(numbers)[used:]
                scores = np.concatenate([scores[:used], word_scores(new, m)])
                used = len(numbers)
            lang, score = np.full(len(words), -1), np.zeros(len(words))
            full = np.flatnonzero(n) if m.langs else np.zeros(0, np.int64)
            if len(full):
                starts = (np.cumsum(n) - n)[full]
                total = np.stack([np.add.reduceat(scores[which, k], starts) for k in range(len(m.langs))], axis=1)
                total += m.log_prior
                lang[full] = total.argmax(axis=1)
                score[full] = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
            names = [*m.langs, NONE]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([names[k] for k in lang.tolist()], pa.string()),
                                              pa.array(score)], ["id", "lang_pred", "score"])


def predict(df: DataFrame, model: Model, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id_col, lang_pred, score): the most probable language and its posterior."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = df.select(id_col).schema[0].dataType.simpleString()
    return (df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
            .mapInArrow(partial(_predict_batches, model=shared), f"id {kind}, lang_pred string, score double")
            .withColumnRenamed("id", id_col))


def op4_language_id(spark, sf_dir, piece_path: str | None = None) -> DataFrame:
    """The language of every document, learnt from the documents outside the held-out fold."""
    docs = C.table(spark, sf_dir, "documents")
    held_out = C.fold_of("doc_id", 3) == 1
    model = fit(docs.where(~held_out), piece_path or C.vocabulary_path("piece_bpe_32k.model"))
    return predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
