"""Token counts by dynamic programming over a trie of pre-tokens.

The distinct pre-tokens of a slice are inserted in a trie, level by level.  A
trie node holds what is known of its prefix: the log forward score (the sum
over all segmentations into pieces), and the score and token count of the best
segmentation.  Each is computed once, however many pre-tokens share the
prefix; pieces that are still open are walked down the trie with the nodes.  A
pre-token's figures are those of the node it ends at, and a text's are the
sums over its pre-tokens.

Pre-tokens are words ``[^\\x20\\x09-\\x0D]+`` with the vocabulary's blank before
them.  The vocabulary is fixed and public; piece probabilities fall with the
place in it (``rank_log_probs``).  A character that is no piece by itself is
written in bytes, one token each.

Results per case: null and empty texts have no tokens and score 0; of equally
good segmentations the one of fewer tokens counts; whole texts of any length;
repeated rows count alike; only the id and text columns are read; an empty
table gives an empty result.
"""

from __future__ import annotations

from functools import partial
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veil.llm import common as C
from veil.llm import pieces as P

_WORDS_KEPT = 400_000       # distinct pre-tokens known before a restart
_WORDS_AT_ONCE = 50_000


class Model(NamedTuple):
    trie: P.PieceTrie
    log_p: np.ndarray
    byte_log_p: float


def read_model(piece_path: str) -> Model:
    pieces = P.read_pieces(piece_path)
    return Model(P.PieceTrie.of(pieces), *P.rank_log_probs(len(pieces)))


class _Open(NamedTuple):
    """Pieces begun but not ended, by node: figures at their start and their state."""

    node: np.ndarray
    forward: np.ndarray
    best: np.ndarray
    tokens: np.ndarray
    state: np.ndarray

    def take(self, at) -> _Open:
        return _Open(*(x[at] for x in self))


def count_words(words: list[str], model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token count, best score and forward score of distinct words."""
    order = sorted(range(len(words)), key=words.__getitem__)
    flat, lens = P.code_points([words[k] for k in order])
    offset = np.cumsum(lens) - lens
    tokens, best, forward = (np.zeros(len(words), dtype=t) for t in (np.int64, float, float))
    # the root: the empty prefix
    n_forward, n_best, n_tokens = np.zeros(1), np.zeros(1), np.zeros(1, dtype=np.int64)
    opened = _Open(*(np.zeros(0, dtype=t) for t in (np.int64, float, float, np.int64, np.int64)))
    live = np.flatnonzero(lens > 0)
    node = np.zeros(len(live), dtype=np.int64)
    depth = 0
    while len(live):
        code = flat[offset[live] + depth]
        # words with the same prefix stand together, so children do too
        new = np.concatenate([[True], (node[1:] != node[:-1]) | (code[1:] != code[:-1])])
        child = np.cumsum(new) - 1
        parent, ch = node[new], code[new]
        count = len(parent)
        # the parent's open pieces and one that begins here
        first = np.searchsorted(opened.node, parent)
        size = np.searchsorted(opened.node, parent, side="right") - first
        ids = np.arange(count)
        go = opened.take(P.runs(first, size))
        go = _Open(*(np.concatenate(x) for x in zip(
            go._replace(node=np.repeat(ids, size)),
            (ids, n_forward[parent], n_best[parent], n_tokens[parent], np.zeros(count, dtype=np.int64)))))
        fresh = np.repeat([False, True], [int(size.sum()), count])
        go = go._replace(state=model.trie.step(go.state, ch[go.node]))
        on = np.flatnonzero(go.state >= 0)
        on = on[np.argsort(go.node[on], kind="stable")]
        go, fresh = go.take(on), fresh[on]
        piece = model.trie.piece[go.state]
        end = piece >= 0
        alone = np.zeros(count, dtype=bool)
        alone[go.node[end & fresh]] = True
        rest = np.flatnonzero(~alone)
        byte = P.utf8_size(ch[rest])
        done = _Open(*(np.concatenate(x) for x in zip(
            (go.node[end], go.forward[end] + model.log_p[piece[end]], go.best[end] + model.log_p[piece[end]],
             go.tokens[end] + 1, go.state[end]),
            (rest, n_forward[parent[rest]] + byte * model.byte_log_p, n_best[parent[rest]] + byte * model.byte_log_p,
             n_tokens[parent[rest]] + byte, rest))))
        by = np.lexsort((done.tokens, -done.best, done.node))
        done = done.take(by)
        cut = np.flatnonzero(np.concatenate([[True], done.node[1:] != done.node[:-1]]))
        n_forward = np.empty(count)
        P.log_add(n_forward[:, None], done.node, done.forward[:, None])
        n_best, n_tokens = done.best[cut], done.tokens[cut]
        opened, depth = go, depth + 1
        ends = lens[live] == depth
        at = np.array(order, dtype=np.int64)[live[ends]]
        tokens[at], best[at], forward[at] = n_tokens[child[ends]], n_best[child[ends]], n_forward[child[ends]]
        live, node = live[~ends], child[~ends]
    return tokens, best, forward


class _Numbers(dict):
    """Numbers pre-tokens in the order they are first seen."""

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def _count_batches(batches, model):
    m = model.value
    numbers, known = _Numbers(), None
    for batch in batches:
        for part in C.slices(batch, 1):
            if known is None or len(numbers) > _WORDS_KEPT:
                numbers, known = _Numbers(), (np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
            words = [t.split() for t in C.bytes_of(part, 1)]
            n = np.fromiter(map(len, words), np.int64, len(words))
            which = np.fromiter(map(numbers.__getitem__, chain.from_iterable(words)), np.int64, int(n.sum()))
            used = len(known[0])
            new = [P.SPACE + w.decode() for w in list(numbers)[used:]]
            for a in range(0, len(new), _WORDS_AT_ONCE):
                known = tuple(map(np.concatenate, zip(known, count_words(new[a:a + _WORDS_AT_ONCE], m))))
            sums = []
            for values in known:
                out = np.zeros(len(words), dtype=values.dtype)
                full = np.flatnonzero(n)
                if len(full):
                    out[full] = np.add.reduceat(values[which], (np.cumsum(n) - n)[full])
                sums.append(pa.array(out))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), *sums],
                                             ["id", "n_pretokens", "n_tokens", "best_score", "forward_score"])


def count(df: DataFrame, model: Model, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id_col, n_pretokens, n_tokens, best_score, forward_score) of every row."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = df.select(id_col).schema[0].dataType.simpleString()
    return (df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
            .mapInArrow(partial(_count_batches, model=shared), f"id {kind}, n_pretokens long, n_tokens long, "
                        "best_score double, forward_score double")
            .withColumnRenamed("id", id_col))


def op5_token_counts(spark, sf_dir, piece_path: str | None = None) -> DataFrame:
    """Token counts of every document."""
    return count(C.table(spark, sf_dir, "documents"), read_model(piece_path or C.vocabulary_path("piece_bpe_32k.model")))
