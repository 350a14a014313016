"""Brown class-based bigram scoring.

P(text) = product over tokens of P(class | class before) P(word | class).  The
classes are found by exchange clustering: items are moved, one after another,
to the class that raises the likelihood of the class bigrams most, until a
sweep moves nothing (or ``SWEEPS`` are done).  The items are the ``OWN`` most
frequent words and ``GROUPS`` groups of all other words (by a hash of the last
three bytes), so every word has a class, unknown ones too.  Within a group a
word has its share of the group's training tokens, with 0.5 added to every
word and to one unknown word.

Spark counts all words and all item bigrams of the training texts.  What the
driver holds has a fixed size whatever the corpus: the ``LISTED`` most
frequent words, and an items x items matrix for the exchange.  The counts of
all other words stay distributed and are joined to the texts' words.

Results per case: null and empty texts consist of the end token alone; an
empty training part gives base score 0 for every token; ties among equally
frequent words are broken by their bytes; rows that repeat id and text have
equal results; texts are scored whole at any length, each by one task; an empty
table gives an empty result; only the id and text columns are read.
"""

from __future__ import annotations

from collections import Counter
from functools import partial
from itertools import chain
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veil.llm import common as C
from veil.session import cut_lineage

CLASSES = 64
OWN = 1_535                 # words that are items of their own; the end token is one more
GROUPS = 512                # groups of all other words
LISTED = 65_536             # most frequent words whose counts every task holds
SWEEPS = 12
BACKOFF = 8.0               # weight of the class unigrams in a transition
END = b""                   # the end token; no word is empty
_ITEMS = 1 + OWN + GROUPS
_WORDS_KEPT = 400_000
_PAIRS_KEPT = 4_000_000
_ROWS = 32                  # items of a block of the bigram matrix


class Model(NamedTuple):
    listed: dict            # word -> (item, count)
    train_tokens: int       # N
    train_types: int        # V
    log_item: np.ndarray    # [items] log10 P(item | class), minus the group's denominator for groups
    item_class: np.ndarray
    log_trans: np.ndarray   # [classes before, classes] log10


def group_of(word: bytes, groups: int = GROUPS) -> int:
    return crc32(word[-3:]) % groups


def _group_column(word: str, groups: int) -> Column:
    return F.crc32(F.substring(word, -3, 3)) % groups


def _tokens(text: bytes) -> list[bytes]:
    return text.lower().split()         # bytes: A-Z and the six blanks only


def _count_batches(batches):
    counts: Counter = Counter()

    def rows():
        out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()),
                                          pa.array(list(counts.values()), pa.int64())], ["word", "n"])
        counts.clear()
        return out

    for batch in batches:
        for part in C.slices(batch, 0):
            for text in C.bytes_of(part, 0):
                counts.update(_tokens(text))
            counts[END] += part.num_rows
            if len(counts) > _WORDS_KEPT:
                yield rows()
    yield rows()


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) of all texts; the end token is the empty word."""
    return (texts.mapInArrow(_count_batches, "word binary, n long")
            .groupBy("word").agg(F.sum("n").alias("n")))


class _Items(dict):
    """Item of each word, remembered for the words of a task."""

    def __init__(self, listed, groups):
        super().__init__({w: item for w, (item, _) in listed.items()})
        self.least, self.groups = len(self), groups

    def __missing__(self, word):
        self[word] = item = 1 + OWN + group_of(word, self.groups)
        return item


def _pair_batches(batches, listed):
    """Item bigrams of a task, as sparse rows of blocks of left items."""
    items = _Items(listed.value, GROUPS)
    codes, counts, held = [], [], 0

    def merged():
        flat, n = np.concatenate(codes), np.concatenate(counts)
        order = np.argsort(flat, kind="stable")
        flat, n = flat[order], n[order]
        cut = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
        return flat[cut], np.add.reduceat(n, cut)

    def rows():
        flat, n = merged()
        codes.clear()
        counts.clear()
        bounds = np.searchsorted(flat, np.arange(0, _ITEMS + _ROWS, _ROWS) * _ITEMS)
        full = [b for b in range(len(bounds) - 1) if bounds[b + 1] > bounds[b]]
        cells = [((flat[bounds[b]:bounds[b + 1]] - b * _ROWS * _ITEMS).astype("<u4").tobytes(),
                  n[bounds[b]:bounds[b + 1]].astype("<i8").tobytes()) for b in full]
        return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([c[0] for c in cells], pa.binary()),
                                           pa.array([c[1] for c in cells], pa.binary())], ["block", "cells", "n"])

    for batch in batches:
        for part in C.slices(batch, 0):
            if len(items) > items.least + _WORDS_KEPT:
                items = _Items(listed.value, GROUPS)
            seq = [_tokens(t) for t in C.bytes_of(part, 0)]
            n = sum(map(len, seq)) + len(seq)
            # the end token (item 0) stands between texts, and before the first
            ids = np.fromiter(chain((0,), chain.from_iterable(chain(map(items.__getitem__, s), (0,)) for s in seq)),
                              np.int64, n + 1)
            code, count = np.unique(ids[:-1] * _ITEMS + ids[1:], return_counts=True)
            codes.append(code)
            counts.append(count)
            held += len(code)
            if held > _PAIRS_KEPT:
                flat, n = merged()
                codes, counts, held = [flat], [n], len(flat)
                if held > _PAIRS_KEPT // 2:
                    yield rows()
                    held = 0
    if codes:
        yield rows()


def _sum_block(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    total = np.zeros(_ROWS * _ITEMS, dtype=np.int64)
    for cells, n in zip(rows.column("cells").to_pylist(), rows.column("n").to_pylist()):
        np.add.at(total, np.frombuffer(cells, "<u4"), np.frombuffer(n, "<i8"))
    return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "n": pa.array([total.tobytes()], pa.binary())})


def item_pairs(texts: DataFrame, listed) -> np.ndarray:
    """[items, items] bigram counts: a matrix of fixed size."""
    blocks = texts.mapInArrow(partial(_pair_batches, listed=listed), "block int, cells binary, n binary")
    # a block's rows are few per task; a random half-way sum keeps a block's tasks apart first
    half = (blocks.withColumn("salt", (F.rand(7) * 16).cast("int")).groupBy("block", "salt")
            .applyInArrow(_sum_salted, "block int, cells binary, n binary"))
    out = np.zeros((-(-_ITEMS // _ROWS) * _ROWS, _ITEMS), dtype=np.int64)
    for r in half.groupBy("block").applyInArrow(_sum_block, "block int, n binary").toLocalIterator():
        out[r.block * _ROWS:(r.block + 1) * _ROWS] = np.frombuffer(r.n, np.int64).reshape(_ROWS, _ITEMS)
    return out[:_ITEMS]


def _sum_salted(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    total = np.frombuffer(_sum_block(key, rows).column("n")[0].as_py(), np.int64)
    cells = np.flatnonzero(total)
    return pa.table({"block": pa.array([key[0].as_py()], pa.int32()),
                     "cells": pa.array([cells.astype("<u4").tobytes()], pa.binary()),
                     "n": pa.array([total[cells].astype("<i8").tobytes()], pa.binary())})


def _x_log_x(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def exchange(pairs: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each item: greedy exchange on the likelihood of the class bigrams.

    Items are visited by falling frequency, starting from rank modulo classes;
    ties go to the class of the lowest number.
    """
    n = pairs.astype(float)
    m = len(n)
    order = np.argsort(-(n.sum(axis=0) + n.sum(axis=1)), kind="stable")
    cls = np.empty(m, dtype=np.int64)
    cls[order] = np.arange(m) % classes
    hot = np.eye(classes)[cls]
    right, left = n @ hot, n.T @ hot            # of each item: class counts after and before it
    table = hot.T @ right
    for _ in range(sweeps):
        moved = 0
        for w in order.tolist():
            a, own = cls[w], n[w, w]
            r, l = right[w].copy(), left[w].copy()
            if not r.any() and not l.any():
                continue
            r[a] -= own
            l[a] -= own
            table[a] -= r
            table[:, a] -= l
            table[a, a] -= own
            # likelihood gained by adding the item to each class
            gain = (_x_log_x(table + r) - _x_log_x(table)).sum(axis=1)
            gain += (_x_log_x(table + l[:, None]) - _x_log_x(table)).sum(axis=0)
            diag = np.diagonal(table)
            gain += (_x_log_x(diag + r + l + own) - _x_log_x(diag + r) - _x_log_x(diag + l) + _x_log_x(diag))
            out, into = table.sum(axis=1), table.sum(axis=0)
            gain -= _x_log_x(out + r.sum() + own) - _x_log_x(out) + _x_log_x(into + l.sum() + own) - _x_log_x(into)
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-9:
                b = int(a)
            table[b] += r
            table[:, b] += l
            table[b, b] += own
            if b != a:
                cls[w] = b
                moved += 1
                right[:, a] -= n[:, w]
                right[:, b] += n[:, w]
                left[:, a] -= n[w]
                left[:, b] += n[w]
        if not moved:
            break
    return cls


def frequent_words(counts: DataFrame, most: int) -> list:
    """At most ``most`` of the most frequent words, by falling count, then bytes.

    The least count is read off a histogram with 64 steps for each power of
    two, so no more than ``most`` rows leave the executors in all.
    """
    power = F.floor(F.log2("n"))
    step = (power * 64 + F.floor((F.col("n") / F.pow(F.lit(2.0), power) - 1) * 64)).alias("step")
    found = sorted(counts.groupBy(step).agg(F.count("*").alias("words"), F.min("n").alias("least")).collect(),
                   key=lambda r: -r.step)                      # at most 64 x 64 rows
    least = None
    for r, words in zip(found, np.cumsum([r.words for r in found])):
        if words > most:
            break
        least = r.least
    if least is None:
        return []
    return sorted(counts.where(F.col("n") >= least).collect(), key=lambda r: (-r.n, bytes(r.word)))


def fit(train: DataFrame, counts: DataFrame) -> Model:
    """The model of the training texts (one column) and their word counts."""
    total = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    top = frequent_words(counts.where(F.col("word") != F.lit(END)), LISTED)
    ends = counts.where(F.col("word") == F.lit(END)).select("n").first()
    listed = {bytes(r.word): (1 + k if k < OWN else 1 + OWN + group_of(bytes(r.word)), r.n) for k, r in enumerate(top)}
    group_n, group_v = np.zeros(GROUPS), np.zeros(GROUPS)
    for r in (counts.where(F.col("word") != F.lit(END)).groupBy(_group_column("word", GROUPS).alias("g"))
              .agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()):     # GROUPS rows
        group_n[r.g], group_v[r.g] = r.n, r.v
    item_n = np.zeros(_ITEMS)
    item_n[0] = ends.n if ends else 0
    for word, (item, n) in listed.items():
        if item <= OWN:
            item_n[item] = n
            group_n[group_of(word)] -= n
            group_v[group_of(word)] -= 1
    item_n[1 + OWN:] = group_n
    pairs = item_pairs(train, train.sparkSession.sparkContext.broadcast(listed))
    cls = exchange(pairs)
    hot = np.eye(CLASSES)[cls]
    class_n, class_size = hot.T @ item_n, hot.sum(axis=0)
    log_item = np.log10((item_n + 0.5) / (class_n + 0.5 * class_size)[cls])
    log_item[1 + OWN:] -= np.log10(group_n + 0.5 * (group_v + 1))
    table = hot.T @ pairs @ hot
    share = (class_n + 0.5) / (class_n + 0.5).sum()
    log_trans = np.log10((table + BACKOFF * share) / (table.sum(axis=1, keepdims=True) + BACKOFF))
    return Model({END: (0, int(item_n[0]))} | listed, int(total.n or 0), int(total.v), log_item, cls, log_trans)


# Columns of a text's own part, and of its words that are not listed.
_LOCAL = "key long, n_tokens long, n_known long, base double, model double"


class _Numbers(dict):
    """Numbers words in the order they are first seen."""

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


class _Reader:
    """Items and listed counts of the words of a task."""

    def __init__(self, model: Model):
        self.model = model
        self.restart()

    def restart(self):
        self.numbers = _Numbers()
        for w in self.model.listed:
            self.numbers[w]
        self.item = np.array([i for i, _ in self.model.listed.values()], dtype=np.int64)
        self.count = np.array([c for _, c in self.model.listed.values()], dtype=np.int64)
        self.listed = len(self.numbers)

    def read(self, texts: list[bytes]):
        """Word numbers with an end after each text, and the token count of each text."""
        if len(self.numbers) > self.listed + _WORDS_KEPT:
            self.restart()
        words = [_tokens(t) for t in texts]
        n = np.fromiter(map(len, words), np.int64, len(words)) + 1
        which = np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(chain(s, (END,)) for s in words)),
                            np.int64, int(n.sum()))
        self.words = list(self.numbers)
        new = self.words[len(self.item):]
        self.item = np.concatenate([self.item, np.fromiter((1 + OWN + group_of(w) for w in new), np.int64, len(new))])
        return which, n


def _local_batches(batches, model):
    """What listed words, items and classes say about each text."""
    m = model.value
    reader = _Reader(m)
    log_base = np.log10(m.train_tokens + 0.5 * (m.train_types + 1))
    for batch in batches:
        for part in C.slices(batch, 1):
            which, n = reader.read(C.bytes_of(part, 1))
            if not len(n):
                continue
            known = which < reader.listed
            count = np.zeros(len(which))
            count[known] = reader.count[which[known]]
            items = reader.item[which]
            cls = m.item_class[items]
            before = np.concatenate([[m.item_class[0]], cls[:-1]])      # the end token of the text before
            log_count = np.where(known, np.log10(count + 0.5), 0.0)     # the others are joined
            model_log = m.log_trans[before, cls] + m.log_item[items] + np.where(items > OWN, log_count, 0.0)
            starts = np.cumsum(n) - n
            yield pa.RecordBatch.from_arrays([
                part.column(0), pa.array(n), pa.array(np.add.reduceat((known & (count > 0)).astype(np.int64), starts)),
                pa.array(np.add.reduceat(log_count - log_base, starts)), pa.array(np.add.reduceat(model_log, starts))],
                ["key", "n_tokens", "n_known", "base", "model"])


def _rare_batches(batches, model):
    """(word, key, n) of the words that are not listed."""
    reader = _Reader(model.value)
    for batch in batches:
        for part in C.slices(batch, 1):
            which, n = reader.read(C.bytes_of(part, 1))
            rare = np.flatnonzero(which >= reader.listed)
            if not len(rare):
                continue
            doc = np.repeat(np.arange(len(n)), n)[rare]
            code, count = np.unique(which[rare] * len(n) + doc, return_counts=True)
            words = [reader.words[k] for k in (code // len(n)).tolist()]
            keys = part.column(0).take(pa.array(code % len(n)))
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), keys, pa.array(count, pa.int32())],
                                             ["word", "key", "n"])


def score(df: DataFrame, model: Model, counts: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id_col, n_tokens, n_known, base_score, score) of every row."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # a text's key: rows that share id and text share their figures
    docs = df.select(F.col(id_col).alias("id"), text.alias("text")).select(
        "id", F.xxhash64(F.col("id").cast("string"), "text").alias("key"), "text")
    local = docs.select("key", "text").mapInArrow(partial(_local_batches, model=shared), _LOCAL)
    local = local.groupBy("key").agg(F.count("*").alias("copies"), *[F.first(c).alias(c) for c in (
        "n_tokens", "n_known", "base", "model")])
    rare = docs.select("key", "text").mapInArrow(partial(_rare_batches, model=shared), "word binary, key long, n int")
    joined = rare.join(counts, "word", "left").select(
        "key", (rare.n * F.log10(F.coalesce(counts.n, F.lit(0)) + 0.5)).alias("log"),
        F.when(counts.n > 0, rare.n).otherwise(0).alias("known"))
    sums = joined.groupBy("key").agg(F.sum("log").alias("log"), F.sum("known").alias("known"))
    both = local.join(sums, "key", "left").select(
        "key", "n_tokens", (F.col("n_known") + F.coalesce(F.col("known") / F.col("copies"), F.lit(0))).cast("long")
        .alias("n_known"), *[(F.col(c) + F.coalesce(F.col("log") / F.col("copies"), F.lit(0.0))).alias(o)
                             for c, o in (("base", "base_score"), ("model", "score"))])
    return docs.select("id", "key").join(both, "key").select(
        F.col("id").alias(id_col), "n_tokens", "n_known", "base_score", "score")


def op1_class_lm(spark, sf_dir) -> DataFrame:
    """Base and model score of every document, learnt outside the held-out fold."""
    docs = C.table(spark, sf_dir, "documents")
    held_out = C.fold_of("doc_id", 5) == 1
    train = docs.where(~held_out).select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    counts = cut_lineage(word_counts(train))
    model = fit(train, counts)
    return score(docs, model, counts).select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known",
        F.lit(model.train_tokens).cast("long").alias("train_tokens"), "base_score", "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
