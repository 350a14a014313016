"""Quality rules: hashed n-gram log-likelihood ratio with a fixed cut.

Words and word pairs of a text are hashed into ``BUCKETS`` counters.  Two
multinomials are estimated over the buckets: one of the trusted target (the
labelled documents of quality 1) and one of the raw corpus (every document).
A document's score is the mean of log(p_target / p_raw) over its words and
pairs, so length does not matter, and every document is kept or rejected by
the same cut, which is read off the scores of the labelled documents.

The corpus counts cover all documents.  Only the labelled documents are a
sample of bounded expected size (``MAX_LABELLED`` rows, by a hash of the id).

Results per case: null and empty texts have no words, fail the base rule and
are rejected; score 0 without words; without labels of quality 1 the ratio is
0 everywhere and only the base rule rejects; several labels of one document
count as their lowest quality; repeated rows are judged alike; of the input
only the id and text columns are read (``keep_good`` hands all columns on);
texts are judged whole at any length; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import partial
from itertools import chain
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veil.llm import common as C

BUCKETS = 1 << 16
SMOOTHING = 0.5             # added to every bucket of both multinomials
MAX_LABELLED = 20_000       # expected bound of the labelled sample
TRUSTED_LOSS = 0.002        # share of trusted documents the cut may reject at most
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
_SYMBOLS = b"#*$%&|<>"
_SPACE = b"\t\n\x0b\x0c\r "
_WORDS_KEPT = 100_000       # distinct words numbered before the numbering restarts
_PAIR = np.uint64(0x9E3779B97F4A7C15)


class Model(NamedTuple):
    log_ratio: np.ndarray   # per bucket
    cut: float              # documents below are rejected


class _Hashes(dict):
    """Numbers words and keeps the hash of each number."""

    def __init__(self):
        super().__init__()
        self.hashes = []

    def __missing__(self, word):
        self[word] = n = len(self)
        self.hashes.append(crc32(word))
        return n


def _repeat_words(ids: np.ndarray) -> int:
    """Words inside a window of three words that occurs twice or more."""
    n = len(ids)
    if n < 4:
        return 0
    top = int(ids.max()) + 1
    if top >= 1 << 21:
        _, first = np.unique(ids[:-2] * top + ids[1:-1], return_inverse=True)
        code = first * top + ids[2:]
    else:
        code = (ids[:-2] * top + ids[1:-1]) * top + ids[2:]
    order = np.argsort(code)
    code = code[order]
    same = code[1:] == code[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n - 2, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    hit = np.zeros(n, dtype=bool)
    hit[:-2] = twice
    hit[1:-1] |= twice
    hit[2:] |= twice
    return int(hit.sum())


def _dup_lines(text: bytes) -> int:
    seen, n = set(), 0
    for line in text.split(b"\n"):
        if line.strip(_SPACE):
            if line in seen:
                n += 1
            seen.add(line)
    return n


class _Texts:
    """Words of the texts of a slice and their hashed features."""

    def __init__(self):
        self.numbers = _Hashes()

    def read(self, texts: list[bytes]):
        if len(self.numbers) > _WORDS_KEPT:
            self.numbers = _Hashes()
        words = [t.split() for t in texts]
        self.counts = np.fromiter(map(len, words), np.int64, len(words))
        self.ids = np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(words)),
                               np.int64, int(self.counts.sum()))
        self.ends = np.cumsum(self.counts)
        hashes = np.array(self.numbers.hashes, dtype=np.uint64)[self.ids]
        self.single = (hashes * _PAIR >> np.uint64(48)).astype(np.int64) & (BUCKETS - 1)
        pair = hashes[:-1] * _PAIR + hashes[1:] if len(hashes) else hashes
        pair = (pair ^ (pair >> np.uint64(29))) * _PAIR
        self.pair = (pair >> np.uint64(48)).astype(np.int64) & (BUCKETS - 1)
        # a pair across two texts is no pair
        self.inside = np.ones(len(self.pair), dtype=bool)
        cross = self.ends[:-1][(self.ends[:-1] > 0) & (self.ends[:-1] < len(self.ids))] - 1
        self.inside[cross] = False

    def features(self, rows: np.ndarray | None = None) -> np.ndarray:
        """Buckets of all words and pairs, or of those of the marked texts."""
        if rows is None:
            return np.concatenate([self.single, self.pair[self.inside]])
        on = np.repeat(rows, self.counts)
        return np.concatenate([self.single[on], self.pair[self.inside & on[:-1]] if len(on) else self.pair])

    def scores(self, log_ratio: np.ndarray) -> np.ndarray:
        """Mean of the log ratio over the words and pairs of each text."""
        out = np.zeros(len(self.counts))
        for k, (end, n) in enumerate(zip(self.ends.tolist(), self.counts.tolist())):
            if n:
                a = end - n
                total = log_ratio[self.single[a:end]].sum()
                total += log_ratio[self.pair[a:end - 1]].sum()
                out[k] = total / (2 * n - 1)
        return out


def _count_batches(batches):
    texts = _Texts()
    raw = np.zeros(BUCKETS, dtype=np.int64)
    trusted = np.zeros(BUCKETS, dtype=np.int64)
    for batch in batches:
        for part in C.slices(batch, 0):
            texts.read(C.bytes_of(part, 0))
            raw += np.bincount(texts.features(), minlength=BUCKETS)
            rows = np.asarray(part.column(1).fill_null(False))
            if rows.any():
                trusted += np.bincount(texts.features(rows), minlength=BUCKETS)
    on = np.nonzero(raw)[0]
    yield pa.RecordBatch.from_arrays([pa.array(on), pa.array(raw[on]), pa.array(trusted[on])],
                                     ["bucket", "raw", "trusted"])


def _rules(texts: _Texts, raw: list[bytes], part: pa.RecordBatch, col: int, model: Model | None) -> dict:
    text = part.column(col)
    chars = np.asarray(pc.fill_null(pc.utf8_length(text), 0), dtype=np.int64)
    texts.read(raw)
    n = texts.counts
    spaces = np.fromiter((len(t) - len(t.translate(None, _SPACE)) for t in raw), np.int64, len(raw))
    symbols = np.fromiter((len(t) - len(t.translate(None, _SYMBOLS)) for t in raw), np.int64, len(raw))
    dup = np.fromiter(map(_dup_lines, raw), np.int64, len(raw))
    repeat = np.fromiter((_repeat_words(texts.ids[e - c:e]) for e, c in zip(texts.ends.tolist(), n.tolist())),
                         np.int64, len(raw))
    failed = (n < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * n)
    score = texts.scores(model.log_ratio) if model else np.zeros(len(raw))
    kept = ~failed & (score >= model.cut) if model else ~failed
    return {"n_words": n, "word_chars": chars - spaces, "n_symbols": symbols, "n_dup_lines": dup,
            "n_repeat_words": repeat, "base_failed": failed, "kept": kept, "score": score}


_RULES = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "base_failed boolean, kept boolean, score double")


def _judge_batches(batches, model):
    texts = _Texts()
    for batch in batches:
        for part in C.slices(batch, 1):
            got = _rules(texts, C.bytes_of(part, 1), part, 1, model.value)
            yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, got.values())], ["id", *got])


def _filter_batches(batches, model, col):
    texts = _Texts()
    for batch in batches:
        for part in C.slices(batch, col):
            kept = _rules(texts, C.bytes_of(part, col), part, col, model.value)["kept"]
            yield part.filter(pa.array(kept))


def labelled_sample(labels: DataFrame, id_col: str, max_labelled: int) -> DataFrame:
    """(label_id, good): one row per labelled id, at most ``max_labelled`` in expectation."""
    one = (labels.where(F.col(id_col).isNotNull() & F.col("quality").isNotNull())
           .groupBy(F.col(id_col).alias("label_id")).agg((F.min("quality") >= 1).alias("good")))
    n = one.count()
    if n <= max_labelled:
        return one
    return one.where(C.in_sample("label_id", max_labelled, n))


def fit(df: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id",
        max_labelled: int = MAX_LABELLED) -> Model:
    """Both multinomials over all of ``df`` and the cut from the labelled documents."""
    spark = df.sparkSession
    # at most max_labelled rows of an id and a flag, whatever the size of the labels
    sample = F.broadcast(labelled_sample(labels, id_col, max_labelled))
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    flagged = docs.join(sample, F.col("id") == F.col("label_id"), "left")
    counts = (flagged.select("text", "good").mapInArrow(_count_batches, "bucket long, raw long, trusted long")
              .groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted"))
              .collect())                                    # one row per bucket
    raw, trusted = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in counts:
        raw[r.bucket], trusted[r.bucket] = r.raw, r.trusted
    if not trusted.any():
        return Model(np.zeros(BUCKETS), -np.inf)
    raw, trusted = raw + SMOOTHING, trusted + SMOOTHING
    ratio = np.log(trusted / trusted.sum()) - np.log(raw / raw.sum())
    model = spark.sparkContext.broadcast(Model(ratio, -np.inf))
    known = docs.join(sample, F.col("id") == F.col("label_id"))
    seen = (known.select("good", "text").mapInArrow(partial(_judge_batches, model=model), f"id boolean, {_RULES}")
            .where(~F.col("base_failed")).select("id", "score").collect())     # bounded by the sample
    good = np.sort([r.score for r in seen if r.id])
    bad = np.sort([r.score for r in seen if not r.id])
    return Model(ratio, choose_cut(good, bad))


def choose_cut(good: np.ndarray, bad: np.ndarray) -> float:
    """The cut of the best balanced accuracy that loses few of the good; the middle of its gap."""
    if not len(good) or not len(bad):
        return -np.inf
    scores = np.unique(np.concatenate([good, bad]))
    cuts = np.concatenate([[-np.inf], (scores[1:] + scores[:-1]) / 2])
    lost = np.searchsorted(good, cuts) / len(good)
    caught = np.searchsorted(bad, cuts) / len(bad)
    return float(cuts[np.argmax(np.where(lost <= TRUSTED_LOSS, caught - lost, -1.0))])


def judge(df: DataFrame, model: Model, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rule figures, score and verdict of every row."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = df.select(id_col).schema[0].dataType.simpleString()
    return (df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
            .mapInArrow(partial(_judge_batches, model=shared), f"id {kind}, {_RULES}")
            .withColumnRenamed("id", id_col))


def keep_good(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that are kept, with all their columns."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    return df.mapInArrow(partial(_filter_batches, model=shared, col=df.columns.index(text_col)), df.schema)


def op3_quality_rules(spark, sf_dir) -> DataFrame:
    """Every document judged, kept or not."""
    docs = C.table(spark, sf_dir, "documents")
    return judge(docs, fit(docs, C.table(spark, sf_dir, "labels")))
