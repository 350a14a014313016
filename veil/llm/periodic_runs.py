"""Periodic runs of words by an online diagonal DP.

A run is a stretch of words that repeats itself: its smallest period is q, it
is ``max(6, 4q)`` words or longer, and neither neighbour continues it.

The words of a text are read in order.  An earlier occurrence of the word at
hand lies on a diagonal, the lag between both places; while a diagonal is
active every further match adds one to its length, and one that ends with
``max(6 - q, 3q)`` matches emits its run at once.  Three facts keep this from
visiting all pairs of occurrences, and lose no run:

* A run of period q needs ``3q`` matches in a row on lag q, so all its words
  but the first q have an earlier occurrence at most q back.  Lags are taken
  by powers of two, and only stretches that are long enough for the power and
  whose words all have such an occurrence are read (``_regions``).
* Those matches cross a multiple of the power with q matches behind it, so
  diagonals open at these places only, and only where the q words before
  match too: windows are told apart by prefix sums of word hashes, then word
  by word.  At most logarithmically many lags with primitive periods pass.
* A lag that a smaller period divides inside a run already emitted has the
  same run and is not opened; where such a run holds both windows of every lag
  of the power, no lag is.

Results per case: null and empty texts have no words and no runs; a text is
held whole by its task, at any length, in memory and time near proportional to
it; equal texts have equal runs, repeated rows stay; runs that share words are
all listed, by start and period; an empty table gives an empty result; only
the id and text columns are read; a null id stays null.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veil.llm import common as C

LEAST_WORDS = 6
LEAST_PERIODS = 4
_SMALL = 64                             # up to this power all lags are compared at once
_BASE = np.uint64(0x9E3779B97F4A7C15)   # odd: powers of it are invertible


def words_of(data: bytes) -> list[bytes]:
    """Words between blanks, tabs and line ends (ASCII white space only)."""
    return data.split()


def numbered(words: list) -> np.ndarray:
    """Each word as the number of its first occurrence among the distinct words."""
    table = {w: k for k, w in enumerate(dict.fromkeys(words))}
    return np.fromiter(map(table.__getitem__, words), dtype=np.int64, count=len(words))


def _last_lag(x: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Distance of each word to its previous occurrence; the text's length and more where there is none.

    ``order`` lists the places word by word, each word's in ascending order.
    """
    lag = np.full(len(x), len(x) + 1, dtype=np.int64)
    sorted_x, gaps = x[order], np.diff(order)
    lag[order[1:]] = np.where(sorted_x[1:] == sorted_x[:-1], gaps, len(x) + 1)
    return lag


def _regions(lag: np.ndarray, power: int) -> list[tuple[int, int]]:
    """Stretches [lo, hi) of words with an occurrence at most ``power`` back, long enough for a run."""
    least = max(LEAST_PERIODS - 1, 1) * (power // 2 + 1) if power > 1 else LEAST_WORDS - 1
    far = np.flatnonzero(lag > power)
    edges = np.concatenate(([-1], far, [len(lag)]))
    long = np.flatnonzero(np.diff(edges) > least)
    return [(int(edges[k]) + 1, int(edges[k + 1])) for k in long]


class _Places:
    """Earlier occurrences of words."""

    def __init__(self, x: np.ndarray, order: np.ndarray):
        self.x, self.order = x, order
        counts = np.bincount(x)
        self.ends = np.cumsum(counts)
        self.starts = self.ends - counts

    def between(self, i: int, far: int, near: int) -> np.ndarray:
        """Occurrences of the word at ``i`` that are at most ``far`` and more than ``near`` words back."""
        word = self.x[i]
        own = self.order[self.starts[word]:self.ends[word]]
        return own[np.searchsorted(own, i - far):np.searchsorted(own, i - near)]


class _Windows:
    """Sums of hashed words, to compare stretches of any length at once."""

    def __init__(self, x: np.ndarray):
        mixed = (x.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1342543DE82EF95)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
        self.powers = np.cumprod(np.full(len(x) + 1, _BASE, dtype=np.uint64))
        self.sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(mixed * self.powers[:-1])))

    def squares(self, end: int | np.ndarray, lags: np.ndarray) -> np.ndarray:
        """Where the ``lag`` words up to ``end`` (inclusive) may equal those before them."""
        stop, mid, start = self.sums[end + 1], self.sums[end + 1 - lags], self.sums[end + 1 - 2 * lags]
        return (stop - mid) == (mid - start) * self.powers[lags - 1]


def _emitted(end: int, lag: int, length: int, found: list) -> None:
    """A diagonal whose last match is at ``end`` gives its run if it is long enough."""
    words = length + lag
    if words >= max(LEAST_WORDS, LEAST_PERIODS * lag):
        found.append((end + 1 - words, words, lag))


def _openings(x: np.ndarray, places: _Places, windows: _Windows, lo: int, hi: int, power: int, known: list
              ) -> Iterator[tuple[int, list[int]]]:
    """(place, lags) where diagonals of lags in (power/2, power] may open, place by place."""
    step = max(power // 2, 1)
    at_all = np.arange(-(-lo // step) * step, hi, step)
    if power <= _SMALL:
        # few lags: all of them at once for every place
        lags = np.arange(step + 1 if power > 1 else 1, power + 1)
        hit = 2 * lags <= at_all[:, None] + 1
        at, which = np.nonzero(hit)
        hit[at, which] = windows.squares(at_all[at], lags[which])
        hit[1:] &= ~hit[:-1]                       # a diagonal that opened a place before is still active
        at, which = np.nonzero(hit)
        cuts = [*np.flatnonzero(np.diff(at, prepend=-1)).tolist(), len(at)]
        places_of, lags_of = at_all[at].tolist(), lags[which]
        candidates = ((places_of[a], lags_of[a:b]) for a, b in zip(cuts, cuts[1:]))
    else:
        candidates = ((i, None) for i in at_all.tolist())
    live, coming = [], iter(known)
    head = next(coming, None)
    before = np.zeros(0, dtype=np.int64)
    for i, lags in candidates:
        while head and head[0] <= i:
            live.append(head)
            head = next(coming, None)
        live = [r for r in live if r[0] + r[1] > i]
        if any(r[0] <= i + 1 - 2 * power for r in live):
            before = before[:0]
            continue                               # all lags that match here are multiples of that run's period
        if lags is None:
            lags = i - places.between(i, power, step)
            lags = lags[2 * lags <= i + 1]
            lags = lags[windows.squares(i, lags)]
            lags, before = np.setdiff1d(lags, before, assume_unique=True) if len(before) else lags, lags
        for start, _, period in live:
            lags = lags[(lags % period != 0) | (i + 1 - lags < start)]
        if len(lags):
            yield i, lags.tolist()


def _read(x: np.ndarray, xs: list[int], openings: Iterator[tuple[int, list[int]]], hi: int, found: list) -> None:
    """Follow the diagonals word by word from where they open; none of them goes on beyond ``hi``."""
    active: dict[int, int] = {}

    def follow(first: int, stop: int) -> None:
        for i in range(first, stop):
            if not active:
                return
            word = xs[i]
            for lag in [*active]:
                if xs[i - lag] == word:
                    active[lag] += 1
                else:
                    _emitted(i - 1, lag, active.pop(lag), found)

    at = 0
    for i, lags in openings:
        follow(at, i + 1)
        at = i + 1
        for lag in lags:
            if lag not in active and np.array_equal(x[i + 1 - lag:i + 1], x[i + 1 - 2 * lag:i + 1 - lag]):
                length = lag                       # it may have begun since the last place to open
                while i - length - lag >= 0 and xs[i - length] == xs[i - length - lag]:
                    length += 1
                active[lag] = length
    follow(at, hi)
    for lag, length in active.items():
        _emitted(hi - 1, lag, length, found)


def runs_of(x: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence of word numbers (from 0, as few as words), by start and period."""
    n = len(x)
    if n < LEAST_WORDS:
        return []
    order = np.argsort(x, kind="stable")
    lag = _last_lag(x, order)
    found: list[tuple[int, int, int]] = []
    places, windows, xs = None, None, []
    power = 1
    while (power // 2 + 1) * LEAST_PERIODS <= n:
        regions = _regions(lag, power)
        if regions and windows is None:
            places, windows, xs = _Places(x, order), _Windows(x), x.tolist()
        known = sorted(found)
        begins = [r[0] for r in known]
        for lo, hi in regions:
            # a run of a smaller power lies in the region but for its first period
            near = known[bisect_left(begins, lo - power):bisect_left(begins, hi)]
            _read(x, xs, _openings(x, places, windows, lo, hi, power, near), hi, found)
        power *= 2
    return sorted(set(found), key=lambda r: (r[0], r[2]))


def runs_of_texts(texts: list[list]) -> list[list[tuple[int, int, int]]]:
    """The runs of several texts at once: no word of a text is numbered like one of another."""
    numbers, base = [], 0
    for words in texts:
        numbers.append(numbered(words) + base)
        base += len(words)
    starts = np.cumsum([0, *map(len, texts)])
    out: list[list] = [[] for _ in texts]
    for start, length, period in runs_of(np.concatenate(numbers) if numbers else np.zeros(0, dtype=np.int64)):
        k = int(np.searchsorted(starts, start, side="right")) - 1
        out[k].append((start - int(starts[k]), length, period))
    return out


def kept_words(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    inside = np.cumsum(edges[:-1]) > 0
    return [w for w, drop in zip(words, inside.tolist()) if not drop]


_OUT = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def find_runs(df: DataFrame, text_col: str = "text", id_col: str = "doc_id",
              prepare: Callable[[object, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """(id_col, n_words, runs by start and period, collapsed text) of every row, in one narrow pass.

    ``prepare(id, words)`` may give other words than those of the text.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for part in C.slices(batch, 1):
                ids = part.column(0)
                texts = [words_of(data) for data in C.bytes_of(part, 1)]
                if prepare:
                    texts = [prepare(key, words) for key, words in zip(ids.to_pylist(), texts)]
                found = runs_of_texts(texts)
                counts = [len(words) for words in texts]
                runs = [[{"start": s, "length": n, "period": p} for s, n, p in own] for own in found]
                collapsed = [b" ".join(kept_words(words, own)) for words, own in zip(texts, found)]
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(counts, pa.int64()), pa.array(runs, _RUNS), pa.array(collapsed, pa.binary()).view(pa.string())],
                    names=["id", "n_words", "runs", "collapsed"])

    return (df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
            .mapInArrow(batches, f"id {kind}, {_OUT}").withColumnRenamed("id", id_col))


def planted(doc_id: object, words: list[bytes]) -> list[bytes]:
    """The words with the periodic tail that the ids of this query name; a null id has none."""
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def op11_periodic_runs(spark, sf_dir) -> DataFrame:
    """Runs of every document, the greatest of them, and the digest of the text without its repetitions."""
    found = find_runs(C.table(spark, sf_dir, "documents"), prepare=planted)
    # the least of (-length, start, period)
    best = F.array_min(F.transform("runs", lambda r: F.struct(
        (-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    written = F.array_join(F.transform("runs", lambda r: F.concat(
        F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    row = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"),
                       F.sha2(written, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
                       "n_words")
    length = -F.col("best.less")
    return row.select("doc_id", "n_runs", F.col("best.start").alias("start"), length.alias("length"),
                      F.col("best.period").alias("period"),
                      F.expr("1000 * -best.less div best.period").alias("exponent_milli"),
                      "runs_sha256", "collapsed_sha256", "n_words")
