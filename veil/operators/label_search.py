"""Search over label-word pairings in bounded memory (F16).

A pairing takes one candidate word per class; there are as many as the product
of the candidate counts.  Two ways, by the number of pairings:

* ``tile_sums`` scores all of them: pairings are numbered (the last class
  fastest) and cut into tiles; a task holds one block of rows and one tile, and
  tiles are dealt over the tasks as rows are.
* ``best_pairings`` finds the best few without scoring all: a box holds a range
  of words of every class, and a row of label y can be right for some pairing
  of the box only if the greatest logit of the y range beats the least logit of
  every other range.  The count of such rows bounds the hits of the whole box
  and is exact for a box of one pairing.  Boxes that cannot reach the n-th best
  pairing are dropped, the others are halved; each step is one pass over the
  rows for a bounded number of boxes.  Memory is bounded on any input; the
  number of passes is small where most words are poor choices for their class
  and grows with the pairings where all words are alike.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veil.functions import arrays as AR

TILE = 1 << 16                  # pairings that a task scores at once
BOXES = 4096                    # boxes that one pass bounds
_ROWS = 512                     # rows of a block
SUMS = ["n", "hits", "x", "y", "xx", "yy", "xy"]


def _rows(examples: DataFrame, logits_col: str, label_col: str) -> DataFrame:
    return examples.where(F.col(logits_col).isNotNull() & F.col(label_col).isNotNull()).select(
        AR.to_double(logits_col).alias("logits"), F.col(label_col).cast("double").alias("label"))


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray, pd.DataFrame]]:
    """Blocks of at most ``_ROWS`` rows: logits, labels, the rows."""
    for pdf in batches:
        for lo in range(0, len(pdf), _ROWS):
            part = pdf.iloc[lo:lo + _ROWS]
            yield np.stack(part["logits"].to_numpy()).astype(np.float64), part["label"].to_numpy(), part


def _scores(logits: np.ndarray, y: np.ndarray, words: Sequence[np.ndarray], number: np.ndarray,
            correlation: bool) -> np.ndarray:
    """The sums of some pairings over a block of rows."""
    sums = np.zeros((len(SUMS), len(number)))
    picked = np.unravel_index(number, tuple(len(w) for w in words))
    sums[0] = len(y)
    if correlation:
        x = 1 / (1 + np.exp(logits[:, words[0][picked[0]]] - logits[:, words[1][picked[1]]]))
        sums[2:] = [x.sum(axis=0), np.full(len(number), y.sum()), (x * x).sum(axis=0),
                    np.full(len(number), (y * y).sum()), (x * y[:, None]).sum(axis=0)]
        return sums
    best = logits[:, words[0][picked[0]]]
    at = np.zeros(best.shape, dtype=np.int16)
    for k in range(1, len(words)):
        other = logits[:, words[k][picked[k]]]
        at = np.where(other > best, np.int16(k), at)            # ties: the first class
        best = np.maximum(best, other)
    sums[1] = (at == y[:, None]).sum(axis=0)
    return sums


def tile_sums(examples: DataFrame, words: Sequence[np.ndarray], logits_col: str, label_col: str,
              correlation: bool = False, tile: int = TILE, numbers: Sequence[int] | None = None) -> DataFrame:
    """(pairing, sums) of all pairings, or of the given ``numbers``.

    Rows are copied to as many deals as the tiles need to be worked on side by
    side (at most the cores of the session); a block's sums of a tile are added
    to those of other blocks before and after the shuffle.
    """
    total = len(numbers) if numbers is not None else int(np.prod([len(w) for w in words], dtype=object))
    tiles = -(-total // tile)
    deals = max(1, min(tiles, examples.sparkSession.sparkContext.defaultParallelism))
    chosen = None if numbers is None else np.asarray(numbers, dtype=np.int64)
    step = max(1, min(tile, (8 << 20) // (8 * _ROWS)))           # numbers of a block's inner matrix: 8 MB a class

    def score(batches):
        for logits, y, part in _blocks(batches):
            for deal in np.unique(part["deal"].to_numpy()):
                own = part["deal"].to_numpy() == deal
                for first in range(int(deal) * step, total, deals * step):
                    at = np.arange(first, min(first + step, total))
                    number = at if chosen is None else chosen[at]
                    yield pd.DataFrame({"pairing": number, **dict(zip(SUMS, _scores(
                        logits[own], y[own], words, number, correlation)))})

    rows = _rows(examples, logits_col, label_col)
    if deals > 1:
        rows = rows.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(deals - 1)))).repartition("deal", F.xxhash64("logits"))
    else:
        rows = rows.withColumn("deal", F.lit(0))
    return rows.mapInPandas(score, "pairing long, " + ", ".join(f"{c} double" for c in SUMS)).groupBy("pairing").agg(
        *[F.sum(c).alias(c) for c in SUMS])


class _Box:
    """Word ranges [lo, hi) of every class, and the most rows that any of its pairings gets right."""

    __slots__ = ("lo", "hi", "bound", "first")

    def __init__(self, lo: tuple, hi: tuple, shape: tuple):
        self.lo, self.hi, self.bound = lo, hi, None
        self.first = int(np.ravel_multi_index(lo, shape))       # its least pairing number

    @property
    def single(self) -> bool:
        return all(h - l == 1 for l, h in zip(self.lo, self.hi))

    def halves(self, shape: tuple) -> list[_Box]:
        """Both halves of its widest range."""
        c = max(range(len(self.lo)), key=lambda k: self.hi[k] - self.lo[k])
        mid = (self.lo[c] + self.hi[c]) // 2
        return [_Box(self.lo, (*self.hi[:c], mid, *self.hi[c + 1:]), shape),
                _Box((*self.lo[:c], mid, *self.lo[c + 1:]), self.hi, shape)]


def _bounds(rows: DataFrame, words: Sequence[np.ndarray], boxes: list[_Box]) -> list[int]:
    """For every box the number of rows that some pairing in it may get right: one pass."""
    ranges = [sorted({(b.lo[c], b.hi[c]) for b in boxes}) for c in range(len(words))]
    place = [{r: k for k, r in enumerate(rs)} for rs in ranges]
    which = np.array([[place[c][b.lo[c], b.hi[c]] for b in boxes] for c in range(len(words))])

    def count(batches):
        hits = np.zeros(len(boxes), dtype=np.int64)
        for logits, y, _ in _blocks(batches):
            top, low = [], []
            for c, rs in enumerate(ranges):
                own = logits[:, words[c]]
                top.append(np.stack([own[:, a:b].max(axis=1) for a, b in rs], axis=1))
                low.append(np.stack([own[:, a:b].min(axis=1) for a, b in rs], axis=1))
            for label in np.unique(y):
                if label != int(label) or not 0 <= label < len(words):
                    continue
                c, mine = int(label), y == label
                ok = np.ones((mine.sum(), len(boxes)), dtype=bool)
                best = top[c][mine][:, which[c]]
                for k in range(len(words)):
                    if k != c:
                        rest = low[k][mine][:, which[k]]
                        ok &= best > rest if k < c else best >= rest
                hits += ok.sum(axis=0)
        yield pd.DataFrame({"box": np.arange(len(boxes)), "hits": hits})

    got = rows.mapInPandas(count, "box long, hits long").groupBy("box").agg(F.sum("hits").alias("hits")).collect()
    out = {r.box: r.hits for r in got}                           # one row a box
    return [int(out.get(k, 0)) for k in range(len(boxes))]


def best_pairings(examples: DataFrame, words: Sequence[np.ndarray], logits_col: str, label_col: str, top_n: int,
                  boxes: int = BOXES) -> list[tuple[int, int]]:
    """(hits, pairing number) of the ``top_n`` pairings with most hits, ties by number: exact.

    A pass bounds at most ``boxes`` boxes, the narrowest first, so that at most
    ``boxes`` times the number of halvings wait on the driver.
    """
    shape = tuple(len(w) for w in words)
    rows = _rows(examples, logits_col, label_col)
    best: list[tuple[int, int]] = []                             # heap of (hits, -number)
    waiting = [_Box((0,) * len(shape), shape, shape)]            # bounded boxes
    waiting[0].bound = np.iinfo(np.int64).max

    def hopeless(box: _Box) -> bool:
        if len(best) < top_n:
            return False
        hits, number = best[0]
        return box.bound < hits or (box.bound == hits and box.first > -number)

    width = lambda b: sum(h - l for l, h in zip(b.lo, b.hi))     # noqa: E731
    while waiting and top_n > 0:
        waiting = [b for b in waiting if not hopeless(b)]
        waiting.sort(key=lambda b: (width(b), -b.bound, b.first))
        parents, waiting = waiting[:max(1, boxes // 2)], waiting[max(1, boxes // 2):]
        children = [h for b in parents for h in ([b] if b.single else b.halves(shape))]
        for box, bound in zip(children, _bounds(rows, words, children) if children else []):
            box.bound = bound
            if box.single:
                heapq.heappush(best, (bound, -box.first))
                if len(best) > top_n:
                    heapq.heappop(best)
            else:
                waiting.append(box)
    return sorted(((h, -m) for h, m in best), key=lambda p: (-p[0], p[1]))


def words_of_pairing(words: Sequence[np.ndarray], number: Column) -> list[Column]:
    """The word of each class of a pairing number."""
    picks, rest = [], number
    for w in reversed(list(words)):
        picks.insert(0, F.element_at(F.array(*[F.lit(int(x)) for x in w]), (F.pmod(rest, F.lit(len(w))) + 1).cast("int")))
        rest = F.floor(rest / len(w))
    return picks
