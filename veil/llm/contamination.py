"""Benchmark decontamination with an FM-index per training shard.

A shard is a bounded run of documents inside one task.  Its words become
numbers of the benchmark vocabulary; runs of vocabulary words that are long
enough to hold a window are written one after another with a separator (no
window can reach beyond such a run), and an FM-index is built over them:
suffix array, BWT, a wavelet matrix for ranks, and the suffix positions that
are multiples of ``SAMPLE``.  All windows of the benchmark are searched
backwards at once, occurrences are located by LF steps to a sampled position,
and the hit words are merged into removal spans.

The benchmark is taken in blocks of bounded bytes; with several blocks each is
one more narrow pass over the documents, so no block grows with the table.

Results per case: null and empty texts have no words and no hits; items
without words are ignored, a null item id counts as ''; repeated items with
one id are one item; an empty benchmark hits nothing; repeated documents are
treated alike, at any length whole; an empty table gives an empty result; all
columns of the input can be handed on, names do not clash.
"""

from __future__ import annotations

import re
from functools import partial
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veil.llm import common as C

WINDOW = 10
SAMPLE = 8                      # every SAMPLE-th suffix position is stored
BLOCK_BYTES = 1 << 20           # benchmark text searched in one pass
SHARD_WORDS = 1_000_000         # indexed words of a shard
SHARD_SLICES = 4                # slices of C.SLICE_BYTES text of a shard
_SEPARATOR, _FIRST = 1, 2       # symbol 0 ends the text

# bytes that are no word characters become blanks, A-Z lower case
_TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
                  for b in range(256))
_WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of all suffixes by prefix doubling; ``text`` ends with its only 0."""
    n = len(text)
    rank = text.astype(np.int64)
    width = 1
    while True:
        nxt = np.zeros(n, dtype=np.int64)
        nxt[:n - width] = rank[width:] + 1 if width < n else 0
        key = rank * (max(int(rank.max()), n) + 2) + nxt
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
        rank = np.empty(n, dtype=np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            return order
        width *= 2


class FMIndex:
    """Backward search and location over a word-number text."""

    def __init__(self, text: np.ndarray, sample: int = SAMPLE):
        self.n = len(text)
        order = suffix_array(text)
        bwt = text[order - 1]
        self.bits = max(1, int(text.max()).bit_length())
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=1 << self.bits))])
        self.ones, self.zeros = [], []
        row = bwt
        for bit in range(self.bits - 1, -1, -1):
            on = (row >> bit & 1).astype(bool)
            self.ones.append(np.concatenate([[0], np.cumsum(on)]))
            self.zeros.append(self.n - int(self.ones[-1][-1]))
            row = np.concatenate([row[~on], row[on]])
        symbols = np.arange(1 << self.bits)
        self.start = self._down(symbols, np.zeros(len(symbols), dtype=np.int64))
        kept = order % sample == 0
        self.kept_rank = np.concatenate([[0], np.cumsum(kept)])
        self.kept_pos = order[kept]

    def _down(self, symbol, pos):
        for level in range(self.bits):
            ones = self.ones[level][pos]
            pos = np.where(symbol >> (self.bits - 1 - level) & 1, self.zeros[level] + ones, pos - ones)
        return pos

    def rank(self, symbol, pos):
        """Occurrences of ``symbol`` in the BWT before ``pos``."""
        return self._down(symbol, pos) - self.start[symbol]

    def search(self, patterns: np.ndarray, lens: np.ndarray):
        """Suffix ranges [lo, hi) of right-aligned patterns (rows, padded on the left)."""
        lo, hi = np.zeros(len(patterns), dtype=np.int64), np.full(len(patterns), self.n, dtype=np.int64)
        width = patterns.shape[1] if patterns.ndim == 2 else 0
        live = np.arange(len(patterns))
        for step in range(width):
            live = live[(lens[live] <= step) | (lo[live] < hi[live])]
            on = live[lens[live] > step]
            c = patterns[on, width - 1 - step]
            known = c < 1 << self.bits
            hi[on[~known]] = lo[on[~known]]
            on, c = on[known], c[known]
            lo[on] = self.first[c] + self.rank(c, lo[on])
            hi[on] = self.first[c] + self.rank(c, hi[on])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix ranks, by LF steps to a sampled position."""
        out = np.empty(len(rows), dtype=np.int64)
        todo, pos, steps = np.arange(len(rows)), rows.copy(), 0
        while len(todo):
            done = self.kept_rank[pos + 1] > self.kept_rank[pos]
            out[todo[done]] = self.kept_pos[self.kept_rank[pos[done]]] + steps
            todo, pos = todo[~done], pos[~done]
            symbol, at = np.zeros(len(pos), dtype=np.int64), pos
            for level in range(self.bits):
                before = self.ones[level][at]
                on = self.ones[level][at + 1] > before
                symbol = symbol * 2 + on
                at = np.where(on, self.zeros[level] + before, at - before)
            pos = self.first[symbol] + at - self.start[symbol]
            steps += 1
        return out


def _words(text: bytes) -> list[bytes]:
    return text.translate(_TO_WORDS).split()


class Windows:
    """The distinct windows of a block of benchmark items."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.vocab: dict[bytes, int] = {}
        found: dict[tuple, set] = {}
        for item, text in items:
            ids = [self.vocab.setdefault(w, len(self.vocab) + _FIRST) for w in _words(text.encode())]
            for a in range(max(1, len(ids) - window + 1) if ids else 0):
                found.setdefault(tuple(ids[a:a + window]), set()).add(item)
        self.items = [sorted(s) for s in found.values()]
        self.lens = np.fromiter(map(len, found), np.int64, len(found))
        self.patterns = np.zeros((len(found), window), dtype=np.int64)
        for k, w in enumerate(found):
            self.patterns[k, window - len(w):] = w
        self.least = int(self.lens.min()) if found else 0


def _runs(on: np.ndarray, least: int):
    """Starts and ends of the runs of True of at least ``least``."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], on.astype(np.int8), [0]])))
    start, end = edge[::2], edge[1::2]
    long = end - start >= least
    return start[long], end[long]


def _hits(numbers: list[np.ndarray], windows: Windows):
    """Per window hit: its place in the concatenated ``numbers`` and its window."""
    flat = np.concatenate(numbers) if numbers else np.zeros(0, np.int64)
    start, end = _runs(flat > 0, windows.least)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # runs one after another, each followed by a separator
    size = end - start
    place = np.repeat(start - (np.cumsum(size + 1) - (size + 1)), size + 1) + np.arange(int((size + 1).sum()))
    text = np.append(flat[np.minimum(place, len(flat) - 1)], 0)
    text[np.cumsum(size + 1) - 1] = _SEPARATOR
    index = FMIndex(text)
    lo, hi = index.search(windows.patterns, windows.lens)
    count = np.maximum(hi - lo, 0)
    which = np.repeat(np.arange(len(count)), count)
    rows = np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    return place[index.locate(rows)], which


def _search_batches(batches, windows):
    """Rows (row, text, n_words, spans, items): adds what this block finds."""
    w = windows.value
    get = w.vocab.get

    def flush(parts, numbers, counts):
        at, which = _hits(numbers, w)
        # each text is followed by one 0, so places tell texts apart
        ends = np.cumsum(np.concatenate([np.asarray(c) for c in counts]) + 1) if counts else np.zeros(0, np.int64)
        doc = np.searchsorted(ends, at, side="right")
        order = np.argsort(doc, kind="stable")
        at, which, doc = at[order], which[order], doc[order]
        base = 0
        for part, count in zip(parts, counts):
            spans, items = part.column(3).to_pylist(), part.column(4).to_pylist()
            for d in np.unique(doc[(doc >= base) & (doc < base + len(count))]).tolist():
                a, b = np.searchsorted(doc, [d, d + 1])
                first = at[a:b] - (ends[d] - count[d - base] - 1)
                hit = np.zeros(count[d - base], dtype=bool)
                edge = np.zeros(len(hit) + 1, dtype=np.int64)
                np.add.at(edge, first, 1)
                np.add.at(edge, first + w.lens[which[a:b]], -1)
                hit |= np.cumsum(edge)[:-1] > 0
                for s in spans[d - base]:
                    hit[s["start"]:s["end"]] = True
                spans[d - base] = [{"start": int(s), "end": int(e)} for s, e in zip(*_runs(hit, 1))]
                found = set(items[d - base]).union(*(w.items[k] for k in np.unique(which[a:b]).tolist()))
                items[d - base] = sorted(found)
            base += len(count)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(count, pa.int64()),
                 pa.array(spans, part.schema.field(3).type), pa.array(items, part.schema.field(4).type)],
                names=part.schema.names)

    parts, numbers, counts, held = [], [], [], 0
    for batch in batches:
        for part in C.slices(batch, 1):
            words = [_words(t) for t in C.bytes_of(part, 1)]
            count = [len(x) for x in words]
            ids = np.fromiter(chain.from_iterable(chain(map(get, x, repeat(0)), (0,)) for x in words),
                              np.int64, sum(count) + len(count))
            parts.append(part)
            numbers.append(ids)
            counts.append(count)
            start, end = _runs(ids > 0, w.least)
            held += int((end - start).sum())
            if held >= SHARD_WORDS or len(parts) >= SHARD_SLICES:
                yield from flush(parts, numbers, counts)
                parts, numbers, counts, held = [], [], [], 0
    if parts:
        yield from flush(parts, numbers, counts)


def find(df: DataFrame, benchmark: DataFrame, columns: list[str], text_col: str = "text", item_col: str = "item_id",
         item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """(row struct of ``columns``, text, n_words, spans, items) for every row.

    ``spans`` are merged [start, end) word positions of all window
    occurrences, ``items`` the ids of the items they belong to.
    """
    spark = df.sparkSession
    items = benchmark.where(F.col(item_text).isNotNull()).select(
        F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(item_text).alias("text"))
    size = items.agg(F.sum(F.octet_length("text")).alias("b"), F.max(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    out = df.select(F.struct(*[F.col(c) for c in columns]).alias("row"), F.col(text_col).cast("string").alias("text"),
                    F.lit(0).cast("long").alias("n_words"),
                    F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("spans"),
                    F.expr("cast(array() as array<string>)").alias("items"))
    for b in range(blocks):
        # about BLOCK_BYTES of benchmark text, whatever the size of the table
        block = [(r.item, r.text) for r in
                 items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b).toLocalIterator()]
        windows = spark.sparkContext.broadcast(Windows(block, window))
        out = out.mapInArrow(partial(_search_batches, windows=windows), out.schema)
    return out


def _cut(text: str, spans: list[dict]) -> str:
    """``text`` without the words of the spans and what stands between them."""
    places = [m.span() for m in _WORD.finditer(text)]
    kept, at = [], 0
    for s in spans:
        kept.append(text[at:places[s["start"]][0]])
        at = places[s["end"] - 1][1]
    return "".join(kept) + text[at:]


def _cut_batches(batches):
    for batch in batches:
        hit = np.flatnonzero(np.asarray(pc.list_value_length(batch.column(2))) > 0).tolist()
        texts = batch.column(1)
        if hit:
            values = texts.to_pylist()
            for k in hit:
                values[k] = _cut(values[k], batch.column(2)[k].as_py())
            texts = pa.array(values, texts.type)
        yield pa.RecordBatch.from_arrays([batch.column(0), texts], ["row", "text"])


def remove(df: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with every removal span cut out of its text; all rows and columns stay."""
    found = find(df, benchmark, [c for c in df.columns if c != text_col], text_col)
    out = found.select("row", "text", "spans").mapInArrow(
        _cut_batches, f"row {found.schema['row'].dataType.simpleString()}, text string")
    return out.select(*[F.col("text").alias(c) if c == text_col else F.col("row").getField(c).alias(c)
                        for c in df.columns])


def op7_fm_decontamination(spark, sf_dir) -> DataFrame:
    """Hit words and items of every document."""
    found = find(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"), ["doc_id"])
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select(F.col("row.doc_id").alias("doc_id"), "n_words", hit.alias("n_hit"),
                        F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
                        (F.size("spans") > 0).alias("contaminated"), "spans")
