"""Look-ups of the words of many texts, a chunk of rows at a time.

Exploding every place of every text, joining it and gathering it back per row
shuffles many times the text.  Here rows are dealt to chunks of bounded bytes;
a chunk asks for each of its distinct words and word pairs once, the answers
come back to the chunk, and its rows are finished there:

    rows ─by chunk─┬─► distinct words, pairs ─⋈ table─► answers ─by chunk─┐
                   └──────────────────────────────────────────────────────┴─► rows

Words are numbered by their order within the chunk and pairs by those numbers,
so asking and finishing agree without handing strings back.
"""

from __future__ import annotations

from functools import reduce
from operator import and_
from typing import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

CHUNK = "__chunk"
CHUNK_BYTES = 8 << 20          # text of a chunk
LEAST_BYTES = 1 << 20          # smaller chunks are not made for the sake of more tasks
_HELD = 1 << 17                # words held as Python strings


def dealt(df: DataFrame, text_cols: Sequence[str], near_cols: Sequence[str] = (), chunk_bytes: int | None = None) -> DataFrame:
    """``df`` with ``__chunk``, whole chunks in partitions.  Rows are dealt by a hash of all
    their columns, so copies of a text under several keys go to several chunks; with
    ``near_cols`` (of groups that a task can hold) rows of a group stay together."""
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)).cast("long") for c in text_cols), F.lit(0).cast("long"))
    total = df.agg(F.sum(size)).first()[0] or 0
    tasks = 3 * df.sparkSession.sparkContext.defaultParallelism
    n = max(1, -(-total // (chunk_bytes or CHUNK_BYTES)), min(tasks, total // LEAST_BYTES))
    known = [F.col(f"`{f.name}`") for f in df.schema if "map<" not in f.dataType.simpleString()]
    key = F.xxhash64(*known)
    if near_cols:
        key = F.when(reduce(and_, [F.col(c).isNotNull() for c in near_cols]), F.xxhash64(*near_cols)).otherwise(key)
    return df.withColumn(CHUNK, F.pmod(key, F.lit(n))).repartition(n, CHUNK)


def looked_up(rows: DataFrame, ask: Callable, asked: str, look_up: Callable, finish: Callable, shape: StructType) -> DataFrame:
    """Rows of ``dealt`` finished with the answers of their chunk.

    ``ask`` makes the table (schema ``asked``, ``__chunk`` among it) of what a chunk's
    rows need, ``look_up`` the DataFrame of answers (with ``__chunk``), ``finish`` the
    result from a chunk's rows and answers.
    """
    answers = look_up(rows.groupBy(CHUNK).applyInArrow(ask, asked))
    return rows.groupBy(CHUNK).cogroup(answers.groupBy(CHUNK)).applyInArrow(finish, shape)


def coded(token_lists) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words in order, the number of every word, words per list)."""
    parts, held, sizes = [], [], []
    for toks in token_lists:
        sizes.append(len(toks))
        held += toks
        if len(held) >= _HELD:
            parts.append(pa.array(held, pa.string()).dictionary_encode())
            held = []
    parts.append(pa.array(held, pa.string()).dictionary_encode())
    words = pc.unique(pa.chunked_array([p.dictionary for p in parts]))
    words = words.combine_chunks() if isinstance(words, pa.ChunkedArray) else words
    words = words.take(pc.sort_indices(words))
    codes = [pc.index_in(p.dictionary, value_set=words).to_numpy().astype(np.int64)[p.indices.to_numpy()] if len(p)
             else np.zeros(0, dtype=np.int64) for p in parts]
    return words, np.concatenate(codes), np.array(sizes, dtype=np.int64)


def neighbours(sizes: np.ndarray) -> np.ndarray:
    """Places of words that another word of the same list follows."""
    follows = np.ones(int(sizes.sum()), dtype=bool)
    ends = np.cumsum(sizes)[sizes > 0]
    follows[ends - 1] = False
    return np.flatnonzero(follows)


ASKED = f"{CHUNK} long, id long, w0 string, w1 string"


def words_and_pairs(chunk: int, token_lists) -> pa.Table:
    """(__chunk, id, w0, w1) of the distinct words (w1 null) and of the distinct neighbours, as ``numbered`` numbers them."""
    words, codes, sizes = coded(token_lists)
    n, at = len(words), neighbours(sizes)
    pairs = np.unique(codes[at] * n + codes[at + 1])
    ids = np.concatenate([np.arange(n), n + pairs])
    w0 = pa.concat_arrays([words, words.take(pa.array(pairs // max(n, 1)))])
    w1 = pa.concat_arrays([pa.nulls(n, pa.string()), words.take(pa.array(pairs % max(n, 1)))])
    return pa.table({CHUNK: pa.array(np.full(len(ids), chunk)), "id": pa.array(ids), "w0": w0, "w1": w1})


class Numbered:
    """The words and neighbours of a chunk's lists and what is known of them, by number."""

    def __init__(self, token_lists):
        self.words, self.codes, self.sizes = coded(token_lists)
        self.at = neighbours(self.sizes)
        n = len(self.words)
        self.pairs, self.pair_of = np.unique(self.codes[self.at] * n + self.codes[self.at + 1], return_inverse=True)
        self.first, self.second = self.pairs // max(n, 1), self.pairs % max(n, 1)

    def known(self, ids: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of the words and of the pairs; 0 where there is no answer."""
        n = len(self.words)
        of_words = np.zeros((n, *values.shape[1:]), dtype=values.dtype)
        of_pairs = np.zeros((len(self.pairs), *values.shape[1:]), dtype=values.dtype)
        single = ids < n
        of_words[ids[single]] = values[single]
        of_pairs[np.searchsorted(self.pairs, ids[~single] - n)] = values[~single]
        return of_words, of_pairs
