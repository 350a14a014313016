"""Byte-level BPE encoding and decoding.

Every match of the split pattern is encoded on its own: all byte positions
start as tokens, and a segment tree over the positions stores the smallest
(pair rank, position), so its root is the leftmost pair of minimum rank.  A
merge changes the pairs of three positions only (the merged one, its left
neighbour and the swallowed right one), each a point update of log n steps.
Short pieces of a batch are merged together as numpy rows of equal tree size;
long pieces are merged one by one with the same tree.

Results per case: null text is the empty text; empty text has no ids and
decodes to no bytes; ids and texts are whole at any length; of equally ranked
pairs the leftmost is merged first; repeated rows and extra columns do not
matter, only the id and text columns are read; an empty table gives an empty
result.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache, partial
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veil.llm import common as C

# Unicode White_Space as the split pattern's \s sees it (fixed values).
_WS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# A match of the split pattern never crosses these units, and the matches
# inside a unit depend on the unit alone, so encoded units can be reused.
_UNITS = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]")
_NONE = np.int64(1) << 62
_POS_BITS = 32
_ID_BITS = 20
_CACHE_UNITS = 100_000      # distinct units kept per task before the cache restarts
_LONG = 256                 # bytes from which a piece is merged alone


class Ranks:
    """A rank file: token bytes by id, and the rank of every mergeable pair."""

    def __init__(self, data: bytes):
        self.ids = {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}
        size = max(self.ids.values()) + 1
        if size >= 1 << _ID_BITS:
            raise ValueError("the rank file has too many ids")
        self.bytes = [b""] * size
        for token, i in self.ids.items():
            self.bytes[i] = token
        self.byte_ids = np.array([self.ids[bytes([b])] for b in range(256)], dtype=np.int64)
        pairs = {}
        for token, rank in self.ids.items():
            for cut in range(1, len(token)):
                a, b = self.ids.get(token[:cut]), self.ids.get(token[cut:])
                if a is not None and b is not None:
                    pairs[(a << _ID_BITS) | b] = rank
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.ranks = np.array([pairs[k] for k in self.keys.tolist()], dtype=np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, or a huge value where the pair cannot merge."""
        key = (left << _ID_BITS) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE >> _POS_BITS)

    def merge_rows(self, pieces: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
        """Encode pieces of 2 to ``size`` bytes (a power of two) as rows of one array.

        Returns all ids in a row and the number of each piece.
        """
        m, none = len(pieces), _NONE
        lens = np.fromiter(map(len, pieces), np.int64, m)
        col = np.arange(size)
        inside = col < lens[:, None]
        # one spare column: the position after the end and before the start
        width = size + 1
        tok = np.zeros((m, width), dtype=np.int64)
        tok[:, :size][inside] = self.byte_ids[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        nxt = np.broadcast_to(np.arange(1, width + 1), (m, width)).copy()
        prv = np.broadcast_to(np.arange(-1, size), (m, width)).copy()
        live = np.zeros((m, width), dtype=bool)
        live[:, :size] = inside
        tree = np.full((m, 2 * size), none, dtype=np.int64)
        r, c = np.nonzero(col + 1 < lens[:, None])
        tree[r, size + c] = (self.pair_ranks(tok[r, c], tok[r, c + 1]) << _POS_BITS) | c
        level = size
        while level > 1:
            tree[:, level // 2:level] = np.minimum(tree[:, level:2 * level:2], tree[:, level + 1:2 * level:2])
            level //= 2
        tok, nxt, prv, flat_live, tree = tok.ravel(), nxt.ravel(), prv.ravel(), live.ravel(), tree.ravel()
        mask, no_pair = (1 << _POS_BITS) - 1, (_NONE >> _POS_BITS) << _POS_BITS
        rows = np.nonzero(tree[1::2 * size] < no_pair)[0]
        while len(rows):
            at, top = rows * width, rows * (2 * size)
            root = tree[top + 1]
            pos = root & mask
            right = nxt[at + pos]
            after = np.minimum(nxt[at + right], size)
            left = prv[at + pos]
            merged = root >> _POS_BITS
            tok[at + pos] = merged
            nxt[at + pos] = after
            prv[at + after] = pos
            flat_live[at + right] = False
            end, first = after >= lens[rows], left < 0
            before = np.where(first, pos, left)      # without a left neighbour: the same leaf again
            here = np.where(end, none, (self.pair_ranks(merged, tok[at + after]) << _POS_BITS) | pos)
            there = np.where(first, here, (self.pair_ranks(tok[at + before], merged) << _POS_BITS) | before)
            node = np.concatenate([right, pos, before]) + size
            base = np.concatenate([top, top, top])
            tree[base + node] = np.concatenate([np.full(len(rows), none), here, there])
            for _ in range(size.bit_length() - 1):
                child = base + (node & ~1)
                node >>= 1
                tree[base + node] = np.minimum(tree[child], tree[child + 1])
            rows = rows[tree[top + 1] < no_pair]
        return tok[flat_live], live.sum(axis=1)

    def merge_long(self, piece: bytes) -> list[int]:
        """Encode one piece of any length with a list as its segment tree."""
        n = len(piece)
        size = 1 << max(1, (n - 1).bit_length())
        none, get = int(_NONE), self.pairs.get
        tok = [int(self.byte_ids[b]) for b in piece]
        nxt, prv, live = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n

        def key(i):
            j = nxt[i]
            rank = get((tok[i] << _ID_BITS) | tok[j]) if j < n else None
            return none if rank is None else (rank << _POS_BITS) | i

        tree = [none] * (2 * size)
        tree[size:size + n] = [key(i) for i in range(n)]
        for node in range(size - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def update(i, value):
            node = i + size
            tree[node] = value
            node >>= 1
            while node:
                best = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == best:
                    break
                tree[node] = best
                node >>= 1

        while tree[1] < none:
            i = tree[1] & ((1 << _POS_BITS) - 1)
            tok[i] = tree[1] >> _POS_BITS
            j = nxt[i]
            nxt[i], live[j] = nxt[j], False
            if nxt[j] < n:
                prv[nxt[j]] = i
            update(j, none)
            update(i, key(i))
            if prv[i] >= 0:
                update(prv[i], key(prv[i]))
        return [t for t, on in zip(tok, live) if on]

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces in a row and the number of each; a piece that is itself a token is that token."""
        groups: dict[int, list[int]] = {}
        counts = np.ones(len(pieces), dtype=np.int64)
        order, parts = [], []
        whole, ids = [], []
        for k, p in enumerate(pieces):
            i = self.ids.get(p)
            if i is not None:
                whole.append(k)
                ids.append(i)
            elif len(p) > _LONG:
                parts.append(np.array(self.merge_long(p), dtype=np.int64))
                counts[k] = len(parts[-1])
                order.append([k])
            else:
                groups.setdefault(1 << max(1, (len(p) - 1).bit_length()), []).append(k)
        for size, members in groups.items():
            step = max(1, (1 << 21) // (size * 8))
            for a in range(0, len(members), step):
                part = members[a:a + step]
                flat, n = self.merge_rows([pieces[k] for k in part], size)
                counts[part] = n
                parts.append(flat)
                order.append(part)
        parts.append(np.array(ids, dtype=np.int64))
        order.append(whole)
        # back into the order of the pieces
        seq = np.fromiter(chain.from_iterable(order), np.int64, len(pieces))
        starts = np.zeros(len(pieces), dtype=np.int64)
        starts[seq] = np.cumsum(counts[seq]) - counts[seq]
        return np.concatenate(parts)[runs(starts, counts)], counts


def runs(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, … (counts[0] of them), then the same of the next."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - counts), counts)


@lru_cache(maxsize=2)
def _ranks(data: bytes) -> Ranks:
    return Ranks(data)


class _Numbers(dict):
    """Numbers units in the order they are first seen."""

    def __missing__(self, unit):
        self[unit] = n = len(self)
        return n


class Encoder:
    """Encodes texts, reusing the ids of units that were seen before."""

    def __init__(self, ranks: Ranks, pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.restart()

    def restart(self) -> None:
        self.numbers = _Numbers()
        self.ids = np.zeros(1 << 20, dtype=np.int32)         # ids of all known units in a row
        self.starts = np.zeros(1 << 18, dtype=np.int64)
        self.counts = np.zeros(1 << 18, dtype=np.int64)
        self.used = 0

    def learn(self, units: list[str], first: int) -> None:
        """Encode the units numbered from ``first`` on."""
        pieces, spans = [], np.ones(len(units), dtype=np.int64)
        for k, u in enumerate(units):
            if u.isalpha() or (u[0] == " " and u[1:].isalpha()):
                pieces.append(u.encode())
            else:
                found = self.pattern.findall(u)
                spans[k] = len(found)
                pieces += [p.encode("utf-8", "surrogatepass") for p in found]
        numbers = _Numbers()
        which = np.fromiter(map(numbers.__getitem__, pieces), np.int64, len(pieces))
        flat, n = self.ranks.encode_pieces(list(numbers))
        starts = np.cumsum(n) - n
        flat = flat[runs(starts[which], n[which])]
        ends = np.concatenate([[0], np.cumsum(n[which])])
        unit_ends = np.cumsum(spans)
        counts = ends[unit_ends] - ends[unit_ends - spans]
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while first + len(units) > len(self.counts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
            self.counts = np.concatenate([self.counts, np.zeros_like(self.counts)])
        self.ids[self.used:self.used + len(flat)] = flat
        self.counts[first:first + len(units)] = counts
        self.starts[first:first + len(units)] = self.used + np.cumsum(counts) - counts
        self.used += len(flat)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and the number of each text."""
        if len(self.numbers) > _CACHE_UNITS:
            self.restart()
        known = len(self.numbers)
        split = [_UNITS.findall(t) for t in texts]
        lens = np.fromiter(map(len, split), np.int64, len(split))
        which = np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(split)), np.int64, int(lens.sum()))
        del split
        if len(self.numbers) > known:
            self.learn(list(islice(self.numbers, known, None)), known)
        n = self.counts[which]
        ends = np.concatenate([[0], np.cumsum(n)])
        text_ends = np.cumsum(lens)
        return self.ids[runs(self.starts[which], n)], ends[text_ends] - ends[text_ends - lens]


def _lists(flat: np.ndarray, counts: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, type=pa.int32()))


def _encode_batches(batches, ranks, pattern):
    encoder = Encoder(_ranks(ranks.value), pattern)
    for batch in batches:
        for part in C.slices(batch, 1):
            flat, counts = encoder.encode(C.texts_of(part, 1))
            yield pa.RecordBatch.from_arrays([part.column(0), _lists(flat, counts)], ["id", "ids"])


def encode(df: DataFrame, vocab_path: str, pattern: str, text_col: str = "text",
           id_col: str = "doc_id") -> DataFrame:
    """(id_col, ids array<int>): the BPE ids of every text, one row per input row."""
    ranks = df.sparkSession.sparkContext.broadcast(C.bounded_file(vocab_path))
    kind = df.select(id_col).schema[0].dataType.simpleString()
    return (df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
            .mapInArrow(partial(_encode_batches, ranks=ranks, pattern=pattern), f"id {kind}, ids array<int>")
            .withColumnRenamed("id", id_col))


@lru_cache(maxsize=2)
def _token_bytes(data: bytes) -> list[bytes]:
    """Token bytes by id: all that decoding needs of a rank file."""
    ids = {int(b): base64.b64decode(a) for a, b in (line.split() for line in data.splitlines() if line)}
    return [ids.get(i, b"") for i in range(max(ids) + 1)]


def _decode_batches(batches, ranks):
    table = _token_bytes(ranks.value).__getitem__
    for batch in batches:
        ids = batch.column(1)
        values = ids.flatten().to_numpy(zero_copy_only=False)
        ends = np.cumsum(np.asarray(pc.list_value_length(ids), dtype=np.int64)).tolist()
        start = first = held = 0
        texts = []
        for k, end in enumerate(ends):
            texts.append(b"".join(map(table, values[start:end].tolist())))
            start, held = end, held + len(texts[-1])
            if held >= C.SLICE_BYTES or k + 1 == len(ends):
                n = len(texts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), ids.slice(first, n),
                                                  pa.array(texts, pa.binary())], ["id", "ids", "decoded"])
                first, held, texts = k + 1, 0, []


def decode(df: DataFrame, vocab_path: str, ids_col: str = "ids", id_col: str = "doc_id") -> DataFrame:
    """(id_col, ids_col, decoded binary): the bytes of every id list; null ids decode to no bytes."""
    ranks = df.sparkSession.sparkContext.broadcast(C.bounded_file(vocab_path))
    kind = df.select(id_col).schema[0].dataType.simpleString()
    return (df.select(F.col(id_col).alias("id"), F.coalesce(ids_col, F.expr("array()").cast("array<int>")).alias("ids"))
            .mapInArrow(partial(_decode_batches, ranks=ranks), f"id {kind}, ids array<int>, decoded binary")
            .withColumnRenamed("id", id_col).withColumnRenamed("ids", ids_col))


def digests(df: DataFrame, id_col: str = "doc_id", extra: list[str] | None = None) -> DataFrame:
    """The contract's digest columns of encoded and decoded rows."""
    return df.select(
        id_col, *(extra or []), F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.transform("ids", lambda i: i.cast("string")), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_byte_bpe(spark, sf_dir, vocab_path: str | None = None) -> DataFrame:
    """Encode and decode every whole text of ``documents``."""
    import public_tokenizers
    path = vocab_path or C.vocabulary_path("byte_bpe_50k.tiktoken")
    ids = encode(C.table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    return digests(decode(ids, path))
