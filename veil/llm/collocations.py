"""Phrase collocations by top-order marginalisation.

Every word of a piece leads one window: the word and its next four as columns
``w1`` to ``w5``, padded with the empty string where the piece ends.  Only these
longest windows are counted; ``ROLLUP (w1, …, w5)`` sums them to the counts of
all shorter phrases, since a phrase occurs where a window begins with it, and
to the number of words of a group.

Most windows hold a neighbour pair, or three to five words in a row, that are
rare, and no phrase that is frequent enough holds one.  Two passes before add
pairs, then longer windows all whose pairs may be frequent, to 2^26 hashed
saturating counters (one byte each, of fixed size whatever the corpus); what
has a counter below the least count is certainly too rare, and the windows end
before it, like at the end of a piece.  Different windows of one counter only
keep windows longer: the counts of frequent phrases are exact on any input.
Every word still leads a window.

Scores are compared in decimals: ``1000·a·n div (l·r)`` of the worst cut.

Results per case: null and empty texts have no words; a null group is ``und``;
a text is read whole by one task; ties of score and count are ordered by the
phrase's bytes; repeated rows count again; an empty table gives an empty
result; only the text and group columns are read; the counts of a hot group
are summed in its tasks before the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veil.llm import common as C
from veil.session import cut_lineage

LONGEST = 5
LEAST_COUNT = 100
TOP = 2000
COUNTER_BITS = 26
SLICE_BYTES = 5 << 20           # text bytes that are counted together inside a task
_CHUNKS = 64                    # parts of the counters
_COLUMNS = [f"w{k}" for k in range(1, LONGEST + 1)]

# what each byte becomes: letters lower-case, tabs blanks, ends of pieces line ends
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A"):ord("Z") + 1] += 32
_FOLD[9] = 32
_FOLD[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = 10


class _Tokens:
    """Words of some texts: numbers into a dictionary, groups, and which words follow one another."""

    def __init__(self, texts: list[bytes], groups: list[str]):
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
        raw = _FOLD[np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)]
        word = (raw != 32) & (raw != 10)
        edge = np.flatnonzero(np.diff(np.concatenate(([False], word, [False])).astype(np.int8)))
        starts, ends = edge[::2], edge[1::2]
        offsets = np.concatenate(([0], np.cumsum(ends - starts)))
        array = pa.LargeStringArray.from_buffers(
            len(starts), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(raw[word]))
        coded = array.dictionary_encode()
        self.words = coded.dictionary
        self.ids = coded.indices.to_numpy().astype(np.int64)
        self.group_names = list(dict.fromkeys(groups))
        number = {g: k for k, g in enumerate(self.group_names)}
        of_text = np.fromiter((number[g] for g in groups), dtype=np.int64, count=len(groups))
        self.groups = of_text[np.searchsorted(np.cumsum(sizes), starts, side="right")]
        piece = np.searchsorted(np.flatnonzero(raw == 10), starts)
        self.joined = piece[1:] == piece[:-1]      # word i and i + 1 stand in one piece
        self.hashes = _hashed(self.words)[self.ids] if len(self.ids) else np.zeros(0, dtype=np.uint64)
        salt = np.array([_salt(g) for g in self.group_names], dtype=np.uint64)
        if len(self.ids):
            self.hashes = _mixed(self.hashes ^ salt[self.groups])

    def pairs(self, bits: int) -> np.ndarray:
        """Place of the counter of each word with its next."""
        return _place(_mixed(self.hashes[:-1] * _STEP + self.hashes[1:]), bits)

    def lengths(self, pairs: bytes, bits: int) -> np.ndarray:
        """Words of each word's window up to the first pair that is too rare."""
        follows = self.joined.copy()
        follows[follows] = _is_set(pairs, self.pairs(bits)[follows])
        at = np.arange(len(self.ids))
        stops = np.append(np.flatnonzero(~follows), len(self.ids) - 1)
        return np.minimum(stops[np.searchsorted(stops, at)] - at + 1, LONGEST)

    def chains(self, lengths: np.ndarray, bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(k, words whose windows have k words or more, counters of those k words) for k from 3 on.

        ``lengths`` may shrink meanwhile.
        """
        at = np.flatnonzero(lengths >= 3)
        h = _mixed(self.hashes[at] * _STEP + self.hashes[at + 1])
        for k in range(3, LONGEST + 1):
            keep = lengths[at] >= k
            at, h = at[keep], h[keep]
            h = _mixed(h * _STEP + self.hashes[at + k - 1] + np.uint64(k))
            yield k, at, _place(h, bits)


_STEP = np.uint64(0x9E3779B97F4A7C15)


def _place(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def _is_set(bitmap: bytes, at: np.ndarray) -> np.ndarray:
    b = np.frombuffer(bitmap, dtype=np.uint8)
    return ((b[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).astype(bool)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def _salt(group: str) -> int:
    return int(_mixed(np.array([int.from_bytes(group.encode()[:8].ljust(8, b"\0"), "little")
                                + len(group)], dtype=np.uint64))[0])


def _hashed(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of every string: sums of bytes times powers."""
    _, offsets, data = words.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[words.offset:words.offset + len(words) + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[:at[-1]].astype(np.uint64) + np.uint64(1)
    place = np.arange(len(raw)) - np.repeat(at[:-1], np.diff(at))
    powers = np.cumprod(np.full(int(place.max(initial=0)) + 1, 0x9E3779B97F4A7C15, dtype=np.uint64))
    sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(raw * powers[place])))
    return _mixed(sums[at[1:]] - sums[at[:-1]])


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[_Tokens]:
    """The texts of a task, some megabytes at a time (columns text, group)."""
    texts, groups, size = [], [], 0
    for batch in batches:
        for part in C.slices(batch, 0):
            for data, group in zip(C.bytes_of(part, 0), part.column(1).to_pylist()):
                texts.append(data)
                groups.append(group)
                size += len(data)
            if size >= SLICE_BYTES:
                yield _Tokens(texts, groups)
                texts, groups, size = [], [], 0
    if texts:
        yield _Tokens(texts, groups)


def rare_filter(rows: DataFrame, least: int, bits: int, places: Callable[[_Tokens], np.ndarray]) -> bytes:
    """A bit for every counter that reaches ``least`` (at most 255): 2^bits / 8 bytes on the driver.

    ``places`` gives the counters that the words of a slice add to.
    """
    if not 1 <= least <= 255:
        raise ValueError("least must be between 1 and 255")
    if bits < 9:
        raise ValueError("fewer than 512 counters do not fill the bytes of all chunks")
    codec = lambda: pa.Codec("zstd", compression_level=1)
    width = (1 << bits) // _CHUNKS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, dtype=np.uint8)
        for t in _slices(batches):
            at, n = np.unique(places(t), return_counts=True)
            counts[at] = np.minimum(counts[at] + np.minimum(n, 255), 255)
        for k in range(_CHUNKS):
            part = counts[k * width:(k + 1) * width]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array(
                    [codec().compress(part.tobytes(), asbytes=True)], pa.binary())], names=["chunk", "counts"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = np.frombuffer(codec().decompress(packed, width, asbytes=True), dtype=np.uint8)
                old = sums.get(k)
                sums[k] = np.minimum(part.astype(np.uint16) + (0 if old is None else old), 255).astype(np.uint8)
        for k, part in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array(
                [np.packbits(part >= least).tobytes()], pa.binary())], names=["chunk", "bits"])

    filled = (rows.mapInArrow(count, "chunk int, counts binary").repartition(_CHUNKS, "chunk")
              .mapInArrow(total, "chunk int, bits binary"))
    out = np.zeros((1 << bits) // 8, dtype=np.uint8)
    for r in filled.collect():                          # _CHUNKS rows of fixed size
        out[r.chunk * width // 8:(r.chunk + 1) * width // 8] = np.frombuffer(r.bits, dtype=np.uint8)
    return out.tobytes()


def windows(rows: DataFrame, least: int, bits: int = COUNTER_BITS) -> DataFrame:
    """(group, w1 … w5, n): padded longest windows, each task's counted once a slice."""
    share = rows.sparkSession.sparkContext.broadcast          # 2^bits / 8 bytes each
    pairs = share(rare_filter(rows, least, bits, lambda t: t.pairs(bits)[t.joined]))

    def longer(t: _Tokens) -> np.ndarray:
        lengths = t.lengths(pairs.value, bits)
        return np.concatenate([at for _, _, at in t.chains(lengths, bits)])

    chains = share(rare_filter(rows, least, bits, longer))

    def emit(t: _Tokens, parts: list) -> None:
        """Distinct windows of every length from the shortest on; parts gets (group, word places, n)."""
        length = t.lengths(pairs.value, bits)
        for k, at, place in t.chains(length, bits):
            length[at[~_is_set(chains.value, place)]] = k - 1
        here = np.arange(len(t.ids))
        width = len(t.words) + 1
        code = t.groups * width + t.ids
        for k in range(1, LONGEST + 1):
            done = length == k
            _, first, n = np.unique(code[done], return_index=True, return_counts=True)
            at = here[done][first]
            parts.append((t.groups[at], t.ids[at[:, None] + np.arange(k)], n))
            here, length, code = here[~done], length[~done], code[~done]
            if not len(here):
                break
            code = np.unique(code, return_inverse=True)[1].astype(np.int64) * width + t.ids[here + k]

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _slices(source):
            if not len(t.ids):
                continue
            parts: list = []
            emit(t, parts)
            names = pa.array(t.group_names, pa.string())
            padded = pa.concat_arrays([t.words.cast(pa.string()), pa.array([""], pa.string())])
            pad = len(t.words)
            for groups, ids, n in parts:
                for lo in range(0, len(n), 100_000):
                    sel = slice(lo, lo + 100_000)
                    columns = [pc.take(names, pa.array(groups[sel]))]
                    for k in range(LONGEST):
                        column = ids[sel, k] if k < ids.shape[1] else np.full(len(n[sel]), pad)
                        columns.append(pc.take(padded, pa.array(column)))
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(n[sel].astype(np.int64))],
                                                     names=["g", *_COLUMNS, "n"])

    schema = "g string, " + ", ".join(f"{c} string" for c in _COLUMNS) + ", n long"
    return rows.mapInArrow(batches, schema)


def phrase_counts(df: DataFrame, text_col: str = "text", group_col: str = "lang", least: int = LEAST_COUNT,
                  bits: int = COUNTER_BITS) -> DataFrame:
    """(g, words, phrase, f): phrases of one to five words that occur ``least`` times or more in a group.

    The row of no words has the number of all words of the group.
    """
    rows = df.select(F.col(text_col).cast("string").alias("text"),
                     F.coalesce(F.col(group_col).cast("string"), F.lit("und")).alias("g"))
    counted = windows(rows, min(least, 255), bits).groupBy("g", *_COLUMNS).agg(
        F.sum("n").alias("n"))
    # a column that is rolled up is null; one that stays is a word, or the pad behind a shorter window
    summed = counted.rollup("g", *_COLUMNS).agg(F.sum("n").alias("f")).where("g is not null")
    size = sum(F.col(c).isNotNull().cast("int") for c in _COLUMNS)
    last = F.coalesce(*[F.col(c) for c in reversed(_COLUMNS)])
    return summed.select("g", size.alias("words"), F.concat_ws(" ", *_COLUMNS).alias("phrase"), "f", last.alias("l")
                         ).where((F.col("words") == 0) | ((F.col("l") != "") & (F.col("f") >= least))).drop("l")


def collocations(df: DataFrame, text_col: str = "text", group_col: str = "lang", least: int = LEAST_COUNT,
                 top: int = TOP, bits: int = COUNTER_BITS) -> DataFrame:
    """(group_col, rank, phrase, a, l, r, n, score): the best phrases of every group."""
    counts = cut_lineage(phrase_counts(df, text_col, group_col, least, bits))
    found = counts.where("words >= 2").withColumnRenamed("f", "a")
    # a phrase is dropped if one that is a word longer is as frequent: counts of still longer ones lie between
    split = F.split("phrase", " ")
    inner = found.where("words >= 3").select("g", "a", split.alias("s"), "words").select("g", "a", F.explode(F.array(
        F.concat_ws(" ", F.slice("s", F.lit(1), F.col("words") - 1)),
        F.concat_ws(" ", F.slice("s", F.lit(2), F.col("words") - 1)))).alias("phrase"))
    covered = inner.groupBy("g", "phrase").agg(F.max("a").alias("most"))
    own = found.join(covered, ["g", "phrase"], "left").where("most is null or most < a")
    cuts = own.select("g", "phrase", "a", split.alias("s"), "words").select(
        "g", "phrase", "a", "s", "words", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")).select(
        "g", "phrase", "a", "k", F.concat_ws(" ", F.slice("s", F.lit(1), F.col("k"))).alias("left"),
        F.concat_ws(" ", F.slice("s", F.col("k") + 1, F.col("words") - F.col("k"))).alias("right"))
    part = counts.where("words between 1 and 4")
    scored = (cuts.join(part.select("g", F.col("phrase").alias("left"), F.col("f").alias("l")), ["g", "left"])
              .join(part.select("g", F.col("phrase").alias("right"), F.col("f").alias("r")), ["g", "right"])
              .join(counts.where("words = 0").select("g", F.col("f").alias("n")), "g")
              .withColumn("score", F.expr(
                  "cast(1000 * a as decimal(19, 0)) * cast(n as decimal(18, 0))"
                  " div (cast(l as decimal(18, 0)) * cast(r as decimal(18, 0)))")))
    worst = scored.groupBy("g", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("x"))
    order = Window.partitionBy("g").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    return (worst.select("g", "phrase", "x.score", "x.a", "x.l", "x.r", "x.n")
            .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
            .select(F.col("g").alias(group_col), F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))


def op12_collocations(spark, sf_dir) -> DataFrame:
    """The first 2000 phrases of every language."""
    return collocations(C.table(spark, sf_dir, "documents"))


SQL = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text,
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS p
  FROM documents),
worded AS (
  SELECT lang, list_filter(string_split_regex(p, '[\\x20\\x09]+'), lambda x: x <> '') AS ws FROM pieces),
leads AS (
  SELECT lang, unnest(list_transform(range(1, len(ws) + 1), lambda i: ws[i:i + {LONGEST - 1}])) AS w
  FROM worded WHERE len(ws) > 0),
totals AS (SELECT lang, count(*) AS n FROM leads GROUP BY lang),
sized AS (
  SELECT lang, array_to_string(w[1:k], ' ') AS phrase, k, count(*) AS f
  FROM leads, range(1, {LONGEST + 1}) AS t(k) WHERE len(w) >= k GROUP BY ALL),
counts AS (SELECT * FROM sized WHERE f >= {LEAST_COUNT}),
found AS (SELECT lang, phrase, k AS words, f AS a, string_split(phrase, ' ') AS s FROM counts WHERE k >= 2),
covered AS (
  SELECT b.lang, unnest([array_to_string(b.s[1:b.words - 1], ' '), array_to_string(b.s[2:b.words], ' ')]) AS phrase,
    b.a FROM found b WHERE b.words >= 3),
own AS (
  SELECT * FROM found f WHERE NOT EXISTS (
    SELECT 1 FROM covered c WHERE c.lang = f.lang AND c.phrase = f.phrase AND c.a >= f.a)),
cuts AS (
  SELECT o.lang, o.phrase, o.a, t.k, array_to_string(o.s[1:t.k], ' ') AS lft,
    array_to_string(o.s[t.k + 1:o.words], ' ') AS rgt
  FROM own o, range(1, {LONGEST}) AS t(k) WHERE t.k < o.words),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r, n.n,
    CAST((1000::HUGEINT * c.a * n.n) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = c.lft
  JOIN counts y ON y.lang = c.lang AND y.phrase = c.rgt JOIN totals n ON n.lang = c.lang),
worst AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
    phrase, a, l, r, n, score FROM worst)
SELECT * FROM ranked WHERE rank <= {TOP}
"""
