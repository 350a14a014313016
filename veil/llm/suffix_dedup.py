"""Removal of repeated byte strings with a distributed array of sampled suffixes.

A byte goes when it is covered by a string of ``LENGTH`` bytes that also starts
anywhere else.  Sorting the suffixes of all positions would move hundreds of
bytes for each byte of text, so the suffixes are sampled by content: every
window of ``LENGTH`` bytes names the place of its least hashed ``GRAM`` bytes
as its anchor (the first of equals), so equal windows have equal anchors at
equal offsets.  Neighbouring windows share an anchor and form a context.

1. Contexts are counted by their anchor's bytes and by their whole bytes (as
   hashes).  A context found twice repeats in all its windows; one whose
   anchor bytes stand nowhere else repeats in none.
2. Of the others, one of each kind is taken from its text and cut into pieces
   of at most ``STEP`` windows.  The bytes that all windows of a piece share
   are the leading tokens of its suffix; sampled splitters range-partition the
   suffixes by them.  Each bucket sorts what follows them, and what stands
   before them read backwards, by multikey quicksort, and the common prefixes
   of neighbours tell which windows are equal.  Suffixes of equal leading
   tokens are never in two buckets, and groups that reach over the end of a
   batch are carried on, so nothing is lost at a boundary.  Pieces of a core that
   stands in too many places, or in two tasks, are cut into parts of ``_FINE``
   windows, which are counted as hashes: parts that are equal as a whole repeat,
   and only where parts share what all their windows share, and differ besides,
   one of each kind is counted window by window.
3. The repeated windows go back to every context of the same bytes, and each
   text is cut.

Results per case: null texts are empty; texts shorter than ``LENGTH`` are kept
whole; a string repeated within one text counts, overlapping itself too;
repeated rows repeat each other; matches never cross texts; whole texts of any
length; an empty table gives an empty result; only the id and text columns are
read.
"""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veil.llm import common as C
from veil.session import keep

LENGTH = 400
GRAM = 32                   # bytes of an anchor, a power of two
STEP = 93                   # windows of a piece
_FINE = 10                  # windows of a part of a piece, where a core's pieces are not held together
_SEGMENT = 1 << 20          # windows looked at together
_PLACE = np.uint64((1 << 24) - 1)
_ROWS_AT_ONCE = 20_000
_GROUP = 10_000             # pieces of one core that are sorted together; of more, parts are counted as hashes
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def gram_hashes(text: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each place on."""
    h = (text.astype(np.uint64) + np.uint64(1)) * _M2
    h ^= h >> np.uint64(29)
    n = 1
    while n < GRAM:
        h = h[:-n] * _M1 + (h[n:] ^ (h[n:] >> np.uint64(31)))
        n *= 2
    h = (h ^ (h >> np.uint64(32))) * _M2
    return h ^ (h >> np.uint64(29))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours, from running minima of blocks in both directions."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n - width + 1], ahead[width - 1:n])


def contexts(text: bytes):
    """(anchor hash, context hash, packed place) of every context of a text.

    The place packs the first window's start, the number of windows and the
    anchor's distance from the first start.
    """
    for base in range(0, max(0, len(text) - LENGTH + 1), _SEGMENT):
        part = text[base:base + _SEGMENT + LENGTH - 1]
        grams = gram_hashes(np.frombuffer(part, dtype=np.uint8))
        keys = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
        anchor = (sliding_min(keys, LENGTH - GRAM + 1) & _PLACE).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        count = np.diff(np.append(first, len(anchor)))
        anchor = anchor[first]
        shape = (count - 1 << 9) + anchor - first
        whole = np.fromiter((xxhash.xxh64_intdigest(part[a:a + n + LENGTH - 1], s) for a, n, s in zip(
            first.tolist(), count.tolist(), shape.tolist())), np.uint64, len(first))
        yield grams[anchor].view(np.int64), whole.view(np.int64), (base + first << 18) + shape


def _unpack(at: int) -> tuple[int, int, int]:
    """(first start, windows, offset of the anchor in the first window)"""
    return at >> 18, (at >> 9 & 511) + 1, at & 511


def _context_batches(batches):
    for batch in batches:
        for part in C.slices(batch, 1):
            keys, rows = [], []
            for key, text in zip(part.column(0).to_pylist(), C.bytes_of(part, 1)):
                for row in contexts(text):
                    keys.append(np.full(len(row[0]), key, dtype=np.int64))
                    rows.append(row)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), *(
                    pa.array(np.concatenate(c)) for c in zip(*rows))], ["key", "g", "u", "at"])


def _pack_batches(batches):
    for batch in batches:
        for part in C.slices(batch, 2):
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(
                C.pack(C.bytes_of(part, 2)), pa.binary())], ["id", "key", "packed"])


def _piece_batches(batches):
    """Pieces of the wanted contexts of each text."""
    for batch in (part for whole in batches for part in C.slices(whole, whole.schema.get_field_index("packed"))):
        out: dict[str, list] = {k: [] for k in ("lead", "core", "before", "after", "lo", "hi", "part", "g", "u", "n")}
        held = 0
        for text, wanted in zip(map(C.unpack, batch.column("packed").to_pylist()), batch.column("wanted").to_pylist()):
            for row in wanted:
                start, count, far = _unpack(row["at"])
                anchor, near = start + far, far - count + 1
                for part in range(near // STEP, far // STEP + 1):
                    # offsets of the anchor in the piece's windows, from the piece's least
                    lo, hi = max(near, part * STEP) - part * STEP, min(far, part * STEP + STEP - 1) - part * STEP
                    a = anchor - part * STEP
                    b = a - STEP + 1 + LENGTH
                    core = text[a:b]
                    for name, value in (("lead", core[:8]), ("core", md5(core).digest() + bytes([part])),
                                        ("before", text[a - hi:a]), ("after", text[b:b + STEP - 1 - lo]), ("lo", lo),
                                        ("hi", hi), ("part", part), ("g", row["g"]), ("u", row["u"]), ("n", row["n"])):
                        out[name].append(value)
                    held += 1
            if held >= _ROWS_AT_ONCE:
                yield _pieces(out)
                held = 0
                for v in out.values():
                    v.clear()
        if held:
            yield _pieces(out)


def _pieces(out):
    kinds = [pa.binary()] * 4 + [pa.int32()] * 3 + [pa.int64()] * 3
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds)], list(out))


_PIECES = ("lead binary, core binary, before binary, after binary, lo int, hi int, part int, g long, u long, n long")
_HANDED = ["g", "u", "lo", "hi", "n", "part", "core", "before", "after"]
_FOUND = ["g", "u", "near", "far", "n", "part", "core", "before", "after"]      # no core: a run of repeated windows
_PARTS = "g long, u long, n long, part int, place int, lo int, hi int, shared long, whole long"
_WINDOWS = "g long, u long, n long, near int, window long"


def multikey_order(group: np.ndarray, strings: np.ndarray) -> np.ndarray:
    """Order of the rows of a byte matrix by group, then by their bytes.

    Multikey quicksort with eight bytes as one character, all segments of
    equal prefixes at once: rows that a character has told apart are done.
    """
    n, width = strings.shape
    chars = np.zeros((n, -(-width // 8) * 8), dtype=np.uint8)
    chars[:, :width] = strings
    chars = chars.view(">u8").astype(np.uint64)
    order = np.argsort(group, kind="stable")
    segment = group[order]
    segment = np.cumsum(np.concatenate([[0], segment[1:] != segment[:-1]]))
    for d in range(chars.shape[1]):
        size = np.bincount(segment)
        tied = np.flatnonzero(size[segment] > 1)
        if not len(tied):
            break
        at = np.lexsort((chars[order[tied], d], segment[tied]))
        order[tied] = order[tied][at]
        char = chars[order, d]
        segment = np.cumsum(np.concatenate([[0], (segment[1:] != segment[:-1]) | (
            (char[1:] != char[:-1]) & (segment[1:] == segment[:-1]))]))
    return order


def _matrix(strings: list[bytes], backwards: bool) -> np.ndarray:
    width = STEP - 1
    rows = [(s[::-1] if backwards else s).ljust(width, b"\0") for s in strings]
    return np.frombuffer(b"".join(rows), dtype=np.uint8).reshape(len(strings), width)


def _common(order: np.ndarray, group: np.ndarray, strings: np.ndarray) -> np.ndarray:
    """Common prefix of each row with the one before it in the order; -1 across groups."""
    out = np.full(len(order), -1, dtype=np.int64)
    a, b = order[:-1], order[1:]
    differ = strings[a] != strings[b]
    prefix = np.where(differ.any(axis=1), differ.argmax(axis=1), strings.shape[1])
    out[1:] = np.where(group[a] == group[b], prefix, -1)
    return out


def equal_windows(group: np.ndarray, before: list[bytes], after: list[bytes], lo: np.ndarray, hi: np.ndarray):
    """[pieces, STEP] True where a piece's window of that offset equals one of another piece of its group."""
    left, right = _matrix(before, True), _matrix(after, False)
    orders = [multikey_order(group, m) for m in (left, right)]
    common = [_common(o, group, m) for o, m in zip(orders, (left, right))]
    n = len(group)
    out = np.zeros((n, STEP), dtype=bool)
    for offset in range(STEP):
        # a window takes this many bytes before and after the shared ones
        need = (offset, STEP - 1 - offset)
        classes = []
        for order, prefix, bytes_needed in zip(orders, common, need):
            cls = np.empty(n, dtype=np.int64)
            cls[order] = np.cumsum(prefix < bytes_needed)
            classes.append(cls)
        on = np.flatnonzero((lo <= offset) & (offset <= hi))
        if not len(on):
            continue
        code = classes[0][on] * (n + 1) + classes[1][on]
        sort = np.argsort(code, kind="stable")
        code = code[sort]
        same = np.concatenate([[False], code[1:] == code[:-1]])
        same[:-1] |= same[1:]
        out[on[sort[same]], offset] = True
    return out


def _bucket_batches(batches):
    """Repeated windows of the pieces of a task, which come sorted by their leading tokens.

    The first and last group of a task may go on in another one, and a group of
    more than ``_GROUP`` pieces is not held: these pieces are handed on as they
    are (with their core), and are counted over all tasks.
    """
    held: list[pa.RecordBatch] = []
    rows = 0
    open_core = None                    # pieces of this core are handed on
    for batch in batches:
        if not batch.num_rows:
            continue
        if open_core is None:
            open_core = batch.column("core")[0].as_py()
        held.append(batch)
        rows += batch.num_rows
        if rows < _ROWS_AT_ONCE:
            continue
        whole = pa.Table.from_batches(held).combine_chunks()
        starts = _group_starts(whole)
        cut = starts[-1]
        # the last group goes on in the next batch or task
        if rows - cut > _GROUP:
            yield from _groups(whole, starts, {open_core, last := whole.column("core")[cut].as_py()})
            open_core, held, rows = last, [], 0
        else:
            yield from _groups(whole.slice(0, cut), starts[:-1], {open_core})
            held, rows = whole.slice(cut).to_batches(), rows - cut
    if held:
        whole = pa.Table.from_batches(held).combine_chunks()
        yield from _groups(whole, _group_starts(whole), {open_core, whole.column("core")[rows - 1].as_py()})


def _group_starts(table: pa.Table) -> list[int]:
    core = table.column("core")
    differ = np.asarray(pc.not_equal(core.slice(1), core.slice(0, len(core) - 1)))
    return [0, *(np.flatnonzero(differ) + 1).tolist()]


def _groups(table: pa.Table, starts: list[int], handed_on: set):
    """Groups that are whole are sorted together; the others are handed on."""
    at = 0
    core = table.column("core")
    for a, b in zip(starts, [*starts[1:], table.num_rows]):
        if b - a > _GROUP or core[a].as_py() in handed_on:
            if at < a:
                yield from _solve(table.slice(at, a - at))
            yield from table.slice(a, b - a).select(_HANDED).rename_columns(_FOUND).to_batches()
            at = b
    if at < table.num_rows:
        yield from _solve(table.slice(at))


def _shared(core: bytes, before: bytes, after: bytes, lo: int, hi: int) -> bytes:
    """The core's name and what the windows of these offsets have in common around it."""
    return core + before[len(before) - lo:] + after[:STEP - 1 - hi]


def _part_batches(batches):
    """Parts of the pieces that were handed on: hashes of what their windows share, and of all their bytes."""
    for batch in batches:
        rows = []
        for g, u, lo, hi, n, part, core, before, after in zip(*(c.to_pylist() for c in batch.columns)):
            for first in range(lo // _FINE * _FINE, hi + 1, _FINE):
                last = min(first + _FINE, STEP) - 1
                a, b = max(lo, first), min(hi, last)
                rows.append((g, u, n, part, first, a, b, _hash(_shared(core, before, after, first, last)),
                             _hash(core + before[len(before) - b:] + after[:STEP - 1 - a], a * STEP + b)))
        yield _rows(rows, _PARTS)


def _window_batches(batches):
    """(g, u, n, near, window): hash of every window of the wanted parts; near is its offset."""
    for batch in batches:
        rows = []
        for g, u, n, part, core, before, after, wanted in zip(*(c.to_pylist() for c in batch.columns)):
            for r in wanted:
                rows += [(g, u, n, part * STEP + at, _hash(_shared(core, before, after, at, at)))
                         for at in range(r["lo"], r["hi"] + 1)]
        yield _rows(rows, _WINDOWS)


def _hash(text: bytes, seed: int = 0) -> int:
    return xxhash.xxh64_intdigest(text, seed) - (1 << 63)


def _rows(rows: list[tuple], kinds: str) -> pa.RecordBatch:
    names, types = zip(*(c.split() for c in kinds.split(", ")))
    columns = zip(*rows) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if t == "long" else pa.int32())
                                       for c, t in zip(columns, types)], list(names))


def _counted(found: DataFrame) -> DataFrame:
    """(g, u, near, far): runs of the repeated windows of the pieces that were handed on."""
    handed = found.where("core is not null")
    parts = keep(handed.select("g", "u", "near", "far", "n", "part", "core", "before", "after")
                 .mapInArrow(_part_batches, _PARTS))
    shares = ["g", "part", "place", "shared"]
    kinds = keep(parts.groupBy(*shares, "whole").agg(
        F.count("*").alias("pieces"), F.min(F.struct("u", "lo", "hi")).alias("one")))
    equal = parts.where("n = 1").join(kinds.where("pieces > 1").select(*shares, "whole"), [*shares, "whole"]).select(
        "g", "u", *[(F.col("part") * STEP + F.col(c)).alias(to) for c, to in (("lo", "near"), ("hi", "far"))])
    mixed = kinds.groupBy(*shares).agg(F.count("*").alias("kinds")).where("kinds > 1").drop("kinds")
    # at most STEP / _FINE + 1 parts of a piece
    wanted = kinds.join(mixed, shares).groupBy("g", "part", "one.u").agg(
        F.collect_list(F.struct("one.lo", "one.hi")).alias("wanted"))
    windows = keep(handed.join(wanted, ["g", "part", "u"]).select(
        "g", "u", "n", "part", "core", "before", "after", "wanted").mapInArrow(_window_batches, _WINDOWS))
    twice = windows.groupBy("g", "near", "window").agg(F.count("*").alias("pieces")).where("pieces > 1")
    single = windows.where("n = 1").join(twice, ["g", "near", "window"]).select("g", "u", "near", F.col("near").alias("far"))
    offsets = equal.unionByName(single).groupBy("g", "u").agg(F.array_sort(F.array_distinct(F.flatten(
        F.collect_list(F.sequence("near", "far"))))).alias("o"))         # at most LENGTH of a context
    return offsets.select("g", "u", F.explode(F.arrays_zip(
        F.filter("o", lambda x: ~F.array_contains("o", x - 1)).alias("near"),
        F.filter("o", lambda x: ~F.array_contains("o", x + 1)).alias("far"))).alias("r")).select("g", "u", "r.near", "r.far")


def _solve(table: pa.Table):
    core = table.column("core").to_pylist()
    number: dict[bytes, int] = {}
    group = np.array([number.setdefault(c, len(number)) for c in core], dtype=np.int64)
    lo, hi = np.asarray(table.column("lo")), np.asarray(table.column("hi"))
    hit = equal_windows(group, table.column("before").to_pylist(), table.column("after").to_pylist(), lo, hi)
    hit &= (np.asarray(table.column("n")) == 1)[:, None]         # the others repeat as a whole
    padded = np.zeros((len(group), STEP + 2), dtype=np.int8)
    padded[:, 1:-1] = hit
    edge = np.diff(padded, axis=1)
    row, first = np.nonzero(edge == 1)
    _, last = np.nonzero(edge == -1)
    base = np.asarray(table.column("part"))[row] * STEP
    yield pa.RecordBatch.from_arrays([
        pa.array(np.asarray(table.column("g"))[row]), pa.array(np.asarray(table.column("u"))[row]),
        pa.array((base + first).astype(np.int32)), pa.array((base + last - 1).astype(np.int32)),
        pa.nulls(len(row), pa.int64()), pa.nulls(len(row), pa.int32()), *[pa.nulls(len(row), pa.binary())] * 3], _FOUND)


def repeated_spans(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(id, key, packed) of every row, and (key, windows): the repeated windows of a key as start ranges."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = df.select(F.col(id_col).alias("id"), text.alias("text")).select(
        "id", F.xxhash64(F.col("id").cast("string"), "text").alias("key"), "text")
    found = keep(docs.select("key", "text").mapInArrow(_context_batches, "key long, g long, u long, at long"))
    packed = docs.mapInArrow(_pack_batches, f"id {docs.schema['id'].dataType.simpleString()}, key long, packed binary")
    kinds = found.groupBy("g", "u").agg(F.count("*").alias("n"), F.min(F.struct("key", "at")).alias("one"))
    mixed = kinds.groupBy("g").agg(F.count("*").alias("kinds")).where("kinds > 1").select("g")
    wanted = kinds.join(mixed, "g").select("one.key", F.struct("g", "u", "n", "one.at").alias("w"))
    pieces = (packed.join(wanted.groupBy("key").agg(F.collect_list("w").alias("wanted")), "key")
              .select("packed", "wanted").mapInArrow(_piece_batches, _PIECES))
    # the context's hash spreads the pieces of a frequent core over tasks
    solved = keep(pieces.repartitionByRange("lead", "core", "u").sortWithinPartitions("lead", "core")
                  .mapInArrow(_bucket_batches, "g long, u long, near int, far int, n long, part int, "
                              "core binary, before binary, after binary"))
    some = solved.where("core is null").select("g", "u", "near", "far").unionByName(_counted(solved))
    whole = kinds.where("n > 1").select("g", "u", F.lit(0).alias("near"), F.lit(511).alias("far"))
    far, count = F.col("at").bitwiseAND(F.lit(511)), F.shiftright("at", 9).bitwiseAND(F.lit(511)) + 1
    anchor = F.shiftright("at", 18) + far
    hits = found.join(whole.unionByName(some), ["g", "u"]).select(
        "key", (anchor - F.least("far", far)).alias("first"), (anchor - F.greatest("near", far - count + 1)).alias("last"))
    return packed, hits.groupBy("key").agg(F.collect_set(F.struct("first", "last")).alias("windows"))


def _cut_batches(batches):
    for batch in (part for whole in batches for part in C.slices(whole, 1, C.SLICE_BYTES // 2)):
        figures = []
        for text, windows in zip(map(C.unpack, batch.column("packed").to_pylist()), batch.column("windows").to_pylist()):
            spans: list[list[int]] = []
            for w in sorted((w["first"], w["last"] + LENGTH) for w in windows or ()):
                if spans and w[0] <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], w[1])
                else:
                    spans.append(list(w))
            kept, at = [], 0
            for a, b in spans:
                kept.append(text[at:a])
                at = b
            kept.append(text[at:])
            figures.append((len(text), [{"start": a, "end": b} for a, b in spans], b"".join(kept)))
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in figures], pa.int64()),
                                          pa.array([f[1] for f in figures], span),
                                          pa.array([f[2] for f in figures], pa.binary())],
                                         ["id", "n_bytes", "spans", "kept"])


def remove_repeats(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id_col, n_bytes, spans, kept): removed byte spans and the bytes that stay, of every row."""
    docs, windows = repeated_spans(df, text_col, id_col)
    kind = docs.schema["id"].dataType.simpleString()
    return (docs.join(windows, "key", "left").select("id", "packed", "windows")
            .mapInArrow(_cut_batches, f"id {kind}, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
            .withColumnRenamed("id", id_col))


def op9_suffix_dedup(spark, sf_dir) -> DataFrame:
    """What is removed from every document."""
    out = remove_repeats(C.table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))
