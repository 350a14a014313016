"""Few-shot / GLUE-style dataset construction and label search."""

from __future__ import annotations

import math
import re
from typing import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from veil.functions import arrays as AR
from veil.functions.md5 import leading_bits
from veil.functions.ranking import hash_key, positions
from veil.operators import demos, label_search

# --- fixed values: GLUE column layout per task ---------------------------------
# task: (text_a index, text_b index or None, label index (-1 = last), guid from, header skipped)
GLUE_LAYOUT = {
    "mrpc": (3, 4, 0, "row", True),
    "mnli": (8, 9, -1, "first", True),
    "snli": (7, 8, -1, "first", True),
    "cola": (3, None, 1, "row", False),
    "sst-2": (0, None, 1, "row", True),
    "sts-b": (7, 8, -1, "first", True),
    "qqp": (3, 4, 5, "first", True),
    "qnli": (1, 2, -1, "first", True),
    "rte": (1, 2, -1, "first", True),
    "wnli": (1, 2, -1, "first", True),
}
TEXTCLS_TASKS = ["mr", "sst-5", "subj", "trec", "cr", "mpqa"]
STSB_BOUNDS = (0.0, 5.0)
STSB_MEDIAN = 2.5
# --- end of fixed values ------------------------------------------------------


# F1 ---------------------------------------------------------------------------
def glue_examples(lines: DataFrame, task: str, split: str, line_col: str = "value",
                  order_col: str = "line_no", first_label: str | None = None) -> DataFrame:
    """Tab-separated lines (with their line number) → (guid, text_a, text_b, label)."""
    a_idx, b_idx, l_idx, guid_from, skip_header = GLUE_LAYOUT[task]
    f = F.split(F.col(line_col), "\t")
    d = lines.withColumn("__f", f)
    if skip_header:
        d = d.where(F.col(order_col) > 0)
    if task == "qqp":
        d = d.where(F.size("__f") > 5)                      # short rows are dropped
    label = F.element_at("__f", -1) if l_idx == -1 else F.try_element_at("__f", F.lit(l_idx + 1))
    if task == "sst-2" and first_label is not None:
        label = F.when(F.size("__f") < 2, F.lit(first_label)).otherwise(label)
    guid_part = F.col(order_col).cast("string") if guid_from == "row" else F.col("__f")[0]
    return d.select(F.concat(F.lit(split + "-"), guid_part).alias("guid"),
                    F.col("__f")[a_idx].alias("text_a"),
                    (F.col("__f")[b_idx] if b_idx is not None else F.lit(None).cast("string")).alias("text_b"),
                    label.alias("label"))


# F2 ---------------------------------------------------------------------------
def textcls_examples(rows: DataFrame, task: str, split: str, cols: Sequence[str], order_col: str) -> DataFrame:
    """CSV rows without header; ``cols`` are the CSV columns c0, c1, …"""
    c = [F.col(x) for x in cols]
    if task in TEXTCLS_TASKS:
        text = c[1]
    elif task == "ag_news":
        text = F.concat(c[1], F.lit(". "), c[2])
    elif task == "yelp_review_full":
        text = c[1]
    elif task == "yahoo_answers":
        text = F.concat_ws(" ", *c[1:4])                    # null parts skipped
    else:
        raise ValueError(task)
    return rows.select(F.concat(F.lit(split + "-"), F.col(order_col).cast("string")).alias("guid"),
                       text.alias("text_a"), c[0].alias("label"))


# F3 / F4 ----------------------------------------------------------------------
_PART = re.compile(r"\*([^*]*)\*")


def parse_template(template: str) -> list[str]:
    """Split ``*part*`` markers; text outside markers is kept as literal parts."""
    return [p for p in template.split("*") if p != ""]


def _first_lower(c: Column) -> Column:
    return F.concat(F.lower(F.substring(c, 1, 1)), F.substring(c, 2, 1 << 30))


def _first_upper(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 1 << 30))


def _limit_words(c: Column, n: int | None) -> Column:
    if n is None:
        return c
    return F.array_join(F.slice(F.split(c, " "), 1, n), " ")


def render_template(template: str, sentences: Sequence[Column], label_words: Sequence[str] = (),
                    demo_labels: Sequence[Column] = (), cls: str = "<s>", mask: str = "<mask>",
                    sep: str = "</s>", first_limit: int | None = None, other_limit: int | None = None) -> Column:
    """Text form of a prompt template.  Parts between ``*``: cls, mask, sep,
    sep+, sent_i, +sent_i, sent-_i, sentl_i, +sentl_i, sentl-_i, sentu_i,
    +sentu_i, label_i, labelx_i; any other part is literal text with ``_`` as
    a space.  The template is parsed once on the driver into a list of column
    expressions."""
    pieces: list[Column] = []
    for part in template.split("*"):
        if part == "":
            continue
        m = re.fullmatch(r"(\+?)(sent|sentl|sentu)(-?)_(\d+)", part)
        if part == "cls":
            pieces.append(F.lit(cls))
        elif part == "mask":
            pieces.append(F.lit(mask))
        elif part in ("sep", "sep+"):
            pieces.append(F.lit(sep))
        elif m:
            plus, kind, minus, idx = m.group(1), m.group(2), m.group(3), int(m.group(4))
            s = sentences[idx]
            s = _limit_words(s, first_limit if idx == 0 else other_limit)
            if kind == "sentl":
                s = _first_lower(s)
            elif kind == "sentu":
                s = _first_upper(s)
            if minus:
                s = F.substr(s, F.lit(1), F.length(s) - 1)
            pieces.append(F.concat(F.lit(" "), s) if plus else s)
        elif re.fullmatch(r"label_\d+", part):
            pieces.append(F.lit(label_words[int(part.split("_")[1])]))
        elif re.fullmatch(r"labelx_\d+", part):
            pieces.append(demo_labels[int(part.split("_")[1])])
        else:
            pieces.append(F.lit(part.replace("_", " ")))
    return F.concat(*pieces)


def segment_ids(template: str) -> list[int]:
    """Segment id per part: ``sep+`` increments the segment after it."""
    seg, out = 0, []
    for part in template.split("*"):
        if part == "":
            continue
        out.append(seg)
        if part == "sep+":
            seg += 1
    return out


def expand_template(template: str, num_labels: int = 0, num_demos: int = 0, head: bool = False) -> str:
    """Replicate the template body per label (``*mask*`` → ``*label_i*``) or per
    in-context example (``*labelx_i*``).  With n sentences in the template, the
    i-th copy speaks of the sentences n·(1 + i) … n·(1 + i) + n − 1.  Copies
    follow the query, which alone keeps ``*cls*``; with ``head`` the in-context
    copies precede it, the last one first."""
    body = template.replace("*cls*", "")
    per_copy = 2 if "_1" in body else 1

    def copy(i: int, word: str) -> str:
        shifted = re.sub(r"(sent[lu]?-?_)(\d+)", lambda m: f"{m.group(1)}{int(m.group(2)) + per_copy * (1 + i)}", body)
        return shifted.replace("*mask*", f"*{word}_{i}*")

    if num_labels:
        return template + "".join(copy(i, "label") for i in range(num_labels))
    demos = [copy(i, "labelx") for i in range(num_demos)]
    return "".join(reversed(demos)) + template if head else template + "".join(demos)


# F5 ---------------------------------------------------------------------------
def fit_length(ids, max_len: int, pad_id: int = 0, truncate_head: bool = False, mask_id: int | None = None) -> Column:
    """Pad with ``pad_id`` to ``max_len`` or truncate tail (default) / head; the
    mask must stay inside."""
    a = F.col(ids) if isinstance(ids, str) else ids
    n = F.size(a)
    cut = (F.slice(a, F.greatest(n - max_len + 1, F.lit(1)), max_len) if truncate_head
           else F.slice(a, 1, max_len))
    out = F.when(n >= max_len, cut).otherwise(F.concat(a, F.array_repeat(F.lit(pad_id), max_len - n)))
    if mask_id is not None:
        out = F.when(F.array_contains(out, mask_id), out).otherwise(F.raise_error(F.lit("mask truncated")))
    return out


def fit_inputs(ids, max_len: int, pad_id: int = 0, truncate_head: bool = False, mask_id: int | None = None) -> Column:
    """struct(input_ids, attention_mask, mask_pos): ``fit_length`` with 1 for every id
    that is kept and 0 for padding, and the 0-based place of the mask (null without one)."""
    a = F.col(ids) if isinstance(ids, str) else ids
    kept = F.least(F.size(a), F.lit(max_len))
    fitted = fit_length(a, max_len, pad_id, truncate_head, mask_id)
    attention = F.concat(F.array_repeat(F.lit(1), kept), F.array_repeat(F.lit(0), F.lit(max_len) - kept))
    place = F.lit(None).cast("int") if mask_id is None else (F.array_position(fitted, mask_id) - 1).cast("int")
    return F.struct(fitted.alias("input_ids"), attention.alias("attention_mask"), place.alias("mask_pos"))


# F6 ---------------------------------------------------------------------------
def demo_filter(queries: DataFrame, support: DataFrame, key_col: str, vec_col: str, label_col: str,
                num_labels: int, rate: float, exclude_self: bool = False, query_rows: int = 1024,
                support_rows: int = 8192, lists: bool = False) -> DataFrame:
    """Per query: cosine similarity to every support row (self excluded when
    ``exclude_self``), descending; keep at most ``int(n // num_labels · rate)``
    per label (n = number of candidates; rows without a label are none).

    A share of the queries meets all support rows of a label in one task, where
    slices of it are compared and ranked: pairs are neither shuffled nor sorted
    outside.  The result is exact; a task holds the vectors of one label and the
    similarities of a slice (``query_rows`` x ``support_rows`` / 8 of them, or
    one query).  There are no more shares than keep the cores busy, so what is
    shuffled grows with the rows, not with the pairs.  Rows without a vector have
    no similarity.

    ``lists``: the same demonstrations as ``(query_id, label, support_ids)``, an
    array of at most ``LIST_ROWS`` and as many rows as it takes, without order
    and similarities: what a draw needs, a row for very many pairs.
    """
    support = support.where(F.col(label_col).isNotNull())
    sizes = support.groupBy(F.col(label_col).alias("label")).agg(F.count(F.lit(1)).alias("n")).collect()    # one row a label
    n_support = sum(r["n"] for r in sizes)
    n_cand = n_support - 1 if exclude_self else n_support
    limit = int(n_cand // num_labels * rate)
    cores = support.sparkSession.sparkContext.defaultParallelism
    shares = max(1, min(-(-queries.count() // query_rows), -(-4 * cores // max(1, len(sizes)))))
    kinds = {"sid": support.schema[key_col].dataType, "label": support.schema[label_col].dataType,
             "qid": queries.schema[key_col].dataType}
    shape = StructType([StructField("query_id", kinds["qid"]), StructField("support_id", kinds["sid"]),
                        StructField("label", kinds["label"]), StructField("sim", DoubleType()), StructField("rank", IntegerType())])
    if lists:
        shape = StructType([shape["query_id"], shape["label"], StructField("support_ids", ArrayType(kinds["sid"]))])
    spark = support.sparkSession
    if not sizes or limit <= 0:
        return spark.createDataFrame([], shape)
    cells = F.broadcast(spark.createDataFrame([(r["label"], i * shares) for i, r in enumerate(sizes)],
                                              StructType([StructField("label", kinds["label"]), StructField("cell", LongType())])))

    def none(c):
        return F.lit(None).cast(kinds[c]).alias(c)

    left = queries.where(F.col(vec_col).isNotNull()).select(F.col(key_col).alias("qid"), F.col(vec_col).alias("vec")).crossJoin(
        cells.select("cell")).select((F.col("cell") + F.pmod(F.xxhash64("qid"), F.lit(shares))).alias("cell"),
                                     F.lit(1).alias("kind"), none("sid"), none("label"), "qid", "vec")
    right = support.where(F.col(vec_col).isNotNull()).select(
        F.col(key_col).alias("sid"), F.col(label_col).alias("label"), F.col(vec_col).alias("vec")).join(cells, "label").select(
        F.explode(F.sequence(F.col("cell"), F.col("cell") + (shares - 1))).alias("cell"), F.lit(0).alias("kind"),
        "sid", "label", none("qid"), "vec")
    schema, entries, most = to_arrow_schema(shape), max(1, query_rows * support_rows // 8), LIST_ROWS

    def prepare(table):
        sid = table.column("sid").combine_chunks()
        return {"unit": demos.vectors_of(table.column("vec")), "sid": sid, "label": table.column("label").combine_chunks(),
                "equal": demos.same_ids(sid) if exclude_self else None}

    def merged(parts):
        """The best of several ranked lists of one query key, which may come in several rows."""
        if len(parts) == 1:
            return parts[0]
        at, sim = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        order = np.lexsort((at, -sim))[:limit]
        return at[order], sim[order]

    def emit(last):
        support_rows_of, ids, at, sim = last
        place = np.flatnonzero(sim > -np.inf)
        if lists:
            return _lists(ids, support_rows_of, np.zeros(len(place), dtype=np.int64), at[place], schema, most)
        return _pairs(ids, support_rows_of, np.zeros(len(place), dtype=np.int64), at[place], sim[place], place, schema)

    def best(batches):
        last = None                                                 # the last key so far: more of its rows may follow
        for s, asked in demos.by_cell(batches, prepare):
            n = len(s["unit"])
            step = max(1, entries // n)
            for i in range(0, len(asked), step):
                q = asked.slice(i, step)
                ids = q.column("qid")
                far = -(demos.vectors_of(q.column("vec")) @ s["unit"].T)
                if exclude_self:
                    far[s["equal"](ids)] = np.inf                   # self takes no place
                code = ids.dictionary_encode(null_encoding="encode").indices.to_numpy()
                starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
                groups = list(zip(starts, [*starts[1:], len(q)]))
                goes_on = last is not None and last[0] is s and last[1].equals(ids.slice(0, 1))
                alone = np.ones(len(q), dtype=bool)                 # rows whose key has no other row
                for a, b in groups:
                    alone[a:b] = b - a == 1 and b < len(q) and not (a == 0 and goes_on)
                ranked = np.flatnonzero(~alone) if lists else np.arange(len(q))
                # support rows come in the order of their keys: ties stay in it
                order = np.argsort(far[ranked], axis=1, kind="stable")[:, :limit]
                sim = -np.take_along_axis(far[ranked], order, 1)
                if last is not None and not goes_on:
                    yield from emit(last)
                    last = None
                for a, b in groups:
                    if alone[a]:
                        continue
                    at = np.searchsorted(ranked, a)
                    parts = [(order[j], sim[j]) for j in range(at, at + b - a)]
                    if a == 0 and goes_on:
                        parts.insert(0, last[2:])
                    last = (s, ids.slice(a, 1), *merged(parts))
                    if b < len(q):
                        yield from emit(last)
                        last = None
                if lists:
                    rows = np.flatnonzero(alone)
                    row, place = np.nonzero(_nearest(far[rows], limit))
                    yield from _lists(ids, s, rows[row], place, schema, most)
                else:
                    row, place = np.nonzero((sim > -np.inf) & alone[:, None])
                    yield from _pairs(ids, s, row, order[row, place], sim[row, place], place, schema)
        if last is not None:
            yield from emit(last)

    rows = demos.dealt(right.unionByName(left), len(sizes) * shares, ["sid", "qid"])
    return rows.mapInArrow(best, shape)


def _pairs(ids, support, row, at, sim, place, schema, most: int = 1 << 18):
    """Batches of (query, support row, label, similarity, rank)."""
    for i in range(0, len(row), most):
        j = slice(i, i + most)
        yield pa.RecordBatch.from_arrays(
            [ids.take(pa.array(row[j])), support["sid"].take(pa.array(at[j])), support["label"].take(pa.array(at[j])),
             pa.array(sim[j]), pa.array((place[j] + 1).astype(np.int32))], schema=schema)


LIST_ROWS = 1024               # demonstrations in one array


def _nearest(far: np.ndarray, limit: int) -> np.ndarray:
    """[queries, support rows] whether a row is among the ``limit`` nearest; ties go to the first."""
    far = np.where(np.isnan(far), np.inf, far)
    if not far.size or far.shape[1] <= limit:
        return far < np.inf
    border = np.partition(far, limit - 1, axis=1)[:, limit - 1:limit]
    near, tied = far < border, far == border
    room = limit - near.sum(axis=1)
    for i in np.flatnonzero(tied.sum(axis=1) > room):
        tied[i, np.flatnonzero(tied[i])[room[i]:]] = False
    return (near | tied) & (far < np.inf)


def _lists(ids, support, row, at, schema, most: int):
    """Batches of (query, label, support rows) from pairs ordered by query."""
    if not len(row):
        return
    start = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    cuts = np.concatenate([np.arange(a, b, most) for a, b in zip(start, [*start[1:], len(row)])])
    arrays = pa.ListArray.from_arrays(pa.array(np.append(cuts, len(row)).astype(np.int32)), support["sid"].take(pa.array(at)))
    labels = support["label"].take(pa.array(np.zeros(len(cuts), dtype=np.int64)))          # one label a cell
    yield pa.RecordBatch.from_arrays([ids.take(pa.array(row[cuts])), labels, arrays.cast(schema.field("support_ids").type)], schema=schema)


# F7 / F8 / F9 -------------------------------------------------------------------
def replicate(df: DataFrame, n: int, col: str = "sample") -> DataFrame:
    """Query set repeated n times (a generator, not a join)."""
    return df.withColumn(col, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def _leading_digits(digests: pa.Array) -> np.ndarray:
    """Numbers that order hex digests of 32 digits by their first eight; no digest is a Python object."""
    size = digests.offset, len(digests)
    ends = np.frombuffer(digests.buffers()[1], dtype=np.int32)[size[0]:sum(size) + 1]
    text = np.frombuffer(digests.buffers()[2], dtype=np.uint8)[ends[0]:ends[-1]]
    return text.view(">u8").reshape(size[1], 4)[:, 0].astype(np.uint64)


def _groups_of(batch, groups: Sequence[str]) -> np.ndarray:
    group = np.zeros(len(batch), dtype=np.int64)
    for c in groups:
        known = batch.column(c).dictionary_encode(null_encoding="encode")
        group = group * len(known.dictionary) + known.indices.to_numpy()
    return group


def _few(group: np.ndarray, order: np.ndarray, k: int) -> np.ndarray:
    """Places, ascending, of the rows with fewer than ``k`` smaller ones in their group."""
    at = np.lexsort((order, group))
    g, o = group[at], order[at]
    place = np.arange(len(at))
    first = np.maximum.accumulate(np.where(np.r_[True, g[1:] != g[:-1]], place, 0))
    tied = np.maximum.accumulate(np.where(np.r_[True, (g[1:] != g[:-1]) | (o[1:] != o[:-1])], place, 0))
    return np.sort(at[tied - first < k])


def _least_of_batches(context: DataFrame, groups: Sequence[str], order_col: str, k: int) -> DataFrame:
    """What may be among the ``k`` rows of least ``order_col`` (hex digests) of its group: of every
    batch the rows with fewer than ``k`` smaller ones.  The others are never shuffled nor sorted."""
    schema, groups = to_arrow_schema(context.schema), list(groups)

    def least(batches):
        for b in batches:
            if len(b):
                yield b.take(pa.array(_few(_groups_of(b, groups), _leading_digits(b.column(order_col)), k))).cast(schema)
    return context.mapInArrow(least, context.schema)


_AT_ONCE = 1 << 20             # demonstrations whose order is computed at once


def _least_of_lists(context: DataFrame, groups: Sequence[str], k: int, seed: int, query_col: str, sample_col: str,
                    support_col: str) -> DataFrame:
    """The same for lists of demonstrations: a row for each that may be among the first ``k``."""
    shape = StructType([StructField(f.name, f.dataType.elementType) if f.name == support_col else f for f in context.schema])
    schema, groups, at_once = to_arrow_schema(shape), list(groups), _AT_ONCE
    head = F.concat_ws(":", F.lit(str(int(seed))), *[F.col(c).cast("string") for c in (query_col, sample_col)])

    def least(batches):
        for b in batches:
            group, found = _groups_of(b, groups), []
            ends = np.cumsum(pc.fill_null(pc.list_value_length(b.column(support_col)), 0).to_numpy(zero_copy_only=False))
            heads = [h.encode() for h in b.column("__head").to_pylist()]
            a = 0
            while a < len(b):
                before = ends[a - 1] if a else 0
                z = max(a + 1, int(np.searchsorted(ends, before + at_once, side="right")))
                row = np.repeat(np.arange(z - a), np.diff(np.r_[before, ends[a:z]]))
                ids = b.column(support_col).slice(a, z - a).flatten()
                if len(ids):
                    order = leading_bits(heads[a:z], row, ids).astype(np.int64)
                    start = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
                    left, some = order.copy(), np.zeros(len(order), dtype=bool)
                    for _ in range(k):                              # the k least values of every list, with their ties
                        least_of = np.repeat(np.minimum.reduceat(left, start), np.diff(np.r_[start, len(row)]))
                        now = left == least_of
                        some |= now
                        left[now] = 1 << 32
                    at = np.flatnonzero(some)
                    found.append((row[at] + a, order[at], ids.take(pa.array(at))))
                a = z
            if found:
                row, order = (np.concatenate([f[i] for f in found]) for i in (0, 1))
                at = _few(group[row], order, k)
                rows, ids = b.take(pa.array(row[at])), pa.concat_arrays([f[2] for f in found]).take(pa.array(at))
                yield pa.RecordBatch.from_arrays([ids if c == support_col else rows.column(c) for c in schema.names],
                                                 names=schema.names).cast(schema)
    return context.withColumn("__head", head).mapInArrow(least, shape)


def _drawn(context: DataFrame, groups: Sequence[str], k: int, seed: int, query_col: str, sample_col: str,
           support_col: str) -> DataFrame:
    """The ``k`` rows of every group that come first in random order."""
    kind = context.schema[support_col].dataType
    if isinstance(kind, ArrayType):
        if isinstance(kind.elementType, (IntegerType, LongType, StringType)):
            context = _least_of_lists(context, groups, k, seed, query_col, sample_col, support_col)
        else:
            context = context.withColumn(support_col, F.explode(support_col))
    hashed = context.withColumn("__h", hash_key(seed, query_col, sample_col, support_col))
    w = Window.partitionBy(*groups).orderBy("__h", support_col)
    return _least_of_batches(hashed, groups, "__h", k).withColumn("__rn", F.row_number().over(w)).where(
        F.col("__rn") <= k).drop("__rn", "__h")


def sample_demo_per_label(context: DataFrame, seed: int, query_col: str = "query_id", sample_col: str = "sample",
                          label_col: str = "label", support_col: str = "support_id") -> DataFrame:
    """Random order, one demonstration per label per (query, sample).

    ``support_col`` may hold a demonstration a row or lists of them (``demo_filter``
    with ``lists``); the draws are rows in either case."""
    return _drawn(context, [query_col, sample_col, label_col], 1, seed, query_col, sample_col, support_col)


def sample_in_context(context: DataFrame, k: int, seed: int, query_col: str = "query_id",
                      sample_col: str = "sample", support_col: str = "support_id") -> DataFrame:
    """Random order, ``k`` demonstrations per (query, sample), from rows or lists."""
    return _drawn(context, [query_col, sample_col], k, seed, query_col, sample_col, support_col)


# F10 ----------------------------------------------------------------------------
def ensemble_predict(logits: DataFrame, query_col: str, logits_col: str, label_col: str | None = None,
                     regression: bool = False) -> DataFrame:
    """Mean logits over samples, argmax (regression: the mean value); labels
    must agree across the samples of a query."""
    ex = logits.select(query_col, F.posexplode(AR.to_double(logits_col)).alias("pos", "v"))
    mean = ex.groupBy(query_col, "pos").agg(F.avg("v").alias("m"))
    if regression:
        pred = mean.groupBy(query_col).agg(F.min_by("m", "pos").alias("pred"))
    else:
        pred = mean.groupBy(query_col).agg(F.max_by("pos", F.struct("m", -F.col("pos"))).alias("pred"))
    if label_col:
        lab = logits.groupBy(query_col).agg(F.min(label_col).alias("label"), F.max(label_col).alias("__mx"))
        lab = lab.withColumn("label", F.when(F.col("label") == F.col("__mx"), F.col("label"))
                             .otherwise(F.raise_error(F.lit("labels differ across samples")))).drop("__mx")
        pred = pred.join(lab, query_col)
    return pred


# F11 / F12 / F13 ------------------------------------------------------------------
def holdout(df: DataFrame, frac: float, seed: int, key_col: str) -> DataFrame:
    """Shuffle; the first n − int(n·frac) rows train, the rest validation."""
    d = df.withColumn("__h", hash_key(seed, key_col))
    d = positions(d, [], ["__h", key_col], out="__r")
    n = df.agg(F.count(F.lit(1)).alias("__n"))
    d = d.join(F.broadcast(n), how="inner")                 # one row
    n_train = F.col("__n") - F.floor(F.col("__n") * F.lit(frac))
    return d.withColumn("split", F.when(F.col("__r") < n_train, "train").otherwise("dev")).drop("__h", "__r", "__n")


def holdout_by_group(df: DataFrame, group_col: str, matched: Sequence[str], seed: int, key_col: str,
                     frac: float = 0.1) -> DataFrame:
    """In shuffled order the first ``int(n·frac)//2`` rows of the matched genres
    go to dev_matched, as many of the others to dev_mismatched, the rest train."""
    grp = F.when(F.col(group_col).isin(list(matched)), "matched").otherwise("mismatched")
    d = df.withColumn("__g", grp).withColumn("__h", hash_key(seed, key_col))
    d = positions(d, ["__g"], ["__h", key_col], out="__r")
    n = df.agg(F.count(F.lit(1)).alias("__n"))
    d = d.join(F.broadcast(n), how="inner")
    cap = F.floor(F.floor(F.col("__n") * F.lit(frac)) / 2)
    split = F.when(F.col("__r") < cap, F.concat(F.lit("dev_"), F.col("__g"))).otherwise("train")
    return d.withColumn("split", split).drop("__g", "__h", "__r", "__n")


def relabel_splits(split) -> Column:
    s = F.col(split) if isinstance(split, str) else split
    return F.when(s == "dev", "test").when(s == "test", "dev").otherwise(s)


# F14 / F15 / F16 ------------------------------------------------------------------
def exact_median(df: DataFrame, value_col: str) -> DataFrame:
    """One row ``(median)`` of the non-null values, selected by distributed rank."""
    v = df.select(F.col(value_col).cast("double").alias("__v")).where(F.col("__v").isNotNull())
    n = v.count()
    return positions(v, [], ["__v"], out="__r").where(F.col("__r").isin((n - 1) // 2, n // 2)).agg(
        F.avg("__v").alias("median"))


def binarize_by_median(df: DataFrame, label_col: str) -> DataFrame:
    med = exact_median(df, label_col).withColumnRenamed("median", "__med")
    return df.join(F.broadcast(med), how="inner").withColumn(          # one row
        label_col, (F.col(label_col) > F.col("__med")).cast("int")).drop("__med")


def likely_words(logits: DataFrame, vocab: DataFrame, label_col: str, logits_col: str, k: int) -> DataFrame:
    """Per class: mean logit per vocabulary id (ids are 0-based positions),
    only word-initial entries, top k."""
    ex = logits.select(label_col, F.posexplode(AR.to_double(logits_col)).alias("id", "v"))
    mean = ex.groupBy(label_col, "id").agg(F.avg("v").alias("mean_logit"))
    mean = mean.join(vocab.where("word_initial").select("id", "token"), "id")
    w = Window.partitionBy(label_col).orderBy(F.desc("mean_logit"), "id")
    return mean.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def neighbor_words(cands: DataFrame, seeds: DataFrame, word_vecs: DataFrame, k: int,
                   label_col: str = "label") -> DataFrame:
    """Cosine distance from each class's seed word to the candidates of that
    class, ascending; top k (all when k ≤ 0).  Candidates per class are bounded
    by F14's k, so this join is k rows per class."""
    wv = word_vecs.select("id", "vec")
    c = cands.join(wv, "id")
    s = seeds.join(wv.withColumnRenamed("id", "seed_id").withColumnRenamed("vec", "seed_vec"), "seed_id")
    j = c.join(s.select(label_col, "seed_id", "seed_vec"), label_col)
    j = j.withColumn("distance", F.greatest(F.lit(0.0), 1 - AR.cosine("vec", "seed_vec")))   # ≥ 0 up to rounding
    w = Window.partitionBy(label_col).orderBy("distance", "id")
    j = j.withColumn("nrank", F.row_number().over(w))
    return j if k <= 0 else j.where(F.col("nrank") <= k)


def search_label_words(examples: DataFrame, cands: dict, logits_col: str, label_col: str, top_n: int,
                       correlation: bool = False, exhaustive: int = 1 << 22) -> DataFrame:
    """All pairings of one candidate per class, scored by the accuracy of the
    argmax over the pairing's logits, or (``correlation``, two classes) by
    Pearson's r of the second softmax probability (an equal pair: −1); the best
    ``top_n`` (−1 = all, Q11).  Rows without logits or label are left out.

    Pairings are numbered, the last class fastest, and never listed.  The best
    few of more than ``exhaustive`` pairings are found by bounds, otherwise tiles
    of pairings are scored against blocks of rows (see ``label_search``).
    """
    classes = sorted(cands)
    words = [np.asarray(cands[c], dtype=np.int64) for c in classes]
    total = math.prod(len(w) for w in words)
    numbers = None
    if not correlation and 0 <= top_n and total > exhaustive:
        numbers = [m for _, m in label_search.best_pairings(examples, words, logits_col, label_col, top_n)]
    got = label_search.tile_sums(examples, words, logits_col, label_col, correlation, numbers=numbers)
    picks = label_search.words_of_pairing(words, F.col("pairing"))
    if correlation:
        cov = F.col("n") * F.col("xy") - F.col("x") * F.col("y")
        var = (F.col("n") * F.col("xx") - F.col("x") ** 2) * (F.col("n") * F.col("yy") - F.col("y") ** 2)
        value = F.when(picks[0] == picks[1], F.lit(-1.0)).otherwise(cov / F.sqrt(var)).alias("correlation")
        name = "correlation"
    else:
        value, name = (F.col("hits") / F.col("n")).alias("accuracy"), "accuracy"
    out = got.select("pairing", value, F.concat_ws(",", *picks).alias("words"))
    if top_n >= 0:
        out = out.orderBy(F.desc(name), "pairing").limit(top_n)            # the limit is the feature
        return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(name), "pairing")))
    return positions(out, [], [-F.col(name), F.col("pairing")], out="rank").withColumn("rank", F.col("rank") + 1)


# F17 / F18 ------------------------------------------------------------------------
def bounded_label(y, lb: float = STSB_BOUNDS[0], ub: float = STSB_BOUNDS[1]) -> Column:
    c = F.col(y) if isinstance(y, str) else y
    t = (c - lb) / (ub - lb)
    return F.array(1 - t, t)


def unbounded_label(p, lb: float = STSB_BOUNDS[0], ub: float = STSB_BOUNDS[1]) -> Column:
    c = F.col(p) if isinstance(p, str) else p
    return c * (ub - lb) + lb


def label_word_logits(logits, label_word_ids: Sequence[int]) -> Column:
    a = F.col(logits) if isinstance(logits, str) else logits
    return F.array(*[F.element_at(a, i + 1) for i in label_word_ids])
