"""Language-model dataset construction.

The subword codec of the reference is a library; here tokens are whitespace
tokens (special tokens kept whole) and ids come from a vocabulary *table*
joined in Spark.  Ragged id lists are ``array<int>`` columns.  Packing into
blocks uses a running token offset inside bounded map batches (≤ 1000 rows).
"""

from __future__ import annotations

from typing import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from veil.functions import chunks
from veil.functions import text as T
from veil.functions.ranking import positions
from veil.session import keep

IGNORE_INDEX = -100
PAD_ID = 0
MAP_BATCH = 1000   # rows per map batch of the reference's dataset.map


# L1 ---------------------------------------------------------------------------
def build_vocab(texts: DataFrame, text_col: str = "text", specials: Sequence[str] = ()) -> DataFrame:
    """``(token, id)``: ids 1.. in token order (0 is the pad id); specials first."""
    spark = texts.sparkSession
    toks = texts.select(F.explode_outer(T.tokens(text_col)).alias("token")).where(F.col("token").isNotNull()).distinct()
    if specials:
        sp = spark.createDataFrame([(s,) for s in specials], "token string")
        toks = toks.join(sp, "token", "left_anti")
        toks = toks.withColumn("__g", F.lit(1)).unionByName(
            sp.withColumn("__g", F.lit(0)).withColumn("token", F.col("token")))
        ranked = positions(toks, [], ["__g", "token"], out="__p").drop("__g")
    else:
        ranked = positions(toks, [], ["token"], out="__p")
    return ranked.select("token", (F.col("__p") + 1).cast("int").alias("id"))


TOKEN_BYTES = 24 << 20     # text of a chunk: the larger, the fewer times a token is asked for


def tokenize(df: DataFrame, vocab: DataFrame, text_col: str, key_cols: Sequence[str] = (),
             out: str = "input_ids", unk_id: int = -1, hot: int | None = None) -> DataFrame:
    """Text → ids by a vocabulary of any size; the text column is dropped (L1).

    A chunk of texts asks for its distinct tokens once (``functions/chunks.py``);
    tokens neither travel once a place nor go to one task because they are
    frequent, and keys may be null or repeated (``key_cols`` and ``hot`` are not
    needed).  A null or empty text has no ids.
    """
    rows = chunks.dealt(df.withColumn(text_col, F.col(text_col).cast("string")), [text_col],
                        chunk_bytes=TOKEN_BYTES)
    shape = StructType([f for f in df.schema if f.name != text_col] + [StructField(out, ArrayType(IntegerType()))])
    schema = to_arrow_schema(shape)

    def tokens_of(table):
        return (t.split() if t else [] for t in table.column(text_col).to_pylist())

    def ask(table: pa.Table) -> pa.Table:
        words, _, _ = chunks.coded(tokens_of(table))
        n = len(words)
        return pa.table({chunks.CHUNK: pa.array(np.full(n, table.column(chunks.CHUNK)[0].as_py(), dtype=np.int64)),
                         "id": pa.array(np.arange(n)), "w0": words})

    def look_up(asked):
        known = vocab.select(F.col("token").alias("w0"), F.coalesce(F.col("id").cast("int"), F.lit(unk_id)).alias("n"))
        return asked.join(known, "w0").select(chunks.CHUNK, "id", "n")

    def finish(table: pa.Table, answers: pa.Table) -> pa.Table:
        words, codes, sizes = chunks.coded(tokens_of(table))
        ids = np.full(len(words), unk_id, dtype=np.int32)
        ids[answers.column("id").to_numpy()] = answers.column("n").to_numpy()
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(ids[codes]))
        return table.drop_columns([chunks.CHUNK, text_col]).append_column(out, lists).select(schema.names).cast(schema)

    return chunks.looked_up(rows, ask, f"{chunks.CHUNK} long, id long, w0 string", look_up, finish, shape)


# L2 ---------------------------------------------------------------------------
def pack_blocks(df: DataFrame, ids_col: str, order_col: str, block: int,
                map_batch: int = MAP_BATCH) -> DataFrame:
    """Within each map batch of ``map_batch`` rows (in ``order_col`` order)
    concatenate ids, drop the remainder, cut blocks; ``labels = input_ids``.

    Range partitions hold the rows in order.  Of each a task needs to know the
    number of its first row and, of each map batch, the ids before and in all
    (a row a partition and a row a map batch).  It then cuts its rows where they
    are; only blocks over the ends of what it sees at once are put together.
    """
    # the bounds are sampled per execution: one materialisation for all passes (see ``ranking``)
    ranged = keep(df.select(F.col(order_col).alias("__o"), F.col(ids_col).alias("ids")).repartitionByRange("__o")
                  .sortWithinPartitions("__o").select("ids", F.spark_partition_id().alias("pid")))
    rows = sorted(ranged.groupBy("pid").agg(F.count(F.lit(1)).alias("n")).collect())
    first = dict(zip([r["pid"] for r in rows], np.cumsum([0] + [r["n"] for r in rows]).tolist()))

    def batches_of(batches):
        """(partition, map batch, ids) in order."""
        row = None
        for batch in batches:
            if not len(batch):
                continue
            pid = batch.column("pid")[0].as_py()
            row = first[pid] if row is None else row
            ids = batch.column("ids")
            start = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False))])
            values, number = ids.flatten(), (row + np.arange(len(ids))) // map_batch
            cuts = [0, *(np.flatnonzero(np.diff(number)) + 1), len(ids)]
            for a, b in zip(cuts, cuts[1:]):
                yield pid, int(number[a]), values.slice(start[a], start[b] - start[a])
            row += len(batch)

    def sums(batches):
        for pid, number, ids in batches_of(batches):
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([pid], pa.int32()), pa.array([len(ids)])],
                                             names=["map_batch", "pid", "n"])

    before, total = {}, {}
    for r in sorted(ranged.mapInArrow(sums, "map_batch long, pid int, n long").groupBy("map_batch", "pid").agg(
            F.sum("n").alias("n")).collect()):
        before[r["pid"], r["map_batch"]] = total.get(r["map_batch"], 0)
        total[r["map_batch"]] = total.get(r["map_batch"], 0) + r["n"]
    shape = StructType([StructField("map_batch", LongType()), StructField("block", LongType()), StructField("start", LongType()),
                        StructField("ids", ranged.schema["ids"].dataType)])
    schema = to_arrow_schema(shape)

    def cut(batches):
        now, end = None, 0
        for pid, number, ids in batches_of(batches):
            off = end if number == now else before[pid, number]
            now, end = number, off + len(ids)
            stop = min(end, total[number] // block * block)
            if off >= stop:
                continue
            edges = np.concatenate([[off], np.arange((off // block + 1) * block, stop, block), [stop]])
            lists = pa.ListArray.from_arrays(pa.array((edges - off).astype(np.int32)), ids.slice(0, stop - off))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(lists), number)), pa.array(edges[:-1] // block), pa.array(edges[:-1]),
                 lists.cast(schema.field("ids").type)], schema=schema)

    parts = ranged.mapInArrow(cut, shape)
    whole = parts.where(F.size("ids") == block).select("map_batch", "block", "ids")
    ends = parts.where(F.size("ids") < block).groupBy("map_batch", "block").agg(
        F.array_sort(F.collect_list(F.struct("start", "ids"))).alias("s")).select(
        "map_batch", "block", F.flatten(F.transform("s", lambda s: s["ids"])).alias("ids"))
    return whole.unionByName(ends).select("map_batch", "block", F.col("ids").alias("input_ids"), F.col("ids").alias("labels"))


# L3 ---------------------------------------------------------------------------
def drop_blank_lines(df: DataFrame, col: str = "value") -> DataFrame:
    return df.where((F.length(col) > 0) & F.col(col).rlike(r"\S"))


# S9 / L4 ------------------------------------------------------------------------
def split_src_tgt(df: DataFrame, col: str = "value") -> DataFrame:
    """Lines ``src||tgt``; lines without exactly one ``||`` are dropped."""
    parts = F.split(F.col(col), r"\|\|")
    d = drop_blank_lines(df, col).withColumn("__p", parts).where(F.size("__p") == 2)
    return d.withColumn("src", F.col("__p")[0]).withColumn("tgt", F.col("__p")[1]).drop("__p")


def format_src_tgt(src="src", tgt="tgt", bos: str = "<|endoftext|>", eos: str = "<|endoftext|>",
                   trailing_space: bool = False) -> Column:
    """``" {src} {bos} {tgt} {eos}"`` (DART adds a trailing space)."""
    s = F.col(src) if isinstance(src, str) else src
    t = F.col(tgt) if isinstance(tgt, str) else tgt
    return F.concat(F.lit(" "), s, F.lit(f" {bos} "), t, F.lit(f" {eos}" + (" " if trailing_space else "")))


# L5 / L6 ------------------------------------------------------------------------
def length_filter_then_cap(df: DataFrame, text_col: str, order_col: str, max_len: int, n: int) -> DataFrame:
    """E2E: filter on token count first, keep the first n after."""
    d = df.where(F.size(T.tokens(text_col)) <= max_len)
    return cap(d, order_col, n)


def cap_then_length_filter(df: DataFrame, text_col: str, order_col: str, max_len: int, n: int) -> DataFrame:
    """DART: keep the first n first, filter after (can end below n)."""
    return cap(df, order_col, n).where(F.size(T.tokens(text_col)) <= max_len)


def cap(df: DataFrame, order_col: str, n: int, group_cols: Sequence[str] = ()) -> DataFrame:
    """First n rows (per group) in order: without groups a top-n that keeps n
    rows per task, with groups a distributed rank, whatever n is."""
    if not group_cols:
        return df.orderBy(order_col).limit(n)                   # the limit is the feature
    return positions(df, group_cols, [order_col], out="__rn").where(F.col("__rn") < n).drop("__rn")


# L7 / L8 / L9 --------------------------------------------------------------------
def truncate(ids, block: int) -> Column:
    return F.slice(F.col(ids) if isinstance(ids, str) else ids, 1, block)


def mask_source_labels(ids, sep_id) -> Column:
    """Labels up to and including the first separator are −100; no separator is an error."""
    a = F.col(ids) if isinstance(ids, str) else ids
    p = F.array_position(a, sep_id)
    checked = F.when(p > 0, p).otherwise(F.raise_error(F.lit("separator not found")))
    return F.transform(a, lambda x, i: F.when(i < checked, F.lit(IGNORE_INDEX)).otherwise(x))


def split_at_separator(ids, sep_id) -> tuple[Column, Column]:
    a = F.col(ids) if isinstance(ids, str) else ids
    p = F.array_position(a, sep_id).cast("int")
    src = F.slice(a, 1, F.greatest(p - 1, F.lit(0)))
    tgt = F.slice(a, F.greatest(p, F.lit(1)), F.size(a))
    return src, tgt


# L10 ----------------------------------------------------------------------------
def category_words(src) -> Column:
    s = F.col(src) if isinstance(src, str) else src
    return F.transform(F.split(s, r"\|"), lambda la: T.py_strip(F.split(la, ":")[0]))


# L11 ----------------------------------------------------------------------------
def length_stats(df: DataFrame, src_ids: str = "src_ids", tgt_ids: str = "tgt_ids") -> DataFrame:
    return df.agg(F.avg(F.size(tgt_ids)).alias("tgt_avg"), F.avg(F.size(src_ids)).alias("src_avg"),
                  (F.sum(F.size(src_ids)) / F.sum(F.size(tgt_ids))).alias("ratio"))


# L12 / L13 ------------------------------------------------------------------------
def linearize_webnlg(entries: DataFrame, bos: str = "<|endoftext|>", eos: str = "<|endoftext|>") -> DataFrame:
    """entries(entry_id, lexicalisations array<struct<comment,lex>>,
    modifiedtripleset array<struct<subject,property,object>>) → one row per good lex."""
    src = F.array_join(F.transform("modifiedtripleset", lambda t: F.concat_ws(
        " : ", t["subject"], t["property"], t["object"])), " | ")
    rela = F.transform("modifiedtripleset", lambda t: t["property"])
    d = entries.select("entry_id", src.alias("src"), rela.alias("relations"),
                       F.posexplode("lexicalisations").alias("lex_idx", "lx"))
    d = d.where(F.col("lx.comment") == "good")
    return d.select("entry_id", "lex_idx", "src", F.col("lx.lex").alias("tgt"), "relations",
                    format_src_tgt("src", F.col("lx.lex"), bos, eos).alias("sent"))


def linearize_dart(examples: DataFrame, bos: str = "<|endoftext|>", eos: str = "<|endoftext|>") -> DataFrame:
    """examples(example_id, tripleset array<array<string>>, annotations array<struct<text>>)."""
    src = F.array_join(F.transform("tripleset", lambda t: F.concat_ws(
        " : ", t[0], F.lower(t[1]), t[2])), " | ")
    rela = F.transform("tripleset", lambda t: F.lower(t[1]))
    d = examples.select("example_id", src.alias("src"), rela.alias("relations"),
                        F.posexplode("annotations").alias("ann_idx", "a"))
    return d.select("example_id", "ann_idx", "src", F.col("a.text").alias("tgt"), "relations",
                    format_src_tgt("src", F.col("a.text"), bos, eos, trailing_space=True).alias("sent"))


# L14 ----------------------------------------------------------------------------
# mode: columns for input, labels, source and (or None) category
PAD_COLUMNS = {
    "peek": ("input_ids", "labels", "src_ids", None),
    "nopeek": ("tgt_ids", "tgt_ids", "src_ids", None),
    "cat": ("input_ids", "labels", "cat_ids", None),
    "infix": ("tgt_ids", "tgt_ids", "src_ids", "cat_ids"),
}


def pad_batch(df: DataFrame, batch_col: str, mode: str = "peek", pad_id: int = PAD_ID) -> DataFrame:
    """Right-pad each batch to its longest row, with the columns that
    ``PAD_COLUMNS`` lists for the mode."""
    x, y, s, c = PAD_COLUMNS[mode]
    w = Window.partitionBy(batch_col)                       # ≤ batch-size rows per group

    def padded(col):
        m = F.max(F.size(col)).over(w)
        return F.concat(F.col(col), F.array_repeat(F.lit(pad_id), m - F.size(col)))
    out = df.select("*", padded(x).alias("b_input_ids"), padded(y).alias("__lab"), padded(s).alias("b_src"),
                    *([padded(c).alias("b_cate")] if c else []))
    out = (out.withColumn("b_labels", F.transform("__lab", lambda v: F.when(v == pad_id, F.lit(IGNORE_INDEX))
                                                  .otherwise(v)))
           .withColumn("src_attn", F.transform("b_src", lambda v: v != pad_id))
           .withColumn("tgt_attn", F.transform("b_input_ids", lambda v: v != pad_id)))
    if c:
        out = out.withColumn("cate_attn", F.transform("b_cate", lambda v: v != pad_id))
    return out.drop("__lab")


# L15 ----------------------------------------------------------------------------
def mlm_mask(ids, seed: int, key, special_ids: Sequence[int], mask_id: int, vocab_size: int,
             p: float = 0.15, pad_id: int = PAD_ID) -> tuple[Column, Column]:
    """Masked-LM corruption: selected non-special, non-pad tokens → 80 % mask,
    10 % random id, 10 % kept; labels −100 elsewhere.  Draws are seeded
    hashes of (seed, key, position) so they do not depend on partitioning."""
    a = F.col(ids) if isinstance(ids, str) else ids
    k = F.col(key) if isinstance(key, str) else key
    sp = F.array(*[F.lit(int(s)) for s in list(special_ids) + [pad_id]])

    def u(tag, i):
        return (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(tag), k.cast("string"),
                                                     i.cast("string"))), 1, 13), 16, 10).cast("double")
                / float(1 << 52))
    sel = F.transform(a, lambda x, i: (u("s", i) < p) & ~F.array_contains(sp, x))
    labels = F.zip_with(a, sel, lambda x, s: F.when(s, x).otherwise(F.lit(IGNORE_INDEX)))

    def corrupt(x, i):
        r = u("r", i)
        rnd = (F.floor(u("v", i) * vocab_size) + 1).cast("int")
        return F.when(r < 0.8, F.lit(mask_id)).when(r < 0.9, rnd).otherwise(x)
    inputs = F.transform(a, lambda x, i: F.when((u("s", i) < p) & ~F.array_contains(sp, x), corrupt(x, i))
                         .otherwise(x))
    return inputs, labels


# L16 ----------------------------------------------------------------------------
def prompt_from_labels(ids, labels) -> Column:
    """ids before the first label that is not −100."""
    a = F.col(ids) if isinstance(ids, str) else ids
    lab = F.col(labels) if isinstance(labels, str) else labels
    first = F.array_position(F.transform(lab, lambda v: v != IGNORE_INDEX), True).cast("int")
    return F.when(first > 0, F.slice(a, 1, F.greatest(first - 1, F.lit(0)))).otherwise(a)


def reference_ids(ids, pad_id: int = PAD_ID) -> Column:
    """ids before the first pad."""
    a = F.col(ids) if isinstance(ids, str) else ids
    p = F.array_position(a, pad_id).cast("int")
    return F.when(p > 0, F.slice(a, 1, F.greatest(p - 1, F.lit(0)))).otherwise(a)


# L17 ----------------------------------------------------------------------------
def cap_generations(df: DataFrame, split_col: str, order_col: str, limits: dict) -> DataFrame:
    """Separate caps for train / valid / eval generations."""
    lim = F.create_map(*[F.lit(x) for kv in limits.items() for x in kv])
    # per-split positions without sending a split to one task
    d = positions(df, [split_col], [order_col], out="__rn")
    return d.where(F.col("__rn") < F.coalesce(F.element_at(lim, F.col(split_col)), F.lit(0))).drop("__rn")
