"""Per-example gradient norms of a linear layer from its factors.

The gradient of an example is ``G = Σ_t b_t a_tᵀ`` over its positions t, with
activations a (size p) and back-propagated b (size d).  Three forms of ‖G‖:

* product: one position, ‖a‖·‖b‖, a narrow expression;
* Gram: ``√Σ_{t,t'} (a_t·a_t')(b_t·b_t')``, 2t² numbers instead of p·d, so the
  gradient is never formed;
* direct: G itself, p·d numbers whatever t is, in chunks of positions whose
  partial gradients are added up.

``factor_norms`` takes for each example the form that holds fewer numbers
(2t² < p·d: Gram), so what a task holds of one example is bounded by the layer,
not by the length of the sequence.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veil.functions import arrays as AR
from veil.functions.ranking import null_safe_join

_ROWS = 256                     # positions of a Gram block


def _norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def product_norms(df: DataFrame, key_col: str, a_col: str, b_col: str) -> DataFrame:
    """‖a‖·‖b‖ of every row (an example of one position): no shuffle."""
    return df.select(key_col, (_norm(AR.to_double(a_col)) * _norm(AR.to_double(b_col))).alias("weight_norm"))


def _matrices(batch: pa.RecordBatch, col: int) -> list[np.ndarray]:
    """The lists of equal-sized vectors of a column as matrices."""
    lists = batch.column(col)
    inner = lists.flatten()
    sizes = np.diff(lists.offsets.to_numpy())
    flat = inner.flatten().to_numpy(zero_copy_only=False)
    wide = len(flat) // max(len(inner), 1)
    ends = np.cumsum(sizes)
    return [flat[(e - n) * wide:e * wide].reshape(n, wide) for n, e in zip(sizes, ends)]


def _gram(a: np.ndarray, b: np.ndarray) -> float:
    total = 0.0
    for lo in range(0, len(a), _ROWS):
        rows = slice(lo, lo + _ROWS)
        total += float(((a[rows] @ a.T) * (b[rows] @ b.T)).sum())
    return float(np.sqrt(max(total, 0.0)))


def _gathered(df: DataFrame, keys: list[str]) -> DataFrame:
    """(g, a, b): the positions of each group as two lists of vectors in the same order."""
    return df.groupBy(*keys).agg(F.collect_list(F.struct("__a", "__b")).alias("__x")).select(
        F.struct(*keys).alias("g"), F.transform("__x", lambda x: x["__a"]).alias("a"),
        F.transform("__x", lambda x: x["__b"]).alias("b"))


def _factors(df: DataFrame, key_col: str, a_col: str, b_col: str, pos_col: str | None) -> DataFrame:
    """(key, __pos, __a, __b) of the rows that have both factors."""
    place = F.col(pos_col).cast("long") if pos_col else F.xxhash64(a_col, b_col)
    return df.where(F.col(a_col).isNotNull() & F.col(b_col).isNotNull()).select(
        F.col(key_col).alias(key_col), place.alias("__pos"), AR.to_double(a_col).alias("__a"),
        AR.to_double(b_col).alias("__b"))


def _gram_norms(d: DataFrame, key_col: str) -> DataFrame:
    grouped = _gathered(d, [key_col])
    kind = grouped.schema["g"].dataType.simpleString()

    def norms(batches):
        for batch in batches:
            for k in range(batch.num_rows):            # a row holds fewer numbers than the layer
                one = batch.slice(k, 1)
                a, b = _matrices(one, 1)[0], _matrices(one, 2)[0]
                yield pa.RecordBatch.from_arrays([one.column(0), pa.array([_gram(a, b)])], ["g", "weight_norm"])

    return grouped.mapInArrow(norms, f"g {kind}, weight_norm double").select(F.col("g")[key_col].alias(key_col), "weight_norm")


def _direct_norms(d: DataFrame, key_col: str, chunk: int) -> DataFrame:
    """Partial gradients of ``chunk`` positions each, added cell by cell."""
    chunked = d.withColumn("__c", F.floor(F.col("__pos") / chunk) if chunk else F.lit(0))
    grouped = _gathered(chunked, [key_col, "__c"])
    kind = grouped.schema["g"].dataType.simpleString()

    def partial(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                a, b = _matrices(one, 1)[0], _matrices(one, 2)[0]
                yield pa.RecordBatch.from_arrays([one.column(0), pa.array([(b.T @ a).ravel()])], ["g", "cells"])

    cells = grouped.mapInArrow(partial, f"g {kind}, cells array<double>").select(
        F.col("g")[key_col].alias(key_col), F.posexplode("cells").alias("__cell", "__x"))
    sums = cells.groupBy(key_col, "__cell").agg(F.sum("__x").alias("__s"))
    return sums.groupBy(key_col).agg(F.sqrt(F.sum(F.col("__s") * F.col("__s"))).alias("weight_norm"))


def factor_norms(df: DataFrame, key_col: str, a_col: str, b_col: str, form: str = "auto",
                 pos_col: str | None = None) -> DataFrame:
    """(key, weight_norm) per example; ``form`` is auto, gram or direct.

    One row of ``df`` is one position.  ``pos_col`` (0, 1, …) tells the
    positions apart; without it a hash of the factors deals them to chunks.
    Rows without a or b are left out; a null key is an example of its own.
    ``gram`` for all examples holds t·(p + d) numbers of the longest one.
    """
    if form not in ("auto", "gram", "direct"):
        raise ValueError(f"unknown form: {form!r}")
    d = _factors(df, key_col, a_col, b_col, pos_col)
    size = d.agg(F.max(F.size("__a")).alias("p"), F.max(F.size("__b")).alias("d")).first()
    p, wide = size.p or 0, size.d or 0
    # a chunk's partial gradient is no larger than the positions that it comes from
    chunk = max(1, -(-p * wide // max(p + wide, 1)))
    if not pos_col:
        n = F.greatest(F.lit(1), F.ceil(F.col("__t") / chunk))
    if form == "gram":
        return _gram_norms(d, key_col)
    sizes = d.groupBy(key_col).agg(F.count(F.lit(1)).alias("__t"))
    d = null_safe_join(d, sizes, [key_col])
    if not pos_col:                                        # the hash modulo the number of chunks, as a chunk's place
        d = d.withColumn("__pos", F.pmod(F.col("__pos"), n) * chunk)
    if form == "direct":
        return _direct_norms(d, key_col, chunk)
    small = 2 * F.col("__t") * F.col("__t") < F.lit(p * wide)
    return _gram_norms(d.where(small), key_col).unionByName(_direct_norms(d.where(~small), key_col, chunk))
