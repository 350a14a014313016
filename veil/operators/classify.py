"""Domain-classifier data and evaluation."""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veil.functions import arrays as AR
from veil.functions.ranking import hash_key, hash_uniform, null_safe_join, positions


# C1 ---------------------------------------------------------------------------
def label_union(parts: Mapping[str, DataFrame], label_col: str = "label") -> DataFrame:
    """Per-domain text tables stacked with their label (unionByName)."""
    out = None
    for label, df in parts.items():
        d = df.withColumn(label_col, F.lit(label))
        out = d if out is None else out.unionByName(d)
    return out


# C2 ---------------------------------------------------------------------------
def random_span(text, key, seed: int, max_start: int = 20, min_end: int = 20) -> Column:
    """low ∈ [0, max_start]; high ∈ [h, max(len, h+1)) with h = max(low+1, min_end);
    ``text[low:high]`` — draws are seeded hashes of the row key."""
    t = F.col(text) if isinstance(text, str) else text
    low = F.floor(hash_uniform(seed, F.lit("lo"), key) * (max_start + 1)).cast("int")
    h = F.greatest(low + 1, F.lit(min_end))
    span = F.greatest(F.length(t), h + 1) - h
    high = (h + F.floor(hash_uniform(seed, F.lit("hi"), key) * span)).cast("int")
    return F.substr(t, low + 1, F.greatest(high - low, F.lit(0)))


# C3 ---------------------------------------------------------------------------
def stratified_split(df: DataFrame, label_col: str, key_col: str, seed: int = 0,
                     test_frac: float = 0.1, valid_frac_of_rest: float = 1 / 9) -> DataFrame:
    """Per label: the first ceil(test_frac·n) rows in hash order are test, the
    next ceil(valid_frac·(n − test)) validation, the rest train (≈ 80/10/10)."""
    d = df.withColumn("__h", hash_key(seed, key_col))
    d = positions(d, [label_col], ["__h", key_col], out="__r")
    n = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("__n"))
    d = null_safe_join(d, n, [label_col])
    n_test = F.ceil(F.col("__n") * F.lit(test_frac))
    n_valid = F.ceil((F.col("__n") - n_test) * F.lit(valid_frac_of_rest))
    split = F.when(F.col("__r") < n_test, "test").when(F.col("__r") < n_test + n_valid, "valid").otherwise("train")
    return d.withColumn("split", split).drop("__h", "__r", "__n")


# C4 ---------------------------------------------------------------------------
def label_index(df: DataFrame, label_col: str = "label", out: str = "label_id") -> DataFrame:
    """Sorted distinct labels → 0..k−1 (the label set is small: broadcast);
    the label −1 passes through."""
    labels = df.select(label_col).where(F.col(label_col).cast("string") != "-1").distinct()
    idx = positions(labels, [], [label_col], out=out)
    res = df.join(idx, label_col, "left")
    return res.withColumn(out, F.when(F.col(label_col).cast("string") == "-1", F.lit(-1))
                          .otherwise(F.col(out)).cast("int"))


# C5 ---------------------------------------------------------------------------
def cap(df: DataFrame, n: int, order_col: str) -> DataFrame:
    """First min(n, len) rows in an explicit order (the limit is the feature)."""
    return df.orderBy(order_col).limit(n)


# C6 / C7 / C8 ---------------------------------------------------------------------
def argmax_label(scores) -> Column:
    return AR.argmax(scores)


def accuracy(df: DataFrame, pred_col: str, label_col: str, group_cols: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*group_cols).agg(F.avg((F.col(pred_col) == F.col(label_col)).cast("double")).alias("accuracy"))


def confusion_matrix(df: DataFrame, pred_col: str, label_col: str) -> DataFrame:
    """Row-normalised (normalize='true') long confusion matrix (y, p, rate)."""
    c = df.groupBy(F.col(label_col).alias("y"), F.col(pred_col).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    tot = c.groupBy("y").agg(F.sum("n").alias("__t"))
    return null_safe_join(c, tot, ["y"]).select("y", "p", (F.col("n") / F.col("__t")).alias("rate"))
