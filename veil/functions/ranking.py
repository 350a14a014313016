"""Exact positions inside large groups without putting a group in one task.

``Window.partitionBy(g).orderBy(o)`` sends a whole group to one task.  When a
group may hold a third of all rows (a domain, a label, a split), positions are
computed instead from a range-partitioned, locally sorted copy:

1. ``repartitionByRange(g, o)`` spreads every group over as many partitions as
   its size needs, in global order;
2. ``monotonically_increasing_id`` gives (partition id, local index);
3. a tiny table of per-(group, partition) counts — at most
   ``#partitions + #groups`` rows — yields each partition's offset inside its
   group by a running sum;
4. position = offset + local index − first local index of the group in the
   partition.

Deterministic as long as the order key is a total order (always append a
unique tie-breaker).
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veil.session import keep

_LOW_BITS = (1 << 33) - 1


def hash_key(seed: int, *cols) -> Column:
    """Reproducible pseudo-random order key: ``md5('<seed>:<k1>:<k2>…')``.

    md5 is spelled the same in every SQL engine, so shuffles and draws made
    with it can be checked by an independent oracle (not numpy's stream).
    """
    parts = [F.lit(str(int(seed)))] + [(F.col(c) if isinstance(c, str) else c).cast("string")
                                       for c in cols]
    return F.md5(F.concat_ws(":", *parts))


def hash_uniform(seed: int, *cols) -> Column:
    """Uniform in [0, 1) from the first 52 bits of ``hash_key``."""
    h = hash_key(seed, *cols)
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / float(1 << 52)


def null_safe_join(left: DataFrame, right: DataFrame, cols: Sequence[str], how: str = "inner",
                   broadcast: bool = False) -> DataFrame:
    """Join on ``cols`` where null equals null; the columns of ``left`` stay, then the others of ``right``."""
    cols = list(cols)
    if not cols:
        return left.join(F.broadcast(right), how="inner") if how in ("inner", "left") else left.join(right, how=how)
    renamed = right.select(*[F.col(c).alias(f"__r{i}") for i, c in enumerate(cols)],
                           *[c for c in right.columns if c not in cols])
    on = F.lit(True)
    for i, c in enumerate(cols):
        on = on & left[c].eqNullSafe(renamed[f"__r{i}"])
    out = left.join(F.broadcast(renamed) if broadcast else renamed, on, how)
    return out.drop(*[f"__r{i}" for i in range(len(cols))])


def _ranged(df: DataFrame, num_partitions: int | None, cols: Sequence) -> DataFrame:
    """Range partitions; without an explicit number AQE sizes them by their bytes."""
    return df.repartitionByRange(num_partitions, *cols) if num_partitions else df.repartitionByRange(*cols)


def positions(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence, out: str = "pos",
              num_partitions: int | None = None) -> DataFrame:
    """Add ``out`` = 0-based position of each row inside its group, in order.

    ``order_cols`` must make the order total inside a group.
    """
    group_cols = list(group_cols)
    ocols = [F.col(c) if isinstance(c, str) else c for c in order_cols]
    keyed = df.select("*", *[o.alias(f"__o{i}") for i, o in enumerate(ocols)])
    okeys = [f"__o{i}" for i in range(len(ocols))]
    ranged = (_ranged(keyed, num_partitions, [*group_cols, *okeys])
              .sortWithinPartitions(*group_cols, *okeys)
              .withColumn("__mid", F.monotonically_increasing_id()))
    ranged = (ranged.withColumn("__pid", F.shiftright("__mid", 33))
              .withColumn("__li", F.col("__mid").bitwiseAND(F.lit(_LOW_BITS))))
    # The range bounds are sampled per execution; the counts and the rows must
    # come from ONE execution, so the ranged copy is persisted (memory, then
    # disk).  A lost block is recomputed from the same shuffle dependency and
    # hence the same bounds.
    ranged = keep(ranged)
    counts = (ranged.groupBy(*group_cols, "__pid")
              .agg(F.count(F.lit(1)).alias("__n"), F.min("__li").alias("__first")))
    w = Window.partitionBy(*group_cols).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__off", F.coalesce(F.sum("__n").over(w), F.lit(0)))
    # counts has at most (#partitions + #groups) rows: without groups one a
    # partition, which every task may hold (else the rows would be shuffled again
    # before AQE knows); with groups AQE decides at run time.
    res = null_safe_join(ranged, counts.drop("__n"), [*group_cols, "__pid"], broadcast=not group_cols)
    res = res.withColumn(out, (F.col("__off") + F.col("__li") - F.col("__first")).cast("long"))
    return res.drop("__mid", "__pid", "__li", "__first", "__off", *okeys)


def group_sizes(df: DataFrame, group_cols: Sequence[str], out: str = "n") -> DataFrame:
    return df.groupBy(*group_cols).agg(F.count(F.lit(1)).alias(out))


def running_sum(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence, value_col: str,
                out_sum: str = "running_sum", out_n: str = "running_n",
                num_partitions: int | None = None) -> DataFrame:
    """Running sum and count inside each group, in order, without sending a
    group to one task: local running sums per (group, range partition), plus
    the totals of the earlier partitions of the group (a table of at most
    #partitions + #groups rows).  ``order_cols`` must be a total order."""
    group_cols = list(group_cols)
    ocols = [F.col(c) if isinstance(c, str) else c for c in order_cols]
    okeys = [f"__o{i}" for i in range(len(ocols))]
    d = df.select("*", *[o.alias(k) for o, k in zip(ocols, okeys)])
    d = keep(_ranged(d, num_partitions, [*group_cols, *okeys])
             .withColumn("__pid", F.spark_partition_id()))      # one materialisation for both uses
    w = Window.partitionBy(*group_cols, "__pid").orderBy(*okeys).rowsBetween(Window.unboundedPreceding, 0)
    local = (d.withColumn("__cs", F.sum(value_col).over(w))
             .withColumn("__cn", F.count(F.lit(1)).over(w)))
    tot = d.groupBy(*group_cols, "__pid").agg(F.sum(value_col).alias("__ps"), F.count(F.lit(1)).alias("__pn"))
    wo = Window.partitionBy(*group_cols).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = tot.select(*group_cols, "__pid", F.coalesce(F.sum("__ps").over(wo), F.lit(0)).alias("__os"),
                      F.coalesce(F.sum("__pn").over(wo), F.lit(0)).alias("__on"))
    res = null_safe_join(local, offs, [*group_cols, "__pid"])
    res = (res.withColumn(out_sum, F.col("__os") + F.col("__cs"))
           .withColumn(out_n, (F.col("__on") + F.col("__cn")).cast("long")))
    return res.drop("__pid", "__cs", "__cn", "__os", "__on", *okeys)
