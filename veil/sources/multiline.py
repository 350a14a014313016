"""Records that go over several lines, read by many tasks from one file.

A splittable scan gives lines, not records: whether a line begins a record
depends on all quotes before it.  Each block of a file (one split of the scan)
is summed up as what it does to that state, the sums are composed by a prefix
pass over the blocks of a file, and every line then knows its record.  Only
records that do go over several lines are put together in a shuffle.

The state is the parity of the quotes so far (a doubled quote inside a field
leaves it as it was).  For both possible parities at its beginning a block
says how many records begin in it; the true parity and the records before a
block are running sums over its predecessors.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(file, blk, mid, value): lines as the scan's splits give them; only ``\\n`` ends a line."""
    return spark.read.option("lineSep", "\n").text(list(paths)).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("blk"),
        F.monotonically_increasing_id().alias("mid"), "value")


def _quotes(value: Column) -> Column:
    return F.length(value) - F.length(F.replace(value, F.lit('"'), F.lit("")))


def _is_blank(value: Column) -> Column:
    return (value == "") | (value == "\r")


def _with_parity(lines: DataFrame) -> DataFrame:
    """``p``: parity of the quotes before the line inside its block."""
    w = Window.partitionBy("file", "blk").orderBy("mid").rowsBetween(Window.unboundedPreceding, -1)
    return lines.withColumn("p", F.coalesce(F.sum("q").over(w), F.lit(0)) % 2)


def block_states(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(file, blk, parity, before): quote parity at each block's beginning and records begun before it.

    One row per split of the scan; quotes and blanks are all that is shuffled.
    """
    bits = _lines(spark, paths).select("file", "blk", "mid", (_quotes(F.col("value")) % 2).alias("q"),
                                       _is_blank(F.col("value")).alias("blank"))
    blocks = _with_parity(bits).groupBy("file", "blk").agg(
        (F.sum("q") % 2).alias("turns"),
        *[F.count_if((F.col("p") == s) & ~F.col("blank")).alias(f"begun{s}") for s in (0, 1)])
    w = Window.partitionBy("file").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("parity", F.coalesce(F.sum("turns").over(w), F.lit(0)) % 2)
    # a line begins a record where the parity before it is even, so by the block's own parity
    begun = F.when(F.col("parity") == 0, F.col("begun0")).otherwise(F.col("begun1"))
    return blocks.withColumn("begun", begun).select(
        "file", "blk", "parity", F.coalesce(F.sum("begun").over(w), F.lit(0)).alias("before"))


def csv_records(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(file, record_no, record): the records of quoted files, numbered from 1 in each file.

    Empty lines between records are no records.  A record is held whole by a
    task; an opening quote without its end makes the rest of the file one record.
    """
    lines = _lines(spark, paths).withColumn("q", _quotes(F.col("value")) % 2)
    d = _with_parity(lines).join(block_states(spark, paths), ["file", "blk"])
    odd = (F.col("p") + F.col("parity")) % 2 == 1                  # inside a quoted field
    d = d.withColumn("inside", odd).where(F.col("inside") | ~_is_blank(F.col("value")))
    w = Window.partitionBy("file", "blk").orderBy("mid")
    d = d.withColumn("record_no", F.col("before") + F.count_if(~F.col("inside")).over(
        w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    whole = ~F.col("inside") & (F.col("q") % 2 == 0)               # begins and ends on this line
    single = d.where(whole).select("file", "record_no", F.col("value").alias("record"))
    several = d.where(~whole).groupBy("file", "record_no").agg(
        F.sort_array(F.collect_list(F.struct("blk", "mid", "value"))).alias("parts")).select(
        "file", "record_no", F.array_join(F.transform("parts", lambda x: x["value"]), "\n").alias("record"))
    return single.unionByName(several).withColumn("record", F.regexp_replace("record", "\r$", ""))


def read_csv(spark: SparkSession, paths: Sequence[str], schema: T.StructType) -> DataFrame:
    """(file, record_no, columns of ``schema``) of quoted CSV files with a header line.

    Fields may hold line breaks, separators and doubled quotes; a file of any
    size is read by as many tasks as the scan has splits.
    """
    rows = csv_records(spark, paths).where("record_no > 1")
    parsed = F.from_csv("record", F.lit(schema.simpleString()[len("struct<"):-1].replace(":", " ")),
                        {"escape": '"', "multiLine": "true", "mode": "PERMISSIVE"})
    return rows.select("file", "record_no", parsed.alias("x")).select("file", "record_no", "x.*")
