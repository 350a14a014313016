"""Records of large JSON documents, read by many tasks from one file.

A document is cut at every ``}`` by a splittable scan, so minified and printed
layouts are alike.  What such a piece does depends on whether it begins inside
a string, and on its depth: each block of the scan is summed up for both cases
(quote parity and change of depth), the sums are composed by a prefix pass over
the blocks of a file, and a piece then knows its state.  A record is an object
that closes at the wanted depth; its pieces are put together by a second prefix
pass that numbers the records.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _every_other(first: int):
    return lambda _, i: i % 2 == first


def _pieces(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(file, blk, mid, value, q, d0, d1): quote parity and change of depth of each piece.

    ``d0`` holds if the piece begins outside a string, ``d1`` inside; the ``}``
    at its end counts where it lies outside.
    """
    d = spark.read.option("lineSep", "}").text(list(paths)).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("blk"),
        F.monotonically_increasing_id().alias("mid"), "value")
    # escapes gone, quotes alone part strings from what is outside
    d = d.withColumn("parts", F.split(F.regexp_replace("value", r"(?s)\\.", ""), '"'))
    d = d.withColumn("q", (F.size("parts") - 1) % 2)
    for s in (0, 1):
        closes = F.when(F.col("q") == s, 1).otherwise(0)              # the piece ends outside a string
        d = d.withColumn(f"t{s}", F.array_join(F.filter("parts", _every_other(s)), "")).withColumn(
            f"d{s}", _count(F.col(f"t{s}"), "{[") - _count(F.col(f"t{s}"), "]") - closes)
    return d.drop("parts", "t0", "t1")


def _states(pieces: DataFrame) -> DataFrame:
    """Add ``p``: quote parity before the piece inside its block."""
    w = Window.partitionBy("file", "blk").orderBy("mid").rowsBetween(Window.unboundedPreceding, -1)
    return pieces.withColumn("p", F.coalesce(F.sum("q").over(w), F.lit(0)) % 2)


def _by_parity(start: Column) -> Column:
    return F.when((start + F.col("p")) % 2 == 0, F.col("d0")).otherwise(F.col("d1"))


def _before(blocks: DataFrame, value: Column) -> Column:
    w = Window.partitionBy("file").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(w), F.lit(0))


def _placed(spark: SparkSession, paths: Sequence[str], level: int, with_text: bool) -> DataFrame:
    """Pieces with ``ends``: whether a record of the wanted depth closes at their end."""
    light = _states(_pieces(spark, paths).drop("value"))
    blocks = light.groupBy("file", "blk").agg((F.sum("q") % 2).alias("turns"), *[
        F.sum(_by_parity(F.lit(s))).alias(f"sum{s}") for s in (0, 1)])             # one row per split
    blocks = blocks.withColumn("parity", _before(blocks, F.col("turns")) % 2)
    blocks = blocks.withColumn("sum", F.when(F.col("parity") == 0, F.col("sum0")).otherwise(F.col("sum1")))
    blocks = blocks.select("file", "blk", "parity", _before(blocks, F.col("sum")).alias("depth"))
    pieces = _states(_pieces(spark, paths)) if with_text else light
    d = pieces.join(blocks, ["file", "blk"]).withColumn("change", _by_parity(F.col("parity")))
    w = Window.partitionBy("file", "blk").orderBy("mid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("after", F.col("depth") + F.sum("change").over(w))
    outside = (F.col("parity") + F.col("p") + F.col("q")) % 2 == 0
    return d.withColumn("ends", (outside & (F.col("after") == level)).cast("int"))


def json_records(spark: SparkSession, paths: Sequence[str], level: int = 1) -> DataFrame:
    """(file, record_no, record): the objects inside ``level`` brackets, numbered from 1 in each file.

    Level 1 has the elements of a top-level array, level 2 those of the first
    array that is a value of a top-level object.  A file may hold several documents.
    A record is held whole by a task; what is no record is left out.
    """
    counted = _placed(spark, paths, level, with_text=False).groupBy("file", "blk").agg(F.sum("ends").alias("n"))
    counted = counted.select("file", "blk", _before(counted, F.col("n")).alias("earlier"))
    d = _placed(spark, paths, level, with_text=True).join(counted, ["file", "blk"])
    w = Window.partitionBy("file", "blk").orderBy("mid").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("record_no", F.col("earlier") + F.coalesce(F.sum("ends").over(w), F.lit(0)) + 1)
    parts = d.withColumn("start", F.col("after") - F.col("change")).groupBy("file", "record_no").agg(
        F.sort_array(F.collect_list(F.struct("blk", "mid", "value", "start"))).alias("x"), F.max("ends").alias("ended"))
    text = F.concat(F.array_join(F.transform("x", lambda s: s["value"]), "}"), F.lit("}"))
    # before a record stand separators, or the beginning of its document
    later = F.regexp_replace(text, r"^[\s,]*\{", "")
    first = r"^[\s,\[\]]*\{" if level == 1 else r'^[\s\]}]*\{(?:[^"\[{]|"(?:[^"\\]|\\.)*")*\[\s*\{'
    goes_on = (F.col("x")[0]["start"] >= level) & text.rlike(r"^[\s,]*\{")
    body = F.when(goes_on, later).otherwise(F.regexp_replace(text, first, ""))
    return parts.where("ended = 1").select("file", "record_no", F.concat(F.lit("{"), body).alias("record"))


def read_json_records(spark: SparkSession, paths: Sequence[str], schema: str, level: int = 1) -> DataFrame:
    """(file, record_no, columns of ``schema``) of the records of large JSON documents."""
    return json_records(spark, paths, level).select(
        "file", "record_no", F.from_json("record", schema).alias("x")).select("file", "record_no", "x.*")
