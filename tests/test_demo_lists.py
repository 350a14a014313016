"""Demonstrations as lists, their draws, and how often support rows are copied."""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from veil.functions.md5 import leading_bits
from veil.operators import fewshot as FS


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _tables(spark):
    rng = np.random.default_rng(6)
    vecs = np.round(rng.normal(size=(240, 5)), 1).tolist()
    vecs[3] = vecs[9] = vecs[15]
    rows = [(i, v, "ab"[i % 2]) for i, v in enumerate(vecs)] + [(900, [0.0] * 5, "a"), (901, None, "b"), (902, [1.0] * 5, None)]
    s = spark.createDataFrame(rows, "id long, v array<float>, label string")
    q = s.where("id % 3 = 0 or id > 800").unionByName(s.where("id in (3, 6, 9)")).select(
        F.when(F.col("id") != 12, F.col("id")).alias("id"), "v")
    return q, s


def test_md5_sums_column_by_column():
    heads = [b"3:12:0", b"5", b"7:123456", b"8:" + b"x" * 60]
    row = np.arange(4000) % 4
    for tails in ([None if i % 13 == 0 else i * (10**9 if i % 7 == 0 else 1) for i in range(4000)],
                  [None if i % 13 == 0 else "é" * (i % 40) for i in range(4000)]):
        got = leading_bits(heads, row, pa.array(tails).slice(0, 4000))
        for i, t in enumerate(tails):
            text = heads[row[i]] + (b"" if t is None else b":" + str(t).encode())
            assert got[i] == int(hashlib.md5(text).hexdigest()[:8], 16)


def test_lists_hold_the_same_demonstrations(spark, monkeypatch):
    monkeypatch.setattr(FS, "LIST_ROWS", 7)
    q, s = _tables(spark)
    for own in (False, True):
        args = (q, s, "id", "v", "label", 2, 0.3, own)
        rows = FS.demo_filter(*args, query_rows=16, support_rows=64)
        got = FS.demo_filter(*args, query_rows=16, support_rows=64, lists=True)
        assert max(r.n for r in got.select(F.size("support_ids").alias("n")).collect()) == 7
        got = got.select("query_id", F.explode("support_ids").alias("support_id"), "label")
        assert sorted(map(str, got.collect())) == sorted(map(str, rows.select(got.columns).collect()))


def test_draws_from_lists_are_the_draws_from_rows(spark, monkeypatch):
    monkeypatch.setattr(FS, "_AT_ONCE", 50)
    q, s = _tables(spark)
    rows = FS.replicate(FS.demo_filter(q, s, "id", "v", "label", 2, 0.5).select("query_id", "support_id", "label"), 2)
    lists = FS.replicate(FS.demo_filter(q, s, "id", "v", "label", 2, 0.5, lists=True).withColumnRenamed("support_ids", "support_id"), 2)
    for draw in (lambda c: FS.sample_demo_per_label(c, 3), lambda c: FS.sample_in_context(c, 4, 5)):
        a, b = draw(rows), draw(lists)
        assert sorted(map(str, a.select(sorted(a.columns)).collect())) == sorted(map(str, b.select(sorted(a.columns)).collect()))
    words = lists.withColumn("support_id", F.transform("support_id", lambda x: F.concat(F.lit("word number "), x.cast("string"))))
    other = lists.withColumn("support_id", F.transform("support_id", lambda x: x.cast("double")))
    for c in (words, other):
        a, b = FS.sample_in_context(c.withColumn("support_id", F.explode("support_id")), 3, 1), FS.sample_in_context(c, 3, 1)
        assert sorted(map(str, a.select(sorted(a.columns)).collect())) == sorted(map(str, b.select(sorted(a.columns)).collect()))


def test_support_rows_are_copied_by_the_cores_not_by_the_queries(spark):
    q, s = _tables(spark)
    got = FS.demo_filter(q, s, "id", "v", "label", 2, 0.3, query_rows=1)       # as many shares as queries were made
    cores = spark.sparkContext.defaultParallelism
    assert got.rdd.getNumPartitions() <= 2 * -(-4 * cores // 2) < 2 * q.count()
