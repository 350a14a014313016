"""Demonstrations without pair tables: what is ranked, compared and drawn inside the tasks."""

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from veil.functions.ranking import hash_key
from veil.operators import demos
from veil.operators import fewshot as FS

from tests.test_demos import brute


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _rows(n, dim, labels):
    rng = np.random.default_rng(3)
    vecs = rng.normal(size=(n, dim)).tolist()
    vecs[5] = vecs[6] = vecs[9]                                    # ties: the smaller key
    return [(i, v, labels[i % len(labels)]) for i, v in enumerate(vecs)]


def test_filter_ranks_inside_the_tasks(spark):
    rows = _rows(150, 12, ["a", "b"]) + [(500, [0.0] * 12, "a"), (501, None, "b"), (502, [1.0] * 12, None)]
    s = spark.createDataFrame(rows, "id long, v array<float>, label string")
    queries = [(i, v) for i, v, _ in rows if i % 4 == 0 or i in (5, 500, 501)]
    q = spark.createDataFrame(queries, "id long, v array<float>")
    for own in (False, True):
        got = FS.demo_filter(q, s, "id", "v", "label", 2, 0.2, exclude_self=own, query_rows=8, support_rows=16)
        assert "Window" not in _plan(got)                          # no pair is sorted or shuffled
        k = int((152 - own) // 2 * 0.2)
        assert {(r.query_id, r.support_id, r.label, r["rank"]) for r in got.collect()} == brute(queries, rows, k, own)


def test_nearest_without_clusters_meets_cells(spark, monkeypatch):
    """Bounds exclude little among many dimensions: no query is dealt out by block again."""
    monkeypatch.setattr(demos, "CELL_ROWS", 40)
    monkeypatch.setattr(demos, "SIMILARITIES", 300)
    rows = _rows(300, 24, [1, 2, None])
    s = spark.createDataFrame(rows, "id long, v array<double>, label int")
    queries = [(i, v) for i, v, _ in rows if i % 3 != 1]
    q = spark.createDataFrame(queries, "id long, v array<double>")
    for own in (False, True):
        got = demos.nearest_per_label(q, s, "id", "v", "label", 4, exclude_self=own, pivots=8, support_rows=9, query_rows=16)
        assert "MapInArrow" in _plan(got)
        assert {(r.query_id, r.support_id, r.label, r["rank"]) for r in got.collect()} == brute(queries, rows, 4, own)


def test_many_copies_stay_k_a_cell(spark):
    s = spark.createDataFrame([(i, [1.0, 2.0], 0) for i in range(200)], "id long, v array<double>, label int")
    q = s.where("id < 20")
    got = demos.nearest_per_label(q, s, "id", "v", "label", 3, support_rows=50)
    assert {(r.query_id, r.support_id) for r in got.collect()} == {(i, j) for i in range(20) for j in range(3)}


def test_draws_hand_on_few_rows_of_a_batch(spark):
    rows = [("q%d" % (i % 2) if i % 5 else None, i % 3, i, "x" * (i % 4)) for i in range(3000)]
    c = spark.createDataFrame(rows, "query_id string, sample int, support_id int, extra string")
    hashed = c.coalesce(1).withColumn("__h", hash_key(7, "query_id", "sample", "support_id"))
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    batch = spark.conf.get(size)                                   # other tests of the session set it
    spark.conf.set(size, "10000")
    try:
        assert FS._least_of_batches(hashed, ["query_id", "sample"], "__h", 4).count() <= 9 * 4 + 2
    finally:
        spark.conf.set(size, batch)
    w = Window.partitionBy("query_id", "sample").orderBy(hash_key(7, "query_id", "sample", "support_id"), "support_id")
    plain = c.withColumn("n", F.row_number().over(w)).where("n <= 4").drop("n")
    assert sorted(map(str, FS.sample_in_context(c, 4, 7).collect())) == sorted(map(str, plain.collect()))
    labelled = c.withColumn("label", F.col("support_id") % 2)
    assert FS.sample_demo_per_label(labelled, 7).count() == 12              # a query name goes with one label


def test_rows_of_one_query_key_share_its_places(spark):
    s = spark.createDataFrame([(i, [1.0, float(i)], 0) for i in range(10)], "id long, v array<double>, label int")
    q = spark.createDataFrame([(50, [1.0, 0.0])] * 3 + [(51, [1.0, 0.0]), (60, [1.0, 0.0]), (60, [0.0, 1.0])], "id long, v array<double>")
    for rows in (1, 16):
        got = FS.demo_filter(q, s, "id", "v", "label", 1, 0.4, query_rows=rows, support_rows=8).collect()
        found = {k: [r.support_id for r in sorted((r for r in got if r.query_id == k), key=lambda r: r["rank"])] for k in (50, 51, 60)}
        assert found == {50: [0, 0, 0, 1], 51: [0, 1, 2, 3], 60: [0, 9, 8, 7]}
