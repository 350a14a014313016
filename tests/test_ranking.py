from pyspark.sql import functions as F

from veil.functions.ranking import positions, running_sum


def _skewed(spark):
    # one hot group holding ~1/3 of the rows, many small ones
    return spark.range(0, 30000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") % 50).cast("string")).alias("g"),
        ((F.col("id") * 7919) % 30011).alias("k"), (F.col("id") % 13).cast("double").alias("v")).repartition(8)


def test_positions_match_python(spark):
    df = _skewed(spark)
    got = {(r["g"], r["k"]): r["pos"] for r in positions(df, ["g"], ["k"], num_partitions=8).collect()}
    rows = sorted((r["g"], r["k"]) for r in df.collect())
    exp, cur, i = {}, None, 0
    for g, k in rows:
        i = i + 1 if g == cur else 0
        cur = g
        exp[(g, k)] = i
    assert got == exp


def test_running_sum_matches_python(spark):
    df = _skewed(spark)
    got = {(r["g"], r["k"]): (r["running_sum"], r["running_n"])
           for r in running_sum(df, ["g"], ["k"], "v", num_partitions=8).collect()}
    rows = sorted((r["g"], r["k"], r["v"]) for r in df.collect())
    exp, cur, s, n = {}, None, 0.0, 0
    for g, k, v in rows:
        if g != cur:
            cur, s, n = g, 0.0, 0
        s, n = s + v, n + 1
        exp[(g, k)] = (s, n)
    assert got == exp


def test_positions_with_more_partitions_than_rows(spark):
    df = spark.createDataFrame([("a", 3), ("a", 1), ("b", 2)], "g string, k int")
    got = sorted((r["g"], r["k"], r["pos"]) for r in positions(df, ["g"], ["k"], num_partitions=16).collect())
    assert got == [("a", 1, 0), ("a", 3, 1), ("b", 2, 0)]


def test_split_manifest_counts_on_skewed_domain(spark):
    from veil.operators import dialogue as D
    rows = [(str(i), 0, "customer", "u", "HOT" if i % 3 else "COLD") for i in range(3000)]
    t = spark.createDataFrame(rows, "conversation_id string, turn int, role string, utterance string, domain string")
    m = D.split_conversations(t.repartition(8), 0.1, 0.1, seed=1)
    c = {(r["domain"], r["split"]): r["n"] for r in m.groupBy("domain", "split").count().withColumnRenamed("count", "n").collect()}
    assert c[("HOT", "test")] == 200 and c[("HOT", "valid")] == 200 and c[("HOT", "train")] == 1600
    assert c[("COLD", "test")] == 100 and c[("COLD", "valid")] == 100 and c[("COLD", "train")] == 800
