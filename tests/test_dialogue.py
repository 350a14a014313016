from pyspark.sql import functions as F

from tests import pyref
from veil.operators import dialogue as D


def test_rstrip_character_sets(spark):
    ids = ["x-1", "x-2", "x-21", "abc-12", "conv11", "a-1-2"]
    d = spark.createDataFrame([(i,) for i in ids], "conversation_id string")
    got = [r[0] for r in d.select(D.normalize_conversation_id("conversation_id")).collect()]
    assert got == [i.rstrip("-1").rstrip("-2") for i in ids]


def test_dedup_keeps_first_copy(spark):
    rows = [("c", 0, "customer", "hi", "AIRLINE"), ("c-1", 0, "customer", "hi", "AIRLINE"),
            ("c-1", 1, "agent", "yes", "AIRLINE")]
    d = spark.createDataFrame(rows, "conversation_id string, turn int, role string, utterance string, domain string")
    out = sorted((r["conversation_id"], r["turn"], r["orig_id"]) for r in D.dedup_turns(d).collect())
    assert out == [("c", 0, "c"), ("c", 1, "c-1")]


def test_prompts_match_python(spark):
    conv = [("customer", " hello "), ("agent", "hi there"), ("customer", "bye"), ("bot", "ok")]
    rows = [("7", i, r, u, "MEDIA") for i, (r, u) in enumerate(conv)]
    d = spark.createDataFrame(rows, "conversation_id string, turn int, role string, utterance string, domain string")
    for cap in (-1, 0, 2, 10):
        got = [r["prompt"] for r in D.build_prompts(d, cap).orderBy("prompt_idx").collect()]
        assert got == pyref.prompts(conv, "<MEDIA>", cap), cap


def test_assemble_and_blank(spark):
    rows = [("7", 1, "agent", None, "MEDIA"), ("7", 0, "customer", "x", "MEDIA")]
    d = D.fill_blank(spark.createDataFrame(
        rows, "conversation_id string, turn int, role string, utterance string, domain string"))
    t = D.assemble_conversations(d).first()["text"]
    assert t == "<_soc_> <MEDIA> USR: x <MEDIA> SYS:  <_eoc_>"


def test_split_is_disjoint_and_complete(spark):
    rows = [(str(i), 0, "customer", "u", "AIRLINE" if i % 2 else "MEDIA") for i in range(101)]
    d = spark.createDataFrame(rows, "conversation_id string, turn int, role string, utterance string, domain string")
    m = D.split_conversations(d, 0.1, 0.2, seed=3).collect()
    ids = [r["conversation_id"] for r in m]
    assert sorted(ids) == sorted(str(i) for i in range(101))
    counts = {}
    for r in m:
        counts[(r["domain"], r["split"])] = counts.get((r["domain"], r["split"]), 0) + 1
    assert counts[("AIRLINE", "test")] == int(0.2 * 50) and counts[("AIRLINE", "valid")] == int(0.1 * 50)
    assert counts[("MEDIA", "test")] == int(0.2 * 51) and counts[("MEDIA", "valid")] == int(0.1 * 51)
    # positions inside each split are 0..k-1
    for key in counts:
        pos = sorted(r["pos"] for r in m if (r["domain"], r["split"]) == key)
        assert pos == list(range(counts[key]))


def test_truncate_at_stop(spark):
    d = spark.createDataFrame([("hello USR: more <_eoc_>",), ("no stop ",)], "t string")
    got = [r[0] for r in d.select(D.truncate_at_stop("t", "dogo")).collect()]
    assert got == ["hello", "no stop"]
