import os
import tempfile

from pyspark.sql import functions as F

from veil.operators import redaction as R
from veil.plans.tables import TEST_KEYWORDS, turns
from veil.sources import io
from veil.streaming import redact_stream as RS

SF = "/root/testdata/sf0.001"


def test_stream_redaction_equals_batch(spark):
    base = tempfile.mkdtemp(prefix="veil-stream-")
    src, sink, ck = f"{base}/in", f"{base}/out", f"{base}/ck"
    t = turns(spark, SF)
    io.write_dialogues(t, src)
    # the file stream reads the part files of every <domain>.tsv folder
    q = RS.start(spark, f"{src}/*.tsv", sink, ck, TEST_KEYWORDS)
    q.awaitTermination(120)
    got = {(r["conversation_id"], r["turn"]): r["utterance"] for r in spark.read.parquet(sink).collect()}
    exp = R.redact_keywords(t.fillna({"utterance": ""}), TEST_KEYWORDS, "utterance", domain_col="domain")
    exp = {(r["conversation_id"], r["turn"]): r["utterance"] for r in exp.collect()}
    assert got == exp and len(got) == t.count()


def test_dialogue_roundtrip_skips_missing(spark):
    base = tempfile.mkdtemp(prefix="veil-io-")
    t = turns(spark, SF)
    paths = io.write_dialogues(t, base)
    back = io.read_dialogues(spark, paths + [f"{base}/nothere.tsv"])
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, t.collect()))


def test_read_lines_first_n_in_file_order(spark):
    base = tempfile.mkdtemp(prefix="veil-lines-")
    d = spark.range(0, 5000).select(F.col("id"), F.col("id").cast("string").alias("value"))
    io.write_lines(d.repartition(7), f"{base}/a.txt", "id")
    io.write_lines(d.where("id < 10"), f"{base}/b.txt", "id")
    r = io.read_lines(spark, [f"{base}/b.txt", f"{base}/a.txt"], max_examples=1200).collect()
    by = {}
    for x in r:
        by.setdefault(x["file_idx"], []).append((x["line_no"], x["value"]))
    assert [v for _, v in sorted(by[0])] == [str(i) for i in range(10)]
    assert [v for _, v in sorted(by[1])] == [str(i) for i in range(1200)]
