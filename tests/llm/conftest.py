import os

import pytest
from pyspark.sql import types as T

DATA = "/root/testdata/sf0.001"
os.environ.setdefault("PYARROW_IGNORE_TIMEZONE", "1")

# extra columns that clash with names the operators use inside
EDGE_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    *[T.StructField(n, T.StringType()) for n in (
        "source", "id", "key", "row", "ids", "print", "spans", "items", "n", "label_id", "good", "word", "n_tokens",
        "class_id", "score", "kept", "windows", "base", "added", "s")],
    T.StructField("n_chars", T.LongType())])


def edge_rows():
    prose = " ".join(f"word{k % 37}x{k}" for k in range(120))
    long = " ".join(f"tok{k}" for k in range(60_000)) + " " + "a" * 5_000
    texts = [(1, None, "en"), (2, "", "en"), (3, "   \n\t ", None), (4, prose, "en"), (4, prose, "en"), (5, prose, "en"),
             (None, prose + " tail", "en"), (None, None, None), (6, long, "en"), (7, "Ünïcödé  　 日本語 😀 \x1c a\x85b", "de"),
             (8, "bob@mail.example.com 10.0.0.1 4111 1111 1111 1111 +1 (212) 555-0187 token = \"abcdef0123456789abcdef01\"", "en"),
             (9, "the " * 300, "fr"), (10, "x", "es"), (11, "one two three four", "es"), (12, "\x00\x01 nul", None)]
    rest = ["x"] * (len(EDGE_SCHEMA) - 4)
    return [(i, t, lang, *rest, None if t is None else len(t)) for i, t, lang in texts]


@pytest.fixture(scope="session")
def edge_dir(spark, tmp_path_factory):
    """The hard cases as tables: nulls, empty and long texts, repeated rows, clashing extra columns."""
    d = str(tmp_path_factory.mktemp("edge"))
    spark.createDataFrame(edge_rows(), EDGE_SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([("b1", "word0x0 word1x1 word2x2 word3x3 word4x4 word5x5 word6x6 word7x7 word8x8 word9x9 word10x10"),
                           ("b2", None), (None, "one two THREE four"), ("b3", ""), ("b1", "tok7 tok8")],
                          "item_id string, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(4, 1, 0), (4, 1, 0), (5, 0, 0), (6, 1, 0), (None, 1, 0), (9, None, 1)],
                          "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


@pytest.fixture(scope="session")
def empty_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("empty"))
    spark.createDataFrame([], EDGE_SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "item_id string, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d
