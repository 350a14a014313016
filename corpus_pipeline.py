"""A training-data pipeline over the documents table.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and returns what its successor reads: quality rules drop documents, near
copies are reduced to one of each class, benchmark passages are cut out,
personal data is replaced by its kind, and what is left is encoded.  All but
the last return the columns of ``documents``; where a text changes, its
``n_chars`` follows.

Results per case: null and empty texts fail the quality rules and go; of equal
or near-equal texts one row stays, the one of the least id (a null id only if
it has no other), and repeated rows leave one; ties of the quality ratio and the
cut are kept; texts of any length are handled whole; an empty table gives an
empty table with the columns of the stage; an empty benchmark or label table
cuts nothing and leaves the base rule alone; extra columns, also with names that
the stages use inside, are handed on unchanged by all stages but the last.
"""

from __future__ import annotations

import functools
import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veil.llm import bpe, common, contamination, near_dup, pii, quality
from veil.session import checkpoint_dir


def _stage(function):
    """A stage whose workers get short batches: texts are what the executors' memory goes to."""
    @functools.wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.short_batches(spark)
        return function(spark, docs, sf_dir)
    return run_stage


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars`` of the text as it is now, where there is such a column."""
    if "n_chars" not in docs.columns:
        return docs
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.char_length("text").cast(kind))


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    return quality.keep_good(docs, quality.fit(docs, common.table(spark, sf_dir, "labels")))


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays, the one of the least id."""
    return near_dup.keep_one(docs)


@_stage
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark are cut out of the texts."""
    return _counted(contamination.remove(docs, common.table(spark, sf_dir, "benchmark")))


@_stage
def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    return _counted(pii.redact(docs, pii.fit(pii.labelled_table(spark))))


@_stage
def encode_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with the digests of the ids and of what they decode to."""
    path = common.vocabulary_path("byte_bpe_50k.tiktoken")
    rows = bpe.decode(bpe.encode(docs, path, public_tokenizers.PATTERN), path)
    return bpe.digests(rows, extra=["ids"])


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("redact_pii", redact_pii),
    ("encode_bpe", encode_bpe),
]

# The quality model, the alignment, the random field and the merges are beyond SQL;
# tests/llm compares the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet in the shared folder and read again."""
    folder = f"{checkpoint_dir(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    docs = common.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
