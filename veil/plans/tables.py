"""Inputs of the registered queries, derived from the driver's tables.

The mapping follows FIXTURES.md; every derived input is a projection of the
given parquet tables so the work grows with them.  Each derived input has a
SQL twin (``SQL_*``) for the DuckDB oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

# The keyword dictionary of the tests: frequent words of the invented prose
# per domain (the reference's phrases do not occur in it).
TEST_KEYWORDS = {
    "AIRLINE": ["the", "of", "and", "of the", "in the"],
    "MEDIA": ["la", "le", "des", "de la", "que"],
    "INSURANCE": ["der", "die", "und", "in der"],
}
DOMAINS3 = ["AIRLINE", "MEDIA", "INSURANCE"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table.  A table that is a single file is dealt round-robin over
    the cores (its row group is one task otherwise); one of many files keeps the
    splits of its scan.  The file list is metadata: no job runs."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.repartition(spark.sparkContext.defaultParallelism) if len(df.inputFiles()) == 1 else df


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dialogue turn table from ``conversations``."""
    c = read(spark, sf_dir, "conversations")
    role = (F.when(F.col("role") == "user", "customer")
            .when(F.col("role") == "assistant", "agent")
            .when(F.col("role") == "system", "bot").otherwise(F.col("role")))
    return c.select(
        F.col("conv_id").cast("string").alias("conversation_id"),
        F.col("turn").cast("int").alias("turn"),
        role.alias("role"),
        F.col("text").alias("utterance"),
        F.element_at(F.array(*[F.lit(d) for d in DOMAINS3]),
                     (F.col("conv_id") % 3 + 1).cast("int")).alias("domain"))


SQL_TURNS = """
SELECT CAST(conv_id AS VARCHAR) AS conversation_id, CAST(turn AS INTEGER) AS turn,
       CASE role WHEN 'user' THEN 'customer' WHEN 'assistant' THEN 'agent'
                 WHEN 'system' THEN 'bot' ELSE role END AS role,
       text AS utterance,
       ['AIRLINE', 'MEDIA', 'INSURANCE'][CAST(conv_id % 3 + 1 AS INTEGER)] AS domain
FROM conversations
"""


def with_copies(t: DataFrame) -> DataFrame:
    """Duplicate conversations for D2/D3: ids suffixed ``-1`` and ``-2`` (FIXTURES)."""
    return t.unionAll(t.withColumn("conversation_id", F.concat("conversation_id", F.lit("-1")))) \
            .unionAll(t.withColumn("conversation_id", F.concat("conversation_id", F.lit("-2"))))


SQL_TURNS_COPIES = f"""
SELECT * FROM ({SQL_TURNS}) UNION ALL
SELECT conversation_id || '-1', turn, role, utterance, domain FROM ({SQL_TURNS}) UNION ALL
SELECT conversation_id || '-2', turn, role, utterance, domain FROM ({SQL_TURNS})
"""
