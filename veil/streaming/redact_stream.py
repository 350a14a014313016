"""Redaction on a stream of dialogue files (Structured Streaming).

The keyword redaction (R3/R4), the formatting of turns (D5/D6) and the
stop-token cut (D14/D15) are pure column expressions, so the same code runs
on ``readStream``: each micro-batch is redacted row by row with no state.
"""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veil.functions import text as T
from veil.operators import redaction as R
from veil.sources.io import DIALOGUE_SCHEMA, domain_from_path


def dialogue_stream(spark: SparkSession, folder: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """New dialogue CSV files arriving in ``folder`` as a stream of turns."""
    r = (spark.readStream.schema(DIALOGUE_SCHEMA).option("header", True)
         .option("multiLine", True).option("escape", '"'))
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    d = r.csv(folder)
    return d.select(F.col("conversationId").alias("conversation_id"), F.col("turnNumber").alias("turn"),
                    F.col("authorRole").alias("role"), F.coalesce("utterance", F.lit("")).alias("utterance"),
                    domain_from_path(F.col("_metadata.file_path")).alias("domain"))


def redact_stream(turns: DataFrame, keywords: Sequence[str] | Mapping[str, Sequence[str]],
                  text_col: str = "utterance", lo: int = 1, hi: int = 3) -> DataFrame:
    """Stateless per-row redaction of a streaming (or batch) turn table."""
    if isinstance(keywords, Mapping):
        kw = F.coalesce(F.element_at(R.keyword_map_col(keywords), F.col("domain")), F.array().cast("array<string>"))
    else:
        kw = T.lit_array(sorted({k.lower() for k in keywords}))
    return T.redact_df(turns, text_col, kw, text_col, lo, hi)


def start(spark: SparkSession, source_folder: str, sink_folder: str, checkpoint: str,
          keywords, available_now: bool = True):
    """Redact every file of ``source_folder`` into parquet under ``sink_folder``
    (exactly-once file sink; progress kept in ``checkpoint``)."""
    q = (redact_stream(dialogue_stream(spark, source_folder), keywords)
         .writeStream.format("parquet").option("path", sink_folder)
         .option("checkpointLocation", checkpoint).outputMode("append"))
    q = q.trigger(availableNow=True) if available_now else q.trigger(processingTime="10 seconds")
    return q.start()
