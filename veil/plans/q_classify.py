"""Registered classifier-data queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from veil.operators import classify as C
from veil.plans import sqlfrag as S
from veil.plans.registry import register
from veil.plans.tables import read


@register("c1_label_union", """
SELECT lang AS label, count(*) AS n, sum(n_chars) AS chars FROM documents GROUP BY lang
""")
def c1_label_union(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    langs = [r[0] for r in d.select("lang").distinct().orderBy("lang").collect()]      # the label set: small
    u = C.label_union({l: d.where(F.col("lang").eqNullSafe(F.lit(l))).select("doc_id", "n_chars") for l in langs})
    return u.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


def _sql_span(seed=0, max_start=20, min_end=20):
    lo = f"CAST(floor({S.hash_uniform(seed, repr('lo'), 'doc_id')} * {max_start + 1}) AS INTEGER)"
    return f"""
SELECT doc_id, substr(text, lo + 1, greatest(hi - lo, 0)) AS span FROM (
  SELECT doc_id, text, lo, CAST(h + floor({S.hash_uniform(seed, repr('hi'), 'doc_id')} * (greatest(length(text), h + 1) - h)) AS INTEGER) AS hi
  FROM (SELECT doc_id, text, lo, greatest(lo + 1, {min_end}) AS h FROM (SELECT doc_id, text, {lo} AS lo FROM documents)))"""


@register("c2_random_span", _sql_span())
def c2_random_span(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", C.random_span("text", F.col("doc_id"), 0).alias("span"))


@register("c3_stratified_split", f"""
WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {S.hash_key(0, 'doc_id')}, doc_id) - 1 AS r,
                  count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT doc_id, lang,
       CASE WHEN r < ceil(n * 0.1) THEN 'test' WHEN r < ceil(n * 0.1) + ceil((n - ceil(n * 0.1)) * (1.0 / 9)) THEN 'valid'
            ELSE 'train' END AS split
FROM r
""")
def c3_stratified_split(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "lang")
    return C.stratified_split(d, "lang", "doc_id", 0).select("doc_id", "lang", "split")


@register("c4_label_index", """
SELECT doc_id, lang, CAST(dense_rank() OVER (ORDER BY lang) - 1 AS INTEGER) AS label_id FROM documents
""")
def c4_label_index(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "lang")
    return C.label_index(d, "lang").select("doc_id", "lang", "label_id")


@register("c5_cap", "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 100")
def c5_cap(spark, sf_dir):
    return C.cap(read(spark, sf_dir, "documents").select("doc_id", "lang"), 100, "doc_id")


SQL_PRED = """(SELECT vec_id, label, CAST(list_position(e, list_max(e)) - 1 AS INTEGER) AS pred
               FROM (SELECT vec_id, label, embedding[1:10] AS e FROM embeddings))"""


def _pred(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    return e.select("vec_id", "label", C.argmax_label(F.slice("embedding", 1, 10)).alias("pred"))


@register("c6_argmax_label", f"SELECT * FROM {SQL_PRED}")
def c6_argmax_label(spark, sf_dir):
    return _pred(spark, sf_dir)


@register("c7_accuracy", f"SELECT round(avg(CASE WHEN pred = label THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM {SQL_PRED}")
def c7_accuracy(spark, sf_dir):
    return C.accuracy(_pred(spark, sf_dir), "pred", "label").select(F.round("accuracy", 6).alias("accuracy"))


@register("c8_confusion_matrix", f"""
SELECT label AS y, pred AS p, round(count(*) / sum(count(*)) OVER (PARTITION BY label), 6) AS rate
FROM {SQL_PRED} GROUP BY label, pred
""")
def c8_confusion_matrix(spark, sf_dir):
    c = C.confusion_matrix(_pred(spark, sf_dir), "pred", "label")
    return c.select("y", "p", F.round("rate", 6).alias("rate"))
