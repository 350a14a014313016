"""Registered LM-dataset queries.

E2E-style lines are built from ``part`` (``name : p_name | brand : p_brand ||
p_type``); WebNLG / DART records from ``part`` as nested arrays of structs.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from veil.functions import text as T
from veil.operators import lmdata as L
from veil.plans import sqlfrag as S
from veil.plans.registry import register
from veil.plans.tables import read

BOS = EOS = "<|endoftext|>"


def e2e_lines(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    return p.select("p_partkey", F.concat(F.lit("name : "), "p_name", F.lit(" | brand : "), "p_brand",
                                          F.lit("||"), "p_type").alias("value"))


SQL_E2E_LINES = "SELECT p_partkey, 'name : ' || p_name || ' | brand : ' || p_brand || '||' || p_type AS value FROM part"
SQL_E2E = f"""
e2e AS (SELECT p_partkey, split_part(value, '||', 1) AS src, split_part(value, '||', 2) AS tgt
        FROM ({SQL_E2E_LINES}) WHERE length(value) > 0 AND regexp_matches(value, '\\S')
             AND len(string_split(value, '||')) = 2),
sents AS (SELECT p_partkey, src, tgt, ' ' || src || ' {BOS} ' || tgt || ' {EOS}' AS sent FROM e2e),
vocab AS (SELECT token, CAST(dense_rank() OVER (ORDER BY token) AS INTEGER) AS id
          FROM (SELECT DISTINCT unnest({S.tokens('sent')}) AS token FROM sents)),
toks AS (SELECT p_partkey, unnest({S.tokens('sent')}) AS token, generate_subscripts({S.tokens('sent')}, 1) AS pos FROM sents),
ids AS (SELECT p_partkey, list(id ORDER BY pos) AS input_ids FROM toks JOIN vocab USING (token) GROUP BY p_partkey),
sep AS (SELECT id AS sep_id FROM vocab WHERE token = '{BOS}')"""


def _e2e(spark, sf_dir):
    d = L.split_src_tgt(e2e_lines(spark, sf_dir))
    return d.withColumn("sent", L.format_src_tgt("src", "tgt", BOS, EOS))


def _e2e_ids(spark, sf_dir):
    d = _e2e(spark, sf_dir)
    vocab = L.build_vocab(d, "sent")
    ids = L.tokenize(d.select("p_partkey", "src", "tgt", "sent", F.col("sent").alias("__t")), vocab, "__t",
                     ["p_partkey"])
    sep = vocab.where(F.col("token") == BOS).select(F.col("id").alias("sep_id"))
    return ids.join(F.broadcast(sep), how="inner")          # one row


@register("l1_tokenize_lines", f"WITH {SQL_E2E} SELECT p_partkey, input_ids FROM ids")
def l1_tokenize_lines(spark, sf_dir):
    return _e2e_ids(spark, sf_dir).select("p_partkey", "input_ids")


@register("l2_pack_blocks", f"""
WITH dv AS (SELECT token, CAST(dense_rank() OVER (ORDER BY token) AS INTEGER) AS id
            FROM (SELECT DISTINCT unnest({S.tokens('text')}) AS token FROM documents)),
dt AS (SELECT doc_id, unnest({S.tokens('text')}) AS token, generate_subscripts({S.tokens('text')}, 1) AS pos FROM documents),
rows_ AS (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) AS r FROM documents),
g AS (SELECT r.doc_id, r.r // 1000 AS map_batch, t.pos, d.id,
             sum(1) OVER (PARTITION BY r.r // 1000 ORDER BY r.r, t.pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS goff,
             count(*) OVER (PARTITION BY r.r // 1000) AS tot
      FROM rows_ r JOIN dt t USING (doc_id) JOIN dv d USING (token))
SELECT CAST(map_batch AS BIGINT) AS map_batch, CAST(goff // 128 AS BIGINT) AS block,
       list(id ORDER BY goff) AS input_ids, list(id ORDER BY goff) AS labels
FROM g WHERE goff // 128 < tot // 128 GROUP BY map_batch, goff // 128
""")
def l2_pack_blocks(spark, sf_dir):
    """Documents tokenised with their own vocabulary, packed into 128-token blocks."""
    d = read(spark, sf_dir, "documents").select("doc_id", "text")
    vocab = L.build_vocab(d, "text")
    ids = L.tokenize(d, vocab, "text", ["doc_id"])
    b = L.pack_blocks(ids, "input_ids", "doc_id", 128)
    return b.select(F.col("map_batch").cast("long").alias("map_batch"), F.col("block").cast("long").alias("block"),
                    "input_ids", "labels")


@register("l3_drop_blank_lines", """
SELECT doc_id, count(*) AS kept FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS value FROM documents)
WHERE length(value) > 0 AND regexp_matches(value, '\\S') GROUP BY doc_id
""")
def l3_drop_blank_lines(spark, sf_dir):
    """Lines of every document (split on newlines), blank ones dropped."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("value"))
    return L.drop_blank_lines(d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("kept"))


@register("s9_l4_format_src_tgt", f"WITH {SQL_E2E} SELECT p_partkey, src, tgt, sent FROM sents")
def s9_l4_format_src_tgt(spark, sf_dir):
    return _e2e(spark, sf_dir).select("p_partkey", "src", "tgt", "sent")


@register("l5_length_filter_then_cap", f"""
WITH {SQL_E2E}
SELECT p_partkey, sent FROM sents WHERE len({S.tokens('sent')}) <= 12 ORDER BY p_partkey LIMIT 500
""")
def l5_length_filter_then_cap(spark, sf_dir):
    return L.length_filter_then_cap(_e2e(spark, sf_dir), "sent", "p_partkey", 12, 500).select("p_partkey", "sent")


@register("l6_cap_then_length_filter", f"""
WITH {SQL_E2E}
SELECT p_partkey, sent FROM (SELECT * FROM sents ORDER BY p_partkey LIMIT 500) WHERE len({S.tokens('sent')}) <= 12
""")
def l6_cap_then_length_filter(spark, sf_dir):
    return L.cap_then_length_filter(_e2e(spark, sf_dir), "sent", "p_partkey", 12, 500).select("p_partkey", "sent")


@register("l7_l8_l9_truncate_mask_split", f"""
WITH {SQL_E2E},
x AS (SELECT p_partkey, input_ids[1:10] AS ids, sep_id FROM ids, sep)
SELECT p_partkey, ids,
       list_transform(ids, lambda v, i: CASE WHEN i <= list_position(ids, sep_id) THEN -100 ELSE v END) AS labels,
       ids[1 : list_position(ids, sep_id) - 1] AS src_ids, ids[list_position(ids, sep_id) :] AS tgt_ids
FROM x
""")
def l7_l8_l9_truncate_mask_split(spark, sf_dir):
    d = _e2e_ids(spark, sf_dir).withColumn("ids", L.truncate("input_ids", 10))
    src, tgt = L.split_at_separator("ids", F.col("sep_id"))
    return d.select("p_partkey", "ids", L.mask_source_labels("ids", F.col("sep_id")).alias("labels"),
                    src.alias("src_ids"), tgt.alias("tgt_ids"))


@register("l10_category_words", f"""
WITH {SQL_E2E}
SELECT p_partkey, list_transform(string_split(src, '|'), lambda la: {S.py_strip("split_part(la, ':', 1)")}) AS cats
FROM e2e
""")
def l10_category_words(spark, sf_dir):
    return _e2e(spark, sf_dir).select("p_partkey", L.category_words("src").alias("cats"))


@register("l11_length_stats", f"""
WITH {SQL_E2E},
x AS (SELECT list_position(input_ids, sep_id) - 1 AS s, len(input_ids) - (list_position(input_ids, sep_id) - 1) AS t
      FROM ids, sep)
SELECT round(avg(t), 6) AS tgt_avg, round(avg(s), 6) AS src_avg, round(sum(s) / sum(t), 6) AS ratio FROM x
""")
def l11_length_stats(spark, sf_dir):
    d = _e2e_ids(spark, sf_dir)
    src, tgt = L.split_at_separator("input_ids", F.col("sep_id"))
    s = L.length_stats(d.select(src.alias("src_ids"), tgt.alias("tgt_ids")))
    return s.select(*[F.round(c, 6).alias(c) for c in ("tgt_avg", "src_avg", "ratio")])


def webnlg_entries(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    trip = F.array(F.struct(F.col("p_name").alias("subject"), F.lit("brand").alias("property"),
                            F.col("p_brand").alias("object")),
                   F.struct(F.col("p_name").alias("subject"), F.lit("type").alias("property"),
                            F.col("p_type").alias("object")))
    lex = F.array(F.struct(F.when(F.col("p_size") % 3 == 0, "bad").otherwise("good").alias("comment"),
                           F.concat_ws(" ", "p_type", "p_name").alias("lex")),
                  F.struct(F.lit("good").alias("comment"), F.concat_ws(" of ", "p_name", "p_brand").alias("lex")))
    return p.select(F.col("p_partkey").alias("entry_id"), lex.alias("lexicalisations"), trip.alias("modifiedtripleset"))


@register("l12_linearize_webnlg", f"""
WITH l AS (SELECT p_partkey AS entry_id, p_name || ' : brand : ' || p_brand || ' | ' || p_name || ' : type : ' || p_type AS src,
                  unnest([CASE WHEN p_size % 3 = 0 THEN 'bad' ELSE 'good' END, 'good']) AS comment,
                  unnest([p_type || ' ' || p_name, p_name || ' of ' || p_brand]) AS tgt,
                  unnest([0, 1]) AS lex_idx FROM part)
SELECT entry_id, lex_idx, src, tgt, ' ' || src || ' {BOS} ' || tgt || ' {EOS}' AS sent FROM l WHERE comment = 'good'
""")
def l12_linearize_webnlg(spark, sf_dir):
    w = L.linearize_webnlg(webnlg_entries(spark, sf_dir), BOS, EOS)
    return w.select("entry_id", "lex_idx", "src", "tgt", "sent")


def dart_examples(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    trip = F.array(F.array("p_name", F.lit("Brand"), "p_brand"),
                   F.array("p_name", F.lit("SIZE"), F.col("p_size").cast("string")))
    ann = F.array(F.struct(F.col("p_type").alias("text")),
                  F.struct(F.concat_ws(" of ", "p_name", "p_brand").alias("text")))
    return p.select(F.col("p_partkey").alias("example_id"), trip.alias("tripleset"), ann.alias("annotations"))


@register("l13_linearize_dart", f"""
WITH l AS (SELECT p_partkey AS example_id,
                  p_name || ' : brand : ' || p_brand || ' | ' || p_name || ' : size : ' || CAST(p_size AS VARCHAR) AS src,
                  unnest([p_type, p_name || ' of ' || p_brand]) AS tgt, unnest([0, 1]) AS ann_idx FROM part)
SELECT example_id, ann_idx, src, tgt, ' ' || src || ' {BOS} ' || tgt || ' {EOS} ' AS sent FROM l
""")
def l13_linearize_dart(spark, sf_dir):
    d = L.linearize_dart(dart_examples(spark, sf_dir), BOS, EOS)
    return d.select("example_id", "ann_idx", "src", "tgt", "sent")


@register("l14_pad_batch", f"""
WITH {SQL_E2E},
x AS (SELECT p_partkey, input_ids, sep_id, (row_number() OVER (ORDER BY p_partkey) - 1) // 8 AS batch FROM ids, sep),
y AS (SELECT p_partkey, batch, input_ids[list_position(input_ids, sep_id) :] AS tgt_ids FROM x),
z AS (SELECT *, max(len(tgt_ids)) OVER (PARTITION BY batch) AS m FROM y)
SELECT p_partkey, CAST(batch AS BIGINT) AS batch,
       list_concat(tgt_ids, list_transform(range(m - len(tgt_ids)), lambda i: 0)) AS b_input_ids,
       list_transform(list_concat(tgt_ids, list_transform(range(m - len(tgt_ids)), lambda i: 0)),
                      lambda v: CASE WHEN v = 0 THEN -100 ELSE v END) AS b_labels
FROM z
""")
def l14_pad_batch(spark, sf_dir):
    """nopeek mode: the target is the input and the labels; batches of 8 lines."""
    from veil.functions.ranking import positions
    d = _e2e_ids(spark, sf_dir)
    src, tgt = L.split_at_separator("input_ids", F.col("sep_id"))
    d = d.select("p_partkey", src.alias("src_ids"), tgt.alias("tgt_ids"))
    d = positions(d, [], ["p_partkey"], out="__r").withColumn("batch", F.floor(F.col("__r") / 8).cast("long"))
    out = L.pad_batch(d, "batch", "nopeek")
    return out.select("p_partkey", "batch", "b_input_ids", "b_labels")


@register("l14_pad_batch_modes", f"""
WITH {SQL_E2E},
x AS (SELECT p_partkey, input_ids, sep_id, (row_number() OVER (ORDER BY p_partkey) - 1) // 8 AS batch FROM ids, sep),
y AS (SELECT p_partkey, batch, input_ids, input_ids[: list_position(input_ids, sep_id) - 1] AS src_ids,
             input_ids[list_position(input_ids, sep_id) :] AS tgt_ids, input_ids[: p_partkey % 3 + 1] AS cat_ids FROM x),
m AS (SELECT mode, p_partkey, batch, CASE WHEN mode IN ('peek', 'cat') THEN input_ids ELSE tgt_ids END AS a,
             CASE WHEN mode = 'cat' THEN cat_ids ELSE src_ids END AS s, CASE WHEN mode = 'infix' THEN cat_ids ELSE NULL END AS c
      FROM y, (SELECT unnest(['peek', 'nopeek', 'cat', 'infix']) AS mode)),
w AS (SELECT *, max(len(a)) OVER v AS ma, max(len(s)) OVER v AS ms, max(len(c)) OVER v AS mc FROM m
      WINDOW v AS (PARTITION BY mode, batch)),
p AS (SELECT mode, p_partkey, list_concat(a, list_transform(range(ma - len(a)), lambda i: 0)) AS b_input_ids,
             list_concat(s, list_transform(range(ms - len(s)), lambda i: 0)) AS b_src,
             CASE WHEN c IS NOT NULL THEN list_concat(c, list_transform(range(mc - len(c)), lambda i: 0)) END AS b_cate FROM w)
SELECT *, list_transform(b_input_ids, lambda v: CASE WHEN v = 0 THEN -100 ELSE v END) AS b_labels FROM p
""")
def l14_pad_batch_modes(spark, sf_dir):
    """All four modes on the same batches of 8 lines (labels are the input ids here)."""
    from veil.functions.ranking import positions
    d = _e2e_ids(spark, sf_dir)
    src, tgt = L.split_at_separator("input_ids", F.col("sep_id"))
    d = d.select("p_partkey", "input_ids", F.col("input_ids").alias("labels"), src.alias("src_ids"), tgt.alias("tgt_ids"),
                 F.slice("input_ids", 1, (F.col("p_partkey") % 3 + 1).cast("int")).alias("cat_ids"))
    d = positions(d, [], ["p_partkey"], out="__r").withColumn("batch", F.floor(F.col("__r") / 8).cast("long"))
    out = None
    for mode in L.PAD_COLUMNS:
        p = L.pad_batch(d, "batch", mode)
        cate = F.col("b_cate") if "b_cate" in p.columns else F.lit(None).cast(p.schema["b_src"].dataType)
        p = p.select(F.lit(mode).alias("mode"), "p_partkey", "b_input_ids", "b_src", cate.alias("b_cate"), "b_labels")
        out = p if out is None else out.unionByName(p)
    return out


@register("l15_mlm_mask")
def l15_mlm_mask(spark, sf_dir):
    d = _e2e_ids(spark, sf_dir)
    inp, lab = L.mlm_mask("input_ids", 0, "p_partkey", [], mask_id=-1, vocab_size=1000)
    return d.select("p_partkey", inp.alias("input_ids"), lab.alias("labels"))


@register("l16_prompt_from_labels", f"""
WITH {SQL_E2E},
x AS (SELECT p_partkey, input_ids AS ids,
             list_transform(input_ids, lambda v, i: CASE WHEN i <= list_position(input_ids, sep_id) THEN -100 ELSE v END) AS labels
      FROM ids, sep)
SELECT p_partkey, ids[1 : list_position(list_transform(labels, lambda v: v <> -100), true) - 1] AS prompt FROM x
""")
def l16_prompt_from_labels(spark, sf_dir):
    d = _e2e_ids(spark, sf_dir).withColumn("labels", L.mask_source_labels("input_ids", F.col("sep_id")))
    return d.select("p_partkey", L.prompt_from_labels("input_ids", "labels").alias("prompt"))


@register("l17_cap_generations", """
WITH g AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'eval' WHEN doc_id % 10 = 1 THEN 'valid' ELSE 'train' END AS split
           FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY doc_id) - 1 AS rn FROM g)
SELECT split, doc_id FROM r
WHERE rn < CASE split WHEN 'train' THEN 50 WHEN 'valid' THEN 20 WHEN 'eval' THEN 30 END
""")
def l17_cap_generations(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id")
    m = F.col("doc_id") % 10
    d = d.withColumn("split", F.when(m == 0, "eval").when(m == 1, "valid").otherwise("train"))
    return L.cap_generations(d, "split", "doc_id", {"train": 50, "valid": 20, "eval": 30}).select("split", "doc_id")
