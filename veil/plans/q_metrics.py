"""Registered metric queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from veil.functions import arrays as AR
from veil.functions import text as T
from veil.operators import attack as A
from veil.operators import dialogue as D
from veil.operators import metrics as M
from veil.plans import sqlfrag as S
from veil.plans.q_attack import SQL_GENS, generations, target_lm
from veil.plans.registry import register
from veil.plans.tables import SQL_TURNS, read, turns

SQL_TLM = S.lm_ctes("tlm", "SELECT text FROM documents")


def _gen_tokens(spark, sf_dir):
    """Token log-probs of prompt + gen; prompt positions carry label −100."""
    g = generations(spark, sf_dir).where(F.length("gen") > 0)
    g = g.select("gen_id", F.concat("prompt", F.lit(" "), "gen").alias("t"),
                 F.size(T.tokens("prompt")).alias("n_prompt"))
    lp = A.token_logprobs(g, target_lm(spark, sf_dir), "t", ["gen_id"])
    return lp.join(g.select("gen_id", "n_prompt"), "gen_id").select(
        "gen_id", "pos", "logprob", (-F.col("logprob")).alias("nll"),
        F.when(F.col("pos") <= F.col("n_prompt"), F.lit(M.IGNORE_INDEX)).otherwise(F.col("pos")).alias("label"))


SQL_GEN_TOKENS = f"""
{SQL_GENS}, {SQL_TLM},
gt AS (SELECT gen_id AS key, prompt || ' ' || gen AS t, len({S.tokens('prompt')}) AS n_prompt
       FROM gens WHERE length(gen) > 0),
gbg AS (SELECT key, i AS pos, n_prompt, toks[i - 1] AS prev, toks[i] AS tok
        FROM (SELECT key, n_prompt, toks, unnest(range(2, len(toks) + 1)) AS i
              FROM (SELECT key, n_prompt, {S.tokens('t')} AS toks FROM gt))),
tokl AS (SELECT b.key AS gen_id, b.pos,
                ln(coalesce(p.c_pair, 0) + 1.0) - ln(coalesce(c.c_ctx, 0) + 1.0 * v.V) AS logprob,
                CASE WHEN b.pos <= b.n_prompt THEN -100 ELSE b.pos END AS label
         FROM gbg b LEFT JOIN tlm_pair p ON p.prev = b.prev AND p.tok = b.tok
         LEFT JOIN tlm_ctx c ON c.prev = b.prev CROSS JOIN tlm_v v)"""


@register("m1_example_loss", f"""
WITH {SQL_GEN_TOKENS}
SELECT gen_id, round(sum(CASE WHEN label <> -100 THEN -logprob END) / count(*) FILTER (WHERE label <> -100), 6) AS loss
FROM tokl GROUP BY gen_id
""")
def m1_example_loss(spark, sf_dir):
    l = M.example_loss(_gen_tokens(spark, sf_dir), ["gen_id"])
    return l.select("gen_id", F.round("loss", 6).alias("loss"))


# Sequences of four rows: ten logits a position, the label of some positions ignored.
SQL_SHIFTED = f"""
tok AS (SELECT vec_id // 4 AS seq, vec_id % 4 AS pos, CASE WHEN vec_id % 5 = 1 THEN -100 ELSE label END AS label,
               CAST(embedding[1:10] AS DOUBLE[]) AS logits FROM embeddings),
sh AS (SELECT seq, pos, lead(label) OVER (PARTITION BY seq ORDER BY pos) AS label, logits,
              lead(pos) OVER (PARTITION BY seq ORDER BY pos) AS nxt FROM tok),
lp AS (SELECT seq, pos, label, list_transform(logits, lambda x: x - list_max(logits)
              - ln(list_sum(list_transform(logits, lambda y: exp(y - list_max(logits)))))) AS lp
       FROM sh WHERE nxt IS NOT NULL)"""


def _shifted(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    tok = e.select(F.floor(F.col("vec_id") / 4).alias("seq"), (F.col("vec_id") % 4).alias("pos"),
                   F.when(F.col("vec_id") % 5 == 1, M.IGNORE_INDEX).otherwise(F.col("label")).cast("int").alias("label"),
                   F.slice("embedding", 1, 10).alias("logits"))
    return M.token_losses(tok, ["seq"], "logits")


@register("m1_shifted_loss", f"""
WITH {SQL_SHIFTED}
SELECT seq, round(sum(-lp[label + 1]) FILTER (WHERE label <> -100) / nullif(count(*) FILTER (WHERE label <> -100), 0), 6) AS loss
FROM lp GROUP BY seq
""")
def m1_shifted_loss(spark, sf_dir):
    """Per-example loss from logits, labels shifted by the operator; null where every label is ignored."""
    loss = M.example_loss(_shifted(spark, sf_dir), ["seq"])
    return loss.select("seq", F.round("loss", 6).alias("loss"))


@register("m3_valid_entropy", f"""
WITH {SQL_SHIFTED}
SELECT seq, round(avg(-list_sum(list_transform(lp, lambda x: exp(x) * x))) FILTER (WHERE label <> -100), 6) AS entropy,
       count(*) FILTER (WHERE label <> -100) AS n
FROM lp GROUP BY seq
""")
def m3_valid_entropy(spark, sf_dir):
    """Mean entropy over the positions whose shifted label is not ignored."""
    e = M.valid_entropy(_shifted(spark, sf_dir), ["seq"])
    return e.select("seq", F.round("entropy", 6).alias("entropy"), "n")


@register("m4_sequence_logprob", f"""
WITH {SQL_GEN_TOKENS}
SELECT gen_id, round(sum(CASE WHEN label <> -100 THEN logprob ELSE 0 END), 6) AS sequence_logprob,
       round(avg(CASE WHEN label <> -100 THEN logprob ELSE 0 END), 6) AS token_logprob,
       round(avg(CASE WHEN label <> -100 THEN logprob END), 6) AS token_logprob_valid
FROM tokl GROUP BY gen_id
""")
def m4_sequence_logprob(spark, sf_dir):
    s = M.sequence_logprob(_gen_tokens(spark, sf_dir), ["gen_id"])
    return s.select("gen_id", *[F.round(c, 6).alias(c) for c in
                                ("sequence_logprob", "token_logprob", "token_logprob_valid")])


@register("m2_split_perplexity", f"""
WITH turns AS ({SQL_TURNS}), {SQL_TLM},
conv AS (SELECT domain, conversation_id,
                '<_soc_> ' || string_agg({S.format_turn(True)}, ' ' ORDER BY turn) || ' <_eoc_>' AS text
         FROM turns GROUP BY domain, conversation_id),
sp AS (SELECT *, CASE WHEN CAST(conversation_id AS BIGINT) % 10 = 0 THEN 'eval'
                      WHEN CAST(conversation_id AS BIGINT) % 10 = 1 THEN 'val' ELSE 'train' END AS split FROM conv),
bt AS (SELECT *, (row_number() OVER (PARTITION BY split ORDER BY conversation_id) - 1) // 8 AS batch FROM sp),
tb AS (SELECT split, batch, conversation_id, toks[i - 1] AS prev, toks[i] AS tok
       FROM (SELECT split, batch, conversation_id, toks, unnest(range(2, len(toks) + 1)) AS i
             FROM (SELECT split, batch, conversation_id, {S.tokens('text')} AS toks FROM bt))),
lp AS (SELECT split, batch, -(ln(coalesce(p.c_pair, 0) + 1.0) - ln(coalesce(c.c_ctx, 0) + 1.0 * v.V)) AS nll
       FROM tb b LEFT JOIN tlm_pair p ON p.prev = b.prev AND p.tok = b.tok
       LEFT JOIN tlm_ctx c ON c.prev = b.prev CROSS JOIN tlm_v v),
bl AS (SELECT split, batch, avg(nll) AS loss FROM lp GROUP BY split, batch),
bn AS (SELECT split, batch, count(*) AS n FROM bt GROUP BY split, batch)
SELECT split, round(exp(sum(loss * n) / sum(n)), 6) AS ppl FROM bl JOIN bn USING (split, batch) GROUP BY split
""")
def m2_split_perplexity(spark, sf_dir):
    """Conversations split by id (train/val/eval), batches of 8; ppl per split."""
    from veil.functions.ranking import positions
    conv = D.assemble_conversations(turns(spark, sf_dir))
    cid = F.col("conversation_id").cast("long") % 10
    conv = conv.withColumn("split", F.when(cid == 0, "eval").when(cid == 1, "val").otherwise("train"))
    conv = positions(conv, ["split"], ["conversation_id"], out="__r").withColumn("batch", F.floor(F.col("__r") / 8))
    lp = A.token_logprobs(conv, target_lm(spark, sf_dir), "text", ["split", "batch", "conversation_id"])
    bl = lp.groupBy("split", "batch").agg(F.avg(-F.col("logprob")).alias("loss"))
    bn = conv.groupBy("split", "batch").agg(F.count(F.lit(1)).alias("n"))
    r = M.split_perplexity(bl.join(bn, ["split", "batch"]))
    return r.select("split", F.round("ppl", 6).alias("ppl"))


def _logits(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    return e.select("vec_id", "label", F.slice("embedding", 1, 10).alias("logits"))


SQL_LSE = """(SELECT vec_id, label, logits, m + ln(list_sum(list_transform(logits, lambda x: exp(x - m)))) AS lse
              FROM (SELECT vec_id, label, CAST(embedding[1:10] AS DOUBLE[]) AS logits,
                           list_max(CAST(embedding[1:10] AS DOUBLE[])) AS m FROM embeddings))"""


@register("m3_token_entropy", f"""
SELECT label, round(avg(-list_sum(list_transform(logits, lambda x: exp(x - lse) * (x - lse)))), 6) AS entropy
FROM {SQL_LSE} GROUP BY label
""")
def m3_token_entropy(spark, sf_dir):
    return _logits(spark, sf_dir).groupBy("label").agg(
        F.round(F.avg(M.token_entropy("logits")), 6).alias("entropy"))


@register("m5_glue_metrics", """
WITH c AS (SELECT count(*) FILTER (WHERE toxic = 1 AND quality = 1)::DOUBLE AS tp,
                  count(*) FILTER (WHERE toxic = 0 AND quality = 0)::DOUBLE AS tn,
                  count(*) FILTER (WHERE toxic = 1 AND quality = 0)::DOUBLE AS fp,
                  count(*) FILTER (WHERE toxic = 0 AND quality = 1)::DOUBLE AS fn,
                  avg(CASE WHEN toxic = quality THEN 1.0 ELSE 0.0 END) AS acc FROM labels),
e AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings),
r AS (SELECT *, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx,
                rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM e)
SELECT round(acc, 6) AS acc,
       round(CASE WHEN tp = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END, 6) AS f1,
       round(CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) = 0 THEN 0
             ELSE (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) END, 6) AS mcc,
       (SELECT round(corr(x, y), 6) FROM e) AS pearson, (SELECT round(corr(rx, ry), 6) FROM r) AS spearman
FROM c
""")
def m5_glue_metrics(spark, sf_dir):
    b = M.binary_metrics(read(spark, sf_dir, "labels"), "toxic", "quality")
    e = read(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    ps = M.pearson_spearman(e, "x", "y", "vec_id")
    out = b.join(ps, how="inner")
    return out.select(*[F.round(c, 6).alias(c) for c in ("acc", "f1", "mcc", "pearson", "spearman")])


@register("m5_task_metrics", """
WITH c AS (SELECT count(*) FILTER (WHERE toxic = 1 AND quality = 1)::DOUBLE AS tp,
                  count(*) FILTER (WHERE toxic = 0 AND quality = 0)::DOUBLE AS tn,
                  count(*) FILTER (WHERE toxic = 1 AND quality = 0)::DOUBLE AS fp,
                  count(*) FILTER (WHERE toxic = 0 AND quality = 1)::DOUBLE AS fn,
                  avg(CASE WHEN toxic = quality THEN 1.0 ELSE 0.0 END) AS acc FROM labels),
b AS (SELECT acc, CASE WHEN tp = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f1,
             CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) = 0 THEN 0
             ELSE (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) END AS mcc FROM c),
e AS (SELECT CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings),
r AS (SELECT *, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx,
                rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM e),
s AS (SELECT corr(x, y) AS p, corr(rx, ry) AS s FROM r)
SELECT task, metric, round(value, 6) AS value FROM (
  SELECT 'cola' AS task, 'mcc' AS metric, mcc AS value FROM b UNION ALL SELECT 'sst-2', 'acc', acc FROM b
  UNION ALL SELECT 'mrpc', 'acc', acc FROM b UNION ALL SELECT 'mrpc', 'f1', f1 FROM b UNION ALL SELECT 'mrpc', 'acc_and_f1', (acc + f1) / 2 FROM b
  UNION ALL SELECT 'sts-b', 'pearson', p FROM s UNION ALL SELECT 'sts-b', 'spearmanr', s FROM s UNION ALL SELECT 'sts-b', 'corr', (p + s) / 2 FROM s)
""")
def m5_task_metrics(spark, sf_dir):
    """The task map: one task of each kind of metric."""
    lab = read(spark, sf_dir, "labels")
    e = read(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    out = M.task_metrics(e, "sts-b", "x", "y", "vec_id")
    for task in ("cola", "sst-2", "mrpc"):
        out = out.unionByName(M.task_metrics(lab, task, "toxic", "quality", "doc_id"))
    return out.withColumn("value", F.round("value", 6))


@register("m6_xent_and_zero_one", f"""
SELECT label, round(avg(-(logits[label + 1] - lse)), 6) AS xent,
       round(avg(CASE WHEN list_position(logits, list_max(logits)) - 1 <> label THEN 1.0 ELSE 0.0 END), 6) AS zero_one
FROM {SQL_LSE} GROUP BY label
""")
def m6_xent_and_zero_one(spark, sf_dir):
    r = M.xent_and_zero_one(_logits(spark, sf_dir), "logits", "label", ["label"])
    return r.select("label", F.round("xent", 6).alias("xent"), F.round("zero_one", 6).alias("zero_one"))


# events as a metric log: step = event_id, metric = event_type, value
RENAME = {"purchase": "f1", "signup": "mcc", "click": "pearson", "view": "acc", "error": "loss"}


@register("m7_dev_objective", """
WITH m AS (SELECT user_id,
                  avg(value) FILTER (WHERE event_type = 'purchase') AS f1,
                  avg(value) FILTER (WHERE event_type = 'signup') AS mcc,
                  avg(value) FILTER (WHERE event_type = 'click') AS pearson,
                  avg(value) FILTER (WHERE event_type = 'view') AS acc
           FROM events GROUP BY user_id)
SELECT user_id,
       CASE WHEN f1 IS NOT NULL THEN 'f1' WHEN mcc IS NOT NULL THEN 'mcc'
            WHEN pearson IS NOT NULL THEN 'pearson' WHEN acc IS NOT NULL THEN 'acc' END AS objective,
       round(coalesce(f1, mcc, pearson, acc), 6) AS value
FROM m
""")
def m7_dev_objective(spark, sf_dir):
    ev = read(spark, sf_dir, "events")
    name = F.element_at(F.create_map(*[F.lit(x) for kv in RENAME.items() for x in kv]), F.col("event_type"))
    per = ev.groupBy("user_id", name.alias("metric")).agg(F.avg("value").alias("v"))
    m = per.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("metric", "v"))).alias("metrics"))
    o = m.select("user_id", M.dev_objective("metrics", on_missing="null").alias("o"))
    return o.select("user_id", "o.objective", F.round("o.value", 6).alias("value"))


@register("m8_best_checkpoint", """
SELECT event_type, arg_max(event_id, (value, -event_id)) AS best_step, max(value) AS best_value
FROM events GROUP BY event_type
""")
def m8_best_checkpoint(spark, sf_dir):
    ev = read(spark, sf_dir, "events")
    return M.best_checkpoint(ev, ["event_type"], "event_id", "value")


def _metric_log(spark, sf_dir):
    ev = read(spark, sf_dir, "events")
    v = F.col("value")

    def split(off):
        return F.struct(F.struct((v + off).alias("ppl"), ((v + off) / 2).alias("eval_losses"),
                                 (v * 2).alias("lr")).alias("model"))
    return ev.select(F.col("event_id").alias("global_step"), split(0).alias("train"),
                     split(1).alias("val"), split(2).alias("eval"))


@register("m9_flatten_metrics", " UNION ALL ".join(
    f"SELECT event_id AS step, '{sp}' AS split, '{me}' AS metric, (value + {off}){f} AS value FROM events"
    for sp, off in (("train", 0), ("val", 1), ("eval", 2)) for me, f in (("ppl", ""), ("eval_losses", " / 2"))))
def m9_flatten_metrics(spark, sf_dir):
    """A nested metric log (one record per step) flattened to split × metric."""
    return M.flatten_metrics(_metric_log(spark, sf_dir))


@register("m10_grid_select", """
WITH runs AS (SELECT event_type AS mode, user_id % 4 AS dim, user_id % 5 AS setting, event_id % 3 AS seed,
                     avg(value) AS train_loss, max(value) AS test_loss
              FROM events GROUP BY ALL),
per AS (SELECT mode, dim, setting, avg(train_loss) AS train_mean, stddev_pop(train_loss) AS train_std,
               avg(test_loss) AS test_mean, stddev_pop(test_loss) AS test_std FROM runs GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY mode, dim ORDER BY train_mean, setting) AS rn FROM per)
SELECT mode, dim, setting, round(train_mean, 6) AS train_mean, round(train_std, 6) AS train_std,
       round(test_mean, 6) AS test_mean, round(test_std, 6) AS test_std FROM best WHERE rn = 1
""")
def m10_grid_select(spark, sf_dir):
    ev = read(spark, sf_dir, "events")
    runs = ev.groupBy(F.col("event_type").alias("mode"), (F.col("user_id") % 4).alias("dim"),
                      (F.col("user_id") % 5).alias("setting"), (F.col("event_id") % 3).alias("seed")).agg(
        F.avg("value").alias("train_loss"), F.max("value").alias("test_loss"))
    g = M.grid_select(runs, ["mode", "dim"], "setting")
    return g.select("mode", "dim", "setting", *[F.round(c, 6).alias(c) for c in
                                                ("train_mean", "train_std", "test_mean", "test_std")])


@register("m11_iterate_average", """
SELECT event_id, event_type,
       round(sum(value) OVER w, 2) AS running_sum, count(*) OVER w AS running_n,
       round(round(sum(value) OVER w, 2) / count(*) OVER w, 9) AS average
FROM events
WINDOW w AS (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
""")
def m11_iterate_average(spark, sf_dir):
    """Running mean per metric, with its parts (values carry two decimals, so the
    running sum is exact at 1e-2; the mean is taken from it where the operator's
    own agrees, since a rounded mean can sit on a rounding tie)."""
    ev = read(spark, sf_dir, "events").select("event_id", "event_type", "value")
    r = M.iterate_average(ev, ["event_type"], "event_id", "value")
    exact = F.round("running_sum", 2) / F.col("running_n")
    return r.select("event_id", "event_type", F.round("running_sum", 2).alias("running_sum"),
                    F.col("running_n").cast("long").alias("running_n"),
                    F.when(F.abs(F.col("running_avg") - exact) < 1e-9, F.round(exact, 9)).alias("average"))


@register("m12_windowed_loss", """
SELECT max(event_id + 1) AS step, round(sum(value) / 100, 6) AS loss
FROM events GROUP BY ceil((event_id + 1) / 100) HAVING max(event_id + 1) = ceil((event_id + 1) / 100) * 100
""")
def m12_windowed_loss(spark, sf_dir):
    ev = read(spark, sf_dir, "events").select((F.col("event_id") + 1).alias("step"), "value")
    w = M.windowed_loss(ev, "step", "value", 100)
    return w.select("step", F.round("loss", 6).alias("loss"))
