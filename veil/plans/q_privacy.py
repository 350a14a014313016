"""Registered privacy queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from veil.operators import factor_norms as FN
from veil.operators import privacy as P
from veil.plans import sqlfrag as S
from veil.plans.registry import register
from veil.plans.tables import SQL_TURNS, read, turns

C = 0.5          # clipping norm: embeddings are unit-norm, so clipping acts
DELTA = 1e-5
INT_ORDERS = list(range(2, 64))


def _emb(spark, sf_dir):
    return read(spark, sf_dir, "embeddings")


SQL_NORM = "sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x)))"
SQL_COEF = f"least(1.0, {C} / ({SQL_NORM} + 1e-6))"


@register("p1_clip_coef", f"SELECT vec_id, round({SQL_COEF}, 6) AS coef FROM embeddings")
def p1_clip_coef(spark, sf_dir):
    return _emb(spark, sf_dir).select("vec_id", F.round(P.clip_coef("embedding", C), 6).alias("coef"))


SQL_CLIPPED_SUM = f"""
SELECT CAST(i - 1 AS INTEGER) AS pos, sum(CAST(embedding[i] AS DOUBLE) * coef) AS value
FROM (SELECT embedding, {SQL_COEF} AS coef, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)
GROUP BY i"""


@register("p2_dp_clipped_sum", f"""
SELECT pos, round(value / (SELECT count(*) FROM embeddings), 6) AS value FROM ({SQL_CLIPPED_SUM})
""")
def p2_dp_clipped_sum(spark, sf_dir):
    """σ = 0: the clipped mean of all examples (the noise-free, checkable form)."""
    e = _emb(spark, sf_dir)
    n = e.count()
    s = P.dp_clipped_sum(e, "embedding", C, 0.0, n)
    return s.select("pos", F.round("value", 6).alias("value"))


@register("p2_dp_clipped_sum_noised")
def p2_dp_clipped_sum_noised(spark, sf_dir):
    e = _emb(spark, sf_dir)
    return P.dp_clipped_sum(e, "embedding", C, 1.0, 256, seed=0)


@register("p3_clip_stats", f"""
SELECT label, round(max({SQL_COEF}), 6) AS coef_max, round(min({SQL_COEF}), 6) AS coef_min,
       round(quantile_disc({SQL_COEF}, 0.5), 6) AS coef_median
FROM embeddings GROUP BY label
""")
def p3_clip_stats(spark, sf_dir):
    s = P.clip_stats(_emb(spark, sf_dir), "embedding", C, ["label"])
    return s.select("label", *[F.round(c, 6).alias(c) for c in ("coef_max", "coef_min", "coef_median")])


@register("p4_noise_stats", f"""
SELECT round(sqrt(sum(value * value)), 6) AS signal, round(sqrt(count(*)) * 1.0 * {C}, 6) AS noise_limit
FROM ({SQL_CLIPPED_SUM})
""")
def p4_noise_stats(spark, sf_dir):
    e = _emb(spark, sf_dir)
    sums = P.clipped_sum_long(e, "embedding", C)
    noised = P.add_step_noise(sums.withColumn("step", F.lit(0)), 1.0, C, seed=0).drop("step")
    st = P.noise_stats(sums, noised, 1.0, C)
    return st.select(F.round("signal", 6).alias("signal"), F.round("noise_limit", 6).alias("noise_limit"))


@register("p4_noise_stats_full")
def p4_noise_stats_full(spark, sf_dir):
    e = _emb(spark, sf_dir)
    sums = P.clipped_sum_long(e, "embedding", C)
    noised = P.add_step_noise(sums.withColumn("step", F.lit(0)), 1.0, C, seed=0).drop("step")
    return P.noise_stats(sums, noised, 1.0, C)


@register("p5_accumulate_microbatches", f"""
SELECT CAST(floor(mb / 4) AS BIGINT) AS step, CAST(i - 1 AS INTEGER) AS pos,
       round(sum(CAST(embedding[i] AS DOUBLE) * coef), 6) AS value
FROM (SELECT vec_id // 50 AS mb, embedding, {SQL_COEF} AS coef, unnest(range(1, len(embedding) + 1)) AS i
      FROM embeddings)
GROUP BY floor(mb / 4), i
""")
def p5_accumulate_microbatches(spark, sf_dir):
    """Micro-batches of 50 examples, 4 accumulated per logical step."""
    e = _emb(spark, sf_dir).withColumn("mb", F.floor(F.col("vec_id") / 50))
    a = P.accumulate_microbatches(e, "embedding", "mb", 4, C)
    return a.select(F.col("step").cast("long").alias("step"), "pos", F.round("value", 6).alias("value"))


@register("p6_factor_norms", """
WITH t AS (SELECT vec_id // 4 AS example, label AS tok, CAST(embedding[1:32] AS DOUBLE[]) AS a,
                  CAST(embedding[33:64] AS DOUBLE[]) AS b FROM embeddings),
w AS (SELECT example, sqrt(sum(s * s)) AS weight_norm
      FROM (SELECT example, bi, ai, sum(b[bi] * a[ai]) AS s
            FROM (SELECT example, a, b, unnest(range(1, 33)) AS bi FROM t), LATERAL (SELECT unnest(range(1, 33)) AS ai)
            GROUP BY example, bi, ai) GROUP BY example),
bi AS (SELECT example, sqrt(sum(s * s)) AS bias_norm
       FROM (SELECT example, i, sum(b[i]) AS s FROM (SELECT example, b, unnest(range(1, 33)) AS i FROM t)
             GROUP BY example, i) GROUP BY example),
em AS (SELECT example, sqrt(sum(s * s)) AS embedding_norm
       FROM (SELECT example, tok, i, sum(b[i]) AS s FROM (SELECT example, tok, b, unnest(range(1, 33)) AS i FROM t)
             WHERE tok <> 0 GROUP BY example, tok, i) GROUP BY example)
SELECT example, round(weight_norm, 6) AS weight_norm, round(bias_norm, 6) AS bias_norm,
       round(embedding_norm, 6) AS embedding_norm
FROM w JOIN bi USING (example) LEFT JOIN em USING (example)
""")
def p6_factor_norms(spark, sf_dir):
    """Per-example gradient norms of a linear layer from activations (first 32
    coordinates) and back-props (last 32) over sequences of 4 rows; token ids
    = label with 0 as the pad id for the embedding-layer norm."""
    e = _emb(spark, sf_dir).select((F.floor(F.col("vec_id") / 4)).cast("long").alias("example"),
                                   F.col("label").alias("tok"), F.slice("embedding", 1, 32).alias("a"),
                                   F.slice("embedding", 33, 32).alias("b"))
    w = P.linear_grad_norms(e, "example", "a", "b")
    b = P.bias_grad_norms(e, "example", "b")
    em = P.embedding_grad_norms(e, "example", "tok", "b", pad_id=0)
    out = w.join(b, "example").join(em, "example", "left")
    return out.select("example", *[F.round(c, 6).alias(c) for c in ("weight_norm", "bias_norm", "embedding_norm")])


# Sequences of unequal length: the k-th holds the rows k² .. (k + 1)² - 1, so the
# short ones take the Gram form and the long ones the direct form.
def _sequences(spark, sf_dir):
    k = F.floor(F.sqrt(F.col("vec_id").cast("double")))
    return _emb(spark, sf_dir).select(k.cast("long").alias("example"), (F.col("vec_id") - k * k).cast("long").alias("t"),
                                      F.slice("embedding", 1, 32).alias("a"), F.slice("embedding", 33, 32).alias("b"))


SQL_SEQUENCE_NORMS = """
WITH t AS (SELECT CAST(floor(sqrt(vec_id)) AS BIGINT) AS example, CAST(embedding[1:32] AS DOUBLE[]) AS a,
                  CAST(embedding[33:64] AS DOUBLE[]) AS b FROM embeddings)
SELECT example, round(sqrt(sum(s * s)), 6) AS weight_norm
FROM (SELECT example, bi, ai, sum(b[bi] * a[ai]) AS s
      FROM (SELECT example, a, b, unnest(range(1, 33)) AS bi FROM t), LATERAL (SELECT unnest(range(1, 33)) AS ai)
      GROUP BY example, bi, ai) GROUP BY example"""


def _register_norms(form: str):
    @register(f"p6_weight_norms_{form}", SQL_SEQUENCE_NORMS)
    def query(spark, sf_dir):
        norms = FN.factor_norms(_sequences(spark, sf_dir), "example", "a", "b", form, pos_col="t")
        return norms.select("example", F.round("weight_norm", 6).alias("weight_norm"))
    query.__doc__ = f"Per-example weight gradient norms of unequal sequences, form: {form}."
    return query


p6_weight_norms_auto, p6_weight_norms_gram, p6_weight_norms_direct = map(_register_norms, ("auto", "gram", "direct"))


@register("p6_weight_norms_product", """
SELECT vec_id, round(sqrt(list_sum(list_transform(CAST(embedding[1:32] AS DOUBLE[]), lambda x: x * x)))
                     * sqrt(list_sum(list_transform(CAST(embedding[33:64] AS DOUBLE[]), lambda x: x * x))), 6) AS weight_norm
FROM embeddings
""")
def p6_weight_norms_product(spark, sf_dir):
    """One position per example: the product of both norms, without a shuffle."""
    e = _emb(spark, sf_dir).select("vec_id", F.slice("embedding", 1, 32).alias("a"), F.slice("embedding", 33, 32).alias("b"))
    return FN.product_norms(e, "vec_id", "a", "b").select("vec_id", F.round("weight_norm", 6).alias("weight_norm"))


def ledger(spark, sf_dir):
    """Per day and event type: q = share of the day's events, σ = 1, steps = count."""
    ev = read(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), "event_type")
    per = ev.groupBy("day", "event_type").agg(F.count(F.lit(1)).alias("steps"))
    tot = ev.groupBy("day").agg(F.count(F.lit(1)).alias("__tot"))
    return per.join(tot, "day").select(F.col("event_type").alias("run"), "day",
                                       (F.col("steps") / F.col("__tot")).alias("q"),
                                       F.lit(1.0).alias("sigma"), "steps")


SQL_LEDGER = """
(SELECT event_type AS run, day, steps / tot AS q, 1.0 AS sigma, steps
 FROM (SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS steps FROM events GROUP BY ALL)
 JOIN (SELECT CAST(ts AS DATE) AS day, count(*) AS tot FROM events GROUP BY ALL) USING (day))"""

SQL_RDP_INT = f"""
rdp_terms AS (
  SELECT run, day, q, sigma, steps, a, t, max(t) OVER (PARTITION BY run, day, a) AS mx
  FROM (SELECT run, day, q, sigma, steps, a,
               lgamma(a + 1) - lgamma(i + 1) - lgamma(a - i + 1) + i * ln(q) + (a - i) * ln(1 - q)
               + (i * i - i) / (2 * sigma * sigma) AS t
        FROM {SQL_LEDGER}, (SELECT unnest(range(2, 64)) AS a), LATERAL (SELECT unnest(range(0, a + 1)) AS i))),
rdp_agg AS (SELECT run, day, q, sigma, steps, a, any_value(mx) + ln(sum(exp(t - mx))) AS loga
            FROM rdp_terms GROUP BY run, day, q, sigma, steps, a),
rdp AS (
  SELECT run, day, a AS "order",
         CASE WHEN q = 0 THEN 0.0 WHEN sigma = 0 THEN 'inf'::DOUBLE WHEN q = 1 THEN a / (2 * sigma * sigma)
              ELSE loga / (a - 1) END * steps AS rdp
  FROM rdp_agg)"""


@register("p7_rdp_integer_orders", f"""
WITH {SQL_RDP_INT}
SELECT run, day, CAST("order" AS INTEGER) AS "order", round(rdp, 6) AS rdp FROM rdp
""")
def p7_rdp_integer_orders(spark, sf_dir):
    r = P.rdp_integer_orders(ledger(spark, sf_dir), INT_ORDERS)
    return r.select("run", "day", F.col("order").cast("int").alias("order"), F.round("rdp", 6).alias("rdp"))


@register("p7_rdp_all_orders")
def p7_rdp_all_orders(spark, sf_dir):
    """All 151 default orders; fractional ones through the vectorised UDF."""
    return P.rdp(ledger(spark, sf_dir))


@register("p8_compose", f"""
WITH {SQL_RDP_INT}
SELECT run, CAST("order" AS INTEGER) AS "order", round(sum(rdp), 6) AS rdp FROM rdp GROUP BY run, "order"
""")
def p8_compose(spark, sf_dir):
    c = P.compose(P.rdp_integer_orders(ledger(spark, sf_dir), INT_ORDERS))
    return c.select("run", F.col("order").cast("int").alias("order"), F.round("rdp", 6).alias("rdp"))


@register("p9_epsilon", f"""
WITH {SQL_RDP_INT},
c AS (SELECT run, "order" AS a, sum(rdp) AS r FROM rdp GROUP BY run, "order"),
e AS (SELECT run, a, CASE WHEN {DELTA} * {DELTA} + (exp(-r) - 1) >= 0 THEN 0.0
                          WHEN a > 1.01 THEN r + ln(1 - 1.0 / a) - ln({DELTA} * a) / (a - 1)
                          ELSE 'inf'::DOUBLE END AS eps FROM c)
SELECT run, round(greatest(min(eps), 0.0), 6) AS epsilon, CAST(arg_min(a, (eps, a)) AS INTEGER) AS opt_order
FROM e GROUP BY run
""")
def p9_epsilon(spark, sf_dir):
    c = P.compose(P.rdp_integer_orders(ledger(spark, sf_dir), INT_ORDERS))
    e = P.epsilon(c, DELTA)
    return e.select("run", F.round("epsilon", 6).alias("epsilon"), F.col("opt_order").cast("int").alias("opt_order"))


@register("p9_epsilon_all_orders")
def p9_epsilon_all_orders(spark, sf_dir):
    return P.epsilon(P.compose(P.rdp(ledger(spark, sf_dir))), DELTA)


def _settings(spark, sf_dir):
    ev = read(spark, sf_dir, "events")
    return ev.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).select(
        "event_type", "n", F.lit(64).alias("batch_size"), F.lit(3).alias("epochs"), F.lit(1.0).alias("sigma"))


@register("p10_privacy_params", """
SELECT event_type, n, round(64.0 / n, 6) AS q, round(pow(n::DOUBLE, -1.1), 12) AS delta,
       CAST(ceil(3 / (64.0 / n)) AS BIGINT) AS steps, round(1.0 / 64, 6) AS effective_sigma
FROM (SELECT event_type, count(*) AS n FROM events GROUP BY event_type)
""")
def p10_privacy_params(spark, sf_dir):
    p = P.privacy_params(_settings(spark, sf_dir))
    return p.select("event_type", "n", F.round("q", 6).alias("q"), F.round("delta", 12).alias("delta"),
                    F.col("steps").cast("long").alias("steps"), F.round("effective_sigma", 6).alias("effective_sigma"))


@register("p11_sigma_for")
def p11_sigma_for(spark, sf_dir):
    p = P.privacy_params(_settings(spark, sf_dir))
    s = p.select(F.col("event_type").alias("setting"), F.lit(8.0).alias("epsilon"), F.lit(DELTA).alias("delta"),
                 "q", "steps")
    return P.sigma_for(s)


@register("p12_per_step_budget", f"""
WITH RECURSIVE s AS (SELECT event_type, floor(count(*) / 100)::DOUBLE AS t FROM events GROUP BY event_type),
b AS (SELECT event_type, t, {DELTA} / (t + 1) AS d, 1e-6::DOUBLE AS lo, 5.0::DOUBLE AS hi FROM s
      UNION ALL
      SELECT event_type, t, d, CASE WHEN big THEN lo ELSE mid END, CASE WHEN big THEN mid ELSE hi END
      FROM (SELECT *, mid * (sqrt(-2 * t * ln(d)) + t * (exp(mid) - 1)) > 1.0 AS big
            FROM (SELECT *, (lo + hi) / 2 AS mid FROM b WHERE hi - lo > 1e-4)))
SELECT event_type, round(lo, 6) AS per_step_epsilon, round(d, 12) AS per_step_delta FROM b WHERE hi - lo <= 1e-4
""")
def p12_per_step_budget(spark, sf_dir):
    ev = read(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    b = ev.select("event_type", P.per_step_budget_udf(F.lit(1.0), F.lit(DELTA),
                                                      F.floor(F.col("n") / 100).cast("long")).alias("b"))
    return b.select("event_type", F.round("b.per_step_epsilon", 6).alias("per_step_epsilon"),
                    F.round("b.per_step_delta", 12).alias("per_step_delta"))


@register("p13_gaussian_variance", f"""
SELECT event_type, round(2 * ln(1.25 / {DELTA}) * (max(value) / 100) * (max(value) / 100) / (1.0 * 1.0), 9) AS variance
FROM events GROUP BY event_type
""")
def p13_gaussian_variance(spark, sf_dir):
    ev = read(spark, sf_dir, "events").groupBy("event_type").agg((F.max("value") / 100).alias("sens"))
    return ev.select("event_type", F.round(P.gaussian_variance(F.lit(DELTA), "sens", F.lit(1.0)), 9).alias("variance"))


@register("p14_dp_geometric_median")
def p14_dp_geometric_median(spark, sf_dir):
    """Train β on the 4/5 of embeddings with vec_id % 5 ≠ 0, test on the rest."""
    e = _emb(spark, sf_dir)
    tr, te = e.where(F.col("vec_id") % 5 != 0), e.where(F.col("vec_id") % 5 == 0)
    res = P.dp_geometric_median(tr, te, "embedding", steps=10, lr=0.5, epsilon=8.0, delta=DELTA)
    return spark.createDataFrame([(float(res["train_loss"]), float(res["test_loss"]),
                                   float(res["per_step_epsilon"]), [float(x) for x in res["beta"]])],
                                 "train_loss double, test_loss double, per_step_epsilon double, beta array<double>")


@register("p15_dp_linear_probe")
def p15_dp_linear_probe(spark, sf_dir):
    e = _emb(spark, sf_dir).select(F.col("vec_id").alias("id"), "embedding", "label")
    res = P.dp_linear_probe(e, "embedding", "label", 10, max_norm=1.0, sigma=1.0, epochs=1, batch_size=256,
                            lr=0.5, seed=0, key_col="id")
    return spark.createDataFrame([(i, float(l)) for i, l in enumerate(res["losses"])], "step int, train_loss double")


@register("p16_redaction_schedule", """
WITH s AS (SELECT event_id AS step, (SELECT count(*) FROM events)::DOUBLE AS T FROM events)
SELECT step, round(floor((T - step) / T * 10.0) / 10.0, 6) AS p_step, round((T - step) / T, 6) AS p_linear,
       round(1.0 - exp(2.0 / T * (step + 1 - T)), 6) AS p_exp_concave, round(exp(-0.001 * step), 6) AS p_exp_convex
FROM s
""")
def p16_redaction_schedule(spark, sf_dir):
    ev = read(spark, sf_dir, "events")
    T = ev.count()
    s = ev.select(F.col("event_id").alias("step"))
    return s.select("step", F.round(P.redaction_schedule("step", "step", T), 6).alias("p_step"),
                    F.round(P.redaction_schedule("step", "linear", T), 6).alias("p_linear"),
                    F.round(P.redaction_schedule("step", "exp_concave", T, 2.0), 6).alias("p_exp_concave"),
                    F.round(P.redaction_schedule("step", "exp_convex", T, 0.001), 6).alias("p_exp_convex"))


@register("p17_mix_batches", f"""
WITH s AS (SELECT event_id AS step, (SELECT count(*) FROM events)::DOUBLE AS T FROM events),
nb AS (SELECT CAST(ceil(count(*) / 16.0) AS BIGINT) AS n, CAST(ceil(count(*) / 24.0) AS BIGINT) AS p FROM conversations)
SELECT step, ((T - step) / T) > 0 AND {S.hash_uniform(0, 'step')} < (T - step) / T AS redacted,
       CAST(step % (SELECT n FROM nb) AS BIGINT) AS private_batch, CAST(step % (SELECT p FROM nb) AS BIGINT) AS public_batch
FROM s
""")
def p17_mix_batches(spark, sf_dir):
    """Steps = events; the private stream has batches of 16 turns, the public one of 24."""
    ev = read(spark, sf_dir, "events")
    T = ev.count()
    turns_n = read(spark, sf_dir, "conversations").count()
    m = P.mix_batches(ev.select(F.col("event_id").alias("step")), math.ceil(turns_n / 24), math.ceil(turns_n / 16),
                      "linear", T, seed=0)
    return m.select("step", ((F.col("p") > 0) & F.col("redacted")).alias("redacted"),
                    F.col("private_batch").cast("long").alias("private_batch"),
                    F.col("public_batch").cast("long").alias("public_batch"))


@register("p18_assign_batches", f"""
SELECT conversation_id, turn,
       CAST(floor((row_number() OVER (ORDER BY {S.hash_key(7, "conversation_id || ':' || CAST(turn AS VARCHAR)")},
                                       conversation_id || ':' || CAST(turn AS VARCHAR)) - 1) / 16) AS BIGINT) AS batch
FROM ({SQL_TURNS})
""")
def p18_assign_batches(spark, sf_dir):
    t = turns(spark, sf_dir).withColumn("key", F.concat_ws(":", "conversation_id", F.col("turn").cast("string")))
    b = P.assign_batches(t, 16, 7, "key")
    return b.select("conversation_id", "turn", F.col("batch").cast("long").alias("batch"))


SQL_POISSON = """
WITH RECURSIVE n AS (SELECT ln(1 - 64.0 / count(*)) AS scale FROM conversations),
k AS (SELECT conversation_id, turn, conversation_id || ':' || CAST(turn AS VARCHAR) AS key FROM (%s)),
d(conversation_id, turn, key, j, step) AS (
  SELECT conversation_id, turn, key, 0, CAST(floor(ln((CAST('0x' || substr(md5('7:' || key || ':0'), 1, 13) AS BIGINT) + 1e0)
         / 4503599627370496e0) / scale) AS BIGINT) FROM k, n
  UNION ALL
  SELECT conversation_id, turn, key, j + 1, step + 1 + CAST(floor(ln((CAST('0x' || substr(md5('7:' || key || ':' || (j + 1)), 1, 13) AS BIGINT)
         + 1e0) / 4503599627370496e0) / scale) AS BIGINT) FROM d, n WHERE step < 40)
SELECT conversation_id, turn, step AS batch FROM d WHERE step < 40
""" % SQL_TURNS


@register("p18_poisson_batches", SQL_POISSON)
def p18_poisson_batches(spark, sf_dir):
    """Forty Poisson-sampled batches of 64 expected turns."""
    t = turns(spark, sf_dir).withColumn("key", F.concat_ws(":", "conversation_id", F.col("turn").cast("string")))
    return P.poisson_batches(t, "key", 64.0 / t.count(), 40, 7).select("conversation_id", "turn", "batch")


@register("p17_mixed_batch_rows", f"""
WITH t AS (SELECT conversation_id || ':' || CAST(turn AS VARCHAR) AS item FROM ({SQL_TURNS})),
priv AS (SELECT item, (row_number() OVER (ORDER BY {S.hash_key(7, "item")}, item) - 1) // 16 AS batch FROM t),
pub AS (SELECT item, (row_number() OVER (ORDER BY {S.hash_key(8, "item")}, item) - 1) // 24 AS batch FROM t),
s AS (SELECT event_id AS step, (SELECT count(*) FROM events)::DOUBLE AS T FROM events),
m AS (SELECT step, ((T - step) / T) > 0 AND {S.hash_uniform(0, 'step')} < (T - step) / T AS redacted,
             step % (SELECT max(batch) + 1 FROM priv) AS pb, step % (SELECT max(batch) + 1 FROM pub) AS ub FROM s)
SELECT step, redacted, CAST(batch AS BIGINT) AS batch, item FROM m JOIN pub ON redacted AND pub.batch = m.ub
UNION ALL
SELECT step, redacted, CAST(batch AS BIGINT) AS batch, item FROM m JOIN priv ON NOT redacted AND priv.batch = m.pb
""")
def p17_mixed_batch_rows(spark, sf_dir):
    """The turns of every step's batch: 16 private or 24 public ones, both streams cyclic."""
    ev = read(spark, sf_dir, "events")
    t = turns(spark, sf_dir).select(F.concat_ws(":", "conversation_id", F.col("turn").cast("string")).alias("item"))
    n = t.count()
    m = P.mix_batches(ev.select(F.col("event_id").alias("step")), math.ceil(n / 24), math.ceil(n / 16), "linear",
                      ev.count(), seed=0).withColumn("redacted", (F.col("p") > 0) & F.col("redacted"))
    rows = P.mixed_batch_rows(m, P.assign_batches(t, 16, 7, "item"), P.assign_batches(t, 24, 8, "item"))
    return rows.select("step", "redacted", "batch", "item")


@register("p19_lr_schedule", """
WITH s AS (SELECT event_id AS step, (SELECT count(*) FROM events) AS T FROM events)
SELECT step, round(0.001 * CASE WHEN step < 100 THEN step / 100.0 ELSE greatest(0.0, (T - step) / (T - 100.0)) END, 9) AS lr
FROM s
""")
def p19_lr_schedule(spark, sf_dir):
    ev = read(spark, sf_dir, "events")
    T = ev.count()
    return ev.select(F.col("event_id").alias("step"),
                     F.round(P.lr_schedule(F.col("event_id"), 0.001, 100, T), 9).alias("lr"))
