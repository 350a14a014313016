"""Registered attack-chain queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from veil.operators import attack as A
from veil.operators import dialogue as D
from veil.operators import redaction as R
from veil.plans import q_redaction as QR
from veil.plans import sqlfrag as S
from veil.plans.registry import register
from veil.plans.tables import SQL_TURNS, read, turns
from veil.session import cut_lineage
from veil.sources import io

TARGETS = ["AIRLINE", "MEDIA"]
REF_SOURCES = [f"src{i}" for i in range(10)]


def target_lm(spark, sf_dir, asked=None):
    return A.fit_ngram_lm(read(spark, sf_dir, "documents"), "text", 1.0, asked)


def ref_lm(spark, sf_dir, asked=None):
    d = read(spark, sf_dir, "documents").where((F.col("lang") == "en") & F.col("source").isin(REF_SOURCES))
    return A.fit_ngram_lm(d, "text", 1.0, asked)


def generations(spark, sf_dir):
    """Prompts (D8, ≤10 per conversation) and the next turn as the generation;
    generations of conversations with ``conv_id % 7 = 0`` are empty (A8)."""
    t = turns(spark, sf_dir)
    p = D.build_prompts(t, 10)
    nxt = t.select("conversation_id", (F.col("turn") - 1).alias("prompt_idx"), F.col("utterance").alias("__u"))
    g = p.join(nxt, ["conversation_id", "prompt_idx"], "inner")
    gen = F.when(F.col("conversation_id").cast("long") % 7 == 0, F.lit("")).otherwise(F.coalesce("__u", F.lit("")))
    return g.select(F.concat_ws(":", "conversation_id", F.col("prompt_idx").cast("string")).alias("gen_id"),
                           "domain", "conversation_id", "prompt_idx", "prompt", gen.alias("gen"))


SQL_GENS = f"""
turns AS ({SQL_TURNS}),
prompts AS (
  SELECT domain, conversation_id, prompt_idx,
         '<_soc_> ' || array_to_string(so_far, ' ') || ' ' || '<' || domain || '> ' || {S.role_token('next_role')} AS prompt
  FROM (SELECT domain, conversation_id, row_number() OVER w - 1 AS prompt_idx, lead(role) OVER w AS next_role,
               list({S.format_turn(True)}) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS so_far
        FROM turns WINDOW w AS (PARTITION BY domain, conversation_id ORDER BY conversation_id, turn))
  WHERE next_role IS NOT NULL AND prompt_idx < 10),
gens AS (
  SELECT p.conversation_id || ':' || CAST(p.prompt_idx AS VARCHAR) AS gen_id, p.domain, p.conversation_id,
         p.prompt_idx, p.prompt,
         CASE WHEN CAST(p.conversation_id AS BIGINT) % 7 = 0 THEN '' ELSE coalesce(t.utterance, '') END AS gen
  FROM prompts p JOIN turns t ON t.conversation_id = p.conversation_id AND t.turn - 1 = p.prompt_idx)"""

SQL_LMS = (S.lm_ctes("tlm", "SELECT text FROM documents") + "," +
           S.lm_ctes("rlm", "SELECT text FROM documents WHERE lang = 'en' AND source IN ("
                     + ", ".join(S.q(s) for s in REF_SOURCES) + ")"))


def _cond_ctes(name: str, lm: str, lower: bool) -> str:
    p = "lower(prompt)" if lower else "prompt"
    g = "lower(gen)" if lower else "gen"
    return (S.ppl_cte(f"{name}_b", lm, f"SELECT gen_id AS key, {p} || ' ' || {g} AS t FROM gens WHERE length(gen) > 0")
            + "," + S.ppl_cte(f"{name}_o", lm, f"SELECT gen_id AS key, {p} AS t FROM gens WHERE length(gen) > 0")
            + f""",
{name} AS (SELECT g.gen_id, b.ppl / o.ppl AS {name}
          FROM gens g LEFT JOIN {name}_b b ON b.key = g.gen_id LEFT JOIN {name}_o o ON o.key = g.gen_id)""")


SQL_COND = (f"WITH {SQL_GENS}, {SQL_LMS}, {_cond_ctes('target_ppl', 'tlm', False)}, "
            f"{_cond_ctes('ref_ppl', 'rlm', False)}, {_cond_ctes('lower_ppl', 'tlm', True)}")

KW = S.sql_list(sorted(set(A.success_keywords(TARGETS))))
PUNCT = S.q(A.ASCII_PUNCTUATION)
SQL_SUCCESS = (f"CASE WHEN length(gen) > 0 THEN contains("
               f"{S.redact_with_list(f'translate(lower(gen), {PUNCT}, {S.q(str())})', KW)}, '<REDACTED>') END")

SQL_RESULTS = f"""{SQL_COND},
results AS (SELECT g.gen_id, g.domain, g.prompt, g.gen, t.target_ppl, r.ref_ppl, l.lower_ppl, {SQL_SUCCESS} AS success
            FROM gens g JOIN target_ppl t USING (gen_id) JOIN ref_ppl r USING (gen_id) JOIN lower_ppl l USING (gen_id))"""


def _results(spark, sf_dir, with_zlib=False):
    gens = cut_lineage(generations(spark, sf_dir))          # read by the filter of the models and by the scores
    asked = A.asked_of_generations(gens)                    # pairs of no generation are not counted
    return A.attack_results(gens, target_lm(spark, sf_dir, asked), ref_lm(spark, sf_dir, asked),
                            TARGETS, ["gen_id"], with_zlib=with_zlib, near_cols=["conversation_id"])


@register("a1_fit_ngram_lm", f"""
WITH {S.lm_ctes('tlm', "SELECT text FROM documents")}
SELECT c.prev, c.c_ctx, count(*) AS n_next, max(p.c_pair) AS max_pair
FROM tlm_ctx c JOIN tlm_pair p USING (prev) GROUP BY c.prev, c.c_ctx
""")
def a1_fit_ngram_lm(spark, sf_dir):
    lm = target_lm(spark, sf_dir)
    return lm["ctx"].join(lm["pair"], "prev").groupBy("prev", "c_ctx").agg(
        F.count(F.lit(1)).alias("n_next"), F.max("c_pair").alias("max_pair"))


@register("a2_perplexity", f"""
WITH {S.lm_ctes('tlm', "SELECT text FROM documents")},
{S.ppl_cte('pp', 'tlm', 'SELECT item_id AS key, text AS t FROM benchmark')}
SELECT key AS item_id, round(ppl, 6) AS ppl FROM pp
""")
def a2_perplexity(spark, sf_dir):
    b = read(spark, sf_dir, "benchmark")
    p = A.perplexity(b, target_lm(spark, sf_dir), "text", ["item_id"])
    return p.select("item_id", F.round("ppl", 6).alias("ppl"))


@register("a3_conditional_perplexity", SQL_COND + """
SELECT gen_id, round(t.target_ppl, 6) AS target_ppl, round(r.ref_ppl, 6) AS ref_ppl
FROM target_ppl t JOIN ref_ppl r USING (gen_id)
""")
def a3_conditional_perplexity(spark, sf_dir):
    g = generations(spark, sf_dir)
    t = A.conditional_perplexity(g, target_lm(spark, sf_dir), ["gen_id"], out="target_ppl")
    r = A.conditional_perplexity(g, ref_lm(spark, sf_dir), ["gen_id"], out="ref_ppl")
    return t.join(r, "gen_id").select("gen_id", F.round("target_ppl", 6).alias("target_ppl"),
                                      F.round("ref_ppl", 6).alias("ref_ppl"))


@register("a4_lowercase_perplexity", SQL_COND + """
SELECT gen_id, round(lower_ppl, 6) AS lower_ppl FROM lower_ppl
""")
def a4_lowercase_perplexity(spark, sf_dir):
    g = generations(spark, sf_dir)
    lo = A.conditional_perplexity(g, target_lm(spark, sf_dir), ["gen_id"], out="lower_ppl", lower=True)
    return lo.select("gen_id", F.round("lower_ppl", 6).alias("lower_ppl"))


@register("a5_zlib_entropy")
def a5_zlib_entropy(spark, sf_dir):
    g = generations(spark, sf_dir)
    return g.select("gen_id", A.zlib_entropy(F.col("gen")).alias("zlib"))


@register("a6_attack_success", f"WITH {SQL_GENS} SELECT gen_id, {SQL_SUCCESS} AS success FROM gens")
def a6_attack_success(spark, sf_dir):
    return A.attack_success_keyword(generations(spark, sf_dir), "gen", TARGETS).select("gen_id", "success")


def _sql_success(hot_where: str) -> str:
    base = f"WITH {SQL_GENS} SELECT gen_id, gen FROM gens"
    return f"""WITH {QR.sql_redacted_in(base, "gen_id", "gen", hot_where, QR.TARGET_LANGS)}
SELECT gen_id, CASE WHEN length(gen) > 0 THEN len(redacted_in) > 0 END AS success FROM marked"""


@register("a6_attack_success_classifier", _sql_success("prob > 0.9"))
def a6_attack_success_classifier(spark, sf_dir):
    """Classifier mode: the generation would be redacted under one of the target labels."""
    gens = generations(spark, sf_dir).select("gen_id", "gen")
    bits = R.classifier_bits(gens, QR._nb(spark, sf_dir), QR.TARGET_LANGS, 0.9, "gen")
    return A.attack_success_domains(gens, bits, "gen", QR.TARGET_LANGS, QR.NB_LO, QR.NB_HI).select("gen_id", "success")


@register("a6_attack_success_scores", _sql_success("prob >= 0.95"))
def a6_attack_success_scores(spark, sf_dir):
    """Score mode: probabilities of an external classifier, inclusive threshold."""
    gens = generations(spark, sf_dir).select("gen_id", "gen")
    grams = R.explode_ngrams(gens, "gen", ["gen_id"], QR.NB_LO, QR.NB_HI)
    scores = R.nb_score(grams, QR._nb(spark, sf_dir), "__gram", short=True).withColumnRenamed("__gram", "gram")
    bits = R.score_bits(scores, QR.TARGET_LANGS, 0.95)
    return A.attack_success_domains(gens, bits, "gen", QR.TARGET_LANGS, QR.NB_LO, QR.NB_HI).select("gen_id", "success")


@register("a7_expand_generations", f"""
WITH {SQL_GENS}
SELECT g.gen_id, s.sample, coalesce(t.utterance, '') AS gen
FROM gens g CROSS JOIN (SELECT unnest(range(0, 3)) AS sample) s
LEFT JOIN turns t ON t.conversation_id = g.conversation_id AND t.turn = g.prompt_idx + 1 + s.sample
""")
def a7_expand_generations(spark, sf_dir):
    """Three continuations per prompt: the following turns of the conversation."""
    g = A.expand_generations(generations(spark, sf_dir).select("gen_id", "conversation_id", "prompt_idx"), 3)
    g = g.withColumn("__turn", F.col("prompt_idx") + 1 + F.col("sample"))
    t = turns(spark, sf_dir).select("conversation_id", F.col("turn").alias("__turn"), "utterance")
    out = g.join(t, ["conversation_id", "__turn"], "left")
    return out.select("gen_id", F.col("sample").cast("bigint").alias("sample"),
                      F.coalesce("utterance", F.lit("")).alias("gen"))


@register("a8_empty_generation_stats", f"""
WITH {SQL_GENS}
SELECT domain, count(*) FILTER (WHERE length(gen) = 0) AS n_empty, count(*) AS n_total,
       round(count(*) FILTER (WHERE length(gen) = 0) / count(*), 6) AS empty_ratio
FROM gens GROUP BY domain
""")
def a8_empty_generation_stats(spark, sf_dir):
    s = A.empty_generation_stats(generations(spark, sf_dir), "gen", ["domain"])
    return s.withColumn("empty_ratio", F.round("empty_ratio", 6))


@register("a9_membership_score", SQL_RESULTS + """
SELECT gen_id, round(ln(ref_ppl) / ln(target_ppl), 6) AS score_ref, round(ln(lower_ppl) / ln(target_ppl), 6) AS score_lower
FROM results
""")
def a9_membership_score(spark, sf_dir):
    r = _results(spark, sf_dir)
    return r.select("gen_id", F.round(A.membership_score("ref_ppl"), 6).alias("score_ref"),
                    F.round(A.membership_score("lower_ppl"), 6).alias("score_lower"))


@register("a10_top_samples", SQL_RESULTS + """
SELECT gen_id, round(ln(ref_ppl) / ln(target_ppl), 6) AS score, success
FROM results ORDER BY ln(ref_ppl) / ln(target_ppl) DESC NULLS LAST, gen_id LIMIT 10
""")
def a10_top_samples(spark, sf_dir):
    r = _results(spark, sf_dir).withColumn("score", A.membership_score("ref_ppl"))
    top = A.top_samples(r, "score", 10, ["gen_id"])
    return top.select("gen_id", F.round("score", 6).alias("score"), "success")


@register("a11_ratio_sorted", SQL_RESULTS + """
SELECT gen_id, round(target_ppl / ref_ppl, 6) AS ratio,
       row_number() OVER (ORDER BY target_ppl / ref_ppl ASC NULLS FIRST, gen_id) AS rank
FROM results
""")
def a11_ratio_sorted(spark, sf_dir):
    r = A.ratio_sorted(_results(spark, sf_dir).select("gen_id", "target_ppl", "ref_ppl"), "target_ppl", "ref_ppl", ["gen_id"])
    return r.select("gen_id", F.round("ratio", 6).alias("ratio"), F.col("rank").cast("long").alias("rank"))


@register("a12_attack_summary", SQL_RESULTS + """
SELECT domain, CAST(sum(CAST(success AS BIGINT)) AS BIGINT) AS successes,
       count(*) FILTER (WHERE length(gen) > 0) AS attempts,
       round(avg(CAST(success AS DOUBLE)), 6) AS success_rate
FROM results GROUP BY domain
""")
def a12_attack_summary(spark, sf_dir):
    s = A.attack_summary(_results(spark, sf_dir), ["domain"])
    return s.withColumn("success_rate", F.round("success_rate", 6))


@register("a13_attack_results", SQL_RESULTS + """
SELECT gen_id, prompt, gen, round(target_ppl, 6) AS target_ppl, round(ref_ppl, 6) AS ref_ppl,
       round(lower_ppl, 6) AS lower_ppl, success
FROM results
""")
def a13_attack_results(spark, sf_dir):
    r = _results(spark, sf_dir)
    return r.select("gen_id", "prompt", "gen", *[F.round(c, 6).alias(c) for c in ("target_ppl", "ref_ppl", "lower_ppl")],
                    "success")


@register("a13_attack_results_zlib")
def a13_attack_results_zlib(spark, sf_dir):
    """The full result row, zlib included (no SQL twin: zlib has no SQL built-in)."""
    return _results(spark, sf_dir, with_zlib=True)


@register("a14_append_runs", SQL_RESULTS + """,
summary AS (SELECT domain AS run, CAST(sum(CAST(success AS BIGINT)) AS BIGINT) AS successes FROM results GROUP BY domain)
SELECT run, CASE WHEN run = 'MEDIA' THEN successes + 1000 ELSE successes END AS result_id, successes FROM summary
""")
def a14_append_runs(spark, sf_dir):
    """Two appends to the lookup table (one run comes again with a new id), then the lookup."""
    s = A.attack_summary(_results(spark, sf_dir), ["domain"]).select(
        F.col("domain").alias("run"), F.col("successes").cast("long").alias("successes"))
    path = io.scratch(spark, "runs")
    A.append_run(path, s.select("run", F.col("successes").alias("result_id")))
    A.append_run(path, s.where("run = 'MEDIA'").select("run", (F.col("successes") + 1000).alias("result_id")))
    return A.run_lookup(s, A.read_runs(spark, path)).select("run", "result_id", "successes")


@register("a14_run_lookup", SQL_RESULTS + """,
summary AS (SELECT domain AS run, CAST(sum(CAST(success AS BIGINT)) AS BIGINT) AS successes FROM results GROUP BY domain),
runs AS (SELECT run, CAST(dense_rank() OVER (ORDER BY run) AS BIGINT) AS result_id FROM (SELECT DISTINCT run FROM summary))
SELECT s.run, r.result_id, s.successes FROM summary s LEFT JOIN runs r USING (run)
""")
def a14_run_lookup(spark, sf_dir):
    s = A.attack_summary(_results(spark, sf_dir), ["domain"]).select(F.col("domain").alias("run"), "successes")
    runs = s.select("run").distinct()
    # the lookup table has one row per run name: a global window over it is tiny
    runs = runs.select("run", F.dense_rank().over(Window.orderBy("run")).cast("long").alias("result_id"))
    return A.run_lookup(s, runs).select("run", "result_id", "successes")
