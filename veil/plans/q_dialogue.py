"""Registered dialogue-preparation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from veil.constants import stop_tokens
from veil.operators import dialogue as D
from veil.plans import sqlfrag as S
from veil.plans.registry import register
from veil.plans.tables import SQL_TURNS, SQL_TURNS_COPIES, read, turns, with_copies

TASK = "airline_media_ins"


def _dedup(spark, sf_dir):
    return D.dedup_turns(D.fill_blank(with_copies(turns(spark, sf_dir))))


SQL_DEDUP = f"""
(SELECT rtrim(rtrim(conversation_id, '-1'), '-2') AS conversation_id, turn, role,
        coalesce(utterance, ' ') AS utterance, domain, min(conversation_id) AS orig_id
 FROM ({SQL_TURNS_COPIES})
 GROUP BY ALL)
"""


@register("d1_fill_blank", f"""
SELECT conversation_id, turn, coalesce(utterance, ' ') AS utterance FROM ({SQL_TURNS})
""")
def d1_fill_blank(spark, sf_dir):
    return D.fill_blank(turns(spark, sf_dir)).select("conversation_id", "turn", "utterance")


@register("d2_normalize_ids", f"""
SELECT DISTINCT conversation_id AS orig_id, rtrim(rtrim(conversation_id, '-1'), '-2') AS conversation_id
FROM ({SQL_TURNS_COPIES})
""")
def d2_normalize_ids(spark, sf_dir):
    t = with_copies(turns(spark, sf_dir))
    return t.select(F.col("conversation_id").alias("orig_id"),
                    D.normalize_conversation_id("conversation_id").alias("conversation_id")).distinct()


@register("d3_dedup_turns", f"SELECT * FROM {SQL_DEDUP}")
def d3_dedup_turns(spark, sf_dir):
    return _dedup(spark, sf_dir)


@register("d5_d6_format_turns", f"""
SELECT conversation_id, turn, {S.format_turn(True)} AS formatted, {S.format_turn(False)} AS plain
FROM ({SQL_TURNS})
""")
def d5_d6_format_turns(spark, sf_dir):
    t = turns(spark, sf_dir)
    return t.select("conversation_id", "turn", D.format_turn(True).alias("formatted"),
                    D.format_turn(False).alias("plain"))


SQL_ASSEMBLE = f"""
SELECT domain, conversation_id,
       '<_soc_> ' || string_agg({S.format_turn(True)}, ' ' ORDER BY orig_id, turn) || ' <_eoc_>' AS text
FROM {SQL_DEDUP} GROUP BY domain, conversation_id
"""


@register("d7_assemble_conversations", SQL_ASSEMBLE)
def d7_assemble(spark, sf_dir):
    return D.assemble_conversations(_dedup(spark, sf_dir))


def _sql_prompts(max_prompts: int) -> str:
    cap = f"AND prompt_idx < {max_prompts}" if max_prompts >= 0 else ""
    return f"""
SELECT domain, conversation_id, prompt_idx,
       '<_soc_> ' || array_to_string(so_far, ' ') || ' ' || '<' || domain || '> ' || {S.role_token('next_role')} AS prompt
FROM (SELECT domain, conversation_id,
             row_number() OVER w - 1 AS prompt_idx,
             lead(role) OVER w AS next_role,
             list({S.format_turn(True)}) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS so_far
      FROM {SQL_DEDUP}
      WINDOW w AS (PARTITION BY domain, conversation_id ORDER BY orig_id, turn))
WHERE next_role IS NOT NULL {cap}
"""


@register("d8_build_prompts", _sql_prompts(10))
def d8_build_prompts(spark, sf_dir):
    return D.build_prompts(_dedup(spark, sf_dir), 10)


@register("d9_build_prompts_full", _sql_prompts(-1))
def d9_build_prompts_full(spark, sf_dir):
    return D.build_prompts_full(_dedup(spark, sf_dir))


SQL_MANIFEST = f"""
(SELECT domain,
        CASE WHEN r < floor(n * 0.1) THEN 'test' WHEN r < floor(n * 0.1) + floor(n * 0.1) THEN 'valid'
             ELSE 'train' END AS split,
        CAST(CASE WHEN r < floor(n * 0.1) THEN r WHEN r < floor(n * 0.1) + floor(n * 0.1) THEN r - floor(n * 0.1)
             ELSE r - 2 * floor(n * 0.1) END AS BIGINT) AS pos,
        conversation_id
 FROM (SELECT domain, conversation_id,
              row_number() OVER (PARTITION BY domain ORDER BY {S.hash_key(0, 'conversation_id')}, conversation_id) - 1 AS r,
              count(*) OVER (PARTITION BY domain) AS n
       FROM (SELECT DISTINCT domain, conversation_id FROM {SQL_DEDUP})))
"""


def _manifest(spark, sf_dir):
    return D.split_conversations(_dedup(spark, sf_dir), 0.1, 0.1, seed=0)


@register("d11_split_manifest", f"SELECT * FROM {SQL_MANIFEST}")
def d11_split_manifest(spark, sf_dir):
    return _manifest(spark, sf_dir)


@register("d12_apply_split_manifest", f"""
SELECT m.split, t.domain, t.conversation_id, t.turn, t.utterance
FROM {SQL_DEDUP} t JOIN {SQL_MANIFEST} m USING (domain, conversation_id)
""")
def d12_apply_split_manifest(spark, sf_dir):
    t = D.apply_split_manifest(_dedup(spark, sf_dir), _manifest(spark, sf_dir))
    return t.select("split", "domain", "conversation_id", "turn", "utterance")


@register("d10_prompts_of_first_k", f"""
WITH lim AS (SELECT t.* FROM {SQL_DEDUP} t
             JOIN {SQL_MANIFEST} m USING (domain, conversation_id) WHERE m.pos < 5)
SELECT domain, conversation_id, prompt_idx,
       '<_soc_> ' || array_to_string(so_far, ' ') || ' ' || '<' || domain || '> ' || {S.role_token('next_role')} AS prompt
FROM (SELECT domain, conversation_id, row_number() OVER w - 1 AS prompt_idx, lead(role) OVER w AS next_role,
             list({S.format_turn(True)}) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS so_far
      FROM lim WINDOW w AS (PARTITION BY domain, conversation_id ORDER BY orig_id, turn))
WHERE next_role IS NOT NULL AND prompt_idx < 10
""")
def d10_prompts_of_first_k(spark, sf_dir):
    t = D.limit_prompt_conversations(_dedup(spark, sf_dir), _manifest(spark, sf_dir), 5).drop("split")
    return D.build_prompts(t, 10)


@register("d13_select_domains", f"""
SELECT domain, count(*) AS turns FROM ({SQL_TURNS}) WHERE domain IN ('AIRLINE', 'MEDIA') GROUP BY domain
""")
def d13_select_domains(spark, sf_dir):
    t = D.select_domains(turns(spark, sf_dir), "AIRLINE,MEDIA", TASK)
    return t.groupBy("domain").agg(F.count(F.lit(1)).alias("turns"))


@register("d14_strip_domain_tokens", f"""
SELECT domain, conversation_id,
       regexp_replace(text, '<AIRLINE> |<MEDIA> |<INSURANCE> ', '', 'g') AS text
FROM ({SQL_ASSEMBLE})
""")
def d14_strip_domain_tokens(spark, sf_dir):
    c = D.assemble_conversations(_dedup(spark, sf_dir))
    return c.withColumn("text", D.strip_domain_tokens("text", TASK))


def _sql_truncate(expr: str, stops) -> str:
    poss = ", ".join(f"nullif(strpos({expr}, {S.q(s)}), 0)" for s in stops)
    pos = f"least({poss})"
    return S.py_strip(f"(CASE WHEN {pos} IS NULL THEN {expr} ELSE substr({expr}, 1, {pos} - 1) END)")


@register("d15_truncate_at_stop", f"""
SELECT domain, conversation_id, {_sql_truncate("substr(text, 9)", stop_tokens(TASK))} AS gen
FROM ({SQL_ASSEMBLE})
""")
def d15_truncate_at_stop(spark, sf_dir):
    """Generations are the assembled text after ``<_soc_> ``: cut at the next stop token."""
    c = D.assemble_conversations(_dedup(spark, sf_dir))
    return c.select("domain", "conversation_id",
                    D.truncate_at_stop(F.substring("text", 9, 1 << 30), TASK).alias("gen"))


@register("d17_missing_special_tokens", f"""
WITH vocab AS (SELECT DISTINCT unnest({S.tokens('text')}) AS token FROM documents),
sp AS (SELECT unnest({S.sql_list(list(dict.fromkeys(stop_tokens(TASK) + ['<pad>'])))}) AS token)
SELECT token FROM sp WHERE token NOT IN (SELECT token FROM vocab)
""")
def d17_missing_special_tokens(spark, sf_dir):
    from veil.functions.text import tokens
    vocab = read(spark, sf_dir, "documents").select(F.explode(tokens("text")).alias("token")).distinct()
    return D.missing_special_tokens(vocab, TASK)
