"""Dialogue preparation.

Input of most operators is a *turn table*::

    conversation_id string, turn int, role string, utterance string, domain string

Conversations are the unit of grouping.  Assembling one conversation into one
string (D7) and building its prompts (D8) need all turns of that conversation
together; everything else is row-local or uses group positions that do not
pull a group into one task (``veil.functions.ranking.positions``).
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veil.constants import CONVO_END, CONVO_START, ROLE_TOKENS, stop_tokens, task_domain_tokens
from veil.functions import text as T
from veil.functions.ranking import hash_key, null_safe_join, positions


# D1 -------------------------------------------------------------------------
def fill_blank(df: DataFrame, col: str = "utterance", value: str = " ") -> DataFrame:
    """Null text → ``" "`` (preparation) or ``""`` (redaction)."""
    return df.withColumn(col, F.coalesce(F.col(col), F.lit(value)))


# D2 -------------------------------------------------------------------------
def normalize_conversation_id(col="conversation_id", exact_suffix: bool = False) -> Column:
    """``rstrip('-1').rstrip('-2')``: character sets, not suffixes (Q1)."""
    c = F.col(col) if isinstance(col, str) else col
    if exact_suffix:
        return F.regexp_replace(F.regexp_replace(c, "-1$", ""), "-2$", "")
    return F.rtrim(F.rtrim(c, F.lit("-1")), F.lit("-2"))


# D3 + D4 ----------------------------------------------------------------------
def dedup_turns(df: DataFrame, id_col: str = "conversation_id", exact_suffix: bool = False) -> DataFrame:
    """Normalise ids (D2), then drop full-row duplicates keeping the first copy.

    ``orig_id`` keeps the smallest original id of the copies: it is the order
    key of the turn inside a merged conversation (D4).  Map-side partial
    aggregation collapses copies before the shuffle, so a group of copies
    holding many rows costs one row per map task.
    """
    cols = [c for c in df.columns]
    norm = df.withColumn("orig_id", F.col(id_col)).withColumn(
        id_col, normalize_conversation_id(id_col, exact_suffix))
    return norm.groupBy(*cols).agg(F.min("orig_id").alias("orig_id"))


def turn_order_key() -> Column:
    """Order inside a (merged) conversation."""
    return F.struct(F.col("orig_id"), F.col("turn"))


# D5 -------------------------------------------------------------------------
def role_token(role="role") -> Column:
    r = F.col(role) if isinstance(role, str) else role
    expr = None
    for name, tok in ROLE_TOKENS.items():
        expr = F.when(r == name, F.lit(tok)) if expr is None else expr.when(r == name, F.lit(tok))
    return expr.otherwise(F.raise_error(F.concat(F.lit("Author "), F.coalesce(r, F.lit("null")),
                                                 F.lit(" not supported"))))


def domain_token_col(domain="domain") -> Column:
    d = F.col(domain) if isinstance(domain, str) else domain
    return F.concat(F.lit("<"), d, F.lit(">"))


# D6 -------------------------------------------------------------------------
def format_turn(use_domain_tokens: bool = True, role="role", utterance="utterance",
                domain="domain") -> Column:
    """``[<DOMAIN> ]ROLE: utterance.strip()``."""
    body = F.concat(role_token(role), F.lit(" "), T.py_strip(utterance))
    if use_domain_tokens:
        return F.concat(domain_token_col(domain), F.lit(" "), body)
    return body


# D7 -------------------------------------------------------------------------
def assemble_conversations(turns: DataFrame, use_domain_tokens: bool = True,
                           keys: Sequence[str] = ("domain", "conversation_id")) -> DataFrame:
    """One row per conversation: ``<_soc_> t0 t1 … <_eoc_>``."""
    t = turns
    if "orig_id" not in t.columns:
        t = t.withColumn("orig_id", F.col("conversation_id"))
    t = t.withColumn("__f", format_turn(use_domain_tokens))
    conv = t.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("orig_id", "turn", "__f"))).alias("__turns"))
    return conv.select(*keys, F.concat(
        F.lit(CONVO_START + " "),
        F.array_join(F.transform("__turns", lambda s: s["__f"]), " "),
        F.lit(" " + CONVO_END)).alias("text"))


# D8 / D9 ----------------------------------------------------------------------
def build_prompts(turns: DataFrame, max_prompts: int = 10, use_domain_tokens: bool = True,
                  keys: Sequence[str] = ("domain", "conversation_id")) -> DataFrame:
    """Prompts: turns 0..i then the speaker token of turn i+1, prefixed ``<_soc_>``.

    At most ``max_prompts`` per conversation when ``max_prompts >= 0``; only
    the first ``max_prompts + 1`` turns of a conversation are ever needed, so
    they are cut first (a window-group limit Spark applies before the shuffle).
    """
    t = turns
    if "orig_id" not in t.columns:
        t = t.withColumn("orig_id", F.col("conversation_id"))
    w = Window.partitionBy(*keys).orderBy("orig_id", "turn")
    t = t.withColumn("prompt_idx", F.row_number().over(w) - 1)
    if max_prompts >= 0:
        t = t.where(F.col("prompt_idx") <= max_prompts)
    nxt_role = F.lead("role").over(w)
    next_tok = role_token(nxt_role)
    if use_domain_tokens:
        next_tok = F.concat(domain_token_col(), F.lit(" "), next_tok)
    t = (t.withColumn("__f", format_turn(use_domain_tokens))
         .withColumn("__next", F.when(nxt_role.isNotNull(), next_tok))
         .withColumn("__so_far", F.collect_list("__f").over(
             w.rowsBetween(Window.unboundedPreceding, Window.currentRow))))
    t = t.where(F.col("__next").isNotNull())
    if max_prompts >= 0:
        t = t.where(F.col("prompt_idx") < max_prompts)
    return t.select(*keys, "prompt_idx", F.concat(
        F.lit(CONVO_START + " "), F.array_join("__so_far", " "), F.lit(" "), F.col("__next")
    ).alias("prompt"))


def build_prompts_full(turns: DataFrame, use_domain_tokens: bool = True,
                       keys: Sequence[str] = ("domain", "conversation_id")) -> DataFrame:
    """D9 = D8 without a cap."""
    return build_prompts(turns, -1, use_domain_tokens, keys)


# D10 ------------------------------------------------------------------------
def limit_prompt_conversations(turns: DataFrame, manifest: DataFrame, k: int) -> DataFrame:
    """Only the first ``k`` ids of each (domain, split) list feed D8/D9; a null domain is a domain."""
    first = manifest.where(F.col("pos") < k).select("domain", "split", "conversation_id")
    return null_safe_join(turns, first, ["domain", "conversation_id"])


# D11 ------------------------------------------------------------------------
def split_conversations(turns: DataFrame, valid_frac: float = 0.1, test_frac: float = 0.1,
                        seed: int = 0) -> DataFrame:
    """Split manifest ``(domain, split, pos, conversation_id)``.

    Per domain the distinct ids are shuffled by a seeded hash; the first
    ``int(test_frac·n)`` are test, the next ``int(valid_frac·n)`` valid, the
    rest train.  Positions come from a range-partitioned rank, so a domain
    with a third of all ids is spread over many tasks.
    """
    ids = turns.select("domain", "conversation_id").distinct()
    ids = ids.withColumn("__h", hash_key(seed, "conversation_id"))
    ranked = positions(ids, ["domain"], ["__h", "conversation_id"], out="__r")
    n = ids.groupBy("domain").agg(F.count(F.lit(1)).alias("__n"))
    ranked = null_safe_join(ranked, n, ["domain"])
    n_test = F.floor(F.col("__n") * F.lit(test_frac))
    n_valid = F.floor(F.col("__n") * F.lit(valid_frac))
    r = F.col("__r")
    split = F.when(r < n_test, "test").when(r < n_test + n_valid, "valid").otherwise("train")
    pos = F.when(r < n_test, r).when(r < n_test + n_valid, r - n_test).otherwise(r - n_test - n_valid)
    return ranked.select("domain", split.alias("split"), pos.cast("long").alias("pos"),
                         "conversation_id")


# D12 ------------------------------------------------------------------------
def apply_split_manifest(turns: DataFrame, manifest: DataFrame, split: str | None = None) -> DataFrame:
    m = manifest if split is None else manifest.where(F.col("split") == split)
    return null_safe_join(turns, m.select("domain", "split", "conversation_id"), ["domain", "conversation_id"])


# D13 ------------------------------------------------------------------------
def select_domains(df: DataFrame, domains, task: str, col: str = "domain") -> DataFrame:
    """``"ALL"`` or a list, validated against the task registry (Q7 fixed)."""
    known = list(task_domain_tokens(task))
    if isinstance(domains, str):
        domains = known if domains.upper() == "ALL" else [d.strip() for d in domains.split(",")]
    bad = [d for d in domains if d not in known]
    if bad:
        raise ValueError(f"domains {bad} not in task {task}: {known}")
    return df.where(F.col(col).isin(list(domains)))


# D14 ------------------------------------------------------------------------
def strip_domain_tokens(text, task: str) -> Column:
    return T.strip_domain_tokens(text, list(task_domain_tokens(task).values()))


# D15 / D16 ------------------------------------------------------------------
def truncate_at_stop(text, task: str | None = None, stops: Sequence[str] | None = None) -> Column:
    return T.truncate_at_stop(text, list(stops) if stops is not None else stop_tokens(task))


# D17 ------------------------------------------------------------------------
def missing_special_tokens(vocab: DataFrame, task: str, token_col: str = "token",
                           add_redaction_token: bool = False) -> DataFrame:
    """Stop tokens of the task, the pad token and optionally ``<REDACTED>``
    that a vocabulary table lacks (anti join)."""
    from veil.constants import PAD_TOKEN, REDACTED
    specials = list(dict.fromkeys(stop_tokens(task) + [PAD_TOKEN]
                                  + ([REDACTED] if add_redaction_token else [])))
    sp = vocab.sparkSession.createDataFrame([(s,) for s in specials], "token string")
    return sp.join(vocab.select(F.col(token_col).alias("token")), "token", "left_anti")
