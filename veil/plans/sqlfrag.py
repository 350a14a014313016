"""DuckDB SQL fragments for the oracle side.

The oracle is an independent engine (DuckDB) running plain SQL; these helpers
only spell the same definitions (tokens, n-grams, the replacement fold) in its
dialect so that every registered query has a readable SQL twin.
"""

from __future__ import annotations

from typing import Mapping, Sequence

from veil.constants import PUNCTUATION_CHARS, REDACTED, WS_RUN


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_list(values: Sequence[str]) -> str:
    if not values:
        return "CAST([] AS VARCHAR[])"
    return "[" + ", ".join(q(v) for v in values) + "]"


def tokens(expr: str) -> str:
    return f"list_filter(regexp_split_to_array({expr}, {q(WS_RUN)}), lambda x: x <> '')"


def exact_ngrams(toks: str, n: int) -> str:
    if n == 1:
        return toks
    slices = ", ".join(f"{toks}[{j + 1} : len({toks}) - {n - 1 - j}]" for j in range(n))
    fields = " || ' ' || ".join(f"s[{j + 1}]" for j in range(n))
    return (f"(CASE WHEN len({toks}) >= {n} THEN "
            f"list_transform(list_zip({slices}), lambda s: {fields}) ELSE CAST([] AS VARCHAR[]) END)")


def ngrams(toks: str, lo: int = 1, hi: int = 3) -> str:
    parts = [f"(CASE WHEN len({toks}) >= {n} THEN {exact_ngrams(toks, n)} "
             f"ELSE [array_to_string({toks}, ' ')] END)" for n in range(hi, lo - 1, -1)]
    return (f"(CASE WHEN len({toks}) = 0 THEN CAST([] AS VARCHAR[]) "
            f"ELSE flatten([{', '.join(parts)}]) END)")


def normalise(g: str) -> str:
    return f"trim(lower({g}), {q(PUNCTUATION_CHARS)})"


def redaction_of(g: str) -> str:
    return f"rtrim(repeat({q(REDACTED + ' ')}, len(string_split({g}, ' '))), ' ')"


def fold(text: str, grams: str) -> str:
    return f"list_reduce({grams}, lambda acc, g: replace(acc, g, {redaction_of('g')}), {text})"


def redact_with_list(text: str, kw: str, lo: int = 1, hi: int = 3) -> str:
    grams = ngrams(tokens(text), lo, hi)
    private = f"list_filter({grams}, lambda g: list_contains({kw}, {normalise('g')}))"
    return fold(text, private)


def keyword_case(domain_expr: str, keyword_dict: Mapping[str, Sequence[str]]) -> str:
    whens = " ".join(f"WHEN {q(d)} THEN {sql_list([w.lower() for w in ws])}"
                     for d, ws in keyword_dict.items())
    return f"(CASE {domain_expr} {whens} ELSE CAST([] AS VARCHAR[]) END)"


def py_strip(expr: str) -> str:
    return f"regexp_replace({expr}, {q('^' + WS_RUN + '|' + WS_RUN + '$')}, '', 'g')"


def r6(x: float) -> str:
    return f"round({x}, 6)"


def hash_key(seed: int, *exprs: str) -> str:
    parts = " || ':' || ".join([q(str(int(seed)))] + [f"CAST({e} AS VARCHAR)" for e in exprs])
    return f"md5({parts})"


def hash_uniform(seed: int, *exprs: str) -> str:
    return f"(CAST(('0x' || substr({hash_key(seed, *exprs)}, 1, 13)) AS BIGINT) / {float(1 << 52)})"


def role_token(expr: str = "role") -> str:
    return (f"(CASE {expr} WHEN 'customer' THEN 'USR:' WHEN 'agent' THEN 'SYS:' "
            f"WHEN 'bot' THEN 'BOT:' ELSE error('Author ' || {expr} || ' not supported') END)")


def format_turn(use_domain_tokens: bool = True) -> str:
    body = f"{role_token('role')} || ' ' || {py_strip('utterance')}"
    return f"('<' || domain || '> ' || {body})" if use_domain_tokens else f"({body})"


def feature_ngrams(expr: str, lo: int, hi: int) -> str:
    toks = tokens(f"lower({expr})")
    return "flatten([" + ", ".join(exact_ngrams(toks, n) for n in range(lo, hi + 1)) + "])"


def nb_model_ctes(train_sql: str, lo: int, hi: int, alpha: float = 1.0) -> str:
    """CTEs nb_vocab, nb_classes(label, logprior, unseen), nb_logp(gram, label, logp).

    ``train_sql`` yields (label, text).
    """
    return f"""
nb_train AS ({train_sql}),
nb_counts AS (SELECT label, gram, count(*) AS gram_n
              FROM (SELECT label, unnest({feature_ngrams('text', lo, hi)}) AS gram FROM nb_train)
              GROUP BY label, gram),
nb_vocab AS (SELECT DISTINCT gram FROM nb_counts),
nb_v AS (SELECT count(*) AS V FROM nb_vocab),
nb_tot AS (SELECT label, sum(gram_n) AS label_n FROM nb_counts GROUP BY label),
nb_nd AS (SELECT label, count(*) AS c FROM nb_train GROUP BY label),
nb_classes AS (SELECT nb_nd.label, ln(c) - ln(sum(c) OVER ()) AS logprior,
                      ln({alpha}) - ln(coalesce(label_n, 0) + {alpha} * V) AS unseen
               FROM nb_nd LEFT JOIN nb_tot USING (label) CROSS JOIN nb_v),
nb_logp AS (SELECT gram, label, ln(gram_n + {alpha}) - ln(label_n + {alpha} * V) AS logp
            FROM nb_counts JOIN nb_tot USING (label) CROSS JOIN nb_v)"""


def nb_score_ctes(items_sql: str, lo: int, hi: int, name: str = "nb_scored") -> str:
    """CTE ``name(t, label, prob)`` for the distinct texts ``t`` of ``items_sql``."""
    return f"""
{name}_items AS (SELECT DISTINCT t FROM ({items_sql})),
{name}_f AS (SELECT t, gram, count(*) AS cnt
             FROM (SELECT t, unnest({feature_ngrams('t', lo, hi)}) AS gram FROM {name}_items)
             GROUP BY t, gram),
{name}_inv AS (SELECT * FROM {name}_f WHERE gram IN (SELECT gram FROM nb_vocab)),
{name}_tv AS (SELECT t, sum(cnt) AS tv FROM {name}_inv GROUP BY t),
{name}_seen AS (SELECT t, label, sum(cnt * (logp - unseen)) AS seen
                FROM {name}_inv JOIN nb_logp USING (gram) JOIN nb_classes USING (label) GROUP BY t, label),
{name}_jll AS (SELECT i.t, c.label, c.logprior + c.unseen * coalesce(tv.tv, 0) + coalesce(s.seen, 0) AS jll
               FROM {name}_items i CROSS JOIN nb_classes c LEFT JOIN {name}_tv tv ON tv.t = i.t
               LEFT JOIN {name}_seen s ON s.t = i.t AND s.label = c.label),
{name}_m AS (SELECT *, max(jll) OVER (PARTITION BY t) AS m FROM {name}_jll),
{name} AS (SELECT t, label, exp(jll - (m + ln(sum(exp(jll - m)) OVER (PARTITION BY t)))) AS prob
           FROM {name}_m)"""


def fold_by_table(base_sql: str, key: str, text: str, grams_expr: str, hot_sql: str,
                  dom_expr: str | None = None) -> str:
    """Redaction fold where the decision is membership in ``hot_sql`` (t[, label])."""
    dom_sel = f", {dom_expr} AS __dom" if dom_expr else ""
    cond = ("(g, __dom) IN (SELECT t, label FROM hot)" if dom_expr
            else "g IN (SELECT t FROM hot)")
    return f"""
hot AS ({hot_sql}),
fb_base AS ({base_sql}),
fb_ex AS (SELECT {key}, g, pos{', __dom' if dom_expr else ''}
          FROM (SELECT {key}{dom_sel}, unnest(grams) AS g, generate_subscripts(grams, 1) AS pos
                FROM (SELECT *, {grams_expr} AS grams FROM fb_base))),
fb_priv AS (SELECT {key}, list(g ORDER BY pos) AS pl FROM fb_ex WHERE {cond} GROUP BY {key}),
folded AS (SELECT b.*, {fold(text, "coalesce(p.pl, CAST([] AS VARCHAR[]))")} AS redacted
           FROM fb_base b LEFT JOIN fb_priv p USING ({key}))"""


def lm_ctes(name: str, corpus_sql: str) -> str:
    """Bigram count LM: CTEs {name}_pair(prev, tok, c_pair), {name}_ctx(prev, c_ctx), {name}_v(V)."""
    return f"""
{name}_toks AS (SELECT {tokens('text')} AS toks FROM ({corpus_sql})),
{name}_bg AS (SELECT toks[i - 1] AS prev, toks[i] AS tok
              FROM (SELECT toks, unnest(range(2, len(toks) + 1)) AS i FROM {name}_toks)),
{name}_pair AS (SELECT prev, tok, count(*) AS c_pair FROM {name}_bg GROUP BY prev, tok),
{name}_ctx AS (SELECT prev, count(*) AS c_ctx FROM {name}_bg GROUP BY prev),
{name}_v AS (SELECT count(DISTINCT t) AS V FROM (SELECT unnest(toks) AS t FROM {name}_toks))"""


def ppl_cte(out: str, lm: str, items_sql: str, k: float = 1.0) -> str:
    """CTE ``out(key, ppl)`` for ``items_sql`` yielding (key, t); null ppl below 2 tokens."""
    return f"""
{out}_it AS ({items_sql}),
{out}_bg AS (SELECT key, toks[i - 1] AS prev, toks[i] AS tok
             FROM (SELECT key, toks, unnest(range(2, len(toks) + 1)) AS i
                   FROM (SELECT key, {tokens('t')} AS toks FROM {out}_it))),
{out}_lp AS (SELECT b.key, ln(coalesce(p.c_pair, 0) + {k}) - ln(coalesce(c.c_ctx, 0) + {k} * v.V) AS lp
             FROM {out}_bg b LEFT JOIN {lm}_pair p ON p.prev = b.prev AND p.tok = b.tok
             LEFT JOIN {lm}_ctx c ON c.prev = b.prev CROSS JOIN {lm}_v v),
{out} AS (SELECT i.key, exp(-avg(l.lp)) AS ppl FROM {out}_it i LEFT JOIN {out}_lp l ON l.key = i.key
          GROUP BY i.key)"""
