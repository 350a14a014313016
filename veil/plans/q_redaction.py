"""Registered redaction queries (R1–R15) over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from veil.operators import redaction as R
from veil.plans import sqlfrag as S
from veil.plans.registry import register
from veil.functions import text as T
from veil.plans.tables import SQL_TURNS, TEST_KEYWORDS, read, turns
from veil.session import keep

FLAT_KEYWORDS = sorted({w for ws in TEST_KEYWORDS.values() for w in ws})


def redacted_turns_per_domain(spark, sf_dir):
    """Flagship: per-domain keyword redaction of every turn, then a rate."""
    t = turns(spark, sf_dir).fillna({"utterance": ""})
    red = R.redact_keywords(t, TEST_KEYWORDS, "utterance", "redacted", domain_col="domain")
    return (red.groupBy("domain")
            .agg(F.count(F.lit(1)).alias("turns"),
                 F.count_if(R.is_redacted("redacted")).alias("redacted_turns"),
                 F.round(F.avg(R.is_redacted("redacted").cast("double")), 6).alias("rate")))


SQL_FLAGSHIP = f"""
WITH t AS (SELECT conversation_id, turn, role, coalesce(utterance, '') AS utterance, domain
           FROM ({SQL_TURNS})),
r AS (SELECT domain, {S.redact_with_list('utterance', S.keyword_case('domain', TEST_KEYWORDS))} AS redacted
      FROM t)
SELECT domain, count(*) AS turns,
       count(*) FILTER (WHERE contains(redacted, '<REDACTED>')) AS redacted_turns,
       round(avg(CASE WHEN contains(redacted, '<REDACTED>') THEN 1.0 ELSE 0.0 END), 6) AS rate
FROM r GROUP BY domain
"""

register("redacted_turns_per_domain", SQL_FLAGSHIP)(redacted_turns_per_domain)


@register("r1_word_ngrams", f"""
SELECT doc_id, len(g) AS n_grams, g[1] AS first_gram, g[len(g)] AS last_gram
FROM (SELECT doc_id, {S.ngrams(S.tokens('text'), 1, 3)} AS g FROM documents)
""")
def r1_word_ngrams(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return T.with_ngrams(d, "text", 1, 3, out="g").select(
            "doc_id", F.size("g").alias("n_grams"), F.try_element_at("g", F.lit(1)).alias("first_gram"),
            F.try_element_at("g", F.size("g")).alias("last_gram"))


# ---------------------------------------------------------------------------
# Documents: the language is the domain (FIXTURES); per-language dictionary.
LANG_KEYWORDS = {
    "en": ["the", "of", "and", "of the"],
    "fr": ["la", "le", "des"],
    "de": ["der", "die"],
    "es": ["que", "la"],
}
LANG_FLAT = sorted({w for ws in LANG_KEYWORDS.values() for w in ws})
SQL_FLAT = S.sql_list(LANG_FLAT)


def _docs(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")


@register("r2_is_keyword", f"""
SELECT doc_id, CAST(len(list_filter({S.ngrams(S.tokens('text'))}, lambda g: list_contains({SQL_FLAT}, {S.normalise('g')}))) AS INTEGER) AS n_private
FROM documents
""")
def r2_is_keyword(spark, sf_dir):
    d = T.with_ngrams(_docs(spark, sf_dir), "text")
    return d.select("doc_id", F.size(F.filter("__grams", lambda g: R.is_keyword(g, LANG_FLAT))).alias("n_private"))


SQL_R3 = f"SELECT doc_id, {S.redact_with_list('text', SQL_FLAT)} AS redacted FROM documents"


@register("r3_redact_keywords", SQL_R3)
def r3_redact_keywords(spark, sf_dir):
    return R.redact_keywords(_docs(spark, sf_dir), LANG_FLAT, "text", "redacted").select("doc_id", "redacted")


@register("r3_redact_keywords_exploded", SQL_R3)
def r3_redact_keywords_exploded(spark, sf_dir):
    """Same fold through explode + join + ordered collect (large-dictionary form)."""
    kw = spark.createDataFrame([(w,) for w in LANG_FLAT], "phrase string")
    return R.redact_keywords(_docs(spark, sf_dir), kw, "text",
                             "redacted").select("doc_id", "redacted")


SQL_R4 = f"""SELECT doc_id, lang, {S.redact_with_list('text', S.keyword_case('lang', LANG_KEYWORDS))} AS redacted
FROM documents"""


@register("r4_redact_keywords_by_domain", SQL_R4)
def r4_redact_keywords_by_domain(spark, sf_dir):
    return R.redact_keywords(_docs(spark, sf_dir), LANG_KEYWORDS, "text", "redacted",
                             domain_col="lang").select("doc_id", "lang", "redacted")


@register("r5_is_redacted", f"""
SELECT lang, count(*) AS docs, count(*) FILTER (WHERE contains(redacted, '<REDACTED>')) AS redacted_docs
FROM ({SQL_R4}) GROUP BY lang
""")
def r5_is_redacted(spark, sf_dir):
    r = r4_redact_keywords_by_domain(spark, sf_dir)
    return r.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"),
                                 F.count_if(R.is_redacted("redacted")).alias("redacted_docs"))


@register("r6_is_redacted_any", f"""
SELECT doc_id,
       contains({S.redact_with_list('text', S.sql_list(LANG_KEYWORDS['de']))}, '<REDACTED>')
       OR contains({S.redact_with_list('text', S.sql_list(LANG_KEYWORDS['es']))}, '<REDACTED>') AS success
FROM documents
""")
def r6_is_redacted_any(spark, sf_dir):
    d = _docs(spark, sf_dir)
    for dom in ("de", "es"):
        d = R.redact_keywords(d.withColumn("__d", F.lit(dom)), {dom: LANG_KEYWORDS[dom]}, "text",
                              f"__r_{dom}", domain_col="__d")
    return d.select("doc_id", (R.is_redacted("__r_de") | R.is_redacted("__r_es")).alias("success"))


@register("r14_redact_unigrams", f"""
SELECT doc_id, array_to_string(list_transform({S.tokens('text')},
       lambda w: CASE WHEN list_contains({SQL_FLAT}, {S.normalise('w')}) THEN '<REDACTED>' ELSE w END), ' ') AS redacted
FROM documents
""")
def r14_redact_unigrams(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", R.redact_unigrams("text", LANG_FLAT).alias("redacted"))


@register("r15_redact_dataset_key", f"""
SELECT conv_id, turn, role,
       {S.redact_with_list("coalesce(text, '')", S.keyword_case("['AIRLINE','MEDIA','INSURANCE'][CAST(conv_id % 3 + 1 AS INTEGER)]", TEST_KEYWORDS))} AS text
FROM conversations
""")
def r15_redact_dataset_key(spark, sf_dir):
    """Whole-table redaction job: null fill, domain tag, redact, drop the domain."""
    c = read(spark, sf_dir, "conversations")
    dom = F.element_at(F.array(*[F.lit(x) for x in ("AIRLINE", "MEDIA", "INSURANCE")]),
                       (F.col("conv_id") % 3 + 1).cast("int"))
    c = c.withColumn("domain", dom)
    out = R.redact_dataset(c, "key", keywords=TEST_KEYWORDS, text_col="text", key_cols=["conv_id", "turn"],
                           domain_col="domain")
    return out.select("conv_id", "turn", "role", "text")


# ---------------------------------------------------------------------------
# Count-based naive Bayes trained on documents (label = language), vectoriser
# of word 1..2-grams; candidates of the classifier redactions are 1..2-grams.
NB_LO, NB_HI = 1, 2
SQL_NB = S.nb_model_ctes("SELECT lang AS label, text FROM documents", NB_LO, NB_HI)


def _nb(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(F.col("lang").alias("label"), "text")
    return R.fit_naive_bayes(d, "text", "label", NB_LO, NB_HI)


def _bench(spark, sf_dir):
    """Candidate texts: all turns of the conversations."""
    return read(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("item_id"), "text")


SQL_ITEMS = ("(SELECT CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS item_id, text FROM conversations)")


def _bench_grams(spark, sf_dir):
    g = R.explode_ngrams(_bench(spark, sf_dir), "text", ["item_id"], NB_LO, NB_HI)
    return g


SQL_BENCH_GRAMS = f"SELECT unnest({S.ngrams(S.tokens('text'), NB_LO, NB_HI)}) AS t FROM {SQL_ITEMS}"


@register("r7_nb_score", f"""
WITH {SQL_NB}, {S.nb_score_ctes(SQL_BENCH_GRAMS, NB_LO, NB_HI)}
SELECT t AS gram, label, round(prob, 6) AS prob FROM nb_scored
""")
def r7_nb_score(spark, sf_dir):
    m = _nb(spark, sf_dir)
    s = R.nb_score(_bench_grams(spark, sf_dir), m, "__gram", short=True)
    return s.select(F.col("__gram").alias("gram"), "label", F.round("prob", 6).alias("prob"))


@register("r10_class_keywords", f"""
WITH {SQL_NB}, {S.nb_score_ctes('SELECT gram AS t FROM nb_vocab', NB_LO, NB_HI)}
SELECT label, t AS gram, round(prob, 6) AS prob,
       row_number() OVER (PARTITION BY label ORDER BY round(prob, 9) DESC, t) AS rank
FROM nb_scored WHERE prob > 0.9
""")
def r10_class_keywords(spark, sf_dir):
    m = _nb(spark, sf_dir)
    s = R.nb_score(m["vocab"], m, "gram", short=True)
    k = R.class_keywords(s, 0.9)
    return k.select("label", "gram", F.round("prob", 6).alias("prob"), F.col("rank").cast("long").alias("rank"))


def _sql_fold_nb(hot_where: str, base_sql: str, key: str, dom_expr: str | None = None,
                 grams: str | None = None) -> str:
    grams = grams or S.ngrams(S.tokens("text"), NB_LO, NB_HI)
    items = f"SELECT unnest({grams}) AS t FROM ({base_sql})"
    return f"""
WITH {SQL_NB}, {S.nb_score_ctes(items, NB_LO, NB_HI)},
{S.fold_by_table(base_sql, key, 'b.text', grams, f'SELECT t, label FROM nb_scored WHERE {hot_where}', dom_expr)}
"""


@register("r8_redact_by_classifier", _sql_fold_nb("prob > 0.9", f"SELECT item_id, text FROM {SQL_ITEMS}", "item_id")
          + "SELECT item_id, redacted FROM folded")
def r8_redact_by_classifier(spark, sf_dir):
    out = R.redact_by_classifier(_bench(spark, sf_dir), _nb(spark, sf_dir), 0.9, "text", "redacted")
    return out.select("item_id", "redacted")


@register("r9_redact_by_classifier_domain",
          _sql_fold_nb("prob > 0.9", "SELECT doc_id, lang, text FROM documents", "doc_id", "lang")
          + "SELECT doc_id, lang, redacted FROM folded")
def r9_redact_by_classifier_domain(spark, sf_dir):
    out = R.redact_by_classifier(_docs(spark, sf_dir), _nb(spark, sf_dir), 0.9, "text", "redacted",
                                 domain_col="lang")
    return out.select("doc_id", "lang", "redacted")


@register("r11_redact_by_scores", _sql_fold_nb("prob >= 0.95", f"SELECT item_id, text FROM {SQL_ITEMS}", "item_id")
          + "SELECT item_id, redacted FROM folded")
def r11_redact_by_scores(spark, sf_dir):
    """External-classifier form: a score table ``(gram, label, prob)``, inclusive ``>=``."""
    scores = R.nb_score(_bench_grams(spark, sf_dir), _nb(spark, sf_dir), "__gram", short=True) \
        .withColumnRenamed("__gram", "gram")
    out = R.redact_by_scores(_bench(spark, sf_dir), scores, 0.95, "text", "redacted",
                             lo=NB_LO, hi=NB_HI)
    return out.select("item_id", "redacted")


# ---------------------------------------------------------------------------
# Token probability vectors = NB class probabilities of each token
# (labels in sorted order), merged into spans by Jensen–Shannon distance.
def _token_probs(spark, sf_dir, model=None):
    b = _bench(spark, sf_dir)
    toks = b.select("item_id", F.posexplode(T.tokens("text")).alias("tok_pos", "token"))
    vec = R.nb_probs_short(toks.select(F.col("token").alias("t")), model or _nb(spark, sf_dir), "t").withColumnRenamed("t", "token")
    return toks.join(vec, "token").select("item_id", (F.col("tok_pos") + 1).alias("tok_pos"), "token", "probs")


SQL_SPANS = f"""
tok AS (SELECT item_id, unnest(toks) AS token, generate_subscripts(toks, 1) AS tok_pos
        FROM (SELECT item_id, {S.tokens('text')} AS toks FROM {SQL_ITEMS})),
{S.nb_score_ctes('SELECT token AS t FROM tok', NB_LO, NB_HI)},
pv AS (SELECT t, list(prob ORDER BY label) AS probs FROM nb_scored GROUP BY t),
e AS (SELECT item_id, tok_pos, token, probs,
             lag(probs) OVER (PARTITION BY item_id ORDER BY tok_pos) AS prev
      FROM tok JOIN pv ON pv.t = tok.token),
n1 AS (SELECT *, list_transform(prev, lambda x: greatest(x, 0)) AS a,
                 list_transform(probs, lambda x: greatest(x, 0)) AS b FROM e),
n2 AS (SELECT *, list_sum(a) AS sa, list_sum(b) AS sb FROM n1),
n3 AS (SELECT *, list_transform(a, lambda x: x / sa) AS pa, list_transform(b, lambda x: x / sb) AS pb FROM n2),
n4 AS (SELECT *, list_transform(list_zip(pa, pb), lambda s: (s[1] + s[2]) / 2) AS mm FROM n3),
n5 AS (SELECT *, sqrt(greatest((
          list_sum(list_transform(list_zip(pa, mm), lambda s: CASE WHEN s[1] > 0 THEN s[1] * ln(s[1] / s[2]) ELSE 0 END))
        + list_sum(list_transform(list_zip(pb, mm), lambda s: CASE WHEN s[1] > 0 THEN s[1] * ln(s[1] / s[2]) ELSE 0 END))
        ) / 2, 0)) AS d FROM n4),
n6 AS (SELECT *, median(d) OVER (PARTITION BY item_id) AS med FROM n5),
n7 AS (SELECT *, sum(CASE WHEN d IS NULL OR NOT (round(d, 9) < round(med, 9)) THEN 1 ELSE 0 END)
                 OVER (PARTITION BY item_id ORDER BY tok_pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS span_pos
       FROM n6),
spans AS (SELECT item_id, CAST(span_pos AS BIGINT) AS span_pos, string_agg(token, ' ' ORDER BY tok_pos) AS span
          FROM n7 GROUP BY item_id, span_pos)"""


@register("r12_merge_spans", f"WITH {SQL_NB}, {SQL_SPANS} SELECT * FROM spans")
def r12_merge_spans(spark, sf_dir):
    sp = R.merge_spans(_token_probs(spark, sf_dir), ["item_id"])
    return sp.select("item_id", F.col("span_pos").cast("long").alias("span_pos"), "span")


@register("r13_redact_merged", f"""
WITH {SQL_NB}, {SQL_SPANS},
{S.nb_score_ctes('SELECT span AS t FROM spans', NB_LO, NB_HI, 'sp_scored')},
hot AS (SELECT DISTINCT t FROM sp_scored WHERE prob >= 0.95),
priv AS (SELECT item_id, list(span ORDER BY span_pos) AS pl FROM spans WHERE span IN (SELECT t FROM hot) GROUP BY item_id)
SELECT b.item_id, {S.fold('b.text', 'coalesce(p.pl, CAST([] AS VARCHAR[]))')} AS redacted
FROM {SQL_ITEMS} b LEFT JOIN priv p USING (item_id)
""")
def r13_redact_merged(spark, sf_dir):
    model = _nb(spark, sf_dir)
    tp = keep(_token_probs(spark, sf_dir, model))               # read by the spans' scores and by the redaction
    spans = R.merge_spans(tp, ["item_id"])
    scores = R.nb_score(spans, model, "span").withColumnRenamed("span", "gram")
    out = R.redact_merged(_bench(spark, sf_dir), tp, scores, 0.95, "text", "redacted", ["item_id"])
    return out.select("item_id", "redacted")


# R13 per domain and R15 with every method: the domain of a turn is one of the labels.
SQL_TAGGED = ("(SELECT CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS item_id, coalesce(text, '') AS text, "
              "['de', 'en', 'es', 'fr'][CAST(conv_id % 4 + 1 AS INTEGER)] AS dom FROM conversations)")


def _tagged(spark, sf_dir):
    dom = F.element_at(F.array(*[F.lit(x) for x in ("de", "en", "es", "fr")]), (F.col("conv_id") % 4 + 1).cast("int"))
    return read(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("item_id"), "text",
                                                       dom.alias("dom"))


@register("r15_redact_dataset_nb", _sql_fold_nb("prob > 0.9", f"SELECT item_id, dom, text FROM {SQL_TAGGED}", "item_id", "dom")
          + "SELECT item_id, redacted AS text FROM folded")
def r15_redact_dataset_nb(spark, sf_dir):
    """The whole-table job with the count NB model, each turn under its own domain."""
    out = R.redact_dataset(_tagged(spark, sf_dir), "nb", model=_nb(spark, sf_dir), text_col="text", domain_col="dom",
                           per_domain=True)
    return out.select("item_id", "text")


@register("r15_redact_dataset_scores", _sql_fold_nb("prob >= 0.95", f"SELECT item_id, text FROM {SQL_TAGGED}", "item_id")
          + "SELECT item_id, redacted AS text FROM folded")
def r15_redact_dataset_scores(spark, sf_dir):
    """The whole-table job with a score table, any class."""
    scores = R.nb_score(_bench_grams(spark, sf_dir), _nb(spark, sf_dir), "__gram", short=True).withColumnRenamed("__gram", "gram")
    out = R.redact_dataset(_tagged(spark, sf_dir), "scores", scores=scores, text_col="text", domain_col="dom")
    return out.select("item_id", "text")


@register("r15_redact_dataset_merged", f"""
WITH {SQL_NB}, {SQL_SPANS},
{S.nb_score_ctes('SELECT span AS t FROM spans', NB_LO, NB_HI, 'sp_scored')},
hot AS (SELECT DISTINCT t FROM sp_scored WHERE prob >= 0.95),
priv AS (SELECT item_id, list(span ORDER BY span_pos) AS pl FROM spans WHERE span IN (SELECT t FROM hot) GROUP BY item_id)
SELECT b.item_id, {S.fold('b.text', 'coalesce(p.pl, CAST([] AS VARCHAR[]))')} AS text
FROM {SQL_TAGGED} b LEFT JOIN priv p USING (item_id)
""")
def r15_redact_dataset_merged(spark, sf_dir):
    """The whole-table job over merged spans, any class."""
    model = _nb(spark, sf_dir)
    tp = keep(_token_probs(spark, sf_dir, model))               # read by the spans' scores and by the redaction
    scores = R.nb_score(R.merge_spans(tp, ["item_id"]), model, "span").withColumnRenamed("span", "gram")
    out = R.redact_dataset(_tagged(spark, sf_dir), "merged", token_probs=tp, scores=scores, text_col="text",
                           domain_col="dom", key_cols=["item_id"])
    return out.select("item_id", "text")


@register("r13_redact_merged_domain", _sql_fold_nb("prob >= 0.95", f"SELECT item_id, dom, text FROM {SQL_TAGGED}", "item_id", "dom",
                                                   grams=S.tokens("text"))
          + "SELECT item_id, redacted FROM folded")
def r13_redact_merged_domain(spark, sf_dir):
    """Spans per domain: vectors of one probability normalise to the same, so every token is a span (Q5)."""
    model = _nb(spark, sf_dir)
    t = _tagged(spark, sf_dir).withColumn("text", F.coalesce("text", F.lit("")))
    tp = _token_probs(spark, sf_dir, model).join(t.select("item_id", "dom"), "item_id")
    place = F.array_position(T.lit_array(model["labels"]), F.col("dom")).cast("int")
    tp = keep(tp.select("item_id", "tok_pos", "token", F.array(F.element_at("probs", place)).alias("probs")))
    scores = R.nb_score(R.merge_spans(tp, ["item_id"]), model, "span").withColumnRenamed("span", "gram")
    out = R.redact_merged(t, tp, scores, 0.95, "text", "redacted", ["item_id"], domain_col="dom")
    return out.select("item_id", "redacted")


# ---------------------------------------------------------------------------
# R6, all modes over a table of n-grams: which target domains redact a text.
# The twins fold the text once per domain and look for the token.
TARGET_LANGS = ["de", "es"]


def _in_domains(cols: dict[str, str]) -> str:
    """List of the domains whose condition holds, in order."""
    return "list_filter([" + ", ".join(f"CASE WHEN {cond} THEN {S.q(d)} END" for d, cond in cols.items()) + "], lambda x: x IS NOT NULL)"


def sql_redacted_in(base_sql: str, key: str, text: str, hot_where: str, domains) -> str:
    """CTEs ``marked(key, redacted_in)``: one fold per target domain under the NB model."""
    grams = S.ngrams(S.tokens(text), NB_LO, NB_HI)
    items = f"SELECT unnest({grams}) AS t FROM ({base_sql})"
    priv = ",".join(f"""
priv_{d} AS (SELECT {key}, list(g ORDER BY pos) AS pl FROM grams_of
             WHERE g IN (SELECT t FROM nb_scored WHERE label = {S.q(d)} AND {hot_where}) GROUP BY {key})""" for d in domains)
    joins = " ".join(f"LEFT JOIN priv_{d} USING ({key})" for d in domains)
    none = "CAST([] AS VARCHAR[])"
    conds = {d: f"contains({S.fold('b.' + text, f'coalesce(priv_{d}.pl, {none})')}, '<REDACTED>')" for d in domains}
    return f"""{SQL_NB}, {S.nb_score_ctes(items, NB_LO, NB_HI)},
marked_base AS ({base_sql}),
grams_of AS (SELECT {key}, unnest(grams) AS g, generate_subscripts(grams, 1) AS pos
             FROM (SELECT {key}, {grams} AS grams FROM marked_base)),{priv},
marked AS (SELECT b.{key}, b.{text}, {_in_domains(conds)} AS redacted_in FROM marked_base b {joins})"""


@register("r6_redacted_domains_keyword", f"""
SELECT doc_id, {_in_domains({d: f"contains({S.redact_with_list('text', S.sql_list(LANG_KEYWORDS[d]))}, '<REDACTED>')" for d in TARGET_LANGS})} AS redacted_in
FROM documents
""")
def r6_redacted_domains_keyword(spark, sf_dir):
    """Dictionary as a table, every target domain decided in one pass."""
    rows = [(d, w) for d, words in LANG_KEYWORDS.items() for w in words]
    bits = R.keyword_bits(spark.createDataFrame(rows, "domain string, phrase string"), TARGET_LANGS)
    out = R.redacted_domains(_docs(spark, sf_dir), bits, "text", TARGET_LANGS, 1, 3, normalise=True)
    return out.select("doc_id", "redacted_in")


@register("r6_redacted_domains_classifier", f"""
WITH {sql_redacted_in(f"SELECT item_id, text FROM {SQL_ITEMS}", "item_id", "text", "prob > 0.9", TARGET_LANGS)}
SELECT item_id, redacted_in, len(redacted_in) > 0 AS redacted_any FROM marked
""")
def r6_redacted_domains_classifier(spark, sf_dir):
    """Count NB model, strict threshold: all turns of the conversations."""
    items, model = _bench(spark, sf_dir), _nb(spark, sf_dir)
    bits = R.classifier_bits(items, model, TARGET_LANGS, 0.9, "text")
    out = R.redacted_domains(items, bits, "text", TARGET_LANGS, NB_LO, NB_HI)
    return out.select("item_id", "redacted_in", (F.size("redacted_in") > 0).alias("redacted_any"))


@register("r6_redacted_domains_scores", f"""
WITH {sql_redacted_in(f"SELECT item_id, text FROM {SQL_ITEMS}", "item_id", "text", "prob >= 0.95", TARGET_LANGS)}
SELECT item_id, redacted_in, len(redacted_in) > 0 AS redacted_any FROM marked
""")
def r6_redacted_domains_scores(spark, sf_dir):
    """A score table of an external classifier, inclusive threshold."""
    items = _bench(spark, sf_dir)
    scores = R.nb_score(_bench_grams(spark, sf_dir), _nb(spark, sf_dir), "__gram", short=True).withColumnRenamed("__gram", "gram")
    bits = R.score_bits(scores, TARGET_LANGS, 0.95)
    out = R.redacted_domains(items, bits, "text", TARGET_LANGS, NB_LO, NB_HI)
    return out.select("item_id", "redacted_in", (F.size("redacted_in") > 0).alias("redacted_any"))
