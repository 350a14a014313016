"""Redaction of domain-private n-grams.

Two physical forms of the same fold:

* **array form** — the dictionary is an array column (literal, or per-row via
  ``element_at(map, domain)``); n-grams, lookup and the ordered replacement
  fold are one higher-order expression per row: no shuffle at all.
* **exploded form** — n-grams are exploded with their position, the decision
  comes from a join against a scored/keyword table (broadcast when the table
  is small, shuffle join otherwise), private n-grams are collected back
  per row in (n-group, position) order and folded.  Used for large
  dictionaries and for model scores.

The fold (Q3) replaces every substring occurrence of each private n-gram, in
order, by k × ``<REDACTED>``.
"""

from __future__ import annotations

import math
from typing import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veil.constants import REDACTED
from veil.functions import chunks
from veil.functions import text as T
from veil.functions.ranking import null_safe_join
from veil.session import keep

# default thresholds per method (run_redaction)
DEFAULT_THRESHOLDS = {"key": None, "nb": 0.9, "scores": 0.95, "merged": 0.95}


# R1 / R2 ----------------------------------------------------------------------
word_ngrams = T.word_ngrams
normalise_ngram = T.normalise_ngram


def is_keyword(g, keywords: Sequence[str] | Column) -> Column:
    kw = keywords if isinstance(keywords, Column) else T.lit_array([k.lower() for k in keywords])
    return F.array_contains(kw, T.normalise_ngram(F.col(g) if isinstance(g, str) else g))


# R3 ---------------------------------------------------------------------------
def redact_keywords_col(text, keywords: Sequence[str], lo: int = 1, hi: int = 3) -> Column:
    """Array form of R3 for a flat dictionary (all domains)."""
    kw = T.lit_array(sorted({k.lower() for k in keywords}))
    return T.redact_with_array(text, kw, lo, hi)


def keyword_map_col(keyword_dict: Mapping[str, Sequence[str]]) -> Column:
    items = []
    for d, words in keyword_dict.items():
        items += [F.lit(d), T.lit_array([w.lower() for w in words])]
    return F.create_map(*items)


# R4 ---------------------------------------------------------------------------
def redact_keywords_by_domain_col(text, domain, keyword_dict: Mapping[str, Sequence[str]],
                                  lo: int = 1, hi: int = 3) -> Column:
    d = F.col(domain) if isinstance(domain, str) else domain
    kw = F.coalesce(F.element_at(keyword_map_col(keyword_dict), d),
                    F.array().cast("array<string>"))
    return T.redact_with_array(text, kw, lo, hi)


def redact_keywords(df: DataFrame, keywords, text_col: str = "utterance",
                    out_col: str | None = None, key_cols: Sequence[str] | None = None,
                    domain_col: str | None = None, lo: int = 1, hi: int = 3) -> DataFrame:
    """R3/R4 on a DataFrame; the kind of the dictionary chooses the physical form.

    ``keywords`` is a list (flat) or a dict (per domain, needs ``domain_col``),
    both held as an array in the plan, or a DataFrame ``(phrase[, domain])`` of
    any size, which is joined.  ``key_cols`` is not needed for either: rows are
    told apart by what the redaction depends on (text and domain).
    """
    out_col = out_col or text_col
    if not isinstance(keywords, DataFrame):
        if isinstance(keywords, Mapping):
            kw = F.coalesce(F.element_at(keyword_map_col(keywords), F.col(domain_col)),
                            F.array().cast("array<string>"))
        else:
            kw = T.lit_array(sorted({k.lower() for k in keywords}))
        return T.redact_df(df, text_col, kw, out_col, lo, hi)
    by_domain = domain_col is not None and "domain" in keywords.columns
    kw_df = keywords.select(F.lower("phrase").alias("__key"),
                            *([F.col("domain").alias("__dom")] if by_domain else [])).distinct()
    join_on = ["__key"] + (["__dom"] if by_domain else [])
    return redact_exploded(df, kw_df, join_on, text_col, out_col, domain_col if by_domain else None, lo, hi)


ROW_KEY = "__rk"


def with_row_key(df: DataFrame, text_col: str, domain_col: str | None = None) -> DataFrame:
    """Add a key of everything a redaction of the row depends on: its text and,
    per domain, its domain.  Never null; rows that share it have the same result."""
    parts = [F.col(text_col).alias("t")] + ([F.col(domain_col).alias("d")] if domain_col else [])
    return df.withColumn(ROW_KEY, F.unhex(F.md5(F.to_json(F.struct(*parts)).cast("binary"))))


def explode_ngrams(df: DataFrame, text_col: str, key_cols: Sequence[str], lo: int, hi: int,
                   domain_col: str | None = None) -> DataFrame:
    """One row per (row key, n-gram position, n-gram) — R1 in long form."""
    extra = [F.col(domain_col).alias("__dom")] if domain_col else []
    d = T.with_ngrams(df.select(*key_cols, *extra, text_col), text_col, lo, hi)
    return d.select(*key_cols, *(["__dom"] if domain_col else []),
                    F.posexplode_outer("__grams").alias("__gpos", "__gram")).where(F.col("__gpos").isNotNull())


def fold_collected(df: DataFrame, private: DataFrame, text_col: str, out_col: str,
                   key_cols: Sequence[str]) -> DataFrame:
    """Collect private n-grams per row in position order and fold them (see ``functions/fold.py``)."""
    from veil.functions.fold import fold_udf
    # rows with the same key have the same n-grams: a set, not a list
    per_row = private.groupBy(*key_cols).agg(
        F.array_sort(F.collect_set(F.struct("__gpos", "__gram"))).alias("__priv"))
    joined = null_safe_join(df, per_row, key_cols, "left")
    grams = F.coalesce(F.transform("__priv", lambda s: s["__gram"]), F.array().cast("array<string>"))
    return joined.withColumn(out_col, fold_udf(F.col(text_col), grams)).drop("__priv")


SMALL_DICTIONARY = 100_000       # phrases that every task may hold


def redact_exploded(df: DataFrame, kw_df: DataFrame, join_on: Sequence[str], text_col: str,
                    out_col: str, domain_col: str | None, lo: int, hi: int) -> DataFrame:
    """Each distinct n-gram of a text meets the dictionary once, where it stands if the
    dictionary is small; what comes back to a row are places, not strings."""
    from veil.functions.fold import fold_places_udf
    if kw_df.limit(SMALL_DICTIONARY + 1).count() <= SMALL_DICTIONARY:
        kw_df = F.broadcast(kw_df)
    keyed = with_row_key(df, text_col, domain_col)
    extra = [F.col(domain_col).alias("__dom")] if domain_col else []
    cut = T.with_ngrams(keyed.select(ROW_KEY, *extra, text_col), text_col, lo, hi).select(
        ROW_KEY, *(["__dom"] if domain_col else []), F.array_distinct("__grams").alias("__d"))
    g = cut.select(ROW_KEY, *(["__dom"] if domain_col else []), F.posexplode_outer("__d").alias("__i", "__gram")).where(
        F.col("__i").isNotNull()).withColumn("__key", T.normalise_ngram(F.col("__gram")))
    private = g.join(kw_df, on=list(join_on), how="left_semi")
    places = private.groupBy(ROW_KEY).agg(F.array_sort(F.collect_set("__i")).alias("__places"))
    joined = keyed.join(places, ROW_KEY, "left")
    return joined.withColumn(out_col, fold_places_udf(lo, hi)(F.col(text_col), F.col("__places"))).drop(ROW_KEY, "__places")


# R5 / R6 ----------------------------------------------------------------------
is_redacted = T.is_redacted


def is_redacted_any(text, domains: Sequence[str], keyword_dict: Mapping[str, Sequence[str]],
                    lo: int = 1, hi: int = 3) -> Column:
    """R6 for keyword redaction: redacted under any of the target domains."""
    conds = [T.is_redacted(redact_keywords_by_domain_col(text, F.lit(d), keyword_dict, lo, hi))
             for d in domains]
    out = conds[0]
    for c in conds[1:]:
        out = out | c
    return out


# R6 over a table: all target domains in one pass.  A text is redacted under a domain iff
# one of the domain's private n-grams occurs in it: the first that does is replaced, and
# whatever is replaced later leaves a whole token behind.  So no fold is needed, and one
# look-up of an n-gram answers for every domain, as a set of bits.
MOST_DOMAINS = 62


def _bit(label: Column, domains: Sequence[str]) -> Column:
    if len(domains) > MOST_DOMAINS:
        raise ValueError(f"at most {MOST_DOMAINS} target domains")
    return F.call_function("shiftleft", F.lit(1).cast("long"),
                           (F.array_position(T.lit_array(list(domains)), label) - 1).cast("int"))


def score_bits(scores: DataFrame, domains: Sequence[str], threshold: float, strict: bool = False) -> DataFrame:
    """(gram, bits): the domains whose probability passes, from ``scores(gram, label, prob)``."""
    passes = (F.col("prob") > threshold) if strict else (F.col("prob") >= threshold)
    return scores.where(passes & F.col("label").isin(list(domains))).groupBy("gram").agg(
        F.bit_or(_bit(F.col("label"), domains)).alias("bits"))


def keyword_bits(keywords: DataFrame, domains: Sequence[str]) -> DataFrame:
    """(gram, bits) from a dictionary ``(domain, phrase)`` of any size; grams are lower-cased."""
    return keywords.where(F.col("domain").isin(list(domains))).groupBy(F.lower("phrase").alias("gram")).agg(
        F.bit_or(_bit(F.col("domain"), domains)).alias("bits"))


def classifier_bits(df: DataFrame, model: dict, domains: Sequence[str], threshold: float = 0.9,
                    text_col: str = "utterance") -> DataFrame:
    """(gram, bits) of the n-grams of ``df`` under the count NB model (strict ``>``); each is scored once."""
    grams = T.with_ngrams(df.select(text_col), text_col, model["lo"], model["hi"]).select(
        F.explode_outer(F.array_distinct("__grams")).alias("gram")).where(F.col("gram").isNotNull())
    short = (model["lo"], model["hi"]) == (1, 2)
    probs = nb_probs_short(grams, model, "gram") if short else nb_probs(grams, model, "gram", space_joined=True)
    place = {label: k for k, label in enumerate(model["labels"])}
    bits = F.lit(0).cast("long")
    for k, d in enumerate(domains):
        if d in place:
            bits = bits.bitwiseOR(F.when(F.col("probs")[place[d]] > threshold, F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
    return probs.select("gram", bits.alias("bits")).where(F.col("bits") != 0)


def redacted_domains(df: DataFrame, bits: DataFrame, text_col: str, domains: Sequence[str], lo: int, hi: int,
                     out: str = "redacted_in", normalise: bool = False) -> DataFrame:
    """Add ``out``: the domains (in their order) under which the text would be redacted.

    ``bits(gram, bits)`` tells the private n-grams; ``normalise`` looks them up
    lower-cased and without outer punctuation (dictionaries).  Equal texts are
    looked at once; a null text gets null.
    """
    domains = list(domains)
    token = F.contains(F.col(text_col), F.lit(REDACTED))
    # what is asked of the text itself is asked before the join: only its answers need travel
    keyed = with_row_key(df, text_col).withColumn("__some", F.col(text_col).isNotNull()).withColumn("__token", token)
    texts = keyed.where(F.col(text_col).isNotNull()).select(ROW_KEY, F.col(text_col).alias("__t"))
    if normalise and bits.limit(SMALL_DICTIONARY + 1).count() <= SMALL_DICTIONARY:
        # the n-grams stay where they are; those of equal texts come together by their key
        bits = F.broadcast(bits)
    else:
        texts = texts.dropDuplicates([ROW_KEY])
    cut = T.with_ngrams(texts, "__t", lo, hi)
    # tokens joined by single blanks hold every n-gram; of other texts some are not in the text
    plain = F.contains(F.col("__t"), F.array_join("__toks", " "))
    grams = cut.select(ROW_KEY, plain.alias("__plain"), F.explode_outer(F.array_distinct("__grams")).alias("__gram")).where(
        F.col("__gram").isNotNull())
    key = T.normalise_ngram(F.col("__gram")) if normalise else F.col("__gram")
    # read by both branches below: looked up (and their bits scored) once
    private = keep(grams.withColumn("gram", key).join(bits, "gram").select(
        ROW_KEY, "__plain", F.when(~F.col("__plain"), F.col("__gram")).alias("__gram"), "bits"))
    sure = private.where("__plain").groupBy(ROW_KEY).agg(F.bit_or("bits").alias("bits"))
    spaced = cut.where(~plain).select(ROW_KEY, "__t").dropDuplicates([ROW_KEY])
    maybe = private.where(~F.col("__plain")).groupBy(ROW_KEY).agg(
        F.collect_set(F.struct("__gram", "bits")).alias("__x")).join(spaced, ROW_KEY)
    found = F.filter("__x", lambda x: F.contains(F.col("__t"), x["__gram"]))
    checked = maybe.select(ROW_KEY, F.aggregate(found, F.lit(0).cast("long"),
                                                lambda s, x: s.bitwiseOR(x["bits"])).alias("bits"))
    joined = keyed.join(sure.unionByName(checked), ROW_KEY, "left")
    every = F.lit((1 << len(domains)) - 1).cast("long")
    bit = F.when(F.col("__token"), every).otherwise(F.coalesce("bits", F.lit(0).cast("long")))
    names = F.filter(T.lit_array(domains), lambda d: bit.bitwiseAND(_bit(d, domains)) != 0)
    return joined.withColumn(out, F.when(F.col("__some"), names)).drop(ROW_KEY, "bits", "__some", "__token")


# Count-based naive Bayes ------------------------------------------------
def feature_ngrams(text, lo: int, hi: int, space_joined: bool = False) -> Column:
    """Vectoriser of the NB model: lower-cased word n-grams for n in lo..hi.

    ``space_joined``: the text is known to be tokens joined by single spaces
    (candidate n-grams, merged spans), so a literal split replaces the
    whitespace regex — same tokens, much cheaper per row.
    """
    t = F.lower(F.col(text) if isinstance(text, str) else text)
    toks = F.split(t, " ") if space_joined else T.tokens(t)
    return F.flatten(F.array(*[T.exact_ngrams(toks, n) for n in range(lo, hi + 1)]))


def fit_naive_bayes(train: DataFrame, text_col: str = "text", label_col: str = "label",
                    lo: int = 1, hi: int = 1, alpha: float = 1.0) -> dict:
    """Multinomial NB with Laplace smoothing, as Spark tables.

    * ``contrib(gram, contrib array<double>)`` — per vocabulary gram, its log
      probability under each label (labels in sorted order); a gram never seen
      with a label contributes that label's ``unseen`` value.  One row per
      gram: scoring needs no (item × label) expansion.
    * ``logp(gram, label, logp)`` — the observed pairs (long form).
    * ``labels``, ``prior``, ``unseen`` — per-class values: the only driver
      objects, bounded by the number of classes.
    """
    ndocs = {r["label"]: r["c"] for r in
             train.groupBy(F.col(label_col).alias("label")).agg(F.count(F.lit(1)).alias("c")).collect()}
    labels = sorted(ndocs)
    # tokens in a projection of their own: the n-grams read them many times
    cut = train.select(F.col(label_col).alias("label"), T.tokens(F.lower(F.col(text_col))).alias("__toks"))
    # a place's word with the next ones, then its n-grams (null past the end): no array of all n-grams of a text
    n_words = F.greatest(F.size("__toks"), F.lit(0))
    ahead = F.arrays_zip(*[F.slice("__toks", n, n_words).alias(f"w{n}") for n in range(1, hi + 1)])
    places = cut.select("label", F.explode_outer(ahead).alias("w"))
    grams = F.array(*[F.concat(*[x for k in range(1, n + 1) for x in (F.lit(" "), F.col(f"w.w{k}"))][1:])
                      for n in range(lo, hi + 1)])
    feats = places.select("label", F.explode_outer(grams).alias("gram")).where(F.col("gram").isNotNull())
    # one row per gram, one count per label: a plain hash aggregation and the only
    # shuffle of the grams; materialised once (memory, then disk)
    counts = keep(feats.groupBy("gram").agg(*[F.count_if(F.col("label") == l).alias(f"__n{i}") for i, l in enumerate(labels)]))
    sums = counts.agg(F.count(F.lit(1)).alias("v"), *[F.sum(f"__n{i}").alias(f"t{i}") for i in range(len(labels))]).first()
    vocab_n, tot = sums["v"], [sums[f"t{i}"] or 0 for i in range(len(labels))]
    n_all = sum(ndocs.values())
    prior = [math.log(ndocs[l]) - math.log(n_all) for l in labels]
    denom = [t + alpha * vocab_n for t in tot]
    unseen = [math.log(alpha) - math.log(d) if d > 0 else 0.0 for d in denom]
    seen = [F.log(F.col(f"__n{i}") + F.lit(alpha)) - F.log(F.lit(float(d))) for i, d in enumerate(denom)]
    contrib = counts.select("gram", F.array(*[F.when(F.col(f"__n{i}") > 0, x).otherwise(F.lit(u))
                                              for i, (x, u) in enumerate(zip(seen, unseen))]).alias("contrib"))
    logp = counts.select("gram", F.explode(F.array(*[F.struct(F.lit(l).alias("label"), F.col(f"__n{i}").alias("n"), x.alias("logp"))
                                                     for i, (l, x) in enumerate(zip(labels, seen))])).alias("s")).where(
        "s.n > 0").select("gram", "s.label", "s.logp")
    return {"contrib": contrib, "logp": logp, "labels": labels, "prior": prior, "unseen": unseen,
            "vocab": contrib.select("gram"), "lo": lo, "hi": hi}


def nb_probs(items: DataFrame, model: dict, text_col: str = "gram", space_joined: bool = False,
             include_oov: bool = True) -> DataFrame:
    """R7 in array form: ``(text, probs array<double>)`` per distinct item, the
    class probabilities in the model's label order.

    jll = prior + Σ over the item's in-vocabulary features of their
    contribution arrays (one summed column per label: a plain hash
    aggregation); probs = softmax(jll).
    """
    lo, hi = model["lo"], model["hi"]
    n_labels = len(model["labels"])
    distinct_items = items.select(F.col(text_col).alias("__t")).distinct()
    feats = (distinct_items.select("__t", F.explode_outer(feature_ngrams("__t", lo, hi, space_joined)).alias("gram"))
             .where(F.col("gram").isNotNull()))
    summed = (feats.join(model["contrib"], "gram", "inner")
              .groupBy("__t").agg(*[F.sum(F.col("contrib")[i]).alias(f"__s{i}") for i in range(n_labels)]))
    jll = F.array(*[F.lit(p) + F.coalesce(F.col(f"__s{i}"), F.lit(0.0)) for i, p in enumerate(model["prior"])])
    from veil.functions.arrays import softmax
    if not include_oov:
        # items without any in-vocabulary feature (probs = softmax(prior)) are
        # left out: the caller has decided that they can never be private
        return summed.select(F.col("__t").alias(text_col), softmax(jll).alias("probs"))
    return (distinct_items.join(summed, "__t", "left")
            .select(F.col("__t").alias(text_col), softmax(jll).alias("probs")))


def nb_probs_short(grams: DataFrame, model: dict, text_col: str, include_oov: bool = True) -> DataFrame:
    """``nb_probs`` of space-joined n-grams of one or two words under a model of
    1–2-grams: such an item has at most three features (each word and the pair),
    so its contributions are look-ups in place of an explode and a sum: the item
    meets the vocabulary once, a pair's words meet the single words only.  The
    model's own vocabulary (``model["vocab"]``) is scored from its table as it is."""
    if (model["lo"], model["hi"]) != (1, 2):
        raise ValueError("needs a model of 1-2-grams")
    if grams is model["vocab"]:
        d = model["contrib"].withColumn("__t", F.col("gram"))
    else:
        items = grams.select(F.col(text_col).alias("__t")).distinct().withColumn("gram", F.lower("__t"))
        d = items.join(model["contrib"], "gram", "left")
    d = _word_contribs(d, model)
    if not include_oov:
        d = d.where(F.coalesce("contrib", "__c0", "__c1").isNotNull())
    pair = F.contains(F.col("gram"), F.lit(" "))               # a pair adds its own contribution to its words'
    d = _with_probs(d, [F.col("__c0"), F.col("__c1"), F.when(pair, F.col("contrib"))], model)
    probs = [F.col(f"__p{i}") for i in range(len(model["labels"]))]
    return d.select(F.col("__t").alias(text_col), F.array(*probs).alias("probs"))


def nb_score(items: DataFrame, model: dict, text_col: str = "gram", space_joined: bool = False,
             short: bool = False) -> DataFrame:
    """R7 in long form ``(text, label, prob)``; ``short``: the items are n-grams
    of one or two words joined by a blank (see ``nb_probs_short``)."""
    short = short and (model["lo"], model["hi"]) == (1, 2)
    p = nb_probs_short(items, model, text_col) if short else nb_probs(items, model, text_col, space_joined)
    labels = T.lit_array(model["labels"])
    # the outer form: of an inner one Catalyst infers a filter that computes all probabilities again, inlined
    return p.select(text_col, F.posexplode_outer("probs").alias("__i", "prob")).where(F.col("__i").isNotNull()).select(
        text_col, F.element_at(labels, F.col("__i") + 1).alias("label"), "prob")


def class_keywords(vocab_scores: DataFrame, threshold: float, label: str | None = None) -> DataFrame:
    """Vocabulary terms whose class probability passes (strict), descending."""
    s = vocab_scores if label is None else vocab_scores.where(F.col("label") == label)
    s = s.where(F.col("prob") > threshold)
    # probabilities are compared at 1e-9 so that summation-order noise does
    # not reorder ties; equal ones are ordered by the term.  A label's share of
    # the vocabulary is ranked by range partitions, not in one task.
    from veil.functions.ranking import positions
    r = positions(s, ["label"], [-F.round("prob", 9), F.col("gram")], out="rank")
    return r.withColumn("rank", F.col("rank") + 1)


# Decision by a score table ------------------------------------------
def redact_by_scores(df: DataFrame, scores: DataFrame, threshold: float, text_col: str = "utterance",
                     out_col: str | None = None, key_cols: Sequence[str] | None = None,
                     domain_col: str | None = None, lo: int = 1, hi: int = 2,
                     strict: bool = False, grams: DataFrame | None = None) -> DataFrame:
    """Fold with the decision "class probability passes the threshold".

    ``scores(gram, label, prob)``: any class counts, or only the row's domain
    when ``domain_col`` is given (R9/R11 per domain).  NB uses ``>`` (strict),
    external classifiers ``>=``.  ``grams`` may pass pre-built n-grams (R13),
    which carry the ``key_cols`` of their row (and ``__dom`` per domain).
    """
    out_col = out_col or text_col
    if grams is None:
        df = with_row_key(df, text_col, domain_col)
        g, key_cols = explode_ngrams(df, text_col, [ROW_KEY], lo, hi, domain_col), [ROW_KEY]
    else:
        g, key_cols = grams, list(key_cols)
    passes = (F.col("prob") > threshold) if strict else (F.col("prob") >= threshold)
    hot = scores.where(passes).select(F.col("gram").alias("__gram"),
                                      F.col("label").alias("__dom")).distinct()
    if domain_col:
        private = g.join(hot, ["__gram", "__dom"], "left_semi")
    else:
        private = g.join(hot.select("__gram").distinct(), ["__gram"], "left_semi")
    return fold_collected(df, private, text_col, out_col, key_cols).drop(ROW_KEY)


def _with_probs(df: DataFrame, parts: Sequence[Column], model: dict) -> DataFrame:
    """Add ``__p0``, ``__p1``, …: the probability of each label.

    ``parts`` are contribution arrays (null: none).  Plain columns, one a label:
    arrays would be built again for every use.
    """
    own = range(len(model["labels"]))
    d = df
    for i, p in enumerate(model["prior"]):
        total = F.coalesce(parts[0][i], F.lit(0.0))
        for x in parts[1:]:
            total = total + F.coalesce(x[i], F.lit(0.0))
        d = d.withColumn(f"__j{i}", F.lit(p) + total)
    top = F.greatest(*[F.col(f"__j{i}") for i in own]) if len(own) > 1 else F.col("__j0")
    d = d.withColumn("__top", top)
    d = d.withColumns({f"__e{i}": F.exp(F.col(f"__j{i}") - F.col("__top")) for i in own})
    d = d.withColumn("__all", sum((F.col(f"__e{i}") for i in own), F.lit(0.0)))
    return d.withColumns({f"__p{i}": F.col(f"__e{i}") / F.col("__all") for i in own}).drop(
        "__top", "__all", *[f"__{c}{i}" for i in own for c in "je"])


def _with_private_bits(df: DataFrame, parts: Sequence[Column], model: dict, threshold: float) -> DataFrame:
    """Add ``bits``: bit i is set where the probability of label i passes (strict)."""
    own = range(len(model["labels"]))
    bits = sum((F.when(F.col(f"__p{i}") > threshold, F.lit(1 << i)).otherwise(F.lit(0)).cast("long")
                for i in own), F.lit(0).cast("long"))
    return _with_probs(df, parts, model).withColumn("bits", bits).drop(*[f"__p{i}" for i in own])


def _word_contribs(grams: DataFrame, model: dict) -> DataFrame:
    """Add the contributions ``__c0``, ``__c1`` of the one or two words of ``gram`` (null: not in the vocabulary)."""
    words = F.split("gram", " ")
    d = grams.withColumn("__w0", words[0]).withColumn("__w1", F.when(F.size(words) == 2, words[1]))
    single = model["contrib"].where(~F.contains(F.col("gram"), F.lit(" ")))
    for k in range(2):
        d = d.join(single.select(F.col("gram").alias(f"__w{k}"), F.col("contrib").alias(f"__c{k}")), f"__w{k}", "left")
    return d.drop("__w0", "__w1")


def gram_bits(grams: DataFrame, model: dict, threshold: float) -> DataFrame:
    """(gram, bits): for every distinct ``gram`` of one or two lower-cased words the labels under which it is
    private, where there are any.  Of the vocabulary only these grams and their words travel."""
    d = grams.select("gram").distinct().join(model["contrib"], "gram", "left")
    own = F.contains(F.col("gram"), F.lit(" "))                # a pair adds its own contribution to its words'
    parts = [F.col("__c0"), F.col("__c1"), F.when(own, F.col("contrib"))]
    return _with_private_bits(_word_contribs(d, model), parts, model, threshold).select("gram", "bits").where(F.col("bits") != 0)


_NONE, _ANY = -1, -2             # labels that make an n-gram of a row private


def _redact_short(df: DataFrame, model: dict, threshold: float, text_col: str, out_col: str,
                  domain_col: str | None) -> DataFrame:
    """Grams of one or two words under a model of the same.

    A chunk of texts asks for the training counts of its distinct words and pairs
    (``functions/chunks.py``), scores them and folds its texts: neither the
    vocabulary is scored beyond them nor does an n-gram travel once a text.
    """
    from veil.functions.fold import fold_text
    labels, prior = list(model["labels"]), np.array(model["prior"])
    n_labels = len(labels)
    if domain_col:
        want = F.coalesce(F.array_position(T.lit_array(labels), F.col(domain_col)).cast("int"), F.lit(0)) - 1
    else:
        want = F.lit(_ANY)
    rows = chunks.dealt(df.withColumn("__want", want), [text_col])

    def tokens_of(table):
        texts, wanted = table.column(text_col).to_pylist(), table.column("__want").to_pylist()
        return texts, wanted, ([] if t is None or w == _NONE else t.split() for t, w in zip(texts, wanted))

    def ask(table: pa.Table) -> pa.Table:
        return chunks.words_and_pairs(table.column(chunks.CHUNK)[0].as_py(), tokens_of(table)[2])

    def look_up(asked):
        grams = asked.withColumn("gram", F.lower(F.concat_ws(" ", "w0", "w1")))
        return grams.join(model["contrib"], "gram").select(
            chunks.CHUNK, "id", *[F.col("contrib")[i].alias(f"c{i}") for i in range(n_labels)])

    def private(total):
        """[n-grams, labels] whether the probability passes (strict)."""
        j = prior + total
        e = np.exp(j - j.max(axis=1, keepdims=True))
        every = np.zeros(len(e))
        for i in range(n_labels):
            every = every + e[:, i]
        return e / every[:, None] > threshold

    def finish(table: pa.Table, answers: pa.Table) -> pa.Table:
        texts, wanted, token_lists = tokens_of(table)
        x = chunks.Numbered(token_lists)
        of_words, of_pairs = x.known(answers.column("id").to_numpy(), np.stack(
            [answers.column(f"c{i}").to_numpy() for i in range(n_labels)], axis=1))
        words, pairs = private(of_words), private(of_words[x.first] + of_words[x.second] + of_pairs)
        if not domain_col:
            words, pairs = words.any(axis=1, keepdims=True), pairs.any(axis=1, keepdims=True)
        words, pairs, out = words[x.codes], pairs[x.pair_of], []
        ends, pair_ends = np.cumsum(x.sizes), np.cumsum(np.maximum(x.sizes - 1, 0))
        for t, w, n, end, pair_end in zip(texts, wanted, x.sizes, ends, pair_ends):
            if not n:
                out.append(t)
                continue
            toks, label = t.split(), w if domain_col else 0
            single = [toks[i] for i in np.flatnonzero(words[end - n:end, label])]
            # a text of one word gives it for either length
            longer = [f"{toks[i]} {toks[i + 1]}" for i in np.flatnonzero(pairs[pair_end - n + 1:pair_end, label])] if n > 1 else single
            out.append(fold_text(t, longer + single))
        kept = table.drop_columns([chunks.CHUNK, "__want"])
        done = pa.array(out, pa.string())
        at = kept.schema.get_field_index(out_col)
        return kept.append_column(out_col, done) if at < 0 else kept.set_column(at, out_col, done)

    shape = df.withColumn(out_col, F.lit(None).cast("string")).schema
    return chunks.looked_up(rows, ask, chunks.ASKED, look_up, finish, shape)


def redact_by_classifier(df: DataFrame, model: dict, threshold: float = 0.9,
                         text_col: str = "utterance", out_col: str | None = None,
                         domain_col: str | None = None,
                         lo: int | None = None, hi: int | None = None) -> DataFrame:
    """R8 (any class) / R9 (the row's domain) with the count NB model, strict ``>``.

    The candidate n-gram range is the vectoriser's unless given.  Distinct
    candidates are scored once; the decision is joined back to the exploded
    n-grams.
    """
    lo = model["lo"] if lo is None else lo
    hi = model["hi"] if hi is None else hi
    out_col = out_col or text_col
    if (model["lo"], model["hi"], lo, hi) == (1, 2, 1, 2) and len(model["labels"]) <= MOST_DOMAINS:
        return _redact_short(df, model, threshold, text_col, out_col, domain_col)
    df, keys = with_row_key(df, text_col, domain_col), [ROW_KEY]
    g = explode_ngrams(df, text_col, keys, lo, hi, domain_col)
    # a candidate with no in-vocabulary feature gets the prior; when no class's
    # prior passes the threshold such candidates are never private and the
    # scoring skips them (no join back to all candidates)
    m = max(model["prior"])
    z = sum(math.exp(p - m) for p in model["prior"])
    prior_passes = any(math.exp(p - m) / z > threshold for p in model["prior"])
    probs = nb_probs(g, model, "__gram", space_joined=True, include_oov=prior_passes)
    if domain_col:
        labels = T.lit_array(model["labels"])
        hot = probs.select("__gram", F.explode(F.filter(
            F.transform("probs", lambda p, i: F.struct(F.element_at(labels, i + 1).alias("__dom"), p.alias("p"))),
            lambda s: s["p"] > threshold)).alias("s")).select("__gram", F.col("s.__dom").alias("__dom"))
        private = g.join(hot, ["__gram", "__dom"], "left_semi")
    else:
        hot = probs.where(F.exists("probs", lambda p: p > threshold)).select("__gram")
        private = g.join(hot, ["__gram"], "left_semi")
    return fold_collected(df, private, text_col, out_col, keys).drop(ROW_KEY)


# Span merging ---------------------------------------------------------
def js_distance(p, q) -> Column:
    """Jensen–Shannon distance (natural log), negatives clipped, sides normalised."""
    p = F.transform(p, lambda x: F.greatest(x.cast("double"), F.lit(0.0)))
    q = F.transform(q, lambda x: F.greatest(x.cast("double"), F.lit(0.0)))
    sp = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    sq = F.aggregate(q, F.lit(0.0), lambda a, x: a + x)
    p = F.transform(p, lambda x: x / sp)
    q = F.transform(q, lambda x: x / sq)
    m = F.zip_with(p, q, lambda a, b: (a + b) / 2)

    def kl(a, mm):
        return F.aggregate(F.zip_with(a, mm, lambda x, y: F.when(x > 0, x * F.log(x / y)).otherwise(0.0)),
                           F.lit(0.0), lambda acc, v: acc + v)
    js = (kl(p, m) + kl(q, m)) / 2
    return F.sqrt(F.greatest(js, F.lit(0.0)))


def merge_spans(token_probs: DataFrame, key_cols: Sequence[str] = ("id",)) -> DataFrame:
    """Tokens ``(key…, tok_pos, token, probs array<double>)`` → spans.

    An edge (t-1, t) is kept iff its JS distance is below the utterance's
    median edge distance; spans are islands of kept edges.  One-token texts
    are unchanged.  Three windows on the same key: one shuffle.
    """
    key_cols = list(key_cols)
    w = Window.partitionBy(*key_cols).orderBy("tok_pos")
    wk = Window.partitionBy(*key_cols)
    t = token_probs.withColumn("__d", js_distance(F.lag("probs").over(w), F.col("probs")))
    t = t.withColumn("__med", F.median("__d").over(wk))
    # distances and the median are compared at 1e-9: below that the order of
    # floating-point sums decides, not the data
    d9, m9 = F.round("__d", 9), F.round("__med", 9)
    cut = F.when(F.col("__d").isNull() | ~(d9 < m9), 1).otherwise(0)
    t = t.withColumn("__span", F.sum(cut).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return (t.groupBy(*key_cols, "__span")
            .agg(F.array_sort(F.collect_list(F.struct("tok_pos", "token"))).alias("__toks"))
            .select(*key_cols, F.col("__span").alias("span_pos"),
                    F.array_join(F.transform("__toks", lambda s: s["token"]), " ").alias("span")))


def redact_merged(df: DataFrame, token_probs: DataFrame, span_scores: DataFrame, threshold: float = 0.95,
                  text_col: str = "utterance", out_col: str | None = None,
                  key_cols: Sequence[str] = ("id",), domain_col: str | None = None) -> DataFrame:
    """Merged spans are the candidate n-grams, decided by ``span_scores``;
    with ``domain_col`` only the score for the row's own domain counts."""
    spans = merge_spans(token_probs, key_cols)
    g = spans.select(*key_cols, F.col("span_pos").alias("__gpos"), F.col("span").alias("__gram"))
    if domain_col:
        domains = df.select(*key_cols, F.col(domain_col).alias("__dom")).distinct()
        g = null_safe_join(g, domains, key_cols)
    return redact_by_scores(df, span_scores, threshold, text_col, out_col, key_cols,
                            domain_col, strict=False, grams=g)


# R14 ------------------------------------------------------------------------------
def redact_unigrams(text, keywords: Sequence[str] | Column) -> Column:
    """Token-wise replacement; whitespace collapsed to single spaces."""
    kw = keywords if isinstance(keywords, Column) else T.lit_array([k.lower() for k in keywords])
    toks = T.tokens(text)
    return F.array_join(F.transform(toks, lambda w: F.when(
        F.array_contains(kw, T.normalise_ngram(w)), F.lit(REDACTED)).otherwise(w)), " ")


# R15 ------------------------------------------------------------------------------
def redact_dataset(df: DataFrame, method: str, *, keywords=None, domain: str | None = None,
                   domain_col: str | None = None, scores: DataFrame | None = None,
                   model: dict | None = None, token_probs: DataFrame | None = None,
                   threshold: float | None = None, key_cols: Sequence[str] = ("id",),
                   text_col: str = "utterance", lo: int = 1, hi: int | None = None,
                   per_domain: bool = False) -> DataFrame:
    """Null fill, domain tag, redact the text column, other columns untouched,
    domain dropped before writing.

    ``method`` ∈ {key, nb, scores, merged} (exact match, Q12).  ``domain`` is a
    constant tag (a file's stem, upper-cased, Q4); ``domain_col`` an existing
    per-row column.  A dict of keywords redacts per domain, a list with all;
    a dictionary table does so by its ``domain`` column.  ``per_domain`` makes
    the model methods heed the row's own domain only.  N-grams go up to three
    words for keywords and up to two for scores unless ``hi`` is given.
    """
    if method not in DEFAULT_THRESHOLDS:
        raise ValueError(f"unknown method {method!r}")
    thr = DEFAULT_THRESHOLDS[method] if threshold is None else threshold
    d = df.withColumn(text_col, F.coalesce(F.col(text_col), F.lit("")))
    dcol = domain_col
    if domain is not None:
        d = d.withColumn("__domain", F.lit(domain.upper()))
        dcol = "__domain"
    model_domain = dcol if per_domain else None
    if method == "key":
        flat = not isinstance(keywords, (Mapping, DataFrame))
        out = redact_keywords(d, keywords, text_col, domain_col=None if flat else dcol, lo=lo, hi=hi or 3)
    elif method == "nb":
        out = redact_by_classifier(d, model, thr, text_col, domain_col=model_domain)
    elif method == "scores":
        out = redact_by_scores(d, scores, thr, text_col, domain_col=model_domain, lo=lo, hi=hi or 2)
    else:
        out = redact_merged(d, token_probs, scores, thr, text_col, key_cols=key_cols, domain_col=model_domain)
    return out.drop(*[c for c in (dcol,) if c])
