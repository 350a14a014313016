"""Column-expression builders for text.

All of these return ``Column`` objects made of Catalyst built-ins (including
higher-order functions), so they stay inside whole-stage codegen and run the
same way in batch and in Structured Streaming.
"""

from __future__ import annotations

from typing import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from veil.constants import PUNCTUATION_CHARS, REDACTED, WS_RUN


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def lit_array(values: Iterable[str]) -> Column:
    vals = list(values)
    if not vals:
        return F.array().cast("array<string>")
    return F.array(*[F.lit(v) for v in vals])


def tokens(text) -> Column:
    """Whitespace tokens as Python's ``str.split()`` gives them."""
    return F.filter(F.split(_c(text), WS_RUN), lambda t: t != F.lit(""))


def _join2(a, b):
    return F.concat(a, F.lit(" "), b)


def exact_ngrams(toks: Column, n: int) -> Column:
    """All n-grams of a token array (empty when shorter than n).

    Built from shifted slices zipped together, so the lambdas only touch
    their own arguments and the token array is computed a constant number of
    times per row (a lambda that reads an outer array would make it O(len²)).
    """
    size = F.size(toks)
    if n == 1:
        return toks
    k = size - (n - 1)
    acc = F.slice(toks, 1, F.greatest(k, F.lit(0)))
    for j in range(1, n):
        acc = F.zip_with(acc, F.slice(toks, j + 1, F.greatest(k, F.lit(0))), _join2)
    return F.when(k > 0, acc).otherwise(F.array().cast("array<string>"))


def word_ngrams_of_tokens(toks: Column, lo: int, hi: int) -> Column:
    """R1 on a token array: for n = hi..lo all ``min(n, len)``-grams, longest first.

    A text shorter than n yields the whole text once for that n; an empty
    token list yields nothing.
    """
    if lo < 1 or hi < lo:
        raise ValueError("need 1 <= lo <= hi")
    size = F.size(toks)
    whole = F.array(F.array_join(toks, " "))
    per_n = [F.when(size >= n, exact_ngrams(toks, n)).otherwise(whole) for n in range(hi, lo - 1, -1)]
    return F.when(size == 0, F.array().cast("array<string>")).otherwise(F.flatten(F.array(*per_n)))


def word_ngrams(text, lo: int = 1, hi: int = 3) -> Column:
    return word_ngrams_of_tokens(tokens(text), lo, hi)


def with_ngrams(df, text_col: str, lo: int = 1, hi: int = 3, out: str = "__grams",
                toks_col: str = "__toks"):
    """DataFrame form of R1: tokens are materialised in their own projection.

    The n-gram expression reads the token array many times; keeping the
    tokens as a column stops Catalyst from inlining (and re-splitting) them.
    """
    d = df.withColumn(toks_col, tokens(text_col))
    return d.withColumn(out, word_ngrams_of_tokens(F.col(toks_col), lo, hi))


def redact_df(df, text_col: str, keywords: Column, out_col: str, lo: int = 1, hi: int = 3):
    """R3 in array form on a DataFrame (see ``with_ngrams``)."""
    d = with_ngrams(df, text_col, lo, hi)
    private = F.filter(F.col("__grams"), lambda g: F.array_contains(keywords, normalise_ngram(g)))
    return d.withColumn(out_col, fold_replace(text_col, private)).drop("__toks", "__grams")


def normalise_ngram(g: Column) -> Column:
    """R2 key: lower-case, punctuation stripped at both ends."""
    return F.btrim(F.lower(g), F.lit(PUNCTUATION_CHARS))


def redaction_of(g: Column) -> Column:
    """k × ``<REDACTED>`` joined by spaces, k = number of words of the n-gram."""
    return F.array_join(F.array_repeat(F.lit(REDACTED), F.size(F.split(g, " "))), " ")


def _noop_safe(g: Column) -> Column:
    """True when a later replacement can never re-create ``g``: it holds no
    ``<``/``>`` and is not a piece of ``REDACTED`` — any new occurrence would
    have to overlap an inserted token."""
    return ~(F.contains(g, F.lit("<")) | F.contains(g, F.lit(">")) | F.contains(F.lit("REDACTED"), g))


def drop_noop_repeats(private_grams: Column) -> Column:
    """Exact shortcut of the fold: once a safe n-gram has been replaced its
    later repeats are no-ops, so when every private n-gram of a row is safe
    the list is deduplicated (first occurrences, order kept)."""
    return F.when(F.exists(private_grams, lambda g: ~_noop_safe(g)), private_grams) \
        .otherwise(F.array_distinct(private_grams))


def fold_replace(text, private_grams: Column) -> Column:
    """R3's fold: each private n-gram, in order, replaces every occurrence."""
    return F.aggregate(drop_noop_repeats(private_grams), _c(text),
                       lambda acc, g: F.replace(acc, g, redaction_of(g)))


def redact_with_array(text, keywords: Column, lo: int = 1, hi: int = 3) -> Column:
    """R3 with the dictionary as an array column (literal or per-row)."""
    grams = word_ngrams(text, lo, hi)
    private = F.filter(grams, lambda g: F.array_contains(keywords, normalise_ngram(g)))
    return fold_replace(text, private)


def is_redacted(text) -> Column:
    """R5."""
    return F.contains(_c(text), F.lit(REDACTED))


def strip_char_set(text, chars: str, side: str = "TRAILING") -> Column:
    """Python ``rstrip(chars)``/``lstrip``/``strip`` with a character set."""
    fn = {"TRAILING": F.rtrim, "LEADING": F.ltrim, "BOTH": F.btrim}[side.upper()]
    return fn(_c(text), F.lit(chars))


def truncate_at_stop(text, stops: Sequence[str]) -> Column:
    """Cut at the earliest occurrence of any stop token, then strip."""
    t = _c(text)
    pos = F.least(*[F.when(F.instr(t, s) > 0, F.instr(t, s)) for s in stops]) if len(stops) > 1 \
        else F.when(F.instr(t, stops[0]) > 0, F.instr(t, stops[0]))
    cut = F.when(pos.isNull(), t).otherwise(F.substr(t, F.lit(1), pos - 1))
    return py_strip(cut)


def py_strip(text) -> Column:
    """Python ``str.strip()``: whitespace removed at both ends."""
    return F.regexp_replace(_c(text), "^" + WS_RUN + "|" + WS_RUN + r"\z", "")


def strip_domain_tokens(text, tokens_: Sequence[str]) -> Column:
    """Remove every ``"<DOMAIN> "`` in one left-to-right pass."""
    import re
    pattern = "|".join(re.escape(t + " ") for t in tokens_)
    return F.regexp_replace(_c(text), pattern, "")
