"""The replacement fold as an Arrow-batched helper for long n-gram lists.

``text.replace(g, k × <REDACTED>)`` for each private n-gram in order costs
O(#grams × len) per row.  What is inserted begins with ``<``, ends with ``>`` and
holds pieces of ``REDACTED`` between such marks, so an n-gram can only meet it if it

* is a *piece* of ``REDACTED``: it then changes the inserted tokens, each alone and
  alike, and otherwise only text that stands yet; or
* holds a ``<`` or ``>`` that could be one of the tokens' (*mixed*).

All others are *safe*: later repeats of them are no-ops.  Without mixed n-grams the
fold is: find all occurrences of all n-grams in the original text at once
(Aho–Corasick), then, n-gram by n-gram in order, take its occurrences left to right
that do not overlap text replaced earlier; an inserted token is then what the pieces
that come later in the list make of it.  Rows with a mixed n-gram, and small rows, use
the plain sequential fold.  All paths give exactly the result of the sequential
``str.replace`` loop.
"""

from __future__ import annotations

from bisect import bisect_right

import ahocorasick
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from veil.constants import REDACTED


def _redaction(g: str) -> str:
    return " ".join([REDACTED] * len(g.split(" ")))


_MARKS = frozenset("<>REDACT")     # what stands beside a mark of an inserted token
SEQUENTIAL = 4_000_000             # n-grams times characters up to which the loop is the faster way


def _mixed(g: str) -> bool:
    """May meet a mark of an inserted token."""
    if not g:
        return True
    if "<" not in g and ">" not in g:
        return False
    return any((c == "<" and (i + 1 == len(g) or g[i + 1] in _MARKS)) or (c == ">" and (i == 0 or g[i - 1] in _MARKS))
               for i, c in enumerate(g))


def _replaced(text: str, grams) -> str:
    for g in grams:
        text = text.replace(g, _redaction(g))
    return text


def fold_text(text, grams) -> str | None:
    if text is None:
        return None
    grams = [] if grams is None else list(grams)
    if not grams:
        return text
    order = list(dict.fromkeys(grams))
    if any(_mixed(g) for g in order):
        return _replaced(text, grams)
    pieces = {g for g in order if g in REDACTED}
    if len(order) * len(text) <= SEQUENTIAL:
        seen = set()                        # later repeats of a safe n-gram are no-ops
        return _replaced(text, [g for g in grams if g in pieces or not (g in seen or seen.add(g))] if pieces else order)
    auto = ahocorasick.Automaton()
    for i, g in enumerate(order):
        auto.add_word(g, i)
    auto.make_automaton()
    occ = [[] for _ in order]
    for end, i in auto.iter(text):
        occ[i].append(end - len(order[i]) + 1)
    taken = bytearray(len(text))
    spans = []
    for i, g in enumerate(order):
        n, last_end, mark = len(g), -1, b"\x01" * len(g)
        for s in occ[i]:                        # ascending starts
            if s < last_end:
                continue
            e = s + n
            if taken.find(1, s, e) >= 0:
                continue
            taken[s:e] = mark
            spans.append((s, e, i))
            last_end = e
    if not spans:
        return text
    spans.sort()
    redaction = [None] * len(order)
    later = [(j, g) for j, g in enumerate(grams) if g in pieces]
    first = {}
    for j, g in enumerate(grams if later else ()):
        first.setdefault(g, j)
    tokens = {}                                 # by the pieces before: what those after make of a token
    parts, pos = [], 0
    for s, e, i in spans:
        if redaction[i] is None:
            if later:
                before = bisect_right(later, first[order[i]], key=lambda x: x[0])
                if before not in tokens:
                    tokens[before] = _replaced(REDACTED, [g for _, g in later[before:]])
                redaction[i] = " ".join([tokens[before]] * len(order[i].split(" ")))
            else:
                redaction[i] = _redaction(order[i])
        parts.append(text[pos:s])
        parts.append(redaction[i])
        pos = e
    parts.append(text[pos:])
    return "".join(parts)


@F.pandas_udf(StringType())
def fold_udf(text: pd.Series, grams: pd.Series) -> pd.Series:
    return pd.Series([fold_text(t, g) for t, g in zip(text, grams)])


def fold_places(text: str | None, places, lo: int, hi: int) -> str | None:
    """The fold of the n-grams whose places among the text's distinct ones (R1 order) are given."""
    if text is None or places is None or not len(places):
        return text
    toks = text.split()
    every = [" ".join(toks[i:i + m]) for m in (min(n, len(toks)) for n in range(hi, lo - 1, -1))
             for i in range(len(toks) - m + 1)]
    distinct = list(dict.fromkeys(every))
    private = {distinct[i] for i in places}
    return fold_text(text, [g for g in every if g in private])


def fold_places_udf(lo: int, hi: int):
    @F.pandas_udf(StringType())
    def fold(text: pd.Series, places: pd.Series) -> pd.Series:
        return pd.Series([fold_places(t, p, lo, hi) for t, p in zip(text, places)], dtype=object)
    return fold
