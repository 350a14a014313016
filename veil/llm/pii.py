"""Personal data: base patterns, and a linear-chain conditional random field.

The base rules find e-mail addresses, IP addresses, card and phone numbers in
their plain forms; their spans always stay.  The random field adds spelled or
otherwise punctuated forms (``ann [at] host [dot] org``, ``(212) 555-0187``).
It labels tokens (letter runs, digit runs, single other characters) by their
word shapes and those of their neighbours, is trained by maximum likelihood on
a small labelled table, and decodes numpy batches by Viterbi.  Each kind needs
a digit or an at sign, so the field reads the surroundings of those only:
every stretch of text within ``REACH`` characters of one.  An added span must
hold as many digits as its kind allows and touches no base span.

Results per case: null and empty texts have no spans; whole texts of any
length, in linear time; equal starts of one kind cannot occur; repeated rows
are treated alike; an empty table gives an empty result; extra columns are
not read (``redact`` hands them on).
"""

from __future__ import annotations

import re
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veil.llm import common as C

KINDS = ("email", "ip", "card", "phone")
REACH = 64
LONGEST = 5_000                     # tokens whose features are held together; a longer stretch goes on from block to block
MAX_LABELLED = 5_000                # rows of the labelled table
_DIGITS = {"email": (0, 40), "ip": (4, 12), "card": (13, 19), "phone": (7, 15)}

_LOCAL = "".join(chr(c) for c in range(48, 58)) + "".join(map(chr, range(65, 91))) + "".join(
    map(chr, range(97, 123))) + "._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match begins where its digit run begins, so the look-behind only saves time
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SEED = re.compile(r"[0-9@]|[\[({]\s?at\s?[\])}]", re.I)
_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|\S")
_DIGIT = re.compile("[0-9]")


def _luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    even = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (odd + even) % 10 == 0


def _emails(text: str):
    at, found = 0, []
    sign = text.find("@")
    while sign >= 0:
        begin = at + len(text[at:sign].rstrip(_LOCAL)) if sign > at else sign
        m = _DOMAIN.match(text, sign + 1) if begin < sign else None
        if m:
            found.append((begin, m.end()))
            at = m.end()
        sign = text.find("@", max(sign + 1, at))
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) by kind, then start."""
    if not _DIGIT.search(text):
        return [(0, a, b) for a, b in _emails(text)] if "@" in text else []
    out = [(0, a, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and _luhn(digits):
            out.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append((3, *m.span()))
    return out


# ---------------------------------------------------------------------------
# The labelled table: <kind>text</kind> marks a span.

_LINES = """
please call <phone>(212) 555-0187</phone> before noon
phone: <phone>212-555-0143</phone> or fax <phone>212-555-0144</phone>
Tel. <phone>020 7946 0958</phone> during office hours
my number is <phone>415.555.0132</phone>, ask for Ann
ring us on <phone>0049 30 901820</phone> today
mobile <phone>07700 900123</phone>
reach the desk at <phone>(030) 555 0199</phone> extension 12
contact <phone>555-867-5309</phone> now
<phone>(617) 555-0111</phone> is the front desk
write to <email>ann.lee [at] example [dot] org</email> for details
mail <email>bob (at) mail (dot) example (dot) com</email> please
e-mail: <email>sales [at] example.com</email>
send it to <email>j.doe @ example.net</email> tonight
Contact <email>info {at} example {dot} de</email> bitte
<email>help [at] host [dot] example [dot] com</email> answers
card <card>4111.1111.1111.1111</card> expires 04/27
pay with <card>5500/0000/0000/0004</card> today
credit card no <card>3400_000000_00009</card>
the card <card>4012.8888.8888.1881</card> was charged
server <ip>10 . 0 . 0 . 1</ip> is down
host <ip>192[.]168[.]1[.]20</ip> answered
blocked <ip>203[.]0[.]113[.]7</ip> at night
in 2024 the price rose by 12.5 % to 1,250 dollars
the meeting is on 2024-01-15 at 10:30 in room 204
version 3.11.2 of 14 packages and 27 modules
order 1234567890123456 was shipped in 3 boxes
chapter 12, pages 100-125 and 340-355
ISBN 978-3-16-148410-0 costs 19.99
the total of 4785380592391139 was noted
between 1999 and 2005 about 300 000 people left
tickets 12-34-56 and 78-90-12 are void
ratio 3:2, score 21-19, time 12:45:30
see section 4.2.1 and table 17
id 550e8400-e29b-41d4-a716-446655440000 is taken
commit 9fceb02d0ae598e95dc970b74767f19372d61af8 fixed it
follow @somebody on the net @ noon
we met at noon (at the dock) and left at 9
3 of 7 tests took 0.25 s each
call me later, room 12 is free
the 16-bit word 65535 wraps to 0
from 1000 to 2000 in steps of 250
it was 20 - 30 degrees in 1987
token = 24be64439e3e49cf46b2d7c90f3602a3d0b907ff
a 1 b 22 c 333 d 4444 e 55555 f 666666
and 97 of the 1204 and the 88
Und 34 einau 5 heit 190 der 2021 die 30
le 12 mai 1987 et la 300 des 45 000
los 15 de 2019 y la 7 con 1 200
""".strip().split("\n")


def labelled_table(spark: SparkSession) -> DataFrame:
    """(line) with marked spans: the default training table."""
    return spark.createDataFrame([(line,) for line in _LINES], "line string")


# ---------------------------------------------------------------------------
# Tokens and features.

_MARKS = "@.-+()[]{}:/#*,_%$&!?'\"|=<>;"
_PAD = 0
_SHAPES = ["pad", "x", "xx", "X", "XX", "xX", *[f"d{n}" for n in range(1, 20)], *_MARKS, "other"]
_SHAPE_NO = {s: k for k, s in enumerate(_SHAPES)}
_S = len(_SHAPES)


def _shape(token: str) -> int:
    c = token[0]
    if "0" <= c <= "9":
        return _SHAPE_NO[f"d{min(len(token), 19)}"]
    if c.isalpha():
        if len(token) == 1:
            return _SHAPE_NO["x" if c.islower() else "X"]
        if token.islower():
            return _SHAPE_NO["xx"]
        if token.isupper():
            return _SHAPE_NO["XX"]
        return _SHAPE_NO["X" if token[1:].islower() else "xX"]
    return _SHAPE_NO.get(c, _S - 1)


LABELS = ["O", *[f"{p}-{k}" for k in KINDS for p in "BI"]]
_L = len(LABELS)


class Model(NamedTuple):
    words: dict             # lower-case words of the training lines, from 1
    tables: list            # per template: [feature values, labels]
    trans: np.ndarray       # [labels, labels]
    first: np.ndarray       # [labels]


def _tokens(text: str, start: int = 0, end: int | None = None):
    return [m.span() for m in _TOKEN.finditer(text, start, len(text) if end is None else end)]


def _rows(texts_spans, words):
    """Shape, word and glue numbers of padded token sequences."""
    n = len(texts_spans)
    width = max((len(s) for _, s in texts_spans), default=0)
    shape = np.zeros((n, width + 4), dtype=np.int64)
    word = np.zeros((n, width + 4), dtype=np.int64)
    glue = np.zeros((n, width + 4), dtype=np.int64)
    for k, (text, spans) in enumerate(texts_spans):
        last = -1
        for j, (a, b) in enumerate(spans):
            token = text[a:b]
            shape[k, j + 2] = _shape(token)
            word[k, j + 2] = words.get(token.lower(), 0)
            glue[k, j + 2] = a == last
            last = b
    return shape, word, glue, np.array([len(s) for _, s in texts_spans], dtype=np.int64)


def _features(shape, word, glue):
    """Per template, the feature value of every place ([sequences, width])."""
    at = lambda x, d: x[:, 2 + d:x.shape[1] - 2 + d]
    s = [at(shape, d) for d in (-2, -1, 0, 1, 2)]
    g = at(glue, 0) * 2 + at(glue, 1)
    v = int(word.max(initial=0)) + 1
    return [s[2] * 4 + g, s[0], s[4], s[1] * _S + s[2], s[2] * _S + s[3], s[1] * _S + s[3],
            at(word, 0), at(word, -1), at(word, -2), at(word, 1)], v


def _sizes(n_words: int) -> list[int]:
    return [_S * 4, _S, _S, _S * _S, _S * _S, _S * _S, *[n_words] * 4]


def _parse(line: str):
    """Plain text and (kind, start, end) of a marked line."""
    text, spans, at = "", [], 0
    for m in re.finditer(r"<(\w+)>(.*?)</\1>", line):
        text += line[at:m.start()]
        spans.append((m.group(1), len(text), len(text) + len(m.group(2))))
        text += m.group(2)
        at = m.end()
    return text + line[at:], spans


def _log_sum(x, axis):
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + np.squeeze(top, axis)


def fit(labelled: DataFrame, line_col: str = "line", rounds: int = 150, rate: float = 0.3, decay: float = 0.002) -> Model:
    """Maximum likelihood by gradient steps (all lines at once, adaptive rates)."""
    lines = [r[0] for r in labelled.select(line_col).where(F.col(line_col).isNotNull()).orderBy(line_col)
             .limit(MAX_LABELLED + 1).collect()]
    if len(lines) > MAX_LABELLED:
        raise ValueError(f"the labelled table has more than {MAX_LABELLED} rows")
    parsed = [p for p in map(_parse, lines) if p[0].strip()]
    words: dict[str, int] = {}
    data, gold = [], []
    for text, spans in parsed:
        tokens = _tokens(text)
        labels = np.zeros(len(tokens), dtype=np.int64)
        for kind, a, b in spans:
            inside = [j for j, (x, y) in enumerate(tokens) if x >= a and y <= b]
            labels[inside] = LABELS.index(f"I-{kind}")
            labels[inside[0]] -= 1
        for a, b in tokens:
            if text[a].isalpha():
                words.setdefault(text[a:b].lower(), len(words) + 1)
        data.append((text, tokens))
        gold.append(labels)
    shape, word, glue, lens = _rows(data, words)
    feats, _ = _features(shape, word, glue)
    n, width = feats[0].shape if len(data) else (0, 0)
    sizes = _sizes(len(words) + 1)
    params = [np.zeros((k, _L)) for k in sizes] + [np.zeros((_L, _L)), np.zeros(_L)]
    if not n:
        return Model(words, params[:-2], params[-2], params[-1])
    inside = np.arange(width) < lens[:, None]
    y = np.zeros((n, width), dtype=np.int64)
    for k, labels in enumerate(gold):
        y[k, :len(labels)] = labels
    seen = [np.zeros_like(p) for p in params]           # what the labelled lines hold
    for t, f in enumerate(feats):
        np.add.at(seen[t], (f[inside], y[inside]), 1)
    both = inside[:, 1:]
    np.add.at(seen[-2], (y[:, :-1][both], y[:, 1:][both]), 1)
    np.add.at(seen[-1], y[:, 0], 1)
    square = [np.full_like(p, 1e-6) for p in params]
    for _ in range(rounds):
        emit = sum(p[f] for p, f in zip(params, feats))
        trans, first = params[-2], params[-1]
        alpha, beta = np.zeros((n, width, _L)), np.zeros((n, width, _L))
        alpha[:, 0] = first + emit[:, 0]
        for t in range(1, width):
            step = _log_sum(alpha[:, t - 1, :, None] + trans, 1) + emit[:, t]
            alpha[:, t] = np.where(inside[:, t, None], step, alpha[:, t - 1])
        for t in range(width - 2, -1, -1):
            step = _log_sum(trans + (emit[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
            beta[:, t] = np.where(inside[:, t + 1, None], step, 0.0)
        z = _log_sum(alpha[:, -1], 1)
        marg = np.exp(alpha + beta - z[:, None, None]) * inside[..., None]
        expect = []
        for t, f in enumerate(feats):
            e = np.zeros_like(params[t])
            np.add.at(e, f[inside], marg[inside])
            expect.append(e)
        pair = np.exp(alpha[:, :-1, :, None] + trans + (emit[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None])
        expect += [pair[both].sum(axis=0), marg[:, 0].sum(axis=0)]
        for p, s, e, q in zip(params, seen, expect, square):
            grad = s - e - decay * len(lines) * p
            q += grad * grad
            p += rate * grad / np.sqrt(q)
    return Model(words, params[:-2], params[-2], params[-1])


def viterbi(model: Model, texts_spans) -> list[np.ndarray]:
    """Best labels of token sequences of about equal length."""
    shape, word, glue, lens = _rows(texts_spans, model.words)
    feats, _ = _features(shape, word, glue)
    emit = sum(p[f] for p, f in zip(model.tables, feats))
    n, width = emit.shape[:2]
    back = np.zeros((n, width, _L), dtype=np.int8)
    score = model.first + emit[:, 0]
    for t in range(1, width):
        step = score[:, :, None] + model.trans
        back[:, t] = step.argmax(axis=1)
        on = (t < lens)[:, None]
        score = np.where(on, step.max(axis=1) + emit[:, t], score)
    label = score.argmax(axis=1)
    out = np.zeros((n, width), dtype=np.int64)
    rows = np.arange(n)
    for t in range(width - 1, -1, -1):
        on = t < lens
        out[on, t] = label[on]
        if t:
            label = np.where(on, back[rows, t, label], label)
    return [out[k, :m] for k, m in enumerate(lens.tolist())]


def viterbi_long(model: Model, text: str, spans) -> np.ndarray:
    """Best labels of one long sequence, as ``viterbi``: the scores go on from block to block."""
    back = np.zeros((len(spans), _L), dtype=np.int8)
    score = None
    for i in range(0, len(spans), LONGEST):
        # features look at two tokens on each side
        low, j = max(0, i - 2), min(len(spans), i + LONGEST)
        shape, word, glue, _ = _rows([(text, spans[low:j + 2])], model.words)
        feats, _ = _features(shape, word, glue)
        emit = sum(p[f[0, i - low:j - low]] for p, f in zip(model.tables, feats))
        for t in range(i, j):
            if score is None:
                score = model.first + emit[0]
                continue
            step = score[:, None] + model.trans
            back[t] = step.argmax(axis=0)
            score = step.max(axis=0) + emit[t - i]
    out = np.zeros(len(spans), dtype=np.int64)
    out[-1] = score.argmax()
    for t in range(len(spans) - 1, 0, -1):
        out[t - 1] = back[t, out[t]]
    return out


def _stretches(text: str) -> list[tuple[int, int]]:
    """Stretches within REACH of a digit or at sign, out to the next blank."""
    out = []
    for m in _SEED.finditer(text):
        a, b = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return out


def field_spans(texts: list[str], model: Model) -> list[list[tuple[int, int, int]]]:
    """(kind number, start, end) that the random field finds in each text."""
    found: list[list] = [[] for _ in texts]
    todo = []
    for k, text in enumerate(texts):
        for a, b in _stretches(text):
            spans = _tokens(text, a, b)
            if len(spans) > LONGEST:
                found[k] += _label_spans(spans, viterbi_long(model, text, spans).tolist())
            else:
                todo.append((k, spans))
    todo.sort(key=lambda x: len(x[1]))
    at = 0
    while at < len(todo):
        # about the same length, a bounded number of cells
        width = len(todo[at][1])
        stop = at + 1
        while stop < len(todo) and len(todo[stop][1]) <= 1.25 * width + 8 and (stop - at) * len(todo[stop][1]) < 50_000:
            stop += 1
        part = todo[at:stop]
        for (k, spans), labels in zip(part, viterbi(model, [(texts[k], s) for k, s in part])):
            found[k] += _label_spans(spans, labels.tolist())
        at = stop
    return [sorted(f) for f in found]


def _label_spans(spans, labels):
    out, open_kind = [], None
    for (a, b), label in zip(spans, labels):
        kind = (label - 1) // 2 if label else None
        if kind is not None and label % 2 == 0 and kind == open_kind:
            out[-1][2] = b
        elif kind is not None:
            out.append([kind, a, b])
        open_kind = kind
    return [tuple(s) for s in out]


def find_spans(texts: list[str], model: Model):
    """Base spans and added spans of each text."""
    base = [base_spans(t) for t in texts]
    added = []
    for text, known, extra in zip(texts, base, field_spans(texts, model)):
        keep = []
        for kind, a, b in extra:
            low, high = _DIGITS[KINDS[kind]]
            if (low <= sum("0" <= c <= "9" for c in text[a:b]) <= high
                    and not any(x < b and a < y for _, x, y in known)):
                keep.append((kind, a, b))
        added.append(keep)
    return base, added


def _find_batches(batches, model):
    span = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        for part in C.slices(batch, 1):
            cells = [pa.array([[dict(zip(("kind", "start", "end"), s)) for s in row] for row in rows], span)
                     for rows in find_spans(C.texts_of(part, 1), model.value)]
            yield pa.RecordBatch.from_arrays([part.column(0), *cells], ["id", "base", "added"])


_SPANS = "array<struct<kind:int,start:int,end:int>>"


def find(df: DataFrame, model: Model, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id_col, base, added): spans as (kind number of ``KINDS``, start, end) in code points."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = df.select(id_col).schema[0].dataType.simpleString()
    return (df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
            .mapInArrow(partial(_find_batches, model=shared), f"id {kind}, base {_SPANS}, added {_SPANS}")
            .withColumnRenamed("id", id_col))


def _redacted(text: str, spans) -> str:
    out, at = [], 0
    for start, end, kind in sorted((a, b, k) for k, a, b in spans):
        if start >= at:
            out += [text[at:start], f"<{KINDS[kind].upper()}>"]
        at = max(at, end)
    return "".join(out) + text[at:]


def _redact_batches(batches, model, col):
    for batch in batches:
        for part in C.slices(batch, col):
            texts = part.column(col).to_pylist()
            base, added = find_spans([t or "" for t in texts], model.value)
            texts = [_redacted(t, b + a) if b or a else t for t, b, a in zip(texts, base, added)]
            cells = part.columns
            cells[col] = pa.array(texts, part.schema.field(col).type)
            yield pa.RecordBatch.from_arrays(cells, schema=part.schema)


def redact(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``df`` with every span replaced by its kind; all rows and columns stay."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    return df.mapInArrow(partial(_redact_batches, model=shared, col=df.columns.index(text_col)), df.schema)


def op8_pii_crf(spark, sf_dir) -> DataFrame:
    """Base and added spans of every document."""
    found = find(C.table(spark, sf_dir, "documents"), fit(labelled_table(spark)))
    kinds = F.array(*[F.lit(k) for k in KINDS])
    written = lambda spans: F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", kinds[s["kind"]], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)],
                        F.size("added").cast("long").alias("n_added"),
                        F.sha2(written(F.col("base")), 256).alias("base_sha256"),
                        written(F.concat("base", "added")).alias("spans"))
