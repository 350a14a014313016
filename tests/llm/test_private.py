"""Personal data and secrets: base rules against plain regular expressions, added spans on planted cases."""

import hashlib
import math
import random
import re

import pytest

from veil.llm import pii, secret_scan
from veil.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def plain_base(text):
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
            if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m.group() if c.isdigit()]
        double = [d if k % 2 == 0 else 2 * d - 9 * (d > 4) for k, d in enumerate(reversed(digits))]
        if 13 <= len(digits) <= 19 and sum(double) % 10 == 0:
            out.append((2, *m.span()))
    out += [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return out


def test_base_spans_on_random_texts():
    random.seed(2)
    for alphabet in ("ab@@..-+1234567890() é", "0123456789 -", "+1 ().-23", "a.@-b"):
        for _ in range(4000):
            text = "".join(random.choice(alphabet) for _ in range(random.randrange(50)))
            assert pii.base_spans(text) == plain_base(text), text


def test_base_rules_are_linear():
    for text in ("a" * 300_000 + "@", "1" * 300_000, "1." * 100_000, "+1" + "(" * 200_000, "a@" * 100_000):
        pii.base_spans(text)


@pytest.fixture(scope="module")
def model(spark):
    return pii.fit(pii.labelled_table(spark))


def test_field_learns_its_table(model):
    for line in pii._LINES:
        text, spans = pii._parse(line)
        assert pii.field_spans([text], model)[0] == sorted((pii.KINDS.index(k), a, b) for k, a, b in spans)


def test_field_finds_unseen_forms_and_leaves_prose(model):
    found = {"ring (303) 555-0123 today": "(303) 555-0123", "phone 415-555-0199 please": "415-555-0199",
             "mail kim [at] site [dot] net soon": "kim [at] site [dot] net"}
    for text, want in found.items():
        _, added = pii.find_spans([text], model)
        assert [text[a:b] for _, a, b in added[0]] == [want]
    clean = ["in 1987 about 300 people met at 10:30", "pages 12-19 of volume 3", "the 2021 budget was 1,250,000",
             "ndble whst the by for and threea 42 and", "version 2.10.4 is out"]
    assert pii.find_spans(clean, model)[1] == [[]] * len(clean)


def test_long_stretches_are_decoded_whole(model, monkeypatch):
    text = " ".join(f"{k} call (212) 555-01{k % 90 + 10} or ann [at] host{k} [dot] org, 12-34-56" for k in range(40))
    tokens = pii._tokens(text)
    whole = pii.field_spans([text], model)[0]
    labels = pii.viterbi(model, [(text, tokens)])[0]
    assert len(whole) >= 80
    for longest in (1, 2, 7, 50, len(tokens) - 1):
        monkeypatch.setattr(pii, "LONGEST", longest)
        assert pii.field_spans([text], model)[0] == whole
        assert (pii.viterbi_long(model, text, tokens) == labels).all()


def test_pii_query_and_redaction(spark, model):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in QUERIES["op8_pii_crf"](spark, SF).collect():
        spans = plain_base(docs[r.doc_id])
        text = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in spans)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == j for k, _, _ in spans) for j in range(4)]
        assert set(text.split(",")) <= set(r.spans.split(","))
    df = spark.createDataFrame([(1, "to bob@mail.example.com or 10.0.0.1!", "x"), (2, None, None), (3, "plain", "y")],
                               "doc_id long, text string, id string")
    got = {r.doc_id: (r.text, r.id) for r in pii.redact(df, model).collect()}
    assert got == {1: ("to <EMAIL> or <IP>!", "x"), 2: (None, None), 3: ("plain", "y")}


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def plain_secrets(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
    return sorted(out)


def secret_texts():
    rnd = random.Random(3)
    bits = ["token = ", "Password:'", "API_KEY=\"", "apikey:", "secret", " = ", "AKIA", "ABCDEFGH01234567", "deadbeef" * 3,
            "é😀", "\n", "abc123", "=x", "token=secret=abcdef", " passwd : hunter2x", "0123456789abcdef01234567f", "日本 "]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randrange(12))) for _ in range(400)]
    return texts + ["", "token = abcdefgh " * 300, "x" * 50_000 + " AKIA" + "Z" * 30]


def test_base_secrets_in_code_points(spark):
    texts = secret_texts()
    df = spark.createDataFrame(list(enumerate(texts)) + [(-1, None)], "doc_id long, text string")
    ratios = secret_scan.fit(df)
    for r in secret_scan.scan(df, ratios).collect():
        text = texts[r.doc_id] if r.doc_id >= 0 else ""
        assert [(s.start, s.kind, s.end) for s in r.base] == plain_secrets(text), text[:200]
        assert all(s.value == text[s.start:s.end] for s in r.base + r.added)
        assert not any(a.start < b.end and b.start < a.end for a in r.added for b in r.base)


def test_chains_tell_random_strings_from_words(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ratios = secret_scan.fit(docs)
    secrets = ["kX9vQ2mZ7pL4tR8wB1nC", "Zm9vYmFyMTIzNDU2Nzg5MHF3ZXJ0eQ", "9fKd02LsmQ81zXyPwv7RtB5h"]
    plain = ["internationalization", "getElementByIdentifier", "usr/local/share/applications", "onthereresedthing",
             "max_number_of_retries", "1234567890123456", "2024-01-15", "================"]
    df = spark.createDataFrame(list(enumerate(f"see {t} here" for t in secrets + plain)), "doc_id long, text string")
    got = {r.doc_id: [s.value for s in r.added] for r in secret_scan.scan(df, ratios).collect()}
    assert [got[k] for k in range(len(secrets))] == [[s] for s in secrets]
    assert not any(got[k] for k in range(len(secrets), len(got)))


def test_secret_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    kinds = secret_scan.KINDS
    rows = QUERIES["op10_secret_scan"](spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        spans = plain_secrets(docs[r.doc_id])
        text = ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in spans)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == j for _, k, _ in spans) for j in range(3)]


def test_secret_scan_plan_has_no_python(spark):
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    plan = secret_scan.scan(df, [0.0] * secret_scan._WIDTH ** 2)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_chains_recomputed_from_all_documents(spark):
    """The log ratios equal those of a plain count over every sample, whatever the number of documents."""
    docs = spark.createDataFrame([(k, f"alpha{'beta' * (k % 3)} password={'q9Z' * 8}{k} x") for k in range(300)],
                                 "doc_id long, text string")
    width, letters = secret_scan._WIDTH, secret_scan._ALPHABET
    code = lambda c: letters.find(c) + 1
    count = {True: [1.0] * width ** 2, False: [1.0] * width ** 2}
    for r in secret_scan.samples(docs, "text").collect():
        for a, b in zip(r.value, r.value[1:]):
            count[r.random][code(a) * width + code(b)] += 1
    row = lambda v, p: sum(v[p // width * width:(p // width + 1) * width])
    want = [math.log(count[True][p] / row(count[True], p)) - math.log(count[False][p] / row(count[False], p))
            for p in range(width ** 2)]
    assert secret_scan.fit(docs) == pytest.approx(want, abs=1e-12)
    assert sum(r.random and "q9Z" in r.value for r in secret_scan.samples(docs, "text").collect()) == 300
