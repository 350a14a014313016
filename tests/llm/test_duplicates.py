"""Near-duplicate classes, repeated byte strings and contamination against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest

from veil.llm import contamination, near_dup, suffix_dedup
from veil.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("scalar", [2, 48])
def test_banded_alignment(scalar, monkeypatch):
    monkeypatch.setattr(near_dup, "_SCALAR_EDITS", scalar)
    random.seed(5)
    for _ in range(600):
        a = [random.randrange(1, 6) for _ in range(random.randrange(25))]
        b = list(a)
        for _ in range(random.randrange(10)):
            k = random.randrange(len(b) + 1)
            if random.random() < 0.5:
                b.insert(k, random.randrange(1, 6))
            elif b:
                b.pop(min(k, len(b) - 1))
        limit, want = random.randrange(9), plain_distance(a, b)
        got = near_dup.edit_distance(*(np.array(x, dtype=np.uint64) * near_dup._MIX2 for x in (a, b)), limit)
        assert got == (want if want <= limit else None)


def brute_classes(texts):
    """Least id of the component of each text with words, by all pairs that share a shingle."""
    words = {i: (t or "").lower().encode().split() for i, t in texts.items()}
    sets = {i: frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) for i, w in words.items() if w}
    at = collections.defaultdict(list)
    for i, s in sets.items():
        for g in s:
            at[g].append(i)
    shared = collections.Counter((a, b) for ids in at.values() for n, b in enumerate(ids) for a in ids[:n])
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), n in shared.items():
        if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n) - 1e-9 and find(a) != find(b):
            number = {w: k + 1 for k, w in enumerate({*words[a], *words[b]})}
            pair = [np.array([number[w] for w in words[i]], dtype=np.uint64) * near_dup._MIX2 for i in (a, b)]
            limit = int(0.2 * max(len(words[a]), len(words[b])) + 1e-9)
            if near_dup.edit_distance(*pair, limit) is not None:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in texts}


def planted():
    """A hub with many edited copies, a chain, a moved block, exact copies and a passage that many share."""
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 9)))
    hub, passage = [word() for _ in range(200)], [word() for _ in range(60)]
    texts = [" ".join(hub)]
    for _ in range(60):
        copy = list(hub)
        for _ in range(rnd.randrange(0, 5)):
            copy[rnd.randrange(200)] = word()
        texts.append(" ".join(copy))
    chain = [word() for _ in range(200)]
    for _ in range(12):
        chain = list(chain)
        for _ in range(3):
            chain[rnd.randrange(200)] = word()
        texts.append(" ".join(chain))
    texts += [" ".join(hub[100:] + hub[:100]), texts[0].upper(), texts[0].replace(" ", "\n"), "", None, "a b c", "A b C"]
    texts += [" ".join(passage + [word() for _ in range(60)]) for _ in range(60)]
    return dict(enumerate(texts))


def test_planted_classes(spark):
    texts = planted()
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_dup.classes(df).collect()}
    want = brute_classes(texts)
    want[next(i for i, t in texts.items() if t == "A b C")] = next(i for i, t in texts.items() if t == "a b c")
    assert got == want
    kept = {r.doc_id for r in near_dup.keep_one(df).collect()}
    assert kept == set(want.values())


def test_classes_of_the_documents(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r.class_id for r in QUERIES["op6_order_minhash"](spark, SF).collect()}
    assert got == brute_classes(texts)


def test_few_links_stay_in_few_partitions(spark):
    """Rounds over few pairs do not deal them over all shuffle partitions again and again."""
    few = 4 * spark.sparkContext.defaultParallelism
    conf = {"spark.sql.shuffle.partitions": str(4 * few), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        edges = [(b"%02d" % k, b"%02d" % (k + 3)) for k in range(30)]
        roots = near_dup.components(spark.createDataFrame(edges, "a binary, b binary"))
        assert roots.rdd.getNumPartitions() <= few
        assert {(bytes(r.node), bytes(r.root)) for r in roots.collect()} == {
            (b"%02d" % k, b"%02d" % (k % 3)) for k in range(33)}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def template_family(slopes=6, q=13):
    """Linked pairs of texts of one template whose base text is absent; texts of two pairs are no link.

    Edits stand at the points of lines, and two lines meet once at most: a pair shares
    one edit (similarity 0.82), texts of two pairs one place of an edit at most (0.79).
    """
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(8))
    base, texts = [word() for _ in range(300)], []
    for b in range(q):
        for a in range(slopes):
            if a % 2 == 0:
                shared = word()
            copy = list(base)
            for x in range(4):
                copy[5 + 5 * (x * q + (a * x + b) % q)] = word() if x else shared
            texts.append(" ".join(copy))
    return dict(enumerate(texts))


def test_links_inside_a_family_without_its_base(spark, monkeypatch):
    texts = template_family()
    want = brute_classes(texts)
    assert len(set(want.values())) == 39
    # the worst draw: no wave meets a linked pair
    drawn = near_dup.between_components
    monkeypatch.setattr(near_dup, "between_components", lambda *a: drawn(*a).where("false"))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in near_dup.classes(df).collect()} == want


@pytest.mark.parametrize("block", [3, 256])
def test_prefix_pairs_hold_every_link(spark, monkeypatch, block):
    monkeypatch.setattr(near_dup, "_BLOCK", block)
    texts = template_family(4) | {100 + i: t for i, t in planted().items() if t and len(t.split()) > 4 and i < 74}
    prints = {hashlib.md5(" ".join(t.lower().split()).encode()).digest(): t.lower().encode().split()
              for t in texts.values()}
    df = spark.createDataFrame([(t,) for t in texts.values()], "text string")
    packed = df.mapInArrow(near_dup._print_batches, "print binary, packed binary").dropDuplicates(["print"])
    members = packed.selectExpr("1L as key", "print")
    rank = members.selectExpr("print", "0L as rank")
    roots = spark.createDataFrame([], "node binary, root binary")
    got = {(bytes(r.a), bytes(r.b)) for r in near_dup.prefix_pairs(
        near_dup.rarest_prefixes(members, roots, rank, packed)).collect()}
    sets = {p: {tuple(w[k:k + 5]) for k in range(len(w) - 4)} for p, w in prints.items()}
    linked = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert linked and linked <= got


def brute_removal(texts, length=400):
    seen = collections.Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        hit = np.zeros(len(t) + 1, dtype=int)
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                hit[i] += 1
                hit[i + length] -= 1
        on = np.cumsum(hit)[:-1] > 0
        kept = bytes(np.frombuffer(t, np.uint8)[~on])
        out.append((len(t), int(on.sum()), int((np.diff(np.concatenate([[0], on])) == 1).sum()),
                    hashlib.sha256(kept).hexdigest()))
    return out


def test_repeated_strings(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_ROWS_AT_ONCE", 50)      # groups go on over batches
    rnd = random.Random(4)
    base = "".join(rnd.choice("abcd efgh") for _ in range(3000))

    def edited(n):
        s = list(base)
        for _ in range(n):
            s[rnd.randrange(len(s))] = rnd.choice("xyzé")
        return "".join(s)

    texts = [None, "", "short", "a" * 1500, "ab" * 700, base, base, edited(3), edited(8), "q" + base[100:499],
             base[100:500], "zz" + base[700:1200] * 3, "é" * 900]
    texts += [edited(rnd.randrange(1, 12))[rnd.randrange(500):rnd.randrange(1500, 3000)] for _ in range(60)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
           for r in QUERIES["op9_suffix_dedup"](spark, str(tmp_path)).collect()}
    assert got == dict(enumerate(brute_removal([(t or "").encode() for t in texts])))


@pytest.mark.parametrize("group", [3, 10_000])
def test_frequent_cores_are_not_held(spark, monkeypatch, group):
    monkeypatch.setattr(suffix_dedup, "_ROWS_AT_ONCE", 40)
    monkeypatch.setattr(suffix_dedup, "_GROUP", group)
    rnd = random.Random(14)
    filler = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    passage = filler(450)
    texts = [filler(rnd.randrange(20, 300)) + passage[rnd.randrange(30):rnd.randrange(420, 451)] + filler(200)
             for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest())
           for r in suffix_dedup.remove_repeats(df).collect()}
    assert got == dict(enumerate(brute_removal([t.encode() for t in texts])))


def test_a_task_holds_a_bounded_group(monkeypatch):
    """A core of many pieces leaves the task as hashes while it is read, in bounded parts."""
    monkeypatch.setattr(suffix_dedup, "_ROWS_AT_ONCE", 40)
    monkeypatch.setattr(suffix_dedup, "_GROUP", 10)
    sizes = []
    solve = suffix_dedup.equal_windows
    monkeypatch.setattr(suffix_dedup, "equal_windows", lambda group, *a: sizes.append(len(group)) or solve(group, *a))

    def pieces():
        for core in (b"a", b"b", b"c"):
            for k in range(20 if core == b"b" else 2):
                yield suffix_dedup._pieces({"lead": [core] * 20, "core": [core] * 20, "before": [b""] * 20, "after": [
                    bytes([k, j]) + b"x" * 90 for j in range(20)], "lo": [0] * 20, "hi": [0] * 20, "part": [0] * 20,
                    "g": [1] * 20, "u": list(range(20 * k, 20 * k + 20)), "n": [1] * 20})

    rows = sum(b.num_rows for b in suffix_dedup._bucket_batches(pieces()))
    assert rows == 480 and not sizes


def test_a_frequent_core_makes_few_rows(spark, monkeypatch):
    """A piece leaves the task as one row and as one of each part, and windows are counted at the passage's ends only."""
    monkeypatch.setattr(suffix_dedup, "_GROUP", 3)
    rnd = random.Random(15)
    filler = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    passage = filler(520)
    texts = [filler(500) + passage[:rnd.choice((330, 395, 399, 400, 401, 455, 520))] + filler(500) for _ in range(80)]
    texts += [texts[0], texts[1][3:], passage, passage[50:]]
    df = spark.createDataFrame([*enumerate(texts), (5, texts[5])], "doc_id long, text string")
    kept = []
    monkeypatch.setattr(suffix_dedup, "keep", lambda d: kept.append(d.persist()) or kept[-1])
    got = {r.doc_id: (r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest())
           for r in suffix_dedup.remove_repeats(df).collect()}
    assert got == dict(enumerate(brute_removal([t.encode() for t in texts] + [texts[5].encode()])[:-1]))
    solved, parts = kept[1].where("core is not null"), kept[2]
    pieces, windows = solved.count(), solved.selectExpr("sum(far - near + 1)").first()[0]
    assert pieces > 80 and solved.select("g", "u", "part").distinct().count() > 80
    assert parts.count() < windows / 5
    for d in kept:
        d.unpersist()


def test_long_texts_are_cut_into_segments(monkeypatch):
    rnd = random.Random(6)
    text = bytes(rnd.randrange(97, 101) for _ in range(9_000))
    whole = [tuple(map(list, c)) for c in suffix_dedup.contexts(text)]
    monkeypatch.setattr(suffix_dedup, "_SEGMENT", 1_000)
    parts = list(suffix_dedup.contexts(text))

    def windows(rows):
        out = {}
        for g, _, at in zip(*rows):
            start, count, far = suffix_dedup._unpack(int(at))
            for s in range(start, start + count):
                out[s] = (start + far, int(g))
        return out

    assert windows(whole[0]) == {k: v for p in parts for k, v in windows(p).items()}


LOWER = re.compile("[A-Z]")
WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def item_words(text):
    return WORD.findall(LOWER.sub(lambda m: m.group().lower(), text or ""))


def brute_hits(docs, items):
    windows = collections.defaultdict(set)
    for item, text in items:
        w = item_words(text)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k:k + 10])].add(item)
    lens = {len(k) for k in windows}
    out = {}
    for i, text in docs.items():
        w, hit, found = item_words(text), set(), set()
        for n in lens:
            for k in range(len(w) - n + 1):
                ids = windows.get(tuple(w[k:k + n]))
                if ids:
                    found |= ids
                    hit |= set(range(k, k + n))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out[i] = (len(w), len(hit), len(found), digest, bool(hit))
    return out


@pytest.mark.parametrize("block", [1 << 24, 2_000])
def test_contamination_of_the_documents(spark, block, monkeypatch):
    monkeypatch.setattr(contamination, "BLOCK_BYTES", block)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated)
           for r in QUERIES["op7_fm_decontamination"](spark, SF).collect()}
    assert got == brute_hits(docs, items) and any(v[4] for v in got.values())


def test_short_items_overlaps_and_removal(spark):
    items = [("s", "Lone word"), ("l", " ".join(f"w{k}" for k in range(15))), ("r", "a a a a a a a a a a a")]
    texts = {1: "x LONE word y lone, word", 2: "pre " + " ".join(f"W{k}" for k in range(3, 15)) + ", post",
             3: "a " * 25 + "b", 4: "lone", 5: None, 6: "", 7: " ".join(f"w{k}" for k in range(9))}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    found = {r.row.doc_id: r for r in contamination.find(df, bench, ["doc_id"]).collect()}
    for i, want in brute_hits(texts, items).items():
        got = found[i]
        assert (got.n_words, sum(s.end - s.start for s in got.spans), len(got["items"])) == want[:3]
    cut = {r.doc_id: r.text for r in contamination.remove(df, bench).collect()}
    assert cut[1] == "x  y " and cut[2] == "pre , post" and cut[3] == " b" and cut[4] == "lone" and cut[5] is None
    assert not any(v[4] for v in brute_hits(cut, items).values())


def test_fm_index_counts_and_locates():
    rng = np.random.default_rng(8)
    text = np.append(rng.integers(1, 6, size=400), 0)
    index = contamination.FMIndex(text)
    assert contamination.suffix_array(text).tolist() == sorted(range(401), key=lambda k: text[k:].tolist())
    for n in (1, 2, 4):
        patterns = rng.integers(1, 7, size=(50, n))
        lo, hi = index.search(patterns, np.full(50, n))
        for p, a, b in zip(patterns, lo, hi):
            want = [k for k in range(401 - n) if (text[k:k + n] == p).all()]
            assert sorted(index.locate(np.arange(a, max(a, b))).tolist()) == want


def test_prints_in_sql_equal_those_of_the_sketches(spark):
    texts = ["A b\tC", " a  b c ", "a b\x85c", "ÄB c", "", None, " \n\x0b\x0c\r\t ", "x\x1cy z", "a b", "W " * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    own = {r.id: r.print for r in near_dup.sketches(df, "text", "doc_id").collect()}
    sql = {r.doc_id: r.p for r in df.select("doc_id", near_dup._print(df["text"]).alias("p")).collect()}
    assert own == sql and own[0] == own[1] and own[6] is None
