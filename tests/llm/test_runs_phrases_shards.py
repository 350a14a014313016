"""Periodic runs, collocations and the hash tree against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import DATA, edge_rows
from veil.llm import collocations, hash_tree, periodic_runs

# --- periodic runs -------------------------------------------------------------------


def brute_runs(x):
    """All stretches of every period, kept if the period is their smallest."""
    n, out = len(x), set()
    for q in range(1, n // 4 + 1):
        i = q
        while i < n:
            if x[i] != x[i - q]:
                i += 1
                continue
            j = i
            while j < n and x[j] == x[j - q]:
                j += 1
            s, size = i - q, j - i + q
            if size >= max(6, 4 * q) and not any(
                    all(x[t] == x[t - p] for t in range(s + p, j)) for p in range(1, q)):
                out.add((s, size, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        a, g = (h // 10) % n, h // 10
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    dropped = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = min(((-size, s, q) for s, size, q in runs), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    top = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
    return (len(runs), *top, sha("".join(f"{s},{size},{q}\n" for s, size, q in runs)),
            sha(" ".join(w for i, w in enumerate(words) if i not in dropped)))


def test_runs_equal_brute_force_on_random_words():
    rng = random.Random(5)
    for _ in range(1500):
        k, n = rng.choice([1, 2, 2, 3, 5, 30]), rng.randint(0, 90)
        x = [rng.randrange(k) for _ in range(n)]
        for _ in range(rng.randint(0, 4)):             # plant repetitions, also overlapping ones
            if n > 8:
                a = rng.randrange(n)
                p, e = rng.randint(1, max(1, (n - a) // 3)), rng.randint(a, n)
                for i in range(a + p, e):
                    x[i] = x[i - p]
        assert periodic_runs.runs_of(np.array(x, dtype=np.int64)) == brute_runs(x), x


def test_runs_of_long_periods_and_hot_words():
    block = list(range(3000))
    x = [4000] * 50 + block * 5 + block[:17] + [4001] * 40
    assert periodic_runs.runs_of(np.array(x, dtype=np.int64)) == [
        (0, 50, 1), (50, 15017, 3000), (15067, 40, 1)]
    assert periodic_runs.runs_of(np.zeros(50_000, dtype=np.int64)) == [(0, 50_000, 1)]
    inner = [0] * 99 + [1]
    found = periodic_runs.runs_of(np.array(inner * 6, dtype=np.int64))
    assert found == sorted([(0, 600, 100), *[(100 * k, 99, 1) for k in range(6)]], key=lambda r: (r[0], r[2]))


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    want = {r.doc_id: brute_row(r.doc_id, r.text) for r in docs.collect() if len(r.text or "") < 20_000}
    got = {r.doc_id: tuple(r)[1:8] for r in periodic_runs.op11_periodic_runs(spark, DATA).collect()}
    assert len(want) > 150 and any(v[0] for v in want.values())
    assert {k: got[k] for k in want} == want


def test_query_on_hard_rows(spark, edge_dir):
    rows = periodic_runs.op11_periodic_runs(spark, edge_dir).collect()
    texts = {r[0]: r[1] for r in edge_rows() if r[0] not in (None, 6)}
    assert {r.doc_id: tuple(r)[1:8] for r in rows if r.doc_id in texts} == {
        k: brute_row(k, t) for k, t in texts.items()}
    no_id = sorted(r.n_words for r in rows if r.doc_id is None)
    assert no_id == [0, 121]


# --- collocations --------------------------------------------------------------------


def brute_phrases(rows, least, top):
    counts, total = Counter(), Counter()
    for text, lang in rows:
        g = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            ws = re.findall(r"[^\x20\x09]+", piece)
            total[g] += len(ws)
            for i in range(len(ws)):
                for k in range(1, 6):
                    if i + k <= len(ws):
                        counts[g, tuple(ws[i:i + k])] += 1
    found = {k: a for k, a in counts.items() if 2 <= len(k[1]) <= 5 and a >= least}
    out = []
    for (g, p), a in found.items():
        if any(g2 == g and len(p2) > len(p) and 100 * b >= 100 * a
               and any(p2[i:i + len(p)] == p for i in range(len(p2) - len(p) + 1)) for (g2, p2), b in found.items()):
            continue
        score, k = min((1000 * a * total[g] // (counts[g, p[:k]] * counts[g, p[k:]]), k) for k in range(1, len(p)))
        out.append((g, " ".join(p), a, counts[g, p[:k]], counts[g, p[k:]], total[g], score))
    ranked = []
    for g in {x[0] for x in out}:
        own = sorted((x for x in out if x[0] == g), key=lambda x: (-x[6], -x[2], x[1].encode()))[:top]
        ranked += [(g, i, *x[1:]) for i, x in enumerate(own, 1)]
    return sorted(ranked)


def phrase_rows(seed):
    rng = random.Random(seed)
    words = ["the", "of", "New", "york", "times", "Éa", "x\x00y", "a", "b", "日本", "c'est"]
    rows = []
    for _ in range(60):
        ws = [rng.choice(words) if rng.random() < 0.7 else "new york TIMES square garden" for _ in range(rng.randint(0, 40))]
        text = "".join(w + rng.choice([" ", " ", " ", "\t ", ". ", "\n", "\x0b", ",", "  "]) for w in ws)
        rows.append((text, rng.choice(["en", "en", "fr", "und", None])))
    return [*rows, (None, "en"), ("", "fr"), (" \t.\n", None)]


@pytest.mark.parametrize("bits", [9, 14])      # few counters: they are shared and cut little
def test_collocations_equal_brute_force(spark, bits):
    rows = phrase_rows(bits)
    df = spark.createDataFrame(rows, "text string, lang string")
    for least, top in ((3, 2000), (8, 5)):
        got = sorted(tuple(r) for r in collocations.collocations(df, least=least, top=top, bits=bits).collect())
        assert got == brute_phrases(rows, least, top)


def test_counts_above_the_counters_are_exact(spark):
    """Counts over 255 saturate the counters of the filter, not the result."""
    df = spark.createDataFrame([("p q " * 400, "en")] * 3, "text string, lang string")
    rows = collocations.phrase_counts(df, least=255, bits=10).collect()
    assert {(r.words, r.phrase): r.f for r in rows}[2, "p q"] == 1200
    assert {(r.words, r.phrase): r.f for r in rows}[0, ""] == 2400


def test_collocations_score_beyond_64_bits(spark):
    e = "cast(1000 * a as decimal(19, 0)) * cast(n as decimal(18, 0)) div (cast(l as decimal(18, 0)) * cast(r as decimal(18, 0)))"
    a, n, left, right = 9 * 10**12, 9 * 10**16, 9 * 10**12 + 1, 9 * 10**13
    row = spark.createDataFrame([(a, n, left, right)], "a long, n long, l long, r long").select(F.expr(e).alias("s")).first()
    assert row.s == 1000 * a * n // (left * right)


# --- hash tree -----------------------------------------------------------------------


def shards_of(spark, tree, n=4000):
    return [r.s for r in spark.range(n).select("id", hash_tree.descend(F.col("id"), tree).alias("s")).orderBy("id").collect()]


def brute_shard(key, tree):
    def draw(name, weight):
        bits = int(hashlib.md5(f"{key}|{name}".encode()).hexdigest()[:13], 16)
        return -np.log((bits + 1) / 2**52) / weight
    weight = lambda r: sum(sum(x.values()) for x in r.values())
    racks = tree[min(tree, key=lambda r: draw(r, weight(tree[r])))]
    rack = min(racks, key=lambda r: draw(r, sum(racks[r].values())))
    return min(racks[rack], key=lambda s: draw(f"{rack}.{s}", racks[rack][s]))


def test_descent_equals_brute_force(spark):
    tree = hash_tree.weighed(hash_tree.grown(hash_tree.balanced()), 3, 2.5)
    assert shards_of(spark, tree, 500) == [brute_shard(k, tree) for k in range(500)]


def test_a_grown_tree_takes_keys_only_into_the_new_shard(spark):
    tree = hash_tree.balanced()
    for _ in range(3):
        old, tree = tree, hash_tree.grown(tree)
        new = max(s for racks in tree.values() for rack in racks.values() for s in rack)
        a, b = shards_of(spark, old), shards_of(spark, tree)
        moved = [y for x, y in zip(a, b) if x != y]
        assert set(moved) == {new}
        assert abs(len(moved) / len(a) - 1 / (new + 1)) < 0.02


def test_a_changed_weight_moves_keys_only_through_its_subtrees(spark):
    """More weight of shard 5 (rack r1.0, region r1): whoever moves lands in a subtree that grew."""
    tree = hash_tree.balanced()
    region = {s: r for r, racks in tree.items() for rack in racks.values() for s in rack}
    rack = {s: k for racks in tree.values() for k, shards in racks.items() for s in shards}
    a, b = shards_of(spark, tree), shards_of(spark, hash_tree.weighed(tree, 5, 3.0))
    assert b.count(5) > 1.8 * a.count(5)
    for x, y in zip(a, b):
        if x != y:
            assert region[y] == region[5]
            if region[x] == region[5]:
                assert rack[y] == rack[5]
                if rack[x] == rack[5]:
                    assert y == 5
    # no weight at all: nobody stays, and other regions keep what they had
    c = shards_of(spark, hash_tree.weighed(tree, 5, 0.0))
    assert 5 not in c and all(x == y for x, y in zip(a, c) if region[x] != region[5])


def test_slots_have_no_gaps_and_hot_rows_are_split(spark):
    rows = [(7, "same text")] * 700 + [(k, "shared") for k in range(300)] + [(None, None), (None, ""), (8, None), (8, "x" * 100_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = hash_tree.place(df, hash_tree.balanced(), buckets=8, chunk=16).collect()
    size = lambda t: len((t or "").encode()) + 1
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter(
        (i, size(t), zlib.crc32((t or "").encode())) for i, t in rows)
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert len({r.shard for r in got if r.doc_id == 7}) == 1


def test_place_is_the_same_on_other_partitions(spark):
    df = spark.read.parquet(f"{DATA}/documents.parquet")
    tree = hash_tree.balanced()
    a = hash_tree.place(df, tree).collect()
    b = hash_tree.place(df.repartition(7), tree).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b)) and len(a) == df.count()


def test_assign_keeps_rows_and_columns(spark, edge_dir):
    df = spark.read.parquet(f"{edge_dir}/documents.parquet")
    out = hash_tree.assign(df, hash_tree.balanced())
    assert out.columns == [*df.columns, "shard"] and out.where("shard is null").count() == 0
    assert out.count() == len(edge_rows())
