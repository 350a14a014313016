"""The pipeline against brute-force versions of its stages, on planted documents."""

import random

import public_tokenizers
import tiktoken

import corpus_pipeline
from tests.llm.test_duplicates import brute_classes, brute_hits
from tests.llm.test_private import plain_base
from tests.llm.test_scores import rule_figures
from veil.llm import bpe, common

SF = "/root/testdata/sf0.001"


def test_stages_in_turn(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality_rules"](spark, docs, SF)
    kept = {r.doc_id: r for r in good.collect()}
    assert all(kept[i] == before[i] for i in kept)
    for i, r in before.items():
        n, _, _, _, repeat = rule_figures(r.text)
        assert not (i in kept and (n < 50 or 100 * repeat > 50 * n))
    one = stages["near_dedup"](spark, good, SF)
    classes = brute_classes({i: r.text for i, r in kept.items()})
    assert sorted(r.doc_id for r in one.collect()) == sorted(set(classes.values()))
    clean = stages["decontaminate"](spark, one, SF)
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert not any(v[4] for v in brute_hits(texts, items).values())
    hit = brute_hits({i: kept[i].text for i in texts}, items)
    assert all(texts[i] == kept[i].text for i in texts if not hit[i][4])
    private = stages["redact_pii"](spark, clean, SF)
    assert not any(plain_base(r.text) for r in private.collect())
    rows = stages["encode_bpe"](spark, private, SF).collect()
    ranks = bpe.Ranks(common.bounded_file(common.vocabulary_path("byte_bpe_50k.tiktoken")))
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks.ids, special_tokens={})
    final = {r.doc_id: r for r in private.collect()}
    assert len(rows) == len(final)
    assert all(list(r.ids) == own.encode_ordinary(final[r.doc_id].text) for r in rows)
    assert all(r.n_chars == len(r.text) for r in final.values())
    run = {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, SF).collect()}
    assert run == {r.doc_id: r.ids_sha256 for r in rows}


def test_random_order_of_rows_does_not_matter(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    random.seed(1)
    mixed = docs.orderBy("text").repartition(7)
    a = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()}
    assert a == {r.doc_id for r in corpus_pipeline.near_dedup(spark, mixed, SF).collect()}
