"""Every operator and stage on nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

import pytest

from tests.llm.conftest import edge_rows
from veil.llm.queries import QUERIES

OPS = [n for n in QUERIES if n not in ("pipeline", "op12_collocations")]    # one row per document


@pytest.mark.parametrize("name", OPS)
def test_hard_rows(spark, edge_dir, name):
    rows = QUERIES[name](spark, edge_dir).collect()
    ids = sorted(str(r.doc_id) for r in rows)
    assert ids == sorted(str(r[0]) for r in edge_rows())
    # repeated rows are treated alike; a slot belongs to one row alone
    twice = [{k: v for k, v in r.asDict().items() if k != "slot"} for r in rows if r.doc_id == 4]
    assert len(twice) == 2 and twice[0] == twice[1]


def test_hard_rows_of_collocations(spark, edge_dir):
    """Phrases, not documents: the words of the row without a language are those of ``und``."""
    rows = QUERIES["op12_collocations"](spark, edge_dir).collect()
    assert ("fr", "the the", 299, 300, 300, 300) in {(r.lang, r.phrase, r.a, r.l, r.r, r.n) for r in rows}
    assert all(r.a >= 100 for r in rows)


@pytest.mark.parametrize("name", [*QUERIES])
def test_empty_tables(spark, empty_dir, name):
    assert QUERIES[name](spark, empty_dir).collect() == []


def test_pipeline_stages_on_hard_rows(spark, edge_dir):
    import corpus_pipeline as P
    docs = spark.read.parquet(f"{edge_dir}/documents.parquet")
    columns = docs.columns
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, edge_dir)
        assert out.columns == columns, name
        assert [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
        out.collect()
    # near-dedup keeps one of the equal rows 4, 4 and 5, and the texts without words
    kept = sorted(str(r.doc_id) for r in P.near_dedup(spark, docs, edge_dir).collect())
    assert kept.count("4") == 1 and "5" not in kept and {"1", "2", "3"} <= set(kept)
    assert P.encode_bpe(spark, docs, edge_dir).count() == len(edge_rows())
    assert P.run(spark, edge_dir).count() > 0
