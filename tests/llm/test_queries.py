"""The registered queries on the provided tables, and the pipeline against its stages done plainly."""

import os

import pytest

from gazette.llm import queries
from tests import oracle

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the provided tables are absent")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_rows_are_the_oracles(spark, name):
    oracle.compare(spark, oracle.connect(SF), queries.QUERIES[name], queries.SQL[name], SF)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - {"op1_warc", "op10_decontamination"}))
def test_one_row_for_each_document(spark, name):
    got = queries.QUERIES[name](spark, SF)
    assert sorted(r.doc_id for r in got.select("doc_id").collect()) == sorted(r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect())


def test_pipeline(spark):
    import corpus_pipeline
    from gazette.llm import near_dedup
    from tests.llm.test_ops import plain_groups, sha

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    left = {k: t for k, t in docs.items() if t and any(map(str.isalpha, t))}
    last = {t: k for k, t in sorted(left.items())}
    left = {k: left[k] for k in sorted(last.values())}
    ids = list(left)
    groups = plain_groups(list(left.values()), near_dedup.Rule(5, 80))
    left = {k: left[k] for n, k in enumerate(ids) if groups[n][1] == n}
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").collect()]
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) <= set(left)
    dropped = set(left) - set(got)
    words = lambda t: " ".join(t.lower().split())
    full = {k for k, t in left.items() if any(words(i) in words(t) for i in items)}
    assert full <= dropped and len(dropped) <= len(full) + 3
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=queries.vocabulary("piece_bpe_32k.model"))
    for k, r in got.items():
        assert r.ids_sha256 == sha(",".join(map(str, sp.encode(left[k]))))


def test_stages():
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "decontamination", "sentencepiece"]
