"""The pipeline and the registered queries on the smallest shared tables."""

import os

import corpus_pipeline
import pytest
from compare import differences, duck

from spanveil.llm import queries, simhash

ROOT = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(ROOT), reason="shared tables not present")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(shared, name):
    assert differences(queries.QUERIES[name](shared, ROOT), duck(ROOT), queries.ORACLES[name]) is None


def test_stages(shared):
    docs = shared.read.parquet(f"{ROOT}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.staged(stage(shared, docs, ROOT), name)
        if name != "packing":
            assert docs.columns == columns
        left = {r.doc_id for r in docs.select("doc_id").distinct().collect()}
        assert left <= ids and (name in ("toxicity", "simhash_near_dedup") or left == ids)
        if name == "simhash_near_dedup":
            assert simhash.near_duplicates(docs).where("doc_id <> component_id").count() == 0
        if name == "pii":
            assert docs.where("text rlike '@mail[0-9]'").count() == 0
        ids = left
    assert docs.where("length > 2048 or offset + length > 2048").count() == 0


def test_stages_on_nothing(shared):
    docs = shared.read.parquet(f"{ROOT}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[1:]:
        docs = corpus_pipeline.staged(stage(shared, docs, ROOT), "empty")
    assert docs.count() == 0
