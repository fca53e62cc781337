"""The pipeline: each stage against a plain version on what its predecessor kept."""

import corpus_pipeline
import pytest
from tillsight.llm import queries
from tillsight.llm.common import table

from tests.llm.test_fingerprints import plain_components, plain_fingerprint
from tests.llm.test_suffixes import plain_removals

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    """The rows after each stage."""
    docs, out = table(spark, SF, "documents"), []
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, SF), "test")
        out.append(docs)
    return out


def test_stages_filter_by_their_operators(spark, kept):
    docs = table(spark, SF, "documents")
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    toxic = {r.doc_id for r in queries.QUERIES["op3_nb_char_ngrams"](spark, SF).where("predicted = 1").collect()}
    assert ids(kept[0]) == ids(docs) - toxic and toxic
    assert ids(kept[1]) < ids(kept[0])
    assert [df.columns for df in kept[:4]] == [docs.columns] * 4


def test_one_document_of_each_group(kept):
    before = [(r.doc_id, r.text) for r in kept[1].collect()]
    component = plain_components([(d, plain_fingerprint(t)) for d, t in before])
    assert {r.doc_id for r in kept[2].collect()} == set(component)


def test_repeats_are_cut(kept):
    before = [(r.doc_id, r.text) for r in kept[2].collect()]
    want = {d: w[4].decode("utf-8", "ignore") for (d, _), w in zip(before, plain_removals([t for _, t in before]))}
    assert {r.doc_id: r.text for r in kept[3].collect()} == want


def test_everything_left_is_packed(spark, kept):
    packed = {}
    for r in kept[4].collect():
        packed[r.doc_id] = packed.get(r.doc_id, 0) + r.length
    assert set(packed) == {r.doc_id for r in kept[3].collect()}
    again = corpus_pipeline.run(spark, SF)
    assert again.agg({"length": "sum"}).first()[0] == sum(packed.values())


def test_empty_and_clashing_columns_pass_through(spark, kept):
    wide = table(spark, SF, "documents").selectExpr("*", "1 as score", "'x' as key", "2.5 as fp", "doc_id as node")
    empty = wide.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
        if name != "packing":
            out = stage(spark, wide, SF)
            assert out.columns == wide.columns and out.count() > 0
