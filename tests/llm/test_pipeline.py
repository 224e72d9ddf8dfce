"""Every registered operator runs; those with SQL agree with it; the pipeline's stages keep their promises."""

import pytest
from compare import compare, connect
from test_jaccard import brute_force

import corpus_pipeline
from optrace.llm import line_dedup, quality, toxicity
from optrace.llm.common import staged
from optrace.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(ORACLES))
def test_sql(spark, name):
    assert compare(QUERIES[name], ORACLES[name], spark, SF, connect(SF)) is None


def test_jaccard_query(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    got = sorted((tuple(x) for x in QUERIES["op10_jaccard_join"](spark, SF).collect()), key=str)
    assert got == brute_force([(x.doc_id, x.text) for x in documents.collect()])


def test_stages(spark):
    docs = documents = staged(spark.read.parquet(f"{SF}/documents.parquet"), "docs")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, SF), "stage")
        kept.append(docs)
        if name != "packing":
            assert docs.columns == documents.columns
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    ids = [sorted(x.doc_id for x in frame.select("doc_id").collect()) for frame in kept]
    good = quality.quality_verdicts(documents, quality.train(documents, labels)).filter("kept").collect()
    assert ids[0] == sorted(x.doc_id for x in good)
    clean = toxicity.toxicity_scores(kept[0], toxicity.train(kept[0], labels)).filter("predicted = 0").collect()
    assert ids[1] == ids[2] == sorted(x.doc_id for x in clean)
    lines = {x.doc_id: x.text for x in line_dedup.drop_boilerplate(kept[1]).collect()}
    assert {x.doc_id: x.text for x in kept[2].collect()} == lines
    assert all(x.n_chars == len(x.text) for x in kept[2].collect())
    groups = {(i, c) for i, _, c, _ in brute_force([(x.doc_id, x.text) for x in kept[2].collect()])}
    assert ids[3] == sorted({c for _, c in groups})
    assert sorted(set(ids[4])) == ids[3]


def test_empty_documents(spark, empty):
    docs = empty
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_near_copies_between_the_two_settings(spark):
    """Two words changed far apart in 100: 5-word sets share 86 of 106 shingles (0.81), 4-word sets 89 of 105 (0.848)."""
    words = [f"w{i}" for i in range(100)]
    other = ["new" if i in (30, 70) else w for i, w in enumerate(words)]
    rows = [(1, " ".join(words)), (2, " ".join(other)), (3, "a text of its own")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], corpus_pipeline.COLUMNS)
    found = dict(corpus_pipeline.STAGES)["n-gram Jaccard join"](spark, docs, SF)
    assert sorted(x.doc_id for x in found.collect()) == [1, 3]
    assert len({c for _, _, c, _ in brute_force(rows)}) == 3
