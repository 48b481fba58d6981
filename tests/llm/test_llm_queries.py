import os

import pytest
from oracle import compare, connect

import corpus_pipeline
from tidemark.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_against_sql(spark, name):
    ok, note, _, _ = compare(spark, connect(SF), QUERIES[name], ORACLES[name], SF)
    assert ok, note


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_pipeline_stages(spark):
    """Each stage takes what its operator rejects, and no more."""
    from tidemark.llm import decontaminate, mixing, simhash, toxicity
    from tidemark.llm.common import read

    docs = read(spark, SF, "documents")
    frames = [docs]
    for _, stage in corpus_pipeline.STAGES[:4]:
        frames.append(stage(spark, frames[-1], SF).cache())
    assert all(f.columns == docs.columns for f in frames)
    one, two, three, four = ({r["doc_id"] for r in f.select("doc_id").collect()} for f in frames[1:])
    scores = toxicity.score(docs, toxicity.fit(docs, read(spark, SF, "labels")))
    assert one == {r["doc_id"] for r in scores.where("score < 0.5").collect()}
    assert two == {r["component_id"] for r in simhash.classes(frames[1]).collect()}
    assert three == two - {r["doc_id"] for r in decontaminate.leaks(frames[2], read(spark, SF, "benchmark")).collect()}
    assert four == {r["doc_id"] for r in mixing.mix(frames[3]).where("taken > 0").collect()}
    last = corpus_pipeline.STAGES[4][1](spark, frames[4], SF)
    rows = last.select("slot", "doc_ids", "n").collect()
    assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
    # packed: one sequence at most is not full
    assert {i for r in rows for i in r["doc_ids"]} == four and sum(r["n"] < 512 for r in rows) <= 1
