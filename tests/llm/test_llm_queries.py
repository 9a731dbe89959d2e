"""The registered queries of the folder against their SQL, and the pipeline stage by stage."""

import pytest

import __spark_entry__ as entry_module
from compare import check, connect
from tallyloom.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    _, rows, problem = check(spark, con, name, QUERIES[name], ORACLES.get(name), FOLDER)
    assert problem is None, problem
    assert rows > 0


def test_registered():
    assert set(QUERIES) | {"pipeline"} <= set(entry_module.queries())


def test_stages_take_odd_rows(spark, odd, empty):
    import corpus_pipeline

    for docs in (odd, empty):
        docs = docs.withColumn("n_chars", docs["doc_id"] * 0)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, FOLDER)
            if name != "pack":
                assert out.columns == docs.columns
            assert out.count() >= 0


def test_pipeline_against_stages(spark):
    """What run() returns packs exactly the documents that a plain walk through the stages' decisions leaves."""
    import corpus_pipeline
    from tallyloom.llm.mixing import mix_report

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    step = {}
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, FOLDER)
        rows = docs.collect()
        docs = spark.createDataFrame(rows, docs.schema)
        step[name] = rows
    assert len(step["near_duplicates"]) < len(step["language"]) <= 200
    assert {r.doc_id for r in step["pseudonyms"]} == {r.doc_id for r in step["near_duplicates"]}
    times = {r.doc_id: r.repeats for r in mix_report(docs).collect()}
    packed = corpus_pipeline.run(spark, FOLDER).collect()
    first = [r.doc_id for r in packed if r.piece == 0]
    assert {d: first.count(d) for d in set(first)} == {d: n for d, n in times.items() if n}
