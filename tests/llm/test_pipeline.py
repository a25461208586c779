"""The registered queries and the pipeline on small tables."""

import corpus_pipeline
from scholarspark.llm import queries

from ..conftest import DATA
from ..oracle import assert_same, connect


def test_queries_and_oracles(spark):
    sf = f"{DATA}/sf0.001"
    con = connect(sf)
    for name, run in queries.QUERIES.items():
        df = run(spark, sf)
        if name in queries.ORACLES:
            assert assert_same(df, con, queries.ORACLES[name])
        else:
            assert df.count() > 0


def test_pipeline_stages(spark):
    sf = f"{DATA}/sf0.001"
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    docs, sizes = documents, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == documents.columns, name
        docs = corpus_pipeline.materialize(out, "test-stage")
        sizes.append(docs.count())
    assert documents.count() > sizes[0] >= sizes[1] == sizes[2] > sizes[3] > 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in docs.select("doc_id").collect()}
    whole = corpus_pipeline.run(spark, sf).collect()
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, whole)) == sorted(map(key, packed))
    lacking = spark.createDataFrame([(None, None, None, None, None)], documents.schema)
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, lacking, sf).collect()
        stage(spark, lacking.limit(0), sf).collect()
