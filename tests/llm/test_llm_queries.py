"""The registered queries against their SQL, and the pipeline stage by stage."""

import zlib

import pytest
from compare import both
from conftest import SMALL

from postlake.llm.queries import oracle_sql, queries


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, name):
    got, wanted = both(queries()[name], oracle_sql()[name], spark, SMALL)
    assert got == wanted


def test_learned_queries_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    langs = queries()["op6_language_id"](spark, folder).collect()
    held = [r for r in langs if r["held_out"]]
    assert len(langs) == len(docs) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in langs)
    assert sum(docs[r["doc_id"]]["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held)
    toxic = [r for r in queries()["op2_toxicity"](spark, folder).collect() if r["doc_id"] in labels and r["held_out"]]
    assert sum(labels[r["doc_id"]] == r["predicted"] for r in toxic) >= 0.94 * len(toxic)


def test_pipeline(spark):
    import corpus_pipeline
    from postlake.llm.common import written

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, left = docs.columns, docs
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        left = written(stage(spark, left, SMALL))
        counts.append(left.count())
        assert left.columns == columns or name == "sharding"
    assert counts[0] >= counts[1] >= counts[2] >= counts[3] > 0 and counts[4] == counts[5]
    run = corpus_pipeline.run(spark, SMALL)
    assert sorted(map(repr, run.collect())) == sorted(map(repr, left.collect()))
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = written(stage(spark, empty, SMALL))
    assert empty.count() == 0
