"""The pipeline end to end on the smallest tables, and the registered names."""

import corpus_pipeline
import __spark_entry__ as entry
from plumbline.llm.common import read_table
from plumbline.llm.decontaminate import contamination
from plumbline.llm.near_dedup import near_duplicates

SMALL = "/root/testdata/sf0.001"


def test_names():
    names = entry.queries()
    assert sum(name.startswith("op") and name[2].isdigit() for name in names) == 10 and "pipeline" in names


def test_stages(spark):
    docs = read_table(spark, SMALL, "documents")
    columns, seen = docs.columns, {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = step(spark, docs, SMALL).cache()
        assert docs.columns == columns, name
        left = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert left and left <= seen, name
        seen = left
    assert not contamination(docs, read_table(spark, SMALL, "benchmark")).where("contaminated").count()
    assert near_duplicates(docs, percent=corpus_pipeline.NEAR_PERCENT).where("NOT kept").isEmpty()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == seen
