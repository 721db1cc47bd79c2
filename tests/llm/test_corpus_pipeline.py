"""The registered corpus queries and the pipeline on the smallest tables."""

from __future__ import annotations

import hashlib

import pytest

import corpus_pipeline
from tradelattice.llm import queries
from tradelattice.llm.common import table

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_gives_a_row_per_row(spark, name):
    rows = queries.QUERIES[name](spark, FOLDER)
    source = {"op5_warc": "pages"}.get(name, "documents")
    if name == "op1_decontamination":
        assert rows.select("doc_id").distinct().count() == rows.count() > 0
    elif name == "op11_spelling":
        assert rows.select("word").distinct().count() == rows.count() > 0
    elif name == "op13_chat":
        assert rows.count() == table(spark, FOLDER, "conversations").select("conv_id").distinct().count() + 1
    elif name == "op8_collision_search":
        assert rows.count() == 10 * table(spark, FOLDER, "embeddings").where("vec_id % 100 = 0").count()
    else:
        assert rows.count() == table(spark, FOLDER, source).count()


def test_pipeline_keeps_rows_of_its_input(spark):
    docs = table(spark, FOLDER, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    step = docs
    for _, function in corpus_pipeline.STAGES[:-1]:
        after = function(spark, step, FOLDER)
        assert after.columns == docs.columns and after.count() <= step.count()
        step = after.sparkSession.createDataFrame(after.collect(), docs.schema)
    kept = {r.doc_id for r in step.collect()}
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    assert {r.doc_id for r in rows} == kept and len(rows) > 0.4 * len(texts)
    assert all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in rows)
