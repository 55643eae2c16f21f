"""Every stage, and the pipeline, on tables whose further columns are called like the operators' own."""

import corpus_pipeline
import pytest
from helpers import empty, odd_documents
from pyspark.sql import functions as F

NAMES = ["bucket", "draw", "size", "score", "spans", "copy", "copies", "source_key", "_key", "lang_pred", "text_key", "_in0", "class_id", "_alone", "key", "target", "spans_email"]


def clashing(spark):
    docs, rows = odd_documents(spark)
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars")
    return docs.select("*", *[F.lit(f"own {n}").alias(n) for n in NAMES]), rows


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES[:-1], ids=lambda s: s[0])
def test_stages_keep_every_column(spark, stage):
    docs, rows = clashing(spark)
    got = stage[1](spark, docs, None)
    assert got.columns == docs.columns
    seen = got.collect()
    assert seen and all(r[n] == f"own {n}" for r in seen for n in NAMES)
    assert {r.doc_id for r in seen} <= {r[0] for r in rows}


def test_pipeline_on_odd_and_empty_tables(spark, tmp_path):
    docs, rows = clashing(spark)
    docs.write.parquet(f"{tmp_path}/odd/documents.parquet")
    out = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    assert out and {r.doc_id for r in out} <= {r[0] for r in rows}
    spans = {}
    for r in out:
        spans.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in spans.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at == 2048 or at & (at - 1) == 0
    empty(spark).write.parquet(f"{tmp_path}/empty/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0
