"""Queries are dealt into lots."""

import numpy as np

from brindle.operators import hnsw


def test_a_graph_is_asked_lots_of_queries(spark, monkeypatch):
    x = np.random.default_rng(7).normal(size=(120, 8))
    v = spark.createDataFrame([(i, r) for i, r in enumerate(x.tolist())], "chunk_id long, embedding array<double>")
    index = hnsw.build_hnsw(v, shards=2).cache()
    q = v.withColumnRenamed("chunk_id", "qid")
    whole = sorted(hnsw.search_hnsw(index, q, 5).collect())
    monkeypatch.setattr(hnsw, "QUERY_LOT", 16)
    made = hnsw.search_hnsw(index, q, 5)
    assert sorted(made.collect()) == whole
    assert "lot" in made._jdf.queryExecution().analyzed().toString()
