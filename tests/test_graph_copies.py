"""Near copies do not fill a beam and end it; a graph travels in pieces."""

import numpy as np

from brindle.operators import hnsw


def unit(x):
    return x / np.linalg.norm(x, axis=1)[:, None]


def test_a_large_group_of_near_copies_hides_no_result():
    rng = np.random.default_rng(11)
    own = unit(rng.normal(size=(900, 64)))
    copies = unit(own[0] + 0.01 * rng.normal(size=(700, 64)))
    x = np.concatenate([own, copies])[rng.permutation(1600)]
    graph = hnsw.Graph(np.arange(1600), x)
    hits = [len({n for n, _ in graph.search(q, 10)} & set(np.argsort(-(x @ q), kind="stable")[:10].tolist())) for q in x[::4]]
    assert min(hits) >= 9


def test_equal_vectors_come_with_the_smallest_ids():
    x = np.repeat(unit(np.random.default_rng(12).normal(size=(3, 16))), 400, 0)
    graph = hnsw.Graph(np.arange(1200)[::-1].copy(), x)
    assert [n for n, _ in graph.search(x[0], 10)] == list(range(800, 810))


def test_a_graph_lies_in_pieces(spark, monkeypatch):
    x = unit(np.random.default_rng(13).normal(size=(300, 16)))
    v = spark.createDataFrame([(i, r) for i, r in enumerate(x.tolist())], "chunk_id long, embedding array<float>")
    q = v.where("chunk_id < 20").withColumnRenamed("chunk_id", "qid")
    want = sorted(map(tuple, hnsw.search_hnsw(hnsw.build_hnsw(v, shards=2), q, 5).collect()))
    monkeypatch.setattr(hnsw, "PIECE", 4096)
    index = hnsw.build_hnsw(v, shards=2).cache()
    assert index.count() > 4 and index.selectExpr("max(length(graph))").first()[0] <= 4096
    assert sorted(map(tuple, hnsw.search_hnsw(index, q, 5).collect())) == want
