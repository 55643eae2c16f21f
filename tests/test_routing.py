import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.operators import dense, hnsw, routing


def clustered(seed, clusters=12, each=40, dim=16, spread=0.3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dim))
    x = np.repeat(centres / np.linalg.norm(centres, axis=1)[:, None], each, 0) + rng.normal(size=(clusters * each, dim)) * spread / np.sqrt(dim)
    return x / np.linalg.norm(x, axis=1)[:, None]


def table(spark, x, key="chunk_id", step=1):
    return spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist()) if i % step == 0], f"{key} long, embedding array<float>")


def same(a, b):
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def met(monkeypatch, index, q, k):
    """The result, and the meetings of the second step."""
    seen = []
    monkeypatch.setattr(routing, "meetings", lambda i, a, s, own=routing.meetings: (seen.append(own(i, a, s).count()) if s is None else None) or own(i, a, s))
    out = routing.search_bounded(index, q, k)
    monkeypatch.undo()
    return out, seen[0]


def test_bounded_search_is_exact_and_skips(spark, monkeypatch):
    """Clustered vectors: as the scan, and most meetings are skipped; those of vectors without clusters are not, with the same rows."""
    monkeypatch.setattr(routing, "QUERY_BLOCK", 8)
    for x, most in ((clustered(1), 0.4), (np.random.default_rng(2).normal(size=(300, 16)), 1.0)):
        v, q = table(spark, x), table(spark, x, "qid", 5)
        index = routing.in_blocks(v, cells=12, size=16)
        got, n = met(monkeypatch, index, q, 5)
        same(got, dense.search_flat(v, q, 5))
        query_blocks = -(-q.count() // 8)
        assert n <= most * query_blocks * len(index.heads.number) * 1.5
        if most < 1:
            assert n < query_blocks * len(index.heads.number) * most


def test_bounded_search_with_ties_and_one_hot_cell(spark, monkeypatch):
    """Equal vectors in many blocks: ties go to the smaller id whatever was skipped."""
    x = np.vstack([np.tile([1.0, 0.0, 0.0], (90, 1)), clustered(3, 4, 10, 3), np.zeros((3, 3))])
    v, q = table(spark, x), table(spark, x, "qid", 7)
    index = routing.in_blocks(v, cells=4, size=8)
    assert len(index.heads.number) > 8
    same(routing.search_bounded(index, q, 6), dense.search_flat(v, q, 6))
    monkeypatch.setattr(routing, "SENT_HEADS", 3)
    by_cell = routing.in_blocks(v, cells=4, size=8)
    assert len(by_cell.heads.number) <= 4
    same(routing.search_bounded(by_cell, q, 6), dense.search_flat(v, q, 6))


def test_bounded_search_of_few_and_none(spark):
    x = clustered(4, 2, 3)
    v, q = table(spark, x), table(spark, x, "qid")
    same(routing.search_bounded(routing.in_blocks(v), q, 50), dense.search_flat(v, q, 50))
    assert routing.search_bounded(routing.in_blocks(v.limit(0)), q, 5).count() == 0
    assert routing.search_bounded(routing.in_blocks(v), q.limit(0), 5).count() == 0
    assert routing.search_bounded(routing.in_blocks(v), q, 0).count() == 0
    with pytest.raises(ValueError):
        routing.search_bounded(routing.in_blocks(v), q.withColumn("embedding", F.slice("embedding", 1, 3)), 5)


def test_routed_graphs(spark):
    """A quarter of the cells gives the results; large cells have several graphs; lots of queries change nothing."""
    x = clustered(5, 10, 60)
    v, q = table(spark, x), table(spark, x, "qid", 4)
    exact = dense.search_flat(v, q, 10)
    index = routing.build_routed(v, 8, shard=40)
    assert index.graphs.select("cell").distinct().count() <= 8 < index.graphs.count()
    found = routing.search_routed(index, q, 10, probes=2)
    assert hnsw.recall(found, exact).first().recall >= 0.95
    assert routing.routes(index, q, 2).groupBy("qid").count().agg(F.max("count")).first()[0] == 2
    assert found.where("rank = 1").count() == q.count()


def test_lots_of_queries_change_nothing(spark, monkeypatch):
    x = clustered(6, 4, 30)
    v, q = table(spark, x), table(spark, x, "qid", 3)
    index = routing.build_routed(v, 3)
    want = sorted(map(tuple, routing.search_routed(index, q, 5, 2).collect()))
    monkeypatch.setattr(routing, "QUERY_LOT", 4)
    assert sorted(map(tuple, routing.search_routed(index, q, 5, 2).collect())) == want
    assert routing.search_routed(routing.build_routed(v.limit(0), 3), q, 5, 2).count() == 0
    assert routing.search_routed(index, q, 0, 2).count() == 0
