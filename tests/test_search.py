import math

import numpy as np
import pytest

from brindle.operators import bm25, dense, evaluate, fusion, hnsw


def chunks(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string")


def ask(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "qid long, text string")


def listed(spark, *ids):
    return spark.createDataFrame([(0, i + 1, c) for i, c in enumerate(ids)], "qid long, rank int, chunk_id long")


def test_ledger(spark):
    index = bm25.build_index(chunks(spark, "alpha", "beta", "alpha alpha", "堆"))
    assert {(r.term, r.chunk_id, r.tf, r.dl) for r in index.postings.collect()} == {("alpha", 0, 1, 1), ("beta", 1, 1, 1), ("alpha", 2, 2, 2)}
    s = index.stats.first()
    assert s.n == 4 and s.avgdl == 1.0 and {(r.term, r.df) for r in index.terms.collect()} == {("alpha", 2), ("beta", 1)}


def test_scores_and_ties(spark):
    own = chunks(spark, "x", "x", "x", "y z")
    got = bm25.search(bm25.build_index(own), ask(spark, "x", "x x", "", "nothing"), 10).orderBy("qid", "rank").collect()
    idf = math.log(1 + (4 - 3 + 0.5) / 3.5)
    w = idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 1 / 1.25))
    assert [(r.qid, r.rank, r.chunk_id) for r in got] == [(q, i + 1, i) for q in (0, 1) for i in range(3)]
    assert got[0].score == pytest.approx(w, rel=1e-6) and got[3].score == pytest.approx(2 * w, rel=1e-6)
    assert bm25.search(bm25.build_index(own), ask(spark, "x"), 0).count() == 0


def test_search_without_index_is_the_same(spark):
    own = chunks(spark, "ret2libc needs libc base", "web sql injection", "leak the libc base then ret2libc", "堆溢出利用")
    q = ask(spark, "ret2libc libc base", "溢出")
    a, b = bm25.search(bm25.build_index(own), q).collect(), bm25.search_texts(own, q).collect()
    assert sorted(a) == sorted(b) and {r.chunk_id for r in a if r.qid == 0} == {0, 2} and {r.chunk_id for r in a if r.qid == 1} == {3}


def test_rrf(spark):
    fused = lambda *x: [(r.chunk_id, r.score) for r in fusion.rrf_fuse(*[listed(spark, *i) for i in x]).orderBy("rank").collect()]
    assert [c for c, _ in fused([0, 1, 2], [1, 0, 3])] == [0, 1, 2, 3]
    assert fused([4, 4, 9]) == [(4, pytest.approx(1 / 61)), (9, pytest.approx(1 / 63))]
    assert [c for c, _ in fused([0, 1], [2, 3])] == [0, 2, 1, 3]
    assert fused([], []) == []


def test_hybrid_falls_back_by_query(spark):
    lex = spark.createDataFrame([(0, 1, 5, 2.0), (1, 1, 6, 1.0)], "qid long, rank int, chunk_id long, score float")
    near = spark.createDataFrame([(0, 1, 7, 0.9)], "qid long, rank int, chunk_id long, score float")
    got = {(r.qid, r.chunk_id): round(r.score, 4) for r in fusion.hybrid(lex, near).collect()}
    assert got == {(0, 5): 0.0164, (0, 7): 0.0164, (1, 6): 1.0}
    assert fusion.hybrid(lex, None).count() == 2
    labels = {r.chunk_id: r.route for r in fusion.route_scores(fusion.hybrid(lex, near), lex, near).collect()}
    assert labels == {5: "bm25", 7: "vec", 6: "bm25"}


def vecs(spark, *rows):
    return spark.createDataFrame(list(enumerate([[float(x) for x in r] for r in rows])), "chunk_id long, embedding array<float>")


def test_flat(spark):
    v = vecs(spark, [1, 0], [0, 1], [2, 0], [1, 0])
    assert [(r.chunk_id, r.score) for r in dense.search_one(v, [1.0, 0.0], 3).orderBy("rank").collect()] == [(2, 2.0), (0, 1.0), (3, 1.0)]
    q = vecs(spark, [1, 0], [0, 1]).withColumnRenamed("chunk_id", "qid")
    got = dense.search_flat(v, q, 2).orderBy("qid", "rank").collect()
    assert [(r.qid, r.chunk_id, r.score) for r in got] == [(0, 2, 2.0), (0, 0, 1.0), (1, 1, 1.0), (1, 0, 0.0)]
    assert dense.search_flat(v, q, 0).count() == 0 and dense.search_flat(v.limit(0), q, 3).count() == 0
    with pytest.raises(ValueError):
        dense.search_one(v, [1.0], 1)
    with pytest.raises(ValueError):
        dense.build_flat(vecs(spark, [1, 0], [1, 0, 0]))


def test_graph_recall_and_determinism(spark):
    rng = np.random.default_rng(4)
    rows = []
    for _ in range(25):
        c = rng.normal(size=16) * 4
        rows += [(x := c + rng.normal(size=16)) / np.linalg.norm(x) for _ in range(8)]
    v = vecs(spark, *rows)
    asked = [(x := rows[i * 4] + 0.2 * rng.normal(size=16)) / np.linalg.norm(x) for i in range(50)]
    q = vecs(spark, *asked).withColumnRenamed("chunk_id", "qid")
    exact = dense.search_flat(v, q, 10)
    for shards in (1, 3):
        found = hnsw.search_hnsw(hnsw.build_hnsw(v, 7, shards), q, 10)
        assert hnsw.recall(found, exact).first().recall >= 0.85
    again = hnsw.search_hnsw(hnsw.build_hnsw(v, 7, 3), q, 10)
    assert sorted(found.collect()) == sorted(again.collect())
    assert hnsw.search_hnsw(hnsw.build_hnsw(v.limit(0)), q, 5).count() == 0
    assert hnsw.search_hnsw(hnsw.build_hnsw(v), q, 0).count() == 0


def test_far_groups_are_reached():
    """Groups without a link between them are all searched."""
    rng = np.random.default_rng(6)
    x = np.concatenate([centre + rng.normal(size=(60, 8)) * 0.01 for centre in np.eye(8)[:4]])
    graph = hnsw.Graph(np.arange(len(x)), x)
    assert len(graph.islands)
    for q in x[::20]:
        s = x @ q
        assert [i for i, _ in graph.search(q, 10)] == np.lexsort((np.arange(len(x)), -s))[:10].tolist()


def test_metrics(spark):
    q = spark.createDataFrame([(i,) for i in range(4)], "qid long")
    judged = spark.createDataFrame([(0, 1, True), (0, 2, True), (1, 3, True), (2, 1, False)], "qid long, rank int, relevant boolean")
    first = evaluate.first_relevant(q, judged)
    m = evaluate.metrics(first).first()
    assert (m.n, m.hit_1, m.hit_5, m.hit_10) == (4, 0.25, 0.5, 0.5) and m.mrr == pytest.approx((1 + 1 / 3) / 4)
    other = spark.createDataFrame([(0, 2), (1, None), (2, None), (3, 1)], "qid long, rank int")
    assert {r.qid: r.verdict for r in evaluate.verdicts(first, other, "a", "b").collect()} == {0: "a", 1: "a", 2: "tie", 3: "b"}
