import math
import os

import numpy as np
import pytest

from brindle.llm import quantise


def brute(rows, queries, k):
    out = {}
    for q, v in queries:
        s = sorted(((-float(sum(float(np.float32(a)) * float(np.float32(b)) for a, b in zip(v, x))), i) for i, x in rows if i != q))[:k]
        out[q] = [(i, -d) for d, i in s]
    return out


def test_against_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(400)]
    rows += [(500 + i, rows[3][1]) for i in range(30)]  # ties
    odd = [(600, None), (620, [0.0] * 8), (640, [1.0, None] + [0.0] * 6), (660, [float("nan")] + [1.0] * 7), (680, [1.0] * 3), (700, [math.inf] * 8), (None, [1.0] * 8), (720, [])]
    df = spark.createDataFrame([(i, v, 1.0, 2) for i, v in rows + odd], "vec_id long, embedding array<float>, score double, rank int").repartition(3)
    got = quantise.nearest(df, df.where("vec_id % 20 = 0"), k=20).collect()
    want = brute(rows, [r for r in rows if r[0] % 20 == 0], 20)
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(found[r.query_id])
    assert set(found) == set(want)
    hits = [len({i for i, _ in found[q]} & {i for i, _ in want[q]}) / 20 for q in want]
    assert np.mean(hits) >= 0.9
    exact = {i: np.asarray(v, np.float32).astype(float) for i, v in rows}
    for q, near in found.items():
        assert near == sorted(near, key=lambda x: (-x[1], x[0]))
        assert all(s == pytest.approx(float((exact[q] * exact[i]).sum()), abs=1e-12) for i, s in near)


def test_ties_go_to_the_smaller_id(spark):
    rows = [(i, [1.0, 0.0]) for i in range(0, 3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = quantise.nearest(df, df.where("vec_id = 40"), k=5).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [0, 1, 2, 3, 4]


def test_few_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.vec_id, r.score) for r in quantise.nearest(df, df.where("vec_id = 0")).collect()] == [(0, 1, 4.0)]
    assert quantise.nearest(df.limit(0), df.limit(0)).count() == 0


def test_beam_search_codes():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 16))
    books = quantise.fit_books(x, books=4, words=64)
    codes, sums = quantise.encode(x[:200], books)
    assert np.allclose(sums, sum(books[m][codes[:, m]] for m in range(4)))
    greedy, s1 = quantise.encode(x[:200], books, beam=1)
    assert ((x[:200] - sums) ** 2).sum() <= ((x[:200] - s1) ** 2).sum() < (x[:200] ** 2).sum() * 0.5


def test_recall_on_embeddings(spark, small):
    import pyarrow.parquet as pq

    path = small.replace("sf0.001", "sf0.1")
    path = path if os.path.isdir(path) else small
    t = pq.read_table(f"{path}/embeddings.parquet").to_pydict()
    ids, x = np.asarray(t["vec_id"]), np.asarray(t["embedding"], float)
    df = spark.read.parquet(f"{path}/embeddings.parquet")
    got = {}
    for r in quantise.nearest(df, df.where("vec_id % 20 = 0")).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    recall = []
    for i in np.flatnonzero(ids % 20 == 0):
        s = x @ x[i]
        s[i] = -np.inf
        recall.append(len(got[int(ids[i])] & set(ids[np.lexsort((ids, -s))[:20]].tolist())) / 20)
    assert np.mean(recall) >= 0.9


def test_queries_of_another_width_take_no_part(spark):
    rows = [(i, [float(i % 3), 1.0, float(i)]) for i in range(30)]
    asked = [(100, [1.0, 2.0]), (101, [1.0, 1.0]), (102, [1.0, 0.0, 2.0])]
    schema = "vec_id long, embedding array<double>"
    got = quantise.nearest(spark.createDataFrame(rows, schema), spark.createDataFrame(asked, schema), k=3).collect()
    assert {r.query_id for r in got} == {102} and [r.vec_id for r in sorted(got, key=lambda r: r["rank"])] == [29, 28, 26]  # 26 and 27 tie
