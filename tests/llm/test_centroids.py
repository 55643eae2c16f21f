import hashlib
import math

import duckdb
import numpy as np
import pytest

from brindle.llm import centroids as ce

COLUMNS = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
SCHEMA = "vec_id long, embedding array<double>, cluster int, distance string"


def brute(rows, k=16, rounds=3):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    c = [v for _, v in sorted(((hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept))[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, m)), j) for j, m in enumerate(c))

    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        for j in range(len(c)):
            own = [v for (_, v), o in zip(kept, of) if o == j]
            if own:
                c[j] = [sum(x) // len(own) for x in zip(*own)]
    found = [(i, *near(v)) for i, v in kept]
    total, by = sum(d for _, d, _ in found), {}
    for _, d, j in found:
        by[j] = by.get(j, 0) + d
    return [(i, j, d, by[j], total, hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, d, j in found]


def rows_of(got):
    return sorted((tuple(r[c] for c in COLUMNS) for r in got), key=lambda r: (r[0] is None, r))


def vectors(seed, n=300):
    rng = np.random.default_rng(seed)
    x = (rng.integers(0, 6, n)[:, None] == np.arange(6)).astype(float) @ rng.normal(size=(6, 64)) * 0.3 + rng.normal(size=(n, 64)) * rng.random(64) * 0.2
    return [(i, v) for i, v in enumerate(x.tolist())]


def test_against_brute_force(spark):
    rows = vectors(1)
    rows += [(400, None), (401, [0.1] * 63), (402, [0.1] * 65), (403, [None] + [0.0] * 63), (404, [math.nan] + [0.0] * 63), (405, [math.inf] + [0.0] * 63), (406, []), (None, [0.25] * 64), (5, [9.0] * 64), (5, [-9.0] * 64), rows[7], rows[7]]
    df = spark.createDataFrame([(*r, 3, "x") for r in rows], SCHEMA).repartition(5)
    assert rows_of(ce.clustered(df).collect()) == sorted(brute(rows), key=lambda r: (r[0] is None, r))


@pytest.mark.parametrize("n", [0, 1, 7])
def test_few_vectors(spark, n):
    rows = vectors(2, 8)[:n]
    got = ce.clustered(spark.createDataFrame([(*r, 1, "") for r in rows], SCHEMA)).collect()
    assert rows_of(got) == sorted(brute(rows))


def test_equal_vectors_leave_empty_centroids(spark):
    """All centroids equal: ties go to number 0, the others stay."""
    rows = [(i, [0.5] * 64) for i in range(40)]
    got = rows_of(ce.clustered(spark.createDataFrame([(*r, 1, "") for r in rows], SCHEMA)).collect())
    assert got == sorted(brute(rows)) and {r[1] for r in got} == {0}


def test_beyond_the_limit_takes_no_part(spark):
    rows = vectors(3, 30)
    df = spark.createDataFrame([(*r, 1, "") for r in [*rows, (99, [1e30] * 64)]], SCHEMA)
    assert rows_of(ce.clustered(df).collect()) == sorted(brute(rows))


def test_partial_distances_end_early_and_miss_nothing():
    """Every nearest centroid, ties to the smaller number, for any order of dimensions; with the highest variance first less is finished."""
    rng = np.random.default_rng(4)
    x = (rng.normal(size=(500, 64)) * np.linspace(20, 1, 64)).astype(np.int64)
    c = np.vstack([x[:9], x[3:6], np.zeros((1, 64), np.int64)])  # 3 to 5 stand twice
    d = ((x[:, None] - c[None]) ** 2).sum(2)
    done = {}
    for name, order in (("high", np.arange(64)), ("low", np.arange(64)[::-1]), ("mixed", rng.permutation(64))):
        near, distance, done[name] = ce.nearest(x, c, order)
        assert (near == d.argmin(1)).all() and (distance == d.min(1)).all()
    assert done["high"] < done["low"] and done["high"] < 0.5 * d.size
    odd, _, _ = ce.nearest(x[:, :5], c[:, :5], np.arange(5))
    assert (odd == ((x[:, None, :5] - c[None, :, :5]) ** 2).sum(2).argmin(1)).all()


def test_order_of_variance(spark):
    rows = [(i, [float(i % 5) if d == 9 else float(i % 2) / 2 if d == 4 else 0.0 for d in range(64)]) for i in range(50)]
    df = spark.createDataFrame([(*r, 1, "") for r in rows], SCHEMA)
    assert ce.by_variance(ce._rows(df, "vec_id", "embedding")).tolist()[:3] == [9, 4, 0]


def test_against_sql(spark, small):
    got = rows_of(ce.op13_centroids(spark, small).collect())
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{small}/embeddings.parquet'")
    assert got and got == sorted(map(tuple, con.sql(ce.sql()).df()[COLUMNS].values.tolist()))
