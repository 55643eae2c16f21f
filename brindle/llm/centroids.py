"""Centroid clustering of integer vectors by partial-distance search.

Components become integers; rounds of exact integer k-means follow. To find a vector's nearest centroid the squared
differences are added up over the dimensions of the highest variance first, a few dimensions at a time. The centroid
that is nearest after the first step is finished at once and gives the distance to beat; others are abandoned when
their sum so far lies strictly above it, and those that never do finish all dimensions. So ties are always seen, and go
to the smaller number. Sums of a cluster are taken in the tasks, added in Spark as decimals, and only the
centroids (k x dimensions) reach the driver.

The vectors are read from the table given once for the first centroids, once for variances, once a round, once for the
inertia and once for the result; nothing is written between, so a lost executor costs its own tasks. A caller with a
costly plan should write it first.

Defined results: vectors that are null, of another size, with null or non-finite components or with a component
beyond 2^20 (whose distances would not fit 64 bits) take no part; a null id counts as the empty text in the hash; equal
ids are ordered by their components; fewer vectors than k give fewer centroids, none give an empty result; repeated
rows are clustered one by one; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, released, small_batches

SIZE, SCALE, CLUSTERS, ROUNDS = 64, 64, 16, 3
#: Components beyond this take no part.
LIMIT = 1 << 20
#: Dimensions added in each step of the search.
STEPS = (8, 8, 16, 32)


def integers(column: pa.Array, size: int = SIZE, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """(rows that take part, their components as integers floor(scale * x)) of a column of lists."""
    right = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(column), size), False).to_numpy(zero_copy_only=False))
    values = pc.list_flatten(column.take(pa.array(right))).cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, size)
    whole = (np.isfinite(values) & (np.abs(values) <= LIMIT)).all(1)
    return right[whole], np.floor(values[whole] * scale).astype(np.int64)


def nearest(x: np.ndarray, centroids: np.ndarray, order: np.ndarray, steps: tuple[int, ...] = STEPS) -> tuple[np.ndarray, np.ndarray, int]:
    """(nearest centroid of each row, squared distance, pairs finished) by partial distances over dimensions in the given order."""
    x, c = np.ascontiguousarray(x[:, order]), np.ascontiguousarray(centroids[:, order])
    n, k = len(x), len(c)
    ends = np.minimum(np.cumsum([*steps, max(0, x.shape[1] - sum(steps))]), x.shape[1])
    part = ((x[:, None, : ends[0]] - c[None, :, : ends[0]]) ** 2).sum(2)
    first = part.argmin(1)
    best = part[np.arange(n), first] + ((x[:, ends[0] :] - c[first, ends[0] :]) ** 2).sum(1)
    alive = part <= best[:, None]
    alive[np.arange(n), first] = False
    row, cand = np.nonzero(alive)
    sums = part[row, cand]
    for a, b in zip(ends[:-1], ends[1:]):
        sums = sums + ((x[row, a:b] - c[cand, a:b]) ** 2).sum(1)
        keep = sums <= best[row]
        row, cand, sums = row[keep], cand[keep], sums[keep]
    far = np.iinfo(np.int64).max
    full = np.full((n, k), far)
    full[np.arange(n), first] = best
    full[row, cand] = sums
    near = full.argmin(1)  # the smallest number among equals
    return near, full[np.arange(n), near], n + len(row)


@dataclass
class Centroids:
    """Fitted centroids, and the dimensions from the highest variance to the lowest."""

    vectors: np.ndarray
    order: np.ndarray

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return nearest(x, self.vectors, self.order)[:2]

    def hashes(self) -> list[str]:
        return [hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for v in self.vectors.tolist()]


def _rows(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    return vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))


def _map(rows: DataFrame, task: Callable[[Iterator[tuple[pa.Array, np.ndarray]]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow over (ids, integer vectors) of the rows that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def kept() -> Iterator[tuple[pa.Array, np.ndarray]]:
            for b in batches:
                at, x = integers(b.column(1))
                if len(x):
                    yield b.column(0).take(pa.array(at)), x

        yield from task(kept())

    return rows.mapInArrow(released(run), schema)


def first_centroids(rows: DataFrame, k: int = CLUSTERS, salt: str = "1") -> np.ndarray:
    """The k vectors with the smallest sha256 of `salt:id`, in ascending order of the hash."""

    def smallest(kept: Iterator[tuple[pa.Array, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        best: list[tuple[str, list[int]]] = []
        for ids, x in kept:
            hashes = [hashlib.sha256(f"{salt}:{'' if i is None else i}".encode()).hexdigest() for i in ids.to_pylist()]
            edge = sorted(hashes)[: k][-1]
            best = sorted(best + [(h, x[i].tolist()) for i, h in enumerate(hashes) if h <= edge])[:k]
        yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in best], pa.string()), pa.array([v for _, v in best], pa.list_(pa.int64()))], names=["hash", "vector"])

    found = _map(rows, smallest, "hash string, vector array<long>").orderBy("hash", "vector").limit(k).collect()
    return np.asarray([r["vector"] for r in found], np.int64).reshape(len(found), SIZE)


def by_variance(rows: DataFrame) -> np.ndarray:
    """All dimensions, the highest variance first. The sums are floating-point: they order the work and touch no result."""

    def moments(kept: Iterator[tuple[pa.Array, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((SIZE, 3))
        for _, x in kept:
            total += np.column_stack([np.full(SIZE, len(x)), x.sum(0), (x.astype(float) ** 2).sum(0)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(SIZE, dtype=np.int32)), *map(pa.array, total.T)], names=["dim", "n", "s", "q"])

    found = _map(rows, moments, "dim int, n double, s double, q double").groupBy("dim").agg(*[F.sum(c).alias(c) for c in "nsq"]).collect()
    spread = {r["dim"]: r["q"] / max(r["n"], 1) - (r["s"] / max(r["n"], 1)) ** 2 for r in found}
    return np.asarray(sorted(range(SIZE), key=lambda d: (-spread.get(d, 0), d)))


def moved(rows: DataFrame, at: Centroids) -> Centroids:
    """Each centroid moved to the exact floored mean of the vectors nearest to it; those without any stay."""

    def sums(kept: Iterator[tuple[pa.Array, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        k = len(at.vectors)
        total = np.zeros((k, SIZE + 1), np.int64)
        for _, x in kept:
            near, _ = at.nearest(x)
            np.add.at(total, near, np.column_stack([x, np.ones(len(x), np.int64)]))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(k, dtype=np.int32), SIZE + 1)), pa.array(np.tile(np.arange(SIZE + 1, dtype=np.int32), k)), pa.array(total.ravel())], names=["cluster", "dim", "s"])

    got = _map(rows, sums, "cluster int, dim int, s long").groupBy("cluster", "dim").agg(F.sum(F.col("s").cast("decimal(28,0)")).alias("s")).collect()
    total = {(r["cluster"], r["dim"]): int(r["s"]) for r in got}
    new = at.vectors.copy()
    for c in range(len(new)):
        n = total.get((c, SIZE), 0)
        if n:
            new[c] = [total[c, d] // n for d in range(SIZE)]
    return Centroids(new, at.order)


def fit(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding", salt: str = "1") -> Centroids:
    small_batches(vectors.sparkSession)
    rows = _rows(vectors, id_col, vector_col)
    at = Centroids(first_centroids(rows, k, salt), by_variance(rows))
    for _ in range(rounds if len(at.vectors) else 0):
        at = moved(rows, at)
    return at


def assign(vectors: DataFrame, at: Centroids, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance) of every vector that takes part."""
    small_batches(vectors.sparkSession)

    def run(kept: Iterator[tuple[pa.Array, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for ids, x in kept:
            if len(at.vectors):
                near, distance = at.nearest(x)
                yield pa.RecordBatch.from_arrays([ids, pa.array(near.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return _map(_rows(vectors, id_col, vector_col), run, "vec_id long, cluster int, distance long")


def clustered(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding", salt: str = "1") -> DataFrame:
    """assign() by fitted centroids, with cluster_inertia, inertia and centroid_sha256 (sums beyond 64 bits are null)."""
    at = fit(vectors, k, rounds, id_col, vector_col, salt)
    near = assign(vectors, at, id_col, vector_col)
    sums = {r["cluster"]: int(r["s"]) for r in near.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(28,0)")).alias("s")).collect()}
    fits = lambda s: s if s < 1 << 63 else None
    known = [(c, fits(sums.get(c, 0)), fits(sum(sums.values())), h) for c, h in enumerate(at.hashes())]
    of = vectors.sparkSession.createDataFrame(known, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return near.join(F.broadcast(of), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(documents(spark, sf_dir, "embeddings"))


def sql() -> str:
    """The contract as DuckDB SQL, exhaustive search over all centroids in every round."""
    names = {0: "seeds"}
    steps = ["""
kept AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(CAST(x AS DOUBLE)))) = 64),
seeds AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c, v FROM kept QUALIFY c < 16)"""]

    def near(i: int) -> str:
        return f"""
far{i} AS (SELECT k.vec_id, k.v, s.c, list_sum(list_transform(list_zip(k.v, s.v), lambda p: CAST((p[1] - p[2]) * (p[1] - p[2]) AS BIGINT))) AS d FROM kept k, {names[i]} s),
near{i} AS (SELECT * FROM far{i} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1)"""

    for i in range(3):
        names[i + 1] = f"c{i + 1}"
        steps.append(near(i))
        steps.append(f"""
parts{i} AS (SELECT c, j, CAST(sum(v[j]) AS BIGINT) AS s, count(*) AS n FROM near{i}, range(1, 65) t(j) GROUP BY c, j),
c{i + 1} AS (SELECT o.c, coalesce(m.v, o.v) AS v FROM {names[i]} o LEFT JOIN (SELECT c, list(CASE WHEN s % n <> 0 AND s < 0 THEN s // n - 1 ELSE s // n END ORDER BY j) AS v FROM parts{i} GROUP BY c) m ON m.c = o.c)""")
    steps.append(near(3))
    return "WITH " + ",".join(steps) + """
SELECT n.vec_id, CAST(n.c AS INTEGER) AS cluster, CAST(n.d AS BIGINT) AS distance, CAST(sum(n.d) OVER (PARTITION BY n.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(n.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(f.v, ',')) AS centroid_sha256
FROM near3 n JOIN c3 f ON f.c = n.c
"""
