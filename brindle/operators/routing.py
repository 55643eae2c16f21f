"""Cells around centroids: exact search that skips what cannot matter, and graphs of which a question meets few.

Centroids are fitted on the driver to a bounded sample; every vector belongs to the cell of its nearest one.

Exact search: rows are packed into blocks of one cell, near ones first, each with its radius, the largest distance from the
centroid. By Cauchy-Schwarz no row of a block scores more than q.c + |q| * radius. The SEEDS best blocks of a
question give its k-th score at least; only blocks whose bound reaches it are met. Whatever the vectors look like, the
result is that of a scan; how much is skipped depends on them: vectors without any clusters save nothing.

Routed graphs: a cell is a shard with a graph of its own, or several where it is large; a question goes to the cells
of the nearest centroids, found in a graph of the centroids, and each shard's questions are dealt into lots.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.workspace import small_batches, written
from .bm25 import top_k
from .dense import QUERY_BLOCK, ROW_BLOCK, _scored, dimension
from .hnsw import EF_BUILD, EF_SEARCH, SHARD, M, Graph, ask_graphs, build_graphs

#: Vectors that centroids are fitted to, about, and rounds of fitting; cells at most.
SAMPLE, ROUNDS, MOST_CELLS = 16_384, 8, 1024
#: Blocks that a question meets first; block heads that are sent to all tasks, beyond which cells have one radius.
SEEDS, SENT_HEADS = 2, 1 << 20
#: Questions of a shard that one task answers.
QUERY_LOT = 256


def centroids(vectors: DataFrame, n: int) -> np.ndarray:
    """n centroids (fewer where there are fewer vectors) of vectors (chunk_id, embedding); the same rows give the same ones."""
    total = vectors.count()
    kept = F.pmod(F.xxhash64("chunk_id"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, SAMPLE / max(total, 1))) + 1
    rows = sorted((r["chunk_id"], r["embedding"]) for r in vectors.where(kept).select("chunk_id", "embedding").collect())
    x = np.asarray([v for _, v in rows], float) if rows else np.zeros((0, 0))
    n = min(n, MOST_CELLS, len(x))
    c = x[np.random.default_rng(0).permutation(len(x))[:n]].copy()
    for _ in range(ROUNDS if n else 0):
        near = nearest(x, c)
        count = np.bincount(near, minlength=n)
        total_ = np.zeros_like(c)
        np.add.at(total_, near, x)
        c = np.where(count[:, None] > 0, total_ / np.maximum(count, 1)[:, None], c)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = (c * c).sum(1) / 2
    return np.concatenate([(x[i : i + 2048] @ c.T - half).argmax(1) for i in range(0, len(x), 2048)]) if len(x) else np.zeros(0, np.int64)


def matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.to_pylist(), float)


def in_cells(vectors: DataFrame, c: np.ndarray, key: str = "chunk_id") -> DataFrame:
    """(key, embedding array<double>, cell, radius): each vector's nearest centroid and its distance from it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = matrix(b.column(1))
                cell = nearest(x, c)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(np.sqrt(((x - c[cell]) ** 2).sum(1)))], names=[key, "embedding", "cell", "radius"])

    return vectors.select(F.col(key).cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(run, f"{key} long, embedding array<double>, cell int, radius double")


# -- exact search


@dataclass
class Heads:
    """Numbers, cells and radii of blocks, or of whole cells where there are too many blocks: what goes to every task."""

    centroids: np.ndarray
    number: np.ndarray
    cell: np.ndarray
    radius: np.ndarray

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """For each query and head, what no row of it exceeds."""
        norm = np.sqrt((q * q).sum(1))[:, None]
        bound = (q @ self.centroids.T)[:, self.cell] + norm * self.radius
        return (bound + 1e-9 * (1 + np.abs(bound))).astype(np.float32)


@dataclass
class Blocks:
    """rows (head, ids, x), each with at most ROW_BLOCK vectors of one cell."""

    rows: DataFrame
    heads: Heads


def packed(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Blocks of rows (id, embedding, cell, radius) that come sorted by cell and radius."""
    held: list[tuple[np.ndarray, ...]] = []

    def cut(part: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        ids, x, cell, radius = part
        return pa.RecordBatch.from_arrays([pa.array([int(cell[0])], pa.int32()), pa.array([float(radius.max())]), pa.array([ids.tobytes()], pa.binary()), pa.array([np.ascontiguousarray(x).tobytes()], pa.binary())], names=["cell", "radius", "ids", "x"])

    for b in batches:
        if not b.num_rows:
            continue
        held.append((b.column(0).to_numpy(), matrix(b.column(1)), b.column(2).to_numpy(), b.column(3).to_numpy()))
        part = tuple(np.concatenate(p) for p in zip(*held))
        at, n = 0, len(part[0])
        while at < n:
            end = min(at + size, int(np.searchsorted(part[2], part[2][at], "right")))
            if end == n and n - at < size:
                break  # the cell may go on
            yield cut(tuple(p[at:end] for p in part))
            at = end
        held = [tuple(p[at:] for p in part)] if at < n else []
    if held:
        yield cut(held[0])


def in_blocks(vectors: DataFrame, cells: int = 64, size: int = ROW_BLOCK) -> Blocks:
    """The vectors (chunk_id, embedding) in blocks, written once. A large cell is cut by distance, so it lies in several parts."""
    dimension(vectors)
    c = centroids(vectors, cells)
    dealt = in_cells(vectors, c).repartitionByRange("cell", "radius").sortWithinPartitions("cell", "radius")
    rows = dealt.mapInArrow(lambda it: packed(it, size), "cell int, radius double, ids binary, x binary")
    rows = written(rows.withColumn("block", F.monotonically_increasing_id()), "blocks")
    heads = rows.select("block", "cell", "radius")
    by_cell = heads.count() > SENT_HEADS
    if by_cell:
        heads = heads.groupBy("cell").agg(F.max("radius").alias("radius")).withColumn("block", F.col("cell").cast("long"))
    found = sorted((r["block"], r["cell"], r["radius"]) for r in heads.collect())
    number, cell, radius = (np.asarray(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    head = F.col("cell").cast("long") if by_cell else F.col("block")
    return Blocks(rows.select(head.alias("head"), "ids", "x"), Heads(c, number, cell, radius))


def meetings(heads: Heads, asked: DataFrame, seeds: int | None) -> DataFrame:
    """(qids, q, head): blocks of queries (qids, q, needed) and the heads that one of them must meet; with seeds, only each query's first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for qids, q, needed in zip(*(b.column(i).to_pylist() for i in range(3))):
                bound = heads.bounds(np.frombuffer(q).reshape(len(qids) // 8, -1))
                if seeds is not None:
                    first = np.argpartition(-bound, min(seeds, bound.shape[1]) - 1, axis=1)[:, :seeds]
                    wanted = np.unique(first)
                else:
                    wanted = np.flatnonzero((bound >= np.frombuffer(needed, np.float32)[:, None]).any(0))
                for i in range(0, len(wanted), 64):
                    part = heads.number[wanted[i : i + 64]]
                    yield pa.RecordBatch.from_arrays([pa.array([qids] * len(part), pa.binary()), pa.array([q] * len(part), pa.binary()), pa.array(part, pa.int64())], names=["qids", "q", "head"])

    return asked.select("qids", "q", "needed").mapInArrow(run, "qids binary, q binary, head long")


def search_bounded(index: Blocks, queries: DataFrame, k: int) -> DataFrame:
    """(qid, rank, chunk_id, score) for queries (qid, embedding): as search_flat over the same vectors."""
    spark, schema = queries.sparkSession, "qid long, chunk_id long, score float"
    small_batches(spark)
    heads, rows = index.heads, index.rows
    if k <= 0 or not len(heads.number):
        return top_k(spark.createDataFrame([], schema), k)
    width, asked = heads.centroids.shape[1], dimension(queries.select("embedding"))
    if not asked:
        return top_k(spark.createDataFrame([], schema), k)
    if width != asked:
        raise ValueError(f"queries have {asked} dimensions, the index {width}")

    def met(asked_in: DataFrame, seeds: int | None) -> DataFrame:
        # Spark takes the meetings for no larger than the questions, though each repeats its block of them for every head: never broadcast
        pairs = meetings(heads, asked_in, seeds).repartition("head")
        return pairs.join(rows.hint("merge"), "head").select("qids", "q", "ids", "x").mapInArrow(lambda it: _scored(it, width, k), schema)

    # queries of one cell are near each other and need about the same blocks
    near = written(in_cells(queries, heads.centroids, "qid").repartitionByRange("cell", "radius").sortWithinPartitions("cell", "radius"), "queries")

    def grouped(rows_: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(0, b.num_rows, QUERY_BLOCK):
                    part = b.slice(i, QUERY_BLOCK)
                    cols = [part.column(0).to_numpy().tobytes(), matrix(part.column(1)).tobytes(), part.column(2).to_numpy(zero_copy_only=False).astype(np.float32).tobytes()]
                    yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in cols], names=["qids", "q", "needed"])

        return rows_.mapInArrow(run, "qids binary, q binary, needed binary")

    none = F.lit(float("-inf")).cast("float")
    first = met(grouped(near.select("qid", "embedding", none.alias("needed"))), SEEDS)
    kth = top_k(first, k).where(F.col("rank") == k).select("qid", F.col("score").alias("needed"))
    known = near.join(kth, "qid", "left").select("qid", "embedding", F.coalesce("needed", none).alias("needed"), "cell", "radius")
    asked_in = written(grouped(known.repartitionByRange("cell", "radius").sortWithinPartitions("cell", "radius").select("qid", "embedding", "needed")), "asked")
    return top_k(met(asked_in, None), k)


# -- routed graphs


@dataclass
class Routed:
    """graphs (shard, cell, part, graph), in pieces, and the graph of the centroids, whose ids are the cells."""

    graphs: DataFrame
    centroids: np.ndarray
    coarse: Graph


def build_routed(vectors: DataFrame, cells: int | None = None, seed: int = 0, m: int = M, ef: int = EF_BUILD, shard: int = SHARD) -> Routed:
    """One graph a cell of vectors (chunk_id, embedding), or several where a cell has more than shard vectors, dealt by a hash; all of a cell's are searched."""
    dimension(vectors)
    c = centroids(vectors, cells or max(1, -(-vectors.count() // shard)))
    coarse = Graph(np.arange(len(c)), c, m, ef, seed)
    placed = written(in_cells(vectors, c), "cells")
    sizes = sorted((r["cell"], -(-r["count"] // shard)) for r in placed.groupBy("cell").count().collect())
    first = np.cumsum([0, *(n for _, n in sizes)]).tolist()
    numbers = F.broadcast(placed.sparkSession.createDataFrame([(cell, f, n) for (cell, n), f in zip(sizes, first)], "cell int, first int, parts int"))  # a row for each cell
    number = (F.col("first") + F.pmod(F.xxhash64("chunk_id"), F.col("parts"))).cast("int")
    dealt = placed.join(numbers, "cell").select(number.alias("shard"), "chunk_id", "embedding")
    graphs = build_graphs(dealt, first[-1], seed, m, ef)
    of = numbers.select("cell", F.explode(F.sequence("first", F.col("first") + F.col("parts") - 1)).alias("shard"))
    return Routed(written(graphs.join(F.broadcast(of), "shard").select("shard", "cell", "part", "graph"), "graphs"), c, coarse)


def routes(index: Routed, queries: DataFrame, probes: int) -> DataFrame:
    """(qid, embedding, cell): each query with its nearest cells."""
    coarse = index.coarse

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, c) for i, q in enumerate(matrix(b.column(1)) if b.num_rows else []) for c, _ in coarse.search(q, probes, max(EF_SEARCH, 2 * probes))]
            at = pa.array([i for i, _ in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array([c for _, c in rows], pa.int32())], names=["qid", "embedding", "cell"])

    return queries.select(F.col("qid").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(run, "qid long, embedding array<double>, cell int")


def search_routed(index: Routed, queries: DataFrame, k: int, probes: int, ef: int | None = None) -> DataFrame:
    """(qid, rank, chunk_id, score) for queries (qid, embedding): each meets the graphs of its nearest cells alone."""
    if k <= 0 or not len(index.centroids):
        return top_k(queries.sparkSession.createDataFrame([], "qid long, chunk_id long, score float"), k)
    width, asked = index.centroids.shape[1], dimension(queries.select("embedding"))
    if asked not in (0, width):
        raise ValueError(f"a query has {asked} dimensions, the index {width}")
    sent = written(routes(index, queries, probes).join(F.broadcast(index.graphs.select("shard", "cell").distinct()), "cell"), "routes")
    lots = sorted((r["shard"], -(-r["count"] // QUERY_LOT)) for r in sent.groupBy("shard").count().collect())
    return top_k(ask_graphs(index.graphs, sent, lots, k, ef), k)
