"""Exact dense search and checks of vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import dot
from ..plans.workspace import small_batches, written
from .bm25 import top_k

#: Queries of a block, and rows of a block.
QUERY_BLOCK, ROW_BLOCK = 512, 2048
#: Queries that a block of rows meets in one row: the rows are repeated once for so many.
MET_QUERIES = 4096


def dimension(vectors: DataFrame) -> int:
    """The one dimension of the vectors (chunk_id, embedding); 0 if there are none; raises if they differ."""
    r = vectors.agg(F.min(F.size("embedding")).alias("lo"), F.max(F.size("embedding")).alias("hi")).first()
    if r["lo"] != r["hi"]:
        raise ValueError(f"vectors have {r['lo']} to {r['hi']} dimensions")
    return r["lo"] or 0


def build_flat(vectors: DataFrame) -> DataFrame:
    """The vectors as given, once they are known to have one dimension."""
    dimension(vectors)
    return vectors.select("chunk_id", "embedding")


def search_one(vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    """(rank, chunk_id, score) of the k largest inner products with one query: a literal, and a top-k without a sort of all rows."""
    empty = vectors.sparkSession.createDataFrame([], f"rank int, chunk_id {dict(vectors.dtypes)['chunk_id']}, score float")
    if k <= 0:
        return empty
    width = dimension(vectors)
    if not width:
        return empty
    if width != len(query):
        raise ValueError(f"the query has {len(query)} dimensions, the index {width}")
    scored = vectors.select("chunk_id", dot(F.col("embedding"), F.lit([float(x) for x in query])).alias("score"))
    best = scored.orderBy(F.desc("score"), "chunk_id").limit(k)
    return best.select(F.array_sort(F.array(F.struct((-F.col("score")).alias("s"), "chunk_id", "score")))[0].alias("r")).select(F.lit(0).alias("qid"), "r.chunk_id", "r.score").transform(lambda d: top_k(d, k)).drop("qid")


def search_flat(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(qid, rank, chunk_id, score) for queries (qid, embedding): rows and queries meet in blocks, and each meeting keeps k of each query.

    Products are summed in double precision, left to right, and compared as floats, ties to the smaller id.
    """
    spark = vectors.sparkSession
    schema = "qid long, chunk_id long, score float"
    if k <= 0:
        return top_k(spark.createDataFrame([], schema), 0)
    width, asked = dimension(vectors), dimension(queries.select(F.col("embedding")))
    if not width or not asked:
        return top_k(spark.createDataFrame([], schema), k)
    if width != asked:
        raise ValueError(f"queries have {asked} dimensions, the index {width}")

    def packed(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, size):
                part = b.slice(i, size)
                x = np.asarray(part.column(1).to_pylist(), float)
                yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_numpy().tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], names=["ids", "x"])

    def blocks(df: DataFrame, key: str, size: int) -> DataFrame:
        return df.select(F.col(key).cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(lambda it: packed(it, size), "ids binary, x binary")

    small_batches(spark)
    # every block of rows meets every block of queries; what goes to the driver is a number for each block of queries
    asked_in = written(blocks(queries, "qid", MET_QUERIES).withColumn("block", F.monotonically_increasing_id()).withColumnsRenamed({"ids": "qids", "x": "q"}), "queries")
    numbers = [F.lit(r["block"]) for r in asked_in.select("block").collect()]
    met = blocks(vectors, "chunk_id", ROW_BLOCK).withColumn("block", F.explode(F.array(*numbers))).join(asked_in, "block")
    return top_k(met.select("qids", "q", "ids", "x").mapInArrow(lambda it: _scored(it, width, k), schema), k)


def _sums(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Products of rows that stand side by side, or of all with all where they have an axis more: in double precision, left to right, as floats."""
    s = np.zeros(np.broadcast_shapes(q.shape[:-1], x.shape[:-1]))
    for j in range(q.shape[-1]):
        s += q[..., j] * x[..., j]
    return s.astype(np.float32)


def _scored(batches: Iterator[pa.RecordBatch], width: int, k: int) -> Iterator[pa.RecordBatch]:
    """The k best rows of each block for each query, and what ties with them."""
    for b in batches:
        for qids, q, ids, x in zip(*(b.column(i).to_pylist() for i in range(4))):
            ids, x = np.frombuffer(ids, np.int64), np.frombuffer(x).reshape(-1, width)
            all_qids, all_q = np.frombuffer(qids, np.int64), np.frombuffer(q).reshape(-1, width)
            for i in range(0, len(all_q), QUERY_BLOCK):
                yield _best(all_qids[i : i + QUERY_BLOCK], all_q[i : i + QUERY_BLOCK], ids, x, k)


def _best(qids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> pa.RecordBatch:
    if len(x) > k:
        with np.errstate(all="ignore"):
            # one product tells what cannot be among the k best: its sums differ from those left to right by less than the slack
            s = q @ x.T
            kth = np.partition(s, len(x) - k, axis=1)[:, len(x) - k]
            slack = 2.0**-21 * np.abs(kth) + 1e-12 * np.sqrt((q * q).sum(1)) * np.sqrt((x * x).sum(1).max()) + 1e-44
        if np.isfinite(s).all() and np.isfinite(slack).all():
            row, col = np.nonzero(s >= (kth - slack)[:, None])
            score = _sums(q[row], x[col])
        else:
            s = _sums(q[:, None, :], x[None, :, :])
            row, col = np.nonzero(s >= np.partition(s, len(x) - k, axis=1)[:, [len(x) - k]])
            score = s[row, col]
    else:
        row, col = np.divmod(np.arange(len(q) * len(x)), max(len(x), 1))
        score = _sums(q[:, None, :], x[None, :, :]).ravel()
    order = np.lexsort((ids[col], -score, row))
    row, col, score = row[order], col[order], score[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return pa.RecordBatch.from_arrays([pa.array(qids[row[keep]]), pa.array(ids[col[keep]]), pa.array(score[keep])], names=["qid", "chunk_id", "score"])
