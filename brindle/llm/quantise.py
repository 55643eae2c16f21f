"""Approximate nearest neighbours by additive quantisation.

Codebooks of full-dimensional residual vectors are fitted to a bounded sample; every vector is
encoded by beam search as a sum of one codeword of each book, with its own norm and that of the sum
stored; queries score codes by lookup tables of inner products, and the best of each block are
reranked by exact double-precision inner products of the original vectors.

Defined results: vectors null, of another width than the most common of the rows, zero, or with null or
non-finite components take no part; fewer candidates than k give fewer rows; ties go to the smaller
id; repeated rows are candidates one by one, a repeated query id is one query (its least vector); an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, done_with, materialize, shuffle_parts, small_batches

#: Vectors that the codebooks are fitted to, at most; chosen by a hash of the id.
SAMPLE = 16384
BOOKS, WORDS, BEAM = 12, 256, 6
#: Candidates of a block of rows that are reranked for each query, rows and queries of a block, and queries scored at once.
SHORTLIST, ROW_BLOCK, QUERY_BLOCK, QUERY_LOT = 400, 8192, 8192, 64


def nearest_word(x: np.ndarray, c: np.ndarray, lot: int = 2048) -> np.ndarray:
    half = (c * c).sum(1) / 2
    return np.concatenate([(half - x[i : i + lot] @ c.T).argmin(1) for i in range(0, len(x), lot)])


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 10) -> np.ndarray:
    c = x[rng.permutation(len(x))[:k]].copy()
    if len(c) < k:
        c = np.vstack([c, np.zeros((k - len(c), x.shape[1]))])
    for _ in range(rounds):
        near = nearest_word(x, c)
        count = np.bincount(near, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], c)
    return c


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM, lot: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Codes (n x books) of the best sums that a beam search finds, and those sums; lot by lot, so the beams of few rows are held."""
    codes, sums = np.empty((len(x), len(books)), np.uint8), np.empty(x.shape)
    for i in range(0, len(x), lot):
        codes[i : i + lot], sums[i : i + lot] = _encode_lot(x[i : i + lot].astype(float), books, beam)
    return codes, sums


def _encode_lot(x: np.ndarray, books: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    n, d = x.shape
    rest = x[:, None, :].copy()
    codes = np.zeros((n, 1, 0), np.uint8)
    for book in books:
        cost = (rest * rest).sum(2)[:, :, None] - 2 * rest @ book.T + (book * book).sum(1)
        flat = cost.reshape(n, -1)
        keep = min(beam, flat.shape[1])
        best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
        best = np.take_along_axis(best, np.argsort(np.take_along_axis(flat, best, 1), axis=1, kind="stable"), 1)
        path, word = best // len(book), best % len(book)
        rows = np.arange(n)[:, None]
        rest = rest[rows, path] - book[word]
        codes = np.concatenate([codes[rows, path], word[:, :, None].astype(np.uint8)], 2)
    return codes[:, 0], x - rest[:, 0]


def fit_books(x: np.ndarray, books: int = BOOKS, words: int = WORDS, seed: int = 3, refine: int = 2) -> np.ndarray:
    """Residual codebooks, then refitted together: with the codes held, least squares gives the best codewords."""
    rng = np.random.default_rng(seed)
    rest, out = x.astype(float), []
    for _ in range(books):
        c = kmeans(rest, words, rng)
        out.append(c)
        rest = rest - c[nearest_word(rest, c)]
    found = np.asarray(out)
    for _ in range(refine):
        codes, _ = encode(x, found)
        for m in range(books):
            others = sum(found[j][codes[:, j]] for j in range(books) if j != m)
            total = np.zeros_like(found[m])
            np.add.at(total, codes[:, m], x - others)
            count = np.bincount(codes[:, m], minlength=words)
            found[m] = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], found[m])
    return found


def exact_dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products, summed left to right, so that equal vectors have equal scores wherever they stand."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j] * b[:, j]
    return out


def clean(vectors: DataFrame, id_col: str, vector_col: str, size: int | None = None) -> DataFrame:
    """(id, v array<double>) of the vectors that take part: those of the given size, or of the most common one."""
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    v = v.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    if size is None:
        common = v.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
        size = common["d"] if common else 0
    return v.where(F.size("v") == size)


def blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    ids, rows = [], []
    for b in batches:
        ids += b.column(0).to_pylist()
        rows += b.column(1).to_pylist()
        while len(ids) >= size:
            yield np.asarray(ids[:size], np.int64), np.asarray(rows[:size], float)
            ids, rows = ids[size:], rows[size:]
    if ids:
        yield np.asarray(ids, np.int64), np.asarray(rows, float)


def build_index(v: DataFrame, books: np.ndarray) -> DataFrame:
    """Blocks of ids, codes, norms, norms of the sums, and original vectors; each row of v is in one block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in blocks(batches, ROW_BLOCK):
            order = np.argsort(ids, kind="stable")
            ids, x = ids[order], x[order]
            codes, sums = encode(x, books)
            made = [ids, codes, np.sqrt((x * x).sum(1)), np.sqrt((sums * sums).sum(1)), x]
            yield pa.RecordBatch.from_arrays([pa.array([m.tobytes()], pa.binary()) for m in made], names=["ids", "codes", "norms", "sum_norms", "v"])

    return v.mapInArrow(run, "ids binary, codes binary, norms binary, sum_norms binary, v binary")


def search_block(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, codes: np.ndarray, norms: np.ndarray, sum_norms: np.ndarray, x: np.ndarray, books: np.ndarray, k: int, shortlist: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query ids, row ids, scores): each query's k best of the block."""
    scale = (norms / np.maximum(sum_norms, 1e-12)).astype(np.float32)
    out: list[tuple] = []
    for i in range(0, len(q), QUERY_LOT):
        tables = [(q[i : i + QUERY_LOT] @ book.T).astype(np.float32) for book in books]
        score = tables[0].take(codes[:, 0], axis=1)
        for m in range(1, len(books)):
            score += tables[m].take(codes[:, m], axis=1)
        score *= scale
        if score.shape[1] > shortlist:  # what ties with the last stays too
            row, col = np.nonzero(score >= np.partition(score, score.shape[1] - shortlist, axis=1)[:, [-shortlist]])
        else:
            row, col = np.divmod(np.arange(score.size), score.shape[1])
        own = q_ids[i + row] != ids[col]
        row, col = row[own], col[own]
        exact = exact_dots(q[i + row], x[col])
        order = np.lexsort((ids[col], -exact, row))
        row, col, exact = row[order], col[order], exact[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        row, col, exact = (a[place < k] for a in (row, col, exact))
        out.append((q_ids[i + row], ids[col], exact))
    return tuple(np.concatenate(a) for a in zip(*out))


def merged(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...], k: int) -> tuple[np.ndarray, ...]:
    """Each query's k best of two results."""
    q, v, s = (np.concatenate(x) for x in zip(a, b))
    order = np.lexsort((v, -s, q))
    q, v, s = q[order], v[order], s[order]
    keep = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[keep], v[keep], s[keep]


def nearest(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, shortlist: int = SHORTLIST, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of vectors to each row of queries, its own id left out.

    Queries and rows meet in blocks, so a task holds one block of each; nothing is collected but the sample. Each block of
    rows is moved once for every QUERY_BLOCK queries. Where the blocks of queries are few, the rows are dealt into lanes, and
    a block of queries meets each lane in a task of its own.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    v = clean(vectors, id_col, vector_col)
    first = v.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()  # all are of one size
    n = int(first[0])
    q = clean(queries, id_col, vector_col, first[1] or 0).groupBy("id").agg(F.min("v").alias("v"))
    result = "query_id long, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    part = v.where(F.pmod(F.xxhash64("id"), F.lit(1_000_003)) <= int(1_000_003 * min(1.0, sample / n)))
    got = part.select("id", "v").toPandas()  # bounded by `sample`
    got = got if len(got) else v.limit(1).select("id", "v").toPandas()
    fit = np.stack(got["v"].to_numpy()).astype(float)
    books = fit_books(fit[np.lexsort((*fit.T[:4], got["id"].to_numpy()))])
    width = books.shape[2]
    n_rows = max(1, -(-n // ROW_BLOCK))
    index = materialize(build_index(v.repartition(n_rows), books), "codes")

    q = materialize(q, "queries")
    n_blocks = max(1, -(-q.count() // QUERY_BLOCK))
    lanes = max(1, min(n_rows, -(-shuffle_parts(spark) // n_blocks)))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each block of queries; the stream is sorted by block."""
        at, ids, rows = None, [], []

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at]), pa.array([np.asarray(ids, np.int64).tobytes()], pa.binary()), pa.array([np.asarray(rows, float).tobytes()], pa.binary())], names=["block", "q_ids", "q"])

        for b in batches:
            for i, vec, block in zip(*(b.column(k).to_pylist() for k in range(3))):
                if block != at:
                    if ids:
                        yield row()
                    at, ids, rows = block, [], []
                ids.append(i)
                rows.append(vec)
        if ids:
            yield row()

    in_blocks = q.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("long")).repartition(n_blocks, "block").sortWithinPartitions("block", "id")
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    asked = materialize(in_blocks.mapInArrow(packed, "block long, q_ids binary, q binary"), "asked")
    spread = index.withColumn("lane", F.pmod(F.xxhash64("ids"), F.lit(lanes)).cast("long")).withColumn("block", each(n_blocks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, best = None, None  # a block of queries and its best so far
        for b in batches:
            for q_ids, qv, ids, codes, norms, sums, x in zip(*(b.column(i).to_pylist() for i in range(7))):
                a = [np.frombuffer(y, float) for y in (qv, norms, sums, x)]
                found = search_block(np.frombuffer(q_ids, np.int64), a[0].reshape(-1, width), np.frombuffer(ids, np.int64), np.frombuffer(codes, np.uint8).reshape(-1, len(books)), a[1], a[2], a[3].reshape(-1, width), books, k, shortlist)
                if last is not None and last != q_ids:
                    yield pa.RecordBatch.from_arrays([pa.array(y) for y in best], names=["query_id", "vec_id", "score"])
                    best = None
                last, best = q_ids, merged(best, found, k) if best is not None else found
        if best is not None:
            yield pa.RecordBatch.from_arrays([pa.array(y) for y in best], names=["query_id", "vec_id", "score"])

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")  # rows are whole blocks here
    met = asked.withColumn("lane", each(lanes)).join(spread, ["block", "lane"]).select("q_ids", "q", "ids", "codes", "norms", "sum_norms", "v").mapInArrow(run, result)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = materialize(met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "nearest")
    small_batches(spark)
    done_with(index, q, asked)
    return found


def op3_additive_quantisation(spark, sf_dir: str) -> DataFrame:
    v = documents(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(v, v.where("vec_id % 20 = 0"))
