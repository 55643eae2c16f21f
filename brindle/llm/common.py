"""Plumbing shared by the training-data operators: work folder, batches, word and shingle hashes."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch handed to Python: texts can be long, so the bytes bound a worker's memory.
BATCH_ROWS, BATCH_BYTES = "8192", "4m"

U64 = np.uint64
_WORD = np.zeros(256, dtype=bool)
_WORD[128:] = True
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    _WORD[_a:_b] = True
_BASE = U64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = U64(pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64))
_SHINGLE = [U64(x | 1) for x in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def small_batches(spark: SparkSession) -> None:
    """Plans run from now on hand Python at most BATCH_ROWS rows and about BATCH_BYTES at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def workspace(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: spark.checkpoint.dir, or one of our own where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="brindle-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: later reads recompute nothing and survive lost executors."""
    spark = df.sparkSession
    path = f"{workspace(spark)}/brindle/{uuid.uuid4().hex}/{label}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def bucketed(df: DataFrame, key: str, dealt: bool = False) -> Iterator[DataFrame]:
    """df written once, dealt by key: joins on the key move the other side alone. The table goes when the block ends.

    dealt: df comes from an aggregation or join on the key and so lies in such parts already.
    """
    spark = df.sparkSession
    n, name = shuffle_parts(spark), f"brindle_{uuid.uuid4().hex}"
    path = f"{workspace(spark)}/brindle/{name}"
    (df if dealt else df.repartition(n, key)).write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(n, key).saveAsTable(name)
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        discard(spark, path)


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete folders of intermediate tables that nothing reads any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        there = jvm.org.apache.hadoop.fs.Path(p)
        there.getFileSystem(conf).delete(there, True)


def done_with(*tables: DataFrame) -> None:
    """Delete what materialize wrote for these tables."""
    for t in tables:
        files = t.inputFiles()
        if files:
            discard(t.sparkSession, files[0].rsplit("/", 2)[0])


def released(run):
    """run, giving memory back to the system when a task's stream ends: idle workers stay, and share the executor with what comes next."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return wrapped


def has_rows(df: DataFrame) -> bool:
    return not df.isEmpty()


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the splitmix64 finalizer)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x = x * U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE ** i and its inverse for i < n, modulo 2 ** 64."""
    if len(_powers[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        for k, base in enumerate((_BASE, _BASE_INV)):
            steps = np.full(size, base, U64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def chunks(texts: list[str | None], size: int = 1 << 19) -> Iterator[tuple[int, list[bytes]]]:
    """Lower-cased UTF-8 texts in runs of about size bytes, each run with the place of its first text."""
    run: list[bytes] = []
    first, total = 0, 0
    for i, t in enumerate(texts):
        b = (t or "").lower().encode("utf-8", "replace")
        if run and total + len(b) > size:
            yield first, run
            run, first, total = [], i, 0
        run.append(b)
        total += len(b) + 1
    if run:
        yield first, run


def segment_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of codes[s:e] for each s, e: prefix sums of a polynomial, moved to the origin, scrambled."""
    pw, inv = powers(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, U64)
    np.cumsum((codes.astype(U64) + U64(1)) * pw[: len(codes)], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * inv[starts] + (ends - starts).astype(U64) * U64(0x2545F4914F6CDD1D))


def word_hashes(run: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, one after another, and where each text's words begin (one more at the end).

    A word is a maximal run of ASCII letters and digits and of bytes beyond ASCII.
    """
    raw = np.frombuffer(b"\n".join(run) + b"\n", np.uint8)
    inside = _WORD[raw].view(np.int8)
    edge = np.diff(inside, prepend=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    bounds = np.concatenate([[0], np.cumsum([len(b) + 1 for b in run])])
    return segment_hashes(raw, starts, ends), np.searchsorted(starts, bounds)


def shingle_hashes(words: np.ndarray, width: int = 5) -> np.ndarray:
    """Hashes of the runs of width words; a text of fewer words has its one run of all of them, an empty one none."""
    n = len(words)
    if n == 0:
        return words
    if n < width:
        return mix64(np.asarray([sum(int(w) * int(m) for w, m in zip(words, _SHINGLE)) + n & (1 << 64) - 1], U64))
    acc = words[: n - width + 1] * _SHINGLE[0]
    for j in range(1, width):
        acc = acc + words[j : n - width + 1 + j] * _SHINGLE[j % 5]
    return mix64(acc + U64(width))


def doc_shingles(texts: list[str | None], width: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """(place, shingle hashes in order, repeats kept) of each text."""
    for first, run in chunks(texts):
        words, at = word_hashes(run)
        for i in range(len(run)):
            yield first + i, shingle_hashes(words[at[i] : at[i + 1]], width)


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shielded(docs: DataFrame) -> tuple[DataFrame, dict[str, str], list]:
    """docs under names that clash with nothing, those names by the old ones, and the columns that bring the old ones back."""
    own = {c: f"_in{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*own.values()), own, [F.col(n).alias(c) for c, n in own.items()]


def id_crc(column: str) -> "F.Column":
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))
