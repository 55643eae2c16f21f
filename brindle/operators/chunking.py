"""Overlapping chunks of documents, cut at atoms, with byte offsets."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lexical import byte_atoms, portions
from ..plans.workspace import first_ids, small_batches, written

CHUNK_ATOMS, OVERLAP_ATOMS = 500, 50


def chunk_pieces(docs: DataFrame, size: int = CHUNK_ATOMS, overlap: int = OVERLAP_ATOMS) -> DataFrame:
    """(doc_id, k, begin, end, text): the k-th chunk of each live document; docs: (doc_id, content, deleted).

    A document's offsets come from one pass over its bytes; nothing is shuffled.
    """
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be less than the chunk size")
    step = size - overlap
    live = docs.where(~F.col("deleted")) if "deleted" in docs.columns else docs

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in portions(b, 1):
                rows = []
                for doc, raw in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist()):
                    raw = raw or b""
                    begins, ends = byte_atoms(raw)
                    n = len(begins)
                    for k in range(max(1, -(-(n - overlap) // step)) if n else 0):
                        lo, hi = int(begins[k * step]), int(ends[min(k * step + size, n) - 1])
                        rows.append((doc, k, lo, hi, raw[lo:hi].decode("utf-8", "replace")))
                cols = list(zip(*rows)) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string()))], names=["doc_id", "k", "begin", "end", "text"])

    small_batches(docs.sparkSession)
    return live.select(F.col("doc_id").cast("long"), "content").mapInArrow(cut, "doc_id long, k int, begin long, end long, text string")


def chunk_documents(docs: DataFrame, size: int = CHUNK_ATOMS, overlap: int = OVERLAP_ATOMS) -> DataFrame:
    """(chunk_id, doc_id, begin, end, text), ids dense in order of document and place.

    Texts are cut and written once, and never sorted: documents are numbered by their chunk counts, and texts stream past a hash table
    of those, of which a task has its share.
    """
    pieces = written(chunk_pieces(docs, size, overlap), "pieces")
    counts = pieces.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    numbered = pieces.join(first_ids(counts, "first", "n", "doc_id").drop("n").hint("shuffle_hash"), "doc_id")
    return numbered.select((F.col("first") + F.col("k")).alias("chunk_id"), "doc_id", "begin", "end", "text")
