"""Lempel-Ziv phrase fingerprints.

A text is parsed into dictionary phrases, each the longest known phrase and one more character. The
set of phrases is hashed, and of each of a family of hash functions the least value is kept. Two
fingerprints agree in about the part of phrases that the texts share, as a compressor would find.

Defined results: a null text is empty; an empty text has no phrase, and its fingerprint agrees with
that of another empty text alone; equal texts have equal fingerprints; documents follow one another
by id (null first), then text; one document alone is its own next; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, segment_hashes, shuffle_parts, small_batches

HASHES = 64
_MULTIPLY = np.random.default_rng(11).integers(0, 1 << 31, HASHES).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = np.random.default_rng(12).integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)
_EMPTY = np.full(HASHES, 0xFFFFFFFF, np.uint32)


def parse(text: str, known: set[str], ends: list[int], at: int, open_at: int) -> int:
    """Parse text[at:] on, from a phrase that began at open_at; adds to known and ends. Returns where the open phrase began."""
    for i in range(at + 1, len(text) + 1):
        phrase = text[open_at:i]
        if phrase not in known:
            known.add(phrase)
            ends.append(i)
            open_at = i
    return open_at


def phrase_ends(text: str) -> list[int]:
    """Where the phrases of the text end; the last may repeat one."""
    ends: list[int] = []
    if parse(text, set(), ends, 0, 0) < len(text):
        ends.append(len(text))
    return ends


def phrase_hashes(text: str, ends: list[int]) -> np.ndarray:
    """32-bit hashes of the phrases."""
    found = np.empty(len(ends), np.uint32)
    at = np.asarray([0, *ends])
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    for i in range(0, len(ends), 1 << 16):
        cut = at[i : i + (1 << 16) + 1]
        part = codes[cut[0] : cut[-1]]
        found[i : i + len(cut) - 1] = (segment_hashes(part, cut[:-1] - cut[0], cut[1:] - cut[0]) >> np.uint64(32)).astype(np.uint32)
    return found


def least(hashes: np.ndarray, so_far: np.ndarray = _EMPTY) -> np.ndarray:
    out = so_far
    for i in range(0, len(hashes), 4096):
        h = hashes[i : i + 4096, None] * _MULTIPLY
        h ^= h >> np.uint32(15)
        h += _ADD
        h *= np.uint32(2246822519)
        out = np.minimum(out, h.min(0))
    return out


def text_form(signature: np.ndarray) -> str:
    return signature.astype(">u4").tobytes().hex()


def fingerprint(text: str | None) -> np.ndarray:
    return least(phrase_hashes(text or "", phrase_ends(text or "")))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def both_fingerprints(text: str, edited: str, same: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of two texts that agree in their first `same` characters, which are parsed once."""
    known: set[str] = set()
    ends: list[int] = []
    open_at = parse(text[:same], known, ends, 0, 0)
    shared = least(phrase_hashes(text, ends))
    out = []
    for t in (text, edited):
        more: list[int] = []
        own = len(known)
        last = parse(t, known, more, same, open_at)
        cut = [ends[-1] if ends else 0, *more]
        if last < len(t):
            more.append(len(t))
        tail = t[cut[0] :]
        out.append(least(phrase_hashes(tail, [e - cut[0] for e in more]), shared))
        if len(known) > own:
            known.difference_update([t[a:b] for a, b in zip(cut, cut[1:])])
    return out[0], out[1]


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(part, own, id, text), each part sorted by id, and after its rows, with own false, the first row of the next part.

    Ids are dealt into ranges, a task each, and the texts are moved once; only one row a range goes to the driver.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.col("id"), F.lit(-(1 << 63)))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("key", key)
    n = max(2, shuffle_parts(spark))
    cuts = rows.agg(F.percentile_approx("key", [i / n for i in range(1, n)], 10000)).first()[0]
    cuts = sorted({int(c) for c in cuts or [0]})
    rows = rows.withColumn("part", F.size(F.filter(F.lit(cuts).cast("array<long>"), lambda c: c <= F.col("key"))))
    firsts = sorted((r["part"], r["key"]) for r in rows.groupBy("part").agg(F.min("key").alias("key")).collect())
    sent = spark.createDataFrame([(part, first, firsts[i - 1][0]) for i, (part, first) in enumerate(firsts)], "part int, key long, before int")
    own = F.struct(F.col("part").alias("part"), F.lit(0).alias("lap"))
    to = F.array_compact(F.array(own, F.when(F.col("before").isNotNull(), F.struct(F.col("before").alias("part"), F.lit(1).alias("lap")))))
    dealt = rows.join(F.broadcast(sent), ["part", "key"], "left").withColumn("to", F.explode(to))
    dealt = dealt.select("to.part", "to.lap", "key", "id", "text").repartitionById(n, F.col("part")).sortWithinPartitions("part", "lap", "key", "text")
    return dealt.select("part", (F.col("lap") == 0).alias("own"), "id", "text")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edit: int = 4) -> DataFrame:
    """Fingerprints of each text, and of the text with its last 1/edit replaced by the next document's beginning."""
    small_batches(docs.sparkSession)
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def made(doc: int | None, text: str, after: str) -> tuple:
        same = len(text) - len(text) // edit
        edited = text[:same] + after[: len(text) - same]
        a, e = both_fingerprints(text, edited, same)
        return doc, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), a, e

    def told(row: tuple, after: np.ndarray) -> tuple:
        *first, a, e = row
        return *first, text_form(a), text_form(e), likeness(a, e), likeness(a, after)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, waits, ready = None, None, None  # the row that waits for its next, and the row before, which waits for its fingerprint
        for b in batches:
            rows: list[tuple] = []
            for to, own, doc, text in zip(*(b.column(i).to_pylist() for i in range(4))):
                if to != part:
                    part, waits, ready = to, None, None
                elif waits is None:
                    continue  # rows after the first that belongs to the next part
                if waits is not None:
                    row = made(*waits, text)
                    if ready is not None:
                        rows.append(told(ready, row[3]))
                    ready = row
                waits = (doc, text) if own else None
                if not own and ready is not None:
                    rows.append(told(ready, fingerprint(text)))
                    ready = None
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs, id_col, text_col).mapInArrow(run, schema)


def op8_lz_fingerprint(spark, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir))
