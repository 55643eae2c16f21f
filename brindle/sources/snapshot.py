"""Snapshots of an index and of vectors: Parquet tables in a version folder, and one small file that names it.

A snapshot is written to a new folder and takes effect when CURRENT is replaced, so a failed write
never harms the one before. Checks run in a fixed order, and the first that fails gives the status.

Every file has a print of its rows, a table's print is a hash over its files', and CURRENT holds the tables'. Opening
compares those and the files' sizes and reads no table but that of the files; in depth, on request, the rows are read again.

Deletions change CURRENT alone: it names the documents, and the ranges of chunk ids that are gone. Ids beyond them
move up, as if all had been built anew.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import asdict, dataclass
from enum import Enum

from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.scalars import restore
from ..operators.bm25 import Index, corpus_stats
from ..operators.chunking import CHUNK_ATOMS, OVERLAP_ATOMS
from ..operators.corpus_diff import manifest, manifest_changes
from ..plans.workspace import Store

MAGIC, VECTOR_MAGIC = "brindle-index", "brindle-vectors"
FORMAT, PIPELINE = 2, 1
POINTER = "CURRENT"


class Status(Enum):
    OK = "ok"
    NOT_FOUND = "no snapshot yet"
    IO_ERROR = "the snapshot cannot be read"
    BAD_MAGIC = "not a snapshot of this engine"
    BAD_FORMAT = "damaged, or of another format"
    BAD_PIPELINE = "made by another pipeline version"
    BAD_PARAMS = "made with other chunk parameters"
    CORPUS_CHANGED = "the corpus has changed"
    BAD_MODEL = "made by another embedding model"


@dataclass(frozen=True)
class Identity:
    """The coordinate system of vectors; dimension 0 is not compared."""

    model_id: str
    embedding_policy: str
    dimension: int = 0


def file_prints(table: DataFrame, name: str) -> DataFrame:
    """(table, file, bytes, rows, print) of a table read from Parquet: the print is a sum of the rows' hashes, in which no rows cancel."""
    columns = sorted(table.columns)
    rows = table.select(*columns, "_metadata.file_name", "_metadata.file_size")
    hashed = F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).cast("string")
    return rows.groupBy(F.col("file_name").alias("file"), F.col("file_size").alias("bytes")).agg(F.count(F.lit(1)).alias("rows"), hashed.alias("print")).select(F.lit(name).alias("table"), "file", "bytes", "rows", "print")


_FILES = "table string, file string, bytes long, rows long, print string"


def without(df: DataFrame, gone: list[list[int]]) -> DataFrame:
    """df without the rows whose chunk_id lies in one of the ranges [begin, end), and all others' ids moved up to be dense again."""
    if not gone:
        return df
    c = F.col("chunk_id")
    inside = reduce(lambda x, y: x | y, [(c >= a) & (c < b) for a, b in gone])
    before = reduce(lambda x, y: x + y, [F.when(c >= b, b - a).otherwise(0) for a, b in gone])
    return df.where(~inside).withColumn("chunk_id", (c - before).cast(dict(df.dtypes)["chunk_id"])).select(*df.columns)


def index_without(index: Index, gone: list[list[int]]) -> Index:
    if not gone:
        return index
    postings, lengths = without(index.postings, gone), without(index.lengths, gone)
    return Index(postings, lengths, postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")), corpus_stats(lengths))


class _Snapshot:
    def __init__(self, spark: SparkSession, root: str, magic: str):
        self.spark, self.root, self.magic, self.store = spark, root.rstrip("/"), magic, Store(spark, root)

    def _save(self, tables: dict[str, DataFrame], facts: dict) -> bool:
        """Write all or nothing; False if anything fails. The version before is removed."""
        try:
            version = f"v-{uuid.uuid4().hex}"
            for name, df in tables.items():
                df.write.parquet(f"{self.root}/{version}/{name}")
            made = [file_prints(self.spark.read.schema(df.schema).parquet(f"{self.root}/{version}/{name}"), name) for name, df in tables.items()]
            reduce(DataFrame.unionByName, made).coalesce(1).write.parquet(f"{self.root}/{version}/files")  # a row for each file
            prints = self._table_prints(self._files(version), list(tables))
            before = json.loads(self.store.read(POINTER)).get("version") if self.store.exists(POINTER) else None
            meta = {"magic": self.magic, "format": FORMAT, "pipeline": PIPELINE, "version": version, "prints": prints, "schemas": {name: df.schema.json() for name, df in tables.items()}, **facts}
            self.store.replace(POINTER, json.dumps(meta, sort_keys=True).encode())
            if before:
                self.store.delete(before)
            return True
        except (PySparkException, Py4JJavaError, OSError):  # a lost cache, not a failure
            return False

    def _files(self, version: str) -> list[tuple]:
        return sorted(map(tuple, self.spark.read.schema(_FILES).parquet(f"{self.root}/{version}/files").collect()))

    @staticmethod
    def _table_prints(files: list[tuple], names: list[str]) -> dict[str, list]:
        """By table, its rows and a hash over its files."""
        out = {}
        for name in names:
            own = [f[1:] for f in files if f[0] == name]
            out[name] = [sum(f[2] for f in own), hashlib.sha256(repr(own).encode()).hexdigest()]
        return out

    def table(self, meta: dict, name: str) -> DataFrame:
        """One of the tables; its schema is in the small file, so no other file is opened for it."""
        return self.spark.read.schema(StructType.fromJson(json.loads(meta["schemas"][name]))).parquet(f"{self.root}/{meta['version']}/{name}")

    def _meta(self) -> tuple[Status, dict]:
        if not self.store.exists(POINTER):
            return Status.NOT_FOUND, {}
        try:
            raw = self.store.read(POINTER)
        except (Py4JJavaError, OSError):
            return Status.IO_ERROR, {}
        try:
            meta = json.loads(raw)
        except ValueError:
            return Status.BAD_MAGIC, {}
        if not isinstance(meta, dict) or meta.get("magic") != self.magic:
            return Status.BAD_MAGIC, {}
        return Status.OK, meta

    def _whole(self, meta: dict, deep: bool = False) -> bool:
        """Whether the format is known and every file is as it was written: in name and size, or, where deep, row by row."""
        if meta.get("format") != FORMAT or not isinstance(meta.get("prints"), dict) or set(meta.get("schemas", ())) != set(meta["prints"]):
            return False
        try:
            files = self._files(meta["version"])
            if self._table_prints(files, list(meta["prints"])) != meta["prints"]:
                return False
            there = {tuple(path.rsplit("/", 2)[1:]): size for path, size in self.store.files(meta["version"])}
            if any(there.get(f[:2]) != f[2] for f in files):
                return False
            if not deep:
                return True
            again = [file_prints(self.table(meta, name), name) for name in meta["prints"]]
            return sorted(map(tuple, reduce(DataFrame.unionByName, again).collect())) == files
        except (PySparkException, Py4JJavaError, OSError):  # what cannot be read is not whole
            return False


class IndexSnapshot(_Snapshot):
    def __init__(self, spark: SparkSession, root: str):
        super().__init__(spark, root, MAGIC)

    def save(self, docs: DataFrame, chunks: DataFrame, index: Index, size: int = CHUNK_ATOMS, overlap: int = OVERLAP_ATOMS) -> bool:
        """Documents with tombstones, chunks without their text, postings, lengths and manifest; what follows from them is left out."""
        tables = {
            "documents": docs.select("doc_id", "path", "content", "deleted"),
            "chunks": chunks.select("chunk_id", "doc_id", "begin", "end"),
            "postings": index.postings.repartitionByRange("term", "chunk_id").sortWithinPartitions("term", "chunk_id"),
            "lengths": index.lengths,
            "manifest": manifest(docs),
        }
        return self._save(tables, {"chunk": [size, overlap]})

    def validate(self, docs: DataFrame, size: int = CHUNK_ATOMS, overlap: int = OVERLAP_ATOMS, deep: bool = False) -> Status:
        status, meta = self._meta()
        if status is not Status.OK:
            return status
        if not self._whole(meta, deep):
            return Status.BAD_FORMAT
        if meta.get("pipeline") != PIPELINE:
            return Status.BAD_PIPELINE
        if meta.get("chunk") != [size, overlap]:
            return Status.BAD_PARAMS
        if manifest_changes(self.table(meta, "manifest"), manifest(docs)).first()["n_changed"]:
            return Status.CORPUS_CHANGED
        return Status.OK

    def load_base(self, size: int = CHUNK_ATOMS, overlap: int = OVERLAP_ATOMS, deep: bool = False) -> tuple[DataFrame, DataFrame, Index, list[list[int]]] | None:
        """(documents, chunks with text, index, ranges of chunk ids that are gone) as written, or None if the header does not hold, or, where deep, the rows or references."""
        status, meta = self._meta()
        if status is not Status.OK or meta.get("pipeline") != PIPELINE or meta.get("chunk") != [size, overlap] or not self._whole(meta, deep):
            return None
        docs, chunks, postings, lengths = (self.table(meta, n) for n in ("documents", "chunks", "postings", "lengths"))
        placed = chunks.join(docs.select("doc_id", "content"), "doc_id", "left")
        if deep:
            bad = F.col("content").isNull() | (F.col("begin") < 0) | (F.col("begin") > F.col("end")) | (F.col("end") > F.octet_length("content"))
            if not placed.where(bad).isEmpty() or not postings.join(chunks, "chunk_id", "left_anti").isEmpty() or lengths.count() != chunks.count():
                return None
        text = restore(F.decode("content", "UTF-8"), F.col("begin"), F.col("end"))
        if dict(docs.dtypes)["content"] == "binary":
            text = F.decode(F.substring("content", F.col("begin") + 1, F.col("end") - F.col("begin")), "UTF-8")
        terms = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        return self._marked(docs, meta), placed.select("chunk_id", "doc_id", "begin", "end", text.alias("text")), Index(postings, lengths, terms, corpus_stats(lengths)), meta.get("gone", [])

    def load(self, size: int = CHUNK_ATOMS, overlap: int = OVERLAP_ATOMS, deep: bool = False) -> tuple[DataFrame, DataFrame, Index] | None:
        """(documents, chunks with text, index) without what is gone."""
        base = self.load_base(size, overlap, deep)
        if base is None:
            return None
        docs, chunks, index, gone = base
        return docs, without(chunks, gone), index_without(index, gone)

    @staticmethod
    def _marked(docs: DataFrame, meta: dict) -> DataFrame:
        ids = meta.get("deleted", [])
        return docs.withColumn("deleted", F.col("deleted") | F.col("doc_id").isin(ids)) if ids else docs

    def mark(self, deleted: list[int], gone: list[list[int]]) -> bool:
        """Name documents that are deleted and their ranges of chunk ids, besides those named already: one small file is written. False if there is no snapshot or it cannot be."""
        status, meta = self._meta()
        if status is not Status.OK:
            return False
        change = {"deleted": sorted({*meta.get("deleted", []), *deleted}), "gone": sorted(map(list, {*map(tuple, meta.get("gone", [])), *map(tuple, gone)}))}
        try:
            self.store.replace(POINTER, json.dumps(meta | change, sort_keys=True).encode())
            return True
        except (Py4JJavaError, OSError):
            return False

    def documents(self) -> DataFrame | None:
        """The documents of the snapshot, tombstones and all, whatever the corpus is now."""
        status, meta = self._meta()
        return self._marked(self.table(meta, "documents"), meta) if status is Status.OK and self._whole(meta) else None


class VectorSnapshot(_Snapshot):
    """doc_vectors: (path, content_hash, vectors array<array<float>>), one row a document."""

    def __init__(self, spark: SparkSession, root: str):
        super().__init__(spark, root, VECTOR_MAGIC)

    def save(self, identity: Identity, doc_vectors: DataFrame) -> bool:
        rows = doc_vectors.select("path", "content_hash", "vectors")
        try:
            r = rows.select(F.explode("vectors").alias("v")).agg(F.min(F.size("v")).alias("a"), F.max(F.size("v")).alias("b")).first()
        except (PySparkException, Py4JJavaError, OSError):
            return False
        return self._save({"doc_vectors": rows.repartitionByRange("path").sortWithinPartitions("path")}, {"identity": asdict(identity), "widths": [r["a"], r["b"]]})

    def load(self, expected: Identity) -> tuple[Status, DataFrame | None]:
        status, meta = self._meta()
        if status is not Status.OK:
            return status, None
        if not self._whole(meta) or meta.get("pipeline") != PIPELINE:  # another version is another format here
            return Status.BAD_FORMAT, None
        own, rows = meta.get("identity") or {}, self.table(meta, "doc_vectors")
        if set(own) != {"model_id", "embedding_policy", "dimension"} or any(w not in (None, own["dimension"]) for w in meta.get("widths", [-1])):
            return Status.BAD_FORMAT, None
        same = own["model_id"] == expected.model_id and own["embedding_policy"] == expected.embedding_policy and expected.dimension in (0, own["dimension"])
        return (Status.OK, rows) if same else (Status.BAD_MODEL, None)
