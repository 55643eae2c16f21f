"""A retrieval session: a corpus folder, its snapshots, hybrid search, grounded answers, deletions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bm25, chunking, context, corpus_diff, dense, fusion
from ..sources import providers
from ..sources.corpus import load_documents
from ..sources.snapshot import Identity, IndexSnapshot, Status, VectorSnapshot, index_without, without
from .workspace import Store, dense_ids, written

#: What a provider, a task of its or a vector of another width raises; anything else is a fault of ours and not hidden.
DENSE_ERRORS = (providers.ProviderError, PySparkException, Py4JJavaError, OSError, ValueError)
#: Ranges of chunk ids that a session leaves out before it builds anew.
MOST_GONE = 64


@dataclass
class Answer:
    """Both routes, what is shown, the prompts with their ledgers, answers, citation checks, and what went wrong."""

    bm25: DataFrame
    dense: DataFrame | None
    ranked: DataFrame
    prompts: DataFrame | None = None
    answers: DataFrame | None = None
    citations: DataFrame | None = None
    dense_error: str = ""


def doc_vectors(spark: SparkSession, docs: DataFrame, chunks: DataFrame, cache: DataFrame | None, factory: Callable[[], providers.Embedder], store: str | None = None) -> tuple[DataFrame, DataFrame]:
    """((path, content_hash, vectors), (n_reused, n_embedded)): vectors of documents whose path, hash and number of chunks are cached are reused, the others' chunks are embedded.

    With a store, what was embedded is kept there when a request fails for good; the failure is raised, and the next call asks for the rest alone.
    """
    counted = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"))
    live = docs.where(~F.col("deleted")).join(counted, "doc_id", "left").select("doc_id", "path", F.xxhash64(F.col("content").cast("binary")).alias("content_hash"), F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"))
    cache = cache if cache is not None else spark.createDataFrame([], "path string, content_hash long, vectors array<array<float>>")
    known = cache.withColumn("n_chunks", F.size("vectors").cast("long"))
    plan = written(corpus_diff.reuse_plan(live, known), "reuse")
    kept = plan.where("reuse").join(known, ["path", "content_hash", "n_chunks"]).select("path", "content_hash", "vectors")
    todo = chunks.join(plan.where("not reuse").select("doc_id", "path", "content_hash"), "doc_id")
    todo = todo.select("path", "content_hash", "chunk_id", "text")
    if store is None:
        fresh = providers.embed_texts(todo, factory)
    else:
        fresh = written(providers.embed_resumable(todo, factory, store), "fresh")
        failed = fresh.where("error is not null").select("error").first()
        if failed:
            raise providers.ProviderError(failed["error"])
    fresh = fresh.groupBy("path", "content_hash").agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk_id", "embedding"))), lambda x: x["embedding"]).alias("vectors"))
    return written(kept.unionByName(fresh), "vectors"), corpus_diff.reuse_counts(plan)


def flat_vectors(vectors: DataFrame) -> DataFrame:
    """(chunk_id, embedding) in order of path and place."""
    return dense_ids(vectors.select("path", F.posexplode("vectors").alias("pos", "embedding")), "chunk_id", "path", "pos").select("chunk_id", "embedding")


class RetrievalSession:
    """Opens a corpus, rebuilding only what its snapshots do not have; then answers batches of queries (qid, text)."""

    def __init__(self, spark: SparkSession, folder: str, cache: str, embedder: Callable[[], providers.Embedder] | None = None, generator: Callable[[], providers.Generator] | None = None):
        self.spark, self.folder, self.embedder, self.generator = spark, folder, embedder, generator
        self.cache = cache
        self.index_cache, self.vector_cache = IndexSnapshot(spark, f"{cache}/index"), VectorSnapshot(spark, f"{cache}/vectors")
        self.docs = load_documents(spark, folder)
        self.status = self.index_cache.validate(self.docs)
        self.inherited = 0
        loaded = self.index_cache.load_base() if self.status is Status.OK else None
        if loaded:
            self.docs, *self._base, self._gone = loaded
            self._apply()
        else:
            # tombstones follow paths, whatever made the snapshot unusable, as long as its documents can be read
            before = self.index_cache.documents()
            if before is not None:
                marked = written(corpus_diff.inherit_tombstones(before, self.docs), "documents")
                self.inherited = marked.where("inherited").count()
                self.docs = marked.drop("inherited")
            self.rebuild()
        self.vectors, self.dense_error, self.reused = None, "", None
        self._build_dense()

    def rebuild(self) -> None:
        chunks = written(chunking.chunk_documents(self.docs), "chunks")
        self._base, self._gone = [chunks, bm25.build_written_index(chunks)], []
        self._apply()
        self.saved = self.index_cache.save(self.docs, *self._base)

    def _apply(self) -> None:
        """Chunks and index as they would be without the chunks that are gone."""
        chunks, index = self._base
        self.chunks, self.index = without(chunks, self._gone), index_without(index, self._gone)

    def _build_dense(self) -> None:
        """Vectors for the dense route; any failure leaves the session with the lexical route."""
        self.vectors = None
        if self.embedder is None:
            return
        try:
            provider = self.embedder()
            identity = Identity(provider.model_id, provider.policy)
            self.vector_status, cached = self.vector_cache.load(identity)
            rows, counts = doc_vectors(self.spark, self.docs, self.chunks, cached, self.embedder, f"{self.cache}/embedded")
            self.reused = counts.first()
            self.vectors = flat_vectors(rows)
            if self.vector_cache.save(Identity(identity.model_id, identity.embedding_policy, dense.dimension(self.vectors)), rows):
                Store(self.spark, self.cache).delete("embedded")
        except DENSE_ERRORS as e:
            self.vectors, self.dense_error = None, str(e)

    def documents(self) -> DataFrame:
        return corpus_diff.doc_list(self.docs).orderBy("doc_id")

    def delete(self, doc_id: int) -> None:
        """Mark a document as deleted: its range of chunk ids is left out from now on, and nothing is built or written anew but the snapshot's small file. Vectors of the others are reused.

        After MOST_GONE deletions everything is built anew, so that expressions stay small.
        """
        if self.docs.where(F.col("doc_id") == doc_id).isEmpty():
            raise KeyError(doc_id)
        self.docs = corpus_diff.tombstone(self.docs, doc_id)
        r = self._base[0].where(F.col("doc_id") == doc_id).agg(F.min("chunk_id").alias("a"), F.max("chunk_id").alias("b")).first()
        own = [[r["a"], r["b"] + 1]] if r["a"] is not None else []
        self._gone = sorted([*self._gone, *(g for g in own if g not in self._gone)])
        if len(self._gone) > MOST_GONE:
            self.docs = written(self.docs, "documents")
            self.rebuild()
        else:
            self._apply()
            self.saved = self.index_cache.mark([doc_id], own)
        self._build_dense()

    def command(self, line: str) -> DataFrame | None:
        """A console's line: `list` gives the documents, `del <doc id>` deletes one and gives its line; None for anything else, which is a question.

        ValueError where the id is no number, KeyError where no document has it; a document deleted already stays as it is.
        """
        if line == "list":
            return self.documents()
        if not line.startswith("del "):
            return None
        number = line[4:]
        if not (number.isascii() and number.isdigit()):
            raise ValueError("usage: del <doc id>")
        own = corpus_diff.doc_list(self.docs.where(F.col("doc_id") == int(number)))
        if own.where("deleted").isEmpty():
            self.delete(int(number))
        return corpus_diff.doc_list(self.docs.where(F.col("doc_id") == int(number)))

    def search(self, queries: DataFrame, shown: int = fusion.SHOWN) -> Answer:
        lexical = bm25.search(self.index, queries, fusion.ROUTE_K)
        near, error = None, self.dense_error
        if self.vectors is not None:
            try:
                asked = written(providers.embed_queries(queries, self.embedder), "queries")
                near = dense.search_flat(self.vectors, asked, fusion.ROUTE_K)
            except DENSE_ERRORS as e:  # this batch is answered by the lexical route
                near, error = None, str(e)
        return Answer(lexical, near, fusion.hybrid(lexical, near, shown=shown), dense_error=error)

    def printed(self, answer: Answer) -> DataFrame:
        """(qid, rank, line) of the results shown."""
        return fusion.printed(answer.ranked, answer.bm25, answer.dense, self.chunks, self.docs)

    def sources(self, answer: Answer) -> DataFrame:
        """(qid, n, line): what the answers were grounded in."""
        return context.source_lines(answer.prompts)

    def ask(self, queries: DataFrame, budget: int = context.BUDGET_BYTES, answer_empty: bool = True, trim: bool = True) -> Answer:
        """Search, prompts, answers and citation checks; without a generator, retrieval alone.

        trim takes white space off the questions' ends; answer_empty says whether queries without a result are put to the generator.
        """
        if trim:
            queries = queries.withColumn("text", F.trim("text"))
        out = self.search(queries)
        out.ranked = written(out.ranked, "ranked")
        found = fusion.described(out.ranked, self.chunks, self.docs).select("qid", "rank", "chunk_id", F.col("path").alias("source"), "text")
        asked = queries if answer_empty else queries.join(found.select("qid").distinct(), "qid", "left_semi")
        out.prompts = context.build_prompts(asked, found, budget)
        if self.generator is not None:
            out.answers = written(providers.generate(out.prompts, self.generator), "answers")
            sized = out.answers.where("answer is not null").join(out.prompts.select("qid", F.size("used").alias("n_used")), "qid")
            out.citations = context.citations(sized)
        return out
