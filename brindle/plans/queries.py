"""Queries over the driver's tables, each with the SQL that gives the same rows.

documents stand for a corpus (path = source/id), embeddings for chunk vectors, benchmark for
questions, conversations for a record log.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..functions.lexical import ATOM, HAN, RUN, WORD, atom_count, atoms, tokens
from ..operators import bm25, chunking, context, corpus_diff, dense, evaluate, fusion, hnsw, logquery, routing
from ..sources import corpus as corpus_io
from ..sources import providers
from ..sources.segments import SegmentedIndex
from ..sources.snapshot import Identity, IndexSnapshot, VectorSnapshot
from .session import doc_vectors, flat_vectors
from .workspace import Store, folder, written

QUESTION = "The hewh of thaner, the"
TERMS = ["the", "hewh", "of", "thaner", "the"]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def path() -> F.Column:
    return F.concat(F.coalesce("source", F.lit("")), F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 8, "0"))


def corpus(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", path().alias("path"), F.col("text").alias("content"), F.lit(False).alias("deleted"))


def texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("chunk_id"), "text")


def question(spark: SparkSession, text: str = QUESTION) -> DataFrame:
    return spark.range(1).select(F.col("id").alias("qid"), F.lit(text).alias("text"))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", "label")


def asked(spark: SparkSession, d: str, step: int = 20) -> DataFrame:
    return vectors(spark, d).where(F.col("chunk_id") % step == 0).select(F.col("chunk_id").alias("qid"), "embedding")


def shown(ranked: DataFrame, *more: str) -> DataFrame:
    return ranked.withColumn("score", F.round(F.col("score").cast("double"), 4)).select("qid", "rank", "chunk_id", "score", *more)


# -- SQL parts ---------------------------------------------------------------------------------

_H = HAN.replace("㐀", r"\x{3400}").replace("䶿", r"\x{4DBF}").replace("一", r"\x{4E00}").replace("鿿", r"\x{9FFF}")
S_RUN, S_ATOM = f"{WORD}|{_H}+", f"{WORD}|{_H}"
S_PATH = "coalesce(source, '') || '/' || lpad(CAST(doc_id AS VARCHAR), 8, '0')"


def s_tokens(source: str, key: str, column: str = "text") -> str:
    """A table of (key, t): the tokens of a column."""
    return f"""SELECT {key}, flatten(list_transform(regexp_extract_all({column}, '{S_RUN}'), lambda x:
      CASE WHEN regexp_matches(x, '{_H}') THEN list_transform(range(1, length(x)), lambda i: substring(x, i, 2)) ELSE [lower(x)] END)) AS t
      FROM {source} WHERE {column} IS NOT NULL"""


S_INDEX = f"""tok AS ({s_tokens('documents', 'doc_id')}),
len AS (SELECT doc_id, len(t) AS dl FROM tok),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM len),
post AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM tok) GROUP BY doc_id, term),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term)"""
S_WEIGHT = "ln(1e0 + (n - df + 0.5e0) / (df + 0.5e0)) * tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * dl / avgdl))"
S_TERMS = "q(qid, pos, term) AS (VALUES " + ", ".join(f"(0, {i}, '{t}')" for i, t in enumerate(TERMS)) + ")"


def s_ranked(scores: str, k: int) -> str:
    """The k best of each query of (qid, chunk_id, score)."""
    return f"SELECT qid, rank, chunk_id, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM ({scores})) WHERE rank <= {k}"


S_BM25 = f"SELECT qid, doc_id AS chunk_id, CAST(sum(w ORDER BY pos) AS FLOAT) AS score FROM (SELECT qid, doc_id, pos, {S_WEIGHT} AS w FROM q JOIN post USING (term) JOIN df USING (term) JOIN len USING (doc_id), st) GROUP BY qid, doc_id"
S_DOT = "CAST(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE))) AS FLOAT)"


def s_flat(where: str, k: int) -> str:
    return s_ranked(f"SELECT a.vec_id AS qid, b.vec_id AS chunk_id, {S_DOT} AS score FROM embeddings a, embeddings b WHERE {where}", k)


def s_rrf(*lists: str) -> str:
    """Fused and ranked lists of (rank, chunk_id)."""
    both = " UNION ALL ".join(f"SELECT {i} AS l, chunk_id, min(rank) AS rank FROM {x} GROUP BY chunk_id" for i, x in enumerate(lists))
    return s_ranked(f"SELECT 0 AS qid, chunk_id, CAST(sum(1e0 / (60 + rank) ORDER BY l) AS FLOAT) AS score FROM ({both}) GROUP BY chunk_id", 1 << 30)


S_ROUTES = f"{S_TERMS}, {S_INDEX}, lex AS ({s_ranked(S_BM25, 20)}), vec AS ({s_flat('a.vec_id = 0', 20)})"
S_SHOWN = "SELECT qid, rank, chunk_id, round(CAST(score AS DOUBLE), 4) AS score"
S_CHUNKS = f"""a AS (SELECT doc_id, regexp_extract_all(text, '{S_ATOM}') AS ats, regexp_split_to_array(text, '{S_ATOM}') AS gp FROM documents WHERE text IS NOT NULL),
x AS (SELECT doc_id, unnest(range(1, len(ats) + 1)) AS i, unnest(ats) AS tok, unnest(gp[1:len(ats)]) AS gap FROM a),
y AS (SELECT doc_id, i, tok, strlen(tok) AS tl, sum(strlen(tok) + strlen(gap)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM x),
m AS (SELECT doc_id, count(*) AS n FROM y GROUP BY doc_id),
k AS (SELECT doc_id, n, unnest(range(0, greatest(1, CAST(ceil((n - 50) / 450e0) AS BIGINT)))) AS k FROM m),
c AS (SELECT row_number() OVER (ORDER BY k.doc_id, k.k) - 1 AS chunk_id, k.doc_id, k.k * 450 + 1 AS i0, least(k.k * 450 + 500, n) AS i1 FROM k),
ch AS (SELECT c.chunk_id, c.doc_id, s.e - s.tl AS "begin", t.e AS "end", i0, i1 FROM c JOIN y s ON s.doc_id = c.doc_id AND s.i = i0 JOIN y t ON t.doc_id = c.doc_id AND t.i = i1)"""
S_OLD = f"o AS (SELECT {S_PATH} AS path, text AS content, doc_id % 7 = 0 AS deleted FROM documents)"
S_NEW = f"""w AS (SELECT {S_PATH} AS path, CASE WHEN doc_id % 10 = 1 THEN text || ' x' ELSE text END AS content, false AS deleted FROM documents WHERE doc_id % 10 <> 0
  UNION ALL SELECT 'new/' || {S_PATH}, text, false FROM documents WHERE doc_id % 10 = 2)"""
S_DIFF = f"""WITH {S_OLD}, {S_NEW}, dif AS (SELECT coalesce(o.path, w.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN w.path IS NULL THEN 'removed' WHEN o.content IS DISTINCT FROM w.content THEN 'edited' END AS change
  FROM o FULL OUTER JOIN w ON o.path = w.path)"""
S_BLOCK = "'[' || n || ']' || chr(10) || 'Source: ' || source || chr(10) || '<<<BEGIN MATERIAL>>>' || chr(10) || text || chr(10) || '<<<END MATERIAL>>>'"
S_KEPT = f"""WITH m AS (SELECT source AS qid, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n, doc_id AS chunk_id, {S_PATH} AS source, text FROM documents WHERE text IS NOT NULL),
b AS (SELECT *, {S_BLOCK} AS block FROM m),
u AS (SELECT *, sum(strlen(block)) OVER (PARTITION BY qid ORDER BY n) AS used_bytes FROM b),
kept AS (SELECT * FROM u WHERE n = 1 OR used_bytes <= 16384)"""
S_ANSWERS = "SELECT doc_id AS qid, 'See [' || (doc_id % 12) || '] and [' || (doc_id % 5 + 1) || '], not [x] or [123456] but [' || (doc_id % 3) || '].' AS answer, CAST(doc_id % 8 AS INTEGER) AS n_used FROM documents"
S_CITED = f"WITH an AS ({S_ANSWERS}), ci AS (SELECT qid, n_used, unnest(regexp_extract_all(answer, '\\[([0-9]{{1,5}})\\]', 1)) AS s, unnest(range(0, len(regexp_extract_all(answer, '\\[([0-9]{{1,5}})\\]', 1)))) AS pos FROM an), cv AS (SELECT qid, pos, CAST(s AS INTEGER) AS n, CAST(s AS INTEGER) BETWEEN 1 AND n_used AS valid FROM ci)"
S_HALF = S_DOT.replace("list_zip(a.embedding, b.embedding)", "list_zip(a.embedding[1:32], b.embedding[1:32])")
S_FIRST = f"""f AS ({s_flat('a.vec_id % 20 = 0', 11)}), h AS ({s_flat('a.vec_id % 20 = 0', 11).replace(S_DOT, S_HALF)}),
jf AS (SELECT f.qid, min(CASE WHEN a.label = b.label AND f.qid <> f.chunk_id THEN rank END) AS rank FROM f JOIN embeddings a ON a.vec_id = f.qid JOIN embeddings b ON b.vec_id = f.chunk_id GROUP BY f.qid),
jh AS (SELECT h.qid, min(CASE WHEN a.label = b.label AND h.qid <> h.chunk_id THEN rank END) AS rank FROM h JOIN embeddings a ON a.vec_id = h.qid JOIN embeddings b ON b.vec_id = h.chunk_id GROUP BY h.qid)"""
S_LOG = "lg AS (SELECT conv_id * 1000 + turn AS line_no, TIMESTAMP '2024-01-01 00:00:00' + conv_id * INTERVAL 1 HOUR AS w, role AS speaker, text FROM conversations)"
S_FILTER = f"WITH {S_LOG}, ft AS (SELECT line_no, speaker, w FROM lg WHERE speaker IN ('assistant', 'user') AND w >= TIMESTAMP '2024-01-02 00:00:00' AND w <= TIMESTAMP '2024-02-01 12:30:00' AND contains(lower(text), 'the') AND contains(lower(text), 'on'))"
S_REUSE = f"""WITH dd AS (SELECT {S_PATH} AS path, md5(coalesce(text, '')) AS content_hash, 1 + doc_id % 4 AS n_chunks, doc_id FROM documents),
ca AS (SELECT path, CASE WHEN doc_id % 9 = 1 THEN 'stale' ELSE content_hash END AS content_hash, CASE WHEN doc_id % 9 = 2 THEN n_chunks + 1 ELSE n_chunks END AS n_chunks FROM dd WHERE doc_id % 9 <> 0),
pl AS (SELECT dd.path, dd.n_chunks, ca.path IS NOT NULL AS reuse FROM dd LEFT JOIN ca ON dd.path = ca.path AND dd.content_hash = ca.content_hash AND dd.n_chunks = ca.n_chunks)"""

# -- Spark ---------------------------------------------------------------------------------------

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        REGISTRY[f.__name__] = (f, sql)
        return f

    return register


@query(f"WITH tok AS ({s_tokens('documents', 'doc_id')}) SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(t, ' ')) AS digest FROM tok")
def tokenize(spark, d):
    own = texts(spark, d).select("chunk_id", tokens(F.col("text")).alias("t"))
    return own.select(F.col("chunk_id").alias("doc_id"), F.size("t").alias("n_tokens"), F.md5(F.array_join("t", " ").cast("binary")).alias("digest"))


@query(f"SELECT doc_id, len(regexp_extract_all(text, '{S_ATOM}')) AS n_atoms FROM documents WHERE text IS NOT NULL")
def atoms_per_document(spark, d):
    return texts(spark, d).select(F.col("chunk_id").alias("doc_id"), atom_count(F.col("text")).alias("n_atoms"))


@query(f"WITH {S_INDEX} SELECT term, doc_id, tf FROM post")
def term_freq(spark, d):
    return bm25.build_index(texts(spark, d)).postings.select("term", F.col("chunk_id").alias("doc_id"), "tf")


@query(f"WITH {S_INDEX} SELECT term, df FROM df")
def doc_freq(spark, d):
    return bm25.build_index(texts(spark, d)).terms


@query(f"WITH {S_INDEX} SELECT n, round(avgdl, 6) AS avgdl FROM st")
def corpus_stats(spark, d):
    return bm25.build_index(texts(spark, d)).stats.select("n", F.round("avgdl", 6).alias("avgdl"))


@query(f"WITH {S_TERMS}, {S_INDEX}, r AS ({s_ranked(S_BM25, 10)}) {S_SHOWN} FROM r")
def bm25_top10(spark, d):
    return shown(bm25.search_texts(texts(spark, d), question(spark)))


@query(f"WITH bt AS ({s_tokens('benchmark', 'item_id')}), q AS (SELECT item_id AS qid, unnest(range(0, len(t))) AS pos, unnest(t) AS term FROM bt), {S_INDEX}, r AS ({s_ranked(S_BM25, 10)}) {S_SHOWN} FROM r")
def bm25_batch(spark, d):
    asked_ = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), "text")
    return shown(bm25.search(bm25.build_written_index(texts(spark, d)), asked_))


@query(f'WITH {S_CHUNKS} SELECT chunk_id, doc_id, "begin", "end" FROM ch')
def chunks(spark, d):
    return chunking.chunk_documents(corpus(spark, d)).select("chunk_id", "doc_id", "begin", "end")


@query(f"WITH {S_CHUNKS} SELECT chunk_id, i1 - i0 + 1 AS dl FROM ch")
def chunk_lengths(spark, d):
    return bm25.build_index(chunking.chunk_documents(corpus(spark, d))).lengths


@query(f"WITH {S_CHUNKS} SELECT doc_id, count(*) AS n_chunks, min(chunk_id) AS first_chunk, max(chunk_id) AS last_chunk FROM ch GROUP BY doc_id")
def chunks_by_document(spark, d):
    return chunking.chunk_documents(corpus(spark, d)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.min("chunk_id").alias("first_chunk"), F.max("chunk_id").alias("last_chunk"))


@query(f"""WITH {S_CHUNKS}, g AS (SELECT doc_id, i, tok, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY i) AS before, e - tl AS at FROM y),
z AS (SELECT ch.chunk_id, string_agg(CASE WHEN g.i = ch.i0 THEN g.tok ELSE x.gap || g.tok END, '' ORDER BY g.i) AS t FROM ch JOIN g ON g.doc_id = ch.doc_id AND g.i BETWEEN i0 AND i1 JOIN x ON x.doc_id = g.doc_id AND x.i = g.i GROUP BY ch.chunk_id)
SELECT chunk_id, md5(t) AS restored, md5(t) AS own FROM z""")
def text_restore(spark, d):
    made = chunking.chunk_documents(corpus(spark, d)).join(corpus(spark, d).select("doc_id", "content"), "doc_id")
    digest = lambda c: F.md5(c.cast("binary"))
    return made.select("chunk_id", digest(scalars.restore(F.col("content"), F.col("begin"), F.col("end"))).alias("restored"), digest(F.col("text")).alias("own"))


S_CHUNK_INDEX = f"""{S_CHUNKS}, len AS (SELECT chunk_id AS doc_id, i1 - i0 + 1 AS dl FROM ch), st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM len),
post AS (SELECT ch.chunk_id AS doc_id, lower(y.tok) AS term, count(*) AS tf FROM ch JOIN y ON y.doc_id = ch.doc_id AND y.i BETWEEN i0 AND i1 GROUP BY ch.chunk_id, lower(y.tok)), df AS (SELECT term, count(*) AS df FROM post GROUP BY term)"""


@query(f"WITH {S_TERMS}, {S_CHUNK_INDEX}, r AS ({s_ranked(S_BM25, 10)}) {S_SHOWN} FROM r")
def bm25_chunks(spark, d):
    return shown(bm25.search_texts(chunking.chunk_documents(corpus(spark, d)), question(spark)))


@query(f"WITH r AS ({s_flat('a.vec_id = 0', 10)}) SELECT rank, chunk_id, round(CAST(score AS DOUBLE), 4) AS score FROM r")
def flat_top10(spark, d):
    q = [float(x) for x in vectors(spark, d).where("chunk_id = 0").first()["embedding"]]
    return dense.search_one(vectors(spark, d), q, 10).select("rank", "chunk_id", F.round(F.col("score").cast("double"), 4).alias("score"))


@query(f"WITH r AS ({s_flat('a.vec_id % 20 = 0', 5)}) {S_SHOWN} FROM r")
def flat_batch_topk(spark, d):
    return shown(dense.search_flat(vectors(spark, d), asked(spark, d), 5))


@query(f"WITH r AS ({s_flat('a.vec_id % 20 = 0', 5)}) {S_SHOWN} FROM r")
def flat_bounded_topk(spark, d):
    """The same from blocks with bounds, which skip what cannot matter."""
    return shown(routing.search_bounded(routing.in_blocks(vectors(spark, d).select("chunk_id", "embedding")), asked(spark, d), 5))


def gathered(spark: SparkSession, d: str) -> DataFrame:
    """The vectors drawn to the first of their label, as those of texts on a few subjects are; the table's own have no clusters."""
    own = vectors(spark, d)
    first = own.groupBy("label").agg(F.min_by("embedding", "chunk_id").alias("first"))
    return own.join(first, "label").select("chunk_id", F.zip_with("embedding", "first", lambda x, y: (x.cast("double") * 0.35 + y.cast("double")).cast("float")).alias("embedding"))


@query("SELECT vec_id AS qid, 10 AS n, 2 AS n_cells, true AS good, true AS all_good FROM embeddings WHERE vec_id % 20 = 0")
def hnsw_routed_gate(spark, d):
    """Graphs of 8 cells, of which each question meets a quarter: at least 7 of 10 exact results each, and 95 % of all."""
    own = written(gathered(spark, d), "gathered")
    q = own.where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("qid"), "embedding")
    index = routing.build_routed(own, 8)
    near = written(routing.search_routed(index, q, 10, probes=2), "near")
    hits = dense.search_flat(own, q, 10).join(near.select("qid", "chunk_id", F.lit(1).alias("hit")), ["qid", "chunk_id"], "left").groupBy("qid").agg(F.count("hit").alias("hits"))
    met = routing.routes(index, q, 2).groupBy("qid").agg(F.countDistinct("cell").cast("int").alias("n_cells"))
    made = written(near.groupBy("qid").agg(F.count(F.lit(1)).cast("int").alias("n")).join(hits, "qid").join(met, "qid"), "judged")
    mean = made.agg((F.avg("hits") >= 9.5).alias("all_good"))
    return made.crossJoin(F.broadcast(mean)).select("qid", "n", "n_cells", (F.col("hits") >= 7).alias("good"), "all_good")


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 5) AS norm FROM embeddings")
def vector_norms(spark, d):
    return vectors(spark, d).select(F.col("chunk_id").alias("vec_id"), F.round(scalars.norm(F.col("embedding")), 5).alias("norm"))


@query("WITH v AS (SELECT vec_id, embedding AS e, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS n FROM embeddings) SELECT vec_id, i, round(CAST(CAST(CAST(e[i + 1] AS DOUBLE) / n AS FLOAT) AS DOUBLE), 4) AS x FROM (SELECT vec_id, e, n, unnest(range(0, len(e))) AS i FROM v)")
def unit_vectors(spark, d):
    made = vectors(spark, d).select(F.col("chunk_id").alias("vec_id"), F.posexplode(scalars.unit(F.col("embedding"))).alias("i", "x"))
    return made.select("vec_id", F.col("i").cast("long").alias("i"), F.round(F.col("x").cast("double"), 4).alias("x"))


@query("SELECT max(len(embedding)) AS width, 1 AS mixed_raises FROM embeddings")
def dim_check(spark, d):
    own = vectors(spark, d)
    try:
        dense.dimension(own.withColumn("embedding", F.slice("embedding", 1, F.when(F.col("chunk_id") % 2 == 0, 3).otherwise(4))))
        raised = 0
    except ValueError:
        raised = 1
    return spark.range(1).select(F.lit(dense.dimension(dense.build_flat(own))).cast("long").alias("width"), F.lit(raised).alias("mixed_raises"))


@query("SELECT row_number() OVER (ORDER BY CAST(label AS VARCHAR), vec_id) - 1 AS chunk_id, vec_id FROM embeddings")
def flatten_vectors(spark, d):
    # the id rides along as the vector, so that the order can be seen
    rows = vectors(spark, d).groupBy(F.col("label").cast("string").alias("path")).agg(F.transform(F.array_sort(F.collect_list("chunk_id")), lambda x: F.array(x)).alias("vectors"))
    return flat_vectors(rows).select("chunk_id", F.col("embedding")[0].alias("vec_id"))


def served(spark: SparkSession, d: str) -> SegmentedIndex:
    """The saved index of the texts: written by the first question, and read by all later ones as long as the table's files are the same."""
    files = sorted(Store(spark, f"{d}/documents.parquet").files())
    index = SegmentedIndex(spark, f"{folder(spark)}/brindle/served/{hashlib.sha256(repr(files).encode()).hexdigest()}")
    if not index.segments():
        index.add(texts(spark, d))
    return index


@query(f"WITH {S_TERMS}, {S_INDEX}, r AS ({s_ranked(S_BM25, 10)}) {S_SHOWN} FROM r")
def served_top10(spark, d):
    """One question to a saved index."""
    return shown(served(spark, d).search(question(spark)))


@query(f"WITH bt AS ({s_tokens('benchmark', 'item_id')}), q AS (SELECT item_id AS qid, unnest(range(0, len(t))) AS pos, unnest(t) AS term FROM bt), {S_INDEX}, r AS ({s_ranked(S_BM25, 10)}) {S_SHOWN} FROM r")
def served_batch(spark, d):
    """Many questions to a saved index."""
    return shown(served(spark, d).search(table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), "text")))


S_EDITED = "documents AS (SELECT doc_id, CASE WHEN doc_id % 11 = 1 THEN text || ' hewh thaner' ELSE text END AS text FROM main.documents WHERE doc_id % 7 <> 0)"


@query(f"WITH {S_TERMS}, {S_EDITED}, {S_INDEX}, r AS ({s_ranked(S_BM25, 10)}) {S_SHOWN} FROM r")
def segments_edited_top10(spark, d):
    """A question after a deletion vector, an edit in a segment of its own and a merge of what is due: the scores of a full rebuild."""
    index = SegmentedIndex(spark, f"{folder(spark)}/brindle/{uuid.uuid4().hex}/edited")
    own = texts(spark, d)
    index.add(own)
    index.delete(own.where("chunk_id % 7 = 0"))
    old = own.where("chunk_id % 7 <> 0 AND chunk_id % 11 = 1")
    index.update(old, old.withColumn("text", F.concat("text", F.lit(" hewh thaner"))))
    index.merge()
    return shown(index.search(question(spark)))


@query(f"WITH {S_EDITED}, tok AS ({s_tokens('documents', 'doc_id')}) SELECT count(*) AS n, round(avg(len(t)), 6) AS avgdl FROM tok")
def segments_stats(spark, d):
    """Statistics as sums over segments and deletion vectors, read from the file that names them."""
    index = SegmentedIndex(spark, f"{folder(spark)}/brindle/{uuid.uuid4().hex}/stats")
    own = texts(spark, d)
    for part in (0, 1):
        index.add(own.where(F.col("chunk_id") % 2 == part))
    index.delete(own.where("chunk_id % 7 = 0"))
    old = own.where("chunk_id % 7 <> 0 AND chunk_id % 11 = 1")
    index.update(old, old.withColumn("text", F.concat("text", F.lit(" hewh thaner"))))
    n, avgdl = index.stats()
    return spark.createDataFrame([(n, round(avgdl, 6))], "n long, avgdl double")


def routes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    lex = written(served(spark, d).search(question(spark), fusion.ROUTE_K), "bm25")
    q = vectors(spark, d).where("chunk_id = 0").select(F.lit(0).cast("long").alias("qid"), "embedding")
    return lex, written(dense.search_flat(vectors(spark, d), q, fusion.ROUTE_K), "dense")


@query(f"WITH {S_ROUTES}, r AS ({s_rrf('lex', 'vec')}) {S_SHOWN} FROM r")
def rrf_fuse(spark, d):
    return shown(fusion.rrf_fuse(*routes(spark, d)))


@query(f"WITH {S_ROUTES}, vec7 AS ({s_flat('a.vec_id = 7', 20)}), r AS ({s_rrf('lex', 'vec', 'vec7')}) {S_SHOWN} FROM r")
def rrf_three_lists(spark, d):
    q = vectors(spark, d).where("chunk_id = 7").select(F.lit(0).cast("long").alias("qid"), "embedding")
    return shown(fusion.rrf_fuse(*routes(spark, d), dense.search_flat(vectors(spark, d), q, fusion.ROUTE_K)))


@query(f"WITH {S_ROUTES}, r AS ({s_rrf('lex', 'vec')}) {S_SHOWN} FROM r WHERE rank <= 10")
def hybrid_top10(spark, d):
    return shown(fusion.hybrid(*routes(spark, d)))


@query(
    f"WITH {S_ROUTES}, r AS ({s_rrf('lex', 'vec')}) SELECT r.qid, r.rank, r.chunk_id, round(CAST(r.score AS DOUBLE), 4) AS score, round(CAST(lex.score AS DOUBLE), 4) AS bm25_score, round(CAST(vec.score AS DOUBLE), 4) AS dense_score, CASE WHEN lex.score IS NOT NULL AND vec.score IS NOT NULL THEN 'bm25+vec' WHEN lex.score IS NOT NULL THEN 'bm25' ELSE 'vec' END AS route FROM r LEFT JOIN lex ON lex.chunk_id = r.chunk_id LEFT JOIN vec ON vec.chunk_id = r.chunk_id WHERE r.rank <= 10"
)
def route_labels(spark, d):
    lex, near = routes(spark, d)
    out = fusion.route_scores(fusion.hybrid(lex, near), lex, near)
    for c in ("bm25_score", "dense_score"):
        out = out.withColumn(c, F.round(F.col(c).cast("double"), 4))
    return shown(out, "bm25_score", "dense_score", "route")


@query(
    f"WITH {S_ROUTES}, r AS ({s_rrf('lex', 'vec')}), p AS (SELECT r.qid, r.rank, '[' || r.rank || '] rrf=' || printf('%g', CAST(r.score AS DOUBLE)) || '  bm25=' || coalesce(printf('%g', CAST(lex.score AS DOUBLE)), '-') || '  vec=' || coalesce(printf('%g', CAST(vec.score AS DOUBLE)), '-') || '  doc=' || {S_PATH} AS head, coalesce(text, '') AS text FROM r JOIN documents ON doc_id = r.chunk_id LEFT JOIN lex ON lex.chunk_id = r.chunk_id LEFT JOIN vec ON vec.chunk_id = r.chunk_id WHERE r.rank <= 10) SELECT qid, rank, head, md5(head || chr(10) || '    ' || text) AS line_md5 FROM p"
)
def printed_results(spark, d):
    lex, near = routes(spark, d)
    docs = corpus(spark, d)
    as_chunks = docs.select(F.col("doc_id").alias("chunk_id"), "doc_id", F.col("content").cast("string").alias("text"))
    lines = fusion.printed(fusion.hybrid(lex, near), lex, near, as_chunks, docs)
    return lines.select("qid", "rank", F.substring_index("line", "\n", 1).alias("head"), F.md5(F.col("line").cast("binary")).alias("line_md5"))


@query(f"{S_KEPT} SELECT qid, n, '[' || n || '] ' || source || ' (chunk ' || chunk_id || ')' AS line FROM kept")
def source_lines(spark, d):
    found = materials(spark, d)
    return context.source_lines(context.build_prompts(found.select("qid").distinct().withColumn("text", F.col("qid")), found))


@query(f"WITH {S_TERMS}, {S_INDEX}, r AS ({s_ranked(S_BM25, 10)}) SELECT r.rank, r.chunk_id, {S_PATH} AS path FROM r JOIN documents ON doc_id = chunk_id")
def result_paths(spark, d):
    docs = corpus(spark, d)
    ranked = fusion.described(bm25.search_texts(texts(spark, d), question(spark)), docs.select(F.col("doc_id").alias("chunk_id"), "doc_id", F.col("content").alias("text")), docs)
    return ranked.select("rank", "chunk_id", "path")


@query(f"WITH {S_TERMS}, {S_INDEX}, r AS ({s_ranked(S_BM25, 10)}) SELECT row_number() OVER (ORDER BY rank) AS rank, chunk_id FROM r WHERE chunk_id % 7 <> 0")
def visible_results(spark, d):
    docs = corpus(spark, d).withColumn("deleted", F.col("doc_id") % 7 == 0)
    ranked = fusion.described(bm25.search_texts(texts(spark, d), question(spark)), docs.select(F.col("doc_id").alias("chunk_id"), "doc_id", F.col("content").alias("text")), docs, show_deleted=False)
    return ranked.select("rank", "chunk_id")


def generations(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    old = corpus(spark, d).withColumn("deleted", F.col("doc_id") % 7 == 0)
    kept = corpus(spark, d).where("doc_id % 10 <> 0").withColumn("content", F.when(F.col("doc_id") % 10 == 1, F.concat("content", F.lit(" x"))).otherwise(F.col("content")))
    more = corpus(spark, d).where("doc_id % 10 = 2").withColumn("path", F.concat(F.lit("new/"), "path"))
    return old, kept.unionByName(more)


@query(f"{S_DIFF} SELECT path, change FROM dif WHERE change IS NOT NULL")
def corpus_changes(spark, d):
    return corpus_diff.diff_corpora(*generations(spark, d))


@query(f"{S_DIFF} SELECT change, count(*) AS n FROM dif WHERE change IS NOT NULL GROUP BY change")
def diff_counts(spark, d):
    return corpus_diff.change_counts(corpus_diff.diff_corpora(*generations(spark, d)))


@query(f"WITH {S_OLD}, {S_NEW} SELECT w.path, o.path IS NOT NULL AS deleted FROM w LEFT JOIN o ON w.path = o.path AND o.deleted")
def inherit_tombstones(spark, d):
    return corpus_diff.inherit_tombstones(*generations(spark, d)).select("path", "deleted")


@query(f"{S_DIFF} SELECT count(change) AS n_changed FROM dif")
def manifest_changed(spark, d):
    old, new = generations(spark, d)
    return corpus_diff.manifest_changes(corpus_diff.manifest(old), corpus_diff.manifest(new))


@query(f"""WITH {S_CHUNKS.replace('WHERE text IS NOT NULL', 'WHERE text IS NOT NULL AND doc_id % 7 <> 0 AND doc_id <> 8')} SELECT chunk_id, doc_id, i1 - i0 + 1 AS dl FROM ch""")
def delete_rebuild(spark, d):
    docs = corpus_diff.tombstone(corpus(spark, d).withColumn("deleted", F.col("doc_id") % 7 == 0), 8)
    made = chunking.chunk_documents(docs)
    return bm25.build_written_index(made).lengths.join(made.select("chunk_id", "doc_id"), "chunk_id").select("chunk_id", "doc_id", "dl")


@query(f"""WITH {S_CHUNKS.replace('WHERE text IS NOT NULL', 'WHERE text IS NOT NULL AND doc_id NOT IN (3, 8, 9, 40)')} SELECT chunk_id, doc_id, "begin", "end", i1 - i0 + 1 AS dl FROM ch""")
def delete_from_snapshot(spark, d):
    """Deletions named in a snapshot's small file: chunks and ids are those of a full rebuild."""
    snapshot = saved_index(spark, corpus(spark, d))
    for doc in (8, 3, 40, 9):
        own = snapshot.load_base()[1].where(F.col("doc_id") == doc).agg(F.min("chunk_id").alias("a"), F.max("chunk_id").alias("b")).first()
        snapshot.mark([doc], [[own["a"], own["b"] + 1]] if own["a"] is not None else [])
    _, made, index = snapshot.load()
    return made.join(index.lengths, "chunk_id").select("chunk_id", "doc_id", "begin", "end", F.col("dl").cast("long").alias("dl"))


@query(f"SELECT doc_id, doc_id % 7 = 0 AS deleted, strlen(text) AS n_bytes, {S_PATH} AS path FROM documents")
def doc_list(spark, d):
    return corpus_diff.doc_list(corpus(spark, d).withColumn("deleted", F.col("doc_id") % 7 == 0))


@query("SELECT coalesce(nullif(source, ''), '(root)') AS category, count(*) AS n_docs, count(*) FILTER (WHERE doc_id % 7 = 0) AS n_deleted FROM documents GROUP BY 1")
def category_counts(spark, d):
    return corpus_diff.category_counts(corpus(spark, d).withColumn("deleted", F.col("doc_id") % 7 == 0))


@query("SELECT doc_id FROM documents WHERE doc_id % 3 <> 2")
def extension_filter(spark, d):
    named = table(spark, d, "documents").select("doc_id", F.concat(F.lit("a.b/"), F.col("doc_id").cast("string"), F.element_at(F.array(F.lit(".MD"), F.lit(".txt"), F.lit(".exe")), (F.col("doc_id") % 3 + 1).cast("int"))).alias("path"))
    return named.where(scalars.has_extension(F.col("path"))).select("doc_id")


def materials(spark: SparkSession, d: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    return table(spark, d, "documents").where("text is not null").select(F.col("source").alias("qid"), place.alias("rank"), F.col("doc_id").alias("chunk_id"), path().alias("source"), "text")


@query(f"{S_KEPT} SELECT qid, n, chunk_id, used_bytes FROM kept")
def context_budget(spark, d):
    return context.within_budget(materials(spark, d)).select("qid", "n", "chunk_id", "used_bytes")


@query(f"{S_KEPT} SELECT qid, md5('Question: ' || qid || chr(10) || chr(10) || 'Retrieved materials:' || chr(10) || chr(10) || string_agg(block, chr(10) || chr(10) ORDER BY n)) AS digest, count(*) AS n_used FROM kept GROUP BY qid")
def prompt_blocks(spark, d):
    asked_ = table(spark, d, "documents").select(F.col("source").alias("qid")).distinct().withColumn("text", F.col("qid"))
    return context.build_prompts(asked_, materials(spark, d)).select("qid", F.md5(F.col("user").cast("binary")).alias("digest"), F.size("used").alias("n_used"))


def answers(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("doc_id")
    text = F.concat(F.lit("See ["), c % 12, F.lit("] and ["), c % 5 + 1, F.lit("], not [x] or [123456] but ["), c % 3, F.lit("]."))
    return table(spark, d, "documents").select(c.alias("qid"), text.alias("answer"), (c % 8).cast("int").alias("n_used"))


@query(f"{S_CITED} SELECT qid, pos, n, valid FROM cv")
def citation_check(spark, d):
    return context.citations(answers(spark, d))


@query(f"{S_CITED} SELECT qid, count(*) FILTER (WHERE valid) AS n_valid, count(*) FILTER (WHERE NOT valid) AS n_invalid FROM cv GROUP BY qid")
def citation_counts(spark, d):
    return context.citation_counts(answers(spark, d))


@query(f"{S_CITED}, le AS (SELECT qid, unnest(range(1, n_used + 1)) AS n FROM an WHERE n_used > 0) SELECT cv.qid, cv.pos, cv.n, CASE WHEN le.n IS NOT NULL THEN cv.qid * 100 + le.n END AS chunk_id FROM cv LEFT JOIN le ON le.qid = cv.qid AND le.n = cv.n")
def citation_resolve(spark, d):
    said = answers(spark, d)
    ledger = said.where("n_used > 0").select("qid", F.explode(F.sequence(F.lit(1), F.col("n_used"))).alias("n")).withColumn("chunk_id", F.col("qid") * 100 + F.col("n")).withColumn("source", F.lit(""))
    return context.resolved(context.citations(said), ledger).select("qid", "pos", "n", "chunk_id")


@query("WITH s AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents) SELECT doc_id, CASE WHEN length(t) > 180 THEN substring(t, 1, 177) || '...' ELSE t END AS snippet FROM s")
def snippets(spark, d):
    return table(spark, d, "documents").select("doc_id", scalars.snippet(F.col("text")).alias("snippet"))


def firsts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """First relevant ranks of full and of halved vectors: relevant are rows of the same label."""
    own, q = vectors(spark, d), asked(spark, d)
    half = lambda df: df.withColumn("embedding", F.slice("embedding", 1, 32))
    labels = own.select("chunk_id", "label")
    out = []
    for v, a in ((own, q), (half(own), half(q))):
        judged = dense.search_flat(v, a, 11).join(labels, "chunk_id").join(labels.select(F.col("chunk_id").alias("qid"), F.col("label").alias("wanted")), "qid")
        out.append(evaluate.first_relevant(q, judged.withColumn("relevant", (F.col("label") == F.col("wanted")) & (F.col("qid") != F.col("chunk_id")))))
    return out[0], out[1]


@query(f"WITH {S_FIRST} SELECT count(*) AS n, avg(CASE WHEN rank <= 1 THEN 1e0 ELSE 0e0 END) AS hit_1, avg(CASE WHEN rank <= 5 THEN 1e0 ELSE 0e0 END) AS hit_5, avg(CASE WHEN rank <= 10 THEN 1e0 ELSE 0e0 END) AS hit_10 FROM jf")
def hit_at_k(spark, d):
    return evaluate.metrics(firsts(spark, d)[0]).drop("mrr")


@query(f"WITH {S_FIRST} SELECT round(avg(coalesce(1e0 / rank, 0e0)), 6) AS mrr FROM jf")
def mrr_at_10(spark, d):
    return evaluate.metrics(firsts(spark, d)[0]).select(F.round("mrr", 6).alias("mrr"))


@query(f"WITH {S_FIRST} SELECT jf.qid, jf.rank AS rank_a, jh.rank AS rank_b, CASE WHEN coalesce(jf.rank, 99) = coalesce(jh.rank, 99) THEN 'tie' WHEN coalesce(jf.rank, 99) < coalesce(jh.rank, 99) THEN 'full' ELSE 'half' END AS verdict FROM jf JOIN jh USING (qid)")
def ab_verdict(spark, d):
    return evaluate.verdicts(*firsts(spark, d), "full", "half")


@query(f"WITH {S_FIRST} SELECT round(count(h.qid) / count(*), 6) AS recall FROM f LEFT JOIN h ON h.qid = f.qid AND h.chunk_id = f.chunk_id")
def recall_at_10(spark, d):
    own, q = vectors(spark, d), asked(spark, d)
    half = lambda df: df.withColumn("embedding", F.slice("embedding", 1, 32))
    return hnsw.recall(dense.search_flat(half(own), half(q), 11), dense.search_flat(own, q, 11)).select(F.round("recall", 6).alias("recall"))


@query(f"WITH {S_TERMS}, {S_INDEX}, r AS ({s_ranked(S_BM25, 10)}) SELECT rank, chunk_id, starts_with({S_PATH}, 'src1') OR starts_with({S_PATH}, 'src7/') AS relevant FROM r JOIN documents ON doc_id = chunk_id")
def relevant_by_prefix(spark, d):
    docs = corpus(spark, d).select(F.col("doc_id").alias("chunk_id"), "path")
    ranked = bm25.search_texts(texts(spark, d), question(spark)).join(docs, "chunk_id")
    expected = spark.range(1).select(F.col("id").alias("qid"), F.array(F.lit("src1"), F.lit("src7/")).alias("prefixes"))
    return evaluate.relevant_by_prefix(ranked, expected).select("rank", "chunk_id", "relevant")


def log(spark: SparkSession, d: str) -> DataFrame:
    when = F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 3600)
    return table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("line_no"), when.alias("when"), F.col("role").alias("speaker"), F.lit("").alias("tag"), F.array("text").alias("body"))


@query(f"{S_FILTER} SELECT line_no, speaker FROM ft")
def log_filter(spark, d):
    return logquery.filter_log(log(spark, d), ["assistant", "user"], "2024-01-02", "2024-02-01 12:30", ["THE", "on"]).select("line_no", "speaker")


@query(f"{S_FILTER} SELECT line_no, speaker FROM ft ORDER BY line_no DESC LIMIT 25")
def log_recent(spark, d):
    return logquery.filter_log(log(spark, d), ["assistant", "user"], "2024-01-02", "2024-02-01 12:30", ["THE", "on"], recent=25).select("line_no", "speaker")


@query("SELECT role AS speaker, count(*) AS n FROM conversations GROUP BY role")
def speaker_tally(spark, d):
    return logquery.speaker_tally(log(spark, d))


def cached(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "documents").select("doc_id", path().alias("path"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("content_hash"), (1 + F.col("doc_id") % 4).alias("n_chunks"))
    stale = docs.where("doc_id % 9 <> 0").withColumn("content_hash", F.when(F.col("doc_id") % 9 == 1, "stale").otherwise(F.col("content_hash"))).withColumn("n_chunks", F.col("n_chunks") + F.when(F.col("doc_id") % 9 == 2, 1).otherwise(0))
    return docs.drop("doc_id"), stale.drop("doc_id")


@query(f"{S_REUSE} SELECT path, reuse FROM pl")
def reuse_plan(spark, d):
    return corpus_diff.reuse_plan(*cached(spark, d)).select("path", "reuse")


@query(f"{S_REUSE} SELECT sum(CASE WHEN reuse THEN n_chunks ELSE 0 END) AS n_reused, sum(CASE WHEN reuse THEN 0 ELSE n_chunks END) AS n_embedded FROM pl")
def reuse_counts(spark, d):
    return corpus_diff.reuse_counts(corpus_diff.reuse_plan(*cached(spark, d)))


# -- snapshots, mixed scripts, logs and files ------------------------------------------------------

HAN_FROM, HAN_TO = "aeioutn", "你好世界中文字"
S_HAN = f"documents AS (SELECT doc_id, translate(text, '{HAN_FROM}', '{HAN_TO}') AS text FROM main.documents)"


def han_corpus(spark: SparkSession, d: str) -> DataFrame:
    """The corpus with some letters written as Han characters, so that both scripts meet in every line."""
    return corpus(spark, d).withColumn("content", F.translate("content", HAN_FROM, HAN_TO))


@query(f"WITH {S_HAN}, tok AS ({s_tokens('documents', 'doc_id')}) SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(t, ' ')) AS digest FROM tok")
def han_tokens(spark, d):
    own = han_corpus(spark, d).where("content is not null").select("doc_id", tokens(F.col("content")).alias("t"))
    return own.select("doc_id", F.size("t").alias("n_tokens"), F.md5(F.array_join("t", " ").cast("binary")).alias("digest"))


@query(f'WITH {S_HAN}, {S_CHUNKS} SELECT chunk_id, doc_id, "begin", "end" FROM ch')
def han_chunks(spark, d):
    return chunking.chunk_documents(han_corpus(spark, d)).select("chunk_id", "doc_id", "begin", "end")


@query(f"WITH {S_HAN}, a AS (SELECT doc_id, regexp_extract_all(text, '{S_ATOM}') AS ats FROM documents WHERE text IS NOT NULL) SELECT doc_id, len(list_filter(ats, lambda x: regexp_matches(x, '{_H}'))) AS n_han, len(list_filter(ats, lambda x: NOT regexp_matches(x, '{_H}'))) AS n_words FROM a")
def atom_kinds(spark, d):
    made = atoms(han_corpus(spark, d).where("content is not null").select("doc_id", "content"))
    kinds = lambda k: F.size(F.filter("atoms", lambda a: a["kind"] == k)).cast("long")
    return made.select("doc_id", kinds("CJK_CHAR").alias("n_han"), kinds("ASCII_WORD").alias("n_words"))


def saved_index(spark: SparkSession, docs: DataFrame) -> IndexSnapshot:
    snapshot = IndexSnapshot(spark, f"{folder(spark)}/brindle/{uuid.uuid4().hex}/index")
    made = written(chunking.chunk_documents(docs), "chunks")
    if not snapshot.save(docs, made, bm25.build_written_index(made)):
        raise OSError("the index was not saved")
    return snapshot


@query(f"WITH {S_TERMS}, {S_CHUNK_INDEX}, r AS ({s_ranked(S_BM25, 10)}) {S_SHOWN} FROM r")
def index_snapshot_search(spark, d):
    """A question answered from an index that was saved and loaded again."""
    return shown(bm25.search(saved_index(spark, corpus(spark, d)).load()[2], question(spark)))


@query(f'WITH {S_CHUNKS} SELECT chunk_id, doc_id, "begin", "end" FROM ch')
def index_snapshot_chunks(spark, d):
    return saved_index(spark, corpus(spark, d)).load()[1].select("chunk_id", "doc_id", "begin", "end")


@query("SELECT * FROM (VALUES ('none', 'NOT_FOUND'), ('same', 'OK'), ('other size', 'BAD_PARAMS'), ('edited', 'CORPUS_CHANGED'), ('tombstone', 'OK'), ('no json', 'BAD_MAGIC'), ('other magic', 'BAD_MAGIC'), ('other pipeline', 'BAD_PIPELINE'), ('other format', 'BAD_FORMAT'), ('lost rows', 'BAD_FORMAT'), ('a file cut short', 'BAD_FORMAT'), ('a folder in its place', 'IO_ERROR')) t(made, status)")
def snapshot_states(spark, d):
    docs = corpus(spark, d).where("content is not null")
    none = IndexSnapshot(spark, f"{folder(spark)}/brindle/{uuid.uuid4().hex}/index")
    s = saved_index(spark, docs)
    out = [("none", none.validate(docs)), ("same", s.validate(docs)), ("other size", s.validate(docs, 400)), ("edited", s.validate(docs.withColumn("content", F.concat("content", F.lit("!"))))), ("tombstone", s.validate(docs.withColumn("deleted", F.lit(True))))]
    good = json.loads(s.store.read("CURRENT"))
    for made, content in (("no json", b"{"), ("other magic", good | {"magic": "x"}), ("other pipeline", good | {"pipeline": 99}), ("other format", good | {"format": 99}), ("lost rows", good | {"prints": good["prints"] | {"lengths": [0, 0]}})):
        s.store.replace("CURRENT", content if isinstance(content, bytes) else json.dumps(content).encode())
        out.append((made, s.validate(docs)))
    s.store.replace("CURRENT", json.dumps(good).encode())
    cut_short(s, good["version"])
    out.append(("a file cut short", s.validate(docs)))
    s.store.delete("CURRENT")
    s.store.replace("CURRENT/inside", b"")
    out.append(("a folder in its place", s.validate(docs)))
    return spark.createDataFrame([(made, status.name) for made, status in out], "made string, status string")


def cut_short(snapshot: IndexSnapshot | VectorSnapshot, version: str) -> None:
    """Leave the first half of one of a snapshot's files."""
    name = sorted(path.split(f"/{version}/")[1] for path, _ in snapshot.store.files(version) if path.endswith(".parquet") and "/files/" not in path)[0]
    content = snapshot.store.read(f"{version}/{name}")
    snapshot.store.replace(f"{version}/{name}", content[: len(content) // 2])


def saved_vectors(spark: SparkSession, d: str) -> VectorSnapshot:
    rows = vectors(spark, d).groupBy(F.col("label").cast("string").alias("path")).agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk_id", "embedding"))), lambda x: x["embedding"]).alias("vectors"))
    snapshot = VectorSnapshot(spark, f"{folder(spark)}/brindle/{uuid.uuid4().hex}/vectors")
    if not snapshot.save(Identity("m", "p", dense.dimension(vectors(spark, d))), rows.withColumn("content_hash", F.xxhash64("path"))):
        raise OSError("the vectors were not saved")
    return snapshot


@query("SELECT row_number() OVER (ORDER BY CAST(label AS VARCHAR), vec_id) - 1 AS chunk_id, round(CAST(embedding[1] AS DOUBLE), 4) AS first, round(CAST(embedding[len(embedding)] AS DOUBLE), 4) AS last FROM embeddings")
def vector_snapshot(spark, d):
    rows = flat_vectors(saved_vectors(spark, d).load(Identity("m", "p"))[1])
    return rows.select("chunk_id", F.round(F.element_at("embedding", 1).cast("double"), 4).alias("first"), F.round(F.element_at("embedding", -1).cast("double"), 4).alias("last"))


@query("SELECT * FROM (VALUES ('none', 'NOT_FOUND'), ('same', 'OK'), ('other model', 'BAD_MODEL'), ('other policy', 'BAD_MODEL'), ('other width', 'BAD_MODEL'), ('other pipeline', 'BAD_FORMAT'), ('no magic', 'BAD_MAGIC'), ('a file cut short', 'BAD_FORMAT')) t(made, status)")
def vector_snapshot_states(spark, d):
    s = saved_vectors(spark, d)
    none = VectorSnapshot(spark, f"{folder(spark)}/brindle/{uuid.uuid4().hex}/vectors")
    out = [("none", none.load(Identity("m", "p"))), ("same", s.load(Identity("m", "p"))), ("other model", s.load(Identity("x", "p"))), ("other policy", s.load(Identity("m", "x"))), ("other width", s.load(Identity("m", "p", 7)))]
    s.store.replace("CURRENT", json.dumps(json.loads(s.store.read("CURRENT")) | {"pipeline": 99}).encode())
    out.append(("other pipeline", s.load(Identity("m", "p"))))
    good = json.loads(s.store.read("CURRENT")) | {"pipeline": 1}
    s.store.replace("CURRENT", json.dumps({k: v for k, v in good.items() if k != "magic"}).encode())
    out.append(("no magic", s.load(Identity("m", "p"))))
    s.store.replace("CURRENT", json.dumps(good).encode())
    cut_short(s, good["version"])
    out.append(("a file cut short", s.load(Identity("m", "p"))))
    return spark.createDataFrame([(made, status.name) for made, (status, _) in out], "made string, status string")


@query(f"WITH {S_ROUTES}, twice AS (SELECT rank, chunk_id FROM lex UNION ALL SELECT rank + 20, chunk_id FROM lex), r AS ({s_rrf('twice', 'vec')}) {S_SHOWN} FROM r")
def rrf_repeats(spark, d):
    """Of a list that names ids more than once, the first place counts."""
    lex, near = routes(spark, d)
    return shown(fusion.rrf_fuse(lex.unionByName(lex.withColumn("rank", F.col("rank") + 20)), near))


@query(f"WITH {S_TERMS}, {S_INDEX}, r AS ({s_ranked(S_BM25, 10)}) {S_SHOWN} FROM r")
def bm25_guards(spark, d):
    """Questions without a token, or with words that no document has, and k = 0 add no row."""
    index = bm25.build_written_index(texts(spark, d))
    more = spark.range(1, 3).select(F.col("id").alias("qid"), F.when(F.col("id") == 1, "... !").otherwise("qqqqzzzz").alias("text"))
    return shown(bm25.search(index, question(spark).unionByName(more)).unionByName(bm25.search(index, question(spark), 0)))


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN doc_id END AS number FROM documents")
def document_numbers(spark, d):
    shape = F.element_at(F.array(F.lit("{}"), F.lit("-{}"), F.lit("{}x"), F.lit("")), (F.col("doc_id") % 4 + 1).cast("int"))
    said = F.regexp_replace(shape, r"\{\}", F.col("doc_id").cast("string"))
    return table(spark, d, "documents").select("doc_id", scalars.document_number(said).alias("number"))


@query(f"WITH {S_CHUNKS}, g AS (SELECT x.doc_id, x.i, sum(length(x.gap) + length(x.tok)) OVER (PARTITION BY x.doc_id ORDER BY x.i) - length(x.tok) AS at FROM x) SELECT ch.chunk_id, g.at AS char_begin FROM ch JOIN g ON g.doc_id = ch.doc_id AND g.i = ch.i0".replace("WITH ", f"WITH {S_HAN}, ", 1))
def char_offsets(spark, d):
    docs = han_corpus(spark, d)
    made = chunking.chunk_documents(docs).join(docs.select("doc_id", "content"), "doc_id")
    return made.select("chunk_id", scalars.char_offset(F.col("content"), F.col("begin")).cast("long").alias("char_begin"))


@query(f'WITH {S_CHUNKS} SELECT ch.chunk_id AS id, ch.doc_id, {S_PATH} AS path, "begin", "end", "end" - "begin" AS n_bytes FROM ch JOIN documents USING (doc_id)')
def chunk_lines(spark, d):
    """Chunks written as JSON lines and read again."""
    docs, to = corpus(spark, d), f"{folder(spark)}/brindle/{uuid.uuid4().hex}/lines"
    corpus_io.write_chunk_lines(chunking.chunk_documents(docs), docs, to)
    return corpus_io.read_chunk_lines(spark, to).select("id", "doc_id", "path", "begin", "end", F.octet_length("text").cast("long").alias("n_bytes"))


@query(f"WITH {S_FIRST} SELECT qid, rank FROM jf")
def evaluation_lines(spark, d):
    """First relevant ranks written as JSON and read again."""
    to = f"{folder(spark)}/brindle/{uuid.uuid4().hex}/evaluation"
    corpus_io.write_evaluation(firsts(spark, d)[0], to)
    return spark.read.schema("qid long, rank int").json(to)


def log_lines(spark: SparkSession, d: str) -> DataFrame:
    """(line_no, line): the conversations in the record format, after a line that is none."""
    said = table(spark, d, "conversations").where("text is not null")
    c, place = F.col("turn"), (F.col("conv_id") * 1000 + F.col("turn")) * 3
    when = F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 3600), "yyyy-MM-dd HH:mm")
    tag = F.when(c % 3 == 0, F.concat(F.when(c % 2 == 0, " (").otherwise("（"), F.lit("t"), c.cast("string"), F.when(c % 2 == 0, ")").otherwise("）"))).otherwise("")
    head = F.concat(F.when(c % 2 == 0, "## [").otherwise("##["), when, F.when(c % 5 == 0, ":59] ").otherwise("]"), F.col("role"), tag)
    lines = said.select(place.alias("line_no"), head.alias("line")).unionByName(said.select((place + 1).alias("line_no"), F.regexp_replace("text", r"\s+", " ").alias("line")))
    lines = lines.unionByName(spark.range(1).select(F.lit(-5).cast("long").alias("line_no"), F.lit("no record yet").alias("line")))
    return lines


@query("SELECT conv_id * 1000 + turn AS line, CAST(TIMESTAMP '2024-01-01 00:00:00' + conv_id * INTERVAL 1 HOUR AS VARCHAR) AS at, role AS speaker, CASE WHEN turn % 3 = 0 THEN 't' || turn ELSE '' END AS tag, length(regexp_replace(text, '\\s+', ' ', 'g')) AS n_chars FROM conversations WHERE text IS NOT NULL")
def log_records(spark, d):
    """A log written as lines of the record format, with lines before its first record, and parsed."""
    out = corpus_io.parse_log(log_lines(spark, d))
    return out.select((F.col("line_no") / 3).cast("long").alias("line"), F.date_format("when", "yyyy-MM-dd HH:mm:ss").alias("at"), "speaker", "tag", F.length(F.element_at("body", 1)).cast("long").alias("n_chars"))


@query("SELECT 2 * row_number() OVER (ORDER BY conv_id, turn) AS line, CAST(TIMESTAMP '2024-01-01 00:00:00' + conv_id * INTERVAL 1 HOUR AS VARCHAR) AS at, role AS speaker, CASE WHEN turn % 3 = 0 THEN 't' || turn ELSE '' END AS tag, length(regexp_replace(text, '\\s+', ' ', 'g')) AS n_chars FROM conversations WHERE text IS NOT NULL")
def log_file_records(spark, d):
    """The same log written as files that follow one another, and read in splits: lines have their numbers over all of them."""
    to = f"{folder(spark)}/brindle/{uuid.uuid4().hex}/log"
    log_lines(spark, d).orderBy("line_no").select("line").write.text(to)
    out = corpus_io.read_log(spark, to)
    return out.select(F.col("line_no").alias("line"), F.date_format("when", "yyyy-MM-dd HH:mm:ss").alias("at"), "speaker", "tag", F.length(F.element_at("body", 1)).cast("long").alias("n_chars"))


@query("SELECT vec_id AS qid, 10 AS n, true AS good FROM embeddings WHERE vec_id % 20 = 0")
def hnsw_gate(spark, d):
    """For each query, how many results the graph gives, and whether at least 85 % of the exact ones are among them."""
    near = written(hnsw_search(spark, d), "near")
    exact = dense.search_flat(vectors(spark, d), asked(spark, d), 10)
    hits = exact.join(near.select("qid", "chunk_id", F.lit(1).alias("hit")), ["qid", "chunk_id"], "left").groupBy("qid").agg(F.count("hit").alias("hits"))
    return near.groupBy("qid").agg(F.count(F.lit(1)).alias("n")).join(hits, "qid").select("qid", "n", (F.col("hits") >= 8.5).alias("good"))


S_FNV = f"""WITH p AS (SELECT doc_id, {S_PATH} AS path FROM documents), b AS (SELECT doc_id, list_transform(range(0, 2 * strlen(path), 2), lambda i: CAST(('0x' || substring(hex(encode(path)), i + 1, 2)) AS HUGEINT)) AS bytes FROM p),
h AS (SELECT doc_id, list_reduce(list_prepend(CAST(14695981039346656037 AS HUGEINT), bytes), lambda h, x: (xor(h, x) * CAST(1099511628211 AS HUGEINT)) % CAST(18446744073709551616 AS HUGEINT)) AS h FROM b)"""


@query(f"{S_FNV} SELECT doc_id, CAST(CASE WHEN h >= CAST(9223372036854775808 AS HUGEINT) THEN h - CAST(18446744073709551616 AS HUGEINT) ELSE h END AS BIGINT) AS hash FROM h")
def path_hashes(spark, d):
    """FNV-1a of each document's path."""
    return table(spark, d, "documents").select("doc_id", scalars.fnv1a64(path()).alias("hash"))


ASTRAL_FROM, ASTRAL_TO = "aeit", "😀é世𝒜"


@query(f"WITH {S_CHUNKS}, g AS (SELECT x.doc_id, x.i, sum(length(x.gap) + length(x.tok) + length(regexp_replace(x.gap, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g'))) OVER (PARTITION BY x.doc_id ORDER BY x.i) - length(x.tok) AS at FROM x) SELECT ch.chunk_id, CAST(g.at AS BIGINT) AS utf16_begin FROM ch JOIN g ON g.doc_id = ch.doc_id AND g.i = ch.i0".replace("WITH ", f"WITH documents AS (SELECT doc_id, translate(text, '{ASTRAL_FROM}', '{ASTRAL_TO}') AS text FROM main.documents), ", 1))
def utf16_offsets(spark, d):
    """Where chunks begin in UTF-16, in texts with characters of one and of two code units."""
    docs = corpus(spark, d).withColumn("content", F.translate("content", ASTRAL_FROM, ASTRAL_TO))
    made = chunking.chunk_documents(docs).join(docs.select("doc_id", "content"), "doc_id")
    return made.select("chunk_id", scalars.utf16_offset(F.col("content"), F.col("begin")).cast("long").alias("utf16_begin"))


@query(rf"""WITH an AS ({S_ANSWERS}), t AS (SELECT qid, n_used, replace(replace(replace(replace('<b> & "x"' || chr(10) || answer || ' [007] [00000]', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS h FROM an),
z AS (SELECT qid, n_used, list_zip(regexp_split_to_array(h, '\[[0-9]{{1,5}}\]'), list_transform(regexp_extract_all(h, '\[([0-9]{{1,5}})\]', 1), lambda s: CAST(s AS INTEGER))) AS p FROM t)
SELECT qid, replace(array_to_string(list_transform(p, lambda x: x[1] || CASE WHEN x[2] IS NULL THEN '' WHEN x[2] BETWEEN 1 AND n_used THEN '<a href="cite:' || x[2] || '">[' || x[2] || ']</a>' ELSE '<span style="color:#b00020;">[' || x[2] || ']</span>' END), ''), chr(10), '<br>') AS html FROM z""")
def answer_html(spark, d):
    said = answers(spark, d).withColumn("answer", F.concat(F.lit('<b> & "x"\n'), "answer", F.lit(" [007] [00000]")))
    return said.select("qid", context.answer_html(F.col("answer"), F.col("n_used")).alias("html"))


@query(f"SELECT row_number() OVER (ORDER BY category, path) - 1 AS place, category, path, deleted FROM (SELECT coalesce(nullif(source, ''), '(root)') AS category, {S_PATH} AS path, doc_id % 7 = 0 AS deleted FROM documents)")
def document_tree(spark, d):
    return corpus_diff.document_tree(corpus(spark, d).withColumn("deleted", F.col("doc_id") % 7 == 0))


@query(f"WITH {S_CHUNK_INDEX} SELECT row_number() OVER (ORDER BY term, doc_id) AS place, term, doc_id AS chunk_id FROM post")
def snapshot_order(spark, d):
    """Postings numbered as they stand in a snapshot's files: by term and chunk, in the order of bytes."""
    s = saved_index(spark, corpus(spark, d))
    rows = s.table(json.loads(s.store.read("CURRENT")), "postings").select("term", "chunk_id", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    sizes = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    before = rows.groupBy("file").agg(F.count(F.lit(1)).alias("n")).select("file", F.coalesce(F.sum("n").over(sizes), F.lit(0)).alias("before"))
    return rows.join(before, "file").select((F.col("before") + F.col("row") + 1).alias("place"), "term", "chunk_id")


@query(f"WITH {S_CHUNKS.replace('WHERE text IS NOT NULL', 'WHERE text IS NOT NULL AND doc_id % 7 <> 0')} SELECT {S_PATH} AS path, count(c.doc_id) AS n_vectors, doc_id % 2 = 0 AS kept FROM documents d LEFT JOIN ch c USING (doc_id) WHERE doc_id % 7 <> 0 GROUP BY ALL HAVING count(c.doc_id) > 0")
def vector_reuse(spark, d):
    """Vectors of live documents' chunks: those of the cache as they are (marked here by their first component), the others embedded; deleted documents have none."""
    docs = corpus(spark, d).withColumn("deleted", F.col("doc_id") % 7 == 0)
    made = written(chunking.chunk_documents(docs), "chunks")
    counts = made.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    mark = F.array_repeat(F.array(F.lit(7.0).cast("float"), F.lit(0.0).cast("float")), F.col("n").cast("int"))
    cache = docs.where("doc_id % 2 = 0").join(counts, "doc_id").select("path", F.xxhash64(F.col("content").cast("binary")).alias("content_hash"), mark.alias("vectors"))
    rows, _ = doc_vectors(spark, docs, made, cache, providers.HashEmbedder)
    return rows.where(F.size("vectors") > 0).select("path", F.size("vectors").cast("long").alias("n_vectors"), F.forall("vectors", lambda v: v[0] == 7.0).alias("kept"))


@query(f"WITH {S_TERMS}, {S_INDEX}, r AS ({s_ranked(S_BM25, 10)}) SELECT r.rank AS n, r.chunk_id, {S_PATH} AS source, md5(coalesce(text, '')) AS text_md5 FROM r JOIN documents ON doc_id = chunk_id")
def prompt_materials(spark, d):
    """What of a question's results goes into its prompt: chunk, path and text, and its number there."""
    docs = corpus(spark, d)
    ranked = served(spark, d).search(question(spark))
    found = fusion.described(ranked, docs.select(F.col("doc_id").alias("chunk_id"), "doc_id", F.col("content").alias("text")), docs).select("qid", "rank", "chunk_id", F.col("path").alias("source"), "text")
    used = context.build_prompts(question(spark), found, 1 << 30).select(F.explode("used").alias("u"))
    return used.select("u.n", "u.chunk_id", "u.source", F.md5(F.col("u.text").cast("binary")).alias("text_md5"))


@query("SELECT vec_id, vec_id % 6 NOT IN (1, 2, 3, 4) AS usable FROM embeddings")
def usable_vectors(spark, d):
    """Vectors made zero, empty, infinite or not a number cannot be brought to unit length."""
    own, k = vectors(spark, d), F.col("chunk_id") % 6
    first = lambda x: F.transform("embedding", lambda v, i: F.when(i == 0, F.lit(x).cast("float")).otherwise(v))
    changed = F.when(k == 1, F.transform("embedding", lambda v: F.lit(0.0).cast("float"))).when(k == 2, F.slice("embedding", 1, 0)).when(k == 3, first(float("inf"))).when(k == 4, first(float("nan"))).otherwise(F.col("embedding"))
    return own.select(F.col("chunk_id").alias("vec_id"), scalars.usable(changed).alias("usable"))


class LengthEmbedder:
    """A provider that SQL can follow: a text's length and 1, at unit length. Texts whose length a number divides are refused until the file named exists."""

    model_id, policy = "length", "none"

    def __init__(self, refuse: int = 0, until: str = ""):
        self.refuse, self.until = refuse, until

    def embed_documents(self, texts: list[str]) -> list[list[float]]:
        if self.refuse and not os.path.exists(self.until) and any(len(t) % self.refuse == 0 for t in texts):
            raise providers.ProviderError("refused")
        return providers.checked_vectors([[float(len(t)), 1.0] for t in texts], len(texts))

    def embed_query(self, text: str) -> list[float]:
        return self.embed_documents([text])[0]


class DigestGenerator:
    """A provider that SQL can follow: it answers with the hash of what it was asked."""

    model_id = "digest"

    def chat(self, messages: list[providers.Message]) -> str:
        return hashlib.md5(messages[-1].text.encode()).hexdigest()


S_LENGTH = "round(CAST(CAST(length({0}) / sqrt(length({0}) * length({0}) + 1e0) AS FLOAT) AS DOUBLE), 5)"


@query(f"SELECT doc_id AS chunk_id, {S_LENGTH.format('text')} AS x FROM documents WHERE text IS NOT NULL")
def embedded_lengths(spark, d):
    """Texts sent to a provider in requests of 32, each vector back with its own text."""
    return providers.embed_texts(texts(spark, d), LengthEmbedder).select("chunk_id", F.round(F.col("embedding")[0].cast("double"), 5).alias("x"))


@query(f"SELECT item_id AS qid, {S_LENGTH.format('text')} AS x FROM benchmark")
def embedded_questions(spark, d):
    asked_ = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), "text")
    return providers.embed_queries(asked_, LengthEmbedder).select("qid", F.round(F.col("embedding")[0].cast("double"), 5).alias("x"))


@query("SELECT doc_id AS chunk_id, length(text) % 7 = 0 AS failed, true AS resumed FROM documents WHERE text IS NOT NULL")
def embed_resumed(spark, d):
    """A provider refuses some texts: those alone have errors, and the next call, which it serves, completes them."""
    own, store = texts(spark, d), f"{folder(spark)}/brindle/{uuid.uuid4().hex}/embedded"
    first = written(providers.embed_resumable(own, lambda: LengthEmbedder(7), store, batch=1, retries=1), "first")
    second = providers.embed_resumable(own, LengthEmbedder, store)
    return first.select("chunk_id", F.col("error").isNotNull().alias("failed")).join(second.select("chunk_id", (F.col("error").isNull() & F.col("embedding").isNotNull()).alias("resumed")), "chunk_id")


@query(f"""WITH bt AS ({s_tokens('benchmark', 'item_id')}), q AS (SELECT item_id AS qid, unnest(range(0, len(t))) AS pos, unnest(t) AS term FROM bt), {S_INDEX}, r AS ({s_ranked(S_BM25, 10)}),
m AS (SELECT r.qid, r.rank AS n, {S_PATH} AS source, text FROM r JOIN documents ON doc_id = chunk_id), b AS (SELECT *, {S_BLOCK} AS block FROM m),
u AS (SELECT *, sum(strlen(block)) OVER (PARTITION BY qid ORDER BY n) AS used_bytes FROM b), kept AS (SELECT * FROM u WHERE n = 1 OR used_bytes <= 16384),
j AS (SELECT qid, string_agg(block, chr(10) || chr(10) ORDER BY n) AS blocks FROM kept GROUP BY qid)
SELECT item_id AS qid, md5('Question: ' || text || chr(10) || chr(10) || 'Retrieved materials:' || chr(10) || chr(10) || coalesce(blocks, '')) AS answer FROM benchmark LEFT JOIN j ON j.qid = item_id""")
def grounded_digests(spark, d):
    """Questions searched, put into prompts with their materials and sent to a provider, which answers with the hash of its prompt."""
    asked_ = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), "text")
    docs = corpus(spark, d)
    ranked = served(spark, d).search(asked_)
    found = fusion.described(ranked, docs.select(F.col("doc_id").alias("chunk_id"), "doc_id", F.col("content").alias("text")), docs).select("qid", "rank", "chunk_id", F.col("path").alias("source"), "text")
    return providers.generate(context.build_prompts(asked_, found), DigestGenerator).select("qid", "answer")


@query(rf"SELECT doc_id, len(regexp_extract_all(regexp_replace(text, '[^\x00-\x7F]', '!', 'g'), '{WORD}')) AS n_atoms FROM documents WHERE text IS NOT NULL AND NOT regexp_matches(text, '[\x{{80}}-\x{{BF}}]{{2}}')")
def malformed_atoms(spark, d):
    """Texts in another encoding are no valid UTF-8: their bytes beyond ASCII separate atoms (texts in which they could pass for a Han character left out)."""
    docs = corpus(spark, d).where(F.col("content").isNotNull() & ~F.col("content").rlike(r"[\x{80}-\x{BF}]{2}"))
    made = atoms(docs.select("doc_id", F.encode(F.regexp_replace("content", r"[^\x00-\xFF]", "!"), "ISO-8859-1").alias("content")))
    return made.select("doc_id", F.size("atoms").cast("long").alias("n_atoms"))


@query(f"WITH {S_TERMS}, documents AS (SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN text END AS text FROM main.documents), {S_INDEX}, r AS ({s_ranked(S_BM25, 10)}) {S_SHOWN} FROM r")
def null_texts_top10(spark, d):
    """Documents without a text do not count among the chunks."""
    own = table(spark, d, "documents").withColumn("text", F.when(F.col("doc_id") % 5 != 0, F.col("text"))).where("text is not null")
    return shown(bm25.search(bm25.build_written_index(own.select(F.col("doc_id").alias("chunk_id"), "text")), question(spark)))


@query("SELECT vec_id AS qid, 10 AS n, true AS good FROM embeddings WHERE vec_id % 20 = 0")
def hnsw_sharded_gate(spark, d):
    """As hnsw_gate, with four shards: every question meets all of them, and their results are merged."""
    index = written(hnsw.build_hnsw(vectors(spark, d).select("chunk_id", "embedding"), shards=4), "hnsw")
    near = written(hnsw.search_hnsw(index, asked(spark, d), 10), "near")
    exact = dense.search_flat(vectors(spark, d), asked(spark, d), 10)
    hits = exact.join(near.select("qid", "chunk_id", F.lit(1).alias("hit")), ["qid", "chunk_id"], "left").groupBy("qid").agg(F.count("hit").alias("hits"))
    return near.groupBy("qid").agg(F.count(F.lit(1)).cast("int").alias("n")).join(hits, "qid").select("qid", "n", (F.col("hits") >= 8.5).alias("good"))


# whole-text byte hashes and providers have no form in SQL, or none that ends: tests hold them against other means


@query()
def hnsw_search(spark, d):
    return hnsw.search_hnsw(written(hnsw.build_hnsw(vectors(spark, d).select("chunk_id", "embedding")), "hnsw"), asked(spark, d), 10)


@query()
def hnsw_recall(spark, d):
    return hnsw.recall(hnsw_search(spark, d), dense.search_flat(vectors(spark, d), asked(spark, d), 10))


@query()
def content_hashes(spark, d):
    return corpus(spark, d).where("content is not null").select("path", scalars.fnv1a64(F.col("content")).alias("content_hash"))


@query()
def embed_documents(spark, d):
    return providers.embed_texts(texts(spark, d), providers.HashEmbedder).select("chunk_id", "embedding")


@query()
def grounded_answers(spark, d):
    asked_ = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), "text")
    docs = corpus(spark, d)
    ranked = bm25.search_texts(texts(spark, d), asked_)
    found = fusion.described(ranked, docs.select(F.col("doc_id").alias("chunk_id"), "doc_id", F.col("content").alias("text")), docs).select("qid", "rank", "chunk_id", F.col("path").alias("source"), "text")
    return providers.generate(context.build_prompts(asked_, found), providers.EchoGenerator)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in REGISTRY.items() if sql}
