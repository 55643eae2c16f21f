"""Reciprocal rank fusion, hybrid retrieval and route labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RRF_K, ROUTE_K, SHOWN = 60, 20, 10


def rrf_fuse(*lists: DataFrame, k: int = RRF_K) -> DataFrame:
    """(qid, rank, chunk_id, score) of ranked lists (qid, rank from 1, chunk_id).

    An id that a list repeats counts once, at its first place; places after it keep their number. The
    parts of a score are added in the order of the lists, at most one a list.
    """
    first = [x.groupBy("qid", "chunk_id").agg(F.min("rank").alias("rank")).withColumn("list", F.lit(i)) for i, x in enumerate(lists)]
    both = reduce(DataFrame.unionByName, first)
    parts = F.array_sort(F.collect_list(F.struct("list", "rank")))
    total = F.aggregate("parts", F.lit(0.0), lambda s, x: s + F.lit(1.0) / (F.lit(float(k)) + x["rank"]))
    fused = both.groupBy("qid", "chunk_id").agg(parts.alias("parts")).select("qid", "chunk_id", total.cast("float").alias("score"))
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "chunk_id")
    return fused.withColumn("rank", F.row_number().over(best)).select("qid", "rank", "chunk_id", "score")


def hybrid(bm25: DataFrame, dense: DataFrame | None, route_k: int = ROUTE_K, shown: int | None = SHOWN) -> DataFrame:
    """Both routes' first route_k fused, for queries with any dense result; BM25's own order and scores for the others."""
    lexical = bm25.where(F.col("rank") <= route_k)
    if dense is None:
        out = lexical
    else:
        dense = dense.where(F.col("rank") <= route_k)
        with_dense = dense.select("qid").distinct()
        fused = rrf_fuse(lexical.join(with_dense, "qid", "left_semi"), dense)
        out = fused.unionByName(lexical.join(with_dense, "qid", "left_anti"))
    return out.where(F.col("rank") <= shown) if shown is not None else out


def route_scores(ranked: DataFrame, bm25: DataFrame, dense: DataFrame, route_k: int = ROUTE_K) -> DataFrame:
    """ranked with bm25_score, dense_score (null where the route has no such row) and the route's label."""
    own = lambda d, name: d.where(F.col("rank") <= route_k).select("qid", "chunk_id", F.col("score").alias(name))
    out = ranked.join(own(bm25, "bm25_score"), ["qid", "chunk_id"], "left").join(own(dense, "dense_score"), ["qid", "chunk_id"], "left")
    label = F.when(F.col("bm25_score").isNotNull() & F.col("dense_score").isNotNull(), "bm25+vec").when(F.col("bm25_score").isNotNull(), "bm25").otherwise("vec")
    return out.withColumn("route", label)


def score_text(score: str, digits: int = 6) -> F.Column:
    """A score for display, - where there is none: so many digits at most, no zeros at the end, an exponent below 0.0001 and beyond the digits."""
    x = F.col(score).cast("double")
    e = F.format_string(f"%.{digits - 1}e", x)
    plain = F.regexp_replace(e.try_cast("decimal(38,18)").cast("string"), r"\.?0+$", "")
    near = F.substring_index(e, "e", -1).try_cast("int").between(-4, digits - 1)
    return F.when(x.isNull(), "-").when(near, plain).otherwise(F.regexp_replace(e, r"\.?0+e", "e"))


def printed(ranked: DataFrame, bm25: DataFrame, dense: DataFrame | None, chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """(qid, rank, line): each result as a console shows it; the routes' scores stand in the results of queries that both routes answered."""
    dense = bm25.limit(0) if dense is None else dense
    found = described(route_scores(ranked, bm25, dense), chunks, docs).join(dense.select("qid", F.lit(True).alias("fused")).distinct(), "qid", "left")
    scores = F.when(F.col("fused"), F.concat(F.lit("rrf="), score_text("score"), F.lit("  bm25="), score_text("bm25_score"), F.lit("  vec="), score_text("dense_score"))).otherwise(F.concat(F.lit("score="), score_text("score")))
    return found.select("qid", "rank", F.concat(F.lit("["), "rank", F.lit("] "), scores, F.lit("  doc="), "path", F.lit("\n    "), F.coalesce("text", F.lit(""))).alias("line"))


def described(ranked: DataFrame, chunks: DataFrame, docs: DataFrame, show_deleted: bool = True) -> DataFrame:
    """ranked with doc_id, path and text; ids that no table has are left out; hidden rows close the ranks."""
    out = ranked.join(chunks.select("chunk_id", "doc_id", "text"), "chunk_id").join(docs.select("doc_id", "path", "deleted"), "doc_id")
    if not show_deleted:
        out = out.where(~F.col("deleted")).withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("rank")))
    return out.drop("deleted")
