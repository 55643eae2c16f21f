"""Differences between generations of a corpus, tombstones, and reuse of what is already computed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diff_corpora(old: DataFrame, new: DataFrame, unchanged: bool = False) -> DataFrame:
    """(path, change) with change added, removed or edited (unchanged on request): one full outer join on the path."""
    a = old.select("path", F.col("content").alias("old_content"), F.lit(True).alias("in_old"))
    b = new.select("path", F.col("content").alias("new_content"), F.lit(True).alias("in_new"))
    change = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").when(~F.col("old_content").eqNullSafe(F.col("new_content")), "edited").otherwise("unchanged")
    out = a.join(b, "path", "full_outer").select("path", change.alias("change"))
    return out if unchanged else out.where("change <> 'unchanged'")


def change_counts(diff: DataFrame) -> DataFrame:
    return diff.groupBy("change").agg(F.count(F.lit(1)).alias("n"))


def inherit_tombstones(old: DataFrame, new: DataFrame) -> DataFrame:
    """new with deleted set where the old generation had the path deleted, and inherited where that is news."""
    gone = old.where("deleted").select("path", F.lit(True).alias("_gone")).distinct()
    out = new.join(gone, "path", "left").withColumn("inherited", F.col("_gone").isNotNull() & ~F.col("deleted"))
    return out.withColumn("deleted", F.col("deleted") | F.col("_gone").isNotNull()).drop("_gone")


def manifest(docs: DataFrame) -> DataFrame:
    """(path, content_hash): what two generations of a corpus are compared by; ids and tombstones have no part in it."""
    return docs.select("path", F.sha2(F.col("content").cast("binary"), 256).alias("content_hash"))


def manifest_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row with the number of paths whose hash differs or that one side lacks."""
    b = new.select("path", F.col("content_hash").alias("new_hash"))
    return old.join(b, "path", "full_outer").agg(F.count(F.when(~F.col("content_hash").eqNullSafe(F.col("new_hash")), 1)).alias("n_changed"))


def tombstone(docs: DataFrame, doc_id: int) -> DataFrame:
    """docs with one document marked as deleted."""
    return docs.withColumn("deleted", F.col("deleted") | (F.col("doc_id") == F.lit(doc_id)))


def doc_list(docs: DataFrame) -> DataFrame:
    """(doc_id, deleted, n_bytes, path)."""
    return docs.select("doc_id", "deleted", F.octet_length("content").cast("long").alias("n_bytes"), "path")


def category_counts(docs: DataFrame) -> DataFrame:
    from ..functions.scalars import category

    return docs.groupBy(category(F.col("path")).alias("category")).agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("deleted").cast("long")).alias("n_deleted"))


def document_tree(docs: DataFrame) -> DataFrame:
    """(place, category, path, deleted): the documents as a tree shows them, categories and then paths in ascending order of bytes."""
    from ..functions.scalars import category
    from ..plans.workspace import dense_ids

    return dense_ids(docs.select(category(F.col("path")).alias("category"), "path", "deleted"), "place", "category", "path").select("place", "category", "path", "deleted")


def reuse_plan(docs: DataFrame, cache: DataFrame) -> DataFrame:
    """docs (path, content_hash, n_chunks) with reuse: whether cache (path, content_hash, n_chunks) has the same path, hash and number of chunks."""
    known = cache.select("path", "content_hash", "n_chunks", F.lit(True).alias("_known")).distinct()
    return docs.join(known, ["path", "content_hash", "n_chunks"], "left").withColumn("reuse", F.col("_known").isNotNull()).drop("_known")


def reuse_counts(plan: DataFrame) -> DataFrame:
    chunks = lambda keep: F.coalesce(F.sum(F.when(keep, F.col("n_chunks")).otherwise(0)), F.lit(0)).cast("long")
    return plan.agg(chunks(F.col("reuse")).alias("n_reused"), chunks(~F.col("reuse")).alias("n_embedded"))
