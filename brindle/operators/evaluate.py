"""Quality of ranked results against labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def relevant_by_prefix(ranked: DataFrame, expected: DataFrame) -> DataFrame:
    """ranked (qid, rank, path) with relevant: whether the path starts with one of the query's prefixes; expected: (qid, prefixes)."""
    return ranked.join(expected, "qid", "left").withColumn("relevant", F.coalesce(F.exists("prefixes", lambda p: F.startswith(F.col("path"), p)), F.lit(False))).drop("prefixes")


def first_relevant(queries: DataFrame, judged: DataFrame) -> DataFrame:
    """(qid, rank) of the first relevant result, null for a miss."""
    first = judged.groupBy("qid").agg(F.min(F.when(F.col("relevant"), F.col("rank"))).alias("rank"))
    return queries.select("qid").join(first, "qid", "left")


def metrics(first: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """One row: n, hit_<k> and mrr of first ranks."""
    hits = [F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)).alias(f"hit_{k}") for k in ks]
    return first.agg(F.count(F.lit(1)).alias("n"), *hits, F.avg(F.coalesce(F.lit(1.0) / F.col("rank"), F.lit(0.0))).alias("mrr"))


def verdicts(a: DataFrame, b: DataFrame, name_a: str = "a", name_b: str = "b") -> DataFrame:
    """(qid, rank_a, rank_b, verdict) of two systems' first ranks: the better one's name, or tie; a miss is worse than any rank."""
    both = a.select("qid", F.col("rank").alias("rank_a")).join(b.select("qid", F.col("rank").alias("rank_b")), "qid")
    x, y = F.coalesce("rank_a", F.lit(1 << 30)), F.coalesce("rank_b", F.lit(1 << 30))
    return both.withColumn("verdict", F.when(x == y, "tie").when(x < y, name_a).otherwise(name_b))
