"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by exact length. Each source's target is met by whole copies of the source
plus a remaining budget; a bounded-knapsack dynamic program chooses how many documents of each
length fill that budget, and a seeded order chooses which documents of a length those are.

Defined results: a null text has size 0 and is never taken; a null source is a source of its own,
last in order; a source of size 0 has target 0; repeated rows count one by one, and rows of one id and text are alike to the draw; an empty table gives
an empty result; further columns of the input pass through, and columns named like the results are
replaced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, materialize, shielded

WORD = r"[^\x20\x09-\x0D]+"
#: Words that the dynamic program fits exactly; larger budgets are first filled by length counts.
DP_WORDS = 1 << 15
#: Seeded buckets of one length; only the documents of one bucket are ranked one by one.
BUCKETS = 4096


def subset_counts(lengths: np.ndarray, counts: np.ndarray, budget: int, dp_words: int = DP_WORDS) -> np.ndarray:
    """How many documents of each length to take, so that the lengths sum to budget or as near below as the program finds."""
    taken = np.zeros(len(lengths), np.int64)
    total = int((lengths * counts).sum())
    if budget <= 0 or total == 0:
        return taken
    if budget >= total:
        return counts.astype(np.int64)
    # in proportion to the counts, but for a remainder that the program can fit
    taken = np.minimum(counts, (counts * (max(0, budget - dp_words // 4) / total)).astype(np.int64))
    rest = budget - int((lengths * taken).sum())
    order = np.argsort(-lengths, kind="stable")
    for i in order:
        if rest <= dp_words:
            break
        n, size = int(counts[i] - taken[i]), int(lengths[i])
        k = min(n, -(-(rest - dp_words) // size), rest // size)
        taken[i] += k
        rest -= k * size
    rest, window = min(rest, dp_words), (1 << (min(rest, dp_words) + 1)) - 1
    reach, steps = 1, []
    for i in order:
        n, size, part = int(counts[i] - taken[i]), int(lengths[i]), 1
        if size > rest:
            continue
        n = min(n, rest // size)
        while n > 0 and not reach >> rest & 1:
            k = min(part, n)
            new = (reach << k * size) & window & ~reach
            if new:
                steps.append((new, int(i), k))
                reach |= new
            n, part = n - k, part * 2
        if reach >> rest & 1:
            break
    s = reach.bit_length() - 1
    for new, i, k in reversed(steps):
        if new >> s & 1:
            taken[i] += k
            s -= k * int(lengths[i])
    return taken


def source_plan(lengths: np.ndarray, counts: np.ndarray, budget: int, most_copies: int) -> np.ndarray:
    """Copies to take of each length: whole copies of the source and a subset; where that leaves a gap, documents may be repeated unevenly."""
    whole = int((lengths * counts).sum())
    if not whole:
        return np.zeros(len(lengths), np.int64)
    copies = min(budget // whole, most_copies)
    even = counts * copies + (subset_counts(lengths, counts, budget - copies * whole) if copies < most_copies else 0)
    if int((even * lengths).sum()) == budget:
        return even
    uneven = subset_counts(lengths, counts * most_copies, budget)
    return max(even, uneven, key=lambda x: int((x * lengths).sum()))


def _planner(most_copies: int):
    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size", ignore_index=True)
        counts = pdf["n"].to_numpy(np.int64)
        total = source_plan(pdf["size"].to_numpy(np.int64), counts, int(round(float(pdf["target"].iloc[0]))), most_copies)
        return pdf.assign(copies=total // counts, extra=total % counts)[["source_key", "source_size", "target", "size", "copies", "extra"]]

    return plan


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (1, 2, 3), share: float = 1.0, most_copies: int = 3, seed: int = 17) -> DataFrame:
    """docs with size, source_size, target, copies and taken (= size * copies).

    weights repeat over the sources in code-point order, null last; share is the part of all sizes
    that the mix has; a target stops at most_copies times its source's size.
    """
    extra_names = {"size", "source_size", "target", "copies", "taken", "source_key", "bucket", "draw"}
    base = (
        docs.drop(*[c for c in extra_names if c not in (id_col, text_col, source_col)])
        .withColumn("size", F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long"))
        .withColumn("source_key", F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("~")))
        .withColumn("draw", F.xxhash64(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(text_col)))
        .withColumn("bucket", F.pmod("draw", F.lit(BUCKETS)).cast("int"))
    )
    # "~" sorts after every "s..." key, so null comes last
    counted = materialize(base.groupBy("source_key", "size", "bucket").agg(F.count(F.lit(1)).alias("n")), "mixing")
    sources = counted.groupBy("source_key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    rank = F.row_number().over(Window.orderBy("source_key")) - 1
    sources = materialize(sources.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))), "sources")
    cap = F.col("source_size") * F.lit(float(most_copies))
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0] * share
    level, before = 0.0, -1.0
    while level != before:
        over = cap <= F.col("w") * F.lit(level)
        held, free = sources.agg(F.coalesce(F.sum(F.when(over, cap)), F.lit(0.0)), F.coalesce(F.sum(F.when(~over, F.col("w"))), F.lit(0.0))).first()
        level, before = (max(level, (total - held) / free) if free else level), level
    sources = sources.select("source_key", "source_size", F.least(cap, F.col("w") * F.lit(level)).alias("target"))
    by_size = counted.groupBy("source_key", "size").agg(F.sum("n").alias("n")).where("size > 0").join(sources, "source_key")
    plan = materialize(by_size.groupBy("source_key").applyInPandas(_planner(most_copies), "source_key string, source_size long, target double, size long, copies long, extra long"), "plan")
    so_far = Window.partitionBy("source_key", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    decided = (
        counted.withColumn("before", F.coalesce(F.sum("n").over(so_far), F.lit(0)))
        .join(plan.select("source_key", "size", "copies", "extra"), ["source_key", "size"], "left")
        .join(sources, "source_key")
        .select("source_key", "size", "bucket", "source_size", "target", F.coalesce("copies", F.lit(0)).alias("base_copies"), (F.coalesce("extra", F.lit(0)) - F.col("before")).alias("more"))
    )
    place = F.row_number().over(Window.partitionBy("source_key", "size", "bucket").orderBy("draw", id_col))
    out = base.join(decided, ["source_key", "size", "bucket"]).withColumn("copies", F.col("base_copies") + F.when(place <= F.col("more"), 1).otherwise(0))
    return out.withColumn("taken", F.col("size") * F.col("copies")).drop("source_key", "bucket", "draw", "base_copies", "more")


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    mixed = mix_sources(documents(spark, sf_dir).select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source")


def mixing_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the mix takes, each as often as it takes it, with all their columns, whatever those are called."""
    plain, own, back = shielded(docs)
    mixed = mix_sources(plain, own["doc_id"], own["text"], own["source"]).where("copies > 0")
    return mixed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*back)
