"""Filters and tallies of a log of records (line_no, when, speaker, tag, body)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import timestamp


def header(log: DataFrame | None = None) -> F.Column:
    suffix = F.when(F.coalesce(F.col("tag"), F.lit("")) != "", F.concat(F.lit("（"), F.col("tag"), F.lit("）"))).otherwise("")
    return F.concat(F.lit("## ["), F.date_format("when", "yyyy-MM-dd HH:mm"), F.lit("] "), F.col("speaker"), suffix)


def filter_log(log: DataFrame, speakers: list[str] | None = None, since: str | None = None, until: str | None = None, keywords: list[str] = (), recent: int = 0) -> DataFrame:
    """Records that pass every filter; with recent, the last so many of them in file order. A date alone is its midnight."""
    out = log
    if speakers:
        out = out.where(F.col("speaker").isin(*speakers))
    if since:
        out = out.where(F.col("when") >= timestamp(F.lit(since)))
    if until:
        out = out.where(F.col("when") <= timestamp(F.lit(until)))
    blob = F.lower(F.concat(header(), F.lit("\n"), F.array_join("body", "\n")))
    for word in keywords:
        out = out.where(F.instr(blob, word.lower()) > 0)
    if recent > 0:
        last = out.orderBy(F.desc("line_no")).limit(recent)
        out = last.orderBy("line_no")
    return out


def speaker_tally(log: DataFrame) -> DataFrame:
    return log.groupBy("speaker").agg(F.count(F.lit(1)).alias("n")).orderBy("speaker")
