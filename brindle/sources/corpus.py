"""Corpora from folders, chunk tables as JSON lines, and record logs."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import has_extension
from ..plans.workspace import Store, dense_ids, written

#: What stands around a record's time and its speaker's tag: fixed values of the format.
HEADING, OPENING, CLOSING = "##", "(（", ")）"


def load_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, path, content binary, deleted) of the .md and .txt files below a folder, ids in path order.

    Spark's reader leaves out empty files and names that begin with a dot or underscore; those are
    listed by the driver (names alone) and added. A folder that does not exist raises.
    """
    store = Store(spark, folder)
    if not store.exists(""):
        raise FileNotFoundError(folder)
    root = store._path("")[0]
    base = store._path("")[1].makeQualified(root).toUri().getPath().rstrip("/") + "/"
    relative = lambda full: unquote(re.sub(r"^[a-z0-9]+:(//[^/]*)?(?=/)", "", full))[len(base) :]
    good = re.compile(r"[^/]\.(md|txt)$", re.I)
    left_out = [(path, size) for path, size in store.files() if good.search(path) and (size == 0 or any(p.startswith((".", "_")) for p in relative(path).split("/")))]
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{[mM][dD],[tT][xX][tT]}")
    docs = read.load(folder).where(F.col("length") > 0)
    plain = F.regexp_replace(F.expr("try_url_decode(replace(path, '+', '%2B'))"), r"^[a-z0-9]+:(//[^/]*)?(?=/)", "")
    out = docs.select(F.substring(plain, len(base) + 1, 1 << 20).alias("path"), "content")
    empty = [relative(p) for p, size in left_out if size == 0]
    if empty:
        out = out.unionByName(spark.createDataFrame([(p, bytearray()) for p in empty], "path string, content binary"))
    hidden = [p for p, size in left_out if size]
    if hidden:  # read one by one, by name
        rows = [(relative(p), bytearray(Store(spark, p.rpartition("/")[0]).read(p.rpartition("/")[2]))) for p in hidden]
        out = out.unionByName(spark.createDataFrame(rows, "path string, content binary"))
    out = out.where(has_extension(F.col("path"))).withColumn("deleted", F.lit(False)).dropDuplicates(["path"])
    return dense_ids(out, "doc_id", "path").select("doc_id", "path", "content", "deleted")


def write_chunk_lines(chunks: DataFrame, docs: DataFrame, folder: str) -> None:
    """One JSON object a line: id, doc_id, path, begin, end, text."""
    rows = chunks.join(docs.select("doc_id", "path"), "doc_id")
    rows.select(F.to_json(F.struct(F.col("chunk_id").alias("id"), "doc_id", "path", "begin", "end", "text")).alias("value")).write.mode("overwrite").text(folder)


def read_chunk_lines(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("id long, doc_id long, path string, begin long, end long, text string").json(folder).where("id is not null")


def write_evaluation(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def header_of(line: Column) -> Column:
    """(date, time, who) of a header line, or null: the heading, a date and a time in square brackets, and who speaks."""
    rest = _trimmed(F.substring(line, len(HEADING) + 1, 1 << 30))
    close = F.instr(rest, "]")
    words = F.split(F.substring(rest, F.lit(2), close - 2), r"\s+")
    shape = F.transform(words, lambda w: F.translate(w, "0123456789", "dddddddddd"))
    who = _trimmed(F.substring(rest, close + 1, F.length(rest)))
    timed = F.array_contains(F.array(F.lit("dddd-dd-dd dd:dd"), F.lit("dddd-dd-dd dd:dd:dd")), F.array_join(shape, " ")) & ~F.exists(words, lambda w: w.contains("d"))
    good = line.startswith(HEADING) & rest.startswith("[") & (close > 0) & timed & (who != "")
    return F.when(good, F.struct(words[0].alias("date"), F.substring(words[1], 1, 5).alias("time"), who.alias("who")))


def speaker_of(who: Column) -> Column:
    """(speaker, tag): a last part in round brackets, of either width, is the tag."""
    inner = F.regexp_replace(who, f"^[^{OPENING}]*[{OPENING}]", "")
    tag = F.substring(inner, F.lit(1), F.length(inner) - 1)
    tagged = F.substring(who, -1, 1).isin(*CLOSING) & (F.length(inner) < F.length(who)) & (tag != "")
    before = _trimmed(F.substring(who, F.lit(1), F.length(who) - F.length(inner) - 1))
    return F.struct(F.when(tagged, before).otherwise(who).alias("speaker"), F.when(tagged, tag).otherwise("").alias("tag"))


def parse_log(lines: DataFrame) -> DataFrame:
    """(line_no, when, speaker, tag, body) of the records in lines (line_no, line) of one log.

    A header line begins a record; lines before the first are dropped.
    """
    ranked = written(lines.select("line_no", "line").orderBy("line_no").withColumn("_row", F.monotonically_increasing_id()), "lines")
    return records(ranked.select(F.shiftright("_row", 33).alias("block"), "line_no", "line"))


def records(lines: DataFrame) -> DataFrame:
    """The records of lines (block, line_no, line), whose blocks are runs of lines that follow one another.

    Each block finds its lines' headers by itself; the last header before a block is a running maximum over the blocks, one row each.
    """
    marked = lines.withColumn("head", header_of(F.col("line")))
    own = F.when(F.col("head").isNotNull(), F.col("line_no"))
    before = Window.orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)
    blocks = marked.groupBy("block").agg(F.min("line_no").alias("begin"), F.max(own).alias("last")).select("block", F.max("last").over(before).alias("carried"))
    inside = Window.partitionBy("block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = marked.withColumn("record", F.last(own, ignorenulls=True).over(inside)).join(blocks, "block")
    placed = placed.withColumn("record", F.coalesce("record", "carried")).where("record is not null")
    is_head = F.col("line_no") == F.col("record")
    grouped = placed.groupBy("record").agg(F.max(F.when(is_head, F.col("head"))).alias("head"), F.array_sort(F.collect_list(F.when(~is_head, F.struct("line_no", "line")))).alias("rows"))
    said = speaker_of(F.col("head.who"))
    when = F.try_to_timestamp(F.concat_ws(" ", "head.date", "head.time"), F.lit("yyyy-MM-dd HH:mm"))
    return grouped.select(F.col("record").alias("line_no"), when.alias("when"), said["speaker"].alias("speaker"), said["tag"].alias("tag"), F.transform("rows", lambda r: r["line"]).alias("body"))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The records of one log: a file, or a folder whose files follow one another by name. It is read in splits; a line's number is its place in its split and the lines of the splits before, one row each."""
    row = F.monotonically_increasing_id()  # a split's lines are in one task, in order
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    lines = spark.read.text(path).select(at.alias("at"), row.alias("row"), F.col("value").alias("line"))
    before = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    splits = lines.groupBy("at").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n"))
    splits = splits.select("at", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return records(lines.join(splits, "at").select(F.col("at").alias("block"), (F.col("before") + F.col("row") - F.col("first") + 1).alias("line_no"), "line"))
