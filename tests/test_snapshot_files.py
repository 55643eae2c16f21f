"""How a snapshot's postings are dealt into files."""

import uuid
from pathlib import Path

from pyspark.sql import functions as F

from brindle.operators import bm25
from brindle.plans.workspace import Store
from brindle.sources.snapshot import IndexSnapshot


def test_a_word_of_all_chunks_lies_in_several_files(spark, tmp_path):
    """Postings are dealt by term and chunk: else those of one common word are one task's."""
    n = 4000
    postings = spark.range(n).select(F.lit("the").alias("term"), F.col("id").alias("chunk_id"), F.lit(1).alias("tf"), F.lit(1).alias("dl"))
    index = bm25.Index(postings, postings.select("chunk_id", "dl"), postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")), bm25.corpus_stats(postings))
    docs = spark.createDataFrame([(0, "p", "the", False)], "doc_id long, path string, content string, deleted boolean")
    chunks = spark.createDataFrame([(0, 0, 0, 3)], "chunk_id long, doc_id long, begin long, end long")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        root = f"{tmp_path}/{uuid.uuid4().hex}"
        assert IndexSnapshot(spark, root).save(docs, chunks, index)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    files = spark.read.parquet(str(next(Path(root).glob("v-*/postings")))).groupBy("_metadata.file_name").agg(F.count(F.lit(1)).alias("n"), F.min("chunk_id").alias("a"), F.max("chunk_id").alias("b")).orderBy("file_name").collect()
    assert len(files) > 1 and max(r["n"] for r in files) < n // 2 and all(x["b"] < y["a"] for x, y in zip(files, files[1:]))
    assert Store(spark, root).exists("CURRENT")
