"""The training-data pipeline: documents in, packed sequences out, each stage written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brindle.llm.common import documents, materialize
from brindle.llm.langid import language_stage
from brindle.llm.mixing import mixing_stage
from brindle.llm.neardup import dedup_stage
from brindle.llm.packing import packing_stage
from brindle.llm.pii import pii_stage

#: Each stage takes (spark, docs, sf_dir); all but the last return the columns of documents.
STAGES = [
    ("language", language_stage),
    ("near_dedup", dedup_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Trained models, minimum hashes and tokenizers have no form in SQL; tests/llm hold run() against its stages one by one, and the operators behind them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences of the documents of sf_dir. Each stage's table is written and read by the next; a null or empty table gives what its stages define."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
