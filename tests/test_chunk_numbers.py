"""Chunks get their ids without a sort of their texts."""

from brindle.operators import chunking


def test_texts_are_not_sorted(spark):
    """Where the numbers are too many for a broadcast, a task's memory has its share of them, and no texts."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = spark.createDataFrame([(i, " ".join(["w"] * (700 if i % 3 == 0 else 5)), False) for i in range(30)], "doc_id long, content string, deleted boolean")
        made = chunking.chunk_documents(docs.repartition(3))
        plan = made._jdf.queryExecution().executedPlan().toString()
        join = next(x for x in plan.splitlines() if "Join" in x and "doc_id" in x)
        assert "ShuffledHashJoin" in join and "SortMergeJoin" not in plan
        found = [(r["chunk_id"], r["doc_id"]) for r in made.orderBy("chunk_id").collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert found == list(enumerate(d for d in range(30) for _ in range(2 if d % 3 == 0 else 1)))
