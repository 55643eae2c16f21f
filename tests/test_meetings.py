"""Questions and blocks meet by a shuffle."""

import numpy as np

from brindle.operators import routing


def test_meetings_of_blocks_are_never_broadcast(spark):
    x = np.random.default_rng(6).normal(size=(200, 8))
    v = spark.createDataFrame([(i, r) for i, r in enumerate(x.tolist())], "chunk_id long, embedding array<double>")
    found = routing.search_bounded(routing.in_blocks(v, 4, 32), v.where("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "qid"), 5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan and found.count() == 50
