"""Exact scores of blocks: a product finds the candidates, sums from left to right decide."""

import numpy as np
import pyarrow as pa

from brindle.operators import dense


def scored(q, x, ids, k):
    cols = [np.arange(len(q)), q, ids, x]
    b = pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in cols], names=["qids", "q", "ids", "x"])
    return list(dense._scored(iter([b]), q.shape[1], k))


def test_large_blocks_of_queries_are_scored_in_parts_with_the_rows_of_a_scan():
    rng = np.random.default_rng(5)
    for q, x in ((rng.normal(size=(1100, 24)), rng.normal(size=(300, 24))), (np.round(rng.normal(size=(700, 4))), np.round(rng.normal(size=(300, 4)))), (np.ones((600, 2)), np.append(rng.normal(size=(50, 2)), [[np.inf, 1.0]], 0))):
        ids = rng.permutation(len(x)).astype(np.int64)
        made = scored(q, x, ids, 7)
        s = np.zeros((len(q), len(x)))
        for j in range(q.shape[1]):
            s += q[:, j, None] * x[None, :, j]
        s = s.astype(np.float32)
        want = [(i, int(ids[c]), float(s[i, c])) for i in range(len(q)) for c in np.lexsort((ids, -s[i]))[:7]]
        assert [tuple(r.values()) for b in made for r in b.to_pylist()] == want
        assert len(made) == -(-len(q) // dense.QUERY_BLOCK)
