"""Graphs over groups of near copies: links must lead out of a group, and every question finds nearly all of its results."""

import numpy as np

from brindle.operators.hnsw import Graph


def test_questions_find_their_results_among_groups_of_near_copies():
    rng = np.random.default_rng(3)
    first = rng.normal(size=(100, 64))
    x = (first[:, None] + 0.04 * rng.normal(size=(100, 25, 64))).reshape(-1, 64)
    x = (x / np.linalg.norm(x, axis=1)[:, None])[rng.permutation(2500)]
    graph = Graph(np.arange(2500), x)
    assert all(len(near) <= 32 for near in graph.layers[0].values()) and all(len(near) <= 16 for layer in graph.layers[1:] for near in layer.values())
    hits = [len({n for n, _ in graph.search(q, 10)} & set(np.argsort(-(x @ q), kind="stable")[:10].tolist())) for q in x[:100]]
    assert min(hits) >= 9
