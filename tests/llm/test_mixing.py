import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
from helpers import empty, odd_documents

from brindle.llm import mixing


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def targets(sizes, weights=(1, 2, 3), most=3):
    """By rounds of resharing, in exact order of sources."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in full]
        left = total - sum(most * sizes[s] for s in full)
        out = {s: most * sizes[s] if s in full else left * w[s] / sum(w[x] for x in free) for s in names}
        over = {s for s in free if out[s] > most * sizes[s]}
        if not over:
            return out
        full |= over


def test_mix(spark):
    docs, rows = odd_documents(spark, 200)
    got = mixing.mix_sources(docs).select("doc_id", "source", "size", "source_size", "target", "taken", "copies", "lang").collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += size(r[1])
    want, taken = targets(sizes), Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and r.taken == r.size * r.copies and r.copies <= 3
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1 or want[s] < 200 and taken[s] <= want[s] + 1
    again = mixing.mix_sources(docs.repartition(3)).select("doc_id", "source", "size", "source_size", "target", "taken", "copies", "lang").collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    assert mixing.mix_sources(empty(spark)).count() == 0


def test_hot_source_reshares(spark):
    rows = [(i, "w " * 10, "a") for i in range(90)] + [(100 + i, "w " * 10, "b") for i in range(2)] + [(200, "", "c")]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {r.source: r.target for r in got} == pytest.approx({"a": 860.0, "b": 60.0, "c": 0.0})
    assert sum(r.taken for r in got) == 920 and all(r.taken <= 3 * r.size for r in got)


def test_subset_counts_against_all_subsets():
    rng = random.Random(3)
    for _ in range(150):
        lengths = sorted(rng.sample(range(1, 30), rng.randrange(1, 5)))
        counts = [rng.randrange(1, 4) for _ in lengths]
        budget = rng.randrange(0, sum(a * b for a, b in zip(lengths, counts)) + 3)
        took = mixing.subset_counts(np.asarray(lengths), np.asarray(counts), budget)
        assert (took <= counts).all() and (took >= 0).all()
        got = int((took * lengths).sum())
        sums = {sum(a * b for a, b in zip(lengths, k)) for k in itertools.product(*[range(c + 1) for c in counts])}
        assert got <= budget and got in sums
        # proportional counts come first; with all left to the program the fit is the best there is
    exact = mixing.subset_counts(np.asarray([7, 11, 13]), np.asarray([100, 100, 100]), 1009)
    assert int((exact * [7, 11, 13]).sum()) == 1009


def test_stage_repeats_rows(spark):
    docs, rows = odd_documents(spark, 120)
    own = docs.select("doc_id", "text", "lang", "source", "n_chars")
    out = mixing.mixing_stage(spark, own, "")
    assert out.columns == own.columns
    copies = mixing.mix_sources(own).agg({"copies": "sum"}).first()[0]
    zero = mixing.mix_sources(own).where("size = 0").agg({"copies": "sum"}).first()[0]
    assert out.count() == copies and zero == 0
