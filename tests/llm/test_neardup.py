import random
from collections import Counter, defaultdict

import numpy as np
from helpers import empty, odd_documents, prose

from brindle.llm import neardup
from brindle.llm.common import doc_shingles
from brindle.llm.components import components


def edited(rng, text, n):
    words = text.split()
    for i in rng.sample(range(len(words)), n):
        words[i] = "".join(rng.choice("bcdfgh") for _ in range(7))
    return " ".join(words)


def planted(seed=1):
    """Groups of copies: exact, near, some too far; one group large and one passage in many documents."""
    rng = random.Random(seed)
    rows, passage = [], prose(rng, 60)
    for i in range(80):
        base = prose(rng, 150)
        rows.append(base)
        if i % 4 == 0:
            rows += [base, edited(rng, base, 1), edited(rng, base, 2), edited(rng, base, 12)]
        if i % 3 == 0:
            rows += [f"{prose(rng, 40)} {passage} {prose(rng, 40)}"]
    base = prose(rng, 200)
    rows += [edited(rng, base, rng.randrange(0, 9)) for _ in range(60)]
    rng.shuffle(rows)
    return rows


def brute(texts, idf, similarity=0.8):
    sets = [neardup.weighted(s, idf) for _, s in doc_shingles(texts)]
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i][0]) and len(sets[j][0]) and (texts[i] == texts[j] or neardup.weighted_jaccard(sets[i], sets[j]) >= similarity):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return [root(i) for i in range(len(texts))]


def classes_match(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    counts, n = neardup.sketch_frequencies(df.select("text"), 5)
    assert n == len(texts)
    got = {r.doc_id: r.class_id for r in neardup.classes(df).collect()}
    want = brute(texts, neardup.idf_of(counts, n))
    assert [got[i] for i in range(len(texts))] == want
    return want


def test_against_all_pairs(spark):
    want = classes_match(spark, planted())
    assert max(Counter(want).values()) > 20


def test_crowded_buckets_are_searched_whole(spark, monkeypatch):
    monkeypatch.setattr(neardup, "FIRST_PARTNERS", 1)
    monkeypatch.setattr(neardup, "BLOCK", 8)
    monkeypatch.setattr(neardup, "TEXT_BLOCK", 8)
    asked, plain = [], neardup.asked_in_blocks

    def seen(buckets, texts_asked, *rest):
        asked.append(texts_asked.count())
        return plain(buckets, texts_asked, *rest)

    monkeypatch.setattr(neardup, "asked_in_blocks", seen)
    rng = random.Random(4)
    base = prose(rng, 300)
    classes_match(spark, planted(2) + [edited(rng, base, 6) for _ in range(120)])
    assert sum(asked) > 0


def test_pairs_just_above_the_threshold_are_found(spark):
    rng = random.Random(11)
    texts, at = [], []
    for _ in range(400):
        base = prose(rng, 200)
        texts += [base, edited(rng, base, 4)]  # 176 of 216 shingles
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.class_id for r in neardup.classes(df).collect()}
    sets = [neardup.weighted(s, np.ones(neardup.CELLS)) for _, s in doc_shingles(texts)]
    at = [neardup.weighted_jaccard(sets[i], sets[i + 1]) for i in range(0, len(texts), 2)]
    near = [i for i, x in enumerate(at) if 0.8 <= x < 0.87]
    assert len(near) > 300
    assert sum(got[2 * i] == got[2 * i + 1] for i in near) >= 0.99 * len(near)


def test_weights_of_rare_shingles_do_not_depend_on_the_size():
    rng = np.random.default_rng(2)
    for load in (0, 20, 2000):
        counts = rng.poisson(load, neardup.CELLS)
        counts[:10] += 100_000
        idf = neardup.idf_of(counts, 1_000_000)
        assert (idf[10:] > 0.999).mean() > 0.99
        assert (idf[:10] < 0.65).all()


def test_samples_agree_as_often_as_weighted_jaccard():
    rng = np.random.default_rng(3)
    pool = rng.integers(1, 1 << 63, 4000, dtype=np.uint64)
    found = []
    for k in range(60):
        a = np.unique(rng.choice(pool, 300))
        b = np.union1d(rng.choice(a, len(a) * 3 // 4, replace=False), rng.choice(pool, 60))
        wa, wb = rng.uniform(0.5, 3, len(a)), None
        weights = dict(zip(a.tolist(), wa))
        wb = np.asarray([weights.get(x, 1.0) * rng.uniform(0.8, 1.2) for x in b.tolist()])
        j = neardup.weighted_jaccard((a, wa), (b, wb))
        found.append((neardup.sample(a, wa) == neardup.sample(b, wb)).mean() - j)
    assert abs(np.mean(found)) < 0.02 and np.std(found) < 0.09


def test_odd_tables(spark):
    docs, rows = odd_documents(spark)
    got = neardup.classes(docs)
    assert got.columns == [*docs.columns, "class_id", "n_class"]
    out = got.collect()
    assert Counter((r.doc_id, r.text) for r in out) == Counter(r[:2] for r in rows)
    by = defaultdict(set)
    for r in out:
        by[r.text].add(r.class_id)
        if r.text is None or not r.text.strip():
            assert r.class_id == r.doc_id and r.n_class == 1
    assert by[rows[3][1]] == {3} and by[rows[7][1]] == {7} and by["x"] == {1003}
    assert neardup.classes(empty(spark)).count() == 0


def test_stage_keeps_one_of_each(spark):
    docs, rows = odd_documents(spark)
    own = docs.select("doc_id", "text", "lang", "source", "n_chars")
    out = neardup.dedup_stage(spark, own, "")
    assert out.columns == own.columns
    texts = Counter(r.text for r in out.collect() if r.text and r.text.strip())
    assert set(texts.values()) == {1} and set(texts) == {r[1] for r in rows if r[1] and r[1].strip()}


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(50)] + [(5, 5)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[x] == root(x) for a, b in edges for x in (a, b) if a != b)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
