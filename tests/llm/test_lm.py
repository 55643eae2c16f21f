import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import empty, odd_documents

from brindle.llm import lm


def crc(i):
    return zlib.crc32(("" if i is None else str(i)).encode())


def test_counts_and_base_scores(spark):
    docs, rows = odd_documents(spark, 150)
    got = lm.score_documents(docs).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    counts = Counter()
    for r in rows:
        if crc(r[0]) % 7 != 2:
            counts.update(lm.tokens(r[1]))
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for r in rows:
        t = lm.tokens(r[1])
        want[r[0], crc(r[0]) % 7 == 2, len(t), sum(counts[w] > 0 for w in t), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t), 6)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def test_empty(spark):
    assert lm.score_documents(empty(spark)).count() == 0
    r = lm.score_documents(spark.createDataFrame([(None, None)], "doc_id long, text string")).first()
    assert (r.n_tokens, r.train_tokens) == (1, 1)


def test_tokens():
    assert lm.tokens("A\x0bB  ÉÀ\x85x\x1c") == [b"a", b"b", "ÉÀ\x85x\x1c".encode(), b""] and lm.tokens(None) == [b""]


def test_model_beats_the_base_on_held_out_text(spark):
    rng = random.Random(1)
    follows = {w: rng.sample("abcdefghijklmnopqrst", 2) for w in "abcdefghijklmnopqrst"}
    rows = []
    for i in range(1500):
        w = [rng.choice("abcdefghijklmnopqrst")]
        while len(w) < 60:
            w.append(rng.choice(follows[w[-1]]))
        rows.append((i, " ".join(w)))
    got = lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).where("held_out").agg({"score": "sum", "base_score": "sum"}).first()
    assert got["sum(score)"] > 0.8 * got["sum(base_score)"]


def test_every_context_is_normalised():
    rng = np.random.default_rng(2)
    p = lm.Params.start(rng.random(40))
    for a in (p.target, p.context, p.scale):
        a += rng.normal(0, 0.5, a.shape)
    far, near, norm = p.tables()
    for two in range(40):
        for one in range(40):
            logs = far[two].astype(float) + near[one] - norm[two, one]
            assert np.exp(np.delete(logs, lm.BEGIN)).sum() == pytest.approx(1, abs=1e-4)


def test_step_gradient_lowers_the_nce_loss():
    rng = np.random.default_rng(3)
    share = np.full(20, 0.05)
    triples = np.stack([rng.integers(0, 20, 5000), np.arange(5000) % 20, (np.arange(5000) % 20 + 1) % 20], 1)
    p = lm.Params.start(share)
    memory = [np.zeros_like(getattr(p, n)) for n in lm.Params.NAMES]
    for _ in range(3):
        lm.train_nce(p, share, triples, np.ones(5000), rng, memory)
    far, near, _ = p.tables()
    assert np.mean([near[w].argmax() == (w + 1) % 20 for w in range(20) if w != lm.BEGIN and (w + 1) % 20 != lm.BEGIN]) > 0.9


def test_scores_are_the_models_token_by_token(spark, monkeypatch):
    """score, summed up anew over each text: class by its definition, exact normaliser over all classes, add-one share inside a class."""
    held = {}
    real = lm.train
    monkeypatch.setattr(lm, "train", lambda parts, share, *a: held.setdefault("params", real(parts, share, *a)))
    docs, rows = odd_documents(spark, 120)
    got = lm.score_documents(docs, n_classes=60, n_endings=20).collect()
    p = held["params"]
    counts = Counter()
    for r in rows:
        if crc(r[0]) % 7 != 2:
            counts.update(lm.tokens(r[1]))
    words = sorted((w for w in counts if w), key=lambda w: (-counts[w], w))[: 60 - 20 - 3]
    tails, kinds = Counter(), Counter()
    for w in counts:
        if w and w not in words:
            tails[w[-3:]] += counts[w]
            kinds[w[-3:]] += 1
    endings = sorted(tails, key=lambda e: (-tails[e], e))[:20]
    own = {w: i + 3 for i, w in enumerate(words)} | {b"": lm.END}
    shared = {e: i + 3 + len(words) for i, e in enumerate(endings)}
    of = lambda w: own.get(w, shared.get(w[-3:], lm.UNKNOWN))
    tokens_in, distinct_in = Counter(), Counter()
    for w in counts:
        tokens_in[of(w)] += counts[w]
        distinct_in[of(w)] += 1
    alone = set(own.values())
    legal = np.arange(3 + len(words) + len(endings)) != lm.BEGIN
    want = {}
    for doc, text, *_ in rows:
        two = one = lm.BEGIN
        total = 0.0
        for w in lm.tokens(text):
            made = p.context[two] * p.scale[0] + p.context[one] * p.scale[1]
            logits = p.target.astype(float) @ made + p.bias
            k = of(w)
            total += (logits[k] - np.log(np.exp(logits[legal]).sum())) / math.log(10)
            if k not in alone:
                total += math.log10((counts[w] + 1) / (tokens_in[k] + distinct_in[k] + 1))
            two, one = one, k
        want.setdefault(doc, []).append(total)
    for r in got:
        assert any(r.score == pytest.approx(w, rel=1e-4, abs=1e-3) for w in want[r.doc_id])


def test_small_parts_score_alike(spark, monkeypatch):
    docs, _ = odd_documents(spark, 100)
    columns = ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score"]
    whole = sorted(map(str, (tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in lm.score_documents(docs).select(columns).collect())))
    monkeypatch.setattr(lm, "GROUP_DOCS", 7)
    parted = lm.score_documents(docs.repartition(3)).select(columns).collect()
    assert sorted(map(str, (tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in parted))) == whole
