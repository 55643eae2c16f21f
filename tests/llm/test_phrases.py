import hashlib
import random
from collections import Counter

import numpy as np
from helpers import empty, odd_documents, prose

from brindle.llm import phrases


def phrase_set(text):
    """The phrases of a text, by the definition."""
    known, at = set(), 0
    while at < len(text):
        end = at + 1
        while end <= len(text) and text[at:end] in known:
            end += 1
        known.add(text[at:end])
        at = end
    return known


def test_phrases_and_fingerprints():
    rng = random.Random(1)
    for text in ["", "a", "aa", "aaa", "abababab", "😀é" * 9, prose(rng, 60)]:
        ends = phrases.phrase_ends(text)
        assert {text[a:b] for a, b in zip([0, *ends], ends)} == phrase_set(text)
        assert (phrases.fingerprint(text) == phrases.least(phrases.phrase_hashes(text, ends))).all()


def test_shared_prefix_is_the_same_as_two_parses():
    rng = random.Random(2)
    for _ in range(60):
        text, after = prose(rng, rng.randrange(1, 60)), prose(rng, rng.randrange(0, 30))
        same = len(text) - len(text) // 4
        edited = text[:same] + after[: len(text) - same]
        a, e = phrases.both_fingerprints(text, edited, same)
        assert (a == phrases.fingerprint(text)).all() and (e == phrases.fingerprint(edited)).all()


def test_likeness_follows_the_phrase_sets():
    rng = random.Random(3)
    off = []
    for _ in range(40):
        a = prose(rng, 120)
        b = a[: rng.randrange(len(a))] + prose(rng, 60)
        x, y = phrase_set(a), phrase_set(b)
        off.append(phrases.likeness(phrases.fingerprint(a), phrases.fingerprint(b)) - len(x & y) / len(x | y))
    assert abs(np.mean(off)) < 0.03 and np.std(off) < 0.1


def test_rows_and_next_documents(spark):
    docs, rows = odd_documents(spark)
    got = phrases.fingerprints(docs.repartition(3)).collect()
    order = sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    want = []
    for i, (doc, text) in enumerate(order):
        after = order[(i + 1) % len(order)][1]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        f, e, g = (phrases.fingerprint(t) for t in (text, edited, after))
        want.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), phrases.text_form(f), phrases.text_form(e), phrases.likeness(f, e), phrases.likeness(f, g)))
    assert Counter(map(tuple, got)) == Counter(want)


def test_few_and_empty(spark):
    assert phrases.fingerprints(empty(spark)).count() == 0
    r = phrases.fingerprints(spark.createDataFrame([(5, "abcdefgh")], "doc_id long, text string")).first()
    assert r.near_next == 1.0 and r.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest()
