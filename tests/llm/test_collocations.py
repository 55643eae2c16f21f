import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from helpers import empty, odd_documents

from brindle.llm import collocations as co

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def brute(rows, least=30, longest=4, keep=2000):
    """The contract by loops over strings."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", text):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for m in range(1, longest + 1):
                for i in range(len(words) - m + 1):
                    f[lang, tuple(words[i : i + m])] += 1
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = []
    for (lang, p), a in cand.items():
        cuts = [(2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        if any(100 * b >= 80 * a and lang == other and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for (other, q), b in cand.items()):
            continue
        out.append((lang, -score, -a, " ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score))
    out.sort(key=lambda r: (r[0], r[1], r[2], r[3].encode()))
    ranks = Counter()
    rows = []
    for lang, _, _, phrase, a, l, r, total, score in out:
        ranks[lang] += 1
        if ranks[lang] <= keep:
            rows.append((lang, ranks[lang], phrase, a, l, r, total, score))
    return rows


def texts(seed, n=120):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "of", "and", "x-ray", "naïve", "a", "b", "c", "日本", "é e"] + [f"w{i}" for i in range(40)]
    weights = [30, 5, 25, 20, 8, 8, 20, 20, 20, 6, 4] + [1] * 40
    rows = []
    for _ in range(n):
        words = []
        while len(words) < rng.randrange(1, 150):
            words += rng.choice([["new", "york", "city", "hall"], ["new", "york"], [rng.choices(vocabulary, weights)[0]], [rng.choices(vocabulary, weights)[0] + rng.choice(".,;:!?\n\r\x0b\x0c")]])
        rows.append((rng.choice(["en", "en", "de", None, "und"]), rng.choice([" ", "  ", "\t"]).join(words)))
    return rows


@pytest.mark.parametrize("least,keep,cells,shard", [(30, 2000, co.CELLS, co.SHARD), (3, 2000, 1 << 15, 700), (2, 7, 1 << 12, 3000)])
def test_against_brute_force(spark, monkeypatch, least, keep, cells, shard):
    """Few cells let all pairs through, and small shards split every count; neither changes a row."""
    rows = texts(1) + [(None, None), ("en", ""), ("en", " \t"), ("de", "a " * 5000), ("en", "New York City Hall " * 40), ("en", "." * 100), ("", "of the of the " * 20)]
    rows += rows[:5]
    df = spark.createDataFrame([(*r, "x", 1, 2.0) for r in rows], "lang string, text string, phrase string, f int, score double").repartition(3)
    monkeypatch.setattr(co, "frequencies", lambda *a, own=co.frequencies: own(*a, shard=shard, cells=cells))
    got = co.collocations(df, least=least, keep=keep).orderBy("lang", "rank").collect()
    want = brute(rows, least, keep=keep)
    assert len(want) > 10
    assert [tuple(r[c] for c in COLUMNS) for r in got] == want


def test_bitmaps_follow_phrases_over_blocks():
    """Shifts carry bits into the next block of 64, also for words that stand everywhere; lots of one row change nothing."""
    rng = np.random.default_rng(3)
    place = rng.integers(0, 4, 1000)
    place[100:300] = 2
    opens = rng.random(1000) < 0.9
    opens[0] = False
    want = Counter()
    for i in range(1000):
        for m in (2, 3, 4):
            if i + m <= 1000 and opens[i + 1 : i + m].all():
                want[tuple(place[i : i + m].tolist())] += 1
    for lot in (1, 7, 1 << 16):
        got = Counter()
        for numbers, f in co.Bitmaps(place, opens).phrases(4, lot):
            for p, n in zip(numbers.tolist(), f.tolist()):
                got[tuple(p)] += n
        assert got == want


def test_against_sql(spark, small):
    got = co.op11_collocations(spark, small).toPandas()[COLUMNS]
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    want = con.sql(co.sql()).df()[COLUMNS]
    assert len(got) and sorted(map(tuple, got.values.tolist())) == sorted(map(tuple, want.values.tolist()))


def test_odd_and_empty_tables(spark):
    docs, rows = odd_documents(spark)
    got = co.collocations(docs, least=2).orderBy("lang", "rank").collect()
    assert [tuple(r[c] for c in COLUMNS) for r in got] == brute([(r[2], r[1]) for r in rows], 2)
    assert co.collocations(empty(spark)).count() == 0
    bad = spark.sql("SELECT 'en' AS lang, CAST(X'612062ff20612062ff20612062ff' AS STRING) AS text")
    assert co.collocations(bad, least=2).count() >= 1


def test_counts_past_64_bits(spark):
    """2000000 * a passes 64 bits; the score is exact."""
    a = 9_000_000_000_000_001
    df = spark.createDataFrame([("en", 1, "x", a + 7), ("en", 1, "y", a + 2), ("en", 2, "x y", a)], "lang string, words int, phrase string, f long")
    r = co.scored(df).collect()
    assert [(x.score, x.l, x.r) for x in r] == [(2000000 * a // (2 * a + 9), a + 7, a + 2)]
