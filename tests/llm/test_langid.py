import math
import random
import zlib

import numpy as np
import pytest
from helpers import SYLLABLES, empty, odd_documents, prose

from brindle.llm import langid


def test_predictions(spark):
    docs, rows = odd_documents(spark, 240)
    said = langid.identify(docs, langid.fit_documents(docs)).select("doc_id", "text", "lang", "lang_pred", "score").collect()
    assert len(said) == len(rows)
    right = [r.lang_pred == r.lang for r in said if r.text and len(r.text) > 60 and r.lang]
    assert np.mean(right) > 0.97
    for r in said:
        assert r.lang_pred in {*SYLLABLES, "und"} and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not r.text or not any(c.isalpha() for c in r.text))


def test_held_out_rows_are_not_learned(spark):
    rng = random.Random(5)
    rows = [(i, prose(rng, 30, "de" if i % 2 else "en"), "de" if i % 2 else "en") for i in range(200)]
    spoiled = [(i, t, "xx" if zlib.crc32(str(i).encode()) % 4 == 2 else lang) for i, t, lang in rows]
    model = langid.fit_documents(spark.createDataFrame(spoiled, "doc_id long, text string, lang string"))
    assert model.labels == ["de", "en"]


def test_empty_and_unlabelled(spark):
    model = langid.fit_documents(empty(spark))
    assert langid.identify(empty(spark), model).count() == 0
    docs = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    r = langid.identify(docs, model).first()
    assert (r.lang_pred, r.score) == ("und", 0.0)


def test_grams_of_long_texts_are_those_of_the_whole():
    text = "Ünder thé brüdge " * 500
    assert (langid.gram_counts(text, 997) == langid.gram_counts(text)).all()
    plain = langid.gram_counts("ab")
    assert plain.sum() == 3


def test_temperature():
    rng = np.random.default_rng(1)
    logits = rng.normal(size=(4000, 3)) * 3
    p = np.exp(logits) / np.exp(logits).sum(1, keepdims=True)
    labels = np.asarray([rng.choice(3, p=x) for x in p])
    assert 1.6 < langid.calibrate(logits * 2, labels) < 2.4


def test_stage_keeps_clean_documents(spark):
    docs, _ = odd_documents(spark, 200)
    own = docs.select("doc_id", "text", "lang", "source", "n_chars").where("text is null or length(text) > 60")
    out = langid.language_stage(spark, own, "")
    assert out.columns == own.columns and out.count() >= own.where("text is not null").count() - 3 and out.where("text is null").count() == 0


def plain_counts(text):
    """Hashed 1- to 3-grams, gram by gram."""
    mask = (1 << 32) - 1
    a, b, c, last = (int(x) for x in langid._GRAM)
    codes = [ord(x) if not x.isascii() or "a" <= x <= "z" else 32 for x in text.lower()]
    counts = {}
    for i in range(len(codes)):
        grams = [codes[i] * a & mask ^ 0x5BD1E995]
        if i + 1 < len(codes):
            grams.append(codes[i] * a * 31 + codes[i + 1] * b & mask)
        if i + 2 < len(codes):
            grams.append(codes[i] * a * 961 + codes[i + 1] * b * 31 + codes[i + 2] * c & mask)
        for g in grams:
            at = ((g ^ g >> 15) * last & mask) >> (32 - langid.BITS)
            counts[at] = counts.get(at, 0) + 1
    return counts


def plain_softmax(z):
    e = [math.exp(x - max(z)) for x in z]
    return [x / sum(e) for x in e]


def plain_ftrl(rows, n_labels, alpha=0.5, beta=1.0, l1=0.002, l2=0.01, epochs=4):
    """FTRL-proximal with elastic net, one coordinate after another."""
    bias = 1 << langid.BITS
    z, n = {}, {}

    def weight(i, k):
        s = z.get((i, k), 0.0)
        return 0.0 if abs(s) <= l1 else -(s - math.copysign(l1, s)) / ((beta + math.sqrt(n.get((i, k), 0.0))) / alpha + l2)

    order = np.random.default_rng(5)
    for _ in range(epochs):
        for r in order.permutation(len(rows)):
            features, label = rows[r]
            own = [*features.items(), (bias, 1.0)]
            w = {(i, k): weight(i, k) for i, _ in own for k in range(n_labels)}
            p = plain_softmax([sum(v * w[i, k] for i, v in own) for k in range(n_labels)])
            for i, v in own:
                for k in range(n_labels):
                    g = v * (p[k] - (k == label))
                    old = n.get((i, k), 0.0)
                    z[i, k] = z.get((i, k), 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / alpha * w[i, k]
                    n[i, k] = old + g * g
    return weight


def test_against_a_plain_version(spark):
    """Grams, document frequencies, unit vectors, weights, temperature and scores of 50 rows, each by its definition in loops."""
    rng = random.Random(11)
    rows = [(i * 31, prose(rng, rng.randrange(3, 12), lang), lang) for i, lang in ((i, rng.choice(list(SYLLABLES))) for i in range(50))]
    df = spark.createDataFrame([(t, lang, key) for key, t, lang in rows], "text string, lang string, key long").repartition(3)
    model = langid.train(df, "text", "lang", "key")
    counts = {key: plain_counts(t) for key, t, _ in rows}
    idf = {at: math.log((1 + 50) / (1 + sum(at in c for c in counts.values()))) + 1 for c in counts.values() for at in c}
    assert all(model.idf[at] == pytest.approx(x) for at, x in idf.items())

    def unit(c):
        v = {at: math.log1p(n) * idf.get(at, math.log(51) + 1) for at, n in c.items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {at: x / size for at, x in v.items()}

    labels = sorted({lang for *_, lang in rows})
    held = [r for r in rows if r[0] // 7 % 5 == 0]
    fit = [({at: float(np.float32(x)) for at, x in unit(counts[key]).items()}, labels.index(lang)) for key, _, lang in sorted(rows) if key // 7 % 5]
    weight = plain_ftrl(fit, len(labels))
    assert model.labels == labels and len(held) > 3
    for at in [*list(idf)[:300], 1 << langid.BITS]:
        for k in range(len(labels)):
            assert model.weights[at, k] == pytest.approx(weight(at, k), abs=1e-6)

    def logits(text):
        return [sum(x * weight(at, k) for at, x in unit(plain_counts(text)).items()) + weight(1 << langid.BITS, k) for k in range(len(labels))]

    def loss(t):
        return sum(-math.log(plain_softmax([z / t for z in logits(text)])[labels.index(lang)]) for _, text, lang in held)

    grid = [math.exp(math.log(0.02) + (math.log(20) - math.log(0.02)) * i / 79) for i in range(80)]
    assert model.temperature == pytest.approx(min(grid, key=loss))
    for text in ["the tion of", rows[0][1], "über die ung", "xyz"]:
        p = plain_softmax([z / model.temperature for z in logits(text)])
        assert model.predict(text) == (labels[p.index(max(p))], pytest.approx(max(p), abs=1e-6))
