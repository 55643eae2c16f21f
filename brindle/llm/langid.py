"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

The weights are trained with follow-the-regularised-leader and elastic-net penalties on a bounded,
documented sample of labelled rows; document frequencies come from all training rows; the scores are
calibrated by a temperature on rows that the weights have not seen.

Defined results: a null text, or one without a letter, is `und` with score 0; a null label is never
learned; with no labelled row every text is `und`; repeated rows are predicted one by one; whole
texts are read, in pieces if they are long; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, id_crc, released, shielded, small_batches

BITS = 15
#: Labelled rows for the fit, at most about so many a label, chosen by a hash of the id.
SAMPLE = 1500
#: In the pipeline, a document goes if its language is `und` or less sure than this.
LEAST_SCORE = 0.5
_LETTER = re.compile(r"[^\W\d_]")
_ASCII = np.full(128, 32, np.uint32)
_ASCII[97:123] = np.arange(97, 123)
_GRAM = [np.uint32(x) for x in (2654435761, 2246822519, 3266489917, 668265263)]


def gram_counts(text: str, piece: int = 1 << 20) -> np.ndarray:
    """Counts of the hashed 1- to 3-grams of the lower-cased text; what is no letter counts as a space."""
    total = np.zeros(1 << BITS, np.int64)
    low, shift = text.lower(), np.uint32(32 - BITS)
    for at in range(0, max(len(low), 1), piece):
        code = np.frombuffer(low[max(at - 2, 0) : at + piece].encode("utf-32-le", "replace"), np.uint32)
        ascii_ = code < 128
        code = np.where(ascii_, _ASCII[np.where(ascii_, code, 0)], code)
        skip = min(at, 2)
        h = [code * m for m in _GRAM]
        grams = [h[0][skip:] ^ np.uint32(0x5BD1E995)]
        if len(code) > 1:
            grams.append((h[0][:-1] * np.uint32(31) + h[1][1:])[max(skip - 1, 0) :])
        if len(code) > 2:
            grams.append(h[0][:-2] * np.uint32(961) + h[1][1:-1] * np.uint32(31) + h[2][2:])
        for g in grams:
            total += np.bincount((g ^ g >> np.uint32(15)) * _GRAM[3] >> shift, minlength=1 << BITS)
    return total


def features(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the unit-length TF-IDF vector, term counts dampened by a logarithm."""
    counts = gram_counts(text)
    at = np.flatnonzero(counts)
    value = np.log1p(counts[at]) * idf[at]
    return at, value / max(np.sqrt((value * value).sum()), 1e-12)


@dataclass
class Model:
    labels: list[str]
    idf: np.ndarray
    weights: np.ndarray  # (features + bias) x labels
    temperature: float = 1.0

    def logits(self, at: np.ndarray, value: np.ndarray) -> np.ndarray:
        return value @ self.weights[at] + self.weights[-1]

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.labels or not text or not _LETTER.search(text):
            return "und", 0.0
        z = self.logits(*features(text, self.idf)) / self.temperature
        p = np.exp(z - z.max())
        k = int(z.argmax())
        return self.labels[k], float(p[k] / p.sum())


def train_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], n_labels: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.002, l2: float = 0.01, epochs: int = 4, seed: int = 5) -> np.ndarray:
    """Per-coordinate FTRL-proximal over the rows (places, values, label); L1 keeps the weights sparse, L2 small."""
    size = (1 << BITS) + 1
    z, n = np.zeros((size, n_labels)), np.zeros((size, n_labels))
    bias = size - 1

    def weights(zs: np.ndarray, ns: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zs) <= l1, 0.0, -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(ns)) / alpha + l2))

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, value, label = rows[i]
            at, value = np.append(at, bias), np.append(value, 1.0)
            zs, ns = z[at], n[at]
            w = weights(zs, ns)
            logit = value @ w
            p = np.exp(logit - logit.max())
            p /= p.sum()
            p[label] -= 1
            g = value[:, None] * p
            g2 = g * g
            z[at] = zs + g - (np.sqrt(ns + g2) - np.sqrt(ns)) / alpha * w
            n[at] = ns + g2
    return weights(z, n)


def calibrate(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least negative log-likelihood."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        s = logits / t
        s = s - s.max(1, keepdims=True)
        return float((np.log(np.exp(s).sum(1)) - s[np.arange(len(labels)), labels]).mean())

    grid = np.exp(np.linspace(np.log(0.02), np.log(20), 80))
    return float(grid[int(np.argmin([loss(t) for t in grid]))])


def train(docs: DataFrame, text_col: str, label_col: str, key: str, sample: int = SAMPLE) -> Model:
    """Fit on labelled rows; key is a column with a 32-bit hash of the id that chooses the sample."""
    spark = docs.sparkSession
    small_batches(spark)
    labelled = docs.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(label_col).alias("label"), F.col(key).alias("key"))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, by = np.zeros(1 << BITS, np.int64), 0, {}
        for b in batches:
            for t, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                df += gram_counts(t) > 0
                n += 1
                by[label] = by.get(label, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array([df.tobytes()], pa.binary()), pa.array([n]), pa.array([list(by)], pa.list_(pa.string())), pa.array([list(by.values())], pa.list_(pa.int64()))], names=["df", "n", "label", "count"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, by = np.zeros(1 << BITS, np.int64), 0, {}
        for b in batches:
            for d, m, labels, counts in zip(*(b.column(i).to_pylist() for i in range(4))):
                df += np.frombuffer(d, np.int64)
                n += m
                for k, c in zip(labels, counts):
                    by[k] = by.get(k, 0) + c
        yield pa.RecordBatch.from_arrays([pa.array([df.tobytes()], pa.binary()), pa.array([n]), pa.array([list(by)], pa.list_(pa.string())), pa.array([list(by.values())], pa.list_(pa.int64()))], names=["df", "n", "label", "count"])

    # sums of sums, each read as a stream: neither a task nor the driver holds more than one vector
    schema = "df binary, n long, label array<string>, count array<long>"
    parts = labelled.select("text", "label").mapInArrow(released(frequencies), schema).repartition(8).mapInArrow(added, schema).collect()
    df, n, by = np.zeros(1 << BITS, np.int64), 0, {}
    for r in parts:
        df += np.frombuffer(r["df"], np.int64)
        n += r["n"]
        for k, c in zip(r["label"], r["count"]):
            by[k] = by.get(k, 0) + c
    labels = sorted(by)
    idf = np.log((1 + n) / (1 + df)) + 1
    if not labels:
        return Model([], idf, np.zeros(((1 << BITS) + 1, 0)))
    code = {k: i for i, k in enumerate(labels)}
    chosen = F.lit(False)
    for k in labels:
        chosen = chosen | ((F.col("label") == k) & (F.pmod(F.xxhash64("key"), F.lit(1_000_003)) < int(1_000_003 * min(1.0, sample / by[k])) + 1))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [features(t, idf) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(2), b.column(1), pa.array([a.astype(np.uint16).tobytes() for a, _ in found], pa.binary()), pa.array([v.astype(np.float32).tobytes() for _, v in found], pa.binary())], names=["key", "label", "at", "value"])

    got = labelled.where(chosen).mapInArrow(released(vectors), "key long, label string, at binary, value binary").collect()
    rows = sorted((r["key"], code[r["label"]], r["at"], r["value"]) for r in got)
    rows = [(k, np.frombuffer(a, np.uint16).astype(np.int64), np.frombuffer(v, np.float32).astype(float), y) for k, y, a, v in rows]
    held = [r[1:] for r in rows if r[0] // 7 % 5 == 0]
    fit = [r[1:] for r in rows if r[0] // 7 % 5] or held
    model = Model(labels, idf, train_ftrl(fit, len(labels)))
    model.temperature = calibrate(np.asarray([model.logits(a, v) for a, v, _ in held]), np.asarray([y for *_, y in held]))
    return model


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score."""
    small_batches(docs.sparkSession)
    keep = docs.drop("lang_pred", "score")
    names = keep.columns
    slim = Model(model.labels, model.idf, model.weights.astype(np.float32), model.temperature)
    where = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            said = [slim.predict(t) for t in b.column(where).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([k for k, _ in said], pa.string()), pa.array([s for _, s in said], pa.float64())], names=[*names, "lang_pred", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep.schema.fields)
    return keep.mapInArrow(released(run), f"{schema}, lang_pred string, score double")


def fit_documents(docs: DataFrame) -> Model:
    own = docs.select("text", "lang", id_crc("doc_id").alias("key"))
    return train(own.where("key % 4 <> 2"), "text", "lang", "key")


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    said = identify(docs.select("doc_id", "text", (id_crc("doc_id") % 4 == 2).alias("held_out")), fit_documents(docs))
    return said.select("doc_id", "held_out", "lang_pred", "score")


def language_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in a language that the model knows and is sure of, with all their columns, whatever those are called."""
    plain, own, back = shielded(docs)
    said = identify(plain, fit_documents(docs), own["text"])
    return said.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*back)
