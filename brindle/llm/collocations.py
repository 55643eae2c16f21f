"""Phrase collocation mining with compressed position bitmaps, SPAM-style.

Texts are dealt into shards of two megabytes. In a shard every word has a bitmap of its positions, kept as its
non-zero blocks of 64 bits. A phrase grows by a word when its bitmap, shifted by one place, is ANDed with the bitmap
of places that continue a piece and with the word's own; the popcount is the phrase's frequency in the shard. Lots of
first words are followed depth-first to the longest phrase, so few bitmaps are held at once. Popcounts are summed
over the shards.

A phrase is frequent only if each of its neighbouring words are frequent as a pair. One pass before counts pairs by a
64-bit hash; the cells of the frequent ones form one bitmap of a fixed size (8 MB), sent to all tasks. Pairs outside of
it are left out of the bitmap of continuing places. Collisions can only let a pair through, so nothing frequent is lost,
and the exact threshold is taken on the sums: more data than the cells can tell apart means more work, not other rows.

Defined results: a null text is empty, a null language counts as `und`; only A-Z are lowered; invalid UTF-8 is taken
byte by byte; an empty table and texts without words give no rows; repeated rows count each; further columns are
ignored, whatever they are called.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import U64, documents, materialize, mix64, released, segment_hashes, signed, small_batches

#: Bytes of text in one shard, bitmap rows of a lot that is followed depth-first, cells of the filter of pairs. A worker's arrays have some 30 bytes for each byte of a shard.
SHARD, LOT, CELLS = 2 << 20, 1 << 16, 1 << 26
#: Rows handed to the JVM at a time.
HANDED = 1 << 16
#: Parts by which a single word's joins are salted: a common word begins or ends a large share of all phrases.
SALT = 32

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_HARD, _SOFT = np.zeros(256, bool), np.zeros(256, bool)
_HARD[list(b".,;:!?\n\x0b\x0c\r")] = True
_SOFT[list(b" \t")] = True
_ONE = U64(1)


class Shard:
    """Words of one language's texts in order: their dictionary, each place's word, and whether it continues a piece."""

    def __init__(self, texts: list[bytes]) -> None:
        raw = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
        hard = _HARD[raw]
        inside = ~(hard | _SOFT[raw])
        edge = np.diff(inside.view(np.int8), prepend=np.int8(0))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
        words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw[inside])])
        coded = words.dictionary_encode()
        self.words: pa.Array = coded.dictionary
        self.place = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        breaks = np.cumsum(hard, dtype=np.int64)
        self.continues = np.zeros(len(starts), bool)
        if len(starts):
            self.continues[1:] = breaks[starts[1:]] == breaks[ends[:-1] - 1]

    def pair_hashes(self, lang: str) -> tuple[np.ndarray, np.ndarray]:
        """(places that continue a piece, hash of the word before and the word there, with the language)."""
        buffers = self.words.buffers()
        offsets = np.frombuffer(buffers[1], np.int64)[: len(self.words) + 1]
        hashes = segment_hashes(np.frombuffer(buffers[2] or b"", np.uint8), offsets[:-1], offsets[1:])
        at = np.flatnonzero(self.continues)
        own = U64(zlib.crc32(lang.encode()) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        return at, mix64(hashes[self.place[at - 1]] * U64(0xC2B2AE3D27D4EB4F) + hashes[self.place[at]] * U64(0x165667B19E3779F9) + own)


def shards(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[str, Shard]]:
    """(language, shard) of (lang, text) rows: about size bytes of text at a time, one shard for each language in them."""
    held: dict[str, list[bytes]] = {}
    total = 0

    def hand_on() -> Iterator[tuple[str, Shard]]:
        nonlocal total
        while held:
            lang, texts = held.popitem()
            yield lang, Shard(texts)
        total = 0

    for b in batches:
        for lang, text in zip(b.column(0), b.column(1)):
            text = text.as_py()
            held.setdefault(lang.as_py(), []).append(text)
            total += len(text) + 1
            if total >= size:
                yield from hand_on()
    yield from hand_on()


class Bitmaps:
    """Position bitmaps of a shard's words as rows (word, block, bits), those of a word together, blocks ascending."""

    def __init__(self, place: np.ndarray, continues: np.ndarray) -> None:
        n = len(place)
        self.place = place
        order = np.argsort(place, kind="stable")
        key_word, key_block = place[order], order >> 6
        first = np.ones(n, bool)
        first[1:] = (key_word[1:] != key_word[:-1]) | (key_block[1:] != key_block[:-1])
        at = np.flatnonzero(first)
        self.word, self.block = key_word[at], key_block[at]
        self.bits = np.bitwise_or.reduceat(_ONE << (order & 63).astype(U64), at) if n else np.zeros(0, U64)
        self.row = np.empty(n, np.int64)  # of each place, the row of its word's bitmap
        self.row[order] = np.cumsum(first) - 1
        open_ = np.zeros((n >> 6) + 2 << 6, bool)
        open_[:n] = continues
        self.open = np.packbits(open_, bitorder="little").view("<u8").astype(U64)

    def extend(self, phrase: np.ndarray, block: np.ndarray, bits: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(phrase, next word, block, bits) of the bitmaps of all phrases longer by a word: shifted, and ANDed with each word that stands there."""
        carry = bits >> U64(63)
        over = np.flatnonzero(carry)
        phrase, block = np.concatenate([phrase, phrase[over]]), np.concatenate([block, block[over] + 1])
        bits = np.concatenate([bits << _ONE, carry[over]]) & self.open[block]
        while True:
            left = np.flatnonzero(bits)
            if not len(left):
                return
            phrase, block, bits = phrase[left], block[left], bits[left]
            low = bits & (~bits + _ONE)
            row = self.row[(block << 6) + np.bitwise_count(low - _ONE)]
            hit = bits & self.bits[row]
            yield phrase, self.word[row], block, hit
            bits = bits & ~hit

    def phrases(self, longest: int, lot: int = LOT) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(word numbers, one row a phrase; frequencies) of phrases of two words and more, lot by lot, depth-first."""
        n_words = int(self.word.max(initial=-1)) + 1

        def grow(spelt: np.ndarray, phrase: np.ndarray, block: np.ndarray, bits: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            found = list(self.extend(phrase, block, bits))
            if not found:
                return
            phrase, word, block, bits = (np.concatenate(x) for x in zip(*found))
            key = phrase * n_words + word
            order = np.argsort(key, kind="stable")
            key, block, bits = key[order], block[order], bits[order]
            first = np.concatenate([[True], key[1:] != key[:-1]])
            at = np.flatnonzero(first)
            spelt = np.column_stack([spelt[key[at] // n_words], key[at] % n_words])
            yield spelt, np.add.reduceat(np.bitwise_count(bits).astype(np.int64), at)
            if spelt.shape[1] < longest:
                phrase = np.cumsum(first) - 1
                for i in range(0, len(bits), lot):
                    yield from grow(spelt, phrase[i : i + lot], block[i : i + lot], bits[i : i + lot])

        every = np.arange(n_words, dtype=np.int64)[:, None]
        for i in range(0, len(self.bits), lot):
            yield from grow(every, self.word[i : i + lot], self.block[i : i + lot], self.bits[i : i + lot])


def spelled(words: pa.Array, numbers: np.ndarray) -> pa.Array:
    """The phrases of rows of word numbers, joined by spaces; the bytes as they are, valid or not."""
    parts = [words.take(pa.array(numbers[:, j])) for j in range(numbers.shape[1])]
    joined = parts[0] if len(parts) == 1 else pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.large_binary()))
    return joined.cast(pa.binary())


def _texts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))


def pair_filter(texts: DataFrame, least: int, shard: int = SHARD, cells: int = CELLS) -> bytes:
    """A bitmap over cells (hash modulo cells) with all pairs of neighbouring words that occur least times, and others that share a cell."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, s in shards(batches, shard):
            keys, n = np.unique(signed(s.pair_hashes(lang)[1]), return_counts=True)
            for i in range(0, len(keys), HANDED):
                yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + HANDED]), pa.array(n[i : i + HANDED])], names=["key", "n"])

    pairs = texts.mapInArrow(released(count), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    cell = F.col("key").bitwiseAND(F.lit(cells - 1)) + 1
    rows = pairs.groupBy(F.bitmap_bucket_number(cell).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(cell)).alias("bits")).collect()
    out = bytearray(max(1, cells // 8))
    for r in rows:
        at = (r["bucket"] - 1) * 4096
        out[at : at + 4096] = r["bits"][: len(out) - at]
    return bytes(out)


def frequencies(docs: DataFrame, least: int = 30, longest: int = 4, text_col: str = "text", lang_col: str = "lang", shard: int = SHARD, cells: int = CELLS) -> DataFrame:
    """(lang, words, phrase, f) of every phrase of 1 to longest words that occurs least times within pieces of a language.

    words = 0 has the number of all word occurrences of the language.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = _texts(docs, text_col, lang_col)
    sent = spark.sparkContext.broadcast(pair_filter(texts, least, shard, cells))

    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.frombuffer(sent.value, np.uint8)

        def rows(lang: str, words: int, phrases: pa.Array, f: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(f), pa.string()), pa.array(np.full(len(f), words, np.int32)), phrases, pa.array(f)], names=["lang", "words", "phrase", "f"])

        for lang, s in shards(batches, shard):
            if not len(s.place):
                continue
            at, hashes = s.pair_hashes(lang)
            cell = hashes & U64(cells - 1)
            s.continues[at] = seen[(cell >> U64(3)).astype(np.int64)] >> (cell & U64(7)).astype(np.uint8) & 1
            yield rows(lang, 0, pa.array([b""], pa.binary()), np.asarray([len(s.place)]))
            f = np.bincount(s.place, minlength=len(s.words))
            for i in range(0, len(f), HANDED):
                yield rows(lang, 1, spelled(s.words, np.arange(i, min(i + HANDED, len(f)))[:, None]), f[i : i + HANDED])
            for numbers, f in Bitmaps(s.place, s.continues).phrases(longest):
                for i in range(0, len(f), HANDED):
                    yield rows(lang, numbers.shape[1], spelled(s.words, numbers[i : i + HANDED]), f[i : i + HANDED])

    found = texts.mapInArrow(released(mine), "lang string, words int, phrase binary, f long")
    # the words' number follows from the phrase, and is no key
    return found.groupBy("lang", "phrase").agg(F.max("words").alias("words"), F.sum("f").alias("f")).where((F.col("f") >= least) | (F.col("words") == 0)).select("lang", "words", F.col("phrase").cast("string").alias("phrase"), "f")


def _part(words: "F.Column", begin: "F.Column", n: "F.Column") -> "F.Column":
    return F.array_join(F.slice(words, begin, n), " ")


def scored(counted: DataFrame, salt: int = SALT) -> DataFrame:
    """(lang, phrase, words, a, l, r, score): each candidate at its lowest-scoring cut, ties to the smallest k."""
    cand = counted.where("words >= 2").select("lang", "phrase", "words", F.col("f").alias("a"))
    split = F.split("phrase", " ", -1)
    cuts = cand.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    sides = cuts.select(
        "lang", "phrase", "words", "a", "k",
        F.explode(F.array(
            F.struct(F.lit("l").alias("side"), F.col("k").alias("width"), _part(split, F.lit(1), F.col("k")).alias("part")),
            F.struct(F.lit("r").alias("side"), (F.col("words") - F.col("k")).alias("width"), _part(split, F.col("k") + 1, F.col("words") - F.col("k")).alias("part")),
        )).alias("s"),
    ).select("lang", "phrase", "words", "a", "k", "s.*").withColumn("salt", F.when(F.col("width") == 1, F.pmod(F.xxhash64("phrase"), F.lit(salt))).otherwise(0).cast("int"))
    parts = counted.where("words >= 1").select("lang", F.col("phrase").alias("part"), F.col("f").alias("part_f"), F.explode(F.sequence(F.lit(0), F.when(F.col("words") == 1, salt - 1).otherwise(0))).alias("salt"))
    joined = sides.join(parts, ["lang", "part", "salt"])
    both = joined.groupBy("lang", "phrase", "words", "a", "k").agg(F.max(F.when(F.col("side") == "l", F.col("part_f"))).alias("l"), F.max(F.when(F.col("side") == "r", F.col("part_f"))).alias("r"))
    score = F.expr("(CAST(2000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(19,0))) DIV (CAST(l AS DECIMAL(19,0)) + CAST(r AS DECIMAL(19,0)))")
    low = both.withColumn("score", score).groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return low.select("lang", "phrase", "words", "a", "cut.l", "cut.r", "cut.score")


def absorbed(counted: DataFrame) -> DataFrame:
    """(lang, phrase, longer): of each phrase inside longer candidates, the highest frequency of those."""
    long = counted.where("words >= 3")
    spans = F.expr("flatten(transform(sequence(2, words - 1), n -> transform(sequence(1, words - n + 1), b -> array_join(slice(split(phrase, ' ', -1), b, n), ' '))))")
    return long.select("lang", "f", F.explode(F.array_distinct(spans)).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("longer"))


def collocations(docs: DataFrame, least: int = 30, longest: int = 4, keep: int = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's keep best phrases. Frequencies are written once and stay until the result is read."""
    counted = materialize(frequencies(docs, least, longest, text_col, lang_col), "frequencies")
    inside = F.coalesce(F.col("longer").cast("decimal(19,0)") * 100 >= F.col("a").cast("decimal(19,0)") * 80, F.lit(False))
    kept = scored(counted).join(absorbed(counted), ["lang", "phrase"], "left").where(~inside)
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= keep)
    totals = counted.where("words = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))


@functools.cache
def sql() -> str:
    """The contract as DuckDB SQL: phrases counted as joined strings."""
    def grams(m: int) -> str:
        return f"SELECT lang, {m} AS m, unnest(list_transform(range(1, len(w) - {m} + 2), lambda i: w[i:i+{m - 1}])) AS g FROM pieces"

    parts = " UNION ALL ".join(f"SELECT lang, g, m, f AS a, {k} AS k, array_to_string(g[1:{k}], ' ') AS lp, array_to_string(g[{k + 1}:m], ' ') AS rp FROM cand WHERE m > {k}" for k in (1, 2, 3))
    inner = " UNION ALL ".join(f"SELECT lang, array_to_string(g[{b}:{b + n - 1}], ' ') AS p, f FROM cand WHERE m > {n} AND m >= {b + n - 1}" for n in (2, 3) for b in range(1, 4 - n + 2))
    return rf"""
WITH texts AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
pieces AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \x09]+'), lambda x: x <> '') AS w FROM texts),
counted AS (
  SELECT lang, m, g, count(*) AS f, array_to_string(g, ' ') AS p FROM ({" UNION ALL ".join(grams(m) for m in (1, 2, 3, 4))}) GROUP BY lang, m, g),
cand AS (SELECT * FROM counted WHERE m >= 2 AND f >= 30),
cuts AS ({parts}),
cut_scores AS (
  SELECT c.lang, array_to_string(c.g, ' ') AS phrase, c.a, c.k, x.f AS l, y.f AS r, (2000000::HUGEINT * c.a) // (x.f + y.f) AS score
  FROM cuts c JOIN counted x ON x.lang = c.lang AND x.p = c.lp JOIN counted y ON y.lang = c.lang AND y.p = c.rp),
low AS (SELECT * FROM cut_scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (SELECT lang, p, max(f) AS f FROM ({inner}) GROUP BY lang, p),
kept AS (SELECT low.* FROM low LEFT JOIN longer ON longer.lang = low.lang AND longer.p = low.phrase WHERE longer.f IS NULL OR 100::HUGEINT * longer.f < 80::HUGEINT * low.a),
totals AS (SELECT lang, sum(len(w)) AS n FROM pieces GROUP BY lang),
ranked AS (SELECT kept.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT r.lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked r JOIN totals t ON t.lang = r.lang WHERE rank <= 2000
"""
