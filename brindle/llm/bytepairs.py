r"""Byte-level BPE encoding and decoding through a sentencepiece model made from the vocabulary.

A rank file's tokens become the pieces of a sentencepiece BPE model, written as its protocol buffer: every byte is
mapped to a character of its own, a piece's score is its negative rank (exact in single precision up to 2^24), and
normalisation is the identity. sentencepiece merges the neighbours of the highest score, the leftmost first, so
it merges what the ranks merge. Texts are cut by the tokenizer's pattern, and each match is encoded by itself; a match that
is a token as a whole is that token, whether merges lead to it or not. Decoding maps pieces back to bytes.

The model is made on the driver (its size is that of the vocabulary) and broadcast; texts pass by in
batches, a long one in lots of matches, and nothing is shuffled. A worker remembers the ids of a bounded number of matches.

The pattern's classes \p{L} and \p{N} follow the Unicode version of the module that cuts. `regex` can be newer here
than tiktoken, whose cuts are wanted: the driver asks both about every character once, and texts that hold one on which they
differ are cut by a pattern without those.

Defined results: a null text is empty and has no ids; invalid UTF-8 is read with replacement characters; decoding a null
gives empty bytes, and an id outside of the vocabulary is an error; the columns of docs are kept, whatever they are called.
"""

from __future__ import annotations

import base64
import codecs
import functools
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, released, shielded, small_batches

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Each byte's character: U+0100 and on, none of which means anything to sentencepiece.
CHARACTERS = "".join(map(chr, range(0x100, 0x200)))
#: Matches remembered by a worker, the longest of them in characters, and characters that are cut at a time.
REMEMBERED, LONGEST, LOT = 1 << 18, 48, 1 << 16
#: A place where every match ends: white space after anything else is the beginning of a match, or a match.
_SAFE = regex.compile(r"\S(?=\s)")


_PACKED = [struct.Struct(f"<{n}i") for n in range(32)]


def _field(number: int, payload: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(payload)) + payload


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def mapped(b: bytes) -> str:
    return codecs.charmap_decode(b, "strict", CHARACTERS)[0]


def unmapped(piece: str) -> bytes:
    return bytes(ord(c) - 0x100 for c in piece)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def serialise(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto whose piece numbers are the ranks; the number after the last is the unknown piece, which a full byte vocabulary never gives."""
    tokens = sorted(ranks, key=ranks.get)
    if [ranks[t] for t in tokens] != list(range(len(tokens))):
        raise ValueError("ranks must be 0, 1, 2, ...")
    if any(bytes([i]) not in ranks for i in range(256)):
        raise ValueError("every byte must be a token")
    pieces = [_field(1, _field(1, mapped(t).encode()) + b"\x15" + struct.pack("<f", -float(r))) for r, t in enumerate(tokens)]
    pieces.append(_field(1, _field(1, b"<unk>") + b"\x15" + struct.pack("<f", 0.0) + b"\x18\x02"))  # type 2: unknown
    flag = lambda number, value: _varint(number << 3) + _varint(value)
    trainer = _field(2, flag(3, 2) + flag(4, len(pieces)) + flag(40, len(tokens)) + b"".join(flag(n, (1 << 64) - 1) for n in (41, 42, 43)))  # BPE; unknown piece; no begin, end, padding
    normalizer = _field(3, _field(1, b"identity") + flag(3, 0) + flag(4, 0) + flag(5, 0))
    return b"".join(pieces) + trainer + normalizer


def newer_characters(category: str) -> str:
    """Characters that `regex` counts to \\p{category} and tiktoken does not."""
    import tiktoken

    every = "\n".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    bytes_alone = tiktoken.Encoding("bytes", pat_str=rf"\p{{{category}}}", mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
    theirs = set(bytes_alone.decode(bytes_alone.encode_ordinary(every)))
    runs: list[list[int]] = []
    for c in (ord(c) for c in regex.findall(rf"\p{{{category}}}", every) if c not in theirs):
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs)


@functools.lru_cache(maxsize=4)
def without_newer(pattern: str) -> tuple[str, str]:
    """(class of the characters on which the modules differ, the pattern without them in \\p{L} and \\p{N}); empty where they agree."""
    newer = {c: newer_characters(c) for c in "LN"}
    if not any(newer.values()):
        return "", pattern
    strict = pattern
    for c, chars in newer.items():
        if chars:
            # [^\\s\\p{L}\\p{N}] holds its class inside of brackets, where a set difference can stand as well
            strict = strict.replace(rf"\p{{{c}}}", rf"[\p{{{c}}}--[{chars}]]")
    return "[" + "".join(newer.values()) + "]", strict


class Codec:
    """Encoder and decoder of one model and pattern."""

    def __init__(self, model: bytes, pattern: str, newer: str = "", strict: str = "") -> None:
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.tokens = [unmapped(self.sp.id_to_piece(i)) for i in range(self.sp.get_piece_size() - 1)]
        self.whole = {t: i for i, t in enumerate(self.tokens)}
        self.pattern = regex.compile(pattern)
        self.newer, self.strict = (regex.compile(newer), regex.compile(strict, regex.V1)) if newer else (None, self.pattern)
        self.known: dict[str, bytes] = {}  # ids of a match, 32 bits each

    def _learn(self, new: set[str]) -> None:
        asked = []
        for m in new:
            token = self.whole.get(m.encode())
            if token is None:
                asked.append(m)
            else:
                self.known[m] = _PACKED[1].pack(token)
        if asked:
            for m, ids in zip(asked, self.sp.encode([mapped(m.encode()) for m in asked], num_threads=1)):
                self.known[m] = _PACKED[len(ids)].pack(*ids) if len(ids) < len(_PACKED) else np.asarray(ids, "<i4").tobytes()

    def _lots(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > LOT:
            cut = _SAFE.search(text, at + LOT - 1)
            if cut is None:
                break
            yield text[at : cut.end()]
            at = cut.end()
        yield text[at:] if at else text

    def encode(self, text: str) -> np.ndarray:
        out = []
        for lot in self._lots(text):
            matches = (self.strict if self._has_newer(lot) else self.pattern).findall(lot)
            if len(self.known) > REMEMBERED:
                self.known = {}
            new = set(matches).difference(self.known)
            if new:
                self._learn(new)
            out.append(b"".join(map(self.known.__getitem__, matches)))
            for m in new:
                if len(m) > LONGEST:
                    del self.known[m]
        return np.frombuffer(b"".join(out), "<i4")

    def _has_newer(self, text: str) -> bool:
        if self.newer is None or text.isascii():
            return False
        try:
            text.encode("latin-1")  # far quicker than a search, and none of these is newer
            return False
        except UnicodeEncodeError:
            return self.newer.search(text) is not None

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) and ids.min() < 0:
            raise IndexError("negative id")
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


@functools.lru_cache(maxsize=1)
def codec(model: bytes, pattern: str, newer: str = "", strict: str = "") -> Codec:
    return Codec(model, pattern, newer, strict)


def _schema(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def encoded(docs: DataFrame, model: bytes, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """docs with the ids of the text (array<int>) as a last column."""
    spark = docs.sparkSession
    small_batches(spark)
    plain, own, back = shielded(docs)
    ready = plain.withColumn("_text", F.coalesce(F.col(own[text_col]).cast("string"), F.lit("")).cast("binary"))
    sent = spark.sparkContext.broadcast(model)
    newer, strict = without_newer(pattern)
    names = plain.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(sent.value, pattern, newer, strict)
        for b in batches:
            ids = [c.encode(t.decode("utf-8", "replace")) for t in b.column(b.num_columns - 1).to_pylist()]
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], lists], names=[*names, "_ids"])

    return ready.mapInArrow(released(run), f"{_schema(plain)}, _ids array<int>").select(*back, F.col("_ids").alias(ids_col))


def decoded(rows: DataFrame, model: bytes, pattern: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """rows with the bytes of their ids as a last column."""
    spark = rows.sparkSession
    small_batches(spark)
    plain, own, back = shielded(rows)
    sent = spark.sparkContext.broadcast(model)
    names = plain.columns
    where = names.index(own[ids_col])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(sent.value, pattern)
        for b in batches:
            lists = b.column(where)
            ids = pc.list_flatten(lists).to_numpy(zero_copy_only=False)
            ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
            texts = [c.decode(ids[i:j]) for i, j in zip([0, *ends[:-1]], ends)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.binary())], names=[*names, "_bytes"])

    return plain.mapInArrow(released(run), f"{_schema(plain)}, _bytes binary").select(*back, F.col("_bytes").alias(bytes_col))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as public

    model = serialise(read_ranks(public.path(RANKS)))
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = decoded(encoded(docs, model, public.PATTERN).drop("text"), model, public.PATTERN)
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
