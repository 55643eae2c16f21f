import hashlib
import random

import numpy as np
import pytest
from helpers import empty, odd_documents
from pyspark.sql import functions as F

from brindle.llm import bytepairs

public = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def vocabulary():
    ranks = bytepairs.read_ranks(public.path(bytepairs.RANKS))
    model = bytepairs.serialise(ranks)
    return model, bytepairs.Codec(model, public.PATTERN, *bytepairs.without_newer(public.PATTERN)), tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_as_tiktoken_on_odd_strings(vocabulary):
    _, codec, theirs = vocabulary
    rng = random.Random(4)
    newer = [chr(c) for c in (0x558, 0x3D000, 0x11DE0, 0x1246F, 0x323B0)]
    alphabet = [chr(c) for c in [*range(0x250), *range(0x370, 0x400), *range(0x3040, 0x3060), *range(0x4E00, 0x4E20), 0x1F600, 0x200D, 0x2581, 0x2028, 0xFFFD, 0x3000, 0x10FFFF]] + newer
    seen = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(4000)]
    seen += ["", " ", "\n" * 99, "a" * 5000, " " * 3000 + "x", "don't DON'T", "<|endoftext|>", "▁▁ <unk> Ā", "\x00"]
    seen += ["".join(rng.choice("ab \n.é") for _ in range(3 * bytepairs.LOT)), "é" * (bytepairs.LOT + 5), "x " * bytepairs.LOT]
    for s in seen:
        ids = codec.encode(s)
        assert ids.tolist() == theirs.encode_ordinary(s), repr(s[:80])
        assert codec.decode(ids) == s.encode()


def test_every_token_by_itself(vocabulary):
    """Each token's bytes are one piece of the model, and sentencepiece merges them to it."""
    _, codec, theirs = vocabulary
    assert codec.sp.get_piece_size() == len(codec.tokens) + 1 and codec.sp.unk_id() == len(codec.tokens)
    merged = codec.sp.encode([bytepairs.mapped(t) for t in codec.tokens])
    assert [m for i, m in enumerate(merged) if m != [i]] == []
    assert codec.decode(np.arange(len(codec.tokens))) == b"".join(map(theirs.decode_single_token_bytes, range(len(codec.tokens))))


def test_the_memory_of_matches_is_bounded(vocabulary, monkeypatch):
    model, _, theirs = vocabulary
    monkeypatch.setattr(bytepairs, "REMEMBERED", 50)
    codec = bytepairs.Codec(model, public.PATTERN)
    rng = random.Random(5)
    for _ in range(30):
        s = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 80))) for _ in range(60))
        assert codec.encode(s).tolist() == theirs.encode_ordinary(s)
        assert len(codec.known) <= 50 + 121 and all(len(m) <= bytepairs.LONGEST for m in codec.known)


def test_a_vocabulary_must_be_whole():
    whole = {bytes([i]): i for i in range(256)}
    assert bytepairs.Codec(bytepairs.serialise(whole), public.PATTERN).encode("é").tolist() == [0xC3, 0xA9]
    with pytest.raises(ValueError):
        bytepairs.serialise({k: v for k, v in whole.items() if v != 255})
    with pytest.raises(ValueError):
        bytepairs.serialise(whole | {b"ab": 300})


def test_operator_keeps_columns_and_round_trips(spark, vocabulary):
    model, _, theirs = vocabulary
    docs, rows = odd_documents(spark)
    docs = docs.withColumns({c: F.lit(f"own {c}") for c in ("_text", "_ids", "_in0", "n_tokens")}).repartition(3)
    out = bytepairs.decoded(bytepairs.encoded(docs, model, public.PATTERN), model, public.PATTERN)
    assert out.columns == [*docs.columns, "ids", "decoded"]
    got = out.collect()
    assert sorted((r.doc_id is None, r.doc_id, r.text or "") for r in got) == sorted((r[0] is None, r[0], r[1] or "") for r in rows)
    for r in got:
        assert r.ids == theirs.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode() and r._ids == "own _ids"
    assert bytepairs.encoded(empty(spark), model, public.PATTERN).count() == 0
    bad = spark.sql("SELECT CAST(X'61ff62' AS STRING) AS text")
    assert bytepairs.encoded(bad, model, public.PATTERN).first().ids == theirs.encode_ordinary("a�b")


def test_query(spark, small, vocabulary):
    _, _, theirs = vocabulary
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = bytepairs.op12_byte_bpe(spark, small).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = theirs.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
