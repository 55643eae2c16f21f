import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as public
from helpers import empty, odd_documents
from tokenizers import Tokenizer

from brindle.llm import packing


def held(rows, docs, capacity=2048, segments=128):
    full = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    texts = [(i, np.asarray([*full.encode(t or "", add_special_tokens=False).ids, 1], "<u4")) for i, t in docs]
    want = defaultdict(list)
    for i, ids in texts:
        want[i].append(ids)
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append(r)
        by_doc[r.doc_id].append(r)
    padding = 0
    for seq in by_sequence.values():
        at = 0
        for r in sorted(seq, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= capacity and len(seq) <= segments
        padding += 0 if at & (at - 1) == 0 else capacity - at
    assert set(by_doc) == set(want)
    for i, pieces in by_doc.items():
        # pieces of repeated rows: as many covers as rows, each id once in each
        assert sum(r.length for r in pieces) == sum(len(x) for x in want[i])
        if len(want[i]) == 1:
            at = 0
            for r in sorted(pieces, key=lambda r: r.start):
                assert r.start == at and r.doc_tokens == len(want[i][0])
                assert r.ids_crc32 == zlib.crc32(want[i][0][at : at + r.length].tobytes())
                at += r.length
            assert at == len(want[i][0])
    return padding


def test_every_id_once(spark):
    docs, rows = odd_documents(spark)
    got = packing.pack_documents(docs.repartition(2)).collect()
    assert held(got, [r[:2] for r in rows]) == 0
    assert packing.pack_documents(empty(spark)).count() == 0


def test_small_rounds_and_limits(spark, monkeypatch):
    docs, rows = odd_documents(spark, seed=2)
    monkeypatch.setattr(packing, "ROUND_ITEMS", 7)
    batches = docs.select("doc_id", "text").toArrow().to_batches(16)

    class Row:
        def __init__(self, d):
            self.__dict__.update(d)

    got = [Row(r) for b in packing._pack_partition(iter(batches), 256, 6, 256) for r in b.to_pylist()]
    assert held(got, [r[:2] for r in rows], 256, 6) == 0


def test_dot_product_bins():
    items = [(60, 10), (40, 40), (50, 50), (50, 0), (10, 0), (90, 20)]
    bins = packing.pack_items(items, 100, 3, 60)
    assert sorted(i for b in bins for i in b) == list(range(6))
    for b in bins:
        assert sum(items[i][0] for i in b) <= 100 and sum(items[i][1] for i in b) <= 60 and len(b) <= 3
    assert packing.pack_items([], 10, 1, 10) == []


def test_whole_examples(spark):
    rows = [(i, 10 + i % 90, i % 50) for i in range(300)] + [(900, 500, 1), (901, None, None), (902, 20, 99)]
    df = spark.createDataFrame(rows, "example_id long, tokens int, loss_tokens int")
    got = packing.pack_examples(df, 128, 4, 64).collect()
    assert sorted(r.example_id for r in got) == sorted(r[0] for r in rows)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append(r)
    for b in bins.values():
        if b[0].over_limit:
            assert len(b) == 1 and b[0].example_id in (900, 902)
        else:
            assert len(b) <= 4 and sum(r.tokens or 0 for r in b) <= 128 and sum(r.loss_tokens or 0 for r in b) <= 64
