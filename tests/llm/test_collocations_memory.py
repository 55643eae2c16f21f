"""A worker of the phrase miner holds little, whatever its texts: the largest arrays are those of one shard."""

import random
import tracemalloc

import pyarrow as pa

from brindle.llm import collocations as co


def test_a_shard_is_small():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7))) for _ in range(20_000)]
    texts = [" ".join(rng.choices(words, k=1000)).encode() for _ in range(2000)]
    assert sum(map(len, texts)) > 9 << 20
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * len(texts)), pa.array(texts, pa.binary())], names=["lang", "text"])
    seen = 0
    tracemalloc.start()
    try:
        for lang, shard in co.shards(iter([batch]), co.SHARD):
            shard.pair_hashes(lang)
            seen += len(shard.place)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert seen == 2_000_000 and peak < 100 << 20
