import random

import corpus_pipeline
from helpers import prose


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(1)
    rows = []
    for i in range(120):
        lang = ("en", "de", "es")[i % 3]
        rows.append((i, prose(rng, 80, lang) + (" mail a.b@example.com now" if i % 10 == 0 else ""), lang, f"s{i % 4}", 0))
    rows += [(200 + i, rows[i][1], rows[i][2], rows[i][3], 0) for i in range(10)] + [(300, "12 34 56", None, "s1", 0), (301, None, None, None, 0)]
    path = str(tmp_path / "sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    docs = spark.read.parquet(f"{path}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "near_dedup", "pii", "mixing", "packing"] and corpus_pipeline.ORACLE_SQL is None
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, path)
        if name != names[-1]:
            assert out.columns == docs.columns
        docs = corpus_pipeline.materialize(out, name)
        kept[name] = docs.collect()
    assert {r.doc_id for r in kept["language"]} == {r[0] for r in rows if r[0] < 300}
    assert {r.doc_id for r in kept["near_dedup"]} == set(range(120))
    assert all("@" not in r.text for r in kept["pii"]) and sum("[EMAIL]" in r.text for r in kept["pii"]) == 12
    assert all(r.n_chars == len(r.text) for r in kept["pii"])
    assert {r.doc_id for r in kept["packing"]} == {r.doc_id for r in kept["mixing"]} <= set(range(120))
    again = corpus_pipeline.run(spark, path)
    key = lambda r: (r.doc_id, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, again.collect())) == sorted(map(key, kept["packing"]))


def test_queries_are_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {f"op{n}" for n in range(1, 14)} == {n.split("_")[0] for n in names if n.startswith("op")} and "pipeline" in names
