import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

from brindle.functions import lexical, scalars
from brindle.operators import chunking
from brindle.plans import workspace

GOLDEN = [
    ("libc-2.31", ["libc-2.31"]),
    ("__libc_csu_init", ["libc_csu_init"]),
    ("wait... e.g. now", ["wait", "e.g", "now"]),
    ("a-.b", ["a-", "b"]),
    ("a.-b", ["a", "-b"]),
    ("堆溢出利用", ["堆溢", "溢出", "出利", "利用"]),
    ("堆", []),
    ("用ROP链 ret2libc", ["rop", "ret2libc"]),
    ("栈溢出 and 堆，格式化", ["栈溢", "溢出", "and", "格式", "式化"]),
    ("", []),
    ("... __ ..", []),
    ("A_B.C", ["a_b.c"]),
]


def scan(text):
    """An independent scanner: words by a walk over characters, Han by code point."""
    alnum = lambda c: c.isascii() and c.isalnum()
    out, i = [], 0
    while i < len(text):
        c = text[i]
        if alnum(c) or c == "-":
            j = i
            while j < len(text):
                if alnum(text[j]) or text[j] == "-":
                    j += 1
                elif text[j] in "._" and j > i and alnum(text[j - 1]) and j + 1 < len(text) and alnum(text[j + 1]):
                    j += 1
                else:
                    break
            out.append((i, j, "w"))
            i = j
        elif "㐀" <= c <= "䶿" or "一" <= c <= "鿿":
            out.append((i, i + 1, "h"))
            i += 1
        else:
            i += 1
    return out


def scanned_tokens(text):
    out, run, last = [], "", -1
    for a, b, kind in [*scan(text), (-2, -2, "w")]:
        if kind == "h" and a == last:
            run += text[a:b]
        else:
            out += [run[i : i + 2] for i in range(len(run) - 1)]
            run = text[a:b] if kind == "h" else ""
        last = b if kind == "h" else -1
        if kind == "w" and a >= 0:
            out.append(text[a:b].lower())
    return out


def test_golden_tokens(spark):
    rows = spark.createDataFrame(GOLDEN, "text string, want array<string>").select("want", lexical.tokens(F.col("text")).alias("got")).collect()
    assert [r["got"] for r in rows] == [r["want"] for r in rows]


def test_random_strings(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("aZ9-._ 堆栈，\né") for _ in range(rng.randrange(30))) for _ in range(2000)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", lexical.tokens(F.col("text")).alias("t"), lexical.atom_count(F.col("text")).alias("n")).collect()
    for r in rows:
        assert r["t"] == scanned_tokens(r["text"]) and r["n"] == len(scan(r["text"]))


def test_malformed_bytes(spark):
    raw = "堆".encode() + b"\xff" + "栈".encode() + b" ab\xc3 \xe5\xa0 x"
    got = lexical.atoms(spark.createDataFrame([(1, bytearray(raw)), (2, None)], "id int, content binary")).orderBy("id").collect()
    assert [(a["begin"], a["end"], a["kind"]) for a in got[0]["atoms"]] == [(0, 3, "CJK_CHAR"), (4, 7, "CJK_CHAR"), (8, 10, "ASCII_WORD"), (15, 16, "ASCII_WORD")]
    assert got[1]["atoms"] is None


def cut(spark, *contents, deleted=False):
    docs = spark.createDataFrame([(i, c, deleted) for i, c in enumerate(contents)], "doc_id long, content string, deleted boolean")
    return [(r.doc_id, r.begin, r.end, r.text) for r in chunking.chunk_documents(docs).orderBy("chunk_id").collect()]


def test_chunks(spark):
    words = " ".join(f"w{i}" for i in range(600))
    got = cut(spark, words)
    assert len(got) == 2 and got[0][3].endswith("w499") and got[1][3].startswith("w450 ") and got[1][3].endswith("w599")
    assert [(b, e) for _, b, e, _ in cut(spark, "堆" * 501)] == [(0, 1500), (1350, 1503)]
    assert len(cut(spark, "堆" * 499 + "。栈")) == 1
    assert cut(spark, "") == [] and cut(spark, "abc", deleted=True) == [] and len(cut(spark, "---")) == 1
    assert [len(cut(spark, " ".join(["a"] * n))) for n in (1, 500, 501, 950, 951)] == [1, 1, 2, 2, 3]


def test_scalars(spark):
    df = spark.createDataFrame([("web/a.MD", "  a\n\tb  "), ("x.txt", "y" * 200), (".md", ""), ("d.md/readme", None)], "path string, text string")
    rows = df.select(scalars.category(F.col("path")).alias("c"), scalars.has_extension(F.col("path")).alias("e"), scalars.snippet(F.col("text")).alias("s")).collect()
    assert [r.c for r in rows] == ["web", "(root)", "(root)", "d.md"]
    assert [r.e for r in rows] == [True, True, False, False]
    assert rows[0].s == "a b" and len(rows[1].s) == 180 and rows[1].s.endswith("y...")


def test_content_hash(spark):
    def plain(raw):
        h = 0xCBF29CE484222325
        for b in raw:
            h = (h ^ b) * 0x100000001B3 % (1 << 64)
        return h - (1 << 64) if h >> 63 else h

    raws = [b"", b"a", "堆".encode(), bytes(range(256)) * 40, b"x" * 5000]
    got = spark.createDataFrame([(i, bytearray(r)) for i, r in enumerate(raws)], "i int, c binary").select("i", scalars.fnv1a64("c").alias("h")).orderBy("i").collect()
    assert [r.h for r in got] == [plain(r) for r in raws]


def test_places_and_numbers(spark):
    r = spark.sql("select 'a堆b' c").select(scalars.restore(F.col("c"), F.lit(1), F.lit(4)).alias("t"), scalars.char_offset(F.col("c"), F.lit(4)).alias("n"), scalars.document_number(F.lit("12")).alias("k"), scalars.document_number(F.lit("1x")).alias("bad"), scalars.timestamp(F.lit("2024-05-06")).cast("string").alias("d"), scalars.timestamp(F.lit("nonsense")).alias("z")).first()
    assert (r.t, r.n, r.k, r.bad, r.d, r.z) == ("堆", 2, 12, None, "2024-05-06 00:00:00", None)


def test_patterns_have_no_lookaround():
    assert not re.search(r"\(\?[=!<]", lexical.RUN)


def test_atoms_are_made_of_a_portion_of_the_texts_at_a_time(spark):
    """A worker's memory does not grow with the texts of a batch: batches are cut by bytes, and rows keep their order and nulls."""
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(["ab", None, "x" * 100, "", "堆 a"])], names=["id", "content"])
    parts = list(lexical.portions(batch, 1, 10))
    assert [p.num_rows for p in parts] == [2, 1, 2] and [x for p in parts for x in p.column(0).to_pylist()] == [0, 1, 2, 3, 4]
    made = lexical.atoms(spark.createDataFrame([(i, None if i % 7 == 0 else f"堆 w{i} " * (i % 50)) for i in range(3000)], "id int, content string"))
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == workspace.BATCH_BYTES
    for r in made.collect():
        wanted = None if r["content"] is None else [r["content"].encode()[a["begin"] : a["end"]].decode() for a in r["atoms"]]
        assert wanted == (None if r["id"] % 7 == 0 else ["堆", f"w{r['id']}"] * (r["id"] % 50))
        assert r["atoms"] is None or [a["kind"] for a in r["atoms"]] == ["CJK_CHAR", "ASCII_WORD"] * (r["id"] % 50)
