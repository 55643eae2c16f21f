"""Tables with nulls, empty, long and repeated texts, ties, and columns with clashing names."""

import random

SYLLABLES = {"en": "the ing tion and ly ness ment er ed for".split(), "de": "ung der heit schen ver ge keit über äu ß".split(), "es": "ción ñ los mente ar que á ó del ía".split()}


def prose(rng, n, lang="en"):
    words = ["".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n)]
    return " ".join(words)


def odd_documents(spark, n=60, seed=1, lang=True):
    """(doc_id, text, lang, source, n_chars) with every oddity, and columns that clash with the operators' own names."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang_ = rng.choice(list(SYLLABLES))
        rows.append((i, prose(rng, rng.randrange(5, 120), lang_), lang_, f"s{i % 5}"))
    rows += [(1000, None, None, None), (1001, "", "en", "s1"), (1002, " \n\t ", None, "s1"), (1003, "x", "en", "s2"), (1004, "12345 678", "de", None), (1005, "é" * 50, "es", "s0"), (1006, "😀 word 😀", "en", "s3"), (1007, "a b c d", "en", "s3"), (1008, "<|endoftext|> is text", "en", "s3")]
    rows += [(2000, rows[3][1], rows[3][2], "s4"), (2001, rows[3][1], rows[3][2], "s4"), (3000, prose(rng, 8000), "en", "s1")]
    rows += [rows[5], rows[5], (None, rows[7][1], rows[7][2], "s2"), (None, None, None, None)]
    full = [(*r, len(r[1] or ""), 7.0, "k", 9) for r in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, score double, key string, size int"), rows


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
