"""Scalar expressions of the engine."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SNIPPET_CHARS = 180
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def snippet(text: Column, chars: int = SNIPPET_CHARS) -> Column:
    """White space collapsed and trimmed; longer texts end in three dots at `chars` characters."""
    flat = F.trim(F.regexp_replace(text, r"[\s  -     　]+", " "))
    return F.when(F.length(flat) > chars, F.concat(F.substring(flat, 1, chars - 3), F.lit("..."))).otherwise(flat)


def category(path: Column) -> Column:
    """First segment of a path, or (root)."""
    return F.when(F.instr(path, "/") > 1, F.substring_index(path, "/", 1)).otherwise(F.lit("(root)"))


def has_extension(path: Column, extensions: tuple[str, ...] = ("md", "txt")) -> Column:
    """Whether the last suffix of the path's last segment is one of these, in any case."""
    return F.lower(F.regexp_extract(path, r"(?<=[^/])\.([^./]+)$", 1)).isin(*extensions)


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision, summed left to right, as float."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x).cast("float")


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def usable(v: Column) -> Column:
    """Whether a vector can be brought to unit length: not null, empty or zero, and every component finite."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) > 0) & finite & (norm(v) > 0), F.lit(False))


def unit(v: Column) -> Column:
    """The vector at unit length, as floats; raises for an empty, zero or non-finite one."""
    n = norm(v)
    return F.when(usable(v), F.transform(v, lambda x: (x.cast("double") / n).cast("float"))).otherwise(F.raise_error(F.lit("a vector is empty, zero or not finite")).cast("array<float>"))


def timestamp(text: Column) -> Column:
    """YYYY-MM-DD HH:MM, or YYYY-MM-DD for midnight; null for anything else."""
    return F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")))


def document_number(text: Column) -> Column:
    """A command's argument as a number, if it is all digits."""
    return F.when(text.rlike("^[0-9]+$"), F.try_to_number(text, F.lit("9" * 18)).cast("long"))


def restore(content: Column, begin: Column, end: Column) -> Column:
    """The bytes [begin, end) of a content, as text."""
    return F.decode(F.substring(F.encode(content, "UTF-8"), begin + 1, end - begin), "UTF-8")


def char_offset(content: Column, byte: Column) -> Column:
    """How many characters stand before a byte offset."""
    return F.length(F.decode(F.substring(F.encode(content, "UTF-8"), F.lit(1), byte), "UTF-8"))


def utf16_length(text: Column) -> Column:
    """Code units of a text in UTF-16: a character beyond U+FFFF has two."""
    return F.length(text) + F.length(F.regexp_replace(text, r"[^\x{10000}-\x{10FFFF}]", ""))


def utf16_offset(content: Column, byte: Column) -> Column:
    """How many code units of UTF-16 stand before a byte offset: where an editor puts its cursor."""
    return utf16_length(F.decode(F.substring(F.encode(content, "UTF-8"), F.lit(1), byte), "UTF-8"))


def escaped(text: Column) -> Column:
    """A text as it stands in HTML."""
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(char), F.lit(name))
    return text


def fnv1a64_bytes(contents: list[bytes]) -> np.ndarray:
    """FNV-1a of each, as unsigned 64-bit numbers; all contents advance together, byte by byte."""
    h = np.full(len(contents), FNV_OFFSET, np.uint64)
    order = np.argsort([-len(c) for c in contents], kind="stable")
    sizes = np.asarray([len(contents[i]) for i in order], np.int64)
    work = h[order]
    longest = int(sizes[0]) if len(sizes) else 0
    for at in range(0, longest, 4096):
        alive = int((sizes > at).sum())
        block = np.zeros((alive, 4096), np.uint64)
        for j in range(alive):
            part = contents[order[j]][at : at + 4096]
            block[j, : len(part)] = np.frombuffer(part, np.uint8)
        for k in range(min(4096, longest - at)):
            live = int((sizes[:alive] > at + k).sum()) if sizes[alive - 1] <= at + k else alive
            work[:live] = (work[:live] ^ block[:live, k]) * np.uint64(FNV_PRIME)
    h[order] = work
    return h


@F.pandas_udf(T.LongType())
def fnv1a64(contents: pd.Series) -> pd.Series:
    """FNV-1a 64 of a binary or string column, its 64 bits as a signed long."""
    raw = [c.encode("utf-8", "surrogatepass") if isinstance(c, str) else bytes(c) for c in contents]
    return pd.Series(fnv1a64_bytes(raw).view(np.int64))
