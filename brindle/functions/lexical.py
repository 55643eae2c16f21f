"""Lexical expressions: atoms and tokens of mixed English and Chinese text.

An ASCII word is a maximal run of letters, digits and hyphens, in which a dot or underscore joins two
letters or digits; a Han character is an atom of its own. Words are lower-cased, and each run of n
adjacent Han characters gives its n-1 bigrams.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.workspace import small_batches

#: Bytes of text of which a worker makes rows at a time.
PORTION = 1 << 18
WORD = r"[A-Za-z0-9-]*[A-Za-z0-9](?:[._][A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)*-*|-+"
HAN = "[㐀-䶿一-鿿]"
FIRST_HAN = "㐀"
ATOM = f"{WORD}|{HAN}"
RUN = f"{WORD}|{HAN}+"
#: The same atoms over bytes: three-byte Han characters, overlong forms left out.
BYTE_ATOM = re.compile(WORD.encode() + rb"|\xE3[\x90-\xBF][\x80-\xBF]|\xE4[\x80-\xB6\xB8-\xBF][\x80-\xBF]|[\xE5-\xE9][\x80-\xBF]{2}")


def tokens(text: Column) -> Column:
    """Array of the text's tokens, in order, repeats kept; null for a null text."""
    bigrams = lambda x: F.transform(F.sequence(F.lit(1), F.length(x) - 1), lambda i: F.substring(x, i, F.lit(2)))
    parts = lambda x: F.when(x < FIRST_HAN, F.array(F.lower(x))).when(F.length(x) < 2, F.array().cast("array<string>")).otherwise(bigrams(x))
    found = F.regexp_extract_all(text, F.lit(RUN), F.lit(0))
    # most texts have no Han character, and need no array for each word
    return F.when(text.rlike(HAN), F.flatten(F.transform(found, parts))).otherwise(F.transform(found, F.lower))


def counted(found: Column) -> Column:
    """array<struct<term,tf>> of an array of tokens, by term: counted in the row, so no table of words is built up in memory or moved."""
    starts = lambda s: F.when(F.size(s) > 0, F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))).otherwise(F.array().cast("array<int>"))
    runs = lambda s, a: F.transform(a, lambda i, j: F.struct(F.get(s, i).alias("term"), (F.coalesce(F.get(a, j + 1), F.size(s)) - i).alias("tf")))
    # arrays of one element bind what is used many times
    return F.transform(F.array(F.sort_array(found)), lambda s: F.transform(F.array(starts(s)), lambda a: runs(s, a))[0])[0]


def atom_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(ATOM))


def byte_atoms(content: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets at which the atoms begin and end; bytes that are no valid text separate atoms."""
    both = np.fromiter((x for m in BYTE_ATOM.finditer(content) for x in m.span()), np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def portions(b: pa.RecordBatch, at: int, size: int = PORTION) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about size bytes in its column of strings or bytes, of a row at least: what is made of them never fills a worker."""
    filled = np.cumsum(pc.fill_null(pc.binary_length(b.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < b.num_rows:
        before = int(filled[begin - 1]) if begin else 0
        end = max(begin + 1, int(np.searchsorted(filled, before + size, "right")))
        yield b.slice(begin, end - begin)
        begin = end


def _atom_lists(contents: pa.Array) -> pa.Array:
    """Of each content its atoms; offsets and kinds are columns of numbers, and no atom is a Python object."""
    at, begins, ends, high = [0], [], [], []
    for content in contents.cast(pa.binary()).to_pylist():
        if content is not None:
            begin, end = byte_atoms(content)
            begins.append(begin)
            ends.append(end)
            high.append(np.frombuffer(content, np.uint8)[begin] >= 0x80)
            at.append(at[-1] + len(begin))
        else:
            at.append(at[-1])
    begin, end, high = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (begins, ends, high))
    kinds = pa.array(["ASCII_WORD", "CJK_CHAR"]).take(pa.array(high.astype(np.int32)))
    values = pa.StructArray.from_arrays([pa.array(begin, pa.int32()), pa.array(end, pa.int32()), kinds], names=["begin", "end", "kind"])
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), values, mask=contents.is_null())


def atoms(docs: DataFrame, content_col: str = "content") -> DataFrame:
    """docs with atoms, array<struct<begin,end,kind>> in bytes of the content (binary or string); safe for malformed UTF-8."""
    small_batches(docs.sparkSession)
    names = [c for c in docs.columns if c != "atoms"]
    keep = docs.select(*names)
    at = names.index(content_col)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in portions(b, at):
                yield pa.RecordBatch.from_arrays([*part.columns, _atom_lists(part.column(at))], names=[*names, "atoms"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep.schema.fields)
    return keep.mapInArrow(scan, f"{schema}, atoms array<struct<begin:int,end:int,kind:string>>")
