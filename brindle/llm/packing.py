"""Vector bin packing of examples into training sequences.

An item has three sizes: tokens, segments and loss-bearing tokens; a sequence has a limit on each.
A sequence takes the fitting item with the largest dot product of the item's sizes and the room left
(both over the limits), until none fits. Where documents may be cut, the room that is left is filled
by pieces of the emptiest sequences, and what then remains is cut at powers of two.

Defined results: a null or empty text has its end token alone; a document longer than a sequence is
cut; repeated rows are packed one by one; an empty table gives no piece; further columns are ignored
and never clash, for the result has names of its own.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, small_batches

#: Items that one packing round holds; more rounds follow in the same task, so memory does not grow with the partition.
ROUND_ITEMS = 2048
END_ID = 1
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"
_encoder: dict[str, tuple] = {}


def encoder(file: str = "byte_bpe_50k"):
    """texts -> arrays of ids as `tokenizers` gives them, without special tokens added.

    The same vocabulary as ranks is several times faster; a text that holds a special token's string
    goes to `tokenizers` itself.
    """
    import public_tokenizers as public
    import tiktoken
    from tokenizers import Tokenizer

    if file not in _encoder:
        with open(public.path(f"{file}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        full = Tokenizer.from_file(public.path(f"{file}.json"))
        special = [t.content for t in full.get_added_tokens_decoder().values()]
        _encoder[file] = (tiktoken.Encoding(file, pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={}), full, special)
    fast, full, special = _encoder[file]

    def encode(text: str) -> list[int]:
        if any(s in text for s in special):
            return full.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


def pack_items(items: list[tuple[int, int]], capacity: int, segments: int, loss: int) -> list[list[int]]:
    """Bins of item numbers. items: (tokens, loss tokens), each within the limits.

    A bin takes, again and again, the fitting item with the largest dot product of its sizes and the
    bin's room (each over its limit, weighted by the mean demand for it), ties to the earlier item.
    """
    if not items:
        return []
    size = np.asarray([(t / capacity, 1 / segments, x / loss) for t, x in items])
    weight = size.mean(0)
    at = np.arange(len(items))
    bins: list[list[int]] = []
    eps = 1e-9
    while len(at):
        room = np.ones(3)
        free = np.ones(len(at), bool)
        own: list[int] = []
        while True:
            fits = free & (size <= room + eps).all(1)
            if not fits.any():
                break
            j = int(np.where(fits, size @ (weight * room), -1.0).argmax())
            own.append(int(at[j]))
            room = room - size[j]
            free[j] = False
        bins.append(own)
        at, size = at[free], size[free]
    return bins


def fill(bins: list[list[list[int]]], capacity: int, segments: int, loss: int) -> tuple[list[list[list[int]]], list[list[int]]]:
    """Filled bins, and the pieces left over: room is filled by pieces cut from the emptiest bins. A piece: item, start, length, whether its tokens bear loss."""
    bins = sorted(bins, key=lambda b: -sum(p[2] for p in b))
    pool: list[list[int]] = []
    done, lo, hi = [], 0, len(bins)
    while lo < hi:
        b = bins[lo]
        lo += 1
        room = capacity - sum(p[2] for p in b)
        borne = sum(p[2] for p in b if p[3])
        while room and len(b) < segments:
            if not pool:
                if hi - 1 < lo:
                    break
                hi -= 1
                pool = bins[hi][:]
            item, start, length, bears = pool[-1]
            take = min(length, room, loss - borne if bears else length)
            if take <= 0:
                break
            if take == length:
                pool.pop()
            else:
                pool[-1] = [item, start + take, length - take, bears]
            b.append([item, start, take, bears])
            room -= take
            borne += take if bears else 0
        if room and not pool and hi <= lo:  # nothing is left to fill it
            pool = b
            break
        done.append(b)
    return done, pool + [p for b in bins[lo:hi] for p in b]


def power_cut(pieces: list[list[int]], capacity: int, segments: int) -> list[list[list[int]]]:
    """The pieces in sequences of powers of two, which need no padding."""
    out: list[list[list[int]]] = []
    queue = [list(p) for p in pieces]
    total = sum(p[2] for p in queue)
    while total:
        want = min(capacity, 1 << total.bit_length() - 1)
        # a sequence of at most `segments` pieces
        seq: list[list[int]] = []
        have = sum(p[2] for p in queue[-segments:])
        want = min(want, 1 << have.bit_length() - 1)
        while want:
            p = queue[-1]
            take = min(p[2], want)
            seq.append([p[0], p[1], take, p[3]])
            if take == p[2]:
                queue.pop()
            else:
                p[1] += take
                p[2] -= take
            want -= take
            total -= take
        out.append(seq)
    return out


def pack_round(sizes: list[tuple[int, bool]], capacity: int, segments: int, loss: int, left: list[list[int]], last: bool) -> tuple[list[list[list[int]]], list[list[int]]]:
    """Sequences of pieces (item, start, length, bears loss) of these items and of the pieces left from earlier rounds."""
    pieces = [list(p) for p in left]
    step = min(capacity, loss)
    for item, (n, bears) in enumerate(sizes):
        top = step if bears else capacity
        for start in range(0, n, top):
            pieces.append([item, start, min(top, n - start), bears])
    bins = [[pieces[i] for i in b] for b in pack_items([(p[2], p[2] if p[3] else 0) for p in pieces], capacity, segments, loss)]
    full, rest = fill(bins, capacity, segments, loss)
    done: list[list[list[int]]] = []
    crowded: list[list[int]] = []  # of sequences that have no room for another segment
    for b in full:
        total = sum(p[2] for p in b)
        if total == capacity or total & (total - 1) == 0:
            done.append(b)
        elif len(b) >= segments:
            crowded += b
        else:
            rest += b
    done += power_cut(crowded, capacity, segments)
    return (done + power_cut(rest, capacity, segments), []) if last else (done, rest)


def _pack_partition(batches: Iterator[pa.RecordBatch], capacity: int, segments: int, loss: int) -> Iterator[pa.RecordBatch]:
    encode = encoder()
    context = TaskContext.get()
    next_id = (context.partitionId() if context else 0) << 40
    held: list[tuple] = []  # (doc_id, ids) of the items at hand
    left: list[list[int]] = []

    def emit(last: bool) -> pa.RecordBatch:
        nonlocal held, left, next_id
        fresh = held[len(carried) :]
        sequences, rest = pack_round([(0, True)] * len(carried) + [(len(ids), True) for _, ids in fresh], capacity, segments, loss, left, last)
        rows: list[tuple] = []
        for seq in sequences:
            offset = 0
            for item, start, length, bears in seq:
                doc, ids = held[item]
                rows.append((doc, start, length, zlib.crc32(ids[start : start + length].tobytes()), len(ids), next_id, offset, length if bears else 0))
                offset += length
            next_id += 1
        items = sorted({p[0] for p in rest})
        move = {old: new for new, old in enumerate(items)}
        left = [[move[p[0]], *p[1:]] for p in rest]
        held = [held[i] for i in items]
        carried[:] = held
        columns = list(zip(*rows)) if rows else [[]] * 8
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[c.split()[0] for c in PIECES.split(", ")])

    carried: list[tuple] = []
    tokens = 0
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            held.append((doc, np.asarray([*encode(text or ""), END_ID], "<u4")))
            tokens += len(held[-1][1])
            if len(held) - len(carried) >= ROUND_ITEMS or tokens >= ROUND_ITEMS * capacity:
                yield emit(False)
                tokens = 0
    yield emit(True)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, max_segments: int = 128, max_loss_tokens: int | None = None) -> DataFrame:
    """Pieces of documents in sequences; each partition packs its own, so nothing is shuffled."""
    small_batches(docs.sparkSession)
    loss = max_loss_tokens or capacity
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lambda it: _pack_partition(it, capacity, max_segments, loss), PIECES)


def pack_examples(examples: DataFrame, capacity: int = 2048, max_segments: int = 32, max_loss_tokens: int = 1536) -> DataFrame:
    """Sequences of whole instruction examples: (example_id, tokens, loss_tokens) with limits on tokens, segments and loss tokens.

    An example beyond a limit gets a sequence of its own (sequence_id unique, over_limit true). Examples are never cut.
    Null sizes count as 0. Adds sequence_id and over_limit.
    """
    names = [c for c in examples.columns if c not in ("sequence_id", "over_limit")]
    keep = examples.select(*names)
    fields = [*keep.schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        base = (context.partitionId() if context else 0) << 40
        for batch in batches:
            t = [x or 0 for x in batch.column(names.index("tokens")).to_pylist()]
            x = [x or 0 for x in batch.column(names.index("loss_tokens")).to_pylist()]
            over = [a > capacity or b > max_loss_tokens for a, b in zip(t, x)]
            fit = [i for i in range(len(t)) if not over[i]]
            where = np.zeros(len(t), np.int64)
            for b in pack_items([(t[i], x[i]) for i in fit], capacity, max_segments, max_loss_tokens):
                where[[fit[i] for i in b]] = base
                base += 1
            for i in (i for i in range(len(t)) if over[i]):
                where[i] = base
                base += 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(where), pa.array(over, pa.bool_())], names=[*names, "sequence_id", "over_limit"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", sequence_id long, over_limit boolean"
    return keep.mapInArrow(run, schema)


def op2_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))


def packing_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences; other columns of the documents do not matter."""
    return pack_documents(docs)
