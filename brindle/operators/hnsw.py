"""Approximate search in layered neighbour graphs, one graph a shard.

Inserting is sequential, so vectors are dealt by a hash into shards of bounded size, each shard gets a
graph of its own, all shards are searched and the best results merged. One shard is one graph.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.workspace import small_batches
from .bm25 import top_k
from .dense import dimension

M, EF_BUILD, EF_SEARCH = 16, 200, 100
#: Vectors of one graph, about.
SHARD = 20_000
#: Queries, about, that a task asks one graph.
QUERY_LOT = 8192
#: Nodes of a beam that are expanded in one step, vectors inserted in one step, and cells (query, node) of a step's table.
STEP, INSERTED, STEP_CELLS = 16, 1024, 1 << 22
#: A beam's width without one given, in roots of the graph's size.
BEAM = 8
#: Squared distance, relative to the squared length, up to which a vector is a near copy of another.
NEAR = 0.02
#: Bytes of a graph in one row, and queries of a task that are searched for at once.
PIECE, ASKED = 1 << 20, 1024


def leaders(x: np.ndarray) -> np.ndarray:
    """For each vector the first of its near copies: itself, or an earlier one that leads itself."""
    length = np.einsum("ij,ij->i", x, x)
    lead, heads = np.arange(len(x)), np.zeros(0, np.int64)
    for i in range(0, len(x), INSERTED):
        own = np.arange(i, min(len(x), i + INSERTED))

        def far(to: np.ndarray) -> np.ndarray:
            return length[own, None] + length[to] - 2 * (x[own] @ x[to].T) - NEAR * length[to]

        free = np.ones(len(own), bool)
        for j in range(0, len(heads), 16 * INSERTED):
            part = heads[j : j + 16 * INSERTED]
            d = far(part)
            best = d.argmin(1)
            hit = free & (d[np.arange(len(own)), best] <= 0)
            lead[own[hit]] = part[best[hit]]
            free &= ~hit
        near = far(own) <= 0
        np.fill_diagonal(near, False)
        for j in np.flatnonzero(free & near.any(1)):
            if free[j]:
                copies = np.flatnonzero(near[:, j] & free)
                copies = copies[copies > j]
                lead[own[copies]], free[copies] = own[j], False
        heads = np.concatenate([heads, own[free]])
    return lead


class Graph:
    """Layers of neighbour lists over unit vectors. Beams of many queries go forward together, in single precision; results are
    compared as exact search does: the product in double precision, left to right, as a float, ties to the smaller id.

    Near copies of a vector are no nodes of their own, or they would fill a beam and end it: they lie in a group with it, with the
    largest distance from it, and are scored wherever one of them can be a result.

    A layer has members (nodes, sorted) and links, a row for each member: numbers of members, filled up with -1.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, m: int = M, ef: int = EF_BUILD, seed: int = 0):
        single = np.ascontiguousarray(vectors, np.float32)
        lead = leaders(single)
        order = np.lexsort((np.arange(len(lead)), lead != np.arange(len(lead))))  # nodes first, then the copies of each
        n = int((lead == np.arange(len(lead))).sum())
        node = np.empty(len(lead), np.int64)
        node[order[:n]] = np.arange(n)
        order[n:] = order[n:][np.argsort(lead[order[n:]], kind="stable")]
        copied = node[lead[order[n:]]]
        self.ids, self.m = np.asarray(ids)[order], m
        self.vectors = (single if np.array_equal(single, vectors) else np.asarray(vectors, float))[order]
        #: nodes with copies, where those begin and end, and how far they lie
        self.groups, first = np.unique(copied, return_index=True)
        self.copies = n + np.append(first, len(copied)).astype(np.int64)
        far = np.sqrt(((self.vectors[n:].astype(float) - self.vectors[copied]) ** 2).sum(1))
        self.radius = np.maximum.reduceat(far, first) if len(far) else far
        self.n = n
        rng = np.random.default_rng(seed)
        level = rng.geometric(1 - 1 / m, n) - 1
        self.members = [np.flatnonzero(level >= at) for at in range(int(level.max()) + 1 if n else 0)]
        self.links = [np.full((len(own), m if at else 2 * m), -1, np.int32) for at, own in enumerate(self.members)]
        # a step inserts no more vectors than are there, and the first all that a product compares at once
        done = 0
        while done < n:
            end = min(n, done + min(INSERTED, max(done, 256)))
            self._insert(done, end, level, ef)
            done = end
        self.entry = int(self.members[-1][0]) if n else -1
        # a search enters the lowest layer at the best of the next one too: groups of near copies are islands in effect,
        # and at the best of those that few links lead to, which beams pass by
        led = np.bincount(self.links[0][self.links[0] >= 0], minlength=n) if n else np.zeros(0, np.int64)
        self.islands = np.unique(np.concatenate([self._islands(), self.groups, np.flatnonzero(led < m), self.members[1] if len(self.members) > 1 else np.zeros(0, np.int64)])).astype(np.int64)

    @property
    def layers(self) -> list[dict[int, list[int]]]:
        return [{int(node): own[row[row >= 0]].tolist() for node, row in zip(own, links)} for own, links in zip(self.members, self.links)]

    def _islands(self) -> np.ndarray:
        """Nodes from which, with the entry, all others can be reached in the lowest layer: links to far groups, and to nodes that are nobody's nearest, can be lost."""
        seen = np.zeros(self.n, bool)
        found: list[int] = []
        for start in [self.entry, *range(self.n)] if self.entry >= 0 else []:
            if seen[start]:
                continue
            if start != self.entry:
                found.append(start)
            seen[start] = True
            open_ = np.asarray([start])
            while len(open_):
                near = self.links[0][open_].ravel()
                open_ = np.unique(near[(near >= 0) & ~seen[near]])
                seen[open_] = True
        return np.asarray(found, np.int64)

    def _rows(self, n: int) -> int:
        """Queries that go forward together over n members."""
        return max(16, min(512, STEP_CELLS // max(n, 1)))

    def _beam(self, q: np.ndarray, entries: np.ndarray, ef: int, layer: int) -> tuple[np.ndarray, np.ndarray]:
        """(members, likeness) of the ef best that a best-first search from entries finds for each query, best first, filled up with -1."""
        own, links = self.members[layer], self.links[layer]
        n, step = len(own), min(STEP, ef)
        # the place at which a member was met first
        stamp = np.full(len(q) * n, -1, np.int32)
        node = np.full((len(q), ef), -1, np.int64)
        like = np.full((len(q), ef), -np.inf, np.float32)
        open_ = np.zeros((len(q), ef), bool)

        def meet(row: np.ndarray, near: np.ndarray) -> None:
            """Score what was not met yet, and keep the best ef."""
            nonlocal node, like, open_
            cell = row * n + near
            fresh = stamp[cell] < 0
            row, near, cell = row[fresh], near[fresh], cell[fresh]
            place = np.arange(len(cell), dtype=np.int32)
            stamp[cell] = place  # of a member that stands twice, one place stays
            once = stamp[cell] == place
            row, near = row[once], near[once]
            s = np.einsum("ij,ij->i", self.vectors[own[near]].astype(np.float32, copy=False), q[row])
            good = s > like[row, -1]
            row, near, s = row[good], near[good], s[good]
            if not len(row):
                return
            hit, first, count = np.unique(row, return_index=True, return_counts=True)
            at = np.arange(len(row)) - np.repeat(first, count)
            more = np.full((len(hit), int(count.max())), -np.inf, np.float32)
            names = np.full(more.shape, -1, np.int64)
            line = np.repeat(np.arange(len(hit)), count)
            more[line, at], names[line, at] = s, near
            all_like = np.concatenate([like[hit], more], 1)
            best = np.argpartition(-all_like, ef - 1, axis=1)[:, :ef]
            worst = np.take_along_axis(all_like, best, 1).argmin(1)  # the last place holds the least
            rows = np.arange(len(hit))
            best[rows, worst], best[:, -1] = best[:, -1].copy(), best[rows, worst]
            like[hit] = np.take_along_axis(all_like, best, 1)
            node[hit] = np.take_along_axis(np.concatenate([node[hit], names], 1), best, 1)
            open_[hit] = np.take_along_axis(np.concatenate([open_[hit], names >= 0], 1), best, 1)

        row, col = np.nonzero(entries >= 0)
        meet(row, entries[row, col])
        while len(active := np.flatnonzero(open_.any(1))):
            waiting = np.where(open_[active], like[active], -np.inf)
            next_ = np.argpartition(-waiting, step - 1, axis=1)[:, :step] if step < ef else np.tile(np.arange(ef), (len(active), 1))
            line, col = np.nonzero(np.take_along_axis(open_[active], next_, 1))
            row, col = active[line], next_[line, col]
            open_[row, col] = False
            near = links[node[row, col]]
            there = near >= 0
            meet(np.repeat(row, there.sum(1)), near[there].astype(np.int64))
        order = np.argsort(-like, axis=1, kind="stable")
        return np.take_along_axis(node, order, 1), np.take_along_axis(like, order, 1)

    def _below(self, found: np.ndarray, layer: int) -> np.ndarray:
        """Members of a layer as members of the next lower one."""
        return np.where(found >= 0, np.searchsorted(self.members[layer - 1], self.members[layer][found]), -1)

    def _insert(self, begin: int, end: int, level: np.ndarray, ef: int) -> None:
        """Vectors begin to end are linked to what is there and to each other."""
        x = self.vectors[begin:end].astype(np.float32, copy=False)
        inside = x @ x.T
        np.fill_diagonal(inside, -np.inf)
        entries = np.full((end - begin, 1), -1, np.int64)
        for layer in range(len(self.members) - 1, -1, -1):
            own = self.members[layer]
            lo, hi = np.searchsorted(own, [begin, end])
            new = level[begin:end] >= layer
            if not lo:  # nothing there yet
                found, like = np.full((end - begin, 1), -1, np.int64), np.full((end - begin, 1), -np.inf, np.float32)
            else:
                entries[entries[:, 0] < 0, 0] = 0
                found, like = np.full((end - begin, ef), -1, np.int64), np.full((end - begin, ef), -np.inf, np.float32)
                for wanted, width in ((new, ef), (~new, 1)):
                    rows, size = np.flatnonzero(wanted), self._rows(len(own))
                    for i in range(0, len(rows), size):
                        part = rows[i : i + size]
                        found[part, :width], like[part, :width] = self._beam(x[part], entries[part], width, layer)
            if hi > lo:
                near = inside[np.ix_(new, new)]
                k = min(self.m, hi - lo)
                top = np.argpartition(-near, k - 1, axis=1)[:, :k]
                s = np.take_along_axis(near, top, 1)
                both = np.concatenate([like[new], s], 1)
                names = np.concatenate([found[new], np.where(s > -np.inf, top + lo, -1)], 1)
                order = np.argsort(-both, axis=1, kind="stable")[:, : self.m]
                self._link(layer, np.repeat(np.arange(lo, hi), order.shape[1]), np.take_along_axis(names, order, 1).ravel())
            if layer:
                entries = self._below(found, layer)

    def _link(self, layer: int, node: np.ndarray, near: np.ndarray) -> None:
        """Links both ways between members. Who has too many keeps the most, first those to neighbours that are nearer to it than to any one kept: else a group of near copies links to itself alone."""
        links, own = self.links[layer], self.members[layer]
        most, n = links.shape[1], len(own)
        node, near = node[near >= 0], near[near >= 0]
        touched = np.unique(np.concatenate([node, near]))
        old = links[touched]
        at, col = np.nonzero(old >= 0)
        pairs = np.unique(np.concatenate([touched[at] * n + old[at, col], node * n + near, near * n + node]))
        node, near = pairs // n, pairs % n
        first = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])) if len(node) else np.zeros(0, np.int64)
        count = np.diff(np.append(first, len(node)))
        by_count = np.argsort(count, kind="stable")
        i = 0
        while i < len(by_count):
            size = max(1, min(1024, STEP_CELLS // int(count[by_count[min(len(by_count), i + 1024) - 1]]) ** 2))
            part = by_count[i : i + size]
            i += size
            width = int(count[part].max())
            rows = first[part][:, None] + np.arange(width)
            there = np.arange(width) < count[part][:, None]
            names = np.where(there, near[np.minimum(rows, len(near) - 1)], -1)
            centre = node[first[part]]
            if width > most:
                x = self.vectors[own[names]].astype(np.float32, copy=False)
                s = np.einsum("ijk,ik->ij", x, self.vectors[own[centre]].astype(np.float32, copy=False))
                s[~there] = -np.inf
                order = np.argsort(-s, axis=1, kind="stable")
                names, s = np.take_along_axis(names, order, 1), np.take_along_axis(s, order, 1)
                x = np.take_along_axis(x, order[:, :, None], 1)
                between = x @ x.transpose(0, 2, 1)
                covered = names < 0
                kept = np.zeros(names.shape, bool)
                for j in range(width):
                    kept[:, j] = ~covered[:, j]
                    covered |= kept[:, j, None] & (between[:, j] > s)
                kept |= (count[part] <= most)[:, None] & (names >= 0)
                rest = np.where(kept, 0, np.where(names >= 0, 1, 2))
                names = np.take_along_axis(names, np.argsort(rest, axis=1, kind="stable")[:, :most], 1)
            links[centre, : names.shape[1]] = names
            links[centre, names.shape[1] :] = -1

    def _copies(self, single: np.ndarray, needed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, vector, likeness) of the near copies that can have the likeness needed: by Cauchy-Schwarz none of a group has more than its node and the radius allow."""
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))]
        if not len(self.groups):
            return out[0]
        bound = single @ self.vectors[self.groups].astype(np.float32, copy=False).T + np.sqrt((single * single).sum(1))[:, None] * self.radius
        row, group = np.nonzero(bound + 1e-5 * (1 + np.abs(bound)) >= needed[:, None])
        begin, count = self.copies[group], self.copies[group + 1] - self.copies[group]
        ends = np.cumsum(count)
        at = 0
        while at < len(row):  # copies of some groups at a time
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (1 << 16), "right")))
            own = count[at:to]
            place = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
            r, v = np.repeat(row[at:to], own), np.repeat(begin[at:to], own) + place
            s = np.einsum("ij,ij->i", self.vectors[v].astype(np.float32, copy=False), single[r])
            good = s >= needed[r]
            out.append((r[good], v[good], s[good]))
            at = to
        return tuple(np.concatenate(x) for x in zip(*out))

    def search_many(self, q: np.ndarray, k: int, ef: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, id, score) of the k best of each query, best first, that a beam of ef nodes finds; its width grows with the root of the graph's size where none is given."""
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))]
        ef = min(max(ef or max(EF_SEARCH, BEAM * math.isqrt(self.n)), k), max(self.n, 1))
        size = self._rows(self.n)
        for i in range(0, len(q) if self.entry >= 0 and k > 0 else 0, size):
            own = np.asarray(q[i : i + size], float)
            single = own.astype(np.float32)
            entries = np.zeros((len(own), 1), np.int64)
            for layer in range(len(self.members) - 1, 0, -1):
                entries = self._below(self._beam(single, entries, 1, layer)[0], layer)
            if len(self.islands):
                near = single @ self.vectors[self.islands].astype(np.float32, copy=False).T
                wide = min(len(self.islands), max(1, ef // 2))
                entries = np.concatenate([entries, self.islands[np.argpartition(-near, wide - 1, axis=1)[:, :wide]]], 1)
            node, like = self._beam(single, entries, ef, 0)
            # single precision does not tell what lies this close to the k-th
            kth = like[:, k - 1] if k <= ef else np.full(len(own), -np.inf, np.float32)
            needed = np.where(np.isfinite(kth), kth - 1e-5 * (1 + np.abs(kth)), -np.inf)
            row, col = np.nonzero((node >= 0) & (like >= needed[:, None]))
            copies = self._copies(single, needed)
            row, node, like = (np.concatenate(x) for x in zip((row, node[row, col], like[row, col]), copies))
            if len(copies[0]):  # they may have raised the k-th
                order = np.lexsort((-like, row))
                row, node, like = row[order], node[order], like[order]
                kth = np.full(len(own), -np.inf)
                at = np.flatnonzero(np.arange(len(row)) - np.searchsorted(row, row) == k - 1)
                kth[row[at]] = like[at] - 1e-5 * (1 + np.abs(like[at]))
                good = like >= kth[row]
                row, node = row[good], node[good]
            score = np.zeros(len(row))
            for j in range(own.shape[1]):  # left to right
                score += own[row, j] * self.vectors[node, j]
            score, id_ = score.astype(np.float32), self.ids[node]
            order = np.lexsort((id_, -score, row))
            row, id_, score = row[order], id_[order], score[order]
            keep = np.arange(len(row)) - np.searchsorted(row, row) < k
            out.append((row[keep] + i, id_[keep], score[keep]))
        return tuple(np.concatenate(x) for x in zip(*out))

    def search(self, q: np.ndarray, k: int, ef: int | None = None) -> list[tuple[int, float]]:
        """(id, score) of the k best for one query."""
        _, ids, scores = self.search_many(np.asarray(q, float)[None], k, ef)
        return [(int(i), float(s)) for i, s in zip(ids, scores)]


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one dimension, in their own precision."""
    width = len(column[0]) if len(column) else 0
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(flat) != width * len(column):
        raise ValueError("vectors differ in their dimension")
    return flat.reshape(-1, width)


def build_graphs(dealt: DataFrame, n: int, seed: int, m: int, ef: int) -> DataFrame:
    """(shard, part, graph): a graph for each shard of vectors (shard, chunk_id, embedding), serialised and cut into pieces; shards are numbers below n, and each has a task of its own."""

    def made(shard: int, held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        ids, x = (np.concatenate(p) for p in zip(*held))
        held.clear()
        blob = pickle.dumps(Graph(ids, x, m, ef, seed + shard), pickle.HIGHEST_PROTOCOL)
        for part in range(-(-len(blob) // PIECE)):
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([part], pa.int32()), pa.array([blob[part * PIECE : (part + 1) * PIECE]], pa.binary())], names=["shard", "part", "graph"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        at = -1
        for b in batches:
            shard = b.column(0).to_numpy()
            for lo, hi in runs(shard):
                if held and shard[lo] != at:
                    yield from made(at, held)
                part, at = b.slice(lo, hi - lo), int(shard[lo])
                held.append((part.column(1).to_numpy(), matrix(part.column(2))))
        if held:
            yield from made(at, held)

    small_batches(dealt.sparkSession)
    own = dealt.select(F.col("shard").cast("int"), F.col("chunk_id").cast("long"), "embedding").repartitionById(max(n, 1), F.col("shard").cast("int"))
    return own.sortWithinPartitions("shard", "chunk_id").mapInArrow(run, "shard int, part int, graph binary")


def runs(x: np.ndarray) -> Iterator[tuple[int, int]]:
    """Where equal neighbours begin and end."""
    first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
    yield from zip(first.tolist(), [*first[1:].tolist(), len(x)])


def ask_graphs(pieces: DataFrame, asked: DataFrame, lots: list[tuple[int, int]], k: int, ef: int | None) -> DataFrame:
    """(qid, chunk_id, score): each shard's k best for its queries asked (shard, qid, embedding), in as many lots as the list of (shard, lots) says.

    A lot has a task of its own, to which its graph comes in pieces: neither Spark nor a row ever holds a whole one.
    """
    spark, last = asked.sparkSession, 2**31 - 1
    first = np.cumsum([0, *(n for _, n in lots)]).tolist()
    places = F.broadcast(spark.createDataFrame([(s, f, n) for (s, n), f in zip(lots, first)], "shard int, first int, lots int"))  # a row for each graph
    lot = F.pmod(F.xxhash64("qid"), F.col("lots")).cast("int")
    own = asked.select("shard", F.col("qid").cast("long"), "embedding").join(places, "shard").withColumn("lot", lot)
    copies = pieces.select("shard", "part", "graph").join(places, "shard").withColumn("lot", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)))
    task = (F.col("first") + F.col("lot")).cast("int").alias("task")
    none = F.lit(None)
    both = copies.select(task, "part", "graph", none.cast("long").alias("qid"), none.cast(asked.schema["embedding"].dataType).alias("embedding")).unionByName(
        own.select(task, F.lit(last).alias("part"), none.cast("binary").alias("graph"), "qid", "embedding"))

    def found(graph: Graph, held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        qids, q = (np.concatenate(p) for p in zip(*held))
        if q.shape[1] != graph.vectors.shape[1]:
            raise ValueError(f"a query has {q.shape[1]} dimensions, the index {graph.vectors.shape[1]}")
        row, ids, score = graph.search_many(q, k, ef)
        return pa.RecordBatch.from_arrays([pa.array(qids[row]), pa.array(ids), pa.array(score)], names=["qid", "chunk_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, blobs, graph = -1, [], None
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for b in batches:
            task_ = b.column(0).to_numpy()
            for lo, hi in runs(task_):
                part = b.slice(lo, hi - lo)
                if task_[lo] != at:
                    if held:
                        yield found(graph, held)
                    at, blobs, graph, held = int(task_[lo]), [], None, []
                n = int((part.column(1).to_numpy() != last).sum())  # pieces come first, in their order
                blobs += part.column(2).slice(0, n).to_pylist()
                if n == part.num_rows:
                    continue
                if graph is None:
                    graph, blobs = pickle.loads(b"".join(blobs)), []
                for i in range(n, part.num_rows, ASKED):
                    some = part.slice(i, ASKED)
                    held.append((some.column(3).to_numpy(), matrix(some.column(4))))
                    if sum(len(x) for x, _ in held) >= ASKED:
                        yield found(graph, held)
                        held = []
        if held:
            yield found(graph, held)

    small_batches(spark)
    dealt = both.repartitionById(max(first[-1], 1), F.col("task")).sortWithinPartitions("task", "part", "qid")
    return dealt.mapInArrow(run, "qid long, chunk_id long, score float")


def build_hnsw(vectors: DataFrame, seed: int = 0, shards: int | None = None, m: int = M, ef: int = EF_BUILD) -> DataFrame:
    """(shard, part, graph): one serialised graph a shard of vectors (chunk_id, embedding), in pieces. The same vectors and seed give the same graphs."""
    dimension(vectors)
    n = shards or max(1, -(-vectors.count() // SHARD))
    return build_graphs(vectors.select(F.pmod(F.xxhash64("chunk_id"), F.lit(n)).cast("int").alias("shard"), "chunk_id", "embedding"), n, seed, m, ef)


def search_hnsw(index: DataFrame, queries: DataFrame, k: int, ef: int | None = None) -> DataFrame:
    """(qid, rank, chunk_id, score) for queries (qid, embedding): every shard is searched, by lots of queries, and the best are merged."""
    lots = max(1, -(-queries.count() // QUERY_LOT))
    shards = sorted(r["shard"] for r in index.select("shard").distinct().collect())
    if not shards or k <= 0:
        return top_k(queries.sparkSession.createDataFrame([], "qid long, chunk_id long, score float"), k)
    asked = queries.select(F.explode(F.array(*map(F.lit, shards))).alias("shard"), "qid", "embedding")
    return top_k(ask_graphs(index, asked, [(s, lots) for s in shards], k, ef), k)


def recall(approximate: DataFrame, exact: DataFrame) -> DataFrame:
    """(recall): the part of exact results (qid, chunk_id) that the approximate ones have."""
    hit = approximate.select("qid", "chunk_id", F.lit(1).alias("hit"))
    return exact.select("qid", "chunk_id").join(hit, ["qid", "chunk_id"], "left").agg((F.count("hit") / F.count(F.lit(1))).alias("recall"))
