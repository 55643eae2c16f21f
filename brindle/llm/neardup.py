"""Near-duplicate documents: improved consistent weighted sampling over TF-IDF shingles.

Shingles of five words weigh by count and inverse document frequency; frequencies come from a count
sketch of fixed size over all documents. Consistent weighted samples agree between two documents
with the probability of their weighted Jaccard similarity; bands of samples give candidates, and
candidates are verified by the weighted Jaccard similarity of their whole texts.

Candidates of a bucket are first the pairs with its least text. Buckets whose texts then still lie in
several classes are searched whole, in blocks: pairs of different classes whose samples agree enough
are verified. A text with many such partners gives its likeliest ones first; where it still has
others in a different class, all of them are compared inside the blocks, and links alone leave them.

Defined results: a text without a word (null, empty, punctuation alone) is in a class of its own;
equal texts are in one class; a class is named by its least id; rows with a null id take part, and
have their class's name; repeated rows have equal results; a text of fewer than five words is one
shingle; an empty table gives an empty result; further columns pass through `classes`, whose results
replace columns of the same names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, bucketed, doc_shingles, documents, done_with, has_rows, materialize, mix64, released, shielded, signed, shuffle_parts, small_batches
from .components import components

WIDTH, SIMILARITY = 5, 0.8
#: Samples of a document, in bands of ROWS: a pair at 0.8 shares no band once in 4,500 times.
ROWS, BANDS = 4, 16
SAMPLES = ROWS * BANDS
#: Cells of the frequency sketch, and cells of one row of its table.
CELLS, CELL_ROW = 1 << 20, 1 << 14
#: A pair at 0.8 agrees in fewer of the 64 samples than this once in 71,500 times.
LEAST_AGREE = 37
#: Texts of a block when a bucket is searched whole by samples, and by texts; partners of a text that are verified first.
BLOCK, TEXT_BLOCK, FIRST_PARTNERS = 512, 512, 8
#: Buckets with more than this part of all rows are hot; there are fewer of them than its inverse.
HOT_PART = 1 / 2000

_rng = np.random.default_rng(23)
_SEEDS = _rng.integers(1, 1 << 63, SAMPLES, dtype=np.uint64) * U64(2) + U64(1)
# Gamma(2, 1) draws by 16-bit numbers: the quantile at the middle of each step
_LEVEL = (np.arange(1 << 16) + 0.5) / (1 << 16)


def _gamma_quantile(p: np.ndarray) -> np.ndarray:
    """Inverse of 1 - (1 + x) exp(-x), by halving."""
    lo, hi = np.zeros_like(p), np.full_like(p, 60.0)
    for _ in range(60):
        mid = (lo + hi) / 2
        below = 1 - (1 + mid) * np.exp(-mid) < p
        lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
    return (lo + hi) / 2


_GAMMA = _gamma_quantile(_LEVEL).astype(np.float32)
_LOG_GAMMA = np.log(_gamma_quantile(_LEVEL)).astype(np.float32)


def sample(shingles: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """SAMPLES consistent weighted samples (32-bit hashes of shingle and weight level) of distinct shingles."""
    best = np.full(SAMPLES, np.inf, np.float32)
    out = np.zeros(SAMPLES, np.uint64)
    log_w = np.log(weights).astype(np.float32)
    for i in range(0, len(shingles), 1024):
        s = shingles[i : i + 1024, None]
        h = s * _SEEDS
        h ^= h >> U64(29)
        h *= U64(0x9FB21C651E98DF25)
        h ^= h >> U64(32)
        low = U64(0xFFFF)
        r = _GAMMA[(h & low).astype(np.intp)]
        log_c = _LOG_GAMMA[(h >> U64(16) & low).astype(np.intp)]
        beta = (h >> U64(48)).astype(np.float32) * np.float32(1 / (1 << 16))
        t = np.floor(log_w[i : i + 1024, None] / r + beta)
        a = log_c - r * (t - beta + 1)
        k = a.argmin(0)
        cols = np.arange(SAMPLES)
        found = a[k, cols]
        better = found < best
        best = np.where(better, found, best)
        level = t[k, cols].astype(np.int64).astype(np.uint64)
        out = np.where(better, mix64(s[k, 0] ^ level * U64(0xD6E8FEB86659FD93)), out)
    return (out >> U64(32)).astype(np.uint32)


def sketch_frequencies(docs: DataFrame, width: int) -> tuple[np.ndarray, int]:
    """Counts of documents by hashed shingle, over all documents; and how many documents there are.

    Tasks send rows of the sketch, which are added up as a stream: no task holds more than its own rows, the driver CELLS numbers.
    """
    spark = docs.sparkSession
    small_batches(spark)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(CELLS, np.int64), 0
        for b in batches:
            held: list[np.ndarray] = []
            for _, s in doc_shingles(b.column(0).to_pylist(), width):
                n += 1
                held.append(np.unique((s >> U64(44)).astype(np.int64)))
            if held:
                total += np.bincount(np.concatenate(held), minlength=CELLS)
        rows = [i for i in range(0, CELLS, CELL_ROW) if total[i : i + CELL_ROW].any()]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([*rows, -1], pa.int64()), pa.array([*(zlib.compress(total[i : i + CELL_ROW].tobytes(), 1) for i in rows), np.asarray([n]).tobytes()], pa.binary())], names=["at", "counts"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for at, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                c = np.frombuffer(c if at < 0 else zlib.decompress(c), np.int64)
                sums[at] = sums[at] + c if at in sums else c.copy()
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["at", "counts"])

    schema = "at long, counts binary"
    total, n = np.zeros(CELLS, np.int64), 0
    for r in docs.mapInArrow(released(count), schema).repartition(min(16, shuffle_parts(spark)), "at").mapInArrow(added, schema).collect():
        c = np.frombuffer(r["counts"], np.int64)
        if r["at"] < 0:
            n += int(c[0])
        else:
            total[r["at"] : r["at"] + CELL_ROW] += c
    return total, n


def idf_of(counts: np.ndarray, n: int) -> np.ndarray:
    """Augmented inverse document frequency by cell, between 0.5 and 1: half is the same for all, half falls with the logarithm of the frequency.

    A cell counts unrelated shingles too, about as many as the median cell; what lies within four deviations of that is
    taken for chance. So a rare shingle weighs 1 however large the corpus is, and one that stands out of its cell weighs less.
    """
    usual = float(np.median(counts))
    frequency = np.maximum(counts - (usual + 4 * np.sqrt(usual)), 1)
    most = np.log1p(max(n, 1))
    return (0.5 + 0.5 * np.log1p(n / frequency) / most).astype(np.float32)


def weighted(shingles: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, tf = np.unique(shingles, return_counts=True)
    return found, tf * idf[(found >> U64(44)).astype(np.int64)].astype(float)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of the lesser over sum of the greater weights."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    least = np.minimum(a[1][i], b[1][j]).sum()
    most = a[1].sum() + b[1].sum() - least
    return float(least / most) if most else 0.0


def signatures(docs: DataFrame, idf: np.ndarray, width: int) -> DataFrame:
    """(key, weight, bands, samples) of each text with a word; docs: (key, text), each text once."""
    small_batches(docs.sparkSession)
    mult = np.asarray([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], U64) | U64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, out = b.column(0).to_pylist(), []
            for i, s in doc_shingles(b.column(1).to_pylist(), width):
                if len(s):
                    found, w = weighted(s, idf)
                    sig = sample(found, w)
                    band = mix64((sig.reshape(BANDS, ROWS).astype(U64) * mult).sum(1, dtype=U64) + np.arange(BANDS, dtype=U64) * U64(0xA0761D6478BD642F))
                    out.append((keys[i], float(w.sum()), signed(band).tolist(), sig.tobytes()))
            if out:
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.list_(pa.int64())), pa.array(cols[3], pa.binary())], names=["key", "weight", "bands", "samples"])

    return docs.mapInArrow(released(run), "key long, weight double, bands array<long>, samples binary")


def verified(pairs: DataFrame, texts: DataFrame, idf: np.ndarray, width: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of text keys that are similar enough; texts: (key, text), one row a key."""
    met = pairs.join(texts.select(F.col("key").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("key").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)
        for batch in batches:
            a, b, ta, tb = (batch.column(i).to_pylist() for i in range(4))
            ok = np.zeros(len(a), bool)
            theirs = {i: weighted(s, idf) for i, s in doc_shingles(tb, width)}
            for i in range(len(a)):
                if a[i] != last[0]:
                    last = (a[i], weighted(next(iter(doc_shingles([ta[i]], width)))[1], idf))
                ok[i] = weighted_jaccard(last[1], theirs[i]) >= similarity
            yield pa.RecordBatch.from_arrays([pa.array(np.asarray(a, np.int64)[ok]), pa.array(np.asarray(b, np.int64)[ok])], names=["a", "b"])

    return met.mapInArrow(released(run), "a long, b long")


def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each cell (first column) of a sorted stream."""
    rest: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        ids = b.column(0).to_numpy(zero_copy_only=False)
        if rest and rest[-1].column(0)[0].as_py() != ids[0]:
            yield pa.Table.from_batches(rest)
            rest = []
        at = 0
        for c in np.flatnonzero(ids[1:] != ids[:-1]) + 1:
            yield pa.Table.from_batches([*rest, b.slice(at, c - at)])
            rest, at = [], c
        rest.append(b.slice(at))
    if rest:
        yield pa.Table.from_batches(rest)


class Cell:
    """Two blocks of a bucket, or one (side 2) with itself: rows (cell, side, band, key, class, weight, samples)."""

    def __init__(self, rows: pa.Table, similarity: float):
        self.side, band, self.key, self.own, self.weight = (rows.column(i).to_numpy() for i in range(1, 6))
        self.sig = np.frombuffer(b"".join(rows.column(6).to_pylist()), np.uint32).reshape(-1, SAMPLES)
        self.band, self.similarity = int(band[0]), similarity
        self.left, self.right = np.flatnonzero(self.side != 1), np.flatnonzero(self.side != 0)

    def partners(self, i: int, both: bool) -> tuple[np.ndarray, np.ndarray]:
        """Rows of another class that can be similar to row i, and their agreements; each pair only in the first band that it shares."""
        j = self.right[self.own[self.right] != self.own[i]]
        j = j[np.minimum(self.weight[j], self.weight[i]) >= self.similarity * np.maximum(self.weight[j], self.weight[i])]
        if both:
            j = j[self.key[j] > self.key[i]]
        same = self.sig[j] == self.sig[i]
        agree = same.sum(1)
        good = agree >= LEAST_AGREE
        j, agree, same = j[good], agree[good], same[good]
        first = same.reshape(-1, BANDS, ROWS).all(2).argmax(1) == self.band
        return j[first], agree[first]


def likely_pairs(batches: Iterator[pa.RecordBatch], similarity: float, first: int) -> Iterator[pa.RecordBatch]:
    """(a, b): partners of each text, at most `first` of a block; and (a, null) for a text with more."""
    for rows in cells(batches):
        cell = Cell(rows, similarity)
        out_a, out_b = [], []
        for i in cell.left:
            j, agree = cell.partners(i, cell.side[i] == 2)
            if len(j) > first:
                j = j[np.lexsort((cell.key[j], -agree))[:first]]
                out_a.append(int(cell.key[i]))
                out_b.append(None)
            out_a += [int(cell.key[i])] * len(j)
            out_b += cell.key[j].tolist()
        if out_a:
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])


def exact_links(batches: Iterator[pa.RecordBatch], idf: np.ndarray, width: int, similarity: float) -> Iterator[pa.RecordBatch]:
    """(a, b): links of side 0 to side 1, found by comparing all likely partners; one for each class that a text joins in a cell. Rows of Cell with asked and text."""
    for rows in cells(batches):
        cell = Cell(rows, similarity)
        asked = rows.column(7).to_numpy(zero_copy_only=False)
        texts = rows.column(8).to_pylist()
        held = {i: weighted(s, idf) for i, s in doc_shingles(texts, width)}
        out: list[tuple[int, int]] = []
        for i in np.flatnonzero(cell.side == 0):
            cell.right = np.flatnonzero(cell.side == 1)
            j, agree = cell.partners(i, False)
            j, agree = j[~(asked[j] & (cell.key[j] <= cell.key[i]))], agree[~(asked[j] & (cell.key[j] <= cell.key[i]))]  # a pair of two asked texts once
            joined: set[int] = set()
            for k in j[np.argsort(-agree, kind="stable")]:
                if int(cell.own[k]) not in joined and weighted_jaccard(held[i], held[k]) >= similarity:
                    joined.add(int(cell.own[k]))
                    out.append((int(cell.key[i]), int(cell.key[k])))
        if out:
            a, b = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def met(rows: DataFrame, other: DataFrame, hot: DataFrame, how: str = "inner") -> DataFrame:
    """rows joined with other on bucket, of which other has one row each. Rows of hot buckets stay where they are and get other's row by broadcast; hot (bucket) has fewer than 1 / HOT_PART rows."""
    few = F.broadcast(hot)
    cold = rows.join(few, "bucket", "left_anti").join(other, "bucket", how)
    return cold.unionByName(rows.join(F.broadcast(other.join(few, "bucket", "left_semi")), "bucket", how))


def in_blocks(buckets: DataFrame, sigs: DataFrame, own: DataFrame, hot: DataFrame) -> DataFrame:
    """Rows of Cell, sorted by cell. buckets: (bucket, band, key); own: (key, class). A bucket is dealt into blocks of about BLOCK texts, and two blocks meet in a cell of their own."""
    sized = buckets.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    rows = met(buckets, sized, hot).join(sigs.select("key", "weight", "samples").join(own, "key"), "key")
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cell = F.xxhash64("bucket", F.least("mine", "other"), F.greatest("mine", "other"))
    side = F.when(F.col("mine") == F.col("other"), 2).when(F.col("mine") < F.col("other"), 0).otherwise(1)
    dealt = rows.select(cell.alias("cell"), side.alias("side"), "band", "key", "class", "weight", "samples")
    return dealt.repartition(shuffle_parts(buckets.sparkSession), "cell").sortWithinPartitions("cell")


def asked_in_blocks(buckets: DataFrame, asked: DataFrame, sigs: DataFrame, own: DataFrame, texts: DataFrame, hot: DataFrame) -> DataFrame:
    """Rows of Cell with asked and text: in each bucket, blocks of the asked texts (side 0) meet blocks of all its texts (side 1)."""
    rows = buckets.join(asked.withColumn("asked", F.lit(True)), "key", "left").withColumn("asked", F.coalesce("asked", F.lit(False)))
    sized = rows.groupBy("bucket").agg(F.ceil(F.sum(F.col("asked").cast("int")) / TEXT_BLOCK).cast("int").alias("ours"), F.ceil(F.count(F.lit(1)) / TEXT_BLOCK).cast("int").alias("theirs")).where("ours > 0")
    full = sigs.select("key", "weight", "samples").join(own, "key").join(texts, "key")
    rows = met(rows, sized, hot).join(full, "key")
    h = F.xxhash64("key")
    lane = lambda side, mine, other: F.transform(F.sequence(F.lit(0), F.col(other) - 1), lambda o: F.struct(F.lit(side).alias("side"), (F.pmod(h, F.col(mine)) if side == 0 else o).cast("int").alias("x"), (o if side == 0 else F.pmod(h, F.col(mine))).cast("int").alias("y")))
    spots = F.when(F.col("asked"), F.concat(lane(0, "ours", "theirs"), lane(1, "theirs", "ours"))).otherwise(lane(1, "theirs", "ours"))
    dealt = rows.withColumn("spot", F.explode(spots)).select(F.xxhash64("bucket", "spot.x", "spot.y").alias("cell"), "spot.side", "band", "key", "class", "weight", "samples", "asked", "text")
    return dealt.repartition(shuffle_parts(buckets.sparkSession), "cell").sortWithinPartitions("cell")


def text_components(docs: DataFrame, width: int, similarity: float) -> DataFrame:
    """(key, class) of the keys of texts that have a near-duplicate; docs: (key, text)."""
    counts, n = sketch_frequencies(docs.select("text"), width)
    idf = idf_of(counts, n)
    # texts move once, copies are dropped before that; signatures and joins on the key find them in place
    with bucketed(docs.dropDuplicates(["key"]), "key", dealt=True) as texts:
        sigs = materialize(signatures(texts.select("key", "text"), idf, width), "signatures")
        buckets = sigs.select(F.posexplode("bands").alias("band", "bucket"), "key")
        firsts = materialize(buckets.groupBy("bucket").agg(F.min("key").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1"), "firsts")
        hot = firsts.where(F.col("n") > sigs.count() * BANDS * HOT_PART).select("bucket")
        shared = materialize(met(buckets, firsts.drop("n"), hot), "buckets")
        candidates = texts.join(shared.select("key").distinct(), "key", "left_semi")
        with bucketed(candidates, "key", dealt=True) as likely_texts:
            own = linked(sigs, shared, hot, likely_texts, idf, width, similarity)
    done_with(sigs, firsts, shared)
    return own.select(F.col("node").alias("key"), F.col("component").alias("class"))


def linked(sigs: DataFrame, shared: DataFrame, hot: DataFrame, texts: DataFrame, idf: np.ndarray, width: int, similarity: float) -> DataFrame:
    """(node, component): classes of the texts in shared buckets (bucket, band, key, a: the bucket's least key); texts: (key, text) of those."""
    pairs = shared.where("a <> key").select("a", F.col("key").alias("b")).distinct()
    edges = materialize(verified(pairs, texts, idf, width, similarity), "links")
    own = materialize(components(edges), "classes")

    def classed(rows: DataFrame, key: str, name: str) -> DataFrame:
        return rows.join(own.select(F.col("node").alias(key), F.col("component").alias(name)), key, "left").withColumn(name, F.coalesce(name, key))

    several = classed(shared, "key", "class").groupBy("bucket").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo <> hi")
    open_rows = materialize(met(shared.select("bucket", "band", "key"), several.select("bucket"), hot, "left_semi"), "open")
    used = [edges, open_rows]
    if has_rows(open_rows):
        first = FIRST_PARTNERS  # workers import the module anew
        keys = open_rows.select("key").distinct()
        likely = materialize(in_blocks(open_rows, sigs, classed(keys, "key", "class"), hot).mapInArrow(released(lambda it: likely_pairs(it, similarity, first)), "a long, b long"), "likely")
        more = materialize(verified(likely.where("b is not null"), texts, idf, width, similarity), "links")
        used += [likely, more, own]
        edges = edges.unionByName(more)
        own = materialize(components(edges), "classes")
        asked = likely.where("b is null").select(F.col("a").alias("key")).distinct()
        if has_rows(asked):
            rows = asked_in_blocks(open_rows, asked, sigs, classed(keys, "key", "class"), texts, hot)
            more = materialize(rows.mapInArrow(released(lambda it: exact_links(it, idf, width, similarity)), "a long, b long"), "links")
            used += [more, own]
            own = materialize(components(edges.unionByName(more)), "classes")
    done_with(*used)
    return own


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """docs with class_id (least id of the class) and n_class (its rows)."""
    names = [c for c in docs.columns if c not in ("class_id", "n_class")]
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.xxhash64(text).alias("key"), text.alias("text"), F.col(id_col).alias("id"))
    found = text_components(keyed.select("key", "text"), width, similarity)
    # a text without a word is alone: its row's id stands for its class
    wordless = ~text.rlike(r"[A-Za-z0-9\x{80}-\x{10FFFF}]")
    rows = docs.select(*names, F.xxhash64(text).alias("_key"), wordless.alias("_alone")).join(found.select(F.col("key").alias("_key"), F.col("class").alias("_class")), "_key", "left")
    rows = rows.withColumn("_class", F.coalesce("_class", "_key"))
    named = rows.where("not _alone").groupBy("_class").agg(F.min(id_col).alias("_id"), F.count(F.lit(1)).alias("_n"))
    out = rows.join(named, "_class", "left")
    return out.select(*names, F.when(F.col("_alone"), F.col(id_col)).otherwise(F.col("_id")).alias("class_id"), F.when(F.col("_alone"), F.lit(1)).otherwise(F.col("_n")).cast("long").alias("n_class"))


def op1_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return classes(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "class_id", "n_class")


def dedup_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class: the one with the least id; of a class without ids, one row of each text."""
    plain, own, back = shielded(docs)
    key = F.xxhash64(F.coalesce(F.col(own["text"]), F.lit("")))
    found = classes(plain.select(F.col(own["doc_id"]).alias("doc_id"), F.col(own["text"]).alias("text"), key.alias("_text")))
    kept = materialize(found.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).select(F.col("doc_id").alias("_id"), "_text").distinct(), "kept")
    rows = plain.withColumn("_key", key)
    once = rows.join(kept, rows[own["doc_id"]].eqNullSafe(kept["_id"]) & (rows["_key"] == kept["_text"]), "left_semi")
    return once.dropDuplicates([own["doc_id"], "_key"]).select(*back)
