"""Language-model scoring: a log-bilinear model trained in numpy by noise-contrastive estimation.

The model predicts a word's vector from the vectors of the two words before it, each scaled by a
vector of its place; the score of a word is an inner product plus a bias. Because a context's score
is a sum of two tables, one matrix product gives the normaliser of every context at once, and every
token's log-probability is exactly normalised. The most frequent words are classes of their own; all
others share a class with the words of the same ending, if the ending is frequent, or else UNKNOWN.
Inside a shared class a word has its add-one share of the class's count, and so have unseen words.

Texts are read once: the documents of a part share a dictionary, and from then on are numbers of its
words. Counts cover every training token. Training goes over the training tokens once, in ROUNDS; in
each, every task starts from the last average and its parameters are averaged by tokens again.

Defined results: a null text is empty and has its end token alone; a null id counts as an empty text
for the hold-out rule; repeated rows count and are scored one by one; an empty table gives an empty
result; without training tokens every count is 0; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, done_with, id_crc, materialize, released, shuffle_parts, small_batches

#: Classes of the model, with UNKNOWN, END and BEGIN, and those of endings among them; bytes of an ending; width of a word's vector.
CLASSES, ENDINGS, TAIL, WIDTH = 2048, 512, 3, 32
UNKNOWN, END, BEGIN = 0, 1, 2
#: Documents and tokens, about, of a part, which share a dictionary.
GROUP_DOCS, GROUP_TOKENS = 8192, 1 << 21
#: Tokens and noise words of a training step, its rate, and how often parameters are averaged in the one pass over the corpus.
STEP, NOISE, RATE, ROUNDS = 1024, 64, 0.15, 2
END_WORD = b""


def tokens(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case, and the end token, which is empty."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    found.append(END_WORD)
    return found


class Words(dict):
    """Numbers of words, given as they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Params:
    """Vectors of target words and of context words, scales of the two places, biases."""

    NAMES = ("target", "context", "scale", "bias")

    def __init__(self, target: np.ndarray, context: np.ndarray, scale: np.ndarray, bias: np.ndarray):
        self.target, self.context, self.scale, self.bias = target, context, scale, bias

    @classmethod
    def start(cls, share: np.ndarray, width: int = WIDTH, seed: int = 7) -> Params:
        """Small random vectors, and biases that give each class its share."""
        rng = np.random.default_rng(seed)
        n = len(share)
        made = rng.normal(0, 0.1, (n, width)), rng.normal(0, 0.1, (n, width)), np.ones((2, width)), np.log(np.maximum(share, 1e-12))
        return cls(*(a.astype(np.float32) for a in made))

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, n).ravel() for n in self.NAMES])

    def like(self, flat: np.ndarray) -> Params:
        out, at = [], 0
        for n in self.NAMES:
            a = getattr(self, n)
            out.append(flat[at : at + a.size].reshape(a.shape).copy())
            at += a.size
        return Params(*out)

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores by (word two back, word), by (word one back, word) with the bias, and log-normalisers by (two back, one back)."""
        far, near = (self.context * self.scale[0]) @ self.target.T, (self.context * self.scale[1]) @ self.target.T
        bias = self.bias.copy()
        bias[BEGIN] = -np.inf  # never a target
        top_far, top_near = far.max(1), (near + bias).max(1)
        z = np.exp(far - top_far[:, None]) @ np.exp(near + bias - top_near[:, None]).T
        norm = np.log(z) + top_far[:, None] + top_near[None, :]
        return far, near + self.bias, norm


class Sums:
    """Sums of rows by number, of one width all along: rows are added in their order, two numbers at a time, without a sort."""

    def __init__(self, size: int, width: int, dtype: np.dtype):
        self.total = np.zeros((size, width + width % 2), dtype)
        self.pairs = self.total.view(np.result_type(dtype, np.complex64)).ravel()
        self.places = np.arange(len(self.pairs)).reshape(size, -1)

    def of(self, index: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers that occur and the sums of their rows (as wide as total)."""
        there = np.flatnonzero(np.bincount(index, minlength=len(self.total)))
        np.add.at(self.pairs, self.places.take(index, axis=0).ravel(), rows.view(self.pairs.dtype).ravel())
        out = self.total.take(there, axis=0)
        self.total[there] = 0
        return there, out


def train_nce(p: Params, share: np.ndarray, triples: np.ndarray, weight: np.ndarray, rng: np.random.Generator, memory: list[np.ndarray], rate: float = RATE, step: int = STEP) -> None:
    """One pass of Adagrad steps over word triples (n x 3: two back, one back, word), in place."""
    kind, (n, width) = p.target.dtype, p.target.shape
    weight = weight.astype(kind)
    noise_log = (np.log(np.maximum(share, 1e-12)) + np.log(NOISE)).astype(kind)
    cdf = np.cumsum(share)
    order = rng.permutation(len(triples))
    triples, weight = np.ascontiguousarray(triples.take(order, axis=0).T), weight[order]
    # a target vector has its bias as one more column, and a made vector a 1 there; columns are even in number
    wide = width + 1 + (width + 1) % 2
    most = min(step, len(order))
    by_word, by_context = Sums(n, wide, kind), Sums(n, width, kind)
    rows, noise_rows = np.zeros((most + NOISE, wide), kind), np.zeros((NOISE, wide), kind)
    made_, scores_ = np.zeros((most, wide), kind), np.empty((most, NOISE), kind)
    context_rows = np.zeros((2 * most, by_context.total.shape[1]), kind)
    for at in range(0, len(order), step):
        far, near, word = triples[:, at : at + step]
        size = len(word)
        g_weight = weight[at : at + step] / weight[at : at + step].mean()
        g_weight *= 1 / size
        q_far, q_near, r_word = p.context.take(far, axis=0), p.context.take(near, axis=0), p.target.take(word, axis=0)
        made, g_noise = made_[:size], scores_[:size]
        np.multiply(q_far, p.scale[0], out=made[:, :width])
        made[:, :width] += q_near * p.scale[1]
        made[:, width] = 1
        noise = np.minimum(np.searchsorted(cdf, rng.random(NOISE) * cdf[-1]), n - 1)
        r_noise = p.target[noise]
        s_word = np.einsum("ij,ij->i", made[:, :width], r_word) + p.bias[word] - noise_log[word]
        g_word = -g_weight / (1 + np.exp(np.clip(s_word, -30, 30)))
        # in place, the largest array of a step: 1 / (1 + exp(-score)), to which a token's weight comes after the products
        np.negative(r_noise, out=noise_rows[:, :width])
        noise_rows[:, width] = noise_log[noise] - p.bias[noise]
        np.matmul(made, noise_rows.T, out=g_noise)
        np.clip(g_noise, -30, 30, out=g_noise)
        np.exp(g_noise, out=g_noise)
        g_noise += 1
        np.reciprocal(g_noise, out=g_noise)
        g_made = g_noise @ r_noise
        g_made *= g_weight[:, None]
        r_word *= g_word[:, None]
        g_made += r_word
        both = rows[: size + NOISE]
        np.multiply(made, g_weight[:, None], out=both[:size])
        np.matmul(g_noise.T, both[:size], out=both[size:])
        np.multiply(made, g_word[:, None], out=both[:size])
        where, grad = by_word.of(np.concatenate([word, noise]), both)
        sides = context_rows[: 2 * size]
        np.multiply(g_made, p.scale[0], out=sides[:size, :width])
        np.multiply(g_made, p.scale[1], out=sides[size:, :width])
        context_where, context_grad = by_context.of(np.concatenate([far, near]), sides)
        steps = [
            (0, where, grad[:, :width]),
            (3, where, grad[:, width]),
            (1, context_where, context_grad[:, :width]),
            (2, np.arange(2), np.stack([np.einsum("ij,ij->j", g_made, q_far), np.einsum("ij,ij->j", g_made, q_near)])),
        ]
        for k, where, grad in steps:
            mine = getattr(p, Params.NAMES[k])
            sums = grad * grad
            sums += memory[k].take(where, axis=0)
            memory[k][where] = sums
            sums += 1e-8
            np.sqrt(sums, out=sums)
            np.divide(grad, sums, out=sums)
            sums *= rate
            mine[where] = mine.take(where, axis=0) - sums


_PART = "part long, local int, word binary, n long, doc_ids array<long>, held array<boolean>, sizes array<int>, ids binary"


def coded(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Written: for each part one row of its documents (doc_ids, held, sizes, ids: numbers of its words, one after another), and a row for each of its words (local number, word, n in training documents)."""
    small_batches(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), (id_crc(id_col) % 7 == 2).alias("held_out"))
    names = [c.split()[0] for c in _PART.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary()]

    def batch(size: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[c], k) if c in columns else pa.nulls(size, k) for c, k in zip(names, kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part = (context.partitionId() if context else 0) << 24
        words, lines, ids, held, total = Words(), [], [], [], 0

        def hand_on() -> Iterator[pa.RecordBatch]:
            nonlocal part, total
            every = np.concatenate(lines)
            sizes = np.asarray([len(x) for x in lines], np.int32)
            seen = np.bincount(every[~np.repeat(np.asarray(held, bool), sizes)], minlength=len(words))
            yield batch(1, part=[part], doc_ids=[ids], held=[held], sizes=[sizes], ids=[every.tobytes()])
            found = list(words)
            for i in range(0, len(found), 1 << 16):
                cut = slice(i, i + (1 << 16))
                size = len(found[cut])
                yield batch(size, part=np.full(size, part), local=np.arange(i, i + size, dtype=np.int32), word=found[cut], n=seen[cut])
            part, total = part + 1, 0
            for x in (words, lines, ids, held):
                x.clear()

        for b in batches:
            for doc, text, out in zip(*(b.column(i).to_pylist() for i in range(3))):
                t = tokens(text)
                lines.append(np.fromiter(map(words.__getitem__, t), np.int32, len(t)))
                ids.append(doc)
                held.append(out)
                total += len(t)
                if len(ids) >= GROUP_DOCS or total >= GROUP_TOKENS:
                    yield from hand_on()
        if ids:
            yield from hand_on()

    return materialize(own.mapInArrow(released(run), _PART), "coded")


class Part:
    """The tokens of a part's documents as classes, with the two before each."""

    def __init__(self, sizes: np.ndarray, ids: np.ndarray, word_class: np.ndarray):
        line = np.full(len(ids) + 2 * len(sizes), BEGIN, np.int32)
        place = np.arange(len(ids)) + 2 * np.repeat(np.arange(1, len(sizes) + 1), sizes)
        line[place] = word_class[ids]
        self.two, self.one, self.word = line[place - 2], line[place - 1], line[place]


def _columns(b: pa.RecordBatch) -> Iterator[tuple]:
    """(doc ids, held out, sizes, ids, counts and classes of the part's words) of each row."""
    for doc_ids, held, sizes, ids, c, cls in zip(*(b.column(i) for i in range(6))):
        yield doc_ids.as_py(), held.as_py(), np.asarray(sizes.as_py(), np.int64), np.frombuffer(ids.as_py(), np.int32), np.frombuffer(c.as_py(), np.int64), np.frombuffer(cls.as_py(), np.int32)


def train(parts: DataFrame, share: np.ndarray, rate: float = RATE, step: int = STEP, rounds: int = ROUNDS) -> Params:
    """One pass over all training tokens, in rounds; in each the tasks' parameters are averaged as a stream, by their tokens."""
    now = Params.start(share)
    size = len(now.flat())

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, n = np.zeros(size), 0
        for b in batches:
            for s, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                out += np.frombuffer(s, np.float32).astype(float) * m
                n += m
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary()), pa.array([n])], names=["sum", "n"])

    schema = "sum binary, n long"
    for r in range(rounds):

        def run(batches: Iterator[pa.RecordBatch], first: Params = now, seed: int = 19 + r) -> Iterator[pa.RecordBatch]:
            p, memory = first.like(first.flat()), [np.zeros_like(getattr(first, n)) for n in Params.NAMES]
            rng = np.random.default_rng(seed)
            total = 0
            for b in batches:
                for _, held, sizes, ids, _, cls in _columns(b):
                    part = Part(sizes, ids, cls)
                    own = np.flatnonzero(~np.repeat(np.asarray(held, bool), sizes))
                    if len(own):
                        train_nce(p, share, np.stack([part.two[own], part.one[own], part.word[own]], 1), np.ones(len(own)), rng, memory, rate, step)
                    total += len(own)
            if total:
                yield pa.RecordBatch.from_arrays([pa.array([p.flat().tobytes()], pa.binary()), pa.array([total])], names=["sum", "n"])

        chosen = parts.where(F.pmod(F.xxhash64("part"), F.lit(rounds)) == r).drop("part")
        sums = chosen.mapInArrow(released(run), schema).repartition(8).mapInArrow(added, schema).collect()
        n = sum(x["n"] for x in sums)
        if n:
            now = now.like((sum(np.frombuffer(x["sum"]) for x in sums) / n).astype(np.float32))
    return now


_tables: list[tuple] = []  # of the last parameters that this worker has seen


def tables_of(shape: Params, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    key = flat.tobytes()
    if not _tables or _tables[0][0] != key:
        _tables[:] = [(key, shape.like(flat).tables())]
    return _tables[0][1]


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_classes: int = CLASSES, n_endings: int = ENDINGS, rate: float = RATE, step: int = STEP, rounds: int = ROUNDS) -> DataFrame:
    spark = docs.sparkSession
    parts = coded(docs, id_col, text_col)
    small_batches(spark)
    # a word's count stands at each of its rows, and one row a word is marked
    of_word = Window.partitionBy("word")
    words = parts.where("word is not null").select("part", "local", "word", "n")
    words = materialize(words.select("part", "local", "word", F.sum("n").over(of_word).alias("c"), (F.col("part") == F.min("part").over(of_word)).alias("mark")), "words")
    counts = words.where("mark and c > 0")
    totals = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.sum(F.when(F.length("word") == 0, F.col("c"))), F.lit(0))).first()
    n_all, n_distinct, n_end = map(int, totals)
    top = counts.where("length(word) > 0").orderBy(F.desc("c"), "word").limit(n_classes - n_endings - 3).select("word", "c").collect()
    known = F.broadcast(spark.createDataFrame([(r["word"], i + 3) for i, r in enumerate(top)], "word binary, own int"))
    tail = F.expr(f"substring(word, greatest(length(word) - {TAIL - 1}, 1), {TAIL})")
    rest = counts.where("length(word) > 0").join(known, "word", "left_anti")
    endings = rest.groupBy(tail.alias("tail")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).orderBy(F.desc("c"), "tail").limit(n_endings).collect()
    ends = F.broadcast(spark.createDataFrame([(r["tail"], i + 3 + len(top)) for i, r in enumerate(endings)], "tail binary, shared int"))
    size = 3 + len(top) + len(endings)
    share, distinct = np.zeros(size), np.zeros(size)
    share[END] = n_end
    share[3:] = [r["c"] for r in (*top, *endings)]
    share[UNKNOWN] = n_all - share.sum()
    distinct[3 + len(top) :] = [r["v"] for r in endings]
    distinct[UNKNOWN] = n_distinct - len(top) - distinct.sum() - (share[END] > 0)
    # the logarithm of a shared class's tokens, distinct words and one more; 0 marks a class of one word
    inner_log = np.zeros(size)
    several = [UNKNOWN, *range(3 + len(top), size)]
    inner_log[several] = np.log10(share[several] + distinct[several] + 1)
    alone = np.ones(size, bool)
    alone[several] = False
    share = (share + 1) / (n_all + size)
    share[BEGIN] = 0

    classed = words.withColumn("tail", tail).join(known, "word", "left").join(ends, "tail", "left")
    classed = classed.select("part", "local", "c", F.when(F.length("word") == 0, END).otherwise(F.coalesce("own", "shared", F.lit(UNKNOWN))).alias("class"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The counts and classes of a part's words, in the order of their numbers, in one row."""
        part, local, c, cls = None, [], [], []

        def row() -> pa.RecordBatch:
            number = np.concatenate(local)
            counted, classed = np.empty(len(number), np.int64), np.empty(len(number), np.int32)
            counted[number], classed[number] = np.concatenate(c), np.concatenate(cls)
            return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([counted.tobytes()], pa.binary()), pa.array([classed.tobytes()], pa.binary())], names=["part", "c", "class"])

        for b in batches:
            to, locals_, counts_, classes_ = (b.column(i).to_numpy() for i in range(4))
            cuts = [0, *(np.flatnonzero(to[1:] != to[:-1]) + 1), len(to)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo < hi:
                    if part is not None and to[lo] != part:
                        yield row()
                        local, c, cls = [], [], []
                    part = int(to[lo])
                    local.append(locals_[lo:hi])
                    c.append(counts_[lo:hi])
                    cls.append(classes_[lo:hi])
        if part is not None:
            yield row()

    dictionary = classed.repartition(shuffle_parts(spark), "part").sortWithinPartitions("part").mapInArrow(released(packed), "part long, c binary, class binary")
    lines = parts.where("word is null").select("part", "doc_ids", "held", "sizes", "ids")
    whole = materialize(lines.join(dictionary, "part").select("doc_ids", "held", "sizes", "ids", "c", "class", "part"), "parts")
    done_with(parts, words)
    flat = train(whole, share, rate, step, rounds).flat()
    shape = Params.start(share)
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    base_log = np.log10(n_all + n_distinct + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc_ids, held, sizes, ids, c, cls in _columns(b):
                far, near, norm = tables_of(shape, flat)
                part = Part(sizes, ids, cls)
                count_log = np.log10(c + 1.0)
                inner = np.where(alone[cls], 0.0, count_log - inner_log[cls])
                logs = (far[part.two, part.word].astype(float) + near[part.one, part.word] - norm[part.two, part.one]) / np.log(10) + inner[ids]
                starts = np.cumsum(sizes) - sizes  # each document has its end token at least
                by_doc = [np.add.reduceat(x, starts) for x in ((c > 0)[ids].astype(np.int64), count_log[ids] - base_log, logs)]
                rows = [doc_ids, held, sizes, by_doc[0], np.full(len(sizes), n_all), *by_doc[1:]]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, kinds)], names=names)

    return whole.drop("part").mapInArrow(released(run), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op5_lm_score(spark, sf_dir: str) -> DataFrame:
    return score_documents(documents(spark, sf_dir))
