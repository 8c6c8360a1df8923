"""Language-model scoring with a hashed maximum-entropy model.

The distribution of a word given its history is factored into classes of classes: the HEAD most frequent words
and the classes of all others are the leaves of a 16-ary Huffman tree, and each inner node holds a softmax over
its children. A frequent word takes one or two decisions, a rare one more, so the mean cost grows with the
entropy of the words and not with their number. Words beyond the head fall into TAIL classes by their ending;
inside its class a word goes by its count. Features are hashed: the last word, the one before it (a skip) and
both together (a trigram); with a node each owns a row of 16 weights. Probabilities sum to one over all words
seen in training and one unseen word for each tail class.

What is gathered grows with the input: the counts of all words (a table), the leaves up to HEAD, and the rows of
weights, one for every TOKENS_A_ROW training tokens, between LEAST_ROWS and MOST_ROWS. HEAD and MOST_ROWS bound
what is broadcast (64 MB of weights); words beyond the head are joined by shuffle.

Training is data-parallel: every training document is seen once, in ROUNDS rounds. In a round each task runs
AdaGrad over its documents from the weights of the round before and hands on, in blocks of rows, what it
changed, weighted by how often; a tree of streaming sums adds FAN_IN parts of a block at a time until one of
each is left, so no task holds more than its own model and two blocks, and the driver gets the model once.
Scoring runs over sparse batches in numpy.

Edge cases: a null text counts as empty and has one token, its end; a null id hashes as the empty text;
repeated rows are scored alike (and count each in training); with no training rows every token is unseen and
its probability is that of its tail class, by the classes' number; an empty table gives an empty result. Only
the columns named are read, so further columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import crc32_of_id, ddl, map_slices, slices, stash, table

END = b"\n"  # no word holds it
WIDTH = 16
#: Words that are broadcast, at most, and classes of the others.
HEAD = 1 << 17
TAIL = 256
FEATURES = 3
TOKENS_A_ROW = 2048
LEAST_ROWS, MOST_ROWS = 1 << 15, 1 << 20
#: Rows of weights handed on at once.
BLOCK = 1 << 12
ROUNDS = ((0, 1, 3), (4, 5, 6))  # remainders mod 7 of the documents of a round; 2 is held out
HELD_OUT = 2
RATE = 0.15
BATCH = 1 << 15
#: Tokens whose decisions are worked out together: few enough to stay in the cache.
STEP = 1 << 11
FAN_IN = 16


def tail_class(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % TAIL


def tree(mass: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A WIDTH-ary Huffman tree over leaves of some mass: (path starts, nodes, branches, log-priors [node, branch]).

    Leaf i decides at nodes[starts[i]:starts[i + 1]], from the root, for the branches beside them.
    """
    n = len(mass)
    heap = [(float(m), i) for i, m in enumerate(mass)]
    heapq.heapify(heap)
    parent: dict[int, tuple[int, int]] = {}
    priors: list[list[float]] = []
    take = (n - 2) % (WIDTH - 1) + 2 if n > 1 else 1  # so that every further node is full
    while len(heap) > 1 or not priors:
        some = [heapq.heappop(heap) for _ in range(min(take, len(heap)))]
        take = WIDTH
        node, total = len(priors), sum(m for m, _ in some)
        for branch, (_, x) in enumerate(some):
            parent[x] = (node, branch)
        priors.append([np.log(m / total) for m, _ in some] + [-40.0] * (WIDTH - len(some)))
        heapq.heappush(heap, (total, n + node))
    starts, nodes, branches = [0], [], []
    for i in range(n):
        path, x = [], i
        while x in parent:
            path.append(parent[x])
            x = n + parent[x][0]
        nodes += [p[0] for p in reversed(path)]
        branches += [p[1] for p in reversed(path)]
        starts.append(len(nodes))
    return np.array(starts, np.int64), np.array(nodes, np.int64), np.array(branches, np.int64), np.array(priors, np.float32)


@dataclass
class Vocabulary:
    """Frequent words with their counts, sums over all training tokens, and tokens and words of each tail class."""

    words: list[bytes]
    counts: np.ndarray
    tokens: int  # N
    distinct: int  # V
    tail_tokens: np.ndarray
    tail_words: np.ndarray

    def __post_init__(self):
        self.rank = {w: i for i, w in enumerate(self.words)}
        self.log_counts = np.r_[np.log10(self.counts + 1.0), np.zeros(TAIL)]
        self.tail_total = np.log10(self.tail_tokens + self.tail_words + 1.0)  # inside a class: (c + 1) / total
        self.starts, self.nodes, self.branches, self.priors = tree(np.r_[self.counts, self.tail_tokens + 1.0])
        self.mixes = (self.nodes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
        wanted = max(1, self.tokens // TOKENS_A_ROW)
        self.rows = min(MOST_ROWS, max(LEAST_ROWS, 1 << (wanted - 1).bit_length()))


def hashed(parts: list[np.ndarray], seed: int) -> np.ndarray:
    h = np.full(len(parts[0]), seed, np.uint64)
    for p in parts:
        h = (h ^ p.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


class Tokens:
    """Tokens of a slice: leaves (ranks, or the tail class after them), words beyond the head, features."""

    def __init__(self, texts: list[bytes], v: Vocabulary):
        get, none = v.rank.get, len(v.words)
        cut = [t.lower().split() for t in texts]
        for c in cut:
            c.append(END)
        self.lengths = np.fromiter(map(len, cut), np.int64, len(cut))
        self.starts = np.r_[0, np.cumsum(self.lengths)[:-1]].astype(np.int64)
        flat = list(chain.from_iterable(cut))
        self.leaf = np.fromiter(map(get, flat, repeat(none)), np.int64, len(flat))
        self.beyond = np.flatnonzero(self.leaf == none)
        self.rare = [flat[i] for i in self.beyond.tolist()]
        self.leaf[self.beyond] = np.fromiter(map(tail_class, self.rare), np.int64, len(self.rare)) + none
        ids = self.leaf + 2
        one, two = np.zeros_like(ids), np.zeros_like(ids)
        one[1:], two[2:] = ids[:-1], ids[:-2]
        one[self.starts] = two[self.starts] = 0
        second = self.starts + 1
        two[second[second < len(two)]] = 0
        self.features = np.stack([hashed([one], 1), hashed([two], 2), hashed([one, two], 3)])


class Model:
    def __init__(self, v: Vocabulary, weights: bytes | None = None):
        self.v = v
        self.w = np.zeros((v.rows, WIDTH), np.float32) if weights is None else np.frombuffer(weights, np.float32).reshape(v.rows, WIDTH)
        self.shift = np.uint64(64 - (v.rows.bit_length() - 1))

    def decisions(self, t: Tokens, lo: int, hi: int) -> tuple:
        """(token, branch, rows of weights by feature, exponentials, their sums, scores) of the decisions of tokens lo to hi."""
        v, leaf = self.v, t.leaf[lo:hi]
        first = v.starts[leaf]
        n = v.starts[leaf + 1] - first
        token = np.repeat(np.arange(hi - lo), n)
        at = np.repeat(first - (np.cumsum(n) - n), n)
        at += np.arange(len(token))
        branch, mix = v.branches[at], v.mixes[at]
        rows = np.empty((FEATURES, len(token)), np.int64)
        z = np.take(v.priors, v.nodes[at], 0)
        for feature, row in zip(t.features, rows, strict=True):
            h = feature[lo:hi][token]
            h ^= mix
            h *= np.uint64(0x9E3779B97F4A7C15)
            h >>= self.shift
            row[:] = h
            z += np.take(self.w, row, 0)
        picked = z[np.arange(len(z)), branch]
        np.exp(z, out=z)  # scores stay small: no maximum needs taking off
        return token, branch, rows, z, z @ np.ones(WIDTH, np.float32), picked

    def log10(self, t: Tokens) -> np.ndarray:
        """log10 probability of each token's leaf; what tells the words of a tail class apart is left out."""
        out = np.zeros(len(t.leaf))
        for lo in range(0, len(out), STEP):
            hi = min(len(out), lo + STEP)
            token, _, _, _, total, picked = self.decisions(t, lo, hi)
            out[lo:hi] = np.bincount(token, picked.astype(np.float64) - np.log(total), hi - lo)
        return out / np.log(10)

    def learn(self, t: Tokens, state: np.ndarray, seen: np.ndarray) -> None:
        most = int(np.add.reduceat(np.diff(self.v.starts)[t.leaf], np.arange(0, len(t.leaf), BATCH)).max(initial=0))
        all_rows, columns = np.empty((FEATURES, most), np.int64), np.empty((WIDTH, most))
        place = np.zeros(self.v.rows, np.int32)
        for lo in range(0, len(t.leaf), BATCH):
            hi, n = min(len(t.leaf), lo + BATCH), 0
            for at in range(lo, hi, STEP):  # all from the weights before the batch
                _, branch, part, g, total, _ = self.decisions(t, at, min(hi, at + STEP))
                g *= (-1 / total)[:, None]
                g[np.arange(len(g)), branch] += 1
                all_rows[:, n : n + len(g)], columns[:, n : n + len(g)] = part, g.T
                n += len(g)
            rows = all_rows[:, :n]
            if self.v.rows <= rows.size:  # most rows are met: each is its own number
                times, number = sum(np.bincount(x, minlength=self.v.rows) for x in rows), rows
                row = own = np.flatnonzero(times)
            else:
                flat = rows.ravel()
                each = np.arange(len(flat), dtype=np.int32)
                place[flat] = each  # the last place of a row stands for it
                row = flat[place[flat] == each]
                place[row] = each[: len(row)]
                number, own = place[rows].astype(np.int64), np.arange(len(row))
                times = np.bincount(number.ravel(), minlength=len(row))
            sums = np.empty((WIDTH, len(times)))
            for total, g in zip(sums, columns[:, :n], strict=True):
                total[:] = sum(np.bincount(x, g, len(times)) for x in number)
            for i in range(0, len(row), 1 << 12):  # small enough to stay in the cache
                r, k = row[i : i + (1 << 12)], own[i : i + (1 << 12)]
                grad = np.ascontiguousarray(sums[:, k].T, np.float32)
                square = np.take(state, r, 0)
                square += grad * grad
                state[r] = square
                grad /= np.sqrt(square, out=square)
                grad *= RATE
                self.w[r] += grad
                seen[r] += times[k]


SUMS = "block int, part int, data binary"


def local_updates(docs: DataFrame, held, weights: bytes) -> DataFrame:
    """By task and block of rows: its changes times how often each row was met, and how often."""
    schema = to_arrow_schema(ddl(SUMS))
    start = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        v, task, model = held.value, TaskContext.get().partitionId(), None
        for part in slices(batches, ["text"]):
            if model is None:
                model = Model(v, start.value)
                model.w = model.w.copy()
                state, seen = np.ones(model.w.shape, np.float32), np.zeros(v.rows, np.float32)
            model.learn(Tokens(part["text"], v), state, seen)
        if model is None:
            return
        old = np.frombuffer(start.value, np.float32).reshape(model.w.shape)
        for lo in range(0, v.rows, BLOCK):
            n = seen[lo : lo + BLOCK, None]
            if n.any():
                data = np.concatenate([(model.w[lo : lo + BLOCK] - old[lo : lo + BLOCK]) * n, n], 1)
                yield pa.RecordBatch.from_arrays([pa.array([lo // BLOCK], pa.int32()), pa.array([task], pa.int32()), pa.array([data.tobytes()], pa.binary())], schema=schema)

    return docs.select("text").mapInArrow(run, SUMS)


def summed(parts: DataFrame, n: int, blocks: int) -> dict[int, np.ndarray]:
    """Sums of the arrays of each block, of ``n`` parts at most: a tree of tasks that each add FAN_IN of them as they stream by."""
    schema = to_arrow_schema(ddl(SUMS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        for b in batches:
            for i in range(b.num_rows):
                key, x = (b.column(0)[i].as_py(), b.column(1)[i].as_py()), np.frombuffer(b.column(2)[i].as_buffer(), np.float32)
                if key != now:
                    if now is not None:
                        yield row(*now, total)
                    now, total = key, x.copy()
                else:
                    total += x
        if now is not None:
            yield row(*now, total)

    def row(block: int, part: int, total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([part], pa.int32()), pa.array([total.tobytes()], pa.binary())], schema=schema)

    while n > 1:
        n = -(-n // FAN_IN)
        # about four blocks a task: each reads at most 4 * FAN_IN of them
        dealt = parts.withColumn("part", F.pmod("part", F.lit(n))).repartition(max(1, n * blocks // 4), "block", "part")
        parts = dealt.sortWithinPartitions("block", "part").mapInArrow(run, SUMS)
    return {r["block"]: np.frombuffer(r["data"], np.float32).reshape(-1, WIDTH + 1) for r in parts.select("block", "data").collect()}  # one model


def word_counts(docs: DataFrame) -> DataFrame:
    """word, c over all texts, ends included; words are counted per slice before the shuffle."""

    def run(part: dict) -> dict:
        c = Counter()
        for t in part["text"]:
            c.update(t.lower().split())
        c[END] = len(part["text"])
        return {"word": list(c), "c": list(c.values())}

    return map_slices(docs.select("text"), run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def vocabulary(counts: DataFrame) -> tuple[Vocabulary, int]:
    """The head words and the threshold: HEAD words at most have that count or more."""
    level = F.floor(F.log2("c") * 16)  # at most 16 levels an octave
    by = counts.groupBy(level.alias("level")).agg(F.count("*").alias("n"), F.sum("c").alias("c"), F.min("c").alias("low")).orderBy(F.desc("level")).collect()
    room, least = HEAD, None
    for r in by:
        room -= r["n"]
        if room < 0:
            break
        least = r["low"]
    found = counts.where(F.col("c") >= least).toArrow() if least is not None else None
    head = sorted(zip(found["word"].to_pylist(), found["c"].to_pylist(), strict=True), key=lambda r: (-r[1], r[0])) if found else []
    least = least or 1 << 62
    ending = F.crc32(F.expr("substring(word, greatest(1, length(word) - 2), 3)")) % TAIL
    tokens, words = np.zeros(TAIL, np.int64), np.zeros(TAIL, np.int64)
    for r in counts.where(F.col("c") < least).groupBy(ending.alias("k")).agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect():
        tokens[r["k"]], words[r["k"]] = r["c"], r["n"]
    v = Vocabulary([w for w, _ in head], np.array([c for _, c in head], np.int64), sum(r["c"] for r in by), sum(r["n"] for r in by), tokens, words)
    return v, least


def trained(docs: DataFrame, held, rounds=ROUNDS) -> bytes:
    """Weights after the rounds, from the documents outside the held-out fold."""
    fold, v = crc32_of_id(F.col("doc_id")) % 7, held.value
    w = np.zeros((v.rows, WIDTH), np.float32)
    for remainders in rounds:
        part = docs.where(fold.isin(*remainders))
        for block, got in summed(local_updates(part, held, w.tobytes()), part.rdd.getNumPartitions(), -(-v.rows // BLOCK)).items():
            w[block * BLOCK : (block + 1) * BLOCK] += got[:, :-1] / np.maximum(got[:, -1:], 1)
    return w.tobytes()


def rare_words(t: Tokens, of: pa.DataType) -> pa.Array:
    """By text: its words beyond the head and how often it has each, as lists of pairs of type ``of``."""
    ends = np.searchsorted(t.beyond, np.r_[t.starts, len(t.leaf)])
    words, times, offsets = [], [], [0]
    for a, b in zip(ends.tolist(), ends[1:].tolist(), strict=False):
        c = Counter(t.rare[a:b])
        words += c
        times += c.values()
        offsets.append(len(words))
    pairs = pa.StructArray.from_arrays([pa.array(words, pa.binary()), pa.array(times, pa.int64())], fields=list(of.value_type))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pairs, type=of)


ROWS = "key long, doc_id long, n_tokens long, known long, logs double, model double, rare array<struct<word: binary, n: long>>"


def score_documents(docs: DataFrame, name: str = "lm") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    fold = crc32_of_id(F.col("doc_id")) % 7
    counts = stash(word_counts(docs.where(fold != HELD_OUT)), f"{name}-counts")
    v, least = vocabulary(counts)
    held = spark.sparkContext.broadcast(v)  # at most HEAD words
    weights = spark.sparkContext.broadcast(trained(docs, held))  # at most MOST_ROWS rows

    def known_part(part: dict) -> dict:
        from pyspark import TaskContext

        v = held.value
        t, n = Tokens(part["text"], v), len(part["text"])
        per = lambda x: np.add.reduceat(x, t.starts)
        inside = t.leaf < len(v.words)
        own = Model(v, weights.value).log10(t) - np.where(inside, 0, np.r_[np.zeros(len(v.words)), v.tail_total][t.leaf])
        first = (TaskContext.get().partitionId() << 36) + numbers.setdefault("next", 0)
        numbers["next"] += n
        return {"key": np.arange(first, first + n), "doc_id": part["doc_id"], "n_tokens": t.lengths, "known": per(inside.astype(np.int64)), "logs": per(v.log_counts[t.leaf]), "model": per(own), "rare": rare_words(t, pairs)}

    numbers: dict[str, int] = {}
    pairs = to_arrow_schema(ddl(ROWS)).field("rare").type
    # the keys are made up while reading, so the rows are kept
    rows = stash(map_slices(docs, known_part, ROWS), f"{name}-rows")
    rare = rows.select("key", F.explode("rare").alias("r")).select("key", "r.word", "r.n").join(counts.where(F.col("c") < least), "word")
    sums = rare.groupBy("key").agg(F.sum("n").alias("rare_known"), F.sum(F.col("n") * F.log10(F.col("c") + F.lit(1.0))).alias("rare_logs"))  # a word not seen adds nothing
    out = rows.join(sums, "key", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("rare_known", "rare_logs")})
    base = np.log10(v.tokens + v.distinct + 1)
    return out.select(
        "doc_id", (fold == HELD_OUT).alias("held_out"), "n_tokens", (F.col("known") + F.col("rare_known")).cast("long").alias("n_known"), F.lit(v.tokens).cast("long").alias("train_tokens"),
        (F.col("logs") + F.col("rare_logs") - F.col("n_tokens") * F.lit(float(base))).alias("base_score"), (F.col("model") + F.col("rare_logs")).alias("score"),
    )


def op2_hashed_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
