"""Quality classifier: a factorisation machine over hashed words, structure statistics and length metadata.

score = sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i (v_if x_i)^2)): the pairwise
interactions cost time linear in the features. Features come from the whole text alone; labels, lang,
source and ids never enter. The model is fitted on the driver by mini-batch AdaGrad from at most
``Params.max_train`` labelled rows (those with the smallest hashes of their ids): a fixed, documented bound.

Edge cases: a null text counts as empty, and an empty text is scored from its length features; a null id is
passed through and never trains; repeated rows are scored alike, and a doc_id repeated in labels counts once
(its lowest label); with no training rows every score is 0.5; an empty table gives an empty result. Only the
columns named are read, so further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc32_of_id, kept_rows, map_slices, table

SCHEMA = "doc_id long, score double"
THRESHOLD = 0.3
SYMBOLS = b"#*$%&|<>@\\^_~{}[]="
DIGITS = b"0123456789"
UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
PUNCT = b".,;:!?"


@dataclass(frozen=True)
class Params:
    word_buckets: int = 1 << 15
    bins: int = 12
    rank: int = 8
    max_train: int = 8_000
    epochs: int = 12
    batch: int = 64
    rate: float = 0.08
    l2: float = 2e-5
    word_weight: float = 1.0


#: Structure statistics, each cut into Params.bins one-hot bins.
STATS = ("log_bytes", "log_words", "symbols", "digits", "upper", "punctuation", "word_length", "distinct", "repeat_lines", "line_words", "exclaimed", "capitalised")


def features(text: bytes, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Feature ids and values of one text."""
    words = text.split()
    n, size = len(words), len(text)
    low = Counter(w.lower() for w in words)
    without = lambda drop: size - len(text.translate(None, drop))
    lines = [x for x in text.split(b"\n") if x.strip()]
    per = lambda a, b: a / b if b else 0.0
    stats = (
        min(np.log2(size + 1) / 20, 1), min(np.log2(n + 1) / 17, 1), per(without(SYMBOLS), n), per(without(DIGITS), size) * 3,
        per(without(UPPER), without(UPPER) + without(LOWER)), per(without(PUNCT), n), per(size, n) / 16, per(len(low), n) ** 0.5,
        1 - per(len(set(lines)), len(lines)) if lines else 0.0, min(per(n, len(lines)) / 60, 1), per(text.count(b"!"), n), per(sum(w[:1].isupper() for w in words), n),
    )
    bins = [p.word_buckets + i * p.bins + min(p.bins - 1, int(s * p.bins)) for i, s in enumerate(stats)]
    ids = np.fromiter((zlib.crc32(w) % p.word_buckets for w in low), np.int64, len(low))
    counts = np.fromiter(low.values(), np.float32, len(low))
    if len(ids) > p.word_buckets:  # very long texts: a feature a bucket at most
        counts = np.bincount(ids, counts, p.word_buckets)
        ids = np.flatnonzero(counts)
        counts = counts[ids].astype(np.float32)
    values = np.log1p(counts)
    if len(values):
        values *= p.word_weight / np.sqrt(np.sum(values * values))
    return np.concatenate([ids, np.array(bins, np.int64)]), np.concatenate([values, np.full(len(bins), 0.5, np.float32)])


class Machine:
    def __init__(self, p: Params):
        size = p.word_buckets + len(STATS) * p.bins
        self.p, self.w0, self.w = p, 0.0, np.zeros(size, np.float32)
        self.v = np.random.default_rng(7).normal(0, 0.02, (size, p.rank)).astype(np.float32)

    def raw(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, tuple]:
        ids, x = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
        starts = np.cumsum([0] + [len(r[0]) for r in rows[:-1]])  # no row is empty: it has its statistics
        vx = self.v[ids] * x[:, None]
        sums = np.add.reduceat(vx, starts)
        squares = np.add.reduceat(vx * vx, starts)
        return self.w0 + np.add.reduceat(self.w[ids] * x, starts) + 0.5 * (sums * sums - squares).sum(1), (ids, x, vx, sums)

    def score(self, rows: list) -> np.ndarray:
        out = []
        for i in range(0, len(rows), 512):
            out.append(1 / (1 + np.exp(-np.clip(self.raw(rows[i : i + 512])[0], -30, 30))))
        return np.concatenate(out).astype(np.float64) if out else np.zeros(0)

    def fit(self, rows: list, labels: np.ndarray) -> Machine:
        """Class-balanced log loss, AdaGrad."""
        if not rows:
            return self
        p, n = self.p, len(rows)
        share = float(np.clip(labels.mean(), 0.05, 0.95))
        weight = np.where(labels > 0, 0.5 / share, 0.5 / (1 - share))
        gw, gv, g0 = np.full(self.w.shape, 1e-2, np.float32), np.full(self.v.shape, 1e-2, np.float32), 1e-2
        order = np.random.default_rng(11)
        for _ in range(p.epochs):
            at = order.permutation(n)
            for i in range(0, n, p.batch):
                take = at[i : i + p.batch]
                part = [rows[j] for j in take]
                raw, (ids, x, vx, sums) = self.raw(part)
                err = weight[take] * (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[take]) / len(take)
                e = np.repeat(err, [len(r[0]) for r in part]).astype(np.float32) * x
                each = np.repeat(sums, [len(r[0]) for r in part], axis=0)
                uniq, back = np.unique(ids, return_inverse=True)
                dw = np.bincount(back, e, len(uniq)).astype(np.float32) + p.l2 * self.w[uniq]
                dv = np.stack([np.bincount(back, e * (each[:, f] - vx[:, f]), len(uniq)) for f in range(p.rank)], 1).astype(np.float32) + p.l2 * self.v[uniq]
                gw[uniq] += dw * dw
                gv[uniq] += dv * dv
                self.w[uniq] -= p.rate * dw / np.sqrt(gw[uniq])
                self.v[uniq] -= p.rate * dv / np.sqrt(gv[uniq])
                g0 += float(err.sum()) ** 2
                self.w0 -= p.rate * float(err.sum()) / g0**0.5
        return self


def train(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> Machine:
    """Fits on labelled rows outside the held-out fold (crc32 of the id's text mod 5 is 0)."""
    fold = crc32_of_id(F.col("doc_id")) % 5
    own = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = own.where(fold != 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(p.max_train)

    def run(part: dict) -> dict:
        rows = [features(t, p) for t in part["text"]]
        return {"doc_id": part["doc_id"], "quality": part["quality"], "ids": [r[0] for r in rows], "x": [r[1] for r in rows]}

    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most max_train rows of two numbers
    got = map_slices(texts, run, "doc_id long, quality int, ids array<int>, x array<float>").toPandas() if p.max_train else None
    got = got.drop_duplicates("doc_id").sort_values("doc_id")
    return Machine(p).fit([(np.asarray(a, np.int64), np.asarray(b, np.float32)) for a, b in zip(got.ids, got.x, strict=True)], (got.quality.to_numpy() > 0).astype(np.float64))


def score(docs: DataFrame, model: Machine) -> DataFrame:
    """doc_id and score of every row; the model is a few hundred kB, whatever the input."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(part: dict) -> dict:
        m = held.value
        return {"doc_id": part["doc_id"], "score": m.score([features(t, m.p) for t in part["text"]])}

    return map_slices(docs.select("doc_id", "text"), run, SCHEMA)


def keep_good(docs: DataFrame, model: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores at least ``threshold``."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def good(texts: list[bytes]) -> list[bool]:
        m = held.value
        return m.score([features(t, m.p) for t in texts]) >= threshold

    return kept_rows(docs, good)


def op8_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (crc32_of_id(F.col("doc_id")) % 5 == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
