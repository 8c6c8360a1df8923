"""Exact substring deduplication by counting windows under anchors, in place of a relative Lempel-Ziv parse.

A word goes if some window of ``window`` consecutive words that covers it also starts anywhere else.

The whole corpus is the reference. Every window is filed under an anchor, the smallest of its eight-word
hashes, so equal windows have equal anchors wherever they stand; consecutive windows with one anchor form a
phrase, and phrases are indexed in blocks by anchor. No longest factors are sought: a
phrase that the reference holds a second time is a copy whole, and where phrases of an anchor differ, the
windows of one phrase of each kind are compared one by one, so borders are exact. Every window is covered,
and what occurs twice is removed.

Per word only a fifteenth of a row is shuffled: phrases whose anchor occurs once end there. Texts are told apart
by 128 bits of hash, never by their ids, since equal texts have equal results. Counts are made before the shuffle;
keys (anchors, phrases, texts) with more than a HOTTEST-th of all rows, so at most HOTTEST of them, are broadcast
and looked up where the rows are, or split into SALTS parts, so that no task holds a hot key. Hashes: 64 bits
of anchor with 64 bits of phrase, 128 of a window.

Edge cases: a null text has no words (kept_sha256 is that of the empty text); texts shorter than a window
are kept whole; a null id is an id like any other; repeated rows, of one id too, are copies of one another;
an empty table gives an empty result. Only the columns named are read, so further columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, map_slices, stash, table

WINDOW = 35
GRAM = 8
#: Words looked at at once; borders between stretches only split phrases.
STRETCH = 1 << 21
BASE = 0x9E3779B97F4A7C15 | 1
GRAM_BASE = 0xD6E8FEB86659FD93 | 1
#: A key with more than this share of all rows is hot; a hot text's rows are split into SALTS parts.
HOTTEST = 2000
SALTS = 64


class Words(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        if len(self) > 400_000:
            self.clear()
        self[word] = value = xxh64_intdigest(word, 7)
        return value


_KNOWN = Words()


@functools.cache
def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & 0xFFFFFFFFFFFFFFFF, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xE7037ED1A0B428DB)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x8EBC6AF09C88C6E3)
    return x ^ (x >> np.uint64(32))


class Hashed:
    """Hashes of any run of words of a stretch, by prefix sums and inverse powers modulo 2**64."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        up = powers(BASE, STRETCH + 4 * WINDOW)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(words * up[:n], dtype=np.uint64, out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        down = powers(pow(BASE, -1, 1 << 64), STRETCH + 4 * WINDOW)
        return mixed((self.sums[end] - self.sums[start]) * down[start] + (end - start).astype(np.uint64))


def phrases(words: np.ndarray, doc: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """(first window start, windows, anchor, phrase hash) of the phrases of a stretch; ``doc`` tells documents apart."""
    n = len(words) - window + 1
    if n < 1:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2
    up = powers(GRAM_BASE, GRAM)
    grams = mixed(sum(words[k : len(words) - GRAM + 1 + k] * up[k] for k in range(GRAM)))
    low = np.uint64((1 << 24) - 1)
    key = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    span, width = window - GRAM + 1, 1  # the least of ``span`` grams, by doubling
    while width * 2 <= span:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    if width < span:
        key = np.minimum(key[: len(key) - (span - width)], key[span - width :])
    place = (key & low).astype(np.int64)
    starts = np.flatnonzero(doc[:n] == doc[window - 1 :])
    if not len(starts):
        return (starts,) * 2 + (np.zeros(0, np.uint64),) * 2
    place = place[starts]
    new = np.r_[True, (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)]
    at = np.flatnonzero(new)
    count = np.diff(np.r_[at, len(starts)])
    first = starts[at]
    whole = Hashed(words).of(first, first + count - 1 + window)
    return first, count, grams[place[at]], mixed(whole + (place[at] - first).astype(np.uint64))


def stretches(texts: list[bytes], window: int):
    """(words, document number, base position in the document) of stretches over a slice's texts."""
    arrays = [np.fromiter(map(_KNOWN.__getitem__, w), np.uint64, len(w)) for t in texts for w in [t.split()]]
    batch, size = [], 0
    for d, a in enumerate(arrays):
        for lo in range(0, max(1, len(a) - window + 1), STRETCH):
            part = a[lo : lo + STRETCH + window - 1]
            if len(part) < window:
                continue
            if size + len(part) > STRETCH and batch:
                yield joined(batch)
                batch, size = [], 0
            batch.append((part, d, lo))
            size += len(part)
    if batch:
        yield joined(batch)


def joined(batch: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lengths = [len(p) for p, _, _ in batch]
    offsets = np.r_[0, np.cumsum(lengths)[:-1]]
    return np.concatenate([p for p, _, _ in batch]), np.repeat([d for _, d, _ in batch], lengths), np.repeat(np.array([lo for _, _, lo in batch]) - offsets, lengths)


TEXT = ["k1", "k2"]
PHRASES = "k1 long, k2 long, at long, anchor long, phrase long"


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text (null as empty) and 128 bits of its hash (k1, k2)."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(7), text).alias("k2"))


def parse(docs: DataFrame, window: int) -> DataFrame:
    """PHRASES of all documents (keyed); ``at`` packs 8 bits of the number of windows below the first one's start."""
    if not GRAM <= window < GRAM + 255:
        raise ValueError("a window has 8 to 262 words")

    def run(part: dict) -> dict | None:
        k1, k2 = np.array(part["k1"], np.int64), np.array(part["k2"], np.int64)
        out: dict[str, list] = {"k1": [], "k2": [], "at": [], "anchor": [], "phrase": []}
        for words, doc, shift in stretches(part["text"], window):
            first, count, anchor, phrase = phrases(words, doc, window)
            d = doc[first]
            for c, v in (("k1", k1[d]), ("k2", k2[d]), ("at", (first + shift[first]) << 8 | count), ("anchor", anchor.view(np.int64)), ("phrase", phrase.view(np.int64))):
                out[c].append(v)
        return {k: np.concatenate(v) for k, v in out.items()} if out["at"] else None

    return map_slices(docs.select("k1", "k2", "text"), run, PHRASES)


def hot_keys(counts: DataFrame, keys: list[str], total: int) -> DataFrame:
    """The ``keys`` of ``counts`` (with n, rows of each) that more than total / HOTTEST rows share: at most HOTTEST, broadcast."""
    return F.broadcast(counts.where(F.col("n") > total / HOTTEST).select(*keys, F.lit(True).alias("hot")))


def having(rows: DataFrame, keys: list[str], wanted: DataFrame, hot: DataFrame) -> DataFrame:
    """The rows whose keys are among ``wanted``; ``hot`` keys (of wanted and others) are looked up without a shuffle."""
    names = rows.columns
    marked = rows.join(hot, keys, "left")
    hot_wanted = F.broadcast(hot.join(wanted.select(*keys), keys, "left_semi").select(*keys))
    there = marked.where("hot").join(hot_wanted, keys, "left_semi")
    return there.select(*names).unionByName(marked.where("hot is null").join(wanted.select(*keys), keys, "left_semi").select(*names))


def with_lists(docs: DataFrame, lists: DataFrame, hot: DataFrame, how: str) -> DataFrame:
    """Keyed documents with ``list`` of their text; the rows of a hot text are split, each part with a copy of its list."""
    salt = F.when(F.col("hot"), F.floor(F.rand(7) * SALTS).cast("int")).otherwise(0)
    rows = docs.join(hot, TEXT, "left").withColumn("salt", salt).drop("hot")
    salts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return rows.join(lists.join(hot, TEXT, "left").withColumn("salt", F.explode(salts)).drop("hot"), [*TEXT, "salt"], how).drop("salt")


def duplicate_spans(docs: DataFrame, hot_texts: DataFrame, window: int = WINDOW) -> DataFrame:
    """k1, k2, list of (start << 8 | windows): runs of window starts whose windows all occur elsewhere. ``docs`` are keyed."""
    found = stash(parse(docs, window), "found")
    often = stash(found.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"), "anchors")
    total = found.count()
    kept = stash(having(found, ["anchor"], often, hot_keys(often, ["anchor"], total)), "phrases")
    discard(found)
    # one phrase of each kind stands for all, in a text of its own
    kinds = stash(kept.groupBy("anchor", "phrase").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "at")).alias("one")), "kinds")
    copied = having(kept, ["anchor", "phrase"], kinds.where("n > 1"), hot_keys(kinds, ["anchor", "phrase"], total)).select("k1", "k2", F.col("at").alias("x"))
    # a phrase's borders may lie inside others of its anchor: one phrase of each kind goes by its windows
    anchors = stash(kinds.groupBy("anchor").agg(F.count("*").alias("n"), F.min("n").alias("least")).where("n > 1 and least = 1"), "mixed")
    open_ = having(kinds, ["anchor"], anchors, hot_keys(anchors, ["anchor"], total)).select("one.*", F.least("n", F.lit(2)).alias("times"))
    lists = stash(open_.groupBy("k1", "k2").agg(F.collect_set(F.col("at") * 4 + F.col("times")).alias("list")), "open")

    def windows(part: dict) -> dict | None:
        out: dict[str, list] = {"row": [], "at": [], "n": [], "hash": [], "hash2": []}
        for r, (text, items) in enumerate(zip(part["text"], part["list"], strict=True)):
            words = text.split()
            w = np.fromiter(map(_KNOWN.__getitem__, words), np.uint64, len(words))
            x = np.array(items, np.int64)
            first, count, n = x >> 10, (x >> 2) & 255, x & 3
            starts = np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            n = np.repeat(n, count)
            order = np.argsort(starts, kind="stable")
            starts, n = starts[order], n[order]
            for lo in range(0, len(w), STRETCH):
                here = (starts >= lo) & (starts < lo + STRETCH)
                if here.any():
                    s = starts[here] - lo
                    part_w = w[lo : lo + STRETCH + window]
                    out["row"].append(np.full(len(s), r))
                    out["at"].append(s + lo)
                    out["n"].append(n[here])
                    out["hash"].append(Hashed(part_w).of(s, s + window).view(np.int64))
                    out["hash2"].append(Hashed(mixed(part_w)).of(s, s + window).view(np.int64))
        if not out["row"]:
            return None
        rows = np.concatenate(out.pop("row"))
        return {c: np.array(part[c], np.int64)[rows] for c in TEXT} | {k: np.concatenate(v) for k, v in out.items()}

    # a text is read once, however many rows have it; a phrase that occurs once is in one row only
    once = docs.join(hot_texts, TEXT, "left")
    once = once.where("hot is null").select(*TEXT, "text").unionByName(once.where("hot").select(*TEXT, "text").dropDuplicates(TEXT))
    single = stash(map_slices(once.join(lists, TEXT), windows, "k1 long, k2 long, at long, n int, hash long, hash2 long"), "windows")
    twice = stash(single.groupBy("hash", "hash2").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.count("*").alias("rows")).where("n > 1"), "twice")
    borders = having(single.where("n = 1"), ["hash", "hash2"], twice, hot_keys(twice.withColumn("n", F.col("rows")), ["hash", "hash2"], total)).select("k1", "k2", (F.col("at") * 256 + 1).alias("x"))
    return stash(copied.unionByName(borders).groupBy("k1", "k2").agg(F.collect_set("x").alias("list")), "spans")


def covered(n: int, items: list[int] | None, window: int) -> np.ndarray:
    """Which of ``n`` words some listed window covers."""
    steps = np.zeros(n + 1, np.int64)
    if items:
        x = np.array(items, np.int64)
        np.add.at(steps, x >> 8, 1)
        np.add.at(steps, (x >> 8) + (x & 255) - 1 + window, -1)
    return np.cumsum(steps[:-1]) > 0


SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _with_spans(docs: DataFrame, window: int) -> DataFrame:
    docs = keyed(docs)
    copies = stash(docs.groupBy(*TEXT).agg(F.count("*").alias("n")), "texts")
    hot = hot_keys(copies, TEXT, copies.agg(F.sum("n")).first()[0] or 0)
    return with_lists(docs, duplicate_spans(docs, hot, window), hot, "left")


def dedup_substrings(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """A row of SCHEMA per row of ``docs``."""

    def run(part: dict) -> dict:
        rows = []
        for doc_id, text, items in zip(part["doc_id"], part["text"], part["list"], strict=True):
            words = text.split()
            gone = covered(len(words), items, window)
            kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])
            rows.append((doc_id, len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest()))
        return dict(zip(("doc_id", "n_words", "n_removed", "kept_sha256"), zip(*rows, strict=True), strict=True))

    return map_slices(_with_spans(docs, window).select("doc_id", "text", "list"), run, SCHEMA)


def remove_duplicate_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id and the text that is left, words joined by one space."""

    def run(part: dict) -> dict:
        texts = []
        for text, items in zip(part["text"], part["list"], strict=True):
            words = text.split()
            texts.append(b" ".join([w for w, g in zip(words, covered(len(words), items, window).tolist(), strict=True) if not g]).decode())
        return {"doc_id": part["doc_id"], "text": texts}

    return map_slices(_with_spans(docs, window).select("doc_id", "text", "list"), run, "doc_id long, text string")


def op5_lz_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents"))
