"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification.

Words are runs of letters and digits, lower-cased. For every benchmark item of L words, windows of L words of
every document get a SimHash over their five-word shingles, by prefix sums of the shingles' bits. The 64 bits
are cut into four blocks of 16; a fingerprint within RADIUS = 15 of an item's agrees with it in one block up to
3 bits, and each block table lists every item under all values within 3 bits of its own, so the lookup
misses no fingerprint within the radius. A window at the threshold may lie beyond the radius, so windows with
enough positions whose shingle the item has are candidates too, whatever their fingerprint; no window that
reaches the threshold has fewer. Candidates are verified exactly: the share of the item's shingles, counted with
repeats, that the window has must reach ``threshold`` (0.8). Windows that share no shingle with any item cannot
reach it and are passed over before fingerprints are taken.

The benchmark is a query set: it is taken in blocks of ITEMS items, each broadcast alone, so what is broadcast is
bounded. With more than one block the documents are scanned once, through a sieve of all items' shingles, and the
blocks read only the documents that pass it. Long documents are taken in overlapping stretches. Edge
cases: null and empty texts and items have no words and match nothing; an item or text of fewer than five
words has one shingle, its whole sequence; a text shorter than an item is one window; items with equal ids
or texts are kept apart by text; repeated rows give repeated results; empty tables give an empty result. Only
the columns named are read, so further columns are ignored.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_slices, own_name, stash, table, text_hash

WIDTH = 5
RADIUS = 15
BLOCK_BITS = 16
THRESHOLD = 0.8
ITEMS = 2048
#: Bits of the sieve of all items' shingles, at most (64 MB).
SIEVE_BITS = 1 << 29
#: Positions of a document looked at at once.
STRETCH = 1 << 16
WORDS = re.compile(r"[^\W_]+")
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)
SCHEMA = "doc_id long, item_id long, start_word long, similarity double"


class OneWordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: str | bytes) -> int:
        from xxhash import xxh64_intdigest

        if len(self) > 400_000:
            self.clear()
        self[word] = value = xxh64_intdigest(word)
        return value


class WordHashes(dict):
    """64-bit hashes of the words inside a stretch without white space, remembered up to a bound; no word crosses white space."""

    def __missing__(self, stretch: str) -> bytes:
        from xxhash import xxh64_intdigest

        if len(self) > 400_000:
            self.clear()
        self[stretch] = value = b"".join([xxh64_intdigest(w).to_bytes(8, "little") for w in WORDS.findall(stretch.lower())])
        return value


def word_hashes(text: str, known: WordHashes) -> np.ndarray:
    return np.frombuffer(b"".join(map(known.__getitem__, text.split())), "<u8").astype(np.uint64, copy=False)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(words: np.ndarray) -> np.ndarray:
    """Hashes of the five-word shingles; fewer words make one."""
    n = len(words)
    if n < WIDTH:
        return mixed((words * MIX[:n]).sum(keepdims=True) + np.uint64(n)) if n else words
    return mixed(sum(words[k : n - WIDTH + 1 + k] * MIX[k] for k in range(WIDTH)))


def bits(h: np.ndarray) -> np.ndarray:
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def packed(on: np.ndarray) -> np.ndarray:
    return np.packbits(on, axis=1, bitorder="little").view(np.uint64).ravel()


def flips(width: int, most: int) -> np.ndarray:
    """All masks of ``width`` bits with at most ``most`` set."""
    return np.array([sum(1 << b for b in c) for k in range(most + 1) for c in combinations(range(width), k)], np.int64)


class Index:
    """A block of benchmark items."""

    def __init__(self, items: list[tuple[int, str]]):
        known = WordHashes()
        parts = [(i, w) for i, t in items if len(w := word_hashes(t or "", known))]
        self.ids = [i for i, _ in parts]
        self.lengths = np.array([len(w) for _, w in parts], np.int64)
        grams = [shingles(w) for _, w in parts]
        self.bags = [Counter(g.tolist()) for g in grams]
        self.totals = [len(g) for g in grams]
        self.prints = np.array([packed(bits(g).sum(0, keepdims=True, dtype=np.int64) * 2 > len(g))[0] for g in grams], np.uint64)
        self.all = np.unique(np.concatenate(grams)) if grams else np.zeros(0, np.uint64)
        # the items of each shingle of ``all``
        own = [np.unique(g) for g in grams]
        of = np.repeat(np.arange(len(own)), [len(g) for g in own])
        place = np.searchsorted(self.all, np.concatenate(own)) if own else np.zeros(0, np.int64)
        self.holders = of[np.argsort(place, kind="stable")]
        self.holder_starts = np.r_[0, np.cumsum(np.bincount(place, minlength=len(self.all)))]
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.all >> np.uint64(44)).astype(np.int64)] = True
        masks = flips(BLOCK_BITS, RADIUS // 4)
        self.tables = []
        for b in range(4):
            own = ((self.prints >> np.uint64(b * BLOCK_BITS)) & np.uint64(0xFFFF)).astype(np.int64)
            value = (own[:, None] ^ masks[None, :]).ravel()
            item = np.repeat(np.arange(len(own)), len(masks))
            order = np.argsort(value, kind="stable")
            self.tables.append((np.searchsorted(value[order], np.arange((1 << BLOCK_BITS) + 1)), item[order]))

    def hits(self, h: np.ndarray) -> np.ndarray:
        """Positions of shingles that some item has."""
        at = np.flatnonzero(self.seen[(h >> np.uint64(44)).astype(np.int64)])
        if len(at) and len(self.all):
            near = np.searchsorted(self.all, h[at])
            near[near == len(self.all)] = 0
            at = at[self.all[near] == h[at]]
        return at

    def close(self, prints: np.ndarray, lengths: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs within RADIUS, each window with items of its number of words in ``lengths`` (one for all, or one each)."""
        windows, items = [], []
        for b, (starts, item) in enumerate(self.tables):
            value = ((prints >> np.uint64(b * BLOCK_BITS)) & np.uint64(0xFFFF)).astype(np.int64)
            n = starts[value + 1] - starts[value]
            w = np.repeat(np.arange(len(prints)), n)
            at = np.repeat(starts[value] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(len(w))
            windows.append(w)
            items.append(item[at])
        w, i = np.concatenate(windows), np.concatenate(items)
        keep = (self.lengths[i] == np.broadcast_to(lengths, len(prints))[w]) & (np.bitwise_count(prints[w] ^ self.prints[i]) <= RADIUS)
        pairs = np.unique(w[keep] * len(self.ids) + i[keep])
        return pairs // max(1, len(self.ids)), pairs % max(1, len(self.ids))

    def full(self, h: np.ndarray, at: np.ndarray, n_words: int, threshold: float) -> dict[int, np.ndarray]:
        """By item: starts of the windows with at least ``threshold`` of its shingles' number of positions that it has.

        ``at`` are the hits among the shingles ``h``; a window's shared shingles are never more than those positions.
        """
        place = np.searchsorted(self.all, h[at])
        n = self.holder_starts[place + 1] - self.holder_starts[place]
        item = self.holders[np.repeat(self.holder_starts[place] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(int(n.sum()))]
        order = np.argsort(item, kind="stable")
        item, where = item[order], np.repeat(at, n)[order]
        ends = np.r_[np.flatnonzero(item[1:] != item[:-1]) + 1, len(item)]
        out, lo = {}, 0
        for hi in ends.tolist():
            i, p = int(item[lo]), where[lo:hi]
            lo = hi
            need = max(1, int(np.ceil(threshold * self.totals[i] - 1e-9)))
            size = max(1, min(int(self.lengths[i]), n_words) - WIDTH + 1)
            if len(p) < need or len(h) < size:
                continue
            first = np.maximum(p[need - 1 :] - size + 1, 0)  # windows from here to p hold ``need`` hits from p on
            last = np.minimum(p[: len(p) - need + 1], len(h) - size)
            span = last - first + 1
            ok = span > 0
            if ok.any():
                first, span = first[ok], span[ok]
                out[i] = np.unique(np.repeat(first - np.r_[0, np.cumsum(span)[:-1]], span) + np.arange(int(span.sum())))
        return out

    def search(self, n_words: int, h: np.ndarray, threshold: float) -> dict[int, tuple[float, int]]:
        """Best (similarity, start) by item over the windows of a text with shingles ``h``."""
        best: dict[int, tuple[float, int]] = {}
        longest = int(self.lengths.max(initial=0))
        for base in range(0, len(h), STRETCH):
            part = h[base : base + STRETCH + longest]
            at = self.hits(part)
            if not len(at):
                continue
            checked = set()

            def verify(item: int, start: int, size: int, part=part, base=base, checked=checked) -> None:
                if (item, start) in checked:
                    return
                checked.add((item, start))
                window = Counter(part[start : start + size].tolist())
                found = sum(min(n, window[g]) for g, n in self.bags[item].items()) / self.totals[item]
                if found >= threshold and (-found, start + base) < (-best.get(item, (0, 0))[0], best.get(item, (0, 0))[1]):
                    best[item] = (found, start + base)

            for item, wanted in self.full(part, at, n_words, threshold).items():
                for start in wanted.tolist():
                    verify(item, start, max(1, min(int(self.lengths[item]), n_words) - WIDTH + 1))
            lo, hi = max(0, int(at[0]) - longest), min(len(part), int(at[-1]) + longest)
            sums = np.zeros((hi - lo + 1, 64), np.int32)
            np.cumsum(bits(np.ascontiguousarray(part[lo:hi])), axis=0, dtype=np.int32, out=sums[1:])
            met = np.zeros(hi - lo + 1, np.int32)
            met[at - lo + 1] = 1
            np.cumsum(met, out=met)
            held: list[tuple[np.ndarray, np.ndarray, int, int]] = []  # fingerprints, starts, length and size of windows

            def look(held=held) -> None:
                if not held:
                    return
                counts = [len(x[0]) for x in held]
                starts, sizes = np.concatenate([x[1] for x in held]), np.repeat([x[3] for x in held], counts)
                for w, item in zip(*self.close(np.concatenate([x[0] for x in held]), np.repeat([x[2] for x in held], counts)), strict=True):
                    verify(int(item), int(starts[w]), int(sizes[w]))
                held.clear()

            waiting = 0
            for length in np.unique(self.lengths).tolist():
                size = max(1, min(length, n_words) - WIDTH + 1)  # shingles of a window
                if hi - lo < size:
                    continue
                starts = lo + np.flatnonzero(met[size:] > met[:-size])
                for i in range(0, len(starts), 1 << 14):
                    s = starts[i : i + (1 << 14)]
                    held.append((packed((sums[s + size - lo] - sums[s - lo]) * 2 > size), s, length, size))
                    waiting += len(s)
                    if waiting >= 1 << 14:  # windows of all lengths are looked up together
                        look()
                        waiting = 0
            look()
        return best


@functools.lru_cache(maxsize=2)
def index_of(items: tuple) -> Index:
    return Index(list(items))


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, key: str = "doc_id", key_type: str = "long") -> DataFrame:
    """SCHEMA: every (document, item) whose best window reaches ``threshold``; ``key`` tells documents."""
    spark = docs.sparkSession
    items = benchmark.select("item_id", "text").distinct()
    blocks = max(1, -(-items.count() // ITEMS))
    parts = [items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text") for b in range(blocks)]
    docs, out = docs.select(key, "text"), None
    if blocks > 1:
        docs = candidates(docs, items, parts, threshold, f"{key} {key_type}, text string")
    for part in parts:
        held = spark.sparkContext.broadcast(tuple((r[0], r[1]) for r in part.collect()))  # about ITEMS items

        def run(batch: dict, held=held) -> dict:
            index, known = index_of(held.value), _KNOWN
            rows = []
            for doc_id, text in zip(batch[key], batch["text"], strict=True):
                words = word_hashes(text.decode(), known)
                if len(words) and len(index.ids):
                    rows += [(doc_id, index.ids[j], start, sim) for j, (sim, start) in sorted(index.search(len(words), shingles(words), threshold).items())]
            return dict(zip((key, "item_id", "start_word", "similarity"), zip(*rows, strict=True), strict=True)) if rows else None

        found = map_slices(docs, run, SCHEMA.replace("doc_id long", f"{key} {key_type}"))
        out = found if out is None else out.unionByName(found)
    return out


def sieve_place(h: np.ndarray, size: int) -> np.ndarray:
    """Two bit positions of each shingle in a sieve of ``size`` bits."""
    return np.concatenate([h >> np.uint64(64 - size.bit_length() + 1), mixed(h) >> np.uint64(64 - size.bit_length() + 1)]).astype(np.int64)


def candidates(docs: DataFrame, items: DataFrame, parts: list[DataFrame], threshold: float, schema: str) -> DataFrame:
    """The documents with enough shingles of any items, by a sieve of all items' shingles: later scans read these alone.

    The sieve has two bits set for each shingle and at most SIEVE_BITS; where it is full it lets more documents
    pass, never fewer.
    """
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    size = 1 << min(SIEVE_BITS.bit_length() - 1, max(20, int(chars * 4).bit_length()))
    bits_, least, known = np.zeros(size // 8, np.uint8), 1 << 62, WordHashes()
    for part in parts:
        for row in part.collect():  # about ITEMS items
            h = shingles(word_hashes(row["text"] or "", known))
            if len(h):
                least = min(least, max(1, int(np.ceil(threshold * len(h) - 1e-9))))
                at = sieve_place(h, size)
                np.bitwise_or.at(bits_, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
    held = docs.sparkSession.sparkContext.broadcast(bits_)

    def keep(batch: dict) -> dict:
        passed = []
        for text in batch["text"]:
            h = shingles(word_hashes(text.decode(), _KNOWN))
            at = sieve_place(h, size)
            there = (held.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).reshape(2, -1).all(0) if len(h) else np.zeros(0, bool)
            passed.append(int(there.sum()) >= least)
        return {c: [(x.decode() if c == "text" else x) for x, p in zip(v, passed, strict=True) if p] for c, v in batch.items()}

    return stash(map_slices(docs, keep, schema), "candidates")


_KNOWN = WordHashes()


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose text holds no benchmark item; the text alone decides, whatever the ids."""
    name = own_name("bad")
    keyed = docs.select(text_hash().alias("text_hash"), "text")
    bad = contaminated(keyed, benchmark, threshold, "text_hash", "string").select(F.col("text_hash").alias(name)).distinct()
    return docs.join(bad, text_hash() == F.col(name), "left_anti")


def op4_simhash_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
