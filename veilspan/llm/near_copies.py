"""Groups of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 (or another, higher) or more.

MinHash bands only propose: BANDS bands of ROWS minima find a pair at 0.8 with probability 0.9999 (at 0.85,
all but 7 in 10 million). Texts that share a band form coarse components; inside each, similarities are computed exactly
from the shingle sets, so no pair below the threshold is linked. A component above TILE_SHINGLES shingles or TILE_SETS sets is
cut into tiles by hash, and each pair of tiles is one group, so no task holds more than two tiles at once.
SimHash blocks cannot propose: at 0.8 two fingerprints are expected to differ in about 10 of 64 bits (a cosine of
0.89), and often in more, too wide a radius for block keys. Inside a group they decide which sets are compared:
the bit-sliced counters of ``simhash`` drop all beyond RADIUS bits, five standard deviations past the mean at 0.8.

Words are lower-cased (ASCII) runs without white space; a text of fewer than five words has one shingle. Equal
shingle sets collapse first. Null and wordless texts are one group; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_slices, stash, text_hash
from .components import components
from .decontaminate import OneWordHashes, shingles

SIMILARITY = 0.8
BANDS, ROWS = 30, 6
RADIUS = 24
TILE_SHINGLES, TILE_SETS = 1 << 20, 1 << 12
_RANDOM = np.random.default_rng(7)
TIMES = _RANDOM.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SALT = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_KNOWN = OneWordHashes()


def shingle_set(text: bytes) -> np.ndarray:
    words = text.lower().split()
    return np.unique(shingles(np.fromiter(map(_KNOWN.__getitem__, words), np.uint64, len(words))))


def bands_of(grams: np.ndarray) -> np.ndarray:
    """A key for each band of minima."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(grams), 1 << 12):
        x = (grams[i : i + (1 << 12)][None, :] ^ SALT[:, None]) * TIMES[:, None]
        least = np.minimum(least, x.min(1))
    rows = least.reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        key = (key ^ rows[:, r]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def fingerprints_of(sets: list[np.ndarray]) -> np.ndarray:
    """SimHash of each set of shingle hashes."""
    out = np.zeros(len(sets), np.uint64)
    for i, s in enumerate(sets):
        ones = np.unpackbits(s.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out[i] = np.packbits(ones * 2 > len(s), bitorder="little").view(np.uint64)[0]
    return out


def similar(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links that connect all pairs of ``sets`` at ``similarity`` or more."""
    from .simhash import planes_of, within

    n = len(sets)
    sizes = np.fromiter(map(len, sets), np.int64, n)
    fps, words = fingerprints_of(sets), np.arange(-(-n // 64))
    planes = planes_of(fps, np.arange(n) // 64, np.arange(n) % 64, len(words))
    # the sets that hold each shingle, by number of the shingle
    _, number = np.unique(np.concatenate(sets), return_inverse=True)
    holders = np.repeat(np.arange(n), sizes)[np.argsort(number, kind="stable")]
    starts = np.r_[0, np.cumsum(np.bincount(number))]
    ends = np.cumsum(sizes)
    root, out = np.arange(n), []
    for p in range(n):
        apart = root != root[p]  # those already joined need no comparison
        apart &= (sizes >= similarity * sizes[p] - 1e-9) & (sizes * similarity - 1e-9 <= sizes[p])
        if not apart.any():
            continue
        near = within(planes, np.full(len(words), fps[p]), words, RADIUS)
        apart &= np.unpackbits(near.view(np.uint8), bitorder="little")[:n].astype(bool)
        if not apart.any():
            continue
        both = np.zeros(n, np.int64)
        for g in number[ends[p] - sizes[p] : ends[p]].tolist():
            both[holders[starts[g] : starts[g + 1]]] += 1  # a set holds a shingle once
        hit = np.flatnonzero(apart & (both >= similarity * (sizes[p] + sizes - both) - 1e-9))
        if len(hit):
            roots, first = np.unique(root[hit], return_index=True)
            out += [(p, int(q)) for q in hit[first]]
            root[np.isin(root, roots)] = root[p]
    return out


def exact_links(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Rows (g, sig, grams) sorted by g -> links (a, b) inside each g."""

    def of(sigs: list, sets: list) -> list[tuple[int, int]]:
        return [(sigs[p], sigs[q]) for p, q in similar(sets, similarity)] if len(sigs) > 1 else []

    now, sigs, sets = None, [], []
    for batch in batches:
        out = []
        for i in range(batch.num_rows):  # one at a time: a batch may hold many long texts
            g, sig, grams = (c[i].as_py() for c in batch.columns)
            if g != now:
                out += of(sigs, sets)
                now, sigs, sets = g, [], []
            sigs.append(sig)
            sets.append(np.frombuffer(grams, np.uint64))
        yield record_of(out)
    yield record_of(of(sigs, sets))


def record_of(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])


def groups(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, text_hash and group of every row; the bands are made for 0.8, and miss pairs below it."""
    if similarity < SIMILARITY:
        raise ValueError(f"the bands find pairs at {SIMILARITY} or more")

    def sign(part: dict) -> dict:
        from xxhash import xxh64_intdigest

        sets = [shingle_set(t) for t in part["text"]]
        sig = np.array([xxh64_intdigest(s.tobytes(), 9) if len(s) else 0 for s in sets], np.uint64).view(np.int64)
        return {"doc_id": part["doc_id"], "text_hash": part["text_hash"], "sig": sig, "size": [len(s) for s in sets], "bands": [bands_of(s) if len(s) else [] for s in sets]}

    rows = docs.select("doc_id", text_hash().alias("text_hash"), "text")
    signed = stash(map_slices(rows, sign, "doc_id long, text_hash string, sig long, size long, bands array<long>"), "shingle-bands")
    keys = signed.dropDuplicates(["sig"]).select("sig", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.min("sig").alias("b"), F.count("*").alias("n")).where("n > 1").select("key", "b")
    coarse = components(keys.join(shared, "key").select(F.col("sig").alias("a"), "b").distinct())
    coarse = coarse.unionByName(coarse.select(F.col("root").alias("node"), "root").distinct())  # roots are not among the nodes
    # of each set in a coarse component one text
    member = signed.join(coarse, F.col("sig") == F.col("node")).groupBy("root", "sig").agg(F.min("text_hash").alias("text_hash"), F.first("size").alias("size"))
    tiles = member.groupBy("root").agg(F.greatest(F.ceil(F.sum("size") / TILE_SHINGLES), F.ceil(F.count("*") / TILE_SETS)).cast("int").alias("tiles"))
    own = member.join(tiles, "root").withColumn("t", F.pmod(F.xxhash64("sig"), F.col("tiles")))

    def sets_of(part: dict) -> dict:
        return {"hash": part["hash"], "grams": [shingle_set(t).tobytes() for t in part["text"]]}

    texts = docs.select(text_hash().alias("hash"), F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.join(own.select(F.col("text_hash").alias("hash")), "hash", "left_semi").dropDuplicates(["hash"])
    grams = map_slices(texts, sets_of, "hash string, grams binary")
    pairs = own.join(grams, F.col("text_hash") == F.col("hash")).withColumn("u", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = pairs.select(F.xxhash64("root", F.least("t", "u"), F.greatest("t", "u")).alias("g"), "sig", "grams")
    links = dealt.repartition("g").sortWithinPartitions("g").mapInArrow(lambda batches: exact_links(batches, similarity), "a long, b long")
    roots = components(links)
    return signed.join(roots, F.col("sig") == F.col("node"), "left").select("doc_id", "text_hash", F.coalesce("root", "sig").alias("group"))
