"""SimHash near-duplicates with bit-sliced comparison.

A text's fingerprint takes XXH64 of its three-word shingles; fingerprints at Hamming distance 3 or less are
linked, and linked texts form groups. Equal fingerprints collapse first. The 64 bits are cut into five
blocks; two fingerprints within distance 3 agree in two blocks at least, so each of the ten block pairs is a
bucket key. Inside a bucket fingerprints lie in words of 64 lanes as bit planes: one pass over the planes
updates 64 distances by carry-save counters, and words all of whose lanes exceed the radius are abandoned.
A bucket above ``TILE`` fingerprints is cut into tiles by hash, and each pair of tiles is one group, so no
task holds more than two tiles; a group hands on a spanning forest of its links, never all pairs.

Edge cases: null and wordless texts have fingerprint zero and are linked like any other; null ids never
become a group's id unless all its ids are null; repeated rows share a group; an empty table gives an empty
result. Only the columns named are read, so further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import near_copies
from .common import map_slices, own_name, stash, table, text_hash
from .components import components

RADIUS = 3
#: Bits of the five blocks, from the lowest.
BLOCKS = (13, 13, 13, 13, 12)
#: Fingerprints of a bucket that one group may hold from each side.
TILE = 4096
#: Comparisons (fingerprint against a word of 64 lanes) done at once.
AT_ONCE = 1 << 17


def fingerprint(text: bytes, hash64, width: int = 3) -> int:
    words = text.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    grams = [b" ".join(words)] if len(words) <= width else list(map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)))
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        part = grams[i : i + (1 << 16)]
        h = np.fromiter((hash64(g, 42) for g in part), np.uint64, len(part))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the carried strings and fingerprint (its 64 bits as a signed long) of every row."""

    def run(part: dict) -> dict:
        from xxhash import xxh64_intdigest

        f = np.fromiter((fingerprint(t, xxh64_intdigest) for t in part["text"]), np.uint64, len(part["text"]))
        return {c: part[c] for c in ("doc_id", *carry)} | {"fp": f.view(np.int64)}

    return map_slices(docs.select("doc_id", *carry, "text"), run, "".join(f"{c} {t}, " for c, t in [("doc_id", "long"), *((c, "string") for c in carry)]) + "fp long")


def planes_of(fps: np.ndarray, word: np.ndarray, lane: np.ndarray, n_words: int) -> np.ndarray:
    """Bit planes [64, n_words]: bit ``lane`` of plane p of word w is bit p of the fingerprint kept there."""
    out = np.zeros((64, n_words), np.uint64)
    at = lane.astype(np.uint64)
    for p in range(64):
        np.bitwise_or.at(out[p], word, ((fps >> np.uint64(p)) & np.uint64(1)) << at)
    return out


def within(planes: np.ndarray, query: np.ndarray, word: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each (query fingerprint, word): the lanes at distance ``radius`` or less, as bits.

    Carry-save counters start so that a carry out of the highest marks a lane as beyond the radius.
    """
    width, full = max(1, radius.bit_length()), np.uint64(0xFFFFFFFFFFFFFFFF)
    lead = (1 << width) - 1 - radius
    counters = [np.full(len(query), full if lead >> k & 1 else 0, np.uint64) for k in range(width)]
    result, live, over = np.zeros(len(query), np.uint64), np.arange(len(query)), np.zeros(len(query), np.uint64)
    for p in range(64):
        carry = planes[p][word] ^ (np.uint64(0) - ((query >> np.uint64(p)) & np.uint64(1)))
        for k in range(width):
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        over |= carry
        if p % 8 == 7 and p < 63:  # abandon words that no lane can come back from
            keep = over != full
            if not keep.all():
                live, query, word, over = (x[keep] for x in (live, query, word, over))
                counters = [c[keep] for c in counters]
    result[live] = ~over
    return result


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Roots (smallest member) of 0..n-1 under the links a-b."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        low = np.minimum(ra, rb)
        np.minimum.at(root, ra, low)
        np.minimum.at(root, rb, low)
        while not np.array_equal(root, nxt := root[root]):
            root = nxt
        keep = root[a] != root[b]
        a, b = a[keep], b[keep]
    return root


def group_links(fps: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (fingerprint, root) of the links inside each group; rows come sorted by group."""
    n = len(fps)
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if n else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[starts, n])
    gid = np.repeat(np.arange(len(starts)), sizes)
    place = np.arange(n) - starts[gid]
    per = (sizes + 63) // 64
    first = np.r_[0, np.cumsum(per)]
    word, lane = first[gid] + place // 64, place % 64
    planes = planes_of(fps, word, lane, int(first[-1]))
    row_of = np.full((int(first[-1]), 64), -1)
    row_of[word, lane] = np.arange(n)
    root = np.arange(n)
    tries = (place // 64) + 1  # a row meets the words up to its own: each pair once or twice
    ends = np.cumsum(tries)
    at = 0
    while at < n:
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE, "right")))
        rows = np.repeat(np.arange(at, upto), tries[at:upto])
        offset = np.arange(len(rows)) - np.repeat(np.r_[0, np.cumsum(tries[at:upto])[:-1]], tries[at:upto])
        words = first[gid[rows]] + offset
        found = within(planes, fps[rows], words)
        hit = np.flatnonzero(found)
        for i in range(0, len(hit), 1 << 14):
            some = hit[i : i + (1 << 14)]
            bits = np.unpackbits(found[some].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            x, y = np.nonzero(bits)
            a, b = rows[some[x]], row_of[words[some[x]], y]
            real = (b >= 0) & (b != a)
            a, b = a[real], b[real]
            if len(a):  # join the trees of both ends
                ra, rb = root[a], root[b]
                ends_, back = np.unique(np.r_[ra, rb], return_inverse=True)
                root[ends_] = ends_[forest(back[: len(ra)], back[len(ra) :], len(ends_))]
                root = root[root]
        at = upto
    moved = np.flatnonzero(root != np.arange(n))
    return fps[moved], fps[root[moved]]


def links(prints: DataFrame) -> DataFrame:
    """Distinct fingerprints (fp) -> links (a, b) that connect all within RADIUS."""
    shifts = np.r_[0, np.cumsum(BLOCKS)]
    block = [F.shiftrightunsigned("fp", int(s)).bitwiseAND((1 << w) - 1) for s, w in zip(shifts, BLOCKS, strict=False)]
    keys = F.array(*(F.lit(i) * F.lit(1 << 32) + block[a] * F.lit(1 << 13) + block[b] for i, (a, b) in enumerate(combinations(range(5), 2))))
    spread = prints.select("fp", F.explode(keys).alias("key"))
    sizes = spread.groupBy("key").count().where("count > 1").withColumn("tiles", F.ceil(F.col("count") / TILE).cast("int"))
    own = spread.join(sizes.select("key", "tiles"), "key").withColumn("t", F.pmod(F.xxhash64("fp"), F.col("tiles")))
    # the pairs of tiles that a fingerprint of tile t belongs to: (least, greatest) with every tile
    pairs = own.withColumn("u", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = pairs.select("fp", F.xxhash64("key", F.least("t", "u"), F.greatest("t", "u")).alias("g"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest_f, rest_g = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for b in batches:
            rest_f = np.r_[rest_f, np.asarray(b.column(0), np.int64).view(np.uint64)]
            rest_g = np.r_[rest_g, np.asarray(b.column(1), np.int64)]
            if len(rest_g) < AT_ONCE:
                continue
            cut = int(np.searchsorted(rest_g, rest_g[-1]))  # the last group may go on
            yield out(*group_links(rest_f[:cut], rest_g[:cut]))
            rest_f, rest_g = rest_f[cut:], rest_g[cut:]
        yield out(*group_links(rest_f, rest_g))

    def out(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return dealt.repartition("g").sortWithinPartitions("g").mapInArrow(run, "a long, b long")


def rooted(prints: DataFrame) -> DataFrame:
    """fp, the smallest id that has it (least) and the root of its group, for every distinct fingerprint."""
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(least.select("fp")))
    return least.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row."""
    prints = stash(fingerprints(docs), "fingerprints")
    joined = rooted(prints)
    ids = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    member = joined.join(ids, "root").select("fp", "component_id")
    return prints.join(member, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, similarity: float | None = None) -> DataFrame:
    """Keeps one row of each group: of those with the smallest id (null only if all are) the least by text hash.

    Without ``similarity`` the groups are those of ``near_duplicates``, which misses most near copies that are
    not equal in their shingles; with it, those of ``near_copies``: five-word shingles at that Jaccard similarity.
    Rows are told by id and text, so null and repeated ids of several groups do not stand for one another.
    """
    if similarity is None:
        prints = stash(fingerprints(docs.select("doc_id", text_hash().alias("text_hash"), "text"), ("text_hash",)), "fingerprints")
        groups = prints.join(rooted(prints).select("fp", F.col("root").alias("group")), "fp")
    else:
        groups = near_copies.groups(docs, similarity)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash"))
    own, keep_id, keep_hash = own_name("hash"), own_name("id"), own_name("keep")
    keep = groups.groupBy("group").agg(first.alias("first")).select(F.col("first.doc_id").alias(keep_id), F.col("first.text_hash").alias(keep_hash))
    rows = docs.withColumn(own, text_hash())
    kept = rows.join(keep, (F.col(own) == F.col(keep_hash)) & rows["doc_id"].eqNullSafe(F.col(keep_id)), "left_semi")
    return kept.dropDuplicates(["doc_id", own]).drop(own)


def op9_simhash_bitsliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
