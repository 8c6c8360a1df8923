"""Quality rules by compression bands.

A text is compressed with zstandard, whole and in fixed chunks. Limits on the ratio (compressed size over
size) depend on the length: too low means repetitive text, too high incompressible text. A text is kept if
its whole ratio lies in the band of its length and at most half of its chunks leave the chunk band. The last
chunk is the last ``chunk_bytes`` of the text, so every byte is in one; a text of one chunk or less has itself
as its chunk, in the band of its length. The base rules count words, symbols, repeated lines and repeated
five-word windows over the whole text.

Edge cases: a null text counts as empty; an empty text has ratio 1, no words and fails the base rules; null
ids are passed through; repeated rows give repeated results; an empty table gives an empty result. Only the
columns named are read, so further columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .common import SPACE, map_slices, table

SYMBOLS = b"#*$%&|<>"
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, n_chunks long, n_bad_chunks long"


@dataclass(frozen=True)
class Bands:
    """(bytes below which it holds, lowest ratio, highest ratio) by length; the last band has no end.

    From the documents of sf0.1 that pass the base rules: 1 % under the lowest ratio of those labelled quality 1
    and 1 % above the highest of all; bands of few documents are wider. Below 128 bytes ordinary and random
    texts have the same ratios, so there is no upper limit; above, random printable text lies beyond it.
    """

    level: int = 3
    whole: tuple[tuple[int, float, float], ...] = (
        (64, 1.0, 9.9), (90, 0.75, 9.9), (128, 0.72, 9.9), (181, 0.66, 0.932), (256, 0.632, 0.866), (362, 0.593, 0.75), (512, 0.577, 0.728), (724, 0.529, 0.703), (1_024, 0.501, 0.643), (1_448, 0.485, 0.597), (2_048, 0.46, 0.56),
        (2_896, 0.459, 0.526), (4_096, 0.447, 0.51), (5_793, 0.432, 0.483), (8_192, 0.423, 0.474), (11_585, 0.416, 0.458), (16_384, 0.411, 0.446), (23_170, 0.406, 0.433), (32_768, 0.399, 0.427), (1 << 62, 0.39, 0.423),
    )
    chunk_bytes: int = 4096
    chunk: tuple[float, float] = (0.439, 0.492)
    bad_share: float = 0.5


def repeat_words(words: list[bytes], width: int = 5) -> int:
    """Words inside a window of ``width`` words that the text has twice or more."""
    n = len(words)
    if n <= width:
        return 0
    windows = list(zip(*(words[i:] for i in range(width)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    times = Counter(windows)
    covered, end = 0, 0
    for i, w in enumerate(windows):
        if times[w] > 1:
            covered += i + width - max(end, i)
            end = i + width
    return covered


def dup_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip(SPACE)]
    return len(lines) - len(set(lines))


def measure(text: bytes, bands: Bands, zstd) -> tuple:
    """A row of SCHEMA without doc_id."""
    words = text.split()
    n = len(words)
    chars = sum(len(w.decode()) for w in words) if not text.isascii() else sum(map(len, words))
    repeats = repeat_words(words)
    failed = n < 10 or 100 * repeats > 20 * n
    size = len(text)
    ratio = len(zstd.compress(text)) / size if size else 1.0
    _, low, high = next(b for b in bands.whole if size < b[0])
    step = bands.chunk_bytes
    if size <= step:
        n_chunks, bad = int(size > 0), int(size > 0 and not low <= ratio <= high)
    else:
        starts = [*range(0, size - step, step), size - step]
        ratios = [len(zstd.compress(text[i : i + step])) / step for i in starts]
        n_chunks, bad = len(ratios), sum(not bands.chunk[0] <= r <= bands.chunk[1] for r in ratios)
    kept = not failed and low <= ratio <= high and bad <= bands.bad_share * n_chunks
    return n, chars, size - len(text.translate(None, SYMBOLS)), dup_lines(text), repeats, failed, kept, ratio, n_chunks, bad


def compression_rules(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """One row of SCHEMA per row of ``docs`` (doc_id, text)."""
    names = SCHEMA.replace(",", "").split()[2::2]

    def run(part: dict) -> dict:
        import zstandard

        zstd = zstandard.ZstdCompressor(level=bands.level, write_content_size=False)
        rows = [measure(t, bands, zstd) for t in part["text"]]
        return {"doc_id": part["doc_id"]} | {c: [r[i] for r in rows] for i, c in enumerate(names)}

    return map_slices(docs.select("doc_id", "text"), run, SCHEMA)


def op10_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression_rules(table(spark, sf_dir, "documents"))
