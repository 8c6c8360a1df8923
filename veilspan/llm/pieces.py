"""SentencePiece encoding and decoding by a max-plus parallel scan.

Ids are those of the library for the vocabulary file's own merges (byte-pair encoding with byte fallback). No
piece holds a line end, nor a space mark after another character, so no merge crosses these; ordinary texts are
encoded word by word from a memo that the library fills.

Merges as such are no best path, but their result is one: a sequence of pieces is what the merges give if and
only if each two neighbours are what the merges give for the two together. So neighbours that are score 0 and
all others minus infinity; the one path of score 0 through a text is its encoding. Giant texts are cut anywhere
into chunks. A chunk's state at its border is the piece that reaches it: how many characters lie before the
border and how many overhang it. Each chunk yields the transfer matrix from entry to exit states in the
(max, +) semiring; matrices are combined associatively per text, the path's border states follow from the end,
and each chunk is backtraced alone. Matrices and backtraces run a chunk at a time, on any executor.

Edge cases: a null or empty text has no ids; the space mark itself (U+2581) in a text decodes to a space, as
the format has it; null ids and repeated rows are passed through, a row for each row; an empty table gives an
empty result. Further columns are carried only if asked for.
"""

from __future__ import annotations

import functools
import hashlib
import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import ddl, map_slices, stash, table

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Texts above are cut into chunks; a text has at most MOST_CHUNKS.
GIANT_CHARS = 1 << 15
CHUNK_CHARS = 1 << 14
MOST_CHUNKS = 1 << 12
#: Characters whose words are looked up together, and ids decoded together.
LEARN_CHARS = 1 << 20
DECODE_IDS = 1 << 20
#: Words remembered, at most; those of LEARN_CHARS may come on top.
MEMO = 200_000
UNIT = re.compile("\n| +[^ \n]*|[^ \n]+")


def bare_file(path: str) -> bytes:
    """The vocabulary file with settings that leave a text as it is: no mark before it, white space kept."""
    with open(path, "rb") as f:
        data = f.read()

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = data[at]
            at, value, shift = at + 1, value | (b & 127) << shift, shift + 7
            if b < 128:
                return value, at

    out, at = bytearray(), 0
    while at < len(data):  # fields of the file: 1 a piece, 2 the trainer's, 3 the normaliser's settings
        length, start = varint(at + 1)
        body = data[start : start + length]
        if data[at] == 0x1A:
            body += bytes([0x18, 0, 0x20, 0, 0x28, 1])  # no dummy prefix, keep white space, escape it: the last value of a field holds
        size, lead = len(body), bytearray([data[at]])
        while size >= 128:
            lead.append(size & 127 | 128)
            size >>= 7
        out += lead + bytes([size]) + body
        at = start + length
    return bytes(out)


class Pieces:
    """The pieces of a SentencePiece vocabulary, and paths of neighbours that the merges give."""

    def __init__(self, path: str):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        own = [i for i in range(n) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
        self.text = [m.id_to_piece(i) for i in range(n)]
        self.ids = {self.text[i]: i for i in own}
        self.bytes = {self.text[i]: i for i in range(n) if m.is_byte(i)}
        byte_of = {i: int(t[1:-1], 16) for t, i in self.bytes.items()}
        self.unknown_id = m.unk_id()
        self.longest = max(map(len, self.ids))
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in self.ids):
            raise ValueError("a piece crosses a word border")
        self.library = sentencepiece.SentencePieceProcessor(model_proto=bare_file(path))
        self.plain = [bytes([byte_of[i]]) if i in byte_of else b"" if m.is_control(i) else t.replace(MARK, " ").encode() for i, t in enumerate(self.text)]
        self.commas = [b"%d," % i for i in range(n)]
        self.memo: dict[str, bytes] = {"": b""}
        self.known: dict[tuple[str, str], bool] = {}

    def ids_of(self, token: str) -> list[int]:
        """A piece's id, or the byte pieces of a character that is none."""
        piece = self.ids.get(token)
        return [piece] if piece is not None else [self.bytes.get(f"<0x{b:02X}>", self.unknown_id) for b in token.encode()]

    def neighbours(self, a: str, b: str) -> bool:
        """Whether the merges give ``a`` and ``b`` for both together (``a`` empty: ``b`` for itself)."""
        found = self.known.get((a, b))
        if found is None:
            if len(self.known) > 400_000:
                self.known = {}
            wanted = self.ids_of(a) + self.ids_of(b) if a else self.ids_of(b)
            self.known[a, b] = found = self.library.encode(a + b) == wanted
        return found

    def coded(self, parts: list[str]) -> list[bytes]:
        """Ids (int32) of each of ``parts`` (units: no border inside), from the memo or the library."""
        if len(self.memo) > MEMO:
            self.memo = {"": b""}
        memo = self.memo
        out = list(map(memo.get, parts))
        if missing := [i for i, x in enumerate(out) if x is None]:
            new = list({parts[i] for i in missing})
            memo.update((u, array("i", ids).tobytes()) for u, ids in zip(new, self.library.encode([u.replace(" ", MARK) for u in new], num_threads=1), strict=True))
            for i in missing:
                out[i] = memo[parts[i]]
        return out

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; the units of about LEARN_CHARS are held at once."""
        out: list[np.ndarray] = []
        at = 0
        while at < len(texts):
            flat, ends, size = [], [0], 0
            while at < len(texts) and size < LEARN_CHARS:
                flat += units(" " + texts[at]) if texts[at] else []
                ends.append(len(flat))
                size += len(texts[at])
                at += 1
            got = self.coded(flat)
            out += [np.frombuffer(b"".join(got[a:b]), np.int32) for a, b in zip(ends, ends[1:], strict=False)]
        return out

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def decode(self, ids: Iterable[int]) -> str:
        """The text; its first mark stands before the first word, and bytes that are no character become U+FFFD."""
        return b"".join(map(self.plain.__getitem__, ids)).decode(errors="replace")[1:]

    # Chunks. ``f`` is a chunk's own characters f[a:b] with up to ``longest`` before and ``longest`` - 1 after them.

    def states(self, f: str, at: int) -> list[tuple[int, int]]:
        """(start, end) in ``f`` of every piece that may reach the border at ``at``; at a text's start only (0, 0)."""
        if at == 0:
            return [(0, 0)]
        reach = range(at, min(len(f), at + self.longest - 1) + 1)
        return [(x, y) for x in range(at - 1, max(-1, at - self.longest - 1), -1) for y in reach if y - x <= self.longest and (f[x:y] in self.ids or (y - x == 1 and f[x] not in self.ids))]

    def paths(self, f: str, start: int, end: int, entries: list[tuple[int, int]]) -> list[dict[int, int] | list[int]]:
        """For each entry piece: the start of the piece that ends at each position, on the path from it; pieces start before ``end``.

        From one entry at most one path leads to a position. Paths that agree over ``longest`` positions agree from there on.
        """
        ids, longest = self.ids, self.longest
        done: list[list[int]] = []
        for x, y in entries:
            back = [-1] * (min(len(f), end + longest) + 1)
            back[y] = x
            twin, same = (done[0] if done else None), 0
            i = y
            while i < end:
                if back[i] >= 0:
                    last = f[back[i] : i]
                    for j in range(i + 1, min(i + longest, len(back) - 1) + 1):
                        token = f[i:j]
                        if (token in ids or (j == i + 1 and token not in ids)) and self.neighbours(last, token):
                            back[j] = i
                i += 1
                if twin is not None:
                    same = same + 1 if back[i] == twin[i] else 0
                    if same > longest:
                        back[i:] = twin[i:]
                        break
            done.append(back)
        return done

    def ends(self, f: str, a: int, b: int) -> tuple[int, int]:
        """The first and last position inside a..b that no piece crosses; (-1, -1) if there is none."""
        cut = [a + m.start() + 1 for m in re.finditer(f"[^{MARK}](?=[{MARK}\n])|\n(?=[^\n])", f[a:b])]
        cut = [c for c in cut if c < b]
        return (cut[0], cut[-1]) if cut else (-1, -1)

    def transfer(self, f: str, a: int, b: int) -> np.ndarray:
        """Max-plus matrix [entry, exit] of a chunk, 1 for score 0 and 0 for minus infinity."""
        entries, leaves = self.states(f, a), self.states(f, b)
        out = np.zeros((len(entries), len(leaves)), np.int8)
        first, last = self.ends(f, a, b)
        short = [k for k, (_, y) in enumerate(entries) if y < (b if first < 0 else first) or y == first]
        if first < 0:
            for k, back in zip(short, self.paths(f, a, b, [entries[k] for k in short]), strict=True):
                out[k] = [x >= a and back[y] == x for x, y in leaves]
        else:
            tail = self.paths(f, last, b, [(last, last)])[0]
            right = np.array([x >= last and tail[y] == x for x, y in leaves], np.int8)
            for k, back in zip(short, self.paths(f, a, first, [entries[k] for k in short]), strict=True):
                out[k] = right * (back[first] >= 0)
        for k, (x, y) in enumerate(entries):
            if y >= b:  # the entry piece reaches the other border itself
                out[k] = [s == (x, y) for s in leaves]
        return out

    def backtrace(self, f: str, a: int, b: int, enter: int, leave: int) -> list[int]:
        """Ids of the pieces that start in the chunk, on the path between two states."""
        entry, (x, y) = self.states(f, a)[enter], self.states(f, b)[leave]
        if entry[1] >= b:
            return []
        first, last = self.ends(f, a, b)
        if first < 0:
            return self.trace(f, self.paths(f, a, b, [entry])[0], entry[1], y)
        out = self.trace(f, self.paths(f, a, first, [entry])[0], entry[1], first)
        out += np.frombuffer(b"".join(self.coded(units(f[first:last]))), np.int32).tolist()
        return out + self.trace(f, self.paths(f, last, b, [(last, last)])[0], last, y)

    def trace(self, f: str, back: list[int], start: int, at: int) -> list[int]:
        out: list[list[int]] = []
        while at > start:
            out.append(self.ids_of(f[back[at] : at]))
            at = back[at]
        return list(chain.from_iterable(reversed(out)))


def marked(text: str) -> str:
    return MARK + text.replace(" ", MARK) if text else ""


def units(s: str) -> list[str]:
    """Line ends, and words with the spaces before them; a space mark counts as a space, and empty units may stand between."""
    if "  " in s or "\0" in s or MARK in s:
        return UNIT.findall(s.replace(MARK, " "))
    return s.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0")


@functools.cache
def pieces(path: str) -> Pieces:
    return Pieces(path)


def times(v: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Max-plus product of a vector and a matrix of scores 0 (as 1) and minus infinity (as 0)."""
    return (v[:, None] & m).max(0)


#: What the tasks that make ids make of them: columns of a list of ids, and their types.
Finish = tuple[Callable[["Pieces", list[np.ndarray]], dict], str]


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, carry: tuple[str, ...] = (), giant: int = GIANT_CHARS, finish: Finish | None = None) -> DataFrame:
    """doc_id, the carried columns and ids of every row; with ``finish`` its columns in place of the ids, which then stay in their task."""
    rows = docs.select("doc_id", *carry, "text")
    fields = [f for f in rows.schema.fields if f.name != "text"]
    names = [f.name for f in fields]
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    long = F.coalesce(F.length("text"), F.lit(0)) > giant

    def short(part: dict) -> dict:
        p = pieces(vocabulary)
        ids = p.encode_all([t.decode() for t in part["text"]])
        return {c: part[c] for c in names} | (finish[0](p, ids) if finish else {"ids": ids})

    schema = f"{types}, {finish[1] if finish else 'ids array<int>'}"
    small, large = map_slices(rows.where(~long), short, schema), encode_giant(rows.where(long), vocabulary, names, types)
    return small.unionByName(finished(large, vocabulary, finish[0], schema) if finish else large)


def id_slices(batch: pa.RecordBatch, at: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Slices of a batch with the ids of its column ``at``, about DECODE_IDS each (one row at least)."""
    column = batch.column(at)
    ends, values, lo = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False), 0
    while lo < batch.num_rows:
        hi = min(batch.num_rows, max(lo + 1, int(np.searchsorted(ends, ends[lo] + DECODE_IDS))))
        yield batch.slice(lo, hi - lo), [values[a:b] for a, b in zip(ends[lo:hi].tolist(), ends[lo + 1 : hi + 1].tolist(), strict=True)]
        lo = hi


def finished(encoded: DataFrame, vocabulary: str, fn: Callable[[Pieces, list[np.ndarray]], dict], schema: str) -> DataFrame:
    out, at = to_arrow_schema(ddl(schema)), encoded.columns.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(vocabulary)
        for batch in batches:
            for part, ids in id_slices(batch, at):
                kept = [c for i, c in enumerate(part.columns) if i != at]
                made = fn(p, ids)
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(kept, out, strict=False)] + [pa.array(made[f.name], f.type) for f in list(out)[len(kept) :]], schema=out)

    return encoded.mapInArrow(run, schema)


def digests(p: Pieces, ids: list[np.ndarray]) -> dict:
    """Number of ids, and hex digests of the ids (comma-joined) and of the text decoded from them."""
    out: dict[str, list] = {"n_tokens": [len(x) for x in ids], "ids_sha256": [], "decoded_sha256": []}
    for x in ids:
        own = x.tolist()
        out["ids_sha256"].append(hashlib.sha256(b"".join(map(p.commas.__getitem__, own))[:-1]).hexdigest())
        out["decoded_sha256"].append(hashlib.sha256(p.decode(own).encode()).hexdigest())
    return out


def encode_giant(rows: DataFrame, vocabulary: str, names: list[str], types: str) -> DataFrame:
    def cut(part: dict) -> dict:
        from pyspark import TaskContext

        longest = pieces(vocabulary).longest
        out: dict[str, list] = {c: [] for c in [*names, "key", "k", "a", "b", "f"]}
        for r, text in enumerate(part["text"]):
            s = marked(text.decode())
            step = max(CHUNK_CHARS, -(-len(s) // MOST_CHUNKS))
            key = (TaskContext.get().partitionId() << 36) + counter.setdefault("rows", 0)
            counter["rows"] += 1
            for k, at in enumerate(range(0, len(s), step)):
                lead, own = min(at, longest), min(step, len(s) - at)
                for c in names:
                    out[c].append(part[c][r])
                for c, v in (("key", key), ("k", k), ("a", lead), ("b", lead + own), ("f", s[at - lead : at + own + longest - 1])):
                    out[c].append(v)
        return out

    counter: dict[str, int] = {}
    # the keys are made up while reading, so the chunks are kept
    chunks = stash(map_slices(rows, cut, f"{types}, key long, k int, a int, b int, f string"), "chunks")

    def matrix(part: dict) -> dict:
        p = pieces(vocabulary)
        found = [p.transfer(f.decode(), a, b) for f, a, b in zip(part["f"], part["a"], part["b"], strict=True)]
        return {"key": part["key"], "k": part["k"], "m": [m.tobytes() for m in found], "leaves": [m.shape[1] for m in found]}

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        """Entry and exit state of each chunk: products from the start, then the one path of score 0 from the end."""
        pdf = pdf.sort_values("k")
        v, before, matrices = np.ones(1, np.int8), [], []
        for m, leaves in zip(pdf["m"], pdf["leaves"], strict=True):
            before.append(v)
            matrices.append(np.frombuffer(m, np.int8).reshape(-1, leaves))
            v = times(v, matrices[-1])
        at, enter, leave = int(np.argmax(v)), [], []
        for v, m in zip(reversed(before), reversed(matrices), strict=True):
            leave.append(at)
            at = int(np.argmax(v & m[:, at]))
            enter.append(at)
        return pd.DataFrame({"key": pdf["key"], "k": pdf["k"], "enter": enter[::-1], "leave": leave[::-1]})

    def back(part: dict) -> dict:
        p = pieces(vocabulary)
        found = [p.backtrace(f.decode(), *x) for f, *x in zip(part["f"], part["a"], part["b"], part["enter"], part["leave"], strict=True)]
        return {c: part[c] for c in (*names, "key", "k")} | {"part": found}

    matrices = map_slices(chunks.select("key", "k", "a", "b", "f"), matrix, "key long, k int, m binary, leaves int", "f")
    borders = matrices.groupBy("key").applyInPandas(scan, "key long, k int, enter int, leave int")
    traced = map_slices(chunks.join(borders, ["key", "k"]).select(*names, "key", "k", "a", "b", "f", "enter", "leave"), back, f"{types}, key long, k int, part array<int>", "f")
    # the chunks of one text: its ids fit one row as its characters did
    whole = traced.groupBy("key").agg(*(F.first(c).alias(c) for c in names), F.sort_array(F.collect_list(F.struct("k", "part"))).alias("parts"))
    return whole.select(*names, F.flatten(F.col("parts.part")).alias("ids"))


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Adds ``text`` from ``ids`` (null for null); about DECODE_IDS ids are decoded at once."""
    at = encoded.columns.index("ids")
    whole = T.StructType([*encoded.schema.fields, T.StructField("text", T.StringType())])
    schema = to_arrow_schema(whole)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(vocabulary)
        for batch in batches:
            for part, ids in id_slices(batch, at):
                texts = [p.decode(x.tolist()) if v else None for x, v in zip(ids, part.column(at).is_valid().to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(part.columns, schema, strict=False)] + [pa.array(texts, pa.string())], schema=schema)

    return encoded.mapInArrow(run, whole)


def op6_piece_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), finish=(digests, "n_tokens long, ids_sha256 string, decoded_sha256 string"))
