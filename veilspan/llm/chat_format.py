"""Token-level chat formatting.

Each turn is encoded by itself; reserved ids above the vocabulary mark turns, so no text can produce one.
Control strings occurring inside texts are escaped reversibly before encoding: ``<ESC*/s>`` gains one ESC
(U+241B) after its first character. The loss mask is the prefix sum of +1/-1 steps at the borders of
assistant segments. A conversation becomes rows of at most about ``PART_TOKENS`` ids, in order of ``part``,
so its length is not bounded by memory.

Encoding runs per turn before anything is grouped; the turns of a conversation then stream through one
sorted partition, and only the current part is held. Edge cases: a null text or role counts as empty; turns
are ordered by turn (nulls first), then role and text, and repeated rows are kept as turns of their own; rows
with a null conv_id form one conversation; an unknown role is spelled inside the markers; an empty table
gives an empty result. Only the columns named are read, so further columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import ddl, map_slices, table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How byte-level BPE vocabularies of this kind cut a text before merging.
PIECES = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Control strings and their reserved ids, counted from the end of the vocabulary.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[TEXT]", "[/ROLE]")
#: Opening and closing controls by role; other roles are spelled out: [ROLE]name[TEXT]text[/ROLE].
ROLES = {"user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}
ESC = "␛"
PART_TOKENS = 1 << 16
PIECE = regex.compile(PIECES)
#: Characters encoded at once, and what is left of the piece they end in.
ENCODE_CHARS = 1 << 16
ESCAPE = re.compile("(" + "|".join(f"{re.escape(c[0])}(?={ESC}*{re.escape(c[1:])})" for c in CONTROLS) + ")")
UNESCAPE = re.compile("(" + "|".join(f"{re.escape(c[0])}(?={ESC}+{re.escape(c[1:])})" for c in CONTROLS) + f"){ESC}")


def escape(text: str) -> str:
    return ESCAPE.sub(rf"\1{ESC}", text)


def unescape(text: str) -> str:
    return UNESCAPE.sub(r"\1", text)


@functools.cache
def encoder(path: str):
    """The byte-level BPE encoder and the id of the first control."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("chat", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={}), max(ranks.values()) + 1


def encode(text: str, bpe) -> list[int]:
    """Ids of the whole text, cut only where two pieces meet."""
    if len(text) <= ENCODE_CHARS:
        return bpe.encode_ordinary(text)
    ids: list[int] = []
    at = 0
    for m in PIECE.finditer(text):
        if m.end() - at >= ENCODE_CHARS:
            ids += bpe.encode_ordinary(text[at : m.end()])
            at = m.end()
    return ids + bpe.encode_ordinary(text[at:])


def encoded_turns(turns: DataFrame, vocabulary: str) -> DataFrame:
    """conv_id, turn, role, text_key (orders equal turns) and the ids of each turn with its markers."""

    def run(part: dict) -> dict:
        bpe, base = encoder(vocabulary)
        mark = {c: base + i for i, c in enumerate(CONTROLS)}
        rows, steps = [], []
        for role, text in zip(part["role"], part["text"], strict=True):
            ids = encode(escape(text.decode()), bpe)
            if role in ROLES:
                head, tail = [mark[ROLES[role][0]]], [mark[ROLES[role][1]]]
            else:
                head, tail = [mark["[ROLE]"], *encode(escape(role or ""), bpe), mark["[TEXT]"]], [mark["[/ROLE]"]]
            rows.append(head + ids + tail)
            steps.append([len(head), len(head) + len(ids)])
        return {k: part[k] for k in ("conv_id", "turn", "role")} | {"text_key": part["text"], "ids": rows, "span": steps}

    return map_slices(turns.select("conv_id", "turn", "role", "text"), run, "conv_id long, turn long, role string, text_key binary, ids array<int>, span array<int>")


FORMATTED = "conv_id long, part int, ids array<int>, loss_mask array<tinyint>"


def format_chats(turns: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """FORMATTED rows; parts of a conversation follow one another in one partition."""
    rows = encoded_turns(turns, vocabulary)
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.coalesce("role", F.lit("")), F.col("text_key")]
    rows = rows.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "role", "ids", "span")
    schema = to_arrow_schema(ddl(FORMATTED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, part, ids, steps, size = None, 0, [], [], 0
        done: list[tuple] = []

        def close() -> None:
            nonlocal part, ids, steps, size
            if ids:
                delta = np.zeros(size + 1, np.int8)
                for a, b in steps:
                    delta[a] += 1
                    delta[b] -= 1
                done.append((conv, part, np.concatenate(ids), np.cumsum(delta[:-1], dtype=np.int8)))
                part, ids, steps, size = part + 1, [], [], 0

        def batch() -> pa.RecordBatch:
            cols = list(zip(*done, strict=True)) if done else [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

        first = True
        for b in batches:
            keys, roles, all_ids, spans = (b.column(i) for i in range(4))
            for i in range(b.num_rows):
                key = keys[i].as_py()
                if first or key != conv:
                    close()
                    conv, part, first = key, 0, False
                row = np.asarray(all_ids[i].values, np.int32)
                if roles[i].as_py() == "assistant":
                    a, e = spans[i].as_py()
                    if e > a:
                        steps.append((size + a, size + e))
                ids.append(row)
                size += len(row)
                if size >= PART_TOKENS:
                    close()
                if sum(len(d[2]) for d in done[-64:]) >= PART_TOKENS or len(done) >= 2048:
                    yield batch()
                    done.clear()
        close()
        yield batch()

    return rows.mapInArrow(run, ddl(FORMATTED))


READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long"


def read_back(formatted: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """What the formatted rows say: a row of READ per conversation, from ids and mask alone."""
    rows = formatted.select("conv_id", "part", "ids", "loss_mask")
    schema = to_arrow_schema(ddl(READ))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, base = encoder(vocabulary)
        opens = {base + CONTROLS.index(a): r for r, (a, _) in ROLES.items()} | {base + CONTROLS.index("[ROLE]"): None}
        done: list[tuple] = []
        state: dict = {}

        def finish() -> None:
            if state:
                done.append((state["conv"], state["n"], state["turns"].hexdigest(), state["chars"], state["loss"].hexdigest(), state["formatted"], state["tokens"]))

        def text_of(ids: np.ndarray) -> str:
            return bpe.decode_bytes(ids.tolist()).decode()

        def batch() -> pa.RecordBatch:
            cols = list(zip(*done, strict=True)) if done else [[]] * len(schema)
            return pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

        for b in batches:
            for i in range(b.num_rows):
                conv = b.column(0)[i].as_py()
                if not state or state["conv"] != conv:
                    finish()
                    state = {"conv": conv, "n": 0, "turns": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "formatted": 0, "tokens": 0}
                ids, mask = np.asarray(b.column(2)[i].values, np.int32), np.asarray(b.column(3)[i].values, np.int8)
                state["tokens"] += len(ids)
                marks = np.flatnonzero(ids >= base)
                state["formatted"] += sum(len(CONTROLS[ids[m] - base]) for m in marks)
                k = 0
                while k < len(marks):
                    role = opens[int(ids[marks[k]])]
                    if role is None:
                        raw = text_of(ids[marks[k] + 1 : marks[k + 1]])
                        state["formatted"] += len(raw)
                        role, k = unescape(raw), k + 1
                    at, end = marks[k] + 1, marks[k + 1]
                    raw = text_of(ids[at:end])
                    text = unescape(raw)
                    state["n"] += 1
                    state["formatted"] += len(raw)
                    for x in (role, "\n", text, "\n"):
                        state["turns"].update(x.encode())
                    if mask[at:end].any():
                        said = unescape(text_of(ids[at:end][mask[at:end] > 0]))
                        state["chars"] += len(said)
                        state["loss"].update(said.encode())
                    k += 2
            if len(done) >= 4096:
                yield batch()
                done.clear()
        finish()
        yield batch()

    return rows.mapInArrow(run, ddl(READ))


def op7_chat_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    turns = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(probe)
    return read_back(format_chats(turns)).drop("n_tokens")


_PATTERN = "|".join(f"{re.escape(c[0])}{ESC}*{re.escape(c[1:])}" for c in CONTROLS)
#: Every control string in a text gains one character; no control string starts inside another.
SQL7 = f"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), f as (
  select *, length(text) + len(regexp_extract_all(text, '{_PATTERN}'))
    + case role when 'user' then 13 when 'assistant' then 7 when 'system' then 15 else 19 + length(role) + len(regexp_extract_all(role, '{_PATTERN}')) end as chars from t
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(chars)::bigint as formatted_chars
from f group by conv_id
"""
