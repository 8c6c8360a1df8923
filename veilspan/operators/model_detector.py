"""Optional detection by a language model: a transport of the user answers requests; its answers are grounded in the text.

Only what stands in the text, up to its white space, becomes a candidate. Nothing is requested unless a
transport is given. Answers may differ between tries, so the lineage is cut before they are used.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, replace

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from ..functions import canonical as C
from ..functions import checksums as V
from ..plans.lineage import cut
from .detect import CANDIDATE
from .resolve import MODEL_RULE

_WORD = regex.compile(r"[\p{L}\p{N}\p{M}_]")


class DetectionFailed(Exception):
    """The model's answer cannot be used."""


class SourceMismatch(DetectionFailed):
    """An entity of the answer does not stand in the text."""


class TooLong(DetectionFailed):
    """The request or its answer is beyond the model's limits; a shorter text may do."""


@dataclass(frozen=True)
class Model:
    """``transport`` takes {text, types, repair, seconds left} and returns {entities: [{type, text, occurrence}]}."""

    transport: Callable[[dict], dict]
    types: tuple[str, ...]
    chunk: int = 4000
    overlap: int = 200
    max_chunks: int = 512
    max_depth: int = 4
    seconds: float = 600.0  # for one text
    fail: bool = True  # otherwise the rules alone decide, and the row says so


def occurrences(source: str, value: str) -> list[tuple[int, int]]:
    """All places of ``value`` in ``source`` where only the layout of white space may differ and no word is cut."""
    words = [(m.start(), m.end()) for m in regex.finditer(r"\S+", source)]
    flat = " ".join(source[a:b] for a, b in words)
    place = [p for i, (a, b) in enumerate(words) for p in (*range(a, b), *((b,) if i < len(words) - 1 else ()))]
    want, found, at = " ".join(value.split()), [], 0
    while want and (at := flat.find(want, at)) >= 0:
        end = at + len(want)
        cut_before = _WORD.match(want[0]) and at and _WORD.match(flat[at - 1])
        cut_after = _WORD.match(want[-1]) and end < len(flat) and _WORD.match(flat[end])
        if cut_before or cut_after:
            at += 1
            continue
        found.append((place[at], place[end - 1] + 1))
        at = end
    if not found:
        raise SourceMismatch(f"{len(value)} characters not in the text")
    return found


def chunks(text: str, size: int, overlap: int) -> list[tuple[int, str]]:
    """Overlapping stretches of at most ``size`` UTF-8 bytes, ending at white space where the last quarter has some."""
    out, at = [], 0
    while at < len(text):
        part = text[at : at + size].encode()[:size].decode(errors="ignore")
        if at + len(part) < len(text):
            edge = max(part.rfind("\n"), part.rfind(" "))
            part = part[: edge + 1] if edge >= 0.75 * len(part) else part
        out.append((at, part))
        if at + len(part) >= len(text):
            break
        at = max(at + 1, at + len(part) - overlap)
    return out


def _entities(answer: dict, types: tuple[str, ...]) -> list[tuple[str, str]]:
    if not isinstance(answer, dict) or set(answer) != {"entities"} or not isinstance(answer["entities"], list) or len(answer["entities"]) > 1000:
        raise DetectionFailed("malformed answer")
    for e in answer["entities"]:
        if not isinstance(e, dict) or set(e) != {"type", "text", "occurrence"} or e["type"] not in types or not isinstance(e["text"], str):
            raise DetectionFailed("malformed entity")
    return [(e["type"], e["text"]) for e in answer["entities"]]


def ask(text: str, model: Model) -> list[tuple[str, int, int]]:
    """Distinct (type, start, end); a stretch whose answer does not fit is asked again once, then halved, one too long is halved."""
    todo = [(at, part, 0) for at, part in chunks(text, model.chunk, model.overlap)]
    asked, spans, until = len(todo), set(), time.monotonic() + model.seconds
    if asked > model.max_chunks:
        raise DetectionFailed("too many chunks")

    def once(part: str, again: bool) -> list[tuple[str, int, int]]:
        left = until - time.monotonic()
        if left <= 0:
            raise DetectionFailed("out of time")
        got = _entities(model.transport({"text": part, "types": list(model.types), "repair": again, "seconds": left}), model.types)
        return [(kind, a, b) for kind, value in got for a, b in occurrences(part, value)]

    while todo:
        at, part, depth = todo.pop()
        try:
            try:
                here = once(part, False)
            except SourceMismatch:
                here = once(part, True)
        except (SourceMismatch, TooLong):
            halves = chunks(part, max(64, len(part.encode()) // 2), model.overlap // (2 << depth))
            asked += len(halves)
            if depth >= model.max_depth or len(part.encode()) <= 128 or asked > model.max_chunks:
                raise
            todo += [(at + a, p, depth + 1) for a, p in halves]
            continue
        spans |= {(kind, at + a, at + b) for kind, a, b in here}
    return sorted(spans, key=lambda f: f[1:])


def narrowed(model: Model, wanted: Callable[[str], bool]) -> Model:
    return replace(model, types=tuple(t for t in model.types if wanted(t)))


_FOUND = pa.struct([("spans", pa.list_(pa.struct([("entity_type", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))), ("failed", pa.bool_())])


def found(text: Column, model: Model) -> Column:
    """struct<spans, failed> of each text: what the model found, in the text's own positions."""

    @F.arrow_udf(from_arrow_type(_FOUND))
    def run(texts: pa.Array) -> pa.Array:
        rows = []
        for t in texts.to_pylist():
            try:
                rows.append({"spans": [{"entity_type": k, "start": a, "end": b} for k, a, b in ask(t or "", model)], "failed": False})
            except DetectionFailed:
                if model.fail:
                    raise
                rows.append({"spans": [], "failed": True})
        return pa.array(rows, type=_FOUND)

    return run.asNondeterministic()(text)


def _canonical(kind: Column, value: Column) -> Column:
    by = F.when(kind.isin("TCKN", "VKN", "MERSIS", "KREDI_KARTI"), C.digits(value)).when(kind == "IBAN", C.iban(value)).when(kind == "KISI", C.name(value))
    return by.when(kind == "TELEFON", C.phone(value)).when(kind == "EPOSTA", C.email(value)).when(kind == "PLAKA", C.plate(value)).otherwise(F.lower(F.trim(value)))


def as_candidates(spans: Column, text: Column) -> Column:
    """The model's spans as candidates beside those of the rules; identifiers with a checksum are checked."""

    def one(s: Column) -> Column:
        kind, value = s["entity_type"], F.substring(text, s["start"] + 1, s["end"] - s["start"])
        canon = _canonical(kind, value)
        ok = F.when(kind == "TCKN", V.tckn_valid(canon)).when(kind == "VKN", V.vkn_valid(canon)).when(kind == "IBAN", V.iban_valid(canon)).when(kind == "KREDI_KARTI", V.luhn_valid(canon))
        status = F.when(ok, "valid").when(~ok, "invalid").otherwise("not_checked")
        return F.struct(
            s["start"].alias("start"), s["end"].alias("end"), value.alias("value"), kind.alias("entity_type"), canon.alias("canonical"), F.lit(0.85).alias("confidence"),
            F.lit(MODEL_RULE).alias("rule_id"), status.alias("status"), F.lit(False).alias("labelled"), F.lit(40).alias("priority"), F.lit(0).alias("bonus"),
        )

    return F.transform(spans, one).cast(CANDIDATE)


def detected(df: DataFrame, key: str, model: Model, text: str = "text") -> DataFrame:
    """(key, entity_type, start, end, value, confidence, priority, rule_id, failed); a failed text gives one row without a span."""
    asked = cut(df.select(key, F.col(text).alias("_text"), found(F.col(text), model).alias("_found")))
    rows = asked.select(key, F.explode_outer(as_candidates(F.col("_found.spans"), F.col("_text"))).alias("c"), F.col("_found.failed").alias("failed"))
    return rows.where("failed or c is not null").select(key, "c.entity_type", "c.start", "c.end", "c.value", "c.confidence", "c.priority", F.lit(MODEL_RULE).alias("rule_id"), "failed")
