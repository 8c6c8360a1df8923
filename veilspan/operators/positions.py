"""Positions in the normalised text and in the original one."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import DELETED

_PAIRS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def original_spans(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A span begins where its first kept character began and ends where its last one ended; at the text's end it takes what follows."""
    starts, ends = [], []
    for i, ch in enumerate(text):
        if ch == "\n" and i and text[i - 1] == "\r":
            ends[-1] = i + 1
        elif ch not in DELETED:
            starts.append(i)
            ends.append(i + 1)
    n = len(starts)
    return [(starts[a] if a < n else len(text), len(text) if b >= n else ends[b - 1] if b else 0) for a, b in spans]


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))
def _original(texts: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
    rows = []
    for t, a, b in zip(texts.to_pylist(), starts.to_pylist(), ends.to_pylist(), strict=True):
        rows.append(None if t is None else [{"start": x, "end": y} for x, y in original_spans(t, list(zip(a, b, strict=True)))])
    return pa.array(rows, type=_PAIRS)


_moved = _original.asNondeterministic()


def to_original(df: DataFrame, text: str, plain: str, spans: str) -> DataFrame:
    """Moves ``spans``, found in ``plain``, to positions of the original text; only texts whose length normalisation changes go to Python."""
    df = df.withColumn("_shift", F.col(text).rlike(f"[{DELETED}]|\r\n") & (F.size(spans) > 0))
    part = F.when(F.col("_shift"), F.col(spans))
    df = df.withColumn("_at", _moved(F.when(F.col("_shift"), F.col(text)), part["start"], part["end"]))

    def moved(c, p):
        value = F.substring(F.col(text), p["start"] + 1, p["end"] - p["start"])
        return c.withField("start", p["start"]).withField("end", p["end"]).withField("value", value)

    same = F.transform(spans, lambda c: c.withField("value", F.substring(F.col(text), c["start"] + 1, c["end"] - c["start"])))
    return df.withColumn(spans, F.when(F.col("_shift"), F.zip_with(spans, "_at", moved)).when(F.col(text) == F.col(plain), F.col(spans)).otherwise(same)).drop("_shift", "_at")
