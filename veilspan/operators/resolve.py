"""Policy filter, scores and the choice of non-overlapping candidates with the highest score sum."""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type


#: The rule of candidates that a model found.
MODEL_RULE = "LLM_OLLAMA"


@dataclass(frozen=True)
class Policy:
    name: str
    min_confidence: float
    valid_only: bool = False
    drop_invalid: bool = False


# Fixed values.
POLICIES = {p.name: p for p in (Policy("strict", 0.5), Policy("balanced", 0.6, drop_invalid=True), Policy("validated_only", 0.8, valid_only=True), Policy("logs", 0.4))}


def policy(name: str) -> Policy:
    if name not in POLICIES:
        raise ValueError(f"unknown policy: {name}")
    return POLICIES[name]


def allowed(c: Column, p: Policy) -> Column:
    ok = c["labelled"] | (c["confidence"] >= p.min_confidence)
    if p.valid_only:
        ok = ok & (c["status"] == "valid")
    if p.drop_invalid:
        ok = ok & (c["labelled"] | (c["status"] != "invalid"))
    return ok


def score(c: Column) -> Column:
    evidence = F.when(c["status"] == "valid", 500).when(c["status"] == "invalid", -350).otherwise(0) + F.when(c["labelled"], 400).otherwise(0) + c["bonus"]
    return F.greatest(F.lit(0.1), c["priority"] * 100 + evidence + c["confidence"] * 100 + F.least(F.octet_length(c["value"]), F.lit(30)))


def best_subset(spans: list[tuple[int, int, float]]) -> list[int]:
    """Indices of the disjoint spans (start, end, score) with the highest sum, by start."""
    order = sorted(range(len(spans)), key=lambda i: (spans[i][1], spans[i][0], -spans[i][2]))
    ends = [spans[i][1] for i in order]
    total = [0.0]
    for k, i in enumerate(order):
        before = bisect_right(ends, spans[i][0], 0, k)
        total.append(max(total[k], total[before] + spans[i][2]))
    chosen, k = [], len(order)
    while k:
        i = order[k - 1]
        before = bisect_right(ends, spans[i][0], 0, k - 1)
        if total[before] + spans[i][2] >= total[k - 1]:
            chosen.append(i)
            k = before
        else:
            k -= 1
    return sorted(chosen, key=lambda i: spans[i][0])


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _picks(starts: pd.Series, ends: pd.Series, scores: pd.Series) -> pd.Series:
    return pd.Series([best_subset(list(zip(a.tolist(), b.tolist(), s.tolist(), strict=True))) if a is not None and len(a) else [] for a, b, s in zip(starts, ends, scores, strict=True)], dtype="object")


#: Never merged into other expressions or run twice, which the optimiser may do with deterministic functions.
_chosen = _picks.asNondeterministic()


def covered(selected: list[tuple[int, int]], accepted: list[tuple[int, int, float]]) -> list[tuple[int, int, int | None]]:
    """``selected`` spans, but where accepted model spans (start, end, score) reach beyond them, one span over the whole group.

    The third part is the index of the model span that names a merged group, None for a span that stays.
    """
    entries = sorted([(a, b, i) for i, (a, b, _) in enumerate(accepted)] + [(a, b, None) for a, b in selected], key=lambda e: e[:2])
    groups: list[list] = []
    reach = -1
    for e in entries:
        if not groups or e[0] >= reach:
            groups.append([])
        groups[-1].append(e)
        reach = max(reach, e[1])
    out = []
    for g in groups:
        end, own = max(e[1] for e in g), [e for e in g if e[2] is None]
        rest = [e[2] for e in g if e[2] is not None]
        if not rest or sum(b - a for a, b, _ in own) == end - g[0][0]:
            out += own
        else:
            out.append((g[0][0], end, max(rest, key=lambda i: accepted[i][2])))
    return out


_COVER = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("pick", pa.int32())]))


@F.arrow_udf(from_arrow_type(_COVER))
def _cover(starts: pa.Array, ends: pa.Array, scores: pa.Array, model: pa.Array) -> pa.Array:
    """The spans chosen, each with the candidate that names it; model candidates keep their whole reach."""
    rows = []
    for a, b, s, m in zip(starts.to_pylist(), ends.to_pylist(), scores.to_pylist(), model.to_pylist(), strict=True):
        if a is None:
            rows.append(None)
            continue
        picks = best_subset(list(zip(a, b, s, strict=True)))
        own = [i for i in range(len(a)) if m[i]]
        by_span = {(a[i], b[i]): i for i in picks}
        spans = covered([(a[i], b[i]) for i in picks], [(a[i], b[i], s[i]) for i in own]) if own else [(a[i], b[i], None) for i in picks]
        rows.append([{"start": x, "end": y, "pick": by_span[x, y] if i is None else own[i]} for x, y, i in spans])
    return pa.array(rows, type=_COVER)


_covered = _cover.asNondeterministic()


def with_covered(df, column: str, p: Policy, text: str):
    """As ``with_resolved``, but overlapping candidates of the model and the spans chosen become one span where the choice would uncover text."""
    df = df.withColumn(column, F.array_sort(F.filter(column, lambda c: allowed(c, p)))).withColumn("_overlap", _overlapping(column))
    part = F.when(F.col("_overlap"), F.col(column))
    flags = F.transform(part, lambda c: c["rule_id"] == MODEL_RULE)
    df = df.withColumn("_pick", _covered(part["start"], part["end"], F.transform(part, lambda c: score(c).cast("double")), flags))

    def one(x):
        c = F.get(F.col(column), x["pick"])
        value = F.substring(F.col(text), x["start"] + 1, x["end"] - x["start"])
        wide = c.withField("start", x["start"]).withField("end", x["end"]).withField("value", value).withField("canonical", value).withField("status", F.lit("not_checked"))
        return F.when((c["start"] == x["start"]) & (c["end"] == x["end"]), c).otherwise(wide)

    return df.withColumn(column, F.when(F.col("_overlap"), F.transform("_pick", one)).otherwise(F.col(column))).drop("_overlap", "_pick")


def _overlapping(column: str) -> Column:
    """Candidates are sorted by start: if any two overlap, two neighbours do."""
    later = F.zip_with(F.col(column), F.slice(column, 2, F.greatest(F.size(column) - 1, F.lit(0))), lambda a, b: b["start"] < a["end"])
    return F.coalesce(F.exists(later, lambda x: F.coalesce(x, F.lit(False))), F.lit(False))


def with_resolved(df, column: str, p: Policy):
    """Replaces the candidates of ``column`` by the resolved ones, by start.

    Scores are positive, so candidates without overlap all stay: only texts with overlaps send numbers to Python.
    """
    df = df.withColumn(column, F.array_sort(F.filter(column, lambda c: allowed(c, p))))
    df = df.withColumn("_overlap", _overlapping(column))
    part = F.when(F.col("_overlap"), F.col(column))
    df = df.withColumn("_pick", _chosen(part["start"], part["end"], F.transform(part, lambda c: score(c).cast("double"))))
    picked = F.transform("_pick", lambda i: F.get(F.col(column), i))
    return df.withColumn(column, F.when(F.col("_overlap"), picked).otherwise(F.col(column))).drop("_overlap", "_pick")
