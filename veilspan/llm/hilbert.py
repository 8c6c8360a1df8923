"""Sharding in Hilbert-curve order.

Each metadata dimension is quantised by weighted quantiles: a value's cell is its place among all rows in
value order, so hot values do not squeeze the others into a few cells. Rows are sorted by the index of their
cell on the Hilbert curve, then text hash, size and id, and the order is cut into runs: consecutive rows are
near in every dimension at once, so files written from the runs can be skipped by filters on any of them.
Runs hold equal row counts (law ``rows``: counts differ by one at most).

No step sorts or counts in one task: order and quantiles come from range partitions and their sums, and
equal keys are spread by text hash and id. Edge cases: nulls come first in a dimension; a null text has size
1 and the hash of the empty text; repeated rows get different slots; an empty table gives an empty result.
Only the columns named are read, so further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import own_name, ranked, table

BITS = 4
SHARDS = 8
DIMENSIONS = ("source", "lang", "size")


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Curve index of the cells [n, dimensions], each below 2**bits (Skilling's transposition)."""
    x = [cells[:, i].astype(np.int64) for i in range(cells.shape[1])]
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            t = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ t)
            x[i] = x[i] ^ t if i else x[0]
        q >>= 1
    for i in range(1, n):
        x[i] = x[i] ^ x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | (((x[i] ^ t) >> b) & 1)
    return out


def quantised(rows: DataFrame, column: str, levels: int) -> DataFrame:
    """The distinct values of ``column`` and their cells: floor(levels * rows before the value / all rows)."""
    counts = rows.groupBy(column).agg(F.count("*").alias("n"))
    placed, _, total = ranked(counts, [F.col(column).asc_nulls_first()], "n", f"cells-{column}")
    return placed.select(F.col(column).alias(f"value_{column}"), F.floor(F.col("before") * levels / F.lit(max(total, 1))).cast("int").alias(f"cell_{column}"))


def curve_order(rows: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS, bits: int = BITS) -> DataFrame:
    """Adds ``curve``, the Hilbert index of each row."""
    for d in dimensions:
        cells = quantised(rows, d, 1 << bits)
        rows = rows.join(cells, rows[d].eqNullSafe(cells[f"value_{d}"])).drop(f"value_{d}")

    @F.pandas_udf("long")
    def curve(*cells: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index(np.stack([c.to_numpy() for c in cells], 1), bits))

    return rows.withColumn("curve", curve(*(F.col(f"cell_{d}") for d in dimensions)))


def hilbert_shards(docs: DataFrame, shards: int = SHARDS, dimensions: tuple[str, ...] = DIMENSIONS, bits: int = BITS, whole: str | None = None) -> DataFrame:
    """doc_id, the dimensions, size, text_crc32, curve, shard and slot of every row; ``whole`` names a struct of all its columns."""
    text = F.coalesce(F.col("text"), F.lit(""))
    row = [F.struct(*docs.columns).alias(whole)] if whole else []
    rows = docs.select("doc_id", "source", "lang", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), *row)
    order: list[Column] = [F.col("curve").asc(), F.col("text_crc32").asc(), F.col("size").asc(), F.col("doc_id").asc_nulls_first()]
    placed, n, _ = ranked(curve_order(rows, dimensions, bits), order, None, "curve")
    shard = F.floor(F.col("rank") * shards / F.lit(max(n, 1))).cast("int")
    start = F.ceil(F.col("shard") * F.lit(n) / shards)  # the first rank of a shard
    return placed.withColumn("shard", shard).withColumn("slot", (F.col("rank") - start).cast("long"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Writes whole documents, every row once, a directory a shard, rows of a file in curve order.

    The directories are named ``shard``, or ``shard_`` where a column has that name.
    """
    row, name = own_name("row"), "shard_" if "shard" in docs.columns else "shard"
    placed = hilbert_shards(docs, shards, whole=row).select(F.col("shard").alias(name), F.col("slot").alias(f"{row}_slot"), row)
    ordered = placed.repartitionByRange(name, f"{row}_slot").sortWithinPartitions(name, f"{row}_slot")
    ordered.select(f"{row}.*", name).write.partitionBy(name).parquet(path)


def op1_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = hilbert_shards(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def op1_sql(bits: int = BITS, shards: int = SHARDS) -> str:
    """The same rows in DuckDB: window sums, the curve unrolled into one CTE a step, crc32 folded byte by byte."""
    dims = DIMENSIONS
    names = [f"x{i}" for i in range(len(dims))]
    steps: list[str] = []

    def step(new: dict[str, str]) -> None:
        steps.append(f"s{len(steps) + 1} as (select * replace ({', '.join(f'{v} as {k}' for k, v in new.items())}) from s{len(steps)})")

    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        step({"x0": f"case when x0 & {q} != 0 then xor(x0, {p}) else x0 end"})
        for x in names[1:]:
            step({"x0": f"case when {x} & {q} != 0 then xor(x0, {p}) else xor(x0, xor(x0, {x}) & {p}) end", x: f"case when {x} & {q} != 0 then {x} else xor({x}, xor(x0, {x}) & {p}) end"})
        q >>= 1
    for a, b in zip(names[1:], names, strict=False):
        step({a: f"xor({a}, {b})"})
    q = 1 << (bits - 1)
    while q > 1:
        step({"t": f"case when {names[-1]} & {q} != 0 then xor(t, {q - 1}) else t end"})
        q >>= 1
    n = len(names)
    curve = " + ".join(f"(((xor({x}, t) >> {b}) & 1) << {b * n + n - 1 - i})" for b in range(bits) for i, x in enumerate(names))
    cells = ", ".join(f"d{i} as (select v, floor((sum(n) over (order by v nulls first) - n) * {1 << bits} / (select count(*) from rows_))::bigint as x{i} from (select {d} as v, count(*) as n from rows_ group by 1))" for i, d in enumerate(dims))
    joins = " ".join(f"join d{i} on rows_.{d} is not distinct from d{i}.v" for i, d in enumerate(dims))
    return f"""
with tab as (
  select list(list_reduce(range(8), lambda a, b: case when a & 1 = 1 then xor(a >> 1, 3988292384::bigint) else a >> 1 end, i::bigint) order by i) as t from range(256) r(i)
), rows_ as (
  select doc_id, source, lang, octet_length(encode(coalesce(text, ''))) + 1 as size,
    xor(list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::bigint),
      lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295::bigint), 4294967295) as text_crc32
  from documents, tab
), {cells}, s0 as (select rows_.*, {", ".join(names)}, 0::bigint as t from rows_ {joins}), {", ".join(steps)}, placed as (
  select *, {curve} as curve from s{len(steps)}
), numbered as (
  select *, row_number() over (order by curve, text_crc32, size, doc_id nulls first) - 1 as rank, count(*) over () as n from placed
), cut as (select *, floor(rank * {shards} / n)::int as shard from numbered)
select doc_id, size::bigint as size, text_crc32, 'rows' as law, shard, (rank - ceil(shard * n / {shards}))::bigint as slot, null::int as grown_shard, curve::bigint as curve from cut
"""
