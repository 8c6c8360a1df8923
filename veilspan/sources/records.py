"""Adapters: rows with an allow-list of columns, and log records of any nesting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import html_escape
from ..plans.redaction import Options, redact

CUT = "\n\u0000\n"
#: Columns that ``redact`` adds.
ADDED = ("redacted", "spans", "candidates", "n_redacted", "applied_rules", "risk", "n_warnings", "warnings")
#: Stands for what is nested too deeply.
TOO_DEEP = "[MAX_DEPTH]"


def _clean(df: DataFrame, column: str, options: Options) -> DataFrame:
    mine = ("_text", "_redacted")
    work = df.withColumn("_text", F.col(column))
    before = [c for c in df.columns if c in ADDED]
    for c in before:
        work = work.withColumnRenamed(c, f"_kept_{c}")
    out = redact(work, options, "_text").withColumn("_redacted", F.col("redacted")).drop(*ADDED)
    for c in before:
        out = out.withColumnRenamed(f"_kept_{c}", c)
    return out.withColumn(column, F.col("_redacted")).drop(*mine).select(*df.columns)


def redact_columns(df: DataFrame, allow: tuple[str, ...], options: Options = Options()) -> DataFrame:
    """Redacts the string columns of the list; all others, and listed columns of other types, are unchanged."""
    for c in allow:
        if isinstance(df.schema[c].dataType, T.StringType):
            df = _clean(df, c, options)
    return df


def with_redacted(df: DataFrame, fields: tuple[str, ...], allow: tuple[str, ...], options: Options = Options()) -> DataFrame:
    """Adds ``redacted_<field>``; null where the field is not on the list."""
    for f in fields:
        df = df.withColumn(f"redacted_{f}", F.col(f) if f in allow else F.lit(None).cast("string"))
    return redact_columns(df, tuple(f"redacted_{f}" for f in fields if f in allow), options)


def _strings(x: Column, t: T.DataType, depth: int) -> Column:
    """All strings within ``x``, in order."""
    none = F.array().cast("array<string>")
    if isinstance(t, T.StringType):
        return F.array(x)
    if depth >= 10:
        return none
    if isinstance(t, T.StructType):
        parts = [_strings(x.getField(f.name), f.dataType, depth + 1) for f in t.fields]
        return F.concat(*parts) if parts else none
    if isinstance(t, T.ArrayType):
        return F.coalesce(F.flatten(F.transform(x, lambda e: _strings(e, t.elementType, depth + 1))), none)
    if isinstance(t, T.MapType):
        return F.coalesce(F.flatten(F.transform(F.map_values(x), lambda e: _strings(e, t.valueType, depth + 1))), none)
    return none


def _rebuilt(x: Column, t: T.DataType, by: Column, depth: int) -> Column:
    if isinstance(t, T.StringType):
        return F.when(x.isNotNull(), F.coalesce(F.try_element_at(by, x), F.lit(TOO_DEEP)))
    if depth >= 10:
        return F.lit(None).cast(t)
    if isinstance(t, T.StructType):
        return F.when(x.isNotNull(), F.struct(*(_rebuilt(x.getField(f.name), f.dataType, by, depth + 1).alias(f.name) for f in t.fields)))
    if isinstance(t, T.ArrayType):
        return F.transform(x, lambda e: _rebuilt(e, t.elementType, by, depth + 1))
    if isinstance(t, T.MapType):
        return F.transform_values(x, lambda k, v: _rebuilt(v, t.valueType, by, depth + 1))
    return x


def redact_log(df: DataFrame, columns: tuple[str, ...] = ("message", "context", "extra"), options: Options = Options(policy="logs")) -> DataFrame:
    """Redacts every string in the columns, whatever their nesting; what is ten levels down is null or a placeholder.

    A row's distinct strings are joined by a mark no pattern crosses, redacted as one text and looked up again.
    """
    strings = F.array_distinct(F.array_compact(F.concat(*(_strings(F.col(c), df.schema[c].dataType, 0) for c in columns))))
    out = df.withColumn("_strings", strings).withColumn("_joined", F.array_join(F.transform("_strings", lambda s: F.replace(s, F.lit("\u0000"), F.lit(" "))), CUT))
    out = _clean(out, "_joined", options)
    by = F.map_from_arrays(F.col("_strings"), F.slice(F.split("_joined", CUT, -1), 1, F.size("_strings")))
    for c in columns:
        out = out.withColumn(c, _rebuilt(F.col(c), df.schema[c].dataType, by, 0))
    return out.drop("_strings", "_joined")


def escaped(df: DataFrame, column: str, options: Options = Options()) -> DataFrame:
    """The redacted column, safe to put into HTML."""
    return redact_columns(df, (column,), options).withColumn(column, html_escape(F.col(column)))
