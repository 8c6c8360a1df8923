"""Repair of saved redactions: spans that today's rules call mistakes are put back; any doubt leaves a row as it is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalise, spans
from ..operators.detect import PLATE
from ..operators.false_positives import legal_fact, mistake
from .redaction import replaced

def _mistake(source: Column, c: Column, kind: Column, plates: Column, legal: bool) -> Column:
    wrong = mistake(source, c["start"], c["end"], kind, plates)
    if legal:
        wrong = wrong | legal_fact(source, c["start"], c["end"], kind)
    return F.coalesce(wrong, F.lit(False))


def repair(df: DataFrame, source: str = "source", preserve_legal_facts: bool = False) -> DataFrame:
    """Rows (hash, text, map, types, spans of start, end and token in code points, and the source) with mistakes restored.

    The hash must be the source's, spans lie in it, know their token and not overlap, and they must render to the
    saved text. Tokens no span uses any more leave the maps. Running it twice changes nothing more.
    """
    s = F.col(source)
    fits = F.forall("spans", lambda c: (c["start"] >= 0) & (c["end"] > c["start"]) & (c["end"] <= F.length(s)) & F.map_contains_key("map", c["token"]))
    clash = F.exists("spans", lambda c: F.exists("spans", lambda o: (o["start"] < c["end"]) & (o["end"] > c["start"]) & (o != c))) | (F.size(F.array_distinct("spans")) < F.size("spans"))
    whole = F.forall(F.map_values("map"), lambda v: v.isNotNull())
    out = df.withColumn("_order", F.array_sort("spans")).withColumn("_plain", normalise(s)).withColumn("_plates", spans("_plain", PLATE))
    sound = (F.sha2(s, 256) == F.col("hash")) & fits & ~clash & whole
    out = out.withColumn("_sound", F.coalesce(sound, F.lit(False)))
    render = lambda column: replaced(s, F.col(column), lambda c: c["token"])
    out = out.withColumn("_sound", F.when(F.col("_sound"), render("_order") == F.col("text")).otherwise(False))
    out = out.withColumn("_kept", F.when(F.col("_sound"), F.filter("_order", lambda c: ~_mistake(s, c, F.try_element_at("types", c["token"]), F.col("_plates"), preserve_legal_facts))))
    out = out.withColumn("_do", F.col("_sound") & (F.size("_kept") < F.size("spans")))
    used = F.transform("_kept", lambda c: c["token"])
    for name, new in (("text", render("_kept")), ("map", F.map_filter("map", lambda k, v: F.array_contains(used, k))), ("types", F.map_filter("types", lambda k, v: F.array_contains(used, k))), ("spans", F.col("_kept"))):
        out = out.withColumn(name, F.when(F.col("_do"), new).otherwise(F.col(name)))
    return out.drop("_order", "_plain", "_plates", "_sound", "_kept", "_do")
