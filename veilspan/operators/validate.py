"""Checks of a finished redaction: what may have been left, and whether a person should look at it. Patterns and words are fixed values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .detect import PLATE

# Residual patterns, without checksums.
RESIDUAL = (
    ("IBAN", r"\bTR[0-9]{2}\s?[0-9]{4}\s?[0-9]{4}\s?[0-9]{4}\s?[0-9]{4}\s?[0-9]{4}\s?[0-9]{2}\b"),
    ("KREDI_KARTI", r"\b(?:[0-9]{4}[ -]?){3}[0-9]{4}\b"),
    ("TCKN", r"\b[1-9][0-9]{10}\b"),
    ("MERSIS", r"\b0[0-9]{15}\b"),
    ("VKN", r"\b[0-46-9][0-9]{9}\b"),
    ("TELEFON", r"(?:\+90|90|0)\s*5[0-9]{2}\s*[0-9]{3}\s*[0-9]{2}\s*[0-9]{2}"),
    ("TELEFON", r"\b5[0-9]{2}\s*[0-9]{3}\s*[0-9]{2}\s*[0-9]{2}\b"),
    ("TELEFON", r"(?:\+90|90|0|0090)\s*[234][0-9]{2}\s*[0-9]{3}\s*[0-9]{2}\s*[0-9]{2}"),
    ("TELEFON", r"\b0?5[0-9]{9}\b"),
    ("EPOSTA", r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"),
    ("PLAKA", PLATE),
)
REVIEW_WORDS = ("çocuk", "sağlık", "cinsel", "şiddet", "aile içi", "küçük yerleşim", "tekil olay", "mahkeme", "ceza")
PLACEHOLDER = r"⟦RDT:[^⟧]+⟧|\[[A-Z_]+_[0-9]+\]|\[[A-Z_]+\]|\*{3,}"


def residual(redacted: Column) -> Column:
    """Types of the residual patterns that still match, one entry a pattern, in order."""
    bare = F.regexp_replace(redacted, PLACEHOLDER, " ")
    return F.array_compact(F.array(*(F.when(bare.rlike(p), t) for t, p in RESIDUAL)))


def review_word(text: Column) -> Column:
    """The first word of the list that the text holds, else null."""
    low = F.lower(text)
    return F.coalesce(*(F.when(low.contains(w), w) for w in REVIEW_WORDS))


def validate(redacted: DataFrame, text: str = "text", words: bool = True) -> DataFrame:
    """Adds ``residual``, ``review_word``, ``status`` and ``needs_review``, raises ``risk`` and appends to ``warnings``."""
    out = redacted.withColumn("residual", residual(F.col("redacted")))
    out = out.withColumn("review_word", review_word(F.col(text)) if words else F.lit(None).cast("string"))
    leak, word = F.size("residual") > 0, F.col("review_word").isNotNull()
    asked = F.col("needs_review") if "needs_review" in redacted.columns else F.lit(False)
    risk = F.when(leak | (F.col("risk") == "high"), "high").when(word, "medium").otherwise(F.col("risk"))
    status = F.when(leak | asked, "review_required").otherwise("complete")
    if "warnings" in redacted.columns:
        one = lambda code, kind, severity: F.struct(F.lit(code).alias("code"), kind.alias("entity_type"), F.lit(severity).alias("severity"))
        left = F.transform("residual", lambda t: one("UNREDACTED_HIGH_RISK_CANDIDATE", t, "high"))
        context = F.when(word, F.array(one("SENSITIVE_CONTEXT_KEYWORD", F.lit(None).cast("string"), "medium"))).otherwise(F.slice(F.array(one("", F.lit(None).cast("string"), "")), 1, 0))
        out = out.withColumn("warnings", F.concat("warnings", left, context))
    return out.withColumn("risk", risk).withColumn("status", status).withColumn("needs_review", leak | word | asked)
