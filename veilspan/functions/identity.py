"""Statements about which model wrote a text, replaced by a neutral mark. Patterns are fixed values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK = "[ASİSTAN]"
VENDORS = r"Qwen|Tongyi|Alibaba|OpenAI|GPT-?[0-9o.]*|ChatGPT|Llama|Meta\s+AI|Gemini|Google\s+DeepMind|DeepMind|Mistral|DeepSeek|Anthropic|Claude|Cohere|Yi|Ernie|Baidu"
_REST = r"[^.\n!?]*"
PATTERNS = (
    rf"\b(?:I\s*am|I[’']m|Ben)\b[^.\n!?]{{0,40}}?(?:{VENDORS}|large\s+language\s+model|büyük\s+dil\s+model\w*|yapay\s+zek\w*\s+model\w*|language\s+model|dil\s+model\w*)\b{_REST}",
    rf"\b(?:independently\s+)?(?:developed|trained|created|built|made|trained\s+up)\s+by\b[^.\n!?]{{0,60}}?(?:{VENDORS})\b{_REST}",
    rf"(?:{VENDORS})\b[^.\n!?]{{0,40}}?\btaraf\w*\s+(?:geliştiril\w*|eğitil\w*|oluşturul\w*|üretil\w*)\b{_REST}",
    r"\bTongyi(?:\s+Lab(?:oratory)?|\s+Qianwen)?\b",
    rf"\bAlibaba\s+(?:Group|Cloud|DAMO)\b{_REST}",
    rf"\b(?:{VENDORS})\b[^.\n!?]{{0,20}}?\b(?:model|serisi|series|family|ailesi)\b",
    rf"\b(?:knowledge\s+)?cut[\s\-]?off(?:\s+date)?\b{_REST}",
    rf"\bbilgi\s+kesim\w*\b{_REST}",
    rf"\b(?:training|eğitim)\s+(?:data|veri\w*)\b[^.\n!?]{{0,40}}?(?:cut|kes|tarih|date|until|kadar)\b{_REST}",
)
SUSPECT = rf"(?iuU)(?:{VENDORS}|language\s+model|dil\s+model|yapay\s+zek|cut[\s\-]?off|bilgi\s+kesim|developed\s+by|trained\s+by|taraf\w*\s+(?:geliş|eğit))"


def scrub_identity(df: DataFrame, text: str = "text", count: str = "n_replaced") -> DataFrame:
    """Replaces the statements in ``text`` and adds how many there were; each step counts on the text the one before it left."""
    out = df.withColumn("_suspect", F.coalesce(F.col(text).rlike(SUSPECT), F.lit(False))).withColumn(count, F.lit(0).cast("long"))
    for p in PATTERNS:
        hits = F.when(F.col("_suspect"), F.regexp_count(text, F.lit(f"(?iuU){p}"))).otherwise(0)
        out = out.withColumn(count, F.col(count) + hits.cast("long")).withColumn(text, F.when(F.col("_suspect"), F.regexp_replace(text, f"(?iuU){p}", MARK)).otherwise(F.col(text)))
    merged: Column = F.regexp_replace(F.regexp_replace(text, r"(?:\[ASİSTAN\]\s*){2,}", f"{MARK} "), "[ \t]{2,}", " ")
    return out.withColumn(text, F.when(F.col(count) > 0, merged).otherwise(F.col(text))).drop("_suspect")
