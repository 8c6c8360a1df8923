"""Rule detectors: each is one column expression giving an array of candidates.

Patterns, windows, confidences and priorities are fixed values that results depend on.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..functions import canonical as C
from ..functions import checksums as V
from ..functions.text import let, spans

END = r"\s*[:\-/]?\s*$"
CANDIDATE = "array<struct<start:int,end:int,value:string,entity_type:string,canonical:string,confidence:double,rule_id:string,status:string,labelled:boolean,priority:int,bonus:int>>"


@dataclass(frozen=True)
class Rule:
    """``confidence`` and ``priority`` are (labelled, not labelled); of checked rules they hold for invalid values."""

    entity_type: str
    rule_id: str
    patterns: tuple[str, ...]
    label: str
    window: int
    canonical: object
    confidence: tuple[float, float]
    priority: tuple[int, int]
    valid: object = None
    valid_confidence: float = 1.0
    keep: object = None
    sign: str = ""  # what every match holds: texts without it are not searched


OCTET = "(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)"
PHONE_LEAD = r"(?:(?:\+90|0090|90)\s*)?"
# Province, letters, digits; ordinary phrases of the same shape are no plates unless a plate word is next to them.
PROVINCE = "(?:0[1-9]|[1-7][0-9]|8[01])"
PLATE_BODY = PROVINCE + r"[\s-]*[A-Za-z]{1,3}[\s-]*[0-9]{2,4}"
PLATE_START, PLATE_END = r"(?<![\p{L}\p{N}_])(?<![0-9][./])", r"(?![\p{L}\p{N}_]|[./][0-9])"
PHRASE = PROVINCE + r"\s+(?:ve|ile|ila|and|or|to|tl|kg|gr|lt|cm|mm|ml|m|l|may|May)\s+[0-9]{2,4}" + PLATE_END
PHRASE_UPPER = PROVINCE + r"\s+(?i:ve|ile|ila|tl|kg|gr|lt|cm|mm|ml|m|l)\s+[0-9]{2,4}" + PLATE_END + r"(?=\s+(?iu:madde(?:leri|ler|si)?|arasında|kuruş|TL|kg|gr|lt|cm|mm|ml)(?!\p{L}))"
# A cheap look-ahead first: most positions fail it and never reach the look-behinds.
PLATE = (
    rf"(?=[0-8])(?:(?<=(?<![\p{{L}}\p{{N}}_])(?iu:plaka(?:sı)?|araç)\s{{0,5}}[:/=-]?\s{{0,5}}){PLATE_BODY}{PLATE_END}"
    rf"|{PLATE_START}{PLATE_BODY}{PLATE_END}(?=\s+(?iu:plakalı|plakası|plaka)(?!\p{{L}}))"
    rf"|{PLATE_START}(?!{PHRASE}|{PHRASE_UPPER}){PLATE_BODY}{PLATE_END})"
)
_H, _NO_H_BEFORE, _NO_H_AFTER = "[0-9a-fA-F]{1,4}", "(?<![a-fA-F0-9:])", "(?![a-fA-F0-9:])"
IPV6 = "(?=[0-9a-fA-F]{0,4}:)(?:" + "|".join(f"{_NO_H_BEFORE}{body}{_NO_H_AFTER}" for body in (f"(?:{_H}:){{7}}{_H}", f"(?:{_H}:){{1,7}}:", f"::(?:{_H}:){{0,6}}{_H}", f"(?:{_H}:){{1,6}}:{_H}")) + ")"
# The detectors in their fixed order.
RULES = (
    Rule("TCKN", "TCKN_CHECKSUM", (r"(?=[0-9])(?<![0-9])(?:[0-9]{11}|[0-9]{3}[\s.-][0-9]{3}[\s.-][0-9]{3}[\s.-][0-9]{2})(?![0-9])",), r"(?i)(?:TCKN|T\.?C\.?\s*Kimlik\s*No(?:su)?|Kimlik\s*No(?:su)?)" + END, 30, C.digits, (0.85, 0.55), (95, 95), V.tckn_valid),
    Rule("VKN", "VKN_10", (r"(?=[0-9])(?<![0-9])(?:[0-9]{10}|[0-9]{3}[\s.-][0-9]{3}[\s.-][0-9]{4})(?![0-9])",), r"(?i)(?:VKN|Vergi\s*(?:Kimlik)?\s*No(?:su)?)" + END, 35, C.digits, (0.8, 0.5), (88, 80), V.vkn_valid, 0.95),
    Rule("IBAN", "IBAN_MOD97", (r"(?i)(?=T)(?<![a-z0-9])TR[\s\u00a0-]*(?:[0-9][\s\u00a0-]*){24}(?![a-z0-9])",), r"(?i)(?:IBAN|Hesap\s*(?:No)?)" + END, 25, C.iban, (0.9, 0.6), (100, 100), V.iban_valid, 1.0, lambda v: F.length(C.iban(v)) == 26),
    Rule(
        "TELEFON", "TELEFON_PARSER",
        (rf"(?=[+(0-9])(?<![\w]){PHONE_LEAD}(?:0\s*)?(?:\(0?[2-5][0-9]{{2}}\)|[2-5][0-9]{{2}})[\s.\-]*[0-9]{{3}}[\s.\-]*[0-9]{{2}}[\s.\-]*[0-9]{{2}}(?![0-9])", rf"(?=[+0-9])(?<![0-9]){PHONE_LEAD}0?[2-5][0-9]{{9}}(?![0-9])"),
        "(?i)(?:Tel(?:efon)?|GSM|Cep|Mobil|İletişim|Faks|Fax)" + END, 30, C.phone, (0.98, 0.9), (89, 82), None, 1.0, lambda v: F.length(C.digits(v)).between(10, 14),
    ),
    Rule("EPOSTA", "EPOSTA_RFC", (r"(?<![a-zA-Z0-9._%+-])[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}(?![a-zA-Z0-9])",), "", 0, C.email, (0.6, 0.6), (70, 70), lambda v: ~v.rlike(r"^\.|\.\.|\.@|@[.-]|-\.|\.-"), sign="@"),
    Rule("KREDI_KARTI", "KREDI_KARTI_LUHN", (r"(?=[0-9])(?<![0-9])(?:[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{1,7}|[0-9]{13,19})(?![0-9])",), r"(?i)(?:Kredi\s*Kartı|Kart\s*No(?:su)?|Card\s*Number|PAN)" + END, 35, C.digits, (0.85, 0.45), (98, 98), V.luhn_valid),
    Rule("MERSIS", "MERSIS_16", (r"(?=0)(?<![0-9])0[0-9]{15}(?![0-9])",), r"(?i)(?:MERSİS|Mersis\s*(?:No(?:su)?)?)" + END, 30, C.digits, (0.95, 0.8), (92, 88)),
    Rule("ESAS_NO", "ESAS_NO", (r"(?i)(?=[0-9])(?:(?<=Esas\s{0,3}No\s{0,3}[:\-/]\s{0,3})[0-9]{4}\s*[/-]\s*[0-9]+\b|\b[0-9]{4}\s*[/-]\s*[0-9]+(?=\s*(?:E\.|Esas)\b))",), "", 0, C.compact, (0.9, 0.9), (75, 75)),
    Rule("KARAR_NO", "KARAR_NO", (r"(?i)(?=[0-9])(?:(?<=Karar\s{0,3}No\s{0,3}[:\-/]\s{0,3})[0-9]{4}\s*[/-]\s*[0-9]+\b|\b[0-9]{4}\s*[/-]\s*[0-9]+(?=\s*(?:K\.|Karar)\b))",), "", 0, C.compact, (0.9, 0.9), (74, 74)),
    Rule("DOSYA_NO", "DOSYA_NO", (r"(?i)(?=[0-9])(?:(?<=Dosya\s{0,3}No\s{0,3}[:\-/]\s{0,3})(?:[0-9]{4}\s*[/-]\s*[0-9]+|[0-9]{5,12})\b)",), "", 0, C.compact, (0.9, 0.9), (73, 73)),
    Rule("IP_ADRESI", "IP_V4", (rf"(?=[0-9])(?<![0-9.])(?:{OCTET}\.){{3}}{OCTET}(?![0-9.])",), "", 0, lambda v: v, (0.6, 0.6), (68, 68), lambda v: ~v.rlike(r"(^|\.)0[0-9]"), 0.95),
    Rule("PLAKA", "PLAKA_CLASSIC", (PLATE,), r"(?iu)(?:Plaka(?:sı)?|Araç)\s*[:\-/]?\s*$", 25, C.plate_spaced, (0.95, 0.85), (60, 60)),
    Rule("IP_ADRESI", "IP_V6", (IPV6,), "", 0, F.lower, (0.95, 0.95), (69, 69), lambda v: F.lit(True), 0.95, sign=":"),
)
#: Types whose label is part of the pattern itself.
LABEL_IS_PATTERN = ("ESAS_NO", "KARAR_NO", "DOSYA_NO")


def candidates_of(text: str, rule: Rule) -> Column:
    found = F.concat(*(spans(text, p) for p in rule.patterns))
    if rule.sign:
        found = F.when(F.col(text).contains(rule.sign), found)  # null becomes an empty array below

    def one(m: Column) -> Column:
        value = F.rtrim(m["value"], F.lit(".,;:!?")) if rule.entity_type == "EPOSTA" else m["value"]
        before = F.right(m["before"], F.lit(rule.window))  # no label reaches into the match before, which ends in a digit
        labelled = F.lit(rule.entity_type in LABEL_IS_PATTERN) if not rule.label else before.rlike(rule.label)
        confidence, priority = F.when(labelled, rule.confidence[0]).otherwise(rule.confidence[1]), F.when(labelled, rule.priority[0]).otherwise(rule.priority[1])
        status = F.lit("not_checked")
        if rule.valid is not None:
            ok = rule.valid(rule.canonical(value))
            status = F.when(ok, "valid").otherwise("invalid")
            confidence = F.when(ok, rule.valid_confidence).otherwise(confidence)
            if rule.entity_type == "VKN":
                priority = F.when(labelled | ok, 88).when(value.startswith("5"), 70).otherwise(80)
        if rule.entity_type == "PLAKA":
            confidence = F.when(labelled, 0.95).when(value.rlike("[ -]"), 0.85).otherwise(0.7)
        if rule.entity_type == "TELEFON":
            confidence = confidence - F.when(value.rlike(r"(?:\+90|0090)\s*0[2-5]"), 0.15).otherwise(0.0)
            priority = F.when(labelled, 89).when(value.contains("(") | value.contains("+90"), 86).otherwise(82)
        return F.struct(
            m["start"].alias("start"), (m["start"] + F.length(value)).alias("end"), value.alias("value"), F.lit(rule.entity_type).alias("entity_type"), rule.canonical(value).alias("canonical"),
            confidence.cast("double").alias("confidence"), F.lit(rule.rule_id).alias("rule_id"), status.alias("status"), labelled.alias("labelled"), priority.cast("int").alias("priority"), F.lit(0).alias("bonus"),
        )

    if rule.keep is not None:
        found = F.filter(found, lambda m: rule.keep(m["value"]))
    return F.coalesce(F.transform(found, one).cast(CANDIDATE), F.array().cast(CANDIDATE)) if rule.sign else F.transform(found, one).cast(CANDIDATE)


@functools.lru_cache(maxsize=512)
def _known(session: str, text: str, rule: Rule) -> Column:
    """A rule's expression, built once a session: it names its column only."""
    return candidates_of(text, rule)


@dataclass(frozen=True)
class Custom:
    """A pattern of the user (Java syntax); an unknown validator's name makes every match valid."""

    rule_id: str
    entity_type: str
    regex: str
    validator: str | None = None
    priority: int = 50

    def rule(self) -> Rule:
        valid = None if self.validator is None else V.VALIDATORS.get(self.validator.split("_")[0], lambda v: F.lit(True))
        unchecked = 0.85 if valid is None else 0.6
        return Rule(self.entity_type, self.rule_id, (self.regex,), "", 0, lambda v: v, (unchecked, unchecked), (self.priority, self.priority), valid)


# References to statutes are no identifiers.
EXCLUDED = (r"\bm\.\s*[0-9]+", r"\bmadde\s+[0-9]+", r"[0-9]+\s*/\s*[0-9]+\s*(?:md\.?|gm\.?|em\.?)")
#: Types that pattern rules find; names and addresses are found by ``contextual``.
TYPES = tuple(dict.fromkeys(r.entity_type for r in RULES)) + ("KISI", "ADRES")


def candidates(text: str, only: tuple[str, ...] | None = None, custom: tuple[Custom, ...] = (), built_in: tuple[Rule, ...] = RULES) -> Column:
    """Candidates of the pattern rules of the wanted types; unwanted detectors are not built."""
    rules = [r for r in (*built_in, *(c.rule() for c in custom)) if only is None or r.entity_type in only]
    session = SparkSession.active().sparkContext.applicationId
    found = [_known(session, text, r) if r in RULES else candidates_of(text, r) for r in rules]
    return F.array_distinct(F.concat(*found)) if found else F.array().cast(CANDIDATE)


def overlaps(start: Column, end: Column, ranges: Column) -> Column:
    """Whether a span meets one of the ranges (structs of start and end, ends exclusive)."""
    return F.exists(ranges, lambda x: (start < x["end"]) & (end > x["start"]))


def not_excluded(found: Column, text: str, patterns: tuple[str, ...] = EXCLUDED) -> Column:
    """Without candidates that meet an excluded stretch of ``text``, whose positions they use."""
    if not patterns:
        return found
    excluded = F.concat(*(spans(text, f"(?i){p}") for p in patterns))
    free = let(excluded, lambda ranges: F.filter(found, lambda c: ~overlaps(c["start"], c["end"], ranges)))
    return F.when(F.size(found) > 0, free).otherwise(found)
