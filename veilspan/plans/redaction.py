"""Redaction of a DataFrame of texts: detect, resolve, replace, report."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import masks
from ..functions.text import normalise, spans as matches
from ..operators.contextual import FIRST_NAMES, contextual
from ..operators.detect import CANDIDATE, EXCLUDED, PLATE, RULES, TYPES, Custom, Rule, candidates, not_excluded
from ..operators.false_positives import dropped, mistake
from ..operators.model_detector import Model, as_candidates, found, narrowed
from ..operators.positions import to_original
from ..operators.resolve import MODEL_RULE, policy, with_covered, with_resolved
from .lineage import cut


STRATEGIES = ("label", "asterisk", "partial", "tag")
# How a report names the types, one of them and several.
NAMES = {
    "TCKN": "TCKN", "VKN": "VKN", "MERSIS": "MERSİS", "IBAN": "IBAN", "TELEFON": "telefon", "EPOSTA": "e-posta", "KISI": "kişi adı", "ADRES": "adres", "PLAKA": "plaka",
    "KREDI_KARTI": "kredi kartı", "ESAS_NO": "esas no", "KARAR_NO": "karar no", "DOSYA_NO": "dosya no", "IP_ADRESI": "IP adresi", "DOGUM_TARIHI": "doğum tarihi",
    "KIMLIK_NO": ("pasaport/ehliyet/kimlik belge numarası", "kimlik belge numarası"), "HESAP_NO": ("banka/finans hesap numarası", "hesap numarası"),
    "MUSTERI_NO": ("müşteri/sicil/üyelik numarası", "müşteri/sicil numarası"), "KULLANICI_ADI": ("kişisel kullanıcı adı", "kullanıcı adı"), "SIFRE": "parola/erişim sırrı",
    "KONUM": ("kişiye ait hassas konum", "konum bilgisi"), "BANKA": ("kişiye ait banka adı", "banka bilgisi"), "SAGLIK": ("kişiye ait sağlık bilgisi", "sağlık bilgisi"),
    "BIYOMETRIK": ("kişiye ait biyometrik veri", "biyometrik veri"), "GENETIK": ("kişiye ait genetik veri", "genetik veri"), "KOKEN": ("kişiye ait ırk/etnik köken bilgisi", "köken bilgisi"),
    "INANC": ("kişiye ait din/mezhep/felsefi inanç", "inanç bilgisi"), "SIYASI_GORUS": ("kişiye ait siyasi düşünce", "siyasi görüş bilgisi"),
    "UYELIK": ("kişiye ait dernek/vakıf/sendika üyeliği", "üyelik bilgisi"), "CINSEL_HAYAT": ("kişiye ait cinsel hayat bilgisi", "cinsel hayat bilgisi"),
    "CEZA_BILGISI": ("kişiye ait ceza mahkumiyeti/güvenlik tedbiri", "ceza/güvenlik tedbiri bilgisi"), "KILIK_KIYAFET": ("kişiye ait kılık/kıyafet bilgisi", "kılık/kıyafet bilgisi"),
    "FINANSAL_BILGI": ("kişiye ait gelir/borç/finansal durum", "finansal bilgi"),
    "DIGER_KISISEL": ("diğer türlere girmeyen kişiyi tanımlayıcı veya kişiye atfedilen özel bilgi", "diğer kişisel bilgi"),
}
NOTHING = "Belgede TCKN, IBAN, telefon, e-posta, kişi adı vb. taranan kişisel veri türleri bulunamadı."
#: What a warning says: its code, the type it is about (null: the whole text) and its severity.
WARNING = "array<struct<code:string,entity_type:string,severity:string>>"
#: Spans up to which tokens are numbered by expressions; a text with more goes to Python.
FEW = 64


def warning(code: str, entity_type: Column | None, severity: str) -> Column:
    kind = F.lit(None).cast("string") if entity_type is None else entity_type
    return F.struct(F.lit(code).alias("code"), kind.alias("entity_type"), F.lit(severity).alias("severity"))


@dataclass(frozen=True)
class Options:
    """``first_names`` extends the dictionary of names; ``dictionary`` switches its scan off; ``model`` adds a language model's candidates.

    ``detectors`` are further ones of the user: each takes the normalised text and gives an array of CANDIDATE.
    ``rules`` and ``excluded`` replace the built-in rules and the patterns of what is no identifier. A text of more
    than ``max_bytes`` bytes is an error.
    """

    policy: str = "balanced"
    strategy: str = "label"  # label, asterisk, partial, tag
    only: tuple[str, ...] | None = None
    custom: tuple[Custom, ...] = ()
    names: bool = True
    dictionary: bool = True
    first_names: frozenset[str] = FIRST_NAMES
    preserve_legal_facts: bool = False
    model: Model | None = None
    detectors: tuple[Callable[[Column], Column], ...] = ()
    rules: tuple[Rule, ...] = RULES
    excluded: tuple[str, ...] = EXCLUDED
    max_bytes: int = (1 << 31) - 1

    def __post_init__(self):
        policy(self.policy)
        if self.strategy not in STRATEGIES:
            raise ValueError(f"unknown strategy: {self.strategy}")
        known = {*TYPES, *(c.entity_type for c in self.custom), *(self.model.types if self.model else ())}
        if self.only is not None and not self.detectors and (bad := set(self.only) - known):
            raise ValueError(f"unknown types: {sorted(bad)}")

    def wanted(self, kind: str) -> bool:
        return (self.only is None or kind in self.only) and (kind != "KISI" or self.names)

    @property
    def asked(self) -> Model | None:
        """The model, for the wanted types only."""
        own = narrowed(self.model, self.wanted) if self.model else None
        return own if own and own.types else None


def detect(df: DataFrame, options: Options = Options(), text: str = "text") -> DataFrame:
    """Adds ``candidates``: all that the detectors find. They scan the normalised text; positions and values are the original's.

    With a model there is also ``model_failed``; its answers are kept in a checkpoint, so no text is asked twice.
    """
    plain = normalise(F.col(text))
    if options.max_bytes < (1 << 31) - 1:
        plain = F.when(F.octet_length(text) > options.max_bytes, F.raise_error(F.lit(f"a text has more than {options.max_bytes} bytes")).cast("string")).otherwise(plain)
    out = df.withColumn("_plain", plain)
    if options.asked:
        out = cut(out.withColumn("_model", found(F.col("_plain"), options.asked)))
    rows = candidates("_plain", options.only, options.custom, options.rules)
    for detector in options.detectors:
        more = detector(F.col("_plain")).cast(CANDIDATE)
        rows = F.concat(rows, more if options.only is None else F.filter(more, lambda c: c["entity_type"].isin(*options.only)))
    kinds = tuple(k for k in ("KISI", "ADRES") if options.wanted(k))
    if kinds:
        out = out.withColumn("_context", contextual(F.col("_plain"), kinds, options.first_names, options.dictionary))
        rows = F.concat(rows, F.coalesce("_context", F.array().cast(CANDIDATE)))
    if options.asked:
        rows = F.concat(rows, as_candidates(F.col("_model.spans"), F.col("_plain")))
    out = to_original(out.withColumn("candidates", rows), text, "_plain", "candidates")
    kept = not_excluded(F.col("candidates"), text, options.excluded)
    if options.preserve_legal_facts:
        kept = F.filter(kept, lambda c: ~dropped(F.col(text), c))
    if options.asked:
        plates = matches("_plain", PLATE)
        kept = F.filter(kept, lambda c: (c["rule_id"] != MODEL_RULE) | ~mistake(F.col(text), c["start"], c["end"], c["entity_type"], plates))
        out = out.withColumn("model_failed", F.col("_model.failed"))
    return out.withColumn("candidates", kept).drop("_plain", "_context", "_model")


def resolve(df: DataFrame, options: Options = Options(), text: str = "text") -> DataFrame:
    """Adds ``spans``: disjoint candidates under the policy, by start."""
    out, p = detect(df, options, text), policy(options.policy)
    out = with_covered(out, "candidates", p, text) if options.asked else with_resolved(out, "candidates", p)
    return out.withColumnRenamed("candidates", "spans")


def replaced(text: Column, spans: Column, replacement) -> Column:
    """``text`` with each span replaced: gaps and replacements are folded from the left."""
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda s, c: F.struct(c["end"].alias("at"), F.concat(s["out"], F.substring(text, s["at"] + 1, c["start"] - s["at"]), replacement(c)).alias("out"))
    return F.aggregate(spans, zero, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))


@F.arrow_udf(T.StringType())
def _joined(texts: pa.Array, starts: pa.Array, ends: pa.Array, by: pa.Array) -> pa.Array:
    rows = []
    for t, a, b, r in zip(texts, starts, ends, by, strict=True):  # one text at a time
        if not t.is_valid:
            rows.append(None)
            continue
        whole, at, out = t.as_py(), 0, []
        for x, y, z in zip(a.as_py(), b.as_py(), r.as_py(), strict=True):
            out += [whole[at:x], z]
            at = y
        rows.append("".join([*out, whole[at:]]))
    return pa.array(rows, type=pa.string())


_spliced = _joined.asNondeterministic()


def with_replaced(df: DataFrame, text: str, by) -> DataFrame:
    """Adds ``redacted``: ``text`` with each of ``spans`` replaced; a text with more than FEW of them goes to Python, where that takes linear time."""
    many = F.when(F.size("spans") > FEW, F.col("spans"))
    df = df.withColumn("_spliced", _spliced(F.when(many.isNotNull(), F.col(text)), many["start"], many["end"], F.transform(many, by)))
    few = replaced(F.col(text), F.when(F.size("spans") <= FEW, F.col("spans")), by)
    return df.withColumn("redacted", F.coalesce("_spliced", few)).drop("_spliced")


def numbers(types: list[str], values: list[str], taken: list[str]) -> list[int]:
    """The number of each (type, value): distinct ones count by type in order, past the numbers of tokens in ``taken``."""
    held: dict[str, list[int]] = {}
    for t in taken:
        kind, _, n = t[1:-1].rpartition("_")
        held.setdefault(kind, []).append(int(n))
    seen: dict[tuple[str, str], int] = {}
    count: dict[str, int] = {}
    for kind, value in zip(types, values, strict=True):
        if (kind, value) not in seen:
            n = count.get(kind, 0) + 1
            while n in held.get(kind, ()):
                n += 1
            seen[kind, value] = count[kind] = n
    return [seen[x] for x in zip(types, values, strict=True)]


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _numbers(types: pa.Array, values: pa.Array, taken: pa.Array) -> pa.Array:
    rows = zip(types.to_pylist(), values.to_pylist(), taken.to_pylist(), strict=True)
    return pa.array([None if t is None else numbers(t, v, k) for t, v, k in rows], type=pa.list_(pa.int32()))


_many = _numbers.asNondeterministic()


def tagged(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``index`` to each span: distinct canonical values are numbered by type in order of appearance.

    Numbers whose token stands in the text already are left out, so unmasking cannot touch that text.
    """
    df = df.withColumn("_taken", F.array_distinct(F.regexp_extract_all(text, F.lit(r"\[[^\[\]]+_[1-9][0-9]{0,8}\]"), F.lit(0))))
    first = lambda c: F.filter("spans", lambda o: (o["entity_type"] == c["entity_type"]) & (o["start"] <= c["start"]))
    own = lambda c: F.filter("spans", lambda o: (o["entity_type"] == c["entity_type"]) & (o["canonical"] == c["canonical"]))[0]
    count = lambda c: F.size(F.array_distinct(F.transform(first(own(c)), lambda o: o["canonical"])))
    part = F.when((F.size("spans") > FEW) | ((F.size("spans") > 0) & (F.size("_taken") > 0)), F.col("spans"))
    df = df.withColumn("_numbers", _many(part["entity_type"], part["canonical"], F.when(part.isNotNull(), F.col("_taken"))))
    few = F.transform("spans", lambda c: c.withField("index", count(c)))
    many = F.zip_with("spans", "_numbers", lambda c, n: c.withField("index", n))
    return df.withColumn("spans", F.when(F.col("_numbers").isNull(), few).otherwise(many)).drop("_taken", "_numbers")


def redact(df: DataFrame, options: Options = Options(), text: str = "text") -> DataFrame:
    """Adds ``redacted``, ``spans``, ``n_redacted``, ``applied_rules`` (distinct, by first use), ``risk``, ``n_warnings`` (one per invalid span kept) and ``warnings``.

    With a model also ``model_failed`` and ``needs_review``: its suggestions raise the risk to medium, its failure to high.
    """
    return applied(resolve(df, options, text), options, text)


def applied(out: DataFrame, options: Options, text: str) -> DataFrame:
    """Replaces the ``spans`` of ``out`` and adds the columns that ``redact`` names."""
    if options.strategy == "tag":
        out = tagged(out, text)
        by = lambda c: masks.token(None, c["entity_type"], c["index"])
    else:
        by = {"label": lambda c: masks.label(c["entity_type"]), "asterisk": lambda c: masks.asterisk(c["value"]), "partial": lambda c: masks.partial(c["value"], c["entity_type"])}[options.strategy]
    invalid = F.filter("spans", lambda c: c["status"] == "invalid")
    risk = F.when(F.size(invalid) > 0, "medium").otherwise("low")
    said = F.transform(invalid, lambda c: warning("UNVALIDATED_FORMAT_CANDIDATE", c["entity_type"], "medium"))
    if options.asked and "model_failed" in out.columns:
        suggested = F.exists("spans", lambda c: c["rule_id"] == MODEL_RULE)
        risk = F.when(F.col("model_failed"), "high").when(suggested, "medium").otherwise(risk)
        said = F.concat(said, F.array_compact(F.array(F.when(suggested, warning("LLM_SUGGESTION_APPLIED", None, "medium")), F.when(F.col("model_failed"), warning("LLM_DETECTION_FAILED", None, "high")))))
        out = out.withColumn("needs_review", F.col("model_failed") | F.coalesce(suggested, F.lit(False)))
    return with_replaced(out, text, by).select(
        "*", F.size("spans").cast("long").alias("n_redacted"),
        F.array_distinct(F.transform("spans", lambda c: c["rule_id"])).alias("applied_rules"), risk.alias("risk"), F.size(invalid).cast("long").alias("n_warnings"), said.cast(WARNING).alias("warnings"),
    )


def token_map(redacted: DataFrame, key: str) -> DataFrame:
    """The sensitive table of a tag redaction: key, token, original (first spelling) and type."""
    rows = redacted.select(key, F.explode("spans").alias("_span"))
    token = masks.token(None, F.col("_span.entity_type"), F.col("_span.index"))
    return rows.groupBy(key, token.alias("token"), F.col("_span.entity_type").alias("entity_type")).agg(F.min_by("_span.value", "_span.start").alias("original"))


def unmask(redacted: DataFrame, tokens: DataFrame, key: str) -> DataFrame:
    """Puts originals back in one pass: the text is cut at brackets, and pieces that are tokens are looked up."""
    maps = tokens.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("token", "original"))).alias("map"))
    joined = redacted.join(maps, key, "left")
    pieces = F.split("redacted", r"(?<=\])|(?=\[)")
    return joined.withColumn("unmasked", F.array_join(F.transform(pieces, lambda p: F.coalesce(F.try_element_at("map", p), p)), "")).drop("map")


def counts_of(spans: Column) -> Column:
    """array<struct<entity_type, n>> of the spans, types in order of appearance."""
    types = F.array_distinct(F.transform(spans, lambda c: c["entity_type"]))
    return F.transform(types, lambda t: F.struct(t.alias("entity_type"), F.size(F.filter(spans, lambda c: c["entity_type"] == t)).cast("long").alias("n")))


def report_summary(spans: Column) -> Column:
    """A sentence that counts the spans by type, types in order of appearance."""
    one, more = (F.create_map(*(F.lit(x) for k, v in NAMES.items() for x in (k, v if isinstance(v, str) else v[i]))) for i in (0, 1))
    named = lambda c: F.when(c["n"] == 1, F.try_element_at(one, c["entity_type"])).otherwise(F.try_element_at(more, c["entity_type"]))
    parts = F.transform(counts_of(spans), lambda c: F.concat(c["n"].cast("string"), F.lit(" "), F.coalesce(named(c), c["entity_type"])))
    return F.when(F.size(spans) > 0, F.concat(F.array_join(parts, ", "), F.lit(" redakte edildi."))).otherwise(F.when(spans.isNotNull(), NOTHING))


def redact_names(df: DataFrame, text: str = "text", first_names: frozenset[str] = FIRST_NAMES, strategy: str = "label") -> DataFrame:
    """Names alone, by a simpler choice: from the left, names by context before those of the dictionary, longer before shorter; no policy or score."""
    options = Options(only=("KISI",), first_names=first_names, strategy=strategy, excluded=())
    order = lambda c: F.struct(c["start"], F.when(c["rule_id"] == "NAME_CONTEXTUAL", 0).otherwise(1).alias("later"), -F.length(c["value"]).alias("short"), c.alias("c"))
    out = detect(df, options, text).withColumn("candidates", F.transform(F.array_sort(F.transform("candidates", order)), lambda x: x["c"]))
    zero = F.struct(F.lit(0).alias("end"), F.array().cast(CANDIDATE).alias("kept"))
    step = lambda s, c: F.when(c["start"] >= s["end"], F.struct(c["end"].alias("end"), F.concat(s["kept"], F.array(c)).alias("kept"))).otherwise(s)
    chosen = F.aggregate("candidates", zero, step, lambda s: s["kept"])
    return applied(out.withColumn("spans", chosen).drop("candidates"), options, text)
