"""Queries over texts made from order keys, one operator or a few each, and SQL that says what must come out.

The texts are built by SQL that both engines read; results are computed apart, from the parts the texts were built of.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import canonical, masks
from .functions.text import normalise, spans
from .operators.detect import Custom, candidates, overlaps
from .operators.model_detector import Model
from .operators.resolve import POLICIES, _chosen, _covered, score
from .operators.validate import REVIEW_WORDS, review_word, validate
from .plans import config
from .plans.redaction import Options, counts_of, redact, redact_names, report_summary, resolve
from .plans.repair import repair
from .plans.sessions import map_from_json, map_to_json, merged, parse_token, unmask_sessions
from .sources import safe, spread
from .sources.records import redact_log, with_redacted

K = "cast(o_orderkey as string)"
Steps = list[tuple[str, str]]


def made(spark: SparkSession, sf_dir: str, steps: Steps) -> DataFrame:
    df = spread(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey"))
    for name, sql in steps:
        df = df.selectExpr("*", f"{sql} as {name}")
    return df


def made_sql(steps: Steps) -> str:
    out = "select o_orderkey from orders"
    for name, sql in steps:
        out = f"select *, {sql} as {name} from ({out})"
    return f"({out})"


def pick(by: str, *values: str) -> str:
    """The value of the remainder of ``by``."""
    return f"case {by} % {len(values)} " + " ".join(f"when {i} then {v}" for i, v in enumerate(values)) + " end"


def digit(x: str, i: int) -> str:
    return f"cast(substr({x}, {i}, 1) as int)"


NINE: Steps = [("b", "cast(o_orderkey * 7919 % 900000000 + 100000000 as string)")]
_ODD, _EVEN = " + ".join(digit("b", i) for i in (1, 3, 5, 7, 9)), " + ".join(digit("b", i) for i in (2, 4, 6, 8))
#: Numbers whose check digits hold unless ``wrong``.
TCKN: Steps = [
    *NINE, ("wrong", "o_orderkey % 3 = 0"), ("c10", f"(({_ODD}) * 7 - ({_EVEN}) + 70) % 10"), ("c11", f"({_ODD} + {_EVEN} + c10) % 10"),
    ("number", "b || cast(c10 as string) || cast(case when wrong then (c11 + 1) % 10 else c11 end as string)"),
]
_V = " + ".join(f"case when ({digit('b', i)} + {10 - i}) % 10 = 9 then 9 else (({digit('b', i)} + {10 - i}) % 10 * {1 << (10 - i)}) % 9 end" for i in range(1, 10))
VKN: Steps = [*NINE, ("wrong", "o_orderkey % 3 = 0"), ("c", f"(10 - ({_V}) % 10) % 10"), ("number", "b || cast(case when wrong then (c + 1) % 10 else c end as string)")]
IBAN: Steps = [
    *NINE, ("wrong", "o_orderkey % 3 = 0"), ("account", "rpad(b, 22, '7')"), ("c", "98 - cast(cast(account || '292700' as decimal(38, 0)) % 97 as int)"),
    ("number", "'TR' || lpad(cast(case when wrong then (c + 1) % 100 else c end as string), 2, '0') || account"),
]


def detected(kind: str, steps: Steps):
    """(query, SQL): candidates of a kind in lead || value || tail; the steps name what is expected, and whether it is found."""
    steps = [*steps, ("text", "lead || value || tail")]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = made(spark, sf_dir, steps).select("o_orderkey", F.explode(candidates("text", (kind,))).alias("c"))
        return rows.select("o_orderkey", F.col("c.start").cast("long").alias("start"), "c.value", "c.canonical", "c.status", "c.labelled", F.round("c.confidence", 4).alias("confidence"), F.col("c.priority").cast("long").alias("priority"))

    return run, f"select o_orderkey, length(lead) as start, value, canonical, status, labelled, cast(confidence as double) as confidence, cast(priority as bigint) as priority from {made_sql(steps)} where found"


_STATUS = ("status", "case when wrong then 'invalid' else 'valid' end")
_SPACED_IBAN = "substr(number, 1, 4)" + "".join(f" || ' ' || substr(number, {i}, 4)" for i in range(5, 27, 4))
detect_tckn, TCKN_SQL = detected("TCKN", [
    *TCKN, ("lead", pick("o_orderkey", "'TCKN: '", "'no '", "'T.C. Kimlik No: '", "'no 1'")), ("value", "case when o_orderkey % 4 = 2 then substr(number, 1, 3) || ' ' || substr(number, 4, 3) || ' ' || substr(number, 7, 3) || ' ' || substr(number, 10, 2) else number end"),
    ("tail", "' son'"), ("found", "o_orderkey % 4 <> 3"), ("canonical", "number"), _STATUS, ("labelled", "o_orderkey % 2 = 0"), ("confidence", "case when not wrong then 1.0 when labelled then 0.85 else 0.55 end"), ("priority", "95"),
])
detect_vkn, VKN_SQL = detected("VKN", [
    *VKN, ("lead", pick("o_orderkey", "'Vergi No: '", "'sicil '", "'VKN '", "'x '")), ("value", pick("o_orderkey", "number", "number", "number", "substr(number, 1, 3) || '-' || substr(number, 4, 3) || '-' || substr(number, 7, 4)")), ("tail", "'.'"), ("found", "true"),
    ("canonical", "number"), _STATUS, ("labelled", "o_orderkey % 2 = 0"), ("confidence", "case when not wrong then 0.95 when labelled then 0.8 else 0.5 end"), ("priority", "case when labelled or not wrong then 88 when substr(number, 1, 1) = '5' then 70 else 80 end"),
])
detect_iban, IBAN_SQL = detected("IBAN", [
    *IBAN, ("lead", pick("o_orderkey", "'IBAN: '", "'hesaba '", "'Hesap No: '", "'A'")), ("value", f"case when o_orderkey % 4 = 1 then {_SPACED_IBAN} when o_orderkey % 4 = 2 then lower(number) else number end"), ("tail", "', son'"), ("found", "o_orderkey % 4 <> 3"),
    ("canonical", "number"), _STATUS, ("labelled", "o_orderkey % 2 = 0"), ("confidence", "case when not wrong then 1.0 when labelled then 0.9 else 0.6 end"), ("priority", "100"),
])
detect_mersis, MERSIS_SQL = detected("MERSIS", [
    *NINE, ("lead", pick("o_orderkey", "'Mersis No: '", "'sicil '", "'sicil 1'", "'MERSİS '")), ("value", "'0' || b || '123456'"), ("tail", "''"), ("found", "o_orderkey % 4 <> 2"), ("canonical", "value"), ("status", "'not_checked'"),
    ("labelled", "o_orderkey % 4 in (0, 3)"), ("confidence", "case when labelled then 0.95 else 0.8 end"), ("priority", "case when labelled then 92 else 88 end"),
])
detect_phones, PHONE_SQL = detected("TELEFON", [
    *NINE, ("n", "'5' || substr(b, 1, 9)"), ("spaced", "substr(n, 1, 3) || ' ' || substr(n, 4, 3) || ' ' || substr(n, 7, 2) || ' ' || substr(n, 9, 2)"), ("lead", pick("o_orderkey", "'Tel: '", "'ara '", "'Cep '", "'ara '", "'no 9'")),
    ("value", pick("o_orderkey", "'0' || spaced", "'+90 ' || spaced", "spaced", "'(' || substr(n, 1, 3) || ') ' || substr(spaced, 5, 9)", "n")), ("tail", "' .'"), ("found", "o_orderkey % 5 <> 4"), ("canonical", "'+90' || n"), ("status", "'not_checked'"), ("labelled", "o_orderkey % 5 in (0, 2)"),
    ("confidence", "case when labelled then 0.98 else 0.9 end"), ("priority", "case when labelled then 89 else 86 end"),
])


def redacted(steps: Steps, expected: str, options=None, count: str = "1"):
    """(query, SQL): ``text`` of the steps redacted, against ``expected``."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return redact(made(spark, sf_dir, steps), options() if options else Options()).select("o_orderkey", "redacted", "n_redacted")

    return run, f"select o_orderkey, {expected} as redacted, cast({count} as bigint) as n_redacted from {made_sql(steps)}"


legal_numbers, LEGAL_SQL = redacted(
    [("y", "cast(1990 + o_orderkey % 30 as string)"), ("number", f"y || '/' || {K}"), ("text", pick("o_orderkey", "'Esas No: ' || number || ' dosyası'", "'Mahkemenin ' || number || ' Karar sayılı'", f"'Dosya No: 12345' || {K} || '.'", "'Sayfa ' || number || ' arası'"))],
    pick("o_orderkey", "'Esas No: [ESAS_NO] dosyası'", "'Mahkemenin [KARAR_NO] Karar sayılı'", f"case when length({K}) <= 7 then 'Dosya No: [DOSYA_NO].' else text end", "text"), count=f"case when o_orderkey % 4 = 3 or (o_orderkey % 4 = 2 and length({K}) > 7) then 0 else 1 end",
)
excluded_ranges, EXCLUDED_SQL = redacted(
    [*TCKN, ("lead", pick("o_orderkey", "'bkz. m. '", "'no '", "'Madde '", "'dd. '")), ("text", "lead || number")],
    "case when not wrong and lead in ('no ', 'dd. ') then lead || '[TCKN]' else text end", lambda: Options(only=("TCKN",)), "case when not wrong and lead in ('no ', 'dd. ') then 1 else 0 end",
)
_FIRST, _LAST = pick("o_orderkey", "'Ali'", "'Xqzt'", "'Ebru'", "'Ankara'", "'Yıldız'"), pick("o_orderkey", "'Kaya'", "'Demir'", "'Üniversitesi'")
dictionary_names, NAMES_SQL = redacted(
    [("first_name", _FIRST), ("last_name", _LAST), ("hit", "first_name not in ('Xqzt', 'Ankara') and last_name <> 'Üniversitesi'"), ("text", f"'toplantıya ' || first_name || ' ' || last_name || ' katıldı, ' || {K}")],
    f"case when hit then 'toplantıya [KISI] katıldı, ' || {K} else text end", lambda: Options(only=("KISI",)), "case when hit then 1 else 0 end",
)
address_parts, ADDRESS_SQL = redacted(
    [("street", pick("o_orderkey", "'Lale Caddesi'", "'Gül Sokağı'", "'Meydan'")), ("text", f"'(Çiçek Mahallesi ' || street || ' No: ' || {K} || ')'")],
    "case when street <> 'Meydan' then '([ADRES])' else text end", lambda: Options(only=("ADRES",)), "case when street <> 'Meydan' then 1 else 0 end",
)
name_mistakes, MISTAKES_SQL = redacted(
    [("text", pick("o_orderkey", "'metni sağlam Hale Getir'", "'metni mavi Hale Getir'", "'Sayın Türk Ceza Kanunu'", "'Sayın Kemal Öz'"))],
    pick("o_orderkey", "text", "'metni mavi [KISI]'", "text", "'Sayın [KISI]'"), lambda: Options(only=("KISI",)), "case when o_orderkey % 2 = 1 then 1 else 0 end",
)
custom_patterns, CUSTOM_SQL = redacted(
    [*TCKN, ("text", "'kayıt S-' || number || ' ve ' || b")], "'kayıt S-' || case when wrong then number else '[OZEL]' end || ' ve [DOKUZ]'",
    lambda: Options(only=("OZEL", "DOKUZ"), custom=(Custom("OWN", "OZEL", r"(?<=S-)[0-9]{11}", "tckn_checksum"), Custom("NINE", "DOKUZ", r"\b[0-9]{9}\b"))), "case when wrong then 1 else 2 end",
)


def _badge(text: Column) -> Column:
    """A detector of the user: badges, found in the column that detection normalises."""
    found = spans("_plain", r"\bB-[0-9]+\b")
    return F.transform(found, lambda m: F.struct(
        m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value"), F.lit("ROZET").alias("entity_type"), m["value"].alias("canonical"), F.lit(0.9).alias("confidence"),
        F.lit("BADGE").alias("rule_id"), F.lit("not_checked").alias("status"), F.lit(False).alias("labelled"), F.lit(50).alias("priority"), F.lit(0).alias("bonus"),
    ))


custom_detectors, DETECTOR_SQL = redacted(
    [("text", f"'rozet B-' || {K} || ' BB-' || {K}")], f"'rozet [ROZET] BB-' || {K}", lambda: Options(only=("ROZET",), detectors=(_badge,)),
)


def _settings() -> Options:
    own = config.merged(config.DEFAULTS, {"policy": "strict", "patterns": [{"id": "ORDER", "entity_type": "SIPARIS", "regex": r"\bORD[0-9]+\b"}], "exclude_patterns": [r"\bNR\s*ORD[0-9]+"], "name_redaction": {"custom_names": ["Zartuk"]}})
    return config.options(own, strategy="label", only=("SIPARIS", "KISI"))


configured, CONFIG_SQL = redacted(
    [("text", f"case when o_orderkey % 2 = 0 then 'NR ' else 'no ' end || 'ORD' || {K} || ', Zartuk Demir'")], f"case when o_orderkey % 2 = 0 then 'NR ORD' || {K} else 'no [SIPARIS]' end || ', [KISI]'", _settings, "case when o_orderkey % 2 = 0 then 1 else 2 end",
)


def _plates(request: dict) -> dict:
    found = [p for p in ("24 ve 25", "34 ABC 123") if p in request["text"]]
    return {"entities": [{"type": "PLAKA", "text": p, "occurrence": 1} for p in found]}


plate_mistakes, PLATE_SQL = redacted(
    [("text", f"case when o_orderkey % 2 = 0 then '24 ve 25 maddeleri ' else '34 ABC 123 geldi ' end || {K}")], f"case when o_orderkey % 2 = 0 then text else '[PLAKA] geldi ' || {K} end",
    lambda: Options(only=("PLAKA",), model=Model(_plates, ("PLAKA",))), "o_orderkey % 2",
)


def _parts(request: dict) -> dict:
    found = [p for p in ("tel 0532 123", "0532 123 45 67", "hasta") if p in request["text"]]
    return {"entities": [{"type": "SAGLIK", "text": p, "occurrence": 1} for p in found[: 1 if "Cep" in request["text"] else 3]]}


model_cover, COVER_SQL = redacted(
    [("text", pick("o_orderkey", "'Cep tel 0532 123 45 67 son '", "'no 0532 123 45 67 son '", "'hasta a@b.co '") + f" || {K}")],
    pick("o_orderkey", "'Cep [SAGLIK] son '", "'no [TELEFON] son '", "'[SAGLIK] [EPOSTA] '") + f" || {K}",
    lambda: Options(only=("TELEFON", "EPOSTA", "SAGLIK"), model=Model(_parts, ("SAGLIK",))), "case when o_orderkey % 3 = 2 then 2 else 1 end",
)


def canonical_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = made(spark, sf_dir, [*IBAN, ("spelled", f"lower({_SPACED_IBAN})")])
    name, k = F.concat(F.lit("  Ayşe   DEMIR "), F.col("b"), F.lit(" ")), F.col("o_orderkey").cast("string")
    return rows.select(
        "o_orderkey", canonical.iban(F.col("spelled")).alias("iban"), canonical.name(name).alias("name"), canonical.plate(F.concat(F.lit("34 abc-"), k)).alias("plate"),
        canonical.digits(F.concat(F.lit("a1."), k, F.lit(" 2"))).alias("digits"), canonical.email(F.concat(F.lit(" Ab"), k, F.lit("@EXAMPLE.Com "))).alias("email"),
    )


CANONICAL_SQL = f"select o_orderkey, number as iban, 'ayşe demir ' || b as name, '34ABC' || {K} as plate, '1' || {K} || '2' as digits, 'Ab' || {K} || '@example.com' as email from {made_sql(IBAN)}"


def more_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, k, t = made(spark, sf_dir, IBAN), F.col("o_orderkey").cast("string"), F.lit
    return rows.select(
        "o_orderkey", masks.partial(F.col("number"), "IBAN").alias("iban"), masks.partial(F.concat(t("Ayşe Demir"), k), "KISI").alias("person"), masks.partial(F.concat(t("34 ABC "), k), "PLAKA").alias("plate"),
        masks.partial(F.concat(t("0123456"), F.col("b")), "MERSIS").alias("mersis"), masks.partial(F.concat(t("10.2.3."), (F.col("o_orderkey") % 200).cast("string")), "IP_ADRESI").alias("ip"), masks.partial(F.concat(t("Lale Caddesi No "), k), "ADRES").alias("address"),
        masks.partial(F.concat(t("2024/"), k), "ESAS_NO").alias("case_number"), masks.partial(k, "OZEL").alias("other"),
    )


MASK_SQL = f"""select o_orderkey, substr(number, 1, 4) || ' **** **** **** **** **** ' || substr(number, 25, 2) as iban, 'A*** D' || repeat('*', 4 + length({K})) as person, '34 *** ' || {K} as plate,
'0123********' || substr(b, 6, 4) as mersis, '10.2.*.*' as ip, 'Lale Cad... [Adres Gizlendi]' as address, '2024/****' as case_number,
case when length({K}) <= 3 then repeat('*', length({K})) else substr({K}, 1, 1) || '***' || substr({K}, length({K}), 1) end as other from {made_sql(IBAN)}"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("int").alias("q"), F.col("l_discount").cast("double").alias("d"))
    status = F.when(F.col("q") % 3 == 0, "valid").when(F.col("q") % 3 == 1, "invalid").otherwise("not_checked")
    c = F.struct((F.col("l_linenumber") - 3).alias("priority"), status.alias("status"), (F.col("q") % 2 == 0).alias("labelled"), (F.col("q") % 5 * 50).alias("bonus"), F.col("d").alias("confidence"), F.repeat(F.lit("é"), F.col("q")).alias("value"))
    return rows.withColumn("c", c).select("l_orderkey", "l_linenumber", F.round(score(F.col("c")), 4).alias("score"))


SCORE_SQL = """select l_orderkey, l_linenumber, round(greatest(0.1, (l_linenumber - 3) * 100 + case q % 3 when 0 then 500 when 1 then -350 else 0 end + case when q % 2 = 0 then 400 else 0 end + q % 5 * 50 + d * 100 + least(2 * q, 30)), 4) as score
from (select l_orderkey, l_linenumber, cast(l_quantity as int) as q, cast(l_discount as double) as d from lineitem)"""


def best_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By order: the highest sum of scores of disjoint spans; a line item is a span from its part number, as long as its quantity."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    x = F.struct((F.col("l_partkey") % 60).cast("int").alias("start"), (F.col("l_partkey") % 60 + F.col("l_quantity")).cast("int").alias("end"), (F.col("l_suppkey") % 50 + 1).cast("double").alias("score"))
    by = rows.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(x)).alias("x"))  # seven items an order at most
    picked = by.withColumn("p", _chosen(F.col("x.start"), F.col("x.end"), F.col("x.score")))
    return picked.select("l_orderkey", F.aggregate(F.transform("p", lambda i: F.get("x", i)["score"]), F.lit(0.0), lambda s, v: s + v).cast("long").alias("total"), F.size("x").cast("long").alias("n"))


BEST_SQL = """with recursive s as (
  select l_orderkey, row_number() over (partition by l_orderkey order by st, en, sc, l_linenumber) as i, st, en, sc
  from (select l_orderkey, l_linenumber, l_partkey % 60 as st, cast(l_partkey % 60 + l_quantity as bigint) as en, l_suppkey % 50 + 1 as sc from lineitem)
), walk as (
  select l_orderkey, i, en, sc as total from s
  union all
  select s.l_orderkey, s.i, s.en, walk.total + s.sc from walk join s on s.l_orderkey = walk.l_orderkey and s.i > walk.i and s.st >= walk.en
) select l_orderkey, cast(max(total) as bigint) as total, (select count(*) from s where s.l_orderkey = walk.l_orderkey) as n from walk group by l_orderkey"""


def cover_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans chosen and a model's spans that reach beyond them, by order: the merged groups."""
    a = (F.col("o_orderkey") % 7).cast("int")
    three = lambda x, y, z: F.array(x.cast("int"), y.cast("int"), z.cast("int"))
    rows = made(spark, sf_dir, []).select("o_orderkey", three(F.lit(0), a, F.lit(20)).alias("s"), three(F.lit(4), a + 3, F.lit(24)).alias("e"), F.array(F.lit(9.0), F.lit(1.0), F.lit(5.0)).alias("v"), F.array(F.lit(False), F.lit(True), F.lit(False)).alias("m"))
    out = rows.withColumn("g", _covered("s", "e", "v", "m"))
    return out.select("o_orderkey", F.array_join(F.transform("g", lambda g: F.concat(g["start"].cast("string"), F.lit("-"), g["end"].cast("string"))), ",").alias("groups"))


COVER_GROUPS_SQL = "select o_orderkey, case when a <= 1 then '0-4' when a < 4 then '0-' || (a + 3) else '0-4,' || a || '-' || (a + 3) end || ',20-24' as groups from (select o_orderkey, o_orderkey % 7 as a from orders)"


def interval_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = F.array(*(F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in ((5, 10), (20, 30))))
    start = (F.col("o_orderkey") % 40).cast("int")
    return made(spark, sf_dir, []).select("o_orderkey", overlaps(start, start + (F.col("o_orderkey") % 6).cast("int"), ranges).alias("meets"))


OVERLAP_SQL = "select o_orderkey, (a < 10 and b > 5) or (a < 30 and b > 20) as meets from (select o_orderkey, o_orderkey % 40 as a, o_orderkey % 40 + o_orderkey % 6 as b from orders)"


def token_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = made(spark, sf_dir, [("token", pick("o_orderkey", f"'⟦RDT:ab' || {K} || ':KISI:' || {K} || '⟧'", f"'[ESAS_NO_' || {K} || ']'", f"'KISI_' || {K}"))])
    t = parse_token(F.col("token"))
    return rows.select("o_orderkey", t["session"].alias("session"), t["entity_type"].alias("entity_type"), t["index"].alias("index"))


TOKEN_SQL = f"select o_orderkey, case when o_orderkey % 3 = 0 then 'ab' || {K} end as session, case o_orderkey % 3 when 0 then 'KISI' when 1 then 'ESAS_NO' end as entity_type, case when o_orderkey % 3 < 2 then o_orderkey end as index from orders"

MIX: Steps = [*TCKN, ("m", "cast(o_orderkey % 3 as int)"), ("text", f"repeat('u' || {K} || '@example.com ', m) || case when o_orderkey % 2 = 0 then 'TCKN: ' || number || ' 10.0.0.7' else 'son' end")]


def report_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resolve(made(spark, sf_dir, MIX), Options(only=("TCKN", "EPOSTA", "IP_ADRESI")))
    counts = F.array_join(F.transform(counts_of(F.col("spans")), lambda c: F.concat(c["entity_type"], F.lit("="), c["n"].cast("string"))), ",")
    return out.select("o_orderkey", report_summary(F.col("spans")).alias("summary"), counts.alias("counts"))


_NO_HIT = "Belgede TCKN, IBAN, telefon, e-posta, kişi adı vb. taranan kişisel veri türleri bulunamadı."
REPORT_SQL = f"""select o_orderkey, case when m = 0 and o_orderkey % 2 = 1 then '{_NO_HIT}' else case when m > 0 then m || ' e-posta' else '' end || case when m > 0 and o_orderkey % 2 = 0 then ', ' else '' end || case when o_orderkey % 2 = 0 then '1 TCKN, 1 IP adresi' else '' end || ' redakte edildi.' end as summary,
case when m > 0 then 'EPOSTA=' || m else '' end || case when m > 0 and o_orderkey % 2 = 0 then ',' else '' end || case when o_orderkey % 2 = 0 then 'TCKN=1,IP_ADRESI=1' else '' end as counts from {made_sql(MIX)}"""


def rules_and_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = validate(redact(made(spark, sf_dir, MIX), Options(only=("TCKN", "EPOSTA", "IP_ADRESI"))))
    codes = F.array_join(F.transform("warnings", lambda w: F.concat_ws(":", w["code"], w["entity_type"], w["severity"])), ",")
    return out.select("o_orderkey", F.array_join("applied_rules", ",").alias("rules"), codes.alias("warnings"), "risk", "status")


RULES_SQL = f"""select o_orderkey, case when m > 0 then 'EPOSTA_RFC' else '' end || case when m > 0 and o_orderkey % 2 = 0 then ',' else '' end || case when o_orderkey % 2 = 0 then 'TCKN_CHECKSUM,IP_V4' else '' end as rules,
case when o_orderkey % 2 = 0 and wrong then 'UNVALIDATED_FORMAT_CANDIDATE:TCKN:medium' else '' end as warnings, case when o_orderkey % 2 = 0 and wrong then 'medium' else 'low' end as risk, 'complete' as status from {made_sql(MIX)}"""


def policy_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A number under each policy: labelled or not, valid or not."""
    rows, out = made(spark, sf_dir, [*TCKN, ("text", "case when o_orderkey % 2 = 0 then 'TCKN: ' else 'no ' end || number")]), None
    for name in POLICIES:
        part = redact(rows, Options(policy=name, only=("TCKN",))).select("o_orderkey", F.lit(name).alias("policy"), "n_redacted", "risk")
        out = part if out is None else out.unionByName(part)
    return out


POLICY_SQL = f"""select o_orderkey, policy, cast(hit as bigint) as n_redacted, case when hit and wrong then 'medium' else 'low' end as risk from (
select *, case policy when 'strict' then true when 'logs' then true when 'balanced' then not wrong or o_orderkey % 2 = 0 else not wrong end as hit from {made_sql(TCKN)}, (select unnest(['strict', 'balanced', 'validated_only', 'logs']) as policy))"""

_LEFT: Steps = [*IBAN, ("redacted", pick("o_orderkey", "'[TCKN] ⟦RDT:a:KISI:12345678901⟧ *** son'", "'kalan ' || b || '12'", f"'kalan ' || {_SPACED_IBAN}", "'kalan 4111-1111-1111-1111'", "'a@b.co ve 0111111111123456'")), ("text", "redacted"), ("risk", "'low'")]


def residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = validate(made(spark, sf_dir, _LEFT))
    return out.select("o_orderkey", F.array_join("residual", ",").alias("residual"), "risk", "status", "needs_review")


RESIDUAL_SQL = f"""select o_orderkey, r as residual, case when r = '' then 'low' else 'high' end as risk, case when r = '' then 'complete' else 'review_required' end as status, r <> '' as needs_review
from (select *, {pick("o_orderkey", "''", "'TCKN'", "'IBAN,KREDI_KARTI'", "'KREDI_KARTI'", "'KREDI_KARTI,MERSIS,EPOSTA'")} as r from {made_sql(_LEFT)})"""

_RAW: Steps = [("text", f"'a\u00a0b\u200b' || {K} || chr(13) || chr(10) || '\u2019c\u201c' || chr(13) || 'd\u2009e\u00ad'")]


def normalised_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return made(spark, sf_dir, _RAW).select("o_orderkey", normalise(F.col("text")).alias("text"))


RAW_SQL = f"select o_orderkey, 'a b' || {K} || chr(10) || '''c' || chr(34) || chr(10) || 'd e' as text from orders"


def review_word_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = made(spark, sf_dir, [("text", pick("o_orderkey", *(f"'x {w} y'" for w in REVIEW_WORDS), "'sade'", "'MAHKEME ceza ŞİDDET'"))])
    return rows.select("o_orderkey", review_word(F.col("text")).alias("review_word"))


REVIEW_SQL = f"select o_orderkey, {pick('o_orderkey', *(chr(39) + w + chr(39) for w in REVIEW_WORDS), 'null', chr(39) + 'mahkeme' + chr(39))} as review_word from orders"

_MAPS: Steps = [("text", f"'{{\"a' || {K} || '\": \"x\", \"n\": 1, \"z\": null, \"o\": {{\"p\": \"q\"}}, \"b\": \"' || {K} || '\"}}'")]


def map_codecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = made(spark, sf_dir, _MAPS).withColumn("m", map_from_json(F.col("text"))).withColumn("u", merged(F.create_map(F.lit("b"), F.lit("old"), F.lit("c"), F.lit("kept")), F.col("m")))
    shown = lambda c: F.array_join(F.array_sort(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")
    broken = map_from_json(F.concat(F.lit("["), F.col("text")))
    return rows.select("o_orderkey", shown("m").alias("loaded"), shown("u").alias("merged"), F.size(broken).cast("long").alias("broken"), F.get_json_object(map_to_json(F.col("u"), True), "$.c").alias("kept"), map_to_json(F.create_map(F.lit("t"), F.col("text"))).alias("safe"))


MAP_SQL = f"select o_orderkey, 'a' || {K} || '=x,b=' || {K} as loaded, 'a' || {K} || '=x,b=' || {K} || ',c=kept' as merged, 0::bigint as broken, 'kept' as kept, '{{\"tokens\":[\"t\"]}}' as safe from orders"


def session_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A token of another session makes a text unsafe; one of its own is put back."""
    rows = made(spark, sf_dir, [("session", "'s' || cast(o_orderkey % 5 as string)"), ("redacted", f"'x ⟦RDT:s' || cast(case when o_orderkey % 3 = 0 then o_orderkey % 5 + 5 else o_orderkey % 5 end as string) || ':KISI:1⟧ ' || {K}")])
    known = spark.createDataFrame([(f"s{i}", f"⟦RDT:s{i}:KISI:1⟧", f"Ali {i}") for i in range(5)], "session string, token string, original string")
    return unmask_sessions(rows, known, "o_orderkey", "session").select("o_orderkey", "unsafe", "unmasked")


GUARD_SQL = f"select o_orderkey, o_orderkey % 3 = 0 as unsafe, case when o_orderkey % 3 <> 0 then 'x Ali ' || (o_orderkey % 5) || ' ' || {K} end as unmasked from orders"


def record_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns on the list are redacted; others give null, and numbers stay."""
    rows = made(spark, sf_dir, [("reasoning", f"'yaz u' || {K} || '@example.com'"), ("notes", f"'n' || {K} || '@example.com'"), ("level", "o_orderkey % 9")])
    out = with_redacted(rows, ("reasoning", "notes", "level"), ("reasoning", "level"), Options(only=("EPOSTA",)))
    return out.select("o_orderkey", "redacted_reasoning", "redacted_notes", F.col("redacted_level").cast("long").alias("redacted_level"), "notes")


RECORD_SQL = f"select o_orderkey, 'yaz [EPOSTA]' as redacted_reasoning, null::varchar as redacted_notes, (o_orderkey % 9)::bigint as redacted_level, 'n' || {K} || '@example.com' as notes from orders"


def log_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = made(spark, sf_dir, [("message", f"'u' || {K} || '@example.com girdi'"), ("level", "o_orderkey % 9")])
    rows = rows.withColumn("context", F.create_map(F.lit("mail"), F.concat(F.lit("m"), F.col("o_orderkey").cast("string"), F.lit("@b.co")), F.lit("plain"), F.lit("ok"))).withColumn("extra", F.array(F.struct(F.array(F.col("message"), F.lit("x")).alias("v"))))
    out = redact_log(rows, options=Options(policy="logs", only=("EPOSTA",)))
    return out.select("o_orderkey", "message", F.col("context")["mail"].alias("mail"), F.col("context")["plain"].alias("plain"), F.array_join(F.col("extra")[0]["v"], "|").alias("extra"), F.col("level").cast("long").alias("level"))


LOG_SQL = "select o_orderkey, '[EPOSTA] girdi' as message, '[EPOSTA]' as mail, 'ok' as plain, '[EPOSTA] girdi|x' as extra, (o_orderkey % 9)::bigint as level from orders"

_SNAPSHOT: Steps = [("n", f"'Dosya ' || {K} || ': '"), ("source", "n || '3 yıl ceza, Ayşe Demir'")]


def snapshot_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A duration taken for a name is put back; a row whose hash is not its source's stays as it is."""
    at = F.length("n")
    span = lambda a, b, t: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"), F.lit(t).alias("token"))
    rows = made(spark, sf_dir, _SNAPSHOT).select(
        "o_orderkey", "n", "source", F.when(F.col("o_orderkey") % 4 == 0, F.lit("0")).otherwise(F.sha2("source", 256)).alias("hash"), F.concat("n", F.lit("[D] ceza, [P]")).alias("text"),
        F.create_map(F.lit("[D]"), F.lit("3 yıl"), F.lit("[P]"), F.lit("Ayşe Demir")).alias("map"), F.create_map(F.lit("[D]"), F.lit("KISI"), F.lit("[P]"), F.lit("KISI")).alias("types"),
        F.array(span(at, at + 5, "[D]"), span(at + 12, at + 22, "[P]")).alias("spans"),
    )
    return repair(rows, preserve_legal_facts=True).select("o_orderkey", "text", F.array_join(F.array_sort(F.map_keys("map")), ",").alias("tokens"), F.size("spans").cast("long").alias("n_spans"))


REPAIR_SQL = f"select o_orderkey, n || case when o_orderkey % 4 = 0 then '[D]' else '3 yıl' end || ' ceza, [P]' as text, case when o_orderkey % 4 = 0 then '[D],[P]' else '[P]' end as tokens, case when o_orderkey % 4 = 0 then 2 else 1 end::bigint as n_spans from {made_sql(_SNAPSHOT)}"


def names_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = made(spark, sf_dir, [("text", f"'Sayın ' || {_FIRST} || ' Kaya, no ' || {K} || ', u@example.com'")])
    return redact_names(rows).select("o_orderkey", "redacted", "n_redacted")


NAMES_ONLY_SQL = f"select o_orderkey, 'Sayın [KISI], no ' || {K} || ', u@example.com' as redacted, 1::bigint as n_redacted from orders"


def safe_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a safe sink writes: no originals in any column."""
    out = safe(redact(made(spark, sf_dir, [("text", f"'u' || {K} || '@example.com'")]), Options(only=("EPOSTA",))))
    return out.select("o_orderkey", F.to_json(F.struct(*sorted(c for c in out.columns if c != "o_orderkey"))).alias("row"))


SAFE_SQL = "select o_orderkey, '" + json.dumps({"applied_rules": ["EPOSTA_RFC"], "n_redacted": 1, "n_warnings": 0, "redacted": "[EPOSTA]", "risk": "low", "warnings": []}, separators=(",", ":")) + "' as row from orders"

_ALL = {
    "detect_tckn": (detect_tckn, TCKN_SQL), "detect_vkn": (detect_vkn, VKN_SQL), "detect_iban": (detect_iban, IBAN_SQL), "detect_mersis": (detect_mersis, MERSIS_SQL), "detect_phones": (detect_phones, PHONE_SQL),
    "legal_numbers": (legal_numbers, LEGAL_SQL), "excluded_ranges": (excluded_ranges, EXCLUDED_SQL), "dictionary_names": (dictionary_names, NAMES_SQL), "address_parts": (address_parts, ADDRESS_SQL), "name_mistakes": (name_mistakes, MISTAKES_SQL),
    "custom_patterns": (custom_patterns, CUSTOM_SQL), "custom_detectors": (custom_detectors, DETECTOR_SQL), "configured": (configured, CONFIG_SQL), "plate_mistakes": (plate_mistakes, PLATE_SQL), "model_cover": (model_cover, COVER_SQL),
    "canonical_forms": (canonical_forms, CANONICAL_SQL), "more_masks": (more_masks, MASK_SQL), "scores": (scores, SCORE_SQL), "best_spans": (best_spans, BEST_SQL), "cover_groups": (cover_groups, COVER_GROUPS_SQL), "interval_overlaps": (interval_overlaps, OVERLAP_SQL),
    "token_parts": (token_parts, TOKEN_SQL), "report_sentences": (report_sentences, REPORT_SQL), "rules_and_warnings": (rules_and_warnings, RULES_SQL), "policy_effects": (policy_effects, POLICY_SQL), "residuals": (residuals, RESIDUAL_SQL),
    "normalised_texts": (normalised_texts, RAW_SQL), "review_word_texts": (review_word_texts, REVIEW_SQL), "map_codecs": (map_codecs, MAP_SQL), "session_guards": (session_guards, GUARD_SQL), "record_columns": (record_columns, RECORD_SQL),
    "log_records": (log_records, LOG_SQL), "snapshot_repair": (snapshot_repair, REPAIR_SQL), "names_only": (names_only, NAMES_ONLY_SQL), "safe_rows": (safe_rows, SAFE_SQL),
}
QUERIES = {k: v[0] for k, v in _ALL.items()}
ORACLE_SQL = {k: v[1] for k, v in _ALL.items()}
