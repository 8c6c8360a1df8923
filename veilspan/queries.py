"""The registered redaction queries and the DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import canonical, checksums, masks
from .functions.identity import scrub_identity
from .functions.text import byte_offset, html_escape, normalise
from .operators.detect import Custom, candidates
from .operators.false_positives import legal_fact
from .operators.model_detector import Model
from .operators.resolve import POLICIES
from .operators.validate import REVIEW_WORDS, review_word, validate
from .plans.redaction import Options, detect, redact, report_summary, resolve, token_map, unmask
from .plans.sessions import redact_sessions, unmask_sessions
from .sources import spread


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("text"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/pages.parquet")).select(F.col("page_id").alias("doc_id"), F.coalesce("html", F.lit("")).alias("text"))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey"))


def _key11() -> Column:
    """Eleven digits from the order key."""
    return F.lpad((F.col("o_orderkey") * 7919 + 10000000001).cast("string"), 11, "1")


_SQL11 = "lpad((o_orderkey * 7919 + 10000000001)::varchar, 11, '1')"
_D = lambda x, i: f"substr({x}, {i}, 1)::int"


def redact_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-mail addresses of all documents replaced by their label."""
    out = redact(_docs(spark, sf_dir), Options(only=("EPOSTA",)))
    return out.select("doc_id", "redacted", "n_redacted")


def redact_asterisk(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = redact(_docs(spark, sf_dir), Options(only=("EPOSTA",), strategy="asterisk"))
    return out.select("doc_id", F.length("redacted").cast("long").alias("n_chars"), (F.length("redacted") - F.length(F.replace("redacted", F.lit("*"), F.lit("")))).cast("long").alias("n_stars"))


def redact_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact(_docs(spark, sf_dir)).select("doc_id", "redacted", "n_redacted", "risk", "n_warnings")


def redact_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact(_docs(spark, sf_dir), Options(strategy="partial")).select("doc_id", "redacted")


def redact_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact(_pages(spark, sf_dir)).select("doc_id", F.sha2("redacted", 256).alias("redacted_sha256"), "n_redacted", "risk")


def detect_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candidates with UTF-8 byte offsets."""
    rows = detect(_docs(spark, sf_dir)).select("doc_id", "text", F.explode("candidates").alias("c"))
    return rows.select("doc_id", "c.entity_type", "c.rule_id", byte_offset(F.col("text"), F.col("c.start")).alias("start"), byte_offset(F.col("text"), F.col("c.end")).alias("end"), "c.status", "c.confidence", "c.priority")


def counts_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = resolve(_docs(spark, sf_dir)).select("lang", F.explode("spans").alias("s"))
    return rows.groupBy("lang", F.col("s.entity_type").alias("entity_type")).agg(F.count("*").alias("n_spans"))


def cards_luhn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen-digit runs and whether their checksum holds."""
    rows = _docs(spark, sf_dir).select("doc_id", F.explode(candidates("text", ("KREDI_KARTI",))).alias("c"))
    rows = rows.where(F.length("c.canonical") == 16)
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_cards"), F.sum(F.when(F.col("c.status") == "valid", 1).otherwise(0)).cast("long").alias("n_valid"))


def policy_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = _docs(spark, sf_dir), None
    for name in POLICIES:
        part = redact(docs, Options(policy=name)).select(F.lit(name).alias("policy"), "n_redacted", "risk").groupBy("policy", "risk").agg(F.count("*").alias("n_docs"), F.sum("n_redacted").alias("n_redacted"))
        out = part if out is None else out.unionByName(part)
    return out


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_map(redact(_docs(spark, sf_dir), Options(strategy="tag")), "doc_id")


def unmask_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What unmasking gives back, and how many tokens there were to put back."""
    out = redact(_docs(spark, sf_dir), Options(strategy="tag", only=("EPOSTA",)))
    n_tokens = F.size(F.regexp_extract_all("redacted", F.lit(r"\[EPOSTA_[0-9]+\]"), F.lit(0))).cast("long")
    return unmask(out, token_map(out, "doc_id"), "doc_id").select("doc_id", F.sha2("unmasked", 256).alias("text_sha256"), n_tokens.alias("n_tokens"))


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve(_docs(spark, sf_dir)).select("doc_id", report_summary(F.col("spans")).alias("summary"))


def normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.sha2(normalise(F.col("text")), 256).alias("text_sha256"))


def escaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("doc_id", F.sha2(html_escape(F.col("text")), 256).alias("html_sha256"))


def tckn_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).select("o_orderkey", _key11().alias("value"), checksums.tckn_valid(_key11()).alias("valid"))


def vkn_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.right(_key11(), F.lit(10))
    return _orders(spark, sf_dir).select("o_orderkey", checksums.vkn_valid(x).alias("valid"))


def iban_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.concat(F.lit("TR33"), F.rpad(_key11(), 22, "7"))
    return _orders(spark, sf_dir).select("o_orderkey", checksums.iban_valid(x).alias("valid"))


def luhn_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).select("o_orderkey", checksums.luhn_valid(F.concat(F.lit("45320"), _key11())).alias("valid"))


def partial_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, t = _orders(spark, sf_dir), F.lit
    return o.select(
        "o_orderkey", masks.partial(_key11(), "TCKN").alias("tckn"), masks.partial(F.right(_key11(), F.lit(10)), "VKN").alias("vkn"),
        masks.partial(F.concat(t("+90"), F.right(_key11(), F.lit(10))), "TELEFON").alias("phone"), masks.partial(F.concat(t("user"), _key11(), t("@example.com")), "EPOSTA").alias("email"),
        masks.partial(F.concat(t("45320"), _key11()), "KREDI_KARTI").alias("card"), masks.asterisk(F.concat(t("a b"), _key11())).alias("stars"),
    )


def canonical_phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.concat(F.lit("5"), F.right(_key11(), F.lit(9)))
    forms = F.array(F.concat(F.lit("+90 "), n), F.concat(F.lit("0090"), n), F.concat(F.lit("0"), n), n)
    return _orders(spark, sf_dir).select("o_orderkey", F.explode(forms).alias("spelling")).select("o_orderkey", "spelling", canonical.phone(F.col("spelling")).alias("phone"))


def _sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sentence an order with a name, a plate, an address, an IPv6 address and an order number."""
    k = F.col("o_orderkey").cast("string")
    text = F.concat(
        F.lit("Davacı Ayşe Demir, plaka: 34 ABC "), F.lpad((F.col("o_orderkey") % 1000).cast("string"), 4, "0"), F.lit(", sunucu fe80::1, ORD-"), F.lpad(k, 8, "0"),
        F.lit(".\nAdres: Atatürk Mahallesi No: "), k, F.lit(" Ankara\nSayın Ali Kaya'ya 24 ve 25 maddeleri iletildi."),
    )
    return _orders(spark, sf_dir).select("o_orderkey", text.alias("text"))


def redact_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names, plates, addresses, IPv6 addresses and a pattern of the user."""
    options = Options(custom=(Custom("ORDER", "SIPARIS_NO", r"\bORD-[0-9]{8}\b"),))
    return redact(_sentences(spark, sf_dir), options).select("o_orderkey", "redacted", "n_redacted")


def redact_original_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with deleted characters and carriage returns are redacted in their own positions."""
    text = F.concat(F.lit("\u200bTel:\u00a00532\r\n"), F.lpad((F.col("o_orderkey") % 1000).cast("string"), 3, "0"), F.lit(" 4\u200b5 67\r\nson\u200b"))
    return redact(_orders(spark, sf_dir).select("o_orderkey", text.alias("text"))).select("o_orderkey", "redacted", "n_redacted")


def residual_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = validate(redact(_docs(spark, sf_dir)))
    return out.select("doc_id", "residual", "review_word", "risk", "status", "needs_review")


def review_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", review_word(F.col("text")).alias("review_word"))


def session_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct e-mail addresses by source, numbered in order of appearance."""
    _, found = redact_sessions(_docs(spark, sf_dir).withColumn("session", F.md5("source")), "doc_id", "session", "doc_id", Options(only=("EPOSTA",)))
    return found.select("session", "token", "original")


def session_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions by source; what unmasking puts back, e-mail addresses in their first spelling."""
    docs = _docs(spark, sf_dir).withColumn("session", F.md5("source"))
    out, found = redact_sessions(docs, "doc_id", "session", "doc_id", Options(only=("EPOSTA",)))
    n_tokens = F.size(F.regexp_extract_all("redacted", F.lit("⟦RDT:"), F.lit(0))).cast("long")
    return unmask_sessions(out, found, "doc_id", "session").select("doc_id", F.lower("unmasked").alias("unmasked"), "unsafe", n_tokens.alias("n_tokens"))


def legal_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates are facts unless a birth is named next to them."""
    d = F.concat(F.lpad((F.col("o_orderkey") % 28 + 1).cast("string"), 2, "0"), F.lit(".05."), (F.col("o_orderkey") % 50 + 1950).cast("string"))
    rows = _orders(spark, sf_dir).select("o_orderkey", F.explode(F.array(F.lit("Tebliğ: "), F.lit("DOĞUM TARİHİ: "), F.lit("D.T.: "))).alias("label"), d.alias("d"))
    text = F.concat("label", "d")
    return rows.select("o_orderkey", "label", legal_fact(text, F.length("label"), F.length(text), F.lit("DOGUM_TARIHI")).alias("fact"))


def identity_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey").cast("string")
    rows = _orders(spark, sf_dir).select("o_orderkey", F.concat(F.lit("Sipariş "), k, F.lit(". I am Qwen, a large language model. Tamam.")).alias("text"))
    return scrub_identity(rows)


def _stand_in(request: dict) -> dict:
    """In place of a model: knows one illness."""
    return {"entities": [{"type": "SAGLIK", "text": "şeker hastası", "occurrence": 1}] if "şeker hastası" in request["text"] else []}


def model_and_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of a model, here a stand-in, and of the rules, resolved together."""
    text = F.concat(F.lit("Hasta "), F.col("o_orderkey").cast("string"), F.lit(" şeker hastası, k"), F.col("o_orderkey").cast("string"), F.lit("@example.com"))
    options = Options(only=("EPOSTA", "SAGLIK"), model=Model(_stand_in, ("SAGLIK",)))
    return redact(_orders(spark, sf_dir).select("o_orderkey", text.alias("text")), options).select("o_orderkey", "redacted", "risk", "needs_review", "model_failed")


def token_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers whose token stands in the text already are left out."""
    text = F.concat(F.lit("[EPOSTA_"), (F.col("o_orderkey") % 3 + 1).cast("string"), F.lit("] a@example.com b@example.com"))
    return redact(_orders(spark, sf_dir).select("o_orderkey", text.alias("text")), Options(strategy="tag", only=("EPOSTA",))).select("o_orderkey", "redacted")


QUERIES = {
    f.__name__: f
    for f in (redact_label, redact_asterisk, redact_all, redact_partial, redact_pages, detect_spans, counts_by_type, cards_luhn, policy_comparison, tokens, unmask_round_trip, summary, normalised, escaped, tckn_check, vkn_check, iban_check, luhn_check, partial_masks, canonical_phones, redact_sentences, redact_original_positions, residual_check, review_words, session_tokens, session_round_trip, legal_facts, identity_statements, model_and_rules, token_collisions)
}

_EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
_T = _SQL11
_V = f"right({_SQL11}, 10)"
_odd = " + ".join(_D("v", i) for i in (1, 3, 5, 7, 9))
_even = " + ".join(_D("v", i) for i in (2, 4, 6, 8))
_vkn = " + ".join(f"(case when ({_D('v', i)} + {10 - i}) % 10 = 9 then 9 else (({_D('v', i)} + {10 - i}) % 10 * {1 << (10 - i)}) % 9 end)" for i in range(1, 10))
_luhn = " + ".join(f"(case when {_D('v', i)} * {2 - (i - 1) % 2} > 9 then {_D('v', i)} * 2 - 9 else {_D('v', i)} * {2 - (i - 1) % 2} end)" for i in range(1, 17))
ORACLE_SQL = {
    "redact_label": f"select doc_id, regexp_replace(coalesce(text, ''), '{_EMAIL}', '[EPOSTA]', 'g') as redacted, len(regexp_extract_all(coalesce(text, ''), '{_EMAIL}')) as n_redacted from documents",
    "redact_asterisk": f"select doc_id, length(text) as n_chars, length(text) - length(replace(text, '*', '')) + coalesce(list_sum(list_transform(regexp_extract_all(text, '{_EMAIL}'), lambda x: length(x))), 0)::bigint as n_stars from (select doc_id, coalesce(text, '') as text from documents)",
    "cards_luhn": f"""with m as (select doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[0-9]+')) as v from documents)
select doc_id, count(*) as n_cards, sum(case when ({_luhn}) % 10 = 0 then 1 else 0 end)::bigint as n_valid from m where length(v) = 16 group by doc_id""",
    "unmask_round_trip": f"select doc_id, sha256(coalesce(text, '')) as text_sha256, len(regexp_extract_all(coalesce(text, ''), '{_EMAIL}')) as n_tokens from documents",
    "normalised": "select doc_id, sha256(replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10))) as text_sha256 from documents",
    "escaped": "select page_id as doc_id, sha256(replace(replace(replace(replace(replace(coalesce(html, ''), '&', '&amp;'), '\"', '&quot;'), '''', '&#039;'), '<', '&lt;'), '>', '&gt;')) as html_sha256 from pages",
    "tckn_check": f"select o_orderkey, v as value, substr(v, 1, 1) != '0' and ((({_odd}) * 7 - ({_even})) % 10 + 10) % 10 = {_D('v', 10)} and ({_odd} + {_even} + {_D('v', 10)}) % 10 = {_D('v', 11)} as valid from (select o_orderkey, {_T} as v from orders)",
    "vkn_check": f"select o_orderkey, (10 - ({_vkn}) % 10) % 10 = {_D('v', 10)} as valid from (select o_orderkey, {_V} as v from orders)",
    "iban_check": f"select o_orderkey, (substr(v, 5) || '292733')::hugeint % 97 = 1 as valid from (select o_orderkey, 'TR33' || rpad({_T}, 22, '7') as v from orders)",
    "luhn_check": f"select o_orderkey, ({_luhn}) % 10 = 0 as valid from (select o_orderkey, '45320' || {_T} as v from orders)",
    "partial_masks": f"""select o_orderkey, left(k, 3) || '*****' || right(k, 3) as tckn, left(right(k, 10), 3) || '****' || right(k, 3) as vkn, '+90 ' || left(right(k, 10), 3) || ' *** ** ' || right(k, 2) as phone,
'u***' || right(k, 1) || '@example.com' as email, '**** **** **** ' || right(k, 4) as card, '* *' || repeat('*', length(k)) as stars from (select o_orderkey, {_T} as k from orders)""",
    "canonical_phones": f"select o_orderkey, unnest(['+90 ' || n, '0090' || n, '0' || n, n]) as spelling, '+90' || n as phone from (select o_orderkey, '5' || right({_T}, 9) as n from orders)",
    "redact_sentences": """select o_orderkey, 'Davacı [KISI], plaka: [PLAKA], sunucu [IP_ADRESI], [SIPARIS_NO].' || chr(10) || 'Adres: [ADRES]' || chr(10) || 'Sayın [KISI]''ya 24 ve 25 maddeleri iletildi.' as redacted, 6::bigint as n_redacted from orders""",
    "redact_original_positions": "select o_orderkey, chr(8203) || 'Tel:' || chr(160) || '[TELEFON]' || chr(13) || chr(10) || 'son' || chr(8203) as redacted, 1::bigint as n_redacted from orders",
    "review_words": "select doc_id, case " + " ".join(f"when contains(lower(text), '{w}') then '{w}'" for w in REVIEW_WORDS) + " end as review_word from (select doc_id, coalesce(text, '') as text from documents)",
    "session_tokens": f"""with m as (select md5(source) as session, doc_id, unnest(regexp_extract_all(coalesce(text, ''), '{_EMAIL}')) as v, generate_subscripts(regexp_extract_all(coalesce(text, ''), '{_EMAIL}'), 1) as i from documents),
c as (select session, left(v, position('@' in v)) || lower(substr(v, position('@' in v) + 1)) as canonical, arg_min(v, (doc_id, i)) as original, min((doc_id, i)) as first from m group by 1, 2)
select session, '⟦RDT:' || session || ':EPOSTA:' || row_number() over (partition by session order by first) || '⟧' as token, original from c""",
    "session_round_trip": f"select doc_id, lower(coalesce(text, '')) as unmasked, false as unsafe, len(regexp_extract_all(coalesce(text, ''), '{_EMAIL}')) as n_tokens from documents",
    "legal_facts": "select o_orderkey, label, label = 'Tebliğ: ' as fact from orders, (select unnest(['Tebliğ: ', 'DOĞUM TARİHİ: ', 'D.T.: ']) as label)",
    "model_and_rules": "select o_orderkey, 'Hasta ' || o_orderkey || ' [SAGLIK], [EPOSTA]' as redacted, 'medium' as risk, true as needs_review, false as model_failed from orders",
    "token_collisions": "select o_orderkey, '[EPOSTA_' || (o_orderkey % 3 + 1) || '] [EPOSTA_' || (case when o_orderkey % 3 = 0 then 2 else 1 end) || '] [EPOSTA_' || (case when o_orderkey % 3 = 2 then 2 else 3 end) || ']' as redacted from orders",
    "identity_statements": "select o_orderkey, 'Sipariş ' || o_orderkey || '. [ASİSTAN]. Tamam.' as text, 1::bigint as n_replaced from orders",
}
