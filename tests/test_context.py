import pytest
from pyspark.sql import functions as F

from veilspan.functions.identity import scrub_identity
from veilspan.operators.contextual import addresses, dictionary_names
from veilspan.operators.detect import Custom
from veilspan.operators.false_positives import legal_fact
from veilspan.operators.positions import original_spans
from veilspan.operators.validate import validate
from veilspan.plans.redaction import Options, redact
from veilspan.plans.sessions import map_from_json, merged, parse_token, redact_sessions, unmask_sessions
from veilspan.sources.records import redact_log, with_redacted

REDACTED = [
    ("davacı Ayşe Demir duruşmaya geldi. davalı Mehmet Kaya arandı.", "davacı [KISI_1] duruşmaya geldi. davalı [KISI_2] arandı."),
    ("Adı Soyadı: Ahmet Yılmaz, İsim: Fatma Öz", "Adı Soyadı: [KISI_1], İsim: [KISI_2]"),
    ("Müvekkilim Ayşe Demir, kiracı Mehmet Kaya'ya", "Müvekkilim [KISI_1], kiracı [KISI_2]'ya"),
    ("Toplantıya Ali Yılmaz ve Ebru Can Güler katıldı.", "Toplantıya [KISI_1] ve [KISI_2] katıldı."),
    ("Mehmet Akif Ersoy Üniversitesi ve İstanbul Üniversitesi", "Mehmet Akif Ersoy Üniversitesi ve İstanbul Üniversitesi"),
    ("HUKUKİ VE SAĞLAM HALE GETİR", "HUKUKİ VE SAĞLAM HALE GETİR"),
    ("Adres: Atatürk Mahallesi No: 5 Çankaya TCKN: 43650391326", "Adres: [ADRES_1] TCKN: [TCKN_1]"),
    ("2001:0db8:85a3:0000:0000:8a2e:0370:7334 ve fe80::1", "[IP_ADRESI_1] ve [IP_ADRESI_2]"),
    ("24 ve 25 maddeleri; 60 ile 72 arasında; 12 TL 50 kuruş; 19 May 2026", "24 ve 25 maddeleri; 60 ile 72 arasında; 12 TL 50 kuruş; 19 May 2026"),
    ("24 ve 25 plakalı araç, 34abc123", "[PLAKA_1] plakalı araç, [PLAKA_2]"),
    ("Plakası: 3​4 ABC 123\r\nson", "Plakası: [PLAKA_1]\r\nson"),
    ("ORD-12345", "[SIPARIS_NO_1]"),
    ("", ""),
    (None, None),
]


def test_contextual_redaction(spark):
    rows = spark.createDataFrame(list(enumerate(t for t, _ in REDACTED)), "id int, text string")
    out = redact(rows, Options(policy="strict", strategy="tag", custom=(Custom("ORDER", "SIPARIS_NO", r"\bORD-[0-9]{5}\b"),)))
    assert [r["redacted"] for r in out.orderBy("id").collect()] == [r for _, r in REDACTED]


def test_long_text_of_names_and_quarters():
    text = "Ali Kaya " * 20000
    assert len(dictionary_names(text, frozenset({"ali"}))) == 10000  # four words a name
    assert addresses("mah " * 20000) == []


def test_spans_of_the_original():
    text = "Ş a​’\r\n😀​"
    assert original_spans(text, [(0, 1), (2, 4), (4, 5), (5, 6), (0, 6)]) == [(0, 1), (2, 5), (5, 7), (7, 9), (0, 9)]


@pytest.mark.parametrize(
    ("before", "value", "after", "kind", "fact"),
    [
        ("", "3 YIL 21 GÜN", "", "CEZA_BILGISI", True), ("", "12.05.2026", "", "DOGUM_TARIHI", True), ("", "İş Kanunu", "", "KISI", True),
        ("", "BELİRSİZ SÜRELİ İŞ SÖZLEŞMESİ", "", "DIGER_KISISEL", True), ("DOĞUM YERİ VE TARİHİ: ", "12.05.1980", "", "DOGUM_TARIHI", False),
        ("", "12.05.1980", " doğumlu Ayşe", "DOGUM_TARIHI", False), ("", "2026", "", "HESAP_NO", False), ("", "Ayşe Demir", "", "KISI", False),
    ],
)
def test_legal_facts(spark, before, value, after, kind, fact):
    column = legal_fact(F.lit(before + value + after), F.lit(len(before)), F.lit(len(before + value)), F.lit(kind))
    assert spark.range(1).select(column.alias("x")).first()["x"] is fact


def test_residuals_and_review(spark):
    rows = spark.createDataFrame([(1, "bare 12345678901"), (2, "mahkeme"), (3, "a@b.com")], "id int, text string")
    got = {r["id"]: r for r in validate(redact(rows)).collect()}
    assert (got[1]["residual"], got[1]["risk"], got[1]["status"]) == (["TCKN"], "high", "review_required")
    assert (got[2]["review_word"], got[2]["risk"], got[2]["status"], got[2]["needs_review"]) == ("mahkeme", "medium", "complete", True)
    assert not got[3]["needs_review"]


def test_sessions(spark):
    rows = [(1, "s", 1, "Ayşe Demir, a@b.com"), (2, "s", 2, "Ali Kaya ve Ayşe Demir"), (3, "t", 1, "Ali Kaya"), (4, "t", 2, None), (5, None, 1, "x@y.com")]
    docs = spark.createDataFrame(rows, "id int, session string, seq int, text string")
    out, found = redact_sessions(docs.where("session is not null"), "id", "session", "seq")
    got = dict(out.select("id", "redacted").collect())
    assert got[1] == "⟦RDT:s:KISI:1⟧, ⟦RDT:s:EPOSTA:1⟧" and got[2] == "⟦RDT:s:KISI:2⟧ ve ⟦RDT:s:KISI:1⟧" and got[3] == "⟦RDT:t:KISI:1⟧"
    back = unmask_sessions(out, found, "id", "session").collect()
    assert all(r["unmasked"] == r["text"] and not r["unsafe"] for r in back)
    assert all(r["unsafe"] and r["unmasked"] is None for r in unmask_sessions(out, found, "id", "session", "other").collect())


def test_token_and_map_codecs(spark):
    old, new = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("a"), F.lit("3"))
    row = spark.range(1).select(
        map_from_json(F.lit('{"a":"b","c":1,"d":null,"e":{"x":"y"}}')).alias("m"), map_from_json(F.lit("[1")).alias("n"), merged(old, new).alias("u"),
        parse_token(F.lit("⟦RDT:ab:KISI:3⟧")).alias("t"), parse_token(F.lit("[KISI_2]")).alias("l"), parse_token(F.lit("KISI_2")).alias("x"),
    ).first()
    assert row["m"] == {"a": "b"} and row["n"] == {} and row["u"] == {"a": "3", "b": "2"}
    assert tuple(row["t"]) == ("ab", "KISI", 3) and tuple(row["l"]) == (None, "KISI", 2) and row["x"] is None


def test_records(spark):
    schema = "message string, context map<string,string>, extra array<struct<u:string,v:array<string>>>, level int"
    rows = [("x@y.com", {"a": "p@q.com", "b": None}, [("z@w.com", ["k@l.com", "ok"])], 5), (None, None, None, None)]
    log = spark.createDataFrame(rows, schema)
    first, empty = redact_log(log).collect()
    assert first["message"] == "[EPOSTA]" and first["context"] == {"a": "[EPOSTA]", "b": None} and first["extra"][0]["v"] == ["[EPOSTA]", "ok"] and first["level"] == 5
    assert empty["message"] is None and empty["context"] is None
    row = with_redacted(log.select("message", "level"), ("message", "level"), ("message",)).first()
    assert row["redacted_message"] == "[EPOSTA]" and row["redacted_level"] is None and row["message"] == "x@y.com"


def test_identity_statements(spark):
    rows = spark.createDataFrame([("I am Qwen, a large language model. Tamam.",), ("Bu metin.",), (None,)], "text string")
    assert [tuple(r) for r in scrub_identity(rows).collect()] == [("[ASİSTAN]. Tamam.", 1), ("Bu metin.", 0), (None, 0)]
