import hashlib

import pytest

from veilspan.operators.model_detector import DetectionFailed, Model, SourceMismatch, TooLong, ask, chunks, detected, occurrences
from veilspan.operators.resolve import covered
from veilspan.operators.validate import validate
from veilspan.plans.redaction import Options, redact, token_map, unmask
from veilspan.plans.repair import repair


def snapshot(source, entities, text=None):
    spans, out, at = [], "", 0
    for token, _, value in entities:
        a = source.index(value, at)
        spans.append((a, a + len(value), token))
        out += source[at:a] + token
        at = a + len(value)
    return (hashlib.sha256(source.encode()).hexdigest(), text or out + source[at:], {t: v for t, _, v in entities}, {t: k for t, k, _ in entities}, spans, source)


def test_repair(spark):
    schema = "hash string, text string, map map<string,string>, types map<string,string>, spans array<struct<start:int,end:int,token:string>>, source string"
    source = "Ceza: 3 yıl. Davacı: Ayşe Demir. 24 ve 25 maddeleri. Metni anlaşılır hâle getirin."
    entities = [("d", "KISI", "3 yıl"), ("p", "KISI", "Ayşe Demir"), ("x", "PLAKA", "24 ve 25"), ("h", "KISI", "hâle getirin")]
    rows = [snapshot(source, entities), snapshot(source, entities, "other"), ("0", *snapshot(source, entities)[1:]), (None, None, None, None, None, None)]
    out = repair(spark.createDataFrame(rows, schema).repartition(1), preserve_legal_facts=True)
    good, other, wrong, empty = out.collect()
    got = {r["text"]: r for r in (good, other, wrong, empty)}
    fixed = got["Ceza: 3 yıl. Davacı: p. 24 ve 25 maddeleri. Metni anlaşılır hâle getirin."]
    assert fixed["map"] == {"p": "Ayşe Demir"} and fixed["types"] == {"p": "KISI"} and len(fixed["spans"]) == 1
    assert len(got["other"]["spans"]) == 4 and len(got[rows[2][1]]["spans"]) == 4 and got[None]["map"] is None
    assert repair(out, preserve_legal_facts=True).where("size(spans) = 1").count() == 1


def test_occurrences():
    assert occurrences("Ali \n Kaya, Ali Kaya; Ali Kayacı", "Ali Kaya") == [(0, 10), (12, 20)]
    for bad in ("", "Veli", "li"):
        with pytest.raises(SourceMismatch):
            occurrences("Ali Kaya", bad)


def test_chunks_cover_the_text():
    text = "Şu ğöz " * 100
    parts = chunks(text, 64, 8)
    assert all(len(p.encode()) <= 64 and text[a : a + len(p)] == p for a, p in parts)
    assert parts[0][0] == 0 and parts[-1][0] + len(parts[-1][1]) == len(text) and all(x + len(p) >= y for (x, p), (y, _) in zip(parts, parts[1:], strict=False))


def echo(request):
    return {"entities": [{"type": "KISI", "text": "Ali Kaya", "occurrence": 1}] if "Ali Kaya" in request["text"] else []}


def lying(request):
    return {"entities": [{"type": "KISI", "text": "Nobody", "occurrence": 1}]}


def test_model_detection(spark):
    assert ask("x " * 100 + "Ali Kaya " + "y " * 100, Model(echo, ("KISI",), chunk=80, overlap=20)) == [("KISI", 200, 208)]
    with pytest.raises(DetectionFailed):
        ask("Ali Kaya", Model(lying, ("KISI",)))
    with pytest.raises(DetectionFailed):
        ask("Ali Kaya", Model(lambda r: {"x": 1}, ("KISI",)))
    docs = spark.createDataFrame([(1, "Sayın Ali Kaya"), (2, ""), (3, None)], "id long, text string")
    assert [(r["id"], r["value"]) for r in detected(docs, "id", Model(echo, ("KISI",))).collect()] == [(1, "Ali Kaya")]
    failed = detected(docs, "id", Model(lying, ("KISI",), fail=False)).collect()
    assert [(r["id"], r["failed"], r["start"]) for r in failed] == [(1, True, None)]


def test_coverage():
    assert covered([(0, 3)], [(0, 8, 1.0)]) == [(0, 8, 0)]
    assert covered([(0, 4), (4, 8)], [(0, 8, 1.0)]) == [(0, 4, None), (4, 8, None)]
    assert covered([(0, 3), (9, 12)], [(2, 5, 1.0), (4, 8, 3.0)]) == [(0, 8, 1), (9, 12, None)]
    assert covered([(0, 5)], [(0, 5, 9.0), (3, 8, 1.0)]) == [(0, 8, 0)]  # the model's own reading of a chosen span may name the group


def words(request):
    """Finds fixed values; fails on request, and on texts that are too long."""
    if "broken" in request["text"]:
        raise DetectionFailed("broken")
    if len(request["text"]) > 100:
        raise TooLong("too long")
    known = (("SAGLIK", "şeker hastası"), ("KISI", "Ayşe Demir Öz"), ("TCKN", "12345678901"), ("KISI", "hâle getirin"), ("PLAKA", "24 ve 25"))
    return {"entities": [{"type": k, "text": v, "occurrence": 1} for k, v in known if v in request["text"]]}


def test_rules_and_model_in_one_call(spark):
    model = Model(words, ("SAGLIK", "KISI", "TCKN", "PLAKA"), fail=False, overlap=20)
    texts = [
        "Davacı Ayşe Demir şeker hastası, a@b.com", "Ayşe Demir Öz geldi", "​şeker​ hastası\r\nson", "broken a@b.com", "metni anlaşılır hâle getirin, 24 ve 25 maddeleri",
        "no 12345678901", "x " * 60 + "şeker hastası", "", None,
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r["id"]: r for r in validate(redact(docs, Options(model=model))).collect()}
    assert [got[i]["redacted"] for i in range(9)] == [
        "Davacı [KISI] [SAGLIK], [EPOSTA]", "[KISI] geldi", "​[SAGLIK]\r\nson", "broken [EPOSTA]", texts[4], texts[5], "x " * 60 + "[SAGLIK]", "", None,
    ]
    assert [got[i]["risk"] for i in (0, 3, 4)] == ["medium", "high", "low"] and [got[i]["needs_review"] for i in (0, 3, 4, 7)] == [True, True, False, False]
    assert [got[i]["model_failed"] for i in (0, 3)] == [False, True] and got[3]["status"] == "review_required"
    only = redact(docs, Options(model=model, only=("EPOSTA",)))  # no wanted type is the model's: it is not asked
    assert "model_failed" not in only.columns and only.where("id = 0").first()["redacted"].endswith("şeker hastası, [EPOSTA]")


def test_covering_span(spark):
    model = Model(lambda r: {"entities": [{"type": "SAGLIK", "text": "tel 0532 123", "occurrence": 1}] if "tel 0532 123" in r["text"] else []}, ("SAGLIK",))
    docs = spark.createDataFrame([(1, "Cep tel 0532 123 45 67 son")], "id int, text string")
    row = redact(docs, Options(model=model)).first()
    assert row["redacted"] == "Cep [SAGLIK] son" and row["spans"][0]["value"] == "tel 0532 123 45 67" and row["spans"][0]["status"] == "not_checked"


def test_tokens_that_stand_in_the_text(spark):
    rows = [(1, "[EPOSTA_1] [EPOSTA_3] [EPOSTA_03] a@b.com c@d.com a@b.com"), (2, "[X_EPOSTA_1] a@b.com"), (3, "")]
    out = redact(spark.createDataFrame(rows, "id int, text string"), Options(strategy="tag"))
    got = {r["id"]: r["redacted"] for r in out.collect()}
    assert got == {1: "[EPOSTA_1] [EPOSTA_3] [EPOSTA_03] [EPOSTA_2] [EPOSTA_4] [EPOSTA_2]", 2: "[X_EPOSTA_1] [EPOSTA_1]", 3: ""}
    assert {r["id"]: r["unmasked"] for r in unmask(out, token_map(out, "id"), "id").collect()} == dict(rows)
