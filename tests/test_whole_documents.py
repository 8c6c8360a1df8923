"""The registered queries over documents and pages against a plain implementation, a document at a time."""

from collections import Counter

import pytest
import regex
from pyspark.sql import functions as F

from veilspan import queries
from veilspan.operators.contextual import addresses, contextual_names, dictionary_names, signs
from veilspan.operators.detect import EXCLUDED, RULES
from veilspan.operators.resolve import POLICIES
from veilspan.operators.validate import PLACEHOLDER, RESIDUAL, REVIEW_WORDS

SF = "/root/testdata/sf0.001"
digits = lambda v: regex.sub("[^0-9]", "", v)


def luhn(v):
    n = [int(c) for c in digits(v)]
    return 13 <= len(n) <= 19 and sum(sum(divmod(2 * d, 10)) if i % 2 else d for i, d in enumerate(reversed(n))) % 10 == 0


def tckn(v):
    n = [int(c) for c in digits(v)]
    return n[0] != 0 and (sum(n[0:9:2]) * 7 - sum(n[1:8:2])) % 10 == n[9] and sum(n[:10]) % 10 == n[10]


def vkn(v):
    n, total = [int(c) for c in digits(v)], 0
    for i in range(9):
        c = (n[i] + 9 - i) % 10
        total += 9 if c == 9 else c * 2 ** (9 - i) % 9
    return (10 - total % 10) % 10 == n[9]


def email(v):
    return not regex.search(r"^\.|\.\.|\.@|@[.-]|-\.|\.-", v)


def iban(v):
    x = regex.sub(r"[\s -]", "", v).upper()
    return int(x[4:] + "2927" + x[2:4]) % 97 == 1


CHECKS = {"TCKN_CHECKSUM": tckn, "VKN_10": vkn, "IBAN_MOD97": iban, "KREDI_KARTI_LUHN": luhn, "EPOSTA_RFC": email, "IP_V4": lambda v: not regex.search(r"(^|\.)0[0-9]", v), "IP_V6": lambda v: True}


def found(text):
    """(start, end, value, type, rule, status, labelled, confidence, priority), by position."""
    out, banned = set(), [m.span() for p in EXCLUDED for m in regex.finditer("(?i)" + p, text)]
    for rule in RULES:
        for pattern in rule.patterns:
            for m in regex.finditer(pattern, text):
                v, a = m[0], m.start()
                if rule.entity_type == "EPOSTA":
                    v = v.rstrip(".,;:!?")
                if rule.entity_type == "TELEFON" and not 10 <= len(digits(v)) <= 14 or rule.entity_type == "IBAN" and len(regex.sub(r"[\s -]", "", v)) != 26:
                    continue
                before = text[max(0, a - rule.window) : a]
                labelled = rule.entity_type in ("ESAS_NO", "KARAR_NO", "DOSYA_NO") or bool(rule.label and regex.search(rule.label, before))
                confidence, priority, status = rule.confidence[not labelled], rule.priority[not labelled], "not_checked"
                if rule.rule_id in CHECKS:
                    status = "valid" if CHECKS[rule.rule_id](v) else "invalid"
                    confidence = rule.valid_confidence if status == "valid" else confidence
                if rule.entity_type == "VKN":
                    priority = 88 if labelled or status == "valid" else 70 if v[0] == "5" else 80
                if rule.entity_type == "TELEFON":
                    confidence -= 0.15 * bool(regex.search(r"(?:\+90|0090)\s*0[2-5]", v))
                    priority = 89 if labelled else 86 if "(" in v or "+90" in v else 82
                if rule.entity_type == "PLAKA":
                    confidence = 0.95 if labelled else 0.85 if regex.search("[ -]", v) else 0.7
                out.add((a, a + len(v), v, rule.entity_type, rule.rule_id, status, labelled, confidence, priority))
    assert not contextual_names(text) and not addresses(text) and not dictionary_names(text, queries.Options().first_names)  # none in these tables
    return sorted(c for c in out if not any(c[0] < b and c[1] > a for a, b in banned))


def points(c):
    return max(0.1, c[8] * 100 + {"valid": 500, "invalid": -350}.get(c[5], 0) + 400 * c[6] + c[7] * 100 + min(len(c[2].encode()), 30))


def chosen(text, name="balanced"):
    """The disjoint candidates with the highest sum, group of overlapping ones by group."""
    p = POLICIES[name]
    some = [c for c in found(text) if (c[6] or c[7] >= p.min_confidence) and (not p.valid_only or c[5] == "valid") and (not p.drop_invalid or c[6] or c[5] != "invalid")]
    best = {0: (0.0, [])}
    cuts = sorted({0, *(c[0] for c in some), *(c[1] for c in some)})
    for i, at in enumerate(cuts):
        total, kept = max([best[at]] if at in best else [best[cuts[i - 1]]], key=lambda x: x[0])
        if i and best[cuts[i - 1]][0] > total:
            total, kept = best[cuts[i - 1]]
        best[at] = (total, kept)
        for c in some:
            if c[0] == at and (c[1] not in best or best[c[1]][0] < total + points(c)):
                best[c[1]] = (total + points(c), [*kept, c])
    return best[cuts[-1]][1]


def replaced(text, spans, by):
    out, at = "", 0
    for c in spans:
        out, at = out + text[at : c[0]] + by(c), c[1]
    return out + text[at:]


def label(c):
    return f"[{c[3]}]"


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def rows(spark, name):
    return [tuple(r) for r in queries.QUERIES[name](spark, SF).collect()]


def test_detected_and_redacted(spark, docs):
    spans = {d: found(t) for d, t in docs.items()}
    want = sorted((d, c[3], c[4], len(docs[d][: c[0]].encode()), len(docs[d][: c[1]].encode()), c[5], round(c[7], 6), c[8]) for d, cs in spans.items() for c in cs)
    assert sorted((*r[:6], round(r[6], 6), r[7]) for r in rows(spark, "detect_spans")) == want and want
    picked = {d: chosen(t) for d, t in docs.items()}
    redacted = {d: replaced(t, picked[d], label) for d, t in docs.items()}
    invalid = {d: sum(c[5] == "invalid" for c in picked[d]) for d in docs}
    assert sorted(rows(spark, "redact_all")) == sorted((d, redacted[d], len(picked[d]), "medium" if invalid[d] else "low", invalid[d]) for d in docs)
    checked = []
    for d, t in docs.items():
        bare = regex.sub(PLACEHOLDER, " ", redacted[d])
        left = [k for k, p in RESIDUAL if regex.search(p, bare)]
        word = next((w for w in REVIEW_WORDS if w in t.lower()), None)
        checked.append((d, left, word, "high" if left else "medium" if word or invalid[d] else "low", "review_required" if left else "complete", bool(left or word)))
    assert sorted(map(str, rows(spark, "residual_check"))) == sorted(map(str, checked))


def test_counts_tokens_and_sentences(spark, docs):
    picked = {d: chosen(t) for d, t in docs.items()}
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert sorted(rows(spark, "counts_by_type")) == sorted((*k, n) for k, n in Counter((langs[d], c[3]) for d, cs in picked.items() for c in cs).items())
    names = {"EPOSTA": "e-posta", "TELEFON": "telefon", "IP_ADRESI": "IP adresi", "KREDI_KARTI": "kredi kartı"}
    want, tokens = [], []
    for d, cs in picked.items():
        counts = Counter(c[3] for c in cs)
        want.append((d, ", ".join(f"{n} {names.get(k, k)}" for k, n in counts.items()) + " redakte edildi." if cs else "Belgede TCKN, IBAN, telefon, e-posta, kişi adı vb. taranan kişisel veri türleri bulunamadı."))
        seen = {}
        for c in cs:
            key = c[2].partition("@")[0] + "@" + c[2].partition("@")[2].lower() if c[3] == "EPOSTA" else canonical(c)
            if (c[3], key) not in seen:
                n = sum(k[0] == c[3] for k in seen) + 1
                seen[c[3], key] = n
                tokens.append((d, f"[{c[3]}_{n}]", c[3], c[2]))
    assert sorted(rows(spark, "summary")) == sorted(want)
    assert sorted(rows(spark, "tokens")) == sorted(tokens) and tokens
    effects = Counter()
    for name in POLICIES:
        for t in docs.values():
            cs = chosen(t, name)
            risk = "medium" if any(c[5] == "invalid" for c in cs) else "low"
            effects[name, risk, "docs"] += 1
            effects[name, risk, "spans"] += len(cs)
    assert sorted(rows(spark, "policy_comparison")) == sorted((n, r, effects[n, r, "docs"], effects[n, r, "spans"]) for n, r, what in effects if what == "docs")


def canonical(c):
    if c[3] == "TELEFON":
        d = digits(c[2])
        return d[2:] if d.startswith("90") and len(d) == 12 else d[1:] if d.startswith("0") and len(d) == 11 else d[4:] if d.startswith("0090") else d
    return digits(c[2]) if c[3] in ("TCKN", "VKN", "KREDI_KARTI", "MERSIS") else c[2]


def test_pages_and_partial_masks(spark, docs):
    import hashlib

    pages = {r["page_id"]: r["html"] or "" for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    want = []
    for d, t in pages.items():
        cs = chosen(t)
        want.append((d, hashlib.sha256(replaced(t, cs, label).encode()).hexdigest(), len(cs), "medium" if any(c[5] == "invalid" for c in cs) else "low"))
    assert sorted(rows(spark, "redact_pages")) == sorted(want)

    def mask(c):
        v, d = c[2], digits(c[2])
        if c[3] == "EPOSTA":
            user, host = v.split("@", 1)
            return ("*" if len(user) <= 1 else user[0] + "*" if len(user) == 2 else user[0] + "***" + user[-1]) + "@" + host
        if c[3] == "IP_ADRESI":
            return ".".join(v.split(".")[:2]) + ".*.*"
        if c[3] == "KREDI_KARTI":
            return "**** **** **** " + d[-4:]
        if c[3] == "TELEFON":
            return ("" if len(d) <= 10 else "+90 " if len(d) == 12 and d.startswith("90") else "0") + d[-10:-7] + " *** ** " + d[-2:]
        cut = {"TCKN": (3, "*****", 3), "VKN": (3, "****", 3), "MERSIS": (4, "********", 4)}[c[3]]
        return d[: cut[0]] + cut[1] + d[-cut[2] :]

    assert sorted(rows(spark, "redact_partial")) == sorted((d, replaced(t, chosen(t), mask)) for d, t in docs.items())


def test_signs_cover_all_names(spark):
    from random import Random

    r, names = Random(4), frozenset({"ali", "yıldız", "i̇pek", "ipek", "can"})
    parts = ["Sayın", "Davacı", "davalı", "Av.", "ADI SOYADI", "İsim", "isim:", "Müvekkilim", "Prof. Dr.", "Dr.", "Ali", "ALİ", "Yıldız", "İpek", "Can'ın", "Kaya", "Öz", "A.", "ve", "geldi", "-", ":", "\n", "kiraya veren", "İhbar Olunan"]
    texts = [" ".join(r.choice(parts) for _ in range(r.randint(1, 9))) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for dictionary in (True, False):
        told = dict(df.select("id", signs(F.col("text"), "KISI", names, dictionary)).collect())
        hits = [i for i, t in enumerate(texts) if contextual_names(t) or (dictionary and dictionary_names(t, names))]
        assert hits and all(told[i] for i in hits)


def test_many_matches_in_one_text(spark):
    from time import monotonic

    from veilspan.plans.redaction import Options, redact

    text = " ".join(f"u{i}@example.com" for i in range(20_000))
    df = spark.createDataFrame([(1, text)], "id int, text string")
    start = monotonic()
    for strategy, want in (("label", " ".join(["[EPOSTA]"] * 20_000)), ("tag", " ".join(f"[EPOSTA_{i + 1}]" for i in range(20_000)))):
        assert redact(df, Options(only=("EPOSTA",), strategy=strategy)).first()["redacted"] == want
    assert monotonic() - start < 120
