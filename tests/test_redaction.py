from itertools import combinations
from random import Random

import pytest
from pyspark.sql import functions as F

from veilspan.functions import canonical, checksums, masks
from veilspan.functions.text import normalise
from veilspan.operators.resolve import best_subset, policy
from veilspan.plans.redaction import Options, redact, token_map, unmask


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("check", "text", "valid"),
    [
        ("tckn", "43650391326", True), ("tckn", "12345678901", False), ("tckn", "03650391326", False), ("tckn", "4365039132", False),
        ("iban", "TR330006100519786457841326", True), ("iban", "TR33 0006 1005 1978 6457 8413 26", True), ("iban", "TR990006100519786457841326", False), ("iban", "TR12345", False),
        ("luhn", "4111111111111111", True), ("luhn", "4111111111111112", False), ("luhn", "123", False), ("vkn", "5321234567", False),
    ],
)
def test_checksums(spark, check, text, valid):
    assert value(spark, checksums.VALIDATORS[check](F.lit(text))) is valid


def test_masks_and_canonical_forms(spark):
    assert value(spark, masks.partial(F.lit("43650391326"), F.lit("TCKN"))) == "436*****326"
    assert value(spark, masks.partial(F.lit("ali@example.com"), F.lit("EPOSTA"))) == "a***i@example.com"
    assert value(spark, masks.partial(F.lit("10.2.3.4"), F.lit("IP_ADRESI"))) == "10.2.*.*"
    assert value(spark, masks.asterisk(F.lit("a b"))) == "* *"
    assert value(spark, canonical.phone(F.lit("0 (532) 123 45 67"))) == "+905321234567"
    assert value(spark, normalise(F.lit("a b​c\r\nd’"))) == "a bc\nd'"


def test_redaction(spark):
    rows = [(1, "TCKN: 43650391326, bare 12345678901"), (2, "mail a.b@example.com. m. 123"), (3, ""), (4, "Tel: 0532 123 45 67 ve TR33 0006 1005 1978 6457 8413 26"), (5, "Esas No: 2024/12")]
    got = dict(redact(spark.createDataFrame(rows, "id long, text string")).select("id", "redacted").collect())
    assert got[1] == "TCKN: [TCKN], bare 12345678901"
    assert got[2] == "mail [EPOSTA]. m. 123"
    assert got[3] == ""
    assert got[4] == "Tel: [TELEFON] ve [IBAN]"
    assert got[5] == "Esas No: [ESAS_NO]"


def test_tags_and_unmask(spark):
    text = "a@example.com b@example.com a@example.com"
    out = redact(spark.createDataFrame([(1, text)], "id long, text string"), Options(strategy="tag"))
    assert out.first()["redacted"] == "[EPOSTA_1] [EPOSTA_2] [EPOSTA_1]"
    assert unmask(out, token_map(out, "id"), "id").first()["unmasked"] == text


def test_best_subset_is_optimal():
    r = Random(3)
    for _ in range(300):
        spans = [(a, a + r.randint(1, 6), float(r.randint(1, 20))) for a in (r.randint(0, 12) for _ in range(r.randint(0, 7)))]
        fits = lambda c: all(x[1] <= y[0] or y[1] <= x[0] for x, y in combinations(c, 2))
        best = max(sum(s[2] for s in c) for k in range(len(spans) + 1) for c in combinations(spans, k) if fits(c))
        got = [spans[i] for i in best_subset(spans)]
        assert fits(got) and sum(s[2] for s in got) == best


def test_options_are_checked():
    for bad in ({"policy": "none"}, {"strategy": "none"}, {"only": ("NONE",)}):
        with pytest.raises(ValueError):
            Options(**bad)
    assert policy("strict").min_confidence == 0.5


def test_entry_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
