import pytest
from pyspark.sql import functions as F

from veilspan.operators.model_detector import DetectionFailed
from veilspan.plans import config
from veilspan.plans.redaction import NOTHING, Options, numbers, redact, report_summary
from veilspan.sources import safe, sensitive
from veilspan.sources.http_model import Budget, planned, supported, thinking


def test_partial_settings_keep_the_defaults(spark):
    own = config.merged(config.DEFAULTS, {"policy_id": "custom_policy", "token_format": "legacy"})
    assert own["policy_id"] == "custom_policy" and own["exclude_patterns"] == config.DEFAULTS["exclude_patterns"]
    df = spark.createDataFrame([(1, "Müvekkil TCKN: 43650391326 olup IBAN: TR33 0006 1005 1978 6457 8413 26")], "id int, text string")
    assert redact(df, config.options(own)).first()["redacted"] == "Müvekkil TCKN: [TCKN_1] olup IBAN: [IBAN_1]"
    named = config.options(config.merged(config.DEFAULTS, {"name_redaction": {"custom_names": ["Zartuk", "Bortuk"]}}))
    df = spark.createDataFrame([(1, "Toplantıya Zartuk Demir katıldı.")], "id int, text string")
    assert redact(df, named).first()["redacted"] == "Toplantıya [KISI_1] katıldı."


def test_merging():
    base = {"patterns": [1, 2], "exclude_patterns": ["a", "b"], "name_redaction": {"enabled": True, "gazetteer": True}, "llm": {"model": "x", "options": {"num_ctx": 1, "seed": 2}}}
    joined = lambda **own: config.merged(base, own)
    assert joined(patterns=[3])["patterns"] == [1, 2, 3] and joined(patterns=[3], patterns_mode="prepend")["patterns"] == [3, 1, 2] and joined(patterns=[3], patterns_mode="replace")["patterns"] == [3]
    assert joined(exclude_patterns=["b", "c"])["exclude_patterns"] == ["a", "b", "c"] and joined(exclude_patterns=["c"], exclude_patterns_mode="replace")["exclude_patterns"] == ["c"]
    assert joined(name_redaction={"enabled": False})["name_redaction"] == {"enabled": False, "gazetteer": True}
    assert joined(llm={"options": {"num_ctx": 9}})["llm"] == {"model": "x", "options": {"num_ctx": 9, "seed": 2}}
    for bad in ({"unknown_key": 1}, {"llm": 3}):
        with pytest.raises(ValueError):
            config.merged(base, bad)
    assert config.merged(base, {"unknown_key": 1}, strict=False)["unknown_key"] == 1
    for bad in ({"token_format": "x"}, {"default_strategy": "x"}, {"policy": "x"}):
        with pytest.raises(ValueError):
            config.options(bad)
    assert config.options({"policy": "logs"}, policy="strict").policy == "strict"  # the call goes first


def test_files(spark, tmp_path):
    (tmp_path / "own.json").write_text('{\n  "policy": "strict"\n}')
    (tmp_path / "names.txt").write_text("# names\nZartuk\n\n Bortuk \n")
    assert config.read(spark, f"file://{tmp_path}/own.json") == {"policy": "strict"}
    assert config.read_names(spark, f"file://{tmp_path}/names.txt") == {"zartuk", "bortuk"}
    with pytest.raises(ValueError):
        config.read_names(spark, f"file://{tmp_path}/names.txt", most=2)


def test_limits_and_columns(spark):
    df = spark.createDataFrame([(1, "a@b.co " * 9)], "id int, text string")
    with pytest.raises(Exception, match="more than 20 bytes"):
        redact(df, Options(max_bytes=20)).collect()
    out = redact(df, Options(only=("EPOSTA",), max_bytes=100))
    assert "text" not in safe(out).columns and {"text", "spans"} <= set(sensitive(out).columns)
    with pytest.raises(ValueError):
        sensitive(df)


def test_numbers_pass_tokens_that_stand_in_the_text():
    assert numbers(["A", "B", "A", "A"], ["x", "x", "y", "x"], []) == [1, 1, 2, 1]
    assert numbers(["A", "A", "A"], ["x", "y", "z"], ["[A_1]", "[A_3]", "[B_2]"]) == [2, 4, 5]


def test_report_sentence(spark):
    span = "array<struct<entity_type:string>>"
    rows = spark.createDataFrame([([("KISI",), ("HESAP_NO",), ("KISI",)],), ([("HESAP_NO",), ("HESAP_NO",), ("OZEL",)],), ([],), (None,)], f"spans {span}")
    got = [r["x"] for r in rows.select(report_summary(F.col("spans")).alias("x")).collect()]
    assert got == ["2 kişi adı, 1 banka/finans hesap numarası redakte edildi.", "2 hesap numarası, 1 OZEL redakte edildi.", NOTHING, None]


def test_budget_and_plan():
    budget, types = Budget(context=2048, output=256), ["KISI"]
    room = budget.chunk("prompt", types)
    assert budget.fits("prompt", types, "x" * (room - 8)) and not budget.fits("prompt", types, "x" * (room + 8)) and not budget.fits("prompt", types, "\n" * (room - 8))
    assert budget.chunk("prompt", types, most=100) == 100
    with pytest.raises(DetectionFailed):
        Budget(context=600, output=256).chunk("prompt", types)
    for bad in ({"margin": 0.6}, {"bytes_a_token": 9}):
        with pytest.raises(ValueError):
            Budget(**bad)
    text = "".join(f"line {i}\n" * (1 if i < 300 else 3) for i in range(600)) + "\n" * 3000
    parts = planned(text, room, 40, lambda p: budget.fits("prompt", types, p))
    assert all(budget.fits("prompt", types, p) and text[a : a + len(p)] == p for a, p in parts)
    assert parts[0][0] == 0 and parts[-1][0] + len(parts[-1][1]) == len(text) and all(x + len(p) >= y for (x, p), (y, _) in zip(parts, parts[1:], strict=False))
    with pytest.raises(DetectionFailed):
        planned("x" * 1000, 500, 10, lambda p: False)


def test_thinking():
    assert thinking({}) is None and thinking({"think": True}) is True and thinking({"reasoning_effort": "none"}) is False
    assert thinking({"think": True, "reasoning_effort": "high"}) == "high" and thinking({"think": "low", "thinking": "low"}) == "low"
    for bad in ({"think": True, "enable_thinking": False}, {"think": "low", "reasoning_effort": "high"}, {"think": False, "reasoning_effort": "high"}, {"enable_thinking": "yes"}, {"reasoning_effort": True}, {"think": " "}, {"think": 3}):
        with pytest.raises(ValueError):
            thinking(bad)
    levels = {"thinking": {"values": ["low", "high"], "default": "low"}}
    assert supported(None, {}) is None and supported(True, {}) is True and supported(True, levels) == "low" and supported("high", levels) == "high" and supported(False, {"thinking": {"values": [True, False]}}) is False
    for think, metadata in (("high", {}), ("max", levels), (False, levels), (True, {"thinking": {"values": ["low"]}}), (True, {"thinking": []}), (True, {"thinking": {"values": []}})):
        with pytest.raises(DetectionFailed):
            supported(think, metadata)
