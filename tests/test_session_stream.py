from pyspark.sql import functions as F

from veilspan.plans.redaction import Options
from veilspan.plans.sessions import parse_token, redact_sessions, unmask_sessions
from veilspan.streaming import read_tokens, redact_session_stream

SCHEMA = "id long, s string, text string"


def plain(text):
    return text.replace("⟦RDT:", "<").replace("⟧", ">")


def test_numbers_start_above_tokens_in_the_text(spark):
    rows = [(1, "a1", "⟦RDT:a1:EPOSTA:7⟧ ⟦RDT:b2:EPOSTA:9⟧ ⟦RDT:a1:EPOSTA:99999999999999999999⟧ x@y.com"), (2, "a1", "z@y.com x@y.com"), (3, "b2", "x@y.com"), (4, "b2", None), (5, None, "x@y.com")]
    out, _ = redact_sessions(spark.createDataFrame(rows, SCHEMA), "id", "s", "id", Options(only=("EPOSTA",)))
    got = {r["id"]: r["redacted"] and plain(r["redacted"]) for r in out.collect()}
    assert got[1].endswith("> <a1:EPOSTA:8>") and got[2] == "<a1:EPOSTA:9> <a1:EPOSTA:8>" and got[3] == "<b2:EPOSTA:1>" and got[4] is None and got[5] == "[EPOSTA]"
    assert spark.range(1).select(parse_token(F.lit("[A_99999999999999999999]")).alias("t")).first()["t"]["index"] is None


def test_sessions_over_a_stream(spark, tmp_path):
    source, tokens, marks = str(tmp_path / "in"), str(tmp_path / "tokens"), str(tmp_path / "marks")
    batches = [[(1, "a1", "x@y.com, z@y.com"), (2, "b2", "z@y.com")], [(3, "a1", "new@y.com Z@Y.com x@Y.com"), (4, "c3", "")], [(5, "b2", "q@y.com z@y.com")]]
    got = {}

    def sink(df, number):
        assert "text" not in df.columns and "spans" not in df.columns
        got.update({r["id"]: (r["s"], r["redacted"]) for r in df.collect()})

    def drain():
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        query = redact_session_stream(stream, "id", "s", "id", tokens, sink, Options(only=("EPOSTA",))).option("checkpointLocation", marks).trigger(availableNow=True).start()
        query.awaitTermination()
        assert query.exception() is None

    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        drain()
    assert {i: plain(t) for i, (_, t) in got.items()} == {
        1: "<a1:EPOSTA:1>, <a1:EPOSTA:2>", 2: "<b2:EPOSTA:1>", 3: "<a1:EPOSTA:3> <a1:EPOSTA:4> <a1:EPOSTA:1>", 4: "", 5: "<b2:EPOSTA:2> <b2:EPOSTA:1>",
    }
    redacted = spark.createDataFrame([(i, s, t) for i, (s, t) in got.items()], "id long, s string, redacted string")
    table = read_tokens(redacted, tokens, "s")
    back = {r["id"]: r["unmasked"] for r in unmask_sessions(redacted, table, "id", "s").collect()}
    assert back == {1: "x@y.com, z@y.com", 2: "z@y.com", 3: "new@y.com Z@y.com x@y.com".replace("Z@y.com", "Z@Y.com"), 4: "", 5: "q@y.com z@y.com"}
