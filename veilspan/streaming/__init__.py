"""Redaction of streams: every stage works on one row, so a streaming DataFrame passes through as it is; sessions keep a token table."""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..plans.redaction import Options, redact
from ..plans.sessions import redact_sessions
from ..sources import safe

#: The token table of a stream, but for the partition column ``batch``.
TOKENS = "token string, entity_type string, canonical string, original string, index long"


def redact_stream(stream: DataFrame, options: Options = Options()) -> DataStreamWriter:
    return safe(redact(stream, options)).writeStream.outputMode("append")


def read_tokens(like: DataFrame, path: str, session: str) -> DataFrame:
    """The token table at ``path`` (sensitive), empty before the first batch; ``like`` has the session column."""
    spark = like.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    schema = f"`{session}` {like.schema[session].dataType.simpleString()}, {TOKENS}, batch long"
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def redact_session_stream(
    stream: DataFrame, key: str, session: str, seq: str, tokens: str, sink: Callable[[DataFrame, int], None], options: Options = Options(), text: str = "text"
) -> DataStreamWriter:
    """Sessions over a stream: values met in an earlier batch keep their token. ``sink`` takes each redacted batch and its id.

    New tokens are written to the folder ``tokens``, which all executors share, as the batch's own partition
    before the sink is called. A batch that is run again reads only earlier batches' tokens and overwrites its
    own, so it gives the same rows; a sink that overwrites by id makes the whole exactly-once. No session is
    held in one task. ``key`` is unique within a batch.
    """

    def run(batch: DataFrame, number: int) -> None:
        known = read_tokens(batch, tokens, session).where(F.col("batch") < number).drop("batch")
        out, new = redact_sessions(batch, key, session, seq, options, text, known)
        new.write.mode("overwrite").parquet(f"{tokens.rstrip('/')}/batch={number}")
        sink(safe(out), number)

    return stream.writeStream.foreachBatch(run)
