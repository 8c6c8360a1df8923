"""Shared helpers of the training-data operators: reading tables, Arrow slices, shared storage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: The characters between words: bytes.split() splits on exactly these.
SPACE = b" \t\n\x0b\x0c\r"
#: Text handled at once inside a Python task.
SLICE_BYTES = 8 << 20


#: A table in fewer files than cores and below this size a core is shared among them.
SMALL = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; a small one in few files, whose scan would leave cores idle, is dealt to all of them."""
    df, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(2 * cores) if size < cores * SMALL and len(df.inputFiles()) < cores else df


def ddl(schema: str) -> T.StructType:
    return T.StructType.fromDDL(schema)


def slices(batches: Iterator[pa.RecordBatch], names: list[str], text: str = "text") -> Iterator[dict]:
    """Cuts Arrow batches into dicts of column -> list of at most SLICE_BYTES of ``text`` (one row at least).

    Memory stays bounded whatever a batch holds. Texts arrive as bytes, a null text as b"".
    """
    for batch in batches:
        n, at = batch.num_rows, 0
        cols = {c: batch.column(i) for i, c in enumerate(names)}
        texts = cols[text].cast(pa.large_binary() if pa.types.is_large_string(cols[text].type) else pa.binary())
        while at < n:
            rows, size, end = [], 0, at
            while end < n and (end == at or size < SLICE_BYTES):
                rows.append(texts[end].as_py() or b"")
                size += len(rows[-1])
                end += 1
            yield {c: rows if c == text else v.slice(at, end - at).to_pylist() for c, v in cols.items()}
            at = end


def record(out: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x := out[f.name], pa.Array) else pa.array(x, type=f.type) for f in schema], schema=schema)


def map_slices(df: DataFrame, fn: Callable[[dict], dict | None], schema: str, text: str = "text") -> DataFrame:
    """Runs ``fn`` over the slices of each partition: a dict of column -> list in, column -> list out."""
    out_schema, names = to_arrow_schema(ddl(schema)), df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, names, text):
            if (out := fn(part)) is not None:
                yield record(out, out_schema)

    return df.mapInArrow(run, schema)


def row_slices(batch: pa.RecordBatch, at: int) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Slices of a batch with the bytes of its column ``at`` (null as None), at most SLICE_BYTES each (one row at least)."""
    column, lo = batch.column(at), 0
    column = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    while lo < batch.num_rows:
        texts, size = [], 0
        while lo + len(texts) < batch.num_rows and (not texts or size < SLICE_BYTES):
            texts.append(column[lo + len(texts)].as_py())
            size += len(texts[-1] or b"")
        yield batch.slice(lo, len(texts)), texts
        lo += len(texts)


def kept_rows(df: DataFrame, fn: Callable[[list[bytes]], list[bool]], text: str = "text") -> DataFrame:
    """The rows, all columns as they are, for whose texts (null as b"") ``fn`` is true."""
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in row_slices(batch, at):
                yield part.filter(pa.array(fn([t or b"" for t in texts]), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def changed_texts(df: DataFrame, fn: Callable[[str], str], text: str = "text") -> DataFrame:
    """The rows with ``fn`` of their texts; a null text stays null, other columns are as they are."""
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in row_slices(batch, at):
                new = pa.array([None if t is None else fn(t.decode()) for t in texts], part.schema.field(at).type)
                yield part.set_column(at, part.schema.field(at), new)

    return df.mapInArrow(run, df.schema)


def own_name(word: str) -> str:
    """A column name that no table has."""
    return f"_{word}_{uuid.uuid4().hex}"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a local session may do without it."""
    sc = spark.sparkContext
    if not (path := sc.getConf().get("spark.checkpoint.dir")):
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not (path := _OWN.get(sc.applicationId)):
            path = _OWN[sc.applicationId] = tempfile.mkdtemp(prefix="veilspan-")
    return path


_OWN: dict[str, str] = {}


def stash(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to a table in the shared folder and reads it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.stash_path = path
    return back


def discard(df: DataFrame) -> None:
    """Deletes a stash that no later plan reads."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.stash_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def crc32_of_id(col: Column) -> Column:
    """crc32 of an id's decimal text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary"))


def text_hash() -> Column:
    """Tells texts apart, whatever their ids; a null text counts as empty."""
    return F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)


def ranked(df: DataFrame, order: list[Column], weight: str | None, name: str) -> tuple[DataFrame, int, int]:
    """Adds rank (rows before, from 0) and before (weight before) in a total order, without a global task.

    Rows are range-partitioned by ``order``, numbered inside each partition, and shifted by the sums of the
    partitions before; only one row per partition reaches the driver. The numbered rows are stashed, since
    range bounds are sampled anew each time. Returns them with the total count and weight.
    """
    spark = df.sparkSession
    local = T.StructType([*df.schema.fields, *ddl("part int, rank long, before long").fields])
    arrow = to_arrow_schema(local)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyspark import TaskContext

        part, rows, total = TaskContext.get().partitionId(), 0, 0
        for b in batches:
            w = np.asarray(b.column(b.schema.get_field_index(weight)), dtype=np.int64) if weight else np.zeros(b.num_rows, np.int64)
            sums = np.cumsum(w)
            extra = [np.full(b.num_rows, part, np.int32), rows + np.arange(b.num_rows), total + sums - w]
            yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, extra)], schema=arrow)
            rows += b.num_rows
            total += int(sums[-1]) if b.num_rows else 0

    kept = stash(df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(number, local), name)
    w = F.col(weight) if weight else F.lit(0)
    sums = sorted(kept.groupBy("part").agg(F.count("*"), F.sum(w)).collect())  # a row a partition
    rows = total = 0
    shifts = []
    for part, n, s in sums:
        shifts.append((part, rows, total))
        rows, total = rows + n, total + (s or 0)
    shift = spark.createDataFrame(shifts, "part int, rank0 long, before0 long")
    out = kept.join(F.broadcast(shift), "part").withColumns({"rank": F.col("rank") + F.col("rank0"), "before": F.col("before") + F.col("before0")}).drop("part", "rank0", "before0")
    return out, rows, total
