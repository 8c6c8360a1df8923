"""Sources and sinks: texts from any Spark reader in, redacted rows out; originals only on request."""

from pyspark.sql import DataFrame, SparkSession


def read_texts(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.format(fmt).load(path)


#: A table below this size for each core may hold fewer row groups than there are cores.
SMALL = 32 << 20


def spread(df: DataFrame) -> DataFrame:
    """Shares the rows of a small table among the cores; a large one keeps its scan's partitions and is not shuffled."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if size < cores * SMALL else df


#: Columns of a redaction that hold originals.
SENSITIVE = ("text", "spans", "candidates")


def safe(df: DataFrame) -> DataFrame:
    """Without the columns that hold originals."""
    return df.drop(*SENSITIVE)


def write_safe(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    safe(df).write.format(fmt).save(path)


def sensitive(df: DataFrame) -> DataFrame:
    """Everything a redaction knows, originals included; only on explicit request. Null columns stay as they are."""
    missing = [c for c in ("redacted", "spans") if c not in df.columns]
    if missing:
        raise ValueError(f"no redaction: {missing}")
    return df


def write_sensitive(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    sensitive(df).write.format(fmt).save(path)
