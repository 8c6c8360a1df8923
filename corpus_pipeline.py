"""A corpus pipeline of five stages, each an operator of ``veilspan.llm``.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before kept; its result is written
as Parquet and read again as the next stage's ``docs``. All but the last return the columns of documents.

Edge cases, alike in all stages: null and repeated ids do not matter, since texts decide; further columns pass
through whatever their names (the last stage drops them); an empty table gives an empty result; a null text
counts as empty. Each stage states what becomes of empty texts and repeated rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.llm import decontaminate, pieces, pii_crf, quality_fm, simhash
from veilspan.llm.common import stash, table

#: Jaccard similarity of five-word shingles from which documents are near duplicates.
SIMILARITY = 0.8


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the factorisation machine scores below its threshold.

    An empty text is scored by its length features; repeated rows are kept or dropped together.
    """
    return quality_fm.keep_good(docs, quality_fm.train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that with the smallest id, of each group of near duplicates: five-word shingles at SIMILARITY.

    Of repeated rows one stays; texts without a word are one group.
    """
    return simhash.drop_near_duplicates(docs, SIMILARITY)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item; an empty text or item holds nothing, repeated rows go or stay together."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind; n_chars is that of the new text (null for a null text). No row is dropped."""
    return pii_crf.redact_pii(docs).withColumn("n_chars", F.length("text").cast("long"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source and the ids of each text, a row for each row; an empty text has no ids."""
    return pieces.encode(docs, carry=("lang", "source"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("personal_data", personal_data), ("encoding", encoding)]
#: The classifier and the fingerprints (XXH64) have no SQL form; the tests hold the rows against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
