"""A corpus pipeline of five operators; each stage is written as Parquet and read again as the next one's input.

Language ID drops the documents that it rejects, line dedup cuts later repeated runs of lines, near-dedup keeps the least doc_id
of each class, decontamination drops documents that hold a benchmark item, and mixing takes documents, some more than once, to
their sources' targets. All stages but the last return the columns of documents, n_chars as it is after cutting; the last one
returns the mixture: a row per copy taken. An empty table gives an empty result at every stage; columns that documents don't have
are carried along.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import decontam, langid, linededup, mixing, neardup
from paperloom.llm._store import table, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is recognised; null texts and those without a letter go. Repeated rows fare alike."""
    model = langid.fit(docs)
    return langid.predict(docs, model, keep=tuple(docs.columns)).where(~F.col("rejected")).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts later repeated runs of lines; documents of which no word is left go, all others stay.

    Null and empty texts have nothing to cut and stay. Rows that repeat a doc_id and text are one document: neither is later.
    """
    cut = linededup.dedup(docs).where((F.col("n_deleted") == 0) | F.col("text").rlike(r"[^\W_]|[^\x00-\x7f]"))
    return cut.withColumn("n_chars", F.when(F.col("n_deleted") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least doc_id of each class of near duplicates, with all rows that repeat it.

    Texts without words are classes of their own; rows with a null doc_id stay.
    """
    return neardup.without_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item; texts of fewer than five words, null and empty ones, hold none and stay."""
    return decontam.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: a row per copy taken, with the columns of documents and size, source_size, target, copies, copy.

    Documents that the mix leaves out are not there. Null sources are one source; texts without words have size 0 and come with
    the certain copies only.
    """
    return mixing.mixture(docs, weights=(5, 2, 1), cap=3.0)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
]
ORACLE_SQL = None  # trained models, winnowing and sampling are not SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
