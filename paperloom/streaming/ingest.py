"""Incremental ingest: a file stream over a folder of PDFs, each new file extracted once and cached.

Files come in order of modification, so priorities belong to the batch queue (paperloom.plans.bulk). The checkpoint is the
record of what is done; there is no event time, so no watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from paperloom.operators.cache import DocCache
from paperloom.operators.extract import extract_files
from paperloom.sources.files import exists, with_key

FILES = "path string, modificationTime timestamp, length long, content binary"


def new_files(spark: SparkSession, folder: str, per_batch: int = 64) -> DataFrame:
    reader = spark.readStream.schema(FILES).format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true")
    return with_key(reader.option("maxFilesPerTrigger", per_batch).load(folder))


def ingest(spark: SparkSession, folder: str, cache: DocCache, checkpoint: str, out: str, backend: str = "auto", per_batch: int = 64) -> StreamingQuery:
    """Extracts what is new and adds documents (sha16, path, problem, doc) to the Parquet table `out`; ends when all is done.

    A batch has a folder of its own, named by the query's id, which the checkpoint keeps, and the batch's number. A batch that is
    replayed, since its end was not recorded, finds its folder finished or writes it anew: each file's row stands there once.
    """

    def batch(files: DataFrame, number: int) -> None:
        session = files.sparkSession
        path = f"{out}/query={session.sparkContext.getLocalProperty('sql.streaming.queryId')}/batch={number}"
        if exists(session, f"{path}/_SUCCESS"):
            return
        files = files.persist()
        try:
            extract_files(files, backend, cache=cache).write.mode("overwrite").parquet(path)
        finally:
            files.unpersist()

    return new_files(spark, folder, per_batch).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingested(spark: SparkSession, out: str) -> DataFrame:
    """What ingest() has written: sha16, path, problem, doc."""
    return spark.read.parquet(out).drop("query", "batch")
