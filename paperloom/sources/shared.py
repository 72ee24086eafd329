"""Tables between the steps of a job, in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from paperloom.sources.files import remove_at_exit

LOCAL_DIR = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; where it is unset a local master gets LOCAL_DIR, and on a cluster that is an error, since
    no folder of one machine is shared."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = LOCAL_DIR
    return where.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, deleted with the application."""
    own = remove_at_exit(spark, f"{shared_dir(spark)}/paperloom-work-{spark.conf.get('spark.app.id', 'local')}")
    return f"{own}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written and read again: computed once, and not again when an executor is lost."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
