"""Where intermediate tables live: the folder that the cluster shares, named by spark.checkpoint.dir."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from paperloom.sources.files import remove_at_exit

LOCAL_DIR = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Where it is unset, a local master gets LOCAL_DIR (tests); on a cluster that is an error,
    since no folder of one machine is shared."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = LOCAL_DIR
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def own_dir(spark: SparkSession) -> str:
    """The folder of this application's intermediate tables, deleted when the application ends."""
    return remove_at_exit(spark, f"{shared_dir(spark)}/paperloom-{spark.conf.get('spark.app.id', 'local')}")


def written(df: DataFrame, label: str) -> DataFrame:
    """The same rows, written to the shared folder and read again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{own_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Deletes all intermediate tables of this application; results not yet written elsewhere can't be read any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(own_dir(spark))
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
