"""Sources: PDF files, the library's JSON, bibliographies, the blocklist."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions.keys import citekeys, content_key
from paperloom.functions.text import strings

LIBRARY = "citekey string, created double, attachments array<struct<mimeType string, filename string>>"
BLOCKLIST = "citekey string, reason string, rss_mb int, pdf string, date string"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in any file system Spark knows."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p))


_removed: set[str] = set()


def remove_at_exit(spark: SparkSession, path: str) -> str:
    """Has a folder deleted when the driver's Python ends, if the JVM is still there then; returns the path."""
    import atexit

    if path not in _removed:
        _removed.add(path)
        jvm = spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        system = target.getFileSystem(spark._jsc.hadoopConfiguration())

        def remove() -> None:
            try:
                system.delete(target, True)
            except Exception:  # noqa: BLE001  the JVM is gone; the cluster's own clean-up remains
                pass

        atexit.register(remove)
    return path


def pdf_files(spark: SparkSession, path: str) -> DataFrame:
    """path, modificationTime, length, content of one file or of all *.pdf under a folder; content is only read where selected."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return reader.load(path) if path.lower().endswith(".pdf") else reader.option("pathGlobFilter", "*.pdf").load(path)


def with_key(files: DataFrame) -> DataFrame:
    """Adds sha16, the content key; hashing happens once, here."""
    return files.withColumn("sha16", content_key(F.col("content")))


def library(spark: SparkSession, path: str) -> DataFrame:
    """One row per entry: ord (place in the library), citekey, created, attachments. The file is one JSON array."""
    text = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", f"array<struct<{LIBRARY}>>")).alias("ord", "e"))
    return text.select(F.col("ord").cast("long").alias("ord"), "e.*")


def project_citekeys(spark: SparkSession, root: str) -> DataFrame:
    """citekey: distinct keys of all references.bib and main.bib at any depth below folders named paper-*; none if the root is missing."""
    if not exists(spark, root):
        return spark.createDataFrame([], "citekey string")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "{references,main}.bib").option("ignoreCorruptFiles", "true").load(root)
    bibs = files.where(F.col("path").rlike(r"/paper-[^/]*/(?:.*/)?(?:references|main)\.bib$"))
    # bytes that are no UTF-8 are dropped, all others read as they are
    decoded = F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("\ufffd"), F.lit(""))
    return bibs.select(F.explode(F.coalesce(citekeys(decoded), strings())).alias("citekey")).distinct()


def blocklist(spark: SparkSession, path: str) -> DataFrame:
    """citekey, reason, rss_mb, pdf, date; empty where the file is missing or unreadable."""
    empty = spark.createDataFrame([], BLOCKLIST)
    if not exists(spark, path):
        return empty
    text = spark.read.text(path, wholetext=True)
    entry = "struct<reason string, rss_mb int, pdf string, date string>"
    return text.where(F.try_parse_json("value").isNotNull()).select(F.explode(F.from_json("value", f"map<string,{entry}>")).alias("citekey", "e")).select("citekey", "e.*")


def save_blocklist(rows: DataFrame, path: str) -> None:
    """One JSON object by citekey, replaced as a whole; a failure to write only warns."""
    import json
    import warnings

    entries = {r["citekey"]: {k: r[k] for k in ("reason", "rss_mb", "pdf", "date")} for r in rows.collect()}  # one row per paper that ever ran out of memory
    spark = rows.sparkSession
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
        out.write(bytearray(json.dumps(entries, indent=2).encode()))
        out.close()
    except Exception as e:  # noqa: BLE001
        warnings.warn(f"the blocklist was not saved: {e}", stacklevel=2)
