"""Registered queries that run the cache, the preflight, extraction, the bulk run, the stream and the command lines themselves.

Documents stand for contents of the cache; PDF files are made from the rows, whole texts included, and read by the library.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator
from contextlib import redirect_stderr, redirect_stdout

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom import bulk_cli, cli
from paperloom.functions import keys
from paperloom.operators import preflight
from paperloom.operators.cache import DocCache, doc_json, export_images, first_of_content
from paperloom.operators.extract import BACKENDS, Backend, extract_files, register
from paperloom.plans import bulk
from paperloom.queries import documents, keyed, long, query, table
from paperloom.schemas import ExtractedDoc
from paperloom.sources import files
from paperloom.sources.pdf_writer import packed_bytes, pdf_bytes, updated
from paperloom.sources.shared import scratch, written
from paperloom.streaming.ingest import ingest, ingested


def _doc(markdown: Column, backend: str) -> Column:
    """A document with this Markdown and nothing else."""
    fields = {"markdown": markdown, "backend": F.lit(backend)}
    blank = lambda f: F.from_json(F.lit("[]" if f.name in ("figures", "tables", "references") else "{}"), f.dataType)
    return F.struct(*[(fields[f.name] if f.name in fields else blank(f)).alias(f.name) for f in ExtractedDoc])


def _cache(spark: SparkSession, sf_dir: str, where: str = "doc_id % 5 = 0") -> tuple[DocCache, DataFrame]:
    """A new cache that holds the contents of some documents, and all documents with their keys."""
    cache, x = DocCache(spark, scratch(spark, "cache")), keyed(spark, sf_dir)
    if where != "false":
        cache.save(x.where(where).select("sha16", _doc(F.coalesce("text", F.lit("")), keys.FAST).alias("doc")), keys.FAST)
    return cache, x


def _put(cache: DocCache, rows: DataFrame, doc: Column, written_at: Column) -> None:
    """Entries as another program would write them: not checked, at a time of their own."""
    x = rows.select("sha16", doc.alias("doc"), written_at.alias("written_at"), F.lit(keys.FAST).alias("backend"), F.lit(cache.version).alias("extract_version"))
    x.write.mode("append").partitionBy("backend", "extract_version").parquet(cache.path)


KEYED_SQL = "keyed AS (SELECT *, substr(sha1(coalesce(text, '')), 1, 16) AS sha16 FROM documents), cached AS (SELECT DISTINCT sha16 FROM keyed WHERE doc_id % 5 = 0)"


@query("SELECT min(doc_id) AS path, sha16, count(*) AS n FROM (SELECT doc_id, substr(sha1(coalesce(text, '')), 1, 16) AS sha16 FROM documents) GROUP BY sha16")
def cache_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_of_content(keyed(spark, sf_dir).select("sha16", F.col("doc_id").alias("path")))


@query(f"WITH {KEYED_SQL} SELECT doc_id, sha16, coalesce(text, '') AS markdown, 'pymupdf4llm' AS backend FROM keyed WHERE sha16 IN (SELECT sha16 FROM cached)")
def cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved documents as they come back."""
    cache, x = _cache(spark, sf_dir)
    return cache.hits(x.select("doc_id", "sha16"), keys.FAST).select("doc_id", "sha16", F.col("cached.markdown").alias("markdown"), F.col("cached.backend").alias("backend"))


@query(f"WITH {KEYED_SQL} SELECT doc_id, sha16 FROM keyed WHERE NOT EXISTS (SELECT 1 FROM cached c WHERE c.sha16 = keyed.sha16)")
def cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache, x = _cache(spark, sf_dir)
    return cache.misses(x.select("doc_id", "sha16"), keys.FAST)


@query(f"WITH {KEYED_SQL} SELECT DISTINCT sha16 FROM keyed k WHERE sha16 NOT IN (SELECT sha16 FROM keyed WHERE lang = 'de')")
def cache_evict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left after an eviction by key."""
    cache, x = _cache(spark, sf_dir, "true")
    cache.evict(x.where("lang = 'de'").select("sha16"), keys.FAST)
    return cache.keys(keys.FAST)


@query(f"""WITH {KEYED_SQL}, fates AS (SELECT sha16, bool_or(lang = 'de') AS evicted, bool_or(doc_id % 3 = 0) AS again, bool_or(lang = 'fr') AS gone, count(DISTINCT doc_id) AS n FROM keyed GROUP BY sha16)
SELECT sha16, CASE WHEN again THEN 'second' ELSE 'first' END AS markdown FROM fates WHERE (again OR NOT evicted) AND NOT gone""")
def cache_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved, evicted by key, saved again in part, compacted, evicted once more, vacuumed: what is left, and of which save."""
    cache, x = _cache(spark, sf_dir, "false")
    put = lambda rows, text: cache.save(rows.select("sha16", _doc(F.lit(text), keys.FAST).alias("doc")).dropDuplicates(["sha16"]), keys.FAST)
    put(x, "first")
    cache.evict(x.where("lang = 'de'").select("sha16"), keys.FAST)
    put(x.where("doc_id % 3 = 0"), "second")
    cache.compact(keys.FAST)
    cache.evict(x.where("lang = 'fr'").select("sha16"), keys.FAST)
    cache.vacuum(0)
    return cache.entries(keys.FAST).select("sha16", F.col("cached.markdown").alias("markdown"))


@query(f"WITH {KEYED_SQL} SELECT sha16 FROM keyed GROUP BY sha16 HAVING max(doc_id % 100) >= 60")
def cache_evict_older(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of entries up to 99.5 days old, several for some contents, when those of more than 40 days go."""
    cache, x = _cache(spark, sf_dir, "false")
    age = F.make_dt_interval((99 - F.col("doc_id") % 100).cast("int"), F.lit(12))
    _put(cache, x, doc_json(_doc(F.col("sha16"), keys.FAST)), F.current_timestamp() - age)
    cache.evict_older(keys.FAST, 40)
    return cache.keys(keys.FAST)


@query(f"WITH {KEYED_SQL} SELECT sha16, max(doc_id) AS newest FROM keyed GROUP BY sha16")
def cache_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of several entries of one content the latest written counts."""
    cache, x = _cache(spark, sf_dir, "false")
    _put(cache, x, doc_json(_doc(F.col("doc_id").cast("string"), keys.FAST)), F.timestamp_seconds(F.col("doc_id")))
    return cache.entries(keys.FAST).select("sha16", F.col("cached.markdown").cast("long").alias("newest"))


@query(f"WITH {KEYED_SQL} SELECT sha16 FROM cached WHERE sha16 NOT IN (SELECT sha16 FROM keyed WHERE doc_id % 10 = 0)")
def cache_corrupt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that can't be decoded are none, by key and by content."""
    cache, x = _cache(spark, sf_dir)
    _put(cache, x.where("doc_id % 10 = 0"), F.when(F.col("doc_id") % 20 == 0, "{not valid").otherwise("[1]"), F.current_timestamp() + F.expr("INTERVAL 1 HOUR"))
    return cache.keys(keys.FAST).join(cache.entries(keys.FAST).select("sha16"), "sha16", "left_semi")


@query(f"WITH {KEYED_SQL}, kept AS (SELECT DISTINCT sha16 FROM keyed WHERE doc_id % 7 = 0) SELECT doc_id, sha16 IN (SELECT sha16 FROM cached) AS fast, sha16 IN (SELECT sha16 FROM kept) AS structured, FALSE AS next_version FROM keyed")
def cache_backends_and_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of two backends stand side by side; another version sees none of them."""
    cache, x = _cache(spark, sf_dir)
    cache.save(x.where("doc_id % 7 = 0").select("sha16", _doc(F.lit("m"), keys.STRUCTURED).alias("doc")), keys.STRUCTURED)
    out = x.select("doc_id", "sha16")
    for name, own in (("fast", cache.keys(keys.FAST)), ("structured", cache.keys(keys.STRUCTURED)), ("next_version", DocCache(spark, cache.root, "9.9").keys(keys.FAST))):
        out = out.join(own.withColumn(name, F.lit(True)), "sha16", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return out.drop("sha16")


EMPTY_JSON = '{"markdown":"x","figures":[],"tables":[],"references":[],"metadata":{"title":null,"authors":null,"year":null,"abstract":null,"n_pages":null,"auto_fallback":null},"backend":"%s"}'


@query(f"""SELECT CASE WHEN doc_id % 3 = 0 THEN 'marker' ELSE 'pymupdf4llm' END AS backend, CASE WHEN doc_id % 4 = 0 THEN '0.0.9' ELSE '0.1.0' END AS extract_version, count(DISTINCT sha1(coalesce(text, ''))) AS entries,
CAST(sum(CASE WHEN doc_id % 3 = 0 THEN {len(EMPTY_JSON % 'marker')} ELSE {len(EMPTY_JSON % 'pymupdf4llm')} END) AS BIGINT) AS bytes FROM documents GROUP BY ALL""")
def cache_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    root, x = scratch(spark, "cache"), keyed(spark, sf_dir)
    for backend, third in ((keys.STRUCTURED, "doc_id % 3 = 0"), (keys.FAST, "doc_id % 3 <> 0")):
        for version, quarter in (("0.0.9", "doc_id % 4 = 0"), (keys.EXTRACT_VERSION, "doc_id % 4 <> 0")):
            DocCache(spark, root, version).save(x.where(third).where(quarter).select("sha16", _doc(F.lit("x"), backend).alias("doc")), backend)
    return DocCache(spark, root).inventory().select("backend", "extract_version", "entries", "bytes")


# PDF files made from rows: whole texts as lines of the first page, further pages by number, and one fault in each of five kinds.
LAST = "End of the first page, long enough to be the usual size of letters."


def pdf_of(number: int, text: str, author: str) -> bytes:
    pages = [[(20, f"Paper {number}"), *((10, line) for line in text.split("\n")), (10, LAST), (10, LAST)]]
    pages += [[(10, f"Page {k} of {number}.")] for k in range(1, number % 4)]
    kind = number % 8
    if kind == 5:
        return b"no document at all"
    more = {3: {"count": len(pages) + 2}, 4: {"after": b"left over"}, 6: {"orphan": True}, 7: {"trailer": "/Encrypt << /Filter /Standard >>"}}.get(kind, {})
    return pdf_bytes(pages, f"Title {number}", author, **more)


def pdfs(rows: DataFrame) -> DataFrame:
    """path, content, sha16 of the files made from (id, text, author); without a text the file is a thin one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):  # some files at a time
                part = batch.slice(at, 64).to_pylist()
                made = [pdf_of(r["id"], r["text"], r["author"]) if r["text"] is not None else pdf_bytes([[(10, f"thin {r['id']}")]], "", "") for r in part]
                yield pa.RecordBatch.from_arrays([pa.array([f"{r['id']}.pdf" for r in part]), pa.array(made, pa.binary())], names=["path", "content"])

    x = rows.select(F.col("id").cast("long").alias("id"), "text", F.coalesce("author", F.lit("")).alias("author"))
    return files.with_key(x.mapInArrow(run, "path string, content binary"))


def _document_pdfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of all documents, made once and written, since they are read several times; a step that needs no bytes reads none."""
    return written(pdfs(documents(spark, sf_dir).select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"), F.col("source").alias("author"))), "pdfs")


def _id(path: str = "path") -> Column:
    return F.substring_index(F.substring_index(path, "/", -1), ".", 1).cast("long")


@query("""WITH x AS (SELECT doc_id, doc_id % 8 AS k, greatest(1, doc_id % 4) AS n FROM documents)
SELECT doc_id, CASE k WHEN 3 THEN 'FAIL' WHEN 4 THEN 'UNAVAILABLE' WHEN 5 THEN 'UNAVAILABLE' WHEN 6 THEN 'UNAVAILABLE' WHEN 7 THEN 'UNAVAILABLE' ELSE 'PASS' END AS verdict,
  CASE WHEN k IN (5, 7) THEN NULL WHEN k = 3 THEN n + 2 ELSE n END AS declared, CASE WHEN k IN (5, 7) THEN NULL ELSE n END AS enumerated, CASE WHEN k IN (5, 7) THEN NULL ELSE n END AS reader,
  CASE k WHEN 4 THEN 'trailing-data' WHEN 5 THEN 'parse-error' WHEN 6 THEN 'xref-coverage' WHEN 7 THEN 'encrypted' END AS warning FROM x""")
def preflight_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The preflight over a PDF per document."""
    x = preflight.preflight(_document_pdfs(spark, sf_dir))
    counts = [long(f"{c}_page_count").alias(c) for c in ("declared", "enumerated", "reader")]
    return x.select(_id("file").alias("doc_id"), "verdict", *counts, F.substring_index(F.get("warnings", 0), ":", 1).alias("warning"))


FONT = {3: b"<< /Type /Font /Subtype /Type1 /BaseFont /Courier >>"}


def revised(number: int, text: str) -> bytes:
    """A file of one revision or two, of one of eight kinds."""
    pages = [[(20, f"Paper {number}"), *((10, line) for line in text.split("\n"))]]
    whole = lambda **more: pdf_bytes(pages, f"Title {number}", **more)
    kinds = [
        whole, lambda: updated(whole(), FONT, stale=True), lambda: updated(packed_bytes(pages), FONT, stale=True), lambda: updated(whole(), FONT),
        lambda: b"junk ahead\n" + whole(), lambda: updated(whole(shift=-1), FONT, stale=True), lambda: updated(whole(), {60 + number % 7: b"<< /New true >>"}, stale=True), lambda: packed_bytes(pages),
    ]
    return kinds[number % 8]()


@query("""SELECT doc_id, CASE WHEN doc_id % 8 IN (1, 2, 4, 6) THEN 'UNAVAILABLE' ELSE 'PASS' END AS verdict, CASE doc_id % 8 WHEN 1 THEN 'xref-coverage: later copies of objects [3]'
WHEN 2 THEN 'xref-coverage: direct copies after their object stream [3]' WHEN 4 THEN 'parser' WHEN 6 THEN 'xref-coverage: objects outside the cross-reference [' || (60 + doc_id % 7) || ']' END AS warning, sha256(coalesce(text, '')) AS sha256
FROM documents""")
def preflight_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The coverage of revisions: superseded, displaced, updated, repaired, not comparable and orphaned copies of objects, a file per
    document. sha256 is the preflight's of the text's own bytes, judged in the same table as files that are no PDF."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64).to_pylist()
                made = [(f"{r['doc_id']}.pdf", revised(r["doc_id"], r["text"])) for r in part] + [(f"{r['doc_id']}.txt", r["text"].encode()) for r in part]
                yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made]), pa.array([m[1] for m in made], pa.binary())], names=["path", "content"])

    x = documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "path string, content binary")
    x = preflight.preflight(written(x, "revisions")).withColumn("pdf", F.endswith("file", F.lit(".pdf")))
    first = F.get("warnings", 0)
    shown = F.when(first.startswith("parser"), "parser").otherwise(first)
    return x.groupBy(_id("file").alias("doc_id")).agg(F.max(F.when(F.col("pdf"), F.col("verdict"))).alias("verdict"), F.max(F.when(F.col("pdf"), shown)).alias("warning"), F.max(F.when(~F.col("pdf"), F.col("sha256"))).alias("sha256"))


# Texts are compared without white space and number signs; characters that a file can't hold are question marks.
SOLID = r"[\t-\r\x1c-\x20\x85\xa0#]"
EXTRACTED_SQL = rf"""WITH x AS (SELECT doc_id, doc_id % 8 = 5 AS bad, greatest(1, doc_id % 4) AS n, coalesce(source, '') AS source, 'Paper ' || doc_id || coalesce(text, '') || '{LAST}{LAST}' ||
  CASE WHEN doc_id % 4 > 1 THEN 'Page 1 of ' || doc_id || '.' ELSE '' END || CASE WHEN doc_id % 4 > 2 THEN 'Page 2 of ' || doc_id || '.' ELSE '' END AS t FROM documents),
solid AS (SELECT *, md5(regexp_replace(regexp_replace(t, '[\t-\r\x1C-\x20\x{{85}}\x{{A0}}#]', '', 'g'), '[^\x{{00}}-\x{{FF}}]', '?', 'g')) AS m FROM x)
SELECT doc_id, bad AS failed, CASE WHEN NOT bad THEN 'Title ' || doc_id END AS title, CASE WHEN NOT bad THEN source END AS authors, CASE WHEN NOT bad THEN n END AS n_pages, CASE WHEN NOT bad THEN m END AS text_md5, CASE WHEN NOT bad THEN 'pymupdf4llm' END AS backend FROM solid"""


@query(EXTRACTED_SQL)
def extract_fast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fast backend over a PDF per document, through a new cache: rows are read back from it, failures with their reason."""
    x = extract_files(_document_pdfs(spark, sf_dir), keys.FAST, cache=DocCache(spark, scratch(spark, "cache")))
    meta = F.col("doc.metadata")
    solid = F.md5(F.regexp_replace(F.regexp_replace("doc.markdown", SOLID, ""), r"[^\x00-\xff]", "?").cast("binary"))
    return x.select(_id().alias("doc_id"), F.col("problem").isNotNull().alias("failed"), meta["title"].alias("title"), meta["authors"].alias("authors"), long(meta["n_pages"]).alias("n_pages"), solid.alias("text_md5"), F.col("doc.backend").alias("backend"))


@query("SELECT doc_id, doc_id % 8 = 5 AS failed, doc_id % 8 <> 5 AS kept, doc_id % 8 <> 5 AS found_again FROM documents")
def extract_cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second extraction finds what the first one kept; failures are not kept."""
    cache, x = DocCache(spark, scratch(spark, "cache")), _document_pdfs(spark, sf_dir)
    name = BACKENDS[keys.FAST].cached_as
    out = extract_files(x, keys.FAST, cache=cache).select(_id().alias("doc_id"), "sha16", F.col("problem").isNotNull().alias("failed"))
    kept = cache.keys(name).withColumn("kept", F.lit(True))
    again = cache.hits(x.select("sha16").distinct(), name).select("sha16", F.lit(True).alias("found_again"))
    return out.join(kept, "sha16", "left").join(again, "sha16", "left").select("doc_id", "failed", F.coalesce("kept", F.lit(False)).alias("kept"), F.coalesce("found_again", F.lit(False)).alias("found_again"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'marker_unavailable' END AS auto_fallback, doc_id % 3 <> 0 AND doc_id % 8 = 5 AS failed, FALSE AS flag_cached FROM documents")
def extract_auto(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Auto routing where the structured backend is not there: thin documents keep the fast result, marked, and the cache doesn't know."""
    x = documents(spark, sf_dir).select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 3 != 0, F.coalesce("text", F.lit(""))).alias("text"), F.lit("").alias("author"))
    cache, name = DocCache(spark, scratch(spark, "cache")), BACKENDS[keys.FAST].cached_as
    out = extract_files(written(pdfs(x), "pdfs"), cache=cache).select(_id().alias("doc_id"), "sha16", F.col("doc.metadata.auto_fallback").alias("auto_fallback"), F.col("problem").isNotNull().alias("failed"))
    marked = cache.entries(name).where(F.col("cached.metadata.auto_fallback").isNotNull()).select("sha16", F.lit(True).alias("m"))
    return out.join(marked, "sha16", "left").select("doc_id", "auto_fallback", "failed", F.coalesce("m", F.lit(False)).alias("flag_cached"))


# A library on disk: benchmark items are its entries, with a PDF each. Files, JSON and bibliography are written first, then read back.
def _write(spark: SparkSession, path: str, text: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def _library(spark: SparkSession, sf_dir: str, name: str) -> str:
    """A folder with pdfs/<id>.pdf (none for every ninth item), library.json, paper-a/references.bib and blocklist.json."""
    root = scratch(spark, name)
    items = table(spark, sf_dir, "benchmark")
    there = items.where("item_id % 9 <> 8").select(F.col("item_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"), F.lit("A. Author").alias("author"))
    made = pdfs(there)
    export_images(made.select(F.lit("pdfs").alias("sha16"), F.col("path").alias("name"), F.col("content").alias("data")), root)
    ids = [r[0] for r in items.select("item_id").orderBy("item_id").collect()]  # a library is one JSON file
    _write(spark, f"{root}/library.json", json.dumps([{"citekey": f"k{i}", "created": None if i % 5 == 0 else i % 13, "attachments": [{"mimeType": "text/html", "filename": "x.html"}, {"mimeType": "application/pdf", "filename": f"All Papers/{i}.pdf"}]} for i in ids]))
    _write(spark, f"{root}/paper-a/deep/references.bib", "".join(f"@article{{k{i},\n  title = {{T}}\n}}\n" for i in ids if i % 4 == 0))
    _write(spark, f"{root}/blocklist.json", json.dumps({f"k{i}": {"reason": "memory", "rss_mb": 5000, "pdf": "x", "date": "2020-01-01"} for i in ids if i % 7 == 0}))
    return root


def _queue(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    found = files.with_key(files.pdf_files(spark, f"{root}/pdfs")).select("path", "sha16", F.substring_index("path", "/", -1).alias("name"))
    entries = bulk.with_priority(bulk.resolved(files.library(spark, f"{root}/library.json"), found), files.project_citekeys(spark, root))
    return entries.join(found.select("path", "sha16"), "path"), files.blocklist(spark, f"{root}/blocklist.json")


LIBRARY_SQL = "items AS (SELECT DISTINCT item_id, item_id % 4 = 0 AS hot, CASE WHEN item_id % 5 = 0 THEN 0 ELSE item_id % 13 END AS created FROM benchmark), queue AS (SELECT * FROM items WHERE item_id % 9 <> 8 AND item_id % 7 <> 0)"


@query(f"WITH {LIBRARY_SQL} SELECT row_number() OVER (ORDER BY hot DESC, CASE WHEN hot THEN 0 ELSE -created END, item_id) AS place, 'k' || item_id AS citekey, hot AS is_hot FROM queue")
def library_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queue from files: library, PDF listing, bibliographies and blocklist."""
    entries, blocked = _queue(spark, _library(spark, sf_dir, "library"))
    return bulk.placed(bulk.not_blocklisted(entries, blocked)).select("place", "citekey", "is_hot")


BULK_SQL = "CASE WHEN item_id % 8 = 3 THEN 'preflight' WHEN item_id % 8 = 5 THEN 'failed' ELSE 'ok' END"


@query(f"WITH {LIBRARY_SQL} SELECT 'k' || item_id AS citekey, {BULK_SQL} AS status, {BULK_SQL} = 'ok' AS cached FROM queue")
def bulk_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queue worked through: preflight gate, outcomes, cache."""
    root = _library(spark, sf_dir, "bulk")
    entries, blocked = _queue(spark, root)
    cache, name = DocCache(spark, f"{root}/cache"), BACKENDS[keys.FAST].cached_as
    todo = bulk.queue(entries, cache.keys(name), blocked, 10_000)
    log = bulk.run(spark, todo, cache, bulk.Budget(free_percent=0), keys.FAST, sidecars=f"{root}/sidecars")
    known = cache.keys(name).withColumn("cached", F.lit(True))
    out = log.select("citekey", "status").join(entries.select("citekey", "sha16"), "citekey").join(known, "sha16", "left")
    return out.select("citekey", "status", F.coalesce("cached", F.lit(False)).alias("cached"))


@query(f"WITH {LIBRARY_SQL}, x AS (SELECT {BULK_SQL} AS status FROM queue) SELECT status, count(*) AS n FROM x GROUP BY status")
def bulk_command_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The command line over the same library; its run log, counted."""
    root = _library(spark, sf_dir, "bulk-cli")
    with redirect_stdout(io.StringIO()), redirect_stderr(io.StringIO()):
        local = root.removeprefix("file:")
        bulk_cli.main(["--library-json", f"{local}/library.json", "--pdf-root", f"{local}/pdfs", "--projects-root", local, "--state", local, "--cache-root", f"{local}/cache", "--heavy-lock", "", "--backend", keys.FAST, "--min-free-percent", "0"], spark)
    return bulk.counters(spark.read.parquet(f"{root}/run_log"))


INGESTED_SQL = "SELECT DISTINCT item_id, item_id % 8 = 5 AS failed, CASE WHEN item_id % 8 <> 5 THEN greatest(1, item_id % 4) END AS n_pages FROM benchmark WHERE item_id % 9 <> 8"


@query(INGESTED_SQL)
def stream_replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder ingested, and again after the record of its last batch's end was lost: that batch is replayed, its rows stand once."""
    root = _library(spark, sf_dir, "replay")
    jvm = spark._jvm
    for _ in range(2):
        ingest(spark, f"{root}/pdfs", DocCache(spark, f"{root}/cache"), f"{root}/checkpoint", f"{root}/out", keys.FAST, per_batch=100).awaitTermination()
        commits = jvm.org.apache.hadoop.fs.Path(f"{root}/checkpoint/commits")
        fs = commits.getFileSystem(spark._jsc.hadoopConfiguration())
        last = max((s.getPath() for s in fs.listStatus(commits) if s.getPath().getName().isdigit()), key=lambda p: int(p.getName()))
        fs.delete(last, False)
    return ingested(spark, f"{root}/out").select(_id().alias("item_id"), F.col("problem").isNotNull().alias("failed"), long("doc.metadata.n_pages").alias("n_pages"))


@query(INGESTED_SQL)
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder ingested as a stream, once, then again without anything new."""
    root = _library(spark, sf_dir, "ingest")
    for _ in range(2):
        ingest(spark, f"{root}/pdfs", DocCache(spark, f"{root}/cache"), f"{root}/checkpoint", f"{root}/out", keys.FAST).awaitTermination()
    return ingested(spark, f"{root}/out").select(_id().alias("item_id"), F.col("problem").isNotNull().alias("failed"), long("doc.metadata.n_pages").alias("n_pages"))


PRINTED = {"metadata": ["--metadata"], "preflight": ["--preflight"], "section": ["--section", "paper 9"], "references": ["--references"], "tables": ["--tables"], "missing section": ["--section", "nowhere"], "missing file": []}


@query("SELECT * FROM (VALUES ('metadata', 0, '3'), ('preflight', 0, 'PASS'), ('section', 0, 'Text of it.'), ('references', 0, ''), ('tables', 0, ''), ('missing section', 2, ''), ('missing file', 1, '')) t(what, code, first)")
def command_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exit codes of the command line and the first thing that it prints, over one file."""
    root = scratch(spark, "cli").removeprefix("file:")
    made = spark.createDataFrame([("files", "9.pdf", bytearray(pdf_bytes([[(20, "Paper 9"), (10, "Text of it."), (10, LAST)], [(10, "More.")], [(10, "End.")]], "T", "A")))], "sha16 string, name string, data binary")
    export_images(made, root)
    rows = []
    for what, flags in PRINTED.items():
        out = io.StringIO()
        with redirect_stdout(out), redirect_stderr(io.StringIO()):
            code = cli.main([f"{root}/files/{'none' if what == 'missing file' else 9}.pdf", "--backend", keys.FAST, "--no-cache", *flags], spark)
        text = out.getvalue().strip()
        if what in ("metadata", "preflight"):
            text = str(json.loads(text)["n_pages" if what == "metadata" else "verdict"])
        rows.append((what, code, text.split("\n")[0]))
    return spark.createDataFrame(rows, "what string, code int, first string")


@query("SELECT doc_id, substr(sha1(coalesce(text, '')), 1, 16) || '_' || CASE WHEN doc_id % 2 = 0 THEN 'marker' ELSE 'pymupdf4llm' END || '_v0.1.0' AS entry FROM documents")
def entry_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    backend = F.when(F.col("doc_id") % 2 == 0, keys.STRUCTURED).otherwise(keys.FAST)
    return keyed(spark, sf_dir).select("doc_id", keys.entry_name(F.col("sha16"), backend, F.lit(keys.EXTRACT_VERSION)).alias("entry"))


@query(f"WITH {LIBRARY_SQL} SELECT 'k' || item_id AS citekey, 'FAIL' AS verdict, greatest(1, item_id % 4) + 2 AS declared, greatest(1, item_id % 4) AS enumerated FROM queue WHERE item_id % 8 = 3")
def fail_sidecars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a bulk run keeps of files whose page counts disagree."""
    root = _library(spark, sf_dir, "sidecars")
    entries, blocked = _queue(spark, root)
    todo = bulk.not_blocklisted(entries, blocked)
    bulk.run(spark, todo, DocCache(spark, f"{root}/cache"), bulk.Budget(free_percent=0), keys.FAST, sidecars=f"{root}/sidecars")
    schema = "verdict string, declared_page_count long, enumerated_page_count long, citekey string"
    return spark.read.schema(schema).json(f"{root}/sidecars").select("citekey", "verdict", F.col("declared_page_count").alias("declared"), F.col("enumerated_page_count").alias("enumerated"))


@query("SELECT 'k' || item_id AS citekey, 'memory' AS reason, CAST(item_id AS INTEGER) AS rss_mb FROM (SELECT DISTINCT item_id FROM benchmark)")
def blocklist_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch(spark, 'blocklist')}/blocklist.json"
    rows = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("k"), F.col("item_id").cast("string")).alias("citekey"), F.lit("memory").alias("reason"), F.col("item_id").cast("int").alias("rss_mb"), F.lit("x.pdf").alias("pdf"), F.lit("2020-01-01").alias("date")).distinct()
    files.save_blocklist(rows, path)
    return files.blocklist(spark, path).select("citekey", "reason", "rss_mb")


def _stand_in(data: bytes, options: dict) -> dict:
    """A structured conversion that needs no package: tables, references and images by the number in the file's title."""
    from paperloom.sources.pdf import Reader

    reader = Reader(data)
    n = int(reader.metadata()["title"].split(" ")[1])
    tables = "".join(f"Table {k}. Of {n}\n\n| a | b |\n|---|---|\n| {k} | {n} |\n\n" for k in range(n % 4))
    refs = "".join(f"[{k}] An entry of the list that is long enough, {n}.\n" for k in range(n % 3))
    return {"markdown": f"# Paper {n}\n\n{tables}End.\n\n## References\n\n{refs}", "title": "", "authors": "", "n_pages": len(reader.pages()), "images": {f"page_{k}_x.png": b"%d" % n for k in range(n % 5)}}


@query("""WITH x AS (SELECT doc_id, doc_id % 8 <> 5 AS good FROM documents) SELECT doc_id, good, CASE WHEN good THEN doc_id % 4 END AS n_tables, CASE WHEN good AND doc_id % 4 > 0 THEN 'Table ' || (doc_id % 4 - 1) || '. Of ' || doc_id END AS last_caption,
CASE WHEN good THEN doc_id % 3 END AS n_refs, CASE WHEN good THEN doc_id % 5 END AS n_figures, CASE WHEN good THEN doc_id % 5 ELSE 0 END AS n_saved, CASE WHEN good THEN greatest(0, doc_id % 5 - 1) END AS last_page FROM x""")
def extract_structured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The structured path with a stand-in for the package: tables, captions, references, figures and their images in the cache."""
    cache = DocCache(spark, scratch(spark, "cache"))
    register(Backend("stand-in", _stand_in, mines=True))
    try:
        out = extract_files(_document_pdfs(spark, sf_dir), "stand-in", cache=cache)
    finally:
        BACKENDS.pop("stand-in")
    saved = cache.figure_names("stand-in").groupBy("sha16").agg(F.count("*").alias("n_saved"))
    doc = F.col("doc")
    return out.join(saved, "sha16", "left").select(
        _id().alias("doc_id"), doc.isNotNull().alias("good"), long(F.when(doc.isNotNull(), F.size(doc["tables"]))).alias("n_tables"), F.get(F.reverse(doc["tables"]), 0)["caption"].alias("last_caption"),
        long(F.when(doc.isNotNull(), F.size(doc["references"]))).alias("n_refs"), long(F.when(doc.isNotNull(), F.size(doc["figures"]))).alias("n_figures"), F.coalesce("n_saved", F.lit(0)).alias("n_saved"),
        long(F.when(doc.isNotNull(), F.coalesce(F.get(F.reverse(doc["figures"]), 0)["page"], F.lit(0)))).alias("last_page"),
    )


@query(f"WITH {KEYED_SQL}, kept AS (SELECT DISTINCT sha16, coalesce(text, '') AS t FROM keyed WHERE doc_id % 5 = 0) SELECT 'pymupdf4llm' AS backend, count(*) AS papers, CAST(sum(length(t)) AS BIGINT) AS characters, count_if(t = '') AS empty FROM kept")
def sql_cache_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache looked at through its views."""
    from paperloom.functions.sql import cache_views

    cache, _ = _cache(spark, sf_dir)
    cache_views(cache, keys.FAST)
    return spark.sql("SELECT backend, count(*) AS papers, sum(length(markdown)) AS characters, count_if(markdown = '') AS empty FROM papers GROUP BY backend")
