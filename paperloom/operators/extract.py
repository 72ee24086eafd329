"""Extraction: backends over PDF bytes, routing between them, and the document struct.

A backend turns bytes into Markdown and metadata in Python workers; structure is then mined by column expressions. `auto` runs the
fast backend, and only documents whose body is thin go on to the structured one: a filter and a union, since a Python function
inside when() would run for every row.
"""

from __future__ import annotations

import importlib.util
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions.keys import FAST, RESERVED, STRUCTURED, THIN, is_thin
from paperloom.functions.markdown import body_without_references, figures, references, tables
from paperloom.operators.cache import DocCache, export_images, first_of_content
from paperloom.sources.files import pdf_files, with_key
from paperloom.sources.shared import written

PATHS_TO_BROADCAST = 200_000
HELD_ROWS, HELD_BYTES = 64, 1 << 20  # results that a task holds before they go on
RAW = "sha16 string, path string, markdown string, title string, authors string, n_pages int, images array<string>, data array<struct<name:string,data:binary>>, problem string"
RAW_ARROW = pa.schema([
    ("sha16", pa.string()), ("path", pa.string()), ("markdown", pa.string()), ("title", pa.string()), ("authors", pa.string()), ("n_pages", pa.int32()), ("images", pa.list_(pa.string())),
    ("data", pa.list_(pa.struct([("name", pa.string()), ("data", pa.binary())]))), ("problem", pa.string()),
])
Converted = dict


@dataclass
class Backend:
    """convert(bytes, options) -> {markdown, title, authors, n_pages, images: {name: bytes}}; `mines` says that tables and figures are harvested."""

    name: str
    convert: Callable[[bytes, dict], Converted]
    requires: str | None = None
    mines: bool = False
    stored_as: str | None = None  # the cache's name for its results, if another program makes them
    options: dict = field(default_factory=dict)

    @property
    def cached_as(self) -> str:
        return self.stored_as or self.name

    def available(self, spark: SparkSession) -> bool:
        """Whether the needed module can be imported, on the driver and on an executor."""
        if self.requires is None:
            return True
        name = self.requires
        if importlib.util.find_spec(name) is None:
            return False
        probe = lambda it: (pd.DataFrame({"ok": [importlib.util.find_spec(name) is not None]}) for _ in it)
        return bool(spark.range(1).mapInPandas(probe, "ok boolean").first()["ok"])


def native_text(data: bytes, options: dict) -> Converted:
    """The own reader: text of simple PDFs. A file that is no PDF, or that it can't follow, raises."""
    from paperloom.sources.pdf import Reader

    reader = Reader(data)
    pages = reader.pages()
    return {"markdown": reader.markdown(), "title": "", "authors": "", "n_pages": len(pages), "images": {}} | reader.metadata()


def info(data: bytes) -> Converted:
    """Title, authors and number of pages as the own reader finds them; blank where it can't."""
    blank = {"title": "", "authors": "", "n_pages": 0}
    try:
        got = native_text(data, {})
        return {k: got[k] for k in blank}
    except Exception:  # noqa: BLE001  another backend has the text; metadata is extra
        return blank


def optional_fast(data: bytes, options: dict) -> Converted:
    """pymupdf4llm where it is installed, else the own reader."""
    if importlib.util.find_spec("pymupdf4llm") is None:
        return native_text(data, options)
    import pymupdf
    import pymupdf4llm

    with pymupdf.open(stream=data, filetype="pdf") as doc:
        info = doc.metadata or {}
        return {"markdown": pymupdf4llm.to_markdown(doc), "title": (info.get("title") or "").strip(), "authors": (info.get("author") or "").strip(), "n_pages": doc.page_count, "images": {}}


_models: dict = {}


def optional_structured(data: bytes, options: dict) -> Converted:
    """marker; its models are loaded once per worker."""
    import os
    import tempfile

    from marker.converters.pdf import PdfConverter
    from marker.models import create_model_dict
    from marker.output import text_from_rendered

    if "models" not in _models:
        _models["models"] = create_model_dict()
    with tempfile.NamedTemporaryFile(suffix=".pdf", delete=False) as f:
        f.write(data)
    try:
        rendered = PdfConverter(artifact_dict=_models["models"], config=options or None)(f.name)
    finally:
        os.unlink(f.name)
    text, _, images = text_from_rendered(rendered)
    own = info(data)
    meta = getattr(rendered, "metadata", None) or {}
    return {"markdown": text, "title": own["title"] or str(meta.get("title") or "").strip(), "authors": own["authors"], "n_pages": own["n_pages"], "images": images or {}}


def png(image: object) -> bytes:
    """The bytes of an image; whatever is no bytes yet is saved as its own save() does."""
    import io

    if isinstance(image, (bytes, bytearray)):
        return bytes(image)
    out = io.BytesIO()
    image.save(out, format="PNG")
    return out.getvalue()


# Where the package is missing the own reader stands in; its results never pass for the package's in the cache.
OWN_READER = "paperloom-reader"
BACKENDS: dict[str, Backend] = {
    FAST: Backend(FAST, optional_fast, stored_as=None if importlib.util.find_spec("pymupdf4llm") else OWN_READER),
    STRUCTURED: Backend(STRUCTURED, optional_structured, requires="marker", mines=True),
}


def register(backend: Backend) -> None:
    BACKENDS[backend.name] = backend


def checked(backend: str) -> str:
    if backend == RESERVED:
        raise NotImplementedError(f"the backend {RESERVED} is reserved")
    if backend not in ("auto", *BACKENDS):
        raise ValueError(f"unknown backend {backend!r}")
    return backend


def converted(files: DataFrame, backend: Backend, options: dict | None = None) -> DataFrame:
    """(sha16, path, content) through a backend: RAW rows. An exception becomes the row's problem.

    images are the names in order, null for one whose bytes could not be taken (a gap in the numbers); data are the others' bytes.
    """
    settings = options or {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for x in zip(*batch.columns, strict=True):  # a paper at a time; results go on some at a time
                held.append(raw_row(*(c.as_py() for c in x), backend, settings))
                size += len(held[-1]["markdown"] or "") + sum(len(d["data"]) for d in held[-1]["data"])
                if len(held) >= HELD_ROWS or size >= HELD_BYTES:
                    yield pa.RecordBatch.from_pylist(held, schema=RAW_ARROW)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=RAW_ARROW)

    return files.select("sha16", "path", "content").mapInArrow(run, RAW)


def raw_row(sha16: str, path: str, data: bytes | None, backend: Backend, options: dict) -> dict:
    """A row of RAW: one paper through a backend, whose exceptions become its problem."""
    row = {"sha16": sha16, "path": path, "markdown": "", "title": "", "authors": "", "n_pages": 0, "images": [], "data": [], "problem": None}
    try:
        got = backend.convert(bytes(data), backend.options | options)
        row |= {k: got[k] for k in ("markdown", "title", "authors", "n_pages")}
        for name, image in sorted((str(k).replace("/", "_"), v) for k, v in dict(got.get("images") or {}).items()):
            try:
                row["data"].append({"name": name, "data": png(image)})
                row["images"].append(name)
            except Exception:  # noqa: BLE001
                row["images"].append(None)
    except Exception as e:  # noqa: BLE001
        row["problem"] = f"{type(e).__name__}: {e}"
    return row


def document(raw: DataFrame, backend: Backend) -> DataFrame:
    """RAW rows as (sha16, path, problem, doc, data): references split off, tables harvested from what is left, figures in name order."""
    body = body_without_references(F.col("markdown"))
    raw = raw.withColumn("__body", body)
    none = lambda t: F.from_json(F.lit("[]"), t)
    figure = "array<struct<index:int,image_path:string,caption:string,page:int,bbox:array<double>,kind:string>>"
    table = "array<struct<index:int,markdown:string,caption:string,page:int>>"
    own_figures = F.transform(F.filter(figures(F.col("images")), lambda f: f["image_path"].isNotNull()), lambda f: F.struct(f["index"].alias("index"), f["image_path"].alias("image_path"), f["caption"].alias("caption"), f["page"].alias("page"), F.lit(None).cast("array<double>").alias("bbox"), F.lit(None).cast("string").alias("kind")))
    blank = F.lit(None if backend.mines else "").cast("string")
    meta = F.struct(F.col("title").alias("title"), F.col("authors").alias("authors"), blank.alias("year"), blank.alias("abstract"), F.col("n_pages").alias("n_pages"), F.lit(None).cast("string").alias("auto_fallback"))
    doc = F.struct(
        F.col("__body").alias("markdown"), (own_figures if backend.mines else none(figure)).alias("figures"), (tables(F.col("__body")) if backend.mines else none(table)).alias("tables"),
        F.transform(references(F.col("markdown")), lambda r: F.struct(r.alias("raw"))).alias("references"), meta.alias("metadata"), F.lit(backend.name).alias("backend"),
    )
    return raw.select("sha16", "path", "problem", doc.alias("doc"), "data")


def located(doc: Column, folder: str) -> Column:
    """The document with the paths of its figures' files, <folder>/<sha16>/<name>."""
    placed = F.transform(doc["figures"], lambda f: f.withField("image_path", F.concat(F.lit(f"{folder.rstrip('/')}/"), F.col("sha16"), F.lit("/"), f["image_path"])))
    return F.when(doc.isNotNull(), doc.withField("figures", placed))


def through(files: DataFrame, name: str, cache: DocCache | None, options: dict | None = None, figures_dir: str | None = None) -> DataFrame:
    """(sha16, path, problem, doc) of one backend: cached documents, and the others converted once per content and cached.

    What fails is never cached as a document; its reason is kept in the cache's failures and told in `problem`, and the content
    is tried anew next time. A document that failed has no doc. Images of a backend that mines are files in `figures_dir`, by
    default in the cache's folder, also without a cache; the figures' paths name them.
    """
    backend = BACKENDS[name]
    if not backend.available(files.sparkSession):
        raise ImportError(f"the backend {name} needs the module {backend.requires}")
    folder = (figures_dir or (cache or DocCache(files.sparkSession)).figure_folder(backend.cached_as)) if backend.mines else None
    told = lambda doc: located(doc, folder) if folder else doc
    if cache is None:
        docs = document(converted(files, backend, options), backend)
        if folder:
            docs = written(docs, "extracted")  # images and documents come from one conversion
            export_images(docs.where("problem IS NULL").select("sha16", F.explode("data").alias("d")).select("sha16", "d.name", "d.data"), folder)
        return docs.select("sha16", "path", "problem", F.when(F.col("problem").isNull(), told(F.col("doc"))).alias("doc"))
    names = written(files.select("sha16", "path"), "names")  # bytes are hashed once
    missing = first_of_content(cache.misses(names, backend.cached_as)).select("sha16", "path")
    n = missing.count()
    if n:
        # bytes stay where they are read as long as the list of paths is small; beyond that they are dealt by key, but never sorted
        wanted = F.broadcast(missing) if n <= PATHS_TO_BROADCAST else missing.hint("shuffle_hash")
        keep(document(converted(files.join(wanted, ["sha16", "path"], "left_semi"), backend, options), backend), backend, cache)
    if figures_dir and backend.mines:
        cache.export_figures(names, backend.cached_as, figures_dir)
    found = names.join(cache.hits(names.select("sha16").distinct(), backend.cached_as).withColumnRenamed("cached", "doc"), "sha16", "left")
    why = cache.failures(backend.cached_as).withColumnRenamed("problem", "__why")
    return found.join(why, "sha16", "left").select("sha16", "path", F.when(F.col("doc").isNull(), F.coalesce("__why", F.lit("not converted"))).alias("problem"), told(F.col("doc")).alias("doc"))


def keep(docs: DataFrame, backend: Backend, cache: DocCache) -> None:
    """Saves document() rows, each conversion run once."""
    store(written(docs, "converted"), backend, cache)


def store(docs: DataFrame, backend: Backend, cache: DocCache) -> None:
    """Saves document() rows that are written already: images, documents and failures."""
    if backend.mines:  # files first, so that no document names one that isn't there
        cache.save_figures(docs.where(F.col("problem").isNull()).select("sha16", F.explode("data").alias("d")).select("sha16", "d.name", "d.data"), backend.cached_as)
    cache.save(docs.where(F.col("problem").isNull()), backend.cached_as)
    cache.save_failures(docs.where(F.col("problem").isNotNull()), backend.cached_as)


def extract(spark: SparkSession, path: str, backend: str = "auto", figures_dir: str | None = None, skip_ocr: bool = False, use_cache: bool = True, cache: DocCache | None = None, thin: int = THIN) -> DataFrame:
    """One row per PDF under `path`: sha16, path, problem, doc. A missing path is told before an unknown backend.

    auto: documents whose body has fewer than `thin` characters, and those that the fast backend could not read, take the
    structured backend; where that is not installed they keep the fast result, with metadata.auto_fallback, which is never cached.
    Images are files in the cache, or in `figures_dir`/sha16/ where that is given; image_path names them.
    """
    files = pdf_files(spark, path)
    checked(backend)
    return extract_files(with_key(files), backend, figures_dir, skip_ocr, use_cache, cache, thin)


def extract_files(files: DataFrame, backend: str = "auto", figures_dir: str | None = None, skip_ocr: bool = False, use_cache: bool = True, cache: DocCache | None = None, thin: int = THIN) -> DataFrame:
    """As extract(), over (sha16, path, content)."""
    spark = files.sparkSession
    cache = (cache or DocCache(spark)) if use_cache else None
    options = {"skip_ocr": skip_ocr}

    if checked(backend) != "auto":
        return through(files, backend, cache, options, figures_dir)
    fast = through(files, FAST, cache, options)
    if cache is None:
        fast = written(fast, "fast")  # both branches read it; with a cache both read the cache
    if not BACKENDS[STRUCTURED].available(spark):  # nothing is converted again, so one pass does
        flagged = F.col("doc").withField("metadata", F.col("doc.metadata").withField("auto_fallback", F.lit(f"{STRUCTURED}_unavailable")))
        return fast.withColumn("doc", F.when(short(F.col("doc.markdown"), thin), flagged).otherwise(F.col("doc")))
    thick, rest = routed(fast, thin)
    again = files.join(rest.select("sha16", "path"), ["sha16", "path"], "left_semi")
    return thick.unionByName(through(again, STRUCTURED, cache, options, figures_dir))


def routed(docs: DataFrame, thin: int = THIN, markdown: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows whose body is long enough, and the thin ones."""
    thin_one = short(F.col("doc.markdown") if markdown is None else markdown, thin)
    return docs.where(~thin_one), docs.where(thin_one)


def short(markdown: Column, thin: int) -> Column:
    return F.coalesce(is_thin(markdown, thin), F.lit(True))
