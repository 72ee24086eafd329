"""Preflight verdicts on generated files, and extraction end to end."""

import importlib.machinery
import io
import json
import os
import re
import sys
import time
import types
from contextlib import redirect_stderr, redirect_stdout

import pandas as pd
import pyarrow as pa
import pyarrow.fs
import pytest
from pyspark.sql import functions as F

from paperloom import bulk_cli, cli, extract
from paperloom.functions.keys import FAST, STRUCTURED
from paperloom.operators import extract as ex
from paperloom.operators.cache import DocCache
from paperloom.operators.preflight import preflight
from paperloom.plans import bulk
from paperloom.sources import files, images, pdf
from paperloom.streaming.ingest import ingest, ingested
from tests.pdfs import objects_of, packed, simple, updated, written

OWN = ex.BACKENDS[FAST].cached_as
PAGES = [[(10, "one")], [(10, "two")]]
CASES = {
    "good": (simple(3), "PASS", (3, 3, 3), ""),
    "packed": (packed(2), "PASS", (2, 2, 2), ""),
    "count-high": (simple(3, count=5), "FAIL", (5, 3, 3), ""),
    "count-low": (simple(3, count=1), "FAIL", (1, 3, 3), ""),
    "count-real": (simple(3, count="3.0"), "UNAVAILABLE", (None, None, None), "page-tree-unresolvable"),
    "count-string": (simple(3, count="(3)"), "UNAVAILABLE", (None, None, None), "page-tree-unresolvable"),
    "no-pages": (simple(1, extra={1: b"<< /Type /Catalog >>"}), "UNAVAILABLE", (None, None, None), "page-tree-unresolvable"),
    "cycle": (simple(1, kids="4 0 R 2 0 R"), "UNAVAILABLE", (1, None, None), "page-tree-walk"),
    "shared": (simple(1, kids="4 0 R 4 0 R", count=2), "UNAVAILABLE", (2, None, None), "page-tree-walk"),
    "odd-node": (simple(1, kids="4 0 R 3 0 R", count=2), "UNAVAILABLE", (2, None, None), "page-tree-walk"),
    "trailing": (simple(1) + b"left over", "UNAVAILABLE", (1, 1, 1), "trailing-data"),
    "padding": (simple(1) + b"\x00\x00 \r\n", "PASS", (1, 1, 1), ""),
    "vertical-tab": (simple(1) + b"\x0b", "UNAVAILABLE", (1, 1, 1), "trailing-data"),
    "orphan": (updated(simple(1), {30: b"<< /New true >>"}, stale=True), "UNAVAILABLE", (1, 1, 1), "xref-coverage: objects"),
    "superseded": (updated(simple(1), {3: b"<< /Type /Font >>"}, stale=True), "UNAVAILABLE", (1, 1, 1), "xref-coverage: later"),
    "displaced": (updated(packed(1), {3: b"<< /Type /Font >>"}, stale=True), "UNAVAILABLE", (1, 1, 1), "xref-coverage: direct"),
    "update": (updated(simple(1), {30: b"<< /New true >>"}), "PASS", (1, 1, 1), ""),
    "encrypted": (written(objects_of(PAGES), "/Encrypt << /Filter /Standard >>"), "UNAVAILABLE", (None, None, None), "encrypted"),
    "empty-tree": (simple(0), "UNAVAILABLE", (0, 0, 0), "empty-page-tree"),
    "junk-before": (written(objects_of(PAGES), before=b"junk junk\n"), "UNAVAILABLE", (2, 2, 2), "parser: cross-reference rebuilt"),
    "truncated": (simple(2)[:-200], "UNAVAILABLE", None, "parser"),
    "no-pdf": (b"hello", "UNAVAILABLE", (None, None, None), "parse-error"),
    "empty": (b"", "UNAVAILABLE", (None, None, None), "parse-error"),
    "unreadable": (None, "UNAVAILABLE", (None, None, None), "unreadable"),
}


def test_verdicts(spark):
    rows = spark.createDataFrame([(k, v[0]) for k, v in CASES.items()], "path string, content binary")
    got = {r["file"]: r for r in preflight(rows).collect()}
    assert len(got) == len(CASES)
    for name, (data, verdict, counts, word) in CASES.items():
        r = got[name]
        assert r["verdict"] == verdict, (name, r)
        if counts:
            assert (r["declared_page_count"], r["enumerated_page_count"], r["reader_page_count"]) == counts, (name, r)
        assert any(w.startswith(word) for w in r["warnings"]) if word else r["warnings"] == [], (name, r)
        assert (r["sha256"] is None) == (data is None)


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "pdfs").mkdir()
    (tmp_path / "pdfs" / "a.pdf").write_bytes(simple(3))
    (tmp_path / "pdfs" / "copy.pdf").write_bytes(simple(3))
    (tmp_path / "pdfs" / "thin.pdf").write_bytes(written(objects_of([[(10, "short")]])))
    (tmp_path / "pdfs" / "note.txt").write_text("no pdf")
    return tmp_path


def structured_stub(monkeypatch, calls):
    def convert(data, options):
        return {"markdown": "# S\n\nTable 1. Things\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\nEnd.\n\n# References\n\n[1] A long enough entry of the list, 1999.\n", "title": "", "authors": "", "n_pages": 1, "images": {"page_10_x.png": b"x", "page_2_x.png": b"y"}}

    monkeypatch.setitem(ex.BACKENDS, STRUCTURED, ex.Backend(STRUCTURED, convert, mines=True))


def test_extract_fast_cached_and_errors(spark, folder):
    cache = DocCache(spark, str(folder / "cache"))
    got = extract(spark, str(folder / "pdfs"), backend=FAST, cache=cache).collect()
    assert len(got) == 3
    doc = next(r["doc"] for r in got if r["path"].endswith("/a.pdf"))
    assert "# Heading 0" in doc["markdown"] and "Some body text of page 2" in doc["markdown"]
    assert doc["metadata"]["title"] == "A Title" and doc["metadata"]["authors"] == "Ann Author" and doc["metadata"]["n_pages"] == 3 and doc["metadata"]["year"] == ""
    assert doc["tables"] == [] and doc["figures"] == [] and doc["backend"] == FAST
    assert cache.all().count() == 2  # equal contents share an entry
    # a changed entry shows that the cache is read
    cache.all().withColumn("doc", F.regexp_replace("doc", "Some body", "SENTINEL")).withColumn("written_at", F.col("written_at") + F.expr("INTERVAL 1 HOUR")).write.mode("append").partitionBy("backend", "extract_version").parquet(cache.path)
    again = extract(spark, str(folder / "pdfs"), backend=FAST, cache=cache).collect()
    assert sum("SENTINEL" in r["doc"]["markdown"] for r in again) == 2
    plain = extract(spark, str(folder / "pdfs"), backend=FAST, use_cache=False).collect()
    assert not any("SENTINEL" in r["doc"]["markdown"] for r in plain)
    with pytest.raises(FileNotFoundError):
        extract(spark, str(folder / "missing.pdf"), backend="nonsense")
    with pytest.raises(ValueError):
        extract(spark, str(folder / "pdfs"), backend="nonsense")
    with pytest.raises(NotImplementedError):
        extract(spark, str(folder / "pdfs"), backend="docling")


def test_auto_routes_thin_documents(spark, folder, monkeypatch):
    cache = DocCache(spark, str(folder / "cache"))
    if not ex.BACKENDS[STRUCTURED].available(spark):
        got = {r["path"].rsplit("/", 1)[1]: r["doc"] for r in extract(spark, str(folder / "pdfs"), cache=cache).collect()}
        assert got["thin.pdf"]["metadata"]["auto_fallback"] == "marker_unavailable" and got["a.pdf"]["metadata"]["auto_fallback"] is None
        assert '"auto_fallback":"' not in "".join(r["doc"] for r in cache.all().collect())
        with pytest.raises(ImportError):
            extract(spark, str(folder / "pdfs"), backend=STRUCTURED, use_cache=False)
    structured_stub(monkeypatch, [])
    got = {r["path"].rsplit("/", 1)[1]: r["doc"] for r in extract(spark, str(folder / "pdfs"), cache=cache, figures_dir=str(folder / "figs")).collect()}
    thin = got["thin.pdf"]
    assert thin["backend"] == STRUCTURED and got["copy.pdf"]["backend"] == FAST
    assert thin["tables"][0]["caption"] == "Table 1. Things" and thin["references"][0]["raw"].startswith("[1]") and thin["metadata"]["year"] is None
    assert [(f["index"], os.path.basename(f["image_path"]), f["page"]) for f in thin["figures"]] == [(0, "page_10_x.png", 10), (1, "page_2_x.png", 2)]
    assert all(os.path.exists(f["image_path"]) and f["image_path"].startswith(str(folder / "figs")) for f in thin["figures"])
    assert len(list((folder / "figs").glob("*/*.png"))) == 2


def test_cache_keys_evict_and_corruption(spark, folder):
    cache = DocCache(spark, str(folder / "cache"))
    f = files.with_key(files.pdf_files(spark, str(folder / "pdfs"))).select("sha16", "path", "content").persist()
    assert all(len(r["sha16"]) == 16 for r in f.collect())
    extract(spark, str(folder / "pdfs"), backend=FAST, cache=cache).count()
    assert cache.misses(f, STRUCTURED).count() == 3 and cache.misses(f, OWN).count() == 0
    # the own reader's results don't pass for the package's
    assert OWN != FAST and cache.misses(f, FAST).count() == 3
    assert DocCache(spark, str(folder / "cache"), version="9").misses(f, OWN).count() == 3
    keys = f.where(F.col("path").endswith("/a.pdf"))
    assert cache.evict(keys, OWN) == 1 and cache.evict(keys, OWN) == 0 and cache.misses(f, OWN).count() == 2
    bad = spark.createDataFrame([(keys.first()["sha16"], "{not valid")], "sha16 string, doc string")
    bad.select("sha16", "doc", F.current_timestamp().alias("written_at"), F.lit(OWN).alias("backend"), F.lit(cache.version).alias("extract_version")).write.mode("append").partitionBy("backend", "extract_version").parquet(cache.path)
    assert cache.misses(f, OWN).count() == 2 and cache.inventory().first()["entries"] == 2
    cache.evict_older(OWN, 60)
    assert cache.inventory().first()["entries"] == 2
    assert sorted(p.name for p in (folder / "cache").iterdir() if p.name.startswith(".")) == []  # nothing is left beside the tables


def test_lookups_read_no_documents_that_were_saved_here(spark, folder):
    cache = DocCache(spark, str(folder / "cache"))
    f = files.with_key(files.pdf_files(spark, str(folder / "pdfs"))).select("sha16", "path")
    extract(spark, str(folder / "pdfs"), backend=FAST, cache=cache).count()
    plan = cache.misses(f, OWN)._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.split("\n") if "ReadSchema" in x or "Scan parquet" in x]
    with_doc = [x for x in scans if "doc:string" in x]
    assert scans and all("IsNull(checked)" in x for x in with_doc)  # only what another program wrote is decoded


def test_failures_are_told_and_never_cached(spark, folder, monkeypatch):
    (folder / "pdfs" / "broken.pdf").write_bytes(b"no document at all")
    cache = DocCache(spark, str(folder / "cache"))
    for kept in (cache, None, cache):
        got = {r["path"].rsplit("/", 1)[1]: r for r in extract(spark, str(folder / "pdfs"), backend=FAST, cache=kept, use_cache=kept is not None).collect()}
        assert got["broken.pdf"]["doc"] is None and got["broken.pdf"]["problem"].startswith("PdfError") and got["a.pdf"]["problem"] is None
    assert cache.keys(OWN).count() == 2 and cache.failures(OWN).count() == 1
    # auto takes what the fast backend can't read to the structured one
    structured_stub(monkeypatch, [])
    auto = {r["path"].rsplit("/", 1)[1]: r for r in extract(spark, str(folder / "pdfs"), cache=cache).collect()}
    assert auto["broken.pdf"]["doc"]["backend"] == STRUCTURED and auto["broken.pdf"]["problem"] is None
    # once it can be read, it is
    monkeypatch.setitem(ex.BACKENDS, FAST, ex.Backend(FAST, lambda d, o: {"markdown": "now " * 40, "title": "", "authors": "", "n_pages": 1, "images": {}}, stored_as=OWN))
    later = {r["path"].rsplit("/", 1)[1]: r for r in extract(spark, str(folder / "pdfs"), backend=FAST, cache=cache).collect()}
    assert later["broken.pdf"]["problem"] is None and later["broken.pdf"]["doc"]["markdown"].startswith("now")


def test_figures_are_kept_in_the_cache(spark, folder, monkeypatch):
    structured_stub(monkeypatch, [])
    cache = DocCache(spark, str(folder / "cache"))
    got = extract(spark, str(folder / "pdfs"), backend=STRUCTURED, cache=cache).collect()
    assert all([os.path.basename(f["image_path"]) for f in r["doc"]["figures"]] == ["page_10_x.png", "page_2_x.png"] for r in got)
    assert all(os.path.exists(f["image_path"]) for r in got for f in r["doc"]["figures"])
    kept = {(r["sha16"], r["name"]): bytes(r["data"]) for r in cache.figures(STRUCTURED).collect()}
    assert len(kept) == 4 and {v for (_, n), v in kept.items() if n == "page_2_x.png"} == {b"y"}
    assert cache.export_figures(spark.createDataFrame([(got[0]["sha16"],)], "sha16 string"), STRUCTURED, str(folder / "out")) == 2
    assert (folder / "out" / got[0]["sha16"] / "page_10_x.png").read_bytes() == b"x"
    extract(spark, str(folder / "pdfs"), backend=STRUCTURED, use_cache=False, figures_dir=str(folder / "plain")).count()
    assert len(list((folder / "plain").glob("*/*.png"))) == 4

    class Odd:
        def save(self, *_, **__):
            raise OSError("no")

    convert = lambda d, o: {"markdown": "x", "title": "", "authors": "", "n_pages": 1, "images": {"page_1_a": b"a", "page_2_b": Odd(), "page_3_c": b"c"}}
    monkeypatch.setitem(ex.BACKENDS, STRUCTURED, ex.Backend(STRUCTURED, convert, mines=True))
    figures = extract(spark, str(folder / "pdfs" / "thin.pdf"), backend=STRUCTURED, use_cache=False, figures_dir=str(folder / "odd")).first()["doc"]["figures"]
    assert [(f["index"], os.path.basename(f["image_path"]), f["page"]) for f in figures] == [(0, "page_1_a", 1), (1, "page_3_c", 3)]


def test_files_are_written_by_tasks_and_taken_away_again(spark, tmp_path):
    out = str(tmp_path / "files")
    rows = spark.createDataFrame([(f"k{i % 5}", f"{i}.bin", bytearray(b"%d" % i)) for i in range(60)] + [("k0", "none", None)], "folder string, name string, data binary").repartition(6)
    images.write_files(rows, out)
    assert {p.name: p.read_bytes() for p in (tmp_path / "files").rglob("*.bin")} == {f"{i}.bin": b"%d" % i for i in range(60)}
    writer = images.FileWriter(out)
    batch = lambda *r: pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*r, strict=True)], names=["folder", "name", "data"])
    told = writer.write(iter([batch(("k0", "0.bin", b"other"), ("new", "x.bin", b"x"))]))
    assert (told.files, told.bytes) == (2, 6) and (tmp_path / "files" / "new" / "x.bin").exists()
    writer.abort([told, None])
    assert not (tmp_path / "files" / "new" / "x.bin").exists() and (tmp_path / "files" / "k0" / "0.bin").exists()
    assert [p.name for p in (tmp_path / "files").iterdir() if p.name.startswith(".")] == []


def test_a_replayed_batch_leaves_the_same_rows(spark, folder):
    run = lambda: ingest(spark, str(folder / "pdfs"), DocCache(spark, str(folder / "cache")), str(folder / "check"), str(folder / "out"), FAST, per_batch=1).awaitTermination()
    run()
    first = sorted(ingested(spark, str(folder / "out")).select("path", "sha16").collect())
    for mark in (folder / "check" / "commits").iterdir():
        if mark.name.lstrip(".").startswith("2"):
            mark.unlink()
    (folder / "out").rglob("_SUCCESS").__next__().unlink()  # and one batch's end was never written
    run()
    assert sorted(ingested(spark, str(folder / "out")).select("path", "sha16").collect()) == first and len(first) == 3


def test_options_reach_the_backend(spark, folder, monkeypatch):
    monkeypatch.setitem(ex.BACKENDS, STRUCTURED, ex.Backend(STRUCTURED, lambda d, o: {"markdown": repr(o), "title": "", "authors": "", "n_pages": 1, "images": {}}, options={"given": 1}))
    told = [extract(spark, str(folder / "pdfs" / "a.pdf"), backend=STRUCTURED, use_cache=False, skip_ocr=skip).first()["doc"]["markdown"] for skip in (True, False)]
    assert told == ["{'given': 1, 'skip_ocr': True}", "{'given': 1, 'skip_ocr': False}"]


def test_adapters_of_optional_packages(monkeypatch):
    """The calls that the adapters make, against stand-ins for the packages."""
    made = []

    class Opened:
        metadata, page_count = {"title": " T ", "author": None}, 7

        def __enter__(self):
            return self

        def __exit__(self, *_):
            made.append("closed")

    pymupdf = types.SimpleNamespace(open=lambda stream, filetype: made.append((stream, filetype)) or Opened())
    fast = types.SimpleNamespace(to_markdown=lambda doc: "# md")
    fast.__spec__ = importlib.machinery.ModuleSpec("pymupdf4llm", None)
    monkeypatch.setitem(sys.modules, "pymupdf", pymupdf)
    monkeypatch.setitem(sys.modules, "pymupdf4llm", fast)
    assert ex.optional_fast(b"pdf", {}) == {"markdown": "# md", "title": "T", "authors": "", "n_pages": 7, "images": {}}
    assert made == [(b"pdf", "pdf"), "closed"]

    class Converter:
        def __init__(self, artifact_dict, config):
            made.append((artifact_dict, config))

        def __call__(self, path):
            with open(path, "rb") as f:
                made.append(f.read())
            return types.SimpleNamespace(metadata={"title": "Given"})

    loads = []
    monkeypatch.setattr(ex, "_models", {})
    for name, content in {"marker": {}, "marker.converters": {}, "marker.converters.pdf": {"PdfConverter": Converter}, "marker.models": {"create_model_dict": lambda: loads.append(1) or "models"}, "marker.output": {"text_from_rendered": lambda r: ("text", "md", {"page_1.png": b"i"})}}.items():
        monkeypatch.setitem(sys.modules, name, types.SimpleNamespace(**content))
    made.clear()
    for _ in range(2):
        got = ex.optional_structured(simple(2), {"skip_ocr": True})
    assert got == {"markdown": "text", "title": "A Title", "authors": "Ann Author", "n_pages": 2, "images": {"page_1.png": b"i"}}
    assert made[0] == ("models", {"skip_ocr": True}) and made[1] == simple(2) and loads == [1]
    assert ex.optional_structured(b"no pdf", {})["title"] == "Given"  # metadata is extra; the text stays


def test_bulk_run(spark, folder, monkeypatch):
    structured_stub(monkeypatch, [])
    (folder / "pdfs" / "bad.pdf").write_bytes(simple(3, count=7))
    lib = [{"citekey": k, "created": c, "attachments": [{"mimeType": "application/pdf", "filename": f"All Papers/{n}"}]} for k, c, n in (("old", 1, "a.pdf"), ("new", 9, "thin.pdf"), ("cited", 0, "copy.pdf"), ("wrong", 5, "bad.pdf"), ("gone", 5, "nowhere.pdf"))]
    lib += [{"citekey": "none", "attachments": None}, {"citekey": "html", "attachments": [{"mimeType": "text/html", "filename": "a.pdf"}]}]
    (folder / "lib.json").write_text(json.dumps(lib))
    (folder / "paper-x" / "deep").mkdir(parents=True)
    (folder / "paper-x" / "deep" / "references.bib").write_text("@article{cited,\n}\n@book{ other ,\n}")
    (folder / "block.json").write_text(json.dumps({"old": {"reason": "memory", "rss_mb": 5000, "pdf": "a.pdf", "date": "2020-01-01"}}))
    cited = files.project_citekeys(spark, str(folder))
    assert {r["citekey"] for r in cited.collect()} == {"cited", "other"}
    pdfs = files.with_key(files.pdf_files(spark, str(folder / "pdfs")))
    listing = pdfs.select(F.substring_index("path", "/", -1).alias("name"), "path")
    entries = bulk.with_priority(bulk.resolved(files.library(spark, str(folder / "lib.json")), listing), cited)
    assert [r["citekey"] for r in entries.orderBy(*bulk.order()).collect()] == ["cited", "new", "wrong", "old"]
    cache = DocCache(spark, str(folder / "cache"))
    keyed = entries.join(pdfs.select("path", "sha16"), "path")
    todo = bulk.queue(keyed, cache.entries(STRUCTURED), files.blocklist(spark, str(folder / "block.json")), 10)
    log = {r["citekey"]: r for r in bulk.run(spark, todo, cache, bulk.Budget(per_task=2, rss_mb=0), sidecars=str(folder / "sidecars"), free=lambda: 100.0).collect()}
    assert {k: r["status"] for k, r in log.items()} == {"cited": "ok", "new": "ok", "wrong": "preflight"}
    assert log["cited"]["n_tabs"] == 1 and log["cited"]["n_figs"] == 2 and log["cited"]["n_refs"] == 1
    assert spark.read.json(str(folder / "sidecars")).first()["verdict"] == "FAIL"
    assert bulk.queue(keyed, cache.entries(STRUCTURED), files.blocklist(spark, str(folder / "no.json")), 10).select("citekey").collect()[0][0] == "wrong"
    assert bulk.run(spark, todo, cache, bulk.Budget(), free=lambda: 1.0).count() == 0
    files.save_blocklist(files.blocklist(spark, str(folder / "block.json")), str(folder / "again.json"))
    assert json.loads((folder / "again.json").read_text())["old"]["rss_mb"] == 5000


def test_bulk_command_line(spark, folder, monkeypatch):
    structured_stub(monkeypatch, [])
    monkeypatch.setenv("HOME", str(folder))
    (folder / "lib.json").write_text(json.dumps([{"citekey": "k1", "created": 3, "attachments": [{"mimeType": "application/pdf", "filename": "All Papers/a.pdf"}]}, {"citekey": "k2", "attachments": [{"mimeType": "application/pdf", "filename": "thin.pdf"}]}]))

    def run(*args):
        out = io.StringIO()
        with redirect_stdout(out), redirect_stderr(io.StringIO()):
            code = bulk_cli.main([*args, "--pdf-root", str(folder / "pdfs"), "--state", str(folder / "state"), "--max-rss-mb", "0", "--min-free-percent", "0"], spark)
        return code, out.getvalue()

    code, out = run("--library-json", str(folder / "lib.json"))
    assert code == 0 and "queue: 0 hot, 2 other, 0 cached, 0 blocklisted" in out and out.index("[ok] k1") < out.index("[ok] k2") and "done: 2 ok" in out
    assert "2 cached" in run("--library-json", str(folder / "lib.json"))[1]
    assert run("--library-json", str(folder / "no.json"))[0] == 1
    with bulk.Lock(str(folder / "state" / "bulk.lock")):
        assert "busy" in run("--library-json", str(folder / "lib.json"))[1]


def test_bibliographies_with_stray_bytes(spark, tmp_path):
    (tmp_path / "paper-y").mkdir()
    (tmp_path / "paper-y" / "main.bib").write_bytes("@article{müller2020,\n}\n".encode() + b"% stray \xff byte\n@book{na\xffme,\n}\n")
    assert {r["citekey"] for r in files.project_citekeys(spark, str(tmp_path)).collect()} == {"müller2020", "name"}


def test_memory_is_looked_at_while_a_paper_runs():
    def convert(data, options):
        held = bytearray(int(data) << 20)
        held[:: 4096] = b"x" * len(held[:: 4096])
        time.sleep(0.05 if int(data) < 200 else 20)
        return {"size": len(held)}

    base = bulk.resident_mb(os.getpid())
    run = bulk.guarded(convert, 30, base + 300, every=0.05)
    began = time.monotonic()
    assert run(b"1", {}) == {"size": 1 << 20}
    with pytest.raises(MemoryError):  # ended while it runs, not after its 20 s
        run(b"700", {})
    assert time.monotonic() - began < 15
    assert run(b"2", {}) == {"size": 2 << 20}  # the next paper isn't blamed


def test_a_conversion_that_dies_or_raises_or_is_late():
    def convert(data, options):
        if data == b"die":
            os._exit(3)
        if data == b"raise":
            raise ValueError("bad file")
        time.sleep(0.1)
        return {"pid": os.getpid()}

    run = bulk.guarded(convert, 5, 0)
    first = run(b"", {})["pid"]
    assert first != os.getpid() and run(b"", {})["pid"] == first  # one child for all papers
    with pytest.raises(RuntimeError):
        run(b"die", {})
    with pytest.raises(ValueError, match="bad file"):
        run(b"raise", {})
    assert run(b"", {})["pid"] != first
    with pytest.raises(InterruptedError):
        bulk.guarded(convert, 5, 0, until=time.time() - 1)(b"", {})


def test_papers_after_the_deadline_are_left_out(spark, folder, monkeypatch):
    structured_stub(monkeypatch, [])
    found = files.with_key(files.pdf_files(spark, str(folder / "pdfs"))).select(F.lit("k").alias("citekey"), "path", "sha16")
    cache = DocCache(spark, str(folder / "cache"))
    moments = iter([0.0, 0.0, 10.0])
    monkeypatch.setattr(bulk.time, "monotonic", lambda: 0.0)  # the loop goes on, so the executors must stop
    monkeypatch.setattr(bulk.time, "time", lambda: next(moments, -100.0) - 50.0)
    log = bulk.run(spark, found, cache, bulk.Budget(seconds=1, rss_mb=0), free=lambda: 100.0)
    assert log.count() == 0 and cache.keys(STRUCTURED).count() == 0 and cache.failures(STRUCTURED).count() == 0


def test_a_slow_paper_holds_up_no_other_and_a_cut_run_loses_none(spark, folder, monkeypatch):
    def convert(data, options):
        if b"slow" in data:
            time.sleep(60)
        return {"markdown": "text " * 40, "title": "", "authors": "", "n_pages": 1, "images": {}}

    monkeypatch.setitem(ex.BACKENDS, STRUCTURED, ex.Backend(STRUCTURED, convert, mines=True))
    for i in range(6):
        (folder / "pdfs" / f"p{i}.pdf").write_bytes(written(objects_of([[(10, f"paper {i}")]], title="slow" if i == 0 else f"T{i}")))
    found = files.with_key(files.pdf_files(spark, str(folder / "pdfs"))).where(F.col("path").rlike(r"/p\d\.pdf$")).select(F.substring_index("path", "/", -1).alias("citekey"), "path", "sha16")
    cache = DocCache(spark, str(folder / "cache"))
    began = time.monotonic()
    log = bulk.run(spark, found.orderBy("citekey"), cache, bulk.Budget(per_paper=8, rss_mb=0), free=lambda: 100.0, log_path=str(folder / "log")).collect()
    assert [(r["citekey"], r["status"]) for r in log] == [("p0.pdf", "timeout")] + [(f"p{i}.pdf", "ok") for i in range(1, 6)]
    assert time.monotonic() - began < 60 and spark.read.parquet(str(folder / "log")).count() == 6
    assert not list((folder / "cache" / "inbox").rglob("*.parquet"))
    # a run that was cut before it took its results over
    own, inbox = ex.BACKENDS[STRUCTURED], folder / "cache" / "inbox" / STRUCTURED / "cut"
    (inbox / "papers").mkdir(parents=True)
    bulk.put(pa.fs.LocalFileSystem(), str(inbox / "papers"), ex.raw_row("0123456789abcdef", "x.pdf", b"any", own, {}))
    assert bulk.left_over(spark, cache, own) == 1 and not inbox.exists()
    assert cache.hits(spark.createDataFrame([("0123456789abcdef",)], "sha16 string"), STRUCTURED).count() == 1


def test_a_breach_of_memory_ends_the_run(spark, folder, monkeypatch):
    def convert(data, options):
        held = bytearray(600 << 20) if b"large" in data else b""
        time.sleep(2)
        return {"markdown": f"text {len(held)}" * 40, "title": "", "authors": "", "n_pages": 1, "images": {}}

    monkeypatch.setitem(ex.BACKENDS, STRUCTURED, ex.Backend(STRUCTURED, convert))
    for i in range(4):
        (folder / "pdfs" / f"p{i}.pdf").write_bytes(written(objects_of([[(10, f"paper {i}")]], title="large" if i == 0 else f"T{i}")))
    found = files.with_key(files.pdf_files(spark, str(folder / "pdfs"))).where(F.col("path").rlike(r"/p\d\.pdf$")).select(F.substring_index("path", "/", -1).alias("citekey"), "path", "sha16")
    log = bulk.run(spark, found.orderBy("citekey"), DocCache(spark, str(folder / "cache")), bulk.Budget(per_task=4, rss_mb=500), free=lambda: 100.0).collect()
    assert [(r["citekey"], r["status"]) for r in log] == [("p0.pdf", "memguard")]


def test_guards_and_locks(tmp_path):
    with pytest.raises(TimeoutError):
        bulk.guarded(lambda d, o: __import__("time").sleep(3), 1, 0)(b"", {})
    with pytest.raises(MemoryError):
        bulk.guarded(lambda d, o: {}, 5, 1)(b"", {})
    with bulk.Lock(str(tmp_path / "x.lock")) as first, bulk.Lock(str(tmp_path / "x.lock")) as second:
        assert first and not second
    assert bulk.free_percent("System-wide memory free percentage: 37%") == 37 and bulk.free_percent("?") == float("inf")


def test_streaming_ingest(spark, folder):
    cache = DocCache(spark, str(folder / "cache"))
    run = lambda: ingest(spark, str(folder / "pdfs"), cache, str(folder / "ck"), str(folder / "out"), backend=FAST, per_batch=2).awaitTermination(120)
    assert run() and spark.read.parquet(str(folder / "out")).count() == 3
    (folder / "pdfs" / "later.pdf").write_bytes(simple(1))
    assert run() and spark.read.parquet(str(folder / "out")).count() == 4


def test_cli(spark, folder, monkeypatch):
    monkeypatch.setenv("HOME", str(folder))
    structured_stub(monkeypatch, [])

    def run(*args):
        out, err = io.StringIO(), io.StringIO()
        with redirect_stdout(out), redirect_stderr(err):
            code = cli.main([str(folder / "pdfs" / args[0]), *args[1:]], spark)
        return code, out.getvalue(), err.getvalue()

    assert run("missing.pdf")[0] == 1
    assert json.loads(run("a.pdf", "--preflight", "--json")[1])["verdict"] == "PASS"
    assert run("a.pdf", "--no-cache")[1].count("Heading") == 3
    assert run("a.pdf", "--section", "heading 1")[1].startswith("Some body text of page 1")
    assert run("a.pdf", "--section", "nowhere")[0] == 2
    assert json.loads(run("a.pdf", "--metadata")[1])["n_pages"] == 3
    assert json.loads(run("thin.pdf", "--backend", "marker", "--json")[1])["backend"] == "marker"
    assert run("thin.pdf", "--backend", "marker", "--tables")[1].startswith("--- table 0  (Table 1. Things) (page 0) ---\n| a | b |")
    shown = re.fullmatch(r"figure 0: (/.*/page_10_x\.png) \(page 10\)", run("thin.pdf", "--backend", "marker", "--figures")[1].splitlines()[0])
    assert os.path.exists(shown[1])
    assert run("thin.pdf", "--backend", "marker", "--references")[1].startswith("[1]")


def test_node_budget():
    from paperloom.sources.pdf import PdfError, Reader

    with pytest.raises(PdfError):
        Reader(simple(30)).enumerated(budget=10)


def test_signals_of_nothing():
    from paperloom.sources.pdf import structure

    assert len(next(structure(iter([pd.DataFrame({"path": ["x"], "content": [None]})])))) == 1


def test_headers_are_found_as_before_a_gap_at_a_time():
    import random

    plain = re.compile(r"(?:\A|GAP)GAP*([+-]?0*[0-9]{1,10})GAP+[+-]?0*[0-9]{1,10}GAP+obj(?![A-Za-z0-9_])".replace("GAP", r"(?:[\x00\t\n\x0c\r ]|%[^\r\n]*[\r\n])").encode())
    rng = random.Random(8)
    bits = [b"1", b"00", b"12345678901", b"+0", b" ", b"\n", b"\r", b"%", b"%x\n", b"obj", b"endobj", b"x", b" 0 obj", b"4 0 obj"]
    for _ in range(5000):
        data = b"".join(rng.choices(bits, k=rng.randrange(1, 16)))
        assert [(int(m[1]), m.start(1)) for m in pdf.headers(data)] == [(int(m[1]), m.start(1)) for m in plain.finditer(data)], data


def test_images_are_found_by_their_table_not_by_listing(spark, tmp_path):
    cache = DocCache(spark, str(tmp_path / "cache"))
    rows = spark.createDataFrame([("a", "1.png", bytearray(b"1")), ("a", "2.png", bytearray(b"2")), ("b", "1.png", bytearray(b"3"))], "sha16 string, name string, data binary")
    images.write_files(rows.where("sha16 = 'b'").withColumnRenamed("sha16", "folder"), cache.figure_folder("x"))  # from before there was a table
    for _ in range(2):
        cache.save_figures(rows.where("sha16 = 'a'"), "x")
    assert sorted((r.sha16, r.name) for r in cache.figure_names("x").collect()) == [("a", "1.png"), ("a", "2.png"), ("b", "1.png")]
    assert "binaryFile" not in cache.figure_names("x")._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.sha16, r.name, bytes(r.data)) for r in cache.figures("x", rows.where("name = '2.png'")).collect()) == [("a", "1.png", b"1"), ("a", "2.png", b"2")]
    os.remove(f"{cache.figure_folder('x')}/a/1.png")
    assert cache.figures("x").count() == 2


def test_a_task_sends_its_results_some_at_a_time(spark):
    """Results go on as Arrow batches of many papers: a frame a paper took longer than the paper."""
    files_ = spark.range(300).coalesce(1).selectExpr("string(id) AS sha16", "string(id) AS path", "CAST('x' AS BINARY) AS content")
    small = ex.Backend("b", lambda d, o: {"markdown": "m", "title": "", "authors": "", "n_pages": 1, "images": {}})
    x = ex.converted(files_, small)
    assert "MapInArrow" in x._jdf.queryExecution().executedPlan().toString() and x.count() == 300
    with_missing = spark.createDataFrame([("k", "p", None), ("l", "q", bytearray(b"x"))], "sha16 string, path string, content binary")
    assert sorted((r.sha16, r.problem is None) for r in ex.converted(with_missing, small).collect()) == [("k", False), ("l", True)]
