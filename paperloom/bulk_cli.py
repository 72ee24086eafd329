"""Command line of the bulk run: a library's queue under budgets, one run at a time."""

from __future__ import annotations

import argparse
import contextlib
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from paperloom.functions.keys import STRUCTURED
from paperloom.operators.cache import DocCache
from paperloom.operators.extract import BACKENDS
from paperloom.plans import bulk
from paperloom.sources import files


def parser() -> argparse.ArgumentParser:
    """Defaults come from PAPERLOOM_* variables; the command line wins."""
    env = lambda name, other=None: os.environ.get(f"PAPERLOOM_{name}", other)
    p = argparse.ArgumentParser(prog="paperloom-bulk", description="Extract a library in order of priority.")
    # Names of arguments and their defaults.
    p.add_argument("--library-json", default=env("LIBRARY_JSON"))
    p.add_argument("--pdf-root", default=env("PDF_ROOT"))
    p.add_argument("--projects-root", default=env("PROJECTS_ROOT"), help="where bibliographies of projects are; unset: no priorities")
    p.add_argument("--backend", default=STRUCTURED)
    p.add_argument("--max-runtime", type=float, default=float(env("MAX_RUNTIME", 21_600)))
    p.add_argument("--max-papers", type=int, default=int(env("MAX_PAPERS", 10_000)))
    p.add_argument("--per-paper-timeout", type=int, default=int(env("PER_PAPER_TIMEOUT", 120)))
    p.add_argument("--max-rss-mb", type=int, default=int(env("MAX_RSS_MB", 4096)))
    p.add_argument("--min-free-percent", type=float, default=float(env("MIN_FREE_PERCENT", 15)))
    p.add_argument("--no-prioritise", action="store_true", help="library order")
    p.add_argument("--cache-root", default=env("CACHE_ROOT"), help="where documents are kept; unset: the session's setting or the user's cache")
    p.add_argument("--heavy-lock", default=env("HEAVY_LOCK", os.path.expanduser("~/.local/state/heavy-workload.lock")), help="a lock that heavy jobs of this machine share; empty: none")
    p.add_argument("--state", default=env("STATE", os.path.expanduser("~/.local/state/paperloom")), help="lock, blocklist, sidecars and run log")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0: done or another run is busy; 1: the library is missing; 2: bad arguments."""
    p = parser()
    args = p.parse_args(argv)
    if not args.library_json or not args.pdf_root:
        p.error("--library-json and --pdf-root are needed")
    if not os.path.exists(args.library_json):
        print(f"ERROR: library not found: {args.library_json}", file=sys.stderr)
        return 1
    with bulk.Lock(os.path.join(args.state, "bulk.lock")) as free:
        if not free:
            print("another run is busy")
            return 0
        with bulk.Lock(args.heavy_lock) if args.heavy_lock else contextlib.nullcontext(True) as idle:
            if not idle:
                print("another heavy job is busy")
                return 0
            work(args, spark or SparkSession.builder.appName("paperloom-bulk").getOrCreate())
    return 0


def work(args: argparse.Namespace, spark: SparkSession) -> None:
    """Builds the queue, works through it, prints the log."""
    cache = DocCache(spark, args.cache_root)
    pdfs = files.with_key(files.pdf_files(spark, args.pdf_root)).select("path", "sha16").persist()  # bytes are hashed once
    listing = pdfs.select("path", F.regexp_replace("path", "^file:/*", "/").alias("full")).select("path", F.substring(F.col("full"), len(os.path.abspath(args.pdf_root)) + 2, 1 << 20).alias("name"))
    prioritised = not args.no_prioritise and bool(args.projects_root)
    cited = files.project_citekeys(spark, args.projects_root) if prioritised else spark.createDataFrame([], "citekey string")
    entries = bulk.with_priority(bulk.resolved(files.library(spark, args.library_json), listing), cited).join(pdfs, "path")
    blocked = os.path.join(args.state, "blocklist.json")
    blocklist = files.blocklist(spark, blocked)
    entries = entries.persist()  # both the sizes and the queue read it
    known = cache.keys(BACKENDS[args.backend].cached_as)
    sizes = bulk.queue_sizes(entries, known, blocklist).first()
    print(f"queue: {sizes['n_hot']} hot, {sizes['n_other']} other, {sizes['n_cached']} cached, {sizes['n_blocked']} blocklisted")
    todo = bulk.queue(entries, known, blocklist, args.max_papers, prioritised)
    budget = bulk.Budget(args.max_runtime, args.max_papers, args.per_paper_timeout, args.max_rss_mb, args.min_free_percent)
    log = bulk.run(spark, todo, cache, budget, args.backend, os.path.join(args.state, "run_log"), os.path.join(args.state, "sidecars"))
    for r in log.collect():  # at most max_papers rows
        print(f"[{r['status']}] {r['citekey'] or '?'} md={r['n_md']} figs={r['n_figs']} tabs={r['n_tabs']} refs={r['n_refs']} {r['problem'] or ''}".rstrip())
    late = log.where("status = 'memguard'").select("citekey", F.lit("memory").alias("reason"), F.regexp_extract("problem", r"([0-9]+) MB", 1).try_cast("int").alias("rss_mb"), F.col("path").alias("pdf"), F.date_format(F.current_date(), "yyyy-MM-dd").alias("date"))
    if late.limit(1).count():
        files.save_blocklist(blocklist.unionByName(late), blocked)
    print("done: " + ", ".join(f"{r['n']} {r['status']}" for r in bulk.counters(log).collect()))


if __name__ == "__main__":
    sys.exit(main())
