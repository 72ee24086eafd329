"""The bulk pipeline: a library becomes a prioritised queue of files, less what is cached or blocklisted, extracted under budgets.

Queue building is relational: attachments meet the file listing by an equi-join, the first attachment in order whose file exists
wins, cited entries come first. Only ord, the place in the library, carries order through joins.
"""

from __future__ import annotations

import os
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from typing import TYPE_CHECKING

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.functions.keys import STRUCTURED, attachment_path
from paperloom.operators.cache import DocCache
from paperloom.operators.preflight import FAIL, preflight
from paperloom.sources.images import opened
from paperloom.sources.shared import written

if TYPE_CHECKING:
    from paperloom.operators.extract import Backend

PDF = "application/pdf"


def resolved(library: DataFrame, listing: DataFrame) -> DataFrame:
    """ord, citekey, created, path: entries with a PDF attachment that is in `listing` (name, path), the first one in order."""
    x = library.select("ord", "citekey", "created", F.posexplode(F.coalesce("attachments", F.array().cast(library.schema["attachments"].dataType))).alias("at", "a"))
    x = x.where(F.col("a.mimeType") == PDF).select("ord", "citekey", "created", "at", attachment_path(F.coalesce("a.filename", F.lit(""))).alias("name"))
    return x.join(listing.select("name", "path"), "name").groupBy("ord", "citekey", "created").agg(F.min_by("path", "at").alias("path"))


def with_priority(entries: DataFrame, cited: DataFrame) -> DataFrame:
    """Adds is_hot: whether the entry's citekey is among the cited ones."""
    hot = cited.select(F.col("citekey").alias("__cited")).distinct()
    return entries.join(hot, F.col("citekey") == F.col("__cited"), "left").withColumn("is_hot", F.col("__cited").isNotNull()).drop("__cited")


def hot(entries: DataFrame, cited: DataFrame) -> DataFrame:
    return entries.join(cited.select("citekey").distinct(), "citekey", "left_semi")


def long_tail(entries: DataFrame, cited: DataFrame) -> DataFrame:
    return entries.join(cited.select("citekey").distinct(), "citekey", "left_anti")


def order(prioritised: bool = True) -> list[Column]:
    """Cited entries in library order, then the others by `created`, latest first, missing as 0, ties in library order; or library order."""
    if not prioritised:
        return [F.col("ord")]
    return [F.desc("is_hot"), F.when(F.col("is_hot"), F.lit(0.0)).otherwise(-F.coalesce("created", F.lit(0)).cast("double")), F.col("ord")]


def placed(entries: DataFrame, prioritised: bool = True) -> DataFrame:
    """Adds place, the number of each entry in the order of the queue, from 1.

    Entries are sorted by ranges over all tasks; a place is the number inside the range plus the sizes of the ranges before, of
    which only one count a range is gathered.
    """
    x = entries.repartitionByRange(*order(prioritised)).sortWithinPartitions(*order(prioritised))
    # written, so that numbers and sizes come from the same ranges whatever executors are lost
    x = written(x.select("*", F.monotonically_increasing_id().alias("__id")), "queue")
    x = x.withColumn("__range", F.shiftright("__id", 33).cast("int")).withColumn("__at", F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = x.groupBy("__range").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.orderBy("__range")) - F.col("n")).select("__range", "before")  # one row a range
    return x.join(F.broadcast(before), "__range").withColumn("place", F.col("before") + F.col("__at") + 1).drop("__id", "__range", "__at", "before")


def not_blocklisted(entries: DataFrame, blocked: DataFrame) -> DataFrame:
    return entries.join(blocked.select("citekey").distinct(), "citekey", "left_anti")


def queue(entries: DataFrame, cached: DataFrame, blocked: DataFrame, limit: int, prioritised: bool = True) -> DataFrame:
    """Entries (ord, citekey, created, is_hot, sha16, ...) without cached contents and blocklisted keys, the first `limit` in order."""
    return not_blocklisted(entries.join(cached.select("sha16").distinct(), "sha16", "left_anti"), blocked).orderBy(*order(prioritised)).limit(limit)


def queue_sizes(entries: DataFrame, cached: DataFrame, blocked: DataFrame) -> DataFrame:
    """One row: n_hot, n_other, n_cached, n_blocked (of those not cached)."""
    marked = entries.join(cached.select("sha16", F.lit(True).alias("c")).distinct(), "sha16", "left").join(blocked.select("citekey", F.lit(True).alias("b")).distinct(), "citekey", "left")
    return marked.agg(F.count_if("is_hot").alias("n_hot"), F.count_if(~F.col("is_hot")).alias("n_other"), F.count_if(F.col("c").isNotNull()).alias("n_cached"), F.count_if(F.col("c").isNull() & F.col("b").isNotNull()).alias("n_blocked"))


def passed(checked: DataFrame) -> DataFrame:
    """Without files whose page counts disagree; files that can't be judged go on."""
    return checked.where(F.col("verdict") != FAIL)


def counters(log: DataFrame) -> DataFrame:
    """status, n: how many papers ended in each way."""
    return log.groupBy("status").agg(F.count("*").alias("n"))


def free_percent(report: str) -> float:
    """Free memory in percent as a report states it; infinite where it doesn't."""
    import re

    m = re.search(r"free percentage:\s*(\d+)%", report)
    return float(m[1]) if m else float("inf")


def system_free_percent() -> float:
    try:
        info = dict(line.split(":", 1) for line in open("/proc/meminfo"))
        return 100 * int(info["MemAvailable"].split()[0]) / int(info["MemTotal"].split()[0])
    except (OSError, KeyError, ValueError):
        return float("inf")


class Lock:
    """A lock file held without waiting; false where another process holds it."""

    def __init__(self, path: str):
        self.path, self.handle = path, None

    def __enter__(self) -> bool:
        import fcntl

        os.makedirs(os.path.dirname(self.path) or ".", exist_ok=True)
        self.handle = open(self.path, "a+")
        try:
            fcntl.flock(self.handle, fcntl.LOCK_EX | fcntl.LOCK_NB)
            return True
        except OSError:
            return False

    def __exit__(self, *_: object) -> None:
        self.handle.close()


@dataclass
class Budget:
    """Limits of a run; 0 turns a memory limit off."""

    seconds: float = 21_600
    papers: int = 10_000
    per_paper: int = 120
    rss_mb: int = 4096
    free_percent: float = 15
    per_task: int = 1


def resident_mb(pid: int) -> float:
    """Memory that a process holds now; 0 where it can't be told."""
    try:
        with open(f"/proc/{pid}/statm") as f:
            return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE") / (1 << 20)
    except (OSError, IndexError, ValueError):
        return 0.0


def serve(packed: bytes, pipe) -> None:
    """A child's work: one conversion after another until the pipe ends."""
    from pyspark import cloudpickle

    convert = cloudpickle.loads(packed)
    pipe.send(None)  # ready
    while True:
        try:
            data, options = pipe.recv()
        except EOFError:
            os._exit(0)
        try:
            pipe.send((True, convert(data, options)))
        except BaseException as e:  # noqa: BLE001  whatever it is, the parent tells it
            pipe.send((False, e if isinstance(e, Exception) else RuntimeError(repr(e))))


_children: dict[str, dict] = {}  # of this Python worker, by guard; tasks that follow one another use the same child


def guarded(convert: Callable[[bytes, dict], dict], per_paper: float, rss_mb: float, until: float | None = None, every: float = 0.1) -> Callable[[bytes, dict], dict]:
    """The conversion in a child process under a time limit and a memory cap, as TimeoutError and MemoryError.

    The child is a new program, not a fork of a process with threads. It serves one paper after another, of all tasks of a worker, so
    what a backend loads is loaded once; it is killed where a paper breaches a limit, native code included, and the next paper gets
    a new one. Memory is what the child holds at the moment, looked at `every` seconds and at the end, so a paper never answers for
    the one before. After `until` (seconds since the epoch) no paper is begun: InterruptedError; one that runs then is cut as if by
    its own limit.
    """
    from pyspark import cloudpickle

    name, packed = uuid.uuid4().hex, cloudpickle.dumps(convert)

    def run(data: bytes, options: dict) -> dict:
        import multiprocessing

        from paperloom.plans import bulk

        held = bulk._children.setdefault(name, {})

        def stop() -> None:
            if held:
                held["process"].kill()
                held["process"].join()
                held["pipe"].close()
                held.clear()

        def answer() -> object:
            try:
                return held["pipe"].recv()
            except EOFError:
                stop()
                raise RuntimeError("the conversion's process died") from None

        if until is not None and time.time() >= until:
            raise InterruptedError("the run's time is over")
        if not held:
            context = multiprocessing.get_context("spawn")
            mine, theirs = context.Pipe()
            held["process"], held["pipe"] = context.Process(target=bulk.serve, args=(packed, theirs), daemon=True), mine
            held["process"].start()
            theirs.close()
            answer()
        began = time.time()
        limit = per_paper if until is None else min(per_paper, until - began)
        held["pipe"].send((data, options))
        while True:
            there = held["pipe"].poll(every)
            used = resident_mb(held["process"].pid)
            if rss_mb and used > rss_mb:
                stop()
                raise MemoryError(f"{used:.0f} MB")
            if there:
                ok, got = answer()
                if not ok:
                    raise got
                return got
            if time.time() - began > limit:
                stop()
                raise TimeoutError(f"over {limit:.0f} s")

    return run


def status_of(problem: Column) -> Column:
    """ok, timeout, memguard, skipped (the run's time was over before the paper began) or failed."""
    return (
        F.when(problem.isNull(), "ok").when(problem.startswith("TimeoutError"), "timeout").when(problem.startswith("MemoryError"), "memguard")
        .when(problem.startswith("InterruptedError"), "skipped").otherwise("failed")
    )


MAX_TASKS = 10_000
LOG = "citekey string, path string, status string, problem string, n_md int, n_figs int, n_tabs int, n_refs int, place long"


def contents(rows: DataFrame) -> DataFrame:
    """(place, path, ...) with `content`, read by the task that has the row; null where a file can't be read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(len(batch)):  # a file at a time
                row = batch.iloc[at : at + 1]
                yield row.assign(content=[file_bytes(row["path"].iloc[0])])

    return rows.mapInPandas(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema.fields)}, content binary")


def file_bytes(path: str) -> bytes | None:
    system, place = opened(path)
    try:
        with system.open_input_stream(place) as f:
            return f.read()
    except OSError:
        return None


def worked(rows: DataFrame, backend: Backend, budget: Budget, until: float, inbox: str, free: Callable[[], float]) -> DataFrame:
    """Converts (place, path, sha16), a paper at a time, and tells place, sha16, problem.

    Each result goes to the inbox at once, as a Parquet file of its own, so a run that is cut loses none. A paper that breaches the
    memory cap leaves a mark there, after which no task begins another; so does a machine short of memory for itself.
    """
    from paperloom.operators.extract import raw_row

    own = replace(backend, convert=guarded(backend.convert, budget.per_paper, budget.rss_mb, until))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = opened(inbox)
        over = lambda: system.get_file_info(f"{root}/stop").type != fs.FileType.NotFound
        for batch in batches:
            for r in batch.itertuples(index=False):
                if over() or budget.free_percent and free() < budget.free_percent:
                    problem = "InterruptedError: no memory is free"
                else:
                    row = raw_row(r.sha16, r.path, file_bytes(r.path), own, {})
                    problem = row["problem"]
                    if not (problem or "").startswith("InterruptedError"):
                        put(system, f"{root}/papers", row)
                    if (problem or "").startswith("MemoryError"):
                        system.open_output_stream(f"{root}/stop").close()
                yield pd.DataFrame({"place": [r.place], "sha16": [r.sha16], "problem": [problem]})

    return rows.mapInPandas(run, "place long, sha16 string, problem string")


def put(system: fs.FileSystem, folder: str, row: dict) -> None:
    """A row of RAW as a file, whole or not at all, the same name for the same content."""
    from paperloom.operators.extract import RAW_ARROW

    part = f"{folder}/.{row['sha16']}-{uuid.uuid4().hex}"
    with system.open_output_stream(part) as out:
        pq.write_table(pa.Table.from_pylist([row], RAW_ARROW), out)
    system.move(part, f"{folder}/{row['sha16']}.parquet")


def taken_over(spark: SparkSession, cache: DocCache, backend: Backend, inbox: str) -> DataFrame:
    """Saves an inbox's results in the cache; returns what documents they are, by sha16."""
    from paperloom.operators.extract import RAW, document, store

    docs = written(document(spark.read.schema(RAW).parquet(f"{inbox}/papers"), backend), "bulk-documents")
    store(docs, backend, cache)
    return docs.select("sha16", "problem", F.length("doc.markdown").alias("n_md"), F.size("doc.figures").alias("n_figs"), F.size("doc.tables").alias("n_tabs"), F.size("doc.references").alias("n_refs"))


def left_over(spark: SparkSession, cache: DocCache, backend: Backend) -> int:
    """Saves what runs that were cut have left in their inboxes, and removes these; returns how many. No other run may be at work."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{cache.root}/inbox/{backend.cached_as}")
    system = p.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s.getPath() for s in system.listStatus(p)] if system.exists(p) else []
    for f in found:
        taken_over(spark, cache, backend, f.toString())
        system.delete(f, True)
    return len(found)


def run(spark: SparkSession, todo: DataFrame, cache: DocCache, budget: Budget, backend: str = STRUCTURED, log_path: str | None = None, sidecars: str | None = None, free: Callable[[], float] = system_free_percent) -> DataFrame:
    """Works through a queue (citekey, path, sha16, in order) and returns the run log: citekey, path, status, problem, n_md, n_figs,
    n_tabs, n_refs, in the queue's order.

    A task has `per_task` papers, one by default, and Spark begins tasks in the queue's order, so the next paper goes to whoever is
    free and a slow one holds up no other. Nothing of the queue or the log passes the driver. The deadline and the free memory are
    looked at before each paper, where it is converted: papers that they leave out are not in the log. A paper that breaches the
    memory cap ends the run. A file that fails the preflight is logged, its sidecar is kept, and it counts towards the limit.
    """
    from paperloom.operators.extract import BACKENDS

    own, until = BACKENDS[backend], time.time() + budget.seconds
    left_over(spark, cache, own)
    names = [f.split(" ")[0] for f in LOG.split(", ")]
    if budget.free_percent and free() < budget.free_percent:
        return spark.createDataFrame([], LOG).drop("place")
    queue = written(todo.select("citekey", "path", "sha16").limit(budget.papers).withColumn("place", F.monotonically_increasing_id()), "bulk-queue")
    n = queue.count()
    if not n:
        return spark.createDataFrame([], LOG).drop("place")
    size = max(1, budget.per_task, -(-n // MAX_TASKS))
    spread = lambda x: x.repartitionById(-(-n // size), F.floor(F.col("place") / size).cast("int")).sortWithinPartitions("place")
    files = contents(spread(queue.groupBy("path").agg(F.min("place").alias("place")))).drop("place")
    told = ("verdict", "declared_page_count", "enumerated_page_count", "reader_page_count", "warnings")
    checked = written(queue.join(preflight(files, "path").select(F.col("file").alias("path"), *told), "path"), "bulk-checked")
    bad = checked.where(F.col("verdict") == FAIL)
    if sidecars:
        bad.drop("sha16", "place").write.mode("append").partitionBy("citekey").json(sidecars)
    inbox = f"{cache.root}/inbox/{own.cached_as}/{uuid.uuid4().hex}"
    spark._jvm.org.apache.hadoop.fs.Path(inbox).getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(spark._jvm.org.apache.hadoop.fs.Path(f"{inbox}/papers"))
    once = passed(checked).groupBy("sha16").agg(F.min_by("path", "place").alias("path"), F.min("place").alias("place"))
    outcome = written(worked(spread(once.select("place", "path", "sha16")), own, budget, until, inbox, free), "bulk-outcome")
    made = taken_over(spark, cache, own, inbox)
    ended = outcome.where(F.coalesce(~F.col("problem").startswith("InterruptedError"), F.lit(True))).select("sha16")
    done = passed(checked).join(ended, "sha16", "left_semi").join(made, "sha16").withColumn("status", status_of(F.col("problem")))
    failed = bad.withColumns({"status": F.lit("preflight"), "problem": F.lit("page counts disagree")} | {c: F.lit(0) for c in ("n_md", "n_figs", "n_tabs", "n_refs")})
    log = written(done.select(*names).unionByName(failed.select(*names)), "bulk-log")
    if log_path:
        log.orderBy("place").drop("place").write.mode("append").parquet(log_path)
    gone = spark._jvm.org.apache.hadoop.fs.Path(inbox)
    gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)
    return log.orderBy("place").drop("place")
