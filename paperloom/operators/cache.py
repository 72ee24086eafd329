"""Content-addressed cache of extracted documents: bucketed Parquet segments under snapshots."""

from __future__ import annotations

import hashlib
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions.keys import EXTRACT_VERSION
from paperloom.operators.snapshots import Conflict, Snapshots, State
from paperloom.schemas import ExtractedDoc
from paperloom.sources.files import exists
from paperloom.sources.images import read_files, write_files

DOC = ExtractedDoc
ROOT_CONF = "spark.paperloom.cache.dir"


def cache_root(spark: SparkSession) -> str:
    """The session's setting; where it is unset a local master gets a folder in the user's cache, and on a cluster that is an error."""
    import os

    root = spark.conf.get(ROOT_CONF, None)
    if not root and not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError(f"{ROOT_CONF} must name a folder that driver and executors share")
    return root or os.path.expanduser("~/.cache/paperloom")


def doc_json(doc: Column) -> Column:
    """A document struct as JSON, null fields written out."""
    return F.to_json(doc, {"ignoreNullFields": "false"})


def parsed_doc(json: Column) -> Column:
    """The document struct of a JSON text; null if it can't be decoded or a figure lacks its index or page. Missing fields are
    empty, unknown ones ignored."""
    x = F.from_json(json, DOC)
    broken = F.exists(F.coalesce(x["figures"], F.array()), lambda f: f["index"].isNull() | f["page"].isNull())
    lists = [F.coalesce(x[c], F.from_json(F.lit("[]"), ExtractedDoc[c].dataType)).alias(c) for c in ("figures", "tables", "references")]
    whole = F.struct(F.coalesce(x["markdown"], F.lit("")).alias("markdown"), *lists, x["metadata"].alias("metadata"), F.coalesce(x["backend"], F.lit("")).alias("backend"))
    return F.when(F.try_parse_json(json).isNotNull() & F.startswith(F.ltrim(json), F.lit("{")) & ~broken, whole)


LOOSE = "sha16 string, doc string, written_at timestamp, checked boolean"
ENTRY = f"{LOOSE}, backend string, extract_version string"
EVICTED = "sha16 string, evicted_at timestamp"
FIGURE_NAME = "sha16 string, name string, backend string, extract_version string"
FAILURE = "sha16 string, problem string, failed_at timestamp, backend string, extract_version string"


BUCKETS = 64
KEYS_TO_PRUNE = 1000


class DocCache:
    """Entries (sha16, backend, extract_version) -> document. Of entries with one key the latest written counts.

    Documents stand in segments, one per save(), bucketed by key with Bloom filters; a snapshot lists the segments that count and
    their numbers. An eviction adds a segment of keys (or a date) that hides what older snapshots hold and rewrites nothing, so what
    is saved meanwhile stays; compact() rewrites a backend's segments as one. Other programs may put Parquet files with the columns
    of ENTRY under docs/backend=.../extract_version=...; these loose entries are read too, and hidden by evictions after they
    were written.

    Images are files by content key and name; their names are an appended table. failures (why a content could not be converted; a failure is never a hit) is an appended
    table. All is written by Spark's tasks and so on any file system the cluster shares. An entry that save() wrote is marked as
    checked, so that looking up keys reads no document; others are decoded first.
    """

    def __init__(self, spark: SparkSession, root: str | None = None, version: str = EXTRACT_VERSION, buckets: int = BUCKETS):
        self.spark, self.version, self.buckets = spark, version, buckets
        self.root = (root or cache_root(spark)).rstrip("/")
        self.path = f"{self.root}/docs"
        self.snapshots = Snapshots(spark, f"{self.root}/snapshots")

    def _read(self, name: str, schema: str) -> DataFrame:
        path = f"{self.root}/{name}"
        return self.spark.read.schema(schema).parquet(path) if exists(self.spark, path) else self.spark.createDataFrame([], schema)

    def _own(self, rows: DataFrame, backend: str) -> DataFrame:
        return rows.where((F.col("backend") == backend) & (F.col("extract_version") == self.version))

    def _append(self, rows: DataFrame, name: str, backend: str) -> None:
        x = rows.withColumns({"backend": F.lit(backend), "extract_version": F.lit(self.version)})
        x.write.mode("append").partitionBy("backend", "extract_version").parquet(f"{self.root}/{name}")

    def _loose(self, backend: str, version: str) -> DataFrame | None:
        path = f"{self.path}/backend={backend}/extract_version={version}"
        return self.spark.read.schema(LOOSE).parquet(path) if exists(self.spark, path) else None

    def _segments(self, state: State, kind: str, backend: str, version: str | None = None) -> State:
        return [s for s in state if (s["kind"], s["backend"], s["version"]) == (kind, backend, version or self.version)]

    def _bucketed(self, segments: State, backend: str, version: str) -> DataFrame:
        """The segments as one bucketed table, so that joins on the key need not shuffle them; its name is this state's."""
        buckets = segments[0]["buckets"]
        name = "paperloom_cache_" + hashlib.md5(repr((self.root, backend, version, [(s["id"], s["seq"]) for s in segments])).encode()).hexdigest()
        if not self.spark.catalog.tableExists(name):
            columns = "sha16 STRING, doc STRING, written_at TIMESTAMP, checked BOOLEAN, seq BIGINT, seg STRING"
            self.spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet PARTITIONED BY (seq, seg) CLUSTERED BY (sha16) SORTED BY (sha16) INTO {buckets} BUCKETS LOCATION '{self.root}/segments'")
            parts = " ".join(f"PARTITION (seq = {s['seq']}, seg = '{s['id']}') LOCATION '{self.root}/segments/{s['id']}'" for s in segments)
            self.spark.sql(f"ALTER TABLE {name} ADD IF NOT EXISTS {parts}")
        return self.spark.table(name).drop("seg")

    def _entries(self, backend: str, version: str | None = None, state: State | None = None, pick: Column | None = None, loose: bool = True) -> DataFrame:
        """sha16, doc, written_at, checked of one backend and version as a snapshot has them, several for a key; `pick` is a condition
        on keys that the scan can use."""
        version, state = version or self.version, self.snapshots.latest()[1] if state is None else state
        kept, gone = self._segments(state, "entries", backend, version), self._segments(state, "evicted", backend, version)
        horizons = self._segments(state, "older", backend, version)
        x = [self._bucketed([s for s in kept if s["buckets"] == n], backend, version) for n in sorted({s["buckets"] for s in kept})]
        if loose and (other := self._loose(backend, version)) is not None:
            x.append(other.withColumn("seq", F.lit(None).cast("long")))
        if not x:
            return self.spark.createDataFrame([], LOOSE)
        rows = reduce(DataFrame.unionByName, x)
        if pick is not None:
            rows = rows.where(pick)
        for h in horizons:
            before = F.timestamp_micros(F.lit(h["before"]))
            rows = rows.where((F.col("written_at") >= before) | F.coalesce(F.col("seq") >= h["seq"], F.lit(False)))
        if gone:
            marks = reduce(DataFrame.unionByName, [self.spark.read.schema(EVICTED).parquet(f"{self.root}/segments/{s['id']}").withColumn("__seq", F.lit(s["seq"]).cast("long")) for s in gone])
            marks = marks.groupBy(F.col("sha16").alias("__key")).agg(F.max("__seq").alias("__seq"), F.max("evicted_at").alias("__at"))
            rows = rows.join(marks, F.col("sha16") == F.col("__key"), "left")
            hidden = F.when(F.col("seq").isNull(), F.col("written_at") <= F.col("__at")).otherwise(F.col("seq") < F.col("__seq"))
            rows = rows.where(F.col("__key").isNull() | ~hidden)
        return rows.select("sha16", "doc", "written_at", "checked")

    def _partitions(self, state: State) -> list[tuple[str, str]]:
        """(backend, version) of all entries."""
        found = {(s["backend"], s["version"]) for s in state if s["kind"] == "entries"}
        if exists(self.spark, self.path):
            found |= {(r[0], r[1]) for r in self._read("docs", ENTRY).select("backend", "extract_version").distinct().collect() if r[0] is not None}
        return sorted(found)

    def all(self) -> DataFrame:
        """Every entry as written: sha16, doc (JSON), written_at, backend, extract_version."""
        _, state = self.snapshots.latest()
        x = [self._entries(b, v, state).drop("checked").withColumns({"backend": F.lit(b), "extract_version": F.lit(v)}) for b, v in self._partitions(state)]
        return reduce(DataFrame.unionByName, x) if x else self.spark.createDataFrame([], ENTRY).drop("checked")

    def entries(self, backend: str) -> DataFrame:
        """sha16, cached (document struct) of this version; entries that can't be decoded are none."""
        x = self._entries(backend).groupBy("sha16").agg(F.max_by("doc", "written_at").alias("doc"))
        return x.select("sha16", parsed_doc(F.col("doc")).alias("cached")).where(F.col("cached").isNotNull())

    def keys(self, backend: str) -> DataFrame:
        """sha16 of the entries that can be decoded; documents are read only where save() did not write the entry."""
        own = self._entries(backend)
        sure = own.where("checked").select("sha16", "written_at", F.lit(True).alias("good"))
        other = own.where("checked IS NULL").select("sha16", "written_at", parsed_doc(F.col("doc")).isNotNull().alias("good"))
        if self._loose(backend, self.version) is None:
            return sure.select("sha16").distinct()
        return sure.unionByName(other).groupBy("sha16").agg(F.max_by("good", "written_at").alias("good")).where("good").select("sha16")

    def hits(self, files: DataFrame, backend: str) -> DataFrame:
        """The rows of `files` with a cached document, with it; only entries of their keys are decoded.

        Up to KEYS_TO_PRUNE keys the scan is told them and reads their buckets only, of which it leaves row groups out by Bloom
        filters. The cache's side of the join stays in its buckets.
        """
        wanted = files.select("sha16").distinct()
        few = [r[0] for r in wanted.limit(KEYS_TO_PRUNE + 1).collect()]
        pick = F.col("sha16").isin([k for k in few if k is not None]) if len(few) <= KEYS_TO_PRUNE else None
        x = self._entries(backend, pick=pick)
        if pick is None:
            x = x.join(wanted, "sha16", "left_semi")
        x = x.groupBy("sha16").agg(F.max_by("doc", "written_at").alias("doc"))
        return files.join(x.select("sha16", parsed_doc(F.col("doc")).alias("cached")).where(F.col("cached").isNotNull()), "sha16")

    def misses(self, files: DataFrame, backend: str) -> DataFrame:
        return files.join(self.keys(backend), "sha16", "left_anti")

    def _segment(self, rows: DataFrame) -> str:
        """Writes rows as a new segment, bucketed by key; nobody sees it before a snapshot names it."""
        name = uuid.uuid4().hex
        x = rows.repartition(self.buckets, "sha16").write.bucketBy(self.buckets, "sha16").sortBy("sha16").option("parquet.bloom.filter.enabled#sha16", "true")
        x.option("path", f"{self.root}/segments/{name}").format("parquet").saveAsTable(f"paperloom_segment_{name}")
        self.spark.sql(f"DROP TABLE paperloom_segment_{name}")  # the name only; its files stay
        return name

    def _added(self, name: str, kind: str, backend: str, **more: object) -> int:
        entry = {"id": name, "kind": kind, "backend": backend, "version": self.version} | more
        return self.snapshots.commit(lambda number, state: [*state, {"seq": number} | entry])

    def save(self, docs: DataFrame, backend: str) -> None:
        """Adds a segment from (sha16, doc struct); readers see it whole or not at all."""
        rows = docs.select("sha16", doc_json(F.col("doc")).alias("doc"), F.current_timestamp().alias("written_at"), F.lit(True).alias("checked"))
        self._added(self._segment(rows), "entries", backend, buckets=self.buckets)

    def figure_folder(self, backend: str) -> str:
        """Where this version's images stand, as <sha16>/<name>."""
        return f"{self.root}/figures/backend={backend}/extract_version={self.version}"

    def save_figures(self, images: DataFrame, backend: str) -> None:
        """Writes (sha16, name, data) as files, by the executors, and then their names as a table, so that no folder need be listed."""
        if not exists(self.spark, self._figure_index(backend)) and exists(self.spark, self.figure_folder(backend)):
            self._append(self._listed_figures(backend).select("sha16", "name"), "figure_names", backend)  # of files from before there was a table
        export_images(images, self.figure_folder(backend))
        self._append(images.where(F.col("data").isNotNull()).select("sha16", "name"), "figure_names", backend)

    def _figure_index(self, backend: str) -> str:
        return f"{self.root}/figure_names/backend={backend}/extract_version={self.version}"

    def _listed_figures(self, backend: str) -> DataFrame:
        part = lambda k: F.element_at(F.split("path", "/"), k)
        x = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(self.figure_folder(backend))
        return x.select(part(-2).alias("sha16"), part(-1).alias("name"))

    def figure_names(self, backend: str) -> DataFrame:
        """sha16, name: the saved images of this version."""
        if exists(self.spark, self._figure_index(backend)):
            return self._own(self._read("figure_names", FIGURE_NAME), backend).select("sha16", "name").distinct()
        if exists(self.spark, self.figure_folder(backend)):
            return self._listed_figures(backend)
        return self.spark.createDataFrame([], "sha16 string, name string")

    def figures(self, backend: str, keys: DataFrame | None = None) -> DataFrame:
        """sha16, name, data: the saved images of this version, of all contents or those of the given sha16s; executors read the files."""
        names = self.figure_names(backend)
        return read_files(names if keys is None else names.join(keys.select("sha16").distinct(), "sha16", "left_semi"), self.figure_folder(backend))

    def export_figures(self, keys: DataFrame, backend: str, folder: str) -> int:
        """Writes the images of the given sha16s as folder/sha16/name; returns their number."""
        export_images(self.figures(backend, keys), folder)
        return self.figure_names(backend).join(keys.select("sha16").distinct(), "sha16", "left_semi").count()

    def save_failures(self, rows: DataFrame, backend: str) -> None:
        """Appends from (sha16, problem)."""
        self._append(rows.select("sha16", "problem", F.current_timestamp().alias("failed_at")), "failures", backend)

    def failures(self, backend: str) -> DataFrame:
        """sha16, problem: the latest failure of each content."""
        return self._own(self._read("failures", FAILURE), backend).groupBy("sha16").agg(F.max_by("problem", "failed_at").alias("problem"))

    def evict(self, keys: DataFrame, backend: str) -> int:
        """Hides this version's entries of the given sha16s; returns how many keys there were. Adds a segment of those keys only."""
        name = uuid.uuid4().hex
        marks = self._entries(backend).select("sha16").join(keys.select("sha16").distinct(), "sha16", "left_semi").distinct()
        marks.withColumn("evicted_at", F.current_timestamp()).write.parquet(f"{self.root}/segments/{name}")
        n = self.spark.read.schema(EVICTED).parquet(f"{self.root}/segments/{name}").count()
        if n:
            self._added(name, "evicted", backend)
        return n

    def evict_older(self, backend: str, days: int) -> None:
        """Hides entries written more than `days` days ago: one line in the next snapshot."""
        now = self.spark.range(1).select(F.unix_micros(F.current_timestamp())).first()[0]
        self._added(uuid.uuid4().hex, "older", backend, before=now - days * 86_400_000_000)

    def compact(self, backend: str) -> int:
        """Rewrites this version's live entries, the latest of each key, as one segment, without the evictions that made them; returns
        the number of segments replaced.

        Saves and evictions that are committed meanwhile stay and count: the new segment bears the number of the snapshot it was
        made from. Two compactions of the same segments conflict, and the later one is refused. Loose entries stay where they are.
        """
        number, state = self.snapshots.latest()
        old = self._segments(state, "entries", backend)
        marks = [*self._segments(state, "evicted", backend), *self._segments(state, "older", backend)]
        if not old:
            return 0
        rows = self._entries(backend, state=state, loose=False).groupBy("sha16").agg(F.max_by(F.struct("doc", "written_at", "checked"), "written_at").alias("e")).select("sha16", "e.*")
        name = self._segment(rows)
        gone = {s["id"] for s in (old if self._loose(backend, self.version) is not None else [*old, *marks])}

        def change(_: int, now: State) -> State:
            if not {s["id"] for s in old} <= {s["id"] for s in now}:
                raise Conflict("the segments were compacted meanwhile")
            return [*(s for s in now if s["id"] not in gone), {"seq": number, "id": name, "kind": "entries", "backend": backend, "version": self.version, "buckets": self.buckets}]

        self.snapshots.commit(change)
        return len(old)

    def vacuum(self, hours: float = 24) -> int:
        """Deletes segments that the latest snapshot doesn't name and that are older than `hours`, so that readers of earlier
        snapshots and writers at work are left alone; returns how many."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/segments")
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(p):
            return 0
        named, n = {s["id"] for s in self.snapshots.latest()[1]}, 0
        limit = self.spark._jvm.System.currentTimeMillis() - hours * 3_600_000
        for f in fs.listStatus(p):
            if f.getPath().getName() not in named and f.getModificationTime() <= limit:
                fs.delete(f.getPath(), True)
                n += 1
        return n

    def inventory(self) -> DataFrame:
        """backend, extract_version, entries, bytes of JSON."""
        x = self.all()
        return x.groupBy("backend", "extract_version").agg(F.count_distinct("sha16").alias("entries"), F.sum(F.octet_length("doc")).alias("bytes"))


def export_images(images: DataFrame, folder: str) -> None:
    """Writes (sha16, name, data) as folder/sha16/name; the executors write, no byte passes the driver."""
    write_files(images.select(F.col("sha16").alias("folder"), "name", "data"), folder)


def first_of_content(files: DataFrame) -> DataFrame:
    """sha16, path, n: one file per content key, the least path, and how many files share it; equal bytes are extracted once."""
    return files.groupBy("sha16").agg(F.min("path").alias("path"), F.count("*").alias("n"))
