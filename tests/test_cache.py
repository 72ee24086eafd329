"""The cache's snapshots: concurrent changes, evictions that rewrite nothing, compaction, bucketed lookups."""

import re
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from paperloom.functions.keys import FAST
from paperloom.operators.cache import ROOT_CONF, DocCache, cache_root
from paperloom.operators.snapshots import Conflict, Snapshots
from paperloom.schemas import ExtractedDoc


def docs(spark, names, text="m"):
    doc = F.struct(*[(F.concat(F.lit(text), "sha16") if f.name == "markdown" else F.lit(None).cast(f.dataType)).alias(f.name) for f in ExtractedDoc])
    return spark.createDataFrame([(n,) for n in names], "sha16 string").withColumn("doc", doc)


def found(cache):
    return {r["sha16"]: r["cached"]["markdown"] for r in cache.entries(FAST).collect()}


def test_changes_of_one_time_all_count(spark, tmp_path):
    snapshots = Snapshots(spark, str(tmp_path))
    with ThreadPoolExecutor(8) as pool:
        list(pool.map(lambda k: snapshots.commit(lambda n, s: [*s, {"id": k, "seq": n}]), range(24)))
    number, state = snapshots.latest()
    assert number == 24 and sorted(s["id"] for s in state) == list(range(24)) and sorted(s["seq"] for s in state) == list(range(1, 25))


def test_a_snapshot_that_was_never_finished_is_passed_over(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("paperloom.operators.snapshots.PATIENCE", 0.1)
    snapshots = Snapshots(spark, str(tmp_path))
    snapshots.commit(lambda n, s: [{"id": "a"}])
    (tmp_path / f"{2:020d}.json").write_text('{"segm')
    assert snapshots.latest() == (1, [{"id": "a"}])
    assert snapshots.commit(lambda n, s: [*s, {"id": "b"}]) == 3 and [s["id"] for s in snapshots.latest()[1]] == ["a", "b"]


def test_a_save_during_an_eviction_survives(spark, tmp_path, monkeypatch):
    cache = DocCache(spark, str(tmp_path))
    cache.save(docs(spark, ["a", "b"]), FAST)
    added, first = cache._added, []

    def late(name, kind, *rest, **more):  # another run saves between the eviction's rows and its snapshot
        if kind == "evicted" and not first:
            first.append(1)
            DocCache(spark, str(tmp_path)).save(docs(spark, ["late"]), FAST)
        return added(name, kind, *rest, **more)

    monkeypatch.setattr(cache, "_added", late)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "segments").rglob("*.parquet")}
    assert cache.evict(docs(spark, ["a", "late", "none"]), FAST) == 1
    assert set(found(cache)) == {"b", "late"}
    assert all(p.stat().st_mtime_ns == t for p, t in before.items())  # nothing was rewritten
    cache.save(docs(spark, ["a"], "again "), FAST)
    assert found(cache)["a"] == "again a"


def test_readers_keep_the_snapshot_they_began_with(spark, tmp_path):
    cache = DocCache(spark, str(tmp_path))
    cache.save(docs(spark, ["a", "b"]), FAST)
    reader = cache.entries(FAST).select("sha16")
    cache.evict(docs(spark, ["a"]), FAST)
    cache.compact(FAST)
    assert {r[0] for r in reader.collect()} == {"a", "b"} and set(found(cache)) == {"b"}


def test_compaction_keeps_what_is_committed_meanwhile(spark, tmp_path, monkeypatch):
    cache = DocCache(spark, str(tmp_path))
    cache.save(docs(spark, ["a", "b", "c"], "old "), FAST)
    cache.save(docs(spark, ["a"], "new "), FAST)
    cache.evict(docs(spark, ["c"]), FAST)
    segment, other = cache._segment, DocCache(spark, str(tmp_path))

    def slow(rows):
        name = segment(rows)
        other.evict(docs(spark, ["b"]), FAST)
        other.save(docs(spark, ["d"]), FAST)
        return name

    monkeypatch.setattr(cache, "_segment", slow)
    assert cache.compact(FAST) == 2
    assert found(cache) == {"a": "new a", "d": "md"}
    monkeypatch.setattr(cache, "_segment", lambda rows: [segment(rows), other.compact(FAST)][0])
    with pytest.raises(Conflict):
        cache.compact(FAST)
    assert found(cache) == {"a": "new a", "d": "md"}
    live = {s["id"] for s in cache.snapshots.latest()[1]}
    assert cache.vacuum(0) > 0 and {p.name for p in (tmp_path / "segments").iterdir()} == live and found(cache) == {"a": "new a", "d": "md"}


def test_lookups_stay_in_buckets(spark, tmp_path):
    cache = DocCache(spark, str(tmp_path), buckets=16)
    cache.save(docs(spark, [f"k{i}" for i in range(500)]), FAST)
    cache.save(docs(spark, [f"k{i}" for i in range(400, 600)], "second "), FAST)
    few = cache.hits(spark.createDataFrame([("k3",), ("k450",), (None,)], "sha16 string"), FAST)
    assert {r["sha16"]: r["cached"]["markdown"] for r in few.collect()} == {"k3": "mk3", "k450": "second k450"}
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert int(re.search(r"SelectedBucketsCount: (\d+) out of 16", plan)[1]) <= 2
    many = spark.range(5000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("sha16"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = cache.hits(many, FAST)
        plan = got._jdf.queryExecution().sparkPlan().toString() + got._jdf.queryExecution().executedPlan().toString()
        assert got.count() == 600
        side = got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # from the scan of the cache upwards there is no exchange before the join
    lines = side.split("\n")
    at = next(i for i, line in enumerate(lines) if "paperloom_cache_" in line)
    depth = lambda line: len(line) - len(line.lstrip(" :+-*|"))
    above, d = [], depth(lines[at])
    for line in reversed(lines[:at]):
        if depth(line) < d:
            above.append(line.strip(" :+-*|"))
            d = depth(line)
    upto = next(i for i, line in enumerate(above) if "Join" in line)
    assert not any("Exchange" in line for line in above[:upto]), above


def test_the_root_must_be_named_on_a_cluster():
    class Conf:
        def __init__(self, **own):
            self.own = own

        def get(self, key, other=None):
            return self.own.get(key, other)

    session = lambda **own: type("S", (), {"conf": Conf(**own)})()
    with pytest.raises(ValueError):
        cache_root(session(**{"spark.master": "spark://host:7077"}))
    assert cache_root(session(**{"spark.master": "yarn", ROOT_CONF: "hdfs:///c"})) == "hdfs:///c"
    assert cache_root(session(**{"spark.master": "local[2]"})).endswith("paperloom")
