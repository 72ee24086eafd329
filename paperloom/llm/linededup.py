"""Line dedup by winnowing over line hashes.

A text's lines are hashed (outer ASCII white space stripped). A gram is the least run of lines from a line on that holds NOISE
words; from each line on, the least run that holds GUARANTEE words is a window, and the gram with the least hash inside it is
a fingerprint. Every repeated run of lines with GUARANTEE words or more so shares a fingerprint; texts and places without a
shared one are left out. Of the rest, whole units are joined: the least run of GUARANTEE words from each line on, and the least
one up to each line. They cover every run of GUARANTEE words or more and nothing else. Each unit's position is joined to its first
one only, so the work is linear in the number of places, whatever the number of copies; positions that keep the same distance are
then extended into one another, both ways, as far as they meet. A line is deleted exactly if it stands in a match with a place that
is earlier in the order of (document, line), in the same document one that ends before the later one begins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm import _bytes as B
from paperloom.llm._store import written
from paperloom.llm.components import join_split, short_list

NOISE, GUARANTEE = 25, 50
SPACE = np.zeros(256, bool)
SPACE[[9, 11, 12, 13, 32]] = True
U = np.uint64


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts the hash and number of words of each line, and the offsets of each text's lines; an empty text has one line."""
    n = len(offsets) - 1
    breaks = np.flatnonzero(data == 10)
    of = np.searchsorted(offsets, breaks, "right") - 1
    at = np.arange(n + 1) + np.searchsorted(of, np.arange(n + 1))
    starts = np.empty(at[-1], np.int64)
    ends = np.empty(at[-1], np.int64)
    starts[at[:-1]] = offsets[:-1]
    ends[at[1:] - 1] = offsets[1:]
    inner = np.arange(len(breaks)) + of
    ends[inner] = breaks
    starts[inner + 1] = breaks + 1
    # stripped: from the first to the last byte that is not white space
    solid = np.flatnonzero(~SPACE[data] & (data != 10))
    first, last = np.searchsorted(solid, starts), np.searchsorted(solid, ends) - 1
    full = last >= first
    lo, hi = starts.copy(), starts.copy()
    lo[full], hi[full] = solid[first[full]], solid[last[full]] + 1
    begins, _ = B.spans(B.WORD[data], offsets)
    words = np.searchsorted(begins, ends) - np.searchsorted(begins, starts)
    return B.span_hashes(B.BYTE[data], lo, hi), words, at


def selected(hashes: np.ndarray, words: np.ndarray, noise: int = NOISE, guarantee: int = GUARANTEE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one text the hashes of all grams, the ends of the windows (one for each line that one starts at; these are the first
    lines), and the first line of the gram selected in each window."""
    n = len(hashes)
    upto = np.concatenate([[0], np.cumsum(words)])
    if upto[-1] < guarantee:
        return hashes[:0], np.zeros(0, np.int64), np.zeros(0, np.int64)
    gram_end = np.searchsorted(upto, upto[:-1] + noise)  # lines i .. gram_end-1 hold `noise` words
    window_end = np.searchsorted(upto, upto[:-1] + guarantee)
    grams = np.full(n, U(0))
    good = np.flatnonzero(gram_end <= n)
    grams[good] = B.span_hashes(hashes, good, gram_end[good])
    heads = np.flatnonzero(window_end <= n)
    last = np.searchsorted(gram_end, window_end[heads], "right") - 1  # the last gram inside each window
    best = heads.copy()
    for step in range(1, int((last - heads).max()) + 1):
        i = np.minimum(heads + step, last)
        best = np.where(grams[i] < grams[best], i, best)
    return grams, window_end[heads], best


def fingerprints(hashes: np.ndarray, words: np.ndarray, noise: int = NOISE, guarantee: int = GUARANTEE) -> tuple[np.ndarray, np.ndarray]:
    """Of one text the hashes and first lines of its selected grams."""
    grams, _, best = selected(hashes, words, noise, guarantee)
    chosen = np.unique(best)
    return grams[chosen], chosen


def units(hashes: np.ndarray, words: np.ndarray, at: np.ndarray, noise: int = NOISE, guarantee: int = GUARANTEE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one text the hashes, first lines and ends of its least runs of `guarantee` words, from each line on and up to each line,
    as far as the gram selected in the window at their first line is one of those at lines `at`."""
    _, ends, best = selected(hashes, words, noise, guarantee)
    upto = np.concatenate([[0], np.cumsum(words)])
    stops = np.flatnonzero(upto >= guarantee) if len(ends) else ends
    back = np.searchsorted(upto, upto[stops] - guarantee, "right") - 1  # the last line from which `guarantee` words stand before a stop
    other = ends[back] != stops  # else it is the window itself
    starts, ends = np.concatenate([np.arange(len(ends)), back[other]]), np.concatenate([ends, stops[other]])
    shared = np.isin(best[starts], at)
    starts, ends = starts[shared], ends[shared]
    return B.span_hashes(hashes, starts, ends), starts, ends


def text_lines(docs: DataFrame, noise: int, guarantee: int) -> DataFrame:
    """From (id, h, text): id, h, raw (packed line hashes, then words as 4 bytes), prints, places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, prints, places = [], [], []
            for _, _, part, off in B.parts(batch.column(2), lower=False):
                hashes, words, at = lines(part, off)
                for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                    raw.append(hashes[a:b].tobytes() + words[a:b].astype(np.uint32).tobytes())
                    p, k = fingerprints(hashes[a:b], words[a:b], noise, guarantee)
                    prints.append(p.astype(np.int64))
                    places.append(k.astype(np.int32))
            columns = [batch.column(0), batch.column(1), pa.array(raw, pa.binary()), pa.array(prints, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "h", "raw", "prints", "places"])

    return docs.mapInArrow(B.releasing(run), "id long, h long, raw binary, prints array<bigint>, places array<int>")


def text_units(shared: DataFrame, noise: int, guarantee: int) -> DataFrame:
    """From (id, h, at, raw): id, h, unit (hash), start, end of each unit whose fingerprint is one of those at lines `at`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = [], []
            for i in range(batch.num_rows):
                raw = batch.column(3)[i].as_buffer()
                n = raw.size // 12
                found.append(units(np.frombuffer(raw, U, n), np.frombuffer(raw, np.uint32, n, 8 * n).astype(np.int64), np.asarray(batch.column(2)[i].as_py()), noise, guarantee))
                rows.append(np.full(len(found[-1][0]), i))
            if not found:
                continue
            unit, start, end = (np.concatenate(x) for x in zip(*found, strict=True))
            of = pa.array(np.concatenate(rows))
            columns = [batch.column(0).take(of), batch.column(1).take(of), pa.array(unit.astype(np.int64)), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "h", "unit", "start", "end"])

    return shared.select("id", "h", "at", "raw").mapInArrow(B.releasing(run), "id long, h long, unit long, start int, end int")


def united(runs: Column) -> Column:
    """Sorted runs [start, end) with those that meet or overlap made one."""
    last = lambda done: F.element_at(done, -1)

    def add(done: Column, r: Column) -> Column:
        joined = F.struct(last(done)["start"].alias("start"), F.greatest(last(done)["end"], r["end"]).alias("end"))
        meets = (F.size(done) > 0) & (r["start"] <= F.get(done, F.size(done) - 1)["end"])
        return F.when(meets, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))).otherwise(F.concat(done, F.array(r)))

    return F.aggregate(runs, F.array().cast("array<struct<start:int,end:int>>"), add)


def matches(docs: DataFrame, key: str = "doc_id", text: str = "text", noise: int = NOISE, guarantee: int = GUARANTEE) -> DataFrame:
    """One row per later repeated run and first place: id, h (hash of the text), start, end (lines, [start, end)), first_id, first_h,
    first_start; as long as both runs stay equal and the first one is the first place of each of its units.

    Documents are told apart by key and text; rows that repeat both are one document, and neither is later than the other. A run
    is later if its first line stands after the other's in the order of key (null first), hash of the text, line; in one document
    it must begin where the other has ended, or later, so that a text whose lines recur keeps the first run of them.
    """
    x = docs.select(F.col(key).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("h"), F.col(text).cast("string").alias("text"))
    x = written(text_lines(x, noise, guarantee), "lines")
    places = x.where(F.size("prints") > 0).select("id", "h", F.explode(F.arrays_zip("prints", "places")).alias("p")).select("id", "h", F.col("p.prints").alias("print"), F.col("p.places").alias("at")).distinct()
    prints = places.groupBy("print").agg(F.count("*").alias("n")).where("n > 1").select("print")
    tie = F.concat_ws(":", F.coalesce(F.col("id").cast("string"), F.lit("null")), F.col("h").cast("string"))
    # one row for each document, with at most as many places as the text has lines
    shared = written(places.join(prints, "print").groupBy("id", "h").agg(F.collect_set("at").alias("at")).select("id", "h", "at", tie.alias("tie")), "lines-shared")
    own = x.join(short_list(shared.select("h").distinct()), "h", "left_semi").select(tie.alias("tie"), "raw")
    own = own.join(shared.select("tie"), "tie", "left_semi").dropDuplicates(["tie"])
    found = written(text_units(shared.join(own, "tie"), noise, guarantee), "lines-units")
    firsts = found.groupBy("unit").agg(F.min(F.struct("id", "h", "start", "end")).alias("first"), F.count("*").alias("n")).where("n > 1").select("unit", "first")
    earlier = F.struct("first.id", "first.h", "first.start") < F.struct("id", "h", "start")
    overlaps = F.col("first.id").eqNullSafe(F.col("id")) & (F.col("first.h") == F.col("h")) & (F.col("start") < F.col("first.end"))
    later = join_split(found, written(firsts, "lines-firsts"), "unit").where(earlier & ~overlaps)
    later = later.select("id", "h", F.col("first.id").alias("first_id"), F.col("first.h").alias("first_h"), (F.col("start") - F.col("first.start")).alias("apart"), "start", "end")
    runs = later.groupBy("id", "h", "first_id", "first_h", "apart").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("runs"))
    return runs.select("id", "h", F.explode(united(F.col("runs"))).alias("run"), "first_id", "first_h", "apart").select("id", "h", "run.*", "first_id", "first_h", (F.col("run.start") - F.col("apart")).alias("first_start"))


def repeated_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", noise: int = NOISE, guarantee: int = GUARANTEE) -> DataFrame:
    """One row per document with a later repeated run: id, h (hash of the text), first_id, runs (array of [start, end) lines), from
    matches(). first_id is the least key of a document in which one of the runs stands first. Runs that meet or overlap are given as one.
    """
    found = matches(docs, key, text, noise, guarantee)
    runs = found.groupBy("id", "h").agg(F.min("first_id").alias("first_id"), F.array_sort(F.collect_set(F.struct("start", "end"))).alias("runs"))
    return runs.withColumn("runs", united(F.col("runs")))


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", noise: int = NOISE, guarantee: int = GUARANTEE) -> DataFrame:
    """The columns of `docs` with later repeated runs cut from the text, and n_lines, n_deleted, first_id.

    Lines are parted by \\n; a text keeps its other lines and their order. A null text stays null with 0 lines; one of which every
    line is deleted becomes empty. first_id is the least key of a document that keeps one of the runs, else null. Texts with
    fewer than `guarantee` words never lose a line. `docs` must not have columns n_lines, n_deleted, first_id itself: clashing
    ones are replaced. An empty table gives an empty result.
    """
    runs = written(repeated_runs(docs, key, text, noise, guarantee), "lines-runs").select(F.col("id").alias("__id"), F.col("h").alias("__h"), F.col("first_id").alias("__first"), F.col("runs").alias("__runs"))
    x = docs.drop("n_lines", "n_deleted", "first_id")
    x = x.withColumn("__hash", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    # only texts with a run meet the runs; the others need not be shuffled
    same = F.col("__hash").eqNullSafe(F.col("__h")) & F.col(key).cast("long").eqNullSafe(F.col("__id"))
    hashes = short_list(runs.select(F.col("__h").alias("__hash")).distinct())
    x = x.join(hashes, "__hash", "left_semi").join(runs, same, "left").unionByName(x.join(hashes, "__hash", "left_anti"), allowMissingColumns=True)
    parts = F.split(F.col(text), "\n")
    kept = F.filter(parts, lambda line, i: ~F.exists("__runs", lambda r: (i >= r["start"]) & (i < r["end"])))
    x = x.withColumn("__lines", F.when(F.col("__runs").isNotNull(), F.array(F.array_join(kept, "\n"), F.size(kept).cast("string"))))
    n = F.coalesce(F.regexp_count(F.col(text), F.lit("\n")) + 1, F.lit(0)).cast("long")
    x = x.withColumn("n_lines", n).withColumn("n_deleted", F.coalesce(F.col("n_lines") - F.get("__lines", 1).cast("long"), F.lit(0)).cast("long"))
    x = x.withColumn("first_id", F.col("__first")).withColumn(text, F.when(F.col("__lines").isNotNull(), F.get("__lines", 0)).otherwise(F.col(text)))
    return x.drop("__hash", "__id", "__h", "__first", "__runs", "__lines")
