"""A prefix trie of conversations, as the Cartesian tree over their sorted order's LCP array.

Conversations are sorted by their turns; lcp is the number of first turns that one shares with its predecessor. For each place of
that array the nearest smaller values on both sides bound an interval, whose conversations share lcp turns: a node of the Cartesian
tree. Equal intervals are merged, single places added, and each node stands for the missing depths between its parent's and its own,
which are added last. Nearest smaller values are found in blocks of places; those that lie in another block are looked for in the
block that the block minima name. Counts and sums of a node are differences of running sums over its interval, so no step
walks along a path or gathers a subtree.

A conversation is never held whole: it is sorted by segments of SEGMENT turns, in which a turn is a 16-byte hash; segments after
the first are replaced by their ranks. The driver gets a few numbers per block, and there are at most MAX_BLOCKS blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.llm._store import written
from paperloom.llm.components import hot_among, join_split

SEGMENT, BLOCK, MAX_BLOCKS = 512, 1024, 16_384
IDS_IN_CHUNK = 4096
ID = 16  # bytes of a turn's hash
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def placed(rows: DataFrame, *order: str, label: str) -> DataFrame:
    """The rows with `pos`, their places (from 0) in the order of the given columns, by sorting ranges; offsets are one row per range."""
    x = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    x = written(x.select("*", F.spark_partition_id().alias("__p"), F.monotonically_increasing_id().alias("__i")), label)
    return with_offsets(x).withColumn("pos", F.col("__i") - F.col("__first") + F.col("__offset")).drop("__p", "__i", "__first", "__offset", "__before")


def with_offsets(x: DataFrame) -> DataFrame:
    """Adds to rows of ranges __p: __first (the range's least __i), __offset (rows of all earlier ranges), __before (the last range
    before it that holds rows)."""
    sizes = x.groupBy("__p").agg(F.min("__i").alias("__first"), F.count("*").alias("__n"))
    w = Window.orderBy("__p")
    before = F.coalesce(F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("__p", "__first", before.alias("__offset"), F.lag("__p").over(w).alias("__before"))
    return x.join(F.broadcast(sizes), "__p")


def turns_of(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, k from 0, id, n) and conversations (conv_id, start, size), from rows (conv_id, turn, role, text).

    Turns are ordered by `turn`, null first, those of the same number by id: the MD5 of role and text, of which null is empty.
    n is the text's length in UTF-8. Rows without a conv_id belong to no conversation. Repeated rows are turns of their own.
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    x = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", part("role").alias("role"), part("text").alias("text"))
    ident = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))
    x = placed(x.select("conv_id", "turn", ident.alias("id"), F.octet_length("text").cast("long").alias("n")), "conv_id", "turn", "id", label="trie-order")
    convs = written(x.groupBy("conv_id").agg(F.min("pos").alias("start"), F.count("*").alias("size")), "trie-convs")
    x = join_split(x, convs.select("conv_id", "start"), "conv_id", hot=hot_among(convs, "conv_id", "size"))
    return x.select("conv_id", (F.col("pos") - F.col("start")).alias("k"), "id", "n"), convs


def shared_starts(turns: DataFrame, convs: DataFrame, family: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Every conversation rebuilt: the first h turns of conversation conv_id - conv_id % family, then its own after its first h, where
    h is its number's CRC-32 modulo `most`. Gives turns (conv_id, idx, id, n) and conversations (conv_id, size)."""
    c = convs.select("conv_id", "size", (F.col("conv_id") - F.col("conv_id") % family).alias("base"), (F.crc32(F.col("conv_id").cast("string")) % most).alias("h"))
    c = c.join(convs.select(F.col("conv_id").alias("base"), F.col("size").alias("base_size")), "base", "left").withColumn("given", F.least("h", F.coalesce("base_size", F.lit(0))))
    c = written(c.select("conv_id", "base", "h", "given", "size"), "trie-plans")
    own = join_split(turns, c.select("conv_id", "h", "given"), "conv_id", hot=hot_among(c, "conv_id", "size")).where("k >= h")
    own = own.select("conv_id", (F.col("k") - F.col("h") + F.col("given")).alias("idx"), "id", "n")
    first = turns.where((F.col("k") < most - 1) & (F.col("conv_id") % family == 0)).withColumnRenamed("conv_id", "base")
    given = c.select("conv_id", "base", "h").join(first, "base").where("k < h").select("conv_id", F.col("k").alias("idx"), "id", "n")
    return given.unionByName(own), c.select("conv_id", (F.col("given") + F.greatest(F.col("size") - F.col("h"), F.lit(0))).alias("size"))


def segments(turns: DataFrame, segment: int) -> DataFrame:
    """conv_id, seg, key (the turns' hashes, ID bytes each), cum (bytes of text before each turn, in the segment), bytes."""
    before = Window.partitionBy("conv_id", "seg").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    x = turns.withColumn("seg", F.floor(F.col("idx") / segment).cast("long")).withColumn("cum", F.coalesce(F.sum("n").over(before), F.lit(0)))
    x = x.groupBy("conv_id", "seg").agg(F.sort_array(F.collect_list(F.struct("idx", "id", "cum"))).alias("t"), F.sum("n").alias("bytes"))
    return written(x.select("conv_id", "seg", F.unhex(F.array_join(F.col("t.id"), "")).alias("key"), F.col("t.cum").alias("cum"), "bytes"), "trie-segments")


def common(a: bytes, b: bytes, width: int) -> int:
    """How many first items of `width` bytes two byte strings share."""
    n = min(len(a), len(b)) // width
    if a[: n * width] == b[: n * width]:
        return n
    k = 0
    while a[k * width : (k + 1) * width] == b[k * width : (k + 1) * width]:
        k += 1
    return k


def shared_turns(a: tuple[bytes, bytes], b: tuple[bytes, bytes], segment: int) -> tuple[int, int, int]:
    """Of two conversations (first segment, ranks of the others) the turns known to be shared, and the ranks of the first pair of
    segments that differ and are to be compared, or -1."""
    k = common(a[0], b[0], ID)
    if k < segment:
        return k, -1, -1
    m = common(a[1], b[1], 8)
    ranks = [int.from_bytes(x[1][8 * m : 8 * m + 8], "big") if len(x[1]) > 8 * m else -1 for x in (a, b)]
    return segment * (1 + m), *(ranks if min(ranks) >= 0 else (-1, -1))


def sorted_lcps(convs: DataFrame, ranked: DataFrame | None, segment: int) -> DataFrame:
    """From (conv_id, size, tot, key, rest): pos, conv_id, size, tot, lcp (turns shared with the one before; -1 at place 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        p = TaskContext.get().partitionId()
        before, i = None, 0
        names = ["__p", "__i", "conv_id", "size", "tot", "lcp", "a", "b", "key", "rest"]
        for batch in batches:
            keys = list(zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True))
            found = [shared_turns(x, y, segment) if x else (-1, -1, -1) for x, y in zip([before, *keys[:-1]], keys, strict=True)]
            n = len(keys)
            # only the ends of a batch can be ends of the range: they keep their keys
            ends = [k if j in (0, n - 1) else (None, None) for j, k in enumerate(keys)]
            columns = [pa.array(np.full(n, p, np.int64)), pa.array(np.arange(i, i + n)), *batch.columns[:3], *(pa.array([f[j] for f in found], pa.int64()) for j in range(3)), *(pa.array([e[j] for e in ends], pa.binary()) for j in range(2))]
            yield pa.RecordBatch.from_arrays(columns, names=names)
            before, i = keys[-1], i + n

    order = ("key", "rest", "conv_id")
    x = convs.select("conv_id", "size", "tot", "key", "rest").repartitionByRange(*order).sortWithinPartitions(*order)
    x = with_offsets(written(x.mapInArrow(run, "__p long, __i long, conv_id long, size long, tot long, lcp long, a long, b long, key binary, rest binary"), "trie-sorted"))
    last = x.groupBy("__p").agg(F.max("__i").alias("__i")).join(x.select("__p", "__i", "key", "rest"), ["__p", "__i"]).select(F.col("__p").alias("__before"), F.col("key").alias("k0"), F.col("rest").alias("r0"))
    first = x.where("__i = 0").join(last, "__before").select("conv_id", "k0", "r0", "key", "rest")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared_turns((k0, r0), (k, r), segment) for k0, r0, k, r in zip(*(batch.column(j).to_pylist() for j in range(1, 5)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([f[j] for f in found], pa.int64()) for j in range(3))], names=["conv_id", "lcp", "a", "b"])

    joins = written(first.mapInArrow(pairs, "conv_id long, lcp long, a long, b long"), "trie-ranges")  # one row per range
    rows = x.select((F.col("__i") - F.col("__first") + F.col("__offset")).alias("pos"), "conv_id", "size", "tot", "lcp", "a", "b")
    better = lambda c: F.coalesce(F.col(f"j.{c}"), F.col(f"x.{c}")).alias(c)
    rows = rows.alias("x").join(F.broadcast(joins).alias("j"), "conv_id", "left").select("x.pos", "conv_id", "x.size", "x.tot", better("lcp"), better("a"), better("b"))
    rows = rows.withColumn("lcp", F.least("lcp", "size"))  # an equal last segment need not be full
    if ranked is None:
        return rows.drop("a", "b")

    def more(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [common(a, b, ID) for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["conv_id", "more"])

    key_of = lambda c: ranked.select(F.col("rank").alias(c), F.col("key").alias(f"key_{c}"))
    rows = written(rows, "trie-lcps")
    rest = rows.where("a >= 0").select("conv_id", "a", "b").join(key_of("a"), "a").join(key_of("b"), "b").select("conv_id", "key_a", "key_b").mapInArrow(more, "conv_id long, more long")
    return rows.join(rest, "conv_id", "left").select("pos", "conv_id", "size", "tot", (F.col("lcp") + F.coalesce("more", F.lit(0))).alias("lcp"))


def nearest_smaller(values: list[int]) -> list[int]:
    """For each place the nearest place on the left with a smaller value, or -1."""
    out, stack = [], []
    for i, v in enumerate(values):
        while stack and values[stack[-1]] >= v:
            stack.pop()
        out.append(stack[-1] if stack else -1)
        stack.append(i)
    return out


def doubled(values: np.ndarray) -> list[np.ndarray]:
    """Minima of the 1, 2, 4 ... values from each place on."""
    out, step = [values], 1
    while 2 * step <= len(values):
        out.append(np.minimum(out[-1][: len(values) - 2 * step + 1], out[-1][step : len(values) - step + 1]))
        step *= 2
    return out


def range_min(tables: list[np.ndarray], lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Minima of values[lo:hi], none of them empty."""
    level = np.frexp((hi - lo).astype(np.float64))[1] - 1
    out = np.empty(len(lo), np.int64)
    for k in np.unique(level):
        at = level == k
        out[at] = np.minimum(tables[k][lo[at]], tables[k][hi[at] - (1 << int(k))])
    return out


def block_rows(block: int):
    """Work inside a block: nearest smaller values as far as they lie in it (else -1), running sums and minima."""

    def run(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("pos", ignore_index=True)
        after = -1
        if x.pos.iloc[-1] // block != key[0]:  # the first place of the next block
            after = int(x.lcp.iloc[-1])
            x = x.iloc[:-1]
        lcp, at, n = x.lcp.to_numpy(), int(x.pos.iloc[0]), len(x)
        left = np.array(nearest_smaller(lcp.tolist()), np.int64)
        right = n - 1 - np.array(nearest_smaller(lcp[::-1].tolist()), np.int64)[::-1]  # n where there is none
        ends = right < n
        conv = x.conv_id.to_numpy()
        both = (left >= 0) & ends
        least = np.full(n, -1, np.int64)
        if both.any():
            least[both] = range_min(doubled(conv), left[both], right[both])
        out = x.assign(block=key[0], nxt=np.append(lcp[1:], after))
        out["leaf"] = (out.nxt < out["size"]).astype(np.int64)
        out["left"], out["right"] = np.where(left >= 0, left + at, -1), np.where(ends, right + at, -1)
        out["left_lcp"], out["right_lcp"] = np.where(left >= 0, lcp[left], -1), np.where(ends, lcp[np.minimum(right, n - 1)], -1)
        out["inside"], out["least"] = both, least
        out["sum_tot"], out["sum_new"], out["sum_leaf"] = x.tot.cumsum(), x.new.cumsum(), out.leaf.cumsum()
        out["upto"], out["from"] = np.minimum.accumulate(conv), np.minimum.accumulate(conv[::-1])[::-1]
        opens = ~((lcp == x["size"].to_numpy()) & (x.pos.to_numpy() > 0))  # not equal to its predecessor
        out["leader"] = np.maximum.accumulate(np.where(opens, x.pos.to_numpy(), -1))
        return out

    return run


BLOCK_ROW = "pos long, conv_id long, size long, tot long, new long, lcp long, block long, nxt long, leaf long, left long, right long, left_lcp long, right_lcp long, inside boolean, least long, sum_tot long, sum_new long, sum_leaf long, upto long, from long, leader long"


def block_before(minima: list[np.ndarray], block: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The last block before `block` whose minimum is under `value`, or -1."""
    at = block - 1
    for k in range(len(minima) - 1, -1, -1):
        lo = at - (1 << k) + 1
        skip = (lo >= 0) & (minima[k][np.maximum(lo, 0).clip(max=len(minima[k]) - 1)] >= value)
        at = np.where(skip, at - (1 << k), at)
    return at


def resolved(blocks: DataFrame, summary: pd.DataFrame, n: int) -> DataFrame:
    """block_rows() with left, right and their values found in other blocks where they don't lie in the own one.

    A block asks once for each value and side. The block minima (one number a block) name the block that answers, which needs only
    its places without a smaller one on the asking side.
    """
    spark = blocks.sparkSession
    forth, back, last = doubled(summary["min"].to_numpy()), doubled(summary["min"].to_numpy()[::-1].copy()), len(summary) - 1
    asked = blocks.where("left < 0 AND pos > 0").select(F.lit(-1).alias("side"), "block", F.col("lcp").alias("value")).unionByName(blocks.where("right < 0").select(F.lit(1).alias("side"), "block", F.col("lcp").alias("value"))).distinct()

    def where(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            b, v = x.block.to_numpy(), x.value.to_numpy()
            mirrored = block_before(back, last - b, v)
            yield x.assign(target=np.where(x.side.to_numpy() < 0, block_before(forth, b, v), np.where(mirrored < 0, -1, last - mirrored)))

    asked = written(asked.mapInPandas(where, "side int, block long, value long, target long"), "trie-asked")
    known = blocks.where("right < 0").select(F.lit(-1).alias("side"), "block", "pos", "lcp").unionByName(blocks.where("left < 0").select(F.lit(1).alias("side"), "block", "pos", "lcp"))

    def answer(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        if not len(q):
            return pd.DataFrame({"side": [], "block": [], "value": [], "at": [], "at_lcp": []}).astype({"side": "int32"} | dict.fromkeys(("block", "value", "at", "at_lcp"), "int64"))
        x = x.sort_values("pos", ascending=q.side.iloc[0] < 0)  # so that values rise
        at = np.searchsorted(x.lcp.to_numpy(), q.value.to_numpy(), "left") - 1
        return q[["side", "block", "value"]].assign(at=x.pos.to_numpy()[at], at_lcp=x.lcp.to_numpy()[at])

    inner = asked.where("target >= 0").groupBy("side", "target").cogroup(known.groupBy("side", "block")).applyInPandas(answer, "side int, block long, value long, at long, at_lcp long")
    answers = written(inner.unionByName(asked.where("target < 0").select("side", "block", "value", F.lit(n).cast("long").alias("at"), F.lit(-1).cast("long").alias("at_lcp"))), "trie-answers")

    def side(sign: int, name: str) -> DataFrame:
        return answers.where(F.col("side") == sign).select("block", F.col("value").alias("lcp"), F.col("at").alias(f"{name}_at"), F.col("at_lcp").alias(f"{name}_at_lcp"))

    x = blocks.join(side(-1, "left"), ["block", "lcp"], "left").join(side(1, "right"), ["block", "lcp"], "left")
    for name in ("left", "right"):
        x = x.withColumn(f"{name}_lcp", F.when(F.col(name) < 0, F.coalesce(f"{name}_at_lcp", F.lit(-1))).otherwise(F.col(f"{name}_lcp")))
        x = x.withColumn(name, F.when(F.col(name) < 0, F.coalesce(f"{name}_at", F.lit(-1))).otherwise(F.col(name)))
    sums = summary[["sum_tot", "sum_new", "sum_leaf"]].cumsum().shift(fill_value=0).rename(columns=lambda c: c.replace("sum", "off"))
    offsets = pd.concat([summary[["block"]], sums, summary.leader.replace(-1, np.nan).ffill().shift(fill_value=0).astype("int64").rename("off_leader")], axis=1)
    x = x.join(F.broadcast(spark.createDataFrame(offsets)), "block")  # one row per block
    for c in ("tot", "new", "leaf"):
        x = x.withColumn(f"sum_{c}", F.col(f"sum_{c}") + F.col(f"off_{c}"))
    x = x.withColumn("leader", F.when(F.col("leader") < 0, F.col("off_leader")).otherwise(F.col("leader")))
    return x.select("pos", "conv_id", "size", "tot", "lcp", "nxt", "leaf", "block", "left", "right", "left_lcp", "right_lcp", "inside", "least", "sum_tot", "sum_new", "sum_leaf", "upto", "from", "leader")


def compact_nodes(places: DataFrame, summary: pd.DataFrame) -> DataFrame:
    """The Cartesian tree's merged nodes and the single places: l, v (depth), lo (the parent's depth, -1 if there is none), parent_l,
    owner (conversation at l), least (conv_id), n, kids, ends (whether one ends here), and sums over the interval."""
    inner = places.where("pos > 0").groupBy(F.col("left").alias("l"), F.col("lcp").alias("v")).agg(
        F.max("right").alias("after"), F.max(F.greatest("left_lcp", "right_lcp")).alias("lo"), F.count_if(F.col("size") > F.col("lcp")).alias("kids"), F.max("least").alias("least"), F.max("inside").alias("inside"))
    inner = written(inner.withColumn("r", F.col("after") - 1), "trie-intervals")
    at_l = places.select(F.col("pos").alias("l"), F.col("conv_id").alias("owner"), F.col("size").alias("l_size"), F.col("tot").alias("l_tot"), F.col("lcp").alias("l_lcp"), F.col("left").alias("l_left"), F.col("block").alias("l_block"), F.col("from").alias("l_from"), "sum_tot", "sum_new", "sum_leaf", F.col("leaf").alias("l_leaf"))
    at_r = places.select(F.col("pos").alias("r"), F.col("block").alias("r_block"), F.col("upto").alias("r_upto"), F.col("sum_tot").alias("r_tot"), F.col("sum_new").alias("r_new"), F.col("sum_leaf").alias("r_leaf"))
    x = join_split(join_split(inner, at_r, "r"), at_l, "l")
    between = doubled(summary.conv.to_numpy())

    def middle(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f[["l", "v"]].assign(middle=range_min(between, f.l_block.to_numpy() + 1, f.r_block.to_numpy()))

    x = written(x, "trie-bounds")
    wide = x.where("r_block > l_block + 1").select("l", "v", "l_block", "r_block").mapInPandas(middle, "l long, v long, middle long")
    x = x.join(wide, ["l", "v"], "left")
    least = F.when(F.col("inside"), F.col("least")).when(F.col("l_block") == F.col("r_block"), F.col("l_from")).otherwise(F.least("l_from", "r_upto", "middle"))
    x = x.select(
        "l", "v", "lo", "owner", least.alias("least"), (F.col("r") - F.col("l") + 1).alias("n"), (F.col("kids") + (F.col("l_size") > F.col("v")).cast("long")).alias("kids"), (F.col("l_size") == F.col("v")).alias("ends"),
        F.when(F.col("l_lcp") < F.col("lo"), F.col("l")).otherwise(F.col("l_left")).alias("parent_l"), "l_tot",
        (F.col("r_tot") - F.col("sum_tot") + F.col("l_tot")).alias("tot"), (F.col("r_new") - F.col("sum_new")).alias("new"), (F.col("r_leaf") - F.col("sum_leaf") + F.col("l_leaf")).alias("leaves"),
    )
    lo = F.greatest("lcp", "nxt")
    single = places.where(F.col("size") > lo).select(
        F.col("pos").alias("l"), F.col("size").alias("v"), lo.alias("lo"), F.col("conv_id").alias("owner"), F.col("conv_id").alias("least"), F.lit(1).cast("long").alias("n"), F.lit(0).cast("long").alias("kids"), F.lit(True).alias("ends"),
        F.when(F.col("lcp") < lo, F.col("pos")).otherwise(F.col("left")).alias("parent_l"), F.col("tot").alias("l_tot"), "tot", F.lit(0).cast("long").alias("new"), F.col("leaf").alias("leaves"),
    )
    return written(x.unionByName(single), "trie-nodes")


def end_hashes(places: DataFrame) -> DataFrame:
    """l, sha: for each set of equal conversations its first place and the SHA-256 of their numbers, ascending, joined by commas.

    Numbers are joined in chunks of IDS_IN_CHUNK places. Sets of several chunks are hashed chunk after chunk, one chunk in memory.
    """
    x = places.groupBy("leader", F.floor(F.col("pos") / IDS_IN_CHUNK).alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("pos", "conv_id"))).alias("t"))
    x = written(x.select(F.col("leader").alias("l"), "chunk", F.array_join(F.transform(F.col("t.conv_id"), lambda c: c.cast("string")), ",").alias("ids")), "trie-ends")
    large = x.groupBy("l").count().where("count > 1").select("l")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            out: list[tuple[int, str]] = []
            for row in range(batch.num_rows):
                l, ids = batch.column(0)[row].as_py(), batch.column(2)[row].as_py().encode()
                if l == now:
                    state.update(b"," + ids)
                    continue
                if state:
                    out.append((now, state.hexdigest()))
                now, state = l, hashlib.sha256(ids)
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.string())], names=["l", "sha"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([state.hexdigest()], pa.string())], names=["l", "sha"])

    many = x.join(large, "l", "left_semi").repartition("l").sortWithinPartitions("l", "chunk").select("l", "chunk", "ids").mapInArrow(run, "l long, sha string")
    return x.join(large, "l", "left_anti").select("l", F.sha2("ids", 256).alias("sha")).unionByName(many)


def segment_starts(segs: DataFrame) -> DataFrame:
    """conv_id, seg, key, cum, bytes and off: bytes of text before the segment."""
    if segs.where("seg > 0").isEmpty():
        return segs.withColumn("off", F.lit(0).cast("long"))
    w = Window.partitionBy("conv_id").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    off = segs.select("conv_id", "seg", F.coalesce(F.sum("bytes").over(w), F.lit(0)).alias("off"))
    return segs.join(off, ["conv_id", "seg"])


def sortable(segs: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """conv_id, size, tot, key (first segment), rest (ranks of the others, 8 bytes each); and the ranked segments, if there are any."""
    nothing = F.unhex(F.lit(""))
    x = convs.join(segs.where("seg = 0").select("conv_id", "key", F.col("bytes").alias("tot")), "conv_id", "left")
    x = x.select("conv_id", "size", F.coalesce("tot", F.lit(0)).alias("tot"), F.coalesce("key", nothing).alias("key"))
    later = segs.where("seg > 0").select("conv_id", "seg", "key", "bytes", F.md5("key").alias("digest"))
    if later.isEmpty():
        return x.withColumn("rest", nothing), None
    ranked = written(placed(later.dropDuplicates(["digest"]).select("key", "digest"), "key", "digest", label="trie-ranks").withColumnRenamed("pos", "rank"), "trie-ranked")
    ranks = join_split(later.select("conv_id", "seg", "bytes", "digest"), ranked.select("digest", "rank"), "digest")
    packed = F.unhex(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seg", "rank"))), lambda r: F.lpad(F.hex(r["rank"]), 16, "0")), ""))
    rest = ranks.groupBy("conv_id").agg(packed.alias("rest"), F.sum("bytes").alias("more"))
    x = x.join(rest, "conv_id", "left")
    return x.select("conv_id", "size", (F.col("tot") + F.coalesce("more", F.lit(0))).alias("tot"), "key", F.coalesce("rest", nothing).alias("rest")), ranked


def trie(turns: DataFrame, convs: DataFrame, segment: int = SEGMENT, block: int = BLOCK) -> DataFrame:
    """The nodes of the prefix trie of conversations `convs` (conv_id, size) with turns (conv_id, idx from 0, id: 32 hexadecimal
    digits, n: bytes), as NODE says; turnless conversations are members of the root. No conversations, no nodes.

    A node's conv_id is its least member. saved_tokens sums, over its subtree, each node's n_convs - 1 times the bytes of its last
    turn. ends_sha256 hashes the numbers of the conversations that end there.
    """
    spark = turns.sparkSession
    segs = segments(turns, segment)
    keyed, ranked = sortable(segs, convs)
    order = written(sorted_lcps(keyed, ranked, segment), "trie-array")
    n = order.count()
    if not n:
        return spark.createDataFrame([], NODE)
    segs = segment_starts(segs)
    # bytes of the turns that a conversation has beyond those shared with its predecessor
    at = order.withColumn("seg", F.floor(F.col("lcp") / segment).cast("long")).join(segs.select("conv_id", "seg", "cum", "off"), ["conv_id", "seg"], "left")
    shared = F.when(F.col("lcp") < 0, F.lit(0)).when(F.col("lcp") >= F.col("size"), F.col("tot")).otherwise(F.col("off") + F.get("cum", (F.col("lcp") % segment).cast("int")))
    order = at.select("pos", "conv_id", "size", "tot", (F.col("tot") - shared).alias("new"), "lcp")
    block = max(block, -(-n // MAX_BLOCKS))
    own = F.floor(F.col("pos") / block).cast("long")
    to = F.when((F.col("pos") % block == 0) & (F.col("pos") > 0), F.array(own, own - 1)).otherwise(F.array(own))  # a block sees the next one's first place
    blocks = written(order.withColumn("block", F.explode(to)).groupBy("block").applyInPandas(block_rows(block), BLOCK_ROW), "trie-blocks")
    summary = blocks.groupBy("block").agg(F.min("lcp").alias("min"), F.min("conv_id").alias("conv"), F.sum("tot").alias("sum_tot"), F.sum("new").alias("sum_new"), F.sum("leaf").alias("sum_leaf"), F.max("leader").alias("leader"))
    summary = summary.toPandas().sort_values("block", ignore_index=True)  # at most MAX_BLOCKS rows
    places = written(resolved(blocks, summary, n), "trie-places")
    nodes = compact_nodes(places, summary)
    ident = lambda l, v: F.concat_ws(":", l, v)
    parents = nodes.where("kids > 0").select(ident("l", "v").alias("parent"), F.col("least").alias("above"), "kids")
    nodes = join_split(nodes.withColumn("parent", ident("parent_l", "lo")), parents.select("parent", "above"), "parent", "left", hot=hot_among(parents, "parent", "kids"))
    ends = end_hashes(places).withColumn("ends", F.lit(True))
    nodes = written(nodes.join(ends, ["l", "ends"], "left"), "trie-linked")
    return depths(nodes, segs, segment)


def depths(nodes: DataFrame, segs: DataFrame, segment: int) -> DataFrame:
    """A row for each depth that a compact node stands for, lo + 1 to v; bytes before a turn come from its owner's segments."""

    def row(depth: Column, before: Column) -> list[Column]:
        # all members' bytes from this depth on, less each distinct turn's bytes once
        saved = F.col("tot") - F.col("n") * before - (F.col("new") + F.col("l_tot") - before)
        last = depth == F.col("v")
        sha = F.when(last & F.col("sha").isNotNull(), F.col("sha")).otherwise(F.sha2(F.lit(""), 256))
        above = F.when(depth > F.col("lo") + 1, F.col("least")).otherwise(F.col("above"))
        return [
            F.col("least").alias("conv_id"), depth.cast("long").alias("depth"), F.when(depth > 0, above).alias("parent_conv_id"), F.col("n").alias("n_convs"), F.when(last, F.col("kids")).otherwise(F.lit(1)).cast("long").alias("n_children"),
            F.col("leaves").alias("n_leaves"), saved.cast("long").alias("saved_tokens"), sha.alias("ends_sha256"),
        ]

    root = nodes.where("lo < 0").select(*row(F.lit(0).cast("long"), F.lit(0).cast("long")))
    low = F.greatest(F.col("lo"), F.lit(0))
    seg_of = lambda c: F.floor(c / segment).cast("long")
    x = nodes.where("v > 0").withColumn("seg", F.explode(F.sequence(seg_of(low), seg_of(F.col("v") - 1))))
    x = x.join(segs.select(F.col("conv_id").alias("owner"), "seg", "cum", "off"), ["owner", "seg"])
    begin, stop = F.greatest(low, F.col("seg") * segment), F.least(F.col("v"), (F.col("seg") + 1) * segment)
    x = x.withColumn("idx", F.explode(F.sequence(begin, stop - 1)))
    return x.select(*row(F.col("idx") + 1, F.col("off") + F.get("cum", (F.col("idx") % segment).cast("int")))).unionByName(root)
