"""MinHash near-dedup: improved consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard.

1. A shingle's weight is tf * (1 + IDF_SHARE * ln p / ln q): p is the share of texts that hold it, RARE at least, and q the least
   share that there can be, 1/N or RARE. So the weight is a function of the shingle's exact share, by one formula for tables of any
   size, and no frequency is estimated. Only shingles of at least RARE * N texts differ from the largest weight: all texts are
   counted into two tables of 2**DF_BITS hashed cells; only a shingle both of whose cells reach that number can itself, and those
   are counted one by one. There are at most (mean number of a text's shingles) / RARE of them, however many texts there are.
   Weights are bounded, since with plain IDF the shingles of a group of copies that holds a third of all rows weigh next to nothing,
   and copies that share nine tenths of their shingles would no longer be similar.
2. Each distinct text gets BANDS * ROWS consistent weighted samples; a sample of a text is a shingle with its quantised weight,
   equal in two texts with a probability of their weighted Jaccard similarity. ROWS samples make the key of a band.
3. Within a bucket (band, key) every text is compared with the bucket's most central text, verified on all shingles, and the
   links make components. Where a bucket still holds several, each text outside the largest is compared with all of other
   components, as far as an upper bound of the similarity leaves it open. No candidate pair whose link could join two classes
   stays unverified, and a bucket of copies costs about as much as it has texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm import _bytes as B
from paperloom.llm._store import written
from paperloom.llm.components import components, dealt, hot_among, hot_keys, join_split, repeated, short_list

WORDS = 5
BANDS, ROWS = 16, 4
DF_BITS = 21
DF_CHUNK = 1 << 12
IDF_SHARE = 0.25
RARE = 1 / 1024  # shares of texts below this count alike
U = np.uint64
_rng = np.random.default_rng(97)
MULTIPLIERS = _rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.int64).astype(U) * U(2) + U(1)
# tables of the sampling's random variables, indexed by 14 bits each of the mixed shingle
_GRID = (np.arange(1 << 14) + 0.5) / (1 << 14)


def _gamma2(u: np.ndarray) -> np.ndarray:
    """Quantiles of Gamma(2, 1), by Newton steps on 1 - (1 + x) exp(-x) = u."""
    x = np.sqrt(2 * u) + u
    for _ in range(60):
        x = np.maximum(1e-9, x - (1 - (1 + x) * np.exp(-x) - u) / np.maximum(1e-12, x * np.exp(-x)))
    return x


_ORDERS = [np.random.default_rng(s).permutation(1 << 14) for s in (1, 2, 3)]
R = _gamma2(_GRID)[_ORDERS[0]].astype(np.float32)
R_INVERSE = (1 / R).astype(np.float32)
LOG_C = np.log(_gamma2(_GRID))[_ORDERS[1]].astype(np.float32)
BETA = _GRID[_ORDERS[2]].astype(np.float32)


def counted(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each text the distinct shingles, sorted, and how often each stands there."""
    hashes, at = B.words(data, offsets)
    for s in B.shingles(hashes, at, WORDS):
        yield np.unique(s, return_counts=True)


def cells_of(shingles: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Each shingle's cells in the two tables, the second one's numbered after the first one's."""
    return (shingles >> U(64 - bits)).astype(np.int64), ((shingles & U((1 << bits) - 1)) + U(1 << bits)).astype(np.int64)


def cell_counts(docs: DataFrame, text: str, bits: int) -> tuple[np.ndarray, int]:
    """How many (text, distinct shingle) fall into each of the cells of both tables, and the number of texts with shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, n = np.zeros(2 << bits, np.int32), 0
        for batch in batches:
            for _, _, part, off in B.parts(batch.column(0)):
                own = [s for s, _ in counted(part, off)]
                n += sum(len(s) > 0 for s in own)
                if own:
                    for cells in cells_of(np.concatenate(own), bits):
                        at, times = np.unique(cells, return_counts=True)
                        table[at] += times.astype(np.int32)
        if n:
            chunks = table.reshape(-1, DF_CHUNK)
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(chunks)), pa.int32()), pa.array([np.array([n], np.int64).tobytes(), *(c.tobytes() for c in chunks)], pa.binary())], names=["chunk", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for c, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = np.frombuffer(raw.as_buffer(), np.int64 if c < 0 else np.int32).astype(np.int64)
                sums[c] = sums[c] + x if c in sums else x
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["chunk", "counts"])

    chunks = (2 << bits) // DF_CHUNK
    parts = docs.select(F.col(text).cast("string")).mapInArrow(B.releasing(run), "chunk int, counts binary")
    sums = parts.repartition("chunk").mapInArrow(B.releasing(add), "chunk int, counts binary").toLocalIterator()  # of a fixed size
    table, n = np.zeros((chunks, DF_CHUNK), np.int64), 0
    for r in sums:
        if r[0] < 0:
            n = int(np.frombuffer(r[1], np.int64)[0])
        else:
            table[r[0]] = np.frombuffer(r[1], np.int64)
    return table.ravel(), n


class Idf:
    """Weights of shingles: those of at least `least` texts are listed with their exact frequency, all others count as of one; shares
    below `rare` count alike."""

    def __init__(self, shingles: np.ndarray, df: np.ndarray, n: int, least: int, bits: int, rare: float = 0.0):
        by, self.bits, self.rare = np.argsort(shingles), bits, rare
        self.shingles, self.n, self.least = shingles[by], n, least
        self.weights = self.weight(df[by])
        self.single = self.weight(np.ones(1))[0]
        self.listed = np.zeros(1 << bits, bool)
        self.listed[cells_of(self.shingles, bits)[0]] = True

    def weight(self, df: np.ndarray) -> np.ndarray:
        n = max(2, self.n)
        top = np.log(min(n, 1 / self.rare) if self.rare else n)
        return (1 + IDF_SHARE * np.minimum(top, np.log(n / np.maximum(1, df))) / top).astype(np.float32)

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        out = np.full(len(shingles), self.single, np.float32)
        may = np.flatnonzero(self.listed[cells_of(shingles, self.bits)[0]])
        if len(may):
            own = shingles[may]
            at = np.minimum(np.searchsorted(self.shingles, own), len(self.shingles) - 1)
            same = self.shingles[at] == own
            out[may[same]] = self.weights[at[same]]
        return out


def frequencies(docs: DataFrame, text: str, bits: int = DF_BITS, rare: float | None = None) -> Idf:
    """Weights from the exact document frequencies of all shingles of at least T texts.

    With `rare` T is that share of the texts, and the weights, in which smaller shares count alike, are exact for every shingle.
    Without it T is six standard deviations above the cells' mean, so that at most 2**bits shingles are listed whatever the texts,
    and a rarer one counts as of a single text.
    """
    cells, n = cell_counts(docs, text, bits)
    mean = float(cells.mean())
    least = max(2, int(np.ceil(mean + 6 * np.sqrt(mean) if rare is None else n * rare)))
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(cells >= least))  # 2 * 2**bits bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy = np.unpackbits(shared.value).astype(bool)
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            keys, inverse = np.unique(np.concatenate([x[0] for x in held]), return_inverse=True)
            return keys, np.bincount(inverse, weights=np.concatenate([x[1] for x in held])).astype(np.int64)

        def out() -> Iterator[pa.RecordBatch]:
            if held:
                keys, times = merged()
                for i in range(0, len(keys), 65_536):
                    yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + 65_536].astype(np.int64)), pa.array(times[i : i + 65_536])], names=["shingle", "n"])
                held.clear()

        for batch in batches:
            for _, _, part, off in B.parts(batch.column(0)):
                own = [s for s, _ in counted(part, off)]
                if own:
                    s = np.concatenate(own)
                    first, second = cells_of(s, bits)
                    held.append(np.unique(s[heavy[first] & heavy[second]], return_counts=True))
                if len(held) >= 24:
                    held[:] = [merged()]
                    if len(held[0][0]) > 1_000_000:
                        yield from out()
        yield from out()

    counts = docs.select(F.col(text).cast("string")).mapInArrow(B.releasing(run), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    got = counts.toArrow()  # at most total / T
    return Idf(got["shingle"].to_numpy().astype(U), got["n"].to_numpy(), n, least, bits, rare or 0.0)


def weights_of(shingles: np.ndarray, counts: np.ndarray, idf: Idf) -> np.ndarray:
    return counts.astype(np.float32) * idf(shingles)


def samples(shingles: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """One consistent weighted sample of each function, as the hash of shingle and quantised weight.

    Per shingle and function r, c ~ Gamma(2, 1) and b ~ U(0, 1); t = floor(ln S / r + b), ln y = r (t - b), and the shingle with
    the least ln c - ln y - r is the sample, with t.
    """
    logs = np.log(weights)[:, None]
    best = np.full(len(MULTIPLIERS), np.inf, np.float32)
    out = np.zeros(len(MULTIPLIERS), U)
    for i in range(0, len(shingles), 2048):  # bounded temporaries for long texts
        s, log = shingles[i : i + 2048], logs[i : i + 2048]
        z = s[:, None] * MULTIPLIERS
        ir = z >> U(50)
        ib = (z >> U(36)) & U(0x3FFF)
        ic = (z >> U(22)) & U(0x3FFF)
        r, b = R[ir], BETA[ib]
        t = np.floor(log * R_INVERSE[ir] + b)
        a = LOG_C[ic] - r * (t - b + 1)
        k = a.argmin(axis=0)
        cols = np.arange(len(MULTIPLIERS))
        found = a[k, cols]
        better = found < best
        sample = B.mix(s[k] ^ B.mix(t[k, cols].astype(np.int64).astype(U) + U(1)))
        best = np.where(better, found, best)
        out = np.where(better, sample, out)
    return out


def band_keys(docs: DataFrame, idf: Idf, key: str, text: str) -> DataFrame:
    """node, content (md5 of the text), bands (array of BANDS longs; null for a text without words), of rows with a key."""
    shared = docs.sparkSession.sparkContext.broadcast(idf)  # at most the texts' mean number of shingles / RARE
    x = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("node"), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("content"), F.col(text).cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            bands: list[np.ndarray | None] = []
            for _, _, part, off in B.parts(batch.column(2)):
                for s, n in counted(part, off):
                    if len(s):
                        own = samples(s, weights_of(s, n, table)).reshape(BANDS, ROWS)
                        mixed = np.arange(1, BANDS + 1).astype(U)
                        for k in range(ROWS):
                            mixed = B.mix(mixed * B.BASE + own[:, k])
                        bands.append(mixed.astype(np.int64))
                    else:
                        bands.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bands, pa.list_(pa.int64()))], names=["node", "content", "bands"])

    return x.mapInArrow(B.releasing(run), "node long, content string, bands array<bigint>")


def shingle_sets(docs: DataFrame, nodes: DataFrame, key: str, text: str) -> DataFrame:
    """node, raw: the packed shingles of the texts whose key is among `nodes`: sorted distinct hashes, then 4-byte counts."""
    x = docs.select(F.col(key).cast("long").alias("node"), F.col(text).cast("string").alias("__text"))
    x = x.join(short_list(nodes), "node", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, part, off in B.parts(batch.column(1)):
                raw = [s.tobytes() + n.astype(np.uint32).tobytes() for s, n in counted(part, off)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(raw, pa.binary())], names=["node", "raw"])

    return x.mapInArrow(B.releasing(run), "node long, raw binary")


def unpacked(raw: pa.Scalar, table: Idf) -> tuple[np.ndarray, np.ndarray]:
    """Shingles and weights of a packed text."""
    buffer = raw.as_buffer()
    n = buffer.size // 12
    s = np.frombuffer(buffer, U, n)
    return s, weights_of(s, np.frombuffer(buffer, np.uint32, n, 8 * n), table)


def verified(pairs: DataFrame, sets: DataFrame, idf: Idf, threshold: float) -> DataFrame:
    """Of pairs (a, b) those whose weighted Jaccard similarity is at least `threshold`, with it: a, b, similarity."""
    shared = pairs.sparkSession.sparkContext.broadcast(idf)
    # a node that very many are compared with is a hot key, and its shingles are wide: dealt over salts
    hot_a, hot_b = hot_keys(pairs, "a"), hot_keys(pairs, "b")
    x = dealt(dealt(pairs, hot_a, "a", "salt_a"), hot_b, "b", "salt_b")
    x = x.join(repeated(sets.select(F.col("node").alias("b"), F.col("raw").alias("raw_b")), hot_b, "b", "salt_b"), ["b", "salt_b"])
    x = x.join(repeated(sets.select(F.col("node").alias("a"), F.col("raw").alias("raw_a")), hot_a, "a", "salt_a"), ["a", "salt_a"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for i, (ra, rb) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                (sa, wa), (sb, wb) = unpacked(ra, table), unpacked(rb, table)
                at = np.minimum(np.searchsorted(sb, sa), len(sb) - 1)
                same = sb[at] == sa
                common = float(np.minimum(wa[same], wb[at[same]]).sum(dtype=np.float64))
                out[i] = common / (float(wa.sum(dtype=np.float64)) + float(wb.sum(dtype=np.float64)) - common)
            ok = pa.array(out >= threshold - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out)], names=["a", "b", "similarity"]).filter(ok)

    links = x.select("a", "b", "raw_a", "raw_b").mapInArrow(B.releasing(run), "a long, b long, similarity double")
    return links.groupBy("a", "b").agg(F.max("similarity").alias("similarity"))  # once, also where a key's row is repeated


def candidate_buckets(reps: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """bucket, node, rank, and the hot buckets: the buckets that hold at least two distinct texts, over all bands.

    rank is the sum of the sizes of a node's buckets: of a text and its edited copies the text itself is most often where most
    of them are.
    """
    x = reps.where(F.col("bands").isNotNull()).select(F.col("node"), F.explode("bands").alias("bucket"))
    sizes = written(x.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "near-sizes")
    hot = hot_among(sizes, "bucket", "size")
    x = written(join_split(x, sizes, "bucket", hot=hot), "near-shared")
    ranks = x.groupBy("node").agg(F.sum("size").alias("rank"))
    return x.join(ranks, "node").select("bucket", "node", "rank"), hot


def head_pairs(buckets: DataFrame, hot: DataFrame | None) -> DataFrame:
    """Pairs (a < b) of the node of highest rank in each bucket with all others of the bucket."""
    heads = buckets.groupBy("bucket").agg(F.max(F.struct("rank", (-F.col("node")).alias("head"))).alias("h")).select("bucket", (-F.col("h.head")).alias("head"))
    x = join_split(buckets, written(heads, "near-heads"), "bucket", hot=hot).where("node <> head")
    return x.select(F.least("head", "node").alias("a"), F.greatest("head", "node").alias("b")).distinct()


def mixed_buckets(buckets: DataFrame, labels: DataFrame, hot: DataFrame | None) -> DataFrame:
    """bucket, node, label, most (the bucket's largest class), of the buckets that hold several classes."""
    placed = buckets.join(labels, "node", "left").select("bucket", "node", F.coalesce("label", "node").alias("label"))
    sizes = placed.groupBy("bucket", "label").agg(F.count("*").alias("size"))
    mixed = sizes.groupBy("bucket").agg(F.max(F.struct("size", "label")).alias("most"), F.count("*").alias("kinds")).where("kinds > 1")
    most = written(mixed.select("bucket", F.col("most.label").alias("most")), "near-most")
    return written(join_split(placed, most, "bucket", hot=hot), "near-mixed")


def profiles(sets: DataFrame, nodes: DataFrame, idf: Idf) -> DataFrame:
    """node, w, c: of the given nodes the weight of all shingles, and of those that at least two of the nodes hold."""
    shared = sets.sparkSession.sparkContext.broadcast(idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, raw in zip(batch.column(0), batch.column(1), strict=True):
                s, w = unpacked(raw, shared.value)
                yield pa.RecordBatch.from_arrays([pa.array(s.astype(np.int64)), pa.array(np.full(len(s), node.as_py())), pa.array(w)], names=["shingle", "node", "w"])

    x = sets.join(nodes, "node", "left_semi").mapInArrow(B.releasing(run), "shingle long, node long, w float")
    single = x.groupBy("shingle").agg(F.count("*").alias("n"), F.min("node").alias("node"), F.min("w").alias("w")).where("n = 1")
    single = single.groupBy("node").agg(F.sum("w").alias("alone"))
    total = total_weights(sets.join(nodes, "node", "left_semi"), idf)
    return total.join(single, "node", "left").select("node", "w", (F.col("w") - F.coalesce("alone", F.lit(0.0))).alias("c"))


def total_weights(sets: DataFrame, idf: Idf) -> DataFrame:
    shared = sets.sparkSession.sparkContext.broadcast(idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([float(unpacked(r, shared.value)[1].sum(dtype=np.float64)) for r in batch.column(1)], pa.float64())], names=["node", "w"])

    return sets.mapInArrow(B.releasing(run), "node long, w double").dropDuplicates(["node"])


def rest_pairs(buckets: DataFrame, labels: DataFrame, sets: DataFrame, idf: Idf, t: float, hot: DataFrame | None) -> DataFrame:
    """All pairs (a < b) of different classes that share a bucket and can be similar to t: nodes outside a bucket's largest class
    with all others of the bucket.

    What two texts share weighs at most c, the weight of shingles that any other node has too: shared <= min(c_x, c_y), and
    similarity = shared / (w_x + w_y - shared). So w_y lies between t w_x and c_x (1 + t) / t - w_x; weights are joined by
    slots of their logarithm, and pairs beyond the bound are never made. Copies with edits of their own fail it at once.
    """
    placed = mixed_buckets(buckets, labels, hot)
    weights = written(profiles(sets, placed.select("node").distinct(), idf), "near-weights")
    own = placed.groupBy("node").agg(F.collect_list("bucket").alias("all"))  # at most one bucket a band
    placed = placed.join(weights, "node").join(own, "node")
    slot = lambda w: F.floor(F.log(w) / 0.02).cast("int")
    low, high = F.col("w") * (t - 1e-4), F.col("c") * (1 + t) / t - F.col("w") * (1 - 1e-4)
    outside = placed.where("label <> most").where(high >= low)
    outside = outside.select("bucket", F.col("node").alias("x"), F.col("label").alias("x_label"), F.col("w").alias("x_w"), F.col("c").alias("x_c"), F.col("all").alias("x_all"), F.explode(F.sequence(slot(low), slot(high))).alias("slot"))
    both = F.least("x_c", "c") + F.col("w") * 1e-4
    can = (F.col("x_label") != F.col("label")) & (both >= t * (F.col("x_w") + F.col("w") - both))
    others = placed.select("bucket", slot(F.col("w")).alias("slot"), "node", "label", "w", "c", "all")
    once = outside.bucket == F.array_min(F.array_intersect("x_all", "all"))  # of the buckets that a pair shares only the least makes it
    x = outside.join(others, (outside.bucket == others.bucket) & (outside.slot == others.slot) & can & once)
    return x.select(F.least("x", "node").alias("a"), F.greatest("x", "node").alias("b")).distinct()


def near_classes(docs: DataFrame, threshold: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, class_id (the least key of its class), class_size (distinct keys), n_links.

    n_links counts the verified links of the row's text with other texts, a lower bound within classes found through buckets.
    Equal texts are of one class at once and only one of them is compared; classes are the components of links of weighted
    Jaccard similarity >= threshold on runs of five words (lower-cased runs of letters, digits and non-ASCII characters; a
    shorter text is one run). Texts without words, null and empty ones are classes of their own. Rows that repeat a key are
    one document; a null key gives a null class. Other columns are not read; an empty table gives an empty result.
    """
    slim = docs.select(F.col(key).cast("long").alias("__key"), F.col(text).cast("string").alias("__text"))
    idf = frequencies(slim, "__text", rare=RARE)
    signed = written(band_keys(slim, idf, "__key", "__text"), "near-bands")
    contents = signed.where(F.col("bands").isNotNull()).groupBy("content").agg(F.min("node").alias("node"))
    reps = written(signed.join(contents, ["content", "node"], "left_semi").dropDuplicates(["content"]), "near-reps")
    buckets, hot = candidate_buckets(reps)
    buckets = written(buckets, "near-buckets")
    nodes = buckets.select("node").distinct()
    sets = written(shingle_sets(slim, nodes, "__key", "__text"), "near-sets")
    pairs = written(head_pairs(buckets, hot), "near-pairs")
    links = written(verified(pairs, sets, idf, threshold), "near-links")
    labels = components(links)
    rest = written(rest_pairs(buckets, labels, sets, idf, threshold, hot).join(pairs, ["a", "b"], "left_anti"), "near-rest")
    links = links.unionByName(written(verified(rest, sets, idf, threshold), "near-more"))
    labels = components(links)
    degree = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("n_links"))
    by_content = contents.join(labels, "node", "left").join(degree, "node", "left").select("content", F.coalesce("label", "node").alias("label"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    # keys, each with the label of its text, where very many may share one; a repeated key with several texts joins their classes
    keyed = join_split(signed.select("node", "content"), written(by_content, "near-contents"), "content", "left").select("node", F.coalesce("label", "node").alias("label"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    keyed = keyed.groupBy("node").agg(F.min("label").alias("label"), F.max("label").alias("other"), F.max("n_links").alias("n_links"))
    keyed = written(keyed, "near-keyed")
    crossing = keyed.where("label <> other").select(F.col("label").alias("a"), F.col("other").alias("b"))
    if crossing.limit(1).count():
        merged = components(crossing).toDF("label", "merged")
        keyed = join_split(keyed, merged, "label", "left").select("node", F.coalesce("merged", "label").alias("label"), "n_links")
    ids = keyed.groupBy("label").agg(F.min("node").alias("class_id"), F.count("*").alias("class_size"))
    final = join_split(keyed, written(ids, "near-ids"), "label").select("node", "class_id", "class_size", "n_links")
    return slim.select(F.col("__key").alias("node")).join(final, "node", "left").select(F.col("node").alias(key), "class_id", "class_size", F.col("n_links").cast("long").alias("n_links"))


def without_copies(docs: DataFrame, threshold: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` whose key is the least of its class, unchanged; rows with a null key stay."""
    classes = near_classes(docs, threshold, key, text)
    gone = written(classes.where(F.col(key) != F.col("class_id")).select(F.col(key).alias("__gone")).distinct(), "near-gone")
    return docs.join(short_list(gone), docs[key] == F.col("__gone"), "left_anti")
