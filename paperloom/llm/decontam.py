"""Benchmark decontamination: size-partitioned MinHash containment search, in DataFrame functions only.

Test items are short and documents long, so their Jaccard similarity is small even where a document holds the whole item. Items
are partitioned by size (doubling classes), and an item of the class up to m shingles is compared with windows of 2m shingles, m
apart: a copied item lies whole in one window, and its Jaccard similarity with that window is at least a known bound, from which
each class gets its number of MinHash functions (recall of 1 - 1e-6 at the threshold).

1. An item's signature is its minimal shingle under each function h XOR seed. These minima, and no other shingles, are the probes:
   a pass over the documents keeps the places where a probe stands (document, place, shingle; nothing wider).
2. A window has an item's minimum exactly if it holds that shingle and none smaller under the function; so signatures of windows
   need not be computed where no probe stands. Documents with a probe come once more, with all their places in one row, and
   each place is tested in the two windows that hold it. A collision under one function makes the item a candidate.
3. Candidates are verified by exact containment: the item's shingles are joined with those of the document.

What is wide (the shingles of a document) stands in one row a document and only for documents with a probe; no row is made for
each pair of a document and an item that merely share a phrase. Items may be spread over a document only as far as its windows
reach: an item whose parts lie further apart than 2m shingles is not looked for.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm._store import written
from paperloom.llm.components import short_list

WORDS = 5
MISS = 1e-6
NOT_WORD = r"[^\p{L}\p{N}]+"


def let(value: Column, body) -> Column:
    """body(value) with the value computed once; written out, the optimiser would compute it anew in every lambda call."""
    return F.get(F.transform(F.array(value), body), 0)


def shingles(text: Column, width: int = WORDS) -> Column:
    """64-bit hashes of all runs of `width` words (lower-cased runs of letters and digits), in order; empty for a shorter text."""
    words = F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD, " ")), " ")

    def runs(codes: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(codes) - width, F.lit(0)))
        got = F.transform(starts, lambda i: F.xxhash64(*[F.get(codes, i + k) for k in range(width)]))
        return F.when(F.size(codes) >= width, got).otherwise(F.array().cast("array<bigint>"))

    return let(F.transform(words, lambda w: F.xxhash64(w)), runs)


def functions_needed(largest: int, threshold: float) -> int:
    """MinHash functions for items of largest/2 < n <= largest shingles: an item that a window holds to `threshold` has at least
    Jaccard t*n / (2*largest + n - t*n) with it, and is missed by all functions with probability under MISS."""
    n = largest // 2 + 1
    j = threshold * n / (2 * largest + n - threshold * n)
    return math.ceil(math.log(MISS) / math.log(1 - j))


def seeds(k: int) -> list[int]:
    """k fixed 64-bit masks."""
    out, x = [], 0x243F6A8885A308D3
    for _ in range(k):
        x = (x * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        y = x ^ (x >> 33)
        out.append(y - (1 << 64) if y >= 1 << 63 else y)
    return out


def item_sets(items: DataFrame, key: str, text: str) -> DataFrame:
    """i (a number of its own), item, set (distinct shingles), n, m (the size class), one row per distinct item with shingles."""
    x = items.select(F.col(key).alias("item"), F.array_distinct(shingles(F.col(text))).alias("set")).withColumn("n", F.size("set")).where("n > 0")
    x = x.withColumn("m", F.pow(F.lit(2.0), F.ceil(F.log2("n"))).cast("int"))
    return written(x.distinct().withColumn("i", F.monotonically_increasing_id()), "decontam-items")


def item_minima(sets: DataFrame, threshold: float) -> DataFrame:
    """i, m, s (mask of a function of the class), h: the item's minimal shingle under the function."""
    classes = sorted(r[0] for r in sets.select("m").distinct().collect())  # at most 31 size classes
    masks: Column | None = None
    for m in classes:
        own = F.array(*[F.lit(s) for s in seeds(functions_needed(m, threshold))])
        masks = F.when(F.col("m") == m, own) if masks is None else masks.when(F.col("m") == m, own)
    if masks is None:
        masks = F.array().cast("array<bigint>")
    least = F.transform(masks, lambda s: F.struct(s.alias("s"), F.array_min(F.transform("set", lambda h: h.bitwiseXOR(s))).bitwiseXOR(s).alias("h")))
    return written(sets.select("i", "m", F.explode(least).alias("x")).select("i", "m", "x.s", "x.h"), "decontam-minima")


def among(rows: DataFrame, column: str, longs: DataFrame) -> DataFrame:
    """The rows whose column is one of `longs` (one distinct column)."""
    return rows.join(short_list(longs), F.col(column) == F.col(longs.columns[0]), "left_semi")


def probed(docs: DataFrame, probes: DataFrame) -> DataFrame:
    """doc, t (hash of the text), hits: of each text the places of probes as (at, h, m, masks)."""
    x = docs.select("doc", F.xxhash64("text").alias("t"), F.posexplode(shingles(F.col("text"))).alias("at", "shingle"))
    x = among(x, "shingle", written(probes.select("h").distinct(), "decontam-longs"))
    x = x.join(probes, x.shingle == probes.h).groupBy("doc", "t").agg(F.collect_set(F.struct("at", "h", "m", "masks")).alias("hits"))
    return written(x, "decontam-hits")


def collisions(runs: Column, hits: Column) -> Column:
    """array<struct<h, m, masks>>: of each hit the masks under which one of the two windows around it has h as its minimum."""

    def one(x: Column) -> Column:
        m, h = x["m"], x["h"]
        first = F.greatest(F.lit(0), F.floor(x["at"] / m).cast("int") - 1)
        window = lambda k: F.slice(runs, (first + k) * m + 1, m * 2)
        smallest = lambda w, s: ~F.exists(w, lambda y: y.bitwiseXOR(s) < h.bitwiseXOR(s))
        held = lambda w: F.when(F.array_contains(w, h), F.filter(x["masks"], lambda s: smallest(w, s))).otherwise(F.array().cast("array<bigint>"))
        return F.struct(h.alias("h"), m.alias("m"), F.array_union(let(window(0), held), let(window(1), held)).alias("masks"))

    return F.filter(F.transform(hits, one), lambda c: F.size(c["masks"]) > 0)


def find(docs: DataFrame, items: DataFrame, threshold: float = 0.8, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per (document, item) with containment of at least `threshold`: key, item_key, n_common, n_item, containment.

    containment is the share of the item's distinct shingles of WORDS words that the document holds. Items and documents of
    fewer words, null and empty ones, have no shingles and no rows. Rows that repeat a document key (a null one too) count as
    one document, those that repeat an item key with another text as items of their own, of which the best counts. Texts are
    searched whole; other columns are not read; an empty table on either side gives an empty result.
    """
    sets = item_sets(items, item_key, item_text)
    minima = item_minima(sets, threshold)
    probes = written(minima.groupBy("h", "m").agg(F.collect_set("s").alias("masks")), "decontam-probes")
    slim = docs.select(F.col(key).alias("doc"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    hits = probed(slim, probes)
    # documents with a probe once more: each with its places in one row
    x = among(slim.withColumn("t", F.xxhash64("text")), "t", hits.select(F.col("t").alias("ht")).distinct())  # others need not be shuffled
    x = x.join(hits.select(F.col("doc").alias("d"), F.col("t").alias("ht"), "hits"), F.col("doc").eqNullSafe(F.col("d")) & (F.col("t") == F.col("ht")))
    tested = let(shingles(F.col("text")), lambda runs: F.struct(collisions(runs, F.col("hits")).alias("met"), F.array_distinct(runs).alias("set")))
    met = written(x.select("doc", tested.alias("x")).select("doc", "x.met", "x.set").where(F.size("met") > 0), "decontam-met")
    collided = met.select("doc", F.explode("met").alias("c")).select("doc", "c.h", "c.m", F.explode("c.masks").alias("s")).distinct()
    candidates = written(collided.join(minima, ["h", "m", "s"]).select("doc", "i").distinct(), "decontam-candidates")
    # exact containment: the items' shingles against those that the candidates' documents share with any item
    index = written(sets.select("i", "item", "n", F.explode("set").alias("shingle")), "decontam-index")
    held = among(met.select(F.col("doc").alias("d"), F.explode("set").alias("s")), "s", written(index.select("shingle").distinct(), "decontam-shingles")).distinct()
    wanted = candidates.join(index, "i")
    pairs = wanted.join(held, F.col("doc").eqNullSafe(F.col("d")) & (F.col("shingle") == F.col("s"))).groupBy("doc", "i", "item", "n").agg(F.count("*").alias("n_common"))
    found = pairs.where(F.col("n_common") >= F.lit(threshold) * F.col("n") - 1e-9)
    found = found.groupBy("doc", "item").agg(F.max(F.struct((F.col("n_common") / F.col("n")).alias("c"), "n_common", "n")).alias("b"))
    return found.select(F.col("doc").alias(key), F.col("item").alias(item_key), F.col("b.n_common").cast("long").alias("n_common"), F.col("b.n").cast("long").alias("n_item"), F.col("b.c").alias("containment"))


def without_leaks(docs: DataFrame, items: DataFrame, threshold: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` that hold no item to the threshold, unchanged; rows that repeat a key go or stay together."""
    leaks = written(find(docs, items, threshold, key, text).select(F.col(key).alias("__leak")).distinct(), "decontam-leaks")
    return docs.join(leaks, docs[key].eqNullSafe(F.col("__leak")), "left_anti")
