"""Filter interaction audit by a mask histogram.

Each document gets a mask of five bits, one per filter that it fails, from native expressions over its whole text; a groupBy of
texts gives the least doc_id, which tells later copies. A part's documents are then counted by mask: 32 cells, from which every
order of the filters follows without another look at the documents. Nothing but the cells' sums is shuffled by part.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm._store import written
from paperloom.llm.components import hot_among, join_split

FILTERS = "ABCDE"
SPACE = r"[\x20\x09-\x0D]+"
MIN_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 50, 65, 5
SYMBOLS = "[#$%&*|]"


def text_mask(text: Column) -> Column:
    """Bits 0 to 3: the text fails A (few words), B (repeated words), C (capitals), D (symbols)."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    repeats = 100 * F.size(F.array_distinct(words)).cast("long") < DISTINCT_PERCENT * F.size(words).cast("long")
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    shouts = 100 * capitals.cast("long") > CAPITAL_PERCENT * F.length(text).cast("long")
    bits = [F.size(words) < MIN_WORDS, repeats, shouts, text.rlike(SYMBOLS)]
    return sum((F.when(b, 1 << i).otherwise(0) for i, b in enumerate(bits)), F.lit(0))


def masks(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """One row per input row: id, part, mask (bit i is set if filter i of FILTERS fails), good, toxic.

    Bit 4 (E) is set where a smaller key has the same text anywhere in the table. A null text is empty, a null part is the empty
    string. Rows with a null key fail E never and are nobody's earlier copy. good and toxic say whether any row of `labels` with
    the key says so; keys without labels have neither.
    """
    x = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    x = written(x.select("id", "part", text_mask(F.col("text")).alias("mask"), F.unhex(F.sha2("text", 256)).alias("same")), "audit-masks")
    copies = written(x.where("id IS NOT NULL").groupBy("same").agg(F.min("id").alias("least"), F.count("*").alias("n")).where("n > 1"), "audit-copies")
    x = join_split(x, copies.select("same", "least"), "same", "left", hot=hot_among(copies, "same", "n"))
    late = F.coalesce(F.col("id") > F.col("least"), F.lit(False))
    x = x.select("id", "part", (F.col("mask") + F.when(late, 16).otherwise(0)).alias("mask"))
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    marks = marks.where("good = 1 OR toxic = 1")
    yes = lambda c: F.coalesce(F.col(c) == 1, F.lit(False)).alias(c)
    return x.join(marks, "id", "left").select("id", "part", "mask", yes("good"), yes("toxic"))


def histogram(masked: DataFrame) -> DataFrame:
    """part, cells: an array of structs (mask, n, good, toxic), one for each mask that stands in the part, 32 at most."""
    count = lambda c: F.count(F.when(F.col(c), 1)).alias(c)
    cells = masked.groupBy("part", "mask").agg(F.count("*").alias("n"), count("good"), count("toxic"))
    return cells.groupBy("part").agg(F.collect_list(F.struct(F.col("mask").cast("int").alias("mask"), "n", "good", "toxic")).alias("cells"))


def interactions(cells: DataFrame) -> DataFrame:
    """From histogram(): one row per part, order of the filters and step, each made from the part's cells alone."""
    masks_of = {f: 1 << i for i, f in enumerate(FILTERS)}
    steps = [(order, k + 1, masks_of[f], sum(masks_of[g] for g in order[:k])) for order in permutations(FILTERS) for k, f in enumerate(order)]
    steps = ", ".join(f"('{''.join(order)}', {step}, {own}, {before})" for order, step, own, before in steps)
    x = cells.selectExpr("part", "cells", f"inline(array({steps})) AS (filter_order, step, own, before)")

    def total(field: str, holds) -> Column:
        return F.aggregate("cells", F.lit(0).cast("long"), lambda s, c: s + F.when(holds(c["mask"]), c[field]).otherwise(F.lit(0)))

    fails = lambda m: m.bitwiseAND(F.col("own")) != 0
    gone = lambda m: m.bitwiseAND(F.col("before")) != 0
    # of a document that fails j filters, each of them is the first one in 120 / j orders
    shares = F.aggregate("cells", F.lit(0).cast("long"), lambda s, c: s + F.when(fails(c["mask"]), (c["n"] * 120 / F.bit_count(c["mask"])).cast("long")).otherwise(F.lit(0)))
    removed = lambda m: fails(m) & ~gone(m)
    return x.select(
        "part", "filter_order", F.col("step").cast("int").alias("step"),
        total("n", lambda m: ~fails(m) & ~gone(m)).alias("kept"), total("n", removed).alias("removed"), total("n", lambda m: fails(m) & gone(m)).alias("redundant"),
        total("n", lambda m: m == F.col("own")).alias("unique_fails"), total("good", removed).alias("good_lost"), total("toxic", removed).alias("toxic_lost"), shares.alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """Rows per part, filter_order (all 120) and step (1 to 5): kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Odd rows are treated as masks() says; repeated rows count each, and a row that repeats key and text is no later copy. An empty
    table has no parts and so gives no rows. Further columns, whatever their names, are not read.
    """
    return interactions(histogram(masks(docs, labels, key, text, part)))
