"""Mixing sources to target weights by Pareto order sampling.

Each source's target is a share of all words by weight, stopped at `cap` times the source's size, the excess reshared by weight
(water-filling). Of target/size copies, the whole ones are certain for every document; the remaining fraction is a sample
without replacement: documents are ranked by random odds divided by inclusion odds, (U/(1-U)) / (p/(1-p)), and taken in that
order until the words reach the rest of the target. Inclusion probabilities p are unequal: proportional to the square root of
the size, at most 1, scaled so that the expected words equal the rest.

No source is ever gathered or sorted in one task: ranks are turned into an even key, words are summed per source over a fixed
grid of keys, and only the documents of the one grid cell in which a source's quota ends are ordered exactly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm._store import written

SIZE_PATTERN = r"[^\x20\x09-\x0D]+"
CLASSES = 8  # size classes per doubling
CELLS = 4096


def words_in(text: Column) -> Column:
    """Maximal runs of characters other than ASCII white space; null has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(SIZE_PATTERN)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float], cap: float) -> DataFrame:
    """From (source, source_size): target. Sources by code point, null last, take the weights in turn, repeating.

    The level t solves sum(min(cap * size, t * weight)) = sum(size): sources in order of cap * size / weight reach their cap
    one after another, which is where resharing the excess again and again by weight ends. One row a source.
    """
    by_source = Window.orderBy(F.col("source").isNull(), F.col("source"))
    by_level = Window.orderBy(F.col("full"), F.col("source").isNull(), F.col("source"))
    everything = Window.partitionBy()
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by_source) - 1) % len(weights) + 1).cast("int"))
    x = sizes.withColumn("w", w).withColumn("limit", F.lit(float(cap)) * F.col("source_size"))
    x = x.withColumn("full", F.col("limit") / F.col("w"))
    x = x.withColumns({
        "before": F.sum("limit").over(by_level.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("limit"),
        "open": F.sum("w").over(everything) - F.sum("w").over(by_level.rowsBetween(Window.unboundedPreceding, Window.currentRow)) + F.col("w"),
        "total": F.sum("source_size").over(everything).cast("double"),
    })
    x = x.withColumn("level", (F.col("total") - F.col("before")) / F.col("open"))
    t = F.max(F.when(F.col("level") <= F.col("full"), F.col("level"))).over(everything)
    return x.select("source", "source_size", F.least(F.col("limit"), F.coalesce(t, F.lit(float("inf"))) * F.col("w")).alias("target"))


def uniform(key: Column, seed: int) -> Column:
    """In (0, 1), a function of key and seed only."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")))), 1, 12), 16, 10).cast("double")
    return (bits + 0.5) / float(1 << 48)


def mix(docs: DataFrame, weights: Sequence[float], cap: float = 3.0, seed: int = 7, key: str = "doc_id", source: str = "source", text: str = "text", carry: bool = False) -> DataFrame:
    """One row per input row: key, source, size, source_size, target (of its source), copies, taken (= copies * size).

    With `carry` also __row, the input row as a struct; it goes through joins with one row a source only.

    size is the number of words of the whole text (null: 0). A row's copies depend on its key, text and source only, never on
    partitions, so reruns agree; rows that repeat a key and size tie and are ordered by a hash of the text. Null sources form
    one source. Rows of size 0 are taken with the certain copies and never in the sample. No row has more than ceil(cap)
    copies, and none more than floor(target / source_size) + 1. An empty table gives an empty result.
    """
    whole_row = [F.struct(*[F.col(c) for c in docs.columns]).alias("__row")] if carry else []
    slim = [F.col(key).alias("__key"), F.col(source).cast("string").alias("source"), words_in(F.col(text)).alias("size"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("__h")]
    sized = written(docs.select(*slim), "mix-sizes")
    klass = F.when(F.col("size") > 0, F.floor(F.log2("size") * CLASSES)).otherwise(-1).cast("int")
    classes = sized.groupBy("source", klass.alias("klass")).agg(F.sum("size").alias("words"), F.count("*").alias("n"))
    sources = targets(classes.groupBy("source").agg(F.sum("words").alias("source_size")), weights, cap)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(0).cast("long")
    plan = sources.withColumn("whole", whole).withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size")))
    # p = min(1, c * sqrt(size)): c so that the expected words over the size classes equal the rest; classes are filled from the largest size down
    r = F.pow(F.lit(2.0), (F.col("klass") + 0.5) / CLASSES / 2)  # square root of the class's middle size
    down = Window.partitionBy("source").orderBy(F.desc("klass")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    c = classes.where("klass >= 0").withColumn("r", r).withColumn("sized", F.col("words") * F.col("r"))
    c = c.withColumn("full", F.sum("words").over(down) - F.col("words")).withColumn("open", F.sum("sized").over(Window.partitionBy("source")) - F.sum("sized").over(down) + F.col("sized"))
    c = c.join(plan.select(F.col("source").alias("s"), "rest"), F.col("source").eqNullSafe(F.col("s"))).withColumn("c", (F.col("rest") - F.col("full")) / F.col("open"))
    scale = c.where(F.col("c") * F.col("r") <= 1).groupBy("source").agg(F.max("c").alias("scale"))
    plan = plan.join(scale.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    plan = written(plan.withColumn("scale", F.coalesce("scale", F.lit(float("inf")))), "mix-plan")

    def planned(rows: DataFrame, table: DataFrame) -> DataFrame:
        # null-safe equality on a key that is never null, so that the join can be split where a source is hot
        named = lambda: F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
        return rows.withColumn("__s", named()).join(table.withColumn("__s", named()).drop("source"), "__s").drop("__s")

    p = F.least(F.lit(0.999999), F.greatest(F.lit(1e-9), F.col("scale") * F.sqrt("size")))
    u = uniform(F.col("__key"), seed)
    odds = F.log(u / (1 - u)) - F.log(p / (1 - p))
    even = 1 / (1 + F.exp(-odds))  # the rank as a key in (0, 1), in the same order
    def ranks(rows: DataFrame) -> DataFrame:
        x = planned(rows, plan).withColumn("__q", even).withColumn("__cell", F.least(F.lit(CELLS - 1), F.floor(F.col("__q") * CELLS)).cast("int"))
        return x.withColumn("__may", (F.col("size") > 0) & (F.col("rest") > 0))

    ranked = ranks(sized)
    cells = ranked.where("__may").groupBy("source", "__cell").agg(F.sum("size").alias("words"), F.max("rest").alias("rest"))
    upto = Window.partitionBy("source").orderBy("__cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cells = cells.withColumn("upto", F.sum("words").over(upto))
    edge = cells.where(F.col("upto") >= F.col("rest")).groupBy("source").agg(F.min(F.struct("__cell", (F.col("upto") - F.col("words")).alias("before"))).alias("e"))
    edge = written(edge.select("source", F.col("e.__cell").alias("edge"), F.col("e.before").alias("before")), "mix-edge")
    ends = edge.select(F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("__s2"), "edge", "before")

    def marks(rows: DataFrame) -> DataFrame:
        return rows.withColumn("__s2", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))).join(ends, "__s2", "left")

    inside = marks(ranked).where("__may and __cell = edge")
    order = Window.partitionBy("source").orderBy("__q", "__key", "__h").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = inside.select("source", "__q", "__key", "__h", "size", "rest", "before").withColumn("upto", F.col("before") + F.sum("size").over(order))
    # the document in which the quota ends is taken if that comes nearer to it
    inside = inside.where(F.col("upto") - F.col("size") / 2 <= F.col("rest"))
    last = inside.groupBy("source").agg(F.max(F.struct("__q", "__key", "__h")).alias("last"))
    last = written(last.select(F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("__s2"), "last"), "mix-last")
    final = marks(ranks(docs.select(*slim, *whole_row)) if carry else ranked).join(last, "__s2", "left")
    in_edge = F.col("last").isNotNull() & (F.struct("__q", "__key", "__h") <= F.col("last"))
    more = F.col("__may") & F.when(F.col("edge").isNull(), True).when(F.col("__cell") < F.col("edge"), True).when(F.col("__cell") == F.col("edge"), in_edge).otherwise(False)
    copies = (F.col("whole") + F.when(more, 1).otherwise(0)).cast("long")
    return final.select(F.col("__key").alias(key), "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), *(["__row"] if carry else []))


def mixture(docs: DataFrame, weights: Sequence[float], cap: float = 3.0, seed: int = 7, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The mix itself: one row per copy that it takes, with the columns of `docs` and size, source_size, target, copies, copy.

    copy counts from 1 to copies; rows that the mix leaves out are not there. Columns of `docs` under those five names are
    replaced. Nulls, repeated rows and empty tables are as in mix().
    """
    added = ("size", "source_size", "target", "copies", "copy")
    x = mix(docs, weights, cap, seed, key, source, text, carry=True).where("copies > 0")
    x = x.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return x.select(*[F.col("__row")[c].alias(c) for c in docs.columns if c not in added], *added)
