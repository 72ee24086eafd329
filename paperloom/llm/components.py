"""Connected components of a link table, by rounds of least labels and pointer jumping on tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm._store import written

LONGS_TO_BROADCAST = 2_000_000
HOT_KEYS = 10_000
HOT_ROWS = 1000


def short_list(longs: DataFrame) -> DataFrame:
    """A table of one column of longs, marked to be broadcast if it has at most LONGS_TO_BROADCAST rows, else to be joined by shuffle."""
    return F.broadcast(longs) if longs.count() <= LONGS_TO_BROADCAST else longs.hint("merge")


def hot_keys(rows: DataFrame, key: str) -> DataFrame | None:
    """key, salts: the keys that hold at least HOT_ROWS rows and one of HOT_KEYS equal shares of all, so at most HOT_KEYS; salts is
    how many times that least number each holds, rounded up. None if there are none."""
    least = max(HOT_ROWS, -(-rows.count() // HOT_KEYS))
    hot = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("__n")).where(F.col("__n") >= least)
    hot = written(hot.select(key, F.ceil(F.col("__n") / least).cast("int").alias("salts")), "hot-keys")
    return None if hot.isEmpty() else hot


def hot_among(sizes: DataFrame, key: str, size: str) -> DataFrame | None:
    """As hot_keys(), from a table that has the number of rows of each key already."""
    total = sizes.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    least = max(HOT_ROWS, -(-total // HOT_KEYS))
    hot = written(sizes.where(F.col(size) >= least).select(key, F.ceil(F.col(size) / least).cast("int").alias("salts")), "hot-keys")
    return None if hot.isEmpty() else hot


def join_split(rows: DataFrame, table: DataFrame, key: str, how: str = "inner", hot: DataFrame | None | bool = True) -> DataFrame:
    """rows join table on `key`, which may be hot in `rows` and stands about once in `table`; how is inner or left. `hot` is what
    hot_keys() or hot_among() gave, if that is known.

    The rows of `table` with hot keys are broadcast, at most HOT_KEYS, which must be narrow; so hot rows never meet in one task.
    All other keys are joined as Spark sees fit.
    """
    hot = hot_keys(rows, key) if hot is True else hot
    if hot is None:
        return rows.join(table, key, how)
    keys = F.broadcast(hot.select(key))
    few = F.broadcast(table.join(keys, key, "left_semi"))
    return rows.join(keys, key, "left_semi").join(few, key, how).unionByName(rows.join(keys, key, "left_anti").join(table, key, how))


def dealt(rows: DataFrame, hot: DataFrame | None, key: str, salt: str) -> DataFrame:
    """Adds `salt`: rows of a hot key are dealt over its salts by a hash of the row, all others have 0."""
    if hot is None:
        return rows.withColumn(salt, F.lit(0))
    x = rows.join(F.broadcast(hot), key, "left")
    return x.withColumn(salt, F.coalesce(F.pmod(F.xxhash64(*rows.columns), F.col("salts")), F.lit(0)).cast("int")).drop("salts")


def repeated(table: DataFrame, hot: DataFrame | None, key: str, salt: str) -> DataFrame:
    """The other side of dealt(): rows of a hot key once for each of its salts, wide as they may be."""
    if hot is None:
        return table.withColumn(salt, F.lit(0))
    return table.join(F.broadcast(hot), key, "left").withColumn(salt, F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")


def components(links: DataFrame) -> DataFrame:
    """From links (a long, b long): node, label (the least node of its component), one row per linked node.

    Each round every node takes the least label of its neighbours and then the label of its label; rounds end when none
    changes, so chains need as many rounds as the logarithm of their length. Only the number of changes comes to the driver.
    Nodes with very many neighbours and labels of very many nodes are hot keys, joined as such.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = written(both, "cc-links")
    now = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), "cc-labels")
    while True:
        near = join_split(both, now.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        step = now.join(near, now.node == near.a).select("node", "label", F.least("label", "near").alias("next"))
        step = written(step, "cc-step")
        up = step.select(F.col("node").alias("next"), F.col("next").alias("jump"))
        step = written(join_split(step, up, "next", "left").select("node", "label", F.least("next", F.coalesce("jump", "next")).alias("next")), "cc-jump")
        changed = step.where("next <> label").limit(1).count()
        now = step.select("node", F.col("next").alias("label"))
        if not changed:
            return now
