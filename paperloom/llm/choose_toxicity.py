"""Chooses the toxicity model's constants on rows that may be learned from, and on no others.

    python -m paperloom.llm.choose_toxicity /root/testdata/sf0.1

Held-out rows (crc32 of the key modulo 3 is 1) are dropped from labels and documents before anything is computed. Of the rest, each
of the remainders 0 and 2 is taught once and the other judged; the figure of a setting is the mean over both of the average precision
of the ranking, which needs no threshold. One constant after another is tried at the values below, the others being the best so far.
"""

from __future__ import annotations

import json
import sys

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import toxicity
from paperloom.llm._store import release, table, written
from paperloom.llm.langid import held_out

TRIED = {"MARGIN": (1.0, 2.0, 3.0), "STEADY": (100, 300, 900), "PRIOR": (10.0, 40.0, 160.0)}


def average_precision(score: np.ndarray, label: np.ndarray) -> float:
    """Mean of the precision at each positive, ranked by score; ties share the precision at their end."""
    order = np.argsort(-score, kind="stable")
    score, label = score[order], label[order]
    ends = np.append(np.flatnonzero(np.diff(score)), len(score) - 1)
    hits = np.cumsum(label)[ends]
    return float((np.diff(hits, prepend=0) * hits / (ends + 1)).sum() / max(1, label.sum()))


def figure(docs: DataFrame, labels: DataFrame) -> float:
    """The mean over both folds; `docs` and `labels` hold no held-out row."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    got = []
    for taught, judged in ((0, 2), (2, 0)):
        scored = toxicity.detect(docs, labels.where(fold == taught)).join(labels.where(fold == judged).select("doc_id", "toxic"), "doc_id").select("score", "toxic").toPandas()
        got.append(average_precision(scored["score"].to_numpy(), scored["toxic"].to_numpy()))
    return sum(got) / len(got)


def choose(docs: DataFrame, labels: DataFrame, tried: dict[str, tuple] = TRIED) -> tuple[dict[str, float], list[dict]]:
    """The best setting, and every setting tried with its figure. The module's own constants are as before afterwards."""
    labels = written(labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull()), "tox-choice-labels")
    docs = written(docs.select("doc_id", "text").join(labels.select("doc_id").distinct(), "doc_id", "left_semi"), "tox-choice-docs")
    before = {k: getattr(toxicity, k) for k in tried}
    best, log = dict(before), []
    try:
        known: dict[tuple, float] = {}
        for name, values in tried.items():
            for value in dict.fromkeys((best[name], *values)):
                setting = best | {name: value}
                key = tuple(setting.values())
                if key not in known:
                    for k, v in setting.items():
                        setattr(toxicity, k, v)
                    known[key] = figure(docs, labels)
                    log.append(setting | {"average_precision": round(known[key], 4)})
            best[name] = max(dict.fromkeys((best[name], *values)), key=lambda v: known[tuple((best | {name: v}).values())])  # noqa: B023
    finally:
        for k, v in before.items():
            setattr(toxicity, k, v)
    return best, log


def main() -> None:
    spark = SparkSession.builder.master("local[*]").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", "8").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    best, log = choose(table(spark, sys.argv[1], "documents"), table(spark, sys.argv[1], "labels"))
    for row in log:
        print(json.dumps(row))
    print(json.dumps({"best": best}))
    release(spark)


if __name__ == "__main__":
    main()
