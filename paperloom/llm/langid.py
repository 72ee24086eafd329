"""Language identification: averaged hashed subword embeddings with a linear softmax, trained by SGD in numpy.

A text's features are the byte n-grams of its lower-cased words, hashed into a fixed table; their embeddings are averaged over
the whole text and a linear softmax gives the language. Probabilities are calibrated by temperature on labelled rows that
training doesn't see, and a prediction is rejected below a threshold found on the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm import _bytes as B

ORDERS = (3, 4)
BITS = 16
DIM = 16
UNKNOWN = "und"
LETTER = np.zeros(256, np.uint8) + 32
LETTER[[*range(97, 123), *range(128, 256)]] = [*range(97, 123), *range(128, 256)]


def held_out(key: Column) -> Column:
    """crc32 of the key as text, modulo 3, is 1; a null key is not held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of all n-grams and the text each belongs to; n-grams that begin with two non-letters or span texts are left out."""
    x = LETTER[data].astype(np.uint32)
    row = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    ids, rows = [], []
    for n in ORDERS:
        m = len(x) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, np.uint32)
        for k in range(n):
            h = h * np.uint32(0x01000193) ^ x[k : k + m]
        h = (h * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
        ok = (row[:m] == row[n - 1 :]) & ~((x[:m] == 32) & (x[1 : m + 1] == 32))
        ids.append(h[ok])
        rows.append(row[:m][ok])
    if not ids:
        return np.zeros(0, np.uint32), np.zeros(0, np.int32)
    return np.concatenate(ids), np.concatenate(rows)


@dataclass
class Model:
    labels: list[str]
    table: np.ndarray  # 2**BITS x labels: each feature's share of the logits, embedding times softmax weights
    bias: np.ndarray
    temperature: float
    threshold: float

    def logits(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Per text the mean of its features' logits, and its number of features."""
        out = np.zeros((len(texts), len(self.labels)))
        count = np.zeros(len(texts), np.int64)
        for a, b, part, off in B.parts(texts):
            ids, rows = features(part, off)
            n = np.bincount(rows, minlength=b - a)
            count[a:b] = n
            for c in range(len(self.labels)):
                out[a:b, c] = np.bincount(rows, weights=self.table[ids, c], minlength=b - a)
        return out / np.maximum(count, 1)[:, None] + self.bias, count


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(rows: list[tuple[str, np.ndarray, np.ndarray]], least_steps: int = 20_000, rate: float = 0.5, seed: int = 1, precision: float = 0.995, floor: float = 0.5, lost: float = 0.005) -> Model:
    """SGD over (label, feature ids, counts) in whole epochs, at least 4 and `least_steps` steps; every fifth row is kept for calibration.

    The rejection threshold is the least confidence at or above which the calibration rows reach `precision`, but not under half
    of `floor` of the way from chance to certainty, and never so high that it rejects more than the share `lost` of the rows
    that are right.
    """
    labels = sorted({r[0] for r in rows})
    rng = np.random.default_rng(seed)
    embed = (rng.random((1 << BITS, DIM)) - 0.5) / DIM
    weights, bias = np.zeros((DIM, len(labels))), np.zeros(len(labels))
    index = {x: i for i, x in enumerate(labels)}
    order = [i for i in range(len(rows)) if i % 5] or list(range(len(rows)))
    seen = np.bincount([index[rows[i][0]] for i in order], minlength=len(labels))
    balance = len(order) / (len(labels) * np.maximum(seen, 1))
    epochs = max(4, -(-least_steps // max(1, len(order))))
    steps, done = epochs * len(order), 0
    for _ in range(epochs):
        for i in rng.permutation(order):
            label, ids, counts = rows[i]
            if not len(ids):
                continue
            share = counts / counts.sum()
            mean = share @ embed[ids]
            z = mean @ weights + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[index[label]] -= 1
            step = rate * (1 - done / steps) * min(4.0, balance[index[label]])
            done += 1
            down = weights @ p
            weights -= step * np.outer(mean, p)
            bias -= 0.1 * step * p
            embed[ids] -= (20 * step) * share[:, None] * down
    table = embed @ weights
    kept = [r for i, r in enumerate(rows) if i % 5 == 0 and len(r[1])] or [r for r in rows if len(r[1])]
    if not kept:
        return Model(labels or [UNKNOWN], np.zeros((1 << BITS, max(1, len(labels)))), np.zeros(max(1, len(labels))), 1.0, 0.0)
    z = np.stack([(c / c.sum()) @ table[i] + bias for _, i, c in kept])
    y = np.array([index[r[0]] for r in kept])
    grid = np.geomspace(0.02, 20, 120)
    slip = 1 / (len(y) + 2)  # a share of errors that rows without one can't rule out

    def loss_at(t: float) -> float:
        logs = np.log(np.maximum(1e-300, softmax(z / t)))
        return float(-((1 - slip) * logs[np.arange(len(y)), y] + slip * logs.mean(axis=1)).mean())

    loss = [loss_at(t) for t in grid]
    temperature = float(grid[int(np.argmin(loss))])
    p = softmax(z / temperature)
    sure, right = p.max(axis=1), p.argmax(axis=1) == y
    by = np.argsort(-sure)
    good = np.cumsum(right[by]) / np.arange(1, len(by) + 1)
    enough = np.flatnonzero(good >= precision)
    chance = 1 / len(labels)
    threshold = max(chance + floor * 0.5 * (1 - chance), float(sure[by[enough[-1]]]) if len(enough) and enough[-1] + 1 < len(by) else 0.0)
    if right.any():
        threshold = min(threshold, float(np.quantile(sure[right], lost, method="lower")))
    return Model(labels, table, bias, temperature, threshold)


def drawn_texts(labelled: DataFrame, per_label: int, seed: int) -> DataFrame:
    """label, h, text: at most `per_label` distinct texts of each label, those of least hash (all, if fewer).

    From rows (label, text). Copies of a text count once, so a text that a third of the rows share is one candidate like any
    other. Hashes far above the place where the cut must fall never leave their task: the share is set from a sketch of the
    number of distinct texts, with a margin, and the exact cut is made on what is left, about twice `per_label` rows a label.
    """
    hashed = labelled.withColumn("h", F.xxhash64(F.lit(seed), F.col("text")))
    distinct = {r[0]: r[1] for r in hashed.groupBy("label").agg(F.approx_count_distinct("h", 0.03)).collect()}  # one row a label
    if not distinct:
        return hashed.select("label", "h", "text").where(F.lit(False))
    share = F.create_map(*[x for k, n in distinct.items() for x in (F.lit(k), F.lit(min(1.0, (2 * per_label + 100) / max(1, n))))])
    near = hashed.where(F.pmod(F.col("h"), F.lit(1 << 30)) / float(1 << 30) <= share[F.col("label")])
    once = near.groupBy("label", "h").agg(F.min("text").alias("text"))
    place = F.row_number().over(Window.partitionBy("label").orderBy(F.pmod(F.col("h"), F.lit(1 << 30)), "h"))
    return once.withColumn("n", place).where(F.col("n") <= per_label).select("label", "h", "text")


def sample(labelled: DataFrame, per_label: int, seed: int) -> DataFrame:
    """label, h, ids (uint16), n (uint32): of each drawn text, whole, its distinct features with counts, at most 2**BITS pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed: list[list[bytes]] = [[], []]
            for a, b, part, off in B.parts(batch.column(2)):
                ids, rows = features(part, off)
                by = np.argsort(rows, kind="stable")
                ids, ends = ids[by], np.searchsorted(rows[by], np.arange(b - a + 1))
                for k in range(b - a):
                    got, n = np.unique(ids[ends[k] : ends[k + 1]], return_counts=True)
                    packed[0].append(got.astype(np.uint16).tobytes())
                    packed[1].append(n.astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, pa.binary()) for x in packed)], names=["label", "h", "ids", "n"])

    return drawn_texts(labelled, per_label, seed).mapInArrow(B.releasing(run), "label string, h long, ids binary, n binary")


MODEL = "labels array<string>, share binary, bias binary, temperature double, threshold double"


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", per_label: int = 1500, seed: int = 1) -> Model:
    """A model from the labelled rows that are not held out; `per_label` bounds the sample: distinct texts of each label.

    The sample (at most 2**BITS pairs of 6 bytes a text) goes to one task, which trains; the driver gets the model only,
    2**BITS rows of one number a label. Null texts and labels teach nothing; without a label every text is `und`.
    """
    labelled = docs.where(~held_out(F.col(key)) & F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(label).cast("string").alias("label"), F.col(text).cast("string").alias("text"))

    def learn(rows: pa.Table) -> pa.Table:
        unpacked = [(la, h, np.frombuffer(i.as_buffer(), np.uint16), np.frombuffer(n.as_buffer(), np.uint32)) for la, h, i, n in zip(rows["label"].to_pylist(), rows["h"].to_pylist(), rows["ids"], rows["n"], strict=True)]
        unpacked.sort(key=lambda r: (r[1], r[0]))  # an order that doesn't depend on partitions
        m = train([(r[0], r[2], r[3]) for r in unpacked], seed=seed)
        columns = [[m.labels], [m.table.astype(np.float64).tobytes()], [np.asarray(m.bias, np.float64).tobytes()], [m.temperature], [m.threshold]]
        types = [pa.list_(pa.string()), pa.binary(), pa.binary(), pa.float64(), pa.float64()]
        return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["labels", "share", "bias", "temperature", "threshold"])

    got = sample(labelled, per_label, seed).groupBy(F.lit(1).alias("all")).applyInArrow(learn, MODEL).toArrow()
    if not got.num_rows:
        return train([])
    labels = got["labels"][0].as_py()
    table = np.frombuffer(got["share"][0].as_buffer(), np.float64).reshape(-1, len(labels))
    return Model(labels, table, np.frombuffer(got["bias"][0].as_buffer(), np.float64), got["temperature"][0].as_py(), got["threshold"][0].as_py())


def predict(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per input row: the columns of `keep`, which may hold the text, lang_pred, score (calibrated probability), rejected.

    lang_pred is a learned label, or `und` with score 0 where the text is null or has no letter; such rows are rejected, as
    are those whose probability is under the model's threshold. Whole texts count; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of a fixed size: 2**BITS rows

    def probabilities(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        names = np.array(m.labels, object)
        try:
            for batch in texts:
                p = softmax(m.logits(batch)[0] / m.temperature)
                yield pa.StructArray.from_arrays([pa.array(names[p.argmax(axis=1)], pa.string()), pa.array(p.max(axis=1), pa.float64())], names=["lang", "score"])
        finally:
            B.give_back()

    # only the text goes to Python, and only a label and a number come back; declared so that no filter has it run twice
    got = F.arrow_udf(probabilities, "struct<lang: string, score: double>").asNondeterministic()(F.coalesce(F.col(text).cast("string"), F.lit("")))
    letter = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    x = docs.select(F.struct(*[F.col(c) for c in keep]).alias("__kept"), letter.alias("__letter"), got.alias("__got"))
    score = F.when(F.col("__letter"), F.col("__got.score")).otherwise(0.0)
    x = x.select("__kept", "__letter", F.when(F.col("__letter"), F.col("__got.lang")).otherwise(UNKNOWN).alias("__lang"), score.alias("__score"))
    rejected = ~F.col("__letter") | (F.col("__score") < model.threshold)
    return x.select(*[F.col("__kept")[c].alias(c) for c in keep], F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"), rejected.alias("rejected"))


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", per_label: int = 1500) -> DataFrame:
    """fit() on the rows that are not held out, predict() on all: key, held_out, lang_pred, score, rejected."""
    model = fit(docs, key, text, label, per_label)
    return predict(docs, model, text, (key,)).withColumn("held_out", held_out(F.col(key))).select(key, "held_out", "lang_pred", "score", "rejected")
