"""Toxicity by class-conditional Kneser-Ney models, compared word by word and normalised by length.

A model gives the probability of each byte of a word (its closing space included) after the bytes before it, back to the word's
opening space and at most ORDER - 1 of them. Counts are of distinct texts' occurrences, at most BURST a text, so neither copies
nor a text that repeats itself weigh more than others. Both classes share one backoff, an interpolated Kneser-Ney model of the
pooled counts: its own top level, and below it, dropping the oldest byte each time, levels that count distinct predecessors; all
discounts are the modified ones, from the counts of counts. A class's probability is its discounted share, and the mass set free,
with PRIOR further counts, goes to the shared model's probability:

    P_c(b | ctx) = (max(n_c(ctx, b) - d_c, 0) + (mass_c(ctx) + PRIOR) P(b | ctx)) / (n_c(ctx) + PRIOR)

so expressions that are rare in a class are smoothed alike in both, and what neither has seen says nothing. The log-ratio of a
word is the sum over its bytes. Ordinary words scatter a little around zero; what a text is judged by are expressions that one
class clearly prefers, so of each word what exceeds MARGIN nats is summed, and divided by the number of words plus STEADY. The score
is a logistic of that, fitted on labelled rows that the counts don't see.

A gram of up to ORDER bytes is packed exactly into one long; counts grow with the corpus. Scoring takes the table of log-ratios,
less those that differ by under PRUNE from what is used where they are missing, in slices of at most SLICE_ROWS rows, each
broadcast in turn, with the words' sums so far carried beside the text; so no worker and no driver holds more than one slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm import _bytes as B
from paperloom.llm._store import written
from paperloom.llm.langid import LETTER, held_out

ORDER = 7
BURST = 8
PRUNE = 0.02
# chosen by choose_toxicity.py, on folds of the rows that may be learned from
PRIOR = 10.0
MARGIN = 2.0
STEADY = 900
SYMBOLS = 64.0  # the lowest level backs off to one of as many bytes
SLICE_ROWS = 6_000_000
LABELS_TO_BROADCAST = 2_000_000
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
CONTEXT = 1 << 60  # marks the key of a context, which stands for the bytes not seen after it


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts, byte by byte, the packed gram that ends there, the number of its word (increasing, with gaps) and its text."""
    n = len(offsets) - 1
    x = LETTER[data]
    row = np.repeat(np.arange(n), np.diff(offsets))
    keep = x != 32
    keep[1:] |= ~(x[1:] != 32) & (x[:-1] != 32) & (row[1:] == row[:-1])  # one space after a word
    x, row = x[keep], row[keep]
    closing = np.ones(len(x), bool)
    closing[:-1] = row[1:] != row[:-1]
    keep = ~(closing & (x == 32))
    x, row = x[keep], row[keep]
    # each text as a zero, a space, its words with single spaces between, a space
    size = np.bincount(row, minlength=n)
    begin = np.concatenate([[0], np.cumsum(size + 3)])
    stream = np.zeros(begin[-1], np.uint8)
    stream[np.arange(len(x)) + 3 * row + 2] = x
    stream[begin[:-1] + 1] = 32
    stream[begin[1:] - 1] = 32
    text = np.repeat(np.arange(n), size + 3)
    before = np.concatenate([[0], stream[:-1]])
    at = np.flatnonzero((stream != 0) & (before != 0) & ~((stream == 32) & (before == 32)))
    key, open_ = np.zeros(len(at), np.uint64), np.ones(len(at), bool)
    for k in range(ORDER):
        b = stream[np.maximum(at - k, 0)]
        open_ &= b != 0
        key |= np.where(open_, b.astype(np.uint64) << np.uint64(8 * k), np.uint64(0))
        if k:
            open_ &= b != 32
    return key, np.cumsum(stream == 32)[at - 1], text[at]


def gram_counts(labelled: DataFrame) -> DataFrame:
    """From rows (toxic int, text), distinct texts: key, t, o: occurrences in toxic and in ordinary texts, at most BURST a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]

        def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            keys, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return keys, np.bincount(inverse, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)

        def out() -> Iterator[pa.RecordBatch]:
            for c, parts in enumerate(held):
                if parts:
                    keys, n = merged(parts)
                    for i in range(0, len(keys), 65_536):
                        k, m = keys[i : i + 65_536].astype(np.int64), n[i : i + 65_536]
                        zero = np.zeros_like(m)
                        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(m if c else zero), pa.array(zero if c else m)], names=["key", "t", "o"])
                parts.clear()

        for batch in batches:
            toxic = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b, part, off in B.parts(batch.column(1)):
                keys, _, text = grams(part, off)
                ends = np.searchsorted(text, np.arange(b - a + 1))
                found: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]
                for i in range(b - a):
                    own, times = np.unique(keys[ends[i] : ends[i + 1]], return_counts=True)
                    found[int(toxic[a + i] == 1)].append((own, np.minimum(times, BURST)))
                for c in (0, 1):
                    if found[c]:
                        held[c].append(merged(found[c]))
                        if len(held[c]) >= 12:
                            held[c][:] = [merged(held[c])]
                if sum(len(p[0]) for parts in held for p in parts) > 3_000_000:
                    yield from out()
        yield from out()

    return labelled.select("toxic", "text").mapInArrow(B.releasing(run), "key long, t long, o long").groupBy("key").agg(F.sum("t").alias("t"), F.sum("o").alias("o"))


def discounts(rows: DataFrame, counts: list[str]) -> list[tuple[float, float, float]]:
    """Of each column of counts the modified Kneser-Ney discounts of 1, 2 and 3 or more, each between 0 and the count."""
    got = rows.agg(*[F.count_if(F.col(c) == k).alias(f"{c}{k}") for c in counts for k in (1, 2, 3, 4)]).first()
    out = []
    for c in counts:
        n = [max(1, got[f"{c}{k}"]) for k in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1])
        out.append(tuple(float(min(k, max(0.0, k - (k + 1) * y * n[k] / n[k - 1]))) for k in (1, 2, 3)))
    return out


def discount(count: Column, d: tuple[float, float, float]) -> Column:
    return F.when(count >= 3, d[2]).when(count == 2, d[1]).when(count == 1, d[0]).otherwise(0.0)


def suffix(key: Column) -> Column:
    """The gram without its oldest byte; 0 if it has one only."""
    cut = F.lit(0).cast("long")
    for k in range(1, ORDER):
        cut = F.when(key >= (1 << 8 * k), key.bitwiseAND(F.lit((1 << 8 * k) - 1))).otherwise(cut)
    return cut


def shared_backoff(counts: DataFrame) -> DataFrame:
    """key, p: of each counted gram the pooled, interpolated Kneser-Ney probability of its last byte after the others.

    A context has at most 256 bytes after it, so no group is large at any level.
    """
    level = counts.select("key", (F.col("t") + F.col("o")).alias("n"))
    tables = [level]
    for k in range(ORDER - 1):
        level = tables[-1].select(suffix(F.col("key")).alias("key")).where("key <> 0").groupBy("key").agg(F.count("*").alias("n"))
        tables.append(written(level, f"tox-level{k}"))
    below: DataFrame | None = None
    for k, level in reversed(list(enumerate(tables))):
        (d,) = discounts(level, ["n"])
        after = Window.partitionBy("ctx")
        rows = level.withColumn("ctx", F.shiftright("key", 8)).withColumn("d", discount(F.col("n"), d))
        rows = rows.withColumns({"total": F.sum("n").over(after), "mass": F.sum("d").over(after), "low": suffix(F.col("key"))})
        if below is not None:
            rows = rows.join(below.select(F.col("key").alias("low"), F.col("p").alias("q")), "low", "left")
        q = F.lit(1 / SYMBOLS) if below is None else F.coalesce("q", F.lit(1 / SYMBOLS))
        below = written(rows.select("key", ((F.col("n") - F.col("d") + F.col("mass") * q) / F.col("total")).alias("p")), f"tox-backoff{k}")
    return below


def log_ratios(counts: DataFrame, prune: float = PRUNE) -> DataFrame:
    """key, ratio: log P_toxic / P_ordinary of every counted gram, and under CONTEXT + ctx of every byte not seen after a context.

    Without texts of both classes there are no rows. A gram is left out where its ratio is within `prune` of its context's, a
    context where its own is within `prune` of 0.
    """
    have = counts.agg(F.coalesce(F.sum("t"), F.lit(0)), F.coalesce(F.sum("o"), F.lit(0))).first()
    rows = counts.join(shared_backoff(counts), "key") if have[0] and have[1] else counts.withColumn("p", F.lit(1.0)).where(F.lit(False))
    after = Window.partitionBy("ctx")
    rows = rows.withColumn("ctx", F.shiftright("key", 8))
    for c, d in zip("to", discounts(counts, ["t", "o"]), strict=True):
        rows = rows.withColumn(f"{c}d", discount(F.col(c), d))
        rows = rows.withColumns({f"{c}n": F.sum(c).over(after) + PRIOR, f"{c}m": F.sum(f"{c}d").over(after) + PRIOR})
    prob = lambda c: (F.col(c) - F.col(f"{c}d") + F.col(f"{c}m") * F.col("p")) / F.col(f"{c}n")
    unseen = F.log(F.col("tm") / F.col("tn")) - F.log(F.col("om") / F.col("on"))
    rows = written(rows.select("key", "ctx", F.log(prob("t") / prob("o")).alias("ratio"), unseen.alias("unseen")), "tox-all-ratios")
    own = rows.where(F.abs(F.col("ratio") - F.col("unseen")) > prune).select("key", "ratio")
    contexts = rows.where(F.abs("unseen") > prune).select((F.col("ctx") + CONTEXT).alias("key"), F.col("unseen").alias("ratio")).distinct()
    return own.unionByName(contexts).select("key", F.col("ratio").cast("float").alias("ratio"))


class Table:
    """Open addressing over packed pieces (never 0), looked up by whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 2))))
        self.shift, self.mask = np.uint64(64 - bits), np.uint64((1 << bits) - 1)
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.float32)
        left, slot = np.arange(len(keys)), (keys * MULTIPLIER) >> self.shift
        while len(left):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = keys[left[free]]  # of several for one place the last stays
            got = self.keys[slot] == keys[left]
            self.values[slot[got]] = values[left[got]]
            left, slot = left[~got], (slot[~got] + np.uint64(1)) & self.mask

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values, 0 where missing, and where the keys were found."""
        slot = (keys * MULTIPLIER) >> self.shift
        there = self.keys[slot]
        found = there == keys
        out = np.where(found, self.values[slot], np.float32(0))
        left = np.flatnonzero(~found & (there != 0))
        slot = slot[left]
        while len(left):
            slot = (slot + np.uint64(1)) & self.mask
            there = self.keys[slot]
            ok = there == keys[left]
            out[left[ok]], found[left[ok]] = self.values[slot[ok]], True
            more = ~ok & (there != 0)
            left, slot = left[more], slot[more]
        return out, found


def slice_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """A gram and its context are of one slice."""
    contexts = np.where(keys >= np.uint64(CONTEXT), keys - np.uint64(CONTEXT), keys >> np.uint64(8))
    return (B.mix(contexts) % np.uint64(parts)).astype(np.int64)


def word_sums(table: Table, keys: np.ndarray, words: np.ndarray, own: np.ndarray | None) -> np.ndarray:
    """Per word number the sum of log-ratios, of the grams whose place in `own` is true."""
    if own is not None:
        keys, places = keys[own], words[own]
    else:
        places = words
    ratio, found = table.get(keys)
    left = np.flatnonzero(~found)
    ratio[left] = table.get((keys[left] >> np.uint64(8)) + np.uint64(CONTEXT))[0]
    return np.bincount(places, weights=ratio, minlength=int(words[-1]) + 1 if len(words) else 0)


def slice_scores(rows: DataFrame, model: tuple[np.ndarray, np.ndarray], part: int, parts: int) -> DataFrame:
    """The last columns of `rows` are text and, from the second slice on, sums (of words so far). All but the last slice give text
    and sums; the last gives evidence instead."""
    shared = rows.sparkSession.sparkContext.broadcast(model)  # about SLICE_ROWS rows at most
    text_at = len(rows.columns) - (2 if part else 1)
    last = part == parts - 1
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: text_at + (not last)]) + (", evidence double" if last else ", sums binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(*shared.value)
        for batch in batches:
            evidence, packed = np.zeros(batch.num_rows), []
            for a, b, piece, off in B.parts(batch.column(text_at)):
                keys, words, text = grams(piece, off)
                ratio = word_sums(table, keys, words, slice_of(keys, parts) == part if parts > 1 else None)
                used = np.flatnonzero(np.diff(words, prepend=-1)) if len(words) else np.zeros(0, np.int64)
                of, ratio = text[used], ratio[words[used]]  # one entry a word, in order
                if part:
                    ratio = ratio + np.concatenate([np.frombuffer(batch.column(text_at + 1)[i].as_buffer(), np.float64) for i in range(a, b)])
                if last:
                    clear = np.bincount(of, weights=np.maximum(ratio - MARGIN, 0), minlength=b - a)
                    evidence[a:b] = clear / (np.bincount(of, minlength=b - a) + STEADY)
                else:
                    ends = np.searchsorted(of, np.arange(b - a + 1))
                    packed += [ratio[ends[i] : ends[i + 1]].tobytes() for i in range(b - a)]
            columns = [*batch.columns[: text_at + (not last)], pa.array(evidence) if last else pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[: text_at + (not last)], "evidence" if last else "sums"])

    return rows.mapInArrow(B.releasing(run), fields)


def scores(rows: DataFrame, ratios: DataFrame, slice_rows: int | None = None) -> DataFrame:
    """The columns of `rows`, whose last is the text, with evidence in the text's place."""
    parts = max(1, -(-ratios.count() // (slice_rows or SLICE_ROWS)))
    if parts == 1:
        return slice_scores(rows, fetched(ratios), 0, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy().astype(np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(slice_of(keys, parts).astype(np.int32))], names=["key", "ratio", "slice"])

    keyed = written(ratios.mapInArrow(run, "key long, ratio float, slice int"), "tox-slices")
    for k in range(parts):
        rows = slice_scores(rows, fetched(keyed.where(F.col("slice") == k)), k, parts)
        if k < parts - 1:
            rows = written(rows, f"tox-sums{k}")
    return rows


def fetched(ratios: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    got = ratios.select("key", "ratio").toArrow()
    return got.column(0).to_numpy().astype(np.uint64), got.column(1).to_numpy().astype(np.float32)


def fit_logistic(mean: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and intercept by Newton steps with a slight ridge on the slope."""
    scale = float(np.sqrt((weight * mean**2).sum() / max(1.0, weight.sum()))) or 1.0
    x = np.stack([mean / scale, np.ones_like(mean)])
    w = np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(w @ x, -40, 40)))
        ridge = np.diag([1e-2, 1e-6])
        step = np.linalg.solve((x * (weight * p * (1 - p))) @ x.T + ridge, x @ (weight * (p - label)) + ridge @ w)
        w -= np.clip(step, -3, 3)
    return float(w[0] / scale), float(w[1])


def detect(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", toxic: str = "toxic", threshold: float = 0.7) -> DataFrame:
    """One row per row of `docs`: key, held_out, score (0 to 1), predicted (1 if score >= threshold).

    Learns from the labelled rows that are not held out: four fifths of their distinct texts give the counts, one fifth (by a
    hash of the text) fits the logistic. A text without letters, or null, has evidence 0 and so the intercept's score. Null
    labels teach nothing; a text counts once for each class that its rows are labelled with. Without any label, or with labels of
    one class only, scores are all 0.5 or that of the class's rate. Empty tables give empty results; other columns are not read.
    """
    teach = labels.where(F.col(toxic).isNotNull() & ~held_out(F.col(key))).select(F.col(key).alias("__key"), F.col(toxic).cast("int").alias("toxic"))
    if teach.count() <= LABELS_TO_BROADCAST:  # else joined by shuffle
        teach = F.broadcast(teach)
    slim = docs.select(F.col(key).alias("__key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    labelled = slim.join(teach, "__key").select("toxic", "text").withColumn("h", F.xxhash64("text"))
    labelled = written(labelled.groupBy("toxic", "h").agg(F.min("text").alias("text")), "tox-labelled")
    tuning = F.pmod(F.col("h"), F.lit(5)) == 0
    ratios = written(log_ratios(written(gram_counts(labelled.where(~tuning)), "tox-counts")), "tox-ratios")
    tuned = scores(labelled.where(tuning).select("toxic", "text"), ratios)
    feature = F.asinh(F.col("evidence") * 200)
    # a histogram of fixed size of all tuning texts, fine near zero
    rows = tuned.groupBy(F.round(feature * 200).cast("int").alias("bin"), "toxic").count().collect()
    x = np.array([r[0] for r in rows], float) / 200
    slope, intercept = fit_logistic(x, np.array([float(r[1] == 1) for r in rows]), np.array([float(r[2]) for r in rows])) if rows else (0.0, 0.0)
    scored = scores(slim, ratios)
    score = 1 / (1 + F.exp(-(feature * slope + intercept)))
    return scored.select(F.col("__key").alias(key), held_out(F.col("__key")).alias("held_out"), score.alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
