"""BPE encoding with content-defined chunk reuse, and decoding.

A rolling hash over a text's bytes cuts it where the last WINDOW bytes say so, so equal passages fall into equal chunks wherever they
stand. Chunks that stand more than once in the corpus are encoded once, by one holder, and sent to all texts that hold them. A
chunk's end can fall anywhere, also inside a word or a special token: at each join the text around it is encoded anew, from a place
before the join that no later character can change, until it has a place in common with the next chunk's own encoding; from there
on both agree to the end of that chunk. Texts without a repeated chunk are encoded where they are read.

For tokenizers (files of the library tokenizers) whose pre-tokeniser drops white space, as Encoder checks.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from hashlib import blake2b
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm import _bytes as B
from paperloom.llm._store import written
from paperloom.llm.components import dealt, hot_among, join_split, repeated, short_list
from paperloom.llm.tokens import SPACE

WINDOW, MEAN, LEAST, MOST = 48, 2048, 256, 1 << 16  # bytes: of the rolling hash; of chunks
PIECE = re.compile(f"[{SPACE}]*[^{SPACE}]+")
LONG = 48  # characters: longer pieces have anchors inside
ENDS = 64  # anchors kept at each end of a chunk
CACHE_ENTRIES = 400_000
BATCH_BYTES = 1 << 16
REACH = 64  # characters that are first encoded anew behind a join
# code points before which a text can be parted without changing its NFC form: none of them composes with one before it
UNJOINED = ((0, 0x2FF), (0x370, 0x482), (0x48A, 0x590), (0x2000, 0x20CF), (0x2100, 0x2FFF), (0x3001, 0x3029), (0x3030, 0x3098), (0x309B, 0x9FFF), (0xAC00, 0xD7A3), (0xFF00, 0xFF9D))


def unjoined(c: str) -> bool:
    n = ord(c)
    return any(a <= n <= b for a, b in UNJOINED)


class Encoded(NamedTuple):
    """ids (4 bytes each), and anchors: places (characters) where a new word of the pre-tokeniser starts, with the number of ids before each."""

    ids: bytes
    places: list[int]
    counts: list[int]


def cuts(data: np.ndarray, mean: int = MEAN, least: int = LEAST) -> list[int]:
    """Ends of a text's chunks, from its UTF-8 bytes."""
    n = len(data)
    if n <= max(least, WINDOW):
        return [n]
    sums = np.zeros(n + 1, B.U)
    np.cumsum(B.BYTE[data] * B.powers(B.BASE, n), out=sums[1:])
    rolling = B.mix((sums[WINDOW:] - sums[:-WINDOW]) * B.powers(B.INVERSE, n + 1)[: n + 1 - WINDOW])
    out, at = [], 0
    for end in [*(np.flatnonzero(rolling % B.U(mean) == 0) + WINDOW).tolist(), n]:
        while end - at > MOST:
            at += MOST
            while data[at] & 0xC0 == 0x80:  # inside a character
                at -= 1
            out.append(at)
        while end < n and data[end] & 0xC0 == 0x80:
            end += 1
        if end == n or end - at >= least:
            out.append(end)
            at = end
    return list(dict.fromkeys(out))


def chunks(text: str, mean: int = MEAN, least: int = LEAST) -> list[bytes]:
    data = text.encode()
    ends = cuts(np.frombuffer(data, np.uint8), mean, least)
    return [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


class Encoder:
    """Encodes as `tokenizers` does with add_special_tokens=False, without truncation or padding; special strings inside texts are
    handled as its default."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = self.tokenizer = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        added = list(t.get_added_tokens_decoder().values())
        ids = lambda x: t.encode(x, add_special_tokens=False).ids
        if ids(" a\n　b ") != ids("a") + ids("b") or any(a.lstrip or a.rstrip or a.single_word or re.search(f"[{SPACE}]", a.content) for a in added):
            raise ValueError("only tokenizers that drop white space can be used")
        self.margin = 2 + max([14, *(len(a.content) for a in added)])  # what stands this far ahead can't change where a word starts
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}  # what was known before; pieces met again come back, so frequent ones are never encoded anew
        self.words = None if t.decoder else [t.id_to_token(i) or "" for i in range(t.get_vocab_size())]

    def _learn(self, pieces: list[str]) -> dict[str, bytes]:
        found = {p: self.older[p] for p in pieces if p in self.older}
        new = list(dict.fromkeys(p for p in pieces if p not in found))
        at = 0
        while at < len(new):
            end, held = at, 0
            while end < len(new) and held < BATCH_BYTES:
                held += len(new[end])
                end += 1
            for p, e in zip(new[at:end], self.tokenizer.encode_batch_fast(new[at:end], add_special_tokens=False), strict=True):
                found[p] = array("i", e.ids).tobytes()
            at = end
        if len(self.known) + len(found) > CACHE_ENTRIES // 2:
            self.older, self.known = self.known, {}
        self.known.update((p, i) for p, i in found.items() if len(p) <= LONG)
        return found

    def _pieces(self, text: str) -> tuple[list[str], list[bytes]]:
        pieces = PIECE.findall(text)
        got = list(map(self.known.get, pieces))
        if None in got:
            found = self._learn([p for p, g in zip(pieces, got, strict=True) if g is None])
            got = [found[p] if g is None else g for p, g in zip(pieces, got, strict=True)]
        return pieces, got

    def ids(self, text: str) -> bytes:
        return b"".join(self._pieces(text)[1])

    def encode(self, text: str) -> Encoded:
        """With anchors before each piece, where the text can be parted, and inside long pieces."""
        pieces, got = self._pieces(text)
        places = [0, *accumulate(map(len, pieces))][:-1] if pieces else []
        counts = [n // 4 for n in [0, *accumulate(map(len, got))][:-1]] if pieces else []
        if any(len(p) > LONG for p in pieces):
            more: list[tuple[int, int]] = []
            for p, at, n in zip(pieces, places, counts, strict=True):
                more.append((at, n))
                if len(p) > LONG:
                    e = self.tokenizer.encode(p, add_special_tokens=False)
                    words, offsets = e.word_ids, e.offsets
                    more += [(at + offsets[k][0], n + k) for k in range(1, len(words)) if words[k] != words[k - 1] and offsets[k - 1][1] <= offsets[k][0] and unjoined(p[offsets[k][0]])]
            places, counts = [m[0] for m in more], [m[1] for m in more]
        if places and not unjoined(text[0]):
            places, counts = places[1:], counts[1:]
        return Encoded(b"".join(got), places, counts)

    def join(self, text: str, parts: list[str], held: dict[int, Encoded]) -> bytes:
        """The ids of a text that is cut into `parts`, some of which are encoded already (`held`, by number)."""
        first = held.get(0) or self.encode(parts[0])
        ids, places, counts = bytearray(first.ids), list(first.places), list(first.counts)
        at, k = len(parts[0]), 1
        while k < len(parts):
            i = bisect_right(places, at - self.margin) - 1
            x, before = (places[i], counts[i]) if i >= 0 else (0, 0)
            start, end = at, at + len(parts[k])
            while end - at < at - x and k + 1 < len(parts):  # far from the last anchor: take as much at once as is encoded anew
                k += 1
                start, end = end, end + len(parts[k])
            part = held.get(k) or self.encode(parts[k])
            own = dict(zip(part.places, part.counts, strict=True))
            reach, agreed = REACH, None
            while True:
                y = min(end, start + reach)
                new = self.encode(text[x:y])
                sure = y if y == len(text) else y - self.margin
                agreed = next(((p, n) for p, n in zip(new.places, new.counts, strict=True) if start <= x + p <= sure and x + p - start in own), None)
                if agreed or y == end:
                    break
                reach *= 4
            place, count = agreed or (end - x + 1, len(new.ids) // 4)
            del ids[4 * before :], places[max(i, 0) :], counts[max(i, 0) :]
            ids += new.ids[: 4 * count]
            places += [x + p for p in new.places if p < place]
            counts += [before + n for p, n in zip(new.places, new.counts, strict=True) if p < place]
            if agreed:
                skip = own[x + place - start]
                shift = len(ids) // 4 - skip
                ids += part.ids[4 * skip :]
                places += [start + p for p in part.places if start + p >= x + place]
                counts += [shift + n for p, n in zip(part.places, part.counts, strict=True) if start + p >= x + place]
            at, k = end, k + 1
        return bytes(ids)

    def decode(self, ids: list[int]) -> str:
        """As the library's decode(ids, skip_special_tokens=False), which joins tokens by spaces where there is no decoder."""
        return self.tokenizer.decode(ids, skip_special_tokens=False) if self.words is None else " ".join(map(self.words.__getitem__, ids))


_encoders: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """One per Python worker, which serves many tasks: the vocabulary is loaded once, and pieces met in one task are known in the next."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def packed(e: Encoded) -> tuple[bytes, bytes]:
    """The ids, and the anchors at both ends, as 4-byte numbers."""
    pairs = np.array([e.places, e.counts], np.int32).T
    if len(pairs) > 2 * ENDS:
        pairs = np.concatenate([pairs[:ENDS], pairs[-ENDS:]])
    return e.ids, pairs.tobytes()


def unpacked(ids: bytes, anchors: bytes) -> Encoded:
    pairs = np.frombuffer(anchors, np.int32).reshape(-1, 2)
    return Encoded(ids, pairs[:, 0].tolist(), pairs[:, 1].tolist())


def pieces_of(batch: pa.RecordBatch, rows: int = 64, size: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Slices of a few rows and about `size` bytes of its last column, so that neither strings nor results of many rows are held."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_pylist()
    at, held = 0, 0
    for i, n in enumerate(sizes):
        if i > at and (i - at >= rows or held + n > size):
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += n
    if at < len(sizes):
        yield batch.slice(at)


def ids_array(rows: list[bytes]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(r) // 4 for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(rows), np.int32)))


def encode(docs: DataFrame, tokenizer: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), columns: dict[str, Column] | None = None, mean: int = MEAN, least: int = LEAST) -> DataFrame:
    """The columns of `keep` and those of `columns`, made from ids (array of int) and decoded (their tokens as decode() gives them);
    by default ids. One row per input row.

    A null text is empty and has no ids; whole texts are encoded, however long; repeated rows and texts are encoded once and
    returned for each row; an empty table gives an empty result. Other columns, whatever their names, are not read. `tokenizer` is
    a path readable on every executor. Chunks have `least` bytes or more and about `mean`.
    """
    columns = columns or {"ids": F.col("ids")}
    kept = [F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]
    x = docs.select(*kept, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    x = x.select("*", F.xxhash64("text").alias("h"))
    made = [c.alias(name) for name, c in columns.items()]
    ks = [f"k{i}" for i in range(len(keep))]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces_of(batch, 4096):
                found = [[blake2b(c, digest_size=16).digest() for c in chunks(t, mean, least)] if t else [] for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.list_(pa.binary()))], names=["t", "h", "c"])

    # every chunk's places; a text that stands in many rows is one text, and counts as often
    rows = written(x.select(F.unhex(F.sha2("text", 256)).alias("t"), "h", "text").mapInArrow(B.releasing(cut), "t binary, h long, c array<binary>"), "bpe-chunks")
    texts = rows.groupBy("t", "h").agg(F.first("c").alias("c"), F.count("*").alias("n"))
    places = written(texts.select("t", "h", "n", F.posexplode("c").alias("seq", "chunk")), "bpe-places")
    shared = written(places.groupBy("chunk").agg(F.sum("n").alias("n"), F.count("*").alias("texts"), F.min(F.struct("t", "h", "seq")).alias("holder")).where("n > 1"), "bpe-shared")
    hot = hot_among(shared, "chunk", "texts")
    refs = written(join_split(places, shared.select("chunk"), "chunk", hot=hot).select("t", "h", "seq", "chunk"), "bpe-refs")
    hashes = short_list(refs.select("h").distinct())

    # texts with a shared chunk meet; a text is held once
    met = x.join(hashes, "h", "left_semi").select(F.unhex(F.sha2("text", 256)).alias("t"), "text")
    met = written(met.groupBy("t").agg(F.first("text").alias("text")), "bpe-texts")
    holders = shared.groupBy("holder.t").agg(F.collect_list(F.struct("holder.seq", "chunk")).alias("own")).select("t", "own")

    def encode_held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer)
        for batch in batches:
            for part in pieces_of(batch):
                out = []
                for own, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    all_of = chunks(t, mean, least)
                    out += [(o["chunk"], *packed(encoder.encode(all_of[o["seq"]].decode()))) for o in own]
                yield pa.RecordBatch.from_arrays([pa.array([o[j] for o in out], pa.binary()) for j in range(3)], names=["chunk", "ids", "anchors"])

    once = written(holders.join(met, "t").select("own", "text").mapInArrow(B.releasing(encode_held), "chunk binary, ids binary, anchors binary"), "bpe-encoded")
    sent = dealt(refs, hot, "chunk", "salt").join(repeated(once, hot, "chunk", "salt"), ["chunk", "salt"])
    sent = sent.groupBy("t").agg(F.collect_list(F.struct("seq", "ids", "anchors")).alias("held"))

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer)
        for batch in batches:
            for part in pieces_of(batch):
                found = []
                for held, t in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    known = {h["seq"]: unpacked(h["ids"], h["anchors"]) for h in held or ()}
                    found.append(encoder.join(t, [c.decode() for c in chunks(t, mean, least)], known) if known else encoder.ids(t))
                yield pa.RecordBatch.from_arrays([part.column(0), ids_array(found), pa.array([encoder.decode(np.frombuffer(f, np.int32).tolist()) for f in found], pa.string())], names=["t", "ids", "decoded"])

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer)
        for batch in batches:
            for part in pieces_of(batch):
                found = [encoder.ids(t) for t in part.column(part.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], ids_array(found), pa.array([encoder.decode(np.frombuffer(f, np.int32).tolist()) for f in found], pa.string())], names=[*ks, "ids", "decoded"])

    joined = met.join(sent, "t", "left").select("t", "held", "text").mapInArrow(B.releasing(assemble), "t binary, ids array<int>, decoded string")
    joined = written(joined.select("t", *made), "bpe-joined")
    back = x.join(hashes, "h", "left_semi").select(*ks, F.unhex(F.sha2("text", 256)).alias("t"))
    copies = hot_among(rows.groupBy("t").agg(F.count("*").alias("n")), "t", "n")
    back = dealt(back, copies, "t", "salt").join(repeated(joined, copies, "t", "salt"), ["t", "salt"])
    fields = ", ".join(f"{k} {x.schema[k].dataType.simpleString()}" for k in ks)
    rest = x.join(hashes, "h", "left_anti").select(*ks, "text").mapInArrow(B.releasing(alone), f"{fields}, ids array<int>, decoded string").select(*ks, *made)
    both = back.select(*ks, *columns).unionByName(rest)
    return both.select(*[F.col(k).alias(c) for k, c in zip(ks, keep, strict=True)], *columns)


def decode(rows: DataFrame, tokenizer: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """The columns of `rows`, and `into`: the text of the ids, special tokens included; null ids have null, none the empty text."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop(into).schema.fields)
    x = rows.drop(into)
    at = x.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([None if i is None else encoder.decode(i) for i in part.column(at).to_pylist()], pa.string())], names=[*part.schema.names, into])

    return x.mapInArrow(B.releasing(run), f"{fields}, `{into}` string")
