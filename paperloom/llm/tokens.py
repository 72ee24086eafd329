"""Token counts: batch encoding in Arrow functions that return lengths only.

Texts are cut into chunks at safe boundaries: places where the byte-level pre-tokeniser always starts a new piece (before a
run of non-space characters with at most one leading space, and around white space), so the counts of the chunks add up to
the count of the whole text. Each distinct chunk is encoded once per cache generation; batches for the library are balanced
by bytes, and a text longer than a batch is worked through in windows of chunks, so memory does not grow with the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The white space of the pre-tokeniser's pattern (the Unicode property White_Space).
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
CHUNK = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
BATCH_BYTES = 1 << 20
CACHE_ENTRIES = 400_000
CACHED_CHARS = 64


def n_bytes(text: str) -> int:
    """Length in UTF-8; ASCII text is not encoded for it."""
    return len(text) if text.isascii() else len(text.encode())


class Counter:
    """Counts tokens as `tokenizers` gives them, without added tokens, truncation or padding."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[str, int] = {}
        added = self.tokenizer.get_added_tokens_decoder().values()
        if any(t.lstrip or t.rstrip or t.single_word for t in added):
            raise ValueError("added tokens that take in their surroundings can't be counted by chunks")
        # the library cuts texts at added tokens first; one token each, and the pre-tokeniser sees an end there
        self.added = re.compile("|".join(re.escape(t.content) for t in sorted(added, key=lambda t: -len(t.content)))) if added else None

    def _chunks(self, text: str) -> Iterator[str]:
        at = 0
        for m in self.added.finditer(text) if self.added else ():
            yield from (c[0] for c in CHUNK.finditer(text[at : m.start()]))
            yield m[0]
            at = m.end()
        yield from (c[0] for c in CHUNK.finditer(text[at:] if at else text))

    def _list(self, text: str) -> list[str]:
        return list(self._chunks(text)) if self.added and self.added.search(text) else CHUNK.findall(text)

    def _encode(self, chunks: list[str]) -> list[int]:
        out: list[int] = []
        batch: list[str] = []
        held = 0
        for c in chunks:  # balanced by bytes, not by number
            batch.append(c)
            held += n_bytes(c)
            if held >= BATCH_BYTES:
                out += map(len, self.tokenizer.encode_batch_fast(batch, add_special_tokens=False))
                batch, held = [], 0
        if batch:
            out += map(len, self.tokenizer.encode_batch_fast(batch, add_special_tokens=False))
        return out

    def _sum(self, chunks: list[str]) -> int:
        get = self.known.get
        lengths = list(map(get, chunks))
        if None in lengths:
            new = list({c for c, n in zip(chunks, lengths, strict=True) if n is None})
            found = dict(zip(new, self._encode(new), strict=True))
            lengths = [found[c] if n is None else n for c, n in zip(chunks, lengths, strict=True)]
            if len(self.known) > CACHE_ENTRIES:
                self.known.clear()
            self.known.update((c, n) for c, n in found.items() if len(c) <= CACHED_CHARS)
        return sum(lengths)

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if n_bytes(text) <= BATCH_BYTES:
            return self._sum(self._list(text))
        total, window, held = 0, [], 0
        for c in self._chunks(text):
            window.append(c)
            held += n_bytes(c)
            if held >= BATCH_BYTES:
                total += self._sum(window)
                window, held = [], 0
        return total + self._sum(window)

    def counts(self, texts: list[str | None]) -> list[int]:
        """As count(), new chunks of many texts encoded together."""
        out: list[int] = []
        group: list[str] = []
        held = 0
        for text in [*texts, None]:
            size = 0 if text is None else n_bytes(text)
            if text is not None and size <= BATCH_BYTES:
                group.append(text)
                held += size
            if group and (held >= BATCH_BYTES or text is None or size > BATCH_BYTES):
                parts = [self._list(t) for t in group]
                get = self.known.get
                new = list({c for p in parts for c in p if get(c) is None})
                found = dict(zip(new, self._encode(new), strict=True))
                known = self.known
                if len(known) + len(found) > CACHE_ENTRIES:
                    known = {k: known[k] for k in {c for p in parts for c in p} if k in known}
                known.update(found)
                out += [sum(map(known.__getitem__, p)) for p in parts]
                for c in new:
                    if len(c) > CACHED_CHARS:
                        del known[c]
                self.known = known
                group, held = [], 0
            if text is not None and size > BATCH_BYTES:
                out.append(self.count(text))
            elif text is None:
                out.append(0)
        return out[:-1]


def count_tokens(docs: DataFrame, tokenizer: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), limit: int = 512) -> DataFrame:
    """One row per input row: the columns of `keep`, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    A null or empty text has 0 bytes and 0 tokens; very long texts are counted whole; repeated rows are counted each;
    an empty table gives an empty result; other columns, whatever their names, are not read. `tokenizer` is the path of a
    .json file of the library tokenizers, readable on every executor. Only lengths leave the Python workers.
    """
    kept = docs.select(*[F.col(c) for c in keep], F.col(text).cast("string").alias("__text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(tokenizer)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            counts: list[int] = []
            sizes: list[int] = []
            for at in range(0, len(texts), 256):  # strings of a few rows at a time
                part = texts.slice(at, 256).to_pylist()
                sizes += [n_bytes(t) if t else 0 for t in part]
                counts += counter.counts([t or "" for t in part])
            columns = [*batch.columns[:-1], pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "n_bytes", "n_tokens", "over_limit"])

    return kept.mapInArrow(run, f"{fields}, n_bytes long, n_tokens long, over_limit boolean")
