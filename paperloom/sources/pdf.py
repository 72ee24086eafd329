"""A small PDF reader in pure Python, run inside mapInArrow: structure for the preflight, text, metadata and page count.

It covers cross-reference tables and streams, object streams, Flate-coded streams, ToUnicode maps and the text operators. Files
whose cross-reference can't be followed are rebuilt from their object headers and carry a repair note. What it can't read
becomes empty text, which routing treats as thin.
"""

from __future__ import annotations

import re
import zlib
from binascii import unhexlify
from collections.abc import Iterator
from typing import Any

import pandas as pd
import pyarrow as pa

NODE_BUDGET = 50_000
GAP = rb"(?:[\x00\t\n\x0c\r ]|%[^\r\n]*[\r\n])"
DIGITS = rb"[+-]?0*+(?:[0-9]{1,10}|(?<=0))"  # possessive, like the gaps: nothing shorter could be followed by what must follow
OBJECT = GAP + rb"*+(" + DIGITS + rb")" + GAP + rb"++" + DIGITS + GAP + rb"++obj(?![A-Za-z0-9_])"
FIRST = re.compile(OBJECT)
# a gap's first character by itself, so that the scan goes from one such character to the next
HEADER = re.compile(rb"[\x00\t\n\x0c\r %](?:(?<=%)[^\r\n]*[\r\n]|(?<!%))" + OBJECT)
SKIPPED = re.compile(rb"(?:[\x00\t\n\x0c\r ]+|%[^\r\n]*)*")
WORD = re.compile(rb"[^\x00\t\n\x0c\r ()<>\[\]{}/%]*")
PLAIN = re.compile(rb"[^()\\]*")
OCTAL = re.compile(rb"[0-7]{0,2}")
NO_DIGITS = re.compile(rb"[^0-9A-Fa-f]")
INTEGER = re.compile(rb"[+-]?[0-9]+")
REAL = re.compile(rb"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)")
REFERENCE = re.compile(rb"[\x00\t\n\x0c\r ]+([0-9]+)[\x00\t\n\x0c\r ]+R(?![A-Za-z0-9])")
ESCAPED = re.compile(rb"#([0-9A-Fa-f]{2})")
ENTRIES = re.compile(rb"[\x00\t\n\x0c\r ]*([0-9]+)[\x00\t\n\x0c\r ]+[0-9]+[\x00\t\n\x0c\r ]+([nf])(?=[\x00\t\n\x0c\r ])")
# what content streams mostly hold: a hexadecimal string, a name, an integer, an operator
TOKEN = re.compile(rb"[\x00\t\n\x0c\r ]*+(?:<((?:[0-9A-Fa-f]{2})*+)>|/([^\x00\t\n\x0c\r ()<>\[\]{}/%#]*+)(?!#)|([+-]?[0-9]++)(?=[\x00\t\n\x0c\r ()<>\[\]{}/%]|\Z)|([A-Za-z'\"*][^\x00\t\n\x0c\r ()<>\[\]{}/%]*+))")
LITERALS = {b"true": True, b"false": False, b"null": None}


def headers(data: bytes) -> Iterator[re.Match]:
    """The object headers in the bytes, also where the cross-reference doesn't know them; the number is the first group."""
    first = FIRST.match(data)
    if first:
        yield first
    yield from HEADER.finditer(data, first.end() if first else 0)


class PdfError(Exception):
    """The file can't be read any further."""


class Name(str):
    __slots__ = ()


class Ref(tuple):
    """(number, generation)."""

    __slots__ = ()


class Stream:
    def __init__(self, info: dict, data: bytes):
        self.info, self.data = info, data


class Lexer:
    """Parses objects from bytes at a position."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def skip(self) -> None:
        self.at = SKIPPED.match(self.data, self.at).end()

    def word(self) -> bytes:
        m = WORD.match(self.data, self.at)
        self.at = m.end()
        return m[0]

    def literal(self) -> bytes:
        out, depth, d = bytearray(), 1, self.data
        self.at += 1
        plain = {ord("n"): 10, ord("r"): 13, ord("t"): 9, ord("b"): 8, ord("f"): 12}
        while depth:
            if self.at >= len(d):
                raise PdfError("unclosed string")
            m = PLAIN.match(d, self.at)
            out += m[0]
            self.at = m.end()
            if self.at >= len(d):
                continue
            c = d[self.at]
            self.at += 1
            if c == 0x5C and self.at < len(d):
                e = d[self.at]
                self.at += 1
                if e in plain:
                    out.append(plain[e])
                elif 48 <= e < 56:
                    m = OCTAL.match(d, self.at)
                    out.append(int(bytes([e]) + m[0], 8) & 255)
                    self.at = m.end()
                elif e not in b"\r\n":
                    out.append(e)
                continue
            depth += (c == 0x28) - (c == 0x29)
            if depth:
                out.append(c)
        return bytes(out)

    def value(self, refs: bool = True) -> Any:
        """The next object; operators come as bytes objects of type Operator."""
        self.skip()
        d = self.data
        if self.at >= len(d):
            raise PdfError("unexpected end")
        c = d[self.at : self.at + 1]
        if c == b"<" and d.startswith(b"<<", self.at):
            self.at += 2
            out: dict = {}
            while True:
                self.skip()
                if d.startswith(b">>", self.at):
                    self.at += 2
                    return out
                key = self.value(refs)
                if not isinstance(key, Name):
                    raise PdfError("a dictionary key is no name")
                out[key] = self.value(refs)
        if c == b"[":
            self.at += 1
            items = []
            while True:
                self.skip()
                if d.startswith(b"]", self.at):
                    self.at += 1
                    return items
                items.append(self.value(refs))
        if c == b"(":
            return self.literal()
        if c == b"<":
            end = d.find(b">", self.at)
            digits = d[self.at + 1 : end]
            self.at = end + 1 if end >= 0 else len(d)
            try:
                return unhexlify(digits)
            except ValueError:  # other characters between, or an odd number
                digits = NO_DIGITS.sub(b"", digits)
                return unhexlify(digits + b"0" * (len(digits) % 2))
        if c == b"/":
            self.at += 1
            name = self.word()
            return Name((ESCAPED.sub(lambda m: bytes([int(m[1], 16)]), name) if b"#" in name else name).decode("latin-1"))
        token = self.word()
        if not token:
            self.at += 1
            raise PdfError(f"unexpected {c!r}")
        if INTEGER.fullmatch(token):
            if refs:
                m = REFERENCE.match(d, self.at)
                if m:
                    self.at = m.end()
                    return Ref((int(token), int(m[1])))
            return int(token)
        if REAL.fullmatch(token):
            return float(token)
        return LITERALS[token] if token in LITERALS else Operator(token)


class Operator(bytes):
    __slots__ = ()


class Reader:
    def __init__(self, data: bytes):
        self.data, self.repairs = data, []
        self.direct: dict[int, int] = {}
        self.packed: dict[int, tuple[int, int]] = {}
        self.free: set[int] = set()
        self.trailer: dict = {}
        self.held: dict[int, Any] = {}
        if not data:
            raise PdfError("empty file")
        if b"%PDF-" not in data[:1024]:
            self.repairs.append("no header in the first kilobyte")
        try:
            self._follow()
        except (PdfError, ValueError, IndexError, zlib.error, TypeError, KeyError) as e:
            self._rebuild(str(e))

    def _follow(self) -> None:
        at = self.data.rfind(b"startxref")
        if at < 0:
            raise PdfError("no startxref")
        place = Lexer(self.data, at + 9).value(False)
        seen: set[int] = set()
        while isinstance(place, int) and place not in seen:
            seen.add(place)
            lexer = Lexer(self.data, place)
            lexer.skip()
            if self.data.startswith(b"xref", lexer.at):
                lexer.at += 4
                info = self._table(lexer)
                hybrid = info.get("XRefStm")
                if isinstance(hybrid, int):
                    self._stream(hybrid)
            else:
                info = self._stream(place)
            self.trailer = info | self.trailer
            place = info.get("Prev")
        if "Root" not in self.trailer:
            raise PdfError("no document root")

    def _table(self, lexer: Lexer) -> dict:
        while True:
            lexer.skip()
            if lexer.data.startswith(b"trailer", lexer.at):
                lexer.at += 7
                info = lexer.value()
                if not isinstance(info, dict):
                    raise PdfError("no trailer dictionary")
                return info
            first, count = lexer.value(False), lexer.value(False)
            if not isinstance(first, int) or not isinstance(count, int):
                raise PdfError("cross-reference section without numbers")
            for n in range(first, first + count):
                if m := ENTRIES.match(lexer.data, lexer.at):  # the usual form
                    lexer.at = m.end()
                    self._entry(n, m[2] == b"n", int(m[1]))
                    continue
                offset, _, kind = lexer.value(False), lexer.value(False), lexer.value(False)
                self._entry(n, kind == b"n", offset)

    def _entry(self, n: int, used: bool, offset: int) -> None:
        if n in self.direct or n in self.packed or n in self.free:
            return
        if used:
            self.direct[n] = offset
        else:
            self.free.add(n)

    def _stream(self, place: int) -> dict:
        _, x = self._object_at(place)
        if not isinstance(x, Stream) or x.info.get("Type") != "XRef":
            raise PdfError("no cross-reference at startxref")
        widths, data = x.info["W"], self.decoded(x)
        index = x.info.get("Index") or [0, x.info["Size"]]
        at = 0
        for first, count in zip(index[::2], index[1::2], strict=True):
            for n in range(first, first + count):
                fields = []
                for k, w in enumerate(widths):
                    fields.append(int.from_bytes(data[at : at + w], "big") if w else (1 if k == 0 else 0))
                    at += w
                if fields[0] == 2:
                    if n not in self.direct and n not in self.packed and n not in self.free:
                        self.packed[n] = (fields[1], fields[2])
                else:
                    self._entry(n, fields[0] == 1, fields[1])
        return x.info

    def _rebuild(self, why: str) -> None:
        self.repairs.append(f"cross-reference rebuilt: {why}")
        self.direct, self.packed, self.free = {}, {}, set()
        for m in headers(self.data):
            self.direct[int(m[1])] = m.start(1)
        for m in re.finditer(rb"trailer", self.data):
            try:
                info = Lexer(self.data, m.end()).value()
                if isinstance(info, dict):
                    self.trailer |= info
            except (PdfError, ValueError):
                continue
        if "Root" not in self.trailer:
            for n in self.direct:
                x = self.get(Ref((n, 0)))
                if isinstance(x, dict) and x.get("Type") == "Catalog":
                    self.trailer["Root"] = Ref((n, 0))
        if "Root" not in self.trailer:
            raise PdfError("no document root")

    def _object_at(self, place: int) -> tuple[int, Any]:
        if not 0 <= place < len(self.data):
            raise PdfError("offset outside the file")
        lexer = Lexer(self.data, place)
        number, generation, word = lexer.value(False), lexer.value(False), lexer.value(False)
        if not isinstance(number, int) or not isinstance(generation, int) or word != b"obj":
            raise PdfError(f"no object at offset {place}")
        x = lexer.value()
        lexer.skip()
        if isinstance(x, dict) and self.data.startswith(b"stream", lexer.at):
            start = lexer.at + 6
            start += 2 if self.data.startswith(b"\r\n", start) else 1 if self.data[start : start + 1] in (b"\n", b"\r") else 0
            length = self.get(x.get("Length"))
            if not isinstance(length, int) or not re.compile(rb"[\x00\t\n\x0c\r ]*endstream").match(self.data, start + length):
                end = self.data.find(b"endstream", start)
                if end < 0:
                    raise PdfError("unclosed stream")
                self.repairs.append(f"stream length of object {number}")
                length = end - start
            return number, Stream(x, self.data[start : start + length])
        return number, x

    def get(self, x: Any) -> Any:
        """The object itself; references are followed, missing ones are null."""
        depth = 0
        while isinstance(x, Ref):
            depth += 1
            if depth > 64:
                raise PdfError("a chain of references")
            n = x[0]
            if n not in self.held:
                if n in self.direct:
                    number, value = self._object_at(self.direct[n])
                    if number != n:
                        raise PdfError(f"object {n} is {number} at its offset")
                    self.held[n] = value
                elif n in self.packed:
                    self._unpack(self.packed[n][0])
                    self.held.setdefault(n, None)
                else:
                    self.held[n] = None
            x = self.held[n]
        return x

    def _unpack(self, container: int) -> None:
        x = self.get(Ref((container, 0)))
        if not isinstance(x, Stream):
            raise PdfError("an object stream is missing")
        data, lexer = self.decoded(x), None
        head = Lexer(data)
        pairs = [(head.value(False), head.value(False)) for _ in range(self.get(x.info["N"]))]
        for n, offset in pairs:
            if self.packed.get(n, (None,))[0] == container:
                lexer = Lexer(data, self.get(x.info["First"]) + offset)
                self.held.setdefault(n, lexer.value())

    def decoded(self, x: Stream) -> bytes:
        filters = self.get(x.info.get("Filter")) or []
        settings = self.get(x.info.get("DecodeParms")) or []
        filters = filters if isinstance(filters, list) else [filters]
        settings = settings if isinstance(settings, list) else [settings]
        data = x.data
        for i, f in enumerate(filters):
            if f not in ("FlateDecode", "Fl"):
                raise PdfError(f"unsupported filter {f}")
            data = zlib.decompressobj().decompress(data)
            own = self.get(settings[i]) if i < len(settings) else None
            if own and self.get(own.get("Predictor", 1)) >= 10:
                data = self._unpredicted(data, self.get(own.get("Columns", 1)) * self.get(own.get("Colors", 1)) * self.get(own.get("BitsPerComponent", 8)) // 8)
        return data

    @staticmethod
    def _unpredicted(data: bytes, width: int) -> bytes:
        out, above = bytearray(), bytearray(width)
        for at in range(0, len(data) - width, width + 1):
            kind, row = data[at], bytearray(data[at + 1 : at + 1 + width])
            if kind == 2:
                row = bytearray((a + b) & 255 for a, b in zip(row, above, strict=True))
            elif kind == 1:
                for i in range(1, width):
                    row[i] = (row[i] + row[i - 1]) & 255
            elif kind:
                raise PdfError("unsupported predictor")
            out += row
            above = row
        return bytes(out)

    def page_root(self) -> Any:
        root = self.get(self.trailer["Root"])
        if not isinstance(root, dict) or "Pages" not in root:
            raise PdfError("the document root has no pages")
        return root["Pages"]

    def declared(self) -> int:
        count = self.get(self.get(self.page_root())["Count"])
        if isinstance(count, bool) or not isinstance(count, int):
            raise PdfError(f"the page count is no integer: {count!r}")
        return count

    def enumerated(self, budget: int = NODE_BUDGET) -> int:
        """Leaves of type Page under the root, each node once."""
        count, seen, stack = 0, set(), [self.page_root()]
        while stack:
            if len(seen) > budget:
                raise PdfError("too many nodes")
            node = stack.pop()
            mark = tuple(node) if isinstance(node, Ref) else id(node)
            if mark in seen:
                raise PdfError("a cycle")
            seen.add(mark)
            own = self.get(node)
            kind = own.get("Type") if isinstance(own, dict) else None
            if self.get(kind) == "Page":
                count += 1
            elif self.get(kind) == "Pages":
                stack.extend(self.get(own.get("Kids")) or [])
            else:
                raise PdfError(f"unexpected node type {kind}")
        return count

    def pages(self, budget: int = NODE_BUDGET) -> list[dict]:
        """Page dictionaries in reading order, told from inner nodes by their lack of Kids; inherited resources filled in."""
        out: list[dict] = []

        def walk(node: Any, inherited: Any, depth: int) -> None:
            own = self.get(node)
            if not isinstance(own, dict) or depth > 500 or len(out) > budget:
                raise PdfError("the page list can't be flattened")
            resources = own.get("Resources", inherited)
            if "Kids" in own:
                for kid in self.get(own["Kids"]) or []:
                    walk(kid, resources, depth + 1)
            else:
                out.append(own | {"Resources": resources})

        walk(self.page_root(), None, 0)
        return out

    def metadata(self) -> dict[str, str]:
        info = self.get(self.trailer.get("Info"))
        text = lambda k: decoded_text(self.get(info.get(k))) if isinstance(info, dict) else ""
        return {"title": text("Title").strip(), "authors": text("Author").strip()}

    def _unicode_map(self, font: dict) -> tuple[dict[int, str], int]:
        x = self.get(font.get("ToUnicode"))
        if not isinstance(x, Stream):
            return {}, 1
        data, table, width = self.decoded(x), {}, 1
        if m := re.search(rb"begincodespacerange\s*<([0-9A-Fa-f]+)>", data):
            width = len(m[1]) // 2
        utf16 = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "ignore")
        for block in re.findall(rb"beginbfchar(.*?)endbfchar", data, re.S):
            for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
                table[int(a, 16)] = utf16(b)
        for block in re.findall(rb"beginbfrange(.*?)endbfrange", data, re.S):
            for a, b, c in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
                for i in range(min(int(b, 16) - int(a, 16) + 1, 65_536)):
                    table[int(a, 16) + i] = chr(int(c, 16) + i)
        return table, width

    def page_lines(self, page: dict) -> list[tuple[float, str]]:
        """(font size, text) of each line of a page, in order of the content stream."""
        contents = self.get(page.get("Contents"))
        parts = [self.get(c) for c in contents] if isinstance(contents, list) else [contents]
        data = b"\n".join(self.decoded(p) for p in parts if isinstance(p, Stream))
        fonts = self.get((self.get(page.get("Resources")) or {}).get("Font")) or {}
        maps = {name: self._unicode_map(self.get(f)) for name, f in fonts.items() if isinstance(self.get(f), dict)}
        lines: list[tuple[float, str]] = []
        line, size, table, width, stack = "", 0.0, {}, 1, []

        def show(raw: Any) -> str:
            if not isinstance(raw, bytes):
                return ""
            if not table:
                return raw.decode("latin-1")
            return "".join(table.get(int.from_bytes(raw[i : i + width], "big"), "") for i in range(0, len(raw), width))

        def end() -> None:
            nonlocal line
            if line.strip():
                lines.append((size, line.strip()))
            line = ""

        lexer = Lexer(data)
        while True:
            if m := TOKEN.match(data, lexer.at):
                lexer.at = m.end()
                kind, x = m.lastindex, m[m.lastindex]
                if kind < 4:
                    stack.append(unhexlify(x) if kind == 1 else Name(x.decode("latin-1")) if kind == 2 else int(x))
                    continue
                if x in LITERALS:
                    stack.append(LITERALS[x])
                    continue
            else:
                lexer.skip()
                if lexer.at >= len(data):
                    break
                try:
                    x = lexer.value(False)
                except PdfError:
                    stack = []
                    continue
                if not isinstance(x, Operator):
                    stack.append(x)
                    continue
            if x == b"Tf" and len(stack) >= 2:
                if stack[-1] != size:
                    end()
                size = float(stack[-1])
                table, width = maps.get(stack[-2], ({}, 1))
            elif x == b"Tj" and stack:
                line += show(stack[-1])
            elif x == b"TJ" and stack and isinstance(stack[-1], list):
                line += "".join(show(p) if isinstance(p, bytes) else " " if isinstance(p, (int, float)) and p < -200 else "" for p in stack[-1])
            elif x in (b"'", b'"') and stack:
                end()
                line += show(stack[-1])
            elif x in (b"T*", b"ET", b"Tm") or x in (b"Td", b"TD") and stack and stack[-1]:
                end()
            stack = []
        end()
        return lines

    def markdown(self) -> str:
        """Text of all pages; lines in a larger font than the commonest become headings, the largest of the first depth."""
        pages = [self.page_lines(p) for p in self.pages()]
        weight: dict[float, int] = {}
        for size, text in (x for p in pages for x in p):
            weight[size] = weight.get(size, 0) + len(text)
        if not weight:
            return ""
        body = max(weight, key=lambda s: (weight[s], -s))
        depth = {s: min(6, i + 1) for i, s in enumerate(sorted((s for s in weight if s > body), reverse=True))}
        return "\n\n".join("\n".join(f"\n{'#' * depth[s]} {t}\n" if s in depth else t for s, t in p).strip() for p in pages if p) + "\n"


def decoded_text(x: Any) -> str:
    if not isinstance(x, bytes):
        return ""
    return x[2:].decode("utf-16-be", "ignore") if x.startswith(b"\xfe\xff") else x.decode("latin-1")


def signals_of(path: str, data: bytes | None) -> dict:
    """What the parser can say of one file; `problem` tells where it stopped."""
    out: dict = {"path": path, "problem": None, "declared": None, "enumerated": None, "reader": None, "known": [], "direct": [], "packed": [], "raw": [], "repairs": [], "coverage_problem": None}
    if data is None:
        return out | {"problem": "unreadable: no content"}
    try:
        reader = Reader(data)
    except Exception as e:  # noqa: BLE001  any malformed file ends here
        return out | {"problem": f"parse-error: {e}"}
    try:
        if "Encrypt" in reader.trailer:
            out["problem"] = "encrypted: can't be verified"
            return out
        for field, step, word in (("declared", reader.declared, "page-tree-unresolvable"), ("enumerated", reader.enumerated, "page-tree-walk"), ("reader", lambda: len(reader.pages()), "reader-page-list")):
            try:
                out[field] = step()
            except Exception as e:  # noqa: BLE001
                out["problem"] = f"{word}: {e}"
                return out
        try:
            out["raw"] = [{"number": int(m[1]), "offset": m.start(1)} for m in headers(data)]
            out["known"] = sorted({*reader.direct, *reader.packed, *reader.free})
            out["direct"] = [{"number": n, "offset": o} for n, o in reader.direct.items()]
            out["packed"] = [{"number": n, "container": c, "offset": reader.direct.get(c)} for n, (c, _) in reader.packed.items()]
        except Exception as e:  # noqa: BLE001
            out["coverage_problem"] = str(e)
        return out
    finally:
        out["repairs"] = list(dict.fromkeys(reader.repairs))


_PLACE = pa.list_(pa.struct([("number", pa.int64()), ("offset", pa.int64())]))
SIGNALS_ARROW = pa.schema([
    ("path", pa.string()), ("problem", pa.string()), ("declared", pa.int32()), ("enumerated", pa.int32()), ("reader", pa.int32()), ("known", pa.list_(pa.int64())),
    ("direct", _PLACE), ("packed", pa.list_(pa.struct([("number", pa.int64()), ("container", pa.int64()), ("offset", pa.int64())]))), ("raw", _PLACE),
    ("repairs", pa.list_(pa.string())), ("coverage_problem", pa.string()),
])


def structures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over (path, content, ...): one row of signals per file, with the other columns as they are."""
    for batch in batches:
        others = [n for n in batch.schema.names if n not in ("path", "content")]
        for at in range(0, batch.num_rows, 16):  # some files at a time
            part = batch.slice(at, 16)
            rows = [signals_of(p, c) for p, c in zip(part.column("path").to_pylist(), part.column("content").to_pylist(), strict=True)]
            found = pa.RecordBatch.from_pylist(rows, schema=SIGNALS_ARROW)
            yield pa.RecordBatch.from_arrays([*found.columns, *(part.column(n) for n in others)], names=[*SIGNALS_ARROW.names, *others])


def structure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The same for mapInPandas."""
    for batch in batches:
        yield from (x.to_pandas() for x in structures(iter([pa.RecordBatch.from_pandas(batch, preserve_index=False)])))
