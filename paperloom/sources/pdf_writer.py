"""Writes small PDF files: pages of text lines, and the structural faults that the preflight looks for."""

from __future__ import annotations

from collections.abc import Sequence

Line = tuple[int, str]  # font size, text


def hex_string(text: str) -> bytes:
    """A PDF string of Latin-1 text; other characters become question marks."""
    return b"<" + text.encode("latin-1", "replace").hex().encode() + b">"


def objects_of(pages: Sequence[Sequence[Line]], title: str = "", author: str = "", count: int | None = None) -> dict[int, bytes]:
    """The objects of a document with one content stream a page; the last one holds title and author."""
    n = len(pages)
    kids = " ".join(f"{4 + 2 * i} 0 R" for i in range(n))
    objects: dict[int, bytes] = {
        1: b"<< /Type /Catalog /Pages 2 0 R >>",
        2: f"<< /Type /Pages /Kids [{kids}] /Count {n if count is None else count} /Resources << /Font << /F1 3 0 R >> >> >>".encode(),
        3: b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>",
    }
    for i, lines in enumerate(pages):
        body = b"BT\n" + b"\n".join(b"/F1 %d Tf %s Tj 0 -14 Td" % (size, hex_string(text)) for size, text in lines) + b"\nET"
        objects[4 + 2 * i] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (5 + 2 * i)
        objects[5 + 2 * i] = b"<< /Length %d >>\nstream\n%s\nendstream" % (len(body), body)
    return objects | {4 + 2 * n: b"<< /Title %s /Author %s >>" % (hex_string(title), hex_string(author))}


def pdf_bytes(pages: Sequence[Sequence[Line]], title: str = "", author: str = "", count: int | None = None, trailer: str = "", orphan: bool = False, after: bytes = b"", shift: int = 0) -> bytes:
    """A file with a cross-reference table.

    count is what the page tree declares (else the truth), trailer further entries of the trailer; orphan adds an object that the
    cross-reference doesn't know; after is what follows the end-of-file marker. shift moves all offsets of the table, by -1 to the
    line end before an object, where readers still find it.
    """
    objects = objects_of(pages, title, author, count)
    info = max(objects)
    out, at = bytearray(b"%PDF-1.4\n"), {}
    for number, body in sorted(objects.items()):
        at[number] = len(out) + shift
        out += b"%d 0 obj\n%s\nendobj\n" % (number, body)
    start = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (info + 1) + b"".join(b"%010d 00000 n \n" % at[k] for k in range(1, info + 1))
    out += f"trailer\n<< /Size {info + 1} /Root 1 0 R /Info {info} 0 R {trailer} >>\nstartxref\n{start}\n%%EOF\n".encode()
    if orphan:
        out += b"%d 0 obj\n<< /New true >>\nendobj\nstartxref\n%d\n%%%%EOF\n" % (info + 7, start)
    return bytes(out) + after


def packed_bytes(pages: Sequence[Sequence[Line]], title: str = "", author: str = "") -> bytes:
    """A file whose objects, but for streams, stand in an object stream, with a cross-reference stream."""
    objects = objects_of(pages, title, author)
    inner = [n for n, b in objects.items() if b"stream" not in b]
    places, body = [], b""
    for n in inner:
        places.append(b"%d %d " % (n, len(body)))
        body += objects[n] + b" "
    head, holder = b"".join(places), max(objects) + 1
    outer = {n: b for n, b in objects.items() if n not in inner}
    outer[holder] = b"<< /Type /ObjStm /N %d /First %d /Length %d >>\nstream\n%s\nendstream" % (len(inner), len(head), len(head + body), head + body)
    out, at = bytearray(b"%PDF-1.5\n"), {}
    for n, b in outer.items():
        at[n] = len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (n, b)
    start = at[holder + 1] = len(out)
    row = lambda kind, a, b: bytes([kind]) + a.to_bytes(4, "big") + b.to_bytes(2, "big")
    rows = b"".join(row(1, at[n], 0) if n in at else row(2, holder, inner.index(n)) if n in inner else row(0, 0, 0) for n in range(holder + 2))
    out += b"%d 0 obj\n<< /Type /XRef /Size %d /W [1 4 2] /Root 1 0 R /Length %d >>\nstream\n%s\nendstream\nendobj\n" % (holder + 1, holder + 2, len(rows), rows)
    return bytes(out) + b"startxref\n%d\n%%%%EOF\n" % start


def updated(data: bytes, objects: dict[int, bytes], stale: bool = False) -> bytes:
    """The file with an incremental update; the end of a stale one names the cross-reference before it, so it is not reached."""
    before = int(data.rsplit(b"startxref", 1)[1].split()[0])
    out, rows = bytearray(data), b""
    for n, body in objects.items():
        rows += b"%d 1\n%010d 00000 n \n" % (n, len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    start = len(out)
    out += b"xref\n%strailer\n<< /Size 100 /Root 1 0 R /Prev %d >>\nstartxref\n%d\n%%%%EOF\n" % (rows, before, before if stale else start)
    return bytes(out)
