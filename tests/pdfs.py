"""Writes small PDF files for tests."""

import zlib


def objects_of(pages: list[list[tuple[int, str]]], count=None, kids=None, title="A Title", extra=None) -> dict[int, bytes]:
    """Objects of a document whose pages are lists of (font size, line)."""
    n = len(pages)
    numbers = [4 + 2 * i for i in range(n)]
    kids = " ".join(f"{k} 0 R" for k in numbers) if kids is None else kids
    objects = {
        1: b"<< /Type /Catalog /Pages 2 0 R >>",
        2: f"<< /Type /Pages /Kids [{kids}] /Count {n if count is None else count} /Resources << /Font << /F1 3 0 R >> >> >>".encode(),
        3: b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>",
    }
    for k, lines in zip(numbers, pages, strict=True):
        text = "BT\n" + "\n".join(f"/F1 {size} Tf ({line}) Tj 0 -14 Td" for size, line in lines) + "\nET"
        data = zlib.compress(text.encode("latin-1"))
        objects[k] = f"<< /Type /Page /Parent 2 0 R /Contents {k + 1} 0 R >>".encode()
        objects[k + 1] = b"<< /Length %d /Filter /FlateDecode >>\nstream\n" % len(data) + data + b"\nendstream"
    objects[4 + 2 * n] = f"<< /Title ({title}) /Author (Ann Author) >>".encode()
    return objects | (extra or {})


def written(objects: dict[int, bytes], trailer: str = "", before: bytes = b"") -> bytes:
    """A file with a cross-reference table; `before` is junk ahead of the header that offsets don't count."""
    out = bytearray(b"%PDF-1.4\n")
    at = {}
    for n, body in sorted(objects.items()):
        at[n] = len(out)
        out += b"%d 0 obj\n" % n + body + b"\nendobj\n"
    start, size = len(out), max(objects) + 1
    info = max(objects) if b"/Title" in objects[max(objects)] else None
    out += b"xref\n0 %d\n0000000000 65535 f \n" % size
    for n in range(1, size):
        out += b"%010d 00000 n \n" % at[n] if n in at else b"0000000000 00000 f \n"
    out += f"trailer\n<< /Size {size} /Root 1 0 R {f'/Info {info} 0 R' if info else ''} {trailer} >>\nstartxref\n{start}\n%%EOF\n".encode()
    return before + bytes(out)


def simple(n_pages: int = 3, **more) -> bytes:
    pages = [[(20, f"Heading {i}"), (10, f"Some body text of page {i} that is long enough to count as the usual size of letters."), (10, "And one more line.")] for i in range(n_pages)]
    return written(objects_of(pages, **more))


def updated(base: bytes, objects: dict[int, bytes], stale: bool = False) -> bytes:
    """An incremental update; a stale one points its startxref at the old cross-reference."""
    old = int(base.rsplit(b"startxref", 1)[1].split()[0])
    out = bytearray(base)
    at = {}
    for n, body in objects.items():
        at[n] = len(out)
        out += b"%d 0 obj\n" % n + body + b"\nendobj\n"
    start = len(out)
    out += b"xref\n" + b"".join(b"%d 1\n%010d 00000 n \n" % (n, o) for n, o in at.items())
    out += f"trailer\n<< /Size {max([*at, 40]) + 1} /Root 1 0 R /Prev {old} >>\nstartxref\n{old if stale else start}\n%%EOF\n".encode()
    return bytes(out)


def packed(n_pages: int = 2) -> bytes:
    """A file with an object stream and a cross-reference stream."""
    objects = objects_of([[(10, "packed page")] for _ in range(n_pages)])
    inside = {n: b for n, b in objects.items() if b"stream" not in b}
    outside = {n: b for n, b in objects.items() if b"stream" in b}
    head, body = "", b""
    for n, b in inside.items():
        head += f"{n} {len(body)} "
        body += b + b" "
    container, table = max(objects) + 1, max(objects) + 2
    data = zlib.compress(head.encode() + body)
    outside[container] = b"<< /Type /ObjStm /N %d /First %d /Length %d /Filter /FlateDecode >>\nstream\n" % (len(inside), len(head), len(data)) + data + b"\nendstream"
    out, at = bytearray(b"%PDF-1.5\n"), {}
    for n, b in outside.items():
        at[n] = len(out)
        out += b"%d 0 obj\n" % n + b + b"\nendobj\n"
    at[table] = len(out)
    rows = b"\x00" * 7
    for n in range(1, table + 1):
        if n in at:
            rows += b"\x01" + at[n].to_bytes(4, "big") + b"\x00\x00"
        else:
            rows += b"\x02" + container.to_bytes(4, "big") + list(inside).index(n).to_bytes(2, "big")
    rows = zlib.compress(rows)
    out += b"%d 0 obj\n<< /Type /XRef /Size %d /W [1 4 2] /Root 1 0 R /Length %d /Filter /FlateDecode >>\nstream\n" % (table, table + 1, len(rows)) + rows + b"\nendstream\nendobj\n"
    return bytes(out) + b"startxref\n%d\n%%%%EOF\n" % at[table]
