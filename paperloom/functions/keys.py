"""Keys: content addresses, citation keys, attachment paths, routing by projection."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.functions.text import SPACE

EXTRACT_VERSION = "0.1.0"
FAST, STRUCTURED, RESERVED = "pymupdf4llm", "marker", "docling"
THIN = 100
MAILBOX_FOLDER = "All Papers/"
CITEKEY = rf"(?md)^{SPACE}*@[\p{{L}}\p{{N}}_]+{SPACE}*\{{{SPACE}*([^,{SPACE[1:-1]}]+){SPACE}*,"
# The backend that each projection asks for.
BACKEND_OF = {"text": "auto", "section": STRUCTURED, "tables": STRUCTURED, "figures": STRUCTURED, "references": FAST, "metadata": FAST}


def content_key(content: Column) -> Column:
    """The first 16 hexadecimal digits of the SHA-1 of bytes."""
    return F.substring(F.sha1(content), 1, 16)


def entry_name(sha16: Column, backend: Column, version: Column) -> Column:
    return F.concat(sha16, F.lit("_"), backend, F.lit("_v"), version)


def citekeys(bib: Column) -> Column:
    """array<string>: the keys of BibTeX entries at line starts, as they stand."""
    return F.regexp_extract_all(bib, F.lit(CITEKEY), F.lit(1))


def attachment_path(filename: Column) -> Column:
    """Without one leading folder of the library's mailbox."""
    return F.when(filename.startswith(MAILBOX_FOLDER), F.substring(filename, len(MAILBOX_FOLDER) + 1, 1 << 30)).otherwise(filename)


def is_thin(markdown: Column, least: int = THIN) -> Column:
    return F.length(markdown) < least


def backend_of(projection: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in BACKEND_OF.items() for x in kv])[projection]
