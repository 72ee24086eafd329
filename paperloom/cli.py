"""Command line: extract one PDF and print a projection of it."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from paperloom.functions.keys import EXTRACT_VERSION
from paperloom.functions.markdown import section


def table_lines(tables: Column) -> Column:
    """array<string>: per table a header line with index, caption and page, its Markdown, and a blank line."""
    caption = lambda t: F.when(t["caption"].isNotNull() & (t["caption"] != ""), F.concat(F.lit("  ("), t["caption"], F.lit(")"))).otherwise("")
    return F.transform(tables, lambda t: F.concat(F.lit("--- table "), t["index"].cast("string"), caption(t), F.lit(" (page "), t["page"].cast("string"), F.lit(") ---\n"), t["markdown"], F.lit("\n")))


def figure_lines(figures: Column) -> Column:
    """array<string>: index, path, page and caption of each figure."""
    caption = lambda f: F.when(f["caption"].isNotNull() & (f["caption"] != ""), F.concat(F.lit("  "), f["caption"])).otherwise("")
    return F.transform(figures, lambda f: F.concat(F.lit("figure "), f["index"].cast("string"), F.lit(": "), F.coalesce(f["image_path"], F.lit("None")), F.lit(" (page "), f["page"].cast("string"), F.lit(")"), caption(f)))


def printed(doc: Column, what: str, name: str = "") -> Column:
    """What the command prints of a document struct: text, section (null if there is none), tables, figures or references."""
    ended = lambda lines: F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), "")
    return {
        "text": lambda: F.concat(doc["markdown"], F.lit("\n")),
        "section": lambda: F.concat(section(doc["markdown"], name), F.lit("\n")),
        "tables": lambda: ended(table_lines(doc["tables"])),
        "figures": lambda: ended(figure_lines(doc["figures"])),
        "references": lambda: ended(F.transform(doc["references"], lambda r: r["raw"])),
    }[what]()


def parser() -> argparse.ArgumentParser:
    # Names of arguments and flags, and their defaults.
    p = argparse.ArgumentParser(prog="paperloom", description="Extract the structure of a PDF.")
    p.add_argument("pdf_path")
    p.add_argument("--backend", choices=["auto", "pymupdf4llm", "marker"], default="auto")
    for flag in ("json", "tables", "figures", "references", "metadata", "preflight", "no-cache", "skip-ocr"):
        p.add_argument(f"--{flag}", action="store_true")
    p.add_argument("--section")
    p.add_argument("--version", action="version", version=EXTRACT_VERSION)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Of several projections the first counts: preflight, json, section, tables, figures, references, metadata, else all text."""
    args = parser().parse_args(argv)
    if not os.path.exists(args.pdf_path):
        print(f"ERROR: file not found: {args.pdf_path}", file=sys.stderr)
        return 1
    spark = spark or SparkSession.builder.appName("paperloom").getOrCreate()
    from paperloom.operators.extract import extract
    from paperloom.operators.preflight import preflight
    from paperloom.sources.files import pdf_files

    if args.preflight:
        row = preflight(pdf_files(spark, args.pdf_path)).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).first()
        print(json.dumps(json.loads(row[0]), indent=2))
        return 0
    doc = extract(spark, args.pdf_path, backend=args.backend, skip_ocr=args.skip_ocr, use_cache=not args.no_cache).select("doc")
    one = lambda c: doc.select(c).first()[0]  # noqa: E731  one document
    as_json = lambda c: print(json.dumps(json.loads(one(F.to_json(c, {"ignoreNullFields": "false"}))), indent=2))
    if args.json:
        as_json(F.col("doc"))
    elif args.section:
        body = one(printed(F.col("doc"), "section", args.section))
        if body is None:
            print(f"ERROR: section {args.section!r} not found", file=sys.stderr)
            return 2
        print(body, end="")
    elif args.metadata and not (args.tables or args.figures or args.references):
        as_json(F.col("doc.metadata"))
    else:
        what = next((w for w in ("tables", "figures", "references") if getattr(args, w)), "text")
        print(one(printed(F.col("doc"), what)), end="")
    return 0
