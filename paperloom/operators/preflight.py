"""Read-integrity preflight of PDF files: structural signals per file, then a verdict as one column expression.

Signals come from bytes (native expressions over Latin-1 text, whose code points equal byte offsets) and from a parser
(paperloom.sources.pdf). The verdict is PASS, FAIL or UNAVAILABLE; a document problem never raises.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.text import let
from paperloom.sources.shared import written

SCHEMA = "pdf_read_preflight/1"
TOOL = "paperloom-preflight"
PASS, FAIL, UNAVAILABLE = "PASS", "FAIL", "UNAVAILABLE"
# What parts and begins an object in a file's bytes, and its end mark.
SEPARATOR = r"(?:[\x00\t\n\x0c\r ]|%[^\r\n]*[\r\n])"
NUMBER = r"[+-]?0*[0-9]{1,10}"
OBJECT = rf"(?:\A|{SEPARATOR}){SEPARATOR}*({NUMBER}){SEPARATOR}+{NUMBER}{SEPARATOR}+obj(?![A-Za-z0-9_])"
MARK = "%%EOF"


def latin1(content: Column) -> Column:
    return F.decode(content, "ISO-8859-1")


def trailing_bytes(raw: Column) -> Column:
    """Number of bytes after the last end-of-file marker if any is not PDF white space (NUL, TAB, LF, FF, CR, SP), else 0; 0 without a marker."""
    tail = F.substring_index(raw, MARK, -1)
    return F.when(raw.contains(MARK) & tail.rlike(r"[^\x00\t\n\x0c\r ]"), F.length(tail)).otherwise(0)


def object_numbers(raw: Column) -> Column:
    """Sorted distinct object numbers of all raw object headers in the bytes, whether the cross-reference names them or not."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(raw, F.lit(OBJECT), F.lit(1)), lambda x: x.try_cast("bigint"))))


def first_five(numbers: Column) -> Column:
    return F.slice(F.array_sort(numbers), 1, 5)


def verdict(declared: Column, enumerated: Column, reader: Column, repaired: Column, vetoed: Column) -> Column:
    """Any missing count: UNAVAILABLE. Counts that disagree: FAIL, also with warnings. No pages, repairs or a veto: UNAVAILABLE. Else PASS."""
    known = declared.isNotNull() & enumerated.isNotNull() & reader.isNotNull()
    return (
        F.when(~known, UNAVAILABLE)
        .when((declared != enumerated) | (enumerated != reader), FAIL)
        .when((declared <= 0) | F.coalesce(repaired, F.lit(False)) | F.coalesce(vetoed, F.lit(False)), UNAVAILABLE)
        .otherwise(PASS)
    )


SIGNALS = (
    "path string, problem string, declared int, enumerated int, reader int, known array<bigint>, "
    "direct array<struct<number:bigint,offset:bigint>>, packed array<struct<number:bigint,container:bigint,offset:bigint>>, "
    "raw array<struct<number:bigint,offset:bigint>>, repairs array<string>, coverage_problem string"
)


def coverage(signals: DataFrame, key: str = "id") -> DataFrame:
    """One row per file with objects: `key`, and orphaned, superseded, displaced: sorted numbers of objects whose newest copy in the
    bytes the active cross-reference doesn't reach.

    orphaned: in the bytes but not in the cross-reference. superseded: stored directly, with a later copy than the referenced one;
    only judged if some referenced offset is a raw one (else offsets are shifted by leading junk). displaced: stored in an
    object stream, with a direct copy after that stream.

    Raw and referenced objects are rows of one list, merged by one aggregation over (file, number), so the work is linear in the
    number of objects and a large file is spread over many tasks.
    """
    entry = "array<struct<kind:string,number:bigint,at:bigint>>"

    def tagged(kind: str) -> Column:
        row = lambda number, at: F.struct(F.lit(kind).alias("kind"), number.alias("number"), at.alias("at"))
        if kind == "known":
            return F.transform(kind, lambda n: row(n, F.lit(None).cast("bigint")))
        return F.transform(kind, lambda x: row(x["number"], x["offset"]))

    rows = [F.coalesce(tagged(kind), F.array().cast(entry)) for kind in ("raw", "direct", "packed", "known")]
    # whether a referenced offset is a raw one: strings, whose sets are hashed, of the same object's place in both lists
    place = lambda kind: F.transform(F.coalesce(F.col(kind), F.array().cast("array<struct<number:bigint,offset:bigint>>")), lambda x: F.concat_ws(":", x["number"].cast("string"), x["offset"].cast("string")))
    objects = signals.select(key, F.arrays_overlap(place("raw"), place("direct")).alias("calibrated"), F.explode(F.concat(*rows)).alias("o"))
    of = lambda kind: F.when(F.col("o.kind") == kind, F.col("o.at"))
    merged = objects.groupBy(key, F.col("o.number").alias("number")).agg(
        F.max(of("raw")).alias("latest"), F.bool_or("calibrated").alias("calibrated"), F.max(of("direct")).alias("direct"), F.max(of("packed")).alias("stream"), F.bool_or(F.col("o.kind") == "known").alias("known"))
    there = F.col("latest").isNotNull()
    listed = lambda holds: F.sort_array(F.collect_list(F.when(there & holds, F.col("number"))))
    out = merged.groupBy(key).agg(
        F.bool_or("calibrated").alias("calibrated"), listed(~F.col("known")).alias("orphaned"),
        listed(F.col("latest") > F.col("direct")).alias("superseded"), listed(F.col("direct").isNull() & (F.col("latest") > F.col("stream"))).alias("displaced"))
    return out.select(key, "orphaned", F.when(F.col("calibrated"), F.col("superseded")).otherwise(F.array().cast("array<bigint>")).alias("superseded"), "displaced")


def preflight(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """One sidecar per file: schema, verdict, file, sha256, the three counts, warnings, generated_at, tool.

    A null content stands for a file that can't be read. Nulls, empty files and files that are no PDF are UNAVAILABLE.
    Each file is read once: hashed, looked through for trailing bytes and parsed in one pass, whose signals are written.
    """
    from paperloom.sources.pdf import structures

    own = files.select(F.col(path).alias("path"), F.col(content).alias("content"), F.sha2(content, 256).alias("sha256"), let(latin1(F.col(content)), trailing_bytes).alias("trailing"))
    signals = own.mapInArrow(structures, f"{SIGNALS}, sha256 string, trailing int").withColumn("id", F.monotonically_increasing_id())
    signals = written(signals, "preflight-signals")
    x = signals.drop("known", "direct", "packed", "raw").join(coverage(signals), "id", "left")
    listed = lambda c: F.concat(F.lit("["), F.array_join(first_five(F.col(c)).cast("array<string>"), ", "), F.lit("]"))
    some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    veto = (F.coalesce("trailing", F.lit(0)) > 0) | some("orphaned") | some("superseded") | some("displaced")
    judged = verdict(F.col("declared"), F.col("enumerated"), F.col("reader"), some("repairs"), veto)
    warnings = F.concat(
        F.array_compact(F.array(
            F.when(F.col("trailing") > 0, F.concat(F.lit("trailing-data: "), F.col("trailing").cast("string"), F.lit(" bytes after the last end-of-file marker"))),
            F.col("problem"),
            F.when(some("orphaned"), F.concat(F.lit("xref-coverage: objects outside the cross-reference "), listed("orphaned"))),
            F.when(some("superseded"), F.concat(F.lit("xref-coverage: later copies of objects "), listed("superseded"))),
            F.when(some("displaced"), F.concat(F.lit("xref-coverage: direct copies after their object stream "), listed("displaced"))),
            F.when(F.col("coverage_problem").isNotNull(), F.concat(F.lit("xref-coverage-skipped: "), F.col("coverage_problem"))),
            F.when((F.col("declared") <= 0) & (F.col("declared") == F.col("enumerated")) & (F.col("declared") == F.col("reader")), F.lit("empty-page-tree: counts agree on no page")),
        )),
        F.coalesce(F.transform("repairs", lambda r: F.concat(F.lit("parser: "), r)), F.array().cast("array<string>")),
    )
    return x.select(
        F.lit(SCHEMA).alias("schema"), judged.alias("verdict"), F.col("path").alias("file"), "sha256", F.col("declared").alias("declared_page_count"),
        F.col("enumerated").alias("enumerated_page_count"), F.col("reader").alias("reader_page_count"), warnings.alias("warnings"), F.current_timestamp().alias("generated_at"), F.lit(TOOL).alias("tool"),
    )
