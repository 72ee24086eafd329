"""Structure mining on Markdown as column expressions: headings, sections, references, tables with captions.

Matches of a pattern are wrapped in sentinels by one regexp_replace and cut out by split, so a document is scanned once and
stays in the JVM. Sentinels are Unicode noncharacters, which texts don't carry; those that do get U+FFFD in their place.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.functions.text import SPACE, let, rstrip, strings, strip

OPEN, MID, SHUT = "\ufdd0", "\ufdd1", "\ufdd2"
REFERENCE_LENGTH = 20
CAPTION_WINDOW = 300
SHORTEST_TABLE = 10
# The patterns that say what a heading, a reference heading, a table and a caption are.
HEADING = rf"(?md)^{SPACE}{{0,3}}(#{{1,6}}){SPACE}+(.+?){SPACE}*$"
REFERENCES = rf"(?imdu)^{SPACE}{{0,3}}#{{1,6}}{SPACE}+\**{SPACE}*(?:references|bibliography|works{SPACE}+cited|literature{SPACE}+cited){SPACE}*\**{SPACE}*$"
TABLE = rf"(?md)(?:\n|^)(?:\|[^\n]*\|\n)(?:\|[{SPACE[1:-1]}:|-]+\|\n)(?:\|[^\n]*\|\n)+"
CAPTION = rf"(?iu)^(?:table{SPACE}+\p{{Nd}}+[.:]|tbl\.?{SPACE}*\p{{Nd}}+)"


def _guarded(md: Column) -> Column:
    return F.translate(md, OPEN + MID + SHUT, "\ufffd" * 3)


def _chapters(md: Column) -> Column:
    """array<struct<raw, depth, title, body>>: each heading as it stands, its depth and title, and the text up to the next one."""
    parts = F.split(F.regexp_replace(_guarded(md), HEADING, f"{OPEN}$0{MID}$1{MID}$2{SHUT}"), OPEN)
    raw = lambda p: F.substring_index(p, MID, 1)
    hashes = lambda p: F.substring_index(F.substring_index(p, MID, 2), MID, -1)
    title = lambda p: F.substring_index(F.substring_index(p, SHUT, 1), MID, -1)
    chapter = lambda p: F.struct(raw(p).alias("raw"), F.length(hashes(p)).alias("depth"), title(p).alias("title"), F.substring_index(p, SHUT, -1).alias("body"))
    return let(parts, lambda a: F.transform(F.slice(a, 2, F.size(a)), chapter))


def headings(md: Column) -> Column:
    """array<struct<depth, title>> of the ATX headings: up to three white-space characters, 1-6 `#`, white space, a title."""
    return F.transform(_chapters(md), lambda c: F.struct(c["depth"].alias("depth"), c["title"].alias("title")))


def section(md: Column, name: Column | str) -> Column:
    """Text of the first section whose lower-cased title holds the lower-cased, stripped name: up to the next heading of at most
    its depth, stripped. Null if no title does; an empty name takes the first heading."""
    needle = strip(F.lower(F.lit(name) if isinstance(name, str) else name))

    def within(chapters: Column) -> Column:
        at = F.array_position(F.transform(chapters, lambda c: F.contains(F.lower(c["title"]), needle)), F.lit(True)).cast("int")

        def body(rest: Column) -> Column:
            end = F.array_position(F.transform(rest, lambda c: c["depth"] <= F.get(chapters, at - 1)["depth"]), F.lit(True)).cast("int")
            inner = F.when(end > 0, F.slice(rest, 1, F.greatest(end - 1, F.lit(0)))).otherwise(rest)
            return strip(F.concat(F.get(chapters, at - 1)["body"], F.array_join(F.transform(inner, lambda c: F.concat(c["raw"], c["body"])), "")))

        return F.when(at > 0, let(F.slice(chapters, F.greatest(at, F.lit(1)) + 1, F.size(chapters)), body))

    return let(_chapters(md), within)


def body_without_references(md: Column) -> Column:
    """The text before the first heading that is exactly a reference heading, right-stripped; without one, the text as it is.

    All that follows leaves the body, appendices included.
    """
    return let(F.split(md, REFERENCES, 2), lambda p: F.when(F.size(p) > 1, rstrip(F.get(p, 0))).otherwise(F.get(p, 0)))


def references(md: Column, longer_than: int = REFERENCE_LENGTH) -> Column:
    """array<string>: stripped lines after the reference heading, longer than `longer_than` and not starting with `#`."""
    lines = lambda tail: F.filter(F.transform(F.split(tail, "\n"), strip), lambda x: (F.length(x) > longer_than) & ~x.startswith("#"))
    return let(F.split(md, REFERENCES, 2), lambda p: F.when(F.size(p) > 1, lines(F.get(p, 1))).when(p.isNotNull(), strings()))


def caption_in(window: Column) -> Column:
    """The last line of the text that starts like a table caption, stripped; null if none."""
    lines = F.filter(F.transform(F.split(rstrip(window), "\n"), strip), lambda x: x.rlike(CAPTION))
    return let(lines, lambda x: F.get(x, F.size(x) - 1))


def tables(md: Column, window: int = CAPTION_WINDOW) -> Column:
    """array<struct<index, markdown, caption, page>>: pipe tables of a header, a separator and at least one row, every line from
    column 0 and closed by `|`; the caption is looked for in the `window` characters before; page is always 0."""
    marked = F.split(F.regexp_replace(_guarded(md), TABLE, f"{OPEN}$0{SHUT}"), OPEN)

    # a match has at least ten characters, so the window lies within so many parts
    reach = -(-window // SHORTEST_TABLE) + 1

    def found(parts: Column) -> Column:
        tails = F.transform(parts, lambda p: F.right(F.replace(p, F.lit(SHUT), F.lit("")), F.lit(window)))

        def with_captions(ends: Column) -> Column:
            def one(p: Column, i: Column) -> Column:
                before = F.right(F.array_join(F.slice(ends, F.greatest(i - (reach - 1), F.lit(1)), F.least(i, F.lit(reach))), ""), F.lit(window))
                return F.struct((i - 1).alias("index"), strip(F.substring_index(p, SHUT, 1)).alias("markdown"), caption_in(before).alias("caption"), F.lit(0).alias("page"))

            return F.filter(F.transform(parts, lambda p, i: F.when(i > 0, one(p, i))), lambda t: t.isNotNull())

        return let(tails, with_captions)

    return let(marked, found)


def figure_page(name: Column) -> Column:
    """The number after a leading `page`, `page_` or `page-`; else 0."""
    return F.coalesce(F.regexp_extract(name, r"\Apage[_-]?([0-9]+)", 1).try_cast("int"), F.lit(0))


def figures(names: Column) -> Column:
    """array<struct<index, image_path, caption, page>> of image names in order of code points."""
    one = lambda n, i: F.struct(i.alias("index"), n.alias("image_path"), F.lit(None).cast("string").alias("caption"), figure_page(n).alias("page"))
    return F.transform(F.array_sort(names), one)
