"""The structure of documents in SQL: functions, table functions and views, so that plain SQL needs no Python.

register(spark) makes temporary SQL functions whose bodies are built-in functions, which Spark expands into the query:

    paper_section(md, name)   paper_headings(md)   paper_body(md)   paper_references(md)   paper_tables(md)
    headings_of(md)  references_of(md)  tables_of(md)      as tables, for LATERAL joins

and cache_views(cache, backend) makes views over a cache: papers, paper_figures and paper_failures.

    SELECT p.sha16, t.caption FROM papers p, LATERAL tables_of(p.markdown) t WHERE paper_section(p.markdown, 'methods') IS NOT NULL
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from paperloom.functions.markdown import CAPTION, CAPTION_WINDOW, HEADING, MID, OPEN, REFERENCE_LENGTH, REFERENCES, SHORTEST_TABLE, SHUT, TABLE
from paperloom.functions.text import SPACES
from paperloom.operators.cache import DocCache

FOUND = "ARRAY<STRUCT<index INT, markdown STRING, caption STRING, page INT>>"


def _text(x: str) -> str:
    """A string literal that is taken as it stands."""
    return f"r'{x}'"


def _stripped(x: str) -> str:
    return f"trim(BOTH '{SPACES}' FROM {x})"


def _cut(pattern: str, mark: str) -> str:
    """The text parted before each match, whose parts are marked; noncharacters of its own are replaced first."""
    guarded = f"translate(md, '{OPEN}{MID}{SHUT}', '���')"
    return f"split(regexp_replace({guarded}, {_text(pattern)}, '{mark}'), '{OPEN}')"


def _let(name: str, value: str, body: str) -> str:
    """The body with the value computed once, wherever the optimizer moves it."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


REACH = -(-CAPTION_WINDOW // SHORTEST_TABLE) + 1
BEFORE = f"right(array_join(slice(ends, greatest(i - {REACH - 1}, 1), least(i, {REACH})), ''), {CAPTION_WINDOW})"
LINES = f"filter(transform(split(rtrim('{SPACES}', {BEFORE}), '\\n'), x -> {_stripped('x')}), x -> x RLIKE {_text(CAPTION)})"
CHAPTER = f"""named_struct('raw', substring_index(p, '{MID}', 1), 'depth', length(substring_index(substring_index(p, '{MID}', 2), '{MID}', -1)),
    'title', substring_index(substring_index(p, '{SHUT}', 1), '{MID}', -1), 'body', substring_index(p, '{SHUT}', -1))"""
CHAPTERS = _let("a", _cut(HEADING, f"{OPEN}$0{MID}$1{MID}$2{SHUT}"), f"transform(slice(a, 2, size(a)), p -> {CHAPTER})")
PLACE = f"CAST(array_position(transform(c, x -> contains(lower(x.title), {_stripped('lower(name)')})), true) AS INT)"
STOP = "CAST(array_position(transform(rest, x -> x.depth <= get(c, place - 1).depth), true) AS INT)"
INNER = "transform(if(stop > 0, slice(rest, 1, greatest(stop - 1, 0)), rest), x -> concat(x.raw, x.body))"
WITHIN = _let("rest", "slice(c, place + 1, size(c))", _let("stop", STOP, _stripped(f"concat(get(c, place - 1).body, array_join({INNER}, ''))")))
HALVES = f"split(md, {_text(REFERENCES)}, 2)"
ENTRIES = f"filter(transform(split(get(h, 1), '\\n'), x -> {_stripped('x')}), x -> length(x) > {REFERENCE_LENGTH} AND NOT startswith(x, '#'))"
ONE = f"named_struct('index', i - 1, 'markdown', {_stripped(f"substring_index(p, '{SHUT}', 1)")}, 'caption', try_element_at({LINES}, -1), 'page', 0)"
ENDS = f"transform(parts, p -> right(replace(p, '{SHUT}', ''), {CAPTION_WINDOW}))"

FUNCTIONS = [  # name, arguments, result, body
    ("paper_headings", "md STRING", "ARRAY<STRUCT<depth INT, title STRING>>", f"transform({CHAPTERS}, x -> named_struct('depth', x.depth, 'title', x.title))"),
    ("paper_section", "md STRING, name STRING", "STRING", _let("c", CHAPTERS, _let("place", PLACE, f"if(place > 0, {WITHIN}, NULL)"))),
    ("paper_body", "md STRING", "STRING", _let("h", HALVES, f"if(size(h) > 1, rtrim('{SPACES}', get(h, 0)), get(h, 0))")),
    ("paper_references", "md STRING", "ARRAY<STRING>", _let("h", HALVES, f"CASE WHEN size(h) > 1 THEN {ENTRIES} WHEN h IS NOT NULL THEN CAST(array() AS ARRAY<STRING>) END")),
    ("paper_tables", "md STRING", FOUND, _let("parts", _cut(TABLE, f"{OPEN}$0{SHUT}"), _let("ends", ENDS, f"filter(transform(parts, (p, i) -> if(i > 0, {ONE}, NULL)), t -> t IS NOT NULL)"))),
]
# Generators over the bodies themselves: Spark makes them part of the outer query, row by row, where a subquery between would be joined by text.
BODIES = {name: body for name, _, _, body in FUNCTIONS}
TABLES = [
    ("headings_of", "md STRING", "pos INT, depth INT, title STRING", f"SELECT inline(transform({BODIES['paper_headings']}, (x, i) -> named_struct('pos', i, 'depth', x.depth, 'title', x.title)))"),
    ("references_of", "md STRING", "pos INT, entry STRING", f"SELECT posexplode({BODIES['paper_references']}) AS (pos, entry)"),
    ("tables_of", "md STRING", "index INT, markdown STRING, caption STRING, page INT", f"SELECT inline({BODIES['paper_tables']})"),
]


def register(spark: SparkSession) -> None:
    """Makes the functions in this session; those of the same names are replaced."""
    for name, arguments, result, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {body}")
    for name, arguments, result, body in TABLES:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS TABLE({result}) RETURN {body}")


def cache_views(cache: DocCache, backend: str) -> None:
    """Views of a cache as it is now: papers (sha16, markdown, title, authors, n_pages, backend, doc), paper_figures (sha16, index, page,
    caption, path) and paper_failures (sha16, problem)."""
    x = cache.entries(backend).withColumnRenamed("cached", "doc")
    meta = F.col("doc.metadata")
    x.select("sha16", "doc.markdown", meta["title"].alias("title"), meta["authors"].alias("authors"), meta["n_pages"].alias("n_pages"), "doc.backend", "doc").createOrReplaceTempView("papers")
    path = F.concat(F.lit(f"{cache.figure_folder(backend)}/"), "sha16", F.lit("/"), "f.image_path")
    x.select("sha16", F.explode("doc.figures").alias("f")).select("sha16", "f.index", "f.page", "f.caption", path.alias("path")).createOrReplaceTempView("paper_figures")
    cache.failures(backend).createOrReplaceTempView("paper_failures")
