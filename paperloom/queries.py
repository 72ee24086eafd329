"""The registered queries over the driver's tables, each with an independently written SQL form.

The tables hold plain prose, so documents are first carried into Markdown by the same concatenation on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.cli import figure_lines, printed, table_lines
from paperloom.functions import keys, markdown
from paperloom.operators import preflight
from paperloom.operators.cache import doc_json, parsed_doc
from paperloom.operators.extract import routed
from paperloom.plans import bulk

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


# Carrier: literals and columns, the same on both sides. The whole text stands once as a section and once as the lines of a reference list.
CARRIER: list = [
    "# Doc ", "doc_id", "\n\n## Introduction\n\nOf ", "source", ".\n\n## Methods\n\n### Detail of methods\n\n", "text",
    "\n\n## Results\n\nTable ", "doc_id", ": Sizes of it.\n\n| field | value |\n|:---|---:|\n| lang | ", "lang", " |\n| chars | ", "n_chars",
    " |\n\nSome lines that part the tables.\n\n| source |\n|--------|\n| ", "source", " |\n\nEnd of results.\n\n## **References**\n\n", "text", "\nshort\n# not an entry of the list\n- one more entry of the list, from ", "source", "\n",
]
COLUMNS = {"doc_id", "lang", "n_chars", "source", "text"}


def carrier() -> Column:
    return F.concat(*[F.coalesce(F.col(x).cast("string"), F.lit("")) if x in COLUMNS else F.lit(x) for x in CARRIER])


def _sql(x: str) -> str:
    return f"coalesce(CAST({x} AS VARCHAR), '')" if x in COLUMNS else "E'" + x.replace("\n", "\\n") + "'"


CARRIED_SQL = f"carried AS (SELECT doc_id, lang, source, n_chars, {' || '.join(_sql(x) for x in CARRIER)} AS md FROM documents)"
LINES_SQL = rf"""{CARRIED_SQL},
split AS (SELECT doc_id, string_split(md, E'\n') AS a FROM carried),
numbered AS (SELECT doc_id, unnest(a) AS line, generate_subscripts(a, 1) AS ln FROM split),
lines AS (SELECT *, CASE WHEN regexp_matches(line, '^\s{{0,3}}#{{1,6}}\s+\S') THEN length(regexp_extract(line, '^\s*(#+)', 1)) END AS depth,
  trim(regexp_extract(line, '^\s*#+\s+(.*)$', 1), E' \t') AS title FROM numbered)"""
WHITE = r"E' \n\t\r'"


def carried(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", "lang", "source", "n_chars", carrier().alias("md"))


def long(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


@query(f"WITH {LINES_SQL} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ln) - 1 AS pos, CAST(depth AS BIGINT) AS depth, title FROM lines WHERE depth IS NOT NULL")
def headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = carried(spark, sf_dir).select("doc_id", F.posexplode(markdown.headings(F.col("md"))).alias("pos", "h"))
    return x.select("doc_id", long("pos").alias("pos"), long("h.depth").alias("depth"), F.col("h.title").alias("title"))


@query(f"WITH {LINES_SQL} SELECT CAST(depth AS BIGINT) AS depth, count(*) AS n FROM lines WHERE depth IS NOT NULL GROUP BY ALL")
def heading_depth_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return carried(spark, sf_dir).select(F.explode(markdown.headings(F.col("md"))).alias("h")).groupBy(long("h.depth").alias("depth")).agg(F.count("*").alias("n"))


def section_sql(needle: str) -> str:
    return f"""WITH {LINES_SQL},
found AS (SELECT doc_id, min(ln) AS at, arg_min(depth, ln) AS d FROM lines WHERE depth IS NOT NULL AND contains(lower(title), '{needle}') GROUP BY doc_id),
ends AS (SELECT f.doc_id, f.at, min(l.ln) AS stop FROM found f LEFT JOIN lines l ON l.doc_id = f.doc_id AND l.ln > f.at AND l.depth <= f.d GROUP BY ALL),
bodies AS (SELECT e.doc_id, string_agg(l.line, E'\\n' ORDER BY l.ln) AS t FROM ends e JOIN lines l ON l.doc_id = e.doc_id AND l.ln > e.at AND (e.stop IS NULL OR l.ln < e.stop) GROUP BY e.doc_id)
SELECT e.doc_id, coalesce(trim(b.t, {WHITE}), '') AS section_text FROM ends e LEFT JOIN bodies b USING (doc_id)"""


def _section(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: carried(spark, sf_dir).select("doc_id", markdown.section(F.col("md"), name).alias("section_text")).where(F.col("section_text").isNotNull())


for _name, _needle in (("section_methods", "Methods"), ("section_nested_parent", "doc "), ("section_detail", " DETAIL OF "), ("section_missing", "acknowledgements")):
    QUERIES[_name] = _section(_needle)
    ORACLES[_name] = section_sql(_needle.lower().strip())

REFS_SQL = rf"""{LINES_SQL},
heads AS (SELECT doc_id, min(ln) AS at FROM lines WHERE regexp_matches(line, '(?i)^\s{{0,3}}#{{1,6}}\s+\**\s*(references|bibliography|works\s+cited|literature\s+cited)\s*\**\s*$') GROUP BY doc_id)"""
ENTRIES_SQL = f"{REFS_SQL}, entries AS (SELECT l.doc_id, l.ln, trim(l.line, {WHITE}) AS entry FROM lines l JOIN heads h ON l.doc_id = h.doc_id AND l.ln > h.at WHERE length(trim(l.line, {WHITE})) > 20 AND left(trim(l.line, {WHITE}), 1) <> '#')"


@query(f"WITH {REFS_SQL} SELECT l.doc_id, rtrim(string_agg(l.line, E'\\n' ORDER BY l.ln), {WHITE}) AS body FROM lines l LEFT JOIN heads h ON l.doc_id = h.doc_id WHERE h.at IS NULL OR l.ln < h.at GROUP BY l.doc_id")
def reference_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    return carried(spark, sf_dir).select("doc_id", markdown.body_without_references(F.col("md")).alias("body"))


@query(f"WITH {ENTRIES_SQL} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ln) - 1 AS pos, entry FROM entries")
def reference_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = carried(spark, sf_dir).select("doc_id", F.posexplode(markdown.references(F.col("md"))).alias("pos", "entry"))
    return x.select("doc_id", long("pos").alias("pos"), "entry")


@query(f"WITH {ENTRIES_SQL} SELECT c.doc_id, count(e.ln) AS n_refs FROM carried c LEFT JOIN entries e USING (doc_id) GROUP BY c.doc_id")
def reference_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return carried(spark, sf_dir).select("doc_id", long(F.size(markdown.references(F.col("md")))).alias("n_refs"))


# Tables as islands of pipe lines: a header, a separator, and ln0 least one row.
TABLES_SQL = rf"""{LINES_SQL},
piped AS (SELECT *, line LIKE '|%|' AND length(line) > 1 AS pipe, regexp_matches(line, '^\|[\s:|-]+\|$') AS sep FROM lines),
islands AS (SELECT *, ln - row_number() OVER (PARTITION BY doc_id, pipe ORDER BY ln) AS island FROM piped),
blocks AS (SELECT doc_id, island, min(ln) AS ln0, count(*) AS n, count(*) FILTER (WHERE sep) AS seps, string_agg(line, E'\n' ORDER BY ln) AS t FROM islands WHERE pipe GROUP BY doc_id, island),
tabs AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ln0) - 1 AS idx, ln0, t FROM blocks WHERE n >= 3 AND seps >= 1)"""
CAPTIONS_SQL = rf"""{TABLES_SQL},
befores AS (SELECT t.doc_id, t.idx, right(coalesce(string_agg(l.line, E'\n' ORDER BY l.ln), ''), 300) AS w FROM tabs t LEFT JOIN lines l ON l.doc_id = t.doc_id AND l.ln < t.ln0 GROUP BY ALL),
wlines AS (SELECT doc_id, idx, unnest(string_split(w, E'\n')) AS line, generate_subscripts(string_split(w, E'\n'), 1) AS ln FROM befores),
caps AS (SELECT doc_id, idx, arg_max(trim(line, {WHITE}), ln) AS caption FROM wlines WHERE regexp_matches(trim(line, {WHITE}), '(?i)^(table\s+\d+[.:]|tbl\.?\s*\d+)') GROUP BY ALL)"""


def _tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return carried(spark, sf_dir).select("doc_id", F.explode(markdown.tables(F.col("md"))).alias("t"))


@query(f"WITH {TABLES_SQL} SELECT doc_id, idx, t AS table_md FROM tabs")
def table_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tables(spark, sf_dir).select("doc_id", long("t.index").alias("idx"), F.col("t.markdown").alias("table_md"))


@query(f"WITH {CAPTIONS_SQL} SELECT t.doc_id, t.idx, c.caption FROM tabs t LEFT JOIN caps c USING (doc_id, idx)")
def table_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tables(spark, sf_dir).select("doc_id", long("t.index").alias("idx"), F.col("t.caption").alias("caption"))


@query(f"WITH {CAPTIONS_SQL} SELECT t.doc_id, t.idx, '--- table ' || t.idx || CASE WHEN coalesce(c.caption, '') = '' THEN '' ELSE '  (' || c.caption || ')' END || ' (page 0) ---' || E'\\n' || t.t || E'\\n' AS printed FROM tabs t LEFT JOIN caps c USING (doc_id, idx)")
def cli_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return carried(spark, sf_dir).select("doc_id", F.posexplode(table_lines(markdown.tables(F.col("md")))).alias("idx", "printed")).select("doc_id", long("idx").alias("idx"), "printed")


NAMES_SQL = "names AS (SELECT doc_id, unnest(['page_' || (doc_id % 13) || '_image_1.png', 'page-' || (doc_id % 7) || '.png', '_page_' || (doc_id % 7) || '_Figure_1.jpeg', 'page' || (doc_id % 13) || '.png', 'fig' || (doc_id % 7) || '.png']) AS name FROM documents)"
FIGURES_SQL = f"{NAMES_SQL}, figs AS (SELECT doc_id, name, row_number() OVER (PARTITION BY doc_id ORDER BY name) - 1 AS idx, coalesce(TRY_CAST(regexp_extract(name, '^page[_-]?([0-9]+)', 1) AS BIGINT), 0) AS page FROM names)"


def _figure_names() -> Column:
    m, k = (F.col("doc_id") % 13).cast("string"), (F.col("doc_id") % 7).cast("string")
    lit = F.lit
    return F.array(F.concat(lit("page_"), m, lit("_image_1.png")), F.concat(lit("page-"), k, lit(".png")), F.concat(lit("_page_"), k, lit("_Figure_1.jpeg")), F.concat(lit("page"), m, lit(".png")), F.concat(lit("fig"), k, lit(".png")))


@query(f"WITH {FIGURES_SQL} SELECT doc_id, idx, name, page FROM figs")
def figure_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = documents(spark, sf_dir).select("doc_id", F.explode(markdown.figures(_figure_names())).alias("f"))
    return x.select("doc_id", long("f.index").alias("idx"), F.col("f.image_path").alias("name"), long("f.page").alias("page"))


@query(f"WITH {FIGURES_SQL} SELECT doc_id, idx, 'figure ' || idx || ': ' || name || ' (page ' || page || ')' AS printed FROM figs")
def cli_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.posexplode(figure_lines(markdown.figures(_figure_names()))).alias("idx", "printed")).select("doc_id", long("idx").alias("idx"), "printed")


@query("SELECT DISTINCT 'k' || (doc_id % 97) || lang AS citekey FROM documents WHERE doc_id % 3 <> 0")
def bib_citekeys(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, key = F.col("doc_id"), F.concat(F.lit("k"), (F.col("doc_id") % 97).cast("string"), F.col("lang"))
    bib = F.concat(F.lit("@string{jan = {January}}\n  @article { "), key, F.lit(" ,\n title={@misc{inner, x}}\n}\n"))
    bib = F.when(d % 3 == 0, F.lit("@comment none\n text @article{inline, a}\n")).otherwise(bib)
    return documents(spark, sf_dir).select(F.explode(keys.citekeys(bib)).alias("citekey")).distinct()


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN source || '/' || doc_id || '.pdf' ELSE 'x/All Papers/' || doc_id || '.pdf' END AS path FROM documents")
def attachment_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("All Papers/"), F.col("source"), F.lit("/"))).otherwise(F.lit("x/All Papers/")), F.col("doc_id").cast("string"), F.lit(".pdf"))
    return documents(spark, sf_dir).select("doc_id", keys.attachment_path(name).alias("path"))


@query("SELECT doc_id, substr(sha1(coalesce(text, '')), 1, 16) AS sha16 FROM documents")
def content_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed(spark, sf_dir).select("doc_id", "sha16")


@query("SELECT doc_id, sha256(coalesce(text, '')) AS sha256 FROM documents")
def sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("sha256"))


def keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).withColumn("sha16", keys.content_key(F.coalesce("text", F.lit("")).cast("binary")))


@query("SELECT doc_id, CASE WHEN length(coalesce(text, '')) >= 100 THEN 'pymupdf4llm' ELSE 'marker' END AS backend, length(coalesce(text, '')) AS n FROM documents")
def auto_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    thick, thin = routed(x, markdown=F.col("text"))
    n = long(F.length("text")).alias("n")
    return thick.select("doc_id", F.lit(keys.FAST).alias("backend"), n).unionByName(thin.select("doc_id", F.lit(keys.STRUCTURED).alias("backend"), n))


@query("SELECT doc_id, coalesce(text, '') AS markdown, lang AS title, n_chars AS n_pages, CAST(NULL AS VARCHAR) AS auto_fallback, CAST(1 AS BIGINT) AS n_refs FROM documents")
def doc_json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.struct(
        F.coalesce("text", F.lit("")).alias("markdown"), F.array(F.struct(F.lit(0).alias("index"), F.lit("a/b.png").alias("image_path"), F.lit(None).cast("string").alias("caption"), F.lit(3).alias("page"))).alias("figures"),
        F.array(F.struct(F.col("source").alias("raw"))).alias("references"), F.struct(F.col("lang").alias("title"), F.col("n_chars").cast("int").alias("n_pages")).alias("metadata"), F.lit(keys.FAST).alias("backend"),
    )
    x = documents(spark, sf_dir).select("doc_id", parsed_doc(doc_json(doc)).alias("d"))
    return x.select("doc_id", F.col("d.markdown").alias("markdown"), F.col("d.metadata.title").alias("title"), long("d.metadata.n_pages").alias("n_pages"), F.col("d.metadata.auto_fallback").alias("auto_fallback"), long(F.size("d.references")).alias("n_refs"))


# The queue: documents stand for library entries (ord by doc_id, created by n_chars, missing for some), good labels for cited keys.
ENTRIES = "entries AS (SELECT doc_id AS ord, CAST(doc_id AS VARCHAR) AS citekey, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE n_chars END AS created, substr(sha1(coalesce(text, '')), 1, 16) AS sha16, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS is_hot FROM documents)"
QUEUE_SQL = f"{ENTRIES}, cached AS (SELECT sha16 FROM entries WHERE ord % 17 = 0), blocked AS (SELECT citekey FROM entries WHERE ord % 19 = 0), free AS (SELECT * FROM entries WHERE sha16 NOT IN (SELECT sha16 FROM cached) AND citekey NOT IN (SELECT citekey FROM blocked))"


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = keyed(spark, sf_dir).select(F.col("doc_id").alias("ord"), F.col("doc_id").cast("string").alias("citekey"), F.when(F.col("doc_id") % 11 != 0, F.col("n_chars")).alias("created"), "sha16")
    return bulk.with_priority(x, _cited(spark, sf_dir))


def _cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").cast("string").alias("citekey"))


def _sides(x: DataFrame) -> tuple[DataFrame, DataFrame]:
    return x.where("ord % 17 = 0"), x.where("ord % 19 = 0")


@query("SELECT doc_id AS ord FROM documents SEMI JOIN (SELECT doc_id FROM labels WHERE quality = 1) USING (doc_id)")
def queue_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bulk.hot(_entries(spark, sf_dir), _cited(spark, sf_dir)).select("ord")


@query("SELECT doc_id AS ord FROM documents ANTI JOIN (SELECT doc_id FROM labels WHERE quality = 1) USING (doc_id)")
def queue_other(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bulk.long_tail(_entries(spark, sf_dir), _cited(spark, sf_dir)).select("ord")


def _ranked(x: DataFrame, prioritised: bool) -> DataFrame:
    """Places from 1 in the order of the queue; the whole order is numbered by ranges, not in one task."""
    return bulk.placed(x, prioritised).select("place", "ord", "citekey")


PRIORITY = "ORDER BY is_hot DESC, CASE WHEN is_hot THEN 0 ELSE -coalesce(created, 0) END, ord"


@query(f"WITH {ENTRIES} SELECT row_number() OVER ({PRIORITY}) AS place, ord, citekey FROM entries")
def queue_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(_entries(spark, sf_dir), True)


@query(f"WITH {ENTRIES} SELECT row_number() OVER (ORDER BY ord) AS place, ord, citekey FROM entries")
def queue_unprioritised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(_entries(spark, sf_dir), False)


@query(f"WITH {QUEUE_SQL} SELECT row_number() OVER ({PRIORITY}) AS place, ord, citekey FROM free QUALIFY place <= 200")
def queue_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _entries(spark, sf_dir)
    cached, blocked = _sides(x)
    return _ranked(bulk.queue(x, cached, blocked, 200), True)


@query(f"WITH {QUEUE_SQL} SELECT count(*) FILTER (WHERE is_hot) AS n_hot, count(*) FILTER (WHERE NOT is_hot) AS n_other, count(*) FILTER (WHERE sha16 IN (SELECT sha16 FROM cached)) AS n_cached, count(*) FILTER (WHERE sha16 NOT IN (SELECT sha16 FROM cached) AND citekey IN (SELECT citekey FROM blocked)) AS n_blocked FROM entries")
def queue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _entries(spark, sf_dir)
    return bulk.queue_sizes(x, *_sides(x))


@query("SELECT doc_id AS ord, CASE WHEN doc_id % 4 = 1 THEN 'b' ELSE 'a' END || doc_id || '.pdf' AS path FROM documents WHERE doc_id % 4 <> 3")
def resolve_attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    ids = F.col("doc_id").cast("string")
    att = lambda mime, name: F.struct(F.lit(mime).alias("mimeType"), name.alias("filename"))
    a, b = F.concat(F.lit("All Papers/a"), ids, F.lit(".pdf")), F.concat(F.lit("b"), ids, F.lit(".pdf"))
    none = F.lit(None).cast("array<struct<mimeType:string,filename:string>>")
    library = d.select(F.col("doc_id").alias("ord"), ids.alias("citekey"), F.col("n_chars").cast("double").alias("created"), F.when(F.col("doc_id") % 4 != 3, F.array(att("text/html", b), att(bulk.PDF, a), att(bulk.PDF, b))).otherwise(none).alias("attachments"))
    there = d.select(F.explode(F.when(F.col("doc_id") % 4 == 1, F.array(b)).otherwise(F.array(F.substring(a, 12, 99), b))).alias("name"))
    return bulk.resolved(library, there.select("name", F.col("name").alias("path"))).select("ord", "path")


@query("SELECT event_type AS status, count(*) AS n FROM events GROUP BY event_type")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bulk.counters(table(spark, sf_dir, "events").select(F.col("event_type").alias("status")))


RAW_SQL = r"raws AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN coalesce(text, '') WHEN 1 THEN coalesce(text, '') || E'%%EOF\n \r\n' WHEN 2 THEN E'%%EOF a%%EOF' || lang WHEN 3 THEN '%%EOF' || chr(11) ELSE 'x%%EOF' END AS raw FROM documents)"


@query(rf"WITH {RAW_SQL}, tails AS (SELECT doc_id, CASE WHEN contains(raw, '%%EOF') THEN list_extract(string_split(raw, '%%EOF'), -1) ELSE '' END AS tail FROM raws) SELECT doc_id, CASE WHEN length(translate(tail, E' \n\r\t\f', '')) > 0 THEN length(tail) ELSE 0 END AS n_trailing FROM tails")
def trailing_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    text, kind, eof = F.coalesce("text", F.lit("")), F.col("doc_id") % 5, "%%EOF"
    raw = F.when(kind == 0, text).when(kind == 1, F.concat(text, F.lit(eof + "\n \r\n"))).when(kind == 2, F.concat(F.lit(f"{eof} a{eof}"), F.col("lang"))).when(kind == 3, F.lit(eof + "\x0b")).otherwise("x" + eof)
    return documents(spark, sf_dir).select("doc_id", long(preflight.trailing_bytes(raw)).alias("n_trailing"))


@query(r"SELECT doc_id, unnest(list_sort(list_distinct([doc_id, doc_id + 2, CAST(7 AS BIGINT)]))) AS number FROM documents")
def object_header_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    s = lambda c: c.cast("string")
    raw = F.concat(s(d), F.lit(" 0 obj<<>>endobj\r"), F.lit("+000"), s(d + 2), F.lit(" 0%note\nobj [] x"), s(d + 3), F.lit(" 0 obj 7 0 obj\n8 0 objx 9 0 R"))
    return documents(spark, sf_dir).select("doc_id", F.explode(preflight.object_numbers(raw)).alias("number"))


@query("""WITH s AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE doc_id % 4 END AS d, CASE WHEN doc_id % 5 = 0 THEN 1 ELSE doc_id % 4 END AS e, doc_id % 4 AS r, doc_id % 3 = 0 AS repaired, doc_id % 2 = 0 AS vetoed FROM documents)
SELECT doc_id, CASE WHEN d IS NULL THEN 'UNAVAILABLE' WHEN NOT (d = e AND e = r) THEN 'FAIL' WHEN d <= 0 OR repaired OR vetoed THEN 'UNAVAILABLE' ELSE 'PASS' END AS verdict FROM s""")
def preflight_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    return documents(spark, sf_dir).select("doc_id", preflight.verdict(F.when(d % 7 != 0, d % 4), F.when(d % 5 == 0, 1).otherwise(d % 4), d % 4, d % 3 == 0, d % 2 == 0).alias("verdict"))


@query("SELECT projection, CASE projection WHEN 'text' THEN 'auto' WHEN 'references' THEN 'pymupdf4llm' WHEN 'metadata' THEN 'pymupdf4llm' ELSE 'marker' END AS backend FROM (SELECT unnest(['text', 'section', 'tables', 'figures', 'references', 'metadata']) AS projection)")
def backend_per_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(p,) for p in keys.BACKEND_OF], "projection string").withColumn("backend", keys.backend_of(F.col("projection")))


# The same rows through SQL alone: spark.sql over views, with the functions of paperloom.functions.sql.
def _by_sql(name: str, sql: str, like: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from paperloom.functions.sql import register

        register(spark)
        carried(spark, sf_dir).createOrReplaceTempView("carried_documents")
        return spark.sql(sql)

    QUERIES[name] = run
    ORACLES[name] = ORACLES[like]


_by_sql("sql_headings", "SELECT d.doc_id, CAST(h.pos AS BIGINT) AS pos, CAST(h.depth AS BIGINT) AS depth, h.title FROM carried_documents d, LATERAL headings_of(d.md) h", "headings")
_by_sql("sql_section_methods", "SELECT doc_id, paper_section(md, 'Methods') AS section_text FROM carried_documents WHERE paper_section(md, 'Methods') IS NOT NULL", "section_methods")
_by_sql("sql_section_detail", "SELECT * FROM (SELECT doc_id, paper_section(md, ' DETAIL OF ') AS section_text FROM carried_documents) WHERE section_text IS NOT NULL", "section_detail")
_by_sql("sql_reference_body", "SELECT doc_id, paper_body(md) AS body FROM carried_documents", "reference_body")
_by_sql("sql_reference_entries", "SELECT d.doc_id, CAST(r.pos AS BIGINT) AS pos, r.entry FROM carried_documents d, LATERAL references_of(d.md) r", "reference_entries")
_by_sql("sql_table_blocks", "SELECT d.doc_id, CAST(t.index AS BIGINT) AS idx, t.markdown AS table_md FROM carried_documents d, LATERAL tables_of(d.md) t", "table_blocks")
_by_sql("sql_table_captions", "SELECT d.doc_id, CAST(t.index AS BIGINT) AS idx, t.caption FROM carried_documents d, LATERAL tables_of(d.md) t", "table_captions")


PRINTED_SQL = rf"""SELECT doc_id, 'text' AS what, body || E'\n' AS printed FROM ({ORACLES['reference_body']}) UNION ALL SELECT doc_id, 'section', section_text || E'\n' FROM ({ORACLES['section_methods']})
UNION ALL SELECT doc_id, 'references', string_agg(entry || E'\n', '' ORDER BY pos) FROM ({ORACLES['reference_entries']}) GROUP BY doc_id
UNION ALL SELECT doc_id, 'tables', string_agg(printed || E'\n', '' ORDER BY idx) FROM ({ORACLES['cli_tables']}) GROUP BY doc_id"""


@query(PRINTED_SQL)
def cli_printed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the command line prints of every document: text, section, references and tables."""
    md = F.col("md")
    refs = F.transform(markdown.references(md), lambda r: F.struct(r.alias("raw")))
    x = carried(spark, sf_dir).select("doc_id", F.struct(markdown.body_without_references(md).alias("markdown"), refs.alias("references")).alias("doc"))
    x = x.withColumn("doc", F.col("doc").withField("tables", markdown.tables(F.col("doc.markdown"))))
    rows = [F.struct(F.lit(w).alias("what"), printed(F.col("doc"), w, "methods").alias("printed")) for w in ("text", "section", "references", "tables")]
    return x.select("doc_id", F.explode(F.array(*rows)).alias("p")).select("doc_id", "p.what", "p.printed")
