"""Structure mining against a restatement in Python's re, and keys."""

import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from paperloom import queries
from paperloom.functions import keys, markdown
from paperloom.functions import sql as sql_functions
from paperloom.operators import preflight

# The patterns that say what a heading, a reference heading, a table and a caption are.
HEADING = re.compile(r"^\s{0,3}(#{1,6})\s+(.+?)\s*$", re.M)
REFS = re.compile(r"^\s{0,3}#{1,6}\s+\**\s*(?:references|bibliography|works\s+cited|literature\s+cited)\s*\**\s*$", re.M | re.I)
TABLE = re.compile(r"(?:\n|^)((?:\|[^\n]*\|\n)(?:\|[\s:|-]+\|\n)(?:\|[^\n]*\|\n)+)", re.M)
CAPTION = re.compile(r"table\s+\d+[.:]|tbl\.?\s*\d+", re.I)
BITS = [
    "# ", "## ", "### ", "#", "\n", "\n", "\n\n", "Methods", "intro", "# References\n", "## **works\ncited**\n", "**", "bibliography", "| a | b |\n", "|---|---|\n", "| a |\n|:-:|\n| 1 |\n", "| 1 | 2 |\n",
    "Table 1. cap\n", "TABLE\t2: x\n", "tbl.5\n", "Tbl 4\n", "Table A1: no\n", "\t", " ", "    ", "\x1c", "\x0b", "\xa0", " ", " ", "\x85", "\U0001f600", "x" * 25, "y" * 120 + "\n", "\r", "|", "٠", "ſ",
]
EDGES = [
    "#\n\n# Foo", "####### no\n#nospace\n    # four\n\t# tab", "References\n\nx", "# 7 References\n", "# references cited\n" + "z" * 30, "#  ** BIBLIOGRAPHY ** \n" + "z" * 21 + "\n# sub " + "q" * 30 + "\n" + "z" * 20,
    "| a |\n|---|\n| 1 |", "| a |\n|---|\n| 1 |\n| 2 |", "| a | \n|---|\n| 1 |\n", "| a |\r\n|---|\r\n| 1 |\r\n", "a\n| a |\n|---|\n| 1 |\n# References\n", "Table 1: c\n\n| a |\n|---|\n| 1 |\n\n| b |\n|---|\n| 2 |\n", "", "# A\n## B\nb\n# C\nc", "|\n" * 3 + "| a |\n|" + "-|" * 500 + "\n| 1 |\n",
]


def sections(md, name):
    hits = list(HEADING.finditer(md))
    for i, m in enumerate(hits):
        if name.lower().strip() in m[2].lower():
            return md[m.end() : next((n.start() for n in hits[i + 1 :] if len(n[1]) <= len(m[1])), len(md))].strip()
    return None


def split(md):
    m = REFS.search(md)
    if not m:
        return md, []
    return md[: m.start()].rstrip(), [x for x in map(str.strip, md[m.end() :].split("\n")) if len(x) > 20 and not x.startswith("#")]


def tables(md):
    out = []
    for m in TABLE.finditer(md):
        lines = [x.strip() for x in md[max(0, m.start() - 300) : m.start()].rstrip().split("\n")]
        out.append((len(out), m[1].strip(), next((x for x in reversed(lines) if CAPTION.match(x)), None), 0))
    return out


@pytest.mark.parametrize("seed", [7, 11])
def test_mining_equals_re(spark, seed):
    rng = random.Random(seed)
    texts = EDGES + ["".join(rng.choices(BITS, k=rng.randrange(1, 30))) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, md string").repartition(4)
    md = F.col("md")
    got = df.select(
        "id", markdown.section(md, " METHODS ").alias("s"), markdown.section(md, "").alias("e"), markdown.references(md).alias("r"),
        markdown.body_without_references(md).alias("b"), markdown.tables(md).alias("t"), markdown.headings(md).alias("h"),
    ).collect()
    for x in got:
        t = texts[x.id]
        assert x.s == sections(t, " METHODS ") and x.e == sections(t, ""), repr(t)
        assert (x.b, x.r) == split(t), repr(t)
        assert [(y["index"], y.markdown, y.caption, y.page) for y in x.t] == tables(t), repr(t)
        assert [(y.depth, y.title) for y in x.h] == [(len(m[1]), m[2]) for m in HEADING.finditer(t)], repr(t)


def test_very_many_tables_take_linear_time(spark):
    def took(n):
        md = "".join(f"Table {i}. t\n\n| a |\n|---|\n| {i} |\n\n" for i in range(n))
        df = spark.createDataFrame([(md,)], "md string").repartition(1)
        began = time.monotonic()
        got = df.select(markdown.tables(F.col("md")).alias("t")).first().t
        assert len(got) == n and all(t.caption == f"Table {i}. t" for i, t in enumerate(got))
        return time.monotonic() - began

    took(100)
    assert took(3200) < 6


def test_schemas_are_those_of_documents(spark):
    import paperloom
    from paperloom.operators.cache import parsed_doc

    got = spark.createDataFrame([('{"markdown": "x"}',)], "j string").select(parsed_doc(F.col("j")).alias("d")).schema["d"].dataType
    assert got.simpleString() == paperloom.ExtractedDoc.simpleString()
    assert paperloom.ExtractedDoc["figures"].dataType.elementType == paperloom.ExtractedFigure
    assert {"extract", "section", "ExtractedDoc", "ExtractedFigure", "ExtractedTable", "ExtractedReference", "EXTRACT_VERSION", "__version__"} == set(paperloom.__all__)


def test_sentinels_and_nulls(spark):
    df = spark.createDataFrame([(0, "# M﷐\nx"), (1, None)], "id int, md string")
    md = F.col("md")
    got = {r.id: r for r in df.select("id", markdown.section(md, "m").alias("s"), markdown.tables(md).alias("t"), markdown.references(md).alias("r"), markdown.body_without_references(md).alias("b")).collect()}
    assert got[0].s == "x" and got[0].t == []
    assert got[1].s is None and got[1].t is None and got[1].b is None and got[1].r is None


def test_keys_and_names(spark):
    row = spark.createDataFrame([("All Papers/All Papers/x.pdf", bytearray(b"abc"))], "f string, c binary").select(
        keys.attachment_path(F.col("f")).alias("a"), keys.content_key(F.col("c")).alias("k"), keys.entry_name(F.lit("k"), F.lit("b"), F.lit("1")).alias("e"),
        markdown.figures(F.array(*[F.lit(x) for x in ("page_2_a", "page_10_a", "_page_3", "Page4", "page-12.png")])).alias("f"),
        keys.citekeys(F.lit("@a{x1,\n @b {y-2 ,}\n@string{j = {J}}\nin @c{no,}\n@d{\nz,")).alias("b"),
    ).first()
    assert row.a == "All Papers/x.pdf" and row.k == hashlib.sha1(b"abc").hexdigest()[:16] and row.e == "k_b_v1"
    assert [(x["index"], x.image_path, x.page) for x in row.f] == [(0, "Page4", 0), (1, "_page_3", 0), (2, "page-12.png", 12), (3, "page_10_a", 10), (4, "page_2_a", 2)]
    assert row.b == ["x1", "y-2", "z"]


def test_object_headers_in_bytes(spark):
    rng = random.Random(2)
    pattern = re.compile(rb"(?:^|(?:[\x00\t\n\x0c\r ]|%[^\r\n]*[\r\n]))(?:[\x00\t\n\x0c\r ]|%[^\r\n]*[\r\n])*([+-]?0*[0-9]{1,10})(?:[\x00\t\n\x0c\r ]|%[^\r\n]*[\r\n])+[+-]?0*[0-9]{1,10}(?:[\x00\t\n\x0c\r ]|%[^\r\n]*[\r\n])+obj(?![A-Za-z0-9_])")
    bits = [b"1", b"23", b" ", b"\r", b"\x00", b"%c\n", b"0", b"+", b"obj", b"\xe9", b"x", b"%%EOF", b"\x0b", b" 0 obj", b"\n7 0 obj"]
    blobs = [b"".join(rng.choices(bits, k=rng.randrange(1, 25))) for _ in range(2000)]
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(blobs)], "id int, c binary").withColumn("s", preflight.latin1(F.col("c")))
    for r in df.select("id", preflight.object_numbers(F.col("s")).alias("n"), preflight.trailing_bytes(F.col("s")).alias("t")).collect():
        b = blobs[r.id]
        assert r.n == sorted({int(m[1]) for m in pattern.finditer(b)}), b
        tail = b[b.rfind(b"%%EOF") + 5 :] if b"%%EOF" in b else b""
        assert r.t == (len(tail) if tail.translate(None, b"\x00\t\n\x0c\r ") else 0), b


def test_entry_points(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_whole_texts_are_mined(spark, tmp_path):
    late = "pad pad\n" * 400 + "# Late one\nlate line with more than twenty\n\nTable 9: late.\n\n| a |\n|---|\n| 1 |\n\nend"
    texts = [late, None, "short"]
    spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda name: entry.queries()[name](spark, str(tmp_path)).collect()
    md = {r.doc_id: r.md for r in queries.carried(spark, str(tmp_path)).collect()}
    assert all(md[i].count(t or "") >= 2 for i, t in enumerate(texts))
    found = {i: [(len(m[1]), m[2]) for m in HEADING.finditer(t)] for i, t in md.items()}
    assert (1, "Late one") in found[0]
    assert sorted((r.doc_id, r.pos, r.depth, r.title) for r in run("headings")) == sorted((i, k, *h) for i, hs in found.items() for k, h in enumerate(hs))
    assert {r.depth: r.n for r in run("heading_depth_counts")} == {d: sum(h[0] == d for hs in found.values() for h in hs) for d in (1, 2, 3)}
    for name, needle in (("methods", "methods"), ("nested_parent", "doc "), ("detail", "detail of")):
        assert {r.doc_id: r.section_text for r in run(f"section_{name}")} == {i: sections(t, needle) for i, t in md.items()}
    assert {r.doc_id: r.body for r in run("reference_body")} == {i: split(t)[0] for i, t in md.items()}
    assert sorted((r.doc_id, r.pos, r.entry) for r in run("reference_entries")) == sorted((i, k, x) for i, t in md.items() for k, x in enumerate(split(t)[1]))
    assert {r.doc_id: r.n_refs for r in run("reference_counts")} == {i: len(split(t)[1]) for i, t in md.items()}
    blocks = sorted((i, k, t, c) for i, x in md.items() for k, t, c, _ in tables(x))
    assert (0, 0, "| a |\n|---|\n| 1 |", "Table 9: late.") in blocks
    assert sorted((r.doc_id, r.idx, r.table_md) for r in run("table_blocks")) == [x[:3] for x in blocks]
    assert sorted((r.doc_id, r.idx, r.caption) for r in run("table_captions")) == [(i, k, c) for i, k, _, c in blocks]
    assert len(run("cli_tables")) == len(blocks)


def test_sql_functions_equal_the_column_functions(spark):
    from paperloom.functions import sql

    rng = random.Random(41)
    parts = ["# ", "## ", "###", "   # ", "\t# ", "Methods", "methods of it", "References", "**References**", "works\ncited", "\n", "\n\n", " ", "| a | b |\n", "|---|---|\n", "|:-|\n", "| 1 | 2 |\n", "Table 3. A caption", "tbl. 4", "x" * 30, "\u2003", "\x1c", "\ufdd0", "[1] an entry that is long enough for it", "é", "'", "\\"]
    texts = [None, "", *("".join(rng.choices(parts, k=rng.randrange(1, 40))) for _ in range(400))]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, md string")
    df.createOrReplaceTempView("fuzzed")
    sql.register(spark)
    got = spark.sql("SELECT id, paper_section(md, ' Methods') AS s, paper_headings(md) AS h, paper_body(md) AS b, paper_references(md) AS r, paper_tables(md) AS t FROM fuzzed")
    md = F.col("md")
    want = df.select("id", markdown.section(md, " Methods").alias("s"), markdown.headings(md).alias("h"), markdown.body_without_references(md).alias("b"), markdown.references(md).alias("r"), markdown.tables(md).alias("t"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    rows = spark.sql("SELECT f.id, t.index, t.caption FROM fuzzed f, LATERAL tables_of(f.md) t").collect()
    assert sorted((r[0], r[1]) for r in rows) == sorted((r["id"], x["index"]) for r in want.collect() for x in r["t"] or [])
    sql.register(spark)  # again, over the same names


def test_table_functions_are_part_of_the_outer_query(spark):
    """A join by the text would shuffle every document; a null text has no rows, equal ones each have theirs."""
    rows = [(i, f"# A {i % 2}\n\n| a |\n|---|\n| 1 |\n\n# References\n\n" + "x" * 30) for i in range(4)] + [(4, None), (5, "")]
    spark.createDataFrame(rows, "id long, md string").createOrReplaceTempView("texts_of_a_test")
    sql_functions.register(spark)
    for name, each in (("headings_of", 2), ("references_of", 1), ("tables_of", 1)):
        x = spark.sql(f"SELECT t.id, f.* FROM texts_of_a_test t, LATERAL {name}(t.md) f")
        plan = x._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "Exchange" not in plan
        assert sorted(r.id for r in x.collect()) == sorted(list(range(4)) * each)
