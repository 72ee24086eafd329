"""Token counts, license scans, URL filters and mixing against brute force on small fixtures."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from paperloom.llm import components, licenses, mixing, queries, tokens, urls
from paperloom.llm.queries import RULES, tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, size int, target string, __key int"
ODD = [None, "", " ", "\n", "a", "MIT License mit license MIT-License", "x " * 3000, "é" * 2000, "<|endoftext|> a <|endoftext|>\n\nb  c", "a b \x1c c\n\n d", "don't  can't 'll"]


def docs(spark, texts):
    rows = [(i, t, None, None if i % 7 == 0 else f"s{i % 3}", i, "x", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + rows[-1:], DOCS)


def test_tokens_equal_the_librarys_on_whole_texts(spark):
    from tokenizers import Tokenizer

    rng = random.Random(3)
    alphabet = ["a", "B", "é", " ", "  ", "\n", "\t", "1", "'s", ".", " ", " ", "\x1c", "\x85", "<|endoftext|>", "字", "!!", " the"]
    texts = ODD + ["".join(rng.choices(alphabet, k=rng.randrange(60))) for _ in range(400)]
    own = Tokenizer.from_file(tokenizer_path())
    got = tokens.count_tokens(docs(spark, texts), tokenizer_path()).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        t = texts[r.doc_id] or ""
        assert (r.n_bytes, r.n_tokens) == (len(t.encode()), len(own.encode(t, add_special_tokens=False).ids)), t
        assert r.over_limit == (r.n_tokens > 512)


def test_long_texts_are_counted_in_windows(monkeypatch):
    monkeypatch.setattr(tokens, "BATCH_BYTES", 50)
    c = tokens.Counter(tokenizer_path())
    texts = ["one two three " * 40, "short", "", "nospacesatall" * 30, "é字 " * 40, "é" * 26]
    seen = []
    encode = c.tokenizer.encode_batch_fast
    monkeypatch.setattr(c, "tokenizer", type("T", (), {"encode": c.tokenizer.encode, "encode_batch_fast": lambda _, b, **k: seen.append(b) or encode(b, **k)})())
    assert c.counts(texts) == [len(c.tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]
    # batches hold at most about BATCH_BYTES bytes, whatever the characters
    assert len(seen) > 3 and all(len("".join(b[:-1]).encode()) < 50 for b in seen)


def test_token_counts_of_odd_tables(spark):
    empty = tokens.count_tokens(docs(spark, ["a"]).limit(0), tokenizer_path())
    assert empty.count() == 0 and empty.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    clash = spark.createDataFrame([(None, "a b", "n", 1, 2)] * 2 + [(1, None, None, None, None)], "doc_id long, text string, n_tokens string, n_bytes int, __text int")
    got = tokens.count_tokens(clash, tokenizer_path()).collect()
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in got) == [(0, 3, 2), (0, 3, 2), (1, 0, 0)]


def words_of(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(str.maketrans(licenses.UPPER, licenses.LOWER)))


def runs_at(text):
    w = words_of(text)
    return [tuple(w[k : k + 3]) for k in range(len(w) - 2)]


def meets(text, templates=licenses.TEMPLATES):
    """(label, first run place of the block, shared runs) of every block that holds four fifths of a template's runs."""
    own, out = runs_at(text), set()
    for label, x in templates.items():
        want = set(runs_at(x))
        size = 1
        while size < len(words_of(x)):
            size *= 2
        for at in range(0, max(1, len(own)), size):
            shared = len(want & set(own[at : at + 2 * size]))
            if shared and shared >= math.ceil(0.8 * len(want) - 1e-9):
                out.add((label, at, shared))
    return out


def license_fixture():
    rng = random.Random(15)
    parts = ["MIT", "license", "Apache", "general", "public", "\n", "v2", "-", "É", "Released under the MIT License.", "Licensed under CC BY-NC 4.0.", "licensed under the apache license version 2"]
    texts, meant = [*ODD, "Released under the A License", "Licensed under the Apache License,\nVersion 2.0"], {}
    meant[len(texts) - 1] = "apache-notice"
    texts += [" ".join(rng.choices(parts, k=rng.randrange(12))) for _ in range(120)]
    for label, t in licenses.TEMPLATES.items():
        for cut in (0, 0, 0.05, 0.3):
            words = [w for w in t.split() if rng.random() >= cut]
            mark = rng.choice(["\n", "\n * ", "\n# ", "\r\n// "])
            before, after = (" ".join(rng.choices(["the", "of", "software", "word"], k=rng.randrange(0, 400))) for _ in range(2))
            texts.append(before + " Copyright 2020 x" + mark + "".join(w + (mark if rng.random() < 0.2 else " ") for w in words) + "end " + after)
            if not cut:
                meant[len(texts) - 1] = label
    return texts, meant


def test_license_scan_equals_brute_force(spark):
    texts, meant = license_fixture()
    rows = licenses.scan(docs(spark, texts)).collect()
    assert len(rows) == len(texts) + 1
    got = {r.doc_id: r for r in rows}
    for i, t in enumerate(texts):
        w = words_of(t)
        at = [(k, label) for p, label in licenses.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        base = {label for _, label in at}
        met = {}
        for label, _, shared in meets(t):
            met[label] = max(met.get(label, 0), shared / len(set(runs_at(licenses.TEMPLATES[label]))))
        r = got[i]
        assert (r.n_words, r.n_base) == (len(w), len(at)), t
        assert (r.first_word, r.last_word) == ((min(at)[0], max(at)[0]) if at else (None, None)), t
        assert r.base_labels == ",".join(sorted(base)) and r.labels == ",".join(sorted(base | set(met))), t
        assert r.score == pytest.approx(max([1.0 if at else 0.0, *met.values()]))
    assert all(label in got[i].labels.split(",") and got[i].score == 1 for i, label in meant.items())
    assert got[len(ODD)].labels == ""  # four of a notice's five words are not the notice


def test_licenses_of_repeated_and_null_keys_are_each_texts_own(spark):
    notice = licenses.TEMPLATES["cc-by-nc-notice"]
    rows = [(1, "nothing here at all"), (1, notice), (1, notice), (None, notice), (None, None), (2, "plain")]
    got = sorted((str(r.doc_id), r.labels, r.score) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert sorted(x[0] for x in got if x[2] == 1) == ["1", "1", "None"] and all((x[2] == 1) == ("cc-by-nc-notice" in x[1]) for x in got)


def test_license_blocks_and_filters(spark):
    texts, _ = license_fixture()
    frame = docs(spark, texts).union(docs(spark, [None]).selectExpr("cast(null as long) doc_id", "'released under the mit license' text", "lang", "source", "size", "target", "__key"))
    got = licenses.meeting_blocks(frame).collect()
    want = {(i, *x) for i, t in enumerate(texts) for x in meets(t)} | {(None, "mit-notice", 0, 3)}
    assert {(r.doc_id, r.label, r.start, r.n_shared) for r in got} == want and len(got) == len(want)
    blocks, index = licenses.block_sets(frame, licenses.TEMPLATES, 0.8, "doc_id", "text")
    kept, all_ = licenses.candidates(blocks, index).count(), licenses.candidates(blocks, index, positional=False).count()
    assert len(want) <= kept < all_  # the positional filter removes pairs that the other filters leave
    every = index.select("label", "n", "need", "x").distinct().collect()
    assert {r.label for r in every} == set(licenses.TEMPLATES) and all(r.x == sorted(r.x) for r in every)
    hits = licenses.written(frame.selectExpr("doc_id", "text"), "test-license")
    places = {}
    for t in hits.collect():
        for run in runs_at(t.text):
            places[run] = places.get(run, 0) + 1
    for r in every:  # rarest first
        counts = sorted(places.get(run, 0) for run in set(runs_at(licenses.TEMPLATES[r.label])))
        assert len(r.x) == len(counts)


def test_license_scan_of_nothing(spark):
    assert licenses.scan(docs(spark, ["a"]).limit(0)).count() == 0
    assert licenses.scan(docs(spark, ["mit license"]), templates={}).first().labels == "mit"
    with pytest.raises(ValueError):
        licenses.meeting_blocks(docs(spark, ["a"]), {"short": "two words"})


PAGES = [
    None, "", "no scheme", "http://A.Example.NET/en/x?q=/y#z", "https://example.net", "http://net/", "http://xexample.net/de/", "http://a.example.com/de/1",
    "http://a.example.com/DE/1", "ftp://x.org/fr/://b", "http://b.org?x=/fr/", "http://c.org#/fr/", "http://d.co.uk/", "http://host:80/p", "//x.net/",
]


def test_rules_and_hosts(spark):
    pages = spark.createDataFrame([(i, u, "h", 1) for i, u in enumerate(PAGES)], "page_id long, url string, html string, host int")
    none = spark.createDataFrame([], "page_id long, bad int")
    got = {r.page_id: r for r in urls.filter_urls(pages, none, RULES).collect()}
    assert len(got) == len(PAGES)
    for i, u in enumerate(PAGES):
        m = re.search(r"://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fits = [(len(r), r, a) for a, r in RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
        want = max(fits, default=(0, None, "allow"))
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, want[1], want[2]), u
    joined = urls.with_rule(pages.select("page_id", urls.host_of(pages.url).alias("host"), urls.path_of(pages.url).alias("path")), RULES, inline=0)
    assert {r.page_id: r.rule for r in joined.collect()} == {i: r.rule for i, r in got.items()}


def test_reputation_shrinks_and_blocks(spark):
    rows = [(i, f"http://h{i % 40}.a.com/{i}") for i in range(4000)] + [(5000 + i, "http://bad.b.com/") for i in range(100)] + [(6000, "http://one.a.com/"), (6001, "http://new.b.com/")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    bad = spark.createDataFrame([(i, int(i // 40 % 20 == 0) if i < 4000 else 1) for i, _ in rows if i != 6001], "page_id long, bad int")
    got = {r.page_id: r for r in urls.filter_urls(pages, bad, (), 2.0).collect()}
    assert got[5000].verdict == "block" and got[1].verdict == "allow"
    assert got[6000].verdict == "allow" and got[6000].bad_rate < 1  # one bad page says little
    assert got[6001].n_labelled == 0 and got[6001].bad_rate > got[1].bad_rate  # from its registered domain


def test_suffixes_and_domains(spark):
    hosts = {"a.b.co.uk": ("co.uk", "b.co.uk"), "x.edu.au": ("edu.au", "x.edu.au"), "gov.in": ("gov.in", "gov.in"), "www.example.com": ("com", "example.com"), "com.example": ("example", "com.example"), "localhost": ("localhost", "localhost"), "": ("", ""), "a.b.city.kawasaki.jp": ("jp", "kawasaki.jp")}
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    x = df.select("host", urls.suffix_of(F.col("host")).alias("s")).withColumn("d", urls.domain_of(F.col("host"), F.col("s")))
    assert {r.host: (r.s, r.d) for r in x.collect()} == hosts
    x = df.select("host", urls.suffix_of(F.col("host"), ("kawasaki.jp", "city.kawasaki.jp", "example")).alias("s")).withColumn("d", urls.domain_of(F.col("host"), F.col("s")))
    assert {r.host: (r.s, r.d) for r in x.collect()}["a.b.city.kawasaki.jp"] == ("city.kawasaki.jp", "b.city.kawasaki.jp")


def test_planted_bad_host_is_blocked_by_the_query(spark, tmp_path, monkeypatch):
    """Through the registered query: one bad host among ordinary ones, a hot host, rules that win, repeated and empty rows."""
    monkeypatch.setattr(components, "HOT_ROWS", 100)
    rng = random.Random(9)
    pages = [(i, f"https://h{i % 30}.site{i % 6}.example.com/p{i}") for i in range(1500)] + [(i, f"https://bad.site1.example.com/{i}") for i in range(1500, 1560)] + [(i, f"https://hot.example.org/{i}") for i in range(1560, 2600)]
    pages += [(2600, "https://bad.site1.example.com/de/x"), (2601, None), (1501, pages[1501][1]), (2602, "https://a.bad.net/")]
    labels = [(i, int(rng.random() < 0.9) if not 1500 <= i < 1560 else 0, 0) for i in range(2600) if i % 2]
    spark.createDataFrame(pages, "page_id long, url string").repartition(5).write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame(labels + [(2601, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = queries.QUERIES["op2_url_filter"](spark, str(tmp_path)).collect()
    assert len(rows) == len(pages)
    by = {}
    for r in rows:
        by.setdefault((r.host, r.rule), set()).add(r.verdict)
    assert by.pop(("bad.site1.example.com", None)) == {"block"} and by.pop(("bad.site1.example.com", "example.com/de/")) == {"block"} and by.pop(("a.bad.net", "net/")) == {"block"}
    assert all(v == {"allow"} for v in by.values())
    spark.createDataFrame([], "page_id long, url string").write.mode("overwrite").parquet(f"{tmp_path}/pages.parquet")
    assert queries.QUERIES["op2_url_filter"](spark, str(tmp_path)).count() == 0


def test_mix_meets_targets(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 60)), rng.choice(["a", "b", "b", "b", "b", None, "é", "d"]), 1) for i in range(3000)] + [(7, None, "a", 1), (8, "", "only-empty", 2)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string, rest int"), (5, 2, 1)).collect()
    assert len(got) == len(rows)
    size, target, taken = {}, {}, {}
    for r in got:
        size[r.source] = size.get(r.source, 0) + r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
        assert r.taken <= 3 * r["size"] and r.source_size >= r["size"]
    names = sorted(size, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    want, left, open_ = {}, float(sum(size.values())), set(names)
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * size[s] + 1e-9}
        if not over:
            break
        for s in over:
            want[s] = 3.0 * size[s]
            left -= want[s]
        open_ -= over
    want |= share
    for s in names:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - target[s]) <= 60, s
    again = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string, rest int").repartition(7), (5, 2, 1)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string"), (1,)).count() == 0
