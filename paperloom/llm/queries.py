"""The registered queries of this subpackage, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import ann, bpe, convtrie, decontam, filteraudit, langid, licenses, linededup, mixing, neardup, tokens, toxicity, urls
from paperloom.llm._store import table

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is the quality label of the document of the same id: quality 0 is bad."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), (1 - F.col("quality")).alias("bad"))
    judged = urls.filter_urls(table(spark, sf_dir, "pages"), labels, RULES, block_lift=1.25)
    return judged.withColumns({c: F.round(c, 6) for c in ("bad_rate", "lower", "upper")})


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.dedup(docs).select("doc_id", "n_lines", "n_deleted", "first_id", "text")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.detect(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1), cap=3.0).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_classes(table(spark, sf_dir, "documents"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations are rebuilt to share starts within families of five before the trie is made."""
    return convtrie.trie(*convtrie.shared_starts(*convtrie.turns_of(table(spark, sf_dir, "conversations"))))


def op12_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    digests = {"n_tokens": F.size("ids").cast("long"), "ids_sha256": F.sha2(ids, 256), "decoded_sha256": F.sha2("decoded", 256)}
    return bpe.encode(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), columns=digests)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_nearest_neighbours": op1_nearest_neighbours,
    "op2_url_filter": op2_url_filter,
    "op3_license_scan": op3_license_scan,
    "op4_token_counts": op4_token_counts,
    "op5_line_dedup": op5_line_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_source_mix": op7_source_mix,
    "op8_language_id": op8_language_id,
    "op9_decontamination": op9_decontamination,
    "op10_near_duplicates": op10_near_duplicates,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_bpe_round_trip": op12_bpe_round_trip,
    "op13_filter_audit": op13_filter_audit,
}

# Words and shingles as lists, without hashes or signatures.
WORDS_SQL = r"string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')), ' ')"


def shingle_sql(table_name: str, key: str) -> str:
    return f"(SELECT DISTINCT {key}, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT {key}, w, unnest(range(1, len(w) - 3)) AS i FROM (SELECT {key}, {WORDS_SQL} AS w FROM {table_name})))"


OP9_SQL = f"""WITH d AS {shingle_sql('documents', 'doc_id')}, b AS {shingle_sql('benchmark', 'item_id')}, n AS (SELECT item_id, count(*) AS n_item FROM b GROUP BY item_id)
SELECT doc_id, item_id, count(*) AS n_common, n_item, CAST(count(*) AS DOUBLE) / n_item AS containment FROM d JOIN b USING (s) JOIN n USING (item_id)
GROUP BY doc_id, item_id, n_item HAVING count(*) >= 0.8 * n_item - 1e-9"""


def list_sql(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def op3_sql() -> str:
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    lower = f"translate(coalesce(text, ''), '{licenses.UPPER}', '{licenses.LOWER}')"
    phrases = ", ".join(f"('{label}', {list_sql(p.split(' '))})" for p, label in licenses.PHRASES.items())
    quoted = lambda t: t.replace("'", "''")
    templates = ", ".join(f"('{label}', '{quoted(t)}')" for label, t in licenses.TEMPLATES.items())
    return f"""WITH docs AS (SELECT doc_id, {lower} AS t FROM documents), words AS (SELECT doc_id, regexp_extract_all(t, '{word}') AS w, t FROM docs),
phrases(label, p) AS (VALUES {phrases}), templates(label, t) AS (VALUES {templates}), template_words AS (SELECT label, regexp_extract_all(translate(t, '{licenses.UPPER}', '{licenses.LOWER}'), '{word}') AS p FROM templates),
template_runs AS (SELECT label, CAST(pow(2, ceil(log2(len(p)))) AS BIGINT) AS size, list_distinct(list_transform(range(1, len(p) - 1), lambda i: array_to_string(p[i:i + 2], ' '))) AS p FROM template_words),
vocabulary AS (SELECT label, CAST(ceil(0.8 * len(p) - 1e-9) AS BIGINT) AS need, size, len(p) AS n, unnest(p) AS r FROM template_runs),
places AS (SELECT doc_id, label, unnest(list_filter(range(1, len(w) + 1), lambda i: w[i:i + len(p) - 1] = p)) - 1 AS at_word FROM words, phrases WHERE contains(t, p[1])),
base AS (SELECT doc_id, count(*) AS n_base, min(at_word) AS first_word, max(at_word) AS last_word FROM places GROUP BY doc_id),
runs AS (SELECT doc_id, i - 1 AS at_run, array_to_string(w[i:i + {licenses.RUN - 1}], ' ') AS r FROM (SELECT doc_id, w, unnest(range(1, len(w) - {licenses.RUN - 2})) AS i FROM words)),
blocks AS (SELECT doc_id, label, need, n, r, unnest([at_run // size - 1, at_run // size]) AS block FROM runs JOIN vocabulary USING (r)),
met AS (SELECT doc_id, label, count(DISTINCT r) / CAST(n AS DOUBLE) AS c FROM blocks WHERE block >= 0 GROUP BY doc_id, label, need, n, block HAVING count(DISTINCT r) >= need),
base_labels AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS base_labels FROM (SELECT DISTINCT doc_id, label FROM places) GROUP BY doc_id),
all_labels AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM places UNION SELECT doc_id, label FROM met) GROUP BY doc_id),
best AS (SELECT doc_id, max(c) AS c FROM met GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  greatest(coalesce(c, 0.0), CASE WHEN n_base > 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS score
FROM words LEFT JOIN base USING (doc_id) LEFT JOIN base_labels USING (doc_id) LEFT JOIN all_labels USING (doc_id) LEFT JOIN best USING (doc_id)"""


def op2_sql() -> str:
    pair = f"regexp_extract(host, '{urls.COUNTRY_SUFFIX}', 1)"
    rules = ", ".join(f"({i}, '{rule}', '{h}', '{p}', '{a}')" for i, (rule, h, p, a) in enumerate(urls.parsed_rules(RULES)))
    sql = [
        f"""WITH urls AS (SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{urls.UPPER}', '{urls.LOWER}') AS host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages)""",
        "named AS (SELECT u.host, count(l.quality) AS n, coalesce(sum(1 - l.quality), 0) AS k, string_split(u.host, '.') AS parts FROM urls u LEFT JOIN labels l ON u.page_id = l.doc_id GROUP BY u.host)",
        f"hosts AS (SELECT *, CASE WHEN {pair} <> '' THEN {pair} ELSE parts[-1] END AS suffix FROM named)",
        "placed AS (SELECT *, CASE WHEN contains(suffix, '.') THEN array_to_string(parts[-3:], '.') ELSE array_to_string(parts[-2:], '.') END AS domain FROM hosts)",
        "overall AS (SELECT (sum(k) + 0.5::DOUBLE) / (sum(n) + 1.0::DOUBLE) AS p FROM placed)",
    ]
    groups = {"suffix": "SELECT suffix, sum(n) AS n, sum(k) AS k, (SELECT p FROM overall) AS p FROM placed GROUP BY suffix", "domain": "SELECT domain, h.suffix, sum(h.n) AS n, sum(h.k) AS k, any_value(a.rate) AS p FROM placed h JOIN suffix_rates a USING (suffix) GROUP BY domain, h.suffix", "host": "SELECT host, h.n, h.k, a.rate AS p FROM placed h JOIN domain_rates a USING (domain)"}
    for level, rows in groups.items():
        sql.append(f"{level}_rows AS ({rows})")
        sql.append(f"{level}_moments AS (SELECT sum(pow(k - n * p, 2) - n * p * (1 - p)) AS e, sum(n * (n - 1) * p * (1 - p)) AS w FROM {level}_rows)")
        sql.append(f"{level}_strength AS (SELECT 1 / CASE WHEN coalesce(w, 0) = 0 THEN 0.5::DOUBLE ELSE least(0.999::DOUBLE, greatest(0.001::DOUBLE, e / w)) END - 1 AS m FROM {level}_moments)")
        sql.append(f"{level}_rates AS (SELECT *, m * p + k AS a, m * (1 - p) + n - k AS b, (m * p + k) / (m + n) AS rate FROM {level}_rows, {level}_strength)")
    sql.append("bounds AS (SELECT host, n, rate, 1.645 * sqrt(a * b / (pow(a + b, 2) * (a + b + 1))) AS d FROM host_rates)")
    sql.append(f"rules(pos, rule, r_host, r_path, action) AS (VALUES {rules})")
    sql.append("fits AS (SELECT page_id, min(pos) AS pos FROM urls, rules WHERE (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path) GROUP BY page_id)")
    return ",\n".join(sql) + """
SELECT u.page_id, u.host, u.path, r.rule, coalesce(r.action, CASE WHEN greatest(0.0, rate - d) > 1.25 * (SELECT p FROM overall) THEN 'block' ELSE 'allow' END) AS verdict, CAST(b.n AS BIGINT) AS n_labelled,
  round(rate, 6) AS bad_rate, round(greatest(0.0::DOUBLE, rate - d), 6) AS lower, round(least(1.0::DOUBLE, rate + d), 6) AS upper
FROM urls u JOIN bounds b USING (host) LEFT JOIN fits f ON f.page_id = u.page_id LEFT JOIN rules r ON r.pos = f.pos"""


# The whole order of each source, without a grid; the same hash as in mixing.uniform.
OP7_SQL = r"""WITH docs AS (SELECT doc_id, text, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS DOUBLE) AS s FROM docs GROUP BY source),
weighed AS (SELECT source, s, [5.0, 2.0, 1.0][CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS INTEGER)]::DOUBLE AS w FROM sizes),
caps AS (SELECT *, 3.0::DOUBLE * s AS cap, 3.0::DOUBLE * s / w AS full_at, sum(s) OVER () AS total FROM weighed),
levels AS (SELECT *, (total - (sum(cap) OVER o - cap)) / (sum(w) OVER () - sum(w) OVER o + w) AS level FROM caps WINDOW o AS (ORDER BY full_at, source IS NULL, source ROWS UNBOUNDED PRECEDING)),
shares AS (SELECT *, least(cap, (SELECT max(level) FROM levels WHERE level <= full_at) * w) AS target FROM levels),
plans AS (SELECT source, s, target, CASE WHEN s > 0 THEN CAST(floor(target / s + 1e-12) AS BIGINT) ELSE 0 END AS whole FROM shares),
rests AS (SELECT *, greatest(0.0, target - whole * s) AS rest FROM plans),
classes AS (SELECT source, CAST(floor(log2(size) * 8) AS INTEGER) AS k, CAST(sum(size) AS DOUBLE) AS words FROM docs WHERE size > 0 GROUP BY ALL),
roots AS (SELECT *, pow(2.0, (k + 0.5) / 8 / 2) AS r FROM classes),
opens AS (SELECT c.source, r, rest - (sum(words) OVER o - words) AS need, sum(words * r) OVER (PARTITION BY c.source) - sum(words * r) OVER o + words * r AS open
  FROM roots c JOIN rests p ON c.source IS NOT DISTINCT FROM p.source WINDOW o AS (PARTITION BY c.source ORDER BY k DESC ROWS UNBOUNDED PRECEDING)),
scales AS (SELECT source, max(need / open) AS scale FROM opens WHERE need / open * r <= 1 GROUP BY source),
drawn AS (SELECT d.doc_id, d.source, d.size, p.s, p.target, p.whole, p.rest, (CAST('0x' || substr(md5('7:' || CAST(d.doc_id AS VARCHAR)), 1, 12) AS BIGINT) + 0.5)::DOUBLE / 281474976710656 AS u,
  least(0.999999::DOUBLE, greatest(1e-9::DOUBLE, scale * sqrt(d.size::DOUBLE))) AS p FROM docs d JOIN rests p ON d.source IS NOT DISTINCT FROM p.source LEFT JOIN scales c ON d.source IS NOT DISTINCT FROM c.source),
ordered AS (SELECT *, sum(CASE WHEN size > 0 AND rest > 0 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY size = 0 OR rest <= 0, ln(u / (1 - u)) - ln(p / (1 - p)), doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM drawn),
taken AS (SELECT *, whole + CASE WHEN size > 0 AND rest > 0 AND upto - size / 2.0 <= rest THEN 1 ELSE 0 END AS copies FROM ordered)
SELECT doc_id, source, CAST(size AS BIGINT) AS size, CAST(s AS BIGINT) AS source_size, target, CAST(copies AS BIGINT) AS copies, CAST(copies * size AS BIGINT) AS taken FROM taken"""

# Nodes by grouping whole prefixes, subtrees by joining each node to all its ancestors; CRC-32 from its polynomial.
OP11_SQL = """WITH crc(t) AS (SELECT list(c ORDER BY i) FROM (SELECT i, list_reduce(list_prepend(CAST(i AS BIGINT), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])), lambda a, x: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) AS c FROM range(256) r(i))),
turns AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS k,
  md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS id, strlen(coalesce(text, '')) AS b FROM conversations WHERE conv_id IS NOT NULL),
sizes AS (SELECT conv_id, conv_id - conv_id % 5 AS base, count(*) AS size FROM turns GROUP BY conv_id),
convs AS (SELECT conv_id, base, size, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
  lambda a, d: xor(a // 256, t[CAST(xor(a, d) % 256 + 1 AS INT)])), 4294967295) % 9 AS h FROM sizes, crc),
plans AS (SELECT c.conv_id, c.base, c.h, least(c.h, coalesce(b.size, 0)) AS given FROM convs c LEFT JOIN convs b ON b.conv_id = c.base),
rebuilt AS (SELECT p.conv_id, k + 1 AS depth, id, b FROM plans p JOIN turns t ON t.conv_id = p.base WHERE k < h UNION ALL SELECT p.conv_id, k - h + given + 1, id, b FROM plans p JOIN turns t ON t.conv_id = p.conv_id WHERE k >= h),
prefixes AS (SELECT conv_id, depth, md5(string_agg(id, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS node, b FROM rebuilt UNION ALL SELECT conv_id, 0, '', 0 FROM convs),
nodes AS (SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n, any_value(b) AS b FROM prefixes GROUP BY node, depth),
edges AS (SELECT DISTINCT c.node, p.node AS parent FROM prefixes c JOIN prefixes p ON p.conv_id = c.conv_id AND p.depth = c.depth - 1),
families AS (SELECT parent AS node, count(*) AS n_children FROM edges GROUP BY parent),
below AS (SELECT p.node, sum((x.n - 1) * x.b) AS saved, count_if(f.node IS NULL) AS n_leaves FROM nodes x LEFT JOIN families f USING (node) JOIN prefixes p ON p.conv_id = x.conv_id AND p.depth <= x.depth GROUP BY p.node),
lasts AS (SELECT conv_id, max_by(node, depth) AS node FROM prefixes GROUP BY conv_id),
ends AS (SELECT node, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS sha FROM lasts GROUP BY node)
SELECT x.conv_id, CAST(x.depth AS BIGINT) AS depth, up.conv_id AS parent_conv_id, x.n AS n_convs, coalesce(f.n_children, 0) AS n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, coalesce(z.sha, sha256('')) AS ends_sha256
FROM nodes x JOIN below s USING (node) LEFT JOIN families f USING (node) LEFT JOIN edges e USING (node) LEFT JOIN nodes up ON up.node = e.parent LEFT JOIN ends z ON z.node = x.node"""

# Every document is taken through every order, without masks or cells.
OP13_SQL = r"""WITH RECURSIVE letters(f) AS (SELECT unnest(['A', 'B', 'C', 'D', 'E'])),
orders(o) AS (SELECT '' UNION ALL SELECT o || f FROM orders, letters WHERE length(o) < 5 AND NOT contains(o, f)),
steps AS (SELECT o AS filter_order, CAST(s AS INT) AS step, o[s] AS own, substr(o, 1, s - 1) AS before FROM orders, range(1, 6) r(s) WHERE length(o) = 5),
marks AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
docs AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, concat(
  CASE WHEN len(w) < 50 THEN 'A' END, CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' END, CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 'C' END,
  CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' END, CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' END) AS fails FROM texts LEFT JOIN marks USING (doc_id)),
walked AS (SELECT part, filter_order, step, own, good, toxic, fails = own AS only_own, contains(fails, own) AS failing, length(translate(fails, before, '')) < length(fails) AS gone FROM docs, steps),
counted AS (SELECT part, filter_order, step, own, count_if(NOT failing AND NOT gone) AS kept, count_if(failing AND NOT gone) AS removed, count_if(failing AND gone) AS redundant, count_if(only_own) AS unique_fails,
  count_if(failing AND NOT gone AND good = 1) AS good_lost, count_if(failing AND NOT gone AND toxic = 1) AS toxic_lost FROM walked GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM counted"""

ORACLES: dict[str, str] = {"op2_url_filter": op2_sql(), "op7_source_mix": OP7_SQL, "op3_license_scan": op3_sql(), "op9_decontamination": OP9_SQL, "op11_conversation_trie": OP11_SQL, "op13_filter_audit": OP13_SQL}
