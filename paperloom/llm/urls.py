"""URL filters: empirical-Bayes host reputation under explicit allow and block rules, in DataFrame functions only.

Labelled page outcomes are counted per host, registered domain, suffix and overall. Each level's bad rate is shrunk towards
its parent's through a beta-binomial prior whose strength is estimated by the method of moments over that level's children.
A host is blocked when the lower bound of its posterior bad rate exceeds `block_lift` times the overall rate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm._store import written
from paperloom.llm.components import dealt, hot_among, repeated

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Labels that registries of countries use before their two letters; such a pair is a suffix (co.uk, edu.au, gov.in).
COUNTRY_LABELS = "ac co com edu go gob gouv gov govt id ltd mil ne net nhs nic nom or org plc sch".split()
COUNTRY_SUFFIX = rf"(?:^|\.)((?:{'|'.join(COUNTRY_LABELS)})\.[a-z][a-z])$"
INLINE_RULES = 256
LEVELS = ("all", "suffix", "domain", "host")


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, ASCII letters lower-cased; null or no `://`: empty."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1)
    return F.translate(rest, UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to `?`, `#` or the end; null or no `://`: empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def suffix_of(host: Column, more: Sequence[str] = ()) -> Column:
    """The last two labels where they are a country's usual pair, else the last; or the longest of the suffixes `more`, such as
    those of a public list (at most some thousands, of up to four labels)."""
    pair = F.regexp_extract(host, COUNTRY_SUFFIX, 1)
    out = F.when(pair != "", pair).otherwise(F.substring_index(host, ".", -1))
    for k in sorted({x.count(".") + 1 for x in more}):
        tail = F.substring_index(host, ".", -k)
        out = F.when(tail.isin(*[x for x in more if x.count(".") + 1 == k]), tail).otherwise(out)
    return out


def domain_of(host: Column, suffix: Column) -> Column:
    """One label more than the suffix; the host itself if it has no more."""
    labels = F.size(F.split(suffix, r"\.")) + 1
    parts = F.split(host, r"\.")
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - labels + 1, F.lit(1)), labels), ".")


def parsed_rules(rules: Sequence[tuple[str, str]]) -> list[tuple[str, str, str, str]]:
    """(action, rule) pairs as (rule, host, path, action); a rule is host, `/`, rest of path. Longest first, then by text, block before allow."""
    for action, rule in rules:
        if action not in ("allow", "block") or not rule:
            raise ValueError(f"not a rule: {(action, rule)!r}")
    split = {(r, r.partition("/")[0].translate(str.maketrans(UPPER, LOWER)), "".join(r.partition("/")[1:]), a) for a, r in rules}
    return sorted(split, key=lambda x: (-len(x[0]), x[0], x[3] != "block"))


def with_rule(urls: DataFrame, rules: Sequence[tuple[str, str]], inline: int = INLINE_RULES) -> DataFrame:
    """Adds `rule` and `rule_action` of the longest rule that fits `host` and `path`, else null.

    Up to `inline` rules become one expression and cost no shuffle; more are joined on the host's own suffixes, so that the
    cost doesn't grow with the number of rules and each row keeps its best rule by a partial aggregate over (host, path).
    """
    parsed = parsed_rules(rules)
    if len(parsed) <= inline:
        host, path = F.col("host"), F.col("path")
        fit: Column | None = None
        for rule, h, p, action in parsed:
            ok = ((host == h) | host.endswith("." + h)) & path.startswith(p)
            is_it = F.struct(F.lit(rule).alias("rule"), F.lit(action).alias("action"))
            fit = F.when(ok, is_it) if fit is None else fit.when(ok, is_it)
        if fit is None:
            return urls.withColumns({"rule": F.lit(None).cast("string"), "rule_action": F.lit(None).cast("string")})
        return urls.withColumn("__fit", fit).withColumns({"rule": F.col("__fit.rule"), "rule_action": F.col("__fit.action")}).drop("__fit")
    spark = urls.sparkSession
    # at most one row for each rule the caller gave
    table = spark.createDataFrame([(i, *x) for i, x in enumerate(parsed)], "r_order int, rule string, r_host string, r_path string, rule_action string")
    labels = F.split("host", r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    places = urls.select("host", "path").distinct()
    best = (
        places.select("host", "path", F.explode(tails).alias("r_host"))
        .join(table, "r_host")
        .where(F.col("path").startswith(F.col("r_path")))
        .groupBy("host", "path")
        .agg(F.min("r_order").alias("r_order"))
        .join(table.select("r_order", "rule", "rule_action"), "r_order")
        .select("host", "path", "rule", "rule_action")
    )
    return urls.join(best, ["host", "path"], "left")


def host_counts(labelled: DataFrame, suffixes: Sequence[str] = ()) -> DataFrame:
    """host, suffix, domain, n, k (bad), rows, from rows of (host, bad 0/1/null): counted once, the rest works on this table."""
    hosts = labelled.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0)).alias("k"), F.count("*").alias("rows"))
    hosts = hosts.withColumn("suffix", suffix_of(F.col("host"), suffixes))
    return written(hosts.withColumn("domain", domain_of(F.col("host"), F.col("suffix"))), "url-hosts")


def reputations(hosts: DataFrame, z: float = 1.645) -> tuple[DataFrame, dict]:
    """Posterior bad rates of hosts from their counts.

    Returns a table (host, n, n_bad, rate, lower, upper) of all hosts, those without outcomes included (their posterior is the
    prior that their registered domain gives), with the overall rate and the strengths. The strength M of the prior of a level is estimated from its children: with n_i outcomes, k_i of them bad
    and parent rate p_i, E[(k_i - n_i p_i)^2] = n_i p_i (1 - p_i) (1 + (n_i - 1) rho), so rho is the ratio of summed excess
    to summed weight, held within [0.001, 0.999], and M = 1/rho - 1. Bounds are z posterior standard deviations from the mean.
    """
    levels = {
        "suffix": hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")),
        "domain": hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")),
        "host": hosts,
    }
    total = hosts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("k")).first()
    overall = (total["k"] + 0.5) / (total["n"] + 1.0)
    strengths: dict[str, float] = {}
    above: DataFrame | None = None
    for level, parent in (("suffix", None), ("domain", "suffix"), ("host", "domain")):
        rows = levels[level]
        rows = rows.withColumn("p", F.lit(overall)) if above is None else rows.join(above, parent)
        spread = F.col("p") * (1 - F.col("p"))
        excess = F.pow(F.col("k") - F.col("n") * F.col("p"), 2) - F.col("n") * spread
        weight = F.col("n") * (F.col("n") - 1) * spread
        moments = rows.agg(F.sum(excess).alias("e"), F.sum(weight).alias("w")).first()  # one row
        rho = min(0.999, max(0.001, (moments["e"] or 0.0) / moments["w"])) if moments["w"] else 0.5
        strengths[level] = m = 1 / rho - 1
        rows = rows.withColumn("a", m * F.col("p") + F.col("k")).withColumn("b", m * (1 - F.col("p")) + F.col("n") - F.col("k"))
        rows = rows.withColumn("rate", F.col("a") / (F.col("a") + F.col("b")))
        above = rows.select(level, F.col("rate").alias("p"))
    sd = F.sqrt(F.col("a") * F.col("b") / (F.pow(F.col("a") + F.col("b"), 2) * (F.col("a") + F.col("b") + 1)))
    table = rows.select("host", "n", F.col("k").alias("n_bad"), "rate", F.greatest(F.lit(0.0), F.col("rate") - z * sd).alias("lower"), F.least(F.lit(1.0), F.col("rate") + z * sd).alias("upper"))
    return table, {"rate": overall, "strengths": strengths, "n": total["n"]}


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str]], block_lift: float = 1.25, url: str = "url", key: str = "page_id", z: float = 1.645, suffixes: Sequence[str] = ()) -> DataFrame:
    """One row per row of `pages`: key, host, path, rule, verdict (allow or block), n_labelled, bad_rate, lower, upper.

    `outcomes` has (key, bad): 1 bad, 0 good, null unknown; rows that repeat a key count each, with each page of that key.
    A rule's verdict wins; else a host is blocked if the lower bound of its posterior bad rate is above `block_lift` times the
    overall rate: where outcomes don't depend on hosts, none is. Null urls and those without `://` share the empty host; a host
    without outcomes has its registered domain's prior. Other columns, whatever their names, are not read; an empty table gives
    an empty result. A host of very many pages is joined split.
    """
    urls = pages.select(F.col(key).alias("__key"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    labelled = urls.join(outcomes.select(F.col(key).alias("__key"), F.col("bad").cast("int").alias("bad")), "__key", "left").select("host", "bad")
    hosts = host_counts(labelled, suffixes)
    table, overall = reputations(hosts, z)
    hot = hot_among(hosts, "host", "rows")
    judged = dealt(with_rule(urls, rules), hot, "host", "__salt").join(repeated(written(table, "url-rates"), hot, "host", "__salt"), ["host", "__salt"])
    method = F.when(F.col("lower") > block_lift * overall["rate"], "block").otherwise("allow")
    return judged.select(
        F.col("__key").alias(key), "host", "path", "rule", F.coalesce("rule_action", method).alias("verdict"),
        F.col("n").cast("long").alias("n_labelled"), F.col("rate").alias("bad_rate"), "lower", "upper",
    )
