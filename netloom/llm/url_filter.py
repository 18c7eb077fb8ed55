"""URL filters: host and path rules indexed by their rarest literal token, in DataFrame functions only.

A rule is (verdict, host, path): it fits its host and all subdomains, if the url's path starts with the rule's. Its
regular expression is run only on urls that hold the rule's rarest literal token (a label of the host or a whole
segment of the path), as counted over the urls themselves. The index of a list of at most IN_PLAN rules is a map
literal in the plan, so nothing is shuffled, broadcast or joined. Longer lists, and rules in a DataFrame, are joined to
the distinct places (host and path) by that token; the results are the same.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm.common import table

IN_PLAN = 1000  # rules in a plan's literal
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ? # or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(host: Column, path: Column) -> Column:
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("h:"), x))
    parts = F.split(path, "/", -1)
    whole = F.transform(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: F.concat(F.lit("p:"), x))
    return F.array_distinct(F.concat(labels, whole, F.array(F.lit("*"))))


def rule_tokens(host: str, path: str) -> list[str]:
    """Tokens that every url that the rule fits holds."""
    return [f"h:{x}" for x in host.split(".") if x] + [f"p:{x}" for x in path.split("/")[:-1] if x]


def rule_regex(host: str, path: str) -> str:
    """Over host and path in one: a host holds no slash."""
    quote = lambda x: re.sub(r"([^A-Za-z0-9_/])", r"\\\1", x)
    return f"(?s)^(?:[^/]*\\.)?{quote(host)}{quote(path) if path else '(?=/|$)'}"


def url_verdicts(pages: DataFrame, rules=RULES, url_col: str = "url", default: str = "allow") -> DataFrame:
    """All columns of pages (but those named as a result), with host, path, rule and verdict.

    The longest fitting rule wins, by length of host plus path; of equally long ones the greater in (text, verdict).
    No rule: rule null and verdict `default`. A null url, or one without ://, has empty host and path and fits no rule.
    Repeated rows stay; an empty table gives an empty table. rules: (verdict, host, path) of each, or a DataFrame of
    such columns of any length; rules with a null are ignored.
    """
    url = F.col(f"`{url_col}`")
    if isinstance(rules, DataFrame) or len(rules) > IN_PLAN:
        own = rules if isinstance(rules, DataFrame) else pages.sparkSession.createDataFrame(list(rules), "verdict string, host string, path string")
        return _joined(pages, own.select("verdict", "host", "path").dropna(), url, default)
    wanted = {t for _, host, path in rules for t in rule_tokens(host, path)}
    counts = {}
    if wanted:
        own = F.array_intersect(tokens_of(host_of(url), path_of(url)), F.array(*(F.lit(t) for t in sorted(wanted))))
        counts = {r.token: r.n for r in pages.select(F.explode(own).alias("token")).groupBy("token").agg(F.count("*").alias("n")).collect()}
    index: dict[str, list[Column]] = {}
    for verdict, host, path in rules:
        rarest = min(rule_tokens(host, path), key=lambda t: (counts.get(t, 0), t), default="*")
        index.setdefault(rarest, []).append(F.struct(F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict"), F.lit(rule_regex(host, path)).alias("regex")))
    out = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    found = pages.select(*(F.col(f"`{c}`") for c in out), host_of(url).alias("host"), path_of(url).alias("path"))
    if not index:
        return found.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    entries = F.create_map(*(x for t, own in sorted(index.items()) for x in (F.lit(t), F.array(*own))))
    fetched = F.flatten(F.filter(F.transform(tokens_of(F.col("host"), F.col("path")), lambda t: F.try_element_at(entries, t)), lambda x: x.isNotNull()))
    line = F.concat("host", "path")
    fits = F.filter(fetched, lambda r: F.rlike(line, r["regex"]))
    best = F.array_max(F.transform(fits, lambda r: F.struct(F.length(r["rule"]).alias("n"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))
    return found.select("*", best.alias("__best")).select(*(F.col(f"`{c}`") for c in out), "host", "path", F.col("__best.rule").alias("rule"), F.coalesce(F.col("__best.verdict"), F.lit(default)).alias("verdict"))


def _joined(pages: DataFrame, rules: DataFrame, url: Column, default: str) -> DataFrame:
    """The same by joins: tokens are counted, rules take their rarest, and places meet rules by it."""
    out = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    found = pages.select(*(F.col(f"`{c}`") for c in out), host_of(url).alias("host"), path_of(url).alias("path"))
    quote = lambda x: F.regexp_replace(x, "([^A-Za-z0-9_/])", r"\\$1")
    labels = F.transform(F.filter(F.split("host", r"\."), lambda x: x != ""), lambda x: F.concat(F.lit("h:"), x))
    parts = F.split("path", "/", -1)
    whole = F.transform(F.filter(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: x != ""), lambda x: F.concat(F.lit("p:"), x))
    tokens = F.array_distinct(F.concat(labels, whole))
    regex = F.concat(F.lit(r"(?s)^(?:[^/]*\.)?"), quote(F.col("host")), F.when(F.col("path") == "", F.lit("(?=/|$)")).otherwise(quote(F.col("path"))))
    own = rules.distinct().select("verdict", F.concat("host", "path").alias("rule"), F.struct("host", "path").alias("place"), regex.alias("regex"), F.when(F.size(tokens) > 0, tokens).otherwise(F.array(F.lit("*"))).alias("tokens"))
    wanted = own.select(F.explode("tokens").alias("token")).distinct()
    places = found.select("host", "path").groupBy("host", "path").agg(F.count("*").alias("urls"))
    held = places.select("host", "path", "urls", F.explode(tokens_of(F.col("host"), F.col("path"))).alias("token")).join(wanted, "token", "left_semi")
    counts = held.groupBy("token").agg(F.sum("urls").alias("n"))
    rarest = own.select("verdict", "rule", "regex", "place", F.explode("tokens").alias("token")).join(counts, "token", "left").groupBy("verdict", "rule", "regex", "place")
    index = rarest.agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("token").alias("token")))["token"].alias("token")).select("token", "verdict", "rule", "regex")
    met = held.join(index, "token").where(F.rlike(F.concat("host", "path"), F.col("regex")))
    best = met.groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("n"), F.col("rule").alias("rule"), F.col("verdict").alias("verdict"))).alias("__best"))
    return found.join(best, ["host", "path"], "left").select(*(F.col(f"`{c}`") for c in out), "host", "path", F.col("__best.rule").alias("rule"), F.coalesce(F.col("__best.verdict"), F.lit(default)).alias("verdict"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


_RULES_SQL = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
OP10_SQL = f"""
WITH rules(verdict, rhost, rpath) AS (VALUES {_RULES_SQL}),
u AS (SELECT page_id, row_number() OVER () AS r,
        translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
        coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
m AS (SELECT u.*, rhost || rpath AS rule, verdict,
        row_number() OVER (PARTITION BY r ORDER BY length(rhost || rpath) DESC, rhost || rpath DESC) AS k
      FROM u LEFT JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1"""
