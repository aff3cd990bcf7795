"""URL filter with redirect equivalence: rules by host and path, propagated over redirect and canonical-link edges.

A rule is (verdict, host, path); it fits its host, all subdomains, and paths that start with its path; the longest rule wins.
Pages that a rule fits take its verdict, so an explicit allow is never overruled by an alias. Pages that no rule fits
are blocked if a rule blocks any url of their connected component. An allow protects the urls that its rule names and no
others: else a page could clear a blocked site by a link to an allowed one. Aliases are urls joined by a canonical link
or a meta refresh in the page's html, or by a row of `redirects`. Urls are the same if they agree after the scheme,
without the fragment.

Edges are few beside pages: only (url, target) goes into components(); rules are judged on the nodes themselves, so pages are
joined once, to the blocked aliases, and only urls without a rule have to be in that join.

Defined results: a null url or one without `://` has an empty host and path, no rule and no aliases, and is allowed; null or
empty html has no links; rows that repeat an id are judged each; empty tables give an empty result; other columns are not
read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import materialize, table
from .components import components

RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_CANONICAL = r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*\bhref\s*=\s*["']?([^"'\s>]+)"""
_REFRESH = r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*\bcontent\s*=\s*["']?\s*[0-9.]*\s*[;,]\s*url\s*=\s*["']?([^"'\s>]+)"""


def _lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def host_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path; both empty for null and for urls without ://."""
    rest = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return _lower(F.coalesce(F.regexp_extract(url, rest, 1), F.lit(""))), F.coalesce(F.regexp_extract(url, rest, 2), F.lit(""))


def node(url: Column) -> Column:
    """What is the same for all spellings of a url: lower-cased host and what follows up to the fragment; null if it has no ://."""
    parts = r"(?s)^.*?://([^/?#]*)([^#]*)"
    return F.when(url.contains("://"), F.concat(_lower(F.regexp_extract(url, parts, 1)), F.regexp_extract(url, parts, 2)))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1], r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def _resolved(base: Column, link: Column) -> Column:
    link = F.regexp_replace(link, "&amp;", "&")
    folder = F.regexp_extract(base, r"(?s)^([^/?]*(?:/[^?]*/|/)?)", 1)
    folder = F.when(folder.contains("/"), folder).otherwise(F.concat(folder, F.lit("/")))
    return (
        F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), node(link))
        .when(link.startswith("//"), node(F.concat(F.lit("http:"), link)))
        .when(link.startswith("/"), node(F.concat(F.lit("http://"), F.regexp_extract(base, "^[^/?]*", 0), link)))
        .when(~link.rlike("^[#?]|^[A-Za-z][A-Za-z0-9+.-]*:"), node(F.concat(F.lit("http://"), folder, link)))
    )


def alias_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """u, v: distinct urls joined by a canonical link or a meta refresh of a page."""
    html = F.col(html_col)
    links = F.array_union(F.regexp_extract_all(html, F.lit(_CANONICAL), F.lit(1)), F.regexp_extract_all(html, F.lit(_REFRESH), F.lit(1)))
    found = pages.select(node(F.col(url_col)).alias("u"), F.explode(links).alias("link")).where("u IS NOT NULL")
    return found.select("u", _resolved(F.col("u"), F.col("link")).alias("v")).where("v IS NOT NULL AND u <> v").distinct()


def url_filter(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, redirects: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, alias (whether the verdict comes from an alias). redirects: source, target urls."""
    edges = alias_edges(pages, url_col, html_col)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(node(F.col("source")).alias("u"), node(F.col("target")).alias("v")))
    found = materialize(components(edges))
    _, own = rule_of(*host_path(F.concat(F.lit("x://"), F.col("node"))), rules)
    judged = found.withColumn("own", own)
    blocked = judged.where("own = 'block'").select("component").distinct()
    aliases = judged.where("own IS NULL").join(blocked, "component", "left_semi").select("node", F.lit(True).alias("alias"))
    host, path = host_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), node(F.col(url_col)).alias("node"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("own")).withColumn("node", F.when(F.col("own").isNull(), F.col("node")))
    free = rows.where("node IS NOT NULL").join(aliases, "node", "left")
    out = free.unionByName(rows.where("node IS NULL").withColumn("alias", F.lit(None).cast("boolean")))
    alias = F.coalesce("alias", F.lit(False))
    return out.select("page_id", "host", "path", "rule", F.coalesce("own", F.when(alias, "block").otherwise("allow")).alias("verdict"), alias.alias("alias"))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages")).drop("alias")


#: No page of the synthetic tables has an alias, so that the rules alone give their rows; a test holds aliases against brute force.
SQL = r"""
WITH p AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages
), r(v, h, q) AS (
  VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')
)
SELECT page_id, host, path, (SELECT arg_max(h || q, length(h || q)) FROM r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q)) AS rule,
       coalesce((SELECT arg_max(v, length(h || q)) FROM r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q)), 'allow') AS verdict
FROM p
"""
