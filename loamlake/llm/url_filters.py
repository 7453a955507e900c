"""Operator 1, URL filters by redirect equivalence [native].

Rules name a host (with all its subdomains) and a path prefix; the longest fitting rule decides. Pages
without a rule of their own get a decision from their aliases: redirect and canonical-link edges make an
undirected graph of addresses, and a block rule on any member of a connected component blocks every member
that no rule of its own allows (an explicit allow takes precedence over a block that only propagates).
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamlake.llm.common import cut, free_name, table
from loamlake.llm.components import connected_components


class Rule(NamedTuple):
    verdict: str  # allow or block
    host: str
    path: str


#: The rules of the registered query.
QUERY_RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)

#: Up to this many rules are folded into the expression of one row; more rules become a table that is joined.
INLINE_RULES = 64

#: Only A-Z: F.lower would also fold letters beyond ASCII.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """The address that names a page whatever its scheme or fragment; null for what is no address."""
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(url.contains("://") & (host_of(url) != ""), F.concat(host_of(url), F.when(rest == "", F.lit("/")).otherwise(rest)))


def _ranked(rules: Sequence[Rule]) -> list[Rule]:
    """Longest first; of equally long ones the longer host, then allow before block."""
    return sorted(rules, key=lambda r: (-len(r.host + r.path), -len(r.host), r.verdict, r.host))


def _inline(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in reversed(_ranked(rules)):
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def match_rules(df: DataFrame, rules: Sequence[Rule] | DataFrame, host: str, path: str, out: str) -> DataFrame:
    """df with ``out`` = struct(rule, verdict) of the longest fitting rule, or null.

    Few rules become one expression. Many (or a DataFrame verdict, host, path) are joined on equal host
    suffixes, each distinct (host, path) once, so that neither rows nor rules meet as pairs.
    """
    if not isinstance(rules, DataFrame):
        rules = [Rule(*r) for r in rules]
        if len(rules) <= INLINE_RULES:
            return df.withColumn(out, _inline(F.col(host), F.col(path), rules))
        rules = df.sparkSession.createDataFrame(rules, "verdict string, host string, path string")
    asked = df.select(F.col(host).alias("h"), F.col(path).alias("p")).where("h is not null and p is not null").distinct()
    labels = F.split("h", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))
    r = rules.where("host is not null and path is not null").select(F.col("host").alias("rh"), F.col("path").alias("rp"), F.col("verdict").alias("rv"))
    rank = F.struct(F.length(F.concat("rh", "rp")), F.length("rh"), (F.col("rv") == "allow").cast("int"), "rh", "rp")
    best = F.max_by(F.struct(F.concat("rh", "rp").alias("rule"), F.col("rv").alias("verdict")), rank)
    found = asked.withColumn("rh", F.explode(suffixes)).join(r, "rh").where(F.col("p").startswith(F.col("rp"))).groupBy("h", "p").agg(best.alias(out))
    return df.join(found, (df[host] == found["h"]) & (df[path] == found["p"]), "left").drop("h", "p")


def alias_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(a, b): the address of a page and one that it declares its canonical form or redirects to.

    Read from ``<link rel=canonical href>`` and ``<meta http-equiv=refresh content="n;url=...">`` outside
    comments and scripts; relative references are resolved against the page's own address.
    """
    seen = pages.select(F.col(url).alias("url"), F.col(html).alias("html")).where(F.col("html").rlike(r"(?i)<(link|meta)\b[^>]*(canonical|refresh)") & F.col("url").contains("://"))
    body = F.regexp_replace("html", r"(?is)<!--.*?-->|<script\b.*?</script\s*>", "")
    tags = F.filter(F.regexp_extract_all(body, F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), F.lit(0)), lambda t: t.rlike(r"(?i)\b(rel\s*=\s*[\"']?[^\"'>]*\bcanonical\b|http-equiv\s*=\s*[\"']?refresh\b)"))
    quoted = lambda t, name: F.regexp_extract(t, rf"(?is)\b{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", 0)
    bare = lambda x: F.regexp_replace(F.regexp_replace(x, r"(?s)^[^=]*=\s*", ""), r"^[\"']|[\"']$", "")
    link = lambda t: F.when(t.rlike("(?i)^<link"), bare(quoted(t, "href"))).otherwise(F.regexp_extract(bare(quoted(t, "content")), r"(?is);\s*url\s*=\s*[\"']?([^\"']*)", 1))
    found = seen.select("url", F.explode(F.transform(tags, link)).alias("href")).withColumn("href", F.replace(F.trim("href"), F.lit("&amp;"), F.lit("&"))).where("href <> ''")
    scheme, root = F.regexp_extract("url", r"(?s)^(.*?)://", 1), F.regexp_extract("url", r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract("url", r"(?s)^(.*?://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    full = (
        F.when(F.col("href").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), F.col("href"))
        .when(F.col("href").startswith("//"), F.concat(scheme, F.lit(":"), "href"))
        .when(F.col("href").startswith("/"), F.concat(root, "href"))
        .when(F.col("href").rlike(r"^[?#]"), F.concat(F.regexp_extract("url", r"(?s)^([^?#]*)", 1), "href"))
        .otherwise(F.concat(folder, F.when(folder.endswith("/"), F.lit("")).otherwise(F.lit("/")), "href"))
    )
    return found.select(node_of(F.col("url")).alias("a"), node_of(full).alias("b")).where("a <> b")


def judge_urls(pages: DataFrame, rules: Sequence[Rule] | DataFrame, edges: DataFrame | None = None, url: str = "url", html: str = "html", default: str = "allow") -> DataFrame:
    """pages with host, path, rule, verdict, via_alias added (columns of these names are replaced).

    edges: further (a, b) address pairs, such as a redirect log, beside those that the pages declare.
    verdict is the rule's; without a rule ``block`` where an alias is blocked, else ``default``.
    A null url, or one without ``://``, has an empty host and path, no rule and no aliases. Repeated rows
    each get their row. Links to pages outside the table count. No rows in, no rows out.
    """
    new = ("host", "path", "rule", "verdict", "via_alias")
    base = pages.drop(*(n for n in new if n not in (url, html)))
    node, hit = free_name(base, "alias_node"), free_name(base, "rule_hit")
    judged = match_rules(base.withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url))), rules, "host", "path", hit)
    judged = judged.withColumn("rule", F.col(hit)["rule"]).withColumn("verdict", F.col(hit)["verdict"]).drop(hit)
    links = alias_edges(pages, url, html) if html in pages.columns else None
    if edges is not None:
        given = edges.select(node_of(F.col("a")).alias("a"), node_of(F.col("b")).alias("b")).where("a <> b")
        links = given if links is None else links.union(given)
    members = None
    if links is not None and not (links := cut(links.distinct())).isEmpty():
        members = connected_components(links, local_edges=0)
    if members is None:
        return judged.withColumn("via_alias", F.lit(False)).withColumn("verdict", F.coalesce("verdict", F.lit(default)))
    parts = cut(members.withColumn("mh", F.regexp_extract("node", r"(?s)^([^/?]*)", 1)).withColumn("mp", F.regexp_extract("node", r"(?s)^[^/?]*([^?]*)", 1)))
    bad = match_rules(parts, rules, "mh", "mp", "hit").where("hit.verdict = 'block'").select("component").distinct()
    # written, so that the join has a shuffle of its own on either side and Spark can split an address of many rows
    bad = cut(parts.join(bad, "component", "left_semi").select(F.col("node").alias(node), F.lit(True).alias("via_alias")))
    # rows that a rule decides, or that have no address, take no part in the join: their null keys would be one task
    judged = judged.withColumn(node, F.when(F.col("verdict").isNull(), node_of(F.col(url))))
    settled = judged.where(F.col(node).isNull()).drop(node).withColumn("via_alias", F.lit(False))
    asked = judged.where(F.col(node).isNotNull()).join(bad, node, "left").drop(node)
    asked = asked.withColumn("via_alias", F.coalesce("via_alias", F.lit(False)))
    asked = asked.withColumn("verdict", F.when(F.col("via_alias"), F.lit("block")))
    return settled.unionByName(asked).withColumn("verdict", F.coalesce("verdict", F.lit(default)))


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), QUERY_RULES).select("page_id", "host", "path", "rule", "verdict", "via_alias")


_RULES_SQL = ", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in QUERY_RULES)

#: DuckDB: the same rules, edges and components; relative references are resolved only from the root.
SQL = {
    "op1_url_filters": f"""
WITH RECURSIVE rules(v, h, p) AS (VALUES {_RULES_SQL}),
pg AS (SELECT row_number() OVER () AS rid, page_id, url, html,
  CASE WHEN contains(url, '://') THEN translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') ELSE '' END AS host,
  CASE WHEN contains(url, '://') THEN regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) ELSE '' END AS path,
  CASE WHEN contains(url, '://') THEN regexp_extract(url, '(?s)^.*?://[^/?#]*([^#]*)', 1) END AS rest FROM pages),
n AS (SELECT *, CASE WHEN host <> '' THEN host || CASE WHEN rest = '' THEN '/' ELSE rest END END AS node FROM pg),
tags AS (SELECT url, node, unnest(regexp_extract_all(regexp_replace(html, '(?is)<!--.*?-->|<script\\b.*?</script\\s*>', '', 'g'), '(?is)<link\\b[^>]*>')) AS t FROM n),
hrefs AS (SELECT url, node AS a, regexp_extract(t, '(?is)href\\s*=\\s*["'']([^"'']*)', 1) AS href FROM tags WHERE regexp_matches(t, '(?i)rel\\s*=\\s*["'']?canonical')),
tgt AS (SELECT a, CASE WHEN contains(href, '://') THEN href ELSE regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) || href END AS u FROM hrefs WHERE href <> ''),
e AS (SELECT a, translate(regexp_extract(u, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') || CASE WHEN regexp_extract(u, '(?s)^.*?://[^/?#]*([^#]*)', 1) = '' THEN '/' ELSE regexp_extract(u, '(?s)^.*?://[^/?#]*([^#]*)', 1) END AS b FROM tgt),
s AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b),
reach(x, y) AS (SELECT a, b FROM s UNION SELECT r.x, s.b FROM reach r JOIN s ON r.y = s.a),
seen AS (SELECT DISTINCT y AS node, regexp_extract(y, '(?s)^([^/?]*)', 1) AS host, regexp_extract(y, '(?s)^[^/?]*([^?]*)', 1) AS path FROM reach),
hit AS (SELECT rid, arg_max(h || p, (length(h || p), length(h), CASE v WHEN 'allow' THEN 1 ELSE 0 END)) AS rule, arg_max(v, (length(h || p), length(h), CASE v WHEN 'allow' THEN 1 ELSE 0 END)) AS verdict
  FROM n JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY rid),
bad AS (SELECT node FROM (SELECT node, arg_max(v, (length(h || p), length(h), CASE v WHEN 'allow' THEN 1 ELSE 0 END)) AS verdict
  FROM seen JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY node) WHERE verdict = 'block'),
alias AS (SELECT DISTINCT x AS node FROM reach WHERE y IN (SELECT node FROM bad))
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN node IN (SELECT node FROM alias) THEN 'block' ELSE 'allow' END) AS verdict,
  verdict IS NULL AND coalesce(node IN (SELECT node FROM alias), false) AS via_alias
FROM n LEFT JOIN hit USING (rid)""",
}

QUERIES = {"op1_url_filters": op1_url_filters}
