"""URL filters with redirect equivalence.

A rule names a host and a path; it fits the host and its subdomains where the url's path starts
with the rule's. The longest rule that fits decides. Urls without a rule follow their aliases:
canonical links (`<link rel="canonical">`) and redirects (`<meta http-equiv="refresh">`) are edges
between urls, and a rule that blocks any url of a connected component, listed as a page or only
linked to, blocks its urls without a rule of their own. An explicit allow always wins.

Urls are one node if they agree in host, path and query; scheme and fragment don't count. A null
url or one without `://` has an empty host and path, no rule, no aliases, and is allowed. Null
html has no links. Repeated rows are each returned. Empty tables give empty results. Of rules
alike in host and path, allow wins. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gigmesh.llm.components import components
from gigmesh.runtime import cut_lineage

#: Fixed values: (host, path, verdict).
RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_CANONICAL = r"""(?i)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*?\bhref\s*=\s*["']?([^"'\s>]+)"""
_REFRESH = r"""(?i)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*?\burl\s*=\s*["']?([^"'\s>]+)"""


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """Host, path and query; null without a host."""
    tail = F.regexp_extract(_rest(url), r"^[^/?#]*([^#]*)", 1)
    return F.when(host_of(url) != "", F.concat(host_of(url), F.when(F.startswith(tail, F.lit("/")), tail).otherwise(F.concat(F.lit("/"), tail))))


def resolved(target: Column, url: Column) -> Column:
    """An absolute url for a link found at ``url``."""
    origin = F.concat(F.lit("http://"), host_of(url))
    folder = F.regexp_extract(path_of(url), r"^(.*/)", 1)
    return (
        F.when(target == "", None)
        .when(F.instr(target, "://") > 0, target)
        .when(F.startswith(target, F.lit("//")), F.concat(F.lit("http:"), target))
        .when(F.startswith(target, F.lit("/")), F.concat(origin, target))
        .otherwise(F.concat(origin, F.when(folder == "", F.lit("/")).otherwise(folder), target))
    )


def rules_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(rules, "rule_host string, rule_path string, rule_verdict string")


def by_rule(places: DataFrame, rules: DataFrame) -> DataFrame:
    """``host, path, rule, rule_verdict`` for the distinct places that some rule fits."""
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    ends = places.select("host", "path").where("host <> ''").distinct().select("host", "path", F.explode(suffixes).alias("suffix"))
    fits = ends.join(rules, F.col("suffix") == F.col("rule_host")).where(F.startswith("path", "rule_path"))
    rule = F.concat("rule_host", "rule_path")
    best = F.max(F.struct(
        F.length(rule).alias("size"), F.length("rule_host").alias("host_size"), (F.col("rule_verdict") == "allow").alias("allow"),
        rule.alias("rule"), "rule_verdict",
    ))
    return fits.groupBy("host", "path").agg(best.alias("best")).select("host", "path", "best.rule", "best.rule_verdict")


def link_edges(pages: DataFrame) -> DataFrame:
    """``u, v, v_host, v_path``: a page's node, and the node it redirects to or calls canonical."""
    found = pages.where("html is not null").select(
        "url", F.explode(F.array(F.regexp_extract("html", _CANONICAL, 1), F.regexp_extract("html", _REFRESH, 1))).alias("target")
    )
    target = found.where("target <> ''").select("url", resolved(F.col("target"), F.col("url")).alias("target"))
    ends = target.select(
        node_of(F.col("url")).alias("u"), node_of(F.col("target")).alias("v"),
        host_of(F.col("target")).alias("v_host"), path_of(F.col("target")).alias("v_path"),
    )
    return ends.where("u is not null and v is not null and u <> v").distinct()


def judge(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every row."""
    edges = cut_lineage(link_edges(pages.select("url", "html")))
    groups = components(edges.select("u", "v"))
    url = F.col("url")
    rows = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("node"))
    places = rows.select("node", "host", "path").union(edges.select("v", "v_host", "v_path"))
    ruled = by_rule(places, rules)
    # Components with a blocked url; only nodes with an edge are looked at.
    known = places.where("node is not null").distinct().join(groups, "node").join(ruled, ["host", "path"])
    blocked = known.where("rule_verdict = 'block'").select("component").distinct()
    aliases = groups.join(blocked, "component").select("node", F.lit(True).alias("spread"))
    out = rows.join(ruled, ["host", "path"], "left").join(aliases, "node", "left")
    verdict = F.coalesce("rule_verdict", F.when(F.col("spread"), "block"), F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"))


def query(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules_table(spark))


ORACLE = r"""
WITH RECURSIVE p AS (
  SELECT page_id, url, html, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (
  SELECT page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path, regexp_extract(rest, '^[^/?#]*([^#]*)', 1) AS tail FROM p),
n AS (SELECT page_id, html, coalesce(host, '') AS host, path,
             CASE WHEN host <> '' THEN host || CASE WHEN starts_with(tail, '/') THEN tail ELSE '/' || tail END END AS node FROM q),
links AS (
  SELECT node AS u, host AS page_host, path AS page_path, unnest([
    regexp_extract(html, '(?i)<link[^>]*rel="canonical"[^>]*href="([^">]+)"', 1),
    regexp_extract(html, '(?i)<meta[^>]*http-equiv="refresh"[^>]*url=([^">]+)"', 1)]) AS t FROM n WHERE html IS NOT NULL),
goals AS (
  SELECT u, CASE WHEN contains(t, '://') THEN substr(t, instr(t, '://') + 3) WHEN starts_with(t, '//') THEN substr(t, 3)
                 WHEN starts_with(t, '/') THEN page_host || t
                 ELSE page_host || coalesce(nullif(regexp_extract(page_path, '^(.*/)', 1), ''), '/') || t END AS rest
  FROM links WHERE t <> '' AND u IS NOT NULL),
g AS (SELECT u, lower(regexp_extract(rest, '^[^/?#]*')) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
             regexp_extract(rest, '^[^/?#]*([^#]*)', 1) AS tail FROM goals),
e AS (SELECT u, host, path, host || CASE WHEN starts_with(tail, '/') THEN tail ELSE '/' || tail END AS v FROM g WHERE host <> ''),
both_ways AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
rules AS (SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'),
                                ('org', '/fr/', 'allow')) AS r(rule_host, rule_path, rule_verdict)),
places AS (SELECT node, host, path FROM n UNION SELECT v, host, path FROM e),
ruled AS (
  SELECT host, path, rule_host || rule_path AS rule, rule_verdict FROM (SELECT DISTINCT host, path FROM places), rules
  WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  QUALIFY row_number() OVER (PARTITION BY host, path ORDER BY length(rule_host || rule_path) DESC) = 1),
reach AS (
  SELECT node AS a, node AS b FROM places WHERE node IN (SELECT u FROM both_ways)
  UNION SELECT a, v FROM reach JOIN both_ways ON b = u),
spread AS (SELECT DISTINCT a FROM reach JOIN places ON b = places.node JOIN ruled USING (host, path) WHERE rule_verdict = 'block')
SELECT page_id, host, path, rule, coalesce(rule_verdict, CASE WHEN a IS NOT NULL THEN 'block' END, 'allow') AS verdict
FROM n LEFT JOIN ruled USING (host, path) LEFT JOIN spread ON node = a
"""
