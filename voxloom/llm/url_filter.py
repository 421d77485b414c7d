"""URL filter by redirect equivalence.

Rules judge a URL's host and path. Pages that no rule fits take the decision of their aliases: redirects
(``<meta http-equiv=refresh>``) and canonical links (``<link rel=canonical>``) are edges between URLs, the connected
components of these edges are found by Spark joins, and a block spreads over its component. An explicit allow takes
precedence twice: a page that an allow rule fits is never blocked, and a component that holds such a page passes its
allow, not its block, to the pages without a rule.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, table
from .components import connected_components

RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): between the first ``://`` and ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; then up to
    ``?``, ``#`` or the end. Null and texts without ``://`` have an empty host and path."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, both null if none does.

    A rule ``host/path`` fits its host and all subdomains if the path starts with its own. The rules are a short list
    that the caller states, so they are a CASE expression, longest first; among equal rules an allow comes first.
    """
    rule, verdict = F, F
    for kind, text in sorted(set(rules), key=lambda r: (-len(r[1]), r[1], r[0])):
        at, _, start = text.partition("/")
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(f"/{start}")
        rule, verdict = rule.when(fits, F.lit(text)), verdict.when(fits, F.lit(kind))
    return (F.lit(None).cast("string"), F.lit(None).cast("string")) if rule is F else (rule, verdict)


def _tidy_path(path: Column) -> Column:
    """An absolute path without ``.`` and ``..`` segments; empty is ``/``."""
    parts = F.split(path, "/")
    none = F.slice(parts, 1, 0)
    kept = F.aggregate(
        F.slice(parts, 2, F.size(parts)),
        none,
        lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(x == ".", acc).otherwise(F.concat(acc, F.array(x))),
    )
    folder = F.element_at(parts, -1).isin(".", "..")
    whole = F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(folder & (F.size(kept) > 0), "/").otherwise(""))
    return F.when(path.contains("/."), whole).otherwise(F.when(path == "", "/").otherwise(path))


def url_node(url: Column) -> Column:
    """The URL that a page answers to: scheme and host in lower case, no port that the scheme implies, path without dot
    segments, query, no fragment.

    Null without ``://`` or without a host.
    """
    host, path = url_parts(url)
    scheme = F.lower(F.trim(F.regexp_extract(url, r"(?s)^(.*?)://", 1)))
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]*)", 1)
    site = F.when(scheme == "http", F.regexp_replace(host, ":(80)?$", "")).when(scheme == "https", F.regexp_replace(host, ":(443)?$", "")).otherwise(host)
    return F.when(host != "", F.concat(scheme, F.lit("://"), site, _tidy_path(path), query))


def resolved(target: Column, url: Column) -> Column:
    """The URL that a link ``target`` on the page ``url`` leads to; null if it leads to no page.

    As browsers resolve links: with a scheme as it stands, from ``//`` on with the page's scheme, from ``/`` on at the
    page's host, from ``?`` on at the page's path, else beside the page. A fragment alone, and schemes without ``//`` (such
    as mailto:), lead nowhere. A base element is not looked for.
    """
    host, path = url_parts(url)
    scheme = F.trim(F.regexp_extract(url, r"(?s)^(.*?)://", 1))
    site = F.concat(scheme, F.lit("://"), host)
    beside = F.concat(site, F.when(path.contains("/"), F.regexp_extract(path, r"(?s)^(.*/)", 1)).otherwise("/"), target)
    at_host = F.when(target.startswith("//"), F.concat(scheme, F.lit(":"), target)).when(target.startswith("/"), F.concat(site, target))
    local = at_host.when(target.startswith("?"), F.concat(site, F.when(path == "", "/").otherwise(path), target)).when(~target.startswith("#") & (target != ""), beside)
    return F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target).when(~target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") & (host != ""), local)


def alias_edges(pages: DataFrame) -> DataFrame:
    """(url, target) of each page that redirects or names a canonical URL in its html.

    Tags inside comments, scripts, styles, templates, titles and text areas are text and count for nothing.
    """
    tag = r"(?is)<(?:link|meta)\b[^>]*>"
    html = F.coalesce("html", F.lit(""))
    markup = F.regexp_replace(html, r"(?is)<!--.*?(?:-->|$)|<(script|style|template|title|textarea)\b.*?(?:</\1\s*>|$)", " ")
    hinted = pages.where(F.lower(html).rlike(r"canonical|http-equiv")).select("url", F.explode(F.regexp_extract_all(markup, F.lit(tag), F.lit(0))).alias("tag"))
    href = F.regexp_extract("tag", r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)""", 1)
    refresh = F.regexp_extract("tag", r"""(?is)\bcontent\s*=\s*["']?\s*\d*\s*;?\s*url\s*=\s*["']?([^"'\s>]+)""", 1)
    target = F.when(F.col("tag").rlike(r"""(?is)^<link\b.*\brel\s*=\s*["']?canonical\b"""), href).when(F.col("tag").rlike(r"""(?is)^<meta\b.*\bhttp-equiv\s*=\s*["']?refresh\b"""), refresh)
    return hinted.select("url", F.replace(target, F.lit("&amp;"), F.lit("&")).alias("target")).where("target <> ''")


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, edges: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict and source (rule, alias or default) of every page.

    ``edges``: further (url, target) pairs, such as a crawler's redirect log. Targets are resolved against the page (see
    ``resolved``); a node is a whole URL without its fragment, and a rule judges it by its host and path. A page with a null
    url has an empty host and path, fits no rule, has no aliases and is allowed; null html has no links; a null page_id is
    a page like any other. Repeated rows give repeated results, and repeated edges count once; of rules that are equally
    long an allow comes first; a component with an allowed and a blocked page passes its allow. An empty table gives an
    empty result. Further columns are ignored.
    """
    links = alias_edges(pages)
    if edges is not None:
        links = links.unionByName(edges.select("url", "target"))
    ends = links.select(url_node(F.col("url")).alias("a"), url_node(resolved(F.col("target"), F.col("url"))).alias("b"))
    links = durable(ends.where("a <> b").distinct())
    host, path = url_parts(F.col("url"))
    # a page without a node gets a key that no node has, so that such pages are not shuffled to one place
    node = F.coalesce(url_node(F.col("url")), F.concat(F.lit(" "), F.coalesce(F.col("page_id").cast("string"), F.lit(""))))
    judged = pages.select("page_id", host.alias("host"), path.alias("path"), node.alias("_node"))
    judged = judged.select("*", *(c.alias(n) for c, n in zip(rule_for(F.col("host"), F.col("path"), rules), ("rule", "_own"), strict=True)))
    if links.isEmpty():
        return judged.select("page_id", "host", "path", "rule", F.coalesce("_own", F.lit("allow")).alias("verdict"), F.when(F.col("rule").isNull(), "default").otherwise("rule").alias("source"))
    nodes = durable(connected_components(links))
    at = url_parts(F.col("node"))
    own = rule_for(*at, rules)[1]
    # cut from its aggregation, so that Spark can split a component with very many pages
    passed = durable(nodes.withColumn("_own", own).where("_own IS NOT NULL").groupBy("root").agg(F.max(F.when(F.col("_own") == "allow", "allow")).alias("allow")))
    passed = nodes.join(passed, "root").select(F.col("node").alias("_node"), F.coalesce("allow", F.lit("block")).alias("_passed"))
    verdict = F.coalesce("_own", "_passed", F.lit("allow"))
    source = F.when(F.col("rule").isNotNull(), "rule").when(F.col("_passed").isNotNull(), "alias").otherwise("default")
    return judged.join(passed, "_node", "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"), source.alias("source"))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


ORACLE_SQL = r"""
WITH p AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), q AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p
), r(kind, rule, site, start) AS (
  VALUES ('allow', 'org/', 'org', '/'), ('block', 'example.org/es/', 'example.org', '/es/'), ('block', 'example.org/en/1', 'example.org', '/en/1'),
         ('allow', 'com/fr/', 'com', '/fr/'), ('block', 'com/de/', 'com', '/de/')
), j AS (
  SELECT page_id, host, path,
         (SELECT max_by(r.rule, length(r.rule)) FROM r WHERE (host = r.site OR ends_with(host, '.' || r.site)) AND starts_with(path, r.start)) AS rule FROM q
)
SELECT page_id, host, path, j.rule, coalesce(r.kind, 'allow') AS verdict, CASE WHEN j.rule IS NULL THEN 'default' ELSE 'rule' END AS source
FROM j LEFT JOIN r ON j.rule = r.rule
"""
