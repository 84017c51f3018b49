"""URL filters with redirect equivalence.

URLs that redirects or canonical links connect are aliases. A rule's block spreads to the aliases without a rule of
their own, unless one of the aliases is allowed by a rule: an explicit allow goes before a block that is inherited.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberglass.operators.components import connected_components
from emberglass.storage import Scratch

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"""(?is)<link\b[^>]*\brel\s*=\s*["']?[^"'>]*\bcanonical\b[^>]*>"""
_META = r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>"""
_HREF = r"""(?is)\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
_URL = r"""(?is)\burl\s*=\s*['"]?([^"'>]+)"""


def _rest(url: Column) -> Column:
    """What follows the first ://, empty where there is none."""
    at = F.locate("://", url)
    return F.when(F.coalesce(at, F.lit(0)) > 0, F.substr(url, at + 3)).otherwise("")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def node_of(url: Column) -> Column:
    """The resource a URL names: host, path and query; scheme and fragment aside. Null where there is no ://."""
    tail = F.regexp_extract(_rest(url), r"^[^/?#]*([^#]*)", 1)
    return F.when(F.contains(url, F.lit("://")), F.concat(host_of(url), tail))


def _resolved(base: Column, href: Column) -> Column:
    """An absolute form of a link that stands in the page at base."""
    href = F.trim(F.regexp_replace(href, "(?i)&amp;", "&"))
    site = F.concat(F.regexp_extract(base, r"^([^:]*)://", 1), F.lit("://"), host_of(base))
    folder = F.coalesce(F.nullif(F.regexp_extract(path_of(base), r"^(.*/)", 1), F.lit("")), F.lit("/"))
    return (
        F.when(href == "", None)
        .when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), href)
        .when(href.startswith("//"), F.concat(F.lit("http:"), href))
        .when(href.startswith("/"), F.concat(site, href))
        .when(href.rlike(r"^(#|[A-Za-z][A-Za-z0-9+.-]*:)"), None)
        .when(href.startswith("?"), F.concat(site, path_of(base), href))
        .otherwise(F.concat(site, folder, href))
    )


def link_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Edges (src, dst) between resources: canonical links and meta refreshes of whole pages."""
    url, html = F.col(url_col), F.col(html_col)
    tags = pages.filter(html.rlike(r"(?i)canonical|http-equiv")).select(url.alias("url"), F.regexp_extract(html, _LINK, 0).alias("link"), F.regexp_extract(html, _META, 0).alias("meta"))
    href = F.concat(*[F.regexp_extract("link", _HREF, k) for k in (1, 2, 3)])
    to = F.explode(F.array(_resolved(F.col("url"), href), _resolved(F.col("url"), F.regexp_extract("meta", _URL, 1))))
    return tags.select("url", to.alias("to")).select(node_of(F.col("url")).alias("src"), node_of(F.col("to")).alias("dst")).filter("src is not null and dst is not null")


def best_rules(places: DataFrame, rules: DataFrame) -> DataFrame:
    """places (host, path, each once) with the longest rule that fits: (host, path, rule, verdict); others are left out.

    rules: (verdict, rule_host, rule_path). A rule meets its hosts in an equality join on every suffix of the host, so
    neither side is paired with all of the other and the rules may be many.
    """
    parts = F.split("host", r"\.")
    suffix = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts) - i + 1), ".")))
    met = places.select("host", "path", suffix.alias("rule_host")).join(rules, "rule_host").filter(F.col("path").startswith(F.col("rule_path")))
    rule = F.concat("rule_host", "rule_path")
    # of equal length only an allow and a block of the same text can be: the allow counts
    best = F.max(F.struct(F.char_length(rule).alias("n"), (F.col("verdict") == "allow").alias("allow"), rule.alias("rule"), F.col("verdict")))
    return met.groupBy("host", "path").agg(best.alias("b")).select("host", "path", "b.rule", "b.verdict")


def judge(pages: DataFrame, rules: DataFrame, edges: DataFrame, scratch: Scratch, url_col: str = "url", default: str = "allow") -> DataFrame:
    """pages with host, path, rule and verdict (columns of these names are replaced).

    rules as in best_rules(); edges (src, dst) of resources as node_of() names them, from link_edges() and from redirect
    logs. A page's own rule decides. A page without one takes its aliases' decision: allow if a rule allows one, else
    block if a rule blocks one, else default. Aliases need not be pages. Null URLs and such without :// have empty host
    and path, no rule and no alias. Repeated rows stay. An empty table gives no rows.
    """
    url = F.col(url_col)
    kept = pages.drop("host", "path", "rule", "verdict")
    rows = kept.select(F.struct("*").alias("row"), host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("node"))
    edges = scratch.save(edges.distinct(), "edges")
    alias = scratch.save(connected_components(edges, scratch), "aliases")
    node_host = F.regexp_extract("node", r"^[^/?#]*", 0)
    node_path = F.regexp_extract("node", r"^[^/?#]*([^?#]*)", 1)
    alias = alias.withColumns({"host": node_host, "path": node_path})
    places = rows.select("host", "path").union(alias.select("host", "path")).distinct()
    best = scratch.save(best_rules(places, rules), "rules")
    groups = alias.join(best, ["host", "path"]).groupBy("component").agg(F.when(F.max(F.col("verdict") == "allow"), "allow").otherwise("block").alias("inherited"))
    inherited = alias.join(groups, "component").select("node", "inherited")
    out = rows.join(best, ["host", "path"], "left").join(inherited, "node", "left")
    verdict = F.coalesce("verdict", "inherited", F.lit(default))
    return out.select("row.*", "host", "path", "rule", verdict.alias("verdict"))
