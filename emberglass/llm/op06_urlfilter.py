"""Query: pages judged by five rules, and by the rules of their aliases."""

from pyspark.sql import DataFrame, SparkSession

from emberglass.llm.urlfilter import judge, link_edges
from emberglass.storage import Scratch

NAME = "op6_url_filter"
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
_LOW = "translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_REST = "CASE WHEN contains({x}, '://') THEN substr({x}, strpos({x}, '://') + 3) ELSE '' END"
_NODE = f"CASE WHEN contains({{x}}, '://') THEN {_LOW.format(x='regexp_extract(' + _REST + ', $$^[^/?#]*$$)')} || regexp_extract({_REST}, $$^[^/?#]*([^#]*)$$, 1) END"
SQL = rf"""
WITH RECURSIVE r(verdict, rule_host, rule_path) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
p AS (SELECT page_id, url, html, coalesce({_LOW.format(x="regexp_extract(" + _REST.format(x="url") + ", '^[^/?#]*')")}, '') AS host, coalesce(regexp_extract({_REST.format(x="url")}, '^[^/?#]*([^?#]*)', 1), '') AS path, {_NODE.format(x="url")} AS node FROM pages),
t AS (SELECT *, regexp_extract(html, $$(?is)<link\b[^>]*\brel\s*=\s*["']?[^"'>]*\bcanonical\b[^>]*>$$) AS link, regexp_extract(html, $$(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>$$) AS meta FROM p WHERE node IS NOT NULL AND regexp_matches(html, '(?i)canonical|http-equiv')),
h AS (SELECT url, node, host, path, trim(regexp_replace(regexp_extract(link, $$(?is)\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))$$, 1) || regexp_extract(link, $$(?is)\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))$$, 2) || regexp_extract(link, $$(?is)\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))$$, 3), '(?i)&amp;', '&', 'g')) AS href FROM t
      UNION ALL SELECT url, node, host, path, trim(regexp_replace(regexp_extract(meta, $$(?is)\burl\s*=\s*['"]?([^"'>]+)$$, 1), '(?i)&amp;', '&', 'g')) FROM t),
a AS (SELECT node, CASE WHEN href = '' THEN NULL WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN href WHEN starts_with(href, '//') THEN 'http:' || href WHEN starts_with(href, '/') THEN regexp_extract(url, '^([^:]*)://', 1) || '://' || host || href
        WHEN regexp_matches(href, '^(#|[A-Za-z][A-Za-z0-9+.-]*:)') THEN NULL WHEN starts_with(href, '?') THEN 'http://' || host || path || href ELSE 'http://' || host || coalesce(nullif(regexp_extract(path, '^(.*/)', 1), ''), '/') || href END AS target FROM h),
e AS (SELECT DISTINCT node AS x, {_NODE.format(x="target")} AS y FROM a WHERE target IS NOT NULL),
u AS (SELECT x, y FROM e WHERE y IS NOT NULL UNION SELECT y, x FROM e WHERE y IS NOT NULL),
c AS (SELECT x AS node, x AS root FROM u UNION SELECT u.y, c.root FROM c JOIN u ON u.x = c.node),
m AS (SELECT node, min(root) AS component FROM c GROUP BY node),
places AS (SELECT host, path FROM p UNION SELECT regexp_extract(node, '^[^/?#]*'), regexp_extract(node, '^[^/?#]*([^?#]*)', 1) FROM m),
f AS (SELECT host, path, rule_host || rule_path AS rule, verdict, row_number() OVER (PARTITION BY host, path ORDER BY length(rule_host || rule_path) DESC, verdict) AS nth FROM places JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)),
g AS (SELECT component, CASE WHEN bool_or(verdict = 'allow') THEN 'allow' ELSE 'block' END AS inherited FROM m JOIN f ON f.nth = 1 AND f.host = regexp_extract(m.node, '^[^/?#]*') AND f.path = regexp_extract(m.node, '^[^/?#]*([^?#]*)', 1) GROUP BY component)
SELECT page_id, p.host, p.path, f.rule, coalesce(f.verdict, g.inherited, 'allow') AS verdict FROM p LEFT JOIN f ON f.nth = 1 AND f.host = p.host AND f.path = p.path LEFT JOIN m ON m.node = p.node LEFT JOIN g ON g.component = m.component
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rules = spark.createDataFrame(RULES, "verdict string, rule_host string, rule_path string")
    judged = judge(pages.select("page_id", "url"), rules, link_edges(pages), Scratch(spark, "urls"))
    return judged.select("page_id", "host", "path", "rule", "verdict")
