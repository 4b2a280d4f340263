"""URL filters: host and path rules, whose decisions reach redirect aliases.

Native: DataFrame functions only. A url's own rule (the longest that fits) decides. A url without one takes the
decision of its alias component: components are closed over redirect and canonical-link edges, and within a component
an explicit allow of any member goes before a block of any other; without either the verdict is allow.

Host: what follows the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; path: what follows up to `?`, `#` or
the end. A rule fits its host and all subdomains of it if the path starts with the rule's path.

Edges come from every <link> whose rel has the word canonical and every <meta http-equiv=refresh> of a page, outside of
comments and scripts, and from an optional table of redirects (source, target). Targets are resolved against the page's
url (absolute, `//host/x`, `/x`, `x`, `../x`, `?q`; <base> is not read) after character references for the
characters of urls are decoded; those of other schemes (`mailto:x`) are none. Urls are one node if they differ only in
their fragment, the case of scheme and host, or dot segments.

Defined results: a null url or one without `://` has an empty host and path, no rule and no aliases; a null html has no
edges; repeated rows each give a row; of rules with the same host and path, block counts before allow; other columns are not read.
An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilake.llm.common import checked, connected_components, save, table

#: The rules of the registered query: host, path, verdict.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
#: Up to so many rules are tried one by one in the row; more are found by a join on the host's suffixes.
INLINE_RULES = 64

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Tags with their quoted values, what hides tags, and the value of an attribute (three ways of quoting).
_TAG = r"(?is)<(?:link|meta)(?=[\s/])(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+>"
_HIDDEN = r"(?is)<!--.*?(?:-->|$)|<script\b.*?(?:</script|$)"
_VALUE = r"\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
# fixed values: character references of characters that stand in urls
_REFERENCES = {"&quot;": '"', "&apos;": "'", "&#39;": "'", "&#47;": "/", "&#x2f;": "/", "&#58;": ":", "&#x3a;": ":", "&#63;": "?", "&#x3f;": "?", "&#61;": "=", "&#x3d;": "=", "&#38;": "&", "&#x26;": "&", "&amp;": "&"}


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + F.lit(3), F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + F.lit(1), F.greatest(F.length(rest), F.lit(1))), "^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def with_rule(urls: DataFrame, rules: DataFrame, inline: int = INLINE_RULES) -> DataFrame:
    """urls (host, path, ...) with the longest rule that fits, as struct<rule, verdict> in the column matched (null: none fits)."""
    rules = rules.where("host is not null and path is not null and verdict is not null").select("host", "path", "verdict")
    few = rules.limit(inline + 1).collect()
    rank = lambda h, p, v: F.struct(F.length(F.concat(h, p)).alias("size"), v.alias("verdict"), F.concat(h, p).alias("rule"))
    if len(few) <= inline:
        fits = [F.when(((F.col("host") == r.host) | F.endswith("host", F.lit("." + r.host))) & F.startswith("path", F.lit(r.path)), rank(F.lit(r.host), F.lit(r.path), F.lit(r.verdict))) for r in few]
        best = F.array_max(F.array_compact(F.array(*fits))) if fits else F.lit(None).cast("struct<size:int,verdict:string,rule:string>")
        return urls.withColumn("__best", best).withColumn("matched", F.when(F.col("__best").isNotNull(), F.struct(F.col("__best.rule").alias("rule"), F.col("__best.verdict").alias("verdict")))).drop("__best")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    keys = urls.select("host", "path").distinct()
    tried = keys.select("host", "path", F.explode(suffixes).alias("suffix"))
    rule = rules.select(F.col("host").alias("suffix"), F.col("path").alias("start"), "verdict")
    found = tried.join(checked(rule), "suffix").where(F.startswith("path", "start"))
    found = found.groupBy("host", "path").agg(F.max(rank(F.col("suffix"), F.col("start"), F.col("verdict"))).alias("__best"))
    found = found.select("host", "path", F.struct(F.col("__best.rule").alias("rule"), F.col("__best.verdict").alias("verdict")).alias("matched"))
    return urls.join(found, ["host", "path"], "left")


def _attribute(tag: Column, name: str) -> Column:
    """The value of a tag's attribute, character references decoded; empty if there is none."""
    pattern = rf"(?is)[\s\"'/]{name}{_VALUE}"
    value = F.concat(*(F.regexp_extract(tag, pattern, k) for k in (1, 2, 3)))
    for reference, character in _REFERENCES.items():  # & last, so that nothing is decoded twice
        value = F.regexp_replace(value, f"(?i){reference}", character)
    return F.regexp_replace(value, r"^[\s]+|[\s]+$|[\t\r\n]", "")


def _without_dots(path: Column) -> Column:
    """A path without its segments . and .. ."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)

    def step(acc: Column, x: Column) -> Column:
        return F.when(x == ".", acc).when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1)))).otherwise(F.concat(acc, F.array(x)))

    kept = F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(F.lit("")), step)
    clean = F.array_join(F.when(last.isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept), "/")
    return F.when(F.regexp_like(path, F.lit(r"(?s)/\.\.?(?:/|$)")), clean).otherwise(path)


def _node(url: Column) -> Column:
    """What urls have in common that are one node: no fragment, scheme and host in small letters, no dot segments."""
    site = F.translate(F.regexp_extract(url, r"^(?s)(.*?://[^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(url, r"^(?s).*?://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(url, r"^(?s).*?://[^?#]*(\?[^#]*)", 1)
    return F.when(F.instr(url, "://") > 0, F.concat(site, _without_dots(path), query))


def _resolved(url: Column, target: Column) -> Column:
    """The absolute url of a page's target; null if it is none."""
    scheme = F.regexp_extract(url, r"^(?s)(.*?)://", 1)
    site = F.regexp_extract(url, r"^(?s)(.*?://[^/?#]*)", 1)
    page = F.regexp_extract(url, r"^(?s)(.*?://[^?#]*)", 1)
    path = F.regexp_extract(url, r"^(?s).*?://[^/?#]*([^?#]*)", 1)
    folder = F.concat(site, F.when(F.contains(path, F.lit("/")), F.regexp_extract(path, r"^(?s)(.*/)", 1)).otherwise("/"))
    return (
        F.when(target.isNull() | (target == "") | F.startswith(target, F.lit("#")), None)
        .when(F.regexp_like(target, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*://")), target)
        .when(F.regexp_like(target, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*:")), None)
        .when(F.startswith(target, F.lit("//")), F.concat(scheme, F.lit(":"), target))
        .when(F.startswith(target, F.lit("/")), F.concat(site, target))
        .when(F.startswith(target, F.lit("?")), F.concat(page, target))
        .otherwise(F.concat(folder, target))
    )


def alias_edges(pages: DataFrame) -> DataFrame:
    """Edges a (the page's url) to b (a canonical or refresh target), both as nodes."""
    low = F.lower("html")
    pages = pages.where(F.contains(low, F.lit("canonical")) | F.contains(low, F.lit("refresh"))).where(F.instr("url", "://") > 0)
    tags = F.regexp_extract_all(F.regexp_replace("html", _HIDDEN, " "), F.lit(_TAG), F.lit(0))
    tags = pages.select("url", F.explode(tags).alias("tag"))
    is_link = F.startswith(F.lower("tag"), F.lit("<link"))
    canonical = is_link & F.array_contains(F.split(F.lower(_attribute(F.col("tag"), "rel")), r"\s+"), "canonical")
    refresh = ~is_link & (F.lower(_attribute(F.col("tag"), "http-equiv")) == "refresh")
    content = F.regexp_replace(F.regexp_extract(_attribute(F.col("tag"), "content"), r"(?is)\burl\s*=\s*(.*)$", 1), r"^[\"']|[\"'].*$", "")
    target = F.when(canonical, _attribute(F.col("tag"), "href")).when(refresh, content)
    found = tags.where(canonical | refresh).select("url", target.alias("target"))
    return found.select(_node(F.col("url")).alias("a"), _node(_resolved(F.col("url"), F.col("target"))).alias("b")).where("b is not null and a <> b")


def judge(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None, inline: int = INLINE_RULES) -> DataFrame:
    """One row per row of pages (page_id, url, html): page_id, host, path, rule, verdict."""
    edges = alias_edges(pages)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(_node(F.col("source")).alias("a"), _node(F.col("target")).alias("b")))
    nodes = connected_components(edges)
    host, path = host_and_path(F.col("node"))
    ruled = with_rule(nodes.withColumns({"host": host, "path": path}), rules, inline)
    groups = ruled.groupBy("component").agg(F.max(F.col("matched.verdict") == "allow").alias("allowed"), F.max(F.col("matched.verdict") == "block").alias("blocked"))
    taken = nodes.join(groups, "component").where("blocked and not coalesce(allowed, false)").select(F.col("node").alias("__node"), F.lit("block").alias("__taken"))
    host, path = host_and_path(F.col("url"))
    own = with_rule(pages.select("page_id", "url").withColumns({"host": host, "path": path}), rules, inline)
    own = own.withColumn("__node", _node(F.col("url"))).join(checked(save(taken, "taken")), "__node", "left")
    return own.select("page_id", "host", "path", F.col("matched.rule").alias("rule"), F.coalesce("matched.verdict", "__taken", F.lit("allow")).alias("verdict"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge(table(spark, sf_dir, "pages").select("page_id", "url", "html"), rules)


def _sql_parts(url: str) -> str:
    rest = f"(CASE WHEN strpos({url}, '://') > 0 THEN substr({url}, strpos({url}, '://') + 3) ELSE '' END)"
    return f"translate(regexp_extract({rest}, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(substr({rest}, length(regexp_extract({rest}, '^[^/?#]*')) + 1), '^[^?#]*') AS path"


QUERIES = {"op7_url_filter": op7_url_filter}
ORACLE_SQL = {
    "op7_url_filter": rf"""
WITH RECURSIVE rules(rhost, rpath, rverdict) AS (VALUES {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)}),
t AS (
  SELECT url, unnest([regexp_extract(regexp_extract(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>'), '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1),
                      regexp_extract(regexp_extract(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>'), '(?is)\burl\s*=\s*["'']?([^"''\s>]+)', 1)]) AS target
  FROM pages WHERE strpos(url, '://') > 0),
e0 AS (
  SELECT regexp_replace(url, '(?s)#.*$', '') AS a,
         regexp_replace(CASE WHEN strpos(target, '://') > 0 THEN target WHEN starts_with(target, '/') AND NOT starts_with(target, '//') THEN regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) || target END, '(?s)#.*$', '') AS b
  FROM t),
e AS (SELECT a, b FROM e0 WHERE b IS NOT NULL AND a <> b UNION SELECT b, a FROM e0 WHERE b IS NOT NULL AND a <> b),
r AS (SELECT a AS node, a AS root FROM (SELECT DISTINCT a FROM e) UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node),
n AS (SELECT node, min(root) AS component, {_sql_parts("node")} FROM r GROUP BY node),
nv AS (SELECT node, component, arg_max(rverdict, length(rhost || rpath)) AS v FROM n LEFT JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY ALL),
g AS (SELECT component FROM nv GROUP BY component HAVING coalesce(bool_or(v = 'block'), false) AND NOT coalesce(bool_or(v = 'allow'), false)),
x AS (SELECT node FROM nv JOIN g USING (component)),
p AS (SELECT page_id, coalesce(url, '') AS u, {_sql_parts("coalesce(url, '')")} FROM pages),
m AS (SELECT page_id, u, host, path, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(rverdict, length(rhost || rpath)) AS v
      FROM p LEFT JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY ALL)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN x.node IS NOT NULL THEN 'block' END, 'allow') AS verdict
FROM m LEFT JOIN x ON x.node = regexp_replace(m.u, '(?s)#.*$', '')
""",
}
