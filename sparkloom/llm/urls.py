"""Operator 6. URL filter with redirect equivalence.

URLs are reduced to a key (no scheme, www./m. host, default document, .html,
closing slash, fragment or tracking parameters). Redirect (meta refresh) and
canonical-link edges (of all such tags of a page, attributes in any order, targets
resolved against the page's url) between keys are closed by distributed connected
components; a block on any alias then holds for all of them unless some alias
is allowed, which wins.

Rules are rows (action 'block' or 'allow', kind 'domain' or 'prefix', value):
a domain holds for its subdomains, a prefix for all paths below it (whole
segments). Both are matched by equality on the few suffixes or prefixes of a key,
so a rule table of any size is a hash join; Spark broadcasts it only below its
own threshold.

Defined cases: a null or empty url has key '' , no rule and no alias, and
passes; null html has no edges; repeated pages are judged each time; ties cannot
arise (allow beats block); an empty target, one of another scheme than http and
one on a page without a host are no edges; other
columns stay behind; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.runtime import cut

from .components import connected_components

#: The blocklist that applies unless a caller brings one.
DEFAULT_RULES = (
    ("block", "domain", "ththth.example.org"),
    ("block", "domain", "tiontion.example.com"),
    ("block", "domain", "tionble.example.com"),
    ("block", "prefix", "tionsh.example.net/de"),
    ("allow", "domain", "blog.ththth.example.org"),
    ("allow", "prefix", "tiontion.example.com/en"),
)
RULES = "action string, kind string, value string"
#: Expressions that Spark and the SQL below share. An attribute's value is quoted in either way or bare.
_TAG = r"(?i)<(?:link|meta)\s[^>]*>"
_CANONICAL = r"(?i)^<link\s(?:.*\s)?rel\s*=\s*[\"']?(?:[^\"'>]*\s)?canonical[\s\"'/>]"
_REFRESH = r"(?i)^<meta\s(?:.*\s)?http-equiv\s*=\s*[\"']?\s*refresh[\s\"'/>]"
_HREF = r"(?is)\shref\s*=\s*(?:\"\s*([^\"]*)\"|'\s*([^']*)'|([^\s\"'>]+))"
_CONTENT = r"(?is)[;\s\"'=]url\s*=\s*[\"']?\s*([^\s\"'>]+)"


def rules_table(spark: SparkSession, rules=DEFAULT_RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), RULES)


def url_key(url: Column) -> Column:
    x = F.regexp_replace(F.lower(F.trim(F.coalesce(url.cast("string"), F.lit("")))), r"^[a-z]+://", "")
    x = F.regexp_replace(x, r"#.*$", "")
    x = F.regexp_replace(x, r"[?&](utm_[a-z]+|ref|fbclid|gclid)=[^&]*", "")
    x = F.regexp_replace(x, r"^(www|m)\.", "")
    x = F.regexp_replace(x, r"/index\.html?$", "")
    return F.regexp_replace(x, r"(\.html?)?/*$", "")


def _without_dots(path: Column) -> Column:
    """A path whose . and .. segments are followed."""
    step = lambda acc, x: F.when(x == "..", F.regexp_replace(acc, r"/?[^/]*$", "")).when(x == ".", acc).otherwise(F.concat(acc, F.lit("/"), x))
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), F.aggregate(F.split(path, "/"), F.lit(""), step)).otherwise(F.concat(F.lit("/"), path))


def resolve(target: Column, url: Column) -> Column:
    """The address that `target` means on the page `url`; null if it means none of http."""
    t = F.trim(F.replace(target, F.lit("&amp;"), F.lit("&")))
    scheme, host = F.regexp_extract(F.trim(url), r"(?i)^(https?:)//", 1), F.regexp_extract(F.trim(url), r"(?i)^https?://([^/?#]+)", 1)
    page = F.regexp_extract(F.trim(url), r"(?i)^https?://[^/?#]+/?([^?#]*)", 1)
    folder = F.regexp_replace(page, r"[^/]*$", "")
    path, rest = F.regexp_extract(t, r"^([^?#]*)", 1), F.regexp_extract(t, r"^[^?#]*(.*)$", 1)
    here = F.concat(scheme, F.lit("//"), host)
    return (
        F.when(t == "", None)
        .when(t.rlike(r"(?i)^https?://[^/]"), t)
        .when(t.rlike(r"(?i)^[a-z][a-z0-9+.\-]*:") | (host == ""), None)
        .when(t.startswith("//"), F.concat(scheme, t))
        .when(t.startswith("/"), F.concat(here, _without_dots(F.substr(path, F.lit(2))), rest))
        .when(t.startswith("?") | t.startswith("#"), F.concat(here, F.lit("/"), page, t))
        .otherwise(F.concat(here, _without_dots(F.concat(folder, path)), rest))
    )


def url_edges(pages: DataFrame) -> DataFrame:
    """(a, b): keys that a redirect or a canonical link makes one."""
    tags = pages.where("html is not null and url is not null and (html ilike '%canonical%' or html ilike '%refresh%')").select("url", F.explode(F.regexp_extract_all("html", F.lit(_TAG), 0)).alias("tag"))
    tag = F.col("tag")
    href = F.concat(*[F.regexp_extract(tag, _HREF, k) for k in (1, 2, 3)])
    target = F.when(tag.rlike(_CANONICAL.replace("(?i)", "(?is)")), href).when(tag.rlike(_REFRESH.replace("(?i)", "(?is)")), F.regexp_extract(tag, _CONTENT, 1))
    return (
        tags.select("url", target.alias("t"))
        .where("t is not null")
        .select(url_key(F.col("url")).alias("a"), url_key(resolve(F.col("t"), F.col("url"))).alias("b"))
        .where("a <> '' and b <> '' and a <> b")
        .distinct()
    )


def judge_urls(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(page_id, url, url_key, site_group, decision) of every page; decision is block, allow or pass."""
    rules = rules.where("action in ('block', 'allow') and value is not null").select("action", "kind", F.lower("value").alias("value"))
    edges = url_edges(pages)
    aliases = cut(connected_components(edges))
    page_keys = pages.select(F.col("page_id"), F.col("url"), url_key(F.col("url")).alias("url_key"))
    keys = page_keys.select("url_key").union(aliases.select("node")).where("url_key <> ''").distinct()
    host = F.element_at(F.split("url_key", "[/?]"), 1)
    labels = F.split(host, r"\.")
    parts = F.split(F.element_at(F.split("url_key", r"\?"), 1), "/")
    tests = keys.select(
        "url_key",
        F.explode(
            F.concat(
                F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(F.lit("domain").alias("kind"), F.concat_ws(".", F.slice(labels, i, F.size(labels))).alias("value"))),
                F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.lit("prefix").alias("kind"), F.concat_ws("/", F.slice(parts, 1, i)).alias("value"))),
            )
        ).alias("t"),
    ).select("url_key", "t.kind", "t.value")
    said = (
        tests.join(rules, ["kind", "value"])
        .join(aliases.withColumnRenamed("node", "url_key"), "url_key", "left")
        .groupBy(F.coalesce("component", "url_key").alias("site_group"))
        .agg(F.max(F.when(F.col("action") == "allow", 2).otherwise(1)).alias("rank"))
    )
    return (
        page_keys.join(aliases.withColumnRenamed("node", "url_key"), "url_key", "left")
        .withColumn("site_group", F.coalesce("component", "url_key"))
        .join(said, "site_group", "left")
        .select("page_id", "url", "url_key", "site_group", F.when(F.col("rank") == 2, "allow").when(F.col("rank") == 1, "block").otherwise("pass").alias("decision"))
    )


ORACLE = """
WITH RECURSIVE raw AS (SELECT page_id, url, html, {key_url} AS url_key FROM pages),
tags AS (SELECT url, url_key AS a, unnest(regexp_extract_all(html, '{tag}')) AS tag FROM raw WHERE html IS NOT NULL AND url IS NOT NULL),
heard AS (SELECT a, trim(url) AS url, trim(replace(CASE WHEN regexp_matches(tag, '{canonical}') THEN regexp_extract(tag, '{href}', 1) || regexp_extract(tag, '{href}', 2) || regexp_extract(tag, '{href}', 3)
  WHEN regexp_matches(tag, '{refresh}') THEN regexp_extract(tag, '{content}', 1) END, '&amp;', '&')) AS t FROM tags),
parts AS (SELECT a, t, regexp_extract(url, '(?i)^(https?:)//', 1) AS scheme, regexp_extract(url, '(?i)^https?://([^/?#]+)', 1) AS host, regexp_extract(url, '(?i)^https?://[^/?#]+/?([^?#]*)', 1) AS page,
  regexp_extract(t, '^([^?#]*)', 1) AS path, regexp_extract(t, '^[^?#]*(.*)$', 1) AS rest FROM heard WHERE t <> ''),
targets AS (SELECT a, CASE WHEN regexp_matches(t, '(?i)^https?://[^/]') THEN t WHEN regexp_matches(t, '(?i)^[a-z][a-z0-9+.-]*:') OR host = '' THEN NULL
  WHEN starts_with(t, '//') THEN scheme || t WHEN starts_with(t, '/') THEN scheme || '//' || host || {root} || rest
  WHEN regexp_matches(t, '^[?#]') THEN scheme || '//' || host || '/' || page || t ELSE scheme || '//' || host || {relative} || rest END AS t FROM parts),
edges AS (SELECT DISTINCT a, {key_t} AS b FROM targets WHERE t IS NOT NULL),
twoway AS (SELECT a, b FROM edges WHERE a <> '' AND b <> '' AND a <> b UNION SELECT b, a FROM edges WHERE a <> '' AND b <> '' AND a <> b),
reach(node, seen) AS (SELECT a, a FROM twoway UNION SELECT r.node, b.b FROM reach r JOIN twoway b ON b.a = r.seen),
aliases AS (SELECT node, min(seen) AS component FROM reach GROUP BY node),
keys AS (SELECT url_key FROM raw WHERE url_key <> '' UNION SELECT node FROM aliases),
rules(action, kind, value) AS (VALUES {rules}),
said AS (
  SELECT coalesce(a.component, k.url_key) AS site_group, max(CASE r.action WHEN 'allow' THEN 2 ELSE 1 END) AS rank
  FROM keys k LEFT JOIN aliases a ON a.node = k.url_key
  JOIN rules r ON (r.kind = 'domain' AND (regexp_extract(k.url_key, '^[^/?]*') = r.value OR ends_with(regexp_extract(k.url_key, '^[^/?]*'), '.' || r.value)))
    OR (r.kind = 'prefix' AND (split_part(k.url_key, '?', 1) = r.value OR starts_with(split_part(k.url_key, '?', 1), r.value || '/')))
  GROUP BY 1)
SELECT raw.page_id, raw.url, raw.url_key, coalesce(a.component, raw.url_key) AS site_group,
  CASE s.rank WHEN 2 THEN 'allow' WHEN 1 THEN 'block' ELSE 'pass' END AS decision
FROM raw LEFT JOIN aliases a ON a.node = raw.url_key LEFT JOIN said s ON s.site_group = coalesce(a.component, raw.url_key)
"""


def oracle(rules=DEFAULT_RULES) -> str:
    def key(x: str) -> str:
        x = f"regexp_replace(lower(trim(coalesce({x}, ''))), '^[a-z]+://', '')"
        for pattern, g in ((r"#.*$", ""), (r"[?&](utm_[a-z]+|ref|fbclid|gclid)=[^&]*", ", 'g'"), (r"^(www|m)\.", ""), (r"/index\.html?$", ""), (r"(\.html?)?/*$", "")):
            x = f"regexp_replace({x}, '{pattern}', ''{g})"
        return x

    def plain(path: str) -> str:
        step = "CASE x WHEN '..' THEN regexp_replace(acc, '/?[^/]*$', '') WHEN '.' THEN acc ELSE acc || '/' || x END"
        return f"(CASE WHEN regexp_matches({path}, '(^|/)[.][.]?(/|$)') THEN list_reduce(list_prepend('', string_split({path}, '/')), lambda acc, x: {step}) ELSE '/' || {path} END)"

    text = {k: v.replace("(?i)", "(?is)").replace("'", "''") for k, v in {"tag": _TAG, "canonical": _CANONICAL, "refresh": _REFRESH, "href": _HREF, "content": _CONTENT}.items()}
    return ORACLE.format(key_url=key("url"), key_t=key("t"), root=plain("path[2:]"), relative=plain("(regexp_replace(page, '[^/]*$', '') || path)"), rules=", ".join(f"('{a}', '{k}', '{v}')" for a, k, v in rules), **text)
