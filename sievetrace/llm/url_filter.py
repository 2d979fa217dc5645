"""URL filter with redirect equivalence, in DataFrame functions only.

A page's URL is judged by the longest rule that fits.  Pages without a rule take their aliases' decision:
a page's normal form (host in lower case; no scheme, fragment or tracking parameters) is joined by the
targets of its canonical links and of its refresh redirects, and by those of a table of redirects if there
is one, and connected components over those edges carry decisions.  A component with a blocked member blocks
its members that have no rule of their own, unless a member is explicitly allowed: an allow takes precedence.
Components without a block allow.

A short list of rules is part of the plan; a longer one, or a table of rules of any size, is joined: by the
suffixes of hosts first, then by the prefixes of paths that have a length which some rule of that host has.

Defined cases: a null URL, or one without ``://``, has empty host and path, no rule and is its own
component (allowed); a null html declares no aliases; a rule that is given with both verdicts allows; a null
end of a redirect is no edge; repeated pages are judged alike, each row once; an empty table gives an empty
table; other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievetrace.llm.components import connected_components
from sievetrace.llm.runtime import table

#: (verdict, host and path prefix) of the registered query; fixed values.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Rules that are literals of the plan; a longer list is joined as a table, with the same results.
MOST_LITERALS = 200
#: Query parameters that don't change a page.
TRACKING = "utm_[a-z]+|ref|fbclid|gclid"

_SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?"
_CANONICAL = r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*\bhref\s*=\s*["']?([^"'\s>]+)"""
_REFRESH = r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*\bcontent\s*=\s*["']?[^"'>]*?url\s*=\s*["']?([^"'\s>]+)"""


def _lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def host(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    return _lower(F.coalesce(F.regexp_extract(url, _SPLIT, 1), F.lit("")))


def path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, _SPLIT, 2), F.lit(""))


def normal_form(url: Column) -> Column:
    """Host, path and the query without tracking parameters; null where there is no host."""
    query = F.regexp_replace(F.regexp_extract(url, _SPLIT, 3), rf"(?<=[?&])(?:{TRACKING})=[^&]*(?:&|$)", "")
    return F.when(host(url) != "", F.concat(host(url), path(url), F.regexp_replace(query, "[?&]$", "")))


def rule(h: Column, p: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """Struct of the longest fitting rule and its verdict; null if none fits."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, text in sorted(rules, key=lambda r: (len(r[1]), r[1], r[0] == "allow")):
        name, _, prefix = text.partition("/")
        fits = ((h == name) | h.endswith(f".{name}")) & p.startswith(f"/{prefix}")
        out = F.when(fits, F.struct(F.lit(text).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def joined_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, found) of the distinct (host, path) that a rule of the table (verdict, rule) fits: :func:`rule` as joins."""
    split = F.regexp_extract("rule", r"(?s)^([^/]*)/?(.*)$", 2)
    rules = rules.filter("rule is not null and verdict is not null").groupBy("rule").agg(F.min("verdict").alias("verdict"))  # 'allow' is before 'block'
    rules = rules.select("rule", "verdict", F.substring_index("rule", "/", 1).alias("name"), F.concat(F.lit("/"), split).alias("prefix"))
    lengths = rules.groupBy("name").agg(F.collect_set(F.length("prefix")).alias("lengths"))  # at most as many as a path has characters
    urls = urls.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    hosts = urls.select("host").distinct().select("host", F.explode(suffixes).alias("name")).join(lengths, "name")
    tried = urls.join(hosts, "host").select("host", "path", "name", F.explode("lengths").alias("n")).filter(F.col("n") <= F.length("path"))
    fits = tried.withColumn("prefix", F.substring("path", F.lit(1), F.col("n"))).join(rules, ["name", "prefix"])
    return fits.groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), F.struct(F.length("rule"), "rule")).alias("found"))


def _found(urls: DataFrame, rules: tuple[tuple[str, str], ...] | DataFrame) -> DataFrame:
    """``urls`` (host, path, ...) with ``found``."""
    if isinstance(rules, DataFrame):
        return urls.join(joined_rules(urls, rules), ["host", "path"], "left")
    if len(rules) > MOST_LITERALS:
        return _found(urls, urls.sparkSession.createDataFrame(list(rules), "verdict string, rule string"))
    return urls.withColumn("found", rule(F.col("host"), F.col("path"), rules))


def _absolute(target: Column, url: Column) -> Column:
    """A link as an absolute URL: absolute, ``//host``, ``/path`` and relative forms."""
    target = F.replace(target, F.lit("&amp;"), F.lit("&"))
    base = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    return (
        F.when(target.contains("://"), target)
        .when(target.startswith("//"), F.concat(F.lit("http:"), target))
        .when(target.startswith("/"), F.concat(base, target))
        .otherwise(F.concat(F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/"))), target))
    )


def judge(
    pages: DataFrame, rules: tuple[tuple[str, str], ...] | DataFrame = RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", redirects: DataFrame | None = None
) -> DataFrame:
    """id, host, path, rule and verdict of each page, and how aliases had a part in it.

    ``component`` is the smallest normal form among the aliases and ``members`` their number (null without a host);
    ``decided_by`` is the alias whose rule decides a page without a rule: the smallest allowed one of those that a
    block would reach, else the smallest blocked one; null where no alias is blocked.  ``rules`` is a list or a table
    (verdict, rule), ``redirects`` a table (from_url, to_url).
    """
    url, html = F.col(url_col), F.coalesce(F.col(html_col), F.lit(""))
    links = F.concat(F.regexp_extract_all(html, F.lit(_CANONICAL), 1), F.regexp_extract_all(html, F.lit(_REFRESH), 1))
    seen = pages.select(F.col(id_col).alias("page"), host(url).alias("host"), path(url).alias("path"), normal_form(url).alias("node"), F.transform(links, lambda t: _absolute(t, url)).alias("targets"))
    seen = table(_found(seen, rules))
    aliases = seen.filter("node is not null and size(targets) > 0").select("node", F.explode("targets").alias("to"))
    if redirects is not None:
        told = redirects.select(F.col("from_url").alias("from"), F.col("to_url").alias("to")).filter("from is not null and to is not null")
        aliases = aliases.union(told.select(normal_form(F.col("from")).alias("node"), "to")).union(told.select(normal_form(F.col("to")), "from")).filter("node is not null")
    aliases = aliases.select("node", normal_form(F.col("to")).alias("target"), host(F.col("to")).alias("host"), path(F.col("to")).alias("path")).filter("target is not null")
    aliases = table(_found(aliases, rules))
    parts = connected_components(aliases, "node", "target")

    facts = seen.select("node", "found").union(aliases.select("target", "found")).filter("node is not null and found is not null")
    ruled = lambda verdict: F.min(F.when(F.col("found.verdict") == verdict, F.col("node"))).alias(verdict)
    facts = facts.groupBy("node").agg(ruled("block"), ruled("allow"))
    facts = facts.join(parts, "node", "left").groupBy(F.coalesce("component", "node").alias("component")).agg(F.min("block").alias("block"), F.min("allow").alias("allow"))
    facts = facts.filter("block is not null")
    sizes = parts.groupBy("component").agg(F.count("*").alias("size"))

    seen = seen.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    seen = seen.join(facts, "component", "left").join(sizes, "component", "left")
    inherited = F.when(F.col("block").isNotNull() & F.col("allow").isNull(), "block")
    members = F.when(F.col("node").isNotNull(), F.coalesce("size", F.lit(1).cast("long")))
    decided_by = F.when(F.col("found").isNull() & F.col("block").isNotNull(), F.coalesce("allow", "block"))
    verdict = F.coalesce("found.verdict", inherited, F.lit("allow"))
    return seen.select(F.col("page").alias(id_col), "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"), "component", members.alias("members"), decided_by.alias("decided_by"))


def oracle_sql() -> str:
    """DuckDB SQL for :func:`judge` with the registered rules."""
    return r"""
WITH RECURSIVE u AS (
  SELECT page_id, url, coalesce(html, '') AS html,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?', 3), '') AS query
  FROM pages),
t AS (
  SELECT u.page_id, unnest(list_concat(
    regexp_extract_all(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*\bhref\s*=\s*["'']?([^"''\s>]+)', 1),
    regexp_extract_all(html, '(?is)<link\b[^>]*\bhref\s*=\s*["'']?([^"''\s>]+)[^>]*\brel\s*=\s*["'']?canonical\b', 1),
    regexp_extract_all(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*\bcontent\s*=\s*["'']?[^"''>]*?url\s*=\s*["'']?([^"''\s>]+)', 1))) AS raw, url FROM u),
a AS (
  SELECT page_id, CASE WHEN contains(raw, '://') THEN raw WHEN starts_with(raw, '//') THEN 'http:' || raw
    WHEN starts_with(raw, '/') THEN regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) || raw
    ELSE regexp_replace(regexp_extract(url, '(?s)^(.*?://[^/?#]*(/[^?#]*/|/)?)', 1), '/?$', '/') || raw END AS url
  FROM (SELECT page_id, replace(raw, '&amp;', '&') AS raw, url FROM t)),
every AS (
  SELECT page_id, host, path, query, true AS own FROM u UNION ALL
  SELECT page_id, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?', 3), false FROM a),
n AS (
  SELECT page_id, own, host, path,
    CASE WHEN host <> '' THEN host || path || regexp_replace(regexp_replace(regexp_replace(query, '([?&])(utm_[a-z]+|ref|fbclid|gclid)=[^&]*', '\1', 'g'), '&+', '&', 'g'), '[?&]+$', '') END AS node,
    CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
         WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
         WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
         WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM every),
v AS (SELECT *, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS verdict FROM n),
e AS (SELECT o.node AS x, d.node AS y FROM v o JOIN v d ON o.page_id = d.page_id AND o.own AND NOT d.own WHERE o.node <> d.node),
both_ways AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
reach AS (SELECT node AS x, node AS y FROM v WHERE node IS NOT NULL UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON r.y = b.x),
part AS (SELECT x AS node, min(y) AS component FROM reach GROUP BY x),
size AS (SELECT component, count(*) AS members FROM part GROUP BY component),
fact AS (SELECT component, min(CASE WHEN verdict = 'block' THEN node END) AS block, min(CASE WHEN verdict = 'allow' THEN node END) AS allow FROM v JOIN part USING (node) GROUP BY component)
SELECT v.page_id, v.host, v.path, v.rule, coalesce(v.verdict, CASE WHEN f.block IS NOT NULL AND f.allow IS NULL THEN 'block' END, 'allow') AS verdict, p.component, z.members,
  CASE WHEN v.rule IS NULL AND f.block IS NOT NULL THEN coalesce(f.allow, f.block) END AS decided_by
FROM v LEFT JOIN part p USING (node) LEFT JOIN fact f USING (component) LEFT JOIN size z USING (component) WHERE v.own
"""
