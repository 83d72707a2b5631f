"""URL filters with redirect equivalence.

Rules name a host and a path prefix; the longest rule that fits decides. Pages
without a fitting rule take the verdict of their equivalents: URLs are nodes,
redirects and canonical links are edges, and connected components carry decisions
to all aliases. In a component an explicit allow wins over any block; a component
without a decision is allowed.

Edges are the page's own canonical links and refreshes (every such tag of its HTML, its
attributes in any order; relative targets resolve against the page's url or its base), the
redirects that nearly every site makes (scheme, www. or m., trailing slash, .html,
index, fragment, tracking parameters: both URLs have one ``canonical`` form), and
any table of known redirects. Components run by joins over 64-bit hashes of
canonical forms; a crowded host or component is a row per task before any shuffle.

Nulls, empties, repeats: a null url or one without "://" has an empty host and path,
fits no rule and has no equivalents but equal urls; a null one is allowed. Null html
has no links. Repeated pages get equal verdicts. Other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditframe.llm.components import components
from auditframe.session import materialize

#: (action, host, path): a rule fits the host and its subdomains where the path begins with the rule's.
Rule = tuple[str, str, str]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SITE_PREFIX = "^(www|m)[.]"
PAGE_SUFFIX = "(/index)?([.]html?)?/*$"
TRACKING = "(^|&)(utm_[^&=]*|ref|fbclid|gclid)=[^&]*"
#: A whole tag, whose quoted values may hold a >; and its attributes.
TAGS = "(?i)<(?:link|meta|base)(?=[\\s/])(?:[^>\"'=]++|=\\s*+\"[^\"]*+\"|=\\s*+'[^']*+'|[^>])*+>"
ATTRIBUTES = "[^\\s\"'<>/=]++(?:\\s*+=\\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\\s>]++))?+"
REFRESH_TARGET = "(?is)^\\s*(?:[0-9.]+\\s*[;,\\s]\\s*(?:url\\s*=\\s*)?|[;,]?\\s*url\\s*=\\s*)(.*)$"
SCHEME = "^[A-Za-z][A-Za-z0-9+.-]*:"
#: Patterns of the SQL, which knows links of the plainest form only.
CANONICAL_LINK = "(?i)<link[^>]{0,200}rel=.?canonical[^>]{0,200}href=[\"']([^\"'>]*)"
REFRESH = "(?i)<meta[^>]{0,200}http-equiv=.?refresh[^>]{0,200}url=([^\"'>]*)"


def host_of(url: Column) -> Column:
    """What lies between the first :// and the next /, ? or #, in lower case (A-Z only); empty for none."""
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(F.coalesce(url, F.lit("")), "://")
    return F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")


def canonical(url: Column) -> Column:
    """The form that a site's usual redirects lead to; a url without a host is its own form."""
    query = F.regexp_extract(_rest(url), "^[^?#]*[?]([^#]*)", 1)
    kept = F.regexp_replace(F.regexp_replace(query, TRACKING, ""), "^&+", "")
    whole = F.concat(
        F.regexp_replace(host_of(url), SITE_PREFIX, ""), F.regexp_replace(path_of(url), PAGE_SUFFIX, ""),
        F.when(kept == "", "").otherwise(F.concat(F.lit("?"), kept)))
    return F.when(host_of(url) == "", F.concat(F.lit(":"), url)).otherwise(whole)


def rule_text(rule: Rule) -> str:
    return rule[1] + rule[2]


def longest_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Struct (rule, action) of the longest rule that fits, null for none; of equally long ones the first in the alphabet, allow first."""
    order = sorted(rules, key=lambda r: (-len(rule_text(r)), rule_text(r), r[0]))
    found = [
        F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(h + p).alias("rule"), F.lit(a).alias("action")))
        for a, h, p in order]
    return F.coalesce(*found) if found else F.lit(None).cast("struct<rule: string, action: string>")


def _unquoted(value: Column) -> Column:
    """What stands in the quotes that a value begins with, or the value itself."""
    quote = F.substring(value, 1, 1)
    inner = F.when(quote == '"', F.regexp_extract(value, '^"([^"]*)', 1)).when(quote == "'", F.regexp_extract(value, "^'([^']*)", 1))
    return F.trim(F.coalesce(inner, value))


def _attribute(tag: Column, name: str) -> Column:
    """The first value of an attribute of a tag (``name`` and ``attributes``), null for none."""
    values = F.filter(tag["attributes"], lambda a: F.lower(F.regexp_extract(a, "^[^=\\s]*", 0)) == name)
    value = F.regexp_replace(F.get(values, F.lit(0)), "^[^=]*=?\\s*", "")
    return F.regexp_replace(_unquoted(value), "(?i)&(amp|#38|#x26);", "&")


def _tags(html: Column) -> Column:
    """Link, meta and base tags as structs of name and attributes."""
    found = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(TAGS), F.lit(0))
    return F.transform(found, lambda t: F.struct(
        F.lower(F.substring(t, 2, 4)).alias("name"),
        F.regexp_extract_all(F.regexp_replace(t, "^<[A-Za-z]+|>$", ""), F.lit(ATTRIBUTES), F.lit(0)).alias("attributes")))


def _linked(tag: Column) -> Column:
    """The target that a tag names as canonical or by a refresh, as written; null for none."""
    canonical_link = F.array_contains(F.split(F.lower(_attribute(tag, "rel")), "\\s+"), "canonical")
    refresh = F.lower(_attribute(tag, "http-equiv")) == "refresh"
    return F.when((tag["name"] == "link") & canonical_link, _attribute(tag, "href")).when(
        (tag["name"] == "meta") & refresh, _unquoted(F.regexp_extract(_attribute(tag, "content"), REFRESH_TARGET, 1)))


def _without_dots(path: Column) -> Column:
    """A path that begins with / without its segments . and .., as far as the root."""
    def step(kept: Column, segment: Column) -> Column:
        up = F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))
        return F.when(segment == ".", kept).when(segment == "..", up).otherwise(F.concat(kept, F.array(segment)))

    end = F.when(path.rlike("/[.]{1,2}$"), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    segments = F.split(F.substring(path, 2, 1 << 30), "/", -1)
    plain = F.concat(F.lit("/"), F.array_join(F.concat(F.aggregate(segments, F.array().cast("array<string>"), step), end), "/"))
    return F.when(path.rlike("/[.]{1,2}(/|$)"), plain).otherwise(path)


def _target(url: Column, found: Column) -> Column:
    """An absolute url for a link found on the page ``url``; null for none, the page itself, and other schemes than those with a host."""
    scheme, host = F.regexp_extract(url, "^[^:/]*", 0), host_of(url)
    path = F.regexp_extract(found, "^[^?#]*", 0)
    after = F.substring(found, F.length(path) + 1, F.length(found))
    directory = F.regexp_extract(path_of(url), "^.*/", 0)
    whole = F.when(path == "", path_of(url)).when(path.startswith("/"), path).otherwise(
        F.concat(F.when(directory == "", "/").otherwise(directory), path))
    inside = F.when(host != "", F.concat(scheme, F.lit("://"), host, _without_dots(whole), after))
    return F.when((found == "") | found.startswith("#"), None).when(found.rlike(SCHEME), F.when(found.rlike(SCHEME + "//"), found)).when(
        found.startswith("//"), F.concat(scheme, F.lit(":"), found)).otherwise(inside)


def judge(pages: DataFrame, rules: list[Rule], redirects: DataFrame | None = None, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, host, path, rule, verdict and url for every page; ``redirects`` are further edges (from_url, to_url)."""
    u, h = F.col(f"`{url}`"), F.col(f"`{html}`")
    tagged = pages.select(F.col(f"`{page_id}`").alias("page_id"), u.alias("url"), _tags(h).alias("tags"))
    bases = F.filter(F.transform(F.filter("tags", lambda t: t["name"] == "base"), lambda t: _attribute(t, "href")), lambda b: b.isNotNull())
    found = tagged.select(
        "page_id", "url", F.coalesce(_target(F.col("url"), F.get(bases, F.lit(0))), F.col("url")).alias("from"),
        F.array_distinct(F.array_compact(F.transform("tags", _linked))).alias("found"))
    links = F.array_compact(F.transform("found", lambda f: _target(F.col("from"), f)))
    base = found.select("page_id", "url", links.alias("links"))
    rows = materialize(base.select("*", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).select(
        "*", F.xxhash64(canonical(F.col("url"))).alias("node"), longest_rule(F.col("host"), F.col("path"), rules).alias("own")), "pages")
    edges = rows.select("url", F.explode("links").alias("to_url")).where("url IS NOT NULL")
    if redirects is not None:
        edges = edges.union(redirects.select(F.col("from_url"), F.col("to_url")).where("from_url IS NOT NULL AND to_url IS NOT NULL"))
    ends = edges.select(*[F.xxhash64(canonical(F.col(c))).alias(n) for c, n in (("url", "a"), ("to_url", "b"))], "url", "to_url")
    joined = components(ends.select("a", "b"))
    sides = [ends.select(F.col(n).alias("node"), F.col(c).alias("url")) for n, c in (("a", "url"), ("b", "to_url"))]
    named = reduce(DataFrame.union, sides).select("node", longest_rule(host_of(F.col("url")), path_of(F.col("url")), rules)["action"].alias("action"))
    decided = rows.where("url IS NOT NULL").select("node", F.col("own.action").alias("action")).union(named).where("action IS NOT NULL")
    # A row per node first, so that a crowded node is one row in the join.
    by_node = decided.groupBy("node").agg(F.min("action").alias("action"))  # allow sorts before block
    of = joined.withColumnRenamed("component", "group")
    by_group = by_node.join(of, "node", "left").groupBy(F.coalesce("group", "node").alias("group")).agg(F.min("action").alias("inherited"))
    nodes = rows.where("own IS NULL AND url IS NOT NULL").select("node").distinct()
    inherited = nodes.join(of, "node", "left").select("node", F.coalesce("group", "node").alias("group")).join(by_group, "group").select("node", "inherited")
    verdict = F.coalesce(F.col("own.action"), F.when(F.col("url").isNotNull(), F.col("inherited")), F.lit("allow"))
    return rows.join(inherited, "node", "left").select("page_id", "host", "path", F.col("own.rule").alias("rule"), verdict.alias("verdict"), "url")


def oracle_sql(rules: list[Rule]) -> str:
    """DuckDB SQL for ``judge`` over the table ``pages``, with the edges found in its HTML."""
    def rest(c: str) -> str:
        return f"CASE WHEN instr({c}, '://') > 0 THEN substr({c}, instr({c}, '://') + 3) ELSE '' END"

    def host(c: str) -> str:
        return f"translate(regexp_extract({rest(c)}, '^[^/?#]*', 0), '{UPPER}', '{LOWER}')"

    def path(c: str) -> str:
        return f"regexp_extract({rest(c)}, '^[^/?#]*([^?#]*)', 1)"

    def form(c: str) -> str:
        kept = f"regexp_replace(regexp_replace(regexp_extract({rest(c)}, '^[^?#]*[?]([^#]*)', 1), '{TRACKING}', '', 'g'), '^&+', '')"
        whole = f"regexp_replace({host(c)}, '{SITE_PREFIX}', '') || regexp_replace({path(c)}, '{PAGE_SUFFIX}', '') || CASE WHEN {kept} = '' THEN '' ELSE '?' || {kept} END"
        return f"CASE WHEN {host(c)} = '' THEN ':' || {c} ELSE {whole} END"

    def pick(c: str, value: int) -> str:
        order = sorted(rules, key=lambda r: (-len(rule_text(r)), rule_text(r), r[0]))
        whens = " ".join(
            f"WHEN ({host(c)} = '{h}' OR ends_with({host(c)}, '.{h}')) AND starts_with({path(c)}, '{p}') THEN '{(h + p, a)[value]}'" for a, h, p in order)
        return f"CASE {whens} END"

    def link(pattern: str) -> str:
        text = pattern.replace("'", "''")
        found = f"trim(regexp_extract(coalesce(html, ''), '{text}', 1))"
        scheme = "regexp_extract(url, '^[^:/]*', 0)"
        return (f"CASE WHEN {found} = '' THEN NULL WHEN starts_with({found}, '//') THEN {scheme} || ':' || {found} "
                f"WHEN starts_with({found}, '/') THEN {scheme} || '://' || {host('url')} || {found} WHEN instr({found}, '://') > 0 THEN {found} END")

    return f"""
WITH RECURSIVE e AS (
  SELECT url, t AS to_url FROM (SELECT url, unnest([{link(CANONICAL_LINK)}, {link(REFRESH)}]) AS t FROM pages) WHERE t IS NOT NULL AND url IS NOT NULL),
n AS (SELECT url FROM pages WHERE url IS NOT NULL UNION SELECT to_url FROM e),
f AS (SELECT url, {form('url')} AS node, {pick('url', 1)} AS action FROM n),
g AS (SELECT DISTINCT x.node AS a, y.node AS b FROM e JOIN f x ON x.url = e.url JOIN f y ON y.url = e.to_url),
reach AS (
  SELECT DISTINCT node AS a, node AS b FROM f
  UNION SELECT reach.a, s.b FROM reach JOIN (SELECT a, b FROM g UNION SELECT b, a FROM g) s ON reach.b = s.a),
said AS (SELECT reach.a AS node, min(action) AS inherited FROM reach JOIN f ON f.node = reach.b GROUP BY 1)
SELECT page_id, {host('url')} AS host, {path('url')} AS path, {pick('url', 0)} AS rule,
  coalesce({pick('url', 1)}, inherited, 'allow') AS verdict
FROM pages LEFT JOIN f USING (url) LEFT JOIN said USING (node)
"""
