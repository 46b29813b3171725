"""URL filters whose decisions spread over redirect and canonical-link edges."""

from __future__ import annotations

import html
from urllib.parse import urljoin

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import stored, table
from .components import connected_components

#: (verdict, host, path)
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty where there is none."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; nulls where none does.

    The rules are few and given by the caller, so they become one CASE, longest first.
    """
    rule = verdict = F.lit(None).cast("string")
    for said, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def canonical_url(url: Column) -> Column:
    """Where the usual redirects of a site lead: no scheme, ``www.`` or ``m.``, query, fragment, ``.html`` or slash at the end."""
    host = F.regexp_replace(host_of(url), r"^(?:www|m)\.", "")
    return F.concat(host, F.regexp_replace(path_of(url), r"(?:\.html?|/)$", ""))


def url_id(url: Column) -> Column:
    """A number of 124 bits from two hashes, so that no two of very many urls share one; null for a null url."""
    high, low = F.shiftright(F.xxhash64(url), 4), F.xxhash64(F.lit("low"), url)
    wide = high.cast("decimal(20,0)") * F.lit(str(2**64)).cast("decimal(20,0)") + low.cast("decimal(20,0)")
    return F.when(url.isNotNull(), wide.cast("decimal(38,0)"))


#: Tags that declare where a page belongs; what stands in comments and scripts isn't one. Each character is met once.
TAGS = r"(?is)<!--.*?(?:-->|\z)|<(?:script|style)\b.*?(?:</(?:script|style)|\z)|(<(?:link|meta|base)\b[^<>]*+>)"


def _attribute(tag: Column, name: str) -> Column:
    """An attribute's value, null if the tag doesn't have it."""
    value = F.regexp_extract(tag, rf"""(?is)[\s"']{name}\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++)""", 1)
    return F.when(value != "", F.regexp_replace(value, r"""^["']|["']$""", ""))


def resolved(page, base, target):
    """A declared target as a full url: references decoded, relative ones resolved against the page's base. Null if it's no url."""
    try:
        page = urljoin(page, html.unescape(base)) if base else page
        return urljoin(page, html.unescape(target).strip())
    except ValueError:
        return None


def declared_edges(pages: DataFrame) -> DataFrame:
    """``(src, dst)``: a page's first canonical link and first refresh redirect, and the redirect to its canonical form.

    Declared targets are decoded and resolved against the page's url, or its ``base``. Tags within comments and scripts
    don't count; time is linear in the page. Rows with a null url have no edges; null pages declare nothing.
    """
    rows = pages.filter(F.col("url").isNotNull()).select("url", F.regexp_extract_all("html", F.lit(TAGS), F.lit(1)).alias("tags"))
    is_a = lambda tag, name: tag.rlike(rf"(?i)^<{name}\b")
    first = lambda found: F.get(found, F.lit(0))
    links = F.filter("tags", lambda t: is_a(t, "link") & F.coalesce(_attribute(t, "rel").rlike(r"(?i)(?:^|\s)canonical(?:\s|$)"), F.lit(False)))
    turns = F.filter("tags", lambda t: is_a(t, "meta") & F.coalesce(_attribute(t, "http-equiv").rlike(r"(?i)^\s*refresh\s*$"), F.lit(False)))
    bases = F.filter("tags", lambda t: is_a(t, "base"))
    content = _attribute(first(turns), "content")
    told = rows.filter(F.size("tags") > 0).select(
        "url", _attribute(first(bases), "href").alias("base"), F.explode(F.array(_attribute(first(links), "href"), F.regexp_extract(content, r"""(?i)url\s*+=\s*+["']?([^"']++)""", 1))).alias("target")
    )
    told = told.filter(F.col("target") != "").select(F.col("url").alias("src"), F.udf(resolved, StringType())("url", "base", "target").alias("dst"))
    edges = told.unionByName(rows.select(F.col("url").alias("src"), canonical_url(F.col("url")).alias("dst")))
    return edges.filter((F.col("dst") != "") & (F.col("src") != F.col("dst")))


def propagate(pages: DataFrame, edges: DataFrame, rules=RULES) -> DataFrame:
    """Judge each page by its longest rule, else by its aliases.

    ``pages(page_id, url, ...)`` and ``edges(src, dst)`` between urls give
    ``(page_id, url, host, path, rule, verdict, via)``. Urls joined by edges, in any
    direction and over any number of steps, are aliases. A page without a rule is
    allowed if a rule allows an alias, else blocked if one blocks an alias, else
    allowed; ``via`` is ``rule``, ``alias`` or ``default``. A url that is only a target
    of edges counts as an alias too. Null urls match no rule and have no alias;
    repeated rows are judged alike; a column of another name is left out.
    """
    judged = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    judged = judged.select("*", rule.alias("rule"), verdict.alias("own"))
    # the components move numbers, not the strings
    links = edges.filter("src is not null and dst is not null").select(url_id(F.col("src")).alias("u"), url_id(F.col("dst")).alias("v"))
    groups = stored(connected_components(links), "aliases")
    ends = edges.select(F.explode(F.array("src", "dst")).alias("url")).filter("url is not null").distinct()
    _, said = matched_rule(host_of(F.col("url")), path_of(F.col("url")), rules)
    decisions = stored(
        ends.select(url_id(F.col("url")).alias("node"), said.alias("said"))
        .filter("said is not null")
        .join(groups, "node")
        .groupBy("component")
        .agg(F.bool_or(F.col("said") == "allow").alias("allowed")),
        "decisions",
    )
    # one verdict for each url before the pages join, so that a hot component is spread over its urls
    alias = groups.join(decisions, "component").select("node", F.when(F.col("allowed"), "allow").otherwise("block").alias("spread"))
    out = judged.withColumn("node", url_id(F.col("url"))).join(alias, "node", "left")
    return out.select(
        "page_id",
        "url",
        "host",
        "path",
        "rule",
        F.coalesce("own", "spread", F.lit("allow")).alias("verdict"),
        F.when(F.col("own").isNotNull(), "rule").when(F.col("spread").isNotNull(), "alias").otherwise("default").alias("via"),
    )


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's verdict."""
    pages = table(spark, sf_dir, "pages")
    # pages are parsed once
    return propagate(pages, stored(declared_edges(pages), "declared")).drop("url")


_HOST = "translate(regexp_extract(coalesce({0}, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = "regexp_extract(coalesce({0}, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1)"
_PICK = """CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN {0}
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN {1}
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN {2}
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN {3} END"""
_RULE = _PICK.format("'example.net/en/'", "'example.com/de/'", "'org/fr/'", "'net/'")
_SAID = _PICK.format("'allow'", "'block'", "'allow'", "'block'")

#: The tables declare no canonical links, so each component is a canonical form with the urls that lead to it.
ORACLE_SQL = {
    "op5_url_filter": f"""
WITH p AS (SELECT page_id, url, {_HOST.format('url')} AS host, {_PATH.format('url')} AS path FROM pages),
c AS (SELECT *, regexp_replace(host, '^(www|m)\\.', '') || regexp_replace(path, '(\\.html?|/)$', '') AS canon,
      {_RULE} AS rule, {_SAID} AS own FROM p),
g AS (SELECT canon, bool_or(own = 'allow') AS allowed FROM c WHERE url <> canon AND own IS NOT NULL GROUP BY canon)
SELECT c.page_id, c.host, c.path, c.rule,
  coalesce(c.own, CASE WHEN g.allowed THEN 'allow' WHEN NOT g.allowed THEN 'block' END, 'allow') AS verdict,
  CASE WHEN c.own IS NOT NULL THEN 'rule' WHEN g.allowed IS NOT NULL THEN 'alias' ELSE 'default' END AS via
FROM c LEFT JOIN g ON c.canon = g.canon
"""
}
QUERIES = {"op5_url_filter": op5_url_filter}
