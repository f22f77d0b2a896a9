"""Operator 10: URL filters with redirect equivalence.

Rules on host and path judge a URL by itself. Pages that redirect to, or name as canonical, another URL are aliases of it: the connected
components of those links are classes of one document, and a block of any member reaches the members that no rule of their own judges.
An explicit allow keeps its own page whatever its class says.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.llm.common import materialize, table
from curatrix.llm.graph import components


@dataclass(frozen=True)
class Rule:
    """Fits its host and all subdomains where the path starts with `path`."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: what follows the first :// up to /, ?, # or the end, A-Z lower-cased; path: then up to ?, # or the end. Null, or no ://:
    both empty."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def judged(df: DataFrame, host: str, path: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """df plus rule (name of the longest that fits, null if none) and own (its verdict). Of equally long ones a block wins."""
    rule, own = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.verdict == "block")):  # later ones go in front
        rule = F.when(r.fits(F.col(host), F.col(path)), r.name).otherwise(rule)
        own = F.when(r.fits(F.col(host), F.col(path)), r.verdict).otherwise(own)
    return df.withColumn("rule", rule).withColumn("own", own)


def node(url: Column) -> Column:
    """What a URL is compared by: host, path and query, without scheme and fragment; null without a host."""
    host, path = host_and_path(url)
    query = F.regexp_extract(url, r"^[^?#]*(\?[^#]*)", 1)
    return F.when(host != "", F.concat(host, F.when(path == "", "/").otherwise(path), F.coalesce(query, F.lit(""))))


def link_targets(html: Column) -> Column:
    """Targets of canonical links and of meta refreshes, as written."""
    tags = F.regexp_extract_all(html, F.lit(r"(?i)(<(?:link|meta)\s[^>]*>)"), F.lit(1))
    is_canonical = lambda t: t.rlike(r"""(?i)^<link\s(?:[^>]*\s)?rel\s*=\s*["']?canonical\b""")
    is_refresh = lambda t: t.rlike(r"""(?i)^<meta\s(?:[^>]*\s)?http-equiv\s*=\s*["']?refresh\b""")
    target = lambda t: F.when(is_canonical(t), F.regexp_extract(t, r"""(?i)\shref\s*=\s*["']?([^"'\s>]+)""", 1)).when(is_refresh(t), F.regexp_extract(t, r"""(?i)\burl\s*=\s*["']?([^"'\s>]+)""", 1))
    return F.filter(F.transform(tags, target), lambda t: t.isNotNull() & (t != ""))


def absolute(target: Column, base: Column) -> Column:
    """target as a URL: with a scheme as it is; //host/.. and /path with the base's scheme and host; else beside the base's path."""
    scheme = F.regexp_extract(base, r"^([^:/?#]+:)//", 1)
    root = F.regexp_extract(base, r"^([^:/?#]+://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"^([^:/?#]+://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    beside = F.concat(folder, F.when(folder.endswith("/"), "").otherwise("/"), target)
    return F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target).when(target.startswith("//"), F.concat(scheme, target)).when(target.startswith("/"), F.concat(root, target)).otherwise(beside)


def filter_urls(pages: DataFrame, redirects: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, spread), a row for each of pages (page_id, url, html); redirects (from_url, to_url) adds
    links seen elsewhere. spread: the verdict is a block that came from an alias.

    Verdict: that of the page's own longest rule; else block if any URL of its class (linked URLs that are no pages among them) is
    blocked by its rule; else allow. Null URLs and URLs without :// have empty host and path, belong to no class and are allowed. Null
    html has no links. Repeated rows are judged alike; an empty table gives no rows.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path"), node(F.col("url")).alias("node"))
    links = pages.select(node(F.col("url")).alias("a"), F.explode(F.transform(link_targets(F.col("html")), lambda t: node(absolute(t, F.col("url"))))).alias("b"))
    if redirects is not None:
        links = links.unionByName(redirects.select(node(F.col("from_url")).alias("a"), node(F.col("to_url")).alias("b")))
    classes = components(links.select(F.col("a").alias("a"), F.col("b").alias("b")))
    members = classes.withColumn("_host", F.regexp_extract("id", r"^([^/?]*)", 1)).withColumn("_path", F.regexp_extract("id", r"^[^/?]*([^?]*)", 1))
    blocked = judged(members, "_host", "_path", rules).filter("own = 'block'").select("component").distinct()
    reached = materialize(classes.join(blocked, "component", "left_semi").select(F.col("id").alias("_node")), "blocked")
    out = judged(rows, "host", "path", rules).join(reached, F.col("node") == F.col("_node"), "left")
    spread = F.col("own").isNull() & F.col("_node").isNotNull()
    return out.select("page_id", "host", "path", "rule", F.coalesce("own", F.when(spread, "block").otherwise("allow")).alias("verdict"), spread.alias("spread"))


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


_TAGS = r"""regexp_extract_all(coalesce(html, ''), '<(?:link|meta)\s[^>]*>', 0, 'i')"""
#: No page of the tables has links of its own, which the query would have to follow; the SQL says so instead of assuming it.
OP10_SQL = f"""
with r as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end rest,
                  len(list_filter({_TAGS}, lambda t: regexp_matches(t, '(canonical|refresh)', 'i'))) links from pages),
h as (select page_id, links, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) path from r),
j as (select *, case when (host = 'example.net' or ends_with(host, '.example.net')) and starts_with(path, '/en/') then 'example.net/en/'
                     when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/de/') then 'example.com/de/'
                     when (host = 'org' or ends_with(host, '.org')) and starts_with(path, '/fr/') then 'org/fr/'
                     when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/') then 'net/' end rule from h)
select page_id, host, path, rule, case when rule in ('net/', 'example.com/de/') then 'block' when links > 0 and rule is null then 'unknown' else 'allow' end verdict, false spread from j
"""
