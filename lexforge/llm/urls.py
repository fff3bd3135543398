"""URL filters with redirect equivalence.

Rules are strings host/path: a rule fits its host and every subdomain where the url's path starts with the
rule's path; the longest rule that fits decides. Redirects and canonical links tie urls into components
(distributed connected components). A url without a rule of its own takes its component's: allowed
if any member is allowed by a rule (explicit allow has precedence), else blocked if any is blocked by one,
else allowed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexforge.llm.common import broadcast_if_small, connected_components, materialize

#: rule lists up to this length become an expression; longer ones are joined
MAX_LITERAL_RULES = 64

#: an attribute's value among space-separated tokens, quoted or not
_REL = r"""\brel\s*=\s*(?:"(?:[^">]*\s)?canonical(?:\s[^">]*)?"|'(?:[^'>]*\s)?canonical(?:\s[^'>]*)?'|canonical(?=[\s>/]))"""
_LINK = rf"""(?is)<link\b(?=[^>]*{_REL})[^>]*?\bhref\s*=\s*["']?([^"'\s>]+)"""
_REFRESH = r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*?\bcontent\s*=\s*["']?\s*[\d.]*\s*[;,]?\s*url\s*=\s*["']?([^"'\s>]+)"""
_BASE = r"""(?is)<base\b[^>]*?\bhref\s*=\s*["']?([^"'\s>]+)"""
_COMMENT = r"(?s)<!--.*?(?:-->|\z)"


def _ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _rest(url: Column) -> Column:
    """What follows the first ://, null without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    """From the first :// to /, ?, # or the end, A-Z lower-cased; empty for null or where there is no ://."""
    return F.coalesce(_ascii_lower(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """From after the host to ?, # or the end; empty for null or where there is no ://."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """Identity of a url in the link graph: without its fragment, A-Z of scheme and host lower-cased; null where it has no host."""
    bare = F.regexp_extract(url, r"^([^#]*)", 1)
    at = F.instr(bare, "://")
    cut = at + 2 + F.length(F.regexp_extract(_rest(bare), r"^([^/?#]*)", 1))
    return F.when(host_of(url) != "", F.concat(_ascii_lower(F.substring(bare, F.lit(1), cut)), F.substring(bare, cut + 1, F.length(bare))))


def resolve(base: Column, href: Column) -> Column:
    """Absolute form of a link target found on the page at base."""
    href = F.replace(href, F.lit("&amp;"), F.lit("&"))
    scheme = F.regexp_extract(base, r"^([^:/?#]*:)", 1)
    root = F.regexp_extract(base, r"^([^:]*://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"^([^:]*://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    return (
        F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), href)
        .when(href.startswith("//"), F.concat(scheme, href))
        .when(href.startswith("/"), F.concat(root, href))
        .when(href.startswith("#") | (href == ""), base)
        .otherwise(F.concat(folder, F.when(folder.endswith("/"), F.lit("")).otherwise(F.lit("/")), href))
    )


def page_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Edges (u, v) between url nodes that pages declare: every canonical link and refresh redirect of a page.

    rel is a list of names; what stands in a comment declares nothing; targets are relative to the page's first base, if it has
    one, else to its url.
    """
    # most pages declare neither; a plain search spares them the patterns
    lower = F.lower(F.col(html_col))
    some = pages.where(lower.contains("canonical") | lower.contains("refresh")).select(F.col(url_col).alias("url"), F.regexp_replace(html_col, _COMMENT, "").alias("html"))
    found = F.concat(*[F.regexp_extract_all("html", F.lit(x), 1) for x in (_LINK, _REFRESH)])
    own_base = F.regexp_extract("html", _BASE, 1)
    rows = some.select("url", F.when(own_base == "", F.col("url")).otherwise(resolve(F.col("url"), own_base)).alias("base"), F.explode(F.filter(found, lambda x: x != "")).alias("href"))
    # exploded once more so that the target is worked out once, not wherever its node's expression names it
    rows = rows.select("url", F.explode(F.array(resolve(F.col("base"), F.col("href")))).alias("target"))
    return rows.select(node_of(F.col("url")).alias("u"), node_of(F.col("target")).alias("v")).where("u is not null and v is not null and u <> v")


def parse_rule(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host.lower(), slash + path


def _literal_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """Longest rule that fits, and its verdict, by expressions alone; of equally long ones an allow, then the last by code point."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[1] == "allow", r[0])):
        h, p = parse_rule(text)
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def _joined_rule(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The same by a join on host suffixes of distinct (host, path), for rule tables of any size: host, path -> rule, own."""
    parts = rules.select("rule", "verdict", F.lower(F.substring_index("rule", "/", 1)).alias("suffix"))
    parts = parts.withColumn("start", F.expr("substring(rule, length(suffix) + 1)"))
    distinct = urls.select("host", "path").distinct()
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hits = distinct.withColumn("suffix", F.explode(suffixes)).join(parts, "suffix").where(F.col("path").startswith(F.col("start")))
    best = F.max_by(F.struct("rule", "verdict"), F.struct(F.length("rule"), (F.col("verdict") == "allow").cast("int"), F.col("rule")))
    return hits.groupBy("host", "path").agg(best.alias("best")).select("host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("own"))


def url_verdicts(pages: DataFrame, rules: Sequence[tuple[str, str]] | DataFrame, links: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Judge every page's url: (id_col, host, path, rule, verdict, via).

    rules: (rule, allow or block) pairs, or a DataFrame (rule, verdict). links: further edges (u, v) of raw urls
    beside those that pages declare (None: none). via is rule, alias (a component decided) or default. Of
    equally long rules allow wins, then the last by code point, however many rules there are. A null url, or one without ://, has empty host and path, fits no rule and
    is allowed; null html declares no links. Null and repeated ids or urls keep a row each; an empty table gives
    none; other columns are ignored.
    """
    url = F.col(url_col).cast("string")
    base = pages.select(F.col(id_col), url.alias("url"), F.col(html_col).cast("string").alias("html"))
    base = base.select(id_col, "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), node_of(F.col("url")).alias("node"))
    if not isinstance(rules, DataFrame) and len(rules) > MAX_LITERAL_RULES:
        values = ", ".join("('{}', '{}')".format(*(x.replace("\\", "\\\\").replace("'", "\\'") for x in r)) for r in rules)
        rules = pages.sparkSession.sql(f"select * from values {values} as t(rule, verdict)")
    if isinstance(rules, DataFrame):
        base = base.join(_joined_rule(base, rules), ["host", "path"], "left")
    else:
        rule, own = _literal_rule(F.col("host"), F.col("path"), rules)
        base = base.withColumn("rule", rule).withColumn("own", own)

    edges = page_links(pages.select(url.alias("url"), F.col(html_col).cast("string").alias("html")), "url", "html")
    if links is not None:
        edges = edges.unionByName(links.select(node_of(F.col("u")).alias("u"), node_of(F.col("v")).alias("v")).where("u is not null and v is not null and u <> v"))
    edges = materialize(edges.distinct())
    groups = materialize(connected_components(edges))
    # rules also decide for members that no page of the table shows
    members = groups.withColumn("host", host_of(F.col("node"))).withColumn("path", path_of(F.col("node")))
    if isinstance(rules, DataFrame):
        members = members.join(_joined_rule(members, rules), ["host", "path"], "left")
    else:
        members = members.withColumn("own", _literal_rule(F.col("host"), F.col("path"), rules)[1])
    says = members.groupBy("component").agg(F.max(F.col("own") == "allow").alias("allowed"), F.max(F.col("own") == "block").alias("blocked"))
    taken = F.when(F.col("allowed"), F.lit("allow")).when(F.col("blocked"), F.lit("block"))
    alias = groups.join(says, "component").select("node", taken.alias("taken")).where("taken is not null")
    # nodes are distinct, so this join adds no rows; urls outside the graph are most and need no match
    out = base.join(broadcast_if_small(alias, 100_000, F.octet_length("node") + 16), "node", "left")
    via = F.when(F.col("own").isNotNull(), "rule").when(F.col("taken").isNotNull(), "alias").otherwise("default")
    return out.select(id_col, "host", "path", "rule", F.coalesce("own", "taken", F.lit("allow")).alias("verdict"), via.alias("via"))
