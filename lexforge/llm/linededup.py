"""Line dedup by site-relative frequency: lines that a large share of a host's pages carry are boilerplate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.llm.common import broadcast_if_small, materialize

#: a line goes if more than this share of its host's pages carry it, and the host has enough pages to tell. Headers and
#: footers are on a tenth of the pages or more, give or take what chance does to a host; ordinary lines repeat on less
MAX_RATIO = 0.07
MIN_PAGES = 10
#: pages that must carry a line: in a small host a share alone would be one page or two
MIN_CARRY = 3


def _lines(text):
    return F.split(text, "\n", -1)


def boilerplate(docs: DataFrame, host: str = "source", text: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, min_carry: int = MIN_CARRY) -> DataFrame:
    """Boilerplate lines of each host: (host, key string, pages long, total long).

    A page counts once for a line however often it repeats it. Lines without a word aren't judged. Counting
    is a two-step aggregate keyed by (host, 128-bit digest of the line), so neither a hot host nor a hot line lands
    in one task whole. Less than (distinct lines per page) / max_ratio lines of a host can pass.
    """
    lines = F.array_distinct(F.filter(_lines(F.col(f"`{text}`")), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    rows = docs.select(F.col(f"`{host}`").alias("host"), lines.alias("lines"))
    totals = rows.groupBy("host").agg(F.count("*").alias("total")).where(F.col("total") >= min_pages)
    keys = rows.select("host", F.explode("lines").alias("line")).select("host", F.unhex(F.md5("line")).alias("key"))
    counts = keys.groupBy("host", "key").agg(F.count("*").alias("pages")).where((F.col("pages") > max_ratio * min_pages) & (F.col("pages") >= min_carry))
    # totals has one row per host; a null host is a host of its own
    both = counts.alias("c").join(totals.alias("t"), F.col("c.host").eqNullSafe(F.col("t.host")))
    return both.where(F.col("pages") > max_ratio * F.col("total")).select(F.col("c.host").alias("host"), F.lower(F.hex("key")).alias("key"), "pages", "total")


def drop_boilerplate(docs: DataFrame, host: str = "source", text: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, min_carry: int = MIN_CARRY) -> DataFrame:
    """docs with boilerplate lines cut from text, and columns n_lines and n_dropped (long) added.

    All columns stay, n_chars too if there is one (set to the new length); where docs has an n_lines or n_dropped, its
    own stays and ours isn't added. Lines are the parts between \\n; the rest keep their order. A null text stays null with
    0 lines; a page that loses all lines keeps an empty text; repeated rows count and stay each; a null host is a
    host. Hosts with fewer than min_pages pages lose nothing, nor do lines on fewer than min_carry pages. An empty table gives an empty one.
    """
    found = boilerplate(docs, host, text, max_ratio, min_pages, min_carry).groupBy("host").agg(F.collect_list("key").alias("_lexforge_keys"))
    # bounded per host by (lines per page) / max_ratio; the table is broadcast only if its rows and its bytes are few
    found = materialize(found)
    small = broadcast_if_small(found, 20_000, F.coalesce(F.octet_length("host"), F.lit(0)) + 40 * F.size("_lexforge_keys"))
    names = docs.columns
    place = {c: f"c{i}" for i, c in enumerate(names)}
    d = docs.select(*[F.col(f"`{c}`").alias(place[c]) for c in names]).alias("d")
    d = d.join(small.alias("f"), F.col(f"d.{place[host]}").eqNullSafe(F.col("f.host")), "left")
    lines, keys = _lines(F.col(place[text])), F.col("_lexforge_keys")
    # most pages have no such line; a hashed overlap tells, and only the others look each line up
    some = F.coalesce(F.arrays_overlap(F.transform(lines, F.md5), keys), F.lit(False))
    kept = F.when(some, F.filter(lines, lambda x: ~F.array_contains(keys, F.md5(x)))).otherwise(lines)
    d = d.select(*place.values(), lines.alias("_lexforge_all"), kept.alias("_lexforge_kept"))
    same = F.size("_lexforge_kept") == F.size("_lexforge_all")
    new = F.when(same, F.col(place[text])).otherwise(F.array_join("_lexforge_kept", "\n"))
    changed = {text: new}
    if "n_chars" in names:
        changed["n_chars"] = F.when(same, F.col(place["n_chars"])).otherwise(F.length(new).cast("long"))
    n = lambda c: F.coalesce(F.when(F.col("_lexforge_all").isNotNull(), c), F.lit(0)).cast("long")
    added = {"n_lines": n(F.size("_lexforge_all")), "n_dropped": n(F.size("_lexforge_all") - F.size("_lexforge_kept"))}
    return d.select(*[changed.get(c, F.col(place[c])).alias(c) for c in names], *[v.alias(c) for c, v in added.items() if c not in names])


ORACLE = """
WITH lines AS (
  SELECT doc_id, source, len(string_split(text, chr(10))) AS n,
         unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos
  FROM documents),
totals AS (SELECT source, count(*) AS total FROM documents GROUP BY source),
pages AS (
  SELECT source, line, count(DISTINCT doc_id) AS pages FROM lines
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY source, line),
bad AS (
  SELECT p.source, p.line FROM pages p JOIN totals t ON p.source IS NOT DISTINCT FROM t.source
  WHERE t.total >= 10 AND p.pages >= 3 AND p.pages > CAST(0.07 AS DOUBLE) * t.total),
kept AS (
  SELECT l.doc_id, l.n, l.line, l.pos, b.line IS NOT NULL AS gone
  FROM lines l LEFT JOIN bad b ON l.source IS NOT DISTINCT FROM b.source AND l.line = b.line)
SELECT doc_id, CAST(max(n) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       md5(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS text_md5
FROM kept GROUP BY doc_id
"""
