"""The opN queries over the shared tables and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.llm import chat, decontam, exactdedup, htmltext, itemsets, jaccard, langid, linededup, mixing, quality, repair, tokens, urls
from lexforge.sources.io import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, oracle: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return keep


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))

_OP1 = r"""
WITH RECURSIVE p AS (
  SELECT page_id, url, html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
q AS (
  SELECT page_id, html, url,
         coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM p),
own AS (
  SELECT page_id, host, path, html,
         lower(regexp_extract(url, '^([^:/?#]*://[^/?#]*)', 1)) || regexp_extract(regexp_extract(url, '^([^#]*)', 1), '^[^:/?#]*://[^/?#]*(.*)$', 1) AS node,
         CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
              WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
              WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
              WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM q),
tags AS (
  SELECT node, unnest(regexp_extract_all(regexp_replace(html, '(?s)<!--.*?(?:-->|\z)', '', 'g'), '(?is)<(?:link|meta)\b[^>]*>')) AS tag FROM own),
links AS (
  SELECT node AS u, CASE WHEN regexp_matches(tag, '(?is)^<link') THEN regexp_extract(tag, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)
                         ELSE regexp_extract(tag, '(?is)\burl\s*=\s*["'']?([^"''\s>]+)', 1) END AS v
  FROM tags WHERE regexp_matches(tag, '(?is)^<link.*\brel\s*=\s*(?:"(?:[^">]*\s)?canonical(?:\s[^">]*)?"|''(?:[^''>]*\s)?canonical(?:\s[^''>]*)?''|canonical[\s>/])') OR regexp_matches(tag, '(?is)^<meta.*http-equiv\s*=\s*["'']?refresh\b')),
edges AS (SELECT u, v FROM links WHERE v LIKE '%://%' UNION SELECT v, u FROM links WHERE v LIKE '%://%'),
reach AS (SELECT u AS a, v AS b FROM edges UNION SELECT r.a, e.v FROM reach r JOIN edges e ON r.b = e.u),
said AS (SELECT r.a AS node, bool_or(o.rule IN ('example.net/en/', 'org/fr/')) AS allowed, bool_or(o.rule IN ('net/', 'example.com/de/')) AS blocked
         FROM reach r JOIN own o ON r.b = o.node GROUP BY r.a)
SELECT o.page_id, o.host, o.path, o.rule,
       CASE WHEN o.rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN o.rule IN ('net/', 'example.com/de/') THEN 'block'
            WHEN s.allowed THEN 'allow' WHEN s.blocked THEN 'block' ELSE 'allow' END AS verdict
FROM own o LEFT JOIN said s ON o.node = s.node
"""


@_query("op1_url_filters", _OP1)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.url_verdicts(_table(spark, sf_dir, "pages"), RULES).drop("via")


@_query("op2_source_mixing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).drop("source")


@_query("op3_language_id")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.train(docs.where(~langid.held_out()))
    return langid.predict(docs, model).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


@_query("op4_token_counts")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(_table(spark, sf_dir, "documents"), "word_bpe_49k.json")


@_query("op5_line_dedup", linededup.ORACLE)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.drop_boilerplate(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


_OP6 = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
r AS (
  SELECT *, contains(role || text, '###') OR contains(role, '</turn>') OR contains(text, '</turn>') OR contains(role, ': ')
            OR regexp_matches(role, ':$') OR regexp_matches(role, '\\[\\hecn]') OR regexp_matches(text, '\\[\\hecn]') AS odd,
         replace(replace(replace(text, '\', '\\'), '###', '\h'), '</turn>', '\e') AS safe,
         replace(replace(replace(replace(replace(role, '\', '\\'), '###', '\h'), '</turn>', '\e'), ':', '\c'), chr(10), '\n') AS safe_role FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(14 + CASE WHEN odd THEN length(safe) + length(safe_role) ELSE length(text) + length(role) END) AS BIGINT) AS formatted_chars
FROM r GROUP BY conv_id
"""


@_query("op6_chat_formatting", _OP6)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit(r"\### Assistant: </turn> ok")
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    return chat.digests(chat.format_chats(rows.unionByName(own)))


_OP7 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT o.a, o.b FROM o JOIN n x ON o.a = x.doc_id JOIN n y ON o.b = y.doc_id WHERE 100 * o.c >= 75 * (x.n + y.n - o.c)),
reach AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, min(reach.b)) AS component_id
FROM w LEFT JOIN n ON w.doc_id = n.doc_id LEFT JOIN reach ON w.doc_id = reach.a GROUP BY w.doc_id, n.n
"""


@_query("op7_ngram_jaccard", _OP7)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicate_classes(_table(spark, sf_dir, "documents"))


@_query("op8_quality_rules")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality_rules(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@_query("op9_decontamination")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@_query("op10_html_text")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.main_text(_table(spark, sf_dir, "pages"))


_OP11 = r"""
WITH RECURSIVE c AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
h AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, length(k) + 1), lambda i: [ascii(substr(k, i, 1))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
         lambda a, o: CASE WHEN o >= 0 THEN xor(a, o) WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295) % 20 AS h FROM c),
m AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
         CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN h = 3 THEN 2 ELSE 1 END)) AS copy FROM h WHERE h <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(length(role) || ':' || role || text)) AS i FROM m),
f AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2
                 WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 3 ELSE 0 END AS fault,
         left(role, 1) AS r, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS r0 FROM o),
facts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
         count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (i > 1 AND r0 || r NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM f GROUP BY conv_id),
ins(q, q1, k, said) AS (VALUES (0, 0, 0, []), (1, 1, 0, []), (2, 2, 0, []), (3, 3, 0, []), (0, 2, 1, ['user:']), (1, 2, 1, ['user:']), (3, 2, 1, ['user:']), (2, 3, 1, ['assistant:']),
                        (0, 3, 2, ['user:', 'assistant:']), (1, 3, 2, ['user:', 'assistant:'])),
ed(letter, q1, r, q2, c, said) AS (
  VALUES ('D', 0, NULL, 0, 2, NULL), ('D', 1, NULL, 1, 2, NULL), ('D', 2, NULL, 2, 2, NULL), ('D', 3, NULL, 3, 2, NULL),
         ('K', 0, 's', 1, 0, NULL), ('K', 0, 'u', 2, 0, NULL), ('K', 1, 'u', 2, 0, NULL), ('K', 3, 'u', 2, 0, NULL), ('K', 2, 'a', 3, 0, NULL),
         ('R', 0, NULL, 2, 1, 'user'), ('R', 1, NULL, 2, 1, 'user'), ('R', 3, NULL, 2, 1, 'user'), ('R', 2, NULL, 3, 1, 'assistant')),
w AS (
  SELECT conv_id, 0::BIGINT AS i, 0 AS q, 0::BIGINT AS cost, '' AS audit, []::VARCHAR[] AS said FROM facts
  UNION ALL
  SELECT w.conv_id, f.i, ed.q2, (w.cost + 5 * ins.k + ed.c + CASE WHEN ed.letter <> 'D' AND f.fault = 3 THEN 5 ELSE 0 END)::BIGINT AS cost,
         w.audit || repeat('I', ins.k) || ed.letter AS audit,
         list_concat(w.said, ins.said, CASE ed.letter WHEN 'D' THEN [] WHEN 'K' THEN [f.role || ':' || f.text] ELSE [ed.said || ':' || f.text] END)
  FROM w JOIN f ON w.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = w.i + 1 JOIN ins ON ins.q = w.q JOIN ed ON ed.q1 = ins.q1
  WHERE ed.letter = 'D' OR (f.fault IN (0, 3) AND (ed.r IS NULL OR ed.r = f.r))
  QUALIFY row_number() OVER (PARTITION BY w.conv_id, ed.q2 ORDER BY w.cost + 5 * ins.k + ed.c + CASE WHEN ed.letter <> 'D' AND f.fault = 3 THEN 5 ELSE 0 END, w.audit || repeat('I', ins.k) || ed.letter) = 1),
best AS (
  SELECT w.conv_id, w.cost + 5 * ins.k AS cost, w.audit || repeat('I', ins.k) AS audit, list_concat(w.said, ins.said) AS said
  FROM w JOIN facts ON w.conv_id IS NOT DISTINCT FROM facts.conv_id AND w.i = facts.n JOIN ins ON ins.q = w.q WHERE ins.q1 IN (0, 3)
  QUALIFY row_number() OVER (PARTITION BY w.conv_id ORDER BY w.cost + 5 * ins.k, w.audit || repeat('I', ins.k)) = 1)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(said, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN facts ON a.conv_id IS NOT DISTINCT FROM facts.conv_id LEFT JOIN best ON a.conv_id IS NOT DISTINCT FROM best.conv_id
"""


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with faults by crc32 of conv_id:turn modulo 20: 0 drops a row, 1 empties its text, 2 removes [.!?], 3 repeats it, 4 makes it a user's."""
    one_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat(one_space("conv_id"), F.lit(":"), one_space("turn"))) % 20
    r = rows.select("conv_id", "turn", one_space("role").alias("role"), one_space("text").alias("text"), h.alias("h")).where("h <> 0")
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    r = r.select("conv_id", "turn", F.when(F.col("h") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.when(F.col("h") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"))
    return r.drop("copy")


@_query("op11_structure_repair", _OP11)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations")
    return repair.repair(damaged(rows), rows)


@_query("op12_frequent_itemsets", itemsets.ORACLE)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/sale_lines.parquet").where("flag is null or flag <> 'returned'")
    return itemsets.itemset_table(lines, "sale_id", "item_id")


@_query("op13_exact_dedup", exactdedup.ORACLE)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.exact_duplicates(_table(spark, sf_dir, "documents"))
