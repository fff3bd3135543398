"""Queries of the engine's own operators over the shared tables, each with its DuckDB twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexforge.functions import lexicons as L
from lexforge.functions import similarity as S
from lexforge.functions import text as T
from lexforge.operators import cost, dedup, evidence, relevance, retention
from lexforge.sources.io import spread
from lexforge.sources.shared import settle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def joined(c: Column) -> Column:
    return F.array_join(c, "|")


# -- SQL shared by the twins --------------------------------------------------------------------------------

NL = "chr(10)"
WORDS = r"list_transform(regexp_extract_all({t}, '[A-Za-z0-9_.$%/-]+'), lambda x: lower(x))"
TOKENS = r"regexp_extract_all({t}, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]')"
COUNT = f"(len({TOKENS}) + coalesce(list_sum(list_transform(list_filter({TOKENS}, lambda x: length(x) > 12), lambda x: length(x) // 8)), 0))"
STRIP = r"regexp_replace({t}, '^\s+|\s+$', '', 'g')"
SQUEEZE = r"regexp_replace(regexp_replace(regexp_replace({t}, '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"
SENTENCES = r"list_filter(list_transform(regexp_split_to_array(regexp_replace({t}, '([.!?])\s+', '\1' || chr(10), 'g'), '\n+'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"
CANON = (
    "regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(replace(regexp_replace(lower({t}), '^\\s+|\\s+$', '', 'g'), 'ml ops', 'mlops'), 'ci cd', 'ci/cd'), "
    "'retrieval augmented generation', 'rag'), 'retrieval-augmented generation', 'rag'), '[^a-z0-9+/#. -]+', ' ', 'g'), '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')"
)

#: letters beyond ASCII to underscores: RE2's word edges know ASCII only
FOLD = r"regexp_replace({t}, '[\x{{00AA}}\x{{00B5}}\x{{00BA}}\x{{00C0}}-\x{{00D6}}\x{{00D8}}-\x{{00F6}}\x{{00F8}}-\x{{02FF}}]', '_', 'g')"


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


STOP = quoted(L.STOPWORDS)
TRIGGER = quoted(T.TRIGGERS)


def sql(template: str, **at: str) -> str:
    """Fill {{name}} marks."""
    for k, v in at.items():
        template = template.replace("{{" + k + "}}", v)
    return template


def f(template: str, t: str = "text") -> str:
    return template.format(t=t)


# -- tokens and normalizers ---------------------------------------------------------------------------------------


@query("count_tokens", sql("SELECT doc_id, CAST({{c}} AS BIGINT) AS n_tokens FROM documents", c=f(COUNT)))
def count_tokens(spark, d):
    return docs(spark, d).select("doc_id", T.count_tokens(F.col("text")).alias("n_tokens"))


@query("approx_tokens", "SELECT doc_id, CAST(CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END AS BIGINT) AS n_tokens FROM documents")
def approx_tokens(spark, d):
    return docs(spark, d).select("doc_id", T.approx_tokens(F.col("text")).alias("n_tokens"))


@query("sentence_split", sql("SELECT doc_id, CAST(len({{s}}) AS BIGINT) AS n_sentences, md5(array_to_string({{s}}, '|')) AS sentences_md5 FROM documents", s=f(SENTENCES, f(STRIP))))
def sentence_split(spark, d):
    s = T.sentences(F.col("text"))
    return docs(spark, d).select("doc_id", F.size(s).cast("long").alias("n_sentences"), F.md5(joined(s)).alias("sentences_md5"))


@query(
    "simple_sentences",
    sql(
        r"""WITH b AS (SELECT doc_id, unnest(list_transform(regexp_split_to_array(text, '\n+'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g'))) AS b FROM documents),
c AS (SELECT doc_id, unnest(CASE WHEN length(b) < 240 THEN [b] ELSE {{s}} END) AS c FROM b WHERE b <> '')
SELECT doc_id, count(*) AS n_chunks, CAST(sum(length(c)) AS BIGINT) AS chars FROM c GROUP BY doc_id""",
        s=f(SENTENCES, "b"),
    ),
)
def simple_sentences(spark, d):
    c = docs(spark, d).select("doc_id", F.explode(T.line_chunks(F.col("text"))).alias("c"))
    return c.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.sum(F.length("c")).cast("long").alias("chars"))


@query("normalize_ws", sql("SELECT page_id, length({{s}}) AS chars, md5({{s}}) AS text_md5 FROM pages", s=f(SQUEEZE, "html")))
def normalize_ws(spark, d):
    s = T.squeeze(F.col("html"))
    return table(spark, d, "pages").select("page_id", F.length(s).cast("long").alias("chars"), F.md5(s).alias("text_md5"))


_POLITE = "'Please, can you ' || text || ' to be honest, just sort of OK ; really'"


def _filler_sql() -> str:
    """One CTE per phrase: hits are counted in the text of its turn."""
    steps, last = [f"s0 AS (SELECT conv_id, turn, {_POLITE} AS t, 0 AS n FROM conversations)"], 0
    for i, p in enumerate(L.SAFE_PHRASES):
        pat = rf"(?i)(^|[^\p{{L}}\p{{N}}_])({p})($|[^\p{{L}}\p{{N}}_])"
        steps.append(f"s{i + 1} AS (SELECT conv_id, turn, regexp_replace(regexp_replace(t, '{pat}', '\\1\\3', 'g'), '{pat}', '\\1\\3', 'g') AS t, n + len(regexp_extract_all(t, '(?i)\\b{p}\\b')) AS n FROM s{i})")
        last = i + 1
    return "WITH " + ",\n".join(steps) + f"\nSELECT conv_id, turn, CAST(n AS BIGINT) AS removed, md5({f(SQUEEZE, r"regexp_replace(t, '\s+([,.!?;:])', '\1', 'g')")}) AS text_md5 FROM s{last}"


@query("safe_normalize", _filler_sql())
def safe_normalize(spark, d):
    c = table(spark, d, "conversations").withColumn("t", F.concat(F.lit("Please, can you "), "text", F.lit(" to be honest, just sort of OK ; really")))
    return c.withColumn("r", T.drop_filler(F.col("t"))).select("conv_id", "turn", F.col("r.removed").alias("removed"), F.md5("r.text").alias("text_md5"))


def _cleanup_sql() -> str:
    t = "'Thanks, i think ' || text || ' , very properly done'"
    for p in [*L.CLEANUP_PHRASES]:
        t = f"regexp_replace({t}, '(?i)\\b{p}\\b', '', 'g')"
    t = rf"regexp_replace(regexp_replace({t}, '\s+([,.;:])', '\1', 'g'), '(?i)\b(really|very|properly|clearly)\b', '', 'g')"
    return f"SELECT conv_id, turn, md5({f(SQUEEZE, t)}) AS text_md5 FROM conversations"


@query("light_cleanup", _cleanup_sql())
def light_cleanup(spark, d):
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", F.md5(T.light_cleanup(F.concat(F.lit("Thanks, i think "), "text", F.lit(" , very properly done")))).alias("text_md5"))


@query(
    "strip_contract",
    r"""SELECT conv_id, turn, md5(array_to_string(list_filter(string_split(t, chr(10)), lambda x: NOT regexp_matches(x, '^\s*(TASK_TERMS:|PRESERVED_EVIDENCE:|MANDATORY_EVIDENCE_TERMS:|MANDATORY_RETAINED_TERMS:|COMPRESSED_CONTEXT_CONTRACT:|- Preserve all mandatory evidence|- Concerns/risk evidence|- Do not infer missing experience)')), chr(10))) AS text_md5
FROM (SELECT conv_id, turn, 'TASK_TERMS: a, b' || chr(10) || text || chr(10) || '  PRESERVED_EVIDENCE:' || chr(10) || '- kept' AS t FROM conversations)""",
)
def strip_contract(spark, d):
    t = F.concat(F.lit("TASK_TERMS: a, b\n"), "text", F.lit("\n  PRESERVED_EVIDENCE:\n- kept"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5(T.strip_contract(t)).alias("text_md5"))


@query("canonical_text", sql("SELECT item_id, {{c}} AS canonical FROM benchmark", c=f(CANON, "'ML Ops & CI CD: ' || text")))
def canonical_text(spark, d):
    return table(spark, d, "benchmark").select("item_id", T.canonical(F.concat(F.lit("ML Ops & CI CD: "), "text")).alias("canonical"))


_SKILLS = ("python and fast api", "vector databases with milvus", "ML Ops on k8s", "no production Kubernetes", "human evaluation missing", "online monitoring", "retrieval-augmented generation", "Cloud Run docker", "synthetic data only", "model drift and data drift", "acceptance criteria", "large language models", "genai", "nothing in particular")


def phrases(key: str) -> Column:
    """Three phrases of evidence, chosen by a number."""
    return F.concat_ws(". ", *[F.array(*[F.lit(x) for x in _SKILLS])[(F.col(key) * k + s) % len(_SKILLS)] for k, s in ((1, 0), (3, 1), (5, 2))])


def evidence_text() -> Column:
    """Texts with evidence in them, derived from orders: three phrases each."""
    return phrases("o_orderkey")


_EVIDENCE_SQL = (
    "(SELECT o_orderkey, "
    + " || '. ' || ".join(f"([{quoted(_SKILLS)}])[CAST((o_orderkey * {k} + {s}) % {len(_SKILLS)} AS INT) + 1]" for k, s in ((1, 0), (3, 1), (5, 2)))
    + " AS text FROM orders)"
)


def _synonym_sql(t: str) -> str:
    t = f"replace(replace(lower({t}), 'ml ops', 'mlops'), 'ci cd', 'ci/cd')"
    for old in sorted(L.SYNONYMS, key=len, reverse=True):
        t = f"regexp_replace({t}, '(^|[^a-z0-9]){old}($|[^a-z0-9])', '\\1{L.SYNONYMS[old]}\\2', 'g')"
    return rf"regexp_replace(regexp_replace(regexp_replace({t}, '[^a-z0-9+/#. -]+', ' ', 'g'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')"


@query("synonym_text", f"SELECT o_orderkey, {_synonym_sql('text')} AS canonical FROM {_EVIDENCE_SQL}")
def synonym_text(spark, d):
    return table(spark, d, "orders").select("o_orderkey", T.synonym_canonical(evidence_text()).alias("canonical"))


@query("char4_ngrams", f"SELECT o_orderkey, CAST(greatest(length(c) - 3, 1) AS BIGINT) AS n_grams, md5(array_to_string(list_transform(range(1, greatest(length(c) - 3, 1) + 1), lambda i: substr(c, i, 4)), '|')) AS grams_md5 FROM (SELECT o_orderkey, {_synonym_sql('text')} AS c FROM {_EVIDENCE_SQL})")
def char4_ngrams(spark, d):
    g = T.char_ngrams(evidence_text())
    return table(spark, d, "orders").select("o_orderkey", F.size(g).cast("long").alias("n_grams"), F.md5(joined(g)).alias("grams_md5"))


@query("canonical_key", r"SELECT page_id, regexp_replace(regexp_replace(lower(url), '[^a-z0-9_]+', '_', 'g'), '^_+|_+$', '', 'g') AS key FROM pages")
def canonical_key(spark, d):
    return table(spark, d, "pages").select("page_id", T.canonical_key(F.col("url")).alias("key"))


@query("strip_fences", "SELECT event_id, props AS body FROM events")
def strip_fences(spark, d):
    return table(spark, d, "events").select("event_id", T.strip_fences(F.concat(F.lit("```json\n"), "props", F.lit("\n``` "))).alias("body"))


@query("json_candidate", "SELECT event_id, props AS body FROM events")
def json_candidate(spark, d):
    return table(spark, d, "events").select("event_id", T.json_candidate(F.concat(F.lit("Here it is: "), "props", F.lit(" - done"))).alias("body"))


@query("words_tf", sql("SELECT source, w AS token, count(*) AS n FROM (SELECT source, unnest({{w}}) AS w FROM documents) WHERE w NOT IN ({{s}}) GROUP BY source, w", w=f(WORDS), s=STOP))
def words_tf(spark, d):
    return docs(spark, d).select("source", F.explode(T.words(F.col("text"))).alias("token")).groupBy("source", "token").agg(F.count("*").alias("n"))


@query("keyword_set", sql(r"SELECT item_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_+#.-]{2,}'), lambda x: lower(x)), lambda x: x NOT IN ({{s}})))), '|') AS keywords FROM benchmark", s=quoted(L.KEYWORD_STOP)))
def keyword_set(spark, d):
    return table(spark, d, "benchmark").select("item_id", joined(F.sort_array(T.keyword_set(F.col("text")))).alias("keywords"))


# -- similarity and relevance ---------------------------------------------------------------------------------------

_TF = """q AS (SELECT item_id, w, count(*) AS n FROM (SELECT item_id, unnest({{wq}}) AS w FROM benchmark) WHERE w NOT IN ({{s}}) GROUP BY ALL),
d AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest({{wd}}) AS w FROM documents) WHERE w NOT IN ({{s}}) GROUP BY ALL),
qn AS (SELECT item_id, sum(n * n) AS x FROM q GROUP BY item_id), dn AS (SELECT doc_id, sum(n * n) AS x FROM d GROUP BY doc_id),
sim AS (SELECT q.item_id, d.doc_id, sum(q.n * d.n) / sqrt(CAST(any_value(qn.x) * any_value(dn.x) AS DOUBLE)) AS similarity
  FROM q JOIN d ON q.w = d.w JOIN qn ON q.item_id = qn.item_id JOIN dn ON d.doc_id = dn.doc_id GROUP BY q.item_id, d.doc_id)"""
_TF = sql(_TF, wq=f(WORDS), wd=f(WORDS), s=STOP)


def _similar(spark, d):
    return relevance.relevance(table(spark, d, "benchmark"), docs(spark, d), "item_id", "doc_id")


@query("tf_cosine_query_docs", f"WITH {_TF} SELECT item_id, doc_id, round(similarity, 6) AS similarity, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(similarity, 9) DESC, doc_id) AS r FROM sim) WHERE r <= 10")
def tf_cosine_query_docs(spark, d):
    top = relevance.top_k(_similar(spark, d).withColumn("similarity", F.round("similarity", 9)), "item_id", "similarity", "doc_id", 10)
    return top.select("item_id", "doc_id", F.round("similarity", 6).alias("similarity"), "rank")


@query("relevance_filter", f"WITH {_TF} SELECT item_id, count(*) AS kept, round(max(similarity), 6) AS best FROM sim WHERE round(similarity, 9) >= 0.15 GROUP BY item_id")
def relevance_filter(spark, d):
    similar = relevance.relevance(table(spark, d, "benchmark"), docs(spark, d), "item_id", "doc_id", least=0.15)
    kept = similar.where(F.round("similarity", 9) >= 0.15)
    return kept.groupBy("item_id").agg(F.count("*").alias("kept"), F.round(F.max("similarity"), 6).alias("best"))


_LEX = r"list_distinct(regexp_extract_all(lower({t}), '[a-zA-Z0-9_+#.-]+'))"


@query("lexical_jaccard_turns", f"WITH c AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations), t AS (SELECT conv_id, turn, {f(_LEX)} AS a, {f(_LEX, 'p')} AS b FROM c WHERE p IS NOT NULL) SELECT conv_id, turn, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END, 6) AS similarity FROM t")
def lexical_jaccard_turns(spark, d):
    c = table(spark, d, "conversations").withColumn("p", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("p is not null")
    return c.select("conv_id", "turn", F.round(S.lexical(F.col("text"), F.col("p")), 6).alias("similarity"))


@query("shannon_entropy", sql("WITH w AS (SELECT doc_id, unnest({{w}}) AS w FROM documents), c AS (SELECT doc_id, w, count(*) AS n FROM w GROUP BY ALL), p AS (SELECT doc_id, n / sum(n) OVER (PARTITION BY doc_id) AS p FROM c) SELECT doc_id, abs(round(sum(p * log2(p)), 6)) AS entropy FROM p GROUP BY doc_id", w=f(WORDS)))
def shannon_entropy(spark, d):
    return docs(spark, d).select("doc_id", F.round(S.entropy(T.all_words(F.col("text"))), 6).alias("entropy")).where("entropy is not null")


@query("top_terms", sql(r"WITH w AS (SELECT source, doc_id, unnest(list_transform(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_+#.-]{2,}'), lambda x: lower(x))) AS w FROM documents), c AS (SELECT source, w AS term, count(*) AS n, min(doc_id) AS first_doc FROM w WHERE w NOT IN ({{s}}) GROUP BY source, w) SELECT source, term, n, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, first_doc, term) AS r FROM c) WHERE r <= 40", s=quoted(L.TOP_TERM_STOP)))
def top_terms(spark, d):
    w = docs(spark, d).select("source", "doc_id", F.explode(F.transform(T.find_all(F.col("text"), r"[A-Za-z][A-Za-z0-9_+#.-]{2,}"), F.lower)).alias("term"))
    c = w.where(~F.col("term").isin(*L.TOP_TERM_STOP)).groupBy("source", "term").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
    r = c.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"), "first", "term")))
    return r.where("rank <= 40").select("source", "term", "n", "rank")


@query("negation_flag", f"SELECT doc_id, list_bool_or(list_transform([{quoted(L.POLARITY_TERMS)}], lambda x: contains(lower(text), x))) AS negated FROM documents")
def negation_flag(spark, d):
    return docs(spark, d).select("doc_id", T.has_polarity(F.col("text")).alias("negated"))


@query("critical_flag", f"SELECT o_orderkey, regexp_matches(lower(text), '\\b({L.CRITICAL_WORDS})\\b') AS critical FROM {_EVIDENCE_SQL}")
def critical_flag(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.lower(evidence_text()).rlike(rf"\b({L.CRITICAL_WORDS})\b").alias("critical"))


@query("dense_cosine_topk", "WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), s AS (SELECT a.vec_id AS query_id, b.vec_id, list_cosine_similarity(a.v, b.v) AS s FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0) SELECT query_id, vec_id, round(s, 5) AS similarity, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS r FROM s) WHERE r <= 5")
def dense_cosine_topk(spark, d):
    """Each vector against every query, in blocks: a stated query set against all rows, and its best five kept block by block."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding", F.sqrt(S.dense_dot(F.col("embedding"), F.col("embedding"))).alias("norm"))
    q = e.where("vec_id % 50 = 0").select(F.struct(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), F.col("norm").alias("n")).alias("q"))
    best = relevance.dense_top_k(q, e, 5)
    return best.select("query_id", "vec_id", F.round("similarity", 5).alias("similarity"), "rank")


# -- extractors ---------------------------------------------------------------------------------------------------------

@query("extract_numbers", sql(r"SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all({{t}}, '[$₹€£]?\b\d+(?:[,.]\d+)*(?:%|\b)'))), '|') AS numbers FROM documents", t=f(FOLD)))
def extract_numbers(spark, d):
    return docs(spark, d).select("doc_id", joined(T.numbers(F.col("text"))).alias("numbers"))


@query("extract_codes", r"SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(t, '\b[A-Z]{1,6}[-_]?[0-9]{1,8}[A-Z0-9-]*\b'))), '|') AS codes FROM (SELECT doc_id, 'ref ' || upper(lang) || '-' || doc_id || ', X9 and ' || upper(lang) || doc_id || 'B' AS t FROM documents)")
def extract_codes(spark, d):
    t = F.concat(F.lit("ref "), F.upper("lang"), F.lit("-"), F.col("doc_id").cast("string"), F.lit(", X9 and "), F.upper("lang"), F.col("doc_id").cast("string"), F.lit("B"))
    return docs(spark, d).select("doc_id", joined(T.codes(t)).alias("codes"))


@query("extract_entities", sql(r"SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all({{t}}, '\b[A-Z][a-zA-Z0-9&.-]+(?:\s+[A-Z][a-zA-Z0-9&.-]+){0,4}\b'), lambda x: lower(x) NOT IN ({{s}})))), '|') AS entities FROM documents", s=STOP, t=f(FOLD)))
def extract_entities(spark, d):
    return docs(spark, d).select("doc_id", joined(T.entities(F.col("text"))).alias("entities"))


@query("constraint_windows", sql("WITH w AS (SELECT doc_id, {{w}} AS w FROM documents), i AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w), h AS (SELECT DISTINCT doc_id, array_to_string(w[greatest(i - 3, 1) : i + 3], ' ') AS x FROM i WHERE w[i] IN ({{t}})) SELECT doc_id, count(*) AS n_windows, md5(string_agg(x, '|' ORDER BY x)) AS windows_md5 FROM h GROUP BY doc_id", w=f(WORDS), t=TRIGGER))
def constraint_windows(spark, d):
    w = docs(spark, d).withColumn("w", T.constraint_windows(F.col("text"))).where(F.size("w") > 0)
    return w.select("doc_id", F.size("w").cast("long").alias("n_windows"), F.md5(joined(F.col("w"))).alias("windows_md5"))


def _group_sql(w: str) -> str:
    out = "CASE "
    for g, cues in L.CONSTRAINT_GROUPS:
        out += "WHEN " + " OR ".join(f"contains(' ' || {w} || ' ', {quoted([c])})" for c in cues) + f" THEN '{g}' "
    return out + "ELSE 'generic' END"


@query("constraint_groups", sql("WITH w AS (SELECT doc_id, {{w}} AS w FROM documents), i AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w), h AS (SELECT doc_id, array_to_string(w[greatest(i - 6, 1) : i + 8], ' ') AS x FROM i WHERE w[i] IN ({{t}})) SELECT doc_id, {{g}} AS grp, count(*) AS n FROM h GROUP BY ALL", w=f(WORDS), t=TRIGGER, g=_group_sql("x")))
def constraint_groups(spark, d):
    toks = docs(spark, d).select("doc_id", T.all_words(F.col("text")).alias("w"))
    hits = toks.select("doc_id", F.explode(F.filter(F.transform("w", lambda x, i: F.when(x.isin(*T.TRIGGERS), T.window(F.col("w"), i, 6, 8))), lambda x: x.isNotNull())).alias("x"))
    return hits.groupBy("doc_id", T.constraint_group(F.col("x")).alias("grp")).agg(F.count("*").alias("n"))


@query("keywords_topk", sql("WITH w AS (SELECT DISTINCT item_id, unnest({{w}}) AS w FROM benchmark), s AS (SELECT item_id, w, length(w) + CASE WHEN regexp_matches(w, '[0-9]') THEN 4 ELSE 0 END + CASE WHEN upper(w) = w THEN 3 ELSE 0 END AS s FROM w WHERE length(w) >= 3 AND w NOT IN ({{s}})) SELECT item_id, string_agg(w, '|' ORDER BY s DESC, w) AS keywords FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY s DESC, w) AS r FROM s) WHERE r <= 30 GROUP BY item_id", w=f(WORDS), s=STOP))
def keywords_topk(spark, d):
    return table(spark, d, "benchmark").select("item_id", joined(T.keywords(F.col("text"))).alias("keywords"))


@query("constraint_sentences", sql("SELECT doc_id, array_to_string(list_filter({{s}}, lambda x: list_bool_or(list_transform([{{c}}], lambda y: contains(lower(x), y))))[1:20], '|') AS sentences FROM documents", s=f(SENTENCES, f(STRIP)), c=quoted(L.CONSTRAINT_CUES)))
def constraint_sentences(spark, d):
    cues = F.array(*[F.lit(x) for x in L.CONSTRAINT_CUES])
    s = F.filter(T.sentences(F.col("text")), lambda x: F.exists(cues, lambda y: F.contains(F.lower(x), y)))
    return docs(spark, d).select("doc_id", joined(F.slice(s, 1, 20)).alias("sentences"))


# -- dedup ------------------------------------------------------------------------------------------------------------------


@query("exact_dup_docs", "SELECT md5(text) AS text_md5, count(*) AS n, min(doc_id) AS keeper FROM documents GROUP BY md5(text) HAVING count(*) > 1")
def exact_dup_docs(spark, d):
    return docs(spark, d).groupBy(F.md5("text").alias("text_md5")).agg(F.count("*").alias("n"), F.min("doc_id").alias("keeper")).where("n > 1")


_DEDUP = sql(
    """WITH RECURSIVE u AS (SELECT conv_id, turn, unnest({{s}}) AS s, generate_subscripts({{s}}, 1) - 1 AS pos FROM conversations),
t AS (SELECT conv_id, turn, pos, w, count(*) AS n FROM (SELECT conv_id, turn, pos, unnest({{w}}) AS w FROM u) WHERE w NOT IN ({{stop}}) GROUP BY ALL),
n AS (SELECT conv_id, turn, pos, sum(n * n) AS x FROM t GROUP BY ALL),
e AS (SELECT a.conv_id, a.turn, a.pos AS a, b.pos AS b FROM t a JOIN t b ON a.conv_id = b.conv_id AND a.turn = b.turn AND a.w = b.w AND b.pos < a.pos
  JOIN n x ON x.conv_id = a.conv_id AND x.turn = a.turn AND x.pos = a.pos JOIN n y ON y.conv_id = b.conv_id AND y.turn = b.turn AND y.pos = b.pos
  GROUP BY a.conv_id, a.turn, a.pos, b.pos HAVING sum(a.n * b.n) / sqrt(CAST(any_value(x.x) * any_value(y.x) AS DOUBLE)) >= 0.9),
near AS (SELECT conv_id, turn, a, list(b) AS bs FROM e GROUP BY ALL),
m AS (SELECT conv_id, turn, max(pos) AS top FROM u GROUP BY ALL),
r AS (SELECT conv_id, turn, -1 AS pos, CAST([] AS BIGINT[]) AS gone, top FROM m
  UNION ALL SELECT r.conv_id, r.turn, r.pos + 1, CASE WHEN near.bs IS NOT NULL AND len(list_filter(near.bs, lambda b: NOT list_contains(r.gone, b))) > 0 THEN list_append(r.gone, r.pos + 1) ELSE r.gone END, r.top
  FROM r LEFT JOIN near ON near.conv_id = r.conv_id AND near.turn = r.turn AND near.a = r.pos + 1 WHERE r.pos < r.top)
SELECT conv_id, turn, CAST(top + 1 - len(gone) AS BIGINT) AS kept, CAST(len(gone) AS BIGINT) AS removed FROM r WHERE pos = top""",
    s=f(SENTENCES, f(STRIP, "(text || chr(10) || text)")),
    w=f(WORDS, "s"),
    stop=STOP,
)


@query("sentence_dedup", _DEDUP)
def sentence_dedup(spark, d):
    c = spread(table(spark, d, "conversations")).select(F.struct("conv_id", "turn").alias("k"), F.concat("text", F.lit("\n"), "text").alias("text"))
    u = dedup.units(c, "k", T.sentences(F.col("text")))
    out = dedup.keep_first(u, dedup.cosine_edges(u, 0.90))
    return out.groupBy("g").agg(F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("removed")).select("g.conv_id", "g.turn", "kept", "removed")


@query("polarity_dedup")
def polarity_dedup(spark, d):
    c = spread(table(spark, d, "conversations")).select(F.struct("conv_id", "turn").alias("k"), F.concat("text", F.lit("\n"), "text").alias("text"))
    u = dedup.units(c, "k", T.line_chunks(F.col("text")))
    out = dedup.keep_first(u, dedup.lexical_edges(u, 0.88))
    return out.groupBy("g").agg(F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("removed")).select("g.conv_id", "g.turn", "kept", "removed")


@query("diversity_select")
def diversity_select(spark, d):
    """Relevant documents of each benchmark item in order of similarity, near-copies of better ones left out."""
    sim = relevance.top_k(_similar(spark, d).withColumn("similarity", F.round("similarity", 9)), "item_id", "similarity", "doc_id", 20)
    u = settle(relevance.with_texts(sim, docs(spark, d).select("doc_id", "text"), "doc_id").select(F.col("item_id").alias("g"), (F.col("rank") - 1).alias("pos"), F.col("text").alias("unit"), "doc_id"))
    out = dedup.keep_first(u.select("g", "pos", "unit"), dedup.cosine_edges(u, 0.90))
    return out.join(u.select("g", "pos", "doc_id"), ["g", "pos"]).select(F.col("g").alias("item_id"), "doc_id", "pos", "kept")


# -- cost, config and risk ---------------------------------------------------------------------------------------------------

def _price_sql(i: str, o: str) -> str:
    return f"(CAST({i} AS DOUBLE) / 1e6 * CAST(0.59 AS DOUBLE) + CAST({o} AS DOUBLE) / 1e6 * CAST(0.79 AS DOUBLE))"


_COSTS = f"SELECT doc_id, n_chars AS b, n_chars * (doc_id % 13) // 10 AS a, {_price_sql('n_chars', '1000')} AS cb, {_price_sql('(n_chars * (doc_id % 13) // 10)', '1000')} AS ca FROM documents"


def _cost_frame(spark, d):
    before, after = F.col("n_chars"), F.floor(F.col("n_chars") * (F.col("doc_id") % 13) / 10)
    return docs(spark, d).select("doc_id", *[c.alias(k) for k, c in cost.cost_columns(before, after, F.lit(1000)).items()])


@query("cost_metrics", f"SELECT doc_id, round(cb, 8) AS cost_before, round(ca, 8) AS cost_after, round(greatest(0, cb - ca), 8) AS savings, round(greatest(0, cb - ca) / cb, 4) AS cost_reduction, CAST(greatest(0, b - a) AS BIGINT) AS tokens_saved, round(greatest(0, b - a) / b * 100.0, 4) AS reduction_pct FROM ({_COSTS})")
def cost_metrics(spark, d):
    r = {"cost_before": 8, "cost_after": 8, "savings": 8, "cost_reduction": 4, "reduction_pct": 4}
    c = _cost_frame(spark, d)
    return c.select("doc_id", *[F.round(x, r[x]).alias(x) if x in r else F.col(x) for x in c.columns[1:]])


@query("success_score", f"SELECT doc_id, round(greatest(0.0, least(1.0, 0.60 * (1 - (doc_id % 10) / 20.0) + 0.40 * greatest(0, cb - ca) / cb)), 6) AS success FROM ({_COSTS})")
def success_score(spark, d):
    kept = 1 - (F.col("doc_id") % 10) / 20.0
    c = _cost_frame(spark, d)
    return c.select("doc_id", F.round(cost.success(kept, F.col("cost_reduction"), F.col("cost_reduction")), 6).alias("success"))


_RISK = "(SELECT doc_id, doc_id % 7 = 0 AS back, doc_id % 3 = 0 AS strict, 1 - (doc_id % 11) / 100.0 AS r, 1 - (doc_id % 17) / 50.0 AS c, 1 - (doc_id % 5) / 60.0 AS n, 1 - (doc_id % 9) / 40.0 AS e, CAST(doc_id % 40 AS DOUBLE) AS red FROM documents)"


@query("risk_label", f"SELECT doc_id, CASE WHEN back THEN 'ROLLED_BACK' WHEN strict AND (r < 0.90 OR red > 28) THEN 'HIGH' WHEN r >= 0.94 AND c >= 0.88 AND n >= 0.98 AND e >= 0.90 AND red <= 30 THEN 'LOW' WHEN r >= 0.88 AND c >= 0.72 AND n >= 0.92 AND e >= 0.80 THEN 'MEDIUM' ELSE 'HIGH' END AS risk FROM {_RISK}")
def risk_label(spark, d):
    i = F.col("doc_id")
    status = F.when(i % 7 == 0, "rolled_back").otherwise("accepted")
    label = cost.risk_label(status, i % 3 == 0, 1 - (i % 11) / 100.0, 1 - (i % 17) / 50.0, 1 - (i % 5) / 60.0, 1 - (i % 9) / 40.0, (i % 40).cast("double"))
    return docs(spark, d).select("doc_id", label.alias("risk"))


_MODE = "([' Conservative', 'balanced', 'AGGRESSIVE', 'other'])[CAST(event_id % 4 AS INT) + 1]"


@query(
    "mode_resolution",
    f"""WITH m AS (SELECT event_id, lower(trim({_MODE})) AS m, event_id % 3 = 0 AS s FROM events),
t AS (SELECT event_id, m, s, CASE m WHEN 'conservative' THEN 0.95 WHEN 'aggressive' THEN 0.82 ELSE 0.88 END AS r, CASE m WHEN 'conservative' THEN 0.94 WHEN 'aggressive' THEN 0.86 ELSE 0.90 END AS d, CASE m WHEN 'conservative' THEN 0.12 WHEN 'aggressive' THEN 0.20 ELSE 0.15 END AS q FROM m)
SELECT event_id, CASE WHEN s AND m = 'aggressive' THEN 'balanced' ELSE m END AS mode, CAST(CASE WHEN s THEN greatest(r, 0.88) ELSE r END AS DOUBLE) AS min_retention, CAST(CASE WHEN s AND m = 'aggressive' THEN greatest(d, 0.90) ELSE d END AS DOUBLE) AS duplicate, CAST(CASE WHEN s AND m = 'aggressive' THEN least(q, 0.15) ELSE q END AS DOUBLE) AS relevance FROM t""",
)
def mode_resolution(spark, d):
    mode = F.array(*[F.lit(x) for x in (" Conservative", "balanced", "AGGRESSIVE", "other")])[F.col("event_id") % 4]
    return table(spark, d, "events").select("event_id", cost.resolved_mode(mode, F.col("event_id") % 3 == 0).alias("m")).select("event_id", "m.*")


@query("usage_reconciliation", f"SELECT l_orderkey, l_linenumber, round({_price_sql('l_quantity', '100')}, 8) AS actual_cost, round(greatest(0.0, 0.001 * l_quantity / greatest(1, l_suppkey % 50)), 8) AS reconciled, round((l_quantity - l_suppkey % 50) / greatest(1, l_suppkey % 50) * 100, 4) AS error_pct FROM lineitem")
def usage_reconciliation(spark, d):
    est = F.col("l_suppkey") % 50
    one = F.greatest(F.lit(1), est)
    return table(spark, d, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.round(cost.price(F.col("l_quantity"), F.lit(100)), 8).alias("actual_cost"),
        F.round(F.greatest(F.lit(0.0), 0.001 * F.col("l_quantity") / one), 8).alias("reconciled"),
        F.round((F.col("l_quantity") - est) / one * 100, 4).alias("error_pct"),
    )


# -- retention ------------------------------------------------------------------------------------------------------------------

#: a shortened text to measure retention in
_SHORT = "replace(replace({t}, 'th', ''), '1', '')"


def short(c: str = "text") -> Column:
    return F.replace(F.replace(F.col(c), F.lit("th"), F.lit("")), F.lit("1"), F.lit(""))


_NUM = r"list_distinct(regexp_extract_all({t}, '[$₹€£]?\b\d+(?:[,.]\d+)*(?:%|\b)'))"


@query("numeric_coverage", r"""WITH d AS (SELECT doc_id, """ + f(FOLD) + r""" AS text FROM documents), n AS (SELECT doc_id, """ + f(_SHORT) + r""" AS b, unnest(""" + f(_NUM) + r""") AS x FROM d),
c AS (SELECT doc_id, avg(CASE WHEN contains(b, x) OR (regexp_replace(x, '[^0-9.]', '', 'g') <> '' AND contains(regexp_replace(b, '[^0-9.]', '', 'g'), regexp_replace(x, '[^0-9.]', '', 'g'))) THEN 1.0 ELSE 0.0 END) AS c FROM n GROUP BY doc_id)
SELECT d.doc_id, round(coalesce(c.c, 1.0), 6) AS coverage FROM d LEFT JOIN c ON d.doc_id = c.doc_id""")
def numeric_coverage(spark, d):
    return docs(spark, d).select("doc_id", F.round(retention.numeric(F.col("text"), short()), 6).alias("coverage"))


@query("keyword_coverage", sql("""WITH w AS (SELECT DISTINCT item_id, unnest({{w}}) AS w FROM benchmark), k AS (SELECT item_id, w, row_number() OVER (PARTITION BY item_id ORDER BY length(w) + CASE WHEN regexp_matches(w, '[0-9]') THEN 4 ELSE 0 END + CASE WHEN upper(w) = w THEN 3 ELSE 0 END DESC, w) AS r FROM w WHERE length(w) >= 3 AND w NOT IN ({{s}})),
h AS (SELECT item_id, {{h}} AS h FROM benchmark)
SELECT k.item_id, round(avg(CASE WHEN list_contains(h.h, k.w) THEN 1.0 ELSE 0.0 END), 6) AS coverage FROM k JOIN h ON k.item_id = h.item_id WHERE r <= 30 GROUP BY k.item_id""", w=f(WORDS), s=STOP, h=f(WORDS, f(_SHORT))))
def keyword_coverage(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.round(retention.keyword(F.col("text"), short()), 6).alias("coverage"))


@query("entity_retention")
def entity_retention(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.round(retention.entity(F.col("text"), short()), 6).alias("retention"))


@query("semantic_retention", sql("""WITH a AS (SELECT item_id, w, count(*) AS n FROM (SELECT item_id, unnest({{w}}) AS w FROM benchmark) WHERE w NOT IN ({{s}}) GROUP BY ALL), b AS (SELECT item_id, w, count(*) AS n FROM (SELECT item_id, unnest({{h}}) AS w FROM benchmark) WHERE w NOT IN ({{s}}) GROUP BY ALL)
SELECT x.item_id, round(coalesce(d / sqrt(CAST(x.x * y.x AS DOUBLE)), 0.0), 6) AS retention FROM (SELECT item_id, sum(n * n) AS x FROM a GROUP BY item_id) x LEFT JOIN (SELECT item_id, sum(n * n) AS x FROM b GROUP BY item_id) y ON x.item_id = y.item_id
LEFT JOIN (SELECT a.item_id, sum(a.n * b.n) AS d FROM a JOIN b ON a.item_id = b.item_id AND a.w = b.w GROUP BY a.item_id) z ON x.item_id = z.item_id""", w=f(WORDS), s=STOP, h=f(WORDS, f(_SHORT))))
def semantic_retention(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.round(retention.semantic(F.col("text"), short()), 6).alias("retention"))


@query("retention_score")
def retention_score(spark, d):
    src = docs(spark, d).select("doc_id", "text", T.drop_filler(F.col("text")).text.alias("short"))
    return retention.scores(src, "doc_id", "text", "short").select("doc_id", *[F.round(m, 6).alias(m) for m in retention.MEASURES])
