"""Evidence, governance, memory, pacing and whole-request queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexforge.functions import lexicons as L
from lexforge.functions import text as T
from lexforge.operators import evidence as E
from lexforge.operators import governed, memory, ontology, quality, relevance, reports, selection
from lexforge.plans import compress
from lexforge.plans import optimize as O
from lexforge.plans.catalog import _EVIDENCE_SQL, CANON, COUNT, _similar, docs, evidence_text, f, joined, phrases, quoted, sql, table
from lexforge.sources.io import spread, spread_rows
from lexforge.streaming import pacing

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return keep


# -- selection ------------------------------------------------------------------------------------------------


def _sized(spark, d) -> DataFrame:
    """Turns of each conversation with their cost and a value."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    x = table(spark, d, "conversations").withColumn("r", F.row_number().over(w))
    return x.select("conv_id", "r", T.count_tokens(F.col("text")).alias("cost"), ((F.col("conv_id") * 37 + F.col("turn") * 11) % 101 / 100.0).alias("value"))


_SIZED = sql("s AS (SELECT conv_id, r, CAST({{c}} AS BIGINT) AS cost, (conv_id * 37 + turn * 11) % 101 / 100.0 AS value FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations))", c=f(COUNT))


@query(
    "greedy_budget_fill",
    f"""WITH RECURSIVE {_SIZED}, p AS (SELECT conv_id, CAST(0 AS BIGINT) AS r, CAST(0 AS BIGINT) AS used, CAST(0 AS BIGINT) AS packed FROM s GROUP BY conv_id
UNION ALL SELECT p.conv_id, p.r + 1, CASE WHEN used + cost <= 250 THEN used + cost ELSE used END, CASE WHEN used + cost <= 250 THEN packed + 1 ELSE packed END FROM p JOIN s ON s.conv_id = p.conv_id AND s.r = p.r + 1)
SELECT conv_id, used, packed FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY r DESC) AS k FROM p) WHERE k = 1""",
)
def greedy_budget_fill(spark, d):
    g = _sized(spark, d).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("r", "cost"))).alias("c"))
    g = g.withColumn("took", selection.first_fit(F.transform("c", lambda x: F.struct(x.r.alias("idx"), x.cost.alias("cost"))), F.lit(250)))
    used = F.aggregate(F.filter("c", lambda x: F.array_contains(F.col("took"), x.r)), F.lit(0).cast("long"), lambda a, x: a + x.cost)
    return g.select("conv_id", used.alias("used"), F.size("took").cast("long").alias("packed"))


@query(
    "knapsack_select",
    f"""WITH RECURSIVE {_SIZED}, p AS (SELECT conv_id, CAST(0 AS BIGINT) AS r, CAST(0 AS BIGINT) AS used, CAST(0 AS BIGINT) AS worth, CAST(0 AS BIGINT) AS bits FROM s GROUP BY conv_id
UNION SELECT p.conv_id, p.r + 1, used + k * greatest(cost, 1), worth + k * CAST(round_even(value * 10000, 0) AS BIGINT), bits + k * CAST(2 ** p.r AS BIGINT) FROM p JOIN s ON s.conv_id = p.conv_id AND s.r = p.r + 1, (VALUES (0), (1)) AS v(k) WHERE used + k * greatest(cost, 1) <= 250 AND (k = 0 OR value > 0)),
b AS (SELECT conv_id, worth, bits, row_number() OVER (PARTITION BY conv_id ORDER BY worth DESC, used, bits) AS place FROM p)
SELECT conv_id, worth, array_to_string(list_filter(range(1, 20), lambda i: (bits >> (i - 1)) % 2 = 1), '|') AS chosen FROM b WHERE place = 1""",
)
def knapsack_select(spark, d):
    out = selection.knapsack(_sized(spark, d).withColumn("budget", F.lit(250)), "conv_id", "r", "value", "cost", "budget")
    worth = F.bround(F.col("value") * 10_000, 0).cast("long")
    places = F.sort_array(F.collect_list(F.when(F.col("chosen"), F.col("r"))))
    return out.groupBy("conv_id").agg(F.sum(F.when(F.col("chosen"), worth).otherwise(0)).alias("worth"), joined(places.cast("array<string>")).alias("chosen"))


@query("rollback", "SELECT doc_id, CASE WHEN doc_id % 11 < 4 THEN text ELSE lang END AS prompt, CASE WHEN doc_id % 11 < 4 THEN 'rolled_back' ELSE 'accepted' END AS status FROM documents")
def rollback(spark, d):
    back = (1 - (F.col("doc_id") % 11) / 40.0 >= 0.88) & (F.col("doc_id") % 11 < 4)
    return docs(spark, d).select("doc_id", F.when(back, F.col("text")).otherwise(F.col("lang")).alias("prompt"), F.when(back, "rolled_back").otherwise("accepted").alias("status"))


# -- evidence and quality ----------------------------------------------------------------------------------------


def _hit_sql(name_aliases: dict) -> str:
    parts = [f"CASE WHEN regexp_matches(c, '{E.pattern(a).replace(chr(39), chr(39) * 2)}') THEN '{n}' END" for n, a in sorted(name_aliases.items())]
    return "list_filter([" + ", ".join(parts) + "], lambda x: x IS NOT NULL)"


_C = f(CANON)
_LEDGER = f"""h AS (SELECT o_orderkey, text, c, {_hit_sql(L.ENTITIES)} AS e0, {_hit_sql(L.CONCERNS)} AS concerns, {_hit_sql(L.REASONS)} AS reasons FROM (SELECT *, {_C} AS c FROM {_EVIDENCE_SQL})),
ledger AS (SELECT o_orderkey, text, c, concerns, reasons, list_sort(list_distinct(list_concat(e0, list_filter([{", ".join(f"CASE WHEN list_contains(concerns, '{k}') THEN '{v}' END" for k, v in L.CONCERN_ENTITY.items())}], lambda x: x IS NOT NULL)))) AS entities FROM h)"""


def _ledgers(spark, d) -> DataFrame:
    return E.with_ledger(spread(table(spark, d, "orders").select("o_orderkey")).select("o_orderkey", evidence_text().alias("text")), "text")


@query("ontology_hits", f"WITH {_LEDGER} SELECT hit, count(*) AS n FROM (SELECT unnest(e0) AS hit FROM h) GROUP BY hit")
def ontology_hits(spark, d):
    # outer: for a plain explode Spark adds a filter on the array, which would look for all names a second time
    t = spread(table(spark, d, "orders").select("o_orderkey")).select(F.explode_outer(E.hits(T.canonical(evidence_text()), L.ENTITIES)).alias("hit"))
    return t.where("hit is not null").groupBy("hit").agg(F.count("*").alias("n"))


@query("evidence_ledger", f"WITH {_LEDGER} SELECT o_orderkey, array_to_string(entities, '|') AS entities, array_to_string(concerns, '|') AS concerns, array_to_string(reasons, '|') AS reasons FROM ledger")
def evidence_ledger(spark, d):
    return _ledgers(spark, d).select("o_orderkey", *[joined(F.col(f"ledger.{x}")).alias(x) for x in ("entities", "concerns", "reasons")])


@query("ontology_ledger", f"WITH {_LEDGER} SELECT o_orderkey, array_to_string(entities, '|') AS entities, array_to_string(concerns, '|') AS concerns, array_to_string(reasons, '|') AS reasons FROM ledger")
def ontology_ledger(spark, d):
    """The ledgers again, from the ontology as a table."""
    texts = spread(table(spark, d, "orders").select("o_orderkey")).select("o_orderkey", evidence_text().alias("text"))
    names = ontology.ontology(spark, {"entities": L.ENTITIES, "concerns": L.CONCERNS, "reasons": L.REASONS})
    brought = spark.createDataFrame(list(L.CONCERN_ENTITY.items()), "concern string, entity string")
    out = ontology.ledgers(texts, "o_orderkey", "text", names, brought)
    return out.select("o_orderkey", *[joined(F.col(x)).alias(x) for x in ("entities", "concerns", "reasons")])


@query("protected_terms")
def protected_terms(spark, d):
    return _ledgers(spark, d).select("o_orderkey", joined(E.protected_terms(F.col("ledger"))).alias("terms"), E.ledger_text(F.col("ledger")).alias("rendered"))


def _weight_sql(c: str) -> str:
    return f"coalesce(list_sum(list_transform({c}, lambda x: CASE x " + " ".join(f"WHEN '{k}' THEN {w}" for k, w in L.CONCERN_WEIGHTS.items()) + " ELSE 1.0 END)), 0)"


_STOPPED = quoted(L.EVIDENCE_STOP)


def _kept_sql(base: str, ontology: dict) -> str:
    parts = []
    for n, a in sorted(ontology.items()):
        own = E._tokens_of(n)
        soft = f" OR len(list_filter([{quoted(own)}], lambda y: list_contains(toks, y))) / {len(own)}.0 >= 0.67" if own else ""
        parts.append(f"CASE WHEN list_contains({base}, '{n}') AND (regexp_matches(oc, '{E.pattern((*a, n))}'){soft}) THEN '{n}' END")
    return "list_filter([" + ", ".join(parts) + "], lambda x: x IS NOT NULL)"


_PAIRED = f"""{_LEDGER}, pair AS (SELECT b.o_orderkey, b.entities, b.concerns, b.reasons, o.c AS oc, list_filter(regexp_extract_all(o.c, '[a-z0-9+#/.-]+'), lambda x: x NOT IN ({_STOPPED}) AND length(x) > 1) AS toks
FROM ledger b JOIN ledger o ON o.o_orderkey = b.o_orderkey + 1)"""


def _pairs(spark, d) -> DataFrame:
    """Each order's evidence against the text of the next order."""
    a = _ledgers(spark, d)
    b = table(spark, d, "orders").select((F.col("o_orderkey") - 1).alias("o_orderkey"), evidence_text().alias("optimized"))
    return a.join(b, "o_orderkey")


@query("soft_contains", f"WITH {_PAIRED} SELECT o_orderkey, array_to_string({_kept_sql('entities', L.ENTITIES)}, '|') AS kept, round(CASE WHEN len(entities) = 0 THEN 100.0 ELSE 100.0 * len({_kept_sql('entities', L.ENTITIES)}) / len(entities) END, 6) AS share FROM pair")
def soft_contains(spark, d):
    p = _pairs(spark, d).withColumn("kept", E.retained(F.col("ledger.entities"), F.col("optimized"), L.ENTITIES))
    return p.select("o_orderkey", joined(F.col("kept")).alias("kept"), F.round(E.share_kept(F.col("ledger.entities"), F.col("kept")), 6).alias("share"))


@query("weighted_concern_retention", f"WITH {_PAIRED}, k AS (SELECT *, {_kept_sql('concerns', L.CONCERNS)} AS kept FROM pair) SELECT o_orderkey, round(CASE WHEN len(concerns) = 0 THEN 100.0 ELSE 100.0 * {_weight_sql('kept')} / {_weight_sql('concerns')} END, 6) AS share FROM k")
def weighted_concern_retention(spark, d):
    p = _pairs(spark, d).withColumn("kept", E.retained(F.col("ledger.concerns"), F.col("optimized"), L.CONCERNS))
    return p.select("o_orderkey", F.round(E.weighted_share(F.col("ledger.concerns"), F.col("kept")), 6).alias("share"))


_SAID = ("yes", "Shortlisted", "do not shortlist", "not shortlist", "N/A", "maybe", "strong recommend", "Rejected!", "manual review", "proceed", "", "unclear", "please review")
_SAID_SQL = f"([{quoted(_SAID)}])[CAST(event_id % {len(_SAID)} AS INT) + 1]"


@query(
    "decision_normalize",
    f"""WITH s AS (SELECT event_id, {_SAID_SQL} AS raw FROM events), v AS (SELECT event_id, raw, {f(CANON, 'raw')} AS v, trim(regexp_replace(lower(trim(raw)), '[^a-z ]', '', 'g')) AS a FROM s)
SELECT event_id, CASE WHEN raw = '' THEN NULL WHEN v IN ('yes', 'shortlist', 'shortlisted', 'selected', 'recommend', 'recommended', 'hire', 'proceed') THEN 'shortlist' WHEN v IN ('no', 'reject', 'rejected', 'do not shortlist', 'not shortlist') THEN 'reject'
 WHEN v IN ('n/a', 'na') THEN NULL WHEN v IN ('maybe', 'hold', 'borderline', 'manual review', 'review') THEN 'hold' WHEN contains(v, 'shortlist') OR contains(v, 'recommend') OR contains(v, 'proceed') THEN 'shortlist'
 WHEN contains(v, 'reject') OR contains(v, 'do not') THEN 'reject' WHEN contains(v, 'hold') OR contains(v, 'review') THEN 'hold' ELSE nullif(v, '') END AS quality_decision,
CASE WHEN raw = '' THEN NULL WHEN a IN ('shortlist', 'yes', 'selected', 'recommend', 'recommended', 'hire', 'proceed', 'shortlisted') THEN 'Shortlist' WHEN a IN ('reject', 'no', 'rejected', 'do not shortlist', 'not shortlist') THEN 'Reject'
 WHEN a IN ('hold', 'maybe', 'manual review', 'review', 'borderline') THEN 'Hold' WHEN contains(a, 'shortlist') OR contains(a, 'recommend') THEN 'Shortlist' WHEN contains(a, 'reject') OR contains(a, 'do not') THEN 'Reject' WHEN contains(a, 'hold') OR contains(a, 'review') THEN 'Hold' END AS agent_decision FROM v""",
)
def decision_normalize(spark, d):
    raw = F.array(*[F.lit(x) for x in _SAID])[F.col("event_id") % len(_SAID)]
    return table(spark, d, "events").select("event_id", quality.decision(raw).alias("quality_decision"), quality.agent_decision(raw).alias("agent_decision"))


def _output(spark, d) -> DataFrame:
    """Structured outputs as JSON text, derived from events."""
    i = F.col("event_id")
    body = F.concat(F.lit('{"final_score": '), (i % 90 / 10.0).cast("string"), F.lit(', "shortlist_decision": "'), F.array(*[F.lit(x) for x in ("Shortlist", "reject", "Hold")])[i % 3], F.lit('"}'))
    raw = F.when(i % 5 == 0, F.concat(F.lit("Score: "), (i % 90).cast("string"), F.lit("; decision = 'Hold'\nmore"))).when(i % 5 == 1, F.concat(F.lit("Answer: "), body, F.lit(" ok"))).otherwise(body)
    return table(spark, d, "events").select("event_id", raw.alias("raw"))


_OUTPUT_SQL = """(SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'x' WHEN 1 THEN 'y' ELSE 'z' END AS kind, event_id % 90 AS n, (['shortlist', 'reject', 'hold'])[CAST(event_id % 3 AS INT) + 1] AS d FROM events)"""


@query("score_extract", f"SELECT event_id, CASE WHEN kind = 'x' THEN CAST(n AS DOUBLE) ELSE n / 10.0 END AS score FROM {_OUTPUT_SQL}")
def score_extract(spark, d):
    return _output(spark, d).select("event_id", quality.score(F.col("raw")).alias("score"))


@query("decision_extract", f"SELECT event_id, CASE WHEN kind = 'x' THEN 'hold' ELSE d END AS decision FROM {_OUTPUT_SQL}")
def decision_extract(spark, d):
    return _output(spark, d).select("event_id", quality.extracted_decision(F.col("raw")).alias("decision"))


@query("score_preservation", "WITH d AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE (event_id % 30) / 10.0 END AS d FROM events) SELECT event_id, CAST(CASE WHEN d IS NULL THEN 70.0 WHEN d <= 0.25 THEN 100.0 WHEN d <= 0.5 THEN 85.0 ELSE round(greatest(0.0, 100.0 - d * 25.0), 6) END AS DOUBLE) AS component, coalesce(d <= 0.25, false) AS preserved FROM d")
def score_preservation(spark, d):
    delta = F.when(F.col("event_id") % 7 != 0, F.col("event_id") % 30 / 10.0)
    return table(spark, d, "events").select("event_id", F.round(quality.score_component(delta), 6).alias("component"), F.coalesce(delta <= 0.25, F.lit(False)).alias("preserved"))


@query("semantic_similarity")
def semantic_similarity(spark, d):
    p = _pairs(spark, d).select("o_orderkey", quality.semantic("text", "optimized").alias("s"))
    return p.select("o_orderkey", *[F.round(f"s.{k.split()[0]}", 6).alias(k.split()[0]) for k in quality.SEMANTIC.split(", ")])


@query("compare_outputs")
def compare_outputs(spark, d):
    tail = F.concat(F.lit('", "final_score": '), (F.col("o_orderkey") % 90 / 10.0).cast("string"), F.lit(', "shortlist_decision": "Hold"}'))
    p = _pairs(spark, d).select("o_orderkey", F.concat(F.lit('{"reasons": "'), "text", tail).alias("baseline"), F.concat(F.lit('{"reasons": "'), "optimized", tail).alias("optimized"))
    return quality.compare(p, "o_orderkey", "baseline", "optimized")


# -- governance -----------------------------------------------------------------------------------------------------


def agent_outputs(spark, d) -> DataFrame:
    """Final-decision outputs derived from events: enum synonyms, unit scores, delimited lists, missing fields, fences, Python literals, prose."""
    i, k = F.col("event_id"), F.get_json_object("props", "$.k")
    said = F.array(*[F.lit(x) for x in ("yes", "reject", "borderline", "do not shortlist this one", "unclear")])[i % 5]
    fields = [
        F.concat(F.lit('"decision": "'), said, F.lit('"')),
        F.concat(F.lit('"hireability_label": "'), F.array(*[F.lit(x) for x in ("good", "poor", "very strong")])[i % 3], F.lit('"')),
        F.concat(F.lit('"risks": "gap '), k, F.lit('; risk '), k, F.lit('"')),
        F.lit('"reasons": ["solid work", "clear plan"]'),
        F.when(i % 7 != 0, F.lit('"interview_focus_areas": "design"')),
        F.lit('"next_step": "interview"'),
        F.concat(F.lit('"score": '), (i % 101 / 100.0).cast("string")),
        F.lit('"missing_evidence": "none"'),
    ]
    body = F.concat(F.lit("{"), F.concat_ws(", ", *fields), F.lit("}"))
    raw = F.when(i % 11 == 3, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(i % 13 == 5, F.lit("- no\n- json here")).when(i % 17 == 4, F.replace(body, F.lit('"'), F.lit("'"))).otherwise(body)
    return spread_rows(table(spark, d, "events").select("event_id", "props")).select("event_id", F.lit("RecruiterDecisionAgent").alias("agent"), raw.alias("raw_output"))


_GOV_SQL = """WITH e AS (SELECT event_id, event_id % 5 AS s, event_id % 11 = 3 AS fence, event_id % 13 = 5 AND event_id % 11 <> 3 AS prose, event_id % 7 = 0 AS gap, event_id % 101 AS p FROM events),
g AS (SELECT *, CASE WHEN prose THEN 'HOLD' WHEN s IN (0, 3) THEN 'SHORTLIST' WHEN s = 1 THEN 'REJECT' ELSE 'HOLD' END AS decision,
 CASE WHEN prose THEN 0 ELSE CAST(round_even(CASE WHEN p <= 100 THEN p / 100.0 * 100 ELSE 100 END, 0) AS INT) END AS fit FROM e)"""


@query("contract_normalize", f"""{_GOV_SQL} SELECT event_id, decision, CAST(fit AS BIGINT) AS fit, NOT (prose OR gap) AS valid, CAST(CASE WHEN prose THEN 10 WHEN gap THEN 2 ELSE 0 END AS BIGINT) AS n_errors FROM g""")
def contract_normalize(spark, d):
    g = governed.govern(agent_outputs(spark, d), "event_id")
    return g.select("event_id", F.get_json_object("normalized", "$.shortlist_decision").alias("decision"), F.get_json_object("normalized", "$.fit_score").cast("long").alias("fit"), "valid", F.size("errors").cast("long").alias("n_errors"))


@query("schema_quality", f"""{_GOV_SQL} SELECT event_id, round(CASE WHEN prose THEN greatest(0.0, 0.6 + 0.4 * 4 / 8 - 0.5) WHEN gap THEN 0.6 + 0.4 * 6 / 8 - 0.1 ELSE 0.6 + 0.4 * 7 / 8 END, 4) AS quality FROM g""")
def schema_quality(spark, d):
    return governed.govern(agent_outputs(spark, d), "event_id").select("event_id", "quality")


_RAW_SQL = r"""raws AS (SELECT event_id, '{' || '"decision": "' || (['yes', 'reject', 'borderline', 'do not shortlist this one', 'unclear'])[CAST(event_id % 5 AS INT) + 1] || '", "hireability_label": "' || (['good', 'poor', 'very strong'])[CAST(event_id % 3 AS INT) + 1]
 || '", "risks": "gap ' || k || '; risk ' || k || '", "reasons": ["solid work", "clear plan"], ' || CASE WHEN event_id % 7 <> 0 THEN '"interview_focus_areas": "design", ' ELSE '' END || '"next_step": "interview", "score": ' || CAST(event_id % 101 / 100.0 AS DOUBLE) || ', "missing_evidence": "none"}' AS body, k
 FROM (SELECT event_id, json_extract_string(props, '$.k') AS k FROM events)),
outs AS (SELECT event_id, k, CASE WHEN event_id % 11 = 3 THEN '```json' || chr(10) || body || chr(10) || '```' WHEN event_id % 13 = 5 THEN '- no' || chr(10) || '- json here' WHEN event_id % 17 = 4 THEN replace(body, '"', '''') ELSE body END AS raw,
 CASE WHEN event_id % 11 = 3 THEN 'json' WHEN event_id % 13 = 5 THEN 'prose' WHEN event_id % 17 = 4 THEN 'literal' ELSE 'json' END AS form FROM raws)""".replace("\\'\\'", "''")
_FIELDS = [n for n, _ in L.CONTRACTS["RecruiterDecisionAgent"][0]]


@query(
    "govern_outputs",
    f"""{_GOV_SQL}, {_RAW_SQL}, j AS (SELECT g.*, outs.k, outs.form, CAST(p / 100.0 AS DOUBLE) AS n, event_id % 3 AS h FROM g JOIN outs USING (event_id)),
t AS (SELECT *, (['STRONG', 'WEAK', 'HIGHLY_HIREABLE'])[CAST(h AS INT) + 1] AS label, (['good', 'poor', 'very strong'])[CAST(h AS INT) + 1] AS said FROM j)
SELECT event_id, CASE WHEN form = 'prose' THEN '{{"shortlist_decision":"HOLD","hireability_label":"MODERATE","risks":[],"reasons":[],"interview_focus_areas":[],"next_step":"MANUAL_REVIEW","fit_score":0,"missing_evidence":[],"_extra":{{"items":["no","json here"]}}}}'
 ELSE '{{"shortlist_decision":"' || decision || '","hireability_label":"' || label || '","risks":["gap ' || k || '","risk ' || k || '"],"reasons":["solid work","clear plan"],"interview_focus_areas":' || CASE WHEN gap THEN '[]' ELSE '["design"]' END || ',"next_step":"SCHEDULE_TECHNICAL_INTERVIEW","fit_score":' || fit || ',"missing_evidence":[]}}' END AS normalized,
 NOT (form = 'prose' OR gap) AS valid, true AS repaired,
 CASE WHEN form = 'prose' THEN '{"|".join(f"missing_required_field:{n}" + (f"|empty_required_field:{n}" if n in ("reasons", "interview_focus_areas") else "") for n in _FIELDS)}' WHEN gap THEN 'missing_required_field:interview_focus_areas|empty_required_field:interview_focus_areas' ELSE '' END AS errors,
 CASE form WHEN 'prose' THEN 'json_parse_failed:JSONDecodeError|literal_eval_failed:SyntaxError|fallback_line_extraction_used' WHEN 'literal' THEN 'json_parse_failed:JSONDecodeError|parsed_with_ast_literal_eval' ELSE '' END AS warnings,
 CASE WHEN form = 'prose' THEN '{"|".join(f"insert_missing_field:{n}|" + {"shortlist_decision": "default_enum:shortlist_decision->HOLD", "hireability_label": "default_enum:hireability_label->MODERATE", "next_step": "default_enum:next_step->MANUAL_REVIEW", "fit_score": "default_fit_score:0"}.get(n, f"coerce_list:{n}") for n in _FIELDS)}'
 ELSE 'alias:decision->shortlist_decision|alias:score->fit_score|' || (['normalize_enum:shortlist_decision:yes->SHORTLIST|', '', 'normalize_enum:shortlist_decision:borderline->HOLD|', 'normalize_enum_fuzzy:shortlist_decision:do not shortlist this one->SHORTLIST|', 'default_enum:shortlist_decision->HOLD|'])[CAST(s AS INT) + 1]
 || 'normalize_enum:hireability_label:' || said || '->' || label || '|coerce_list:risks|' || CASE WHEN gap THEN 'insert_missing_field:interview_focus_areas|' ELSE '' END || 'coerce_list:interview_focus_areas|normalize_enum:next_step:interview->SCHEDULE_TECHNICAL_INTERVIEW|scale_score_0_1_to_100:' || n || '|coerce_list:missing_evidence' END AS actions,
 round(CASE WHEN prose THEN 0.3 WHEN gap THEN 0.6 + 0.4 * 6 / 8 - 0.1 ELSE 0.6 + 0.4 * 7 / 8 END, 4) AS quality FROM t""",
)
def govern_outputs(spark, d):
    g = governed.govern(agent_outputs(spark, d), "event_id")
    return g.select("event_id", "normalized", "valid", "repaired", joined(F.col("errors")).alias("errors"), joined(F.col("warnings")).alias("warnings"), joined(F.col("actions")).alias("actions"), "quality")


@query("evidence_consistency", f"""{_GOV_SQL} SELECT event_id, list_sum([CASE WHEN decision = 'SHORTLIST' AND prose THEN 1 ELSE 0 END, CASE WHEN fit <= 40 AND decision = 'SHORTLIST' THEN 1 ELSE 0 END, CASE WHEN (CASE WHEN fit = 1 THEN 100 ELSE fit END) >= 80 AND decision = 'REJECT' THEN 1 ELSE 0 END, CASE WHEN fit = 1 AND decision = 'SHORTLIST' THEN -1 ELSE 0 END]) AS n FROM g""".replace("list_sum([", "CAST(list_sum([").replace("]) AS n", "]) AS BIGINT) AS n"))
def evidence_consistency(spark, d):
    return governed.contradictions(agent_outputs(spark, d), "event_id").select("event_id", F.size("contradictions").cast("long").alias("n"))


def _contract_sql(agent: str) -> str:
    fields, full, _ = L.CONTRACTS[agent]
    lines = [*L.CONTRACT_OPEN, *(f"- {n}: {k}" + (" non-empty" if n in full else "") for n, k in fields), *L.CONTRACT_CLOSE]
    return " || chr(10) || ".join(f"'{x}'" for x in lines)


@query(
    "contract_instruction",
    f"""{_GOV_SQL}, {_RAW_SQL} SELECT event_id, md5({quoted([L.REPAIR_OPEN])} || chr(10) || chr(10) || {_contract_sql("RecruiterDecisionAgent")} || chr(10) || chr(10) || 'MODEL_OUTPUT_TO_REPAIR:' || chr(10) || raw) AS prompt_md5
FROM g JOIN outs USING (event_id) WHERE prose OR gap""",
)
def contract_instruction(spark, d):
    """The prompts that ask again for outputs which fail their contract."""
    raws = agent_outputs(spark, d)
    g = governed.govern(raws, "event_id").where("not valid").select("event_id", "fields")
    return g.join(raws, "event_id").select("event_id", F.md5(governed.repair_text(F.col("raw_output"), F.col("fields"))).alias("prompt_md5"))


_LISTS = ("none", "a; b ;; c", "x", " N/A ", "- one\\n- two", "")


@query("to_list", "SELECT event_id, (['', 'a|b|c', 'x', '', 'one|two', ''])[CAST(event_id % 6 AS INT) + 1] AS items FROM events")
def to_list(spark, d):
    raw = F.array(*[F.lit(x.replace("\\n", "\n")) for x in _LISTS])[F.col("event_id") % 6]
    return table(spark, d, "events").select("event_id", joined(quality.to_list(raw)).alias("items"))


@query("to_number", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN -3.5 WHEN 1 THEN CAST(event_id AS DOUBLE) WHEN 2 THEN NULL ELSE 12.0 END AS number FROM events")
def to_number(spark, d):
    i = F.col("event_id")
    raw = F.when(i % 4 == 0, F.lit("about -3.5 of 7")).when(i % 4 == 1, i.cast("string")).when(i % 4 == 2, F.lit("none")).otherwise(F.lit("12 years"))
    return table(spark, d, "events").select("event_id", quality.to_number(raw).alias("number"))


@query("score_100", "SELECT event_id, CAST(round_even(CASE WHEN v BETWEEN 0 AND 1 THEN v * 100 ELSE least(100, greatest(0, v)) END, 0) AS BIGINT) AS score FROM (SELECT event_id, (event_id % 300) / 2.0 - 20 AS v FROM events)")
def score_100(spark, d):
    return table(spark, d, "events").select("event_id", quality.score_100(F.col("event_id") % 300 / 2.0 - 20).alias("score"))


_ENUM_IN = ("yes", "REJECT", "strong yes", "maybe later", "do not shortlist this person", "?", "not recommended")


@query("enum_normalize", "SELECT event_id, (['SHORTLIST', 'REJECT', 'SHORTLIST', 'HOLD', 'SHORTLIST', 'HOLD', 'REJECT'])[CAST(event_id % 7 AS INT) + 1] AS value FROM events")
def enum_normalize(spark, d):
    raw = F.array(*[F.lit(x) for x in _ENUM_IN])[F.col("event_id") % 7]
    return table(spark, d, "events").select("event_id", quality.enum_value("shortlist_decision", raw).alias("value"))


@query("alias_apply", "SELECT action, count(*) AS n FROM (SELECT unnest(['decision->shortlist_decision', 'score->fit_score']) AS action FROM events WHERE NOT (event_id % 13 = 5 AND event_id % 11 <> 3)) GROUP BY action")
def alias_apply(spark, d):
    """Aliases met in outputs."""
    # outer: for a plain explode Spark adds a filter on the array, which would work out all of it a second time
    a = governed.govern(agent_outputs(spark, d), "event_id").select(F.explode_outer("actions").alias("a")).where("startswith(a, 'alias:')")
    return a.groupBy(F.substring("a", 7, 200).alias("action")).agg(F.count("*").alias("n"))


@query("http_error_class", "SELECT event_id, CASE WHEN c = 401 THEN 'unauthorized' WHEN c = 403 THEN 'forbidden' WHEN c = 404 THEN 'not_found' WHEN c = 429 THEN 'rate_limited' WHEN c >= 500 THEN 'server' ELSE 'other' END AS kind FROM (SELECT event_id, ([401, 403, 404, 429, 500, 503, 400])[CAST(event_id % 7 AS INT) + 1] AS c FROM events)")
def http_error_class(spark, d):
    code = F.array(*[F.lit(x) for x in (401, 403, 404, 429, 500, 503, 400)])[F.col("event_id") % 7]
    return table(spark, d, "events").select("event_id", reports.http_error(code).alias("kind"))


@query("response_repair", """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'fallback' ELSE 'major' END AS severity, CASE WHEN event_id % 5 = 0 THEN 'Hold' ELSE (['Shortlist', 'Reject', 'Hold'])[CAST(event_id % 3 AS INT) + 1] END AS decision FROM events""")
def response_repair(spark, d):
    r = governed.repair(_output(spark, d), "event_id", "raw")
    return r.select("event_id", "severity", F.get_json_object("normalized", "$.shortlist_decision").alias("decision"))


# -- memory and chain ---------------------------------------------------------------------------------------------------


@query("running_context", "SELECT conv_id, turn, md5(coalesce(string_agg(substr(text, 1, 1100), chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '')) AS context_md5 FROM conversations")
def running_context(spark, d):
    return memory.running_context(table(spark, d, "conversations"), "conv_id", "turn", "text").select("conv_id", "turn", F.md5("context").alias("context_md5"))


CONTEXT_BUDGET = 120

_COUNTED = sql("t AS (SELECT conv_id, turn, text, CAST({{c}} AS BIGINT) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS place FROM conversations)", c=f(COUNT))


@query(
    "budget_context",
    f"""WITH {_COUNTED}, a AS (SELECT *, CAST(sum(n) OVER (PARTITION BY conv_id ORDER BY place) - n AS BIGINT) AS begun FROM t),
s AS (SELECT *, min(place) OVER w AS first, begun - min(begun) OVER w AS context_tokens FROM a WINDOW w AS (PARTITION BY conv_id ORDER BY begun RANGE BETWEEN {CONTEXT_BUDGET} PRECEDING AND CURRENT ROW))
SELECT conv_id, turn, CAST(place - first AS BIGINT) AS turns, context_tokens, md5(coalesce((SELECT string_agg(b.text, chr(10) ORDER BY b.place) FROM t b WHERE b.conv_id = s.conv_id AND b.place >= s.first AND b.place < s.place), '')) AS context_md5 FROM s""",
)
def budget_context(spark, d):
    c = table(spark, d, "conversations").withColumn("tokens", T.count_tokens(F.col("text")))
    out = memory.budget_context(c, "conv_id", ["turn"], "text", "tokens", CONTEXT_BUDGET)
    return out.select("conv_id", "turn", (F.col("place") - F.col("first")).cast("long").alias("turns"), "context_tokens", F.md5("context").alias("context_md5"))


@query("last_k_outputs", "SELECT conv_id, turn, md5(coalesce(string_agg(text, '|') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), '')) AS previous_md5 FROM conversations")
def last_k_outputs(spark, d):
    return memory.last_outputs(table(spark, d, "conversations"), "conv_id", "turn", "text").select("conv_id", "turn", F.md5(joined(F.col("previous"))).alias("previous_md5"))


@query("skills", "SELECT o_orderkey, array_to_string(list_filter([" + quoted(L.KNOWN_SKILLS) + f"], lambda x: contains(lower(text), x)), '|') AS known FROM {_EVIDENCE_SQL}")
def skills(spark, d):
    low = F.lower(evidence_text())
    return table(spark, d, "orders").select("o_orderkey", joined(F.filter(F.array(*[F.lit(x) for x in L.KNOWN_SKILLS]), lambda x: F.contains(low, x))).alias("known"))


def _runs(spark, d) -> DataFrame:
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return c.select("conv_id", F.col("t")[0]["text"].alias("profile"), F.coalesce(F.get("t", F.lit(1))["text"], F.lit("")).alias("requirement"), F.transform(F.filter("t", lambda x, i: i >= 2), lambda x: x.text).alias("evidence"))


@query("top_sentences")
def top_sentences(spark, d):
    t = memory.top_sentences(F.col("text"), F.array(F.lit("the"), F.lit("for")), 3)
    return table(spark, d, "benchmark").select("item_id", joined(t).alias("sentences"))


@query("compact_memory")
def compact_memory(spark, d):
    return memory.compact_memory(_runs(spark, d)).select("conv_id", memory.memory_text(F.col("memory")).alias("block"))


@query("route_context")
def route_context(spark, d):
    m = memory.compact_memory(_runs(spark, d)).withColumn("agent", F.explode(F.array(*[F.lit(a) for a in L.CONTRACTS])))
    routed = memory.route(F.col("agent"), memory.memory_text(F.col("memory")), F.col("profile"), F.col("requirement"), F.col("evidence"), F.col("evidence"))
    return m.select("conv_id", "agent", F.size(routed).cast("long").alias("texts"), F.length(joined(routed)).cast("long").alias("chars"))


@query("memory_stats")
def memory_stats(spark, d):
    m = memory.compact_memory(_runs(spark, d))
    raw = T.count_tokens(F.array_join(F.concat(F.array("profile", "requirement"), F.col("evidence")), "\n"))
    m = m.select("conv_id", raw.alias("raw_tokens"), T.count_tokens(memory.memory_text(F.col("memory"))).alias("compact_tokens"))
    saved = F.col("raw_tokens") - F.col("compact_tokens")
    return m.select("*", F.greatest(F.lit(0), saved).cast("long").alias("saved"), F.round(F.coalesce(F.try_divide(saved * 100.0, F.col("raw_tokens")), F.lit(0.0)), 4).alias("reduction_pct"))


@query("run_report", """SELECT l_suppkey AS run_id, count(*) AS calls, CAST(sum(l_quantity) AS DOUBLE) AS tokens, round(sum(l_quantity) / 1e6 * 0.59, 8) AS cost, count(*) FILTER (WHERE l_returnflag = 'A') AS accepted, count(*) FILTER (WHERE l_returnflag = 'R') AS rolled_back,
round(avg(l_discount), 4) AS avg_retention, min(l_discount) AS worst_retention FROM lineitem GROUP BY l_suppkey""")
def run_report(spark, d):
    calls = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("run_id"), F.col("l_quantity").alias("tokens"), (F.col("l_quantity") / 1e6 * 0.59).alias("cost"), F.when(F.col("l_returnflag") == "A", "accepted").when(F.col("l_returnflag") == "R", "rolled_back").alias("status"), F.col("l_discount").alias("retention"))
    return reports.run_report(calls)


@query("run_totals", """SELECT l_suppkey AS run_id, count(*) AS calls, CAST(sum(l_quantity) + sum(CASE WHEN l_orderkey % 9 = 0 THEN 5 ELSE 0 END) AS DOUBLE) AS tokens, round(sum(l_quantity) / 1e6 * 0.59, 8) AS cost, CAST(0 AS DOUBLE) AS savings, CAST(sum(l_orderkey % 50) AS BIGINT) AS tokens_saved,
round(avg(l_discount), 4) AS avg_retention, min(l_discount) AS worst_retention, count(*) FILTER (WHERE l_returnflag = 'A') AS accepted, count(*) FILTER (WHERE l_returnflag = 'R') AS rolled_back, count(*) FILTER (WHERE l_orderkey % 4 = 1) AS high_risk,
count(*) FILTER (WHERE l_orderkey % 5 <> 0) AS schema_valid, count(*) FILTER (WHERE l_orderkey % 3 = 0) AS schema_repaired, count(*) FILTER (WHERE l_orderkey % 5 = 0) AS schema_invalid, count(*) FILTER (WHERE l_orderkey % 9 = 0) AS retries, count(*) FILTER (WHERE l_orderkey % 18 = 0) AS retry_successes,
count(*) FILTER (WHERE l_orderkey % 7 = 0) AS inconsistent, round(avg(l_tax), 4) AS avg_consistency, CAST(0 AS DOUBLE) AS sleep_seconds FROM lineitem GROUP BY l_suppkey""")
def run_totals(spark, d):
    k = F.col("l_orderkey")
    calls = table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("run_id"),
        F.col("l_quantity").alias("tokens"),
        (F.col("l_quantity") / 1e6 * 0.59).alias("cost"),
        F.when(F.col("l_returnflag") == "A", "accepted").when(F.col("l_returnflag") == "R", "rolled_back").alias("status"),
        F.col("l_discount").alias("retention"),
        F.when(k % 4 == 1, "HIGH").otherwise("LOW").alias("risk"),
        (k % 5 != 0).alias("valid"),
        F.when(k % 3 == 0, True).alias("repaired"),
        (k % 9 == 0).alias("retried"),
        (k % 18 == 0).alias("retry_ok"),
        F.when(k % 9 == 0, 5).otherwise(0).alias("retry_tokens"),
        (k % 7 != 0).alias("consistent"),
        F.col("l_tax").alias("consistency"),
        (k % 50).alias("saved"),
    )
    return reports.run_totals(calls)


_GRAIN_KEYS = ("run_id", "agent", "mode", "status")
_GRAIN_NAME = "coalesce(nullif(concat_ws('+', " + ", ".join(f"CASE WHEN grouping({k}) = 0 THEN '{k}' END" for k in _GRAIN_KEYS) + "), ''), 'all')"


@query(
    "run_grains",
    f"""WITH c AS (SELECT CAST(l_suppkey AS VARCHAR) AS run_id, CASE WHEN l_orderkey % 13 <> 0 THEN 'stage' || l_linenumber END AS agent, l_linestatus AS mode, CASE l_returnflag WHEN 'A' THEN 'accepted' WHEN 'R' THEN 'rolled_back' END AS status, l_returnflag = 'A' AS ok,
 CAST(l_quantity AS BIGINT) AS tokens, l_quantity / 1e6 * 0.59 AS cost, CASE WHEN l_orderkey % 4 <> 0 THEN l_discount END AS retention, l_orderkey % 50 AS saved FROM lineitem)
SELECT {_GRAIN_NAME} AS grain, {", ".join(_GRAIN_KEYS)}, count(*) AS calls, CAST(sum(tokens) AS BIGINT) AS tokens, round(sum(cost), 8) AS cost, round(100.0 * count(*) FILTER (WHERE ok) / count(*), 4) AS accepted_pct,
 round(100.0 * sum(saved) / (sum(tokens) + sum(saved)), 4) AS saved_pct, round(1000.0 * sum(cost) / sum(tokens), 8) AS cost_per_1k, round(coalesce(sum(retention) / nullif(count(retention), 0), 0), 4) AS avg_retention, CAST(coalesce(min(retention), 0) AS DOUBLE) AS worst_retention
FROM c GROUP BY GROUPING SETS ({", ".join("(" + ", ".join(g) + ")" for g in reports.GRAINS)})""",
)
def run_grains(spark, d):
    k = F.col("l_orderkey")
    calls = table(spark, d, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("run_id"),
        F.when(k % 13 != 0, F.concat(F.lit("stage"), F.col("l_linenumber").cast("string"))).alias("agent"),
        F.col("l_linestatus").alias("mode"),
        F.when(F.col("l_returnflag") == "A", "accepted").when(F.col("l_returnflag") == "R", "rolled_back").alias("status"),
        F.col("l_quantity").cast("long").alias("tokens"),
        (F.col("l_quantity") / 1e6 * 0.59).alias("cost"),
        F.when(k % 4 != 0, F.col("l_discount")).alias("retention"),
        (k % 50).alias("saved"),
    )
    return reports.run_grains(calls)


@query("schema_critical", f"{_GOV_SQL} SELECT 'RecruiterDecisionAgent' AS agent, true AS critical, count(*) AS outputs, count(*) FILTER (WHERE prose OR gap) AS invalid FROM g")
def schema_critical(spark, d):
    """Outputs by agent, whether its contract has fields that may not be empty, and how many fail."""
    g = governed.validity(agent_outputs(spark, d), "event_id")
    return g.groupBy("agent").agg(F.bool_or(F.exists("fields", lambda f: f.non_empty)).alias("critical"), F.count("*").alias("outputs"), F.count_if(~F.col("valid")).alias("invalid"))


@query("entropy_filter", "WITH w AS (SELECT item_id, lower(unnest(regexp_extract_all(text, '[A-Za-z0-9_.$%/-]+'))) AS w FROM benchmark), c AS (SELECT item_id, w, count(*) AS n FROM w GROUP BY ALL), p AS (SELECT item_id, n / sum(n) OVER (PARTITION BY item_id) AS p FROM c), e AS (SELECT item_id, abs(round(sum(p * log2(p)), 6)) AS e FROM p GROUP BY item_id) SELECT b.item_id, md5(b.text) AS text_md5, coalesce(e.e, 0.0) AS entropy, CAST(3 AS DOUBLE) AS least_entropy, false AS changed FROM benchmark b LEFT JOIN e ON e.item_id = b.item_id")
def entropy_filter(spark, d):
    out = relevance.entropy_filter(table(spark, d, "benchmark"), "text", 3.0)
    return out.select("item_id", F.md5("text").alias("text_md5"), F.round("entropy", 6).alias("entropy"), "least_entropy", "changed")


@query("ab_totals", "SELECT o_orderpriority AS variant, CAST(sum(b) AS BIGINT) AS baseline, CAST(sum(o) AS BIGINT) AS optimized, round(CASE WHEN sum(b) = 0 THEN 0 ELSE (1 - sum(o) / sum(b)) * 100 END, 4) AS reduction_pct FROM (SELECT o_orderpriority, o_orderkey % 977 AS b, o_orderkey % 613 AS o FROM orders) GROUP BY o_orderpriority")
def ab_totals(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("variant"), (F.col("o_orderkey") % 977).alias("baseline"), (F.col("o_orderkey") % 613).alias("optimized"))
    return reports.ab_totals(o, "variant")


@query("repair_severity", "SELECT sev AS severity, count(e.event_id) AS n FROM (VALUES ('none'), ('minor'), ('major'), ('fallback')) s(sev) LEFT JOIN (SELECT event_id, (['none', 'minor', 'major'])[CAST(event_id % 3 AS INT) + 1] AS v FROM events) e ON e.v = s.sev GROUP BY sev")
def repair_severity(spark, d):
    e = table(spark, d, "events").select(F.array(*[F.lit(x) for x in ("none", "minor", "major")])[F.col("event_id") % 3].alias("severity"))
    return reports.severity_counts(e)


# -- pacing ------------------------------------------------------------------------------------------------------------------


def _packed_events(spark, d) -> DataFrame:
    """Events of a user with time compressed a thousandfold, so that windows fill."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    base = F.lit(1704067200000000)
    at = F.timestamp_micros((base + F.floor((us - base) / 1000)).cast("long"))
    return table(spark, d, "events").select("event_id", "user_id", at.alias("ts"), (F.col("event_id") % 900 + 1).alias("tokens"))


_PACED_SQL = "(SELECT event_id, user_id, 1704067200000000 + (epoch_us(ts) - 1704067200000000) // 1000 AS us, event_id % 900 + 1 AS tokens FROM events)"


@query("rolling_60s_tokens", f"SELECT event_id, CAST(sum(tokens) OVER w AS BIGINT) AS tokens_60s, CAST(count(*) OVER w AS BIGINT) AS requests_60s FROM {_PACED_SQL} WINDOW w AS (PARTITION BY user_id ORDER BY us RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW)")
def rolling_60s_tokens(spark, d):
    return pacing.rolling(_packed_events(spark, d), "user_id", "ts", "tokens", "event_id").select("event_id", "tokens_60s", "requests_60s")


@query("rpm_violations", f"SELECT user_id, count(*) AS violations FROM (SELECT user_id, count(*) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW) AS n FROM {_PACED_SQL}) WHERE n > 1 GROUP BY user_id")
def rpm_violations(spark, d):
    r = pacing.rolling(_packed_events(spark, d), "user_id", "ts", "tokens", "event_id").where("requests_60s > 1")
    return r.groupBy("user_id").agg(F.count("*").alias("violations"))


@query("fixed_delay", "SELECT conv_id, turn, CAST((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) * 8 AS DOUBLE) AS delay FROM conversations")
def fixed_delay(spark, d):
    return pacing.fixed_delay(table(spark, d, "conversations").select("conv_id", "turn"), "conv_id", "turn", 8.0)


@query("pacer_virtual_sleep")
def pacer_virtual_sleep(spark, d):
    return pacing.pace(_packed_events(spark, d), "user_id", "ts", "tokens", "event_id")


# -- whole requests --------------------------------------------------------------------------------------------------------------


def _requests(spark, d) -> DataFrame:
    """Each benchmark text as a prompt with its ten most similar documents as chunks."""
    best = relevance.top_k(_similar(spark, d).withColumn("similarity", F.round("similarity", 9)), "item_id", "similarity", "doc_id", 10)
    chunks = relevance.with_texts(best, docs(spark, d).select("doc_id", F.col("text").alias("chunk")), "doc_id")
    chunks = chunks.groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("rank", "chunk"))).alias("c"))
    items = table(spark, d, "benchmark").join(chunks, "item_id")
    return items.select("item_id", F.concat(F.lit("Please answer with at least 3 facts. "), "text").alias("prompt"), F.col("text").alias("query"), F.transform("c", lambda x: x.chunk).alias("chunks"))


@query("optimize_requests")
def optimize_requests(spark, d):
    r = O.optimize_requests(_requests(spark, d), "item_id", O.Policy(max_input_tokens=2000))
    return r.withColumns({"selected": F.size("selected").cast("long"), "removed": F.size("removed").cast("long")})


@query("guarded_compress")
def guarded_compress(spark, d):
    """Documents with three phrases of evidence and a quantity each."""
    said = F.concat("text", F.lit("\n"), phrases("doc_id"), F.lit(". Please note "), (F.col("doc_id") % 9).cast("string"), F.lit(" years."))
    c = compress.guarded(docs(spark, d).select("doc_id", said.alias("text")), "doc_id", "text", "Extract strengths and hiring risks.")
    return c.select(
        "doc_id",
        F.md5("optimized").alias("optimized_md5"),
        "tokens_before",
        "tokens_after",
        F.round("reduction_pct", 4).alias("reduction_pct"),
        *[joined(F.col(x)).alias(x) for x in ("preserved", "removed", "protected")],
        "guard_passed",
        F.size("missing").cast("long").alias("n_missing"),
    )


@query("chain_run")
def chain_run(spark, d):
    return reports.run_report(compress.run_chain(_runs(spark, d)))
