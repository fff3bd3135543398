"""Plans over small tables: brute force, goldens worked out by hand, hot groups and odd rows."""

import itertools
import json
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexforge.functions import lexicons as L
from lexforge.functions import text as T
from lexforge.operators import dedup, governed, relevance, retention, selection
from lexforge.plans import compress
from lexforge.plans import optimize as O

# -- selection -----------------------------------------------------------------------------------------------------


def test_knapsack_brute_force(spark):
    rng = random.Random(5)
    cases = [([(rng.randint(0, 30) / 100, rng.randint(0, 12)) for _ in range(rng.randint(0, 9))], rng.randint(-1, 40)) for _ in range(150)]
    cases += [([(0.5, 3), (0.5, 3), (0.5, 3)], 6), ([(0.1, 100)], 5), ([(None, 1), (0.2, None)], 9)]
    df = spark.createDataFrame([(k, items, b) for k, (items, b) in enumerate(cases)], "k long, items array<struct<value:double,cost:long>>, budget long")
    got = {r.k: r.p for r in df.select("k", selection.best_fit(F.col("items"), F.col("budget")).alias("p")).collect()}
    for k, (items, budget) in enumerate(cases):
        value, cost = [round((v or 0) * 10_000) for v, _ in items], [max(1, c or 0) for _, c in items]
        sets = [s for n in range(len(items) + 1) for s in itertools.combinations(range(len(items)), n) if sum(cost[i] for i in s) <= max(0, budget) and all(value[i] > 0 for i in s)]
        best = min(sets, key=lambda s: (-sum(value[i] for i in s), sum(cost[i] for i in s), sum(1 << i for i in s)))
        assert got[k] == list(best), (items, budget)


def test_knapsack_rows_keep_their_columns(spark):
    rows = [(1, 1, 0.5, 3, "a", 5), (1, 0, 0.4, 2, "b", 5), (1, 2, 0.3, 4, "c", 5), (None, 0, 0.1, 9, "d", 5), (2, 0, None, None, None, 5)]
    df = spark.createDataFrame(rows, ["r", "i", "v", "c", "a.b", "budget"])
    got = {(x["r"], x["i"]): x["chosen"] for x in selection.knapsack(df, "r", "i", "v", "c", "budget").collect()}
    assert got == {(1, 0): True, (1, 1): True, (1, 2): False, (None, 0): False, (2, 0): False}
    assert selection.knapsack(df.limit(0), "r", "i", "v", "c", "budget").count() == 0


# -- near-copies within groups ------------------------------------------------------------------------------------------


def _bag(text):
    return Counter(w for w in (x.lower() for x in re.findall(r"[A-Za-z0-9_.$%/-]+", text)) if w not in L.STOPWORDS)


def _cos(a, b):
    return sum(n * b[t] for t, n in a.items()) / math.sqrt(sum(n * n for n in a.values()) * sum(n * n for n in b.values())) if a and b else 0.0


def _kept(texts, near):
    kept = []
    for i in range(len(texts)):
        if not any(near(texts[k], texts[i]) for k in kept):
            kept.append(i)
    return kept


@pytest.mark.parametrize("threshold", [0.5, 0.8, 0.9])
def test_cosine_keep_first_brute_force(spark, threshold):
    rng = random.Random(int(threshold * 100))
    groups = {}
    for g in range(6):
        words = [f"w{rng.randint(0, 9)}" for _ in range(40)]
        groups[g] = [" ".join(rng.choice(words + ["common", "the"]) for _ in range(rng.randint(0, 6))) for _ in range(25)]
        groups[g] += ["common " * 3 + f"x{k}" for k in range(5)] + groups[g][:5]
    u = spark.createDataFrame([(g, i, t) for g, ts in groups.items() for i, t in enumerate(ts)], "g long, pos int, unit string").repartition(3)
    got = {}
    for r in dedup.keep_first(u, dedup.cosine_edges(u, threshold)).where("kept").collect():
        got.setdefault(r.g, []).append(r.pos)
    for g, ts in groups.items():
        assert sorted(got[g]) == _kept(ts, lambda a, b: _cos(_bag(a), _bag(b)) >= threshold)


def test_lexical_keep_first_brute_force(spark):
    rng = random.Random(3)
    base = [f"t{k}" for k in range(30)]
    texts = []
    for _ in range(60):
        x = list(base[: rng.randint(8, 20)])
        for _ in range(rng.randint(0, 2)):
            x[rng.randrange(len(x))] = rng.choice(["no", "zz", "q1", "q2"])
        texts.append(" ".join(x))
    texts += ["", "!!", "!!"]
    u = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "g long, pos int, unit string")

    def near(a, b):
        x, y = (set(re.findall(r"[a-zA-Z0-9_+#.-]+", t.lower())) for t in (a, b))
        neg = [any(p in t.lower() for p in L.POLARITY_TERMS) for t in (a, b)]
        return bool(x and y) and neg[0] == neg[1] and len(x & y) / len(x | y) > 0.88

    got = sorted(r.pos for r in dedup.keep_first(u, dedup.lexical_edges(u, 0.88)).where("kept").collect())
    assert got == _kept(texts, near)


def test_one_common_word_forms_no_pairs(spark):
    """A word that every unit of a large group has is in no prefix, so candidates don't grow with the square of the group."""
    n = 3000
    u = spark.range(n).select(F.lit(1).alias("g"), F.col("id").cast("int").alias("pos"), F.concat(F.lit("common alpha"), F.col("id"), F.lit(" beta"), F.col("id"), F.lit(" gamma"), F.col("id") % 1500).alias("unit"))
    assert dedup.cosine_edges(u, 0.9).count() == 0
    copies = spark.range(n).select(F.lit(1).alias("g"), F.col("id").cast("int").alias("pos"), F.lit("the very same sentence").alias("unit"))
    edges = dedup.cosine_edges(copies, 0.9)
    assert edges.count() == n - 1 and dedup.keep_first(copies, edges).where("kept").count() == 1


# -- relevance -----------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("kw", [{}, {"k": 3}, {"least": 0.3}, {"k": 2, "least": 0.2}, {"k": 500}])
def test_relevance_bounds_lose_nothing(spark, kw):
    """Whatever the bounds cut, all pairs from least on and the best k of each query with their ties stay, and what is returned is exact."""
    rng = random.Random(7)
    word = lambda: f"w{min(rng.randint(0, 30), rng.randint(0, 30))}"
    texts = {i: " ".join(word() for _ in range(rng.choice([1, 3, 10, 60]))) for i in range(120)} | {120: "", 121: None, 122: "the of"}
    queries = {i: " ".join(word() for _ in range(rng.randint(1, 6))) for i in range(15)} | {15: None, 16: "zzz"}
    q = spark.createDataFrame(list(queries.items()), "q long, text string")
    d = spark.createDataFrame(list(texts.items()), "d long, text string").withColumn("token", F.lit("x")).repartition(3)
    got = {(r.q, r.d): r.similarity for r in relevance.relevance(q, d, "q", "d", **kw).collect()}
    want = {(i, j): s for i, x in queries.items() for j, y in texts.items() if (s := _cos(_bag(x or ""), _bag(y or ""))) > 0}
    assert all(abs(want[p] - s) < 1e-12 for p, s in got.items())
    for i in queries:
        mine = sorted((s for p, s in want.items() if p[0] == i), reverse=True)
        floor = mine[kw["k"] - 1] if 0 < kw.get("k", 0) <= len(mine) else 0.0
        must = {p for p, s in want.items() if p[0] == i and s >= max(floor, kw.get("least", 0.0))}
        assert must <= set(got)
    if not kw:
        assert set(got) == set(want)


def test_relevance_verifies_few_pairs(spark):
    """A word that all texts have can't carry a pair over the threshold by itself, and forms none."""
    d = spark.range(2000).select("id", F.concat(F.lit("common "), *[F.concat(F.lit(f"a{k}x"), F.col("id"), F.lit(" ")) for k in range(8)]).alias("text"))
    q = spark.createDataFrame([(1, "common a0x5 a1x5 a2x5 a3x5"), (2, "common b c d")], "q long, text string")
    p, t = relevance.postings(q, "q", "text"), relevance.postings(d, "id", "text")
    p = p.select(F.col("id").alias("q"), "token", F.col("n").alias("qn"), F.col("norm2").alias("qq"))
    t = t.withColumns({"w": F.col("n") / F.sqrt("norm2"), "block": F.lit(0)})
    assert relevance._candidates(p, t, None, 0.5).collect() == [(1, 5)] and len(t.join(p, "token").select("q", "id").distinct().collect()) == 4000


# -- governance ------------------------------------------------------------------------------------------------------------------


def _govern(spark, *rows):
    df = spark.createDataFrame([(i, a, r) for i, (a, r) in enumerate(rows)], "i long, agent string, raw string")
    return [r for r in governed.govern(df, "i", "agent", "raw").orderBy("i").collect()]


def test_governance_goldens(spark):
    raw = {"decision": "yes", "hireability_label": "good", "risks": "a; b", "reasons": ["solid"], "interview_focus_areas": ["x"], "next_step": "interview", "score": 0.8, "missing_evidence": "none"}
    fenced, literal, lines = "```json\n" + json.dumps(raw) + "\n```", "{'decision': 'yes', 'risks': None, 'ok': True}", "- one\n- two"
    agent = "RecruiterDecisionAgent"
    a, b, c, d, e, f, g, h = _govern(spark, (agent, json.dumps(raw)), (agent, fenced), (agent, literal), (agent, lines), (agent, None), ("InterviewQuestionAgent", "{}"), ("InterviewQuestionAgent", '{"technical": ["a"], "technical_questions": ["a", "b"]}'), (None, '{"x": 1}'))
    n = json.loads(a.normalized)
    assert n["shortlist_decision"] == "SHORTLIST" and n["fit_score"] == 80 and n["risks"] == ["a", "b"] and n["missing_evidence"] == []
    assert a.valid and a.repaired and a.errors == [] and a.quality == 0.95 and b.normalized == a.normalized and b.warnings == []
    assert c.warnings == ["json_parse_failed:JSONDecodeError", "parsed_with_ast_literal_eval"] and json.loads(c.normalized)["_extra"] == {"ok": True}
    assert json.loads(d.normalized)["_extra"] == {"items": ["one", "two"]} and d.warnings[-1] == "fallback_line_extraction_used"
    assert e.warnings == ["empty_output"] and not e.valid
    assert f.quality == 0.1
    assert json.loads(g.normalized)["technical_questions"] == ["a", "b"]
    assert h.quality == 1.0 and json.loads(h.normalized) == {"_extra": {"x": 1}} and h.valid


def test_consistency_rules(spark):
    raw = {"decision": "SHORTLIST", "score": 30, "missing_evidence": ["mandatory check"], "risks": ["weak python skills shown"], "reasons": ["python skills shown weak"]}
    high = {"decision": "reject", "score": 90, "missing_evidence": ["a", "b", "c"], "reasons": ["q"]}
    a, b, c = _govern(spark, ("RecruiterDecisionAgent", json.dumps(raw)), ("RecruiterDecisionAgent", json.dumps(high)), ("RecruiterDecisionAgent", '{"decision": "HOLD", "reasons": ["a"], "score": 60}'))
    assert not a.consistent and a.consistency == 0.55
    assert a.contradictions == ["shortlist_with_missing_mandatory_evidence", "risk_reason_overlap:weak python skills shown", "low_score_with_shortlist_decision"]
    assert b.contradictions == ["high_score_with_many_missing_evidence_items", "high_score_with_reject_decision"]
    assert (c.consistent, c.consistency, c.contradictions) == (True, 1.0, [])


def test_own_contracts(spark):
    own = governed.contracts(spark, {"A": ((("n", "number"), ("d", "dict"), ("s", "string")), ("s",), {"num": "n"})})
    df = spark.createDataFrame([(1, "A", '{"num": "7 years", "d": [1], "s": ["x", 2]}'), (2, "B", "{}")], "i long, agent string, raw string")
    a, b = governed.govern(df, "i", "agent", "raw", own).orderBy("i").collect()
    assert json.loads(a.normalized) == {"n": 7.0, "d": {}, "s": "x; 2"} and a.actions == ["alias:num->n", "coerce_number:n", "coerce_dict:d", "coerce_string:s"]
    assert b.valid and governed.govern(df.limit(0), "i", "agent", "raw").count() == 0


def test_response_repair(spark):
    full = {"final_score": 7.0, "shortlist_decision": "Hold", "evidence_terms": [], "reasons": ["a"], "concerns": [], "interview_plan": []}
    raws = [json.dumps(full), json.dumps(full | {"shortlist_decision": "hold", "reasons": [" a "]}), 'x {"score": "7/10", "risks": null} y', "Score: 8 / 10, decision: 'Reject'.", '{"final_score": "8", "decision": "yes", "extra": {"k": 1}, "questions": "q"}']
    got = [(json.loads(r.normalized), r.severity) for r in governed.repair(spark.createDataFrame(list(enumerate(raws)), "i long, raw string"), "i", "raw").orderBy("i").collect()]
    assert got[0] == (full | {"schema_valid": True}, "none") and got[1] == (full | {"schema_valid": True}, "minor")
    assert got[2] == ({**full, "shortlist_decision": "N/A", "reasons": [], "schema_valid": True}, "major")
    assert got[3][1] == "fallback" and got[3][0]["final_score"] == 8.0 and got[3][0]["shortlist_decision"] == "Reject"
    assert got[4][1] == "major" and got[4][0]["interview_plan"] == ["q"] and got[4][0]["extra"] == {"k": 1} and got[4][0]["shortlist_decision"] == "Shortlist"


# -- whole requests ----------------------------------------------------------------------------------------------------------------


def test_optimizer_goldens(spark):
    chunks = ["Alpha service must keep 3 replicas in region X9.", "Alpha service must keep 3 replicas in region X9.", "Unrelated cooking recipe with onions.", None]
    rows = [(m, "Please tell about alpha service replicas. Please tell about alpha service replicas.", "alpha service replicas", chunks, m) for m in ("conservative", "balanced", "aggressive")]
    rows += [("none", None, None, None, None), ("tight", "One fact here. " * 3 + "Two facts there.", "", ["fact one here"], "balanced")]
    df = spark.createDataFrame(rows, "k string, prompt string, query string, chunks array<string>, mode string")
    got = {r.k: r for r in O.optimize_requests(df, "k", O.Policy(max_input_tokens=120)).collect()}
    for m in ("conservative", "balanced", "aggressive"):
        r = got[m]
        assert r.tokens_saved >= 0 and 0 <= r.retention <= 1 and r.risk in ("LOW", "MEDIUM", "HIGH", "ROLLED_BACK")
        assert (r.status == "rolled_back") == (r.optimized_prompt == r.original_prompt and r.reason is not None)
        assert set(r.selected) | set(r.removed) >= set(chunks[:3]) and r.selected[0] == chunks[0]
        assert r.optimized_prompt.count("tell about alpha") == (2 if r.status == "rolled_back" else 1)
    assert got["none"].original_prompt == "" and got["none"].retention == 0.8 and got["none"].status == "rolled_back"
    small = O.optimize_requests(df.where("k = 'tight'"), "k", O.Policy(max_input_tokens=14, rollback=False, deduplicate=False, protected=("Keep 5.",))).first()
    assert "Keep 5." in small.optimized_prompt and "Two facts there." in small.removed


def test_rescue_puts_back_what_tells_most(spark):
    chunks = ["Must not exceed 30% for AB-12 unless Board agrees.", "weather is fine today again"]
    df = spark.createDataFrame([(1, "sum up", "unrelated words", chunks)], "k long, prompt string, query string, chunks array<string>")
    r = O.optimize_requests(df, "k", O.Policy(max_input_tokens=500, relevance=0.5, min_retention=0.99)).first()
    assert r.selected[0] == chunks[0] and r.removed == chunks


def test_retention_goldens(spark):
    texts = [("Alpha must keep 3 replicas", "Alpha must keep 3 replicas"), ("Keep Keep the word 30%", ""), ("", "x"), (None, None), ("must", "")]
    got = {r.i: r for r in retention.scores(spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(texts)], "i long, a string, b string"), "i", "a", "b").collect()}
    assert got[0].retention == pytest.approx(1.0) and got[1].numeric == 0.0 and got[1].semantic == 0.0 and got[2].retention == got[3].retention == pytest.approx(0.8)
    assert got[4].constraint == pytest.approx(0.85)  # an atom without terms and numbers is met by its terms, not by its group
    one = spark.createDataFrame([("You must not deploy service alpha before review. You must not deploy service alpha before review.",)], "t string").select(T.constraint_atoms(F.col("t")).alias("a")).first().a
    assert one[0].group == "negation" and len({(a.group, tuple(a.terms[:6]), tuple(a.numbers)) for a in one}) == len(one)


def test_chain_facts(spark):
    def model(agent, prompt):
        if agent == "JDRequirementAgent":
            raise ValueError("down")
        return compress.mock_model(agent, prompt) if "MODEL_OUTPUT_TO_REPAIR" in prompt or agent != "SkillGapReadinessAgent" else "{}"

    runs = spark.createDataFrame([(1, "Python engineer with 5 years.", "Must know sql.", ["Built X9."]), (2, None, None, None)], "conv_id long, profile string, requirement string, evidence array<string>")
    rows = compress.run_chain(runs, model).collect()
    by = {(r.run_id, r.agent): r for r in rows}
    assert len(rows) == 12 and {r.turn for r in rows} == set(range(6))
    assert all((r.status == "error") == (r.agent == "JDRequirementAgent") for r in rows) and by[("1", "JDRequirementAgent")].tokens == 0
    assert all(r.valid for r in rows if r.agent != "JDRequirementAgent") and by[("1", "RecruiterDecisionAgent")].tokens > 0
