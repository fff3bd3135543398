"""The check and the audit of governance alone: the same answers as the whole, from the values they need."""

import json

from lexforge.functions import lexicons as L
from lexforge.operators import governed


def _rows():
    recruiter = {"decision": "yes", "risks": "weak python skills; b\tc", "reasons": ["Weak Python skills", 'say "x"\\n', 3, None, {"a": 1}], "score": 0.2, "missing_evidence": ["must have \"k8s\"", "b", "c"], "next_step": "x"}
    merged = {"decision": "reject", "shortlist_decision": "hold", "score": 95, "fit_score": "90", "risks": ["r"], "Reasons": "a; b", "reasons": ["c"]}
    bodies = [json.dumps(recruiter), json.dumps(merged), "```json\n" + json.dumps(merged) + "\n```", str(recruiter), "- no\n- json } here {", "", None, "{}", "[1, 2]", '{"a": {"b": [1]}, "score": true}', '{"decision": "shortlist", "reasons": [], "score": 99}', "text } {\"decision\": \"Reject\", \"fit_score\": 100} tail"]
    rows = [(a, b) for a in [*L.CONTRACTS, "nobody", None] for b in bodies]
    return [(i, a, b) for i, (a, b) in enumerate(rows)] + [(None, "RecruiterDecisionAgent", "{}")] * 2


def test_parts_equal_the_whole(spark):
    df = spark.createDataFrame(_rows(), "i int, agent string, raw string")
    whole = sorted(governed.govern(df, "i", "agent", "raw").select("i", "valid", "consistent", "consistency", "contradictions").collect(), key=str)
    check = governed.contradictions(df, "i", "agent", "raw").select("i", "consistent", "consistency", "contradictions").collect()
    audit = governed.validity(df, "i", "agent", "raw").select("i", "valid").collect()
    assert sorted(((r.i, r.consistent, r.consistency, r.contradictions) for r in check), key=str) == sorted(((r.i, r.consistent, r.consistency, r.contradictions) for r in whole), key=str)
    assert sorted(map(tuple, audit), key=str) == sorted(((r.i, r.valid) for r in whole), key=str)
    assert {r.valid for r in whole} == {True, False} and len({x for r in whole for x in r.contradictions}) >= 4


def test_parts_of_own_contracts(spark):
    own = governed.contracts(spark, {"A": ((("reasons", "list"), ("n", "number"), ("d", "dict"), ("s", "string")), ("n", "d", "s"), {"why": "reasons"})})
    raws = ['{"why": "a", "n": "x", "d": {}, "s": " "}', '{"reasons": 1, "n": 0, "d": {"a": 1}, "s": "t"}', '{"n": 1}']
    df = spark.createDataFrame([(i, "A", r) for i, r in enumerate(raws)], "i int, agent string, raw string")
    whole = {r.i: (r.valid, r.contradictions) for r in governed.govern(df, "i", "agent", "raw", own).collect()}
    audit = {r.i: r.valid for r in governed.validity(df, "i", "agent", "raw", own).collect()}
    assert audit == {i: v for i, (v, _) in whole.items()} == {0: False, 1: True, 2: False}


def test_check_forms_no_log(spark):
    df = spark.createDataFrame([(1, "RecruiterDecisionAgent", "{}")], "i int, agent string, raw string")
    plan = governed.contradictions(df, "i", "agent", "raw").select("contradictions")._jdf.queryExecution().optimizedPlan().toString()
    assert "insert_missing_field" not in plan and "coerce_list" not in plan
