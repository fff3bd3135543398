"""Expressions are worked out once a row: what a plan names often is bound, and no filter repeats it."""

from pyspark.sql import functions as F

from lexforge.functions import text as T
from lexforge.operators import evidence as E
from lexforge.operators import governed
from lexforge.operators import quality as Q


def _optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_fences_are_taken_off_once(spark):
    assert _optimized(spark.createDataFrame([("a",)], "t string").select(T.json_candidate(F.col("t")))).count("(?:json|JSON)") <= 2
    rows = spark.createDataFrame([('```json\n{"a": 1}\n```',), ("x {1} y } z",), ("} {",), ("none",), ("",), (None,), (" \t{}\x0b",)], "t string")
    assert [r[0] for r in rows.select(T.json_candidate(F.col("t"))).collect()] == ['{"a": 1}', "{1} y }", "} {", "none", "", "", "{}"]


def test_governance_parses_once(spark):
    outputs = spark.createDataFrame([(1, "RecruiterDecisionAgent", "{}")], "output_id long, agent string, raw_output string")
    plan = _optimized(governed.govern(outputs).select("quality"))
    data = plan[plan.index("got#") - 60000 if plan.index("got#") > 60000 else 0 :]
    # the united values are the start of the fold that binds them and stand in no lambda over the contract's fields
    assert data.count("fields#") and "transform(fields" in data
    inner = data[data.index("transform(fields") :].split("\n")[0]
    assert "array_distinct(" not in inner


def test_decision_reads_its_keys_once(spark):
    plan = _optimized(spark.createDataFrame([("a",)], "t string").select(Q.extracted_decision(F.col("t"))))
    assert plan.count("$.shortlist_decision") <= 2


def test_aliases_are_searched_before_their_pattern(spark):
    aliases = ("api integration", "apis", "api")
    texts = ["the api.", "rapid", "apis", "no", "an api integration", "xapi api", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(E.met(F.col("t"), aliases).alias("a"), F.col("t").rlike(E.pattern(aliases)).alias("b")).collect()
    assert [r.a for r in got] == [r.b for r in got] == [True, False, True, False, True, True, False]
