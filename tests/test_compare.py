"""Comparison of outputs: evidence against its plain form, equal pairs compared once, an output read once."""

import re

import pytest
from pyspark.sql import functions as F

from lexforge.functions import lexicons as L
from lexforge.functions.kernels import plain
from lexforge.operators import evidence as E
from lexforge.operators import quality as Q

NAMES = [x for o in E.ONTOLOGIES.values() for n, a in o.items() for x in (n, *a)]
TEXTS = [*NAMES, *[f"x{n}" for n in NAMES], *[f"{n}s {m}" for n, m in zip(NAMES, NAMES[1:])], *[f"{n}/{m}, {n}-3" for n, m in zip(NAMES, NAMES[7:])], " ".join(NAMES), "", None, "  ", "llama 3.3-model drift monitoringcv", "Kubernetes\tGAP é sql"]


def _names(text, ontology, own=False):
    return sorted(n for n, a in ontology.items() if re.search(E.pattern((*a, n) if own else a), plain(text or "")))


def _kept(base, text, ontology):
    tokens, met = set(plain(text or "").split(" ")), _names(text, ontology, own=True)
    return [n for n in base if n in met or (own := E._tokens_of(n)) and len(tokens & set(own)) / len(own) >= 0.67]


def test_names_are_those_of_each_pattern(spark):
    rows = list(enumerate(zip(TEXTS, [*TEXTS[5:], *TEXTS[:5]])))
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in rows], "i int, a string, b string")
    bases = {k: F.array(*[F.lit(n) for n in o]) for k, o in E.ONTOLOGIES.items()}
    got = df.select("i", E.ledger(F.col("a")).alias("led"), E.retained_of(bases, F.col("b"), E.ONTOLOGIES).alias("kept")).collect()
    for r in got:
        a, b = rows[r.i][1]
        concerns = _names(a, L.CONCERNS)
        assert r.led.entities == sorted({*_names(a, L.ENTITIES), *[e for c, e in L.CONCERN_ENTITY.items() if c in concerns]}), a
        assert (r.led.concerns, r.led.reasons) == (concerns, _names(a, L.REASONS)), a
        assert all(r.kept[k] == sorted(_kept(o, b, o)) for k, o in E.ONTOLOGIES.items()), b


OUTPUTS = ['{"score": "7", "decision": "yes", "reasons": "sql"}', 'x {"final_score": 7.50, "raw_output": [1.50, {"k": "rag"}]} y', '{"decision": null, "recommendation": "no", "candidate_score": 3}', '{"score": 1, "score": 2}', "Score: 4 decision = 'Hold'", "{}", "", None]


@pytest.mark.parametrize("again, small", [(10**9, 0), (0, 0), (0, Q.SMALL_BYTES)])
def test_compare_in_rows_and_once(spark, monkeypatch, again, small):
    monkeypatch.setattr(Q, "AGAIN", again)
    monkeypatch.setattr(Q, "SMALL_BYTES", small)
    pairs = [(a, b) for a in OUTPUTS for b in OUTPUTS] * 2
    out = Q.compare(spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "k int, b string, a string"), "k", "b", "a")
    got = {r.k: r for r in out.collect()}
    assert out.columns[0] == "k" and sorted(got) == list(range(128)) and all(got[i][1:] == got[i + 64][1:] for i in range(64))
    alone = spark.createDataFrame([(x,) for x in OUTPUTS], "t string").select(Q.score(F.col("t")).alias("s"), Q.extracted_decision(F.col("t")).alias("d")).collect()
    for i, (p, q) in enumerate((p, q) for p in alone for q in alone):
        assert got[i].decision_preserved == (p.d is not None and p.d == q.d)
        assert got[i].score_delta == (None if p.s is None or q.s is None else round(abs(p.s - q.s), 6))
    assert [got[9 * i].similarity for i in range(8)] == [1.0, 1.0, 1.0, 1.0, 1.0, 0.0, 0.0, None]


def test_equal_pairs_are_compared_once(spark, monkeypatch):
    compared, own = [], Q._compared
    monkeypatch.setattr(Q, "_compared", lambda p: compared.append(p.count()) or own(p))
    rows = spark.range(400).select("id", F.lit("sql").alias("a"), F.format_string("score: %s", F.col("id") % 5).alias("b"))
    assert Q.compare(rows, "id", "a", "b").count() == 400 and Q.compare(rows.where("id < 10"), "id", "a", "b").count() == 10
    assert compared == [5, 10]


def test_an_output_is_read_once(spark):
    plan = Q._compared(spark.createDataFrame([("a", "b")], "a string, b string"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("get_json_object") == 0 and plan.count("json_tuple(") == 2
