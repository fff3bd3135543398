"""Ontology joins, reports at several grains and contexts within a budget against brute force."""

import re

import pytest
from pyspark.sql import functions as F

from lexforge.functions.kernels import plain
from lexforge.operators import evidence, memory, ontology, reports

NAMES = {"x": {"gcp": ("google cloud", "google cloud platform"), "net": (".net",), "cpp": ("c++",), "bare": ("cloud",)}, "y": {"ci": ("ci/cd", "ci cd"), "also": ("google cloud",)}}
TEXTS = ["Google  Cloud Platform, really", "the google cloud", "asp.net and .net", "a.net", "c++", "c+++ c++x", "xc++ y", "CI CD now", "cloudy", "", None, "!!", ".net", "c++, google-cloud"]


def _brute(text):
    t = plain(text or "")
    return {(c, n) for c, names in NAMES.items() for n, a in names.items() if re.search(evidence.pattern(a), t)}


@pytest.mark.parametrize("small", [ontology.SMALL_BYTES, 0])
def test_ontology_matches(spark, monkeypatch, small):
    monkeypatch.setattr(ontology, "SMALL_BYTES", small)
    texts = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string").withColumns({"key": F.lit(1), "name": F.lit("n")})
    got = {}
    for r in ontology.matches(texts, "id", "text", ontology.ontology(spark, NAMES)).collect():
        got.setdefault(r.id, set()).add((r.category, r.name))
    assert got == {i: b for i, t in enumerate(TEXTS) if (b := _brute(t))}


def test_ontology_longest_and_empty(spark):
    texts = spark.createDataFrame([(1, "google cloud platform"), (2, "google cloud platform, a cloud"), (3, "google cloud")], "id int, text string")
    table = ontology.ontology(spark, {"x": {"long": ("google cloud platform",), "mid": ("google cloud",), "same": ("google cloud",), "bare": ("cloud",)}})
    got = sorted((r.id, r.name) for r in ontology.matches(texts, "id", "text", table, longest=True).collect())
    assert got == [(1, "long"), (2, "bare"), (2, "long"), (3, "mid"), (3, "same")]
    assert ontology.matches(texts, "id", "text", table.limit(0)).collect() == []
    assert ontology.matches(texts.limit(0), "id", "text", table).collect() == []
    out = ontology.ledgers(texts, "id", "text", table.limit(0), spark.createDataFrame([], "concern string, entity string"))
    assert sorted(map(tuple, out.collect())) == [(1, [], [], []), (2, [], [], []), (3, [], [], [])]


def test_ontology_of_many_aliases(spark):
    many = spark.range(100_000).select(F.lit("x").alias("category"), F.concat(F.lit("n"), "id").alias("name"), F.concat_ws(" ", F.lit("term"), F.col("id").cast("string")).alias("alias"))
    texts = spark.range(50).select("id", F.concat(F.lit("see Term "), (F.col("id") * 1999).cast("string"), F.lit(", then")).alias("text"))
    assert {(r.id, r.name) for r in ontology.matches(texts, "id", "text", many).collect()} == {(i, f"n{i * 1999}") for i in range(50)}


def test_grains(spark):
    rows = [("r1", None, "m", "accepted", 10, 0.5, 0.5, 10), ("r1", "a", "m", None, 20, 0.25, None, 0), ("r2", "a", "n", "accepted", None, None, 1.0, None)]
    calls = spark.createDataFrame(rows, "run_id string, agent string, mode string, status string, tokens long, cost double, retention double, saved long")
    got = {(r.grain, r.run_id, r.agent): r for r in reports.run_grains(calls, grains=((), ("run_id",), ("agent",))).collect()}
    assert set(got) == {("all", None, None), ("run_id", "r1", None), ("run_id", "r2", None), ("agent", None, None), ("agent", None, "a")}
    every = got["all", None, None]
    assert (every.calls, every.tokens, every.cost, every.accepted_pct, every.saved_pct, every.cost_per_1k, every.avg_retention, every.worst_retention) == (3, 30, 0.75, 66.6667, 25.0, 25.0, 0.75, 0.5)
    lone = got["run_id", "r2", None]
    assert (lone.saved_pct, lone.cost_per_1k, lone.avg_retention) == (0.0, 0.0, 1.0)
    assert reports.run_grains(calls.limit(0), grains=(("run_id",),)).collect() == []


def test_budget_context(spark):
    rows = [("a", None, 5, "n"), ("a", 1, 4, "one"), ("a", 2, 0, "zero"), ("a", 3, 3, None), ("a", 4, 9, "big"), ("a", 5, 1, "end"), (None, 1, 2, "x"), (None, 2, None, "y")]
    turns = spark.createDataFrame(rows, "run string, turn int, tokens int, text string").withColumn("a.b", F.lit(0))
    for budget in (0, 3, 7, 100):
        got = {(r.run, r.turn): (r.context, r.context_tokens) for r in memory.budget_context(turns, "run", ["turn"], "text", "tokens", budget).collect()}
        for run in ("a", None):
            own = sorted((r for r in rows if r[0] == run), key=lambda r: (r[1] is not None, r[1] or 0))
            for i, r in enumerate(own):
                j, used = i, 0
                while j and used + (own[j - 1][2] or 0) <= budget:
                    j, used = j - 1, used + (own[j - 1][2] or 0)
                assert got[run, r[1]] == ("\n".join(x[3] for x in own[j:i] if x[3] is not None), used)
