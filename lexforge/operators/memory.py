"""Compact memory of long context, and what of it each pipeline stage gets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexforge.functions import text as T
from lexforge.functions.lexicons import CONSTRAINT_CUES, KNOWN_SKILLS, SENTENCE_CUES
from lexforge.sources.shared import settle


def _lits(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def skills(c: Column, limit: int = 35) -> Column:
    """Known skills in their order, then keywords longer than 3."""
    low = F.lower(F.coalesce(c, F.lit("")))
    known = F.filter(_lits(KNOWN_SKILLS), lambda x: F.contains(low, x))
    more = F.filter(T.keywords(c, 60), lambda x: F.length(x) > 3)
    return F.slice(F.array_distinct(F.concat(known, more)), 1, limit)


def constraint_sentences(c: Column, limit: int = 20) -> Column:
    cues = _lits(CONSTRAINT_CUES)
    return F.slice(F.filter(T.sentences(c), lambda s: F.exists(cues, lambda x: F.contains(F.lower(s), x))), 1, limit)


def top_sentences(c: Column, terms: Column, limit: int) -> Column:
    """Best sentences by shared terms, numbers, codes and cues; the shorter first on ties, then the earlier."""
    wanted = F.array_distinct(F.transform(terms, F.lower))
    cues = _lits(SENTENCE_CUES)

    def score(s: Column) -> Column:
        shared = F.size(F.array_intersect(F.array_distinct(T.words(s)), wanted))
        cue = F.when(F.exists(cues, lambda x: F.contains(F.lower(s), x)), 3).otherwise(0)
        return shared + 2 * F.least(F.lit(8), F.size(T.numbers(s))) + 2 * F.least(F.lit(4), F.size(T.codes(s))) + cue

    ranked = F.sort_array(F.transform(T.sentences(c), lambda s, i: F.struct((-score(s)).alias("k"), F.length(s).alias("n"), i.alias("i"), s.alias("s"))))
    return F.transform(F.slice(ranked, 1, limit), lambda x: x.s)


def compact_memory(runs: DataFrame, profile: str = "profile", requirement: str = "requirement", evidence: str = "evidence") -> DataFrame:
    """runs with column memory: summaries, skills, numbers, names, constraints and evidence, each bounded; evidence is an array of texts."""
    p, q = F.coalesce(profile, F.lit("")), F.coalesce(requirement, F.lit(""))
    texts = F.coalesce(evidence, F.array().cast("array<string>"))
    whole = F.array_join(F.concat(F.array(p, q), texts), "\n")
    r = runs.withColumns({"_p": skills(p, 25), "_q": skills(q, 30), "_all": whole})
    digest = F.flatten(F.transform(texts, lambda t: top_sentences(t, F.concat("_p", "_q"), 2)))
    memory = F.struct(
        F.substring(F.array_join(top_sentences(p, F.concat("_p", _lits(("project", "experience", "skill"))), 5), " | "), 1, 1200).alias("candidate_summary"),
        F.substring(F.array_join(top_sentences(q, F.concat("_q", _lits(("requirement", "must", "experience"))), 5), " | "), 1, 1200).alias("jd_summary"),
        F.col("_p").alias("core_skills"),
        F.col("_q").alias("role_requirements"),
        F.slice(T.numbers(F.col("_all")), 1, 25).alias("numeric_facts"),
        F.slice(F.sort_array(F.array_union(T.entities(F.col("_all")), T.codes(F.col("_all")))), 1, 25).alias("named_entities"),
        constraint_sentences(F.col("_all"), 18).alias("safety_constraints"),
        F.slice(digest, 1, 12).alias("evidence_digest"),
    )
    return r.withColumn("memory", memory).drop("_p", "_q", "_all")


#: field, separator and most entries of a rendered memory
_LINES = (("core_skills", ", ", 35), ("role_requirements", ", ", 35), ("numeric_facts", ", ", 25), ("named_entities", ", ", 25), ("safety_constraints", "; ", 20), ("evidence_digest", "; ", 20))


def memory_text(m: Column) -> Column:
    parts = [F.lit("[COMPACT_MEMORY]\ncandidate_summary: "), m.candidate_summary, F.lit("\njd_summary: "), m.jd_summary, F.lit("\n")]
    for name, sep, most in _LINES:
        parts += [F.lit(f"{name}: "), F.array_join(F.slice(m[name], 1, most), sep), F.lit("\n")]
    return F.concat(*parts)


def route(agent: Column, memory: Column, profile: Column, requirement: Column, evidence: Column, previous: Column) -> Column:
    """Texts that an agent's stage is given: the memory and, by agent, raw text or the last outputs."""
    last = lambda n: F.when(F.size(previous) > n, F.slice(previous, -n, n)).otherwise(previous)
    base = F.array(memory)
    return (
        F.when(agent == "ResumeIntelligenceAgent", F.concat(base, F.array(F.concat(F.lit("[RAW_CANDIDATE_PROFILE]\n"), F.substring(profile, 1, 4500))), F.slice(evidence, 1, 2)))
        .when(agent == "JDRequirementAgent", F.concat(base, F.array(F.concat(F.lit("[RAW_JOB_DESCRIPTION]\n"), F.substring(requirement, 1, 4500)))))
        .when(agent == "RecruiterDecisionAgent", F.concat(base, last(4)))
        .otherwise(F.concat(base, last(2)))
    )


def running_context(turns: DataFrame, run: str, order: str, text: str, most: int = 1100) -> DataFrame:
    """turns with context: the first most characters of each earlier turn of the run, in order, joined by newlines."""
    w = Window.partitionBy(run).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return turns.withColumn("context", F.array_join(F.collect_list(F.substring(text, 1, most)).over(w), "\n"))


def context_spans(turns: DataFrame, run: str, order: Sequence[str], tokens: str, budget: int) -> DataFrame:
    """turns with place, first and context_tokens: the context of a turn is the latest earlier turns that fit the budget.

    place counts a run's turns from 1 by the columns of order, nulls first; the context is the turns first .. place - 1
    (none where first = place), whose tokens sum to context_tokens <= budget. Running sums say where each turn starts,
    and a range frame over them finds the first turn that starts no more than budget before; no text moves. A null or
    negative count of tokens is 0; turns alike in order are told apart by their tokens only, so order should be
    unique in a run. A null run is a run. A run is one sorted sequence in one task.
    """
    w = Window.partitionBy(run).orderBy(*[F.asc_nulls_first(c) for c in order], "_n")
    t = turns.withColumn("_n", F.greatest(F.coalesce(F.col(tokens), F.lit(0)), F.lit(0)).cast("long"))
    t = t.withColumns({"place": F.row_number().over(w), "_at": F.sum("_n").over(w) - F.col("_n")})
    back = Window.partitionBy(run).orderBy("_at").rangeBetween(-budget, Window.currentRow)
    t = t.withColumns({"first": F.min("place").over(back), "context_tokens": F.col("_at") - F.min("_at").over(back)})
    return t.drop("_n", "_at")


def budget_context(turns: DataFrame, run: str, order: Sequence[str], text: str, tokens: str, budget: int) -> DataFrame:
    """turns with place, first, context_tokens and context: the texts of context_spans, in order, joined by newlines.

    Each span names its turns by place, and texts are joined to them once at the end: what is shuffled is the turns and
    the contexts themselves, at most budget tokens a turn (turns without tokens come on top). Null texts are left out.
    """
    names = [f"`{c}`" for c in turns.columns]
    spans = settle(context_spans(turns, run, order, tokens, budget))
    asked = spans.where("first < place").select(F.col(run).alias("_r"), F.col("place").alias("_p"), F.explode(F.sequence("first", F.col("place") - 1)).alias("_q"))
    texts = spans.select(F.col(run).alias("_s"), F.col("place").alias("_t"), F.col(text).alias("_text"))
    got = asked.join(texts, F.col("_r").eqNullSafe(F.col("_s")) & (F.col("_q") == F.col("_t")))
    got = got.groupBy("_r", "_p").agg(F.sort_array(F.collect_list(F.struct("_q", "_text"))).alias("_c"))
    got = got.select("_r", "_p", F.array_join(F.transform("_c", lambda x: x["_text"]), "\n").alias("context"))
    out = spans.join(got, F.col(run).eqNullSafe(F.col("_r")) & (F.col("place") == F.col("_p")), "left")
    return out.select(*names, "place", "first", "context_tokens", F.coalesce("context", F.lit("")).alias("context"))


def last_outputs(turns: DataFrame, run: str, order: str, text: str, k: int = 2) -> DataFrame:
    """turns with previous: the k outputs before each."""
    w = Window.partitionBy(run).orderBy(order).rowsBetween(-k, -1)
    return turns.withColumn("previous", F.collect_list(text).over(w))
