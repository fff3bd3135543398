"""The request optimizer: filler and duplicates out, chunks chosen within a token budget, retention guarded.

A plan over tables of requests, sentences and chunks. Near-copies are found by the prefix-filtered join inside a request; what depends on
its own earlier choices (knapsack, budget trim, rescue) is a fold over a request's few items, in the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexforge.functions import text as T
from lexforge.functions.similarity import bind, counted_cosine, counts, kept
from lexforge.operators import cost, dedup, retention, selection
from lexforge.sources.io import dealt
from lexforge.sources.shared import settle

PROTECTED = "\n\n[SCHEMA_CRITICAL_PROTECTED_INSTRUCTIONS]\n"
CONTEXT = "\n\n[OPTIMIZED_CONTEXT]\n"
#: what a rescued text has to add to the retention
GAIN = 0.002


@dataclass(frozen=True)
class Policy:
    """What a request is held to; thresholds left out come from the mode."""

    mode: str = "balanced"
    max_input_tokens: int = 8000
    min_retention: float | None = None
    duplicate: float | None = None
    relevance: float | None = None
    schema_strict: bool = False
    normalize: bool = True
    deduplicate: bool = True
    knapsack: bool = True
    rollback: bool = True
    expected_output: int = 1000
    protected: Sequence[str] = field(default=())
    critical_terms: Sequence[str] = field(default=())

    def thresholds(self, mode: Column) -> Column:
        """Struct (mode, min_retention, duplicate, relevance) of a request's mode; own values go before the mode's, and a strict schema tightens either."""
        m = F.lower(F.trim(mode))
        plain = cost.resolved_mode(mode, F.lit(False))
        own = lambda value, name: F.lit(float(value)) if value is not None else plain[name]
        least, dup, rel = own(self.min_retention, "min_retention"), own(self.duplicate, "duplicate"), own(self.relevance, "relevance")
        if self.schema_strict:
            bold = m == "aggressive"
            dup, rel = F.when(bold, F.greatest(dup, F.lit(0.90))).otherwise(dup), F.when(bold, F.least(rel, F.lit(0.15))).otherwise(rel)
            least, m = F.greatest(least, F.lit(0.88)), F.when(bold, "balanced").otherwise(m)
        # a threshold of zero counts as not given
        given = lambda c, default: F.when(c == 0, default).otherwise(c)
        return F.struct(m.alias("mode"), given(least, 0.90).alias("min_retention"), given(dup, 0.90).alias("duplicate"), given(rel, 0.15).alias("relevance"))


# -- prompts -----------------------------------------------------------------------------------------------------


def _block(texts: Sequence[str]) -> str:
    return PROTECTED + "\n\n".join(texts) if texts else ""


def with_protected(prompt: Column, block: str) -> Column:
    if not block:
        return prompt
    return F.when(F.contains(prompt, F.lit(block.strip())), prompt).otherwise(F.concat(F.regexp_replace(prompt, r"\s+$", ""), F.lit(block)))


def with_context(prompt: Column, chunks: Column) -> Column:
    parts = F.filter(F.transform(chunks, T.strip), lambda c: c != "")
    return F.when(F.size(chunks) > 0, F.concat(T.strip(prompt), F.lit(CONTEXT), F.array_join(parts, "\n\n"))).otherwise(T.strip(prompt))


# -- steps ------------------------------------------------------------------------------------------------------------

_REMOVED = "array<struct<text:string,cost:bigint,worth:double>>"


def _worth(text: Column, asked: Column, terms: Sequence[str]) -> Column:
    """How telling a removed text is, asked being the counts of the query's words."""
    low = F.lower(text)
    named = sum((F.when(F.contains(low, F.lit(t)), 2.0).otherwise(0.0) for t in terms), F.lit(0.0))
    parts = 3.0 * F.size(T.numbers(text)) + 2.0 * F.size(T.codes(text)) + 1.5 * F.size(T.constraint_windows(text)) + 0.5 * F.size(T.entities(text))
    return named + parts + counted_cosine(asked, counts(T.words(text)))


@kept
def _counted(name: str) -> Column:
    return counts(T.words(F.col(name)))


@kept
def _chunk_value() -> Column:
    return counted_cosine(F.col("asked_counts"), _counted("text"))


@kept
def _chunk_worth(terms: tuple[str, ...]) -> Column:
    return _worth(F.col("text"), F.col("asked_counts"), terms)


def _parts(r: DataFrame, policy: Policy, terms: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(id, lines): the prompts' sentences without near-copies of earlier ones, a line each; and (id, pool, irrelevant, copies): chunks by
    similarity to the query, those below the threshold and near-copies of better ones apart. One search finds both kinds of copies."""
    c = r.select("id", F.col("t.duplicate").alias("least"), F.col("t.relevance").alias("relevance"), "asked", "asked_counts", F.posexplode("chunks").alias("idx", "text"))
    c = c.withColumns({"value": _chunk_value(), "worth": _chunk_worth(terms), "cost": T.count_tokens(F.col("text"))})
    c = c.withColumn("relevant", (F.col("value") >= F.col("relevance")) | (F.col("asked") == ""))
    order = Window.partitionBy("id").orderBy(F.desc("relevant"), F.desc("value"), "idx")
    c = settle(c.withColumn("rank", F.row_number().over(order) - 1).drop("asked", "asked_counts"))
    of = lambda is_chunk: F.struct("id", F.lit(is_chunk).alias("is_chunk")).alias("g")
    u = c.where("relevant").select(of(True), F.col("rank").alias("pos"), F.col("text").alias("unit"), "least")
    if policy.deduplicate:
        u = u.unionByName(r.select(of(False), F.col("t.duplicate").alias("least"), F.posexplode(T.sentences(F.col("work"))).alias("pos", "unit")).select("g", "pos", "unit", "least"))
    stay = settle(dedup.keep_first(u.select("g", "pos", "unit"), dedup.cosine_edges(u, "least")).select("g.id", "g.is_chunk", "pos", "kept", F.when(~F.col("g.is_chunk"), F.col("unit")).alias("unit")))
    lines = stay.where("kept and not is_chunk").groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "unit"))), lambda x: x.unit), "\n").alias("lines"))
    c = c.join(stay.where("is_chunk").select("id", F.col("pos").alias("rank"), "kept"), ["id", "rank"], "left")
    row = F.struct("rank", "idx", "text", "value", "cost", "worth")
    of = lambda cond, by: F.sort_array(F.collect_list(F.when(cond, F.struct(F.col(by).alias("_by"), row.alias("row")))))
    g = c.groupBy("id").agg(of(F.col("kept"), "rank").alias("pool"), of(~F.col("relevant"), "idx").alias("irrelevant"), of(~F.col("kept"), "rank").alias("copies"))
    return lines, g.select("id", *[F.transform(k, lambda x: x.row).alias(k) for k in ("pool", "irrelevant", "copies")])


def _trimmed(x: Column, block: str) -> Column:
    """Struct (kept, gone) of a prompt's sentences: each stays if the whole request then still fits. Tokens of lines add up."""
    fixed = T.count_tokens(F.lit(block)) if block else F.lit(0).cast("long")
    lines = F.transform(T.sentences(F.replace(x.work, F.lit(block), F.lit("")) if block else x.work), lambda s: F.struct(s.alias("text"), T.count_tokens(s).alias("cost")))
    none = F.array().cast("array<string>")

    def step(s: Column, line: Column) -> Column:
        fits = s.used + line.cost <= x.most
        return F.when(fits, F.struct((s.used + line.cost).alias("used"), F.array_append(s.kept, line.text).alias("kept"), s.gone.alias("gone"))).otherwise(F.struct(s.used.alias("used"), s.kept.alias("kept"), F.array_append(s.gone, line.text).alias("gone")))

    begin = F.struct((fixed + x.context).cast("long").alias("used"), none.alias("kept"), none.alias("gone"))
    return F.aggregate(lines, begin, step, lambda s: F.struct(s.kept.alias("kept"), s.gone.alias("gone")))


def _rescued(x: Column) -> Column:
    """Struct (best, added, m): removed texts put back, the most telling first, while they fit and retention gains.

    x: facts, m (measures of best), best, work, chosen (texts), pool (text, cost, worth in order), used, most, least.
    """
    none = F.array().cast("array<string>")
    begin = F.struct(x.best.alias("best"), none.alias("added"), x.used.alias("used"), x.m.alias("m"))

    def step(s: Column, p: Column) -> Column:
        mark = F.when((F.size(x.chosen) == 0) & (F.size(s.added) == 0), T.count_tokens(F.lit(CONTEXT))).otherwise(F.lit(0))
        used = s.used + p.cost + mark
        grown = lambda: F.array_append(s.added, p.text)
        tried = bind(with_context(x.work, F.concat(x.chosen, grown())), lambda t: F.struct(t.alias("t"), retention.measures(x.facts, t).alias("m")))
        better = lambda n: F.when(n.m.retention >= s.m.retention + GAIN, F.struct(n.t.alias("best"), grown().alias("added"), used.alias("used"), n.m.alias("m"))).otherwise(s)
        return F.when((s.m.retention < x.least) & (used <= x.most), bind(tried, better)).otherwise(s)

    return F.aggregate(x.pool, begin, step, lambda s: F.struct(s.best.alias("best"), s.added.alias("added"), s.m.alias("m")))


# -- the long expressions over a request's columns -------------------------------------------------------------


@kept
def _filler_gone() -> Column:
    return T.drop_filler(F.col("guarded")).text


@kept
def _taken(knapsack: bool) -> Column:
    """Places in the pool of the chunks taken within the budget."""
    if knapsack:
        return selection.best_fit(F.transform("pool", lambda c: F.struct(c.value.alias("value"), c.cost.alias("cost"))), F.col("budget"))
    return selection.first_fit(F.transform("pool", lambda c, i: F.struct(i.alias("idx"), c.cost.alias("cost"))), F.col("budget"))


@kept
def _cut(block: str) -> Column:
    return F.when(~F.col("fits"), bind(F.struct("work", "most", "context"), lambda s: _trimmed(s, block)))


@kept
def _cut_lines(terms: tuple[str, ...]) -> Column:
    lines = F.coalesce("cut.gone", F.array().cast("array<string>"))
    return F.transform(lines, lambda s: F.struct(s.alias("text"), T.count_tokens(s).alias("cost"), _worth(s, F.col("asked_counts"), terms).alias("worth")))


@kept
def _facts() -> Column:
    return retention.facts(F.col("whole"))


@kept
def _measured() -> Column:
    return retention.measures(F.col("facts"), F.col("best"))


@kept
def _ending() -> Column:
    """Struct (best, added, m): the request after its rescue, where it has chunks and its retention is below the least."""
    pool = F.filter(F.array_distinct("gone"), lambda g: (g.text != "") & ~F.array_contains("chosen", g.text))
    ranked = F.transform(F.sort_array(F.transform(pool, lambda g, i: F.struct((-g.worth).alias("w"), i.alias("i"), g.text.alias("text"), g.cost.alias("cost")))), lambda g: F.struct(g.text.alias("text"), g.cost.alias("cost")))
    least = F.col("t.min_retention")
    state = F.struct("facts", "m", "best", "work", "chosen", ranked.alias("pool"), "used", "most", least.alias("least"))
    asis = F.struct(F.col("best"), F.array().cast("array<string>").alias("added"), F.col("m"))
    return F.when(F.col("some") & (F.col("m.retention") < least), bind(state, _rescued)).otherwise(asis)


RESULT = (
    "original_prompt string, optimized_prompt string, original_tokens long, optimized_tokens long, cost_before double, cost_after double, savings double, "
    "cost_reduction double, tokens_saved long, reduction_pct double, entity double, numeric double, constraint double, semantic double, keyword double, "
    "retention double, success double, risk string, status string, reason string, selected array<string>, removed array<string>"
)


def optimize_requests(requests: DataFrame, id_col: str = "request_id", policy: Policy = Policy()) -> DataFrame:
    """requests (id_col, prompt, query, chunks array<string>, and optionally max_input_tokens, mode) -> RESULT by request.

    Ids are to be unique. Null prompts, queries and chunks count as empty, none and absent; without a query the prompt is asked. Texts
    removed are the irrelevant, the near-copies, what the budget left out and trimmed sentences, in this order.
    """
    has, block = set(requests.columns), _block(list(dict.fromkeys(t.strip() for t in policy.protected if t and t.strip())))
    terms = tuple(dict.fromkeys(str(t).strip().lower() for t in policy.critical_terms if t and str(t).strip()))
    own = lambda name, default: F.coalesce(F.col(name), F.lit(default)) if name in has else F.lit(default)
    texts = "array<string>"
    prompt = F.coalesce(F.col("prompt"), F.lit(""))
    r = dealt(requests, id_col).select(
        F.col(id_col).alias("id"),
        prompt.alias("prompt"),
        F.when(F.coalesce(F.col("query"), F.lit("")) != "", F.col("query")).otherwise(prompt).alias("asked") if "query" in has else prompt.alias("asked"),
        F.filter(F.coalesce(F.col("chunks"), F.array().cast(texts)), lambda c: c.isNotNull()).alias("chunks"),
        own("max_input_tokens", policy.max_input_tokens).cast("long").alias("most"),
        policy.thresholds(own("mode", policy.mode)).alias("t"),
    )
    r = r.withColumn("guarded", with_protected(F.col("prompt"), block))
    r = r.withColumns({"whole": with_context(F.col("guarded"), F.col("chunks")), "work": with_protected(_filler_gone(), block) if policy.normalize else F.col("guarded"), "asked_counts": _counted("asked")})
    r = settle(r.withColumn("before", T.count_tokens(F.col("whole"))))

    lines, found = _parts(r, policy, terms)
    x = r
    if policy.deduplicate:
        x = x.join(lines, "id", "left").withColumn("work", with_protected(F.coalesce("lines", F.lit("")), block)).drop("lines")
    # written here: what follows is the bulk of the work, on rows alone, and is dealt anew as joins of few requests end in few tasks
    x = dealt(settle(x.join(found, "id", "left")), "id")
    rows = "array<struct<rank:int,idx:int,text:string,value:double,cost:bigint,worth:double>>"
    for name in ("pool", "irrelevant", "copies"):
        x = x.withColumn(name, F.coalesce(name, F.array().cast(rows)))
    budget = F.greatest(F.lit(1).cast("long"), F.col("most") - T.count_tokens(F.col("work")))
    x = x.withColumn("budget", budget).withColumn("took", _taken(policy.knapsack)).drop("budget")
    chosen = F.filter("pool", lambda c, i: F.array_contains("took", i))
    chosen = F.array_sort(chosen, lambda a, b: a.idx - b.idx) if policy.knapsack else chosen
    x = x.withColumns({"chosen": chosen, "left": F.filter("pool", lambda c, i: ~F.array_contains("took", i))})
    bare = lambda c: F.transform(c, lambda e: F.struct(e.text.alias("text"), e.cost.alias("cost"), e.worth.alias("worth")))
    mark = F.when(F.size("chosen") > 0, T.count_tokens(F.lit(CONTEXT))).otherwise(F.lit(0))
    x = x.withColumns({"gone": F.concat(*map(bare, ("irrelevant", "copies", "left"))), "chosen": F.transform("chosen", lambda c: c.text), "context": (mark + F.aggregate("chosen", F.lit(0).cast("long"), lambda s, c: s + c.cost)).cast("long")})
    x = x.drop("pool", "irrelevant", "copies", "left", "took").withColumn("fits", T.count_tokens(with_context(F.col("work"), F.col("chosen"))) <= F.col("most"))
    # too long still: sentences of the prompt go
    x = x.withColumn("cut", _cut(block))
    said = _cut_lines(terms)
    x = x.withColumns({"work": F.when(F.col("fits"), F.col("work")).otherwise(with_protected(F.array_join("cut.kept", "\n"), block)), "gone": F.concat("gone", said)}).drop("cut")
    x = x.withColumn("best", with_context(F.col("work"), F.col("chosen"))).withColumn("used", T.count_tokens(F.col("best")))
    # written once more: all that follows reads the facts and the measures several times
    x = x.withColumn("facts", _facts())
    x = settle(x.select("id", "whole", "before", "most", "t", "work", "chosen", "gone", "best", "used", "facts", (F.size("chunks") > 0).alias("some"), _measured().alias("m")))

    least = F.col("t.min_retention")
    x = x.withColumn("end", _ending())
    back = F.lit(policy.rollback) & (F.col("end.m.retention") < least)
    x = x.withColumn("status", F.when(back, "rolled_back").otherwise("accepted"))
    x = x.withColumn("final", F.when(back, F.col("whole")).otherwise(F.col("end.best"))).withColumn("after", T.count_tokens(F.col("final")))
    money = cost.cost_columns(F.col("before"), F.col("after"), F.lit(policy.expected_output))
    x = x.withColumns({f"c_{k}": v for k, v in money.items()})
    latency = F.when(F.col("status") == "rolled_back", 0.0).otherwise(F.col("c_cost_reduction"))
    m = lambda k: F.col(f"end.m.{k}")
    risk = cost.risk_label(F.col("status"), F.lit(policy.schema_strict), m("retention"), m("constraint"), m("numeric"), m("entity"), F.col("c_reduction_pct"))
    places = {"cost_before": 8, "cost_after": 8, "savings": 8, "cost_reduction": 4, "reduction_pct": 4}
    return x.select(
        F.col("id").alias(id_col),
        F.col("whole").alias("original_prompt"),
        F.col("final").alias("optimized_prompt"),
        F.col("before").alias("original_tokens"),
        F.col("after").alias("optimized_tokens"),
        *[(F.round(f"c_{k}", places[k]) if k in places else F.col(f"c_{k}")).alias(k) for k in money],
        *[F.round(m(k), 4).alias(k) for k in ("entity", "numeric", "constraint", "semantic", "keyword", "retention")],
        F.round(cost.success(m("retention"), F.col("c_cost_reduction"), latency), 4).alias("success"),
        risk.alias("risk"),
        "status",
        F.when(F.col("status") == "rolled_back", "retention_score_below_threshold").alias("reason"),
        F.concat("chosen", "end.added").alias("selected"),
        F.transform("gone", lambda g: g.text).alias("removed"),
    )
