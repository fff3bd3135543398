"""Reading scores and decisions out of model outputs, coercions, and comparison of two variants of a run."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexforge.functions import kernels
from lexforge.functions import lexicons as L
from lexforge.functions import similarity as S
from lexforge.functions import text as T
from lexforge.functions.similarity import bind
from lexforge.operators import evidence as E
from lexforge.sources.shared import settle


def _ladder(v: Column, exact: list[tuple[str, tuple]], within: list[tuple[str, tuple]]) -> Column:
    """First group that holds v, then the first one of whose words occurs in v."""
    out = F.when(F.lit(False), None)
    for name, values in exact:
        out = out.when(v.isin(*values), name)
    for name, parts in within:
        hit = F.lit(False)
        for p in parts:
            hit = hit | F.contains(v, F.lit(p))
        out = out.when(hit, name)
    return out


def decision(raw: Column) -> Column:
    """shortlist, reject or hold; null for nothing or n/a; what isn't understood stays as it is."""
    return bind(raw, lambda r: bind(T.canonical(r), lambda v: _decision(r, v)))


def _decision(raw: Column, v: Column) -> Column:
    yes = ("yes", "shortlist", "shortlisted", "selected", "recommend", "recommended", "hire", "proceed")
    no = ("no", "reject", "rejected", "do not shortlist", "not shortlist")
    known = _ladder(v, [("shortlist", yes), ("reject", no), ("hold", ("maybe", "hold", "borderline", "manual review", "review"))], [("shortlist", ("shortlist", "recommend", "proceed")), ("reject", ("reject", "do not")), ("hold", ("hold", "review"))])
    return F.when(raw.isNull() | (raw == "") | v.isin("n/a", "na", ""), None).otherwise(F.coalesce(known, v))


def agent_decision(raw: Column) -> Column:
    """Shortlist, Reject or Hold, else null."""
    return bind(raw, lambda r: bind(F.trim(F.regexp_replace(F.lower(T.strip(r)), "[^a-z ]", "")), lambda v: _agent_decision(r, v)))


def _agent_decision(raw: Column, v: Column) -> Column:
    yes = ("shortlist", "yes", "selected", "recommend", "recommended", "hire", "proceed", "shortlisted")
    no = ("reject", "no", "rejected", "do not shortlist", "not shortlist")
    known = _ladder(v, [("Shortlist", yes), ("Reject", no), ("Hold", ("hold", "maybe", "manual review", "review", "borderline"))], [("Shortlist", ("shortlist", "recommend")), ("Reject", ("reject", "do not")), ("Hold", ("hold", "review"))])
    return F.when(raw.isNull() | (raw == ""), None).otherwise(known)


def json_body(raw: Column) -> Column:
    """The text itself if it is a JSON object, else its outermost braces if they are; else null."""
    is_object = lambda c: F.ltrim(c).startswith("{") & F.try_parse_json(c).isNotNull()
    within = lambda r: bind(F.regexp_extract(r, r"(?s)\{.*\}", 0), lambda i: F.when(is_object(i), i))
    return bind(raw, lambda r: F.when(is_object(r), r).otherwise(within(r)))


def _first_match(raw: Column, patterns: list[str]) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(raw, p, 1), F.lit("")) for p in patterns])


SCORE_FIELDS = ("final_score", "score", "candidate_score")
DECISION_FIELDS = ("shortlist_decision", "decision", "recommendation")


def score(raw: Column) -> Column:
    """Score of an output: from JSON keys, else from the first pattern that matches."""
    return _score(raw, bind(json_body(raw), lambda body: F.coalesce(*[F.get_json_object(body, f"$.{k}").try_cast("double") for k in SCORE_FIELDS])))


def _score(raw: Column, keyed: Column) -> Column:
    number = r"([0-9]+(?:\.[0-9]+)?)"
    return F.coalesce(keyed, _first_match(raw, [rf"(?i)final_score\s*[:=]\s*{number}", rf"(?i)final[_ ]?score\s*[:=]\s*{number}", rf"(?i)score\s*[:=]\s*{number}"]).try_cast("double"))


def extracted_decision(raw: Column) -> Column:
    return _extracted_decision(raw, bind(json_body(raw), lambda body: F.coalesce(*[F.get_json_object(body, f"$.{k}") for k in DECISION_FIELDS])))


def _extracted_decision(raw: Column, keyed: Column) -> Column:
    found = _first_match(raw, [r"(?is)shortlist_decision\s*[:=]\s*['\"]?([A-Za-z _/-]+)", r"(?is)decision\s*[:=]\s*['\"]?([A-Za-z _/-]+)", r"(?is)Final\s+Shortlist\s+Decision.*?(Shortlist|Reject|Hold|Yes|No|Maybe)"])
    first = F.regexp_replace(F.split(T.strip(found), "\n")[0], r"^[ \-*.,']+|[ \-*.,']+$", "")
    return decision(F.coalesce(keyed, first))


def score_component(delta: Column) -> Column:
    return F.when(delta.isNull(), 70.0).when(delta <= 0.25, 100.0).when(delta <= 0.5, 85.0).otherwise(F.greatest(F.lit(0.0), 100.0 - delta * 25.0))


# -- coercions --------------------------------------------------------------------------------------------------


def to_list(raw: Column) -> Column:
    """A string as a list: null words none, parts at semicolons, else bulleted lines, else itself."""
    return bind(T.strip(F.coalesce(raw, F.lit(""))), _to_list)


def _to_list(s: Column) -> Column:
    parts = lambda c, sep, trim: F.filter(F.transform(F.split(c, sep, -1), lambda x: F.regexp_replace(x, trim, "")), lambda x: x != "")
    return (
        F.when((s == "") | F.lower(s).isin(*L.NULL_WORDS), F.array().cast("array<string>"))
        .when(F.contains(s, F.lit(";")), parts(s, ";", r"^\s+|\s+$"))
        .when(F.contains(s, F.lit("\n")), parts(s, "\n", r"^[ \-•\t]+|[ \-•\t]+$"))
        .otherwise(F.array(s))
    )


def to_number(raw: Column) -> Column:
    return F.nullif(F.regexp_extract(raw, r"-?\d+(?:\.\d+)?", 0), F.lit("")).try_cast("double")


def score_100(v: Column) -> Column:
    """0 to 100; what lies in 0..1 is a share; halves go to the even number."""
    scaled = F.when(v.isNull(), 0.0).when((v >= 0) & (v <= 1), v * 100).otherwise(v)
    return F.bround(F.greatest(F.lit(0.0), F.least(F.lit(100.0), scaled)), 0).cast("long")


def enum_value(name: str, raw: Column) -> Column:
    values, default = L.ENUMS[name]
    known = lambda v: _ladder(v, [(n, (n.lower(), *vs)) for n, vs in values], [(n, tuple(x for x in vs if len(x) >= 4)) for n, vs in values])
    return F.coalesce(bind(F.lower(T.strip(F.coalesce(raw, F.lit("")))), known), F.lit(default))


# -- comparison ----------------------------------------------------------------------------------------------------


SEMANTIC = "similarity double, token_cosine double, char4_cosine double, concept_jaccard double"


def semantic(a: str, b: str) -> Column:
    """Struct SEMANTIC of two columns: similarity = 0.45 token cosine + 0.25 character 4-gram cosine + 0.30 concept Jaccard, and its parts.

    Counting a text's 4-grams is quadratic as an array expression, so this one is an Arrow function.
    """

    @F.pandas_udf(SEMANTIC)
    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        rows = [kernels.semantic_similarity(p or "", q or "") for p, q in zip(x, y, strict=True)]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in SEMANTIC.split(", ")])

    return run(a, b)


EVIDENCE_FIELDS = ("evidence_terms", "reasons", "concerns", "risk_flags", "interview_plan", "raw_output")
FIELDS = (*SCORE_FIELDS, *DECISION_FIELDS, *EVIDENCE_FIELDS)


def _read(df: DataFrame, raw: str) -> DataFrame:
    """df with an output's fields, as struct <raw>_f, the output read once for all of them; body is null if it is no JSON object."""
    names = [f"_{k}" for k in FIELDS]
    df = df.withColumn("_body", json_body(F.col(raw)))
    df = df.select("*", F.json_tuple("_body", *FIELDS).alias(*names))
    fields = F.struct(F.col("_body").alias("body"), *[F.col(n).alias(k) for n, k in zip(names, FIELDS, strict=True)])
    return df.withColumn(f"{raw}_f", fields).drop("_body", *names)


def _evidence_text(raw: Column, fields: Column) -> Column:
    """An output's evidence fields, then the output itself; just the output if it is no JSON object."""
    return F.when(fields.body.isNull(), raw).otherwise(F.concat_ws("\n", *[F.coalesce(fields[k], F.lit("")) for k in EVIDENCE_FIELDS], raw))


#: a pair of outputs is compared once for all its rows where pairs come this often on average
AGAIN = 4
#: bytes of compared pairs that may be broadcast
SMALL_BYTES = 16 << 20


def compare(pairs: DataFrame, id_col: str, baseline: str, optimized: str) -> DataFrame:
    """How far the optimized output keeps the baseline's decision, score and evidence.

    The rows and the distinct pairs are counted first. Where pairs come again often, each is compared once and joined to its rows,
    by broadcast if the bytes prove small; else each row's pair is compared in its row, and no text is shuffled.
    """
    p = pairs.select(F.col(id_col).alias("id"), F.col(baseline).alias("a"), F.col(optimized).alias("b"))
    rows, kinds = p.agg(F.count("*"), F.approx_count_distinct(F.xxhash64("a", "b"))).first()
    if kinds * AGAIN > rows:
        return _compared(p).drop("a", "b").withColumnRenamed("id", id_col)
    once = settle(_compared(p.select("a", "b").distinct()))
    texts = F.octet_length(F.concat_ws("", "a", "b", "missing_entities", "missing_concerns"))
    size = once.agg(F.coalesce(F.sum(texts + 128), F.lit(0))).first()[0]
    q = once.withColumnsRenamed({"a": "_a", "b": "_b"})
    met = p.join(F.broadcast(q) if size <= SMALL_BYTES else q, F.col("a").eqNullSafe(F.col("_a")) & F.col("b").eqNullSafe(F.col("_b")))
    return met.drop("a", "b", "_a", "_b").withColumnRenamed("id", id_col)


def _compared(pairs: DataFrame) -> DataFrame:
    """compare() of the outputs a and b row by row; all columns stay."""
    own = pairs.columns
    p = _read(_read(pairs, "a"), "b")
    first = lambda c, keys, kind: F.coalesce(*[F.col(f"{c}_f")[k].try_cast(kind) for k in keys])
    p = p.select(
        *own,
        *[_extracted_decision(F.col(c), first(c, DECISION_FIELDS, "string")).alias(f"d{c}") for c in "ab"],
        *[_score(F.col(c), first(c, SCORE_FIELDS, "double")).alias(f"s{c}") for c in "ab"],
        *[_evidence_text(F.col(c), F.col(f"{c}_f")).alias(f"e{c}") for c in "ab"],
    )
    p = p.withColumn("led", E.ledger(F.col("ea")))
    p = p.withColumn("kept", E.retained_of({k: F.col("led")[k] for k in E.ONTOLOGIES}, F.col("eb"), E.ONTOLOGIES))
    delta = F.abs(F.col("sa") - F.col("sb"))
    p = p.select(
        *own,
        F.coalesce(F.col("da") == F.col("db"), F.lit(False)).alias("decision_preserved"),
        F.round(delta, 6).alias("score_delta"),
        F.coalesce(delta <= 0.25, F.lit(False)).alias("score_preserved"),
        score_component(delta).alias("component"),
        E.share_kept(F.col("led.entities"), F.col("kept.entities")).alias("entity_pct"),
        E.share_kept(F.col("led.concerns"), F.col("kept.concerns")).alias("raw_concern_pct"),
        E.weighted_share(F.col("led.concerns"), F.col("kept.concerns")).alias("concern_pct"),
        E.share_kept(F.col("led.reasons"), F.col("kept.reasons")).alias("reason_pct"),
        S.lexical(F.col("ea"), F.col("eb")).alias("similarity"),
        F.array_join(F.array_except("led.entities", "kept.entities"), "|").alias("missing_entities"),
        F.array_join(F.array_except("led.concerns", "kept.concerns"), "|").alias("missing_concerns"),
    )
    overall = 0.30 * F.when(F.col("decision_preserved"), 100.0).otherwise(0.0) + 0.15 * F.col("component") + 0.20 * F.col("entity_pct") + 0.25 * F.col("concern_pct") + 0.10 * F.col("reason_pct")
    p = p.withColumn("overall_pct", overall)
    passed = F.col("decision_preserved") & F.col("score_preserved") & (F.col("entity_pct") >= 90) & (F.col("concern_pct") >= 90) & (F.col("overall_pct") >= 90)
    return p.withColumn("passed", passed).drop("component")
