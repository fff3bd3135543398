"""Governance of model outputs as schema-on-read: JSON as variants, contracts and aliases as a table, coercion in columns.

An output's keys are read as an ordered map of variants. A contract is a row (agent, fields, aliases) that is joined to the outputs of its
agent, so contracts other than the built-in ones are a DataFrame away. Values travel as structs (t, s): the type and the text,
raw for a string and JSON for anything else.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.functions import lexicons as L
from lexforge.functions import text as T
from lexforge.functions.similarity import bind, kept
from lexforge.operators import quality as Q

#: bytes of a table of contracts that may be broadcast
SMALL_CONTRACTS = 1 << 20
_TEXTS = "array<string>"
_CONTRACT = "agent string, fields array<struct<name:string,kind:string,non_empty:boolean>>, aliases map<string,string>"


def contracts(spark: SparkSession, own: dict | None = None) -> DataFrame:
    """The built-in contracts, or others of their form, as a table: (agent, fields, aliases)."""
    rows = [(a, [(n, k, n in full) for n, k in fields], dict(aliases)) for a, (fields, full, aliases) in (own or L.CONTRACTS).items()]
    return spark.createDataFrame(rows, _CONTRACT)


def contract_text(fields: Column) -> Column:
    """What a prompt says about a contract; nothing for one without fields."""
    line = lambda f: F.concat(F.lit("- "), f["name"], F.lit(": "), f.kind, F.when(f.non_empty, " non-empty").otherwise(""))
    lines = F.concat(F.array(*map(F.lit, L.CONTRACT_OPEN)), F.transform(fields, line), F.array(*map(F.lit, L.CONTRACT_CLOSE)))
    return F.when(F.size(fields) > 0, F.array_join(lines, "\n")).otherwise("")


def repair_text(raw: Column, fields: Column) -> Column:
    """The prompt that asks for an output once more."""
    return F.concat(F.lit(L.REPAIR_OPEN + "\n\n"), contract_text(fields), F.lit(L.REPAIR_CLOSE), raw)


def instruction(agent: str) -> str:
    """contract_text() of a built-in contract, as a constant of a policy."""
    fields, full, _ = L.CONTRACTS.get(agent, ((), (), {}))
    return "\n".join([*L.CONTRACT_OPEN, *(f"- {n}: {k}{' non-empty' * (n in full)}" for n, k in fields), *L.CONTRACT_CLOSE]) if fields else ""


def repair_opening(agent: str) -> str:
    """repair_text() of a built-in contract up to the output."""
    return f"{L.REPAIR_OPEN}\n\n{instruction(agent)}{L.REPAIR_CLOSE}"


# -- values ------------------------------------------------------------------------------------------------------------


def _texts(*values: Column) -> Column:
    return F.array(*values).cast(_TEXTS) if not values else F.array(*values)


def _value(t, s: Column) -> Column:
    return F.struct((F.lit(t) if isinstance(t, str) else t).alias("t"), s.alias("s"))


def _quoted(s: Column) -> Column:
    """A string as JSON."""
    return bind(F.to_json(F.array(s)), lambda j: F.substring(j, F.lit(2), F.length(j) - 2))


def _of_variant(v: Column) -> Column:
    def of(kind: Column) -> Column:
        t = F.when(kind.startswith("ARRAY"), "list").when(kind.startswith("OBJECT"), "dict").when(kind == "BOOLEAN", "bool").when(kind == "VOID", "null").otherwise("number")
        return F.when(kind == "STRING", _value("string", F.try_variant_get(v, "$", "string"))).otherwise(_value(t, F.to_json(v)))

    # bound: each of its comparisons would read the value again
    return bind(F.schema_of_variant(v), of)


def _json(v: Column) -> Column:
    return F.when(v.t == "string", _quoted(v.s)).otherwise(v.s)


def _items(v: Column) -> Column:
    """JSON texts of a list's elements."""
    return F.transform(F.from_json(v.s, "array<variant>"), lambda e: F.to_json(e))


def _plain(j: Column) -> Column:
    """Text of a JSON value: a string without its quotes and escapes, anything else as it is."""
    bare = F.substring(j, F.lit(2), F.length(j) - 2)
    escaped = F.from_json(F.concat(F.lit("["), j, F.lit("]")), _TEXTS)[0]
    return F.when(j.startswith('"'), F.when(F.contains(j, F.lit("\\")), escaped).otherwise(bare)).otherwise(j)


def _list(items: Column) -> Column:
    return _value("list", F.concat(F.lit("["), F.array_join(items, ","), F.lit("]")))


def _says(v: Column) -> Column:
    """Whether a value is more than null, nothing, zero or false."""
    return ~(v.t == "null") & ~((v.t == "string") & (v.s == "")) & ~v.s.isin("[]", "{}", "false") & ~((v.t == "number") & (v.s.try_cast("double") == 0))


def _merged(a: Column, b: Column) -> Column:
    """Two values of one field: lists unite, a scalar joins a list, else the first that says something."""
    as_list = lambda v: F.when(v.t == "list", _items(v)).otherwise(F.array(_json(v)))
    both = bind(F.struct(as_list(a).alias("a"), as_list(b).alias("b")), lambda x: _list(F.concat(x.a, F.filter(x.b, lambda e: ~F.array_contains(x.a, e)))))
    return F.when((a.t == "list") | (b.t == "list"), both).when(_says(a), a).otherwise(b)


def _empty(v: Column) -> Column:
    return (v.t == "null") | ((v.t == "string") & (T.strip(v.s) == "")) | v.t.isin("list", "dict") & v.s.isin("[]", "{}")


def _text(v: Column) -> Column:
    joined = lambda: F.array_join(F.transform(_items(v), _plain), "; ")
    return F.when(v.t == "null", "").when(v.t == "string", T.strip(v.s)).when(v.t == "list", joined()).otherwise(v.s)


def _number(v: Column) -> Column:
    return F.when(v.t == "number", v.s.try_cast("double")).when(v.t.isin("null", "bool"), F.lit(None)).otherwise(Q.to_number(v.s))


# -- coercions: struct (v, log) ------------------------------------------------------------------------------------------


def _out(v: Column, log: Column) -> Column:
    return F.struct(v.alias("v"), F.filter(log, lambda x: x.isNotNull()).alias("log"))


def _logged(cond: Column, *parts) -> Column:
    return F.when(cond, F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]))


def _to_list(v: Column) -> Column:
    own = F.when(v.t == "null", _texts()).when(v.t == "string", F.transform(Q.to_list(v.s), _quoted)).otherwise(F.array(v.s))
    return F.when(v.t == "list", v).otherwise(_list(own))


def _to_text(v: Column) -> Column:
    return _value("string", _text(v))


def _to_dict(v: Column) -> Column:
    return F.when(v.t == "dict", v).otherwise(_value("dict", F.lit("{}")))


def _rounded(n: Column) -> Column:
    return _value("number", F.coalesce(F.round(n, 4), F.lit(0.0)).cast("string"))


def _of_100(n: Column) -> Column:
    return _value("number", Q.score_100(n).cast("string"))


def _as_list(name: Column, v: Column) -> Column:
    return _out(_to_list(v), F.array(_logged(v.t != "list", "coerce_list:", name)))


def _as_text(name: Column, v: Column) -> Column:
    return _out(_to_text(v), F.array(_logged(v.t != "string", "coerce_string:", name)))


def _as_dict(name: Column, v: Column) -> Column:
    return _out(_to_dict(v), F.array(_logged(v.t != "dict", "coerce_dict:", name)))


def _as_number(name: Column, v: Column) -> Column:
    def of(n: Column) -> Column:
        log = F.array(_logged(n.isNull(), "default_number:", name, ":0"), _logged(n.isNotNull() & (v.t != "number"), "coerce_number:", name))
        return _out(_rounded(n), log)

    return bind(_number(v), of)


def _as_score(v: Column) -> Column:
    def of(n: Column) -> Column:
        log = F.array(_logged(n.isNull(), "default_fit_score:0"), _logged((n >= 0) & (n <= 1), "scale_score_0_1_to_100:", n.cast("string")))
        return _out(_of_100(n), log)

    return bind(_number(v), of)


def _as_enum(enum: str, v: Column) -> Column:
    values, default = L.ENUMS[enum]

    def of(raw: Column) -> Column:
        said = lambda how, name: F.concat(F.lit(f"{how}:{enum}:"), v.s, F.lit(f"->{name}"))
        got = lambda name, log: _out(_value("string", F.lit(name)), F.array(log))
        out = F.when(F.lit(False), got("", F.lit(None).cast("string")))
        for name, variants in values:
            out = out.when(raw == name.lower(), got(name, F.lit(None).cast("string"))).when(raw.isin(*variants), got(name, said("normalize_enum", name)))
        for name, variants in values:
            within = F.exists(T.words_in([x for x in variants if len(x) >= 4]), lambda x: F.contains(raw, x))
            out = out.when(within, got(name, said("normalize_enum_fuzzy", name)))
        return out.otherwise(got(default, F.lit(f"default_enum:{enum}->{default}")))

    return bind(T.strip(F.lower(_text(v))), of)


def coerced(name: Column, kind: Column, v: Column) -> Column:
    """Struct (v, log): a value of the declared type, and what was done to it."""
    out = F.when(kind == "list", _as_list(name, v)).when(kind == "string", _as_text(name, v)).when(kind == "dict", _as_dict(name, v)).when(kind == "number", _as_number(name, v)).when(kind == "score_100", _as_score(v))
    for k, enum in L.ENUM_TYPES.items():
        out = out.when(kind == k, _as_enum(enum, v))
    return out.otherwise(_out(v, _texts()))


def valued(kind: Column, v: Column) -> Column:
    """The value of coerced() alone, for those who don't ask what was done to it."""
    out = F.when(kind == "list", _to_list(v)).when(kind == "string", _to_text(v)).when(kind == "dict", _to_dict(v)).when(kind == "number", bind(_number(v), _rounded)).when(kind == "score_100", bind(_number(v), _of_100))
    for k, enum in L.ENUM_TYPES.items():
        out = out.when(kind == k, _value("string", Q.enum_value(enum, _text(v))))
    return out.otherwise(v)


# -- reading -------------------------------------------------------------------------------------------------------------------


def _keyed(key: Column, v: Column) -> Column:
    return F.struct(key.alias("key"), v.alias("v"))


def _entries(json: Column, entry: Callable[[Column, Column], Column] = _keyed) -> Column:
    """Ordered array of entry(key, v) of a JSON object; null where it isn't one. Single quotes are read too."""
    return F.transform(F.map_entries(F.from_json(json, "map<string,variant>")), lambda e: entry(e.key, _of_variant(e.value)))


def parsed(raw: Column, entry: Callable[[Column, Column], Column] = _keyed, kind: str = "key:string,v:struct<t:string,s:string>") -> Column:
    """Struct (entries, notes): JSON, else a Python literal of the same shape, else lines; and what went wrong on the way.

    entry() makes an entry, a struct of kind, of its key and value.
    """
    body = bind(T.json_candidate(raw), lambda c: F.struct(c.alias("c"), F.try_parse_json(c).alias("json"), F.ltrim(c).startswith("{").alias("braces")))
    literal = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"(?<=[:\[,]\s{0,9})None(?=\s*[,\]}])", "null"), r"(?<=[:\[,]\s{0,9})True(?=\s*[,\]}])", "true"), r"(?<=[:\[,]\s{0,9})False(?=\s*[,\]}])", "false")
    lines = F.filter(F.transform(F.split(raw, r"\r\n|\n|\r", -1), lambda x: F.when(T.strip(x) != "", F.regexp_replace(x, r"^[ \-•\t]+|[ \-•\t]+$", ""))), lambda x: x.isNotNull())
    failed, worse = F.lit("json_parse_failed:JSONDecodeError"), F.lit("literal_eval_failed:SyntaxError")
    none = F.array().cast(f"array<struct<{kind}>>")
    said = lambda e, *notes: F.struct(e.alias("entries"), _texts(*notes).alias("notes"))

    def of(x: Column) -> Column:
        named = lambda key, v: F.array(entry(F.lit(key), v))
        as_lines = bind(lines, lambda ls: F.when(F.size(ls) > 0, said(named("items", _list(F.transform(ls, _quoted))), failed, worse, F.lit("fallback_line_extraction_used"))).otherwise(said(none, failed, worse, F.lit("unable_to_parse_output"))))
        as_literal = bind(F.when(x.braces, _entries(literal(x.c), entry)), lambda e: F.when(e.isNotNull(), said(e, failed, F.lit("parsed_with_ast_literal_eval"))).otherwise(as_lines))
        as_json = bind(_entries(x.c, entry), lambda e: said(e))
        return F.when(x.c == "", said(none, F.lit("empty_output"))).when(x.json.isNotNull() & x.braces, as_json).when(x.json.isNotNull(), said(named("value", _of_variant(x.json)), F.lit("json_root_not_object"))).otherwise(as_literal)

    return bind(body, of)


def _named(name: str):
    return lambda x: (x["name"] == name) & _says(x.v)


#: the fields that contradictions are looked for in
_READ = {
    "reasons": ("reasons", "scoring_rationale", "strengths"),
    "risks": ("risks", "rejection_risks", "red_flags"),
    "missing": ("missing_evidence", "missing_skills", "weak_evidence"),
    "score": ("fit_score", "score"),
    "decision": ("shortlist_decision",),
}


def _consistent(f: Column) -> Column:
    """Struct (consistent, consistency, contradictions) of coerced fields, an array of (name, v)."""

    def pick(names: tuple[str, ...]) -> Column:
        return F.coalesce(*[F.try_element_at(F.filter(f, _named(n)), F.lit(1))["v"] for n in names])

    texts = lambda v: F.when(v.isNull(), _texts()).when(v.t == "list", F.filter(F.transform(_items(v), _plain), lambda s: T.strip(s) != "")).otherwise(F.filter(F.array(T.strip(v.s)), lambda s: s != ""))
    said = lambda v: bind(v, texts)
    share = lambda fit: F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.when((fit >= 0) & (fit <= 1), fit * 100).otherwise(fit)))
    facts = F.struct(
        said(pick(_READ["reasons"])).alias("reasons"),
        said(pick(_READ["risks"])).alias("risks"),
        said(pick(_READ["missing"])).alias("missing"),
        bind(F.coalesce(pick(_READ["score"])["s"].try_cast("double"), F.lit(0.0)), share).alias("score"),
        F.upper(F.coalesce(pick(_READ["decision"])["s"], F.lit(""))).alias("decision"),
    )
    terms = lambda s: F.array_distinct(F.filter(T.find_all(F.lower(s), r"[a-zA-Z0-9_+#.]+"), lambda t: (F.length(t) > 2) & ~t.isin(*L.CONSISTENCY_STOP)))

    def rules(x: Column) -> Column:
        # terms are distinct, so the size of a union is what both have less what they share
        alike = lambda a, b: bind(F.size(F.array_intersect(a, b)), lambda n: n / (F.size(a) + F.size(b) - n) >= 0.55)
        near = lambda risk, given: bind(terms(risk), lambda a: (F.size(a) > 0) & F.exists(given, lambda b: (F.size(b) > 0) & alike(a, b)))
        # bound: a reason's terms would be found again for each risk
        overlap = bind(F.transform(x.reasons, terms), lambda given: F.transform(x.risks, lambda r: F.when(near(r, given), F.concat(F.lit("risk_reason_overlap:"), F.substring(r, 1, 60)))))
        must = F.exists(x.missing, lambda m: F.contains(F.lower(m), F.lit("mandatory")) | F.contains(F.lower(m), F.lit("must")))
        shortlist = x.decision == "SHORTLIST"
        first = F.array(
            F.when(x.decision.isin("SHORTLIST", "RECOMMEND") & (F.size(x.reasons) == 0), "positive_decision_without_reasons"),
            F.when((x.score >= 85) & (F.size(x.missing) >= 3), "high_score_with_many_missing_evidence_items"),
            F.when(shortlist & must, "shortlist_with_missing_mandatory_evidence"),
        )
        last = F.array(F.when((x.score <= 40) & shortlist, "low_score_with_shortlist_decision"), F.when((x.score >= 80) & (x.decision == "REJECT"), "high_score_with_reject_decision"))
        return F.filter(F.concat(first, overlap, last), lambda w: w.isNotNull())

    done = lambda w: F.struct((F.size(w) == 0).alias("consistent"), F.round(F.greatest(F.lit(0.0), 1.0 - 0.15 * F.size(w)), 4).alias("consistency"), w.alias("contradictions"))
    return bind(bind(facts, rules), done)


# -- the long expressions over an output's columns ------------------------------------------------------------


#: a key that canonical_key() leaves as it is
_PLAIN_KEY = r"^[a-z0-9](?:[a-z0-9_]*[a-z0-9])?\z"


def _aliased(key: Column, v: Column) -> Column:
    """Entry (key, own, target, v): own is the canonical key, target what the contract calls it."""
    own = F.when(key.rlike(_PLAIN_KEY), key).otherwise(T.canonical_key(key))
    return bind(own, lambda k: F.struct(key.alias("key"), k.alias("own"), F.coalesce(F.try_element_at("aliases", k), k).alias("target"), v.alias("v")))


def _wanted(names: tuple[str, ...]):
    """Entry (target, v), the value left out, unread, of a target that is neither in names nor, without names, in the text full.

    A search of that text is quicker than one of an array; what it may find too much is a value read for nothing.
    """

    def entry(key: Column, v: Column) -> Column:
        own = F.when(key.rlike(_PLAIN_KEY), key).otherwise(T.canonical_key(key))
        target = bind(own, lambda k: F.coalesce(F.try_element_at("aliases", k), k))
        return bind(target, lambda t: F.struct(t.alias("target"), F.when(t.isin(*names) if names else F.contains("full", F.concat(F.lit("\0"), t, F.lit("\0"))), v).alias("v")))

    return entry


@kept
def _parsed_raw() -> Column:
    return parsed(F.col("raw"), _aliased, "key:string,own:string,target:string,v:struct<t:string,s:string>")


@kept
def _parsed_wanted(names: tuple[str, ...] = ()) -> Column:
    return parsed(F.col("raw"), _wanted(names), "target:string,v:struct<t:string,s:string>")


@kept
def _renames() -> Column:
    return bind(F.col("e"), lambda es: F.transform(F.filter(es, lambda e: e.own != e.target), lambda e: F.concat(F.lit("alias:"), e.key, F.lit("->"), e.target)))


@kept
def _united() -> Column:
    """Array of (name, v): each target's values merged, in the order of first places."""

    def united(es: Column, t: Column) -> Column:
        vs = F.transform(F.filter(es, lambda e: e.target == t), lambda e: e.v)
        return bind(vs, lambda v: F.struct(t.alias("name"), F.aggregate(F.slice(v, F.lit(2), F.size(v)), v[0], lambda a, b: _merged(a, b)).alias("v")))

    def of(es: Column) -> Column:
        targets = F.transform(es, lambda e: e.target)
        single = F.transform(es, lambda e: F.struct(e.target.alias("name"), e.v.alias("v")))
        return bind(F.array_distinct(targets), lambda ts: F.when(F.size(ts) == F.size(es), single).otherwise(F.transform(ts, lambda t: united(es, t))))

    # bound: a column that is named once would be worked out again inside the lambdas, for each field
    return bind(F.filter("e", lambda e: e.v.isNotNull()), of)


@kept
def _fields() -> Column:
    """Array of (name, v, log, errors): the contract's fields, coerced."""

    def field(data: Column, f: Column) -> Column:
        def of(found: Column) -> Column:
            missing = F.size(found) == 0
            value = F.when(missing, _value("null", F.lit("null"))).otherwise(found[0]["v"])
            return bind(bind(value, lambda v: coerced(f["name"], f.kind, v)), lambda c: F.struct(f["name"].alias("name"), c.v.alias("v"), log(missing, c).alias("log"), faults(missing, c).alias("errors")))

        some = lambda *parts: F.filter(F.array(*parts), lambda x: x.isNotNull())
        log = lambda missing, c: F.concat(some(_logged(missing, "insert_missing_field:", f["name"])), c.log)
        faults = lambda missing, c: some(_logged(missing, "missing_required_field:", f["name"]), _logged(f.non_empty & _empty(c.v), "empty_required_field:", f["name"]))
        return bind(F.filter(data, lambda d: d["name"] == f["name"]), of)

    return bind(F.col("data"), lambda data: F.transform("fields", lambda f: field(data, f)))


@kept
def _checked_fields() -> Column:
    return bind(F.col("got"), _consistent)


@kept
def _wanted_fields(names: tuple[str, ...] = ()) -> Column:
    """Array of (name, v): the contract's fields of these names, or else those that may not be empty, coerced."""

    def field(data: Column, f: Column) -> Column:
        found = F.try_element_at(F.filter(data, lambda d: d["name"] == f["name"]), F.lit(1))["v"]
        value = bind(F.coalesce(found, _value("null", F.lit("null"))), lambda v: valued(f.kind, v))
        return F.struct(f["name"].alias("name"), value.alias("v"))

    wanted = F.filter("fields", lambda f: f["name"].isin(*names) if names else f.non_empty)
    return bind(F.col("data"), lambda data: F.transform(wanted, lambda f: field(data, f)))


def _with_contracts(outputs: DataFrame, id_col: str, agent_col: str, raw_col: str, own: DataFrame | None) -> DataFrame:
    """(id, agent, raw, fields, aliases): outputs beside their agent's contract; null outputs are empty, unknown agents have no fields."""
    table = contracts(outputs.sparkSession) if own is None else own
    if own is None or own.select(F.coalesce(F.sum(F.length(F.to_json(F.struct("*")))), F.lit(0))).first()[0] <= SMALL_CONTRACTS:
        table = F.broadcast(table)
    src = outputs.select(F.col(id_col).alias("id"), F.col(agent_col).alias("agent"), F.coalesce(F.col(raw_col), F.lit("")).alias("raw"))
    src = src.join(table.select(F.col("agent").alias("of"), "fields", "aliases"), F.col("agent") == F.col("of"), "left").drop("of")
    return src.withColumn("fields", F.coalesce("fields", F.array().cast("array<struct<name:string,kind:string,non_empty:boolean>>")))


def contradictions(outputs: DataFrame, id_col: str = "output_id", agent_col: str = "agent", raw_col: str = "raw_output", own: DataFrame | None = None) -> DataFrame:
    """The check of govern() alone: (id_col, agent, consistent, consistency, contradictions).

    Only values of fields that the check reads are read and coerced, and nothing is logged.
    """
    src = _with_contracts(outputs, id_col, agent_col, raw_col, own)
    names = tuple(n for of in _READ.values() for n in of)
    src = src.withColumn("e", _parsed_wanted(names).entries).withColumn("data", _united()).withColumn("got", _wanted_fields(names)).withColumn("c", _checked_fields())
    return src.select(F.col("id").alias(id_col), "agent", "c.consistent", "c.consistency", "c.contradictions")


def validity(outputs: DataFrame, id_col: str = "output_id", agent_col: str = "agent", raw_col: str = "raw_output", own: DataFrame | None = None) -> DataFrame:
    """The audit of govern() alone: (id_col, agent, valid, fields).

    A key of each field has to be there, and only values of fields that may not be empty are read and coerced.
    """
    src = _with_contracts(outputs, id_col, agent_col, raw_col, own)
    full = F.transform(F.filter("fields", lambda f: f.non_empty), lambda f: f["name"])
    src = src.withColumn("full", F.concat(F.lit("\0"), F.array_join(full, "\0"), F.lit("\0")))
    src = src.withColumn("e", _parsed_wanted().entries).withColumns({"data": _united(), "gaps": F.array_except("fields.name", "e.target")}).withColumn("got", _wanted_fields())
    full = ~F.coalesce(F.exists("got", lambda g: _empty(g.v)), F.lit(False))
    return src.select(F.col("id").alias(id_col), "agent", ((F.size("gaps") == 0) & full).alias("valid"), "fields")


def govern(outputs: DataFrame, id_col: str = "output_id", agent_col: str = "agent", raw_col: str = "raw_output", own: DataFrame | None = None) -> DataFrame:
    """Each raw output parsed, aliased, coerced to its agent's contract, audited and checked for contradictions.

    (id_col, agent, normalized JSON, valid, repaired, errors, warnings, actions, quality, consistent, consistency, contradictions, fields).
    Contracts are the built-in ones or the table own. Keys of one field are merged in their order; keys of no field go to _extra.
    Null outputs count as empty; unknown and null agents have an empty contract; repeated rows keep a row each.
    """
    src = _with_contracts(outputs, id_col, agent_col, raw_col, own)
    src = src.withColumn("p", _parsed_raw()).withColumn("e", F.col("p.entries")).withColumn("renames", _renames()).withColumn("data", _united()).withColumn("got", _fields())
    names = F.transform("fields", lambda f: f["name"])
    src = src.withColumns({"extra": F.filter("data", lambda d: ~F.array_contains(names, d["name"])), "errors": F.flatten(F.transform("got", lambda g: g.errors)), "actions": F.concat("renames", F.flatten(F.transform("got", lambda g: g.log)))})
    pair = lambda d: F.concat(_quoted(d["name"]), F.lit(":"), _json(d.v))
    inner = F.concat(F.lit('"_extra":{'), F.array_join(F.transform("extra", pair), ","), F.lit("}"))
    parts = F.concat(F.transform("got", pair), F.when(F.size("extra") > 0, F.array(inner)).otherwise(_texts()))
    filled = F.size(F.filter("got", lambda g: ~_empty(g.v))) / F.size("fields")
    score = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.6 + 0.4 * filled - F.least(F.lit(0.5), 0.05 * F.size("errors")))), 4)
    src = src.withColumn("c", _checked_fields())
    return src.select(
        F.col("id").alias(id_col),
        "agent",
        F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}")).alias("normalized"),
        (F.size("errors") == 0).alias("valid"),
        ((F.size("actions") > 0) | (F.size("p.notes") > 0)).alias("repaired"),
        "errors",
        F.col("p.notes").alias("warnings"),
        "actions",
        F.when(F.size("fields") == 0, 1.0).otherwise(score).alias("quality"),
        "c.consistent",
        "c.consistency",
        "c.contradictions",
        "fields",
    )


def repair(outputs: DataFrame, id_col: str = "output_id", raw_col: str = "raw_output") -> DataFrame:
    """Final-decision responses brought to their fields: (id_col, normalized JSON, severity none, minor, major or fallback)."""
    raw = F.col("raw")
    src = outputs.select(F.col(id_col).alias("id"), F.coalesce(F.col(raw_col), F.lit("")).alias("raw"))
    bare = F.regexp_replace(T.strip(raw), r"(?is)^```(?:json)?\s*|\s*```$", "")
    forms = F.array(raw, bare, F.regexp_extract(raw, r"(?s)\{.*\}", 0))
    first = F.try_element_at(F.filter(forms, lambda c: F.try_parse_json(c).isNotNull()), F.lit(1))
    src = src.withColumn("e", bind(first, lambda c: F.when(F.ltrim(c).startswith("{"), _entries(c))))

    def field(name: str) -> Column:
        """Struct (v, renamed, found) of a response's field, under its own name or a shorter one."""
        short = next((k for k, v in L.RESPONSE_NAMES.items() if v == name), "")
        at = lambda k: F.try_element_at(F.filter("e", lambda x: x.key == k), F.lit(1))["v"]
        return bind(F.struct(at(name).alias("a"), at(short).alias("b")), lambda x: F.struct(F.coalesce(x.a, x.b).alias("v"), (x.a.isNull() & x.b.isNotNull()).alias("renamed"), (x.a.isNotNull() | x.b.isNotNull()).alias("found")))

    src = src.withColumns({k: field(k) for k in ("final_score", "shortlist_decision", *L.RESPONSE_LISTS)})
    first_of = lambda patterns: F.coalesce(*[F.nullif(F.regexp_extract(raw, "(?i)" + p, 1), F.lit("")) for p in patterns])
    in_prose = first_of(L.RESPONSE_SCORES).try_cast("double")
    major = F.lit(False)
    minor = F.lit(False)
    out: dict[str, Column] = {}
    for k in L.RESPONSE_LISTS:
        c = F.col(k)
        stripped = F.filter(F.transform(F.transform(_items(c.v), _plain), T.strip), lambda s: s != "")
        is_list = F.coalesce(c.v.t == "list", F.lit(False))
        out[k] = F.when(is_list, F.transform(stripped, _quoted)).when(c.v.isNull() | (c.v.t == "null"), _texts()).otherwise(F.array(_quoted(c.v.s)))
        major = major | c.renamed | ~is_list
        minor = minor | (is_list & (F.transform(stripped, _quoted) != _items(c.v)))
    d = F.col("shortlist_decision")
    said = F.when(d.found, d.v.s).otherwise("N/A")
    decision = F.coalesce(Q.agent_decision(said), F.lit("N/A"))
    s = F.col("final_score")
    cast = F.when(s.v.t == "bool", F.when(s.v.s == "true", 1.0).otherwise(0.0)).otherwise(T.strip(s.v.s).try_cast("double"))
    given = s.found & (s.v.t != "null")
    major = major | d.renamed | ~d.found | s.renamed | ~s.found | (given & cast.isNull())
    minor = minor | (decision != said) | (given & (s.v.t == "string") & cast.isNotNull())
    number = F.when(given, F.coalesce(cast, in_prose))
    known = ("final_score", "shortlist_decision", *L.RESPONSE_LISTS)
    rest = F.filter("e", lambda x: ~x.key.isin(*known, "schema_valid") & ~F.coalesce(F.try_element_at(F.create_map(*[v for k, n in L.RESPONSE_NAMES.items() for v in (F.lit(k), F.col(n).renamed)]), x.key), F.lit(False)))
    body = lambda n, v, lists, tail: F.concat(F.lit('{"final_score":'), F.coalesce(n.cast("string"), F.lit("null")), F.lit(',"shortlist_decision":"'), v, F.lit('"'), *[F.concat(F.lit(f',"{k}":['), F.array_join(lists[k], ","), F.lit("]")) for k in L.RESPONSE_LISTS], tail, F.lit("}"))
    extra = F.array_join(F.transform(rest, lambda x: F.concat(F.lit(","), _quoted(x.key), F.lit(":"), _json(x.v))), "")
    word = F.regexp_replace(F.split(T.strip(first_of(L.RESPONSE_DECISIONS)), "\n")[0], r"^[ ,.\-_\"']+|[ ,.\-_\"']+$", "")
    fallback = body(in_prose, F.coalesce(Q.agent_decision(word), F.lit("N/A")), {k: _texts() for k in L.RESPONSE_LISTS}, F.concat(F.lit(',"raw_output":'), _quoted(F.substring(raw, 1, 1200)), F.lit(',"schema_valid":false')))
    return src.select(
        F.col("id").alias(id_col),
        F.when(F.col("e").isNull(), fallback).otherwise(body(number, decision, out, F.concat(extra, F.lit(',"schema_valid":true')))).alias("normalized"),
        F.when(F.col("e").isNull(), "fallback").when(major, "major").when(minor, "minor").otherwise("none").alias("severity"),
    )
