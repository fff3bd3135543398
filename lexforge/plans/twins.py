"""DuckDB twins of the longer plans: folds over chunks, budgets and compression, written as recursive queries."""

from __future__ import annotations

from lexforge.functions import lexicons as L
from lexforge.plans import compress as C
from lexforge.plans.catalog import _SHORT, _SKILLS, _TF, CANON, FOLD, SENTENCES, SQUEEZE, STOP, STRIP, WORDS, f, quoted, sql
from lexforge.plans.chains import _LEDGER, _hit_sql

ORACLES: dict[str, str] = {}


def distinct(items: str) -> str:
    """A list's values in the order of their first places."""
    return f"list_transform(list_filter(list_transform({items}, lambda v, i: {{'v': v, 'i': i}}), lambda x: list_position({items}, x.v) = x.i), lambda x: x.v)"


def squeezed(t: str) -> str:
    return f(SQUEEZE, t)


def cleaned(t: str) -> str:
    for p in L.CLEANUP_PHRASES:
        t = f"regexp_replace({t}, '(?i)\\b{p}\\b', '', 'g')"
    return squeezed(rf"regexp_replace(regexp_replace({t}, '\s+([,.;:])', '\1', 'g'), '(?i)\b(really|very|properly|clearly)\b', '', 'g')")


def approx(t: str) -> str:
    return f"CAST(CASE WHEN length({t}) = 0 THEN 0 ELSE greatest(1, length({t}) // 4) END AS BIGINT)"


def keyword_set(t: str) -> str:
    return f"list_distinct(list_filter(list_transform(regexp_extract_all({t}, '[A-Za-z][A-Za-z0-9_+#.-]{{2,}}'), lambda x: lower(x)), lambda x: x NOT IN ({quoted(L.KEYWORD_STOP)})))"


def line_chunks(t: str) -> str:
    lines = rf"list_filter(list_transform(regexp_split_to_array({t}, '\n+'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"
    return f"flatten(list_transform({lines}, lambda b: CASE WHEN length(b) < 240 THEN [b] ELSE {f(SENTENCES, 'b')} END))"


def lexical_fold(units: str, keys: str, threshold: float) -> str:
    """CTEs from units (keys, pos, s): r has (keys, pos = the last one, gone, top), gone being the places that go."""
    k = keys.split(", ")
    on = lambda a, b: " AND ".join(f"{a}.{x} = {b}.{x}" for x in k)
    of = lambda a: ", ".join(f"{a}.{x}" for x in k)
    return f"""lt AS MATERIALIZED (SELECT DISTINCT {keys}, pos, unnest(regexp_extract_all(lower(s), '[a-zA-Z0-9_+#.-]+')) AS w, list_bool_or(list_transform([{quoted(L.POLARITY_TERMS)}], lambda x: contains(lower(s), x))) AS neg FROM {units}),
ln AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY {keys}, pos) AS n FROM lt),
le AS MATERIALIZED (SELECT {of("a")}, a.pos AS a, b.pos AS b FROM ln a JOIN ln b ON {on("a", "b")} AND a.w = b.w AND a.neg = b.neg AND b.pos < a.pos AND a.n * {threshold} < b.n AND b.n * {threshold} < a.n
  GROUP BY {of("a")}, a.pos, b.pos, a.n, b.n HAVING count(*) / (a.n + b.n - count(*)) > {threshold}),
near AS (SELECT {keys}, a, list(b) AS bs FROM le GROUP BY ALL),
m AS (SELECT {keys}, max(pos) AS top FROM {units} GROUP BY ALL),
r AS (SELECT {keys}, CAST(-1 AS BIGINT) AS pos, CAST([] AS BIGINT[]) AS gone, top FROM m
  UNION ALL SELECT {of("r")}, r.pos + 1, CASE WHEN near.bs IS NOT NULL AND len(list_filter(near.bs, lambda b: NOT list_contains(r.gone, b))) > 0 THEN list_append(r.gone, r.pos + 1) ELSE r.gone END, r.top
  FROM r LEFT JOIN near ON {on("near", "r")} AND near.a = r.pos + 1 WHERE r.pos < r.top)"""


_TWICE = "(text || chr(10) || text)"
ORACLES["polarity_dedup"] = f"""WITH RECURSIVE u AS (SELECT conv_id, turn, unnest({line_chunks(_TWICE)}) AS s, generate_subscripts({line_chunks(_TWICE)}, 1) - 1 AS pos FROM conversations),
{lexical_fold("u", "conv_id, turn", 0.88)}
SELECT conv_id, turn, CAST(top + 1 - len(gone) AS BIGINT) AS kept, CAST(len(gone) AS BIGINT) AS removed FROM r WHERE pos = top"""

ORACLES["diversity_select"] = sql(
    """WITH RECURSIVE {{tf}},
u AS (SELECT item_id, doc_id, r - 1 AS pos FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(similarity, 9) DESC, doc_id) AS r FROM sim) WHERE r <= 20),
e AS (SELECT a.item_id, a.pos AS a, b.pos AS b FROM u a JOIN u b ON a.item_id = b.item_id AND b.pos < a.pos JOIN d x ON x.doc_id = a.doc_id JOIN d y ON y.doc_id = b.doc_id AND y.w = x.w JOIN dn p ON p.doc_id = a.doc_id JOIN dn q ON q.doc_id = b.doc_id
  GROUP BY ALL HAVING sum(x.n * y.n) / sqrt(CAST(any_value(p.x) * any_value(q.x) AS DOUBLE)) >= 0.9),
near AS (SELECT item_id, a, list(b) AS bs FROM e GROUP BY ALL),
m AS (SELECT item_id, max(pos) AS top FROM u GROUP BY ALL),
r AS (SELECT item_id, CAST(-1 AS BIGINT) AS pos, CAST([] AS BIGINT[]) AS gone, top FROM m
  UNION ALL SELECT r.item_id, r.pos + 1, CASE WHEN near.bs IS NOT NULL AND len(list_filter(near.bs, lambda b: NOT list_contains(r.gone, b))) > 0 THEN list_append(r.gone, r.pos + 1) ELSE r.gone END, r.top
  FROM r LEFT JOIN near ON near.item_id = r.item_id AND near.a = r.pos + 1 WHERE r.pos < r.top)
SELECT u.item_id, u.doc_id, CAST(u.pos AS INT) AS pos, NOT list_contains(r.gone, u.pos) AS kept FROM u JOIN r ON r.item_id = u.item_id AND r.pos = r.top""",
    tf=_TF,
)

_WHOLE = distinct(f"list_concat(concerns, [{quoted(L.GOVERNANCE_TERMS)}], entities, reasons)")
_PART = lambda c: f"CASE WHEN len({c}) > 0 THEN array_to_string({c}, ', ') ELSE 'N/A' END"
ORACLES["protected_terms"] = f"""WITH {_LEDGER} SELECT o_orderkey, array_to_string(({_WHOLE})[1:80], '|') AS terms,
'EVIDENCE_LEDGER:' || chr(10) || 'entities: ' || {_PART("entities")} || chr(10) || 'concerns: ' || {_PART("concerns")} || chr(10) || 'reasons: ' || {_PART("reasons")} AS rendered FROM ledger"""

_ENTITIES = r"list_filter(regexp_extract_all(t, '\b[A-Z][a-zA-Z0-9&.-]+(?:\s+[A-Z][a-zA-Z0-9&.-]+){0,4}\b'), lambda x: lower(x) NOT IN (" + STOP + "))"
_CODES = r"regexp_extract_all(t, '\b[A-Z]{1,6}[-_]?[0-9]{1,8}[A-Z0-9-]*\b')"
ORACLES["entity_retention"] = sql(
    """WITH i AS (SELECT item_id, {{short}} AS s, {{fold}} AS t FROM benchmark),
q AS (SELECT item_id, unnest(list_distinct(list_concat({{e}}, {{c}}))) AS x FROM i),
hw AS (SELECT item_id, w, count(*) AS n FROM (SELECT item_id, unnest({{ws}}) AS w FROM i) WHERE w NOT IN ({{stop}}) GROUP BY ALL),
hn AS (SELECT item_id, sum(n * n) AS z FROM hw GROUP BY ALL),
xw AS (SELECT item_id, x, w, count(*) AS n FROM (SELECT item_id, x, unnest({{wx}}) AS w FROM q) WHERE w NOT IN ({{stop}}) GROUP BY ALL),
xn AS (SELECT item_id, x, sum(n * n) AS z FROM xw GROUP BY ALL),
dot AS (SELECT xw.item_id, xw.x, sum(xw.n * hw.n) AS d FROM xw JOIN hw ON hw.item_id = xw.item_id AND hw.w = xw.w GROUP BY ALL),
hit AS (SELECT q.item_id, contains(lower(i.s), lower(q.x)) OR coalesce(dot.d / sqrt(CAST(xn.z * hn.z AS DOUBLE)), 0.0) >= 0.5 AS ok
  FROM q JOIN i ON i.item_id = q.item_id LEFT JOIN dot ON dot.item_id = q.item_id AND dot.x = q.x LEFT JOIN xn ON xn.item_id = q.item_id AND xn.x = q.x LEFT JOIN hn ON hn.item_id = q.item_id)
SELECT i.item_id, round(coalesce(avg(CASE WHEN ok THEN 1.0 WHEN NOT ok THEN 0.0 END), 1.0), 6) AS retention FROM i LEFT JOIN hit ON hit.item_id = i.item_id GROUP BY i.item_id""",
    short=f(_SHORT), fold=f(FOLD), e=_ENTITIES, c=_CODES, ws=f(WORDS, "s"), wx=f(WORDS, "x"), stop=STOP,
)

_NUMBERS = r"list_distinct(regexp_extract_all(z, '[$₹€£]?\b\d+(?:[,.]\d+)*(?:%|\b)'))"
ORACLES["top_sentences"] = sql(
    r"""WITH s AS (SELECT item_id, unnest({{s}}) AS s, generate_subscripts({{s}}, 1) AS i FROM benchmark),
k AS (SELECT item_id, s, i, length(s) AS n, 2 * least(8, len({{num}})) + 2 * least(4, len(list_distinct(regexp_extract_all(z, '\b[A-Z]{1,6}[-_]?[0-9]{1,8}[A-Z0-9-]*\b')))) + CASE WHEN list_bool_or(list_transform([{{cues}}], lambda c: contains(lower(s), c))) THEN 3 ELSE 0 END AS k
  FROM (SELECT *, {{fold}} AS z FROM s)),
o AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY k DESC, n, i) AS r FROM k)
SELECT b.item_id, coalesce(string_agg(o.s, '|' ORDER BY o.r) FILTER (WHERE o.r <= 3), '') AS sentences FROM benchmark b LEFT JOIN o ON o.item_id = b.item_id GROUP BY b.item_id""",
    s=f(SENTENCES, f(STRIP)), num=_NUMBERS, cues=quoted(L.SENTENCE_CUES), fold=f(FOLD, "s"),
)


# -- guarded compression ------------------------------------------------------------------------------------

TASK = "Extract strengths and hiring risks."


def present(terms: str, low: str, name: str) -> str:
    return f"list_filter({terms}, lambda {name}: contains({low}, lower({name})))"


def guarded(low: str, folded: str) -> str:
    """Best ranked guarded terms of a text (low: in lower case, folded: with other letters than a-z as word characters)."""
    fixed = present(f"[{quoted(sorted({*L.DOMAIN_TERMS, *L.QUALITY_PHRASES}))}]", low, "g")
    named = [f"list_transform(regexp_extract_all({folded}, '(?i){p}'), lambda g: lower({f(STRIP, 'g')}))" for p in L.TECH_PATTERNS]
    some = lambda cues: f"CASE WHEN list_bool_or(list_transform([{quoted(cues)}], lambda h: contains(g, h))) THEN 1 ELSE 0 END"
    rank = f"{C.RANK_DOMAIN} * (CASE WHEN g IN ({quoted(L.DOMAIN_TERMS)}) THEN 1 ELSE 0 END) + {C.RANK_HIGH} * {some(L.PRIORITY_HIGH)} + {C.RANK_SKILL} * {some(L.PRIORITY_SKILL)}"
    ranked = f"list_sort(list_transform(list_distinct(list_concat({fixed}, {', '.join(named)})), lambda g: {{'r': -({rank}), 't': g}}))"
    return f"list_transform(({ranked})[1:{C.GUARDED_TERMS}], lambda x: x.t)"


def critical(low: str, terms: str, name: str) -> str:
    return f"(regexp_matches({low}, '\\b({L.CRITICAL_WORDS})\\b') OR len({present(terms, low, name)}) >= {C.CRITICAL_TERMS})"


def _guarded_compress() -> str:
    phrases = f"([{quoted(_SKILLS)}])"
    extra = " || '. ' || ".join(f"{phrases}[CAST((doc_id * {k} + {s}) % {len(_SKILLS)} AS INT) + 1]" for k, s in ((1, 0), (3, 1), (5, 2)))
    text = f"text || chr(10) || {extra} || '. Please note ' || (doc_id % 9) || ' years.'"
    prefixes = "|".join(p.replace("/", "\\/") for p in L.CONTRACT_PREFIXES)
    stripped = rf"list_filter(string_split(t, chr(10)), lambda x: NOT regexp_matches(x, '^\s*({prefixes})'))"
    led = distinct(f"list_concat(concerns, [{quoted(L.GOVERNANCE_TERMS)}], entities, reasons)")
    wanted = f"list_concat({keyword_set(quoted([TASK]))}, terms)"
    w = {k: f"CAST({v} AS DOUBLE)" for k, v in C.WORTH.items()}
    flag = lambda cond, key: f"CASE WHEN {cond} THEN {w[key]} ELSE CAST(0 AS DOUBLE) END"
    worth = " + ".join(
        [
            f"{w['wanted']} * len(list_intersect({keyword_set('s')}, wanted))",
            f"{w['term']} * len({present('terms', 'low', 'p')})",
            flag(rf"regexp_matches(low, '\d+(\.\d+)?\s*(years?|%|lpa|score|tokens?)')", "quantity"),
            flag(f"list_bool_or(list_transform([{quoted(L.POLARITY_TERMS)}], lambda x: contains(low, x)))", "polarity"),
            flag(f"regexp_matches(low, '\\b({L.SIGNAL_WORDS})\\b')", "signal"),
            flag(f"length(s) > {C.LONG_CHUNK}", "long"),
        ]
    )
    aside = r"regexp_replace({t}, '(?i)\b(this demonstrates|this shows|it indicates that|overall,?)\b', '', 'g')"
    kept_parts = f"list_filter(list_transform(list_filter(regexp_split_to_array(tidy, '[,;]'), lambda q, i: i <= {C.LEADING_PARTS} OR {critical('lower(q)', 'own', 'v')}), lambda q: {f(STRIP, 'q')}), lambda q: q <> '')"
    header = f"'MANDATORY_EVIDENCE_TERMS: ' || array_to_string(terms[1:{C.HEADER_TERMS}], ', ')"
    contract = " || chr(10) || ".join(quoted([x]) for x in L.CONTRACT_LINES)
    missing = lambda low: f"list_filter(terms, lambda m: NOT contains({low}, lower(m)))"
    both = lambda a, b: f"list_sort(list_intersect({keyword_set(a)}, {keyword_set(b)}))"
    return f"""WITH RECURSIVE src AS MATERIALIZED (SELECT doc_id, {text} AS t FROM documents),
o AS MATERIALIZED (SELECT doc_id, {squeezed(f"CASE WHEN len({stripped}) > 0 THEN array_to_string({stripped}, chr(10)) ELSE t END")} AS original FROM src),
b AS MATERIALIZED (SELECT *, {approx("original")} AS before, original || chr(10) || '{TASK}' AS whole FROM o),
c AS MATERIALIZED (SELECT *, {f(CANON, "whole")} AS c, {f(FOLD, "whole")} AS folded, lower(whole) AS low FROM b),
h AS MATERIALIZED (SELECT *, {_hit_sql(L.ENTITIES)} AS e0, {_hit_sql(L.CONCERNS)} AS concerns, {_hit_sql(L.REASONS)} AS reasons FROM c),
led AS MATERIALIZED (SELECT *, list_sort(list_distinct(list_concat(e0, list_filter([{", ".join(f"CASE WHEN list_contains(concerns, '{k}') THEN '{v}' END" for k, v in L.CONCERN_ENTITY.items())}], lambda x: x IS NOT NULL)))) AS entities FROM h),
led2 AS MATERIALIZED (SELECT *, ({led})[1:{C.MOST_TERMS}] AS ledger, {guarded("low", "folded")} AS guarded FROM led),
led3 AS MATERIALIZED (SELECT *, list_concat(ledger, guarded, [{quoted(L.GOVERNANCE_TERMS)}]) AS every FROM led2),
t AS MATERIALIZED (SELECT doc_id, original, before, ({distinct("every")})[1:{C.MOST_TERMS}] AS terms FROM led3),
big AS MATERIALIZED (SELECT *, {wanted} AS wanted, greatest({C.LEAST}, CAST(floor(before * CAST({C.RATIOS["guarded"]} AS DOUBLE)) AS BIGINT)) AS target FROM t WHERE before > {C.SHORT}),
u AS MATERIALIZED (SELECT doc_id, unnest({line_chunks("original")}) AS s, generate_subscripts({line_chunks("original")}, 1) - 1 AS pos FROM big),
{lexical_fold("u", "doc_id", C.SAME)},
fate AS MATERIALIZED (SELECT u.doc_id, u.pos, u.s, lower(u.s) AS low, list_contains(r.gone, u.pos) AS gone FROM u JOIN r ON r.doc_id = u.doc_id AND r.pos = r.top),
flags AS MATERIALIZED (SELECT fate.doc_id, fate.pos, fate.s, {critical("low", "terms", "p")} AS critical, {worth} AS worth, {aside.format(t=cleaned("s"))} AS tidy FROM fate JOIN big ON big.doc_id = fate.doc_id WHERE NOT fate.gone),
cut AS MATERIALIZED (SELECT *, CAST([] AS VARCHAR[]) AS own FROM flags WHERE length(tidy) <= {C.WHOLE_CHUNK} UNION ALL SELECT * EXCLUDE (tl, tf), {guarded("tl", "tf")} AS own FROM (SELECT *, lower(tidy) AS tl, {f(FOLD, "tidy")} AS tf FROM flags WHERE length(tidy) > {C.WHOLE_CHUNK})),
small AS MATERIALIZED (SELECT doc_id, pos, critical, CASE WHEN critical THEN CAST(0 AS DOUBLE) ELSE -worth END AS rank, CASE WHEN length(tidy) <= {C.WHOLE_CHUNK} THEN tidy ELSE left(array_to_string({kept_parts}, '; '), {C.CUT_CHUNK}) END AS compact FROM cut),
once AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, compact ORDER BY NOT critical, rank, pos) AS k FROM small) WHERE k = 1),
ranked AS MATERIALIZED (SELECT doc_id, pos, critical, compact, {approx("compact")} AS size, row_number() OVER (PARTITION BY doc_id ORDER BY NOT critical, rank, pos) AS r FROM once),
fold AS (SELECT doc_id, CAST(0 AS BIGINT) AS r, CAST(0 AS BIGINT) AS used, CAST(0 AS BIGINT) AS n, false AS isfull, target, CAST([] AS BIGINT[]) AS places FROM big
  UNION ALL SELECT doc_id, r, CASE WHEN add THEN used + size ELSE used END, CASE WHEN add THEN n + 1 ELSE n END, isfull OR (NOT critical AND CASE WHEN add THEN used + size ELSE used END >= target AND CASE WHEN add THEN n + 1 ELSE n END >= {C.ENOUGH}), target, CASE WHEN add THEN list_append(places, pos) ELSE places END
  FROM (SELECT fold.doc_id, fold.r + 1 AS r, fold.used, fold.n, fold.isfull, fold.target, fold.places, ranked.size, ranked.pos, ranked.critical, ranked.critical OR (NOT fold.isfull AND fold.used + ranked.size <= fold.target) AS add FROM fold JOIN ranked ON ranked.doc_id = fold.doc_id AND ranked.r = fold.r + 1)),
picked AS (SELECT doc_id, places FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY r DESC) AS k FROM fold) WHERE k = 1),
body AS (SELECT ranked.doc_id, string_agg('- ' || compact, chr(10) ORDER BY pos) AS body FROM ranked JOIN picked ON picked.doc_id = ranked.doc_id AND list_contains(picked.places, ranked.pos) GROUP BY ranked.doc_id),
draft AS MATERIALIZED (SELECT big.doc_id, original, before, terms, {cleaned(f"{contract} || chr(10) || {header} || chr(10) || 'PRESERVED_EVIDENCE:' || chr(10) || coalesce(body, '')")} AS draft FROM big LEFT JOIN body ON body.doc_id = big.doc_id),
low_draft AS MATERIALIZED (SELECT *, {missing("low")} AS absent FROM (SELECT *, lower(draft) AS low FROM draft)),
gone AS (SELECT doc_id, list(left(s, {C.PREVIEW}) ORDER BY pos) AS gone FROM fate WHERE gone GROUP BY doc_id),
done AS MATERIALIZED (SELECT doc_id, original, before, terms, CASE WHEN len(terms) > 0 THEN {squeezed(f"{header} || chr(10) || {cleaned('original')}")} ELSE {cleaned("original")} END AS optimized FROM t WHERE before <= {C.SHORT}
  UNION ALL SELECT doc_id, original, before, terms, CASE WHEN len(absent) > 0 THEN {squeezed(f"draft || chr(10) || 'MANDATORY_RETAINED_TERMS: ' || array_to_string(absent[1:{C.FOOTER_TERMS}], ', ')")} ELSE draft END FROM low_draft),
last AS (SELECT *, {missing("low")} AS absent FROM (SELECT *, lower(optimized) AS low FROM done))
SELECT last.doc_id, md5(optimized) AS optimized_md5, before AS tokens_before, {approx("optimized")} AS tokens_after,
  round(CASE WHEN before > 0 THEN (1 - {approx("optimized")} / before) * 100 ELSE 0.0 END, 4) AS reduction_pct, array_to_string(({both("original", "optimized")})[1:{C.MOST_PRESERVED}], '|') AS preserved,
  coalesce(array_to_string(gone.gone[1:{C.MOST_REMOVED}], '|'), '') AS removed, array_to_string(terms, '|') AS protected, len(absent) = 0 AS guard_passed, CAST(len(absent[1:{C.FOOTER_TERMS}]) AS BIGINT) AS n_missing
FROM last LEFT JOIN gone ON gone.doc_id = last.doc_id"""


ORACLES["guarded_compress"] = _guarded_compress()

