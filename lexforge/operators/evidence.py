"""Evidence ontology matching, ledgers and retention of evidence between two texts."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping
from itertools import batched

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexforge.functions import text as T
from lexforge.functions.kernels import plain
from lexforge.functions.lexicons import CONCERN_ENTITY, CONCERN_WEIGHTS, CONCERNS, ENTITIES, EVIDENCE_STOP, GOVERNANCE_TERMS, REASONS
from lexforge.functions.similarity import bind


ONTOLOGIES = {"entities": ENTITIES, "concerns": CONCERNS, "reasons": REASONS}


def pattern(aliases) -> str:
    """One pattern for all aliases, between edges that are no letter or digit."""
    return "(^|[^a-z0-9])(" + "|".join(re.escape(a) for a in sorted({plain(x) for x in aliases})) + ")($|[^a-z0-9])"


def met(canonical_text: Column, aliases) -> Column:
    """Whether an alias occurs between edges; the pattern is run only where the text holds one of them at all."""
    all_of = {plain(x) for x in aliases}
    least = sorted(a for a in all_of if not any(b != a and b in a for b in all_of))
    held = F.contains(canonical_text, F.lit(least[0]))
    for a in least[1:]:
        held = held | F.contains(canonical_text, F.lit(a))
    return held & canonical_text.rlike(pattern(aliases))


def _any_of(words) -> str:
    """A pattern of some words, the longest first where several fit: classes of first letters are tried, then letters, then words."""
    by: dict[str, list[str]] = {}
    for w in sorted(filter(None, words), key=lambda w: (-len(w), w)):
        by.setdefault(re.escape(w[0]), []).append(re.escape(w[1:]))
    of = lambda firsts: "|".join(f"{x}(?:{'|'.join(by[x])})" for x in firsts)
    return "|".join(f"(?=[{''.join(firsts)}])(?:{of(firsts)})" for firsts in batched(sorted(by), 8))


def _constant(values: Mapping[str, object], kind: str) -> Column:
    """A map from strings as one constant: as a column for each value the driver would take seconds to put it together."""
    return F.from_json(F.lit(json.dumps(values)), f"map<string,{kind}>")


def found(canonical_text: Column, ontologies: Mapping[str, Mapping[str, tuple]]) -> Column:
    """Struct of the sorted names by ontology whose aliases occur between edges that are no letter or digit; null holds none.

    The ontologies are constants, so this is one projection and no join, and one pass over the text for all of them: at each place it
    takes the longest alias. A shorter one that fits there too is the start of the longer, so a table tells the names of both.
    """
    named: dict[str, set] = {}
    for kind, names in ontologies.items():
        for name, aliases in names.items():
            for alias in aliases:
                named.setdefault(plain(alias), set()).add((kind, name))
    starts = lambda a: [b for b in named if a.startswith(b) and not re.match("[a-z0-9]", a[len(b) :])]
    told = {a: {kind: sorted({n for b in starts(a) for k, n in named[b] if k == kind}) for kind in ontologies} for a in named}
    table = _constant(told, f"struct<{', '.join(f'{kind}: array<string>' for kind in ontologies)}>")
    aliases = F.regexp_extract_all(F.coalesce(canonical_text, F.lit("")), F.lit(f"(?<![a-z0-9])(?=({_any_of(named)})(?![a-z0-9]))"), F.lit(1))
    names = lambda x, kind: F.sort_array(F.array_distinct(F.flatten(x[kind]))).alias(kind)
    return bind(F.transform(F.array_distinct(aliases), lambda a: F.element_at(table, a)), lambda x: F.struct(*[names(x, kind) for kind in ontologies]))


def hits(canonical_text: Column, ontology: dict) -> Column:
    """Sorted names of the ontology whose aliases occur."""
    return found(canonical_text, {"names": ontology})["names"]


def ledger(text: Column) -> Column:
    """Struct (entities, concerns, reasons); some concerns bring an entity along."""

    def close(x: Column) -> Column:
        brought = F.array_compact(F.array(*[F.when(F.array_contains(x.concerns, c), F.lit(e)) for c, e in CONCERN_ENTITY.items()]))
        return F.struct(F.sort_array(F.array_union(x.entities, brought)).alias("entities"), x.concerns.alias("concerns"), x.reasons.alias("reasons"))

    return bind(found(T.canonical(text), ONTOLOGIES), close)


def protected_terms(led: Column, limit: int = 80) -> Column:
    fixed = F.array(*[F.lit(x) for x in GOVERNANCE_TERMS])
    return F.slice(F.array_distinct(F.concat(led.concerns, fixed, led.entities, led.reasons)), 1, limit)


def ledger_text(led: Column) -> Column:
    part = lambda c: F.when(F.size(c) > 0, F.array_join(c, ", ")).otherwise("N/A")
    return F.concat(F.lit("EVIDENCE_LEDGER:\nentities: "), part(led.entities), F.lit("\nconcerns: "), part(led.concerns), F.lit("\nreasons: "), part(led.reasons))


def _tokens_of(name: str) -> list[str]:
    return sorted({t for t in re.findall(r"[a-z0-9+#/.-]+", plain(name)) if t not in EVIDENCE_STOP and len(t) > 1})


def retained(base: Column, text: Column, ontology: dict, share: float = 0.67) -> Column:
    """The names in base that text keeps: by an alias, or by at least share of the name's own tokens."""
    return retained_of({"names": base}, text, {"names": ontology}, share)["names"]


def retained_of(bases: Mapping[str, Column], text: Column, ontologies: Mapping[str, Mapping[str, tuple]], share: float = 0.67) -> Column:
    """retained() for several ontologies at once, as a struct; the text is read once for all."""
    named = {kind: {name: (*aliases, name) for name, aliases in names.items()} for kind, names in ontologies.items()}

    def kept(x: Column, kind: str) -> Column:
        # a canonical text's tokens stand between its spaces
        own = _constant({n: [f" {t} " for t in tokens] for n in ontologies[kind] if (tokens := _tokens_of(n))}, "array<string>")
        near = lambda tokens: F.size(F.filter(tokens, lambda t: F.contains(x.padded, t))) / F.size(tokens) >= share
        keeps = lambda n: F.array_contains(x.met[kind], n) | F.coalesce(bind(F.try_element_at(own, n), near), F.lit(False))
        return F.sort_array(F.array_distinct(F.filter(F.coalesce(bases[kind], F.array().cast("array<string>")), keeps))).alias(kind)

    read = bind(T.canonical(F.coalesce(text, F.lit(""))), lambda t: F.struct(found(t, named).alias("met"), F.concat(F.lit(" "), t, F.lit(" ")).alias("padded")))
    return bind(read, lambda x: F.struct(*[kept(x, kind) for kind in ontologies]))


def share_kept(base: Column, kept: Column) -> Column:
    return F.when(F.size(base) == 0, F.lit(100.0)).otherwise(100.0 * F.size(kept) / F.size(base))


def weighted_share(base: Column, kept: Column) -> Column:
    """100 * weight kept / weight at all; weights by concern, 1 where none is known."""
    weight = F.create_map(*[F.lit(x) for kv in CONCERN_WEIGHTS.items() for x in kv])
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + F.coalesce(F.try_element_at(weight, x), F.lit(1.0)))
    return F.when(F.size(base) == 0, F.lit(100.0)).otherwise(100.0 * total(kept) / total(base))


def with_ledger(df: DataFrame, text_col: str) -> DataFrame:
    """df with column ledger; the text is canonicalised once, before the ontology's patterns run over it."""
    return df.withColumn("ledger", ledger(F.col(text_col)))
