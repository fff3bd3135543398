"""How much of an original text's information an optimized one retains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexforge.functions import lexicons as L
from lexforge.functions import text as T
from lexforge.functions.similarity import bind, clamp, cosine, counted_cosine, counts, square_sum


def _share(required: Column, found) -> Column:
    return F.when(F.size(required) == 0, F.lit(1.0)).otherwise(F.size(F.filter(required, found)) / F.size(required))


def digits(c: Column) -> Column:
    # runs, not single characters: each match is a step of its own
    return F.regexp_replace(c, "[^0-9.]+", "")


# -- measures over a struct of what they need ---------------------------------------------------------------------


def _numeric(x: Column) -> Column:
    return _share(x.numbers, lambda n: F.contains(x.text, n) | ((digits(n) != "") & F.contains(x.digits, digits(n))))


def _keyword(x: Column) -> Column:
    return F.when(F.size(x.keywords) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(x.keywords, x.words)) / F.size(x.keywords))


def _entity(x: Column, least: float = 0.5) -> Column:
    def near(phrase: Column) -> Column:
        dot = lambda o: F.aggregate(o, F.lit(0).cast("long"), lambda s, e: s + e.n * F.coalesce(F.try_element_at(x.have, e.t), F.lit(0).cast("long")))
        return bind(counts(T.words(phrase)), lambda o: F.when((F.size(o) == 0) | (x.norm == 0), F.lit(0.0)).otherwise(dot(o) / F.sqrt((square_sum(o) * x.norm).cast("double"))))

    return _share(x.entities, lambda p: F.when(F.contains(x.low, F.lower(p)), F.lit(True)).otherwise(near(p) >= least))


# -- fixed values: what an atom's score is made of ---------------------------------------------------------------
GROUP_ENOUGH, TERMS_ENOUGH, BY_TERMS, BY_GROUP, BY_LITTLE = 0.25, 0.65, 0.85, 0.55, 0.45


def _constraint(x: Column) -> Column:
    weights = F.create_map(*[F.lit(x) for kv in L.ATOM_WEIGHTS.items() for x in kv])
    cues = F.create_map(*[x for g, words in L.GROUP_SYNONYMS.items() for x in (F.lit(g), T.words_in(words))])

    def score(a: Column) -> Column:
        terms = F.filter(a.terms, lambda t: F.length(t) >= 3)
        aims = F.size(terms) + F.size(a.numbers)
        hits = F.size(F.filter(terms, lambda t: F.contains(x.low, t))) + F.size(F.filter(a.numbers, lambda n: F.contains(x.low, F.lower(n)) | F.contains(x.digits, digits(n))))
        met = F.when(aims > 0, hits / aims).otherwise(1.0)
        group = F.exists(F.coalesce(F.try_element_at(cues, a.group), F.array().cast("array<string>")), lambda w: F.contains(x.low, w))
        return bind(F.struct(met.alias("met"), group.alias("group")), lambda s: F.when(s.group & (s.met >= GROUP_ENOUGH), 1.0).when(s.met >= TERMS_ENOUGH, BY_TERMS).when(s.group, BY_GROUP).otherwise(F.least(F.lit(BY_LITTLE), s.met)))

    weight = lambda a: F.coalesce(F.try_element_at(weights, a.group), F.lit(1.0))
    total = lambda f: F.aggregate(x.atoms, F.lit(0.0), lambda s, a: s + f(a))
    return F.when(F.size(x.atoms) == 0, F.lit(1.0)).otherwise(total(lambda a: weight(a) * score(a)) / total(weight))


def _bag(c: Column) -> list[Column]:
    """Fields have and norm of counts()."""
    return [F.map_from_arrays(F.transform(c, lambda e: e.t), F.transform(c, lambda e: e.n)).alias("have"), square_sum(c).alias("norm")]


# -- one measure of two texts ----------------------------------------------------------------------------------------


def numeric(original: Column, optimized: Column) -> Column:
    """Share of the original's numbers that occur, or whose digits occur among the digits of the optimized text."""
    return bind(F.struct(T.numbers(original).alias("numbers"), optimized.alias("text"), digits(optimized).alias("digits")), _numeric)


def keyword(original: Column, optimized: Column) -> Column:
    return bind(F.struct(T.keywords(original).alias("keywords"), T.all_words(optimized).alias("words")), _keyword)


def entity(original: Column, optimized: Column, least: float = 0.5) -> Column:
    """Share of the original's entities and codes that occur, or whose words have that cosine with the optimized text."""
    required = F.array_union(T.entities(original), T.codes(original))
    both = bind(counts(T.words(optimized)), lambda c: F.struct(required.alias("entities"), F.lower(optimized).alias("low"), *_bag(c)))
    return bind(both, lambda x: _entity(x, least))


def semantic(original: Column, optimized: Column) -> Column:
    return cosine(T.words(original), T.words(optimized))


def constraint(original: Column, optimized: Column) -> Column:
    """Weighted mean of how well the original's constraint atoms are met: by their terms and numbers, and by words of their group."""
    low = F.lower(optimized)
    return bind(F.struct(T.constraint_atoms(original).alias("atoms"), low.alias("low"), digits(low).alias("digits")), _constraint)


# -- all measures of one text against facts kept from another ------------------------------------------------------------

MEASURES = ("retention", "entity", "numeric", "constraint", "semantic", "keyword")


def facts(original: Column) -> Column:
    """What all measures need of an original: struct (entities, numbers, keywords, atoms, counts)."""
    required = F.array_union(T.entities(original), T.codes(original))
    of = lambda w, c: F.struct(required.alias("entities"), T.numbers(original).alias("numbers"), T.best_words(c).alias("keywords"), T.atoms_in(w).alias("atoms"), counts(c).alias("counts"))
    # bound: the text's words are found once for all that need them
    return bind(T.all_words(original), lambda w: bind(T.content(w), lambda c: of(w, c)))


def measures(of: Column, text: Column) -> Column:
    """Struct MEASURES of a text against facts() of its original; they are worked out once, however many texts are tried."""

    def all_of(x: Column) -> Column:
        one = {"entity": _entity(x), "numeric": _numeric(x), "constraint": _constraint(x), "semantic": counted_cosine(x.counts, x.own), "keyword": _keyword(x)}
        return bind(F.struct(*[clamp(c).alias(k) for k, c in one.items()]), whole)

    def whole(m: Column) -> Column:
        total = sum((F.lit(w) * m[k] for k, w in L.RETENTION_WEIGHTS.items()), F.lit(0.0))
        return F.struct(F.least(F.lit(1.0), total).alias("retention"), *[m[k].alias(k) for k in MEASURES[1:]])

    fixed = [of[k].alias(k) for k in ("entities", "numbers", "keywords", "atoms", "counts")]
    seen = lambda t, w, c: F.struct(*fixed, t.alias("text"), F.lower(t).alias("low"), digits(t).alias("digits"), w.alias("words"), c.alias("own"), *_bag(c))
    return bind(text, lambda t: bind(bind(T.all_words(t), lambda w: bind(counts(T.content(w)), lambda c: seen(t, w, c))), all_of))


def scores(df: DataFrame, id_col: str, original: str, optimized: str) -> DataFrame:
    """All measures and their weighted sum for each row: (id_col, retention, entity, numeric, constraint, semantic, keyword).

    Columns alone; a null text counts as empty, and null or repeated ids keep a row each.
    """
    a, b = F.coalesce(F.col(original), F.lit("")), F.coalesce(F.col(optimized), F.lit(""))
    out = df.select(F.col(id_col).alias("id"), facts(a).alias("f"), b.alias("b")).select("id", measures(F.col("f"), F.col("b")).alias("m"))
    return out.select(F.col("id").alias(id_col), *[F.col(f"m.{k}").alias(k) for k in MEASURES])
