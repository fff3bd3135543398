"""Similarity functions as column expressions over arrays of tokens."""

from __future__ import annotations

import functools
import string
from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def kept(build: Callable[..., Column]) -> Callable[..., Column]:
    """build, its results kept for each application: a long expression over named columns is put together once on the driver."""
    made: dict[tuple, Column] = {}

    @functools.wraps(build)
    def get(*args) -> Column:
        key = (SparkSession.active().sparkContext.applicationId, *args)
        if key not in made:
            made[key] = build(*args)
        return made[key]

    return get


def bind(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with value worked out once a row, however often then uses it.

    A fold over nothing, whose end is then(). An element of a transformed array would do the same, but taking an element asks for
    the array's type, which Spark works out anew for each row over all of then's expression and over those nested in it.
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda v, _: v, then)


def counts(tokens: Column) -> Column:
    """Sorted array of (t, n): each distinct token and how often it occurs. One sort, then run lengths."""

    def runs(s: Column) -> Column:
        starts = F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (F.get(s, i - 1) != x), F.struct(x.alias("t"), i.alias("i")))), lambda e: e.isNotNull())
        return bind(starts, lambda st: F.transform(st, lambda e, j: F.struct(e.t.alias("t"), (F.coalesce(F.get(st, j + 1)["i"], F.size(s)) - e.i).cast("long").alias("n"))))

    return bind(F.sort_array(tokens), runs)


def square_sum(c: Column) -> Column:
    """Sum of squared counts of counts()."""
    return F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x.n * x.n)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of the token counts of two arrays; 0 where one is empty. Integer sums, so no order of addition matters."""
    return counted_cosine(counts(a), counts(b))


def counted_cosine(a: Column, b: Column) -> Column:
    """cosine() of two results of counts(): the sorted lists are merged, where a shared token's counts stand side by side."""

    def of(p: Column) -> Column:
        dot = bind(F.sort_array(F.concat(p.a, p.b)), lambda m: F.aggregate(F.transform(m, lambda x, i: F.when(F.get(m, i + 1)["t"] == x.t, x.n * F.get(m, i + 1)["n"]).otherwise(0)), F.lit(0).cast("long"), lambda s, x: s + x))
        return F.when((F.size(p.a) == 0) | (F.size(p.b) == 0), F.lit(0.0)).otherwise(dot / F.sqrt((square_sum(p.a) * square_sum(p.b)).cast("double")))

    return bind(F.struct(a.alias("a"), b.alias("b")), of)


def jaccard(a: Column, b: Column, both_empty: float = 1.0) -> Column:
    """Jaccard similarity of two arrays as sets; both_empty where neither has any, 0 where one has none."""

    def of(p: Column) -> Column:
        n, m, both = F.size(p.a), F.size(p.b), F.size(F.array_intersect(p.a, p.b))
        return F.when((n == 0) & (m == 0), F.lit(both_empty)).when((n == 0) | (m == 0), F.lit(0.0)).otherwise(bind(both, lambda k: k / (n + m - k)))

    return bind(F.struct(F.array_distinct(a).alias("a"), F.array_distinct(b).alias("b")), of)


def lexical_tokens(c: Column) -> Column:
    # each character is named: Java takes longer for a class that mixes ranges and single characters
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(f"[{string.ascii_lowercase}{string.digits}_+#.-]+"), F.lit(0)))


def lexical(a: Column, b: Column) -> Column:
    return jaccard(lexical_tokens(a), lexical_tokens(b), 0.0)


def dense_dot(a: Column, b: Column) -> Column:
    """Inner product of two number arrays of one length."""
    return F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)


def dense_cosine(a: Column, b: Column) -> Column:
    """Cosine of two number arrays of one length."""
    return F.try_divide(dense_dot(a, b), F.sqrt(dense_dot(a, a)) * F.sqrt(dense_dot(b, b)))


def entropy(tokens: Column) -> Column:
    """Shannon entropy in bits of the token counts of an array; null where it is empty, plain zero for one token."""

    def of(c: Column) -> Column:
        total = F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x.n)
        bits = bind(total, lambda n: F.aggregate(c, F.lit(0.0), lambda s, x: s - x.n / n * F.log2(x.n / n)))
        return F.when(F.size(c) > 0, F.abs(bits))

    return bind(counts(tokens), of)


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
