"""Budgeted selection per request: knapsack and first fit as folds over a request's items, in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexforge.functions.similarity import bind


def first_fit(items: Column, budget: Column) -> Column:
    """Of an array of structs (idx, cost) in order, the idx that fit; what doesn't fit is passed over. JVM-side fold."""
    state = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        fits = s.used + x.cost <= budget
        return F.struct(F.when(fits, s.used + x.cost).otherwise(s.used).alias("used"), F.when(fits, F.array_append(s.out, x.idx)).otherwise(s.out).alias("out"))

    return F.aggregate(items, state, step, lambda s: s.out)


def best_fit(items: Column, budget: Column) -> Column:
    """Places (from 0, ascending) of the exact best subset of an array of structs (value, cost) within an integer budget.

    Values count in ten-thousandths, rounded half to even; items worth nothing are never taken, a cost is 1 at least, and of
    equal sets the one of less cost stays, then the one without the later items. Dynamic programming over an array of budget + 1
    sums, with a row of choice bits for each item to walk back on. Where all items fit, all of worth are taken at once.
    """
    long = lambda c: c.cast("long")
    scaled = F.transform(items, lambda x: F.struct(F.greatest(F.lit(0), F.coalesce(long(F.bround(x.value * 10_000, 0)), F.lit(0))).cast("long").alias("value"), F.greatest(F.lit(1), F.coalesce(long(x.cost), F.lit(0))).cast("long").alias("cost")))
    none = F.array().cast("array<int>")

    def solve(x: Column) -> Column:
        start = F.struct(F.array_repeat(long(F.lit(0)), (x.room + 1).cast("int")).alias("best"), F.array().cast("array<array<boolean>>").alias("took"))

        def step(s: Column, it: Column) -> Column:
            shifted = F.concat(F.array_repeat(long(F.lit(-1)), it.cost.cast("int")), F.slice(s.best, F.lit(1), (x.room + 1 - it.cost).cast("int")))
            taken = F.transform(shifted, lambda v: F.when(v >= 0, v + it.value).otherwise(v))
            better = lambda t: F.struct(F.zip_with(s.best, t, lambda p, q: F.greatest(p, q)).alias("best"), F.array_append(s.took, F.zip_with(s.best, t, lambda p, q: q > p)).alias("took"))
            return F.when((it.cost <= x.room) & (it.value > 0), bind(taken, better)).otherwise(F.struct(s.best.alias("best"), F.array_append(s.took, F.array().cast("array<boolean>")).alias("took")))

        def back(s: Column) -> Column:
            order = F.reverse(F.transform(x.items, lambda it, i: F.struct(i.alias("i"), it.cost.alias("cost"))))
            begin = F.struct((F.array_position(s.best, F.array_max(s.best)) - 1).cast("int").alias("room"), none.alias("out"))
            took = lambda w, o: F.coalesce(F.get(F.get(s.took, o.i), w.room), F.lit(False))
            walk = lambda w, o: F.when(took(w, o), F.struct((w.room - o.cost).cast("int").alias("room"), F.array_prepend(w.out, o.i).alias("out"))).otherwise(w)
            return F.aggregate(order, begin, walk, lambda w: w.out)

        return F.aggregate(x["items"], start, step, back)

    def begin(x: Column) -> Column:
        worth = F.filter(F.transform(x["items"], lambda it, i: F.when(it.value > 0, i)), lambda i: i.isNotNull())
        return F.when(x.room <= 0, none).when(x.total <= x.room, worth).otherwise(solve(x))

    total = lambda s: F.aggregate(s, long(F.lit(0)), lambda a, it: a + it.cost)
    return bind(bind(scaled, lambda s: F.struct(s.alias("items"), long(budget).alias("room"), total(s).alias("total"))), begin)


def knapsack(chunks: DataFrame, request: str, idx: str, value: str, cost: str, budget: str) -> DataFrame:
    """chunks with column chosen: the exact best subset of each request within its budget, items in order of idx.

    A request's rows are one row for the fold (a request is a prompt's context, not a data set). Null values and costs
    count as 0; a null request is a request of its own; repeated rows are items each.
    """
    names = chunks.columns
    rows = chunks.groupBy(F.col(request).alias("_request")).agg(F.collect_list(F.struct(*[F.col(f"`{c}`") for c in names])).alias("rows"))
    place = lambda a, b: F.when(a[idx].eqNullSafe(b[idx]), 0).when(a[idx].isNull() | (a[idx] < b[idx]), -1).otherwise(1)
    rows = rows.select(F.array_sort("rows", place).alias("rows"))
    items = F.transform("rows", lambda r: F.struct(F.coalesce(r[value].cast("double"), F.lit(0.0)).alias("value"), r[cost].alias("cost")))
    rows = rows.withColumn("places", best_fit(items, F.col("rows")[0][budget]))
    return rows.select(F.inline(F.transform("rows", lambda r, i: F.struct(*[r[c].alias(c) for c in names], F.array_contains("places", i).alias("chosen")))))
