"""Keep-first removal of near-duplicate units (sentences, chunks) within a group.

Similar pairs come from a prefix-filtered token join inside the group: a unit's tokens are ordered by how many units of the group have them,
and only its rarest ones, without which no partner could reach the threshold, look for partners. Units with the same tokens
are one unit in that search. Which units stay is a fold over positions: a unit goes only if it is similar to an
earlier one that stays. All steps are JVM-side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexforge.functions import text as T
from lexforge.functions.similarity import counted_cosine, counts, square_sum
from lexforge.sources.shared import settle

#: the earlier neighbour of a copy: no unit, so it never goes and the copy always does
COPY = -1


def units(df: DataFrame, group: str, parts: Column) -> DataFrame:
    """(group, pos, unit): array elements with their places from 0."""
    return df.select(F.col(group).alias("g"), F.posexplode(parts).alias("pos", "unit"))


def _firsts(v: DataFrame, same: list[str]) -> DataFrame:
    """Of units of one group with equal columns same the first, with its other columns."""
    rest = [c for c in v.columns if c not in ("g", "pos", *same)]
    return v.groupBy("g", *same).agg(F.min("pos").alias("pos"), *[F.first(c).alias(c) for c in rest])


def _copies(v: DataFrame, firsts: DataFrame) -> DataFrame:
    """Edges of all units that aren't the first of their kind. They go, as the first does or what it went for stays."""
    return v.join(firsts.select("g", "pos"), ["g", "pos"], "left_anti").select("g", F.col("pos").alias("a"), F.lit(COPY).alias("b"))


def _rarity(t: DataFrame) -> DataFrame:
    """Rows (g, pos, token, ...) whose token at least two units of the group have, with that number as df."""
    seen = t.groupBy("g", "token").agg(F.count("*").alias("df"))
    return t.join(seen, ["g", "token"])


def _pairs(prefix: DataFrame, *more: str) -> DataFrame:
    """(g, a, b), b before a, of units that share a token of their prefixes and the columns more. Tokens of one unit alone lead nowhere."""
    p = prefix.where("df > 1").select("g", "pos", "token", *more)
    b = p.withColumnRenamed("pos", "b")
    return p.withColumnRenamed("pos", "a").join(b, ["g", "token", *more]).where("b < a").select("g", "a", "b").distinct()


def _checked(pairs: DataFrame, v: DataFrame, columns: list[str], good: Column) -> DataFrame:
    side = lambda k, x: v.select("g", F.col("pos").alias(k), *[F.col(c).alias(f"{c}_{x}") for c in columns])
    return pairs.join(side("a", "x"), ["g", "a"]).join(side("b", "y"), ["g", "b"]).where(good).select("g", "a", "b")


def cosine_edges(u: DataFrame, threshold: float | str) -> DataFrame:
    """(g, a, b): pairs with b before a whose word counts have a cosine >= threshold, a number or a column of u.

    Units without a content word have no edge. Of units with equal counts only the first is compared; each other one has the
    edge (g, a, COPY). What a unit's tokens outside its prefix hold of its norm is less than the threshold, so by Cauchy and
    Schwarz a pair that shares only such tokens stays below it: a word of every unit forms pairs only of units that are little else.
    """
    least = F.lit(float(threshold)) if not isinstance(threshold, str) else F.col(threshold)
    v = u.select("g", "pos", least.alias("least"), counts(T.words(F.col("unit"))).alias("c")).where(F.size("c") > 0)
    # the norm is a stored column: worked out beside explode() it would be summed again for every token
    v = settle(v.withColumn("n2", square_sum(F.col("c"))))
    one = settle(_firsts(v, ["c"]))
    t = one.select("g", "pos", "least", "n2", F.explode("c").alias("e")).select("g", "pos", "least", "n2", F.col("e.t").alias("token"), F.col("e.n").alias("n"))
    # squares of this token and of all more frequent ones: where they reach the threshold, a partner may lie beyond
    rest = Window.partitionBy("g", "pos").orderBy(F.desc("df"), F.desc("token")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    prefix = _rarity(t).withColumn("left", F.sum(F.col("n") * F.col("n")).over(rest)).where(F.col("left") >= F.col("least") * F.col("least") * F.col("n2") * (1 - 1e-9))
    near = _checked(_pairs(prefix), one, ["c", "least"], counted_cosine(F.col("c_x"), F.col("c_y")) >= F.col("least_x"))
    return near.unionByName(_copies(v, one))


def lexical_edges(u: DataFrame, threshold: float) -> DataFrame:
    """(g, a, b) with b before a, Jaccard of lexical tokens > threshold and the same polarity; copies as in cosine_edges().

    A Jaccard above the threshold needs more than that share of either unit's tokens in common, so one of the n - ceil(threshold
    * n) + 1 rarest is shared, and sizes within a factor of the threshold.
    """
    tokens = F.array_sort(F.array_distinct(T.find_all(F.lower("unit"), r"[a-zA-Z0-9_+#.-]+")))
    v = settle(u.select("g", "pos", T.has_polarity(F.col("unit")).alias("neg"), tokens.alias("c")).where(F.size("c") > 0).withColumn("n", F.size("c")))
    one = settle(_firsts(v, ["neg", "c"]))
    t = _rarity(one.select("g", "pos", "neg", "n", F.explode("c").alias("token")))
    place = F.row_number().over(Window.partitionBy("g", "pos").orderBy("df", "token"))
    prefix = t.withColumn("place", place).where(F.col("place") <= F.col("n") - F.ceil(threshold * F.col("n") - 1e-9) + 1)
    x, y = F.col("c_x"), F.col("c_y")
    sizes = F.least(F.size(x), F.size(y)) > threshold * F.greatest(F.size(x), F.size(y))
    common = F.size(F.array_intersect(x, y))
    near = _checked(_pairs(prefix, "neg"), one, ["c"], sizes & (common / (F.size(x) + F.size(y) - common) > threshold))
    return near.unionByName(_copies(v, one))


def keep_first(u: DataFrame, edges: DataFrame) -> DataFrame:
    """(g, pos, unit, kept): the fold over each group's units that have an earlier neighbour; all others stay."""
    near = edges.groupBy("g", "a").agg(F.collect_list("b").alias("earlier"))
    order = near.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("a", "earlier"))).alias("e"))
    dropped = F.aggregate("e", F.array().cast("array<int>"), lambda gone, x: F.when(F.size(F.array_except(x.earlier, gone)) > 0, F.array_append(gone, x.a)).otherwise(gone))
    gone = order.select("g", F.explode(dropped).alias("pos")).withColumn("gone", F.lit(True))
    return u.join(gone, ["g", "pos"], "left").select("g", "pos", "unit", F.col("gone").isNull().alias("kept"))
