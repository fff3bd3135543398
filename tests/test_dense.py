"""Dense search as products of matrices: the exact best, whatever the tiles."""

import math
import random

from pyspark.sql import functions as F

from lexforge.functions import similarity as S
from lexforge.operators import relevance


def test_dense_top_k_is_exact_in_tiles_and_passes(spark, monkeypatch):
    rng = random.Random(5)
    vectors = {i: [float(rng.randrange(-3, 4)) / 7 for _ in range(5)] for i in range(140)}
    vectors.update({i: vectors[3] for i in range(60, 100)})
    vectors.update({7: [0.0] * 5, 11: None, 12: [1.0, None, 0.0, 0.0, 0.0]})
    e = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<float>").repartition(3)
    f = {r.vec_id: r.embedding for r in e.collect()}
    e = e.withColumn("norm", F.sqrt(S.dense_dot(F.col("embedding"), F.col("embedding"))))
    q = e.where("vec_id % 10 = 0").select(F.struct(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), F.col("norm").alias("n")).alias("q"))

    def dot(a, b):
        total = 0.0
        for x, y in zip(a, b, strict=True):
            total += x * y
        return total

    def value(a, b):
        if a is None or b is None or None in a or None in b:
            return None
        n = math.sqrt(dot(a, a)) * math.sqrt(dot(b, b))
        return dot(a, b) / n if n else None

    want = set()
    for i in range(0, 140, 10):
        near = sorted((-s if (s := value(f[i], f[j])) is not None else math.inf, j) for j in f if j != i)[:4]
        want |= {(i, j, r + 1) for r, (_, j) in enumerate(near)}
    for tile, block, size in ((2048, 512, 1 << 20), (9, 3, 1 << 20), (16, 2, 200)):
        monkeypatch.setattr(relevance, "TILE", tile)
        monkeypatch.setattr(relevance, "QUERY_BLOCK", block)
        monkeypatch.setattr(relevance, "BLOCK_BYTES", size)
        assert {(r.query_id, r.vec_id, r["rank"]) for r in relevance.dense_top_k(q, e, 4).collect()} == want


def test_dense_top_k_forms_no_pairs_as_rows(spark):
    e = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(10)], "vec_id long, embedding array<double>").withColumn("norm", F.lit(1.0))
    q = e.where("vec_id = 0").select(F.struct(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), F.col("norm").alias("n")).alias("q"))
    plan = relevance.dense_top_k(q, e, 2)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "explode" not in plan.lower()
