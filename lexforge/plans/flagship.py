"""The flagship: for each query the documents relevant to it, packed first-fit into a token budget, and what that costs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexforge.functions import text as T
from lexforge.operators import cost, relevance, selection
from lexforge.plans import catalog
from lexforge.plans.catalog import _TF, COUNT, f, sql

BUDGET, RELEVANCE, MOST = 1200, 0.05, 50


def relevant_context(spark: SparkSession, sf_dir: str, budget: int = BUDGET, threshold: float = RELEVANCE, most: int = MOST) -> DataFrame:
    """(item_id, candidates, packed, used_tokens, cost): documents of at least threshold by similarity, the most best of them packed."""
    items, docs = spark.read.parquet(f"{sf_dir}/benchmark.parquet"), catalog.docs(spark, sf_dir)
    sim = relevance.relevance(items, docs, "item_id", "doc_id").withColumn("similarity", F.round("similarity", 9)).where(F.col("similarity") >= threshold)
    best = relevance.top_k(sim, "item_id", "similarity", "doc_id", most)
    sized = relevance.with_texts(best, docs.select("doc_id", "text"), "doc_id").select("item_id", "rank", T.count_tokens(F.col("text")).alias("cost"))
    packs = sized.groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("rank", "cost"))).alias("c"))
    packs = packs.withColumn("took", selection.first_fit(F.transform("c", lambda x: F.struct(x.rank.alias("idx"), x.cost.alias("cost"))), F.lit(budget)))
    used = F.aggregate(F.filter("c", lambda x: F.array_contains(F.col("took"), x.rank)), F.lit(0).cast("long"), lambda a, x: a + x.cost)
    return packs.select(
        "item_id",
        F.size("c").cast("long").alias("candidates"),
        F.size("took").cast("long").alias("packed"),
        used.alias("used_tokens"),
        F.round(cost.price(used, F.lit(1000)), 8).alias("cost"),
    )


_SQL = sql(
    """WITH RECURSIVE {{tf}},
r AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY round(similarity, 9) DESC, doc_id) AS r FROM sim WHERE round(similarity, 9) >= 0.05),
c AS (SELECT r.item_id, r.r, CAST({{c}} AS BIGINT) AS cost FROM r JOIN documents t ON r.doc_id = t.doc_id WHERE r.r <= 50),
m AS (SELECT item_id, max(r) AS top FROM c GROUP BY item_id),
p AS (SELECT item_id, CAST(0 AS BIGINT) AS r, CAST(0 AS BIGINT) AS used, CAST(0 AS BIGINT) AS packed, top FROM m
  UNION ALL SELECT p.item_id, p.r + 1, CASE WHEN p.used + c.cost <= 1200 THEN p.used + c.cost ELSE p.used END, CASE WHEN p.used + c.cost <= 1200 THEN p.packed + 1 ELSE p.packed END, p.top
  FROM p JOIN c ON c.item_id = p.item_id AND c.r = p.r + 1)
SELECT item_id, top AS candidates, packed, used AS used_tokens, round(CAST(used AS DOUBLE) / 1e6 * CAST(0.59 AS DOUBLE) + CAST(1000 AS DOUBLE) / 1e6 * CAST(0.79 AS DOUBLE), 8) AS cost FROM p WHERE r = top""",
    tf=_TF,
    c=f(COUNT, "t.text"),
)

QUERIES = {"relevant_context": relevant_context}
ORACLES = {"relevant_context": _SQL}
