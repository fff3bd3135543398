"""Measures of retention find a text's words once."""

from pyspark.sql import functions as F

from lexforge.functions import text as T
from lexforge.operators import retention


def test_words_are_found_once(spark):
    df = spark.createDataFrame([("a", "b")], "a string, b string")
    plan = df.select(retention.facts(F.col("a")).alias("f"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[A-Za-z0-9_.$%/-]+") == 1


def test_words_and_digits_are_the_same(spark):
    texts = ["The cost is $5.00, NOT over 3,000% and/or the-The THE_ a.b A b", "", None, "the", "İthe theİ ıs IS .", "1a2..b-3\n4"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    c = F.col("t")
    for r in df.select(T.content(T.all_words(c)).alias("a"), T.words(c).alias("b"), retention.digits(c).alias("d"), F.regexp_replace(c, "[^0-9.]", "").alias("e"), T.best_words(T.words(c)).alias("k"), T.keywords(c).alias("l")).collect():
        assert r.a == r.b and r.d == r.e and r.k == r.l
