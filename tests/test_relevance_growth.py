"""Relevance to few queries is summed up where the texts are."""

from lexforge.operators import relevance


def test_relevance_shuffles_no_words(spark):
    texts = spark.createDataFrame([(1, "red fox fox"), (2, "blue"), (2, "fox"), (3, None)], "i long, t string")
    queries = spark.createDataFrame([(7, "fox red"), (8, "green")], "k long, text string")
    out = relevance.relevance(queries, texts, "k", "i", text_text="t")
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(id") <= 2
    assert {(r.k, r.i): round(r.similarity, 6) for r in out.collect()} == {(7, 1): 0.948683, (7, 2): 0.5}
    assert [(r.k, r.i) for r in relevance.relevance(queries, texts, "k", "i", text_text="t", least=0.9).collect()] == [(7, 1)]
