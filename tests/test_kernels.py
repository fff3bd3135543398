"""Row-local algorithms: goldens worked out by hand, brute force and invariants."""

from pyspark.sql import functions as F

from lexforge.functions import kernels as K
from lexforge.plans import compress


def test_pacer():
    p = K.Pacer(tokens=100, requests=3, gap=8.0)
    assert p.request(0.0, 500)[0] == 0.0  # an empty window never waits for tokens
    assert p.request(1.0, 10)[0] == 60.0 - 1.0 + 0.25
    p = K.Pacer(tokens=10_000, requests=3, gap=0.0)
    for t in range(3):
        assert p.request(float(t), 1)[0] == 0.0
    assert p.request(3.0, 1)[0] == 57.25
    assert K.Pacer(gap=8.0, events=[(0.0, 1)]).sleep_for(60.0, 1) == 0.0


def test_compression_keeps_terms(spark):
    long = "\n".join(f"Point {i}: the candidate has {i} years of python and limited kubernetes, detail number {i * 7} of the long plan." for i in range(80))
    rows = [(1, long), (1, long), (2, ""), (3, None), (None, "please use sql")]
    out = compress.guarded(spark.createDataFrame(rows, "id long, text string").withColumn("k", F.lit("clash")), "id", "text", "find risks")
    got = sorted(out.collect(), key=lambda r: (r.id is None, r.id))
    assert [r.id for r in got] == [1, 1, 2, 3, None] and got[0] == got[1] and got[2].optimized == got[3].optimized
    assert got[0].guard_passed and got[0].tokens_after < got[0].tokens_before and got[2].tokens_before == 0 and got[2].reduction_pct == 0.0
    lines = [x for x in got[0].optimized.split("\n") if x.startswith("- Point")]
    assert lines == sorted(lines, key=lambda x: int(x.split()[2][:-1])) and len(lines) < 80
    assert "please" not in got[4].optimized and "sql" in got[4].protected
    assert compress.guarded(out.select("id", "optimized").limit(0), "id", "optimized").count() == 0


def test_counts_and_cosine(spark):
    from lexforge.functions import similarity as S

    rows = [(["b", "a", "b", "c"], ["a", "b"]), ([], ["a"]), (["x"], ["x", "x"]), (["a"], ["b"])]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>")
    out = df.select(S.counts(F.col("a")).alias("c"), S.cosine(F.col("a"), F.col("b")).alias("s"), S.entropy(F.col("a")).alias("e")).collect()
    assert [[tuple(x) for x in r.c] for r in out] == [[("a", 1), ("b", 2), ("c", 1)], [], [("x", 1)], [("a", 1)]]
    assert [round(r.s, 9) for r in out] == [round(3 / (6 * 2) ** 0.5, 9), 0.0, 1.0, 0.0] and [r.e for r in out] == [1.5, None, 0.0, 0.0]
