"""Work that grows no faster than the tables: what is shuffled, and what is worked out again."""

import random
import re

from pyspark.sql import functions as F

from lexforge.functions import kernels
from lexforge.functions import lexicons as L
from lexforge.functions import text as T
from lexforge.operators import dedup, ontology
from lexforge.plans import compress


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_keep_first_in_a_row_equals_the_join(spark):
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "not", "no"]
    bases = [" ".join(rng.choice(words) + str(rng.randrange(4)) for _ in range(rng.randrange(8, 24))) for _ in range(6)]
    units = [" ".join([*rng.choice(bases).split(), *rng.sample(words, rng.randrange(3))]) for _ in range(120)] + ["...", "...", "", "a", "a"]
    rows = spark.createDataFrame([(1, i, u) for i, u in enumerate(units)], "g int, pos int, unit string")
    want = {r.pos: r.kept for r in dedup.keep_first(rows, dedup.lexical_edges(rows, compress.SAME)).collect()}
    got = kernels.keep_first([u.lower() for u in units], compress.SAME)
    assert got == [want[i] for i in range(len(units))] and 10 < sum(got) < 115


def test_compression_shuffles_only_texts_and_keys(spark):
    texts = spark.createDataFrame([(i, f"Line {i} holds Python and Kubernetes.\n" * 3 + "word " * 600) for i in range(4)], "i long, t string")
    assert _plan(compress.guarded(texts, "i", "t")).count("Exchange ") <= 4


def test_phrases_are_searched_before_their_pattern(spark):
    phrases = [L.SAFE_PHRASES[0], L.SAFE_PHRASES[-1]]
    texts = ["x", None, "", *phrases, f"a {phrases[0].upper()} b {phrases[1]}, c", f"{phrases[0]}x {phrases[0]}", "İ just sort of OK ; really"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")

    def plain(t):
        n = 0
        for p in L.SAFE_PHRASES:
            t, k = re.subn(r"(?i)\b" + re.escape(p) + r"\b", "", t or "", flags=re.ASCII)
            n += k
        return re.sub(r"[ \t]+", " ", re.sub(r"\s+([,.!?;:])", r"\1", t)).strip(), n

    assert [(r.text, r.removed) for r in df.select(T.drop_filler(F.col("t")).alias("r")).select("r.*").collect()] == [plain(t) for t in texts]


def test_equal_texts_are_searched_once(spark):
    table = ontology.ontology(spark, {"entities": {"PY": ("python",), "K8": ("kubernetes",)}, "concerns": {"GAP": ("gap",)}, "reasons": {}})
    brought = spark.createDataFrame([("GAP", "ZZ")], "concern string, entity string")
    texts = spark.createDataFrame([(1, "python"), (2, "python"), (2, "a gap"), (3, None), (None, "kubernetes"), (4, "")], "i long, t string")
    out = ontology.ledgers(texts, "i", "t", table, brought)
    got = {r.i: (r.entities, r.concerns, r.reasons) for r in out.collect()}
    assert got == {1: (["PY"], [], []), 2: (["PY", "ZZ"], ["GAP"], []), 3: ([], [], []), None: (["K8"], [], []), 4: ([], [], [])}
    searched = []
    spied = lambda t, *more: searched.append(t.count()) or found(t, *more)
    found, ontology.matches = ontology.matches, spied
    try:
        ontology.ledgers(texts, "i", "t", table, brought)
    finally:
        ontology.matches = found
    assert searched == [4]


def test_similarity_of_equal_texts_is_worked_out_once():
    kernels._kept_similarity.cache_clear()
    rows = [kernels.semantic_similarity("Python and k8s " + str(i % 3), "docker " + str(i % 3)) for i in range(30)]
    assert kernels._kept_similarity.cache_info().misses == 3 and rows[:3] * 10 == rows
    assert kernels.semantic_similarity("Python", "python") == (1.0, 1.0, 1.0, 1.0)
    long = "word " * 1000
    assert kernels.semantic_similarity(long, long)[0] == 1.0 and kernels._kept_similarity.cache_info().misses == 4
