"""Structure repair, frequent itemsets and exact dedup against brute force on small random tables, with hot groups and odd rows."""

import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from lexforge.llm import exactdedup, itemsets, queries, repair

# -- exact dedup ------------------------------------------------------------------------------------------


def _dedup_brute(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((doc_id, text))
    out = []
    for norm, members in groups.items():
        ranked = sorted(members, key=lambda m: (-len(m[1] or ""), m[0] is None, m[0] or 0))
        for k, (doc_id, _) in enumerate(ranked):
            out.append((doc_id, ranked[0][0], len(ranked), k == 0, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=str)


_DOCS = [(1, "a b"), (2, "ab"), (3, "a  b"), (3, "a  b"), (4, None), (5, ""), (6, " \t\n\x0b\x0c\r"), (None, "ab "), (None, "xyz"), (7, "xyz"), (8, "é e"), (9, "ée"), (10, "z" * 300_000), (11, "z" * 299_999 + " z"), (0, "AB")]
_DOCS += [(100 + k, f"hot {'same' if k % 3 else k}") for k in range(60)]


@pytest.mark.parametrize("digest", [exactdedup.content_hash, lambda norm: F.unhex(F.substring(F.md5(norm), 1, 2)), lambda norm: F.lit(b"x")])
@pytest.mark.parametrize("small", [100_000, 0])
def test_exact_dedup_brute_force(spark, monkeypatch, digest, small):
    monkeypatch.setattr(exactdedup, "SMALL_GROUPS", small)
    docs = spark.createDataFrame(_DOCS, "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in exactdedup.exact_duplicates(docs, digest=digest).collect()]
    assert sorted(got, key=str) == _dedup_brute(_DOCS)


def test_exact_dedup_odd_tables(spark):
    empty = exactdedup.exact_duplicates(spark.createDataFrame([], "doc_id long, text string"))
    assert empty.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"] and empty.count() == 0
    odd = spark.createDataFrame([(1, "x y", 1, "p", 2, 3), (2, "xy", 4, "q", 5, 6)], ["doc_id", "text", "key", "a.b", "n", "part"])
    assert [tuple(r)[:4] for r in exactdedup.exact_duplicates(odd).orderBy("doc_id").collect()] == [(1, 1, 2, True), (2, 1, 2, False)]
    kept = exactdedup.drop_copies(odd)
    assert kept.columns == odd.columns and [tuple(r) for r in kept.collect()] == [(1, "x y", 1, "p", 2, 3)]
    twice = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y"), (None, "z"), (None, "z "), (3, None)], "doc_id long, text string")
    assert sorted(map(tuple, exactdedup.drop_copies(twice).collect()), key=str) == sorted([(1, "x"), (2, "y"), (None, "z "), (3, None)], key=str)


# -- frequent itemsets --------------------------------------------------------------------------------------


def _itemsets_brute(baskets, floor, n, confidence):
    support = {}
    for items in baskets:
        for k in range(1, len(items) + 1):
            for s in itertools.combinations(sorted(items), k):
                support[s] = support.get(s, 0) + 1
    out = []
    for s, v in support.items():
        if v < floor or any(set(s) < set(t) and w == v for t, w in support.items()):
            continue
        found = []
        for c in s if len(s) > 1 else ():
            rest = tuple(x for x in s if x != c)
            if 100 * v >= confidence * support[rest] and v * n > support[rest] * support[(c,)]:
                found.append((c, support[rest], support[(c,)]))
        best = min(found, key=lambda r: (r[1], r[0]))[0] if found else None
        text = ";".join(":".join(map(str, r)) for r in found)
        out.append((",".join(map(str, s)), len(s), v, len(found), best, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("seed,cells", [(1, itemsets.BATCH_CELLS), (3, 60)])
def test_itemsets_brute_force(spark, seed, cells):
    rng = random.Random(seed)
    baskets = []
    for _ in range(60):
        b = {rng.choice([2, 10, 3, -5, 100, 7, 8, 9]) for _ in range(rng.randint(1, 5))}
        if 10 in b and rng.random() < 0.9:
            b |= {2, 3}  # items that nearly always come along, so that closures matter
        if 100 in b:
            b |= {7}
        baskets.append(b | ({55} if seed == 3 else set()))  # an item of all baskets: the empty set's closure
    rows = [(k, i) for k, b in enumerate(baskets) for i in b for _ in range(rng.randint(1, 2))]
    rows += [(None, 2), (3, None), (None, None)]
    df = spark.createDataFrame(rows, "basket long, item long").withColumn("support", F.lit("x")).withColumn("a.b", F.lit(1)).repartition(4)
    got = itemsets.itemset_table(df, "basket", "item", min_count=4, min_share=20, cells=cells)
    assert got.columns == ["items", "n_items", "support", "n_rules", "best_item", "rules_sha256"]
    assert sorted(map(tuple, got.collect())) == _itemsets_brute(baskets, 4, len(baskets), itemsets.MIN_CONFIDENCE)


def test_itemsets_hot_basket_and_item(spark):
    baskets = [set(range(200))] + [{0, k % 40 + 1} for k in range(160)] + [{0}] * 40
    rows = [(k, i) for k, b in enumerate(baskets) for i in b]
    got = itemsets.itemset_table(spark.createDataFrame(rows, "basket long, item long"), "basket", "item", min_count=4, min_share=2000)
    want = {("0", 201)} | {(f"0,{k}", 5) for k in range(1, 41)}
    assert {(r.items, r.support) for r in got.collect()} == want


def test_itemsets_empty(spark):
    none = spark.createDataFrame([], "basket long, item long")
    assert itemsets.itemset_table(none, "basket", "item").count() == 0
    few = spark.createDataFrame([(1, 2), (2, 2)], "basket long, item long")
    assert itemsets.itemset_table(few, "basket", "item").count() == 0


# -- structure repair ----------------------------------------------------------------------------------------


def _repair_brute(turns):
    """turns in order: (turn, role, text) after damage. Best (cost, audit) of each grammar state, row by row."""
    seen, faults = set(), []
    for _, role, text in turns:
        bare = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    after = {"": "u", "s": "u", "u": "a", "a": "u"}
    best = {"": (0, "", [])}

    def inserted(states):
        out = dict(states)
        for _ in range(3):
            for q, (cost, audit, said) in list(out.items()):
                new = (cost + 5, audit + "I", said + [{"u": "user:", "a": "assistant:"}[after[q]]])
                if after[q] not in out or new[:2] < out[after[q]][:2]:
                    out[after[q]] = new
        return out

    for (_, role, text), fault in zip(turns, faults):
        # every way to insert first, kept apart by the state it leads to and the state it came from
        options = []
        for q, got in best.items():
            for q1, (cost, audit, said) in inserted({q: got}).items():
                options.append((q1, (cost + 2, audit + "D", said)))
                if fault in ("blank", "duplicate"):
                    continue
                more = 5 * (fault == "truncated")
                i = role[:1]
                if i == "s" and q1 == "" or i in ("u", "a") and after[q1] == i:
                    options.append((i, (cost + more, audit + "K", said + [f"{role}:{text}"])))
                options.append((after[q1], (cost + more + 1, audit + "R", said + [{"u": "user", "a": "assistant"}[after[q1]] + ":" + text])))
        best = {}
        for q, x in options:
            if q not in best or x[:2] < best[q][:2]:
                best[q] = x
    cost, audit, said = min((x for q, got in best.items() for q1, x in inserted({q: got}).items() if q1 in ("", "a")), key=lambda x: x[:2])
    initials = [r[:1] for _, r, _ in turns]
    numbers = [t for t, _, _ in turns if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())


def _in_order(rows):
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest())
    return sorted([(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows], key=key)


@pytest.mark.parametrize("seed,bits", [(1, repair.SEGMENT_BITS), (2, 1), (3, 2), (4, 0)])
def test_repair_brute_force(spark, seed, bits):
    rng = random.Random(seed)
    chats = {}
    for conv in [None, *range(-3, 30)]:
        rows = []
        for turn in range(rng.randint(1, 14)):
            role = rng.choice(["user", "assistant"] * 4 + ["system", "tool", "", None, "sage", "ärzte"])
            text = rng.choice(["ok.", "ok.", f"say {turn}", f"say {turn}!", f"why {turn}? \n", "", " \t", None, "x. "])
            for _ in range(rng.choice([1, 1, 1, 2, 3])):
                rows.append((rng.choice([turn, turn, turn + 3, None, 0]), role, text))
        chats[conv] = rows
    table = spark.createDataFrame([(c, *r) for c, rows in chats.items() for r in rows], "conv_id long, turn long, role string, text string").withColumn("id", F.lit(0)).withColumn("a.b", F.lit("z"))
    ids = table.select("conv_id").unionByName(spark.createDataFrame([(999,)], "conv_id long"))
    got = {r[0]: tuple(r)[1:] for r in repair.repair(table.repartition(5), ids, bits=bits).collect()}
    want = {c: _repair_brute(_in_order(rows)) for c, rows in chats.items()}
    want[999] = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got == want


def test_repair_long_conversation_in_segments(spark):
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", f"word {k}" + "." * (k % 7 > 0)) for k in range(6000) if k % 11] + [(1, 77, "user", "word 76.")] * 500
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    edits, facts = repair.repaired_rows(table, bits=6)
    got = repair.repair(table, table, bits=6).first()
    assert tuple(got)[1:] == _repair_brute(_in_order([r[1:] for r in rows])) and facts.count() == 1
    said = [t.role[0] for r in edits.orderBy("pos").collect() for t in r.turns]
    assert re.fullmatch("(s?(ua)+)?", "".join(said)) and set(got.audit) <= set("DIKR")


def test_repair_empty(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.repair(none, none).count() == 0
    gone = spark.createDataFrame([(4, 0, "user", "")], none.schema)
    assert tuple(repair.repair(gone, gone).first())[1:] == (0, 1, 0, 0, 0, 2, "D", hashlib.sha256(b"").hexdigest())


def test_damage_is_by_crc32(spark):
    import zlib

    rows = [(c, t, r, x) for c in (1, None) for t in [*range(60), None] for r, x in [("assistant", f"a. {t}!"), (None, None)]]
    got = sorted(map(tuple, queries.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()), key=str)
    want = []
    for c, t, r, x in rows:
        h = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        x = "" if h == 1 else re.sub("[.!?]", "", x) if h == 2 else x
        want += [(c, t, "user" if h == 4 else r, x)] * (0 if h == 0 else 2 if h == 3 else 1)
    assert got == sorted(want, key=str)


def test_stages_take_any_column_name(spark):
    """Names with dots and spaces pass through every stage, and of rows alike in id and text the same one stays on each run."""
    import corpus_pipeline

    words = "the quick brown fox jumps over the lazy dog and runs away from here today"
    rows = [(1, f"{words} one two three", "en", "s", 9, "b", "x"), (1, f"{words} one two three", "en", "s", 9, "a", "y"), (1, "another text of several words that is not like it at all", "en", "s", 9, "c", "z"), (None, words, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "lang", "source", "n_chars", "a.b", "c d.e"])
    for stage in (corpus_pipeline.line_dedup, corpus_pipeline.near_duplicates):
        got = [stage(spark, docs.repartition(k), "/root/testdata/sf0.001") for k in (1, 3)]
        assert all(g.columns == docs.columns for g in got) and sorted(map(str, got[0].collect())) == sorted(map(str, got[1].collect()))
    assert sorted(str(r["a.b"]) for r in got[0].collect()) == ["a", "c"]
