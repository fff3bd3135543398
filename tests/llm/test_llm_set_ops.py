"""Operators over whole tables: brute force, invariants, hot groups and odd rows."""

import itertools
import random
import re
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexforge.llm import decontam, jaccard, langid, linededup, mixing, queries
from lexforge.llm.common import Words, connected_components, prefix_sum

SF = "/root/testdata/sf0.001"
WORD = r"[^\x20\x09-\x0D]+"
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, cls int, u int, token string"


def words(text):
    return re.findall(WORD, (text or "").translate(LOWER))


def shingles(text, k=5):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def union_find(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return find


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t) if t is not None else None, 1, 2, "t") for i, t, s in rows], SCHEMA)


def family(rnd, base, n, edits):
    """n variants of a list of words with random substitutions, cuts and additions."""
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rnd.randint(0, edits)):
            w[rnd.randrange(len(w))] = f"z{rnd.randrange(999)}"
        if rnd.random() < 0.3:
            w = w[: -rnd.randint(1, max(1, len(w) // 8))]
        if rnd.random() < 0.3:
            w += [f"y{rnd.randrange(99)}" for _ in range(rnd.randint(1, len(w) // 8 + 1))]
        out.append(" ".join(w))
    return out


# -- parts ------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("kind", ["random", "chain", "hub", "empty"])
def test_components(spark, kind):
    rnd = random.Random(5)
    edges = {"random": [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)], "chain": [(i, i + 1) for i in range(120)], "hub": [(7, i) for i in range(200)] + [(500, 501)], "empty": []}[kind]
    df = spark.createDataFrame([*edges, (1, None), (None, None)], "u long, v long")
    got = {r.node: r.component for r in connected_components(df).collect()}
    links = [(a, b) for a, b in edges if a != b]
    find = union_find({x for e in links for x in e}, links)
    assert got == {x: find(x) for e in links for x in e}


def test_prefix_sum(spark):
    rows = [(k, i, (i * 7) % 5) for k, n in (("a", 4000), (None, 300), ("c", 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, i long, v long")
    got = prefix_sum(df, ["k"], ["i"], "v", "start", len(rows), leaf=64).collect()
    assert len(got) == len(rows)
    for key in ("a", None, "c"):
        own = sorted((r.start, r.start + r.v) for r in got if r.k == key)
        ends = 0
        for a, b in own:  # spans tile the whole without overlap
            assert a == ends or a == b
            ends = max(ends, b)
        assert ends == sum(v for k, _, v in rows if k == key)


@pytest.mark.parametrize("leaf", [4, 16, 600, 4096])
def test_prefix_sum_order(spark, leaf):
    """One running order, by hash and then by the columns, whatever the number of levels (leaf 4: five of them)."""
    rows = [(k, i % 2500, (i * 7) % 5 + 1) for k, n in (("a", 3000), (None, 300), ("c", 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, i long, v long")
    want, ends = [], Counter()
    for r in sorted(df.withColumn("h", F.xxhash64("i", "v")).collect(), key=lambda r: (r.h, r.i, r.v)):
        want.append((r.k or "", r.i, r.v, ends[r.k]))
        ends[r.k] += r.v
    out = prefix_sum(df, ["k"], ["i", "v"], "v", "start", len(rows), leaf=leaf)
    assert out.columns == ["k", "i", "v", "start"]
    assert sorted((r.k or "", r.i, r.v, r.start) for r in out.collect()) == sorted(want)


# -- near duplicates ------------------------------------------------------------------------------------------------


def brute_classes(rows):
    sets = [shingles(t) for _, t in rows]
    seen = {}
    for i, s in enumerate(sets):
        for x in s:
            seen.setdefault(x, []).append(i)
    pairs = {p for v in seen.values() for p in itertools.combinations(v, 2)}
    links = [(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    find = union_find(range(len(rows)), links)
    low = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            low[find(i)] = min(low.get(find(i), doc), doc)
    return Counter((doc, len(sets[i]), low.get(find(i)) if sets[i] else doc) for i, (doc, _) in enumerate(rows))


def near_duplicate_rows():
    rnd = random.Random(11)
    vocabulary = [f"v{i}" for i in range(4000)]
    passage = [rnd.choice(vocabulary) for _ in range(60)]
    rows = [None, "", "  \n", "A", "a", "a b c d", "A b C d", "a b c d e", "a b c d f"]
    for size, n, edits in ((80, 40, 2), (300, 90, 9), (40, 30, 1), (700, 12, 20), (6, 12, 1)):
        rows += family(rnd, [rnd.choice(vocabulary) for _ in range(size)], n, edits)
    rows += [" ".join(passage + [rnd.choice(vocabulary) for _ in range(rnd.randint(20, 200))]) for _ in range(120)]  # share a passage, no copies
    rows += [" ".join([rnd.choice(vocabulary) for _ in range(5_000)])] * 3
    rows += ["hot copy of one text that many rows have in full"] * 200
    rows = list(enumerate(rows))
    return [*rows, (3, "a repeated id with other words in it"), (None, "hot copy of one text that many rows have in full"), (None, "alone and null")]


@pytest.mark.parametrize("hot_at,tile,small", [(64, 1024, 64), (4, 8, 4)])
def test_near_duplicates_brute_force(spark, monkeypatch, hot_at, tile, small):
    monkeypatch.setattr(jaccard, "TILE", tile)
    monkeypatch.setattr(jaccard, "SMALL_TILE", small)
    rows = near_duplicate_rows()
    df = frame(spark, [(i, t, "s") for i, t in rows]).repartition(5)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicate_classes(df, hot_at=hot_at).collect())
    assert got == brute_classes(rows)


def test_near_duplicates_empty(spark):
    assert jaccard.near_duplicate_classes(frame(spark, [])).count() == 0
    got = jaccard.near_duplicate_classes(frame(spark, [(1, None, "a"), (2, "", "a")])).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(1, 0, 1), (2, 0, 2)}


def test_signature_bounds():
    rng = np.random.default_rng(2)
    for _ in range(200):
        pool = rng.integers(0, 1 << 62, 400, dtype=np.uint64)
        a, b = (np.unique(rng.choice(pool, rng.integers(1, 300))) for _ in range(2))
        x, y = (np.frombuffer(jaccard.parity_signature(s), np.uint8) for s in (a, b))
        size = min(len(x), len(y))
        apart = int(np.bitwise_count(jaccard.fold(x, size) ^ jaccard.fold(y, size)).sum())
        assert (len(a) + len(b) - apart) // 2 >= len(np.intersect1d(a, b))
        n = len(np.intersect1d(a, b))
        assert (100 * n >= 75 * (len(a) + len(b) - n)) == (n >= jaccard.need(len(a), len(b), 75))


# -- line dedup ---------------------------------------------------------------------------------------------------------


def test_line_dedup_brute_force(spark):
    rnd = random.Random(4)
    common = ["Home | News", "All rights reserved"]
    rows = []
    for i in range(300):
        host = "hot" if i % 3 else rnd.choice(["a", "b", None])
        lines = [f"line {i} {j}" for j in range(rnd.randint(0, 4))] + [c for c in common if rnd.random() < 0.3] + [""] * rnd.randint(0, 2)
        rnd.shuffle(lines)
        rows.append((i, "\n".join(lines), host))
    rows += [(900 + i, "Home | News\nx", "small") for i in range(5)] + [(990, None, "hot"), (991, "", None), (None, "Home | News", "hot"), (992, "Home | News\nHome | News", "hot"), (992, "Home | News\nHome | News", "hot")]
    df = frame(spark, rows)
    pages = Counter(h for *_, h in rows)
    carry = Counter((h, x) for _, t, h in rows for x in {y for y in (t or "").split("\n") if t is not None and re.search(WORD, y)})
    bad = {k for k, n in carry.items() if pages[k[0]] >= 10 and n >= 3 and n > 0.07 * pages[k[0]]}
    want = Counter()
    for i, t, h in rows:
        lines = t.split("\n") if t is not None else []
        kept = [x for x in lines if (h, x) not in bad]
        want[(i, "\n".join(kept) if t is not None else None, len(lines), len(lines) - len(kept))] += 1
    assert bad and {h for h, _ in bad} >= {"hot", None} - {"small"}
    out = linededup.drop_boilerplate(df)
    assert out.columns == [*df.columns, "n_lines", "n_dropped"]
    got = out.collect()
    assert Counter((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got) == want
    assert all(r.text is None or r.n_chars == len(r.text) for r in got)
    assert linededup.drop_boilerplate(df.limit(0)).count() == 0


def test_line_dedup_ratio_and_columns(spark):
    """A footer on 9% of a host's pages goes, a line on 4% stays; a host of 10 pages doesn't lose what one page has."""
    rows = [(i, f"own {i}" + ("\nfooter" if i % 11 == 0 else "") + ("\nordinary" if i % 25 == 0 else ""), "big") for i in range(550)]
    rows += [(1000 + i, f"page {i}" + ("\ntwice" if i < 2 else "") + ("\nthrice" if i < 3 else ""), "ten") for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `ho.st` string").withColumn("n_lines", F.lit("theirs")).withColumn("c0", F.lit(1)).withColumn("key", F.lit(2))
    out = linededup.drop_boilerplate(df, host="ho.st")
    assert out.columns == [*df.columns, "n_dropped"] and out.select("n_lines").distinct().collect() == [("theirs",)]
    text = {r.doc_id: r.text for r in out.collect()}
    assert text == {i: "\n".join(x for x in t.split("\n") if x not in ("footer", "thrice")) for i, t, _ in rows}
    assert linededup.drop_boilerplate(df.select("doc_id", "text", F.lit("h").alias("source")).limit(0)).count() == 0


# -- decontamination --------------------------------------------------------------------------------------------------------


def brute_hits(docs, items):
    found = set()
    for d, text in docs:
        own = words(text)
        for i, it in items:
            w = words(it)
            if not w:
                continue
            weight, x = decontam.shingle_weights(w, 5), 25 * max(1, len(w) - 4) // 125
            for b in range(-x, len(own)):
                a = max(0, b)
                if b + len(w) > 0 and 100 * decontam.weighted_jaccard(weight, decontam.shingle_weights(own[a : b + len(w)], 5)) >= 75 - 1e-9:
                    found.add((d, i))
                    break
    return found


def test_decontamination_brute_force(spark):
    rnd = random.Random(9)
    vocabulary = [f"v{i}" for i in range(500)] + ["the", "of", "and"] * 20
    items = [(k, " ".join(rnd.choice(vocabulary) for _ in range(n))) for k, n in enumerate((1, 3, 5, 8, 12, 16, 22, 30, 38, 39, 45, 59, 80, 130))] + [(50, None), (51, ""), (52, "Solo Word Item Text")]
    docs = []
    for i in range(240):
        body = [rnd.choice(vocabulary) for _ in range(rnd.randint(0, 120))]
        k, it = rnd.choice(items[3:14])
        w = it.upper().split() if rnd.random() < 0.3 else it.split()
        kind = i % 6
        if kind == 1:
            w[rnd.randrange(len(w))] = "edited"
        elif kind == 2:
            w = w[rnd.randint(0, 3) :]
        elif kind == 3:
            w.insert(rnd.randrange(len(w)), "added")
        elif kind == 4:
            w = w[: len(w) // 2]
        at = rnd.randint(0, len(body))
        docs.append((i, " ".join(body[:at] + (w if kind != 5 else []) + body[at:])))
    docs += [(500, None), (501, ""), (502, "solo word\nitem\ttext"), (503, "pre " * 3000 + items[7][1]), (503, "pre " * 3000 + items[7][1])]
    df = frame(spark, [(i, t, "s") for i, t in docs]).withColumn("item_id", F.lit("clash"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.contaminated(df, bench)
    pairs = [(r.doc_id, r.item_id) for r in got.collect()]
    assert set(pairs) == brute_hits(docs, items) and pairs.count((503, 7)) == 2
    clean = decontam.drop_contaminated(df, bench)
    assert clean.columns == df.columns
    assert Counter(r.doc_id for r in clean.collect()) == Counter(i for i, _ in docs if i not in {d for d, _ in pairs})
    assert decontam.contaminated(df, bench.limit(0)).count() == 0 and decontam.contaminated(df.limit(0), bench).count() == 0


def test_hamming_blocks_miss_none():
    rng = np.random.default_rng(1)
    entries = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    queried = entries[rng.integers(0, 300, 2000)].copy()
    for i in range(len(queried)):
        for b in rng.choice(64, rng.integers(0, 12), replace=False):
            queried[i] ^= np.uint64(1) << np.uint64(b)
    for blocks, near, radius in ((3, 2, 8), (4, 0, 3), (2, 1, 3)):
        q, e = decontam.HammingIndex(entries, blocks, near).search(queried)
        close = np.bitwise_count(queried[:, None] ^ entries[None, :]) <= radius
        assert set(zip(q.tolist(), e.tolist(), strict=True)) == set(zip(*map(np.ndarray.tolist, np.nonzero(close)), strict=True))


def edited(rnd, item, kind):
    """A passage that may still reach the threshold against item, by one kind of edit or several."""
    w, x = list(item), decontam.lost(len(item))
    new = lambda: f"new{rnd.randrange(10**6)}"
    if kind == "ends":
        a = rnd.randint(0, x)
        w = w[a : len(w) - (x - a)]
    elif kind == "block":
        c = max(1, x - 4)
        a = rnd.randrange(len(w) - c + 1)
        w[a : a + c] = [new() for _ in range(c)]
    elif kind == "words":
        for _ in range(max(1, x // 5)):
            w[rnd.randrange(len(w))] = new()
    elif kind == "more":
        for _ in range(max(1, x // 4)):
            w.insert(rnd.randrange(len(w)), new())
    elif kind == "less":
        for _ in range(max(1, x // 5)):
            del w[rnd.randrange(len(w))]
    return w


def test_decontamination_recall():
    """Fingerprints of item-sized windows find at least 0.97 of the passages that brute force finds, and nothing else."""
    rnd = random.Random(21)
    vocabulary = [f"v{i}" for i in range(3000)] + ["the", "of", "and", "to"] * 150
    items = [(i, " ".join(rnd.choice(vocabulary) for _ in range(n))) for i, n in enumerate([15, 17, 22, 27, 33, 38, 43, 48, 52, 56, 59, 75, 90, 120, 180, 260, 400, 700])]
    index = decontam.ItemIndex(items)
    texts, owner = [], []
    for i, it in items:
        for kind in ("whole", "ends", "block", "words", "more", "less"):
            for _ in range(12):
                body = [rnd.choice(vocabulary) for _ in range(rnd.randint(5, 80))]
                at = rnd.randint(0, len(body))
                texts.append(" ".join(body[:at] + edited(rnd, it.split(), kind) + body[at:]))
                owner.append(i)
    texts += [" ".join(rnd.choice(vocabulary) for _ in range(300)) for _ in range(50)]
    got = {(row, item) for row, item, _, _ in index.hits(Words(pa.array(texts), lower=True))}
    want = {(r, i) for r, i in enumerate(owner) if brute_hits([(r, texts[r])], [items[i]])}
    assert got <= want and len(want) > 700 and len(got) >= 0.97 * len(want)
    # the radius does work: many are found only through fingerprints that differ
    for _, _, hamming, _, _ in index.groups:
        hamming.radius = 0
    same = {(row, item) for row, item, _, _ in index.hits(Words(pa.array(texts), lower=True))}
    assert same < got and len(same) < 0.9 * len(got)


def test_decontamination_passes_and_spans(spark, monkeypatch):
    rnd = random.Random(2)
    items = [(i, " ".join(f"w{rnd.randrange(400)}" for _ in range(30 + i))) for i in range(12)]
    docs = [(i, " ".join([f"w{rnd.randrange(400)}" for _ in range(rnd.randint(0, 900))] + items[i % 12][1].split() + ["end"] * (i % 5)), "s") for i in range(36)]
    df, bench = frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")
    rows = lambda: sorted((r.doc_id, r.item_id, r.similarity, r.first_word) for r in decontam.contaminated(df, bench).collect())
    whole = rows()
    assert {(d, i) for d, i, *_ in whole} >= {(i, i % 12) for i in range(36)}
    monkeypatch.setattr(decontam, "INDEX_BYTES", 150_000)
    assert len(decontam._passes(bench, "item_id", "text", 5, 75)) > 3
    assert rows() == whole and decontam.drop_contaminated(df, bench).count() == 0
    words = Words(pa.array([t for _, t, _ in docs]), lower=True)
    found = sorted(decontam.ItemIndex(items).hits(words))
    monkeypatch.setattr(decontam, "SPAN", 97)
    assert sorted(decontam.ItemIndex(items).hits(words)) == found


# -- mixing --------------------------------------------------------------------------------------------------------------------


def brute_targets(sizes, weights, total, cap=2):
    """Shares of total by weight; those above cap times their size stop there, and the rest is dealt again."""
    out, free, left = [Fraction(0)] * len(sizes), list(range(len(sizes))), total
    while free:
        weight = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] > cap * sizes[i] * weight]
        for i in over or free:
            out[i] = Fraction(cap * sizes[i]) if over else left * weights[i] / weight
        if not over:
            break
        left -= sum(out[i] for i in over)
        free = [i for i in free if i not in over]
    return out


def test_targets(spark):
    assert [float(t) for t in brute_targets([100, 100, 100], [3, 1, 2], Fraction(450))] == [200.0, 250 / 3, 500 / 3]
    rnd = random.Random(6)
    for sizes in ([100, 100, 100], [5, 50, 500, 0], [0, 0], [], [7], [rnd.choice([0, 1, 3, 900, rnd.randrange(10**6)]) for _ in range(60)], [10**6] + [1] * 30):
        names = [f"s{i:03d}" for i in range(len(sizes))]
        if len(names) > 2:
            names[-1] = None
        df = spark.createDataFrame(list(zip(names, sizes, strict=True))[::-1], "source string, size long")
        got = mixing.planned(df, (3, 1, 2), 1.5, 2, 64).orderBy("s").collect()
        want = brute_targets(sizes, [(3, 1, 2)[i % 3] for i in range(len(sizes))], Fraction(3 * sum(sizes), 2))
        assert [r.source for r in got] == names and [r.source_size for r in got] == sizes
        assert [r.target for r in got] == pytest.approx([float(t) for t in want], rel=1e-12, abs=1e-9)
        assert all(r.blocks == -(-r.source_size // 64) and r.quota <= 2 * r.blocks and (r.source_size == 0 or abs(r.quota - r.target * r.blocks / r.source_size) <= 0.5 + 1e-9) for r in got)


def test_shard_counts_are_multinomial(spark):
    """Counts vary from shard to shard as draws do, each source gets its quota whole, and no slot is lost."""
    quota = [4000, 2500, 1200, 299, 1, 0]
    sources = spark.createDataFrame([(i, q, max(1, q // 2)) for i, q in enumerate(quota)], "s long, quota long, blocks long")
    n = sum(quota)
    rows = mixing.slots(sources, n, len(quota), 5, shard_slots=50).toPandas()
    assert len(rows) == n and rows.groupby("shard").size().eq(50).all() and rows.shard.nunique() == n // 50
    assert {s: len(g) for s, g in rows.groupby("s")} == {i: q for i, q in enumerate(quota) if q}
    for s, g in rows.groupby("s"):
        assert sorted(g.ordinal) == list(range(quota[s]))
        times = g.block.value_counts()
        assert times.max() - times.reindex(range(max(1, quota[s] // 2)), fill_value=0).min() <= 1  # pass after pass
    table = rows.pivot_table(index="shard", columns="s", values="block", aggfunc="count", fill_value=0)
    for s in (0, 1, 2):
        p = quota[s] / n
        assert 0.7 < table[s].var() / (50 * p * (1 - p)) < 1.4
    again = mixing.slots(sources.repartition(3), n, len(quota), 5, shard_slots=50).toPandas()
    assert sorted(map(tuple, again[["s", "shard", "ordinal", "block"]].values)) == sorted(map(tuple, rows[["s", "shard", "ordinal", "block"]].values))


@pytest.mark.parametrize("n", [1, 2, 7, 64, 1000])
def test_permutation(spark, n):
    p = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), mixing.round_keys(F.lit(n).cast("long"), F.lit("s"))).alias("p")).collect()
    assert sorted(r.p for r in p) == list(range(n)) and (n < 64 or [r.p for r in p] != list(range(n)))


def test_mix(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "text")
    odd = spark.createDataFrame([(1001, None, "a b c " * 700), (1002, "src0", None), (None, "src1", "x y"), (1004, "", "lone"), (1004, "", "lone"), (1005, "zz", "")], docs.schema)
    docs = docs.unionByName(odd).withColumn("size", F.lit("clash"))
    got = mixing.mix(docs).toPandas()
    again = mixing.mix(docs.repartition(7)).toPandas()
    key = ["doc_id", "source", "size", "taken"]
    assert sorted(map(repr, got[key].values.tolist())) == sorted(map(repr, again[key].values.tolist()))
    assert len(got) == docs.count() and (got.taken <= 2 * got["size"]).all()
    size = Counter((r.doc_id, len(re.findall(WORD, r.text or ""))) for r in docs.collect())
    assert Counter((None if i != i else int(i), n) for i, n in zip(got.doc_id, got["size"], strict=True)) == size
    by = got.groupby("source", dropna=False).agg(size=("size", "sum"), taken=("taken", "sum"), target=("target", "first"), own=("source_size", "first"))
    assert (by["size"] == by.own).all() and ((by.taken - by.target).abs() <= 0.03 * by.target + 2 * mixing.BLOCK_LEN).all()
    assert abs(by.target.sum() - 1.5 * by["size"].sum()) < 1e-6
    assert mixing.mix(docs.limit(0)).count() == 0


def test_blocks_are_whole(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    m = mixing.Mixture(docs)
    b = m.blocks().toPandas()
    whole = b.groupby(["shard", "s", "ordinal"]).words.sum()
    assert (whole <= m.block_len).all() and (whole < m.block_len).sum() <= 2 * 2 * m.sources.count()
    assert m.slots.groupBy("shard").count().agg(F.max("count")).first()[0] <= mixing.SHARD_SLOTS


# -- queries and pipeline --------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_match_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "benchmark"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    rows = lambda df: (sorted(df.columns), sorted(map(repr, df[sorted(df.columns)].astype(object).where(df[sorted(df.columns)].notna(), None).values.tolist())))
    assert rows(queries.QUERIES[name](spark, SF).toPandas()) == rows(con.sql(queries.ORACLES[name]).df())


def test_query_names():
    assert {re.match(r"op(\d+)_", k)[1] for k in queries.QUERIES} == {str(i) for i in range(1, 11)}


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_duplicates", "decontamination", "source_mixing"]
    kept = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        df = spark.createDataFrame(kept, "doc_id long, text string, source string").join(docs.select("doc_id", "lang", "n_chars"), "doc_id")
        out = stage(spark, df, SF)
        assert out.columns == df.columns
        now = [tuple(r) for r in out.select("doc_id", "text", "source").collect()]
        if name == "near_duplicates":
            low = {d: c for d, _, c in brute_classes([(d, t) for d, t, _ in kept])}
            assert {d for d, *_ in now} == {d for d in low if low[d] == d}
        if name == "decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            near = {d: t for d, t, _ in kept if any(shingles(t) & shingles(i) for _, i in items)}
            assert {d for d, *_ in kept} - {d for d, *_ in now} == {d for d, _ in brute_hits(list(near.items()), items)}
        if name == "language_id":
            assert len(now) >= 0.98 * len(kept)
        kept = now
    final = corpus_pipeline.run(spark, SF).toPandas()
    assert set(final.doc_id) == {d for d, *_ in kept} and (final.taken <= 2 * final["size"]).all()


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_on_odd_rows(spark, name, stage):
    """Nulls everywhere, empty and very long texts, repeated rows, columns whose names clash; and an empty table."""
    english = "the quick brown fox jumps over the lazy dog while the old man reads his paper by the river "
    long = " ".join(f"word{i}" for i in range(90_000))
    rows = [(i, f"{english}{i} and more number {i * 7}", "src") for i in range(30)]
    rows += [(100, None, None), (101, "", "src"), (102, " \n\t", None), (103, long, "src"), (104, english * 2, None), (104, english * 2, None), (None, "a null id has a text of its own, in plain words that say little", "src"), (None, None, None)]
    df = spark.createDataFrame([(i, t, "en" if i is None or i % 2 else None, s, len(t) if t else None, 1, 2, "t", "x") for i, t, s in rows], SCHEMA + ", size string").withColumnRenamed("size", "taken")
    out = stage(spark, df, SF).collect()
    got = Counter((r.doc_id, r.text) if name != "source_mixing" else r.doc_id for r in out)
    every = Counter((i, t) for i, t, _ in rows)
    if name == "source_mixing":
        assert got == Counter(i for i, *_ in rows) and all(0 <= r.taken <= 2 * r["size"] for r in out)
    elif name == "language_id":
        assert got == Counter({k: n for k, n in every.items() if k[1] and k[1].strip()})
    elif name == "near_duplicates":
        assert got[(104, english * 2)] == 1 and all(got[k] == n for k, n in every.items() if not (k[1] or "").strip()) and set(got) <= set(every)
    else:
        assert got == every  # nothing here is boilerplate or a benchmark item
    if name != "source_mixing":
        assert all(r.cls == 1 and r.token == "t" and r.taken == "x" for r in out)
    assert stage(spark, df.limit(0), SF).count() == 0


def test_near_duplicates_stage_keeps_one_of_equal_rows(spark):
    rows = [(1, "a b c d e f", "s"), (1, "a b c d e f", "s"), (2, "a b c d e f", "s"), (3, "", "s"), (3, "", "s"), (4, None, "s")]
    out = corpus_pipeline.near_duplicates(spark, frame(spark, rows), SF)
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter([(1, "a b c d e f"), (3, ""), (3, ""), (4, None)])


def test_near_duplicates_stage_tells_rows_of_one_id_apart(spark):
    near = [" ".join([*(f"p{i}" for i in range(60)), x]) for x in "xyz"]
    only = [" ".join(f"{x}{i}" for i in range(30)) for x in "abcd"]
    rows = [(1, near[0], "s"), (5, near[1], "s"), (5, only[0], "s"), (5, "", "s")]  # 5: one row goes, the others are unique
    rows += [(7, only[1] + " v", "s"), (7, only[1] + " w", "s")]  # near rows of one id
    rows += [(None, near[2], "s"), (None, only[2], "s"), (None, only[2] + " u", "s"), (None, only[2], "s"), (None, only[3], "s"), (None, None, "s")]
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, frame(spark, rows), SF).collect())
    assert [got.pop((7, f"{only[1]} {x}"), 0) for x in "vw"].count(1) == 1
    assert [got.pop((None, only[2] + x), 0) for x in ("", " u")].count(1) == 1
    assert got == Counter([(1, near[0]), (5, only[0]), (5, ""), (None, only[3]), (None, None)])
    assert [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, frame(spark, [(2, only[0], "s"), (9, only[0], "s")]), SF).collect()] == [(2, only[0])]


def test_training_is_bounded(spark):
    docs = frame(spark, [(i, f"text number {i} " * 20, "s") for i in range(500)])
    m = langid.train(docs, max_bytes=3_000, max_texts=100)
    assert m["langs"] == ["en"] and m["trees"][0][0]["counts"].sum() < 4_000
