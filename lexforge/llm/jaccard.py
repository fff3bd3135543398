"""Exact n-gram Jaccard self-join with components (near-duplicate classes).

Documents become sets of k-word shingles (64-bit hashes). Equal sets collapse into one class first. Two
classes can only reach the threshold if their prefixes - the first n - ceil(t n) + 1 shingles in one global
order - share a shingle, so classes meet in tiles keyed by a prefix shingle. Inside a tile members are
sorted by set size, and a size band bounds the partners of each. Every pair left is bounded by hashed bitmap
signatures: a parity bitmap's Hamming distance never exceeds the symmetric difference, so (a + b -
popcount(xor)) / 2 bounds the overlap from above. What passes is decided by exact intersection of the sorted
shingle arrays.

The order puts frequent shingles last. Frequencies of shingles that meet within a scan block are counted over
all documents, and the most frequent, as many as a bitmap of fixed size can tell apart, go into it: any bitmap
gives one order for all, so it only affects speed. Signatures come in two widths: a thin one of about the set's
size in bits meets every candidate pair, the wide one only what the thin one leaves. Links are verified in three rounds. The first proposes one leader per class. Of tiles that
then still join several components, the second proposes every pair across them in small tiles and a spanning
forest in large ones, the last every pair across components in large ones - each as far as size band and
signatures don't exclude it - so that no link between different components is left unseen.
Pairs inside one component are never expanded. Large tiles are dealt into chunks of TILE members at most.

Class handles are 64 bits of a 128-bit digest of the shingle set; the other half is compared, and where two sets
share a handle everything is worked out again with other digests. Shingles themselves are 64-bit hashes of
their words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexforge.llm.common import Words, broadcast_if_small, connected_components, discard, map_arrow, materialize, mix64, release, slices

_U = np.uint64
HOT_BITS = 26
#: a shingle is frequent from this count on; doubled until no more than 2**HOT_BITS / HOT_FILL shingles are
HOT_AT = 2
HOT_FILL = 8
TILE = 2048
#: narrow rows (two to four longs) that may be broadcast after a count
SMALL_ROWS = 250_000
#: shingles gathered before a block is counted or packed
BLOCK = 500_000

META = "cls long, check long, n int, thin binary, sig binary, token long, seen int"


def parity_signature(s: np.ndarray) -> bytes:
    """Parity bitmap of a power-of-two number of bits, at least four times the set's size (64 to 65,536).

    Fewer bits would lose much of a small difference to collisions, and let pairs just below the threshold pass.
    """
    bits = 1 << min(16, max(6, int(4 * len(s) - 1).bit_length()))
    counts = np.bincount((s & _U(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def fold(sig: np.ndarray, size: int) -> np.ndarray:
    """Fold signatures (rows of bytes) to size bytes; parities of merged bits add up, so bounds stay true."""
    while sig.shape[-1] > size:
        h = sig.shape[-1] // 2
        sig = sig[..., :h] ^ sig[..., h:]
    return sig


def thin(sig: bytes) -> bytes:
    """A signature folded to a quarter (64 bits at least): one to two bits a shingle."""
    x = np.frombuffer(sig, np.uint8)
    return fold(x, max(8, len(x) // 4)).tobytes()


def need(a, b, percent: int):
    """Smallest overlap with 100 * overlap >= percent * union."""
    return -(-percent * (a + b) // (100 + percent))


def digests(s: np.ndarray, salt: int = 0) -> tuple[int, int]:
    """128-bit digest of a set as two longs, another one for each salt."""
    a = int(mix64(s + _U(0x51ED270B + salt)).sum(dtype=np.uint64))
    b = int(mix64(s ^ _U(0xA5A5A5A55A5A5A5A + salt)).sum(dtype=np.uint64))
    return a - (1 << 64) if a >= 1 << 63 else a, b - (1 << 64) if b >= 1 << 63 else b


def _texts(batch: pa.RecordBatch, name: str = "text"):
    for a, b in slices(batch.column(name)):
        yield a, b, batch.slice(a, b - a)


def _scan(id_columns: list[str], k: int, salt: int):
    """Rows of documents: id columns, class, size and signatures; and (token, seen) for shingles met twice or more in a block."""
    names = [*id_columns, "cls", "check", "n", "thin", "sig", "token", "seen"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, classes, size = [], set(), 0

        def flush():
            tokens, counts = np.unique(np.concatenate(held), return_counts=True)
            tokens, counts = tokens[counts > 1], counts[counts > 1]
            m = len(tokens)
            none = [pa.nulls(m, pa.int64())] * (len(id_columns) + 2) + [pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.binary())]
            return pa.RecordBatch.from_arrays([*none, pa.array(tokens.view(np.int64)), pa.array(counts.astype(np.int32))], names=names)

        for batch in batches:
            for _, _, part in _texts(batch):
                rows = []
                for s in Words(part.column("text"), lower=True).shingle_sets(k):
                    c, d = digests(s, salt)
                    wide = parity_signature(s)
                    rows.append((c, d, len(s), thin(wide), wide))
                    if len(s) and c not in classes:
                        classes.add(c)
                        held.append(s)
                        size += len(s)
                m = len(rows)
                cols = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(c).cast(pa.int64()) for c in id_columns), *cols, pa.nulls(m, pa.int64()), pa.nulls(m, pa.int32())], names=names)
                if size >= BLOCK:
                    yield flush()
                    held, classes, size = [], set(), 0
        if held:
            yield flush()
        release()

    return run


def _hot_bits(scan: DataFrame, hot_at: int) -> np.ndarray:
    """Fixed-size bitmap of the shingles seen most often (2**HOT_BITS bits, which reach the driver as blocks of BLOCK_WORDS words).

    hot_at is doubled until at most 2**HOT_BITS / HOT_FILL shingles reach it, so that the bitmap tells them from others.
    """
    counted = scan.where("token is not null").groupBy("token").agg(F.sum("seen").alias("seen")).where(F.col("seen") >= hot_at)
    counted = materialize(counted)
    steps = [(r.e, r.n) for r in counted.groupBy(F.floor(F.log2(F.col("seen") / hot_at)).alias("e")).agg(F.count("*").alias("n")).collect()]
    up = 0
    while sum(n for e, n in steps if e >= up) > (1 << HOT_BITS) // HOT_FILL:
        up += 1
    bit = F.shiftrightunsigned("token", 20).bitwiseAND(F.lit((1 << HOT_BITS) - 1))
    out = _bitmap_of(counted.where(F.col("seen") >= hot_at << up).select(bit.alias("bit")), "bit")
    discard(counted)
    return out


def _is_hot(bits: np.ndarray, s: np.ndarray) -> np.ndarray:
    b = (s >> _U(20)) & _U((1 << HOT_BITS) - 1)
    return (bits[(b >> _U(6)).astype(np.int64)] >> (b & _U(63))) & _U(1) == 1


TOKEN_BYTES = 5


def _entries(bits, percent: int, parts: int, k: int, salt: int):
    """Prefix entries packed by part: each class once with its size and number of tokens, and TOKEN_BYTES of each token.

    A token's part is a hash of all its bits, so part and TOKEN_BYTES tell tokens apart nearly always; where they don't, a
    tile holds the classes of both.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = bits.value
        tokens, owners, sizes, classes, held = [], [], [], set(), 0

        def flush():
            t = np.concatenate(tokens)
            owner = np.repeat(np.arange(len(owners)), [len(x) for x in tokens])
            p = (mix64(t) % _U(parts)).astype(np.int64)
            order = np.lexsort((owner, p))
            t, owner, p = t[order], owner[order], p[order]
            raw = np.ascontiguousarray(t.view(np.uint8).reshape(-1, 8)[:, :TOKEN_BYTES])
            c, n = np.array(owners, np.int64), np.array(sizes, np.int32)
            at = np.flatnonzero(np.concatenate(([True], p[1:] != p[:-1], [True])))
            rows = []
            for a, b in zip(at[:-1], at[1:], strict=True):
                own, count = np.unique(owner[a:b], return_counts=True)
                rows.append((int(p[a]), raw[a:b].tobytes(), c[own].tobytes(), n[own].tobytes(), count.astype(np.int32).tobytes()))
            kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=["part", "tokens", "classes", "sizes", "counts"])

        for batch in batches:
            for _, _, part in _texts(batch):
                for s in Words(part.column("text"), lower=True).shingle_sets(k):
                    if not len(s):
                        continue
                    c, _ = digests(s, salt)
                    if c in classes:
                        continue
                    classes.add(c)
                    keep = len(s) - (-(-percent * len(s) // 100)) + 1
                    flag = _is_hot(hot, s)
                    prefix = s[~flag][:keep]
                    if len(prefix) < keep:
                        prefix = np.concatenate([prefix, s[flag][: keep - len(prefix)]])
                    tokens.append(prefix)
                    owners.append(c)
                    sizes.append(len(s))
                    held += keep
                if held >= BLOCK:
                    yield flush()
                    tokens, owners, sizes, classes, held = [], [], [], set(), 0
        if held:
            yield flush()
        release()

    return run


def _meet(percent: int):
    """One part's tokens: those of two classes or more; votes of each class for its tile's smallest handle."""

    def run(table: pa.Table) -> pa.Table:
        join = lambda name, kind: np.frombuffer(b"".join(table.column(name).to_pylist()), kind)
        raw = join("tokens", np.uint8).reshape(-1, TOKEN_BYTES)
        wide = np.zeros((len(raw), 8), np.uint8)
        wide[:, :TOKEN_BYTES] = raw
        t = wide.view(np.uint64).ravel() | _U(table.column("part")[0].as_py() << 8 * TOKEN_BYTES)
        count = join("counts", np.int32)
        c, n = np.repeat(join("classes", np.int64), count), np.repeat(join("sizes", np.int32), count)
        order = np.lexsort((c, n, t))
        t, c, n = t[order], c[order], n[order]
        new = np.concatenate(([True], (t[1:] != t[:-1]) | (c[1:] != c[:-1])))
        t, c, n = t[new], c[new], n[new]
        at = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1])))
        count = np.diff(np.append(at, len(t)))
        m = np.repeat(count, count)
        # the leader is the smallest handle; members it can't match by size are left to later rounds
        lead = np.repeat(np.minimum.reduceat(c, at), count)
        # a member with no partner of its size band in the tile can't link there
        fits = (t[1:] == t[:-1]) & (100 * n[:-1].astype(np.int64) >= percent * n[1:].astype(np.int64)) if len(t) else np.zeros(0, bool)
        keep = (m > 1) & (np.append(fits, False) | np.insert(fits, 0, False)) if len(t) else m > 1
        t, c, n, m, lead = t[keep], c[keep], n[keep], m[keep], lead[keep]
        pairs = np.stack([c, lead])[:, c != lead]
        if pairs.shape[1]:
            order = np.lexsort(pairs)
            pairs = pairs[:, order]
            new = np.flatnonzero(np.concatenate(([True], (pairs[:, 1:] != pairs[:, :-1]).any(axis=0))))
            votes, pairs = np.diff(np.append(new, pairs.shape[1])), pairs[:, new]
        else:
            votes = np.zeros(0, np.int64)
        a, b = len(t), len(votes)
        return pa.table(
            {
                "token": pa.concat_arrays([pa.array(t.view(np.int64)), pa.nulls(b, pa.int64())]),
                "cls": pa.concat_arrays([pa.array(c), pa.array(pairs[0])]),
                "n": pa.concat_arrays([pa.array(n), pa.nulls(b, pa.int32())]),
                "m": pa.concat_arrays([pa.array(m.astype(np.int32)), pa.nulls(b, pa.int32())]),
                "leader": pa.concat_arrays([pa.nulls(a, pa.int64()), pa.array(pairs[1])]),
                "votes": pa.concat_arrays([pa.nulls(a, pa.int32()), pa.array(votes.astype(np.int32))]),
            }
        )

    return run


def _arrays(wanted, k: int, salt: int):
    """Sorted shingle arrays of rows whose id is in a bitmap (false positives go at the join); a null id counts as -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = wanted.value
        for batch in batches:
            ids = batch.column("id").fill_null(-1).to_numpy().view(np.uint64) & _U((1 << HOT_BITS) - 1)
            hit = (flags[(ids >> _U(6)).astype(np.int64)] >> (ids & _U(63))) & _U(1) == 1
            if not hit.any():
                continue
            for _, _, part in _texts(batch.filter(pa.array(hit))):
                rows = [(digests(s, salt)[0], s.tobytes()) for s in Words(part.column("text"), lower=True).shingle_sets(k) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["cls", "shingles"])
        release()

    return run


#: words of a bitmap in a block; a bitmap reaches the driver as blocks, since a row for each word takes 30 times its bytes there
BLOCK_WORDS = 1 << 12


def _pack_words(table: pa.Table) -> pa.Table:
    """The words (w, v) of one block as bytes."""
    at = table.column("w").to_numpy()
    words = np.zeros(BLOCK_WORDS, np.uint64)
    words[at % BLOCK_WORDS] = table.column("v").to_numpy().view(np.uint64)
    return pa.table({"block": pa.array([int(at[0]) // BLOCK_WORDS], pa.int64()), "words": pa.array([words.tobytes()], pa.binary())})


def _bitmap_blocks(df: DataFrame, column: str, bits: int = HOT_BITS) -> DataFrame:
    """(block, words) of a bitmap over the low bits of a long column: the blocks in which a bit is set, BLOCK_WORDS words each."""
    low = df.select(F.col(column).bitwiseAND(F.lit((1 << bits) - 1)).alias("b"))
    words = low.where("b is not null").groupBy(F.shiftrightunsigned("b", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("v"))
    return words.groupBy(F.floor(F.col("w") / BLOCK_WORDS).alias("block")).applyInArrow(_pack_words, "block long, words binary")


def _bitmap_of(df: DataFrame, column: str, bits: int = HOT_BITS) -> np.ndarray:
    """Bitmap of fixed size over the low bits of a long column."""
    out = np.zeros(max(1 << (bits - 6), BLOCK_WORDS), np.uint64)
    for block, words in _bitmap_blocks(df, column, bits).collect():
        out[block * BLOCK_WORDS : (block + 1) * BLOCK_WORDS] = np.frombuffer(words, np.uint64)
    return out


def _decide(percent: int):
    """Exact intersection of sorted arrays: keep pairs whose Jaccard similarity reaches the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v = batch.column("u").to_pylist(), batch.column("v").to_pylist()
            x, y = batch.column("x"), batch.column("y")
            ok = []
            for i in range(batch.num_rows):
                a, b = np.frombuffer(x[i].as_buffer(), np.uint64), np.frombuffer(y[i].as_buffer(), np.uint64)
                if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
                    ok.append(False)
                    continue
                both = np.concatenate([a, b])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                ok.append(100 * common >= percent * (len(a) + len(b) - common))
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(ok, pa.bool_())], names=["u", "v", "ok"])
        release()

    return run


def _within_bounds(percent: int):
    """Pairs that size band and signatures can't exclude."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("a").to_numpy().astype(np.int64), batch.column("b").to_numpy().astype(np.int64)
            keep = (100 * np.minimum(a, b) >= percent * np.maximum(a, b)) & (need(a, b, percent) <= np.minimum(a, b))
            x, y = batch.column("x"), batch.column("y")
            for i in np.flatnonzero(keep):
                s, t = np.frombuffer(x[i].as_buffer(), np.uint8), np.frombuffer(y[i].as_buffer(), np.uint8)
                size = min(len(s), len(t))
                apart = int(np.bitwise_count(fold(s, size).view(np.uint64) ^ fold(t, size).view(np.uint64)).sum())
                keep[i] = (a[i] + b[i] - apart) // 2 >= need(a[i], b[i], percent)
            yield batch.filter(pa.array(keep)).select(["u", "v"])
        release()

    return run


def _verify(pairs: DataFrame, src: DataFrame, owners: DataFrame, percent: int, k: int, salt: int) -> DataFrame:
    """pairs (u, v), distinct -> (u, v, ok), materialised. owners: (cls, id), the row whose text stands for a class."""
    ends = pairs.select(F.col("u").alias("cls")).union(pairs.select(F.col("v").alias("cls"))).distinct()
    ends = materialize(owners.join(broadcast_if_small(materialize(ends), SMALL_ROWS), "cls", "left_semi"))
    wanted = src.sparkSession.sparkContext.broadcast(_bitmap_of(ends.select(F.coalesce("id", F.lit(-1)).alias("id")), "id"))
    arrays = materialize(map_arrow(src, _arrays(wanted, k, salt), "cls long, shingles binary").join(broadcast_if_small(ends.select("cls"), SMALL_ROWS), "cls", "left_semi"))
    x = arrays.select(F.col("cls").alias("u"), F.col("shingles").alias("x"))
    y = arrays.select(F.col("cls").alias("v"), F.col("shingles").alias("y"))
    joined = x.join(broadcast_if_small(pairs, SMALL_ROWS), "u").join(y, "v").select("u", "v", "x", "y")
    out = materialize(map_arrow(joined, _decide(percent), "u long, v long, ok boolean").distinct())
    discard(arrays)
    discard(ends)
    wanted.unpersist()
    return out


class _Tile:
    """Pairs of one tile across components that size band and signature bounds leave."""

    def __init__(self, percent: int):
        self.percent = percent

    def pairs(self, cls, n, comp, sig, chunk):
        order = np.argsort(n, kind="stable")
        cls, n, comp, chunk = cls[order], n[order], comp[order], chunk[order]
        sig = [np.frombuffer(sig[i], np.uint8) for i in order]
        across = chunk.max() != chunk.min()
        out_u, out_v, out_w = [], [], []
        sizes = np.array([len(s) for s in sig])
        for size in np.unique(sizes):  # partners of a smaller signature are folded to it
            rows = np.flatnonzero(sizes == size)
            last = int(np.searchsorted(n, n[rows].max() * 100 // self.percent, "right"))
            others = np.arange(rows[0], last)
            others = others[sizes[others] >= size]
            if not len(others):
                continue
            table = np.stack([fold(sig[j], size) for j in others])
            wide = np.ascontiguousarray(table).view(np.uint64)
            where = {int(j): p for p, j in enumerate(others)}
            for i in rows:
                p = where[int(i)]
                end = int(np.searchsorted(n[others], n[i] * 100 // self.percent, "right"))
                q = np.arange(p + 1, end)
                if len(q):
                    q = q[comp[others[q]] != comp[i]]
                if across and len(q):
                    q = q[chunk[others[q]] != chunk[i]]
                if not len(q):
                    continue
                apart = np.bitwise_count(wide[q] ^ wide[p]).sum(axis=1).astype(np.int64)
                j = others[q]
                most = (n[i] + n[j] - apart) // 2
                good = most >= need(n[i].astype(np.int64), n[j].astype(np.int64), self.percent)
                if good.any():
                    j, most = j[good], most[good]
                    out_u.append(np.full(len(j), cls[i]))
                    out_v.append(cls[j])
                    out_w.append(most / (n[i] + n[j]))
        if not out_u:
            return np.zeros((2, 0), np.int64), np.zeros(0)
        return np.stack([np.concatenate(out_u), np.concatenate(out_v)]), np.concatenate(out_w)

    def small(self, key, cls, n, comp):
        """Pairs (u < v) of many small tiles (rows sorted by key) that the size band leaves, each once however many tiles share it."""
        found, live, d = [], np.arange(len(key)), 1
        while True:
            live = live[live + d < len(key)]
            live = live[key[live] == key[live + d]]
            if not len(live):
                break
            i, j = live, live + d
            good = (comp[i] != comp[j]) & (100 * np.minimum(n[i], n[j]) >= self.percent * np.maximum(n[i], n[j]))
            found.append(np.stack([cls[i[good]], cls[j[good]]]))
            d += 1
        if not found or not (pair := np.concatenate(found, axis=1)).shape[1]:
            return np.zeros((2, 0), np.int64)
        pair = np.sort(pair, axis=0)
        order = np.lexsort(pair)
        pair = pair[:, order]
        return pair[:, np.concatenate(([True], (pair[:, 1:] != pair[:, :-1]).any(axis=0)))]

    def forest(self, pair, weight, comp_of):
        """A spanning forest of highest bounds over components."""
        parent: dict[int, int] = {}

        def find(x):
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        keep = []
        for i in np.lexsort((pair[1], pair[0], -weight)):
            a, b = find(comp_of[int(pair[0, i])]), find(comp_of[int(pair[1, i])])
            if a != b:
                parent[max(a, b)] = min(a, b)
                keep.append(i)
        return pair[:, keep]


#: tiles up to this many members are expanded into pairs before signatures are fetched
SMALL_TILE = 64


def _by_tile(one, large: bool):
    """Stream rows sorted by key and hand one() whole tiles: each tile alone, or (large=False) all that a batch completes."""

    def emit(rows: list[pa.RecordBatch]):
        table = pa.Table.from_batches(rows).combine_chunks()
        if not large:
            found = [one(table)]
        else:
            key = table.column("key").to_numpy()
            at = np.append(np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))), len(key))
            found = [one(table.slice(a, b - a)) for a, b in zip(at[:-1], at[1:], strict=True)]
        pair = np.concatenate(found, axis=1)
        return pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column("key").to_numpy()
            if rest and key[0] != rest[-1].column("key")[-1].as_py():
                yield emit(rest)
                rest = []
            cut = int(np.searchsorted(key == key[-1], True)) if key[0] != key[-1] else 0
            if cut:
                yield emit([*rest, batch.slice(0, cut)])
                rest = []
            rest.append(batch.slice(cut))
        if rest:
            yield emit(rest)

    return run


def _small_tiles(percent: int):
    tile = _Tile(percent)

    def one(rows: pa.Table):
        key, cls, n, comp = (rows.column(c).to_numpy() for c in ("key", "cls", "n", "comp"))
        return tile.small(key, cls, n.astype(np.int64), comp)

    return _by_tile(one, large=False)


def _large_tiles(percent: int, forest: bool):
    tile = _Tile(percent)

    def one(rows: pa.Table):
        cls, n, comp, chunk = (rows.column(c).to_numpy() for c in ("cls", "n", "comp", "chunk"))
        if comp.min() == comp.max():
            return np.zeros((2, 0), np.int64)
        pair, weight = tile.pairs(cls, n.astype(np.int64), comp, rows.column("sig").to_pylist(), chunk)
        if forest and pair.shape[1]:
            pair = tile.forest(pair, weight, dict(zip(cls.tolist(), comp.tolist(), strict=True)))
        return np.sort(pair, axis=0)

    return _by_tile(one, large=True)


def _bounded(pairs: DataFrame, sigs: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) that size band, thin and then wide signatures leave, materialised."""
    for column in ("thin", "sig"):
        x = sigs.select(F.col("cls").alias("u"), F.col("n").alias("a"), F.col(column).alias("x"))
        y = sigs.select(F.col("cls").alias("v"), F.col("n").alias("b"), F.col(column).alias("y"))
        small = broadcast_if_small(pairs, SMALL_ROWS)
        left = materialize(map_arrow(small.join(x, "u").join(y, "v"), _within_bounds(percent), "u long, v long"))
        discard(pairs)
        pairs = left
    return pairs


def _mixed(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of tiles that still join several components, with the component of each."""
    rows = rows.join(broadcast_if_small(labels, SMALL_ROWS), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    mixed = materialize(rows.groupBy("token").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a <> b").select("token"))
    return rows.join(broadcast_if_small(mixed, SMALL_ROWS), "token", "left_semi")


def _small_pairs(shared: DataFrame, labels: DataFrame, sigs: DataFrame, percent: int) -> DataFrame:
    """Pairs across components of small tiles; a tile of one component alone has none, so tiles needn't be told apart before."""
    rows = shared.where(F.col("m") <= SMALL_TILE).join(broadcast_if_small(labels, SMALL_ROWS), "cls", "left")
    rows = rows.select(F.col("token").alias("key"), "cls", "n", F.coalesce("comp", "cls").alias("comp"))
    pairs = map_arrow(rows.repartition("key").sortWithinPartitions("key"), _small_tiles(percent), "u long, v long").distinct()
    return _bounded(materialize(pairs), sigs, percent)


def _large_pairs(shared: DataFrame, labels: DataFrame, sigs: DataFrame, percent: int, forest: bool) -> DataFrame:
    """Large tiles: members of a tile's largest component meet only the others, which also meet each other.

    Both sides are dealt into chunks of TILE at most. While one component holds most of a tile, its members are not
    repeated, so rows grow with the tile and not with its square.
    """
    rows = _mixed(shared.where(F.col("m") > SMALL_TILE), labels).select("token", "cls", "n", "comp")
    sizes = rows.groupBy("token", "comp").agg(F.count("*").alias("c"))
    main = sizes.groupBy("token").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.max("c").alias("most"), F.sum("c").alias("all"))
    chunks = lambda c: F.greatest(F.lit(1), F.ceil(c / TILE)).cast("int")
    main = main.select("token", "main", chunks(F.col("most")).alias("km"), chunks(F.col("all") - F.col("most")).alias("kr"))
    rows = rows.join(main, "token")
    inside = F.col("comp") == F.col("main")
    own = F.pmod(F.xxhash64("cls"), F.when(inside, F.col("km")).otherwise(F.col("kr"))).cast("int")
    up_to = lambda k: F.sequence(F.lit(0), k - 1)
    key = lambda kind, i, j: F.xxhash64("token", F.lit(kind), i, j)
    member = F.transform(up_to(F.col("kr")), lambda j: F.struct(key("main", F.col("own"), j).alias("key"), F.lit(-1).alias("chunk")))
    other = F.transform(up_to(F.col("km")), lambda i: F.struct(key("main", i, F.col("own")).alias("key"), F.col("own").alias("chunk")))
    among = F.transform(up_to(F.col("kr")), lambda j: F.struct(key("rest", F.least(j, F.col("own")), F.greatest(j, F.col("own"))).alias("key"), F.col("own").alias("chunk")))
    rows = rows.withColumn("own", own).withColumn("place", F.explode(F.when(inside, member).otherwise(F.concat(other, among))))
    rows = rows.select("cls", "n", "comp", "place.key", "place.chunk")
    rows = rows.join(sigs.select("cls", "sig"), "cls").select("key", "cls", "n", "comp", "chunk", "sig")
    pairs = map_arrow(rows.repartition("key").sortWithinPartitions("key"), _large_tiles(percent, forest), "u long, v long")
    return materialize(pairs.distinct())


def text_key(text: Column) -> Column:
    """64-bit digest of a text, by which rows of one id are told apart."""
    return F.xxhash64(text)


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, k: int = 5, hot_at: int = HOT_AT, row_key: bool = False) -> DataFrame:
    """Size of each document's shingle set and the smallest id that links reach.

    Returns one row per input row: id_col, n_shingles long, component_id long. Words are runs of anything but
    ASCII white space, A-Z lower-cased; a text of 1 to k-1 words has its whole sequence as its only shingle; a
    null or empty text has none, links with nothing and keeps its own id. Documents link when 100 *
    intersection >= percent * union. Repeated rows and repeated ids give a row each; a null id stays null
    and is passed over when the smallest is taken. Other columns are ignored, an empty table gives none.

    row_key adds text_key (text_key() of the text), which tells rows of one id apart, and group, a handle of the
    component itself: repeated and null ids can give several components one component_id. Both are longs.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    keys = ["id", "text_key"] if row_key else ["id"]
    keyed = src.withColumn("text_key", text_key(F.col("text"))) if row_key else src
    for salt in range(8):
        scan = materialize(map_arrow(keyed, _scan(keys, k, salt), f"{', '.join(f'{x} long' for x in keys)}, {META}"))
        meta = scan.where("seen is null")
        handles = meta.where("n > 0").groupBy("cls").agg(F.min("check").alias("a"), F.max("check").alias("b"))
        if handles.where("a <> b").isEmpty():
            break
        discard(scan)
    else:
        raise RuntimeError("sets clash under every digest")
    stats = meta.where("n > 0").agg(F.sum(F.col("n").cast("long"))).first()[0] or 0
    parts = max(12, int(stats * (100 - percent) // 100 // 400_000))
    hot = spark.sparkContext.broadcast(_hot_bits(scan, hot_at))
    packed = map_arrow(src.select("text"), _entries(hot, percent, parts, k, salt), "part int, tokens binary, classes binary, sizes binary, counts binary")
    met = materialize(packed.groupBy("part").applyInArrow(_meet(percent), "token long, cls long, n int, m int, leader long, votes int"))
    hot.unpersist()
    shared = met.where("token is not null")
    best = met.where("leader is not null").groupBy("cls", "leader").agg(F.sum("votes").alias("votes"))
    best = best.groupBy("cls").agg(F.max_by("leader", F.struct("votes", -F.col("leader"))).alias("leader"))
    best = materialize(best.select(F.least("cls", "leader").alias("u"), F.greatest("cls", "leader").alias("v")).distinct())
    ends = materialize(shared.select("cls").distinct())
    sigs = meta.where("n > 0").join(broadcast_if_small(ends, SMALL_ROWS), "cls", "left_semi").groupBy("cls")
    sigs = materialize(sigs.agg(F.min("n").alias("n"), F.min("thin").alias("thin"), F.min("sig").alias("sig"), F.min("id").alias("id")))
    discard(ends)
    owners = sigs.select("cls", "id")
    pairs = _bounded(best, sigs, percent)
    tested = _verify(pairs, src, owners, percent, k, salt)
    discard(pairs)
    links = tested.where("ok").select("u", "v")
    labels = _labels(links)
    for propose in (
        lambda: (_small_pairs(shared, labels, sigs, percent), _large_pairs(shared, labels, sigs, percent, True)),
        lambda: (_large_pairs(shared, labels, sigs, percent, False),),
    ):
        found = propose()
        union = found[0] if len(found) == 1 else found[0].unionByName(found[1])
        fresh = materialize(union.distinct().join(broadcast_if_small(tested.select("u", "v"), SMALL_ROWS), ["u", "v"], "left_anti"))
        for x in found:
            discard(x)
        if fresh.isEmpty():
            continue
        checked = _verify(fresh, src, owners, percent, k, salt)
        discard(fresh)
        tested, links = tested.unionByName(checked), links.unionByName(checked.where("ok").select("u", "v"))
        if not checked.where("ok").isEmpty():
            labels = _labels(links)
    discard(met)
    discard(sigs)
    classes = meta.join(labels, "cls", "left")
    # documents without shingles stay alone; the others group by component or class
    classes = classes.withColumn("comp", F.coalesce("comp", "cls"))
    least = classes.where("n > 0").groupBy("comp").agg(F.min("id").alias("low"))
    out = classes.join(least, "comp", "left")
    return out.select(
        F.col("id").alias(id_col),
        F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("low")).otherwise(F.col("id")).alias("component_id"),
        *([F.col("text_key"), F.col("comp").alias("group")] if row_key else []),
    )


def _labels(links: DataFrame) -> DataFrame:
    return connected_components(links).select(F.col("node").alias("cls"), F.col("component").alias("comp"))
