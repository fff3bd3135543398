"""Benchmark decontamination: SimHash windows, multi-index Hamming blocks, exact weighted-shingle check.

Documents and benchmark items become words. An item of L words is compared with windows of nearly its own size: the
largest grid length that a passage at the threshold still holds when all it may lose is lost at one end. The item's
windows of that length, and a document's on a grid of starts, get 64-bit SimHash fingerprints of their words; edits
inside a window move its fingerprint by some bits, and fingerprints within RADIUS bits are looked up.

The index is a multi-index of BLOCKS blocks of bits. Of prints within RADIUS = BLOCKS * (NEAR + 1) - 1 bits, one block at
least differs in NEAR bits or fewer, so each entry is kept under every value within NEAR bits of its own in each block:
one lookup a block finds all fingerprints within RADIUS, and a bitmap of fixed size a block spares most lookups.

Each hit puts the item over the document where the windows align, and the weighted Jaccard similarity of the k-word
shingles (weights: how often each occurs) of the item and item-sized windows around there decides. That fingerprints
of a passage at the threshold lie within RADIUS is likely, not certain: measured recall is in the README.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import combinations, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.llm.common import Words, map_arrow, release, slices

_U = np.uint64
#: window lengths: each up to 10, then about a seventh apart; counters of the fingerprints hold windows below 256
WINDOWS = (*range(1, 11), *sorted({round(10 * 1.15**i) for i in range(1, 24)}))
BLOCKS, NEAR = 3, 2
RADIUS = BLOCKS * (NEAR + 1) - 1
#: bytes of a built index that go to every executor at once; more items take several passes
INDEX_BYTES = 64 << 20
#: words of a document fingerprinted at a time
SPAN = 100_000


def lost(length: int, k: int = 5, percent: int = 75) -> int:
    """Shingles that a passage at the threshold may lose of an item of length words: (S - x) / (S + x) >= t."""
    return (100 - percent) * max(1, length - k + 1) // (100 + percent)


def window_of(length: int, k: int = 5, percent: int = 75) -> tuple[int, int]:
    """(window length, step between a document's window starts) for an item."""
    size = max(w for w in WINDOWS if w <= max(1, length - lost(length, k, percent)))
    return size, 1 if size < 24 else 2 if size < 40 else 3 if size < 64 else size // 20


def item_starts(length: int, size: int, step: int) -> np.ndarray:
    """Starts of an item's indexed windows: all of them, or of a long item runs of step starts half a window apart.

    A run of step starts in a row meets some window of any document start grid in step with it.
    """
    last = length - size
    if last < 64:
        return np.arange(last + 1)
    runs = [np.arange(a, min(a + step, last + 1)) for a in range(0, last + 1, max(step, size // 2))]
    return np.unique(np.concatenate([*runs, np.arange(max(0, last - step + 1), last + 1)]))


#: byte -> its eight bits as eight byte-wide counters of one 64-bit lane
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def prefix_bits(hashes: np.ndarray) -> np.ndarray:
    """Running bit counts as packed lanes. Carries between counters cancel in differences, which are exact for windows below 256."""
    out = np.zeros((len(hashes) + 1, 8), np.uint64)
    np.cumsum(_LANES[np.ascontiguousarray(hashes).view(np.uint8)].reshape(-1, 8), axis=0, out=out[1:])
    return out


def fingerprints(hashes: np.ndarray, window: int, starts: np.ndarray, sums: np.ndarray | None = None) -> np.ndarray:
    """SimHash of the words hashes[s : s + window] for each start: a bit is set where most words have it."""
    if sums is None:
        sums = prefix_bits(hashes)
    votes = (sums[starts + window] - sums[starts]).view(np.uint8)
    return np.packbits(votes > window // 2, axis=1, bitorder="little").reshape(-1, 8).view(np.uint64).ravel()


class HammingIndex:
    """Fingerprints found by any query within blocks * (near + 1) - 1 bits of them."""

    def __init__(self, prints: np.ndarray, blocks: int = BLOCKS, near: int = NEAR):
        self.prints, self.radius, self.blocks = prints, blocks * (near + 1) - 1, []
        edges = np.linspace(0, 64, blocks + 1).round().astype(int).tolist()
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            flips = np.array([sum(1 << i for i in c) for m in range(near + 1) for c in combinations(range(b - a), m)], np.uint32)
            own = ((prints >> _U(a)) & _U((1 << (b - a)) - 1)).astype(np.uint32)
            value = (own[:, None] ^ flips).ravel()
            order = np.argsort(value, kind="stable")
            present = np.zeros(1 << (b - a), bool)
            present[value] = True
            self.blocks.append((_U(a), _U((1 << (b - a)) - 1), value[order], (order // len(flips)).astype(np.int32), np.packbits(present, bitorder="little")))

    @property
    def nbytes(self) -> int:
        return self.prints.nbytes + sum(v.nbytes + e.nbytes + p.nbytes for _, _, v, e, p in self.blocks)

    def search(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, entry) within radius, each once."""
        found = []
        for shift, mask, value, entry, present in self.blocks:
            v = ((queries >> shift) & mask).astype(np.uint32)
            some = np.flatnonzero((present[v >> np.uint32(3)] >> (v & np.uint32(7)).astype(np.uint8)) & np.uint8(1))
            if not len(some):
                continue
            a, b = np.searchsorted(value, v[some], "left"), np.searchsorted(value, v[some], "right")
            n = b - a
            q = np.repeat(some, n)
            e = entry[np.repeat(a, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            close = np.bitwise_count(queries[q] ^ self.prints[e]) <= self.radius
            found.append(q[close] * len(self.prints) + e[close])
        pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        return pairs // max(1, len(self.prints)), pairs % max(1, len(self.prints))


def weighted_jaccard(a: Counter, b: Counter) -> float:
    low = sum(min(n, b[x]) for x, n in a.items() if x in b)
    high = sum(a.values()) + sum(b.values()) - low
    return low / high if high else 0.0


def shingle_weights(words: list[int], k: int) -> Counter:
    """Shingles with their counts; fewer than k words have the whole sequence as one."""
    if not words:
        return Counter()
    return Counter(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def entry_bytes(length: int, k: int = 5, percent: int = 75) -> int:
    """Bytes that an item of length words takes in a built index, all but the bitmaps."""
    values = sum(1 + b + b * (b - 1) // 2 for b in (22, 21, 21))
    return len(item_starts(length, *window_of(length, k, percent))) * (8 * values + 28) + 24 * length if length else 0


class ItemIndex:
    """Items by window length, in arrays alone."""

    def __init__(self, items: list[tuple[int, str]], k: int = 5, percent: int = 75):
        self.k, self.percent = k, percent
        self.ids = [i for i, _ in items]
        words = Words(pa.array([t for _, t in items], pa.string()), lower=True)
        shingles, _ = words.shingles(k)
        self.words = [words.hash[words.first[r] : words.first[r + 1]] for r in range(words.rows)]
        #: sorted distinct shingles of each item of k words or more, and their weights
        self.sets = [np.unique(shingles[words.first[r] : max(words.first[r], words.first[r + 1] - k + 1)], return_counts=True) for r in range(words.rows)]
        groups: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for r, w in enumerate(self.words):
            if len(w):
                size, step = window_of(len(w), k, percent)
                starts = item_starts(len(w), size, step)
                groups.setdefault((size, step), []).append((fingerprints(w, size, starts), np.full(len(starts), r, np.int32), starts.astype(np.int32)))
        self.groups = []
        for (size, step), found in sorted(groups.items()):
            prints, item, start = (np.concatenate(x) for x in zip(*found, strict=True))
            self.groups.append((size, step, HammingIndex(prints), item, start))

    def hits(self, words: Words) -> Iterator[tuple[int, int, float, int]]:
        """(row, item, similarity, first word of the window) for each item that reaches the threshold in a row, at its best window."""
        if not len(words.hash) or not self.groups:
            return
        place = np.arange(len(words.hash)) - words.first[words.row]
        room = np.diff(words.first)[words.row] - place
        most = max(size for size, *_ in self.groups)
        found = []
        for a in range(0, len(words.hash), SPAN):
            own = words.hash[a : a + SPAN + most]
            sums = prefix_bits(own)
            for size, step, index, item, start in self.groups:
                at = np.flatnonzero((place[a : a + SPAN] % step == 0) & (room[a : a + SPAN] >= size))
                if len(at):
                    q, e = index.search(fingerprints(own, size, at, sums))
                    at = a + at[q]
                    found.append(np.stack([words.row[at], item[e], place[at] - start[e]], axis=1))
        if not sum(map(len, found)):
            return
        spots = np.unique(np.concatenate(found), axis=0)
        edges = np.flatnonzero(np.concatenate(([True], (spots[1:, :2] != spots[:-1, :2]).any(axis=1), [True])))
        shingles, _ = words.shingles(self.k)
        for i, j in pairwise(edges):
            row, r = int(spots[i, 0]), int(spots[i, 1])
            best, where = self._best(words, shingles, row, r, spots[i:j, 2])
            if 100 * best >= self.percent - 1e-9:
                yield row, r, best, where

    def _best(self, words: Words, shingles: np.ndarray, row: int, r: int, begins: np.ndarray) -> tuple[float, int]:
        """Highest weighted Jaccard similarity of an item and item-sized windows about begins, and the first word of its window."""
        n, k = len(self.words[r]), self.k
        slack = lost(n, k, self.percent)
        begins = np.unique((begins[:, None] + np.arange(-slack, slack + 1)).ravel())
        first, size = int(words.first[row]), int(words.first[row + 1] - words.first[row])
        begins = begins[(begins < size) & (begins + n > 0)]
        best, where = 0.0, 0
        if n < k:
            own, weight = words.hash[first : first + size].tolist(), shingle_weights(self.words[r].tolist(), k)
            for b in begins.tolist():
                z = weighted_jaccard(weight, shingle_weights(own[max(0, b) : b + n], k))
                if z > best:
                    best, where = z, max(0, b)
            return best, where
        known, weight = self.sets[r]
        low, high = max(0, int(begins[0])), min(size, int(begins[-1]) + n)
        if high - low < k:
            return 0.0, 0  # shorter than a shingle of the item
        own = shingles[first + low : first + high - k + 1]
        p = np.minimum(np.searchsorted(known, own), len(known) - 1)
        p = np.where(known[p] == own, p, -1)
        if int((p >= 0).sum()) < n - k + 1 - slack:
            return 0.0, 0
        for b in begins.tolist():
            a = max(0, b)
            part = p[a - low : min(size, b + n) - k + 1 - low] if min(size, b + n) - a >= k else p[:0]
            if len(part):
                both = int(np.minimum(np.bincount(part[part >= 0], minlength=len(known)), weight).sum())
                z = both / (len(part) + n - k + 1 - both)
                if z > best:
                    best, where = z, a
        return best, where


def _match(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: ItemIndex = index.value
        for batch in batches:
            for a, b in slices(batch.column("text"), 500_000):
                part = batch.slice(a, b - a)
                found = list(known.hits(Words(part.column("text"), lower=True)))
                if found:
                    rows, items, scores, starts = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(rows)), pa.array([known.ids[i] for i in items], pa.int64()), pa.array(scores, pa.float64()), pa.array(starts, pa.int64())], names=["id", "item_id", "similarity", "first_word"])
        release()

    return run


def _clean(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: ItemIndex = index.value
        for batch in batches:
            for a, b in slices(batch.column("text"), 500_000):
                part = batch.slice(a, b - a)
                keep = np.ones(part.num_rows, bool)
                keep[[row for row, *_ in known.hits(Words(part.column("text"), lower=True))]] = False
                yield part.filter(pa.array(keep))
        release()

    return run


def _passes(items: DataFrame, item_col: str, item_text: str, k: int, percent: int) -> list:
    """Broadcast indexes of the items, INDEX_BYTES of a built one each (a longer item has one of its own).

    The driver holds the items' texts: a benchmark, not a corpus. More of them mean more passes over the documents.
    """
    own = items.select(F.col(item_col).cast("long").alias("i"), F.col(item_text).cast("string").alias("t")).where("t is not null")
    rows = sorted(((r.i, r.t) for r in own.toLocalIterator()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    parts, size = [[]], 0
    for row in rows:
        more = entry_bytes(len(row[1].split()), k, percent)
        if parts[-1] and size + more > INDEX_BYTES:
            parts.append([])
            size = 0
        parts[-1].append(row)
        size += more
    return [items.sparkSession.sparkContext.broadcast(ItemIndex(part, k, percent)) for part in parts]


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", k: int = 5, percent: int = 75) -> DataFrame:
    """docs without rows in which an item is found; all columns stay, and no join is needed. Cases as in contaminated()."""
    names = docs.columns
    short = {c: "text" if c == text_col else f"c{i}" for i, c in enumerate(names)}
    out = src = docs.select(*[F.col(f"`{c}`").alias(short[c]) for c in names])
    for index in _passes(items, item_col, item_text, k, percent):
        out = map_arrow(out, _clean(index), src.schema)
    return out.select(*[F.col(short[c]).alias(c) for c in names])


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", k: int = 5, percent: int = 75) -> DataFrame:
    """Items found in documents: (id_col, item_col long, similarity double, first_word long), a row per document row and item.

    Words are runs of anything but ASCII white space, A-Z lower-cased. Every whole text is searched, a very long one in
    spans of SPAN words that overlap by a window. An item is found where some item-sized window reaches percent of
    weighted similarity and the fingerprints of a window pair inside lie within RADIUS bits; the best window is given,
    the first of equal ones. Fewer words than k count as one shingle. Items without text or without words match
    nothing; null and repeated ids of either side keep their rows; documents without text give none; an empty
    table on either side gives none. Other columns are ignored. Items beyond INDEX_BYTES take further passes.
    """
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    kind = src.schema["id"].dataType.simpleString()
    found = [map_arrow(src, _match(x), f"id {kind}, item_id long, similarity double, first_word long") for x in _passes(items, item_col, item_text, k, percent)]
    out = reduce(DataFrame.unionByName, found)
    return out.select(F.col("id").alias(id_col), F.col("item_id").alias(item_col), "similarity", "first_word")
