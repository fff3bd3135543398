"""Language identification by prediction by partial matching (PPM).

For every language a byte context tree of order ORDER is grown from a bounded sample of labelled texts and
then frozen. The code length of a byte is that of PPM with escape method C and exclusion: from the longest
context of the tree downwards, a byte seen there costs -log2(count / (n + d)), an unseen one first pays the
escape d / (n + d), n and d counted over bytes not excluded by longer contexts; below order 0 the bytes left
are equally likely. The symbols of a context are among those of every shorter one, so the excluded set is
just the context's own symbols, and the whole cost of a (context, byte) pair is a constant that training
works out. Scoring looks up one constant per byte for all languages at once: exact code lengths, no
model changes while scoring. The language of the shortest code wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexforge.llm.common import map_arrow, release, slices

_U = np.uint64
ORDER = 4
#: bounds of the training sample: bytes and texts per language, and languages
TRAIN_BYTES = 300_000
TRAIN_TEXTS = 2_000
MAX_LANGS = 200
#: bytes scored at a time
SPAN = 250_000


class Ppm:
    """Frozen context trees of several languages, as tables of code lengths in bits."""

    def __init__(self, texts: dict[str, list[bytes]], order: int = ORDER):
        self.order, self.langs = order, sorted(texts)
        trees = [self._tree(texts[x]) for x in self.langs]
        #: per order k: sorted (context, byte) keys of any language and their cost in each; contexts likewise
        self.keys, self.costs = [], []
        for k in range(order + 1):
            keys = np.unique(np.concatenate([t[k]["keys"] for t in trees] or [np.zeros(0, np.uint64)]))
            self.keys.append(keys)
            self.costs.append(np.stack([self._cost(t, k, keys) for t in trees], axis=1).astype(np.float32) if len(keys) else np.zeros((0, len(trees)), np.float32))
        # escapes of contexts for bytes that no language has seen in them
        self.trees = trees

    def _tree(self, texts: list[bytes]):
        """Per order a table of (context, byte) keys with counts, and of contexts with n, d and the counts that their
        symbols have one order below; grams don't cross texts."""
        data = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint64)
        at = np.concatenate([np.arange(len(t)) for t in texts]) if texts else np.zeros(0, np.int64)
        out, key = [], data.copy()
        for k in range(self.order + 1):
            if k:
                key[k:] = key[k:] | (data[:-k] << _U(8 * k))
            keys, counts = np.unique(key[at >= k], return_counts=True)
            ctx = keys >> _U(8)
            first = np.flatnonzero(np.concatenate(([True], ctx[1:] != ctx[:-1]))) if len(ctx) else np.zeros(0, int)
            level = {"keys": keys, "counts": counts.astype(float), "ctx": ctx[first], "d": np.diff(np.append(first, len(ctx))).astype(float)}
            level["n"] = np.add.reduceat(level["counts"], first) if len(first) else np.zeros(0)
            lower = self._count(out[k - 1], keys & _U((1 << 8 * k) - 1)) if k else np.zeros(len(keys))
            level["below"] = np.add.reduceat(lower, first) if len(first) else np.zeros(0)
            out.append(level)
        return out

    @staticmethod
    def _count(level: dict, keys: np.ndarray) -> np.ndarray:
        own = level["keys"]
        if not len(own):
            return np.zeros(len(keys))
        p = np.minimum(np.searchsorted(own, keys), len(own) - 1)
        return np.where(own[p] == keys, level["counts"][p], 0.0)

    @staticmethod
    def _context(level: dict, contexts: np.ndarray):
        """n, d and below of contexts (0 where the tree has none)."""
        own = level["ctx"]
        if not len(own):
            return (np.zeros(len(contexts)),) * 3
        p = np.minimum(np.searchsorted(own, contexts), len(own) - 1)
        hit = own[p] == contexts
        return tuple(np.where(hit, level[x][p], 0.0) for x in ("n", "d", "below"))

    def _cost(self, tree, k: int, keys: np.ndarray) -> np.ndarray:
        """Bits of the last byte of keys (k context bytes and the byte), starting at order k."""
        bits = np.zeros(len(keys))
        open_ = np.ones(len(keys), bool)
        gone_n, gone_d = np.zeros(len(keys)), np.zeros(len(keys))
        for j in range(k, -1, -1):
            key = keys & _U((1 << 8 * (j + 1)) - 1)
            n_all, d_all, below = self._context(tree[j], key >> _U(8))
            n, d = n_all - gone_n, d_all - gone_d
            c = self._count(tree[j], key)
            hit = open_ & (c > 0)
            bits[hit] -= np.log2(c[hit] / (n[hit] + d[hit]))
            open_ &= c == 0
            esc = open_ & (n > 0)
            bits[esc] -= np.log2(d[esc] / (n[esc] + d[esc]))
            gone_n, gone_d = below, d_all
        bits[open_] += np.log2(256 - gone_d[open_])
        return bits

    def freeze(self) -> dict:
        """What scoring needs, as plain arrays, with a hash index over the longest keys."""
        return {"order": self.order, "langs": self.langs, "keys": self.keys[self.order], "costs": self.costs[self.order], "trees": self.trees, "index": _index(self.keys[self.order])}


def _slot(keys: np.ndarray, shift: int) -> np.ndarray:
    return ((keys * _U(0x9E3779B97F4A7C15)) >> _U(shift)).astype(np.int64)


def _index(keys: np.ndarray) -> tuple[np.ndarray, int]:
    """Open-addressed table of positions in keys; -1 is free, runs are probed linearly."""
    bits = max(8, int(4 * len(keys) + 1).bit_length())
    table = np.full(1 << bits, -1, np.int32)
    left = np.arange(len(keys), dtype=np.int32)
    slot = _slot(keys, 64 - bits)
    while len(left):
        free = table[slot] == -1
        table[slot[free]] = left[free]
        lost = table[slot] != left
        left, slot = left[lost], (slot[lost] + 1) & ((1 << bits) - 1)
    return table, bits


class Scorer:
    """Code lengths of texts under a frozen model."""

    def __init__(self, model: dict):
        self.m = model
        self.order, self.langs = model["order"], model["langs"]
        self.ppm = Ppm.__new__(Ppm)
        self.ppm.order, self.ppm.langs, self.ppm.trees = self.order, self.langs, model["trees"]

    def _find(self, keys: np.ndarray) -> np.ndarray:
        table, bits = self.m["index"]
        own = self.m["keys"]
        slot = _slot(keys, 64 - bits)
        at = table[slot]
        out = np.full(len(keys), -1, np.int32)
        live = np.flatnonzero(at >= 0)
        while len(live):
            hit = own[at[live]] == keys[live]
            out[live[hit]] = at[live[hit]]
            live = live[~hit]
            slot[live] = (slot[live] + 1) & ((1 << bits) - 1)
            at[live] = table[slot[live]]
            live = live[at[live] >= 0]
        return out

    def bits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code length of each row (bytes data[offsets[i]:offsets[i+1]]) in each language."""
        k, n = self.order, len(data)
        out = np.zeros((len(offsets) - 1, len(self.langs)))
        if not self.langs:
            return out
        # spans of the texts laid end to end: what a very long text needs doesn't grow with it
        for a in range(0, n, SPAN):
            b, low = min(n, a + SPAN), max(0, a - k)
            key = data[low:b].astype(np.uint64)
            wide = key.copy()
            for j in range(1, k + 1):
                wide[j:] |= key[:-j] << _U(8 * j)
            wide = wide[a - low :]
            first, last = int(np.searchsorted(offsets, a, "right")) - 1, int(np.searchsorted(offsets, b, "left"))
            edges = np.clip(offsets[first : last + 1], a, b)
            rows, sizes = np.arange(first, last), np.diff(edges)
            at = np.arange(a, b) - np.repeat(offsets[first:last], sizes)
            full = at >= k
            pos = np.full(b - a, -1, np.int32)
            pos[full] = self._find(wide[full])
            costs = np.zeros((b - a, len(self.langs)), np.float32)
            hit = pos >= 0
            costs[hit] = self.m["costs"][pos[hit]]
            # a text's first bytes have shorter contexts; bytes unseen there in any language take the long way, once per distinct gram
            miss = np.flatnonzero(~hit)
            depth = np.minimum(at[miss], k)
            for j in range(k + 1):
                some = miss[depth == j]
                if len(some):
                    grams, back = np.unique(wide[some] & _U((1 << 8 * (j + 1)) - 1), return_inverse=True)
                    cost = np.stack([self.ppm._cost(t, j, grams) for t in self.ppm.trees], axis=1)
                    costs[some] = cost[back]
            some = sizes > 0
            out[rows[some]] += np.add.reduceat(costs, edges[:-1][some] - a, axis=0, dtype=np.float64)
        return out


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = ORDER, max_bytes: int = TRAIN_BYTES, max_texts: int = TRAIN_TEXTS) -> dict:
    """Learn from labelled docs: at most max_texts whole texts a language, up to max_bytes (the text that crosses it included).

    The sample is a fixed one: texts in the order of a hash of id and text. Languages are counted over all rows; one
    with few texts gives all of them. At most MAX_LANGS languages are allowed, so the driver receives a
    bounded number of bytes. Null texts or labels are passed over.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null and text <> ''")
    counts = {r.lang: r["count"] for r in rows.groupBy("lang").count().limit(MAX_LANGS + 1).collect()}
    if len(counts) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    if not counts:
        return Ppm({}, order).freeze()
    rows = rows.withColumn("h", F.xxhash64(F.col("id").cast("string"), "text"))
    # a share of each language that holds max_texts with near certainty: few rows are ranked, whatever the corpus' size
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, 1.5 * max_texts / n + 1e-9))).otherwise(share)
    rows = rows.where(F.pmod("h", F.lit(1 << 30)) < share * (1 << 30))
    w = Window.partitionBy("lang").orderBy("h", "id")
    size = F.octet_length("text")
    rows = rows.withColumn("before", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("r", F.row_number().over(w))
    texts: dict[str, list[bytes]] = {}
    for r in rows.where((F.coalesce("before", F.lit(0)) < max_bytes) & (F.col("r") <= max_texts)).select("lang", "text").collect():
        texts.setdefault(r.lang, []).append(r.text.encode())
    return Ppm({k: sorted(v) for k, v in texts.items()}, order).freeze()


def _predict(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.value)
        for batch in batches:
            for a, b in slices(batch.column("text"), 250_000):
                part = batch.slice(a, b - a)
                column = part.column("text").cast(pa.large_string())
                texts = column.to_pylist()
                column = column.fill_null("")
                offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
                data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
                bits = scorer.bits(data, offsets - offsets[0])
                lang, score, rate = [], [], []
                for i, text in enumerate(texts):
                    if not text or not scorer.langs or not any(map(str.isalpha, text)):
                        lang.append("und")
                        score.append(0.0)
                        rate.append(None)
                        continue
                    x = bits[i] - bits[i].min()
                    p = np.exp2(-np.minimum(x, 1000))
                    best = int(np.argmin(bits[i]))
                    lang.append(scorer.langs[best])
                    score.append(float(p[best] / p.sum()))
                    rate.append(float(bits[i].min() / (offsets[i + 1] - offsets[i])))
                yield pa.RecordBatch.from_arrays([part.column(c) for c in part.schema.names] + [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rate, pa.float64())], names=[*part.schema.names, "lang_pred", "score", "bits_per_byte"])
        release()

    return run


def predict(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """Language of every whole text: (id_col, lang_pred string, score double, bits_per_byte double).

    lang_pred is the learned language of the shortest code (ties: the first by name), or und for a text that is
    null or has no letter, or if nothing was learned; score is that language's posterior under equal priors,
    0 for und. Null and repeated ids keep a row each; an empty table gives none; other columns are ignored.
    With keep_text the text stays, as column text. Whole texts count, in spans of SPAN bytes with the contexts carried over.
    """
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    bmodel = docs.sparkSession.sparkContext.broadcast(model)
    out = map_arrow(src, _predict(bmodel), f"id {kind}, text string, lang_pred string, score double, bits_per_byte double")
    return out.select(F.col("id").alias(id_col), *(["text"] if keep_text else []), "lang_pred", "score", "bits_per_byte")


def annotate(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """docs with _lexforge_lang_pred, _lexforge_score and _lexforge_bits_per_byte added; all columns pass through the Arrow function, so nothing is joined."""
    names = docs.columns
    short = {c: "text" if c == text_col else f"c{i}" for i, c in enumerate(names)}
    src = docs.select(*[F.col(f"`{c}`").alias(short[c]) for c in names])
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in src.schema)
    out = map_arrow(src, _predict(docs.sparkSession.sparkContext.broadcast(model)), f"{schema}, lang_pred string, score double, bits_per_byte double")
    return out.select(*[F.col(short[c]).alias(c) for c in names], *[F.col(c).alias(f"_lexforge_{c}") for c in ("lang_pred", "score", "bits_per_byte")])


#: a text is no known language if its shortest code needs more bits a byte (noise needs about 8), given enough bytes to tell
REJECT_BITS = 7.0
REJECT_BYTES = 64


def keep_known_languages(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """docs without those of no language: und, or REJECT_BYTES or more that cost over REJECT_BITS a byte in every one."""
    odd = (F.col("_lexforge_lang_pred") == "und") | ((F.octet_length(F.col(text_col)) >= REJECT_BYTES) & (F.col("_lexforge_bits_per_byte") > REJECT_BITS))
    return annotate(docs, model, text_col).where(~odd).select(*[F.col(f"`{c}`") for c in docs.columns])


def held_out(id_col: str = "doc_id", folds: int = 5):
    """The fold that training leaves out: crc32 of the id as text (null: empty) divides by folds."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == 0
