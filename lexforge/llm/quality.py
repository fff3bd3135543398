"""Quality rules: word statistics and zstandard compression bands.

The whole text and each fixed chunk of it are compressed. A ratio (compressed / raw bytes) below a band's
floor marks repetitive text, one above its ceiling text without structure. Short texts carry the
compressor's fixed cost and hardly repeat, so floor and ceiling depend on the length.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.llm.common import Words, map_arrow, release, slices

#: (bytes from, floor, ceiling) for whole texts; below the first there is no verdict
BANDS = ((100, 0.35, 1.20), (300, 0.33, 0.90), (1_000, 0.30, 0.74), (4_000, 0.27, 0.66), (20_000, 0.22, 0.62))
CHUNK = 2_048
#: floor and ceiling of a chunk, and the share of chunks out of them that rejects a text
CHUNK_BAND = (0.28, 0.72)
CHUNK_SHARE = 0.5
LEVEL = 3
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True


def compression_verdict(raw: bytes, compress, bands=BANDS, chunk: int = CHUNK, chunk_band=CHUNK_BAND, share: float = CHUNK_SHARE) -> tuple[float, int, int, str]:
    """(whole ratio, chunks, chunks out of band, reason) with reason null for text that stays, repetitive or incompressible else.

    Chunks cover the whole text: what follows the last full one is a chunk too, judged by the band of its length (below
    the first there is no verdict, as for whole texts), and a chunk's bytes are its part in the share.
    """
    n = len(raw)
    if not n:
        return 1.0, 0, 0, None
    ratio = len(compress(raw)) / n
    judged = low = high = count = odd = 0
    for a in range(0, n, chunk):
        c = raw[a : a + chunk]
        size = len(c)
        limits = chunk_band if size == chunk else next((b[1:] for b in reversed(bands) if size >= b[0]), None)
        if limits is None:
            continue
        r = ratio if size == n else len(compress(c)) / size
        judged += size
        low += size * (r < limits[0])
        high += size * (r > limits[1])
        count += 1
        odd += r < limits[0] or r > limits[1]
    band = next((b for b in reversed(bands) if n >= b[0]), None)
    reason = None
    if band:
        if ratio < band[1] or low > share * judged:
            reason = "repetitive"
        elif ratio > band[2] or high > share * judged:
            reason = "incompressible"
    return ratio, count, odd, reason


def _lines(raw: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    if b"\n" not in raw:
        return 0
    lines = [x for x in raw.split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
    return len(lines) - len(set(lines))


def _measure(bands, chunk, chunk_band, share):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=LEVEL).compress
        for batch in batches:
            for a, b in slices(batch.column("text")):
                part = batch.slice(a, b - a)
                w = Words(part.column("text"), lower=False)
                data = w.data.tobytes()
                points, symbols = (w.data & 0xC0) != 0x80, _SYMBOLS[w.data]
                # code points of each word, and of the words before each
                letters = np.add.reduceat(points, np.stack([w.start, w.end], 1).ravel()[: -1 if len(w.end) and w.end[-1] == len(points) else None], dtype=np.int64)[::2] if len(w.start) else np.zeros(0, np.int64)
                in_words = np.concatenate(([0], np.cumsum(letters)))
                s, valid = w.shingles(5)
                rows = []
                for r, (x, y) in enumerate(pairwise(w.offsets.tolist())):
                    f, g = int(w.first[r]), int(w.first[r + 1])
                    repeat = 0
                    if g - f > 5:
                        h = s[f : g - 4]
                        _, inverse, counts = np.unique(h, return_inverse=True, return_counts=True)
                        if len(counts) < len(h):
                            cover = np.zeros(g - f + 1, np.int64)
                            hit = np.flatnonzero(counts[inverse] > 1)
                            np.add.at(cover, hit, 1)
                            np.add.at(cover, hit + 5, -1)
                            repeat = int((np.cumsum(cover)[:-1] > 0).sum())
                    raw = data[x:y]
                    rows.append((g - f, int(in_words[g] - in_words[f]), int(np.count_nonzero(symbols[x:y])), _lines(raw), repeat, *compression_verdict(raw, compress, bands, chunk, chunk_band, share)))
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int64()] * 5 + [pa.float64(), pa.int32(), pa.int32(), pa.string()]
                yield pa.RecordBatch.from_arrays([part.column("id"), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=["id", *NAMES])
        release()

    return run


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "ratio", "n_chunks", "n_odd_chunks", "reason")


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands=BANDS, chunk: int = CHUNK, chunk_band=CHUNK_BAND, share: float = CHUNK_SHARE) -> DataFrame:
    """Word statistics, compression ratios and verdict of every whole text.

    Returns id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), ratio double, n_chunks and
    n_odd_chunks int, reason string (repetitive, incompressible or null), base_failed and kept boolean. A
    null text counts as empty: zeros, ratio 1, base_failed. Null or repeated ids keep a row each; an empty
    table gives none; other columns are ignored.
    """
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, ratio double, n_chunks int, n_odd_chunks int, reason string"
    out = map_arrow(src, _measure(bands, chunk, chunk_band, share), schema)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return out.select(F.col("id").alias(id_col), *NAMES, failed.alias("base_failed"), (~failed & F.col("reason").isNull()).alias("kept"))
