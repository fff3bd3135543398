"""A bitmap reaches the driver as a few blocks of bytes, not as a row for each of its words."""

import random

import numpy as np
from pyspark.sql import functions as F

from lexforge.llm import jaccard


def test_bitmap_comes_in_blocks(spark):
    rng = random.Random(5)
    values = [rng.getrandbits(64) - (1 << 63) for _ in range(20_000)] + [0, 63, 64, -1, (1 << 20) - 1]
    df = spark.createDataFrame([(v,) for v in values], "x long").repartition(5)
    bits = 20
    want = np.zeros(1 << (bits - 6), np.uint64)
    for v in values:
        b = v & ((1 << bits) - 1)
        want[b >> 6] |= np.uint64(1 << (b & 63))
    got = jaccard._bitmap_of(df, "x", bits)
    assert got.dtype == np.uint64 and (got == want).all()
    blocks = jaccard._bitmap_blocks(df, "x", bits)
    assert blocks.count() == (1 << (bits - 6)) // jaccard.BLOCK_WORDS
    assert blocks.select(F.max(F.octet_length("words"))).first()[0] == 8 * jaccard.BLOCK_WORDS
    assert not jaccard._bitmap_of(df.limit(0), "x", bits).any()
