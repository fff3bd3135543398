"""Mixing sources to target weights, in DataFrame operations only.

Documents of a source, in a fixed order, are one stream of words cut into blocks of block_len. Output shards
have slots of one block each. Every shard draws its sources' counts from a multinomial: each slot draws a ticket, of which
a source holds as many as it should get slots in all. A source that is drawn more often than it holds tickets has its
last slots drawn again, among the sources that are still short, so that no slot is lost and none exceeds its target.
A source's slots, numbered through all shards, run through its blocks along a pseudorandom permutation of their
indices (a swap-or-not shuffle keyed by the source), pass after pass, and meet the blocks in a join by index. So a
block is taken at most once more than any other, and never beyond the cap.

All that grows with the number of sources is a DataFrame; the driver holds totals alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexforge.llm.common import WORD, broadcast_if_small, materialize, prefix_sum

BLOCK_LEN = 64
SHARD_SLOTS = 4096
ROUNDS = 16
#: rows of the sources' table (a name, six numbers) that may be broadcast, after a count
SMALL_SOURCES = 10_000


def round_keys(n: Column, seed: Column, rounds: int = ROUNDS) -> Column:
    """Keys of a pseudorandom permutation of 0..n-1: a hash and an offset for each round."""
    hashes = F.transform(F.sequence(F.lit(0), F.lit(rounds - 1)), lambda r: F.xxhash64(seed, r))
    return F.transform(hashes, lambda h: F.struct(h.alias("h"), F.pmod(h, n).alias("k")))


def permuted(index: Column, n: Column, keys: Column) -> Column:
    """Image of index under the permutation of 0..n-1 that keys give (swap-or-not; every round is an involution)."""

    def step(x: Column, r: Column) -> Column:
        other = F.pmod(r.k - x, n)
        return F.when(F.xxhash64(r.h, F.greatest(x, other)).bitwiseAND(F.lit(1)) == 1, other).otherwise(x)

    return F.aggregate(keys, index, step)


def planned(sizes: DataFrame, weights: Sequence[int], share: float, cap: int, block_len: int) -> DataFrame:
    """Sources (source, size) -> (s, source, source_size, weight, target, blocks, quota).

    s numbers the sources by code point, null last; weights repeat along it. Targets share share * all sizes by weight; one
    that would exceed cap * size stops there and the excess goes to the others by weight, until none is above. With
    sources in the order of cap * size / weight those that stop come first, and the others' level is what is left
    over their weights. quota is the target in whole blocks, blocks the source's number of them. Both orders are windows
    over the table of sources, which has a few numbers a row.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    rows = sizes.withColumn("s", (F.row_number().over(by_name) - 1).cast("long"))
    rows = rows.withColumn("weight", F.array(*[F.lit(w) for w in weights])[F.pmod("s", F.lit(len(weights))).cast("int")])
    rows = rows.withColumn("limit", cap * F.col("size"))
    ratio = F.col("limit") / F.col("weight")
    by_ratio = Window.orderBy("ratio", "s")
    rows = rows.withColumn("ratio", ratio)
    rows = rows.withColumns(
        {
            "_before": F.coalesce(F.sum("limit").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "_weights": F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
            "_all": F.sum("size").over(Window.partitionBy()),
        }
    )
    # the level if this source and all after it share what those before leave
    level = (F.lit(share) * F.col("_all") - F.col("_before")) / F.col("_weights")
    rows = rows.withColumn("_level", F.when(level <= F.col("ratio"), level))
    rows = rows.withColumn("_level", F.max("_level").over(Window.partitionBy()))
    target = F.least(F.col("limit").cast("double"), F.coalesce(F.col("_level") * F.col("weight"), F.col("limit").cast("double")))
    rows = rows.withColumn("target", F.greatest(F.lit(0.0), target)).withColumn("blocks", F.ceil(F.col("size") / block_len).cast("long"))
    quota = F.when(F.col("size") > 0, F.round(F.col("target") * F.col("blocks") / F.col("size"))).otherwise(0).cast("long")
    return rows.select("s", "source", F.col("size").alias("source_size"), "weight", "target", "blocks", F.least(quota, cap * F.col("blocks")).alias("quota"))


def sized(docs: DataFrame, source: str = "source", text: str = "text") -> DataFrame:
    """docs' id and source with size, the words of the text (null: 0), and a digest that settles the order of equal ids."""
    return docs.withColumns({"_size": F.coalesce(F.size(F.regexp_extract_all(F.col(text).cast("string"), F.lit(WORD), 0)), F.lit(0)).cast("long"), "_tie": F.xxhash64(F.col(text).cast("string"))})


def slots(sources: DataFrame, n: int, n_sources: int, seed: int, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """Output slots: (s, shard, ordinal, block): source number, shard, number of the slot within the source, block index.

    sources: (s, quota, blocks), n the sum of quotas.
    """
    spark = sources.sparkSession
    if n <= 0:
        return spark.range(0).select(F.col("id").alias("s"), F.col("id").alias("shard"), F.col("id").alias("ordinal"), F.col("id").alias("block"))
    # tickets 0..n-1 belong to the sources in turn; a ticket finds its source by the bucket of tickets that it lies in
    width = max(1, n // n_sources)
    held = sources.where("quota > 0").select("s", "quota", "blocks")
    held = held.withColumn("_to", F.sum("quota").over(Window.orderBy("s"))).withColumn("_from", F.col("_to") - F.col("quota"))
    held = materialize(held)
    ranges = held.select("s", "_from", "_to", F.explode(F.sequence(F.floor(F.col("_from") / width), F.floor((F.col("_to") - 1) / width))).alias("_bucket"))
    drawn = spark.range(0, n, 1, max(1, min(10_000, n // 200_000))).withColumn("shard", F.floor(F.col("id") / shard_slots))
    drawn = drawn.withColumn("_ticket", F.pmod(F.xxhash64(F.lit(seed), F.lit("draw"), "id"), F.lit(n))).withColumn("_bucket", F.floor(F.col("_ticket") / width))
    drawn = drawn.join(broadcast_if_small(ranges, 4 * SMALL_SOURCES), "_bucket").where("_ticket >= _from and _ticket < _to")
    counts = materialize(drawn.groupBy("shard", "s").agg(F.count("*").alias("count")))
    total = counts.groupBy("s").agg(F.sum("count").alias("drawn"))
    held = held.join(total, "s", "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)))
    excess, gap = F.greatest(F.lit(0), F.col("drawn") - F.col("quota")), F.greatest(F.lit(0), F.col("quota") - F.col("drawn"))
    in_turn = Window.orderBy("s").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = held.withColumns({"excess": excess, "gap": gap, "_over": F.sum(excess).over(in_turn) - excess, "_gaps": F.sum(gap).over(in_turn) - gap})
    held = materialize(held.select("s", "blocks", "drawn", "excess", "gap", "_over", "_gaps"))
    lost = held.agg(F.sum("excess")).first()[0]
    # number the slots of a source through all shards
    starts = prefix_sum(counts, ["s"], ["shard"], "count", "start", min(n, -(-n // shard_slots) * n_sources), leaf=4096)
    # a row here becomes up to shard_slots slots: dealt out first, or one task would make them all
    starts = starts.repartition(max(1, n // 100_000), "s", "shard").join(broadcast_if_small(held, SMALL_SOURCES), "s")
    keys = lambda what: round_keys(F.col("blocks"), F.concat_ws(":", F.lit(seed), what))
    rows = starts.withColumn("keys", keys(F.col("s"))).withColumn("number", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("count") - 1)))
    # excess slots lie evenly among those of their source; the others are numbered on without them
    rows = rows.withColumns({"before": F.expr("(number * excess) div drawn"), "upto": F.expr("((number + 1) * excess) div drawn")})
    block = permuted(F.pmod("ordinal", "blocks"), F.col("blocks"), F.col("keys"))
    out = rows.where("before = upto").withColumn("ordinal", F.col("number") - F.col("before")).select("s", "shard", "ordinal", block.alias("block"))
    if lost:
        # they are dealt again, along a permutation, to the sources that were drawn too seldom
        all_keys = round_keys(F.lit(lost).cast("long"), F.concat_ws(":", F.lit(seed), F.lit("again")))
        over = rows.where("before < upto").select("shard", permuted(F.col("_over") + F.col("before"), F.lit(lost).cast("long"), all_keys).alias("place"))
        gaps = held.where("gap > 0").withColumn("place", F.explode(F.sequence(F.col("_gaps"), F.col("_gaps") + F.col("gap") - 1)))
        gaps = gaps.select("s", "blocks", keys(F.col("s")).alias("keys"), "place", (F.col("drawn") + F.col("place") - F.col("_gaps")).alias("ordinal"))
        out = out.unionByName(gaps.join(over, "place").select("s", "shard", "ordinal", block.alias("block")))
    return out


class Mixture:
    """A planned mix over docs: sources, pieces (documents cut at block edges), slots and their joins."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", source: str = "source", text: str = "text", weights: Sequence[int] = (3, 1, 2), share: float = 1.5, cap: int = 2, block_len: int = BLOCK_LEN, seed: int = 17, shard_slots: int = SHARD_SLOTS):
        self.spark, self.block_len = docs.sparkSession, block_len
        base = docs.select(F.col(id_col).alias("id"), F.col(source).cast("string").alias("source"), F.col(text).cast("string").alias("text"))
        self.sized = materialize(sized(base).drop("text"))
        sizes = self.sized.groupBy("source").agg(F.sum("_size").alias("size"), F.count("*").alias("docs"))
        #: a row for each source
        self.sources = materialize(planned(sizes.select("source", "size"), weights, share, cap, block_len))
        n, n_sources = self.sources.agg(F.coalesce(F.sum("quota"), F.lit(0)), F.count("*")).first()
        known = self.sized.alias("d").join(broadcast_if_small(self.sources, SMALL_SOURCES).alias("q"), F.col("d.source").eqNullSafe(F.col("q.source")))
        known = known.select("d.id", "d.source", "d._size", "d._tie", "q.s", "q.source_size", "q.target")
        #: offset: where the document starts in its source's stream
        self.placed = prefix_sum(known, ["s"], ["id", "_size", "_tie"], "_size", "offset", self.sized.count())
        self.slots = slots(self.sources, n, n_sources, seed, shard_slots)

    def pieces(self) -> DataFrame:
        """Documents cut at block edges: (s, block, offset, id, first, words): words of the document from its word first on."""
        b = self.block_len
        d = self.placed.where("_size > 0")
        d = d.withColumn("block", F.explode(F.sequence(F.floor(F.col("offset") / b), F.floor((F.col("offset") + F.col("_size") - 1) / b))))
        start = F.greatest(F.col("offset"), F.col("block") * b)
        end = F.least(F.col("offset") + F.col("_size"), (F.col("block") + 1) * b)
        return d.select("s", "block", "offset", "id", (start - F.col("offset")).alias("first"), (end - start).alias("words"))

    def blocks(self) -> DataFrame:
        """The mix: one row per slot and piece, in the order (shard, source, ordinal, offset)."""
        return self.slots.join(self.pieces(), ["s", "block"])

    def taken(self) -> DataFrame:
        """Words the mix takes of every document: (id, source, size, source_size, target, taken)."""
        uses = self.slots.groupBy("s", "block").agg(F.count("*").alias("uses"))
        words = self.pieces().join(uses, ["s", "block"]).groupBy("s", "offset").agg(F.sum(F.col("words") * F.col("uses")).alias("taken"))
        some = self.placed.where("_size > 0").join(words, ["s", "offset"], "left")
        out = some.select("id", "source", F.col("_size").alias("size"), "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))
        none = self.placed.where("_size = 0").select("id", "source", F.col("_size").alias("size"), "source_size", "target", F.lit(0).cast("long").alias("taken"))
        return out.unionByName(none)


def mix(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """Words of each document that the mix takes: (id_col, source, size, source_size, target, taken).

    Sources by code point, null last, weigh options["weights"] in turn and share options["share"] of all words; a
    target stops at cap times its source's size and the excess is dealt again. Each source's taken words come within
    about a block of its target: counts are drawn, and what a source is drawn too often is drawn again. No document gives more than cap times its size. Reruns agree: every
    draw is a hash of the seed. A null text has size 0; a null source is a source; null or repeated ids and
    repeated rows keep a row each; an empty table gives none; other columns are ignored.
    """
    return Mixture(docs, id_col, **options).taken().withColumnRenamed("id", id_col)
