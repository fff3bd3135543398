"""Closed frequent itemsets of baskets, and rules that point to one item.

Closed sets are grown from prefixes level by level. A batch of the frontier's prefixes meets a block of baskets in each task: the
prefixes' occurrences (prefix x basket) times the baskets (basket x item), both sparse, give the supports of every extension of
every prefix within the block, and a sum over the blocks gives them over all baskets. Items whose support equals
the prefix's own complete it to its closure. A closure that brings in an item before the one by which the prefix was extended has
another, canonical owner and is left to it, so each closed set is found once and nothing has to be compared.

Baskets stay where they are, as rows of their frequent items, equal ones as one row with a weight; no basket list of an
item is ever gathered, so an item or a basket with a third of all rows is summed block by block. To the driver and from there to
the tasks goes only what the least support bounds: the frequent items (no more than MIN_SHARE times the mean basket's size) and
one batch of prefixes at a time (BATCH_CELLS / number of items).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.llm.common import broadcast_if_small, discard, map_arrow, materialize

#: least support: a number of baskets, and one basket in so many
MIN_COUNT, MIN_SHARE = 8, 2000
#: rules: least confidence in hundredths
MIN_CONFIDENCE = 10
#: counters (prefix x item) of a batch of prefixes
BATCH_CELLS = 1 << 21
SMALL_ITEMS = 200_000


def pairs(rows: DataFrame, basket_col: str, item_col: str) -> DataFrame:
    """Distinct (basket, item), both longs, of the rows that have both; written once."""
    r = rows.select(F.col(f"`{basket_col}`").cast("long").alias("basket"), F.col(f"`{item_col}`").cast("long").alias("item")).where("basket is not null and item is not null")
    return materialize(r.distinct())


class _Block:
    """Baskets of one Arrow batch: items by basket, and baskets by item."""

    def __init__(self, batch: pa.RecordBatch, items: np.ndarray):
        lists = batch.column("items")
        self.weight = batch.column("weight").to_numpy()
        self.size = np.diff(lists.offsets.to_numpy())
        self.start = np.concatenate(([0], np.cumsum(self.size)))
        self.item = np.searchsorted(items, lists.flatten().to_numpy())
        basket = np.repeat(np.arange(len(self.size)), self.size)
        # (item, basket) in one sorted key: a range of it is an item's baskets, a search in it tells whether a basket has an item
        self.n = len(self.size) + 1
        self.key = np.sort(self.item * self.n + basket)

    def occurrences(self, prefix: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(prefix number, basket) of every basket that holds all items of a prefix (rows padded with -1), an int matrix."""
        low = np.searchsorted(self.key, np.maximum(prefix, 0) * self.n)
        high = np.searchsorted(self.key, (np.maximum(prefix, 0) + 1) * self.n)
        count = np.where(prefix >= 0, high - low, np.iinfo(np.int64).max)
        rare = count.argmin(1)
        at = np.arange(len(prefix))
        who = np.repeat(at, count[at, rare])
        within = np.arange(len(who)) - np.repeat(np.cumsum(count[at, rare]) - count[at, rare], count[at, rare])
        basket = self.key[low[who, rare[who]] + within] % self.n
        for k in range(prefix.shape[1]):
            need = (prefix[who, k] >= 0) & (rare[who] != k)
            wanted = prefix[who, k] * self.n + basket
            found = np.minimum(np.searchsorted(self.key, wanted), len(self.key) - 1)
            stay = ~need | (self.key[found] == wanted)
            who, basket = who[stay], basket[stay]
        return who, basket

    def extensions(self, who: np.ndarray, basket: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
        """Occurrences times baskets: the weight of each (prefix, item) in this block."""
        size = self.size[basket]
        row = np.repeat(np.arange(len(who)), size)
        at = self.start[basket][row] + np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        cell = who[row] * shape[1] + self.item[at]
        return np.bincount(cell, self.weight[basket][row], shape[0] * shape[1]).astype(np.int64)


def _padded(prefixes: list[list[int]], items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    length = np.array([len(p) for p in prefixes], np.int64)
    out = np.full((len(prefixes), max(1, int(length.max(initial=0)))), -1, np.int64)
    for k, p in enumerate(prefixes):
        out[k, : len(p)] = np.searchsorted(items, p)
    return out, length


def _sums(baskets: DataFrame, frontier: DataFrame, items: np.ndarray, extend: bool, floor: int, cells: int) -> DataFrame:
    """Supports over all baskets of the frontier's prefixes (number long, prefix array<long>).

    With extend (number, item, support) of every item that at least floor of the prefix's baskets hold, the prefix's own among them;
    otherwise (number, support).
    """
    total = frontier.count()
    batch_rows = max(1, cells // (max(1, len(items)) if extend else 64))
    n_batches = -(-total // batch_rows)
    done = []
    for b in range(n_batches):
        # dealt by hash: about batch_rows prefixes, whatever the frontier's size
        rows = [(r.number, list(r.prefix)) for r in frontier.where(F.pmod(F.xxhash64("number"), F.lit(n_batches)) == b).collect()]
        if not rows:
            continue
        number = np.array([r[0] for r in rows], np.int64)
        prefix, length = _padded([r[1] for r in rows], items)

        def partial(batches, number=number, prefix=prefix, length=length):
            width = len(items) if extend else 1
            acc = np.zeros(len(number) * width, np.int64)
            for batch in batches:
                if not batch.num_rows:
                    continue
                block = _Block(batch, items)
                if not len(block.key):
                    continue
                who, basket = block.occurrences(prefix, length)
                acc += block.extensions(who, basket, (len(number), width)) if extend else np.bincount(who, block.weight[basket], len(number)).astype(np.int64)
            cell = np.flatnonzero(acc)
            yield pa.RecordBatch.from_arrays([pa.array(number[cell // width]), pa.array(items[cell % width] if extend else np.zeros(len(cell), np.int64)), pa.array(acc[cell])], ["number", "item", "n"])

        part = map_arrow(baskets, partial, "number long, item long, n long")
        done.append(materialize(part.groupBy("number", "item").agg(F.sum("n").alias("support")).where(F.col("support") >= floor)))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out if extend else out.drop("item")


def _numbered(df: DataFrame) -> DataFrame:
    return materialize(df.withColumn("number", F.monotonically_increasing_id()))


def closed_itemsets(rows: DataFrame, basket_col: str, item_col: str, min_count: int = MIN_COUNT, min_share: int = MIN_SHARE, cells: int = BATCH_CELLS):
    """(closed, baskets, items, n_baskets): the closed sets (items array<long> ascending, support) and what rules() needs.

    A basket is the distinct items of its rows; rows without basket or item are left out. An itemset is returned where at least
    min_count baskets and one in min_share hold it and no larger set has as many. Repeated rows change nothing, an empty
    table gives no sets, other columns are ignored. Ids have to be longs or castable to them.
    """
    both = pairs(rows, basket_col, item_col)
    n_baskets = both.select("basket").distinct().count()
    floor = max(min_count, -(-n_baskets // min_share))
    frequent = materialize(both.groupBy("item").agg(F.count("*").alias("support")).where(F.col("support") >= floor))
    items = np.sort(np.array([r.item for r in frequent.select("item").collect()], np.int64))
    spark = rows.sparkSession
    if not len(items):
        return spark.createDataFrame([], "items array<long>, support long"), None, frequent, n_baskets
    kept = both.join(broadcast_if_small(frequent.select("item"), SMALL_ITEMS), "item", "left_semi")
    lists = kept.groupBy("basket").agg(F.array_sort(F.collect_list("item")).alias("items"))
    baskets = materialize(lists.groupBy("items").agg(F.count("*").alias("weight")))
    # the empty set's closure: items that all baskets hold
    held = sorted(r.item for r in frequent.where(F.col("support") == n_baskets).collect())
    found = []
    if held:
        found.append(spark.createDataFrame([(held, n_baskets)], "items array<long>, support long"))
    own = F.array(*[F.lit(x).cast("long") for x in held]) if held else F.array().cast("array<long>")
    # a prefix is a closed set and one more item, after all by which that set was extended
    frontier = frequent.where(F.col("support") < n_baskets).select(own.alias("parent"), F.col("item").alias("last"), "support")
    while True:
        level = _numbered(frontier.select("parent", "last", "support", F.concat("parent", F.array("last")).alias("prefix")))
        if level.isEmpty():
            break
        sums = _sums(baskets, level.select("number", "prefix"), items, True, floor, cells)
        grown = sums.groupBy("number").agg(F.collect_list(F.struct("item", "support")).alias("with"))
        grown = level.join(grown, "number")
        closure = F.array_sort(F.transform(F.filter("with", lambda x: x.support == F.col("support")), lambda x: x.item))
        grown = grown.withColumn("closure", closure)
        owned = F.size(F.filter(F.array_except("closure", "parent"), lambda x: x < F.col("last"))) == 0
        closed = materialize(grown.where(owned).select("closure", "last", "support", F.filter("with", lambda x: (x.item > F.col("last")) & (x.support < F.col("support"))).alias("more")))
        found.append(closed.select(F.col("closure").alias("items"), "support"))
        frontier = closed.select(F.col("closure").alias("parent"), F.explode("more").alias("m")).select("parent", F.col("m.item").alias("last"), F.col("m.support").alias("support"))
        discard(level)
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out, baskets, frequent, n_baskets


def rules(closed: DataFrame, baskets: DataFrame | None, frequent: DataFrame, n_baskets: int, confidence: int = MIN_CONFIDENCE, cells: int = BATCH_CELLS) -> DataFrame:
    """(items, support, item, rest_support, item_support): rules from the rest of a closed set to one of its items.

    Confidence is at least so many hundredths and lift above 1. The supports of rests, closed or not, come from one more product
    of occurrences over the baskets.
    """
    each = closed.where(F.size("items") > 1).select("items", "support", F.explode("items").alias("item"))
    each = each.withColumn("rest", F.filter("items", lambda x: x != F.col("item")))
    single = frequent.select(F.col("item").alias("c"), F.col("support").alias("n"))
    rests = each.where(F.size("rest") > 1).select(F.col("rest").alias("prefix")).distinct()
    one = single.select(F.array("c").alias("prefix"), F.col("n").alias("rest_support"))
    if baskets is not None:
        level = _numbered(rests)
        if not level.isEmpty():
            items = np.sort(np.array([r.item for r in frequent.select("item").collect()], np.int64))
            counted = level.join(_sums(baskets, level, items, False, 1, cells), "number")
            one = one.unionByName(counted.select("prefix", F.col("support").alias("rest_support")))
    r = each.join(one, F.col("rest") == F.col("prefix")).join(single, F.col("item") == F.col("c"))
    r = r.select("items", "support", "item", "rest_support", F.col("n").alias("item_support"))
    return r.where((100 * F.col("support") >= confidence * F.col("rest_support")) & (F.col("support") * F.lit(n_baskets).cast("long") > F.col("rest_support") * F.col("item_support")))


def itemset_table(rows: DataFrame, basket_col: str, item_col: str, min_count: int = MIN_COUNT, min_share: int = MIN_SHARE, confidence: int = MIN_CONFIDENCE, cells: int = BATCH_CELLS) -> DataFrame:
    """One row per closed set: items as text, n_items, support, n_rules, best_item and the digest of its rules."""
    closed, baskets, frequent, n_baskets = closed_itemsets(rows, basket_col, item_col, min_count, min_share, cells)
    closed = materialize(closed)
    found = rules(closed, baskets, frequent, n_baskets, confidence, cells)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item", "rest_support", "item_support"))), lambda x: F.concat_ws(":", x.item.cast("string"), x.rest_support.cast("string"), x.item_support.cast("string"))), ";")
    best = F.min(F.struct("rest_support", "item")).alias("best")
    found = found.groupBy(F.col("items").alias("of")).agg(F.count("*").alias("n_rules"), best, text.alias("text"))
    out = closed.join(found, F.col("items") == F.col("of"), "left")
    return out.select(
        F.array_join(F.transform("items", lambda x: x.cast("string")), ",").alias("items"),
        F.size("items").cast("long").alias("n_items"),
        "support",
        F.coalesce("n_rules", F.lit(0)).cast("long").alias("n_rules"),
        F.col("best.item").alias("best_item"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("rules_sha256"),
    )


ORACLE = r"""
WITH RECURSIVE p AS (
  SELECT DISTINCT sale_id, item_id FROM sale_lines WHERE flag IS DISTINCT FROM 'returned' AND sale_id IS NOT NULL AND item_id IS NOT NULL),
b AS (SELECT count(DISTINCT sale_id) AS b FROM p),
f AS (SELECT sale_id, item_id FROM p, b WHERE item_id IN (SELECT item_id FROM p, b GROUP BY item_id HAVING count(*) >= 8 AND count(*) * 2000 >= any_value(b.b))),
q AS (
  SELECT [item_id] AS items, item_id AS last, sale_id FROM f
  UNION ALL
  SELECT list_append(q.items, f.item_id), f.item_id, q.sale_id FROM q JOIN f ON q.sale_id = f.sale_id AND f.item_id > q.last
  QUALIFY count(*) OVER (PARTITION BY q.items, f.item_id) >= 8 AND count(*) OVER (PARTITION BY q.items, f.item_id) * 2000 >= (SELECT b FROM b)),
s AS (SELECT items, count(*) AS support FROM q GROUP BY items),
d AS (SELECT items, support, c, list_filter(items, lambda x: x <> c) AS rest FROM (SELECT items, support, unnest(items) AS c FROM s)),
closed AS (SELECT s.* FROM s WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.rest = s.items AND d.support = s.support)),
r AS (
  SELECT d.items, d.c, a.support AS a, s1.support AS s
  FROM d JOIN s a ON d.rest = a.items JOIN s s1 ON s1.items = [d.c], b
  WHERE 100 * d.support >= 10 * a.support AND d.support * b.b > a.support * s1.support),
t AS (SELECT items, count(*) AS n_rules, arg_min(c, (a, c)) AS best_item, string_agg(c || ':' || a || ':' || s, ';' ORDER BY c) AS rules FROM r GROUP BY items)
SELECT array_to_string(closed.items, ',') AS items, len(closed.items) AS n_items, closed.support, coalesce(n_rules, 0) AS n_rules, best_item, sha256(coalesce(rules, '')) AS rules_sha256
FROM closed LEFT JOIN t ON closed.items = t.items
"""
