"""Relevance by term-frequency cosine: texts and queries as tall (id, token, n, norm) tables joined on tokens.

Where the queries' words are few enough to broadcast, all pairs are summed up where the texts are. Beyond, where only the best
texts of a query or those above a threshold are asked for, upper bounds from the largest weight of each word in blocks of texts
cut the search before pairs are formed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexforge.functions import text as T
from lexforge.functions.similarity import entropy
from lexforge.sources.shared import settle

#: query-side (query, token, n) rows that may be broadcast after a count
SMALL_TERMS = 500_000


#: units of similarity by which a bound is loosened, so that no rounding of sums or of results cuts a pair
SLACK = 1e-8


def postings(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, token, n, norm2): counts of non-stop words and the text's squared norm; a text without any has no row. Counts are written once and read for the norms."""
    rows = df.select(F.col(id_col).alias("id"), F.explode(T.words(F.col(text_col))).alias("token"))
    tf = settle(rows.groupBy("id", "token").agg(F.count("*").alias("n")))
    norms = tf.groupBy("id").agg(F.sum(F.col("n") * F.col("n")).alias("norm2"))
    return tf.join(norms, "id")


def _cosines(q: DataFrame, texts: DataFrame, text_id: str, text_text: str) -> DataFrame:
    """(q, id, similarity) of all pairs that share a word, for queries that are broadcast.

    Texts are dealt out by id once; counts, norms and sums over a pair's words then stay where the text is, so that neither words nor
    pairs are shuffled.
    """
    rows = texts.select(F.col(text_id).alias("id"), F.col(text_text).alias("t")).repartition("id").select("id", F.explode(T.words(F.col("t"))).alias("token"))
    tf = rows.groupBy("id", "token").agg(F.count("*").alias("n"))
    d = tf.groupBy("id").agg(F.sum(F.col("n") * F.col("n")).alias("norm2"), F.collect_list(F.struct("token", "n")).alias("c"))
    d = d.select("id", "norm2", F.explode("c").alias("e")).select("id", "norm2", F.col("e.token").alias("token"), F.col("e.n").alias("n"))
    both = d.join(F.broadcast(q), "token").groupBy("id", "q").agg(F.sum(F.col("n") * F.col("qn")).alias("dot"), F.first("qq").alias("qq"), F.first("norm2").alias("norm2"))
    return both.select("q", "id", (F.col("dot") / F.sqrt((F.col("qq") * F.col("norm2")).cast("double"))).alias("similarity"))


def _floors(q: DataFrame, d: DataFrame, k: int, least: float) -> DataFrame:
    """(q, floor): a similarity that k texts reach for sure, from those in which a query's words weigh most; least where fewer are found."""
    heavy = d.withColumn("place", F.row_number().over(Window.partitionBy("token").orderBy(F.desc("w"), "id"))).where(F.col("place") <= k)
    seeds = heavy.select("token", "id").join(q.select("q", "token"), "token").select("q", "id").distinct()
    known = _scored(q, d, seeds).select("q", "similarity").withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("similarity"))))
    return known.where(F.col("place") == k).select("q", F.greatest(F.col("similarity"), F.lit(least)).alias("floor"))


def _candidates(q: DataFrame, d: DataFrame, floors: DataFrame | None, least: float) -> DataFrame:
    """(q, id): texts that may reach a query's floor.

    Texts lie in blocks of like norm, and for each word and block the largest weight is known. A query's words, those first that add
    least at most for the texts that have them, split into some that together stay below the floor and the rest: a text without
    one of the rest can't reach it, and a block without any isn't looked at.
    """
    most = d.groupBy("token", "block").agg(F.max("w").alias("top"), F.count("*").alias("df"))
    bound = q.join(most, "token").withColumn("adds", F.col("qn") * F.col("top") / F.sqrt(F.col("qq").cast("double")))
    floor = F.lit(least)
    if floors is not None:
        bound, floor = bound.join(floors, "q", "left"), F.coalesce("floor", F.lit(least))
    below = Window.partitionBy("q", "block").orderBy(F.col("adds") / F.col("df"), "token").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    needed = bound.withColumn("sum", F.sum("adds").over(below)).where(F.col("sum") >= floor - SLACK).select("q", "token", "block")
    return d.select("id", "token", "block").join(needed, ["token", "block"]).select("q", "id").distinct()


def _scored(q: DataFrame, d: DataFrame, pairs: DataFrame) -> DataFrame:
    """(q, id, similarity) of pairs (q, id), exactly."""
    both = pairs.join(d.select("id", "token", "n", "norm2"), "id").join(q, ["q", "token"])
    both = both.groupBy("q", "id").agg(F.sum(F.col("n") * F.col("qn")).alias("dot"), F.first("qq").alias("qq"), F.first("norm2").alias("norm2"))
    return both.select("q", "id", (F.col("dot") / F.sqrt((F.col("qq") * F.col("norm2")).cast("double"))).alias("similarity"))


def relevance(queries: DataFrame, texts: DataFrame, query_id: str, text_id: str, query_text: str = "text", text_text: str = "text", least: float = 0.0, k: int | None = None) -> DataFrame:
    """Pairs of a query and a text that share a word: (query_id, text_id, similarity). Pairs left out have similarity 0.

    With least or k, pairs below least, or which k texts of the query exceed, may be left out before they are formed: all of
    similarity >= least stay, and so do the best k of each query with all ties. Ids are to be unique.
    """
    q = postings(queries, query_id, query_text).select(F.col("id").alias("q"), "token", F.col("n").alias("qn"), F.col("norm2").alias("qq"))
    small = q.limit(SMALL_TERMS + 1).count() <= SMALL_TERMS
    d = None if small and not k else postings(texts, text_id, text_text)
    if small and not k:
        out = _cosines(q, texts, text_id, text_text).where(F.col("similarity") >= least - SLACK)
    elif least <= 0 and not k:
        pairs = d.join(q, "token").groupBy("q", "id").agg(F.sum(F.col("n") * F.col("qn")).alias("dot"), F.first("qq").alias("qq"), F.first("norm2").alias("norm2"))
        out = pairs.select("q", "id", (F.col("dot") / F.sqrt((F.col("qq") * F.col("norm2")).cast("double"))).alias("similarity"))
    else:
        q = F.broadcast(q) if small else q
        asked = q.select("token").distinct()
        d = d.join(F.broadcast(asked) if small else asked, "token", "left_semi")
        d = settle(d.select("id", "token", "n", "norm2", (F.col("n") / F.sqrt(F.col("norm2").cast("double"))).alias("w"), F.floor(F.log2(F.col("norm2"))).cast("int").alias("block")))
        q = settle(q)
        q = F.broadcast(q) if small else q
        floors = settle(_floors(q, d, k, least)) if k else None
        out = _scored(q, d, _candidates(q, d, floors, least)).where(F.col("similarity") >= least - SLACK)
    return out.select(F.col("q").alias(query_id), F.col("id").alias(text_id), "similarity")


def with_texts(best: DataFrame, texts: DataFrame, text_id: str) -> DataFrame:
    """best joined to its texts; few best rows are broadcast, so that not all texts are shuffled or worked on to find them."""
    best = settle(best)
    few = best.limit(SMALL_TERMS + 1).count() <= SMALL_TERMS
    return texts.join(F.broadcast(best) if few else best, text_id)


def top_k(pairs: DataFrame, by: str, value: str, tie: str, k: int) -> DataFrame:
    w = Window.partitionBy(by).orderBy(F.desc(value), tie)
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def entropy_filter(df: DataFrame, text_col: str, least: float = 0.0) -> DataFrame:
    """df with entropy, least_entropy and changed: the score that a policy may act on. No text is cut by entropy alone.

    A null or wordless text has entropy 0.
    """
    score = F.coalesce(entropy(T.all_words(F.col(text_col))), F.lit(0.0))
    return df.withColumns({"entropy": score, "least_entropy": F.lit(float(least)), "changed": F.lit(False)})


#: vectors in one tile, queries in one block, bytes of blocks that one pass broadcasts
TILE, QUERY_BLOCK, BLOCK_BYTES = 2048, 512, 32 << 20
#: most bytes of one tile
TILE_BYTES = 2 << 20
#: Spark's own bound of an Arrow batch, which leaves room for many tiles
_DEFAULT_BATCH = "67108864b"
_PACK = "ids array<{0}>, width int, flat binary, norms array<double>"


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """Rows (id, v, n) packed into rows of up to size vectors of one width. A vector that is null, holds a null or has no norm keeps a null norm."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, norms = batch.column(0), batch.column(2)
            widths = np.asarray(pc.fill_null(pc.list_value_length(batch.column(1)), 0))
            for width in np.unique(widths):
                places = np.flatnonzero(widths == width)
                step = max(1, min(size, TILE_BYTES // (8 * max(1, int(width)))))
                for at in range(0, len(places), step):
                    some = pa.array(places[at : at + step])
                    flat = np.asarray(batch.column(1).take(some).flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
                    rows = [ids.take(some).to_pylist(), int(width), flat.tobytes(), norms.take(some).to_pylist()]
                    yield pa.RecordBatch.from_arrays([pa.array([rows[0]], pa.list_(ids.type)), pa.array([rows[1]], pa.int32()), pa.array([rows[2]], pa.binary()), pa.array([rows[3]], pa.list_(pa.float64()))], ["ids", "width", "flat", "norms"])

    return rows.mapInArrow(pack, _PACK.format(rows.schema["id"].dataType.simpleString()))


def _best(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Of rows that hold a tile and a block the best k vectors of each query, kept over all rows of the task."""
    kept: dict = {}
    for batch in batches:
        for row in zip(*[c for c in batch.columns], strict=True):
            t_ids, t_width, t_flat, t_norms, q_ids, q_width, q_flat, q_norms = (x.as_py() for x in row)
            if not t_ids or not q_ids:
                continue
            tn, qn = (np.array([np.nan if n is None else n for n in x]) for x in (t_norms, q_norms))
            no_t, no_q = (np.array([n is None or n == 0 for n in x]) for x in (t_norms, q_norms))
            same = t_width == q_width
            tv = np.frombuffer(t_flat).reshape(len(t_ids), t_width)
            qv = np.frombuffer(q_flat).reshape(len(q_ids), q_width)
            # of equal vectors only the k + 1 first by id can be among the best, one of them being the query itself
            order = sorted(range(len(t_ids)), key=lambda i: (tv[i].tobytes(), no_t[i], t_ids[i]))
            run, last, use = 0, None, []
            for i in order:
                key = (tv[i].tobytes(), no_t[i])
                run, last = (run + 1 if key == last else 1), key
                if run <= k + 1:
                    use.append(i)
            use = np.array(use)
            with np.errstate(all="ignore"):
                s = (qv @ tv[use].T) / (qn[:, None] * tn[use][None, :]) if same else np.full((len(q_ids), len(use)), -np.inf)
            s = np.where(np.isnan(s), np.inf, s)
            s[:, no_t[use]] = -np.inf
            s[no_q, :] = -np.inf
            s[np.array(q_ids)[:, None] == np.array(t_ids)[use][None, :]] = np.nan
            top = np.where(np.isnan(s), -np.inf, s).max(axis=1)
            some = min(k, len(use))
            for j, q in enumerate(q_ids):
                own = s[j]
                valid = np.flatnonzero(~np.isnan(own))
                if not len(valid):
                    continue
                have = kept.get(q, [])
                if len(have) == k and top[j] < -have[-1][0] - SLACK:
                    continue
                floor = np.partition(own[valid], max(0, len(valid) - some))[max(0, len(valid) - some)]
                if len(have) == k:
                    floor = max(floor, -have[-1][0])
                near = valid[own[valid] >= floor - SLACK]
                if np.isneginf(floor):
                    near = sorted(near, key=lambda x: (-own[x], t_ids[use[x]]))[: k]
                if not len(near):
                    continue
                # the same sums from left to right as dense_dot()
                for x in near:
                    i = use[x]
                    if np.isneginf(own[x]):
                        have.append((np.inf, t_ids[i], None))
                    else:
                        v = float(np.add.accumulate(np.concatenate(([0.0], qv[j] * tv[i])))[-1] / (qn[j] * tn[i]))
                        have.append((-np.inf if np.isnan(v) else -v, t_ids[i], v))
                kept[q] = sorted(have, key=lambda x: x[:2])[:k]
    found = [(q, i, v) for q, rows in kept.items() for _, i, v in rows]
    for at in range(0, len(found), 10_000):
        q, i, v = zip(*found[at : at + 10_000], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(i, pa.int64()), pa.array(v, pa.float64())], ["query_id", "vec_id", "s"])


def dense_top_k(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """The k vectors of highest cosine for each query: (query_id, vec_id, similarity, rank); a vector isn't its own neighbour.

    queries: (q struct<id, v, n>), vectors: (vec_id, embedding, norm), ids long. Vectors are packed into tiles where they lie
    and queries into blocks; a tile meets a block as a product of matrices, whose pairs near the best are summed up again as
    dense_dot() does. Blocks are broadcast, BLOCK_BYTES in a pass over the tiles, so vectors are never shuffled, and a
    task hands on no more than k rows a query. All pairs are formed: the work is queries times vectors.
    """
    conf, key = queries.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key, None) == _DEFAULT_BATCH:
        conf.set(key, str(4 * TILE_BYTES))
    q = settle(_packed(queries.select("q.id", "q.v", "q.n").toDF("id", "v", "n").where("id is not null"), QUERY_BLOCK))
    size = q.agg(F.coalesce(F.sum(F.length("flat")), F.lit(0))).first()[0]
    tiles = _packed(vectors.where("vec_id is not null").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), F.col("norm").alias("n")), TILE)
    tiles = settle(tiles) if size > BLOCK_BYTES else tiles
    passes = max(1, -(-size // BLOCK_BYTES))
    blocks = q.toDF("q_ids", "q_width", "q_flat", "q_norms")
    if passes > 1:
        blocks = settle(blocks.withColumn("pass", F.pmod(F.xxhash64("q_ids"), F.lit(passes))))
    out = None
    for i in range(passes):
        part = blocks.where(F.col("pass") == i).drop("pass") if passes > 1 else blocks
        one = tiles.crossJoin(F.broadcast(part)).mapInArrow(lambda b: _best(b, k), "query_id long, vec_id long, s double")
        out = one if out is None else out.unionByName(one)
    return top_k(out, "query_id", "s", "vec_id", k).withColumnRenamed("s", "similarity")
