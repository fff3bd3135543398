"""Exact duplicates by content hash: groups of a 128-bit digest, a kept row each, bytes compared inside the groups.

DataFrame operations only. What is shuffled for every row is narrow (id, digests, length); texts move only for the rows
of groups of two or more, and there equal texts meet in the map-side aggregate first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexforge.llm.common import broadcast_if_small, materialize

WHITE = " \t\n\x0b\x0c\r"
#: groups of several rows that may be broadcast: a 16-byte digest each
SMALL_GROUPS = 100_000
#: ways that the rows of one digest are dealt where their groups are too many to broadcast
SALTS = 16


def normalized(text: Column) -> Column:
    """The text without ASCII white space; a null text is an empty one."""
    return F.translate(F.coalesce(text, F.lit("")), WHITE, "")


def content_hash(norm: Column) -> Column:
    return F.unhex(F.md5(norm))


def _repeated(rows: DataFrame) -> DataFrame:
    """(key, part, n, keep_id, keep_tag) of the groups of two rows and more: most code points, smallest id (null last), smallest tag."""
    best = F.min(F.struct((-F.col("n_code")).alias("less"), F.col("id").isNull().alias("none"), F.col("id"), F.col("tag"))).alias("best")
    groups = rows.groupBy("key", "part").agg(F.count("*").alias("n"), best).where("n > 1")
    return materialize(groups.select("key", "part", "n", F.col("best.id").alias("keep_id"), F.col("best.tag").alias("keep_tag")))


def _with_text(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of docs whose digest is among keys (distinct)."""
    small = broadcast_if_small(keys, SMALL_GROUPS)
    if small is not keys:
        return docs.join(small, "key", "left_semi")
    # dealt by digest and salt, so that a digest with a third of all rows is no task of its own
    each = keys.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return docs.withColumn("salt", F.pmod(F.xxhash64("id", F.length("text")), F.lit(SALTS)).cast("int")).join(each, ["key", "salt"], "left_semi").drop("salt")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=content_hash) -> DataFrame:
    """One row per row of docs: (id_col, keep_id, group_size long, kept boolean, text_sha256 string).

    Texts are equal when they are the same bytes after ASCII white space is deleted; null counts as empty, and so does a text
    of white space alone, so all those are one group. Of equal texts the row with the most code points in the original
    text stays, then that with the smallest id, null last; of rows repeated with id and length alike exactly one stays.
    Digests only propose groups: in every group of two rows or more the texts themselves are grouped, and where one digest
    stands for several texts each of them becomes a group. An empty table gives no rows; other columns are ignored.
    """
    text = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    named = text.withColumn("norm", normalized(F.col("text")))
    named = named.withColumn("key", digest(F.col("norm")))
    columns = [F.col("id"), F.col("key"), F.coalesce(F.length("text"), F.lit(0)).alias("n_code"), F.sha2("norm", 256).alias("sha"), F.monotonically_increasing_id().alias("tag")]
    # written once: the tag, which tells repeated rows apart, has to be the same in both reads
    rows = materialize(named.select(*columns, F.lit(0).alias("part")))
    groups = _repeated(rows)
    texts = _with_text(named.select("id", "text", "key", "norm"), groups.select("key")).groupBy("key", "norm").agg(F.lit(1).alias("one"))
    clash = materialize(texts.groupBy("key").count().where("count > 1").select("key"))
    if not clash.isEmpty():
        # one digest, several texts: each text gets a number, and rows find theirs by the text itself
        several = materialize(texts.join(clash, "key", "left_semi").select("key", "norm", (F.monotonically_increasing_id() + 1).cast("long").alias("part")))
        again = named.join(several.withColumnRenamed("key", "k").withColumnRenamed("norm", "t"), (F.col("key") == F.col("k")) & (F.col("norm") == F.col("t")))
        again = materialize(again.select(*columns, "part"))
        rows = rows.withColumn("part", F.col("part").cast("long")).join(clash, "key", "left_anti").unionByName(again)
        groups = _repeated(rows)
    else:
        rows, groups = rows.withColumn("part", F.col("part").cast("long")), groups.withColumn("part", F.col("part").cast("long"))
    out = rows.join(groups, ["key", "part"], "left")
    single = F.col("n").isNull()
    return out.select(
        F.col("id").alias(id_col),
        F.when(single, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (single | (F.col("tag") == F.col("keep_tag"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of docs, all columns, one per group of equal texts; of rows repeated with id and text alike one, whatever its other columns hold."""
    stay = exact_duplicates(docs, id_col, text_col).where("kept").select(F.col(id_col).alias("_id"), F.col("text_sha256").alias("_sha")).alias("k")
    key = F.struct(F.col(f"`{id_col}`").alias("id"), F.sha2(normalized(F.col(f"`{text_col}`")), 256).alias("sha"), F.coalesce(F.length(f"`{text_col}`"), F.lit(0)).alias("n")).alias("_lexforge_key")
    rows = docs.select("*", key)
    kept = rows.join(stay, F.col("_lexforge_key.id").eqNullSafe(F.col("k._id")) & (F.col("_lexforge_key.sha") == F.col("k._sha")), "left_semi")
    # rows of one id and text but other white space: the longest stays
    longest = kept.groupBy("_lexforge_key.id", "_lexforge_key.sha").agg(F.max("_lexforge_key.n").alias("_n")).select(F.col("id").alias("_i"), F.col("sha").alias("_s"), "_n")
    kept = kept.join(longest, F.col("_lexforge_key.id").eqNullSafe(F.col("_i")) & (F.col("_lexforge_key.sha") == F.col("_s")) & (F.col("_lexforge_key.n") == F.col("_n")), "left_semi")
    return kept.dropDuplicates(["_lexforge_key"]).drop("_lexforge_key")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(length(text), 0) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents),
g AS (
  SELECT doc_id, t, row_number() OVER w AS r, first_value(doc_id) OVER w AS keep_id FROM d
  WINDOW w AS (PARTITION BY t ORDER BY n DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, count(*) OVER (PARTITION BY t) AS group_size, r = 1 AS kept, sha256(t) AS text_sha256 FROM g
"""
