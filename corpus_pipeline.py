"""A corpus pipeline: language ID, line dedup, near-duplicate removal, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; its result is written as
Parquet and read again as the next one's docs. All but the last return the columns of documents.

Common to all stages: null ids, languages and sources are values like any other; repeated rows are rows of their own
unless a stage says otherwise; further columns, whatever their names, pass through untouched; an empty table gives an
empty one; very long texts are worked on whole, in spans of bounded memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.llm import decontam, jaccard, langid, linededup, mixing
from lexforge.llm.common import WORD, broadcast_if_small, materialize


def _columns(docs: DataFrame) -> list[Column]:
    """All columns by quoted name, whatever the names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of no learned language go: null, empty or letterless texts, and noise in all of them.

    The model learns from these documents' labels; without any label nothing is learned and all documents go. Ties
    between languages change nothing here.
    """
    return langid.keep_known_languages(docs, langid.train(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of each source go; every document stays with the lines left, an empty text if none are.

    A null text stays null; n_chars is set anew where a text changed. A line exactly at the ratio stays.
    """
    return linededup.drop_boilerplate(docs).select(*_columns(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked rows one stays: that of the smallest doc_id, null last, then of the smallest text key.

    Rows are told apart by doc_id and text, so a repeated or null doc_id neither drops a row of another group nor
    keeps a second one of its own. Rows without a word link with nothing and all stay.
    """
    classes = materialize(jaccard.near_duplicate_classes(docs, row_key=True))
    gone = materialize(classes.where("component_id <> doc_id").select("doc_id").distinct())
    twice = materialize(classes.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    nulls = not classes.where("doc_id is null").isEmpty()
    again = broadcast_if_small(twice, jaccard.SMALL_ROWS)
    repeats = not twice.isEmpty()
    once = docs.where("doc_id is not null") if nulls else docs
    once = once.join(again, "doc_id", "left_anti") if repeats else once
    out = once.join(broadcast_if_small(gone, jaccard.SMALL_ROWS), "doc_id", "left_anti").select(*_columns(docs))
    if not (repeats or nulls):
        return out
    # rows whose id alone doesn't name them: the group's row is chosen among those of its smallest id
    first = classes.where("n_shingles > 0 and doc_id <=> component_id")
    first = first.where("doc_id is null").unionByName(first.join(again, "doc_id", "left_semi").select(*first.columns))
    stay = first.groupBy("group").agg(F.min("doc_id").alias("id"), F.min("text_key").alias("key"))
    stay = broadcast_if_small(materialize(stay.select("id", "key")), jaccard.SMALL_ROWS).alias("k")
    rows = docs.where("doc_id is null").unionByName(docs.join(again, "doc_id", "left_semi").select(*_columns(docs)))
    has_word = F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    same = F.col("r.doc_id").eqNullSafe(F.col("k.id")) & (jaccard.text_key(F.col("r.text")) == F.col("k.key"))
    kept = rows.where(has_word).alias("r").join(stay, same, "left_semi").select("r.*")
    # of rows alike in id and text the first by all their columns, so that reruns agree
    whole = F.struct(*_columns(docs))
    kept = kept.groupBy(F.col("doc_id").alias("_id"), F.col("text").alias("_text")).agg(F.min_by(whole, F.to_json(whole)).alias("row")).select("row.*")
    return out.unionByName(rows.where(~has_word)).unionByName(kept)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; a similarity exactly at the threshold counts as held.

    Documents without text stay. Items without text match nothing, and an empty benchmark removes nothing.
    """
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that a mix of the sources takes of each document left: doc_id, source, size, source_size, target, taken.

    A null or empty text has size 0 and gives nothing; repeated rows keep a row each.
    """
    return mixing.mix(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("source_mixing", source_mixing),
]

#: code lengths, near-duplicate search and pseudorandom draws have no SQL form; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs


QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
