"""An ontology as a table: its aliases are found in texts by a dictionary join on n-grams of words.

The table has rows (category, name, alias). An alias occurs in a text where its canonical form stands in the text's
canonical form between edges that are no letter or digit - what `evidence.pattern` says with one regular expression
for each name, which holds for some tens of names; here an ontology may have any number of aliases.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexforge.functions import text as T
from lexforge.functions.similarity import bind
from lexforge.sources.shared import settle

#: bytes of aliases and names that may be broadcast
SMALL_BYTES = 16 << 20

_PIECE = "[a-z0-9]+|[^a-z0-9]+"


def ontology(spark: SparkSession, categories: Mapping[str, Mapping[str, tuple[str, ...]]]) -> DataFrame:
    """Rows (category, name, alias) of ontologies given as name -> aliases."""
    rows = [(c, n, a) for c, names in categories.items() for n, aliases in names.items() for a in aliases]
    return spark.createDataFrame(rows, "category string, name string, alias string")


def _aliases(table: DataFrame) -> DataFrame:
    """Distinct (category, name, key, lead, trail, n): key runs from an alias's first word to its last, lead and trail stand around it."""
    a = table.select("category", "name", T.canonical(F.col("alias")).alias("a")).where("a rlike '[a-z0-9]'").distinct()
    core = F.regexp_replace("a", "^[^a-z0-9]+|[^a-z0-9]+$", "")
    lead, trail = (F.regexp_extract("a", p, 0) for p in ("^[^a-z0-9]+", "[^a-z0-9]+$"))
    return a.select("category", "name", core.alias("key"), lead.alias("lead"), trail.alias("trail"), F.regexp_count(core, F.lit("[a-z0-9]+")).alias("n"))


def _spans(pieces: Column, lengths: list[int]) -> Column:
    """Every run of n words, for each n that some alias has, with what stands on both sides.

    pieces takes turns between words (odd places, from 0) and what is between them (even places).
    """
    words = (F.size(pieces) - 1) / 2

    def of(n: int) -> Column:
        firsts = F.when(words >= n, F.sequence(F.lit(0), (words - n).cast("int"))).otherwise(F.array().cast("array<int>"))
        return F.transform(
            firsts,
            lambda i: F.struct(
                i.alias("first"),
                (i + n - 1).alias("last"),
                F.array_join(F.slice(pieces, i * 2 + 2, F.lit(2 * n - 1)), "").alias("key"),
                F.element_at(pieces, i * 2 + 1).alias("before"),
                F.element_at(pieces, i * 2 + 2 * n + 1).alias("after"),
            ),
        )

    return F.concat(*[of(n) for n in lengths])


def matches(texts: DataFrame, id_col: str, text: str, table: DataFrame, longest: bool = False) -> DataFrame:
    """Distinct rows (id_col, category, name) of the names whose aliases occur in a text.

    With longest an alias counts only where no longer match holds all its words and more: "google cloud" is not met
    inside "google cloud platform", but is where it stands alone. Names that share an alias are all met.

    Null and empty texts and aliases without a letter or digit match nothing; an empty table matches nothing; rows
    that share an id count as parts of one text, a null id is a value like any other. Only the lengths of aliases go
    to the driver. The aliases are broadcast if their bytes prove small; beyond, spans are shuffled by their words and
    a word sequence met often is left to the splitting of skewed joins.
    """
    aliases = _aliases(table)
    lengths = sorted(r.n for r in aliases.select("n").distinct().collect())
    kind = texts.schema[id_col].dataType
    if not lengths:
        return texts.sparkSession.createDataFrame([], f"id {kind.simpleString()}, category string, name string").withColumnRenamed("id", id_col)
    size = aliases.agg(F.sum(F.octet_length("key") + F.octet_length("name") + F.octet_length(F.coalesce("category", F.lit(""))) + 48)).first()[0]
    padded = F.concat(F.lit(" "), T.canonical(F.coalesce(F.col(text), F.lit(""))), F.lit(" "))
    spans = bind(F.regexp_extract_all(padded, F.lit(_PIECE), F.lit(0)), lambda p: _spans(p, lengths))
    t = texts.select(F.col(id_col).alias("id"), F.explode(spans).alias("s")).select("id", "s.*")
    # around a match stands a letter, a digit or the text's edge only if lead or trail leaves nothing of the piece
    edges = F.endswith("before", "lead") & F.startswith("after", "trail") & (F.length("before") > F.length("lead")) & (F.length("after") > F.length("trail"))
    met = t.join(F.broadcast(aliases) if size <= SMALL_BYTES else aliases, "key").where(edges)
    if longest:
        met = _longest(met)
    return met.select(F.col("id").alias(id_col), "category", "name").distinct()


def _longest(met: DataFrame) -> DataFrame:
    """Matches not inside a longer one. By first word, the longer first: one that ends no later than any before it is inside."""
    met = met.groupBy("id", "first", "last").agg(F.collect_set(F.struct("category", "name")).alias("names"))
    before = Window.partitionBy("id").orderBy("first", F.desc("last")).rowsBetween(Window.unboundedPreceding, -1)
    met = met.withColumn("reached", F.max("last").over(before)).where("reached is null or last > reached")
    return met.select("id", F.inline("names"))


def ledgers(texts: DataFrame, id_col: str, text: str, table: DataFrame, brought: DataFrame, longest: bool = False) -> DataFrame:
    """(id_col, entities, concerns, reasons): sorted names by text, from the categories of these names.

    brought has rows (concern, entity): a concern met brings its entity along. A text without any match keeps its row.
    """
    # each distinct text is searched once, however many rows hold it
    parts = texts.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    met = matches(parts.select("_text").distinct(), "_text", "_text", table, longest).withColumnRenamed("_text", id_col)
    more = met.where("category = 'concerns'").join(brought, F.col("name") == F.col("concern")).select(id_col, F.lit("entities").alias("category"), F.col("entity").alias("name"))
    names = lambda c: F.sort_array(F.collect_set(F.when(F.col("category") == c, F.col("name")))).alias(c)
    kinds = ("entities", "concerns", "reasons")
    found = settle(met.unionByName(more).groupBy(F.col(id_col).alias("_text")).agg(*[names(c) for c in kinds]))
    size = found.agg(F.coalesce(F.sum(F.octet_length("_text") + sum(F.octet_length(F.array_join(c, " ")) + F.size(c) * 16 for c in kinds)), F.lit(0))).first()[0]
    rows = parts.join(F.broadcast(found) if size <= SMALL_BYTES else found, "_text", "left")
    rows = rows.groupBy("_id").agg(*[F.collect_set(c).alias(c) for c in kinds])
    return rows.select(F.col("_id").alias(id_col), *[F.sort_array(F.array_distinct(F.flatten(c))).alias(c) for c in kinds])
