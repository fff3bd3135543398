"""Sources and sinks: key/value settings, model calls behind an injectable function, JSON, CSV, JSON lines and Markdown reports."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.errors import HttpError


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer splits than the cluster has cores, dealt out to all of them; any other is left as it is.

    For a small file that heavy row-by-row work follows; a table of many files or row groups never moves.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def spread_rows(df: DataFrame) -> DataFrame:
    """Narrow rows dealt out evenly before heavy work on each, two tasks a core.

    A scan has a task for each stretch of bytes, but rows only for those that a row group begins in: few large row groups
    leave most cores idle, the more so the larger the file.
    """
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism)


def dealt(df: DataFrame, key: str) -> DataFrame:
    """Rows of much work each, dealt out by key to as many partitions as there are cores or shuffle partitions.

    A fixed number, so that rows that are few and small but dear don't end up in one task.
    """
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), F.xxhash64(key))


def chunks(df: DataFrame, id_col: str, array_col: str) -> DataFrame:
    """Context arrays as rows (id_col, idx, text)."""
    return df.select(id_col, F.posexplode(array_col).alias("idx", "text"))


def settings(spark: SparkSession, path: str) -> DataFrame:
    """Key/value lines: blanks, comments and lines without = are passed over; quotes around a value go; the first of equal keys counts."""
    lines = spark.read.text(path, wholetext=False).select(F.trim("value").alias("v"), F.monotonically_increasing_id().alias("i"))
    rows = lines.where("v <> '' and not startswith(v, '#') and contains(v, '=')").select("i", F.split("v", "=", 2).alias("p"))
    rows = rows.select("i", F.trim(F.col("p")[0]).alias("key"), F.regexp_replace(F.regexp_replace(F.trim(F.col("p")[1]), "^[\"']+|[\"']+$", ""), "^\\s+|\\s+$", "").alias("value"))
    return rows.groupBy("key").agg(F.min_by("value", "i").alias("value"))


def offline_model(system: str, user: str) -> str:
    """Constant answer in the shape of a model's."""
    return '{"final_score": null, "shortlist_decision": "N/A", "evidence_terms": [], "reasons": [], "concerns": [], "interview_plan": []}'


def call_model(
    requests: DataFrame,
    id_col: str = "request_id",
    model: Callable[[str, str], str] = offline_model,
    retries: int = 1,
    plain: Callable[[str, str], str] | None = None,
    wait: Callable[[float], None] = time.sleep,
    longest_wait: float = 60.0,
) -> DataFrame:
    """Answers of a model to (id_col, system, user): (id_col, text, ok, error). model is any callable and may do network calls.

    A call that raises is tried again retries times; then its row says why. HttpError is handled by its code: after 400
    plain is asked instead, if there is one (a service that refuses structured output); after 429 the wait it asks for
    comes first, 2 seconds without one, longest_wait at most; 401, 403 and 404 aren't tried again. Tasks may be rerun,
    so a model that has effects should be idempotent.
    """
    kind = requests.schema[id_col].dataType.simpleString()

    def one(system: str, user: str) -> tuple[str | None, bool, str | None]:
        error, ask = None, model
        for attempt in range(retries + 1):
            try:
                return ask(system, user), True, None
            except HttpError as e:
                error = f"{type(e).__name__}: {e}"
                if e.code in (401, 403, 404):
                    break
                if e.code == 400 and plain is not None:
                    ask = plain
                if e.code == 429 and attempt < retries:
                    wait(min(longest_wait, 2.0 if e.retry_after is None else e.retry_after))
            except Exception as e:  # whatever a model raises becomes a row
                error = f"{type(e).__name__}: {e}"
        return None, False, error

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [one(s or "", u or "") for s, u in zip(pdf.system, pdf.user, strict=True)]
            yield pd.DataFrame([(i, *g) for i, g in zip(pdf[id_col], got, strict=True)], columns=[id_col, "text", "ok", "error"])

    return requests.select(id_col, "system", "user").mapInPandas(run, f"{id_col} {kind}, text string, ok boolean, error string")


def models(spark: SparkSession, fetch: Callable[[], list[dict]]) -> DataFrame:
    """Metadata of the models that a service shows: (id, owner). fetch returns its list of records."""
    return spark.createDataFrame([(m.get("id"), m.get("owned_by")) for m in fetch() if isinstance(m, dict)], "id string, owner string")


def health(shown: DataFrame, configured: str, sample: int = 10) -> DataFrame:
    """One row on a service: (ok, configured_model, model_visible, visible_model_count, sample_models); asks for no tokens."""
    ids = F.sort_array(F.collect_list("id"))
    return shown.agg(
        F.lit(True).alias("ok"),
        F.lit(configured).alias("configured_model"),
        (F.count_if(F.col("id") == configured) > 0).alias("model_visible"),
        F.count("*").alias("visible_model_count"),
        F.slice(ids, 1, sample).alias("sample_models"),
    )


def flat(df: DataFrame) -> DataFrame:
    """For CSV: arrays joined by a pipe, newlines to spaces, structs and maps as JSON."""

    def one(name: str, kind: str) -> Column:
        c = F.col(f"`{name}`")
        if kind.startswith("array"):
            c = F.array_join(c.cast("array<string>"), "|")
        elif kind.startswith(("struct", "map")):
            c = F.to_json(c)
        return F.regexp_replace(c, r"[\r\n]+", " ").alias(name) if kind in ("string",) or not kind[0].isdigit() and kind.startswith(("array", "struct", "map")) else c.alias(name)

    return df.select(*[one(n, k) for n, k in df.dtypes])


def write_csv(df: DataFrame, path: str) -> None:
    flat(df).write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    """Append rows with a UTC timestamp, as a usage log does."""
    df.select(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX").alias("timestamp"), "*").write.mode("append").json(path)


def pretty_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*"), {"pretty": "true"}).alias("value"))


def markdown(df: DataFrame, title: str) -> DataFrame:
    """Rows as Markdown bullets under a title, one text row each; values are escaped by being inline code."""
    bullets = F.concat_ws("\n", *[F.concat(F.lit(f"- {n}: `"), F.coalesce(F.col(f"`{n}`").cast("string"), F.lit("")), F.lit("`")) for n in df.columns])
    return df.select(F.concat(F.lit(f"# {title}\n\n"), bullets, F.lit("\n")).alias("value"))


def summary(df: DataFrame, title: str, width: int = 90) -> list[str]:
    """Lines of a console summary of a small result: a ruled title, then a line for each value of each row."""
    rule, rows = "=" * width, df.collect()
    lines = [rule, title.upper(), rule]
    longest = max((len(c) for c in df.columns), default=0)
    for i, row in enumerate(rows):
        lines += ["-" * width] * (i > 0) + [f"{c + ':':<{longest + 2}}{'' if v is None else v}" for c, v in zip(df.columns, row, strict=True)]
    return [*lines, rule]


def print_summary(df: DataFrame, title: str) -> None:
    print("\n".join(summary(df, title)))
