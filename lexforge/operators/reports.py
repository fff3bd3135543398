"""Run reports, contract tables and error classes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.functions.lexicons import CONTRACTS


def http_error(code: Column) -> Column:
    known = F.when(code == 401, "unauthorized").when(code == 403, "forbidden").when(code == 404, "not_found").when(code == 429, "rate_limited")
    return known.when(code >= 500, "server").otherwise("other")


def run_report(calls: DataFrame) -> DataFrame:
    """Totals of each run from its calls (run_id, tokens, cost, status, retention)."""
    return calls.groupBy("run_id").agg(
        F.count("*").alias("calls"),
        F.sum("tokens").cast("double").alias("tokens"),
        F.round(F.sum("cost"), 8).alias("cost"),
        F.count_if(F.col("status") == "accepted").alias("accepted"),
        F.count_if(F.col("status") == "rolled_back").alias("rolled_back"),
        F.round(F.coalesce(F.avg("retention"), F.lit(0.0)), 4).alias("avg_retention"),
        F.coalesce(F.min("retention"), F.lit(0.0)).alias("worst_retention"),
    )


#: grains of run_grains: over all, by each key, and by run in detail
GRAINS = ((), ("run_id",), ("agent",), ("mode",), ("agent", "status"), ("agent", "mode"), ("run_id", "agent"))

#: what a call may say beside its tokens, cost, status and retention; a run without such a column counts 0
_FACTS = {"risk": "string", "valid": "boolean", "repaired": "boolean", "retried": "boolean", "retry_ok": "boolean", "consistent": "boolean", "consistency": "double", "saved": "long", "savings": "double", "retry_tokens": "long", "retry_cost": "double", "sleep": "double"}


def run_totals(calls: DataFrame) -> DataFrame:
    """The whole report of each run: run_report()'s figures and the conditional counts of its calls' further facts.

    calls: (run_id, tokens, cost, status, retention) and any of _FACTS. A null flag counts as not set, a call without
    valid as invalid where the column exists; averages are 0 for a run without any value.
    """
    have = set(calls.columns)
    c = calls.withColumns({k: F.lit(None).cast(t) for k, t in _FACTS.items() if k not in have})
    unset = lambda k: F.count_if(~F.coalesce(F.col(k), F.lit(False))) if k in have else F.lit(0).cast("long")
    total = lambda k: F.coalesce(F.sum(k), F.lit(0))
    return c.groupBy("run_id").agg(
        F.count("*").alias("calls"),
        (F.sum("tokens") + total("retry_tokens")).cast("double").alias("tokens"),
        F.round(F.sum("cost") + total("retry_cost"), 8).alias("cost"),
        F.round(total("savings"), 8).alias("savings"),
        total("saved").cast("long").alias("tokens_saved"),
        F.round(F.coalesce(F.avg("retention"), F.lit(0.0)), 4).alias("avg_retention"),
        F.coalesce(F.min("retention"), F.lit(0.0)).alias("worst_retention"),
        *[F.count_if(F.col("status") == x).alias(x) for x in ("accepted", "rolled_back")],
        F.count_if(F.col("risk") == "HIGH").alias("high_risk"),
        F.count_if("valid").alias("schema_valid"),
        F.count_if("repaired").alias("schema_repaired"),
        unset("valid").alias("schema_invalid"),
        F.count_if("retried").alias("retries"),
        F.count_if("retry_ok").alias("retry_successes"),
        unset("consistent").alias("inconsistent"),
        F.round(F.coalesce(F.avg("consistency"), F.lit(0.0)), 4).alias("avg_consistency"),
        F.round(total("sleep"), 3).cast("double").alias("sleep_seconds"),
    )


def run_grains(calls: DataFrame, keys: Sequence[str] = ("run_id", "agent", "mode", "status"), grains: Sequence[Sequence[str]] = GRAINS) -> DataFrame:
    """Reports of calls at several grains in one pass over them: one row for each group of each grain.

    calls: the keys, tokens, cost, retention, saved. grain names the keys a row is grouped by, joined by +, or says all;
    its other keys are null there, while a null key of its own is a group like any other. Rates are ratios of sums
    (accepted_pct of calls, saved_pct of tokens before saving, cost_per_1k of tokens), so they hold at each grain where
    means of means would not; avg_retention goes by the calls that have one, and is 0 where none has. A ratio over
    nothing is 0. An empty table gives no row.
    """
    whole = lambda c: F.coalesce(F.sum(c), F.lit(0))
    ratio = lambda a, b, d: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), d).cast("double")
    used = F.array_compact(F.array(*[F.when(F.grouping(k) == 0, F.lit(k)) for k in keys]))
    # a key's values are hidden from aggregates in grains without it, so status is counted by a copy
    out = calls.withColumn("status_", F.col("status")).groupingSets([[F.col(k) for k in g] for g in grains], *keys).agg(
        F.when(F.size(used) == 0, "all").otherwise(F.array_join(used, "+")).alias("grain"),
        F.count("*").alias("calls"),
        whole("tokens").cast("long").alias("tokens"),
        F.round(whole("cost"), 8).cast("double").alias("cost"),
        ratio(F.count_if(F.col("status_") == "accepted") * 100.0, F.count("*"), 4).alias("accepted_pct"),
        ratio(whole("saved") * 100.0, whole("tokens") + whole("saved"), 4).alias("saved_pct"),
        ratio(whole("cost") * 1000.0, whole("tokens"), 8).alias("cost_per_1k"),
        ratio(whole("retention"), F.count("retention"), 4).alias("avg_retention"),
        F.coalesce(F.min("retention"), F.lit(0.0)).cast("double").alias("worst_retention"),
    )
    return out.select("grain", *keys, *[c for c in out.columns if c not in keys and c != "grain"])


def ab_totals(rows: DataFrame, by: str) -> DataFrame:
    out = rows.groupBy(by).agg(F.sum("baseline").cast("long").alias("baseline"), F.sum("optimized").cast("long").alias("optimized"))
    return out.withColumn("reduction_pct", F.round(F.coalesce(F.try_divide((F.col("baseline") - F.col("optimized")) * 100.0, F.col("baseline")), F.lit(0.0)), 4))


def severity_counts(rows: DataFrame, severity: str = "severity") -> DataFrame:
    """Histogram of repair severities; all four are always there."""
    names = ("none", "minor", "major", "fallback")
    counted = rows.agg(*[F.count_if(F.col(severity) == n).alias(n) for n in names])
    return counted.select(F.inline(F.array(*[F.struct(F.lit(n).alias("severity"), F.col(n).alias("n")) for n in names])))
