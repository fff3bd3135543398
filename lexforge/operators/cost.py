"""Costs, success scores, risk labels and run reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexforge.functions.lexicons import INPUT_PRICE, MODES, OUTPUT_PRICE


def price(tokens_in: Column, tokens_out: Column, per_in: float = INPUT_PRICE, per_out: float = OUTPUT_PRICE) -> Column:
    """US dollars; prices are per million tokens."""
    return tokens_in / 1e6 * per_in + tokens_out / 1e6 * per_out


def cost_columns(before: Column, after: Column, out: Column) -> dict[str, Column]:
    a, b = price(before, out), price(after, out)
    saved = F.greatest(F.lit(0.0), a - b)
    fewer = F.greatest(F.lit(0), before - after)
    return {
        "cost_before": a,
        "cost_after": b,
        "savings": saved,
        "cost_reduction": F.when(a > 0, saved / a).otherwise(0.0),
        "tokens_saved": fewer.cast("long"),
        "reduction_pct": F.when(before > 0, fewer / before * 100.0).otherwise(0.0),
    }


def success(retention: Column, cost: Column, latency: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.60 * retention + 0.30 * cost + 0.10 * latency))


def risk_label(status: Column, strict: Column, retention: Column, constraint: Column, numeric: Column, entity: Column, reduction: Column) -> Column:
    low = (retention >= 0.94) & (constraint >= 0.88) & (numeric >= 0.98) & (entity >= 0.90) & (reduction <= 30)
    medium = (retention >= 0.88) & (constraint >= 0.72) & (numeric >= 0.92) & (entity >= 0.80)
    out = F.when(status == "rolled_back", "ROLLED_BACK").when(strict & ((retention < 0.90) | (reduction > 28)), "HIGH")
    return out.when(low, "LOW").when(medium, "MEDIUM").otherwise("HIGH")


def resolved_mode(mode: Column, strict: Column) -> Column:
    """Struct (mode, min_retention, duplicate, relevance): thresholds of a mode, tightened where the schema is strict."""
    m = F.lower(F.trim(mode))
    pick = lambda i: F.when(m == "conservative", MODES["conservative"][i]).when(m == "aggressive", MODES["aggressive"][i]).otherwise(MODES["balanced"][i])
    down = strict & (m == "aggressive")
    return F.struct(
        F.when(down, "balanced").otherwise(m).alias("mode"),
        F.when(strict, F.greatest(pick(0), F.lit(0.88))).otherwise(pick(0)).alias("min_retention"),
        F.when(down, F.greatest(pick(1), F.lit(0.90))).otherwise(pick(1)).alias("duplicate"),
        F.when(down, F.least(pick(2), F.lit(0.15))).otherwise(pick(2)).alias("relevance"),
    )
