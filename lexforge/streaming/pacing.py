"""Pacing of request streams: rolling 60-second windows as SQL, the feedback pacer per tenant, and its streaming twin."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexforge.functions.kernels import Pacer

SPAN_US = 60_000_000


def rolling(events: DataFrame, tenant: str, ts: str, tokens: str, tie: str) -> DataFrame:
    """events with tokens_60s and requests_60s: those of the same tenant not yet 60 s old, the event itself included."""
    w = Window.partitionBy(tenant).orderBy("_us").rangeBetween(-(SPAN_US - 1), 0)
    e = events.withColumn("_us", F.unix_micros(F.col(ts).cast("timestamp")))
    return e.withColumns({"tokens_60s": F.sum(tokens).over(w).cast("long"), "requests_60s": F.count("*").over(w).cast("long")}).drop("_us")


def fixed_delay(events: DataFrame, run: str, order: str, seconds: float, delay: str = "delay") -> DataFrame:
    """events with delay: seconds after the run's start at which each call goes if every call waits a fixed time after the one before."""
    w = Window.partitionBy(run).orderBy(order)
    return events.withColumn(delay, (F.row_number().over(w) - 1) * F.lit(float(seconds)))


PACED = "tenant {}, event_id long, sleep double, went double, tokens_60s long, requests_60s long"


def pace(events: DataFrame, tenant: str, ts: str, tokens: str, tie: str, limits: tuple[int, int, float] = (9000, 20, 8.0)) -> DataFrame:
    """Virtual-time pacing of each tenant's events: what each has to wait, given what the earlier ones waited.

    An event arrives at its time or when the one before went, whichever is later. Tenants are independent; one
    tenant's events are a sequence by nature and go through one task in order.
    """
    src = events.select(F.col(tenant).alias("tenant"), F.col(tie).cast("long").alias("event_id"), (F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).alias("at"), F.col(tokens).cast("long").alias("tokens"))
    kind = src.schema["tenant"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["at", "event_id"])
        pacer, clock, rows = Pacer(*limits), float("-inf"), []
        for t, e, at, n in pdf.itertuples(index=False):
            sleep, clock, held, count = pacer.request(max(at, clock), n)
            rows.append((t, e, sleep, round(clock, 6), held, count))
        return pd.DataFrame(rows, columns=["tenant", "event_id", "sleep", "went", "tokens_60s", "requests_60s"])

    return src.groupBy("tenant").applyInPandas(run, PACED.format(kind))


def pace_stream(events: DataFrame, tenant: str, ts: str, tokens: str, tie: str, limits: tuple[int, int, float] = (9000, 20, 8.0), late: str = "10 minutes") -> DataFrame:
    """pace() over a stream: keyed state holds the events of the last 60 s; events behind the watermark are dropped.

    State is bounded: at most the events that went in the last 60 s, and it times out once the watermark is past them.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    src = events.withWatermark(ts, late).select(F.col(tenant).alias("tenant"), F.col(tie).cast("long").alias("event_id"), F.col(ts).alias("ts"), F.col(tokens).cast("long").alias("tokens"))
    kind = src.schema["tenant"].dataType.simpleString()

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times, sizes = state.get if state.exists else ([], [])
        pacer = Pacer(*limits, events=list(zip(times, sizes, strict=True)))
        clock = times[-1] if len(times) else float("-inf")
        pdf = pd.concat(list(batches), ignore_index=True).sort_values(["ts", "event_id"])
        rows = []
        for e, at, n in zip(pdf.event_id, pdf.ts, pdf.tokens, strict=True):
            sleep, clock, held, count = pacer.request(max(at.timestamp(), clock), n)
            rows.append((key[0], e, sleep, round(clock, 6), held, count))
        state.update(([x for x, _ in pacer.events], [int(n) for _, n in pacer.events]))
        state.setTimeoutTimestamp(max(int((clock + 60) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(rows, columns=["tenant", "event_id", "sleep", "went", "tokens_60s", "requests_60s"])

    return src.groupBy("tenant").applyInPandasWithState(run, PACED.format(kind), "times array<double>, sizes array<long>", "append", GroupStateTimeout.EventTimeTimeout)
