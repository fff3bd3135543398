"""Rolling 60-second windows over a stream with managed state: the streaming twin of `pacing.rolling`."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from lexforge.streaming.pacing import SPAN_US

#: timers stand at whole seconds, so that a tenant has one a second at most
_TICK_MS = 1000


class _Windows(StatefulProcessor):
    """Holds a tenant's events until the watermark is past them, then says what stood in the 60 s up to each."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "us long, event string, tokens long, told boolean")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        known = set(self.handle.listTimers())
        for pdf in rows:
            self.held.appendList([(int(u), e, int(n), False) for u, e, n in zip(pdf.us, pdf.event, pdf.tokens, strict=True)])
            # a timer is later than each event of its second: none of them can be joined by another once it fires
            for due in {(int(u) // 1000 // _TICK_MS + 1) * _TICK_MS for u in pdf.us} - known:
                self.handle.registerTimer(due)
                known.add(due)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = expiredTimerInfo.getExpiryTimeInMs() * 1000
        held = sorted(self.held.get(), key=lambda e: e[0])
        out, stay, first, end, tokens = [], [], 0, 0, 0
        for us, event, _, told in held:
            if us >= until:
                break
            while end < len(held) and held[end][0] <= us:  # events of the same time are in each other's window
                tokens, end = tokens + held[end][2], end + 1
            while held[first][0] <= us - SPAN_US:
                tokens, first = tokens - held[first][2], first + 1
            if not told:
                out.append((event, tokens, end - first))
        for us, event, n, told in held:
            if us > until - SPAN_US:  # the rest can be in no later event's window
                stay.append((us, event, n, told or us < until))
        if stay:
            self.held.put(stay)
        else:
            self.held.clear()
        if out:
            yield pd.DataFrame(out, columns=["event", "tokens_60s", "requests_60s"])

    def close(self) -> None:
        pass


def rolling_stream(events: DataFrame, tenant: str, ts: str, tokens: str, tie: str, late: str = "10 minutes") -> DataFrame:
    """(tenant, event_id, tokens_60s, requests_60s) of a stream's events: what `pacing.rolling` says of them in a batch.

    A row comes once the watermark, late behind the newest event, is past its time, so that events out of order count
    where they belong; those behind the watermark are dropped. An event of exactly 60 s ago has left; a null count of
    tokens is 0, a row without a time is dropped, a null tenant is a tenant. State is a list of a tenant's events of
    the last 60 s and of those that wait; an event-time timer for each second that has one tells and drops them. It is
    restored from the checkpoint after a loss. The session's state store is to be RocksDB's, as managed state demands.
    """
    src = events.select(F.col(tenant).alias("tenant"), F.col(ts).cast("timestamp").alias("ts"), F.col(tie).cast("long").alias("event_id"), F.coalesce(F.col(tokens), F.lit(0)).cast("long").alias("tokens"))
    src = src.where("ts is not null").withWatermark("ts", late)
    # tenants and events go through Python as JSON text, never null: a null tenant's rows made those of the next one null
    kind = f"tenant {src.schema['tenant'].dataType.simpleString()}, event_id long"
    src = src.select("ts", F.to_json(F.struct("tenant")).alias("key"), F.to_json(F.struct("tenant", "event_id")).alias("event"), F.unix_micros("ts").alias("us"), "tokens")
    out = src.groupBy("key").transformWithStateInPandas(_Windows(), "event string, tokens_60s long, requests_60s long", "append", "eventTime")
    return out.select(F.from_json("event", kind).alias("e"), "tokens_60s", "requests_60s").select("e.*", "tokens_60s", "requests_60s")
