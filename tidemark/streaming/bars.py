"""The tick-to-bar path as a stream: late ticks are bounded by a watermark, and recursive means keep state per instrument."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_bars(ticks: DataFrame, width: str = "1 hour", late: str = "10 minutes", key="event_type", price="value", event="event_id") -> DataFrame:
    """Bars of a tick stream, given out once the watermark passes them. Ticks are taken once by event and time."""
    once = ticks.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark([event])
    at = F.struct("ts", event)
    bars = once.groupBy(F.window("ts", width), F.col(key).alias("ticker")).agg(
        F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"), F.count("*").cast("double").alias("volume")
    )
    return bars.select("ticker", F.col("window.start").alias("ts"), "open", "high", "low", "close", "volume")


def stream_ema(ticks: DataFrame, n: int, key="event_type", price="value", event="event_id") -> DataFrame:
    """(ticker, event_id, ema) of each tick. Ticks of a trigger are taken in order of event; the mean is state between triggers."""
    rate = 2 / (n + 1)

    def step(k, frames, state):
        now = state.get[0] if state.exists else None
        frame = pd.concat(list(frames)).sort_values(event)
        out = []
        for v in frame[price].astype(float):
            now = v if now is None else now + rate * (v - now)
            out.append(now)
        state.update((now,))
        yield pd.DataFrame({"ticker": k[0], "event_id": frame[event].to_numpy(), "ema": out})

    return ticks.groupBy(key).applyInPandasWithState(step, "ticker string, event_id bigint, ema double", "ema double", "append", "NoTimeout")
