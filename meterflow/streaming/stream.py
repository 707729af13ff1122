"""Structured Streaming over samples: windows with watermarks, repeated values, reassembly."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed(samples: DataFrame, keys: list[str], length: str, slide: str | None = None, late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Count, mean, least and greatest value of each channel in event-time windows; rows later than ``late`` are left out."""
    w = F.window(ts, length, slide) if slide else F.window(ts, length)
    out = samples.withWatermark(ts, late).groupBy(*keys, w).agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), F.min("v").alias("low"), F.max("v").alias("high"))
    return out.select(*keys, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", "mean", "low", "high")


def sessions(samples: DataFrame, keys: list[str], gap: str, late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Runs of samples with no pause longer than ``gap``."""
    out = samples.withWatermark(ts, late).groupBy(*keys, F.session_window(ts, gap)).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    return out.select(*keys, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n", "low", "high")


def changes(samples: DataFrame, key: str) -> DataFrame:
    """(key, t, v, before): samples whose value differs from the channel's last one; the state is that value.

    Within a micro-batch samples are taken in order of t; samples older than the last one seen are left out."""

    def run(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last_t, last_v = state.get if state.exists else (None, None)
        rows = pd.concat(list(parts)).sort_values("t", kind="stable")
        out = []
        for t, v in zip(rows["t"].tolist(), rows["v"].tolist()):
            if last_t is None or t >= last_t:
                if last_v is None or v != last_v:
                    out.append((k[0], t, v, last_v))
                last_t, last_v = t, v
        state.update((last_t, last_v))
        yield pd.DataFrame(out, columns=[key, "t", "v", "before"])

    kind = samples.schema[key].dataType.simpleString()
    return samples.select(key, "t", "v").groupBy(key).applyInPandasWithState(run, f"{key} {kind}, t long, v double, before double", "t long, v double", "append", GroupStateTimeout.NoTimeout)
