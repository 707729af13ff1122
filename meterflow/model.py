"""The tables of a measurement, and how the driver's tables are seen as one.

A measurement is a catalogue of channels and long samples: channel keys, ``t`` (a number: microseconds or
seconds), ``ord`` (the order of samples of equal t), a value ``v`` and, where there is one, ``invalid``.
Operators take and return such frames; none keeps state, and none starts a job unless it says so.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Microseconds of a day: the width of the time buckets that a channel's samples are dealt to.
DAY = 86_400_000_000


@dataclass(frozen=True)
class Options:
    """Choices that change results. Modes: 0 repeats the previous sample, 1 is linear, 2 is linear only for converted floats."""

    integer_mode: int = 0
    float_mode: int = 1
    first_of_several: bool = False
    zero_for_empty: bool = False


def event_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as samples: a channel for each event_type, t in microseconds, event_id as order."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    t = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    return events.select(F.col("event_type").alias("channel"), "user_id", F.col("event_id").alias("ord"), t.alias("t"), F.col("value").alias("v"))
