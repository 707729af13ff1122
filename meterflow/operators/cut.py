"""Cutting in time, and rows that are dropped for their stamps or validity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .align import linear_value, previous_value


def cut(samples: DataFrame, keys: list[str], start: float, stop: float, ends: bool = True, linear: bool = True) -> DataFrame:
    """(keys, t, v) with start <= t <= stop. With ``ends``, a bound strictly inside a channel's span at which there is no
    sample gets an interpolated one. Channels that don't reach into the span give no rows.

    The samples on either side of a bound are aggregates of a channel, pre-aggregated where the samples lie."""
    inside = samples.where(F.col("t").between(start, stop)).select(*keys, "t", "v")
    if not ends:
        return inside
    order, sample = F.struct("t", "ord"), F.struct("t", "v")
    at = sorted({start, stop})
    near = [f(sample, F.when(F.col("t") <= b if n == "b" else F.col("t") > b, order)).alias(f"{n}{i}") for i, b in enumerate(at) for f, n in ((F.max_by, "b"), (F.min_by, "a"))]
    bounds = [F.struct(F.lit(b).cast(samples.schema["t"].dataType).alias("t"), F.col(f"b{i}").alias("before"), F.col(f"a{i}").alias("after")) for i, b in enumerate(at)]
    found = samples.groupBy(*keys).agg(*near).select(*keys, F.inline(F.array(*bounds))).where("after IS NOT NULL AND before.t <> t")
    return inside.unionByName(found.select(*keys, "t", (linear_value() if linear else previous_value()).alias("v")))


def cut_group(samples: DataFrame, keys: list[str], start: float, stop: float, from_first: bool = False, zero: bool = False, **how) -> DataFrame:
    """:func:`cut` of a whole measurement: bounds count from its earliest stamp if ``from_first`` (one job finds it), stamps from ``start`` if ``zero``."""
    base = samples.agg(F.min("t")).first()[0] if from_first else 0
    out = cut(samples, keys, start + base, stop + base, **how)
    return out.withColumn("t", F.col("t") - F.lit(start + base)) if zero else out


def keep_valid(samples: DataFrame) -> DataFrame:
    """Samples that aren't flagged invalid."""
    return samples.where(~F.coalesce("invalid", F.lit(False)))


def plausible(t: Column, minimum: float, maximum: float, least_power: int = -15, most_power: int = 15, strict: bool = True) -> Column:
    """Stamps within bounds, finite, and zero or of a decimal power within bounds. Not ``strict``: bounds hold for zero alone."""
    finite = ~F.isnan(t) & (F.abs(t) != float("inf"))
    power = F.when(t > 0, F.log10(t)).between(least_power, most_power)
    bounds = (t >= minimum) & (t <= maximum) & finite
    return F.coalesce(bounds & ((t == 0) | power) if strict else (bounds & (t == 0)) | power, F.lit(False))


def _bucketed_lag(samples: DataFrame, keys: list[str], bucket: float) -> DataFrame:
    """``samples`` with ``_prev``, the stamp of the sample before in order of ``ord`` — by buckets of ``ord``."""
    by = samples.withColumn("_b", F.floor(F.col("ord") / bucket))
    w = Window.partitionBy(*keys, "_b").orderBy("ord")
    edges = by.groupBy(*keys, "_b").agg(F.max_by("t", "ord").alias("_last"))
    e = Window.partitionBy(*keys).orderBy("_b")
    edges = edges.select(*keys, "_b", F.lag("_last").over(e).alias("_last"))
    return by.withColumn("_in", F.lag("t").over(w)).join(edges, [*keys, "_b"]).withColumn("_prev", F.coalesce("_in", "_last")).drop("_in", "_last", "_b")


def increasing(samples: DataFrame, keys: list[str], bucket: float = 1_000_000) -> DataFrame:
    """Samples whose stamp is greater than that of the sample recorded before (by ``ord``)."""
    return _bucketed_lag(samples, keys, bucket).where("_prev IS NULL OR t > _prev").drop("_prev")


def not_increasing(samples: DataFrame, keys: list[str], most: int = 10, bucket: float = 1_000_000) -> DataFrame:
    """The first ``most`` samples of each channel whose stamp doesn't exceed that of the sample before, with both stamps."""
    bad = _bucketed_lag(samples, keys, bucket).where("t <= _prev")
    # the first few of each bucket, then of each channel: no channel is sorted whole
    part = Window.partitionBy(*keys, F.floor(F.col("ord") / bucket)).orderBy("ord")
    few = bad.withColumn("_r", F.row_number().over(part)).where(F.col("_r") <= most)
    rank = Window.partitionBy(*keys).orderBy("ord")
    return few.withColumn("n", F.row_number().over(rank)).where(F.col("n") <= most).select(*keys, "n", "ord", F.col("_prev").alias("before"), "t")
