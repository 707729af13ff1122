"""Rasters and resampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import Options
from .align import every_stamp, interpolate


def raster(spans: DataFrame, keys: list[str], step: float, endpoint: bool = False, chunk: int = 10_000) -> DataFrame:
    """(keys, t): stamps of a raster over each row's ``lo`` to ``hi``.

    A whole number of steps gives evenly spaced stamps with both ends; otherwise stamps are lo + i * step below hi, and
    ``hi`` itself if ``endpoint``. Stamps are made in chunks, so one long span is many rows early on."""
    if step <= 0:
        raise ValueError("the raster must be greater than zero")
    lo, hi = F.col("lo").cast("double"), F.col("hi").cast("double")
    steps = (hi - lo) / step
    even = steps == F.rint(steps)
    n = F.ceil(steps).cast("long")
    count = F.when(even, F.rint(steps).cast("long") + 1).otherwise(F.greatest(n, F.lit(1).cast("long")))
    rows = spans.select(*keys, lo.alias("lo"), hi.alias("hi"), even.alias("_even"), count.alias("_n"))
    rows = rows.withColumn("_c", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / chunk))))
    rows = rows.repartition(*keys, "_c").withColumn("_i", F.explode(F.sequence(F.col("_c") * chunk, F.least(F.col("_n") - 1, F.col("_c") * chunk + chunk - 1))))
    delta = (F.col("lo") + step) - F.col("lo")
    inner = F.col("lo") + F.col("_i") * F.when(F.col("_even"), F.try_divide(F.col("hi") - F.col("lo"), F.col("_n") - 1)).otherwise(delta)
    t = F.when(F.col("_even") & (F.col("_i") == F.col("_n") - 1), F.col("hi")).otherwise(F.coalesce(inner, F.col("lo")))
    out = rows.select(*keys, t.alias("t"))
    return out.unionByName(rows.where("NOT _even AND _i = 0").select(*keys, F.col("hi").alias("t"))) if endpoint else out


def raster_of_ratio(spans: DataFrame, keys: list[str], step: float) -> DataFrame:
    """(keys, t): the older raster of a single channel. A span that is a whole number of steps, by a ratio of single precision, gives
    that many evenly spaced stamps with both ends, one fewer than :func:`raster`; otherwise lo + i * step below hi."""
    lo, hi = F.col("lo").cast("double"), F.col("hi").cast("double")
    ratio = ((hi - lo) / step).cast("float")
    even = ratio == F.floor(ratio)
    n = F.when(even, ratio.cast("long")).otherwise(F.ceil((hi - lo) / step).cast("long"))
    i = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(n - 1, F.lit(0))))
    rows = spans.where(n > 0).select(*keys, lo.alias("lo"), hi.alias("hi"), even.alias("_even"), n.alias("_n"), i.alias("_i"))
    each = F.when(F.col("_even"), F.coalesce(F.try_divide(F.col("hi") - F.col("lo"), F.col("_n") - 1), F.lit(0.0))).otherwise(F.lit(step))
    return rows.select(*keys, F.when(F.col("_even") & (F.col("_i") == F.col("_n") - 1) & (F.col("_n") > 1), F.col("hi")).otherwise(F.col("lo") + F.col("_i") * each).alias("t"))


def spans(samples: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, lo, hi): each channel's first and last stamp."""
    return samples.groupBy(*keys).agg(F.min("t").alias("lo"), F.max("t").alias("hi"))


def resample(samples: DataFrame, keys: list[str], step: float | None = None, stamps: DataFrame | None = None, kind: str = "f", zero: bool = False, options: Options = Options(), bucket: float | None = None) -> DataFrame:
    """(keys, t, v) on a raster of ``step`` over the common span of all channels, or on ``stamps(t)``."""
    channels = samples.select(*keys).distinct()
    first = None
    if stamps is None:
        lo, hi = samples.agg(F.min("t"), F.max("t")).first()
        probes, first = raster(channels.withColumns({"lo": F.lit(lo).cast("double"), "hi": F.lit(hi).cast("double")}), keys, step), lo
    else:
        probes = every_stamp(channels, stamps.select("t").distinct(), [])
        first = stamps.agg(F.min("t")).first()[0] if zero else None
    out = interpolate(samples.withColumn("t", F.col("t").cast("double")), probes, keys, kind, options=options, bucket=bucket)
    return out.withColumn("t", F.col("t") - F.lit(first)) if zero else out


def step_count(lo: Column, hi: Column, step: float) -> Column:
    """Stamps that a raster has."""
    return F.floor((hi - lo) / step).cast("long") + 1
