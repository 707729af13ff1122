"""Statistics of channels, plot reduction, spectra."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .align import bucket_width
from .cut import cut


def _finite(v: Column) -> Column:
    return ~F.isnan(v) & (F.abs(v) != float("inf"))


def with_previous(samples: DataFrame, keys: list[str], columns: list[str] = ["t", "v"], bucket: float | None = None) -> DataFrame:
    """``samples`` with ``prev``, a struct of ``columns`` of the sample before, found by time buckets. Without ``bucket`` their width is chosen by :func:`~.align.bucket_width`,
    here and in what follows, which starts a job."""
    bucket = bucket or bucket_width(samples, keys)
    by = samples.withColumns({"_b": F.floor(F.col("t") / bucket), "_s": F.struct(*columns)})
    order = F.struct("t", "ord")
    edges = by.groupBy(*keys, "_b").agg(F.max_by("_s", order).alias("_l"))
    edges = edges.select(*keys, "_b", F.lag("_l").over(Window.partitionBy(*keys).orderBy("_b")).alias("_l"))
    w = Window.partitionBy(*keys, "_b").orderBy("t", "ord")
    return by.withColumn("_p", F.lag("_s").over(w)).join(edges, [*keys, "_b"]).withColumn("prev", F.coalesce("_p", "_l")).drop("_p", "_l", "_s", "_b")


def summary(samples: DataFrame, keys: list[str], bucket: float | None = None, per_second: float = 1_000_000) -> DataFrame:
    """Over finite samples: n, min, max, mean, rms, std (population), first and last value, delta, span, gradient, integral (trapezoids).

    ``per_second``: units of t in a second. A single sample has integral, delta, span and gradient 0."""
    fine = samples.where(_finite(F.col("v")))
    area = (F.col("t") - F.col("prev.t")) / per_second * (F.col("v") + F.col("prev.v")) / 2
    order = F.struct("t", "ord")
    out = with_previous(fine, keys, bucket=bucket).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min("v").alias("min"), F.max("v").alias("max"), F.avg("v").alias("mean"), F.sqrt(F.avg(F.col("v") * F.col("v"))).alias("rms"), F.stddev_pop("v").alias("std"),
        F.min_by("v", order).alias("first"), F.max_by("v", order).alias("last"), ((F.max("t") - F.min("t")) / per_second).alias("span"), F.coalesce(F.sum(area), F.lit(0.0)).alias("integral"),
    )
    return out.withColumn("delta", F.col("last") - F.col("first")).withColumn("gradient", F.coalesce(F.try_divide("delta", "span"), F.lit(0.0)))


def region_summary(samples: DataFrame, keys: list[str], start: float, stop: float, bucket: float | None = None) -> DataFrame:
    """:func:`summary` of the part from start to stop, with interpolated ends."""
    part = cut(samples, keys, start, stop).withColumn("ord", F.lit(0).cast("long"))
    return summary(part, keys, bucket)


def shared_range(stats: DataFrame, axis: str) -> DataFrame:
    """Least min and greatest max of each set of channels; (0, 1) for sets without samples."""
    return stats.groupBy(axis).agg(F.coalesce(F.min("min"), F.lit(0.0)).alias("low"), F.coalesce(F.max("max"), F.lit(1.0)).alias("high"))


def interval_median(samples: DataFrame, keys: list[str], bucket: float | None = None) -> DataFrame:
    """Median of the intervals between stamps."""
    d = with_previous(samples, keys, ["t"], bucket).where("prev IS NOT NULL").select(*keys, (F.col("t") - F.col("prev.t")).alias("d"))
    return d.groupBy(*keys).agg(F.percentile("d", F.lit(0.5)).alias("median_interval"))


def reduce_for_plot(samples: DataFrame, keys: list[str], rows_per_pixel: int) -> DataFrame:
    """Of each run of ``rows_per_pixel`` samples by ``ordinal`` (0, 1, … within a channel) the least and the greatest, in time order."""
    part = samples.withColumn("pixel", F.floor(F.col("ordinal") / rows_per_pixel))
    s = F.struct("ordinal", "t", "v")
    ends = part.groupBy(*keys, "pixel").agg(F.min_by(s, F.struct("v", "ordinal")).alias("_a"), F.max_by(s, F.struct(F.col("v"), -F.col("ordinal"))).alias("_b"))
    return ends.select(*keys, "pixel", F.explode(F.array_distinct(F.array("_a", "_b"))).alias("_s")).select(*keys, "pixel", "_s.ordinal", "_s.t", "_s.v")


def numbered(samples: DataFrame, keys: list[str], bucket: float | None = None) -> DataFrame:
    """``ordinal``: 0, 1, … within a channel by (t, ord), from a row number per time bucket and the counts of the buckets before."""
    bucket = bucket or bucket_width(samples, keys)
    by = samples.withColumn("_b", F.floor(F.col("t") / bucket))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = by.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n")).select(*keys, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    w = Window.partitionBy(*keys, "_b").orderBy("t", "ord")
    return by.withColumn("_r", F.row_number().over(w) - 1).join(counts, [*keys, "_b"]).withColumn("ordinal", F.col("_base") + F.col("_r")).drop("_b", "_r", "_base")


def periodogram(samples: DataFrame, keys: list[str], low: float, high: float, steps: int) -> DataFrame:
    """Normalised Lomb-Scargle power of mean-free values at ``steps`` frequencies (t in seconds), from grouped sums."""
    freqs = F.array(*[F.lit(low + i * (high - low) / max(steps - 1, 1)) for i in range(steps)])
    mean = samples.groupBy(*keys).agg(F.avg("v").alias("_m"))
    x = samples.join(mean, keys).withColumn("v", F.col("v") - F.col("_m")).select(*keys, "t", "v", F.explode(freqs).alias("frequency"))
    w = 2 * math.pi * F.col("frequency") * F.col("t")
    c, s = F.cos(w), F.sin(w)
    sums = x.groupBy(*keys, "frequency").agg(F.sum(F.col("v") * c).alias("vc"), F.sum(F.col("v") * s).alias("vs"), F.sum(c * c).alias("cc"), F.sum(s * s).alias("ss"), F.sum(c * s).alias("cs"), F.sum(F.col("v") * F.col("v")).alias("vv"))
    tau = F.atan2(2 * F.col("cs"), F.col("cc") - F.col("ss")) / 2
    ct, st = F.cos(tau), F.sin(tau)
    cc = ct * ct * F.col("cc") + 2 * ct * st * F.col("cs") + st * st * F.col("ss")
    ss = ct * ct * F.col("ss") - 2 * ct * st * F.col("cs") + st * st * F.col("cc")
    vc, vs = ct * F.col("vc") + st * F.col("vs"), ct * F.col("vs") - st * F.col("vc")
    power = (F.coalesce(F.try_divide(vc * vc, cc), F.lit(0.0)) + F.coalesce(F.try_divide(vs * vs, ss), F.lit(0.0))) / F.col("vv")
    return sums.select(*keys, "frequency", power.alias("power"))


def downcast_type(low: float, high: float, floating: bool) -> str:
    """The smallest type that holds low to high, by strict bounds: floats become float."""
    if floating:
        return "float"
    bounds = [("smallint", 255), ("int", 65535), ("bigint", 4294967295)] if low >= 0 else [("tinyint", 127), ("smallint", 32767), ("int", 2147483647)]
    return next((t for t, b in bounds if high < b and (low >= 0 or low > -b)), "decimal(20,0)" if low >= 0 else "bigint")
