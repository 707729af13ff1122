"""Functions of the user over channels: per sample, or over a whole channel, and filters that are recurrences.

A function has defaults for all arguments and ``t`` last. Per-sample functions run in Arrow batches of aligned
rows; a failing sample gives NaN. Whole-channel functions and filters need all samples of a channel in order, so a
channel is one task for them by their nature; everything around them is not.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.align import interpolate, union_timebase
from ..operators.resample import raster, spans
from .filters import sections


def check_function(function: Callable) -> list[str]:
    """Argument names; an error if one has no default or ``t`` isn't last."""
    parameters = list(inspect.signature(function).parameters.values())
    if not parameters or parameters[-1].name != "t" or any(p.default is inspect.Parameter.empty for p in parameters):
        raise ValueError("all arguments need defaults, and the last one must be t")
    return [p.name for p in parameters]


def argument(names: list[str], available: set[str]) -> str | float | None:
    """The first of the alternatives that is a channel, or that is a number (decimal, 0x, 0b) — None for "none"."""
    for name in names:
        if name in available:
            return name
        if name.lower() == "none":
            return None
        for read in (lambda s: int(s, 0), float):
            try:
                return read(name)
            except ValueError:
                pass
    raise ValueError(f"none of {names} is a channel or a number")


def aligned(channels: dict[str, DataFrame], keys: list[str], trigger: str | None = None, stamps: DataFrame | None = None, step: float | None = None, bucket: float | None = None) -> DataFrame:
    """(keys, t, a column per channel): on all stamps, on those of a ``trigger`` channel, every ``step`` over the channels' spans, or on given ``stamps(keys, t)``."""
    if step is not None:
        every = reduce(DataFrame.unionByName, [f.select(*keys, "t") for f in channels.values()])
        stamps = raster(spans(every, keys), keys, step)
        channels = {n: f.withColumn("t", F.col("t").cast("double")) for n, f in channels.items()}
    base = stamps if stamps is not None else union_timebase(channels[trigger], keys=keys) if trigger else union_timebase(*channels.values(), keys=keys)
    return reduce(lambda out, item: interpolate(item[1], out, keys, "f", bucket=bucket).withColumnRenamed("v", item[0]), channels.items(), base)


def per_sample(frame: DataFrame, function: Callable, out: str = "v") -> DataFrame:
    """``frame`` (aligned columns and t) with the function's value for each row; NaN where it fails."""
    names = check_function(function)
    used = [n for n in names if n in frame.columns]

    @F.pandas_udf("double")
    def run(*columns: pd.Series) -> pd.Series:
        def one(*values):
            try:
                return float(function(**dict(zip(used, values))))
            except Exception:
                return float("nan")

        return pd.Series([one(*row) for row in zip(*columns)], dtype="float64")

    return frame.withColumn(out, run(*[F.col(n).cast("double") for n in used]))


def per_channel(frame: DataFrame, keys: list[str], function: Callable, out: str = "v") -> DataFrame:
    """(keys, t, out): the function on whole arrays, in order of t; a shorter result stands at the last stamps."""
    names = check_function(function)
    used = [n for n in names if n in frame.columns]
    kinds = {f.name: f.dataType.simpleString() for f in frame.schema.fields}

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("t", kind="stable")
        values = np.asarray(function(**{n: part[n].to_numpy() for n in used}), float)
        part = part.iloc[len(part) - len(values) :]
        return pd.DataFrame({**{k: part[k] for k in keys}, "t": part["t"], out: values})

    return frame.groupBy(*keys).applyInPandas(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), f"t {kinds['t']}", f"{out} double"]))


def clipped(samples: DataFrame, lower: float = 0.0, upper: float = 100.0) -> DataFrame:
    return samples.withColumn("v", F.greatest(F.least("v", F.lit(upper)), F.lit(lower)))


def shifted(samples: DataFrame, delta: float | Column) -> DataFrame:
    """Samples moved in time."""
    return samples.withColumn("t", F.col("t") + delta)


def run_sections(sections: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The filter's recurrence, section by section."""
    y = np.asarray(x, float)
    for b0, b1, b2, _, a1, a2 in sections:
        out, s1, s2 = np.empty_like(y), 0.0, 0.0
        for i, v in enumerate(y.tolist()):
            w = b0 * v + s1
            s1, s2 = b1 * v - a1 * w + s2, b2 * v - a2 * w
            out[i] = w
        y = out
    return y


def filtered(samples: DataFrame, keys: list[str], kind: str, cut: float | tuple[float, float], order: int = 3, rate: float | None = None, per_second: float = 1_000_000, family: str = "butterworth", ripple: float = 1.0, attenuation: float = 40.0) -> DataFrame:
    """Channels through a filter of a family of :mod:`.filters`; the rate is one over the median interval unless given."""

    def smooth(v=0, t=0):
        each = rate or per_second / float(np.median(np.diff(t))) if len(t) > 1 else 1.0
        return run_sections(sections(order, cut, kind, each, family, ripple, attenuation), v) if len(t) > 1 else np.asarray(v, float)

    return per_channel(samples, keys, smooth)
