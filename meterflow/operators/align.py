"""Time alignment: as-of lookups, interpolation, unions of timebases, arithmetic between channels.

A channel may hold a third of all rows, so its samples are dealt to time buckets. Within a bucket neighbours come from a window;
what lies beyond its edge comes from a table of each bucket's first and last sample, which has a row per
channel and bucket. No channel is gathered in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..model import Options


def _sample(t: str = "t", v: str = "v") -> Column:
    return F.struct(F.col(t).alias("t"), F.col(v).alias("v"))


def bucket_width(samples: DataFrame, keys: list[str], rows: int = 1_000_000) -> float:
    """A width of time buckets by which the busiest one holds about ``rows`` samples. One job, two where there are more than ``rows``."""
    lo, hi, n = samples.agg(F.min("t").cast("double"), F.max("t").cast("double"), F.count("t")).first()
    if n <= rows or not hi > lo or hi == float("inf"):
        return max(hi - lo, 1.0) * 2 if n and abs(hi - lo) < float("inf") else 1.0
    cell = (hi - lo) / 4096
    most = samples.groupBy(*keys, F.floor(F.col("t") / cell).alias("_c")).count().agg(F.max("count")).first()[0]
    return cell * rows / most if most > rows else cell * (rows // most)


def both_ways(keys: list[str], *order: str) -> tuple[WindowSpec, WindowSpec]:
    """Windows over a bucket's rows up to the current one, and from the last row back to the one after it: the last value
    of either is the one before or after a row, and each is found in one pass."""
    part = Window.partitionBy(*keys, "_b")
    return part.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0), part.orderBy(*[F.col(c).desc() for c in order]).rowsBetween(Window.unboundedPreceding, -1)


def beyond(edges: DataFrame, keys: list[str], last: list[str], first: list[str]) -> DataFrame:
    """From a row per bucket: the last one of earlier buckets' ``last`` columns, the first one of later buckets' ``first`` columns."""
    w = Window.partitionBy(*keys)
    up = w.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    down = w.orderBy(F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    return edges.select(*keys, "_b", *[F.last(c, True).over(up).alias(c) for c in last], *[F.last(c, True).over(down).alias(c) for c in first])


def neighbours(samples: DataFrame, probes: DataFrame, keys: list[str], bucket: float | None = None) -> DataFrame:
    """``probes`` with ``before`` (the last sample at or before t) and ``after`` (the first one after t), structs (t, v) or null.

    Samples of equal t are taken in order of ``ord``; a probe stands after samples of its own t. ``bucket`` is the width of
    time buckets; without it :func:`bucket_width` chooses one from the samples, which starts a job."""
    bucket = bucket or bucket_width(samples, keys)
    extra = [c for c in probes.columns if c not in (*keys, "t")]
    own = F.struct(*extra) if extra else F.struct(F.lit(0).alias("_"))
    s = samples.select(*keys, "t", F.lit(0).alias("_k"), F.col("ord").cast("long").alias("_o"), _sample().alias("_s"), F.lit(None).cast(probes.select(own.alias("x")).schema["x"].dataType).alias("_x"))
    p = probes.select(*keys, "t", F.lit(1).alias("_k"), F.lit(0).cast("long").alias("_o"), F.lit(None).cast(s.schema["_s"].dataType).alias("_s"), own.alias("_x"))
    both = s.unionByName(p).withColumn("_b", F.floor(F.col("t") / bucket))
    up, down = both_ways(keys, "t", "_k", "_o")
    found = both.withColumns({"_p": F.last("_s", True).over(up), "_n": F.last("_s", True).over(down)}).where("_k = 1")
    # edges: a row for each bucket that holds samples or probes
    order = F.struct("t", "_o")
    edges = both.groupBy(*keys, "_b").agg(F.max_by("_s", F.when(F.col("_k") == 0, order)).alias("_l"), F.min_by("_s", F.when(F.col("_k") == 0, order)).alias("_f"))
    out = found.join(beyond(edges, keys, ["_l"], ["_f"]), [*keys, "_b"], "left")
    return out.select(*keys, "t", *[F.col("_x").getField(c).alias(c) for c in extra], F.coalesce("_p", "_l").alias("before"), F.coalesce("_n", "_f").alias("after"))


def previous_value(clamp: bool = True, before: str = "before", after: str = "after") -> Column:
    """Over :func:`neighbours`: the previous sample's value; before the first sample the first one's, or null."""
    return F.coalesce(f"{before}.v", f"{after}.v") if clamp else F.col(f"{before}.v")


def linear_value(before: str = "before", after: str = "after") -> Column:
    """Over :func:`neighbours`: linear between neighbours, the end's value outside."""
    t0, t1, v0, v1 = (F.col(c).cast("double") for c in (f"{before}.t", f"{after}.t", f"{before}.v", f"{after}.v"))
    slope = F.try_divide(v1 - v0, t1 - t0)
    return F.when(F.col(before).isNull(), v1).when(F.col(after).isNull() | (F.col(f"{before}.t") == F.col("t")), v0).otherwise(slope * (F.col("t").cast("double") - t0) + v0)


def nearest_value(part: str = "v") -> Column:
    """Over :func:`neighbours`: the nearer sample's value (or "t"); a tie goes to the later one."""
    left, right = F.col("t") - F.col("before.t"), F.col("after.t") - F.col("t")
    return F.when(F.col("after").isNull() | (left < right) | (F.col("before.t") == F.col("t")), F.col(f"before.{part}")).otherwise(F.col(f"after.{part}"))


def value_at_or_after(strict: bool = False) -> Column:
    """Over :func:`neighbours`: the first sample at or after t; beyond the last one null if ``strict``, else the last."""
    here = F.when(F.col("before.t") == F.col("t"), F.col("before.v"))
    return F.coalesce(here, "after.v") if strict else F.coalesce(here, "after.v", "before.v")


def _is_linear(kind: str, converts_to_float: bool, options: Options) -> bool:
    mode = options.float_mode if kind == "f" else options.integer_mode if kind in "iu" else 0
    return mode == 1 or (mode == 2 and converts_to_float)


def interpolate(samples: DataFrame, probes: DataFrame, keys: list[str], kind: str = "f", converts_to_float: bool = False, options: Options = Options(), bucket: float | None = None) -> DataFrame:
    """``probes`` with ``v`` by the rule of the channel's kind: "f" float, "i" or "u" integer, others repeat.

    Integers that were interpolated are cut towards zero, back to their type."""
    linear = _is_linear(kind, converts_to_float, options)
    value = linear_value() if linear else previous_value()
    if linear and kind in "iu":
        value = value.cast("long").cast(samples.schema["v"].dataType)
    return neighbours(samples, probes, keys, bucket).withColumn("v", value).drop("before", "after")


def union_timebase(*frames: DataFrame, keys: list[str] = (), digits: int | None = None) -> DataFrame:
    """Distinct stamps of all frames (by ``keys``), rounded to ``digits`` where given."""
    t = F.round("t", digits) if digits is not None else F.col("t")
    return reduce(DataFrame.unionByName, [f.select(*keys, t.alias("t")) for f in frames]).distinct()


def union_of_masters(samples: DataFrame, group: list[str], digits: int | None = None) -> DataFrame:
    """Stamps of all channels of all files. Channels of a group share their master, whose stamps count once before groups are united."""
    masters = samples.select(*group, "t").distinct()
    return union_timebase(masters, digits=digits)


def joined_channels(a: DataFrame, b: DataFrame, keys: list[str], digits: int = 9, bucket: float | None = None) -> DataFrame:
    """(keys, t, a, b): both channels, interpolated, on the union of their stamps rounded to ``digits``."""
    stamps = union_timebase(a, b, keys=keys, digits=digits)
    first = interpolate(a, stamps, keys, bucket=bucket).withColumnRenamed("v", "a")
    return interpolate(b, first, keys, bucket=bucket).withColumnRenamed("v", "b")


def every_stamp(channels: DataFrame, stamps: DataFrame, keys: list[str], parts: int = 64) -> DataFrame:
    """Each channel with each stamp of its keys. Without keys stamps are dealt to parts, each of which holds the channels once."""
    if keys:
        return channels.join(stamps, keys)
    dealt = stamps.withColumn("_part", F.pmod(F.xxhash64("t"), F.lit(parts)))
    return channels.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))).join(dealt, "_part").drop("_part")


def _whole(f):
    return lambda x, y: f(x.cast("long"), y.cast("long"))


def _numbers(x: Column, y: Column) -> Column:
    """NaN compares as unequal to everything, as in numpy; Spark's own order has it above all numbers."""
    return ~F.isnan(x) & ~F.isnan(y)


OPERATORS = {
    "add": lambda x, y: x + y,
    "sub": lambda x, y: x - y,
    "mul": lambda x, y: x * y,
    "div": lambda x, y: F.when(y != 0, x / y).when(y.isNotNull(), F.when(F.isnan(x) | (x == 0), F.lit(float("nan"))).otherwise(F.when(x > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf"))))),
    "floordiv": lambda x, y: F.floor(F.try_divide(x, y)).cast("double"),
    "mod": lambda x, y: x - y * F.floor(F.try_divide(x, y)),
    "pow": lambda x, y: F.pow(x, y),
    "and": _whole(lambda x, y: x.bitwiseAND(y)),
    "or": _whole(lambda x, y: x.bitwiseOR(y)),
    "xor": _whole(lambda x, y: x.bitwiseXOR(y)),
    "lshift": _whole(lambda x, y: F.call_function("shiftleft", x, y.cast("int"))),
    "rshift": _whole(lambda x, y: F.call_function("shiftright", x, y.cast("int"))),
    "lt": lambda x, y: (x < y) & _numbers(x, y),
    "le": lambda x, y: (x <= y) & _numbers(x, y),
    "gt": lambda x, y: (x > y) & _numbers(x, y),
    "ge": lambda x, y: (x >= y) & _numbers(x, y),
    "eq": lambda x, y: (x == y) & _numbers(x, y),
    "ne": lambda x, y: (x != y) | ~_numbers(x, y),
}
UNARY = {"neg": lambda x: -x, "abs": F.abs, "invert": lambda x: F.bitwise_not(x.cast("long")), "pos": lambda x: x}


def combine(a: DataFrame, b: DataFrame, keys: list[str], operator: str, kind: str = "f", bucket: float | None = None, options: Options = Options()) -> DataFrame:
    """(keys, t, v): both channels on the union of their stamps within their common span, then the operator.

    With a column ``invalid`` in either channel the result has one: a value is invalid if the sample in force of either channel is.
    Both channels are scanned and shuffled once, to time buckets; the common span is where both have samples on either side."""
    bucket = bucket or min(bucket_width(a, keys), bucket_width(b, keys))
    flags = "invalid" in a.columns or "invalid" in b.columns

    def side(f: DataFrame, mine: str, other: str) -> DataFrame:
        flag = [(F.coalesce("invalid", F.lit(False)) if "invalid" in f.columns else F.lit(False)).alias("i")] if flags else []
        x = f.select(*keys, "t", F.col("ord").cast("long").alias("_o"), F.struct("t", F.col("v").cast("double").alias("v"), *flag).alias(mine))
        return x.withColumn(other, F.lit(None).cast(x.schema[mine].dataType))

    both = side(a, "_x", "_y").unionByName(side(b, "_y", "_x")).withColumn("_b", F.floor(F.col("t") / bucket))
    by = lambda f, c: f(c, F.when(F.col(c).isNotNull(), F.col("_o")))
    stamps = both.repartition(*keys, "_b").groupBy(*keys, "_b", "t").agg(*[by(f, c).alias(c + n) for c in ("_x", "_y") for f, n in ((F.max_by, "l"), (F.min_by, "f"))])
    up, down = both_ways(keys, "t")
    near = stamps.withColumns({f"{c}p": F.last(f"{c}l", True).over(up) for c in ("_x", "_y")} | {f"{c}n": F.last(f"{c}f", True).over(down) for c in ("_x", "_y")})
    at = lambda c: F.when(F.col(c).isNotNull(), F.col("t"))
    edges = stamps.groupBy(*keys, "_b").agg(*[F.max_by(f"{c}l", at(f"{c}l")).alias(f"{c}el") for c in ("_x", "_y")], *[F.min_by(f"{c}f", at(f"{c}f")).alias(f"{c}ef") for c in ("_x", "_y")])
    out = near.join(beyond(edges, keys, ["_xel", "_yel"], ["_xef", "_yef"]), [*keys, "_b"], "left")
    out = out.withColumns({f"{c}{n}": F.coalesce(f"{c}{n}", f"{c}{e}") for c in ("_x", "_y") for n, e in (("p", "el"), ("n", "ef"))})
    for c in ("_x", "_y"):
        out = out.where(F.col(f"{c}p").isNotNull() & (F.col(f"{c}n").isNotNull() | (F.col(f"{c}p.t") == F.col("t"))))
    linear = _is_linear(kind, False, options)
    x, y = ((linear_value(f"{c}p", f"{c}n") if linear else previous_value(True, f"{c}p", f"{c}n")) for c in ("_x", "_y"))
    if kind in "iu":
        x, y = x.cast("long"), y.cast("long")
    values = out.select(*keys, "t", x.alias("_u"), y.alias("_w"), *([(F.col("_xp.i") | F.col("_yp.i")).alias("invalid")] if flags else []))
    return values.select(*keys, "t", OPERATORS[operator](F.col("_u"), F.col("_w")).alias("v"), *(["invalid"] if flags else []))


def with_scalar(samples: DataFrame, operator: str, scalar: float, reflected: bool = False) -> DataFrame:
    """A channel and a number, in the order given by ``reflected``."""
    x, y = F.col("v"), F.lit(scalar)
    return samples.withColumn("v", OPERATORS[operator](*((y, x) if reflected else (x, y))))


def with_unary(samples: DataFrame, operator: str) -> DataFrame:
    """A channel's negation, absolute value, bits inverted, or itself ("neg", "abs", "invert", "pos")."""
    return samples.withColumn("v", UNARY[operator](F.col("v")))
