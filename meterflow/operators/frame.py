"""Wide frames: a column for each channel, and the names of columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .align import beyond, both_ways, bucket_width, every_stamp, interpolate, linear_value, previous_value, union_timebase


def wide_exact(samples: DataFrame, keys: list[str], channel: str, names: list[str]) -> DataFrame:
    """(keys, t, a column for each of ``names``): values at their own stamps, null elsewhere; of equal stamps the first in ``ord``."""
    return samples.groupBy(*keys, "t").pivot(channel, names).agg(F.min_by("v", "ord"))


def wide(samples: DataFrame, keys: list[str], channel: str, names: list[str], linear: bool = False, outside_null: bool = False, same_group: bool = False, bucket: float | None = None) -> DataFrame:
    """As :func:`wide_exact`, on the union of stamps, each channel interpolated (repeated, unless ``linear``). ``same_group``: all
    channels have the same stamps, so nothing is interpolated. ``outside_null``: null beyond a channel's own span.

    Channels become columns first, a row for each stamp; then each column is filled within time buckets (of ``bucket``, or as
    :func:`~.align.bucket_width` finds by a job) and from a row per bucket beyond them. Channels and stamps are never multiplied."""
    if same_group:
        return wide_exact(samples, keys, channel, names)
    some = samples.where(F.col(channel).isin(names))
    bucket = bucket or bucket_width(some, keys)
    n = range(len(names))
    own = [F.when(F.col(channel) == name, F.struct("t", "v")) for name in names]
    order = [F.when(F.col(channel) == name, F.col("ord")) for name in names]
    sides = [(f"l{i}", F.max_by(own[i], order[i])) for i in n] + [(f"f{i}", F.min_by(own[i], order[i])) for i in n]
    rows = some.withColumn("_b", F.floor(F.col("t") / bucket)).repartition(*keys, "_b").groupBy(*keys, "_b", "t").agg(*[c.alias(k) for k, c in sides])
    at = lambda c: F.when(F.col(c).isNotNull(), F.col("t"))
    edges = rows.groupBy(*keys, "_b").agg(*[F.max_by(f"l{i}", at(f"l{i}")).alias(f"el{i}") for i in n], *[F.min_by(f"f{i}", at(f"f{i}")).alias(f"ef{i}") for i in n])
    edges = beyond(edges, keys, [f"el{i}" for i in n], [f"ef{i}" for i in n])
    up, down = both_ways(keys, "t")
    filled = rows.withColumns({f"p{i}": F.last(f"l{i}", True).over(up) for i in n} | {f"n{i}": F.last(f"f{i}", True).over(down) for i in n}).join(edges, [*keys, "_b"], "left")
    filled = filled.withColumns({f"p{i}": F.coalesce(f"p{i}", f"el{i}") for i in n} | {f"n{i}": F.coalesce(f"n{i}", f"ef{i}") for i in n})

    def value(i: int) -> Column:
        v = linear_value(f"p{i}", f"n{i}") if linear else previous_value(True, f"p{i}", f"n{i}")
        inside = F.col(f"p{i}").isNotNull() & (F.col(f"n{i}").isNotNull() | (F.col(f"p{i}.t") == F.col("t")))
        return (F.when(inside, v) if outside_null else v).alias(names[i])

    return filled.select(*keys, "t", *[value(i) for i in n])


def group_frame(samples: DataFrame, catalogue: DataFrame, group: int, value: str = "physical") -> DataFrame:
    """One channel group as a frame: a row for each record, a column for each channel by its unique name. A small job reads the group's names."""
    own = catalogue.where(F.col("group_index") == group).select("channel_index", "name")
    names = {r["channel_index"]: r["unique_name"] for r in unique_names(own, "name", ["channel_index"]).collect()}
    rows = samples.where(F.col("group_index") == group).groupBy("ordinal", "t")
    wide_rows = rows.pivot("channel_index", sorted(names)).agg(F.first(value))
    return wide_rows.select("ordinal", "t", *[F.col(f"`{i}`").alias(names[i]) for i in sorted(names)])


def on_common_timebase(samples: DataFrame, keys: list[str], channel: str, kind: str = "f", bucket: float | None = None) -> DataFrame:
    """Signals of unequal timebases as one group: every channel, interpolated, at every stamp that any channel of its keys has."""
    channels = samples.select(*keys, channel).distinct()
    probes = every_stamp(channels, union_timebase(samples, keys=keys), keys)
    return interpolate(samples, probes, [*keys, channel], kind, bucket=bucket)


def long(wide_frame: DataFrame, t: str, columns: list[str]) -> DataFrame:
    """Ingest of a frame: its columns as channels on the timebase ``t``; nulls are no samples."""
    kept = [c for c in wide_frame.columns if c not in columns]
    out = wide_frame.unpivot(kept, columns, "channel", "v").where("v IS NOT NULL")
    return out.withColumnRenamed(t, "t") if t != "t" else out


def unique_names(catalogue: DataFrame, name: str, order: list[str]) -> DataFrame:
    """``unique_name``: the name, then name_0, name_1, … for its further occurrences in ``order``."""
    n = F.row_number().over(Window.partitionBy(name).orderBy(*order))
    return catalogue.withColumn("unique_name", F.when(n == 1, F.col(name)).otherwise(F.concat_ws("_", F.col(name), (n - 2).cast("string"))))


def flatten(df: DataFrame, parent: str = "", separator: str = ".", basenames: bool = False) -> DataFrame:
    """Struct columns as columns ``parent.child``, at any depth; arrays stay. ``basenames`` keeps only the last part."""
    columns: list[Column] = []

    def walk(column: Column, name: str, kind: T.DataType) -> None:
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                walk(column.getField(f.name), f"{name}{separator}{f.name}", f.dataType)
        else:
            columns.append(column.alias(name.rsplit(separator, 1)[-1] if basenames else name))

    for f in df.schema.fields:
        walk(F.col(f"`{f.name}`"), f.name, f.dataType)
    return df.select(*columns)


def chunks(df: DataFrame, order: str, rows: int) -> DataFrame:
    """``df`` with ``chunk``, the number of its run of ``rows`` rows by a dense ``order`` column that starts at 0."""
    return df.withColumn("chunk", F.floor(F.col(order) / rows))


def display_name(names: str, name: str) -> Column:
    """The first display name of a map, else the name."""
    return F.coalesce(F.try_element_at(F.map_keys(names), F.lit(1)), F.col(name))
