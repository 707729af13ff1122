"""Choosing channels, finding them by name or value, and predicates on rows."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import round_half_away


class ChannelError(ValueError):
    """A channel that isn't there, or of which there are several."""


def resolve(catalogue: DataFrame, name: str | None = None, group: int | None = None, index: int | None = None, first: bool = False) -> tuple[int, int]:
    """(group_index, channel_index) of one channel. Of several occurrences the first if ``first``, else an error."""
    found = catalogue
    for column, v in (("name", name), ("group_index", group), ("channel_index", index)):
        found = found if v is None else found.where(F.col(column) == v)
    rows = found.select("group_index", "channel_index").orderBy("group_index", "channel_index").limit(2).collect()
    if not rows:
        raise ChannelError(f"no channel {name!r} in group {group} at {index}")
    if len(rows) > 1 and not first:
        raise ChannelError(f"several channels {name!r}; give a group and an index")
    return tuple(rows[0])


def select(samples: DataFrame, catalogue: DataFrame, wanted: DataFrame, keys: list[str] = ["group_index", "channel_index"]) -> DataFrame:
    """Samples of the requested channels, in the order asked: ``wanted(position, requested, keys…)``; a channel asked twice is there twice.

    The catalogue gives names; the result's ``name`` is the requested one."""
    chosen = wanted.join(catalogue.select(*keys, F.col("name").alias("own_name")), keys)
    return samples.join(chosen.select(*keys, "position", F.coalesce("requested", "own_name").alias("name")), keys)


def raw_or_physical(samples: DataFrame, raw: bool | dict[str, bool], name: str = "name") -> DataFrame:
    """``v`` from the columns ``raw`` and ``physical``: raw values for all channels, or for those that a mapping says; its
    entry "__default__" holds for all others and must be there."""
    if isinstance(raw, dict):
        if "__default__" not in raw:
            raise ValueError("the mapping of raw channels needs an entry __default__")
        chosen = [k for k, v in raw.items() if k != "__default__" and v != raw["__default__"]]
        test = F.col(name).isin(chosen) if chosen else F.lit(False)
        test = ~test if raw["__default__"] else test
    else:
        test = F.lit(raw)
    return samples.withColumn("v", F.when(test, F.col("raw").cast(samples.schema["physical"].dataType)).otherwise(F.col("physical")))


def get(samples: DataFrame, catalogue: DataFrame, name: str | None = None, group: int | None = None, index: int | None = None, first: bool = False, raw: bool = False, raster: float | None = None, offset: int = 0, count: int | None = None) -> DataFrame:
    """(ordinal, t, v) of one channel of ``samples(group_index, channel_index, ordinal, t, raw, physical)``: a slice of its records, raw or physical; with
    ``raster`` (t, v) on evenly spaced stamps over the slice. A small job finds the channel, with ``raster`` two more its span and bucket."""
    from .resample import resample

    g, c = resolve(catalogue, name, group, index, first)
    one = record_slice(samples.where((F.col("group_index") == g) & (F.col("channel_index") == c)), offset, count)
    one = raw_or_physical(one, raw).select("ordinal", "t", "v")
    return one if raster is None else resample(one.withColumnsRenamed({"ordinal": "ord"}), [], raster)


def information(catalogue: DataFrame, samples: DataFrame) -> DataFrame:
    """A row for each channel group: its channels in order, how many there are, records and span of its master."""
    channels = catalogue.groupBy("group_index").agg(F.array_sort(F.collect_list(F.struct("channel_index", "name"))).alias("channels"), F.count(F.lit(1)).alias("n_channels"))
    spans = samples.groupBy("group_index").agg((F.max("ordinal") + 1).alias("n_records"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))
    return channels.join(spans, "group_index", "left").withColumn("channels", F.col("channels.name"))


def triggers(events: DataFrame) -> DataFrame:
    """Triggers of each group, numbered in order of time: when, and the times before and after that were recorded for them."""
    w = Window.partitionBy("group_index").orderBy("t")
    return events.select("group_index", (F.row_number().over(w) - 1).alias("index"), "t", F.coalesce("pre_time", F.lit(0.0)).alias("pre_time"), F.coalesce("post_time", F.lit(0.0)).alias("post_time"))


def with_missing(frame: DataFrame, columns: list[str]) -> DataFrame:
    """``frame`` with the columns asked for, in their order after its own; those that it lacks are NaN."""
    return frame.withColumns({c: F.lit(float("nan")) for c in columns if c not in frame.columns}) if set(columns) - set(frame.columns) else frame


def stable_order(frame: DataFrame, column: str, ascending: bool = True, index: str = "ordinal") -> DataFrame:
    """Rows by a column, nulls last, those of equal values in order of ``index``."""
    c = F.col(f"`{column}`")
    return frame.orderBy(c.asc_nulls_last() if ascending else c.desc_nulls_last(), index)


def longest_value(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Per channel the greatest size in bytes of its variable-length values, over all files."""
    return samples.groupBy(*keys).agg(F.max(F.octet_length("v")).alias("size"))


def contains(catalogue: DataFrame, name: str) -> bool:
    """Whether a channel of that name is there. A job that ends at the first one found."""
    return bool(catalogue.where(F.col("name") == name).take(1))


def with_empty_channels(samples: DataFrame, catalogue: DataFrame, stamps: DataFrame | None = None, keys: list[str] = ["group_index", "channel_index"]) -> DataFrame:
    """Channels without samples: left out, or, with ``stamps(group_index, t)``, zero at their group's stamps."""
    out = samples.select(*keys, "t", "v")
    if stamps is None:
        return out
    empty = catalogue.select(*keys).join(samples.select(*keys).distinct(), keys, "left_anti")
    return out.unionByName(empty.join(stamps, "group_index").select(*keys, "t", F.lit(0.0).alias("v")))


def iterate(samples: DataFrame, catalogue: DataFrame, keys: list[str] = ["group_index", "channel_index"]):
    """Names of channels in the catalogue's order, each with its samples as a frame that isn't computed before it is asked for."""
    for row in catalogue.select("name", *keys).orderBy(*keys).toLocalIterator():
        yield row["name"], samples.where(reduce(lambda a, b: a & b, [F.col(k) == row[k] for k in keys]))


def cast_values(samples: DataFrame, kind: str) -> DataFrame:
    """Samples of another type: fractions are cut, and what doesn't fit is null."""
    return samples.withColumn("v", F.col("v").try_cast(kind))


def keep_channels(samples: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Samples of the channels in ``wanted``; none is doubled."""
    return samples.join(wanted.select(*keys), keys, "left_semi")


def included(catalogue: DataFrame, dependencies: DataFrame | None = None, skip_master: bool = True) -> DataFrame:
    """Channels that stand for themselves: neither masters nor parts of another channel."""
    out = catalogue.where("NOT is_master") if skip_master else catalogue
    return out.join(dependencies, ["group_index", "channel_index"], "left_anti") if dependencies is not None else out


def record_slice(samples: DataFrame, offset: int = 0, count: int | None = None) -> DataFrame:
    """Records from ``offset`` on, ``count`` of them, by ordinal."""
    return samples.where((F.col("ordinal") >= offset) & (F.lit(True) if count is None else F.col("ordinal") < offset + count))


def where_is(catalogue: DataFrame, name: str, source_name: str | None = None, source_path: str | None = None, acq_name: str | None = None) -> DataFrame:
    """Occurrences of a name, by source or acquisition where given. A name with a backslash is also known by what stands before it."""
    out = catalogue.where((F.col("name") == name) | (F.substring_index("name", "\\", 1) == name))
    for column, v in (("source.name", source_name), ("source.path", source_path), ("acq_name", acq_name)):
        out = out if v is None else out.where(F.col(column) == v)
    return out


def name_matches(name: str, pattern: str, mode: str = "plain", ignore_case: bool = False) -> Column:
    """Search in names: "plain" text, "regex" or "wildcard" (* for any text) anywhere in the name."""
    column = F.col(name)
    if mode == "plain":
        return F.contains(F.lower(column), F.lit(pattern.lower())) if ignore_case else F.contains(column, F.lit(pattern))
    if mode == "wildcard":
        pattern = ".*".join(re.escape(p) for p in pattern.split("*"))
    elif mode != "regex":
        raise ValueError(f"unknown mode {mode!r}")
    return column.rlike(("(?i)" if ignore_case else "") + pattern)


def is_close(value: Column, target: float) -> Column:
    """Within 1e-8 plus 1e-5 of the target's size."""
    return F.abs(value - target) <= 1e-8 + 1e-5 * abs(target)


def by_values(samples: DataFrame, keys: list[str], target: float, mode: str) -> DataFrame:
    """Channels that "contains", "contains_not" (not all close) or "constant" (all close) the target."""
    close = is_close(F.col("v"), target)
    test = {"contains": F.bool_or(close), "contains_not": ~F.bool_and(close), "constant": F.bool_and(close)}[mode]
    return samples.groupBy(*keys).agg(test.alias("ok")).where("ok").drop("ok")


COMPARE = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


def condition(column: str, op: str, target) -> Column:
    """A row filter. NaN equals nothing, not even NaN, but ``== NaN`` asks whether the value is NaN."""
    c = F.col(column)
    if isinstance(target, float) and target != target:
        return F.isnan(c) if op == "==" else ~F.isnan(c) if op == "!=" else F.lit(False)
    out = COMPARE[op](c, F.lit(target))
    number = isinstance(target, (int, float)) and not isinstance(target, bool)
    return out & ~F.isnan(c) if number and op in (">", ">=", "==") else out


def filter_rows(df: DataFrame, conditions: list[tuple[str, str, str, object]]) -> DataFrame:
    """Conditions (AND or OR, column, op, target); AND binds closer than OR. The first one's word doesn't count."""
    groups: list[list[Column]] = []
    for i, (word, column, op, target) in enumerate(conditions):
        if i == 0 or word.upper() == "OR":
            groups.append([])
        groups[-1].append(condition(column, op, target))
    return df.where(reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, g) for g in groups])) if groups else df


def literal(text: str, kind: str):
    """What a filter's text stands for: "hex", "bin", "ascii", "float", "bytes" or "datetime"."""
    if kind in ("hex", "bin"):
        return int(text, 16 if kind == "hex" else 2)
    if kind == "bytes":
        return bytes.fromhex(text)
    if kind == "datetime":
        return F.to_timestamp(F.lit(text))
    return text if kind == "ascii" else float(text)


def first_range(value: Column, ranges: list[tuple]) -> Column:
    """The label of the first range that holds: (low, low op, high op, high, label); "value1 op1 x and x op2 value2", None skips a side."""
    out = F.lit(None)
    for low, op1, op2, high, label in reversed(ranges):
        test = F.lit(True)
        test = test & COMPARE[op1](F.lit(low), value) if low is not None else test
        test = test & COMPARE[op2](value, F.lit(high)) if high is not None else test
        out = F.when(test, F.lit(label)).otherwise(out)
    return out


def next_match(samples: DataFrame, channel: str, after: float, test: Column, forward: bool = True, digits: int | None = None) -> DataFrame:
    """(t, channel) of the earliest sample after a stamp (the latest before it, if not ``forward``) that passes; one row, null if none.
    Of samples of that stamp the first by ``ord`` that has a ``channel`` gives it.
    With ``digits`` stamps are rounded first, so that those a rounding apart from the start don't count as later."""
    start = F.lit(after)
    if digits is not None:
        samples, start = samples.withColumn("t", round_half_away(F.col("t"), digits)), round_half_away(start, digits)
    some = samples.where(test & (F.col("t") > start if forward else F.col("t") < start))
    place = F.when(F.col(channel).isNotNull(), F.struct("t", (F.col("ord") if forward else -F.col("ord")).alias("o")))
    return some.agg((F.min("t") if forward else F.max("t")).alias("t"), (F.min_by if forward else F.max_by)(channel, place).alias(channel))


def next_different(samples: DataFrame, keys: list[str], at: float, mode: str = "different", forward: bool = True) -> DataFrame:
    """Per channel: the next stamp after ``at`` with a "higher", "lower" or "different" value than the sample in force at ``at``."""
    now = samples.where(F.col("t") <= at).groupBy(*keys).agg(F.max_by("v", F.struct("t", "ord")).alias("_now"))
    test = {"higher": F.col("v") > F.col("_now"), "lower": F.col("v") < F.col("_now"), "different": F.col("v") != F.col("_now")}[mode]
    later = samples.where(F.col("t") > at if forward else F.col("t") < at).join(now, keys).where(test)
    return later.groupBy(*keys).agg((F.min("t") if forward else F.max("t")).alias("t"))


def step_stamp(stamps: DataFrame, at: float, k: int) -> DataFrame:
    """The stamp k positions from the first one at or after ``at``: one row, clipped to the timebase. A bounded take."""
    ahead = stamps.select("t").distinct()
    some = ahead.where(F.col("t") >= at).orderBy("t").limit(k + 1) if k >= 0 else ahead.where(F.col("t") < at).orderBy(F.col("t").desc()).limit(-k)
    return some.agg((F.max("t") if k >= 0 else F.min("t")).alias("t"))


def natural_key(name: str) -> Column:
    """Sort key by which runs of digits count as numbers."""
    return F.transform(F.expr(f"regexp_extract_all(lower({name}), '([0-9]+|[^0-9]+)', 1)"), lambda x: F.when(x.rlike("^[0-9]"), F.lpad(x, 20, "0")).otherwise(x))


def sort_by_value(df: DataFrame, number: str, text: str, name: str) -> DataFrame:
    """Numbers, then texts, then what is missing; by name in natural order within."""
    return df.orderBy(F.when(F.col(number).isNotNull(), 0).when(F.col(text).isNotNull(), 1).otherwise(2), number, text, natural_key(name))


def with_edges(samples: DataFrame, keys: list[str], flag: str, order: str = "ord", bucket: int = 1_000_000) -> DataFrame:
    """Rows where a flag holds, and their neighbours, by buckets of a dense ``order``: a bucket's edge rows are sent to the buckets beside it."""
    by = samples.withColumns({"_b": F.floor(F.col(order) / bucket), "_own": F.lit(True)})
    edges = by.where(F.pmod(F.col(order), F.lit(bucket)).isin(0, bucket - 1))
    copies = edges.withColumns({"_b": F.when(F.pmod(F.col(order), F.lit(bucket)) == 0, F.col("_b") - 1).otherwise(F.col("_b") + 1), "_own": F.lit(False)})
    w = Window.partitionBy(*keys, "_b").orderBy(order)
    near = F.coalesce(F.lag(flag).over(w), F.lit(False)) | F.coalesce(F.lead(flag).over(w), F.lit(False))
    return by.unionByName(copies).withColumn("_near", near).where(F.col("_own") & (F.col(flag) | F.col("_near"))).drop("_b", "_own", "_near")
