"""Recordings joined end to end or side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def file_order(samples: DataFrame, measurements: DataFrame) -> DataFrame:
    """Measurements with ``position``, by start time, then earliest stamp, then id. One row per measurement."""
    first = samples.groupBy("measurement_id").agg(F.min("t").alias("first_t"))
    w = Window.orderBy(F.col("start_time").asc_nulls_last(), "first_t", "measurement_id")
    return measurements.join(first, "measurement_id", "left").withColumn("position", F.row_number().over(w) - 1)


def _offsets(rows: list, sync: bool, direct: bool, gap) -> list[tuple]:
    """The fold over files: each file's shift follows from where the one before ended. A handful of numbers per file."""
    out, last = [], None
    oldest = min((r["start"] for r in rows if r["start"] is not None), default=0)
    for r in rows:
        shift = max(0, (r["start"] or 0) - oldest) if sync else 0
        if r["lo"] is not None:
            if last is not None and (direct or r["lo"] + shift <= last):
                step = (r["second"] - r["lo"]) if r["second"] is not None else gap
                shift = last + step - r["lo"]
            last = r["hi"] + shift
        out.append((r["measurement_id"], shift))
    return out


def concatenate(samples: DataFrame, starts: DataFrame, sync: bool = True, direct: bool = False, gap=1000) -> DataFrame:
    """Files (``measurement_id``) one after the other in order of ``starts(measurement_id, position, start)``.

    With ``sync`` a file is shifted by how much later it started than the oldest. A file that would begin at or before
    the end of the one before (or any, if ``direct``) continues it: its first stamp is that end plus its own first interval, or ``gap``.
    Collected are three stamps for each file, found on Spark; the shifts come back as a broadcast
    table of as many rows as there are files."""
    rank = _ends(samples)
    per_file = starts.join(rank, "measurement_id", "left").select("measurement_id", "position", "start", "lo", "hi", "second").orderBy("position")
    shifts = _offsets(per_file.collect(), sync, direct, gap)
    kind = samples.schema["t"].dataType.simpleString()
    table = samples.sparkSession.createDataFrame([(m, float(x) if kind in ("double", "float") else x) for m, x in shifts], f"measurement_id {samples.schema['measurement_id'].dataType.simpleString()}, _shift {kind}")
    return samples.join(F.broadcast(table), "measurement_id").withColumn("t", F.col("t") + F.col("_shift")).drop("_shift")


def _ends(samples: DataFrame) -> DataFrame:
    """First, second distinct and last stamp of each file."""
    lo = samples.groupBy("measurement_id").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    second = samples.join(lo, "measurement_id").where(F.col("t") > F.col("lo")).groupBy("measurement_id").agg(F.min("t").alias("second"))
    return lo.join(second, "measurement_id", "left")


def with_origin(samples: DataFrame, files: list[str]) -> DataFrame:
    """``samples_origin``: the file's index, and ``samples_origin_name``: its name."""
    names = F.array(*[F.lit(f) for f in files])
    return samples.withColumn("samples_origin_name", F.get(names, F.col("samples_origin")))


def same_structure(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """Catalogue rows that one side has more often than the other; none if the structures agree."""
    left, right = a.select(*columns), b.select(*columns)
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def stack(frames: list[tuple[DataFrame, int]], group: str = "group_index", starts: list | None = None) -> DataFrame:
    """Groups side by side: each frame's group numbers follow those of the frames before it (given its number of groups).
    With ``starts``, when each recording began in the unit of t, all stamps count from the earliest of them."""
    out, base = None, 0
    for k, (df, groups) in enumerate(frames):
        moved = df.withColumn(group, F.col(group) + base)
        moved = moved.withColumn("t", F.col("t") + F.lit(starts[k] - min(starts))) if starts else moved
        out, base = moved if out is None else out.unionByName(moved), base + groups
    return out


def remapped(samples: DataFrame, catalogue: DataFrame, reference: DataFrame) -> DataFrame:
    """Samples of another recording under the numbers that ``reference`` has for its groups (by ``acq_name``) and channels (by name within a group).

    Channels that the reference lacks are left out; :func:`same_structure` tells which they are."""
    numbers = reference.select("acq_name", "name", F.col("group_index").alias("_g"), F.col("channel_index").alias("_c"))
    found = catalogue.select("group_index", "channel_index", "acq_name", "name").join(numbers, ["acq_name", "name"]).select("group_index", "channel_index", "_g", "_c")
    out = samples.join(found, ["group_index", "channel_index"])
    return out.withColumns({"group_index": F.col("_g"), "channel_index": F.col("_c")}).drop("_g", "_c")


def append_group(catalogue: DataFrame, samples: DataFrame, channels: DataFrame, values: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A new channel group behind the ones there are: ``channels(channel_index, name, …)`` and their ``values``. One small job finds its number."""
    number = catalogue.agg(F.coalesce(F.max("group_index") + 1, F.lit(0))).first()[0]
    own = lambda df: df.withColumn("group_index", F.lit(number).cast(catalogue.schema["group_index"].dataType))
    return catalogue.unionByName(own(channels), allowMissingColumns=True), samples.unionByName(own(values), allowMissingColumns=True)


def append_records(samples: DataFrame, more: DataFrame, keys: list[str] = ["group_index", "channel_index"]) -> DataFrame:
    """Further records of channels that are there: their ordinals follow the last ones, their stamps stay."""
    last = samples.groupBy(*keys).agg((F.max("ordinal") + 1).alias("_next"))
    moved = more.join(last, keys, "left").withColumn("ordinal", F.col("ordinal") + F.coalesce("_next", F.lit(0))).drop("_next")
    return samples.unionByName(moved)


def converted(measurement: DataFrame, version: str, versions: tuple[str, ...] = ("2.00", "2.10", "2.14", "3.00", "3.10", "3.20", "3.30", "4.00", "4.10", "4.11", "4.20", "4.30")) -> DataFrame:
    """A measurement's row in another version of the format; its samples stay as they are. An unknown version is an error."""
    if version not in versions:
        raise ValueError(f"unknown version {version!r}")
    return measurement.withColumn("version", F.lit(version))


def scatter(frames: list[DataFrame], t: str = "t") -> DataFrame:
    """Rows of several frames with their own columns, in order of time; equal stamps keep all their rows, in the frames' order."""
    out = None
    for k, df in enumerate(frames):
        df = df.withColumn("source_index", F.lit(k))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out.orderBy(t, "source_index")


def attach(attachments: DataFrame, more: DataFrame) -> DataFrame:
    """Attachments with further ones (file_name, mime, comment, data), which are numbered on and carry their size and digest."""
    n = attachments.agg(F.coalesce(F.max("index") + 1, F.lit(0))).first()[0]
    w = Window.orderBy("file_name")
    new = more.withColumns({"index": F.row_number().over(w) - 1 + F.lit(n), "size": F.length("data"), "md5": F.md5("data")})
    return attachments.unionByName(new.select(*attachments.columns))


def extend(first: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """``other`` after ``first``, per key: shifted by the last stamp where it starts at or before it."""
    last = first.groupBy(*keys).agg(F.max("t").alias("_last"))
    start = other.groupBy(*keys).agg(F.min("t").alias("_start"))
    shift = start.join(last, keys, "left").select(*keys, F.when(F.col("_start") <= F.col("_last"), F.col("_last")).otherwise(F.lit(0)).alias("_shift"))
    return first.unionByName(other.join(shift, keys).withColumn("t", F.col("t") + F.col("_shift")).drop("_shift"))
