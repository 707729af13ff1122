"""Exports: Parquet, CSV with a row of units, a CSV per group, ASC text, anonymised texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def numeric_only(frame: DataFrame) -> DataFrame:
    """Columns that are numbers: what a Parquet export holds."""
    return frame.select([F.col(f"`{f.name}`") for f in frame.schema.fields if isinstance(f.dataType, (T.NumericType, T.BooleanType))])


def to_parquet(frame: DataFrame, path: str, compression: str = "snappy") -> None:
    numeric_only(frame).write.option("compression", compression).parquet(path)


def csv_rows(frame: DataFrame, t: str = "t", start=None, zone: str | None = None) -> DataFrame:
    """``frame`` as text columns, bytes in hex; with ``start`` the stamps (seconds) become dates, in a time zone if given."""
    out = frame
    if start is not None:
        moment = F.lit(start).cast("timestamp") + F.make_dt_interval(secs=F.col(t).cast("decimal(18,6)"))
        out = out.withColumn(t, F.date_format(F.from_utc_timestamp(moment, zone) if zone else moment, "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    return out.select([(F.regexp_replace(F.hex(f.name), "(..)(?!$)", "$1 ") if isinstance(f.dataType, T.BinaryType) else F.col(f"`{f.name}`").cast("string")).alias(f.name) for f in out.schema.fields])


def to_csv(frame: DataFrame, path: str, units: dict[str, str] | None = None, **options) -> None:
    """CSV parts with a header each; units stand in the header's names, since parts are written apart."""
    out = csv_rows(frame)
    for name, unit in (units or {}).items():
        out = out.withColumnRenamed(name, f"{name} [{unit}]")
    out.write.options(header=True, **options).csv(path)


def to_csv_by_group(samples: DataFrame, path: str, group: str = "group_index", **options) -> None:
    """A folder of CSV parts for each channel group, in one pass."""
    samples.write.partitionBy(group).options(header=True, **options).csv(path)


def export(frame: DataFrame, fmt: str, path: str, **options) -> None:
    """``frame`` in a format: "parquet", "csv", "csv_by_group", "asc" or "table" (Parquet with all its columns)."""
    if fmt == "table":
        frame.write.options(**options).parquet(path)
        return
    writers = {"parquet": to_parquet, "csv": to_csv, "csv_by_group": to_csv_by_group, "asc": to_asc}
    if fmt not in writers:
        raise ValueError(f"unknown format {fmt!r}: one of {[*writers, 'table']}")
    writers[fmt](frame, path, **options)


def flexray_lines(frames: DataFrame) -> DataFrame:
    """(t, value): a line of an ASC log for each FlexRay frame of :func:`~meterflow.operators.bus.flexray_trace`'s input."""
    data = F.regexp_replace(F.hex("payload"), "(..)(?!$)", "$1 ")
    name = F.when(F.col("channel") == 1, "B").otherwise("A")
    line = F.format_string("%12.6f Fr RMSG 0 0 %d %s %d %s", F.col("t"), F.col("id").cast("long"), name, F.length("payload"), data)
    return frames.where("payload IS NOT NULL").select("t", line.alias("value"))


def asc_lines(frames: DataFrame) -> DataFrame:
    """(t, value): a line of a Vector ASC log for each frame (t in seconds); frames may be flagged is_tx, is_extended, is_fd, is_remote or is_error."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in frames.columns else F.lit(False)
    data = F.regexp_replace(F.hex("payload"), "(..)(?!$)", "$1 ")
    direction = F.when(flag("is_tx"), "Tx").otherwise("Rx")
    ident = F.concat(F.hex("id"), F.when(flag("is_extended"), "x").otherwise(""))
    start = F.format_string("%12.6f", F.col("t"))
    line = F.format_string("%s %-2s %-16s%s   d %d %s", start, F.col("bus"), ident, direction, F.length("payload"), data)
    error = F.format_string("%s %-2s ErrorFrame", start, F.col("bus"))
    remote = F.format_string("%s %-2s %-16s%s   r", start, F.col("bus"), ident, direction)
    fd = F.format_string("%s CANFD %-2s %s %-16s 1 0 %d %s", start, F.col("bus"), direction, ident, F.length("payload"), data)
    return frames.select("t", F.when(flag("is_error"), error).when(flag("is_remote"), remote).when(flag("is_fd"), fd).otherwise(line).alias("value"))


def to_asc(frames: DataFrame, path: str) -> None:
    """Text parts whose lines are in order of time, part after part."""
    asc_lines(frames).orderBy("t").select("value").write.text(path)


def scrambled(text: Column, salt: str) -> Column:
    """A text of the same length that doesn't tell the original: digits of salted hashes, equal for equal texts."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.length(text) / 64).cast("int")), lambda i: F.sha2(F.concat_ws("/", F.lit(salt), text, i.cast("string")), 256))
    return F.substring(F.array_join(blocks, ""), F.lit(1), F.length(text))


def scramble(catalogue: DataFrame, columns: list[str], salt: str) -> DataFrame:
    return catalogue.withColumns({c: scrambled(F.col(c), salt) for c in columns})
