"""Recordings as fixed-width records: a catalogue of fields, and built-in expressions that take them out.

Record files are read by Spark in splits (``binaryFile`` for whole small files, or any DataFrame with a BINARY record).
A field is (name, byte offset, bit offset, bits, type, byte order); extraction is arithmetic on the record's bytes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.bus import byte_at, ieee, two_complement, unsigned


@dataclass(frozen=True)
class Field:
    """``kind``: "u", "i", "f", "text" or "bytes". Bits count from the field's first byte; big-endian ones from its last."""

    name: str
    byte_offset: int
    bits: int
    kind: str = "u"
    bit_offset: int = 0
    big_endian: bool = False
    invalid_bit: int | None = None


def records(spark: SparkSession, path: str, size: int, header: int = 0) -> DataFrame:
    """(path, ordinal, record): the records of binary files, ``size`` bytes each after ``header`` bytes.

    Files are dealt to tasks by Spark and cut into records by position before they are exploded, so no record carries its file. A file
    larger than a task's memory should be recorded in pieces, as loggers do."""
    files = spark.read.format("binaryFile").load(path)
    n = F.floor((F.col("length") - header) / size)
    cut = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.substring(F.col("content"), (i * size + header + 1).cast("int"), F.lit(size)))
    return files.where(n > 0).select("path", F.posexplode(cut).alias("ordinal", "record")).withColumn("ordinal", F.col("ordinal").cast("long"))


def value(record: Column, f: Field) -> Column:
    if f.kind in ("text", "bytes"):
        data = F.substring(record, F.lit(f.byte_offset + 1), F.lit(f.bits // 8))
        return F.substring_index(F.decode(data, "UTF-8"), "\0", 1) if f.kind == "text" else data
    n = (f.bit_offset + f.bits + 7) // 8
    # a big-endian field's most significant bit, counted within its bytes
    start = f.byte_offset * 8 + f.bit_offset
    if f.big_endian:
        top = n * 8 - f.bit_offset - f.bits
        start = (f.byte_offset + top // 8) * 8 + 7 - top % 8
    raw = unsigned(record, F.lit(start), F.lit(f.bits), F.lit(not f.big_endian))
    if f.kind == "f":
        return ieee(raw, F.lit(f.bits))
    return two_complement(raw, F.lit(f.bits)) if f.kind == "i" else raw


def invalid(record: Column, position: int, trailer: int) -> Column:
    """An invalidation bit: number ``position`` of the bytes that start at ``trailer``."""
    return F.shiftright(byte_at(record, F.lit(trailer + position // 8)), position % 8).bitwiseAND(F.lit(1)) == 1


def fields(rows: DataFrame, layout: list[Field], trailer: int | None = None, record: str = "record") -> DataFrame:
    """A column per field, and ``<name>_invalid`` for those with an invalidation bit."""
    columns = {f.name: value(F.col(record), f) for f in layout}
    columns |= {f"{f.name}_invalid": invalid(F.col(record), f.invalid_bit, trailer) for f in layout if f.invalid_bit is not None and trailer is not None}
    return rows.withColumns(columns).drop(record)


def by_record_id(rows: DataFrame, id_bytes: int, record: str = "record") -> DataFrame:
    """Interleaved records told apart by their leading little-endian id: ``record_id`` and the rest of the record."""
    whole = F.aggregate(F.reverse(F.transform(F.sequence(F.lit(0), F.lit(id_bytes - 1)), lambda i: byte_at(F.col(record), i))), F.lit(0).cast("long"), lambda a, b: a * 256 + b)
    # two steps: within one, a name in a lambda would be taken for the new column
    return rows.withColumn("record_id", whole).withColumn(record, F.expr(f"substring({record}, {id_bytes + 1})"))


def variable_length(data: Column, offset: Column) -> Column:
    """A length-prefixed value (four bytes, little-endian) at an offset of a data block."""
    size = unsigned(data, offset * 8, F.lit(32), F.lit(True)).cast("int")
    return F.substring(data, (offset + 5).cast("int"), size)


def master(ordinal: Column, rate: float | None = None, conversion: tuple[float, float] = (1, 0)) -> Column:
    """A timebase that isn't stored: the ordinal, times the rate of a virtual master, through a linear conversion."""
    a, b = conversion
    return ordinal.cast("double") * (rate if rate is not None else 1.0) * a + b
