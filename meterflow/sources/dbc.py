"""Signal definitions from DBC text: the SG_ and BO_ lines, read by Spark as text and taken apart by regular expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_BO = r"^BO_ (\d+) (\w+)\s*: (\d+)"
_SG = r"^\s*SG_ (\w+)\s*(M|m\d+M?)?\s*: (\d+)\|(\d+)@([01])([+-]) \(([^,]+),([^)]+)\)"
_VALUES = r"^VAL_ (\d+) (\w+) (.*);"
_VALUE = r'(-?\d+) "([^"]*)"'
_FLOAT = r"^SIG_VALTYPE_ (\d+) (\w+)\s*:?\s*([12])\s*;"
_PROTOCOL = r'^BA_ "ProtocolType" "J1939'
_FORMAT = r'^BA_ "VFrameFormat" BO_ (\d+) (\d+)\s*;'
#: Extended ids have bit 31 set, of which 29 bits are the id. VFrameFormat 3 is J1939.
_EXTENDED, _ID, _J1939 = 0x80000000, 0x1FFFFFFF, "3"
_RANGE = r"^SG_MUL_VAL_ (\d+) (\w+) (\w+) (\d+)-(\d+)"


def signals(lines: DataFrame) -> DataFrame:
    """Definitions from ``lines(path, n, value)``: a database's lines with their numbers. A database is small; files are told apart by path.

    Ids lose the extended flag (bit 31), which is a column of its own. SIG_VALTYPE_ lines make floats; a message is J1939 if the database's protocol is and its id is
    extended, or by its frame format. A signal "mN" belongs to the message's signal "M" at value N; ranges of SG_MUL_VAL_ go first."""
    w = Window.partitionBy("path").orderBy("n")
    head = F.when(F.col("value").rlike(_BO), F.col("value"))
    rows = lines.withColumn("_h", F.last(head, True).over(w)).where(F.col("value").rlike(_SG))
    g = lambda i: F.regexp_extract("value", _SG, i)
    out = rows.select(
        "path", F.regexp_extract("_h", _BO, 1).cast("long").alias("_id"), F.regexp_extract("_h", _BO, 2).alias("message"), F.regexp_extract("_h", _BO, 3).cast("int").alias("message_size"),
        g(1).alias("signal"), g(2).alias("_m"), g(3).cast("int").alias("start_bit"), g(4).cast("int").alias("size"), (g(5) == "1").alias("little_endian"), (g(6) == "-").alias("is_signed"), F.trim(g(7)).cast("double").alias("factor"), F.trim(g(8)).cast("double").alias("offset"),
    )
    out = out.withColumns({"message_id": F.col("_id").bitwiseAND(F.lit(_ID)), "is_extended": F.col("_id").bitwiseAND(F.lit(_EXTENDED)) != 0})
    found = lambda pattern, i: F.regexp_extract("value", pattern, i)
    floats = lines.where(F.col("value").rlike(_FLOAT)).select("path", found(_FLOAT, 1).cast("long").alias("_id"), found(_FLOAT, 2).alias("signal"), F.lit(True).alias("_float"))
    formats = lines.where(F.col("value").rlike(_FORMAT)).select("path", found(_FORMAT, 1).cast("long").alias("_id"), (found(_FORMAT, 2) == _J1939).alias("_own"))
    protocol = lines.groupBy("path").agg(F.bool_or(F.col("value").rlike(_PROTOCOL)).alias("_all"))
    out = out.join(floats, ["path", "_id", "signal"], "left").join(formats, ["path", "_id"], "left").join(protocol, "path")
    muxers = out.where("_m = 'M'").select("path", "message_id", F.col("signal").alias("_muxer"))
    r = lambda i: F.regexp_extract("value", _RANGE, i)
    ranged = lines.where(F.col("value").rlike(_RANGE)).select("path", r(1).cast("long").bitwiseAND(F.lit(0x1FFFFFFF)).alias("message_id"), r(2).alias("signal"), r(3).alias("_rm"), r(4).cast("long").alias("_r0"), r(5).cast("long").alias("_r1"))
    out = out.join(muxers, ["path", "message_id"], "left").join(ranged, ["path", "message_id", "signal"], "left")
    number = F.regexp_extract("_m", r"m(\d+)", 1)
    own = F.when(number != "", number.cast("long"))
    return out.withColumns({"mux": F.coalesce("_rm", F.when(own.isNotNull(), F.col("_muxer"))), "mux_min": F.coalesce("_r0", own), "mux_max": F.coalesce("_r1", own), "is_float": F.coalesce("_float", F.lit(False)), "j1939": F.coalesce("_own", F.lit(False)) | (F.col("_all") & F.col("is_extended"))}).drop("_id", "_float", "_own", "_all", "_m", "_muxer", "_rm", "_r0", "_r1")


def values(lines: DataFrame) -> DataFrame:
    """(path, message_id, signal, value, label): the value tables of VAL_ lines, a row for each of their entries."""
    rows = lines.where(F.col("value").rlike(_VALUES))
    g = lambda i: F.regexp_extract("value", _VALUES, i)
    entry = F.explode(F.regexp_extract_all(g(3), F.lit(_VALUE), F.lit(0)))
    out = rows.select("path", g(1).cast("long").bitwiseAND(F.lit(_ID)).alias("message_id"), g(2).alias("signal"), entry.alias("_e"))
    return out.select("path", "message_id", "signal", F.regexp_extract("_e", _VALUE, 1).cast("long").alias("value"), F.regexp_extract("_e", _VALUE, 2).alias("label"))
