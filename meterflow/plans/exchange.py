"""Queries on records, signal definitions and exports, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar, userfn
from ..model import event_samples
from ..operators import bus, select
from ..sources import dbc, records, sinks
from .alignment import S


def _little(x: Column, size: int) -> Column:
    """Hex of a non-negative integer, little-endian."""
    return F.concat(*[F.lpad(F.hex(F.shiftright(x, 8 * i).bitwiseAND(F.lit(255))), 2, "0") for i in range(size)])


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as records of 16 bytes: key u32 LE, cents i32 BE (negated for odd keys), status text, a u12 at bit 4, an invalidation byte."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    cents = F.rint(F.col("o_totalprice") * 100).cast("long") * F.when(F.col("o_orderkey") % 2 == 1, -1).otherwise(1)
    big = F.lpad(F.hex(F.pmod(cents, F.lit(1 << 32))), 8, "0")
    bits = _little((F.col("o_custkey") % 4096) * 16 + 5, 2)
    flags = F.lpad(F.hex(F.when(F.col("o_orderkey") % 3 == 0, 4).otherwise(0)), 2, "0")
    return o.select("o_orderkey", F.unhex(F.concat(_little(F.col("o_orderkey"), 4), big, F.hex(F.encode("o_orderstatus", "UTF-8")), F.lit("00004142"), bits, flags, F.lit("00"))).alias("record"))


LAYOUT = [records.Field("key", 0, 32), records.Field("cents", 4, 32, "i", big_endian=True, invalid_bit=2), records.Field("status", 8, 24, "text"), records.Field("customer", 12, 12, bit_offset=4)]


def record_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    # status takes bytes 8 to 10, a filler bytes 10 to 12 ("AB" from byte 11), the 12-bit field starts in byte 13
    layout = [LAYOUT[0], LAYOUT[1], LAYOUT[2], records.Field("customer", 13, 12, bit_offset=4)]
    return records.fields(_records(spark, sf_dir), layout, trailer=15)


def record_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interleaved records: the leading two bytes as an id, and how long the rest is."""
    return records.by_record_id(_records(spark, sf_dir), 2).select("o_orderkey", "record_id", F.length("record").alias("size"))


def variable_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length-prefixed texts in one block per part, the second of them taken by its offset."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", "p_type")
    piece = lambda c: F.concat(_little(F.octet_length(c).cast("long"), 4), F.hex(F.encode(c, "UTF-8")))
    block = p.withColumn("data", F.unhex(F.concat(piece("p_name"), piece("p_type"))))
    return block.select("p_partkey", F.decode(records.variable_length(F.col("data"), F.lit(0)), "UTF-8").alias("first"), F.decode(records.variable_length(F.col("data"), 4 + F.octet_length("p_name")), "UTF-8").alias("second"))


def virtual_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = event_samples(spark, sf_dir)
    return e.select(F.col("ord").alias("event_id"), records.master(F.col("ord"), 0.25, (2, 1)).alias("t"))


def dbc_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A signal definition for each supplier, written as DBC text and read again."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey")
    k = F.col("s_suppkey").cast("string")
    head = F.concat(F.lit("BO_ "), (F.col("s_suppkey") + 2147483648).cast("string"), F.lit(" Msg"), k, F.lit(": 8 Node"))
    line = F.concat(F.lit(" SG_ Sig"), k, F.lit(" : "), (F.col("s_suppkey") % 40).cast("string"), F.lit("|"), (F.col("s_suppkey") % 20 + 1).cast("string"), F.when(F.col("s_suppkey") % 2 == 0, "@1+").otherwise("@0-"), F.lit(' (0.5,-3) [0|100] "V" Node'))
    lines = s.select(k.alias("path"), F.posexplode(F.array(head, line)).alias("n", "value"))
    return dbc.signals(lines).select("message_id", "message", "signal", "start_bit", "size", "little_endian", "is_signed", "factor", "offset")


def asc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = event_samples(spark, sf_dir)
    frames = e.select((F.col("ord") / 4).alias("t"), F.lit("1").alias("bus"), F.col("user_id").alias("id"), F.unhex(F.lpad(F.hex("ord"), 4, "0")).alias("payload"), (F.col("ord") % 2 == 0).alias("is_tx"), (F.col("channel") == "view").alias("is_extended"), (F.col("channel") == "error").alias("is_error"))
    return sinks.asc_lines(frames).select("value")


def csv_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = event_samples(spark, sf_dir).select(F.col("ord").alias("event_id"), (F.col("ord") / 8).alias("t"))
    return sinks.csv_rows(e, start="2024-03-01 00:00:00")


def scrambled_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names made unreadable: of the same length, equal where they were equal, never the original."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name")
    s = sinks.scramble(p.withColumn("own", F.col("p_name")), ["p_name"], "salt")
    return s.groupBy("own").agg(F.countDistinct("p_name").alias("forms"), F.max((F.col("p_name") == F.col("own")).cast("int")).alias("readable"), F.max(F.length("p_name")).alias("size"))


def lin_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = event_samples(spark, sf_dir)
    frames = e.select("t", F.lit("LIN1").alias("bus"), (F.col("user_id") + 64).alias("id"), F.unhex(F.lpad(F.hex("ord"), 4, "0")).alias("payload"), F.when(F.col("channel") == "error", "LIN Checksum Error").alias("error_kind"))
    names = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("message_id"), F.col("n_name").alias("message"))
    return bus.lin_trace(frames, names)


def display_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments as XML, and texts decoded up to their first NUL."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    xml = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("<CNcomment><TX>"), F.col("n_name"), F.lit("</TX></CNcomment>"))).otherwise(F.col("n_name"))
    return n.select("n_nationkey", scalar.xml_comment(xml).alias("comment"), scalar.decoded(F.unhex(F.concat(F.hex(F.encode("n_name", "UTF-8")), F.lit("0041")))).alias("text"))


def value_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' last readings: numbers, then texts, then missing ones."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    shown = c.select("c_name", F.when(F.col("c_custkey") % 3 == 0, F.col("c_acctbal")).alias("number"), F.when(F.col("c_custkey") % 3 == 1, F.col("c_mktsegment")).alias("text"))
    return select.sort_by_value(shown, "number", "text", "c_name")


def clipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return userfn.clipped(event_samples(spark, sf_dir), 5.0, 50.0).select(F.col("ord").alias("event_id"), "v")


QUERIES = {f.__name__: f for f in [record_fields, record_ids, variable_length, virtual_master, dbc_signals, asc_lines, csv_dates, scrambled_names, lin_trace, display_texts, value_order, clipped]}

ORACLE_SQL = {
    "record_fields": "SELECT o_orderkey, o_orderkey AS key, CAST(round_even(o_totalprice * 100, 0) AS BIGINT) * CASE WHEN o_orderkey % 2 = 1 THEN -1 ELSE 1 END AS cents, o_orderkey % 3 = 0 AS cents_invalid, o_orderstatus AS status, o_custkey % 4096 AS customer FROM orders",
    "record_ids": "SELECT o_orderkey, o_orderkey % 65536 AS record_id, 15 AS size FROM orders",
    "variable_length": "SELECT p_partkey, p_name AS first, p_type AS second FROM part",
    "virtual_master": f"WITH {S} SELECT ord AS event_id, ord * 0.25::DOUBLE * 2 + 1 AS t FROM s",
    "dbc_signals": "SELECT s_suppkey AS message_id, 'Msg' || s_suppkey AS message, 'Sig' || s_suppkey AS signal, s_suppkey % 40 AS start_bit, s_suppkey % 20 + 1 AS size, s_suppkey % 2 = 0 AS little_endian, s_suppkey % 2 = 1 AS is_signed, 0.5::DOUBLE AS factor, -3.0::DOUBLE AS \"offset\" FROM supplier",
    "asc_lines": f"WITH {S} SELECT CASE WHEN channel = 'error' THEN printf('%12.6f %-2s ErrorFrame', ord / 4, '1') ELSE printf('%12.6f %-2s %-16s%s   d %d %s', ord / 4, '1', hex(user_id) || CASE WHEN channel = 'view' THEN 'x' ELSE '' END, CASE WHEN ord % 2 = 0 THEN 'Tx' ELSE 'Rx' END, len(h) // 2, rtrim(regexp_replace(h, '(..)', '\\1 ', 'g'))) END AS value FROM (SELECT *, CASE WHEN ord = 0 THEN '0000' ELSE lpad(hex(ord), 4, '0') END AS h FROM s)",
    "csv_dates": f"WITH {S} SELECT CAST(ord AS VARCHAR) AS event_id, strftime(TIMESTAMP '2024-03-01 00:00:00' + to_microseconds(ord * 125000), '%Y-%m-%d %H:%M:%S.%f') AS t FROM s",
    "scrambled_names": "SELECT p_name AS own, 1 AS forms, 0 AS readable, max(length(p_name)) AS size FROM part GROUP BY p_name",
    "lin_trace": f"WITH {S} SELECT t, 'LIN1' AS bus, (user_id + 64) & 63 AS id, coalesce(n_name, '') AS message, CASE WHEN channel = 'error' THEN 'LIN Checksum Error' ELSE 'LIN Frame' END AS event, 2 AS dlc, substr(lpad(hex(ord), 4, '0'), 1, 2) || ' ' || substr(lpad(hex(ord), 4, '0'), 3, 2) AS data FROM s LEFT JOIN nation ON n_nationkey = (user_id + 64) & 63",
    "display_texts": "SELECT n_nationkey, n_name AS comment, n_name AS text FROM nation",
    "value_order": "WITH c AS (SELECT c_name, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal END AS number, CASE WHEN c_custkey % 3 = 1 THEN c_mktsegment END AS text FROM customer) SELECT * FROM c ORDER BY CASE WHEN number IS NOT NULL THEN 0 WHEN text IS NOT NULL THEN 1 ELSE 2 END, number, text, c_name",
    "clipped": f"WITH {S} SELECT ord AS event_id, greatest(least(v, 50), 5) AS v FROM s",
}
