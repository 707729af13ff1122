"""Queries on merging, statistics, selection, conversions and bus decoding, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import convert as cv
from ..functions import scalar, userfn
from ..model import DAY, event_samples
from ..operators import bus, frame, merge, select, stats
from .alignment import LINEAR, START, STOP, S

BASE = 1704067200000000  # 2024-01-01 in microseconds
WEEK = 7 * DAY


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of each week as a recording of its own, with stamps from its first one."""
    s = event_samples(spark, sf_dir).withColumn("measurement_id", F.floor((F.col("t") - F.lit(BASE)) / WEEK).cast("int"))
    return s.withColumn("t", F.col("t") - F.lit(BASE) - F.col("measurement_id") * F.lit(WEEK))


def _starts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, i, i * WEEK) for i in range(5)], "measurement_id int, position int, start long")


def concat_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.concatenate(_files(spark, sf_dir), _starts(spark)).select("measurement_id", F.col("ord").alias("event_id"), "t", "v")


def concat_continuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.concatenate(_files(spark, sf_dir), _starts(spark), sync=False, direct=True).select("measurement_id", F.col("ord").alias("event_id"), "t", "v")


def samples_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = merge.with_origin(_files(spark, sf_dir).withColumnRenamed("measurement_id", "samples_origin"), [f"week{i}.mf4" for i in range(5)])
    return out.select(F.col("ord").alias("event_id"), "samples_origin", "samples_origin_name")


def stack_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations and regions as channel groups side by side."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_regionkey").cast("int").alias("group_index"), F.col("n_name").alias("name"))
    r = spark.read.parquet(f"{sf_dir}/region.parquet").select(F.lit(0).alias("group_index"), F.col("r_name").alias("name"))
    return merge.stack([(n, 5), (r, 1)])


def structure_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = event_samples(spark, sf_dir)
    one, two = (e.where(F.col("user_id") % 2 == i).groupBy("channel").agg((F.count(F.lit(1)) % 3).alias("layout")) for i in (0, 1))
    return merge.same_structure(one, two, ["channel", "layout"])


def extend_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _files(spark, sf_dir).select("channel", "ord", "t", "v", "measurement_id")
    return merge.extend(s.where("measurement_id = 0").drop("measurement_id"), s.where("measurement_id = 1").drop("measurement_id"), ["channel"]).select("channel", F.col("ord").alias("event_id"), "t", "v")


def file_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _files(spark, sf_dir)
    m = _starts(spark).select("measurement_id", F.when(F.col("position") != 2, -F.col("start")).alias("start_time"))
    return merge.file_order(s, m).select("measurement_id", "position", "first_t")


STATS = ["n", "min", "max", "first", "last", "delta"]


def _shown(out: DataFrame, keys: list[str]) -> DataFrame:
    return out.select(*keys, *STATS[:5], F.round("delta", 6).alias("delta"), *[F.round(F.col(c) + 1e-9, 4).alias(c) for c in ("mean", "rms", "std", "span")], F.round(F.col("integral") + 1e-5, 1).alias("integral"), F.round(F.col("gradient") * 1e6, 3).alias("gradient"))


def stats_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(stats.summary(event_samples(spark, sf_dir), ["channel", "user_id"]), ["channel", "user_id"])


def stats_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(stats.region_summary(event_samples(spark, sf_dir), ["channel"], START, STOP), ["channel"])


def shared_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stats.summary(event_samples(spark, sf_dir), ["channel"]).withColumn("axis", F.substring("channel", 1, 1))
    return stats.shared_range(s, "axis")


def group_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_samples(spark, sf_dir).groupBy("channel").agg(F.min("t").alias("first"), F.max("t").alias("last"), F.count(F.lit(1)).alias("cycles"))


def interval_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.interval_median(event_samples(spark, sf_dir), ["channel"])


def plot_minmax_downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = stats.numbered(event_samples(spark, sf_dir), ["channel"])
    return stats.reduce_for_plot(numbered, ["channel"], 50)


def record_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.record_slice(stats.numbered(event_samples(spark, sf_dir), ["channel"]), 100, 50).select("channel", "ordinal", F.col("ord").alias("event_id"), "v")


def periodogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = event_samples(spark, sf_dir).withColumn("t", (F.col("t") - F.lit(BASE)) / 1e6 / 3600)
    return stats.periodogram(s, ["channel"], 0.01, 0.5, 8).select("channel", F.round("frequency", 6).alias("frequency"), F.round("power", 6).alias("power"))


def downcast_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest type for each integer column of line items, from one pass of minima and maxima."""
    columns = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    low = spark.read.parquet(f"{sf_dir}/lineitem.parquet").agg(*[f(c).cast("long").alias(f"{c}_{f.__name__}") for c in columns for f in (F.min, F.max)]).first()
    return spark.createDataFrame([(c, low[f"{c}_min"], low[f"{c}_max"], stats.downcast_type(low[f"{c}_min"], low[f"{c}_max"], False)) for c in columns], "name string, low long, high long, type string")


def _search(pattern: str, mode: str, ignore_case: bool, name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name")
        return parts.where(select.name_matches("p_name", pattern, mode, ignore_case))

    query.__name__ = name
    return query


def pattern_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as channels: those that contain a value, those that don't hold it throughout, and those that are constant."""
    s = event_samples(spark, sf_dir).withColumn("v", F.floor("v"))
    out = [select.by_values(s, ["user_id"], 12.0, m).withColumn("mode", F.lit(m)) for m in ("contains", "contains_not", "constant")]
    return out[0].unionByName(out[1]).unionByName(out[2])


def select_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channels by a list of requests, one of them twice, under the names asked for."""
    s = event_samples(spark, sf_dir).withColumnRenamed("channel", "channel_index")
    catalogue = s.select("channel_index").distinct().withColumn("name", F.upper("channel_index"))
    wanted = spark.createDataFrame([(0, "speed", "click"), (1, None, "view"), (2, "again", "click")], "position int, requested string, channel_index string")
    return select.select(s, catalogue, wanted, ["channel_index"]).select("position", "name", F.col("ord").alias("event_id"), "v")


def filter_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = spark.createDataFrame([("click",), ("click",), ("error",)], "channel string")
    return select.keep_channels(event_samples(spark, sf_dir), wanted, ["channel"]).select("channel", F.col("ord").alias("event_id"))


def where_is(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").join(spark.read.parquet(f"{sf_dir}/nation.parquet"), F.col("s_nationkey") == F.col("n_nationkey"))
    catalogue = s.select("s_suppkey", F.concat_ws("\\", F.concat(F.lit("sig"), (F.col("s_suppkey") % 10).cast("string")), "n_name").alias("name"), F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").cast("string").alias("path")).alias("source"))
    return select.where_is(catalogue, "sig3", source_path="1").select("s_suppkey", "name")


def filter_and_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_returnflag")
    return select.filter_rows(rows, [("", "l_quantity", ">=", 45.0), ("AND", "l_discount", "<", 0.03), ("OR", "l_returnflag", "==", "R"), ("AND", "l_quantity", "<=", 2.0), ("AND", "l_discount", "!=", float("nan"))])


def range_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    label = select.first_range(F.col("o_totalprice"), [(0, "<", "<", 50000, "low"), (50000, "<=", "<=", 150000, "middle"), (None, "<", ">", 300000, "peak"), (100000, "<", None, None, "high")])
    return o.select("o_orderkey", label.alias("label"))


def next_different(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = event_samples(spark, sf_dir)
    out = [select.next_different(s, ["user_id"], START, m, m != "lower").withColumn("mode", F.lit(m)) for m in ("higher", "lower", "different")]
    return out[0].unionByName(out[1]).unionByName(out[2])


def next_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = event_samples(spark, sf_dir)
    a = select.next_match(s, "channel", START, F.col("v") > 60).withColumn("way", F.lit("forward"))
    return a.unionByName(select.next_match(s, "channel", START, F.col("v") > 60, False).withColumn("way", F.lit("backward")))


def step_stamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = event_samples(spark, sf_dir)
    return select.step_stamp(s, START, 5).withColumn("k", F.lit(5)).unionByName(select.step_stamp(s, START, -5).withColumn("k", F.lit(-5)))


def natural_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by the natural order of their brands, with the key that they are sorted by."""
    names = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.col("p_brand").alias("name"))
    return names.withColumn("key", F.array_join(select.natural_key("name"), "")).orderBy("key", "p_partkey")


def conv_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = event_samples(spark, sf_dir)
    return e.select(F.col("ord").alias("event_id"), F.round(cv.convert(F.col("v"), {"type": "linear", "a": 1.8, "b": 32}), 6).alias("phys"), F.round(cv.convert(cv.convert(F.col("v"), {"type": "linear", "a": 4, "b": -0.5}), cv.inverse({"type": "linear", "a": 4, "b": -0.5})), 9).alias("back"))


def conv_rational(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = event_samples(spark, sf_dir)
    return e.select(F.col("ord").alias("event_id"), F.round(cv.rational(F.col("v"), (1, 2, 3, 0, 1, 4)), 6).alias("phys"), F.round(cv.rational(F.col("v"), (0, 5, -0.5, 0, 0, 2)), 6).alias("short"))


def conv_formula(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = event_samples(spark, sf_dir)
    return e.select(F.col("ord").alias("event_id"), F.round(cv.formula(F.col("v"), "3 * sin(X) + (X1 - 2) ^ 2 / 7 - sqrt(X)"), 6).alias("phys"))


RAW, PHYS = [0, 10, 20, 50, 100], [0.0, 1.0, 4.0, 10.0, 12.5]


def conv_tab_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return p.select("p_partkey", cv.table(F.col("p_size"), RAW, PHYS, False).alias("phys"))


def conv_tabi(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = event_samples(spark, sf_dir)
    return e.select(F.col("ord").alias("event_id"), F.round(cv.table(F.col("v"), RAW, PHYS, True), 6).alias("phys"))


def conv_rtab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges to values: closed for integers, open above for floats; a default outside."""
    rows = [(0, 9, 100.0), (10, 19, 200.0), (20, 29, 300.0)]
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return p.select("p_partkey", cv.ranges(F.col("p_size"), rows, -1.0, True).alias("whole"), cv.ranges(F.col("p_retailprice") % 40, rows, -1.0, False).alias("real"))


def conv_value2text(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    conversion = {"type": "value_to_text", "rows": {i: f"nation {i}" for i in range(0, 20)}, "default": "other"}
    number, text = cv.convert_mixed(F.col("c_nationkey"), {0: "zero", 1: {"type": "linear", "a": 10, "b": 1}, 2: "two"}, {"type": "linear", "a": 2, "b": 0})
    return c.select("c_custkey", cv.convert(F.col("c_nationkey"), conversion).alias("phys"), F.nanvl(number, F.lit(None)).alias("number"), text.alias("text"))


def conv_range2text(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    rows = [(0, 10, "few"), (10, 25, "some"), (25, 40, "many")]
    return li.select("l_orderkey", "l_linenumber", cv.convert(F.col("l_quantity"), {"type": "range_to_text", "rows": rows, "default": "most"}).alias("phys"))


def conv_trans(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return li.select("l_orderkey", "l_linenumber", cv.convert(F.col("l_returnflag"), {"type": "text_to_text", "rows": {"A": "accepted", "R": "returned"}}).alias("text"), cv.convert(F.col("l_linestatus"), {"type": "text_to_value", "rows": {"O": 1.0, "F": 2.0}, "default": 0.0}).alias("value"))


def conv_bitfield(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    parts = [(3, {0: "off", 1: "on", 2: "fault"}, "state"), (12, {4: "left", 8: "right"}, None), (240, {}, "none")]
    return o.select("o_orderkey", cv.bitfield(F.col("o_orderkey"), parts).alias("text"))


def conv_exponential(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = event_samples(spark, sf_dir)
    p = (2.0, 3.0, 1.0, 0.0, 1.0, 0.01, 4.0)
    return e.select(F.col("ord").alias("event_id"), F.round(cv.exponential(F.col("v"), p, False), 9).alias("expo"), F.round(cv.exponential(F.col("v") + 500, (2.0, 3.0, 1.0, 0.0, 1.0, 0.5, 4.0), True), 9).alias("logh"), F.round(cv.polynomial(F.col("v"), (1, 2, 3, 4, 5, 6)), 6).alias("poly"))


def conv_by_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value-to-text table of any size: nations' names by key."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey")
    keys = spark.read.parquet(f"{sf_dir}/nation.parquet").where("n_nationkey < 20").select(F.col("n_nationkey").alias("raw_key"), F.col("n_name").alias("result"))
    return cv.convert_by_table(c, "c_nationkey", keys, F.lit("unknown"))


def conv_struct(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", F.struct(F.col("l_quantity").alias("q"), F.col("l_tax").alias("t")).alias("s"))
    out = cv.convert_struct(li, "s", {"q": {"type": "linear", "a": 2, "b": 1}, "t": {"type": "linear", "a": 100, "b": 0}})
    return out.select("l_orderkey", "l_linenumber", "s.q", F.round("s.t", 6).alias("t"))


def hex_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    k = F.col("o_orderkey")
    return o.select("o_orderkey", scalar.as_hex(k, 8).alias("hex"), scalar.as_bin(k.bitwiseAND(F.lit(0xFFF)), 12).alias("bin"), scalar.spaced_hex(F.encode("o_orderpriority", "UTF-8"), F.lit(3)).alias("bytes"), scalar.ascii_text(k % 140).alias("ascii"))


def rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    x = F.col("l_extendedprice") * F.col("l_discount") - 500
    return li.select("l_orderkey", "l_linenumber", scalar.round_half_even(F.col("l_quantity") / 8, 1).alias("even"), scalar.clip(F.col("l_quantity"), 10, 30).alias("clipped"), F.round(scalar.modulo(x, F.lit(7.5)), 4).alias("rest"), scalar.signed(F.col("l_partkey"), 7).alias("signed"), F.bitwise_not(F.shiftleft("l_suppkey", 2)).alias("bits"))


def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    name = F.concat_ws(".", F.col("p_size").cast("string"), "p_name", "p_brand")
    return p.select("p_partkey", scalar.matlab_name(name).alias("matlab"), scalar.query_name(name).alias("query"))


def message_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trace table of events as frames: names by id where they are known."""
    e = event_samples(spark, sf_dir)
    frames = e.select("t", F.lit("CAN1").alias("bus"), (F.col("user_id") + F.lit(0x60000000)).alias("id"), F.unhex(F.lpad(F.hex("ord"), 8, "0")).alias("payload"), (F.col("channel") == "error").alias("is_error"), (F.col("channel") == "view").alias("is_remote"), F.lit(False).alias("is_fd"), (F.col("ord") % 7).cast("int").alias("error_type"), (F.col("ord") % 2 == 0).alias("is_tx"))
    names = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("message_id"), F.col("s_name").alias("message"))
    return bus.trace(frames, names)


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as eight-byte frames: the event's number in the low four bytes, little-endian, the value's hundredths above, big-endian."""
    e = event_samples(spark, sf_dir)
    low = F.concat(*[F.lpad(F.hex(F.shiftright("ord", 8 * i).bitwiseAND(F.lit(255))), 2, "0") for i in range(4)])
    return e.select(F.concat(F.lit("CAN"), (F.col("user_id") % 2 + 1).cast("string")).alias("bus"), (F.col("user_id") % 5).alias("id"), "t", "ord", F.unhex(F.concat(low, F.lpad(F.hex(F.rint(F.col("v") * 100).cast("long")), 8, "0"))).alias("payload"))


SIGNALS = "message_id long, message string, signal string, start_bit int, size int, little_endian boolean, is_signed boolean, is_float boolean, factor double, offset double, mux string, mux_min long, mux_max long, j1939 boolean"
DEFINED = [
    (1, "Engine", "number", 0, 32, True, False, False, 1.0, 0.0, None, None, None, False),
    (1, "Engine", "value", 39, 32, False, False, False, 0.01, 0.0, None, None, None, False),
    (1, "Engine", "odd_bits", 3, 11, True, True, False, 1.0, 0.0, None, None, None, False),
    (2, "Gear", "which", 0, 2, True, False, False, 1.0, 0.0, None, None, None, False),
    (2, "Gear", "when_one", 8, 8, True, False, False, 2.0, -1.0, "which", 1, 1, False),
    (2, "Gear", "when_two_or_three", 58, 5, False, False, False, 1.0, 0.0, "which", 2, 3, False),
    (3, "Brake", "flag", 0, 8, True, False, False, 1.0, 0.0, None, None, None, True),
]


def mux_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bus.decode(_frames(spark, sf_dir), spark.createDataFrame(DEFINED, SIGNALS))
    return out.select("bus", "message", "signal", "t", "raw", F.round("v", 4).alias("v"), "invalid")


def bus_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bus.bus_signal(bus.without_dead_channels(bus.decode(_frames(spark, sf_dir), spark.createDataFrame(DEFINED, SIGNALS)), ["bus", "message", "signal"]), "CAN1.Engine.number")
    return out.select("t", "raw")


def bus_id_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bus.id_summary(_frames(spark, sf_dir), spark.createDataFrame(DEFINED, SIGNALS).select("message_id"))


def isotp_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order as a message of 20 bytes in three frames; every fifth one lacks its last frame."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.rpad(F.hex(F.encode(F.concat_ws("-", F.col("o_orderkey").cast("string"), "o_orderpriority"), "UTF-8")), 40, "2E").alias("h"))
    part = lambda i: F.concat(F.lit(["1014", "21", "22"][i]), F.substring("h", [1, 13, 27][i], [12, 14, 14][i]))
    f = o.select("o_orderkey", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), part(i).alias("p")) for i in range(3)])).alias("x")).where("NOT (o_orderkey % 5 = 0 AND x.i = 2)")
    frames = f.select((F.col("o_orderkey") % 3).alias("id"), (F.col("o_orderkey") * 1_000_000 + F.col("x.i")).alias("t"), F.col("x.i").cast("long").alias("ord"), F.unhex("x.p").alias("payload"))
    return bus.merge_transport(frames, ["id"]).select("id", "t", "size", F.hex("payload").alias("payload"))


def j1939_invalid(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    return p.select("p_partkey", (F.col("p_partkey") % 256 > bus.max_valid(F.lit(8))).alias("byte_invalid"), (F.col("p_partkey") % 16 > bus.max_valid(F.lit(3))).alias("nibble_invalid"), (F.col("p_partkey") * 7 % 4096 > bus.max_valid(F.lit(11))).alias("twelve_invalid"), bus.defined_bits(F.col("p_partkey") % 40).cast("long").alias("width"))


def computed_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function per sample over clicks and views on the stamps of clicks; failures are NaN, shown as null."""
    s = event_samples(spark, sf_dir)
    both = userfn.aligned({"a": s.where("channel = 'click'"), "b": s.where("channel = 'view'")}, ["user_id"], trigger="a")

    def ratio(a=0, b=1, t=0):
        return a / (0 if a < 5 else b)

    return userfn.per_sample(both, ratio).select("user_id", "t", F.round(F.nanvl("v", F.lit(None)), 6).alias("v"))


def computed_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function over whole channels: differences, one sample shorter."""
    s = event_samples(spark, sf_dir).where("channel = 'click'")

    def steps(v=0, t=0):
        return v[1:] - v[:-1]

    return userfn.per_channel(s, ["user_id"], steps).select("user_id", "t", F.round("v", 6).alias("v"))


def time_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return userfn.shifted(event_samples(spark, sf_dir), F.when(F.col("channel") == "click", 1500).otherwise(-250)).select(F.col("ord").alias("event_id"), "t")


def top_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten greatest values."""
    return event_samples(spark, sf_dir).orderBy(F.col("v").desc(), "ord").limit(10).select(F.col("ord").alias("event_id"), "v")


def zero_for_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A channel without samples in a minute counts as zero."""
    s = event_samples(spark, sf_dir).withColumn("t", F.floor(F.col("t") / 3_600_000_000))
    return frame.wide_exact(s, [], "channel", ["click", "view"]).fillna(0.0, ["click", "view"])


def array_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as 8 x 8 maps: their diagonal and their row sums."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("size(embedding) = 64")
    rows = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("embedding", i * 8 + 1, F.lit(8)))
    return e.select("vec_id", F.round(F.aggregate(F.sequence(F.lit(0), F.lit(7)), F.lit(0.0), lambda a, i: a + F.get(F.get(rows, i), i).cast("double")), 6).alias("trace"), F.round(F.aggregate(F.get(rows, F.lit(3)), F.lit(0.0), lambda a, x: a + x.cast("double")), 6).alias("row3"))


QUERIES = {f.__name__: f for f in [concat_sync, concat_continuation, samples_origin, stack_groups, structure_difference, extend_signal, file_order, stats_overall, stats_region, shared_range, group_spans, interval_median, plot_minmax_downsample, record_slice, periodogram, downcast_minmax, _search("red", "plain", False, "search_plain"), _search("^(RED|blue) .*t$", "regex", True, "search_regex"), _search("s*l b*t", "wildcard", False, "search_wildcard"), pattern_values, select_channels, filter_channels, where_is, filter_and_or, range_colours, next_different, next_match, step_stamp, natural_sort, conv_linear, conv_rational, conv_formula, conv_tab_nearest, conv_tabi, conv_rtab, conv_value2text, conv_range2text, conv_trans, conv_bitfield, conv_exponential, conv_by_table, conv_struct, hex_format, rounding, safe_names, message_names, mux_decode, bus_signal, bus_id_summary, isotp_merge, j1939_invalid, computed_channel, computed_whole, time_shift, top_values, zero_for_empty, array_axes]}

_F = f"{S}, f AS (SELECT channel, user_id, ord, (t - {BASE}) // {WEEK} AS m, (t - {BASE}) % {WEEK} AS t, v FROM s)"
_STAT = """p AS (SELECT *, lag(t) OVER w AS pt, lag(v) OVER w AS pv FROM x WINDOW w AS (PARTITION BY {k} ORDER BY t, ord)),
g AS (SELECT {k}, count(*) AS n, min(v) AS min, max(v) AS max, arg_min(v, t) AS first, arg_max(v, t) AS last, avg(v) AS mean, sqrt(avg(v * v)) AS rms, stddev_pop(v) AS std, (max(t) - min(t)) / 1000000 AS span, coalesce(sum((t - pt) / 1000000 * (v + pv) / 2), 0) AS integral FROM p GROUP BY {k})
SELECT {k}, n, min, max, first, last, round(last - first, 6) AS delta, round(mean + 1e-9, 4) AS mean, round(rms + 1e-9, 4) AS rms, round(std + 1e-9, 4) AS std, round(span + 1e-9, 4) AS span, round(integral + 1e-5, 1) AS integral, round(coalesce((last - first) / nullif(span, 0), 0) * 1000000, 3) AS gradient FROM g"""
_LE = "(CAST('0x' || {h} AS BIGINT))"
_FR = f"WITH {S}, f AS (SELECT 'CAN' || (user_id % 2 + 1) AS bus, user_id % 5 AS id, t, ord, CAST(round_even(v * 100, 0) AS BIGINT) AS c FROM s)"
_TAB = "CASE WHEN x <= 0 THEN 0.0 WHEN x < 10 THEN {a} WHEN x < 20 THEN {b} WHEN x < 50 THEN {c} WHEN x < 100 THEN {d} ELSE 12.5 END"

ORACLE_SQL = {
    "concat_sync": f"WITH {_F} SELECT m AS measurement_id, ord AS event_id, t + m * {WEEK} AS t, v FROM f",
    "concat_continuation": f"WITH RECURSIVE {_F}, e AS (SELECT m, min(t) AS lo, max(t) AS hi, (SELECT min(g.t) FROM f g WHERE g.m = f.m AND g.t > (SELECT min(h.t) FROM f h WHERE h.m = f.m)) AS second FROM f GROUP BY m), r AS (SELECT m, 0::BIGINT AS shift, hi AS last FROM e WHERE m = 0 UNION ALL SELECT e.m, r.last + (e.second - e.lo) - e.lo, e.hi + r.last + (e.second - e.lo) - e.lo FROM r JOIN e ON e.m = r.m + 1) SELECT f.m AS measurement_id, ord AS event_id, t + shift AS t, v FROM f JOIN r ON f.m = r.m",
    "samples_origin": f"WITH {_F} SELECT ord AS event_id, m AS samples_origin, 'week' || m || '.mf4' AS samples_origin_name FROM f",
    "stack_groups": "SELECT n_regionkey AS group_index, n_name AS name FROM nation UNION ALL SELECT 5, r_name FROM region",
    "structure_difference": f"WITH {S}, a AS (SELECT channel, count(*) FILTER (user_id % 2 = 0) % 3 AS l, count(*) FILTER (user_id % 2 = 1) % 3 AS r FROM s GROUP BY channel) SELECT channel, l AS layout, 'left' AS side FROM a WHERE l <> r UNION ALL SELECT channel, r, 'right' FROM a WHERE l <> r",
    "extend_signal": f"WITH {_F}, l AS (SELECT channel, max(t) FILTER (m = 0) AS last, min(t) FILTER (m = 1) AS start FROM f GROUP BY channel) SELECT channel, ord AS event_id, CASE WHEN m = 1 AND start <= last THEN t + last ELSE t END AS t, v FROM f JOIN l USING (channel) WHERE m IN (0, 1)",
    "file_order": f"WITH {_F}, g AS (SELECT m, min(t) AS first_t FROM f GROUP BY m), a AS (SELECT i AS m, CASE WHEN i <> 2 THEN -i * {WEEK} END AS st FROM range(5) r(i)) SELECT m AS measurement_id, row_number() OVER (ORDER BY st NULLS LAST, first_t, m) - 1 AS position, first_t FROM a LEFT JOIN g USING (m)",
    "stats_overall": f"WITH {S}, x AS (SELECT * FROM s), " + _STAT.format(k="channel, user_id"),
    "stats_region": f"""WITH {S}, sp AS (SELECT channel, min(t) AS lo, max(t) AS hi FROM s GROUP BY 1), p0 AS (SELECT channel, b AS t FROM sp, (VALUES ({START}), ({STOP})) v(b) WHERE b > lo AND b < hi),
nn AS (SELECT p.*, b.t AS bt, b.v AS bv, a.t AS nt, a.v AS av FROM p0 p ASOF LEFT JOIN s b ON p.channel = b.channel AND p.t >= b.t ASOF LEFT JOIN s a ON p.channel = a.channel AND p.t < a.t),
x AS (SELECT channel, 0 AS ord, t, v FROM s WHERE t BETWEEN {START} AND {STOP} UNION ALL SELECT channel, 0, t, {LINEAR} FROM nn WHERE bt <> t), """ + _STAT.format(k="channel"),
    "shared_range": f"WITH {S} SELECT substr(channel, 1, 1) AS axis, min(v) AS low, max(v) AS high FROM s GROUP BY 1",
    "group_spans": f"WITH {S} SELECT channel, min(t) AS first, max(t) AS last, count(*) AS cycles FROM s GROUP BY 1",
    "interval_median": f"WITH {S}, d AS (SELECT channel, t - lag(t) OVER (PARTITION BY channel ORDER BY t, ord) AS d FROM s) SELECT channel, CAST(quantile_cont(d, 0.5) AS DOUBLE) AS median_interval FROM d WHERE d IS NOT NULL GROUP BY 1",
    "plot_minmax_downsample": f"WITH {S}, o AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY t, ord) - 1 AS ordinal FROM s), r AS (SELECT *, ordinal // 50 AS pixel FROM o), q AS (SELECT *, row_number() OVER (PARTITION BY channel, pixel ORDER BY v, ordinal) AS a, row_number() OVER (PARTITION BY channel, pixel ORDER BY v DESC, ordinal) AS b FROM r) SELECT channel, pixel, ordinal, t, v FROM q WHERE a = 1 OR b = 1",
    "record_slice": f"WITH {S}, o AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY t, ord) - 1 AS ordinal FROM s) SELECT channel, ordinal, ord AS event_id, v FROM o WHERE ordinal BETWEEN 100 AND 149",
    "periodogram": f"""WITH {S}, m AS (SELECT channel, avg(v) AS m FROM s GROUP BY 1), x AS (SELECT s.channel, 0.01 + i * ((0.5 - 0.01) / 7) AS f, (t - {BASE}) / 1e6 / 3600 AS t, v - m AS v FROM s JOIN m USING (channel), range(8) r(i)),
a AS (SELECT channel, f, sum(v * cos(2 * pi() * f * t)) AS vc, sum(v * sin(2 * pi() * f * t)) AS vs, sum(cos(2 * pi() * f * t) ** 2) AS cc, sum(sin(2 * pi() * f * t) ** 2) AS ss, sum(cos(2 * pi() * f * t) * sin(2 * pi() * f * t)) AS cs, sum(v * v) AS vv FROM x GROUP BY 1, 2),
b AS (SELECT *, cos(atan2(2 * cs, cc - ss) / 2) AS ct, sin(atan2(2 * cs, cc - ss) / 2) AS st FROM a)
SELECT channel, round(f, 6) AS frequency, round(((ct * vc + st * vs) ** 2 / (ct * ct * cc + 2 * ct * st * cs + st * st * ss) + (ct * vs - st * vc) ** 2 / (ct * ct * ss - 2 * ct * st * cs + st * st * cc)) / vv, 6) AS power FROM b""",
    "downcast_minmax": "WITH a AS (SELECT unnest([{'name': 'l_orderkey', 'low': min(l_orderkey), 'high': max(l_orderkey)}, {'name': 'l_partkey', 'low': min(l_partkey), 'high': max(l_partkey)}, {'name': 'l_suppkey', 'low': min(l_suppkey), 'high': max(l_suppkey)}, {'name': 'l_linenumber', 'low': min(l_linenumber), 'high': max(l_linenumber)}], recursive := true) FROM lineitem) SELECT name, low, high, CASE WHEN high < 255 THEN 'smallint' WHEN high < 65535 THEN 'int' WHEN high < 4294967295 THEN 'bigint' ELSE 'decimal(20,0)' END AS type FROM a",
    "search_plain": "SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'red')",
    "search_regex": "SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '(?i)^(RED|blue) .*t$')",
    "search_wildcard": "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%s%l b%t%'",
    "pattern_values": f"WITH {S}, c AS (SELECT user_id, abs(floor(v) - 12) <= 1e-8 + 1e-5 * 12 AS ok FROM s), g AS (SELECT user_id, bool_or(ok) AS o, bool_and(ok) AS a FROM c GROUP BY 1) SELECT user_id, 'contains' AS mode FROM g WHERE o UNION ALL SELECT user_id, 'contains_not' FROM g WHERE NOT a UNION ALL SELECT user_id, 'constant' FROM g WHERE a",
    "select_channels": f"WITH {S}, w(position, name, c) AS (VALUES (0, 'speed', 'click'), (1, 'VIEW', 'view'), (2, 'again', 'click')) SELECT position, name, ord AS event_id, v FROM s JOIN w ON channel = c",
    "filter_channels": f"WITH {S} SELECT channel, ord AS event_id FROM s WHERE channel IN ('click', 'error')",
    "where_is": "SELECT s_suppkey, 'sig' || (s_suppkey % 10) || chr(92) || n_name AS name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 10 = 3 AND n_regionkey = 1",
    "filter_and_or": "SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_returnflag FROM lineitem WHERE (l_quantity >= 45 AND l_discount < 0.03) OR (l_returnflag = 'R' AND l_quantity <= 2)",
    "range_colours": "SELECT o_orderkey, CASE WHEN 0 < o_totalprice AND o_totalprice < 50000 THEN 'low' WHEN o_totalprice BETWEEN 50000 AND 150000 THEN 'middle' WHEN o_totalprice > 300000 THEN 'peak' WHEN o_totalprice > 100000 THEN 'high' END AS label FROM orders",
    "next_different": f"WITH {S}, c AS (SELECT user_id, arg_max(v, t) AS now FROM s WHERE t <= {START} GROUP BY 1), j AS (SELECT s.user_id, t, v, now FROM s JOIN c USING (user_id)) SELECT user_id, min(t) AS t, 'higher' AS mode FROM j WHERE t > {START} AND v > now GROUP BY 1 UNION ALL SELECT user_id, max(t), 'lower' FROM j WHERE t < {START} AND v < now GROUP BY 1 UNION ALL SELECT user_id, min(t), 'different' FROM j WHERE t > {START} AND v <> now GROUP BY 1",
    "next_match": f"WITH {S} SELECT min(t) AS t, arg_min(channel, t) AS channel, 'forward' AS way FROM s WHERE t > {START} AND v > 60 UNION ALL SELECT max(t), arg_max(channel, t), 'backward' FROM s WHERE t < {START} AND v > 60",
    "step_stamp": f"WITH {S} SELECT max(t) AS t, 5 AS k FROM (SELECT DISTINCT t FROM s WHERE t >= {START} ORDER BY t LIMIT 6) UNION ALL SELECT min(t), -5 FROM (SELECT DISTINCT t FROM s WHERE t < {START} ORDER BY t DESC LIMIT 5)",
    "natural_sort": "SELECT p_partkey, p_brand AS name, lower(regexp_extract(p_brand, '^[^0-9]+')) || lpad(regexp_extract(p_brand, '[0-9]+'), 20, '0') AS key FROM part",
    "conv_linear": f"WITH {S} SELECT ord AS event_id, round(v * 1.8::DOUBLE + 32, 6) AS phys, round((v * 4 - 0.5::DOUBLE) * 0.25 + 0.125, 9) AS back FROM s",
    "conv_rational": f"WITH {S} SELECT ord AS event_id, round((v * v + 2 * v + 3) / (v + 4), 6) AS phys, round((v * 5 - 0.5) / 2, 6) AS short FROM s",
    "conv_formula": f"WITH {S} SELECT ord AS event_id, round(3 * sin(v) + (v - 2) ** 2 / 7 - sqrt(v), 6) AS phys FROM s",
    "conv_tab_nearest": "SELECT p_partkey, " + _TAB.format(a="CASE WHEN x <= 5 THEN 0.0 ELSE 1.0 END", b="CASE WHEN x <= 15 THEN 1.0 ELSE 4.0 END", c="CASE WHEN x <= 35 THEN 4.0 ELSE 10.0 END", d="CASE WHEN x <= 75 THEN 10.0 ELSE 12.5 END") + " AS phys FROM (SELECT p_partkey, p_size AS x FROM part)",
    "conv_tabi": f"WITH {S} SELECT ord AS event_id, round(" + _TAB.format(a="x * 0.1::DOUBLE", b="(x - 10) * 0.3::DOUBLE + 1", c="(x - 20) * 0.2::DOUBLE + 4", d="(x - 50) * 0.05::DOUBLE + 10") + ", 6) AS phys FROM (SELECT ord, v AS x FROM s)",
    "conv_rtab": "SELECT p_partkey, CASE WHEN p_size BETWEEN 0 AND 9 THEN 100.0 WHEN p_size BETWEEN 10 AND 19 THEN 200.0 WHEN p_size BETWEEN 20 AND 29 THEN 300.0 ELSE -1.0 END AS whole, CASE WHEN x >= 0 AND x < 9 THEN 100.0 WHEN x >= 10 AND x < 19 THEN 200.0 WHEN x >= 20 AND x < 29 THEN 300.0 ELSE -1.0 END AS real FROM (SELECT *, p_retailprice % 40 AS x FROM part)",
    "conv_value2text": "SELECT c_custkey, CASE WHEN c_nationkey BETWEEN 0 AND 19 THEN 'nation ' || c_nationkey ELSE 'other' END AS phys, CASE c_nationkey WHEN 0 THEN NULL WHEN 1 THEN 11.0 WHEN 2 THEN NULL ELSE c_nationkey * 2.0 END AS number, CASE c_nationkey WHEN 0 THEN 'zero' WHEN 2 THEN 'two' END AS text FROM customer",
    "conv_range2text": "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity >= 0 AND l_quantity < 10 THEN 'few' WHEN l_quantity < 25 THEN 'some' WHEN l_quantity < 40 THEN 'many' ELSE 'most' END AS phys FROM lineitem",
    "conv_trans": "SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 'accepted' WHEN 'R' THEN 'returned' ELSE l_returnflag END AS text, CASE l_linestatus WHEN 'O' THEN 1.0 WHEN 'F' THEN 2.0 ELSE 0.0 END AS value FROM lineitem",
    "conv_bitfield": "SELECT o_orderkey, concat_ws('|', CASE o_orderkey & 3 WHEN 0 THEN 'state=off' WHEN 1 THEN 'state=on' WHEN 2 THEN 'state=fault' END, CASE o_orderkey & 12 WHEN 4 THEN 'left' WHEN 8 THEN 'right' END) AS text FROM orders",
    "conv_exponential": f"WITH {S} SELECT ord AS event_id, round(exp(((v - 4) * 0.01::DOUBLE - 1) / 2) / 3, 9) AS expo, round(ln(((v + 500 - 4) * 0.5::DOUBLE - 1) / 2) / 3, 9) AS logh, round((2 - 4 * (v - 11)) / (3 * (v - 11) - 1), 6) AS poly FROM s",
    "conv_by_table": "SELECT c_custkey, c_nationkey, coalesce(n_name, 'unknown') AS phys FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey < 20",
    "conv_struct": "SELECT l_orderkey, l_linenumber, l_quantity * 2 + 1 AS q, round(l_tax * 100, 6) AS t FROM lineitem",
    "hex_format": "SELECT o_orderkey, '0x' || lpad(hex(o_orderkey), 8, '0') AS hex, rtrim(regexp_replace(lpad(bin(o_orderkey & 4095), 12, '0'), '(.{4})', '\\1 ', 'g')) AS bin, rtrim(regexp_replace(hex(encode(substr(o_orderpriority, 1, 3))), '(..)', '\\1 ', 'g')) AS bytes, CASE WHEN o_orderkey % 140 BETWEEN 32 AND 126 THEN chr(CAST(o_orderkey % 140 AS INT)) ELSE CAST(o_orderkey % 140 AS VARCHAR) END AS ascii FROM orders",
    "rounding": "WITH x AS (SELECT *, l_extendedprice * l_discount - 500 AS x FROM lineitem) SELECT l_orderkey, l_linenumber, round_even(l_quantity / 8 * 10, 0) / 10 AS even, greatest(least(l_quantity, 30), 10) AS clipped, round(x - 7.5::DOUBLE * floor(x / 7.5::DOUBLE), 4) AS rest, CASE WHEN (l_partkey >> 6) & 1 = 1 THEN (l_partkey & 127) - 128 ELSE l_partkey & 127 END AS signed, ~(l_suppkey << 2) AS bits FROM x",
    "safe_names": "WITH n AS (SELECT p_partkey, regexp_replace(p_size || '.' || p_name || '.' || p_brand, '[^A-Za-z0-9_]', '_', 'g') AS n FROM part) SELECT p_partkey, substr('M_' || n, 1, 60) AS matlab, 'file_' || n AS query FROM n",
    "message_names": f"WITH {S} SELECT t, 'CAN1' AS bus, user_id AS id, coalesce(s_name, '') AS message, CASE channel WHEN 'error' THEN 'Error Frame' WHEN 'view' THEN 'Remote Frame' ELSE 'CAN Frame' END AS event, CASE WHEN channel <> 'error' THEN '' ELSE CASE ord % 7 WHEN 1 THEN 'BIT ERROR' WHEN 2 THEN 'FORM ERROR' WHEN 3 THEN 'BIT STUFFING ERROR' WHEN 4 THEN 'CRC ERROR' WHEN 5 THEN 'ACK ERROR' ELSE 'UNKNOWN' END END AS details, CASE WHEN ord % 2 = 0 THEN 'Tx' ELSE 'Rx' END AS direction, 4 AS dlc, rtrim(regexp_replace(lpad(hex(ord), 8, '0'), '(..)', '\\1 ', 'g')) AS data FROM s LEFT JOIN supplier ON s_suppkey = user_id",
    "mux_decode": _FR + """, d AS (SELECT bus, t, 'Engine' AS message, unnest([{'signal': 'number', 'raw': ord, 'v': CAST(ord AS DOUBLE)}, {'signal': 'value', 'raw': c, 'v': round(c * 0.01::DOUBLE, 4)}, {'signal': 'odd_bits', 'raw': CASE WHEN (ord >> 3) & 2047 >= 1024 THEN ((ord >> 3) & 2047) - 2048 ELSE (ord >> 3) & 2047 END, 'v': CAST(CASE WHEN (ord >> 3) & 2047 >= 1024 THEN ((ord >> 3) & 2047) - 2048 ELSE (ord >> 3) & 2047 END AS DOUBLE)}], recursive := true), FALSE AS invalid FROM f WHERE id = 1
UNION ALL SELECT bus, t, 'Gear', unnest([{'signal': 'which', 'raw': ord & 3, 'v': CAST(ord & 3 AS DOUBLE)}, {'signal': 'when_one', 'raw': CASE WHEN ord & 3 = 1 THEN (ord >> 8) & 255 END, 'v': ((ord >> 8) & 255) * 2.0::DOUBLE - 1}, {'signal': 'when_two_or_three', 'raw': CASE WHEN ord & 3 >= 2 THEN ((c & 7) << 2) + 3 END, 'v': CAST(((c & 7) << 2) + 3 AS DOUBLE)}], recursive := true), FALSE FROM f WHERE id = 2
UNION ALL SELECT bus, t, 'Brake', 'flag', ord & 255, CAST(ord & 255 AS DOUBLE), ord & 255 > 250 FROM f WHERE id = 3) SELECT * FROM d WHERE raw IS NOT NULL""",
    "bus_signal": _FR + " SELECT t, ord AS raw FROM f WHERE id = 1 AND bus = 'CAN1'",
    "bus_id_summary": _FR + " SELECT bus, count(DISTINCT id) AS ids, count(DISTINCT id) FILTER (id IN (1, 2, 3)) AS known, count(DISTINCT id) FILTER (id NOT IN (1, 2, 3)) AS unknown FROM f GROUP BY bus",
    "isotp_merge": "SELECT o_orderkey % 3 AS id, o_orderkey * 1000000 + 2 AS t, 20 AS size, substr(rpad(hex(encode(o_orderkey || '-' || o_orderpriority)), 40, '2E2E2E2E2E2E2E2E2E2E2E2E2E2E2E2E2E2E2E2E'), 1, 40) AS payload FROM orders WHERE o_orderkey % 5 <> 0",
    "j1939_invalid": "SELECT p_partkey, p_partkey % 256 > 250 AS byte_invalid, p_partkey % 16 > 10 AS nibble_invalid, p_partkey * 7 % 4096 > 4015 AS twelve_invalid, (SELECT min(w) FROM (VALUES (4), (8), (10), (12), (16), (20), (24), (28), (32), (64)) x(w) WHERE w >= p_partkey % 40)::BIGINT AS width FROM part",
    "computed_channel": f"WITH {S}, q AS (SELECT * FROM s WHERE channel = 'view'), p AS (SELECT DISTINCT user_id, t FROM s WHERE channel = 'click'), n AS (SELECT p.*, b.t AS bt, b.v AS bv, a.t AS nt, a.v AS av FROM p ASOF LEFT JOIN q b ON p.user_id = b.user_id AND p.t >= b.t ASOF LEFT JOIN q a ON p.user_id = a.user_id AND p.t < a.t), y AS (SELECT n.user_id, n.t, s.v AS a, {LINEAR.replace(' t ', ' n.t ').replace('= t', '= n.t').replace('(t AS', '(n.t AS')} AS b FROM n JOIN s ON s.user_id = n.user_id AND s.t = n.t AND channel = 'click') SELECT user_id, t, round(CASE WHEN a >= 5 THEN a / nullif(b, 0) END, 6) AS v FROM y",
    "computed_whole": f"WITH {S}, d AS (SELECT user_id, t, v - lag(v) OVER (PARTITION BY user_id ORDER BY t) AS d FROM s WHERE channel = 'click') SELECT user_id, t, round(d, 6) AS v FROM d WHERE d IS NOT NULL",
    "time_shift": f"WITH {S} SELECT ord AS event_id, t + CASE WHEN channel = 'click' THEN 1500 ELSE -250 END AS t FROM s",
    "top_values": f"WITH {S} SELECT ord AS event_id, v FROM s ORDER BY v DESC, ord LIMIT 10",
    "zero_for_empty": f"WITH {S} SELECT t // 3600000000 AS t, coalesce(arg_min(v, ord) FILTER (channel = 'click'), 0) AS click, coalesce(arg_min(v, ord) FILTER (channel = 'view'), 0) AS view FROM s GROUP BY 1",
    "array_axes": "SELECT vec_id, round(list_sum([CAST(embedding[i * 9 + 1] AS DOUBLE) for i in range(8)]), 6) AS trace, round(list_sum([CAST(x AS DOUBLE) for x in embedding[25:32]]), 6) AS row3 FROM embeddings WHERE len(embedding) = 64",
}
