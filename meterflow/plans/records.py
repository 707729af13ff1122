"""Queries on single channels, their records and groups, bus databases and traces, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import computed, convert, userfn
from ..model import event_samples
from ..operators import align, bus, frame, merge, resample, select
from ..sources import dbc, sinks
from .alignment import LINEAR, S, _two
from .measures import SIGNALS, _frames

START_S = 1704067200


def _catalogue(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Events as channel groups, one for each user modulo 7, a channel for each type: raw hundredths and physical values."""
    e = event_samples(spark, sf_dir)
    kinds = spark.createDataFrame([(i, n) for i, n in enumerate(["click", "error", "purchase", "signup", "view"])], "channel_index int, name string")
    groups = spark.range(7).select(F.col("id").cast("int").alias("group_index"))
    catalogue = groups.join(F.broadcast(kinds)).withColumn("is_master", F.lit(False))  # 35 rows
    s = e.withColumn("group_index", (F.col("user_id") % 7).cast("int")).join(kinds.withColumnRenamed("name", "channel"), "channel")
    return catalogue, s.select("group_index", "channel_index", "channel", F.col("ord").alias("ordinal"), "t", F.rint(F.col("v") * 100).alias("raw"), F.col("v").alias("physical"))


_CAT = f"WITH {S}, c AS (SELECT CAST(user_id % 7 AS INTEGER) AS group_index, CAST(list_position(['click', 'error', 'purchase', 'signup', 'view'], channel) - 1 AS INTEGER) AS channel_index, channel, ord AS ordinal, t, round_even(v * 100, 0) AS raw, v AS physical FROM s)"


def get_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One channel by name and group, its raw values, from record 100 on."""
    catalogue, s = _catalogue(spark, sf_dir)
    return select.get(s, catalogue, "view", group=3, raw=True, offset=100)


def get_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One channel by group and index on a raster of six hours."""
    catalogue, s = _catalogue(spark, sf_dir)
    seconds = s.withColumn("t", (F.col("t") - F.lit(START_S * 1_000_000)) / 1_000_000)
    return select.get(seconds, catalogue, group=2, index=0, raster=21600.0).select(F.round("t", 3).alias("t"), F.round("v", 4).alias("v"))


def raw_by_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, s = _catalogue(spark, sf_dir)
    return select.raw_or_physical(s, {"__default__": False, "click": True, "view": True}, "channel").select("ordinal", "v")


def group_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalogue, s = _catalogue(spark, sf_dir)
    return select.information(catalogue, s).withColumn("channels", F.array_join("channels", ","))


def trigger_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error events as triggers of their groups."""
    _, s = _catalogue(spark, sf_dir)
    events = s.where("channel = 'error'").select("group_index", "t", F.when(F.col("raw") > 0, F.col("physical")).alias("pre_time"), F.lit(None).cast("double").alias("post_time"))
    return select.triggers(events)


def longest_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_brand", F.col("p_name").alias("v"))
    return select.longest_value(p, ["p_brand"])


def missing_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name")
    return select.with_missing(n, ["n_name", "altitude"])


def edge_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with a status of their own kind, and the orders beside them."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.lit(0).alias("k"), F.col("o_orderkey").alias("ord"), (F.col("o_totalprice") > 400_000).alias("high"))
    return select.with_edges(o, ["k"], "high", bucket=1000).select(F.col("ord").alias("o_orderkey"), "high")


def next_rounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first purchase of more than 50 after a stamp, by stamps rounded to two decimals of an hour."""
    s = event_samples(spark, sf_dir).where("channel = 'purchase'").withColumn("t", (F.col("t") - F.lit(START_S * 1_000_000)) / 3_600_000_000)
    return select.next_match(s, "ord", 100.004, F.col("v") > 50, digits=2)


def append_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier balances as a new group behind the groups of events: the channels of both and how many samples they have."""
    catalogue, s = _catalogue(spark, sf_dir)
    p = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    values = p.select(F.lit(0).alias("channel_index"), F.lit("balance").alias("channel"), F.col("s_suppkey").alias("ordinal"), F.col("s_suppkey").alias("t"), F.col("s_acctbal").alias("raw"), F.col("s_acctbal").alias("physical"))
    channels = spark.createDataFrame([(0, "balance", False)], "channel_index int, name string, is_master boolean")
    all_channels, all_samples = merge.append_group(catalogue, s, channels, values)
    n = all_samples.groupBy("group_index", "channel_index").agg(F.count(F.lit(1)).alias("n"), F.max("physical").alias("top"))
    return all_channels.select("group_index", "channel_index", "name").join(n, ["group_index", "channel_index"], "left")


def append_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks numbered by user, and views as further records of the same channels."""
    clicks, views = _two(spark, sf_dir)
    numbered = lambda s: s.select("user_id", F.col("ord").alias("ordinal"), "t", "v")
    return merge.append_records(numbered(clicks), numbered(views), ["user_id"])


def stack_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks and views as recordings of which the second began 90 seconds after the first."""
    clicks, views = _two(spark, sf_dir)
    group = lambda s: s.select((F.col("user_id") % 4).alias("group_index"), "ord", "t")
    return merge.stack([(group(clicks), 4), (group(views), 4)], starts=[10_000_000, 100_000_000])


def scatter_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    clicks, views = _two(spark, sf_dir)
    return merge.scatter([clicks.select("t", F.col("v").alias("click")), views.select("t", F.col("ord").alias("view_id"))])


def xy_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """x and y of a plot on the union of their stamps."""
    clicks, views = _two(spark, sf_dir)
    stamps = align.union_timebase(clicks, views, keys=["user_id"])
    x = align.interpolate(clicks, stamps, ["user_id"]).withColumnRenamed("v", "x")
    return align.interpolate(views, x, ["user_id"]).select("user_id", "t", F.round("x", 6).alias("x"), F.round("v", 6).alias("y"))


def joint_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sum of two channels, of which every eleventh sample of either is flagged."""
    a, b = (s.withColumn("invalid", F.col("ord") % 11 == 0) for s in _two(spark, sf_dir))
    return align.combine(a, b, ["user_id"], "add", "S").select("user_id", "t", F.round("v", 4).alias("v"), "invalid")


def _bits(operator: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        a, b = (s.withColumn("v", F.floor(F.col("v")).cast("long")) for s in _two(spark, sf_dir))
        return align.combine(a, b, ["user_id"], operator, "i")

    query.__name__ = f"signal_{operator}"
    return query


def unary(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, _ = _two(spark, sf_dir)
    whole = a.withColumn("v", F.floor(F.col("v")) - 40)
    out = a.select(F.col("ord").alias("event_id"))
    for name in ("neg", "abs", "invert"):
        out = out.join(align.with_unary(whole, name).select(F.col("ord").alias("event_id"), F.col("v").alias(name)), "event_id")
    return out.join(align.with_scalar(whole.withColumn("v", F.col("v").cast("double")), "pow", 2.0).select(F.col("ord").alias("event_id"), F.col("v").alias("square")), "event_id")


def single_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older raster of single channels, over spans that are whole numbers of steps and others."""
    s = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_regionkey").alias("k"), F.col("n_nationkey").cast("double").alias("t"))
    whole = resample.raster_of_ratio(resample.spans(s, ["k"]), ["k"], 0.5).withColumn("step", F.lit(0.5))
    return whole.unionByName(resample.raster_of_ratio(resample.spans(s, ["k"]), ["k"], 0.75).withColumn("step", F.lit(0.75)))


DATABASE = """BO_ 1 Engine: 8 ECU
 SG_ number : 0|32@1+ (1,0) [0|0] "" X
 SG_ state : 0|2@1+ (1,0) [0|3] "" X
BO_ 2147483650 Gear: 8 ECU
 SG_ ratio : 32|32@1- (1,0) [0|0] "" X
 SG_ far : 60|8@1+ (1,0) [0|0] "" X
VAL_ 1 state 0 "off" 1 "on" 3 "error" ;
SIG_VALTYPE_ 2147483650 ratio : 1;
BA_ "ProtocolType" "J1939";
BA_ "VFrameFormat" BO_ 1 0;"""


def _database(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("db", i, x) for i, x in enumerate(DATABASE.split("\n"))], "path string, n int, value string")


def dbc_database(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a database says beside the fields: float types, J1939 by protocol and frame format, fields beyond their message, texts of values."""
    lines = _database(spark)
    s = dbc.signals(lines)
    far = bus.beyond_payload(s).select("message_id", "signal", F.lit(True).alias("beyond"))
    texts = dbc.values(lines).groupBy("message_id", "signal").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "value", "label"))), ",").alias("texts"))
    out = s.join(far, ["message_id", "signal"], "left").join(texts, ["message_id", "signal"], "left")
    return out.select("message_id", "signal", "is_extended", "is_float", "j1939", F.coalesce("beyond", F.lit(False)).alias("beyond"), F.coalesce("texts", F.lit("")).alias("texts"))


def bus_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of a signal with the texts of its value table, and a signal scaled by ranges of its raw values."""
    lines = _database(spark)
    samples = bus.decode(_frames(spark, sf_dir), dbc.signals(lines))
    ranges = spark.createDataFrame([(1, "number", 0, 99, 2.0, 1.0), (1, "number", 100, 4999, 0.5, 0.0)], "message_id long, signal string, low long, high long, factor double, offset double")
    out = bus.labelled(bus.scaled(samples.where("message = 'Engine'"), ranges), dbc.values(lines))
    return out.select("bus", "signal", "t", "raw", "v", "label")


def frame_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A signal by the id of its frame and its bus."""
    samples = bus.decode(_frames(spark, sf_dir), spark.createDataFrame([(4, "Door", "count", 0, 16, True, False, False, 1.0, 0.0, None, None, None, False)], SIGNALS))
    return bus.bus_signal(samples, "CAN2.CAN_DataFrame_4.count").select("t", "raw")


def half_floats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Floats of 16 bits: powers of two and their halves, written as bits."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", (F.col("p_partkey") % 30 + 1).alias("e"))
    raw = F.shiftleft("e", 10).bitwiseOR(F.lit(512)).bitwiseOR(F.when(F.col("p_partkey") % 2 == 1, 0x8000).otherwise(0)).cast("long")
    return p.select("p_partkey", bus.ieee(raw, F.lit(16)).alias("v"))


def flexray_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = event_samples(spark, sf_dir)
    frames = e.select("t", F.lit("FR1").alias("bus"), F.col("user_id").alias("id"), (F.col("ord") % 64).alias("cycle"), (F.col("ord") % 2).cast("int").alias("channel"), F.when(F.col("channel") == "error", 1).otherwise(0).alias("event_type"), F.when(F.col("channel") != "error", F.unhex(F.lpad(F.hex("ord"), 8, "0"))).alias("payload"))
    names = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("message_id"), F.col("s_name").alias("message"))
    return bus.flexray_trace(frames, names)


def asc_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an ASC log: frames with a flexible data rate, remote frames, error frames and others."""
    e = event_samples(spark, sf_dir)
    frames = e.select(((F.col("t") - F.lit(START_S * 1_000_000)) / 1_000_000).alias("t"), F.lit("1").alias("bus"), F.col("user_id").alias("id"), F.unhex(F.lpad(F.hex("ord"), 8, "0")).alias("payload"), (F.col("channel") == "error").alias("is_error"), (F.col("channel") == "view").alias("is_remote"), (F.col("channel") == "click").alias("is_fd"), (F.col("ord") % 2 == 0).alias("is_tx"))
    return sinks.asc_lines(frames).select("value")


def computed_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptions of computed channels over line items: nested arithmetic, a function and an expression."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("off"))
    net = {"computation": {"type": "arithmetic", "op": "*", "operand1": "price", "operand2": {"computation": {"type": "arithmetic", "op": "-", "operand1": "1", "operand2": "off"}}}}
    root = {"computation": {"type": "function", "name": "sqrt", "channel": net, "args": []}}
    each = {"computation": {"type": "expression", "expression": "{{price}} / {{quantity}} + 1"}}
    assert computed.required(root) == ["price", "off"]
    return rows.select("l_orderkey", "l_linenumber", computed.column(net).alias("net"), computed.column(root).alias("root"), computed.column(each).alias("each"))


def included_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channels that stand for themselves: no masters, no parts of other channels."""
    catalogue, _ = _catalogue(spark, sf_dir)
    marked = catalogue.withColumn("is_master", F.col("channel_index") == 0)
    parts = spark.createDataFrame([(1, 2), (1, 3), (5, 4)], "group_index int, channel_index int")
    return select.included(marked, parts).select("group_index", "channel_index", "name")


def display_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers by the first display name that they have, else by their name."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    names = F.when(F.col("s_suppkey") % 2 == 0, F.map_from_arrays(F.array(F.concat(F.lit("shown "), F.col("s_suppkey").cast("string"))), F.array(F.lit("display")))).otherwise(F.expr("cast(map() as map<string,string>)"))
    return s.withColumn("names", names).select("s_suppkey", frame.display_name("names", "s_name").alias("shown"))


def cast_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices as small integers: fractions are cut, what doesn't fit is missing."""
    p = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", (F.col("o_totalprice") / 4).alias("v"))
    return select.cast_values(p, "smallint")


def literal_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by a hexadecimal, a binary, a text and a float literal."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    read = [("and", "o_orderkey", ">", "0x1F4", "hex"), ("and", "o_custkey", "<", "0b10000000", "bin"), ("or", "o_orderstatus", "==", "P", "ascii"), ("and", "o_totalprice", ">=", "3e5", "float")]
    return select.filter_rows(o, [(word, c, op, select.literal(text, kind)) for word, c, op, text, kind in read])


def step_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many stamps a raster of half an hour has, over the channels involved."""
    s = event_samples(spark, sf_dir).where("channel IN ('click', 'view')")
    spans = resample.spans(s, ["user_id"])
    return spans.select("user_id", resample.step_count(F.col("lo"), F.col("hi"), 1_800_000_000).alias("n"))


def gps_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks and views as coordinates in seconds, on the union of their stamps rounded to three digits."""
    a, b = (s.withColumn("t", (F.col("t") - F.lit(START_S * 1_000_000)) / 1_000_000) for s in _two(spark, sf_dir))
    return align.joined_channels(a, b, ["user_id"], digits=3).select("user_id", F.round("t", 3).alias("t"), F.round("a", 5).alias("a"), F.round("b", 5).alias("b"))


def union_of_masters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours at which any line item's group has a sample, four channels to a group."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select((F.col("l_suppkey") % 5).alias("group_index"), F.col("l_orderkey").alias("t"), "l_quantity", "l_tax")
    return align.union_of_masters(frame.long(rows, "t", ["l_quantity", "l_tax"]), ["group_index"])


def conv_transferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A polynomial quotient of the older format, and the rational conversion that it is in the newer one."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.col("p_size").cast("double").alias("x"))
    old = {"type": "polynomial", "p": (3.0, 2.0, 0.5, -4.0, 1.0, 0.25)}
    new = convert.transferred(old, 4)
    return p.select("p_partkey", F.round(convert.convert(F.col("x"), old), 9).alias("old"), F.round(convert.convert(F.col("x"), new), 9).alias("new"))


def conv_text_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value table with texts taken and skipped, and ranges whose default is a linear conversion."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size")
    c = {"type": "value_to_text", "rows": {1: "one", 2: "two"}, "default": "many"}
    r = convert.from_dict(convert.to_dict({"type": "range_to_value", "rows": [(0, 9, 1.0), (10, 19, 2.0)], "default": {"type": "linear", "a": 0.5, "b": 3.0}}))
    x = F.col("p_size")
    return p.select("p_partkey", convert.convert(x, c).alias("text"), convert.convert(x, c, skip_text=True).alias("raw"), convert.convert(x.cast("double"), r).alias("ranged"))


def _signals(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    catalogue, s = _catalogue(spark, sf_dir)
    return catalogue.withColumn("acq_name", F.concat(F.lit("rate "), F.col("group_index").cast("string"))), s


def remapped_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a recording whose groups and channels are numbered backwards, under the numbers of the first one."""
    catalogue, s = _signals(spark, sf_dir)
    back = lambda df: df.withColumns({"group_index": 6 - F.col("group_index"), "channel_index": 4 - F.col("channel_index")})
    out = merge.remapped(back(s), back(catalogue), catalogue.where("name <> 'error'"))
    return out.select("group_index", "channel_index", "ordinal")


def group_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalogue, s = _catalogue(spark, sf_dir)
    return frame.group_frame(s, catalogue, 4)


def common_timebase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signups and errors of a user as one group on the union of their stamps."""
    s = event_samples(spark, sf_dir).where("channel IN ('signup', 'error')")
    return frame.on_common_timebase(s, ["user_id"], "channel").select("user_id", "channel", "t", F.round("v", 6).alias("v"))


def empty_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channels of which no sample exceeds a bound, as zeros at the days of their group."""
    catalogue, s = _catalogue(spark, sf_dir)
    high = s.where("physical > 60 AND NOT (group_index = 2 AND channel_index = 1) AND NOT (group_index = 5 AND channel_index = 3)").withColumn("v", F.col("physical"))
    days = high.select("group_index", (F.floor(F.col("t") / 86_400_000_000) * 86_400_000_000).alias("t")).distinct()
    return select.with_empty_channels(high, catalogue, days)


def buses_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of two buses, one of them with a cycle, in one order."""
    f = _frames(spark, sf_dir).select("bus", "id", "t")
    return bus.chronological(f.where("bus = 'CAN1'"), f.where("bus = 'CAN2'").withColumn("cycle", F.col("id") % 3))


def computed_by_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arguments of a computed channel every six hours over the span of both channels."""
    a, b = (s.withColumn("t", (F.col("t") - F.lit(START_S * 1_000_000)) / 1_000_000) for s in _two(spark, sf_dir))
    out = userfn.aligned({"a": a, "b": b}, ["user_id"], step=21600.0)
    return out.select("user_id", F.round("t", 3).alias("t"), F.round("a", 4).alias("a"), F.round("b", 4).alias("b"))


QUERIES = {f.__name__: f for f in [remapped_channels, group_frame, common_timebase, empty_channels, buses_in_order, computed_by_step, included_channels, display_names, cast_values, literal_filters, step_counts, gps_join, union_of_masters, conv_transferred, conv_text_skipped, get_channel, get_raster, raw_by_channel, group_information, trigger_list, longest_text, missing_columns, edge_rows, next_rounded, append_group, append_records, stack_sync, scatter_merge, xy_union, joint_validity, unary, single_raster, dbc_database, bus_labels, frame_names, half_floats, flexray_trace, asc_kinds, computed_columns, *map(_bits, ["and", "or", "xor"])]}

_FR = f"WITH {S}, f AS (SELECT 'CAN' || (user_id % 2 + 1) AS bus, user_id % 5 AS id, t, ord FROM s)"
_HELD = f"""WITH {S}, g AS (SELECT * FROM s WHERE channel IN ('click', 'view')),
p AS (SELECT DISTINCT user_id, t FROM g), a AS (SELECT * FROM g WHERE channel = 'click'), b AS (SELECT * FROM g WHERE channel = 'view'),
h AS (SELECT p.user_id, p.t, a.v AS x, a.ord AS xo, b.v AS y, b.ord AS yo FROM p ASOF JOIN a ON p.user_id = a.user_id AND p.t >= a.t ASOF JOIN b ON p.user_id = b.user_id AND p.t >= b.t),
m AS (SELECT user_id, least(max(t) FILTER (channel = 'click'), max(t) FILTER (channel = 'view')) AS hi FROM g GROUP BY user_id),
z AS (SELECT h.* FROM h JOIN m USING (user_id) WHERE t <= hi)"""
_UNION = f"""WITH {S}, p AS (SELECT DISTINCT user_id, t FROM s WHERE channel IN ('click', 'view')),
x AS (SELECT p.*, b.t AS bt, b.v AS bv, a.t AS nt, a.v AS av FROM p ASOF LEFT JOIN (SELECT * FROM s WHERE channel = 'click') b ON p.user_id = b.user_id AND p.t >= b.t ASOF LEFT JOIN (SELECT * FROM s WHERE channel = 'click') a ON p.user_id = a.user_id AND p.t < a.t),
y AS (SELECT p.*, b.t AS bt, b.v AS bv, a.t AS nt, a.v AS av FROM p ASOF LEFT JOIN (SELECT * FROM s WHERE channel = 'view') b ON p.user_id = b.user_id AND p.t >= b.t ASOF LEFT JOIN (SELECT * FROM s WHERE channel = 'view') a ON p.user_id = a.user_id AND p.t < a.t)
SELECT user_id, t, round(x, 6) AS x, round(y, 6) AS y FROM (SELECT user_id, t, {LINEAR} AS x FROM x) JOIN (SELECT user_id, t, {LINEAR} AS y FROM y) USING (user_id, t)"""

ORACLE_SQL = {
    "remapped_channels": f"{_CAT} SELECT group_index, channel_index, ordinal FROM c WHERE channel <> 'error'",
    "group_frame": f"{_CAT} SELECT ordinal, t, CASE channel WHEN 'click' THEN physical END AS click, CASE channel WHEN 'error' THEN physical END AS error, CASE channel WHEN 'purchase' THEN physical END AS purchase, CASE channel WHEN 'signup' THEN physical END AS signup, CASE channel WHEN 'view' THEN physical END AS view FROM c WHERE group_index = 4",
    "common_timebase": f"WITH {S}, q AS (SELECT * FROM s WHERE channel IN ('signup', 'error')), p AS (SELECT c.user_id, c.channel, d.t FROM (SELECT DISTINCT user_id, channel FROM q) c JOIN (SELECT DISTINCT user_id, t FROM q) d USING (user_id)), n AS (SELECT p.*, b.t AS bt, b.v AS bv, a.t AS nt, a.v AS av FROM p ASOF LEFT JOIN q b ON p.user_id = b.user_id AND p.channel = b.channel AND p.t >= b.t ASOF LEFT JOIN q a ON p.user_id = a.user_id AND p.channel = a.channel AND p.t < a.t) SELECT user_id, channel, t, round({LINEAR}, 6) AS v FROM n",
    "empty_channels": f"{_CAT}, h AS (SELECT group_index, channel_index, t, physical AS v FROM c WHERE physical > 60 AND NOT (group_index = 2 AND channel_index = 1) AND NOT (group_index = 5 AND channel_index = 3)), k AS (SELECT CAST(g AS INTEGER) AS group_index, CAST(i AS INTEGER) AS channel_index FROM range(7) a(g), range(5) b(i)), e AS (SELECT * FROM k WHERE (group_index, channel_index) NOT IN (SELECT (group_index, channel_index) FROM h)), d AS (SELECT DISTINCT group_index, t // 86400000000 * 86400000000 AS t FROM h) SELECT * FROM h UNION ALL SELECT group_index, channel_index, t, 0.0 FROM e JOIN d USING (group_index)",
    "buses_in_order": f"{_FR} SELECT bus, id, t, CASE bus WHEN 'CAN2' THEN id % 3 END AS cycle FROM f",
    "computed_by_step": f"WITH s AS (SELECT event_type AS channel, user_id, (epoch_us(ts) - {START_S}000000) / 1000000.0::DOUBLE AS t, value AS v FROM events WHERE event_type IN ('click', 'view')), m AS (SELECT user_id, min(t) AS lo, max(t) AS hi FROM s GROUP BY 1), p AS (SELECT user_id, lo + i * ((lo + 21600.0) - lo) AS t FROM (SELECT *, unnest(range(0, greatest(CAST(ceil((hi - lo) / 21600.0) AS BIGINT), 1))) AS i FROM m)), x AS (SELECT p.*, b.t AS bt, b.v AS bv, a.t AS nt, a.v AS av FROM p ASOF LEFT JOIN (SELECT * FROM s WHERE channel = 'click') b ON p.user_id = b.user_id AND p.t >= b.t ASOF LEFT JOIN (SELECT * FROM s WHERE channel = 'click') a ON p.user_id = a.user_id AND p.t < a.t), y AS (SELECT p.*, b.t AS bt, b.v AS bv, a.t AS nt, a.v AS av FROM p ASOF LEFT JOIN (SELECT * FROM s WHERE channel = 'view') b ON p.user_id = b.user_id AND p.t >= b.t ASOF LEFT JOIN (SELECT * FROM s WHERE channel = 'view') a ON p.user_id = a.user_id AND p.t < a.t) SELECT user_id, round(t, 3) AS t, round(x, 4) AS a, round(y, 4) AS b FROM (SELECT user_id, t, {LINEAR} AS x FROM x) JOIN (SELECT user_id, t, {LINEAR} AS y FROM y) USING (user_id, t)",
    "included_channels": "SELECT CAST(g AS INTEGER) AS group_index, CAST(c AS INTEGER) AS channel_index, ['click', 'error', 'purchase', 'signup', 'view'][c + 1] AS name FROM range(7) a(g), range(1, 5) b(c) WHERE NOT (g = 1 AND c IN (2, 3)) AND NOT (g = 5 AND c = 4)",
    "display_names": "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'shown ' || s_suppkey ELSE s_name END AS shown FROM supplier",
    "cast_values": "SELECT o_orderkey, TRY_CAST(trunc(o_totalprice / 4) AS SMALLINT) AS v FROM orders",
    "literal_filters": "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE (o_orderkey > 500 AND o_custkey < 128) OR (o_orderstatus = 'P' AND o_totalprice >= 300000)",
    "step_counts": f"WITH {S} SELECT user_id, CAST(floor((max(t) - min(t)) / 1800000000) AS BIGINT) + 1 AS n FROM s WHERE channel IN ('click', 'view') GROUP BY 1",
    "gps_join": _UNION.replace("WITH s AS (SELECT event_type AS channel, user_id, event_id AS ord, epoch_us(ts) AS t,", f"WITH s AS (SELECT event_type AS channel, user_id, event_id AS ord, (epoch_us(ts) - {START_S}000000) / 1000000.0::DOUBLE AS t,").replace("p AS (SELECT DISTINCT user_id, t FROM s", "p AS (SELECT DISTINCT user_id, round(t, 3) AS t FROM s").replace("SELECT user_id, t, round(x, 6) AS x, round(y, 6) AS y FROM", "SELECT user_id, round(t, 3) AS t, round(x, 5) AS a, round(y, 5) AS b FROM"),
    "union_of_masters": "SELECT DISTINCT l_orderkey AS t FROM lineitem",
    "conv_transferred": "SELECT p_partkey, round(v, 9) AS old, round(v, 9) AS new FROM (SELECT p_partkey, (2.0 + 4.0 * (p_size - 1.25)) / (0.5 * (p_size - 1.25) - 3.0) AS v FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) AS p_size FROM part))",
    "conv_text_skipped": "SELECT p_partkey, CASE p_size WHEN 1 THEN 'one' WHEN 2 THEN 'two' ELSE 'many' END AS text, p_size AS raw, CAST(CASE WHEN p_size BETWEEN 0 AND 8 THEN 1 WHEN p_size BETWEEN 10 AND 18 THEN 2 ELSE 0.5 * p_size + 3 END AS DOUBLE) AS ranged FROM part",
    "get_channel": f"{_CAT} SELECT ordinal, t, raw AS v FROM c WHERE channel = 'view' AND group_index = 3 AND ordinal >= 100",
    "get_raster": f"{_CAT}, q AS (SELECT (t - {START_S}000000) / 1000000.0::DOUBLE AS t, physical AS v FROM c WHERE channel = 'click' AND group_index = 2), m AS (SELECT min(t) AS lo, max(t) AS hi FROM q), p AS (SELECT lo + i * ((lo + 21600.0) - lo) AS t FROM m, range(0, CAST(ceil((hi - lo) / 21600.0) AS BIGINT)) r(i)), n AS (SELECT p.t, b.t AS bt, b.v AS bv, a.t AS nt, a.v AS av FROM p ASOF LEFT JOIN q b ON p.t >= b.t ASOF LEFT JOIN q a ON p.t < a.t) SELECT round(t, 3) AS t, round({LINEAR}, 4) AS v FROM n",
    "raw_by_channel": f"{_CAT} SELECT ordinal, CASE WHEN channel IN ('click', 'view') THEN raw ELSE physical END AS v FROM c",
    "group_information": f"{_CAT} SELECT g AS group_index, 'click,error,purchase,signup,view' AS channels, 5 AS n_channels, max(ordinal) + 1 AS n_records, min(t) AS first_t, max(t) AS last_t FROM (SELECT CAST(unnest(range(7)) AS INTEGER) AS g) LEFT JOIN c ON g = group_index GROUP BY g",
    "trigger_list": f"{_CAT} SELECT group_index, row_number() OVER (PARTITION BY group_index ORDER BY t) - 1 AS index, t, coalesce(CASE WHEN raw > 0 THEN physical END, 0) AS pre_time, 0.0::DOUBLE AS post_time FROM c WHERE channel = 'error'",
    "longest_text": "SELECT p_brand, max(strlen(p_name)) AS size FROM part GROUP BY 1",
    "missing_columns": "SELECT n_nationkey, n_name, 'nan'::DOUBLE AS altitude FROM nation",
    "edge_rows": "SELECT o_orderkey, high FROM (SELECT *, coalesce(lag(high) OVER w, FALSE) AS b, coalesce(lead(high) OVER w, FALSE) AS a FROM (SELECT o_orderkey, o_totalprice > 400000 AS high FROM orders) WINDOW w AS (ORDER BY o_orderkey)) WHERE high OR a OR b",
    "next_rounded": f"WITH {S}, r AS (SELECT round((t - {START_S}000000) / 3600000000.0::DOUBLE, 2) AS t, ord, v FROM s WHERE channel = 'purchase') SELECT min(t) AS t, arg_min(ord, t) AS ord FROM r WHERE v > 50 AND t > 100.0",
    "append_group": f"{_CAT}, n AS (SELECT group_index, channel_index, count(*) AS n, max(physical) AS top FROM c GROUP BY ALL UNION ALL SELECT 7, 0, count(*), max(s_acctbal) FROM supplier), l AS (SELECT CAST(unnest(range(7)) AS INTEGER) AS group_index), k AS (SELECT group_index, CAST(i AS INTEGER) AS channel_index, ['click', 'error', 'purchase', 'signup', 'view'][i + 1] AS name FROM l, range(5) r(i) UNION ALL SELECT 7, 0, 'balance') SELECT group_index, channel_index, name, n, top FROM k LEFT JOIN n USING (group_index, channel_index)",
    "append_records": f"WITH {S}, l AS (SELECT user_id, max(ord) + 1 AS m FROM s WHERE channel = 'click' GROUP BY 1) SELECT user_id, ord + CASE WHEN channel = 'view' THEN coalesce(m, 0) ELSE 0 END AS ordinal, t, v FROM s LEFT JOIN l USING (user_id) WHERE channel IN ('click', 'view')",
    "stack_sync": f"WITH {S} SELECT user_id % 4 + CASE channel WHEN 'view' THEN 4 ELSE 0 END AS group_index, ord, t + CASE channel WHEN 'view' THEN 90000000 ELSE 0 END AS t FROM s WHERE channel IN ('click', 'view')",
    "scatter_merge": f"WITH {S} SELECT t, CASE channel WHEN 'click' THEN v END AS click, CASE channel WHEN 'view' THEN ord END AS view_id, CASE channel WHEN 'view' THEN 1 ELSE 0 END AS source_index FROM s WHERE channel IN ('click', 'view')",
    "xy_union": _UNION,
    "joint_validity": f"{_HELD} SELECT user_id, t, round(x + y, 4) AS v, xo % 11 = 0 OR yo % 11 = 0 AS invalid FROM z",
    "unary": f"WITH {S}, w AS (SELECT ord AS event_id, CAST(floor(v) AS BIGINT) - 40 AS x FROM s WHERE channel = 'click') SELECT event_id, -x AS neg, abs(x) AS abs, -x - 1 AS invert, CAST(x * x AS DOUBLE) AS square FROM w",
    "single_raster": "WITH c AS (SELECT n_regionkey AS k, CAST(min(n_nationkey) AS DOUBLE) AS lo, CAST(max(n_nationkey) AS DOUBLE) AS hi FROM nation GROUP BY 1), r AS (SELECT *, unnest([0.5, 0.75])::DOUBLE AS step FROM c), g AS (SELECT *, CAST((hi - lo) / step AS FLOAT) AS q FROM r), n AS (SELECT *, CASE WHEN q = floor(q) THEN CAST(q AS BIGINT) ELSE CAST(ceil((hi - lo) / step) AS BIGINT) END AS n FROM g) SELECT k, step, CASE WHEN q = floor(q) AND i = n - 1 AND n > 1 THEN hi ELSE lo + i * CASE WHEN q = floor(q) THEN coalesce((hi - lo) / nullif(n - 1, 0), 0) ELSE step END END AS t FROM (SELECT *, unnest(range(n)) AS i FROM n)",
    "dbc_database": "SELECT * FROM (VALUES (1::BIGINT, 'number', FALSE, FALSE, FALSE, FALSE, ''), (1, 'state', FALSE, FALSE, FALSE, FALSE, '0=off,1=on,3=error'), (2, 'ratio', TRUE, TRUE, TRUE, FALSE, ''), (2, 'far', TRUE, FALSE, TRUE, TRUE, '')) v(message_id, signal, is_extended, is_float, j1939, beyond, texts)",
    "bus_labels": f"{_FR} SELECT bus, 'number' AS signal, t, ord AS raw, CAST(CASE WHEN ord <= 99 THEN ord * 2.0 + 1 WHEN ord <= 4999 THEN ord * 0.5 ELSE ord END AS DOUBLE) AS v, NULL AS label FROM f WHERE id = 1 UNION ALL SELECT bus, 'state', t, ord & 3, CAST(ord & 3 AS DOUBLE), CASE ord & 3 WHEN 0 THEN 'off' WHEN 1 THEN 'on' WHEN 3 THEN 'error' END FROM f WHERE id = 1",
    "frame_names": f"{_FR} SELECT t, ord & 65535 AS raw FROM f WHERE id = 4 AND bus = 'CAN2'",
    "half_floats": "SELECT p_partkey, CASE WHEN p_partkey % 2 = 1 THEN -1 ELSE 1 END * 1.5::DOUBLE * pow(2, p_partkey % 30 + 1 - 15) AS v FROM part",
    "flexray_trace": f"WITH {S} SELECT t, 'FR1' AS bus, user_id AS id, ord % 64 AS cycle, CASE WHEN ord % 2 = 1 THEN 'B' ELSE 'A' END AS channel, coalesce(s_name, '') AS message, CASE s.channel WHEN 'error' THEN 'FlexRay NullFrame' ELSE 'FlexRay Frame' END AS event, CASE s.channel WHEN 'error' THEN 0 ELSE 4 END AS dlc, CASE s.channel WHEN 'error' THEN '' ELSE regexp_replace(regexp_replace(printf('%08X', ord), '(..)', '\\1 ', 'g'), ' $', '') END AS data FROM s LEFT JOIN supplier ON s_suppkey = user_id",
    "asc_kinds": f"WITH {S}, l AS (SELECT printf('%12.6f', (t - {START_S}000000) / 1000000.0::DOUBLE) AS stamp, printf('%X', user_id) AS i, regexp_replace(regexp_replace(printf('%08X', ord), '(..)', '\\1 ', 'g'), ' $', '') AS d, CASE WHEN ord % 2 = 0 THEN 'Tx' ELSE 'Rx' END AS dir, channel FROM s) SELECT CASE channel WHEN 'error' THEN stamp || ' 1  ErrorFrame' WHEN 'view' THEN stamp || ' 1  ' || rpad(i, 16, ' ') || dir || '   r' WHEN 'click' THEN stamp || ' CANFD 1  ' || dir || ' ' || rpad(i, 16, ' ') || ' 1 0 4 ' || d ELSE stamp || ' 1  ' || rpad(i, 16, ' ') || dir || '   d 4 ' || d END AS value FROM l",
    "computed_columns": "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net, sqrt(l_extendedprice * (1 - l_discount)) AS root, l_extendedprice / l_quantity + 1 AS each FROM lineitem",
    **{f"signal_{k}": f"{_HELD} SELECT user_id, t, {e} AS v FROM (SELECT user_id, t, CAST(floor(x) AS BIGINT) AS x, CAST(floor(y) AS BIGINT) AS y FROM z)" for k, e in {"and": "x & y", "or": "x | y", "xor": "xor(x, y)"}.items()},
}
