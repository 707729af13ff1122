"""Queries on time alignment, cutting, resampling and frames, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import round_half_away
from ..model import DAY, event_samples
from ..operators import align, cut, frame, resample

#: 2024-01-10 and 2024-01-20 in microseconds: bounds of cuts.
START, STOP = 1704844800000000, 1705708800000000
NAMES = ["click", "error", "purchase", "signup", "view"]
S = "s AS (SELECT event_type AS channel, user_id, event_id AS ord, epoch_us(ts) AS t, value AS v FROM events)"
#: Two as-of joins give the neighbours of probes ``p(k.., t)`` among samples ``q``.
NEAR = """n AS (SELECT {p}, b.t AS bt, b.v AS bv, a.t AS nt, a.v AS av FROM p ASOF LEFT JOIN q b ON {on_b} p.t >= b.t ASOF LEFT JOIN q a ON {on_a} p.t < a.t)"""


def near(cols: str = "p.*", key: str = "user_id") -> str:
    return NEAR.format(p=cols, on_b=f"p.{key} = b.{key} AND" if key else "", on_a=f"p.{key} = a.{key} AND" if key else "")


LINEAR = "CASE WHEN bt IS NULL THEN av WHEN nt IS NULL OR bt = t THEN bv ELSE (av - bv) / (CAST(nt AS DOUBLE) - bt) * (CAST(t AS DOUBLE) - bt) + bv END"


def _two(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    s = event_samples(spark, sf_dir)
    return s.where("channel = 'click'"), s.where("channel = 'view'")


def asof_prev(spark: SparkSession, sf_dir: str) -> DataFrame:
    clicks, views = _two(spark, sf_dir)
    out = align.interpolate(views, clicks.select("user_id", "t", F.col("ord").alias("event_id")), ["user_id"], "S")
    return out.select("user_id", "event_id", "v")


def interp_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    clicks, views = _two(spark, sf_dir)
    out = align.interpolate(views, clicks.select("user_id", "t", F.col("ord").alias("event_id")), ["user_id"])
    return out.select("user_id", "event_id", F.round("v", 6).alias("v"))


def interp_integer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integer channels, hybrid mode: linear as the conversion yields floats, cut back to integers."""
    from ..model import Options

    clicks, views = _two(spark, sf_dir)
    whole = views.withColumn("v", F.floor("v").cast("long"))
    out = align.interpolate(whole, clicks.select("user_id", "t", F.col("ord").alias("event_id")), ["user_id"], "i", True, Options(integer_mode=2))
    return out.select("user_id", "event_id", "v")


def nearest_stamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    clicks, views = _two(spark, sf_dir)
    near_ = align.neighbours(views, clicks.select("user_id", "t", F.col("ord").alias("event_id")), ["user_id"])
    return near_.select("user_id", "event_id", align.nearest_value("t").alias("stamp"), align.nearest_value().alias("v"))


def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first view at or after each click; null beyond the last."""
    clicks, views = _two(spark, sf_dir)
    near_ = align.neighbours(views, clicks.select("user_id", "t", F.col("ord").alias("event_id")), ["user_id"])
    return near_.select("user_id", "event_id", align.value_at_or_after(True).alias("v"), align.value_at_or_after().alias("clamped"))


def lookup_clamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    clicks, views = _two(spark, sf_dir)
    near_ = align.neighbours(views, clicks.select("user_id", "t", F.col("ord").alias("event_id")), ["user_id"])
    return near_.select("user_id", "event_id", align.previous_value(clamp=False).alias("strict"), align.previous_value().alias("clamped"))


def union_timebase(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _two(spark, sf_dir)
    seconds = lambda s: s.withColumn("t", F.floor(F.col("t") / 1_000_000))
    return align.union_timebase(seconds(a), seconds(b), keys=["user_id"])


def gps_timebase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union of stamps in seconds, rounded."""
    a, b = _two(spark, sf_dir)
    seconds = lambda s: s.withColumn("t", F.col("t") / 1_000_000)
    return align.union_timebase(seconds(a), seconds(b), digits=0)


def xy_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks as x, views on their stamps as y, with the direction to the next point."""
    clicks, views = _two(spark, sf_dir)
    out = align.interpolate(views, clicks.select("user_id", "t", "ord", F.col("v").alias("x")), ["user_id"]).withColumnRenamed("v", "y")
    from ..functions.scalar import arrow_angle
    from ..operators.stats import with_previous

    p = with_previous(out, ["user_id"], ["x", "y"])
    return p.select("user_id", F.col("ord").alias("event_id"), "x", F.round("y", 6).alias("y"), F.round(arrow_angle(F.col("x") - F.col("prev.x"), F.col("y") - F.col("prev.y")), 4).alias("angle"))


def _arith(operator: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        a, b = _two(spark, sf_dir)
        out = align.combine(a, b, ["user_id"], operator)
        return out.select("user_id", "t", (round_half_away(F.col("v"), 4) if dict(out.dtypes)["v"] == "double" else F.col("v")).alias("v"))

    query.__name__ = f"signal_{operator}"
    return query


def scalar_arith(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, _ = _two(spark, sf_dir)
    plus = align.with_scalar(a, "add", 2.5).select("ord", F.col("v").alias("plus"))
    minus = align.with_scalar(a, "sub", 100.0, reflected=True).select("ord", F.col("v").alias("minus"))
    rest = align.with_scalar(a, "mod", 7.0).select("ord", F.round("v", 6).alias("rest"))
    return plus.join(minus, "ord").join(rest, "ord").withColumnRenamed("ord", "event_id")


ARITH = {"add": "x + y", "sub": "x - y", "mul": "x * y", "div": "CASE WHEN y = 0 THEN CASE WHEN x = 0 THEN 'nan'::DOUBLE WHEN x > 0 THEN 'inf'::DOUBLE ELSE '-inf'::DOUBLE END ELSE x / y END", "floordiv": "floor(x / nullif(y, 0))", "mod": "x - y * floor(x / nullif(y, 0))"}
COMPARED = {"lt": "x < y", "le": "x <= y", "gt": "x > y", "ge": "x >= y", "eq": "x = y", "ne": "x <> y"}


def _arith_sql(expression: str, rounded: bool) -> str:
    value = f"round({expression}, 4)" if rounded else expression
    return f"""WITH {S}, a AS (SELECT * FROM s WHERE channel = 'click'), b AS (SELECT * FROM s WHERE channel = 'view'),
sp AS (SELECT user_id, greatest(min(t) FILTER (channel = 'click'), min(t) FILTER (channel = 'view')) AS lo, least(max(t) FILTER (channel = 'click'), max(t) FILTER (channel = 'view')) AS hi FROM s WHERE channel IN ('click', 'view') GROUP BY user_id HAVING count(DISTINCT channel) = 2),
p AS (SELECT DISTINCT s.user_id, t FROM s JOIN sp USING (user_id) WHERE channel IN ('click', 'view') AND t BETWEEN lo AND hi),
x AS (SELECT p.user_id, p.t, b.t AS bt, b.v AS bv, n.t AS nt, n.v AS av FROM p ASOF LEFT JOIN a b ON p.user_id = b.user_id AND p.t >= b.t ASOF LEFT JOIN a n ON p.user_id = n.user_id AND p.t < n.t),
y AS (SELECT p.user_id, p.t, c.t AS bt, c.v AS bv, n.t AS nt, n.v AS av FROM p ASOF LEFT JOIN b c ON p.user_id = c.user_id AND p.t >= c.t ASOF LEFT JOIN b n ON p.user_id = n.user_id AND p.t < n.t),
z AS (SELECT user_id, t, x, y FROM (SELECT user_id, t, {LINEAR} AS x FROM x) JOIN (SELECT user_id, t, {LINEAR} AS y FROM y) USING (user_id, t))
SELECT user_id, t, {value} AS v FROM z"""


def cut_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut.cut(event_samples(spark, sf_dir), ["channel"], START, STOP, ends=False)


def cut_with_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cut.cut(event_samples(spark, sf_dir), ["channel"], START, STOP)
    return out.select("channel", "t", F.round("v", 6).alias("v"))


def cut_repeat_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut.cut(event_samples(spark, sf_dir), ["channel", "user_id"], START, STOP, linear=False)


def cut_from_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days 2 to 5 of the measurement, counted from its first stamp, stamps from zero."""
    return cut.cut_group(event_samples(spark, sf_dir), ["channel"], 2 * DAY, 5 * DAY, from_first=True, zero=True, ends=False)


def validate_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = event_samples(spark, sf_dir).withColumn("invalid", F.col("user_id") % 7 == 0)
    return cut.keep_valid(flagged).select(F.col("ord").alias("event_id"), "v")


def cleanup_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order totals as stamps, some of them zero, negative or far out: the plausible ones, in both readings."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    k = F.col("o_orderkey") % 11
    t = F.when(k == 0, F.lit(0.0)).when(k == 1, -F.col("o_totalprice")).when(k == 2, F.lit(float("nan"))).when(k == 3, F.lit(1e20)).otherwise(F.col("o_totalprice"))
    return o.select("o_orderkey", cut.plausible(t, 0, 200000).alias("ok"), cut.plausible(t, 0, 200000, strict=False).alias("ok_loose"))


def strict_monotonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in key order as records with stamps that jump back: those later than the record before."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderstatus", F.col("o_orderkey").alias("ord"), F.expr("timestampdiff(DAY, TIMESTAMP_NTZ'1970-01-01', o_orderdate)").alias("t"))
    return cut.increasing(o, ["o_orderstatus"], bucket=1000)


def monotonic_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderstatus", F.col("o_orderkey").alias("ord"), F.expr("timestampdiff(DAY, TIMESTAMP_NTZ'1970-01-01', o_orderdate)").alias("t"))
    return cut.not_increasing(o, ["o_orderstatus"], bucket=1000)


def raster_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = event_samples(spark, sf_dir).withColumn("t", F.floor((F.col("t") - F.lit(START)) / 1_000_000))
    return resample.raster(resample.spans(s, ["channel"]), ["channel"], 3600.0).select("channel", F.round("t", 6).alias("t"))


def raster_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A span of a whole number of steps: both ends are there."""
    s = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_regionkey").alias("k"), F.col("n_nationkey").cast("double").alias("t"))
    return resample.raster(resample.spans(s, ["k"]), ["k"], 0.5)


def _seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_samples(spark, sf_dir).withColumn("t", (F.col("t") - F.lit(1704067200000000)) / 1_000_000)


def resample_prev(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample.resample(_seconds(spark, sf_dir), ["channel"], 1800.0, kind="S")
    return out.select("channel", F.round("t", 3).alias("t"), "v")


def resample_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample.resample(_seconds(spark, sf_dir), ["channel"], 7200.0)
    return out.select("channel", F.round("t", 3).alias("t"), F.round("v", 4).alias("v"))


def resample_on_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = event_samples(spark, sf_dir)
    out = resample.resample(s, ["channel"], stamps=s.where("channel = 'signup'").select(F.col("t").cast("double").alias("t")), kind="S")
    return out.select("channel", F.col("t").cast("long").alias("t"), "v")


def wide_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = event_samples(spark, sf_dir).withColumn("t", F.floor(F.col("t") / 60_000_000))
    return frame.wide_exact(s, [], "channel", NAMES)


def wide_prev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame.wide(event_samples(spark, sf_dir), [], "channel", NAMES)


def wide_outside_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame.wide(event_samples(spark, sf_dir), [], "channel", NAMES, outside_null=True)


def from_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as a frame of four channels on the order key."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("t"), "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return frame.long(rows, "t", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


def unique_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name")
    return frame.unique_names(parts, "p_name", ["p_partkey"])


def flatten_structs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    nested = c.select("c_custkey", F.struct(F.col("c_name").alias("name"), F.struct(F.col("c_acctbal").alias("balance"), F.col("c_nationkey").alias("nation")).alias("more")).alias("c"))
    return frame.flatten(nested, separator="_")


def chunked_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("n"), "o_totalprice")
    return frame.chunks(o, "n", 1000).groupBy("chunk").agg(F.count(F.lit(1)).alias("rows"), F.min("n").alias("first"), F.max("n").alias("last"))


QUERIES = {f.__name__: f for f in [asof_prev, interp_linear, interp_integer, nearest_stamp, point_lookup, lookup_clamped, union_timebase, gps_timebase, xy_pairs, scalar_arith, cut_closed, cut_with_edges, cut_repeat_edges, cut_from_first, validate_drop, cleanup_timestamps, strict_monotonic, monotonic_report, raster_grid, raster_even, resample_prev, resample_linear, resample_on_channel, wide_exact, wide_prev, wide_outside_null, from_wide, unique_names, flatten_structs, chunked_frames, *map(_arith, [*ARITH, *COMPARED])]}

_CV = f"WITH {S}, q AS (SELECT * FROM s WHERE channel = 'view'), p AS (SELECT user_id, ord AS event_id, t, v AS x FROM s WHERE channel = 'click'), {near()}"
_DAY = f"WITH {S}, d AS (SELECT * FROM s), c AS (SELECT DISTINCT channel FROM d), q AS (SELECT * FROM d), p AS (SELECT channel, t FROM c CROSS JOIN (SELECT DISTINCT t FROM d)), {near('p.*', 'channel')}"
_PIVOT = ", ".join(f"max(v) FILTER (channel = '{n}') AS {n}" for n in NAMES)
_GRID = "WITH s AS (SELECT event_type AS channel, (epoch_us(ts) - 1704067200000000) / 1000000.0::DOUBLE AS t, value AS v FROM events), q AS (SELECT * FROM s), m AS (SELECT min(t) AS lo, max(t) AS hi FROM s), g AS (SELECT lo + i * ((lo + {step}) - lo) AS t FROM m, range(0, CAST(ceil((hi - lo) / {step}) AS BIGINT)) r(i)), p AS (SELECT channel, t FROM (SELECT DISTINCT channel FROM s) CROSS JOIN g), "
_ORD = "WITH o AS (SELECT o_orderstatus, o_orderkey AS ord, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS t FROM orders), l AS (SELECT *, lag(t) OVER (PARTITION BY o_orderstatus ORDER BY ord) AS before FROM o) "


def _edges(keys: str, linear: bool) -> str:
    join = " AND ".join(f"p.{k} = x.{k}" for k in keys.split(", "))
    value = f"round({LINEAR}, 6)" if linear else "bv"
    kept = "round(v, 6)" if linear else "v"
    return f"""WITH {S}, sp AS (SELECT {keys}, min(t) AS lo, max(t) AS hi FROM s GROUP BY {keys}),
p AS (SELECT {keys}, b AS t FROM sp, (VALUES ({START}), ({STOP})) v(b) WHERE b > lo AND b < hi),
n AS (SELECT p.*, b.t AS bt, b.v AS bv, a.t AS nt, a.v AS av FROM p ASOF LEFT JOIN s b ON {join.replace('x.', 'b.')} AND p.t >= b.t ASOF LEFT JOIN s a ON {join.replace('x.', 'a.')} AND p.t < a.t)
SELECT {keys}, t, {kept} AS v FROM s WHERE t BETWEEN {START} AND {STOP} UNION ALL SELECT {keys}, t, {value} AS v FROM n WHERE bt <> t"""


ORACLE_SQL = {
    "asof_prev": f"{_CV} SELECT user_id, event_id, coalesce(bv, av) AS v FROM n WHERE TRUE",
    "interp_linear": f"{_CV} SELECT user_id, event_id, round({LINEAR}, 6) AS v FROM n",
    "interp_integer": f"WITH {S}, q AS (SELECT user_id, t, floor(v) AS v FROM s WHERE channel = 'view'), p AS (SELECT user_id, ord AS event_id, t FROM s WHERE channel = 'click'), {near()} SELECT user_id, event_id, CAST(trunc({LINEAR}) AS BIGINT) AS v FROM n",
    "nearest_stamp": f"{_CV} SELECT user_id, event_id, CASE WHEN nt IS NULL OR t - bt < nt - t OR bt = t THEN bt ELSE nt END AS stamp, CASE WHEN nt IS NULL OR t - bt < nt - t OR bt = t THEN bv ELSE av END AS v FROM n",
    "point_lookup": f"{_CV} SELECT user_id, event_id, CASE WHEN bt = t THEN bv ELSE av END AS v, coalesce(CASE WHEN bt = t THEN bv ELSE av END, bv) AS clamped FROM n",
    "lookup_clamped": f"{_CV} SELECT user_id, event_id, bv AS strict, coalesce(bv, av) AS clamped FROM n",
    "union_timebase": f"WITH {S} SELECT DISTINCT user_id, t // 1000000 AS t FROM s WHERE channel IN ('click', 'view')",
    "gps_timebase": f"WITH {S} SELECT DISTINCT round(t / 1000000, 0) AS t FROM s WHERE channel IN ('click', 'view')",
    "xy_pairs": f"{_CV}, y AS (SELECT *, {LINEAR} AS y FROM n), l AS (SELECT *, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy FROM y WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)) SELECT user_id, event_id, x, round(y, 6) AS y, round(degrees(atan2(dy, dx)), 4) AS angle FROM l",
    "scalar_arith": f"WITH {S} SELECT ord AS event_id, v + 2.5 AS plus, 100.0 - v AS minus, round(v - 7 * floor(v / 7), 6) AS rest FROM s WHERE channel = 'click'",
    "cut_closed": f"WITH {S} SELECT channel, t, v FROM s WHERE t BETWEEN {START} AND {STOP}",
    "cut_with_edges": _edges("channel", True),
    "cut_repeat_edges": _edges("channel, user_id", False),
    "cut_from_first": f"WITH {S}, m AS (SELECT min(t) AS m FROM s) SELECT channel, t - m - {2 * DAY} AS t, v FROM s, m WHERE t BETWEEN m + {2 * DAY} AND m + {5 * DAY}",
    "validate_drop": "SELECT event_id, value AS v FROM events WHERE user_id % 7 <> 0",
    "cleanup_timestamps": "WITH o AS (SELECT o_orderkey, CASE o_orderkey % 11 WHEN 0 THEN 0.0 WHEN 1 THEN -o_totalprice WHEN 2 THEN 'nan'::DOUBLE WHEN 3 THEN 1e20 ELSE o_totalprice END AS t FROM orders), b AS (SELECT *, coalesce(t >= 0 AND t <= 200000 AND isfinite(t), FALSE) AS inb, coalesce(isfinite(t) AND t > 0 AND log10(CASE WHEN isfinite(t) AND t > 0 THEN t END) BETWEEN -15 AND 15, FALSE) AS pw FROM o) SELECT o_orderkey, inb AND (t = 0 OR pw) AS ok, (inb AND t = 0) OR pw AS ok_loose FROM b",
    "strict_monotonic": _ORD + "SELECT o_orderstatus, ord, t FROM l WHERE before IS NULL OR t > before",
    "monotonic_report": _ORD + ", r AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY ord) AS n FROM l WHERE t <= before) SELECT o_orderstatus, n, ord, before, t FROM r WHERE n <= 10",
    "raster_grid": f"WITH {S}, c AS (SELECT channel, min(floor((t - {START}) / 1000000)) AS lo, max(floor((t - {START}) / 1000000)) AS hi FROM s GROUP BY channel) SELECT channel, round(CASE WHEN (hi - lo) / 3600 = round((hi - lo) / 3600) AND i = (hi - lo) / 3600 THEN hi ELSE lo + i * 3600.0 END, 6) AS t FROM (SELECT *, unnest(range(0, CASE WHEN (hi - lo) / 3600 = round((hi - lo) / 3600) THEN CAST((hi - lo) / 3600 AS BIGINT) + 1 ELSE greatest(CAST(ceil((hi - lo) / 3600) AS BIGINT), 1) END)) AS i FROM c)",
    "raster_even": "WITH c AS (SELECT n_regionkey AS k, CAST(min(n_nationkey) AS DOUBLE) AS lo, CAST(max(n_nationkey) AS DOUBLE) AS hi FROM nation GROUP BY 1) SELECT k, lo + i * 0.5 AS t FROM (SELECT *, unnest(range(0, CAST((hi - lo) * 2 AS BIGINT) + 1)) AS i FROM c)",
    "resample_prev": _GRID.format(step="1800.0") + near("p.*", "channel") + " SELECT channel, round(t, 3) AS t, coalesce(bv, av) AS v FROM n",
    "resample_linear": _GRID.format(step="7200.0") + near("p.*", "channel") + f" SELECT channel, round(t, 3) AS t, round({LINEAR}, 4) AS v FROM n",
    "resample_on_channel": f"WITH {S}, q AS (SELECT * FROM s), p AS (SELECT channel, t FROM (SELECT DISTINCT channel FROM s) CROSS JOIN (SELECT DISTINCT t FROM s WHERE channel = 'signup')), {near('p.*', 'channel')} SELECT channel, t, coalesce(bv, av) AS v FROM n",
    "wide_exact": f"WITH {S} SELECT t // 60000000 AS t, {', '.join(f'''arg_min(v, ord) FILTER (channel = '{n}') AS {n}''' for n in NAMES)} FROM s GROUP BY 1",
    "wide_prev": f"{_DAY}, f AS (SELECT channel, t, coalesce(bv, av) AS v FROM n) SELECT t, {_PIVOT} FROM f GROUP BY t",
    "wide_outside_null": f"{_DAY}, f AS (SELECT channel, t, CASE WHEN bt IS NOT NULL AND (nt IS NOT NULL OR bt = t) THEN bv END AS v FROM n) SELECT t, {_PIVOT} FROM f GROUP BY t",
    "from_wide": "SELECT t, l_linenumber, channel, v FROM (SELECT l_orderkey AS t, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem) UNPIVOT (v FOR channel IN (l_quantity, l_extendedprice, l_discount, l_tax))",
    "unique_names": "SELECT p_partkey, p_name, CASE WHEN n = 1 THEN p_name ELSE p_name || '_' || (n - 2) END AS unique_name FROM (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS n FROM part)",
    "flatten_structs": "SELECT c_custkey, c_name AS c_name, c_acctbal AS c_more_balance, c_nationkey AS c_more_nation FROM customer",
    "chunked_frames": "SELECT o_orderkey // 1000 AS chunk, count(*) AS rows, min(o_orderkey) AS first, max(o_orderkey) AS last FROM orders GROUP BY 1",
    **{f"signal_{k}": _arith_sql(v, True) for k, v in ARITH.items()},
    **{f"signal_{k}": _arith_sql(v, False) for k, v in COMPARED.items()},
}
