"""Operators against numpy, truth tables and round trips."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterflow.functions import convert as cv
from meterflow.functions import computed, filters, scalar, userfn
from meterflow.model import Options
from meterflow.operators import align, bus, cut, frame, merge, resample, select, stats
from meterflow.sources import dbc, records, sinks


def samples(spark, rows, schema="channel string, ord long, t double, v double"):
    return spark.createDataFrame(rows, schema)


def by_time(df, *columns):
    return [tuple(r) for r in df.orderBy("t").select(*columns).collect()]


@pytest.mark.parametrize("bucket", [0.5, 3.0, 1e9])
@pytest.mark.parametrize("seed", range(3))
def test_interpolation_as_numpy(spark, bucket, seed):
    rng = np.random.RandomState(seed)
    t = np.sort(rng.choice(np.arange(0, 20, 0.25), 30, replace=False))
    v = rng.rand(30) * 10
    probes = np.unique(np.concatenate((rng.uniform(-2, 23, 25), t[::5])))
    s = samples(spark, [("a", i, float(x), float(y)) for i, (x, y) in enumerate(zip(t, v))])
    p = spark.createDataFrame([("a", float(x)) for x in probes], "channel string, t double")
    got = by_time(align.interpolate(s, p, ["channel"], bucket=bucket), "t", "v")
    assert np.allclose([g[1] for g in got], np.interp(probes, t, v), rtol=0, atol=1e-12)
    got = by_time(align.interpolate(s, p, ["channel"], "S", bucket=bucket), "t", "v")
    at = np.maximum(np.searchsorted(t, probes, "right") - 1, 0)
    assert [g[1] for g in got] == v[at].tolist()


def test_equal_stamps_take_the_last(spark):
    s = samples(spark, [("a", 0, 1.0, 1.0), ("a", 1, 1.0, 2.0), ("a", 2, 2.0, 5.0)])
    p = spark.createDataFrame([("a", 1.0), ("a", 1.5)], "channel string, t double")
    assert by_time(align.interpolate(s, p, ["channel"], "S"), "t", "v") == [(1.0, 2.0), (1.5, 2.0)]


def test_integers_are_cut_towards_zero(spark):
    s = samples(spark, [("a", 0, 0.0, -3), ("a", 1, 2.0, 4)], "channel string, ord long, t double, v long")
    p = spark.createDataFrame([("a", 0.5)], "channel string, t double")
    assert align.interpolate(s, p, ["channel"], "i", options=Options(integer_mode=1)).first()["v"] == -1
    assert align.interpolate(s, p, ["channel"], "i").first()["v"] == -3


def test_resample_with_a_gap(spark):
    t = [*range(500), *range(1000, 1500)]
    s = samples(spark, [("a", i, float(x), float(i)) for i, x in enumerate(t)])
    got = by_time(resample.resample(s, ["channel"], 1.33, bucket=100), "t", "v")
    grid = np.arange(0, 1499, 1.33)
    assert len(got) == len(grid) and np.allclose([g[1] for g in got], np.interp(grid, t, np.arange(1000.0)))
    with pytest.raises(ValueError):
        resample.raster(resample.spans(s, ["channel"]), ["channel"], 0)


def test_raster_ends(spark):
    s = spark.createDataFrame([("a", 1.0, 4.0)], "k string, lo double, hi double")
    assert [r[0] for r in by_time(resample.raster(s, ["k"], 0.5, chunk=2), "t")] == [1 + i / 2 for i in range(7)]
    assert [r[0] for r in by_time(resample.raster(s, ["k"], 2.0, endpoint=True), "t")] == [1.0, 3.0, 4.0]


def test_cut_truth_table(spark):
    s = samples(spark, [("a", i, float(i), float(i)) for i in range(5)])
    run = lambda a, b, **k: by_time(cut.cut(s, ["channel"], a, b, **k), "t", "v")
    assert run(0.5, 2.5) == [(0.5, 0.5), (1.0, 1.0), (2.0, 2.0), (2.5, 2.5)]
    assert run(0.5, 2.5, linear=False)[0] == (0.5, 0.0)
    assert run(1.2, 1.4) == [(1.2, 1.2), (1.4, 1.4)] and run(1.5, 1.5) == [(1.5, 1.5)]
    assert run(1.2, 1.4, ends=False) == [] and run(7.0, 9.0) == [] and run(-3.0, -1.0) == []
    assert run(-1.0, 0.0) == [(0.0, 0.0)] and run(4.0, 8.0) == [(4.0, 4.0)]


def test_cut_pieces_concatenate_to_the_whole(spark):
    rng = random.Random(5)
    rows = [("a", i, i * 10.0, rng.random()) for i in range(100)]
    s = samples(spark, rows)
    cuts = [0, 195, 401, 666, 803, 1000]
    parts = None
    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
        part = cut.cut(s, ["channel"], a, b - 1e-6, ends=False).withColumns({"measurement_id": F.lit(i), "ord": F.lit(0).cast("long")})
        parts = part if parts is None else parts.unionByName(part)
    starts = spark.createDataFrame([(i, i, 0.0) for i in range(5)], "measurement_id int, position int, start double")
    assert by_time(merge.concatenate(parts, starts), "t", "v") == [(r[2], r[3]) for r in rows]


def test_cut_keeps_nothing_of_invalid(spark):
    s = spark.createDataFrame([(1, True), (2, False), (3, None)], "v int, invalid boolean")
    assert [r["v"] for r in cut.keep_valid(s).collect()] == [2, 3]


def test_arithmetic_on_the_common_span(spark):
    a = samples(spark, [("a", i, float(i), float(i)) for i in range(5)])
    b = samples(spark, [("a", i, i + 0.5, 10.0) for i in range(3)])
    got = by_time(align.combine(a, b, ["channel"], "add"), "t", "v")
    assert got == [(t, t + 10) for t in (0.5, 1.0, 1.5, 2.0, 2.5)]


def test_wide_frames(spark):
    s = samples(spark, [("x", 0, 0.0, 1.0), ("x", 1, 2.0, 3.0), ("y", 2, 1.0, 5.0)])
    assert by_time(frame.wide_exact(s, [], "channel", ["x", "y"]), "t", "x", "y") == [(0.0, 1.0, None), (1.0, None, 5.0), (2.0, 3.0, None)]
    assert by_time(frame.wide(s, [], "channel", ["x", "y"], linear=True), "t", "x", "y") == [(0.0, 1.0, 5.0), (1.0, 2.0, 5.0), (2.0, 3.0, 5.0)]
    assert by_time(frame.wide(s, [], "channel", ["x", "y"], True, True), "t", "y") == [(0.0, None), (1.0, 5.0), (2.0, None)]


def test_flatten_nested(spark):
    df = spark.sql("SELECT named_struct('a', 1, 'b', named_struct('c', 2)) AS s, array(1, 2) AS x")
    assert frame.flatten(df).columns == ["s.a", "s.b.c", "x"] and frame.flatten(df, basenames=True).columns == ["a", "c", "x"]


@pytest.mark.parametrize("x,want", [(-1.0, 1.0), (0.0, 1.0), (0.5, 1.0), (0.51, 2.0), (2.0, 2.0), (3.5, 4.0), (9.0, 4.0)])
def test_nearest_key(spark, x, want):
    assert spark.range(1).select(cv.table(F.lit(x), [0, 1, 5], [1.0, 2.0, 4.0], False)).first()[0] == want


def test_conversions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(cv.rational(F.lit(2.0), (0, 0, 1, 0, 1, -2))) == math.inf and math.isnan(one(cv.quotient(F.lit(0.0), F.lit(0.0))))
    rows = [(0, 9, 100.0), (10, 19, 200.0)]
    assert [one(cv.ranges(F.lit(i), rows, -1.0, True)) for i in (-1, 0, 9, 10, 19, 20)] == [-1.0, 100.0, 100.0, 200.0, 200.0, -1.0]
    assert one(cv.ranges(F.lit(9.0), rows, -1.0, False)) == -1.0
    assert one(cv.convert(F.lit(3), {"type": "value_to_text", "rows": {3: "three"}, "default": "?"})) == "three"
    assert one(cv.convert(F.lit(3), {"type": "value_to_text", "rows": {3: "three"}}, skip_text=True)) == 3
    nested = {"type": "range_to_text", "rows": [(0, 1, "low")], "default": {"type": "value_to_text", "rows": {5: "five"}, "default": "other"}}
    assert [one(cv.convert(F.lit(i), nested, whole=True)) for i in (1, 5, 6)] == ["low", "five", "other"]
    assert one(cv.convert(F.lit("ab\0"), {"type": "text_to_text", "rows": {"ab": "c"}})) == "c"
    assert one(cv.bitfield(F.lit(6), [(2, {2: "up"}, "dir"), (4, {4: "on"}, None), (1, {1: "x"}, None)])) == "dir=up|on"
    assert abs(one(cv.formula(F.lit(2.0), "-X ** 2 + 3 * (X1 - 1) / 2")) + 2.5) < 1e-12
    for bad in ("__import__('os')", "X + ", "open(X)", "X; 1"):
        with pytest.raises((ValueError, IndexError)):
            cv.formula(F.lit(1.0), bad)
    c = {"type": "rational", "p": (0, 3, 4, 0, 5, 6)}
    assert abs(one(cv.convert(cv.convert(F.lit(1.25), c), cv.inverse(c))) - 1.25) < 1e-12
    assert cv.from_dict({"lower_0": 0, "upper_0": 1, "text_0": "a", "default": "b"}) == {"type": "range_to_text", "rows": [(0, 1, "a")], "default": "b"}


@pytest.mark.parametrize("seed", range(4))
def test_bits_as_integers(spark, seed):
    rng = random.Random(seed)
    data = bytes(rng.randrange(256) for _ in range(8))
    little, big, columns, want = int.from_bytes(data, "little"), int.from_bytes(data, "big"), [], []
    payload = F.lit(bytearray(data))
    for _ in range(25):
        size = rng.randint(1, 40)
        at = rng.randint(0, 63 - size)
        columns += [bus.unsigned(payload, F.lit(at), F.lit(size), F.lit(True)), bus.unsigned(payload, F.lit(at // 8 * 8 + 7 - at % 8), F.lit(size), F.lit(False))]
        want += [little >> at & (1 << size) - 1, big >> (64 - at - size) & (1 << size) - 1]
    got = spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()
    assert list(got) == want


def test_floats_from_bits(spark):
    import struct

    for v in (1.5, -0.1, 0.0, 1e-40, 3e38, math.inf):
        raw = F.lit(int.from_bytes(struct.pack("<f", v), "little"))
        assert spark.range(1).select(bus.ieee(raw, F.lit(32))).first()[0] == struct.unpack("<f", struct.pack("<f", v))[0]
    raw = F.lit(int.from_bytes(struct.pack("<d", -math.pi), "little", signed=True))
    assert spark.range(1).select(bus.ieee(raw, F.lit(64))).first()[0] == -math.pi


def test_transport_messages(spark):
    f = [(0.112, 0, "100B490401020304"), (0.113, 1, "2105060708090A33"), (0.116, 2, "3000000000000000"), (0.2, 3, "2255555555555555"), (0.3, 4, "1014414243444546")]
    frames = spark.createDataFrame([("a", t, o, bytearray.fromhex(h)) for t, o, h in f], "id string, t double, ord long, payload binary")
    for bucket in (0.01, 10.0):
        got = bus.merge_transport(frames, ["id"], bucket).collect()
        assert [(r["t"], r["size"], bytes(r["payload"]).hex()) for r in got] == [(0.113, 11, "4904010203040506070809")]


def test_records(spark, tmp_path):
    rows = b"HEAD" + b"".join((i).to_bytes(2, "little") + (-i).to_bytes(4, "big", signed=True) + b"ab\0\0" + bytes([1 << (i % 8)]) for i in range(50))
    (tmp_path / "x.bin").write_bytes(rows)
    r = records.records(spark, str(tmp_path), 11, header=4)
    layout = [records.Field("u", 0, 16), records.Field("s", 2, 32, "i", big_endian=True), records.Field("name", 6, 32, "text"), records.Field("b", 0, 5, bit_offset=2, invalid_bit=3)]
    got = records.fields(r, layout, trailer=10).orderBy("ordinal").collect()
    assert [(g["u"], g["s"], g["name"], g["b"], g["b_invalid"]) for g in got] == [(i, -i, "ab", i >> 2 & 31, i % 8 == 3) for i in range(50)]


def test_unaligned_fields(spark):
    data = bytes.fromhex("04020000F804023F")
    row = spark.createDataFrame([(bytearray(data),)], "record binary")
    layout = [records.Field("le", 0, 16), records.Field("be", 0, 16, big_endian=True), records.Field("bits", 4, 21, bit_offset=6)]
    got = records.fields(row, layout).first()
    assert (got["le"], got["be"], got["bits"]) == (0x0204, 0x0402, (0x3F0204F8 >> 6) & (1 << 21) - 1)


def test_dbc(spark):
    text = """BO_ 2364540158 EEC1: 8 Vector
 SG_ Speed : 24|16@1+ (0.125,0) [0|8031.875] "rpm" Vector
BO_ 100 Muxed: 8 X
 SG_ Sel M : 0|8@1+ (1,0) [0|0] "" X
 SG_ A m1 : 8|8@1- (2,-1) [0|0] "" X
 SG_ B m2 : 15|8@0+ (1,0) [0|0] "" X
SG_MUL_VAL_ 100 B Sel 2-5;"""
    lines = spark.createDataFrame([("f", i, x) for i, x in enumerate(text.split("\n"))], "path string, n int, value string")
    s = dbc.signals(lines)
    got = {r["signal"]: r for r in s.collect()}
    assert got["Speed"]["message_id"] == 2364540158 & 0x1FFFFFFF and got["Speed"]["factor"] == 0.125
    assert (got["A"]["mux"], got["A"]["mux_min"], got["A"]["is_signed"]) == ("Sel", 1, True) and (got["B"]["mux_min"], got["B"]["mux_max"]) == (2, 5)
    frames = spark.createDataFrame([("CAN1", 100, float(i), bytearray([i, 255 - i, 0, 0, 0, 0, 0, 0])) for i in range(7)], "bus string, id long, t double, payload binary")
    out = {(r["signal"], r["t"]): r["v"] for r in bus.decode(frames, s).collect()}
    assert {k: v for k, v in out.items() if k[0] != "Sel"} == {("A", 1.0): (254 - 256) * 2 - 1, **{("B", float(i)): 255 - i for i in range(2, 6)}}


def test_errors_in_selection(spark):
    c = spark.createDataFrame([(0, 1, "SIG"), (1, 1, "SIG"), (1, 2, "B")], "group_index int, channel_index int, name string")
    assert select.resolve(c, "SIG", 1) == (1, 1) and select.resolve(c, "SIG", first=True) == (0, 1) and select.resolve(c, None, 1, 2) == (1, 2)
    for bad in (("SIG",), ("x",)):
        with pytest.raises(select.ChannelError):
            select.resolve(c, *bad)


def test_search_modes(spark):
    names = spark.createDataFrame([("foo",), ("Bar",), ("baz",)], "name string")
    find = lambda *a: sorted(r[0] for r in names.where(select.name_matches("name", *a)).collect())
    assert find("ba") == ["baz"] and find("ba", "plain", True) == ["Bar", "baz"] and find("b*", "wildcard") == ["baz"]
    assert find("^B", "regex") == ["Bar"] and find("^b.*", "regex", True) == ["Bar", "baz"]


def test_nan_conditions(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),)], "v double")
    nan = float("nan")
    assert df.where(select.condition("v", "==", nan)).count() == 1 and df.where(select.condition("v", "!=", nan)).first()["v"] == 1.0
    assert df.where(select.condition("v", ">", 0.5)).count() == 1


def test_statistics(spark):
    t, v = [0.0, 1.0, 3.0, 4.0], [1.0, 3.0, float("inf"), -1.0]
    s = samples(spark, [("a", i, x, y) for i, (x, y) in enumerate(zip(t, v))])
    r = stats.summary(s, ["channel"], bucket=1.5, per_second=1).first()
    assert (r["n"], r["min"], r["max"], r["delta"], r["span"], r["gradient"]) == (3, -1.0, 3.0, -2.0, 4.0, -0.5)
    assert abs(r["integral"] - np.trapezoid([1, 3, -1], [0, 1, 4])) < 1e-12 and abs(r["std"] - np.std([1, 3, -1])) < 1e-12


def test_downcast():
    assert [stats.downcast_type(*a) for a in ((0, 254, False), (0, 255, False), (-5, 126, False), (-5, 127, False), (0, 1 << 40, False), (0, 1, True))] == ["smallint", "int", "tinyint", "smallint", "decimal(20,0)", "float"]


def test_functions_of_the_user(spark):
    with pytest.raises(ValueError):
        userfn.check_function(lambda a: a)
    assert userfn.argument(["x", "0x10"], {"y"}) == 16 and userfn.argument(["x", "y"], {"y"}) == "y" and userfn.argument(["none"], set()) is None
    f = spark.createDataFrame([("k", float(i), float(i)) for i in range(6)], "k string, t double, a double")

    def pairs(a=0, t=0):
        return a[1:] + a[:-1]

    assert by_time(userfn.per_channel(f, ["k"], pairs), "t", "v") == [(float(i), 2.0 * i - 1) for i in range(1, 6)]


def test_fields_at_any_bit(spark):
    """Fields of 1 to 64 bits against whole numbers in Python."""
    rng = np.random.RandomState(9)
    rows = []
    for _ in range(400):
        data, size = rng.bytes(rng.randint(1, 17)), int(rng.randint(1, 65))
        at, little = int(rng.randint(0, 8 * 9)), bool(rng.randint(2))
        whole = data + b"\xff" * 40
        if little:
            want = int.from_bytes(whole, "little") >> at & (1 << size) - 1
        else:
            top = at // 8 * 8 + 7 - at % 8
            want = int.from_bytes(whole, "big") >> (8 * len(whole) - top - size) & (1 << size) - 1
        rows.append((bytearray(data), at, size, little, want - (1 << 64) if want >> 63 else want))
    df = spark.createDataFrame(rows, "p binary, at int, size int, little boolean, want long")
    got = df.select(bus.unsigned(F.col("p"), F.col("at"), F.col("size"), F.col("little")).alias("got"), "want").collect()
    assert all(r["got"] == r["want"] for r in got)


def test_nan_compares_as_in_numpy(spark):
    nan = float("nan")
    values = [1.0, nan, 5.0]
    rows = [(i, x, y) for i, (x, y) in enumerate((x, y) for x in values for y in values)]
    df = spark.createDataFrame(rows, "i int, x double, y double")
    for name, f in {"lt": np.less, "le": np.less_equal, "gt": np.greater, "ge": np.greater_equal, "eq": np.equal, "ne": np.not_equal}.items():
        got = {r["i"]: r["v"] for r in df.select("i", align.OPERATORS[name](F.col("x"), F.col("y")).alias("v")).collect()}
        assert got == {i: bool(f(x, y)) for i, x, y in rows}
    for op, f in {"<": np.less, "<=": np.less_equal, ">": np.greater, ">=": np.greater_equal, "==": np.equal, "!=": np.not_equal}.items():
        for target in (3, 5, 5.0):
            got = [r["x"] for r in df.where("i % 3 = 0").where(select.condition("x", op, target)).collect()]
            assert len(got) == sum(bool(f(x, target)) for x in values)


def test_many_samples_in_one_bucket(spark):
    """Neighbours are found in one pass: a hundred thousand samples and probes in a single bucket take seconds."""
    s = spark.range(100_000).select(F.lit("a").alias("channel"), (F.col("id") * 10.0).alias("t"), F.col("id").alias("ord"), F.col("id").cast("double").alias("v"))
    p = spark.range(100_000).select(F.lit("a").alias("channel"), (F.col("id") * 10.0 + 5).alias("t"))
    out = align.interpolate(s, p, ["channel"], bucket=1e9)
    assert out.where("abs(v - (t / 10)) > 1e-6 AND t < 999990").count() == 0
    both = align.combine(s, s.withColumn("t", F.col("t") + 5), ["channel"], "sub", bucket=1e9)
    assert both.where("abs(v - 0.5) > 1e-6").count() == 0 and both.count() == 199_998


def test_bucket_width(spark):
    s = samples(spark, [("a", i, float(i), 0.0) for i in range(100)] + [("b", i, i / 100, 0.0) for i in range(300)])
    width = align.bucket_width(s, ["channel"], rows=50)
    assert s.groupBy("channel", F.floor(F.col("t") / width)).count().agg(F.max("count")).first()[0] <= 60
    assert align.bucket_width(s.limit(0), ["channel"]) == 1.0


def test_wide_over_bucket_edges(spark):
    s = samples(spark, [("a", 0, 0.0, 1.0), ("a", 1, 10.0, 2.0), ("b", 2, 4.0, 5.0), ("b", 3, 25.0, 6.0)])
    for bucket in (3.0, 1000.0):
        got = [tuple(r) for r in frame.wide(s, [], "channel", ["a", "b"], linear=True, bucket=bucket).orderBy("t").collect()]
        assert got == [(0.0, 1.0, 5.0), (4.0, 1.4, 5.0), (10.0, 2.0, 5 + 6 / 21), (25.0, 2.0, 6.0)]
        null = [tuple(r) for r in frame.wide(s, [], "channel", ["a", "b"], outside_null=True, bucket=bucket).orderBy("t").collect()]
        assert null == [(0.0, 1.0, None), (4.0, 1.0, 5.0), (10.0, 2.0, 5.0), (25.0, None, 6.0)]


def response(sections, f, rate):
    z = np.exp(-2j * np.pi * f / rate)
    return abs(np.prod([(b0 + b1 * z + b2 * z * z) / (1 + a1 * z + a2 * z * z) for b0, b1, b2, _, a1, a2 in sections], axis=0))


@pytest.mark.parametrize("family", ["chebyshev1", "chebyshev2", "elliptic"])
@pytest.mark.parametrize("order", [2, 3, 5])
@pytest.mark.parametrize("kind,cut_at", [("low", 10.0), ("high", 10.0), ("band", (8.0, 15.0)), ("stop", (8.0, 15.0))])
def test_filters_keep_their_bounds(family, order, kind, cut_at):
    """Ripple in the pass band and attenuation in the stop band are met, and reached."""
    f = np.linspace(0.05, 49.95, 4000)
    gain = 20 * np.log10(np.maximum(response(filters.sections(order, cut_at, kind, 100.0, family, 1.0, 40.0), f, 100.0), 1e-12))
    inside = {"low": f < 10, "high": f > 10, "band": (f > 8) & (f < 15), "stop": (f < 8) | (f > 15)}[kind]
    assert gain.max() < 1e-6
    if family != "chebyshev2":
        assert -1.0001 <= gain[inside].min() < -0.9
    else:
        assert -40.3 < gain[~inside].max() < -39.9
    if family == "elliptic" and order == 5:
        assert (gain[~inside] < -39.9).mean() > 0.4


def test_descriptions():
    nested = {"computed": True, "computation": {"type": "arithmetic", "op": "+", "operand1": "a", "operand2": {"computed": True, "computation": {"type": "expression", "expression": "{{b}} * {{c}}"}}}}
    user = {"computed": True, "computation": {"type": "python_function", "args": {"x": ["d", "e"], "y": [""]}, "triggering": "triggering_on_channel", "triggering_value": "f"}}
    assert computed.required(nested) == ["a", "b", "c"] and computed.required(user) == ["d", "e", "f"] and computed.required({"computed": False}) == []
    assert computed.variables("a = 3\nb = [1, 2]\nc = a") == {"a": 3, "b": [1, 2], "c": 3}
    for text in ("import os", "a = open('x')", "a += 1"):
        with pytest.raises(ValueError):
            computed.variables(text)
    assert computed.modes(lambda a=1, t=0: a + t) == {"per_sample": True, "per_channel": True}
    assert computed.modes(lambda a=1, t=0: np.diff(a)) == {"per_sample": False, "per_channel": True}


def test_attachments_versions_and_exports(spark, tmp_path):
    a = spark.createDataFrame([], "index int, file_name string, mime string, comment string, data binary, size int, md5 string")
    more = spark.createDataFrame([("b.txt", "text/plain", "", bytearray(b"xy")), ("a.txt", "text/plain", "", bytearray(b""))], "file_name string, mime string, comment string, data binary")
    got = merge.attach(a, more).orderBy("index").collect()
    assert [(r["index"], r["file_name"], r["size"]) for r in got] == [(0, "a.txt", 0), (1, "b.txt", 2)]
    m = spark.createDataFrame([("m", "3.30")], "id string, version string")
    assert merge.converted(m, "4.10").first()["version"] == "4.10"
    with pytest.raises(ValueError):
        merge.converted(m, "9.99")
    sinks.export(m, "table", str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).first()["id"] == "m"
    with pytest.raises(ValueError):
        sinks.export(m, "mat", str(tmp_path / "x"))
    f = spark.createDataFrame([(0.5, 7, bytearray(b"\x01\xff"), 1), (0.6, 7, None, 0)], "t double, id int, payload binary, channel int")
    assert [r["value"] for r in sinks.flexray_lines(f).collect()] == ["    0.500000 Fr RMSG 0 0 7 B 2 01 FF"]


@pytest.mark.parametrize("kind,cut_at,good,bad", [("low", 5.0, 0.5, 40.0), ("high", 20.0, 45.0, 1.0), ("band", (8.0, 12.0), 9.8, 40.0), ("stop", (8.0, 12.0), 1.0, 9.8)])
def test_butterworth(kind, cut_at, good, bad):
    sections = filters.sections(3, cut_at, kind, 100.0)

    def gain(f):
        z = np.exp(-2j * np.pi * f / 100)
        return abs(np.prod([(b0 + b1 * z + b2 * z * z) / (1 + a1 * z + a2 * z * z) for b0, b1, b2, _, a1, a2 in sections]))

    assert abs(gain(good) - 1) < 0.03 and gain(bad) < 0.06
    for f in np.atleast_1d(cut_at):
        assert abs(gain(f) - math.sqrt(0.5)) < 1e-6
    x = np.random.RandomState(1).rand(50)
    y = userfn.run_sections(sections, x)
    assert np.isfinite(y).all()


def test_exports(spark, tmp_path):
    s = spark.createDataFrame([(0.5, 1, bytearray(b"\xa2\xc3"), "x")], "t double, a int, b binary, c string")
    sinks.to_parquet(s, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).columns == ["t", "a"]
    sinks.to_csv(s, str(tmp_path / "c"), {"a": "m"}, sep=";")
    assert spark.read.csv(str(tmp_path / "c"), header=True, sep=";").first().asDict() == {"t": "0.5", "a [m]": "1", "b": "A2 C3", "c": "x"}
    assert sinks.csv_rows(s, start="2024-01-01 00:00:00").first()["t"] == "2024-01-01 00:00:00.500000"
    g = spark.createDataFrame([(0, 1.0), (1, 2.0)], "group_index int, v double")
    sinks.to_csv_by_group(g, str(tmp_path / "g"))
    assert spark.read.csv(str(tmp_path / "g"), header=True).count() == 2
    f = spark.createDataFrame([(0.25, "1", 291, bytearray(b"\x01\x02"), True)], "t double, bus string, id long, payload binary, is_tx boolean")
    f = f.withColumns({"is_extended": F.lit(False), "is_error": F.lit(False)})
    assert sinks.asc_lines(f).first()["value"] == "    0.250000 1  123             Tx   d 2 01 02"
    a = sinks.scramble(spark.createDataFrame([("secret name",)], "n string"), ["n"], "salt").first()["n"]
    assert len(a) == 11 and a != "secret name"


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(scalar.round_half_even(F.lit(0.205), 2)) == np.around(0.205, 2)
    assert one(scalar.modulo(F.lit(-7.0), F.lit(3.0))) == -7 % 3 and one(scalar.signed(F.lit(0b1110).cast("long"), 4)) == -2
    assert one(scalar.decoded(F.lit(bytearray(b"ab\0c")))) == "ab" and one(scalar.decoded(F.lit(bytearray(b"\xe9")))) == "é"
    assert one(scalar.xml_comment(F.lit("<CN><TX>hi</TX></CN>"))) == "hi" and one(scalar.spaced_hex(F.lit(bytearray(b"\xa2\xc3\x08")))) == "A2 C3 08"
    assert str(one(scalar.absolute(F.lit("2024-01-01").cast("timestamp_ntz"), F.lit(1.5)))) == "2024-01-01 00:00:01.500000"


def test_next_match_takes_the_first_of_a_stamp(spark):
    """Stamps that rounding makes equal: the sample of the least ``ord`` counts, whichever partition it lies in."""
    rows = [("p", i, 100.0 + i / 10_000, 60.0) for i in range(200)]  # 50 to 149 are 100.01 in hundredths
    first = lambda s, *a: tuple(select.next_match(s, "ord", *a, digits=2).first())
    for order in (rows, rows[::-1], random.Random(7).sample(rows, 200)):
        s = samples(spark, order).repartition(5, "ord")
        assert first(s, 100.004, F.col("v") > 50) == (100.01, 50)
        assert first(s, 100.02, F.col("v") > 50, False) == (100.01, 50)
    assert first(samples(spark, [("p", None, 100.01, 60.0), ("p", 3, 100.01, 60.0)]), 100.0, F.col("v") > 50) == (100.01, 3)
    assert first(samples(spark, [("p", 1, 100.005, 60.0)]), 100.005, F.col("v") > 50) == (None, None)  # rounded as the start is


def test_next_rounded_with_its_sql(spark, data, tmp_path):
    """Five copies of the events with other keys: purchases within a rounding are taken by event_id, as one thread of the SQL reads them."""
    import duckdb

    from meterflow.plans import records as plans

    db = duckdb.connect(config={"threads": 1})
    db.sql(f"COPY (SELECT * REPLACE (event_id + k * 100000 AS event_id, user_id + k * 1500 AS user_id) FROM range(5) r(k), '{data}/sf0.1/events.parquet' ORDER BY event_id) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    db.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    assert tuple(plans.next_rounded(spark, str(tmp_path)).select("t", "ord").first()) == db.execute(plans.ORACLE_SQL["next_rounded"]).fetchone()


def test_rounding_as_sql(spark):
    """Halves and near-halves, ends of the range and signs of zero, as the SQL of the queries rounds."""
    import duckdb

    r = random.Random(5)
    x = [2.56125, -2.56125, 0.00005, -0.00001, 0.0, 1e300, 1e305, -1.5e308, 1e18, float("inf"), float("nan"), None, 0.49999999999999994e-4, *[i / 100_000 for i in range(-50, 2000, 5)], *[r.uniform(-1e6, 1e6) for _ in range(200)]]
    got = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "i int, x double").select("i", scalar.round_half_away(F.col("x"), 4).alias("x")).orderBy("i").collect()
    assert [str(row["x"]) for row in got] == [str(duckdb.execute("SELECT round($1::DOUBLE, 4)", [v]).fetchone()[0]) for v in x]


def test_quotients_with_their_sql(spark, tmp_path):
    """Quotients beside a half of the fourth decimal, by zero, of zero, beside nulls; all operators whose SQL rounds, digit by digit."""
    import duckdb

    from meterflow.plans import alignment as plans

    r, rows = random.Random(3), [(20.49, 8.0), (2.05, 0.8), (5.0, 0.0), (0.0, 0.0), (0.0, 8.0), (5.0, None), (None, 8.0), (0.0, None), (None, None)]
    rows += [(r.randrange(1, 60_000) / 100, r.choice([0.16, 0.32, 0.8, 1.28, 1.6, 3.2, 6.4, 8.0, 16.0])) for _ in range(400)]
    values = [(2 * i + k, f"2024-01-01 00:00:00.{i:06d}", i // 3, kind, v) for i, pair in enumerate(rows) for k, (kind, v) in enumerate(zip(("click", "view"), pair))]
    spark.createDataFrame(values, "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    for name in ("signal_div", "signal_mul", "signal_add", "signal_sub", "signal_mod"):
        got = plans.QUERIES[name](spark, str(tmp_path)).select("user_id", "t", "v").collect()
        want = db.execute(f"SELECT user_id, t, v FROM ({plans.ORACLE_SQL[name]})").fetchall()
        assert len(got) == len(rows) and sorted((u, t, str(v)) for u, t, v in got) == sorted((u, t, str(v)) for u, t, v in want), name


def test_report_of_stamps_over_bucket_edges(spark):
    s = samples(spark, [("a", i, t, 0.0) for i, t in enumerate([1.0, 2.0, 2.0, 1.5, 3.0])])
    assert [r["ord"] for r in cut.increasing(s, ["channel"], bucket=2).orderBy("ord").collect()] == [0, 1, 4]
    assert [r["ord"] for r in cut.not_increasing(s, ["channel"], bucket=2).orderBy("ord").collect()] == [2, 3]


def test_empty_tables(spark):
    s = samples(spark, [])
    p = spark.createDataFrame([("a", 1.0)], "channel string, t double")
    assert align.interpolate(s, p, ["channel"]).first()["v"] is None
    assert stats.summary(s, ["channel"]).count() == 0 and cut.cut(s, ["channel"], 0, 1).count() == 0
