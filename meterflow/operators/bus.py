"""Bus logging: signals out of frame payloads, by a table of signal definitions.

Frames are (bus, id, t, payload BINARY); definitions (message_id, message, signal, start_bit, size, little_endian,
is_signed, is_float, factor, offset, mux, mux_min, mux_max, …) come from :mod:`meterflow.sources.dbc` or any table. A frame meets
the signals of its message by an equi-join on the id; extraction is integer arithmetic on the payload's bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .align import bucket_width

#: Error types of CAN error frames.
#: Greatest valid raw value of a J1939 field of so many bits.
MAX_VALID = {4: 0xA, 8: 0xFA, 10: 0x3FA, 12: 0xFAF, 16: 0xFAFF, 20: 0xFAFFF, 24: 0xFAFFFF, 28: 0xFAFFFFF, 32: 0xFAFFFFFF, 64: 0xFFFFFFFFFFFFFFFF}
#: Kinds of frames in a FlexRay trace.
FLEXRAY_EVENTS = {0: "FlexRay Frame", 1: "FlexRay NullFrame", 2: "FlexRay StartCycle", 3: "FlexRay Status"}
CAN_ERRORS = {0: "UNKNOWN", 1: "BIT ERROR", 2: "FORM ERROR", 3: "BIT STUFFING ERROR", 4: "CRC ERROR", 5: "ACK ERROR"}


def byte_at(payload: Column, i: Column) -> Column:
    """Byte i (from 0) of a payload; bytes beyond its end are 0xFF."""
    two = F.substring(F.hex(payload), 2 * i + 1, F.lit(2))
    return F.when(F.length(two) == 2, F.conv(two, 16, 10).cast("long")).otherwise(F.lit(255).cast("long"))


def unsigned(payload: Column, start_bit: Column, size: Column, little_endian: Column) -> Column:
    """An unsigned field of up to 64 bits at any bit, as BIGINT of its bits; bytes beyond the payload's end are 0xFF.

    ``start_bit``: of the least significant bit, counted from byte 0's bit 0, for little-endian fields; of the most
    significant bit, in the same count, for big-endian ones. The bytes are read as one hexadecimal number, of 18 digits at most."""
    first = F.floor(start_bit / 8).cast("int")
    inner = F.when(little_endian, F.pmod(start_bit, F.lit(8))).otherwise(F.lit(7) - F.pmod(start_bit, F.lit(8)))
    n = F.ceil((inner + size) / 8).cast("int")
    text = F.rpad(F.hex(F.substring(payload, first + 1, n)), 2 * n, F.lit("F"))
    digits = F.when(little_endian, F.regexp_replace(F.reverse(text), "(.)(.)", "$2$1")).otherwise(text)
    low = F.conv(F.right(digits, F.lit(16)), 16, -10).cast("long")
    high = F.when(n > 8, F.conv(F.substring(digits, 1, 2), 16, 10).cast("long")).otherwise(F.lit(0).cast("long"))
    down = F.when(little_endian, inner).otherwise(n * 8 - inner - size).cast("int")
    moved = F.call_function("shiftrightunsigned", low, down).bitwiseOR(F.when(n > 8, F.call_function("shiftleft", high, 64 - down)).otherwise(F.lit(0).cast("long")))
    return moved.bitwiseAND(F.call_function("shiftrightunsigned", F.lit(-1).cast("long"), (64 - size).cast("int")))


def two_complement(raw: Column, size: Column) -> Column:
    top = F.pow(F.lit(2.0), size - 1).cast("long")
    return F.when((size < 64) & (raw >= top), raw - top - top).otherwise(raw)


def ieee(raw: Column, size: Column) -> Column:
    """The float whose bits are ``raw``: 16, 32 or 64 of them."""
    def value(exponent_bits: int, mantissa_bits: int) -> Column:
        bias = (1 << (exponent_bits - 1)) - 1
        sign = F.when(F.call_function("shiftrightunsigned", raw, F.lit(exponent_bits + mantissa_bits)).bitwiseAND(F.lit(1)) == 1, -1.0).otherwise(1.0)
        exponent = F.call_function("shiftrightunsigned", raw, F.lit(mantissa_bits)).bitwiseAND(F.lit((1 << exponent_bits) - 1))
        mantissa = raw.bitwiseAND(F.lit((1 << mantissa_bits) - 1)).cast("double") / float(1 << mantissa_bits)
        full = (1 << exponent_bits) - 1
        special = F.when(mantissa == 0, sign * float("inf")).otherwise(F.lit(float("nan")))
        return F.when(exponent == full, special).when(exponent == 0, sign * mantissa * F.pow(F.lit(2.0), F.lit(1 - bias))).otherwise(sign * (mantissa + 1) * F.pow(F.lit(2.0), exponent - bias))

    return F.when(size == 64, value(11, 52)).when(size == 16, value(5, 10)).otherwise(value(8, 23))


def padded(payload: Column, size: Column) -> Column:
    """The payload with 0xFF up to a message's size."""
    return F.unhex(F.rpad(F.hex(payload), F.greatest(size * 2, F.length(F.hex(payload))), "F"))


def defined_bits(bits: Column) -> Column:
    """The width that J1939 defines for a field of ``bits``: the next one that isn't smaller."""
    out = bits
    for width in sorted(MAX_VALID, reverse=True):
        out = F.when(bits <= width, width).otherwise(out)
    return out


def max_valid(bits: Column) -> Column:
    """Greatest valid raw value of a J1939 signal by its defined width: above it, "error" and "not available". 64 bits are all valid."""
    out = F.lit((1 << 63) - 1)
    for width, most in sorted(MAX_VALID.items(), reverse=True):
        out = F.when(bits <= width, F.lit(min(most, (1 << 63) - 1))).otherwise(out)
    return out.cast("long")


def decode(frames: DataFrame, signals: DataFrame, depth: int = 1) -> DataFrame:
    """Long samples (bus, message, signal, t, raw, v, invalid) of all signals of all frames whose id has a definition.

    A signal with a multiplexor (``mux``: that signal's name) is there when the multiplexor's value, itself decoded from
    the same payload, lies between mux_min and mux_max; ``depth`` is how deep multiplexors nest. J1939 signals above their valid range are flagged."""
    s = signals.select([F.col(c) for c in ("message_id", "message", "signal", "start_bit", "size", "little_endian", "is_signed", "is_float", "factor", "offset", "mux", "mux_min", "mux_max", "j1939")])
    by_name = s.select("message_id", F.col("signal").alias("_n"), F.col("start_bit").alias("_st"), F.col("size").alias("_si"), F.col("little_endian").alias("_le"), F.col("mux").alias("_up"), F.col("mux_min").alias("_lo"), F.col("mux_max").alias("_hi"))
    chain = s.withColumn("_mux", F.col("mux"))
    tests = []
    for k in range(depth):
        m = by_name.select(F.col("message_id").alias(f"_id{k}"), *[F.col(c).alias(f"{c}{k}") for c in ("_n", "_st", "_si", "_le", "_up", "_lo", "_hi")])
        chain = chain.join(m, (F.col("message_id") == F.col(f"_id{k}")) & (F.col("_mux") == F.col(f"_n{k}")), "left")
        low, high = (F.col("mux_min"), F.col("mux_max")) if k == 0 else (F.col(f"_lo{k - 1}"), F.col(f"_hi{k - 1}"))
        tests.append(F.col(f"_n{k}").isNull() | unsigned(F.col("payload"), F.col(f"_st{k}"), F.col(f"_si{k}"), F.col(f"_le{k}")).between(low, high))
        chain = chain.withColumn("_mux", F.col(f"_up{k}"))
    joined = frames.join(chain.withColumnRenamed("message_id", "id"), "id")
    for test in tests:
        joined = joined.where(test)
    raw = unsigned(F.col("payload"), F.col("start_bit"), F.col("size"), F.col("little_endian"))
    out = joined.withColumn("raw", F.when(F.col("is_signed"), two_complement(raw, F.col("size"))).otherwise(raw))
    number = F.when(F.col("is_float"), ieee(F.col("raw"), F.col("size"))).otherwise(F.col("raw").cast("double"))
    invalid = F.coalesce(F.col("j1939"), F.lit(False)) & (F.col("raw") > max_valid(F.col("size")))
    return out.select("bus", "id", "message", "signal", "t", "raw", (number * F.col("factor") + F.col("offset")).alias("v"), invalid.alias("invalid"))


def without_dead_channels(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Samples of channels of which at least one sample is valid."""
    dead = samples.groupBy(*keys).agg(F.bool_and("invalid").alias("dead")).where("dead")
    return samples.join(dead, keys, "left_anti")


def beyond_payload(signals: DataFrame) -> DataFrame:
    """Definitions of fields that reach beyond their message's size, for which payloads hold no data."""
    last = F.when(F.col("little_endian"), F.col("start_bit") + F.col("size")).otherwise((F.floor(F.col("start_bit") / 8) + F.ceil((7 - F.pmod("start_bit", F.lit(8)) + F.col("size")) / 8)) * 8)
    return signals.where(last > F.col("message_size") * 8)


def labelled(samples: DataFrame, values: DataFrame) -> DataFrame:
    """Decoded samples with ``label``, the text that ``values(message_id, signal, value, label)`` has for the raw value. Other samples keep their linear value alone."""
    texts = values.select(F.col("message_id").alias("id"), "signal", F.col("value").alias("raw"), "label")
    return samples.join(texts, ["id", "signal", "raw"], "left")


def scaled(samples: DataFrame, ranges: DataFrame) -> DataFrame:
    """Decoded samples with ``v`` by ranges of raw values, ``ranges(message_id, signal, low, high, factor, offset)``, both ends included; outside them as it is.

    The ranges of a signal are gathered into one array, of as many entries as a database has for it."""
    each = ranges.groupBy(F.col("message_id").alias("id"), "signal").agg(F.array_sort(F.collect_list(F.struct("low", "high", "factor", "offset"))).alias("_r"))
    fit = F.get(F.filter("_r", lambda r: F.col("raw").between(r["low"], r["high"])), F.lit(0))
    return samples.join(each, ["id", "signal"], "left").withColumn("v", F.coalesce(F.col("raw") * fit["factor"] + fit["offset"], "v")).drop("_r")


def aliases(samples: DataFrame, prefix: str = "") -> DataFrame:
    """The names that a decoded signal goes by: Signal, Message.Signal, BUSn.Message.Signal, and CAN_DataFrame_<id> in the message's place."""
    frame = F.concat(F.lit("CAN_DataFrame_"), F.col("id").cast("string"))
    parts = [["signal"], ["message", "signal"], ["bus", "message", "signal"], [frame, "signal"], ["bus", frame, "signal"]]
    return samples.withColumn("names", F.array(*[F.concat(F.lit(prefix), F.concat_ws(".", *p)) for p in parts]))


def bus_signal(samples: DataFrame, name: str) -> DataFrame:
    """Samples of one signal by any of its names."""
    return aliases(samples).where(F.array_contains("names", name)).drop("names")


def merge_transport(frames: DataFrame, keys: list[str], bucket: float | None = None, longest: float = 3_600_000_000) -> DataFrame:
    """Transport-protocol messages (keys, t, size, payload) from first (0x1n) and consecutive (0x2n) frames.

    The size is the 12 bits after the first nibble; a first frame gives six bytes, the others seven each, cut to size. t is that of the
    frame that completes the message; unfinished ones give nothing, and frames before any first one are left out. Frames of a message
    follow its first one within ``longest``; sessions are numbered within time buckets and carried over their edges. Without ``bucket`` their width is chosen by
    :func:`~.align.bucket_width`, which starts a job."""
    bucket = bucket or bucket_width(frames, keys)
    kind = F.shiftright(byte_at(F.col("payload"), F.lit(0)), 4)
    use = frames.withColumn("_k", kind).where("_k IN (1, 2)").withColumn("_b", F.floor(F.col("t") / bucket))
    start = F.when(F.col("_k") == 1, F.struct("t", "ord"))
    w = Window.partitionBy(*keys, "_b").orderBy("t", "ord").rowsBetween(Window.unboundedPreceding, 0)
    edges = use.groupBy(*keys, "_b").agg(F.max(start).alias("_l"))
    e = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.select(*keys, "_b", F.last("_l", True).over(e).alias("_l"))
    owned = use.withColumn("_s", F.last(start, True).over(w)).join(edges, [*keys, "_b"]).withColumn("_s", F.coalesce("_s", "_l")).where(F.col("_s").isNotNull() & (F.col("t") - F.col("_s.t") <= longest))
    part = F.when(F.col("_k") == 1, F.substring(F.hex("payload"), 5, 12)).otherwise(F.substring(F.hex("payload"), 3, 14))
    size = F.when(F.col("_k") == 1, byte_at(F.col("payload"), F.lit(0)).bitwiseAND(F.lit(15)) * 256 + byte_at(F.col("payload"), F.lit(1)))
    rows = owned.groupBy(*keys, "_s").agg(F.max(size).alias("size"), F.array_sort(F.collect_list(F.struct("t", "ord", part.alias("p")))).alias("parts"))
    need = F.greatest(F.lit(1), F.ceil((F.col("size") - 6) / 7).cast("int") + 1)
    rows = rows.withColumn("_n", need).where(F.size("parts") >= F.col("_n"))
    data = F.unhex(F.substring(F.array_join(F.transform(F.slice("parts", F.lit(1), F.col("_n")), lambda x: x["p"]), ""), F.lit(1), (F.col("size") * 2).cast("int")))
    return rows.select(*keys, F.element_at("parts", F.col("_n"))["t"].alias("t"), F.col("size"), data.alias("payload"))


def trace(frames: DataFrame, names: DataFrame) -> DataFrame:
    """A trace table: id without flags, message name ("" if unknown), direction, DLC and payload text; errors and remote frames by kind."""
    shown = frames.withColumn("id", F.col("id").bitwiseAND(F.lit(0x1FFFFFFF)))
    named = shown.join(names.select(F.col("message_id").alias("id"), "message"), "id", "left")
    kind = F.when(F.coalesce("is_error", F.lit(False)), F.lit("Error Frame")).when(F.coalesce("is_remote", F.lit(False)), F.lit("Remote Frame")).when(F.coalesce("is_fd", F.lit(False)), F.lit("CAN FD Frame")).otherwise(F.lit("CAN Frame"))
    data = F.regexp_replace(F.hex("payload"), "(..)(?!$)", "$1 ")
    error = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in CAN_ERRORS.items() for x in p]), F.col("error_type")), F.lit(CAN_ERRORS[0]))
    return named.select("t", "bus", "id", F.coalesce("message", F.lit("")).alias("message"), kind.alias("event"), F.when(F.coalesce("is_error", F.lit(False)), error).otherwise(F.lit("")).alias("details"), F.when(F.coalesce("is_tx", F.lit(False)), "Tx").otherwise("Rx").alias("direction"), F.length("payload").alias("dlc"), data.alias("data"))


def lin_trace(frames: DataFrame, names: DataFrame) -> DataFrame:
    """As :func:`trace`, of LIN frames: six bits of id, and the kind of error where there is one."""
    shown = frames.withColumn("id", F.col("id").bitwiseAND(F.lit(0x3F)))
    named = shown.join(names.select(F.col("message_id").alias("id"), "message"), "id", "left")
    return named.select("t", "bus", "id", F.coalesce("message", F.lit("")).alias("message"), F.coalesce("error_kind", F.lit("LIN Frame")).alias("event"), F.length("payload").alias("dlc"), F.regexp_replace(F.hex("payload"), "(..)(?!$)", "$1 ").alias("data"))


def chronological(*frames: DataFrame) -> DataFrame:
    """Frames of several buses and kinds in one order of time; columns that a kind lacks are null."""
    out = frames[0]
    for more in frames[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out.orderBy("t")


def flexray_trace(frames: DataFrame, names: DataFrame) -> DataFrame:
    """A FlexRay trace: slot, cycle, channel, name of the frame where it is known, kind of event, size and data."""
    named = frames.join(names.select(F.col("message_id").alias("id"), "message"), "id", "left")
    kind = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in FLEXRAY_EVENTS.items() for x in p]), F.col("event_type")), F.lit(FLEXRAY_EVENTS[0]))
    data = F.regexp_replace(F.hex(F.coalesce("payload", F.unhex(F.lit("")))), "(..)(?!$)", "$1 ")
    return named.select("t", "bus", "id", "cycle", F.when(F.col("channel") == 1, "B").otherwise("A").alias("channel"), F.coalesce("message", F.lit("")).alias("message"), kind.alias("event"), F.coalesce(F.length("payload"), F.lit(0)).alias("dlc"), data.alias("data"))


def id_summary(frames: DataFrame, names: DataFrame) -> DataFrame:
    """Per bus: how many different ids there are, and how many of them have a definition or not."""
    ids = frames.select("bus", "id").distinct().join(names.select(F.col("message_id").alias("id"), F.lit(1).alias("_k")).distinct(), "id", "left")
    return ids.groupBy("bus").agg(F.count(F.lit(1)).alias("ids"), F.count("_k").alias("known"), F.count_if(F.col("_k").isNull()).alias("unknown"))
