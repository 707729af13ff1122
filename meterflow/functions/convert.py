"""Raw to physical: conversions as column expressions.

A conversion is a dict; :func:`convert` turns it into a column over the raw one. Small tables become CASE or map
expressions, so no row leaves whole-stage code; a conversion with many entries is joined by :func:`convert_by_table`.
Results that mix numbers and text come as two columns (:func:`convert_mixed`).
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def quotient(a: Column, b: Column) -> Column:
    """Division of doubles that gives infinities and NaN instead of an error."""
    return F.when(b != 0, a / b).when(F.isnan(a) | F.isnan(b) | (a == 0), F.lit(NAN)).otherwise(F.when(a > 0, F.lit(INF)).otherwise(F.lit(-INF)))


def linear(x: Column, a: float, b: float) -> Column:
    if (a, b) == (1, 0):
        return x
    out = x.cast("double") * float(a)
    return out + float(b) if b else out


def rational(x: Column, p: tuple[float, ...]) -> Column:
    """(p1 x² + p2 x + p3) / (p4 x² + p5 x + p6), with the short forms of a linear or reciprocal one."""
    p1, p2, p3, p4, p5, p6 = map(float, p)
    x = x.cast("double")
    if (p1, p4, p5) == (0, 0, 0) and p6:
        return x if (p2, p3, p6) == (1, 0, 1) else (x * p2 + p3) / p6
    return quotient(p1 * x * x + p2 * x + p3, p4 * x * x + p5 * x + p6)


_TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+)|([A-Za-z_]\w*)|(\*\*|[-+*/^(),]))")
_CALLS = {"sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin, "acos": F.acos, "atan": F.atan, "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh, "exp": F.exp, "log": F.ln, "ln": F.ln, "log10": F.log10, "sqrt": F.sqrt, "abs": F.abs, "floor": F.floor, "ceil": F.ceil}


def formula(x: Column, text: str) -> Column:
    """An arithmetic formula in X (or X1): numbers, + - * / ^ **, brackets and the functions above. Nothing else is evaluated."""
    found, at = [], 0
    while at < len(text.rstrip()):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"{text!r} isn't a formula")
        found.append(m)
        at = m.end()
    tokens = [m.group(0).strip() for m in found] + [""]
    pos = 0

    def take(*some: str) -> str:
        nonlocal pos
        if tokens[pos] in some:
            pos += 1
            return tokens[pos - 1]
        return ""

    def total() -> Column:
        out = product()
        while op := take("+", "-"):
            out = out + product() if op == "+" else out - product()
        return out

    def product() -> Column:
        out = signed()
        while op := take("*", "/"):
            out = out * signed() if op == "*" else quotient(out, signed())
        return out

    def signed() -> Column:
        if take("-"):
            return -signed()
        take("+")
        base = atom()
        return F.pow(base, signed()) if take("^", "**") else base

    def atom() -> Column:
        nonlocal pos
        token = tokens[pos]
        pos += 1
        if token == "(":
            out = total()
        elif token.upper() in ("X", "X1"):
            return x.cast("double")
        elif token.lower() == "pi":
            return F.lit(math.pi)
        elif token.lower() in _CALLS and take("("):
            out = _CALLS[token.lower()](total()).cast("double")
        elif token and (token[0].isdigit() or token[0] == "."):
            return F.lit(float(token))
        else:
            raise ValueError(f"{token!r} isn't allowed in {text!r}")
        if not take(")"):
            raise ValueError(f"a bracket isn't closed in {text!r}")
        return out

    out = total()
    if tokens[pos]:
        raise ValueError(f"{tokens[pos]!r} isn't expected in {text!r}")
    return out


def table(x: Column, raw: list[float], phys: list[float], interpolate: bool) -> Column:
    """Table look-up, clamped: linear between keys, or the nearest key (a tie takes the lower one)."""
    x = x.cast("double")
    pairs = sorted(zip(map(float, raw), map(float, phys)))
    out = F.lit(pairs[-1][1])
    for (r0, p0), (r1, p1) in reversed(list(zip(pairs, pairs[1:]))):
        inner = (x - r0) * ((p1 - p0) / (r1 - r0)) + p0 if interpolate else F.when(x - r0 <= r1 - x, F.lit(p0)).otherwise(F.lit(p1))
        out = F.when(x < r1, inner).otherwise(out)
    return F.when(F.isnan(x), F.lit(NAN) if interpolate else F.lit(pairs[-1][1])).when(x <= pairs[0][0], F.lit(pairs[0][1])).otherwise(out)


def in_range(x: Column, low: float, high: float, whole: bool) -> Column:
    """Integers: closed at both ends. Floats: closed below, open above."""
    return (x >= low) & (x <= high if whole else x < high)


def ranges(x: Column, rows: list[tuple[float, float, object]], default, whole: bool) -> Column:
    """The result of the first range that holds x; results may be columns (nested conversions)."""
    out = default if isinstance(default, Column) else F.lit(default)
    for low, high, result in reversed(rows):
        out = F.when(in_range(x, low, high, whole), result if isinstance(result, Column) else F.lit(result)).otherwise(out)
    return out


def values(x: Column, rows: dict, default) -> Column:
    """The result of an equal key."""
    default = default if isinstance(default, Column) else F.lit(default)
    if not rows:
        return default
    if any(isinstance(v, Column) for v in rows.values()):
        out = default
        for k, v in reversed(rows.items()):
            out = F.when(x == F.lit(k), v if isinstance(v, Column) else F.lit(v)).otherwise(out)
        return out
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(y) for pair in rows.items() for y in pair]), x), default)


def bitfield(x: Column, parts: list[tuple[int, dict | list, str | None]]) -> Column:
    """For each (mask, conversion rows, name) the text of the masked value, joined by "|"; empty texts are left out."""
    texts = []
    for mask, rows, name in parts:
        masked = x.cast("long").bitwiseAND(F.lit(mask))
        text = values(masked, rows, "") if isinstance(rows, dict) else ranges(masked, rows, "", True)
        texts.append(F.when(text != "", F.concat(F.lit(f"{name}="), text) if name else text))
    return F.concat_ws("|", *texts)


def exponential(x: Column, p: tuple[float, ...], logarithm: bool) -> Column:
    """The seven-parameter exponential (or logarithmic) conversion."""
    p1, p2, p3, p4, p5, p6, p7 = map(float, p)
    f = F.ln if logarithm else F.exp
    x = x.cast("double")
    if p4 == 0 and p1 and p2:
        return f(((x - p7) * p6 - p3) / p1) / p2
    if p1 == 0 and p4 and p5:
        return f((quotient(F.lit(p3), x - p7) - p6) / p4) / p5
    raise ValueError("either the first or the fourth parameter must be zero")


def polynomial(x: Column, p: tuple[float, ...]) -> Column:
    """(p2 - p4 (x - p5 - p6)) / (p3 (x - p5 - p6) - p1), with the short form p4 x / p1."""
    p1, p2, p3, p4, p5, p6 = map(float, p)
    x = x.cast("double")
    if (p2, p3, p5, p6) == (0, 0, 0, 0) and p1:
        return x * p4 / p1 if p4 != p1 else x
    moved = x - (p5 + p6)
    return quotient(p2 - p4 * moved, p3 * moved - p1)


def convert(x: Column, conversion: dict | None, whole: bool = False, skip_text: bool = False) -> Column:
    """A conversion's column. ``whole``: the raw channel is of an integer type. ``skip_text``: conversions to text give the raw value."""
    kind = (conversion or {"type": "none"})["type"]
    c = conversion or {}
    if kind in ("value_to_text", "range_to_text", "bitfield") and skip_text:
        return x

    def nested(r):
        return convert(x, r, whole) if isinstance(r, dict) else r

    if kind == "none":
        return x
    if kind == "linear":
        return linear(x, c["a"], c["b"])
    if kind == "rational":
        return rational(x, c["p"])
    if kind == "formula":
        return formula(x, c["formula"])
    if kind in ("table", "table_interpolated"):
        return table(x, c["raw"], c["phys"], kind == "table_interpolated")
    if kind in ("range_to_value", "range_to_text"):
        return ranges(x, [(lo, hi, nested(r)) for lo, hi, r in c["rows"]], nested(c.get("default")), whole)
    if kind in ("value_to_text", "text_to_value", "text_to_text"):
        key = F.rtrim(F.regexp_replace(x, "\\x00", "")) if kind == "text_to_text" else x
        default = x if kind == "text_to_text" and c.get("default") is None else nested(c.get("default"))
        return values(key, {k: nested(v) for k, v in c["rows"].items()}, default)
    if kind == "bitfield":
        return bitfield(x, c["parts"])
    if kind in ("exponential", "logarithmic"):
        return exponential(x, c["p"], kind == "logarithmic")
    if kind == "polynomial":
        return polynomial(x, c["p"])
    raise ValueError(f"unknown conversion {kind!r}")


def convert_mixed(x: Column, rows: dict, default: dict | str | None = None) -> tuple[Column, Column]:
    """(number, text) of a value conversion whose results are texts or further conversions: one of the two is null or NaN."""
    texts = {k: v for k, v in rows.items() if isinstance(v, str)}
    numbers = {k: convert(x, v).cast("double") for k, v in rows.items() if isinstance(v, dict)}
    other = convert(x, default).cast("double") if isinstance(default, dict) else F.lit(NAN)
    text = values(x, texts, F.lit(default if isinstance(default, str) else None).cast("string"))
    return F.when(text.isNotNull(), F.lit(NAN)).otherwise(values(x, numbers, other)), text


def convert_struct(df: DataFrame, column: str, conversions: dict[str, dict]) -> DataFrame:
    """Fields of a struct column converted, each by its own conversion."""
    out = F.col(column)
    for field, c in conversions.items():
        out = out.withField(field, convert(F.col(f"{column}.{field}"), c))
    return df.withColumn(column, out)


def convert_by_table(df: DataFrame, raw: str, keys: DataFrame, default: Column) -> DataFrame:
    """``phys`` from a table of any size, (raw_key, result): an equi-join whose strategy Spark picks."""
    joined = df.join(keys, F.col(raw) == F.col("raw_key"), "left")
    return joined.withColumn("phys", F.coalesce("result", default)).drop("raw_key", "result")


def inverse(conversion: dict) -> dict:
    """The conversion back to raw, of a linear or a rational conversion without squares."""
    if conversion["type"] == "linear":
        return {"type": "linear", "a": 1 / conversion["a"], "b": -conversion["b"] / conversion["a"]}
    p1, p2, p3, p4, p5, p6 = conversion["p"]
    if conversion["type"] != "rational" or p1 or p4:
        raise ValueError("only linear and simple rational conversions have an inverse")
    return {"type": "rational", "p": (0, -p6, p3, 0, p5, -p2)}


def from_dict(given: dict) -> dict:
    """A conversion from the shape of its keys, as in configuration files: a and b; P1 to P6; formula; raw_0, phys_0, …; lower_0, upper_0, phys_0 or text_0; mask_0, …"""
    if "formula" in given:
        return {"type": "formula", "formula": given["formula"]}
    if "a" in given:
        return {"type": "linear", "a": given["a"], "b": given.get("b", 0)}
    if "P1" in given:
        p = tuple(given[f"P{i}"] for i in range(1, 8) if f"P{i}" in given)
        return {"type": "rational" if len(p) == 6 else "exponential", "p": p}

    def column(name: str) -> list:
        return [given[f"{name}_{i}"] for i in range(sum(re.fullmatch(rf"{name}_\d+", k) is not None for k in given))]

    if column("upper"):
        results = column("text") or column("phys")
        return {"type": "range_to_text" if column("text") else "range_to_value", "rows": list(zip(column("lower"), column("upper"), results)), "default": given.get("default")}
    if column("raw") and column("phys"):
        return {"type": "table_interpolated" if given.get("interpolation") else "table", "raw": column("raw"), "phys": column("phys")}
    if column("val") and column("text"):
        return {"type": "value_to_text", "rows": dict(zip(column("val"), column("text"))), "default": given.get("default")}
    if column("text") and column("phys"):
        return {"type": "text_to_value", "rows": dict(zip(column("text"), column("phys"))), "default": given.get("default")}
    if column("input") and column("output"):
        return {"type": "text_to_text", "rows": dict(zip(column("input"), column("output"))), "default": given.get("default")}
    return {"type": "none"}


def to_dict(conversion: dict | None) -> dict:
    """The shape of keys that :func:`from_dict` reads, of conversions that have one."""
    c = conversion or {"type": "none"}
    default = {"default": c["default"]} if c.get("default") is not None else {}
    numbered = lambda **columns: {f"{name}_{i}": v for name, values_ in columns.items() for i, v in enumerate(values_)}
    if c["type"] == "none":
        return {}
    if c["type"] == "linear":
        return {"a": c["a"], "b": c["b"]}
    if c["type"] == "formula":
        return {"formula": c["formula"]}
    if c["type"] in ("rational", "exponential"):
        return {f"P{i}": v for i, v in enumerate(c["p"], 1)}
    if c["type"] in ("table", "table_interpolated"):
        return numbered(raw=c["raw"], phys=c["phys"]) | ({"interpolation": True} if c["type"] == "table_interpolated" else {})
    if c["type"] in ("range_to_text", "range_to_value"):
        lower, upper, results = zip(*c["rows"])
        return numbered(lower=lower, upper=upper, **{"text" if c["type"] == "range_to_text" else "phys": results}) | default
    names = {"value_to_text": ("val", "text"), "text_to_value": ("text", "phys"), "text_to_text": ("input", "output")}
    if c["type"] in names:
        return numbered(**dict(zip(names[c["type"]], zip(*c["rows"].items())))) | default
    raise ValueError(f"{c['type']} has no shape of keys")


def transferred(conversion: dict | None, version: int) -> dict:
    """A conversion for version 3 or 4 of the format, with the same results. Version 4 has no polynomial quotients, which are rational conversions
    there; version 3 has no tables from texts, nor ranges to values with a default: they are an error there."""
    c = conversion or {"type": "none"}
    if version >= 4 and c["type"] == "polynomial":
        p1, p2, p3, p4, p5, p6 = c["p"]
        return {"type": "rational", "p": (0, -p4, p2 + p4 * (p5 + p6), 0, p3, -p3 * (p5 + p6) - p1)}
    if version < 4 and (c["type"] in ("text_to_value", "text_to_text", "bitfield") or (c["type"] == "range_to_value" and c.get("default") is not None)):
        raise ValueError(f"version {version} has no conversion {c['type']!r}")
    return c
