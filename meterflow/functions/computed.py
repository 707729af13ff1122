"""Descriptions of computed channels: what they need, and the expression or function that they are.

A description is a dict with a ``type``: "arithmetic" (op, operand1, operand2), "function" (channel, name, args), "expression" (text with
{{channel}}) or "python_function" (args: names by argument). Operands are names, numbers, or computed channels themselves."""

from __future__ import annotations

import inspect
import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.align import OPERATORS

_NAME = re.compile(r"\{\{(?P<name>.+?)\}\}")
_OPS = {"+": "add", "-": "sub", "*": "mul", "/": "div", "//": "floordiv", "%": "mod", "**": "pow", "&": "and", "|": "or", "^": "xor", "<<": "lshift", ">>": "rshift"}
#: numpy's names of functions that Spark has.
FUNCTIONS = {"absolute": F.abs, "abs": F.abs, "sqrt": F.sqrt, "cbrt": F.cbrt, "exp": F.exp, "log": F.ln, "log2": F.log2, "log10": F.log10, "sin": F.sin, "cos": F.cos, "tan": F.tan, "arcsin": F.asin, "arccos": F.acos, "arctan": F.atan, "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh, "floor": F.floor, "ceil": F.ceil, "rint": F.rint, "sign": F.signum, "degrees": F.degrees, "radians": F.radians, "negative": lambda x: -x, "square": lambda x: x * x}


def _number(operand) -> float | None:
    try:
        return float(operand)
    except (TypeError, ValueError):
        return None


def required(channel: dict) -> list[str]:
    """Names of channels that a computed one (with ``computation``) needs, in the order they are met, those of nested ones too."""
    names: list[str] = []

    def add(operand) -> None:
        if isinstance(operand, dict):
            names.extend(required(operand))
        elif isinstance(operand, str) and _number(operand) is None:
            names.append(operand)

    if channel.get("computed", "computation" in channel):
        c = channel["computation"]
        if c["type"] == "arithmetic":
            add(c["operand1"])
            add(c["operand2"])
        elif c["type"] == "function":
            add(c["channel"])
        elif c["type"] == "expression":
            names.extend(m.group("name") for m in _NAME.finditer(c["expression"]))
        else:
            names.extend(n for several in c["args"].values() for n in several if n)
            if c.get("triggering") == "triggering_on_channel":
                names.append(c["triggering_value"])
    return list(dict.fromkeys(names))


def column(channel: dict) -> Column:
    """The expression of a computed channel over a frame that has a column for each channel it needs."""

    def operand(x) -> Column:
        if isinstance(x, dict):
            return column(x)
        return F.col(f"`{x}`") if _number(x) is None else F.lit(_number(x))

    c = channel["computation"]
    if c["type"] == "arithmetic":
        return OPERATORS[_OPS[c["op"]]](operand(c["operand1"]), operand(c["operand2"]))
    if c["type"] == "function":
        if c["name"] in ("round", "around"):
            return F.rint(operand(c["channel"]) * 10.0 ** (c.get("args") or [0])[0]) / 10.0 ** (c.get("args") or [0])[0]
        if c["name"] == "clip":
            low, high = c["args"]
            return F.greatest(F.least(operand(c["channel"]), F.lit(float(high))), F.lit(float(low)))
        return FUNCTIONS[c["name"]](operand(c["channel"]))
    if c["type"] == "expression":
        return F.expr(_NAME.sub(lambda m: f"`{m.group('name')}`", c["expression"]))
    raise ValueError("a function of the user is no expression: use userfn")


def variables(text: str, names: dict | None = None) -> dict:
    """Numbers and texts that a block of ``name = value`` lines gives, for functions to be called with. Values are literals or names defined before."""
    import ast

    out = dict(names or {})
    for line in ast.parse(text.replace("\t", "    ")).body:
        if not isinstance(line, ast.Assign) or not all(isinstance(t, ast.Name) for t in line.targets):
            raise ValueError("a block of variables holds assignments only")
        value = out[line.value.id] if isinstance(line.value, ast.Name) and line.value.id in out else ast.literal_eval(line.value)
        out.update({t.id: value for t in line.targets})
    return out


def modes(function: Callable, n: int = 10_000) -> dict[str, bool]:
    """Whether a function works per sample and on whole channels, tried with its defaults and with ``n`` equal samples."""
    defaults = {k: p.default for k, p in inspect.signature(function).parameters.items()}
    out = {"per_sample": True, "per_channel": True}
    try:
        value = function(**defaults)
        out["per_sample"] = isinstance(value, (int, float, np.integer, np.floating))
    except ZeroDivisionError:
        pass
    except Exception:
        out["per_sample"] = False
    try:
        value = function(**{k: np.ones(n, np.int64) * d for k, d in defaults.items() if k != "t"}, t=np.arange(n) * 0.1)
        out["per_channel"] = np.ndim(value) == 1 and len(value) <= n
    except ZeroDivisionError:
        pass
    except Exception:
        out["per_channel"] = False
    return out
