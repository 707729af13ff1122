"""Scalar functions on columns: rounding, bits, texts of numbers and bytes, names, times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_even(x: Column, digits: int) -> Column:
    """Rounding of the scaled binary value, halves to even."""
    return F.rint(x * float(10**digits)) / float(10**digits)


def round_half_away(x: Column, digits: int) -> Column:
    """Rounding of the scaled binary value, halves away from zero, as SQL engines on doubles do. ``F.round`` rounds the decimal text instead:
    2.56125, whose ten-thousands are 25612.499999999996, is 2.5612 here and 2.5613 there."""
    scaled = x * float(10**digits)
    whole = F.rint(scaled)
    away = F.when(F.abs(scaled - whole) == 0.5, scaled + F.signum(scaled) * 0.5).otherwise(whole)
    return F.when(F.abs(scaled) < float("inf"), away / float(10**digits)).otherwise(x)


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def modulo(a: Column, b: Column) -> Column:
    """The remainder with the divisor's sign."""
    return a - b * F.floor(F.try_divide(a, b))


def signed(x: Column, bits: int) -> Column:
    """The two's complement value of the lowest ``bits`` bits."""
    low = x.bitwiseAND(F.lit((1 << bits) - 1))
    return F.when(F.shiftright(low, bits - 1).bitwiseAND(F.lit(1)) == 1, low - F.lit(1 << bits)).otherwise(low)


def as_hex(x: Column, digits: int | None = None) -> Column:
    out = F.hex(x)
    return F.concat(F.lit("0x"), F.lpad(out, digits, "0") if digits else out)


def as_bin(x: Column, bits: int) -> Column:
    """Binary digits in groups of four."""
    return F.rtrim(F.regexp_replace(F.lpad(F.bin(x), bits, "0"), "(.{4})", "$1 "))


def spaced_hex(data: Column, size: Column | None = None) -> Column:
    """Bytes as "A2 C3 08", the first ``size`` of them."""
    data = F.substring(data, F.lit(1), size) if size is not None else data
    return F.regexp_replace(F.hex(data), "(..)(?!$)", "$1 ")


def ascii_text(x: Column) -> Column:
    """The character of a printable code, else the number."""
    return F.when(x.between(32, 126), F.char(x)).otherwise(x.cast("string"))


def decoded(data: Column) -> Column:
    """Bytes up to the first NUL as UTF-8, or as Latin-1 where they aren't valid UTF-8."""
    text = F.when(F.is_valid_utf8(data.cast("string")), data.cast("string")).otherwise(F.decode(data, "ISO-8859-1"))
    return F.substring_index(text, "\0", 1)


def matlab_name(name: Column) -> Column:
    """Letters, digits and _ only, a letter first, 60 characters at most."""
    clean = F.regexp_replace(name, "[^A-Za-z0-9_]", "_")
    return F.substring(F.when(clean.rlike("^[A-Za-z]"), clean).otherwise(F.concat(F.lit("M_"), clean)), 1, 60)


def query_name(name: Column) -> Column:
    """A name that can stand in a query: what isn't a letter, digit or _ becomes _."""
    clean = F.regexp_replace(name, "[^A-Za-z0-9_]", "_")
    return F.when(clean.rlike("^[0-9]"), F.concat(F.lit("file_"), clean)).otherwise(clean)


def xml_comment(comment: Column) -> Column:
    """The text of a comment that is XML, else the comment itself."""
    return F.when(comment.startswith("<"), F.coalesce(F.nullif(F.regexp_extract(comment, r"(?s)<TX[^>]*>(.*?)</TX>", 1), F.lit("")), F.lit(""))).otherwise(comment)


def xml_display_names(comment: Column) -> Column:
    """Display names within an XML comment."""
    return F.regexp_extract_all(comment, F.lit(r"<(?:display|DISPLAY)[^>]*>([^<]*)<"), F.lit(1))


def absolute(start: Column, seconds: Column) -> Column:
    """Start time plus seconds, to the microsecond."""
    return start + F.make_dt_interval(secs=F.round(seconds, 6).cast("decimal(18,6)"))


def arrow_angle(dx: Column, dy: Column) -> Column:
    """Direction in degrees of a step (dx, dy)."""
    return F.degrees(F.atan2(dy, dx))
