"""Scalar expressions with the meaning that the operators need for nulls, NaN, infinities and rounding."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

INF = float("inf")


def finite(x: Column) -> Column:
    """Not null, NaN or infinite."""
    return F.coalesce(~F.isnan(x) & (F.abs(x) < INF), F.lit(False))


def known(x: Column) -> Column:
    """x with null for NaN, since Spark holds NaN for larger than every number."""
    return F.when(~F.isnan(x), x)


def round_even(x: Column, digits: int = 3) -> Column:
    """Rounds halves to the even digit; never gives a negative zero."""
    return F.rint(x * 10.0**digits) / 10.0**digits + F.lit(0.0)


def relative_change(now: Column, before: Column) -> Column:
    """now / before - 1: infinite from zero to something, null from zero to zero or if either is missing."""
    from_zero = F.when(now > 0, F.lit(INF)).when(now < 0, F.lit(-INF))
    return F.when(before == 0, from_zero).otherwise(F.try_divide(now, before) - 1)


def close_to(x: Column, y: Column | float, absolute: float = 1e-8, relative: float = 1e-5) -> Column:
    y = F.lit(y) if isinstance(y, float) else y
    return F.abs(x - y) <= F.lit(absolute) + F.lit(relative) * F.abs(y)


def flag(text: Column) -> Column:
    """Whether a text says true."""
    return F.lower(F.trim(text)).isin("true", "1", "t", "yes")


def epoch_unit(value: Column) -> Column:
    """s, ms, us or ns, by magnitude."""
    size = F.abs(value)
    return F.when(size >= 10**17, "ns").when(size >= 10**14, "us").when(size >= 10**11, "ms").otherwise("s")


def epoch_to_timestamp(value: Column) -> Column:
    """A UTC time without zone, cut to the millisecond."""
    unit = epoch_unit(value)
    millis = F.when(unit == "ns", _div(value, 10**6)).when(unit == "us", _div(value, 10**3)).when(unit == "ms", value).otherwise(value * 1000)
    return F.timestamp_millis(millis).cast("timestamp_ntz")


def _div(value: Column, by: int) -> Column:
    """Whole division towards minus infinity, without doubles."""
    return ((value - F.pmod(value, F.lit(by))).cast("decimal(20,0)") / F.lit(by)).cast("long")


def cycle(value: Column, last: int) -> tuple[Column, Column]:
    """Sine and cosine of a value's place in a cycle whose last value meets the first."""
    angle = F.lit(2.0) * F.pi() * value / F.lit(float(last))
    return F.sin(angle), F.cos(angle)


def json_fields(text: Column, fields: str) -> Column:
    """Typed fields of a JSON text; null where the text is none."""
    return F.from_json(text, fields)


def symbol_list(text: Column) -> Column:
    """The distinct symbols of a comma-separated text, in upper case and order."""
    parts = F.transform(F.split(text, ","), lambda s: F.upper(F.trim(s)))
    return F.array_sort(F.array_distinct(F.filter(parts, lambda s: s != "")))
