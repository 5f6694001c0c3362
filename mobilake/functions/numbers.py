"""Numeric parsing and arithmetic. [M1-M6, M11-M14, F2-F5]"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

_DECIMAL = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"


def to_float(c: Column) -> Column:
    """Plain decimal text to double, everything else (nan, inf, 1_000) null. [M1]"""
    return F.when(c.rlike(_DECIMAL), c.try_cast("double"))


def to_int(c: Column) -> Column:
    """Whole-number text to int, everything else null. [M1]"""
    return F.when(c.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(c).try_cast("int"))


def to_int_via_float(c: Column) -> Column:
    """'12.0' to 12, truncating. [M2]"""
    return to_float(c).try_cast("int")


def decimal_comma(c: Column) -> Column:
    """'12,5' to 12.5. [M3]"""
    return to_float(F.replace(c, F.lit(","), F.lit(".")))


def grouped_decimal(c: Column) -> Column:
    """'40.417.386' to 40.417386: the first group is whole, the rest are decimals. [M4]"""
    parts = F.split(F.trim(c), r"\.")
    joined = F.concat(F.get(parts, F.lit(0)), F.lit("."), F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1))), ""))
    return F.when(c.rlike(r"^\s*-?\d{1,3}(\.\d+)+\s*$"), joined.try_cast("double")).otherwise(to_float(c))


def dms(c: Column) -> Column:
    """Degrees, minutes, seconds and hemisphere to signed degrees, 6 decimals. [M5]"""
    p = r"""(\d+)\D+(\d+)\D+(\d+(?:[.,]\d+)?)\D*?([NSEWO])?\s*$"""
    g = lambda i: F.replace(F.regexp_extract(F.upper(c), p, i), F.lit(","), F.lit(".")).try_cast("double")
    sign = F.when(F.regexp_extract(F.upper(c), p, 4).isin("S", "W", "O") | c.rlike(r"^\s*-"), -1).otherwise(1)
    return F.round(sign * (g(1) + g(2) / 60 + g(3) / 3600), 6)


def ratio(a: Column, b: Column) -> Column:
    """a / b; null where b is null or 0. [M6]"""
    return F.try_divide(a.cast("double"), b.cast("double"))


def half_even(c: Column, digits: int = 4) -> Column:
    """Round half to even. [M11]"""
    return F.bround(c, digits)


def wrap_longitude(c: Column) -> Column:
    """0..360 to -180..180. [M12]"""
    return F.when(c > 180, c - 360).otherwise(c)


def in_range(c: Column, low: float | None, high: float | None, required: bool = False) -> Column:
    """Inclusive range; null passes unless required. [F3, F4]"""
    ok = F.lit(True)
    if low is not None:
        ok = ok & (c >= low)
    if high is not None:
        ok = ok & (c <= high)
    return F.coalesce(ok, F.lit(not required))


def range_by(key: Column, value: Column, limits: Mapping[str, tuple[float, float]]) -> Column:
    """Range looked up by another column; unknown keys and nulls pass. [F5]"""
    low = F.create_map(*[x for k, v in limits.items() for x in (F.lit(k), F.lit(float(v[0])))])
    high = F.create_map(*[x for k, v in limits.items() for x in (F.lit(k), F.lit(float(v[1])))])
    return F.coalesce(value.between(F.try_element_at(low, key), F.try_element_at(high, key)), F.lit(True))


def excess(key: Column, value: Column, highest: Mapping[str, float]) -> Column:
    """value minus the highest plausible value of its key; -inf for unknown keys. [M14]"""
    m = F.create_map(*[x for k, v in highest.items() for x in (F.lit(k), F.lit(float(v)))])
    return F.coalesce(value - F.try_element_at(m, key), F.lit(float("-inf")))
