"""Arrays, maps, structs and JSON. [C1-C10, W7, O7]"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from mobilake.functions.times import WEEKDAYS


def week_profile(entries: Column) -> Column:
    """array<struct(name, data)> to a struct with one array per weekday key; the last of a name wins. [C2]"""

    def last(day: str) -> Column:
        of_day = F.filter(entries, lambda e: F.lower(e["name"]) == day)
        return F.try_element_at(of_day, F.lit(-1))["data"]

    return F.when(entries.isNotNull(), F.struct(*[last(d).alias(d) for d in WEEKDAYS]))


def profile_at(profile: Column, clock: Column) -> Column:
    """Value of a week profile at a wall clock; null out of range. [C3, A14]"""
    day = F.weekday(clock)
    data = None
    for i, d in enumerate(WEEKDAYS):
        data = F.when(day == i, profile[d]) if data is None else data.when(day == i, profile[d])
    return F.get(data, F.hour(clock))


def all_within(arrays: Sequence[Column], low: float, high: float) -> Column:
    """No element of any array lies outside; nulls pass. [F9, C4]"""
    flat = F.flatten(F.array_compact(F.array(*arrays)))
    return F.coalesce(~F.exists(flat, lambda x: (x < low) | (x > high)), F.lit(True))


def extremes(arrays: Column) -> Column:
    """struct(low, high) over an array of arrays; null for none. [C4]"""
    flat = F.flatten(arrays)
    return F.struct(F.array_min(flat).alias("low"), F.array_max(flat).alias("high"))


def text_list(json: Column) -> Column:
    """JSON list of texts; anything else gives an empty list. [C5]"""
    ok = F.schema_of_variant(F.try_parse_json(json)).startswith("ARRAY")
    return F.coalesce(F.when(ok, F.from_json(json, "array<string>")), F.array().cast("array<string>"))


def whole_day(entries: Column, value: str = "value") -> Column:
    """Entry of the period '00-24', else of the first without period. [C6]"""
    pick = F.filter(entries, lambda e: e["periodo"] == "00-24")
    return F.coalesce(F.get(pick, F.lit(0))[value], F.get(F.filter(entries, lambda e: e["periodo"].isNull()), F.lit(0))[value])


def parameters(entries: Column, *names: str) -> Column:
    """First non-null value among parameter names; of repeated names the last counts. [C7]"""

    def last(name: str) -> Column:
        return F.try_element_at(F.filter(entries, lambda e: e["valueName"] == name), F.lit(-1))["value"]

    return F.coalesce(*[last(n) for n in names])


def point_of(coordinates: Column) -> Column:
    """[lon, lat] to struct(lat, lon), nulls where too short. [C8]"""
    return F.struct(F.get(coordinates, F.lit(1)).alias("lat"), F.get(coordinates, F.lit(0)).alias("lon"))


def json_path(json: Column, path: str, kind: str = "string") -> Column:
    """Typed value at a path; null when the text is no JSON, the path is absent or the value does not fit. [C9]"""
    return F.try_variant_get(F.try_parse_json(json), path, kind)


def has_key(json: Column, *keys: str) -> Column:
    """Whether a JSON object has one of the keys, per record and whatever its value. [F10, N13]"""
    return F.coalesce(F.arrays_overlap(F.json_object_keys(json), F.array(*[F.lit(k) for k in keys])), F.lit(False))


def last_valid(pairs: Sequence[tuple[Column, Column]], good: str = "V") -> Column:
    """Of (value, flag) pairs in order of hours: struct(hour, value) of the last one flagged good. [W7]"""
    out = None
    for hour in range(len(pairs), 0, -1):
        value, flag = pairs[hour - 1]
        hit = F.struct(F.lit(hour).alias("hour"), value.alias("value"))
        out = F.when(flag == good, hit) if out is None else out.when(flag == good, hit)
    return out


def nearest_index(grid: Column, target: Column) -> Column:
    """Index of the grid value nearest to target, the first of ties. [O7]"""
    off = F.transform(grid, lambda x: F.abs(x - target))
    return (F.array_position(off, F.array_min(off)) - 1).cast("int")
