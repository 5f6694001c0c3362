"""Dates and times of records that are ISO or in one known format. [D1-D17]

For texts in mixed formats see mobilake.functions.instants.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mobilake.functions.instants import MONTHS

ISO = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}([.,]\d{1,9})?)?(Z|[+-]\d{2}:?\d{2})?$"
AWARE = r"(Z|[+-]\d{2}:?\d{2})$"
# Weekday keys from Monday.
WEEKDAYS = ("lunes", "martes", "miercoles", "jueves", "viernes", "sabado", "domingo")


def iso_ok(c: Column) -> Column:
    """A full ISO date and time that exists; false for null. [D1]

    The pattern keeps out what the parser would complete by itself ('12:30').
    """
    return F.coalesce(c.rlike(ISO) & F.try_to_timestamp(c).isNotNull(), F.lit(False))


def aware(c: Column) -> Column:
    """Has an offset or Z. [D3]"""
    return F.coalesce(c.rlike(AWARE), F.lit(False))


def iso_instant(c: Column) -> Column:
    """ISO text with offset to timestamp, null otherwise. [D1, D2]"""
    return F.when(c.rlike(ISO) & c.rlike(AWARE), F.try_to_timestamp(c))


def iso_date(c: Column) -> Column:
    """YYYY-MM-DD to date, null otherwise. [D4]"""
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(c, "yyyy-MM-dd"))


def local_clock(c: Column, zone: str = "Europe/Madrid") -> Column:
    """Instant (timestamp) to the wall clock of a zone, whatever the session's zone. [D10]"""
    from mobilake.functions.instants import from_epoch_us

    return F.convert_timezone(F.lit("UTC"), F.lit(zone), from_epoch_us(F.unix_micros(c)))


def date_key(clock: Column) -> Column:
    """Partition key of the day. [D12]"""
    return F.date_format(clock, "yyyy-MM-dd")


def hour_key(clock: Column) -> Column:
    """Partition key of the hour, two digits. [D12]"""
    return F.date_format(clock, "HH")


def source_time(c: Column, *formats: str) -> Column:
    """First of the formats that reads the text; the text's fraction is cut first. [D5]"""
    t = F.regexp_replace(c, r"\.\d+$", "")
    return F.coalesce(*[F.try_to_timestamp(t, F.lit(f)).cast("timestamp_ntz") for f in formats])


def long_date(c: Column) -> Column:
    """'15 de agosto de 2026' to date. [D6]"""
    p = r"(\d{1,2})\s+de\s+(\p{L}+)\s+de\s+(\d{4})"
    m = F.create_map(*[x for i, names in enumerate(MONTHS, 1) for x in (F.lit(names[0]), F.lit(f"{i:02d}"))])
    month = F.try_element_at(m, F.lower(F.regexp_extract(c, p, 2)))
    return F.try_to_date(F.concat_ws("-", F.regexp_extract(c, p, 3), month, F.lpad(F.regexp_extract(c, p, 1), 2, "0")), "yyyy-MM-dd")


def duration_min(c: Column) -> Column:
    """'1h 45min' to 105; null without hours or minutes. [D7]"""
    h, m = F.regexp_extract(c, r"(\d+)\s*h", 1), F.regexp_extract(c, r"(\d+)\s*min", 1)
    return F.when((h != "") | (m != ""), F.coalesce(h.try_cast("int"), F.lit(0)) * 60 + F.coalesce(m.try_cast("int"), F.lit(0)))


def hour_of_day(year: Column, month: Column, day: Column, hour: Column) -> Column:
    """Hours 1..24; 24 is the next day's midnight. [D9]"""
    start = F.try_make_timestamp_ntz(year, month, day, F.lit(0), F.lit(0), F.lit(0).cast("decimal(16,6)"))
    return F.when(hour.between(1, 24), start + F.make_dt_interval(F.lit(0), hour))


def weekday_name(clock: Column) -> Column:
    """Spanish weekday key. [D13]"""
    return F.element_at(F.array(*[F.lit(w) for w in WEEKDAYS]), F.weekday(clock) + 1)


def lead_days(valid: Column, issued: Column) -> Column:
    """Whole days from issue to validity. [D14, A12]"""
    return F.datediff(valid, issued)


def lead_hours(valid: Column, issued: Column) -> Column:
    """Hours from issue to validity, rounded half to even. [D14]"""
    return F.bround((F.unix_micros(valid) - F.unix_micros(issued)) / 3_600_000_000).cast("int")


def previous_hour(now: Column, zone: str = "Europe/Madrid") -> Column:
    """struct(fecha, hora) of the hour before an instant; the hour is taken off in UTC, so no local hour is skipped or met twice. [D11, N16]"""
    clock = local_clock(now - F.expr("interval 1 hour"), zone)
    return F.struct(date_key(clock).alias("fecha"), hour_key(clock).alias("hora"))


def days_between(first: Column, last: Column) -> Column:
    """All dates from first to last. [D11]"""
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<date>"))


def day_kind(date: Column, holidays: Column) -> Column:
    """laborable, sabado, domingo or festivo; holidays is an array of dates. [D17]"""
    return F.when(F.array_contains(holidays, date), "festivo").when(F.weekday(date) == 6, "domingo").when(F.weekday(date) == 5, "sabado").otherwise("laborable")


def ntz_micros(c: Column) -> Column:
    """Microseconds since 1970 of a wall clock, as if UTC."""
    parts = F.unix_date(c.cast("date")).cast("bigint") * 86_400 + F.hour(c) * 3600 + F.minute(c) * 60
    return parts * 1_000_000 + (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("bigint")


def forecast_base(text: Column) -> Column:
    """'FORECAST time from 20260815' (with or without +hours behind) to that day's midnight; null otherwise. [D16]"""
    day = F.regexp_extract(text, r"from\s+(\d{8})", 1)
    return F.try_to_date(F.when(day != "", day), "yyyyMMdd").cast("timestamp_ntz")


def reference_date(long_name: Column, units: Column) -> Column:
    """The moment that model times count from: 'hours since 1900-01-01 00:00:00', else the date in the long name. [D16]"""
    since = F.regexp_extract(units, r"since\s+(\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2})?)?)", 1)
    return F.coalesce(F.when(since != "", since).try_cast("timestamp_ntz"), forecast_base(long_name))


def decode_time(value: Column, units: Column, base: Column) -> Column:
    """base plus value in the unit that units begins with (seconds, minutes, hours or days; hours where there is none). [D16]"""
    word = F.lower(F.regexp_extract(units, r"^\s*([A-Za-z]+)", 1))
    seconds = F.when(word.startswith("sec"), 1).when(word.startswith("min"), 60).when(word.startswith("day"), 86_400).otherwise(3600)
    return base + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (value * seconds).cast("decimal(18,6)"))
