"""The fifteen data marts: quality rules, silver projection and gold roll-up of each.

Every dataset is a ``Mart``: rules, the silver projection, the partition key
and the gold roll-up, all Column expressions, so a batch is one narrow stage
up to silver and one aggregation to gold. Bucketing is by the wall clock of
``zone``, independent of the session.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mobilake.functions import arrays, numbers, times
from mobilake.operators import gate, rollup, windows
from mobilake.operators.gate import Rule
from mobilake.operators.spatial import in_box

ZONE = "Europe/Madrid"
# Plausible box around Madrid, and limits of plausibility by measurement.
BOX = {"south": 39.8, "north": 41.2, "west": -4.6, "east": -3.0}
POLLUTANT_MAX = {
    "SO2": 500, "CO": 50, "NO": 1000, "NO2": 500, "PM2.5": 1000, "PM10": 1000, "NOx": 1000, "O3": 500, "TOL": 1000, "BEN": 100,
    "EBE": 1000, "MXY": 1000, "PXY": 1000, "OXY": 1000, "TCH": 50, "CH4": 50, "NMHC": 50, "MPX": 50,
}
MODEL_POLLUTANT_MAX = {"NO2": 500, "NO": 1000, "SO2": 500, "O3": 500, "PM2.5": 1000, "PM10": 1000, "polvo": 1000}
MAGNITUDE_RANGE = {
    "temperature_c": (-20, 50), "humidity_pct": (0, 100), "wind_speed_ms": (0, 100), "wind_direction_deg": (0, 360),
    "pressure_mb": (850, 1050), "solar_radiation_wm2": (0, 1500), "uv_radiation_mwm2": (0, 5000), "precipitation_lm2": (0, 300),
}
NO_CATEGORY, NO_DISTRICT, NO_TIME = "__sin_categoria__", "__sin_distrito__", "__sin_medida__"


@dataclass(frozen=True)
class Mart:
    """name; rules on bronze; silver projection; silver and gold partition columns; gold roll-up; unique key of silver."""

    name: str
    rules: Callable[[], list[Rule]]
    silver: Callable[[DataFrame], DataFrame]
    gold: Callable[[DataFrame], DataFrame]
    silver_keys: Sequence[str] = ("fecha", "hora")
    gold_keys: Sequence[str] = ("date",)
    unique: str | None = None
    context_days: int = 0  # days before and after a changed day that its gold rows look at


def _clock(c: str) -> Column:
    return times.local_clock(times.iso_instant(F.col(c)), ZONE)


def _instant(c: str) -> Column:
    return times.iso_instant(F.col(c))


def _at(c: str) -> Column:
    """Instant of a time text, parsed once by _timed."""
    return F.col(f"__at_{c}")


def _timed(df: DataFrame, *names: str) -> DataFrame:
    """df with the instants that the aggregates order by, one column per time text."""
    return df.withColumns({f"__at_{n}": _instant(n) for n in names})


def _hourly(df: DataFrame, time: str) -> DataFrame:
    d = _timed(df, time).withColumn("__clock", times.local_clock(_at(time), ZONE))
    return d.withColumns({"date": times.date_key(F.col("__clock")), "hour": F.hour("__clock")})


def _keys(df: DataFrame, time: str, hour: bool = True) -> DataFrame:
    k = _clock(time)
    cols = {"fecha": F.coalesce(times.date_key(k), F.lit(NO_TIME))} | ({"hora": F.coalesce(times.hour_key(k), F.lit(NO_TIME))} if hour else {})
    return df.withColumns(cols)


def _span(time: str) -> dict[str, Column]:
    return {f"first_{time}": rollup.first_by(F.col(time), _at(time)), f"last_{time}": rollup.last_by(F.col(time), _at(time))}


def _firsts(time: str, *names: str) -> dict[str, Column]:
    return {n.rpartition(".")[2]: rollup.earliest(F.col(n), _at(time)) for n in names}


def _avg(*names: str) -> dict[str, Column]:
    return {f"avg_{n}": F.avg(n) for n in names}


def _extreme(*names: str) -> dict[str, Column]:
    return {k: v for n in names for k, v in ((f"max_{n}", F.max(n)), (f"min_{n}", F.min(n)))}


def _outside() -> Rule:
    return Rule("location_missing_or_outside_madrid_bbox", ~in_box(F.col("location.lat"), F.col("location.lon"), **BOX))


def _renamed(df: DataFrame) -> DataFrame:
    """[P5]"""
    return df.withColumnRenamed("captured_at", "ingested_at") if "captured_at" in df.columns else df


def _traffic_silver(df: DataFrame) -> DataFrame:
    """[M6, M11, M13]"""
    r = {"occupancy_ratio": numbers.ratio(F.col("occupancy_pct"), F.lit(100)), "load_ratio": numbers.ratio(F.col("load_pct"), F.lit(100)), "intensity_ratio": numbers.ratio(F.col("intensity_vph"), F.col("saturation_intensity_vph"))}
    return _keys(df.withColumns({k: numbers.half_even(v) for k, v in r.items()}), "measured_at")


def _noise_gold(df: DataFrame) -> DataFrame:
    """Daily means per station and period, then the trailing seven calendar days."""
    levels = ("laeq_db", "l1_db", "l10_db", "l50_db", "l90_db", "l99_db")
    m = _firsts("ingested_at", "station_name", "period_name", "district", "neighbourhood", "location.lat", "location.lon", "location.altitude_m") | _avg(*levels) | _extreme("laeq_db")
    g = rollup.rollup(_timed(df, "ingested_at"), ["station_id", "period", "measured_date"], m, ["station_id", "period"])
    g = rollup.calendar_rolling(g, ["station_id", "period"], times.iso_date(F.col("measured_date")), "avg_laeq_db", 7, "laeq_rolling_7d_avg_db", "laeq_rolling_7d_days")
    return g.withColumnRenamed("measured_date", "date")


def _weather_silver(df: DataFrame) -> DataFrame:
    """Wide to long; values out of their magnitude's range are left out. [P7, F5]"""
    ids = [c for c in ("schema_version", "source", "station_id", "station_name", "station_address", "measured_at", "ingested_at", "location") if c in df.columns]
    long = windows.melt(df.select(*ids, *[F.col(c).cast("double").alias(c) for c in MAGNITUDE_RANGE]), ids, list(MAGNITUDE_RANGE), "magnitude", "value")
    return _keys(long.where(numbers.range_by(F.col("magnitude"), F.col("value"), MAGNITUDE_RANGE)), "measured_at")


def _counts_silver(df: DataFrame) -> DataFrame:
    return _keys(df.withColumn("count", windows.by_mode("mode", {"peatones": "pedestrian_count", "bicicletas": "bicycle_count"})), "measured_at")


def _agenda_silver(df: DataFrame) -> DataFrame:
    inner = [F.col(f"location.{c}").alias(c) for c in ("venue_name", "address", "district", "neighborhood", "postal_code", "lat", "lon")]
    flat = df.select(*[c for c in df.columns if c != "location"], *inner)
    return _renamed(flat).withColumn("fecha", F.substring("start_datetime", 1, 10))


def _agenda_gold(df: DataFrame) -> DataFrame:
    keys = [rollup.sentinel(F.col("category"), NO_CATEGORY).alias("category"), rollup.sentinel(F.col("district"), NO_DISTRICT).alias("district"), F.col("fecha").alias("date")]
    m = {"events_count": rollup.distinct_count(F.col("event_id")), "free_events_count": rollup.distinct_count(F.col("event_id"), F.col("free")), "sources": rollup.distinct_list(F.col("source"))}
    start = F.try_to_timestamp("start_datetime")
    return rollup.rollup(df, keys, m | {"first_start_datetime": rollup.first_by(F.col("start_datetime"), start), "last_start_datetime": rollup.last_by(F.col("start_datetime"), start)})


def _forecast_silver(df: DataFrame) -> DataFrame:
    """Text numbers to double; blanks to null. [P2]"""
    names = [c for c in df.columns if c.endswith(("_c", "_pct", "_kmh")) or c == "uv_max"]
    return _renamed(df).withColumns({c: numbers.to_float(F.col(c).cast("string")) for c in names}).withColumn("fecha", F.col("valid_date"))


def _forecast_gold(df: DataFrame) -> DataFrame:
    lead = times.lead_days(times.iso_date(F.col("valid_date")), _clock("ingested_at").cast("date"))
    m = {"municipio_name": rollup.earliest(F.col("municipio_name"), _at("ingested_at"))} | _avg("temperature_max_c", "temperature_min_c", "precipitation_probability_pct")
    m |= {"max_temperature_max_c": F.max("temperature_max_c"), "min_temperature_min_c": F.min("temperature_min_c"), "max_precipitation_probability_pct": F.max("precipitation_probability_pct"), "first_valid_date": F.min("valid_date"), "last_valid_date": F.max("valid_date")}
    return rollup.rollup(_timed(df.withColumn("leadtime_days", lead), "ingested_at"), ["municipio_code", "leadtime_days"], m, ["municipio_code"])


def _crowd_gold(df: DataFrame) -> DataFrame:
    d = _timed(df, "ingested_at").withColumn("__clock", times.local_clock(_at("ingested_at"), ZONE))
    k = F.col("__clock")
    d = d.withColumns({"date": times.date_key(k), "hour": F.hour(k), "day_of_week": times.weekday_name(k), "typical_value": arrays.profile_at(F.col("typical_by_hour"), k)})
    m = _firsts("ingested_at", "name", "day_of_week", "lat", "lon") | {"avg_live_pct": F.avg("live_pct"), "typical_pct": F.avg("typical_value")} | _span("ingested_at")
    return rollup.rollup(d, ["place_id", "date", "hour"], m, ["place_id"])


def _hourly_mart(keys: Sequence[str], time: str, measures: Callable[[], dict[str, Column]]) -> Callable[[DataFrame], DataFrame]:
    return lambda df: rollup.rollup(_hourly(df, time), [*keys, "date", "hour"], measures() | _span(time), keys)


MARTS: dict[str, Mart] = {
    m.name: m
    for m in (
        Mart(
            "trafico",
            lambda: [gate.missing("point_id"), *gate.instant("measured_at"), *gate.instant("ingested_at"), _outside(), gate.between("intensity_vph", 0, 20000), gate.between("occupancy_pct", 0, 100), gate.between("load_pct", 0, 100), gate.negative("saturation_intensity_vph"), gate.between("service_level", 0, 10), Rule("sensor_reports_error", F.col("has_error"))],
            _traffic_silver,
            _hourly_mart(["point_id"], "measured_at", lambda: _firsts("measured_at", "subarea", "location.lat", "location.lon") | _avg("intensity_vph", "occupancy_ratio", "load_ratio", "intensity_ratio", "service_level") | _extreme("intensity_vph")),
        ),
        Mart(
            "transporte_publico_emt",
            lambda: [Rule("unexpected_auth_error_payload", arrays.has_key(F.col("_raw"), "accessToken", "code", "description")), gate.missing("stop_id"), gate.missing("line"), *gate.instant("ingested_at"), gate.between("estimate_arrive_sec", 0, 7200), gate.negative("distance_bus_m")],
            lambda df: _keys(df, "ingested_at"),
            _hourly_mart(["stop_id", "line"], "ingested_at", lambda: _avg("estimate_arrive_sec") | _extreme("estimate_arrive_sec")),
        ),
        Mart(
            "bicimad",
            lambda: [gate.missing("station_id"), *gate.instant("measured_at"), *gate.instant("ingested_at"), Rule("station_not_installed", ~F.col("is_installed")), *[gate.negative(c) for c in ("bikes_available", "bikes_disabled", "docks_available", "docks_disabled", "docks_total")], gate.exceeds("bikes_exceed_docks_total", ["bikes_available", "bikes_disabled"], "docks_total"), gate.exceeds("docks_exceed_docks_total", ["docks_available", "docks_disabled"], "docks_total")],
            lambda df: _keys(df.withColumn("occupancy_ratio", numbers.half_even(numbers.ratio(F.col("bikes_available"), F.col("docks_total")))), "measured_at"),
            _hourly_mart(["station_id"], "measured_at", lambda: _firsts("measured_at", "name", "docks_total", "location.lat", "location.lon") | _avg("bikes_available", "bikes_disabled", "docks_available", "docks_disabled", "occupancy_ratio")),
        ),
        Mart(
            "aparcamientos",
            lambda: [gate.missing("parking_id"), *gate.instant("ingested_at"), *gate.instant("measured_at", optional=True), gate.negative("free_spaces"), gate.negative("total_spaces"), gate.exceeds("free_spaces_exceeds_total_spaces", ["free_spaces"], "total_spaces")],
            lambda df: _keys(df.withColumn("occupancy_ratio", numbers.half_even(numbers.ratio(F.col("total_spaces") - F.col("free_spaces"), F.col("total_spaces")))), "measured_at"),
            lambda df: _hourly_mart(["parking_id"], "measured_at", lambda: _firsts("measured_at", "name", "total_spaces", "location.lat", "location.lon") | _avg("free_spaces", "occupancy_ratio"))(df.where(F.col("free_spaces").isNotNull() & F.col("measured_at").isNotNull())),
        ),
        Mart(
            "calidad_aire",
            lambda: [gate.missing("station_id"), gate.missing("pollutant", "magnitude_abbr"), *gate.instant("measured_at"), *gate.instant("ingested_at"), gate.null("value"), gate.negative("value"), Rule("value_out_of_plausible_range", numbers.excess(F.col("magnitude_abbr"), F.col("value"), POLLUTANT_MAX) > 0)],
            lambda df: _keys(df.withColumnsRenamed({"magnitude_abbr": "pollutant", "magnitude_name": "pollutant_name"}), "measured_at"),
            _hourly_mart(["station_id", "pollutant"], "measured_at", lambda: _firsts("measured_at", "station_name", "magnitude_code", "pollutant_name", "unit", "location.lat", "location.lon") | _avg("value") | _extreme("value")),
        ),
        Mart(
            "meteorologia",
            lambda: [gate.missing("station_id"), *gate.instant("measured_at"), *gate.instant("ingested_at")],
            _weather_silver,
            _hourly_mart(["station_id", "magnitude"], "measured_at", lambda: _firsts("measured_at", "station_name", "location.lat", "location.lon", "location.altitude_m") | _avg("value") | _extreme("value")),
        ),
        Mart(
            "ruido",
            lambda: [gate.missing("station_id"), gate.missing("period"), gate.date("measured_date"), *gate.instant("ingested_at"), gate.null("laeq", "laeq_db"), *[gate.between(c, 20, 120, suffix="out_of_plausible_range") for c in ("laeq_db", "l1_db", "l10_db", "l50_db", "l90_db", "l99_db")]],
            lambda df: df.withColumn("fecha", F.col("measured_date")),
            _noise_gold,
            silver_keys=("fecha",),
            context_days=6,
        ),
        Mart(
            "aforos_peatones_bicicletas",
            lambda: [gate.missing("station_id"), gate.one_of("mode", ("peatones", "bicicletas")), *gate.instant("measured_at"), *gate.instant("ingested_at"), Rule("count_missing", F.col("mode").isin("peatones", "bicicletas") & windows.by_mode("mode", {"peatones": "pedestrian_count", "bicicletas": "bicycle_count"}).isNull()), Rule("count_negative", windows.by_mode("mode", {"peatones": "pedestrian_count", "bicicletas": "bicycle_count"}) < 0)],
            _counts_silver,
            _hourly_mart(["station_id", "mode"], "measured_at", lambda: _firsts("measured_at", "district_code", "district", "address", "address_notes", "location.lat", "location.lon") | {"total_count": F.sum("count")} | _avg("count") | _extreme("count")),
        ),
        Mart(
            "cartelera_cines_estrenos",
            lambda: [Rule("not_a_screening_session", F.col("record_type") == "estreno_semana"), gate.missing("movie_title"), gate.missing("cinema_id"), gate.missing("showtime_id"), *gate.instant("showtime_datetime"), *gate.instant("captured_at"), Rule("showtime_already_passed", _instant("showtime_datetime") < _instant("captured_at"))],
            lambda df: _renamed(_keys(df, "showtime_datetime", hour=False)),
            lambda df: rollup.rollup(_timed(df.withColumnRenamed("fecha", "date"), "showtime_datetime"), ["movie_url", "cinema_id", "date"], {"sessions_count": rollup.distinct_count(F.col("showtime_id")), "language_versions": rollup.distinct_list(F.col("language_version"))} | _firsts("showtime_datetime", "movie_title", "chain", "cinema_name", "address", "postal_code", "locality") | _span("showtime_datetime"), ["movie_url", "cinema_id"]),
            silver_keys=("fecha",),
        ),
        Mart(
            "agenda_eventos",
            lambda: [gate.one_of("source", ("agenda_eventos_madrid_municipal", "agenda_turismo_esmadrid", "agenda_eventos_distritos"), "missing_or_unknown"), gate.missing("event_id"), gate.missing("title"), *gate.instant("start_datetime", zoned=False), *gate.instant("captured_at")],
            _agenda_silver,
            _agenda_gold,
            silver_keys=("fecha",),
        ),
        Mart(
            "bluesky_menciones",
            lambda: [gate.one_of("mode", ("bajo_demanda", "distrito_sweep")), gate.blank("match_term"), gate.blank("text", "missing_or_empty"), gate.missing("post_hash"), *gate.instant("created_at"), *gate.instant("captured_at")],
            lambda df: _renamed(_keys(df, "created_at")),
            _hourly_mart(["mode", "match_term"], "created_at", lambda: {"mentions_count": rollup.distinct_count(F.col("post_hash")), "langs": rollup.distinct_list(F.col("lang"))} | {f"total_{c}_count": rollup.total(F.col(f"{c}_count")) for c in ("like", "repost", "reply", "quote")}),
            unique="post_hash",
        ),
        Mart(
            "aemet_prevision",
            lambda: [gate.missing("municipio_code"), gate.date("valid_date"), *[Rule(r.reason.replace("captured_at", "ingested_at"), r.bad) for r in gate.instant("captured_at")], Rule("valid_date_already_passed", times.iso_date(F.col("valid_date")) < _clock("captured_at").cast("date")), gate.between("temperature_max_c", -20, 50, True), gate.between("temperature_min_c", -20, 50, True), gate.between("precipitation_probability_pct", 0, 100, True)],
            _forecast_silver,
            _forecast_gold,
            silver_keys=("fecha",),
            gold_keys=("municipio_code",),
        ),
        Mart(
            "aemet_avisos",
            lambda: [gate.missing("identifier"), gate.missing("zone"), gate.one_of("level", ("amarillo", "naranja", "rojo")), gate.missing("phenomenon"), *gate.instant("effective_from", zoned=False), *[Rule(r.reason.replace("captured_at", "ingested_at"), r.bad) for r in gate.instant("captured_at")]],
            lambda df: _renamed(df).withColumn("fecha", F.substring("effective_from", 1, 10)),
            lambda df: rollup.rollup(_timed(df, "effective_from", "effective_until"), ["zone", "fecha", "level"], {"alerts_count": rollup.distinct_count(F.col("identifier")), "phenomena": rollup.distinct_list(F.col("phenomenon")), "first_effective_from": rollup.first_by(F.col("effective_from"), _at("effective_from")), "last_effective_until": rollup.last_by(F.col("effective_until"), _at("effective_until"))}, ["zone", "level"]),
            silver_keys=("fecha",),
            gold_keys=("fecha",),
        ),
        Mart(
            "cams_calidad_aire",
            lambda: [gate.missing("pollutant"), gate.missing("pollutant_code"), *gate.instant("valid_datetime"), *gate.instant("forecast_issued_at"), gate.null("leadtime_hour"), gate.negative("leadtime_hour"), *gate.instant("ingested_at"), gate.null("value"), gate.negative("value"), Rule("value_out_of_plausible_range", numbers.excess(F.col("pollutant"), F.col("value"), MODEL_POLLUTANT_MAX) > 0)],
            lambda df: _keys(df, "valid_datetime", hour=False),
            lambda df: rollup.rollup(_timed(df.withColumn("fecha_validez", times.date_key(_clock("valid_datetime"))), "forecast_issued_at"), ["pollutant", "fecha_validez"], _firsts("forecast_issued_at", "pollutant_code", "unit") | _avg("value") | {"max_value": F.max("value"), "leadtime_hours": F.sort_array(F.collect_set("leadtime_hour"))} | _span("forecast_issued_at"), ["pollutant"]),
            silver_keys=("fecha",),
            gold_keys=("pollutant",),
        ),
        Mart(
            "afluencia_lugares",
            lambda: [gate.missing("place_id"), gate.missing("name"), *gate.instant("captured_at"), gate.between("live_pct", 0, 100), Rule("typical_by_hour_value_out_of_range", ~arrays.all_within([F.col(f"typical_by_hour.{d}") for d in times.WEEKDAYS], 0, 100))],
            lambda df: _keys(_renamed(df).withColumns({"lat": F.col("location.lat"), "lon": F.col("location.lon")}), "ingested_at"),
            _crowd_gold,
        ),
    )
}


def silver(mart: Mart, bronze: DataFrame, order: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(silver rows, rejected rows with their reasons) of a bronze batch."""
    good, bad = gate.split(bronze, mart.rules(), mart.unique, order)
    return mart.silver(good), bad


def gold(mart: Mart, rows: DataFrame, processed_at: str) -> DataFrame:
    """Gold table with its version and stamp. [P4]"""
    return mart.gold(rows).withColumns({"schema_version": F.lit(1), "processed_at": F.lit(processed_at)})
