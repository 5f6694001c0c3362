"""Raw feeds to bronze records: one projection per feed. [P1, J1, J2, J9, P7, P8, W7]

Each function takes the scanned raw rows (see mobilake.sources.readers) and
gives the bronze columns of its mart. Dimension tables are joined with
``joins.lookup``; nothing here reads files.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mobilake.functions import arrays, geo, numbers, text, times
from mobilake.functions.instants import from_epoch_us
from mobilake.operators import joins, rollup, windows

ZONE = "Europe/Madrid"
HOURS = range(1, 25)
# Code of a pollutant -> (short name, name, unit).
POLLUTANTS = {
    "01": ("SO2", "Dióxido de Azufre", "µg/m³"),
    "06": ("CO", "Monóxido de Carbono", "mg/m³"),
    "07": ("NO", "Monóxido de Nitrógeno", "µg/m³"),
    "08": ("NO2", "Dióxido de Nitrógeno", "µg/m³"),
    "09": ("PM2.5", "Partículas < 2.5 µm", "µg/m³"),
    "10": ("PM10", "Partículas < 10 µm", "µg/m³"),
    "12": ("NOx", "Óxidos de Nitrógeno", "µg/m³"),
    "14": ("O3", "Ozono", "µg/m³"),
    "20": ("TOL", "Tolueno", "µg/m³"),
    "30": ("BEN", "Benceno", "µg/m³"),
    "35": ("EBE", "Etilbenceno", "µg/m³"),
    "37": ("MXY", "Metaxileno", "µg/m³"),
    "38": ("PXY", "Paraxileno", "µg/m³"),
    "39": ("OXY", "Ortoxileno", "µg/m³"),
    "42": ("TCH", "Hidrocarburos totales (hexano)", "mg/m³"),
    "43": ("CH4", "Metano", "mg/m³"),
    "44": ("NMHC", "Hidrocarburos no metánicos (hexano)", "mg/m³"),
    "431": ("MPX", "Metaparaxileno", "mg/m³"),
}
# Code of a weather magnitude -> field.
WEATHER = {
    "80": "uv_radiation_mwm2",
    "81": "wind_speed_ms",
    "82": "wind_direction_deg",
    "83": "temperature_c",
    "86": "humidity_pct",
    "87": "pressure_mb",
    "88": "solar_radiation_wm2",
    "89": "precipitation_lm2",
}
PERIODS = {"D": "diurno", "E": "vespertino", "N": "nocturno", "T": "total"}


def iso(local: Column, zone: str = ZONE) -> Column:
    """Wall clock of a zone to ISO text with its offset. [D10]"""
    utc = F.convert_timezone(F.lit(zone), F.lit("UTC"), local)
    back = F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)
    seconds = lambda c: F.unix_date(c.cast("date")) * 86400 + F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)
    east = ((seconds(back) - seconds(utc)) / 60).cast("int")
    sign = F.when(east < 0, "-").otherwise("+")
    return F.concat(F.date_format(back, "yyyy-MM-dd'T'HH:mm:ss"), sign, F.lpad((F.abs(east) / 60).cast("int").cast("string"), 2, "0"), F.lit(":"), F.lpad((F.abs(east) % 60).cast("string"), 2, "0"))


def iso_of_instant(us: Column) -> Column:
    """Microseconds since 1970 UTC to ISO text in the zone. [D8]"""
    return iso(F.convert_timezone(F.lit("UTC"), F.lit(ZONE), from_epoch_us(us)))


def _where(lat: Column, lon: Column) -> Column:
    return F.struct(lat.alias("lat"), lon.alias("lon"), F.lit("EPSG:4326").alias("srid"))


def _stamped(source: str) -> list[Column]:
    return [F.lit(1).alias("schema_version"), F.lit(source).alias("source")]


def traffic(pm: DataFrame, measured: Column, ingested: Column, source: str = "trafico") -> DataFrame:
    """pm elements: numbers as text, decimal comma, UTM position turned to WGS84. [M3, M7]"""
    x, y = numbers.decimal_comma(F.col("st_x")), numbers.decimal_comma(F.col("st_y"))
    where = F.struct(x.alias("x"), y.alias("y"), F.lit("EPSG:25830").alias("srid_source"), geo.utm_to_lat(x, y).alias("lat"), geo.utm_to_lon(x, y).alias("lon"), F.lit("EPSG:4326").alias("srid_target"))
    whole = {"intensity_vph": "intensidad", "occupancy_pct": "ocupacion", "load_pct": "carga", "service_level": "nivelServicio", "saturation_intensity_vph": "intensidadSat"}
    words = {"point_id": "idelem", "description": "descripcion", "access_code": "accesoAsociado", "subarea": "subarea", "error_code": "error"}
    return pm.select(
        *_stamped(source), *[text.clean(F.col(c)).alias(k) for k, c in words.items()], *[numbers.to_int(F.col(c)).alias(k) for k, c in whole.items()],
        iso(measured).alias("measured_at"), ingested.alias("ingested_at"), F.coalesce(text.clean(F.col("error")) != "N", F.lit(True)).alias("has_error"), where.alias("location"),
    )


def arrivals(raw: DataFrame, ingested: Column, source: str = "emt") -> DataFrame:
    """Bus arrivals with stop_id, line, bus, destination, estimateArrive, DistanceBus, isHead, deviation, positionTypeBus, geometry. [X15, C8]"""
    p = arrays.point_of(F.col("geometry.coordinates"))
    return raw.select(
        *_stamped(source), F.col("stop_id").cast("string").alias("stop_id"), F.col("line").cast("string").alias("line"), F.col("bus").alias("bus_id"), "destination", ingested.alias("ingested_at"),
        F.col("estimateArrive").alias("estimate_arrive_sec"), F.col("DistanceBus").alias("distance_bus_m"), F.coalesce(text.is_true(F.col("isHead").cast("string")), F.lit(False)).alias("is_head"),
        F.coalesce(F.col("deviation"), F.lit(0)).alias("deviation_sec"), F.col("positionTypeBus").alias("position_type_bus"), _where(p["lat"], p["lon"]).alias("location"),
    )


def bikes(info: DataFrame, status: DataFrame, ingested: Column, source: str = "bicimad") -> DataFrame:
    """Stations with their state; of repeated states the latest report counts. [J1, D8]"""
    j = joins.lookup(info, status, ["station_id"], [-F.coalesce(F.col("last_reported"), F.lit(0))])
    names = {"num_bikes_available": "bikes_available", "num_bikes_disabled": "bikes_disabled", "num_docks_available": "docks_available", "num_docks_disabled": "docks_disabled", "capacity": "docks_total", "status": "status", "is_renting": "is_renting", "is_returning": "is_returning", "is_installed": "is_installed"}
    return j.select(*_stamped(source), F.col("station_id").cast("string").alias("station_id"), "name", "address", iso_of_instant(F.col("last_reported") * 1_000_000).alias("measured_at"), ingested.alias("ingested_at"), *[F.col(k).alias(v) for k, v in names.items()], _where(F.col("lat"), F.col("lon")).alias("location"))


def parking(listed: DataFrame, totals: DataFrame, ingested: Column, source: str = "aparcamientos") -> DataFrame:
    """Car parks with their capacity where the detail is known. [J9, D5]"""
    j = joins.lookup(listed, totals, ["parking_id"])
    moment = times.source_time(F.col("moment"), "dd/MM/yyyy HH:mm:ss", "d/M/yyyy H:mm", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss")
    return j.select(*_stamped(source), "parking_id", text.clean(F.col("name")).alias("name"), text.clean(F.col("address")).alias("address"), iso(moment).alias("measured_at"), ingested.alias("ingested_at"), numbers.to_int(F.col("free")).alias("free_spaces"), numbers.to_int(F.col("total_spaces")).alias("total_spaces"), _where(numbers.to_float(F.col("latitude")), numbers.to_float(F.col("longitude"))).alias("location"))


def _last_hour(raw: DataFrame) -> DataFrame:
    """Wide rows H01..H24 with flags V01..V24: hour and value of the last valid one, as __hour and __value. [W7]"""
    last = arrays.last_valid([(F.col(f"H{h:02d}"), F.col(f"V{h:02d}")) for h in HOURS])
    d = raw.withColumn("__last", last).where(F.col("__last").isNotNull())
    clock = times.hour_of_day(numbers.to_int(F.col("ANO")), numbers.to_int(F.col("MES")), numbers.to_int(F.col("DIA")), F.col("__last.hour"))
    return d.withColumns({"__at": clock, "__value": numbers.to_float(F.col("__last.value"))})


def _station_id() -> Column:
    """'28079004_8_8' to '28079004'. [X10]"""
    return text.first_of(F.col("PUNTO_MUESTREO"))


def air(raw: DataFrame, stations: DataFrame, ingested: Column, source: str = "calidad_aire") -> DataFrame:
    """One row per station and pollutant at its last valid hour; stations: station_id, station_name, station_address, lat, lon. [J2, J3]"""
    d = _last_hour(raw).withColumn("station_id", _station_id())
    j = joins.lookup(d, stations, ["station_id"])
    code = text.zfill(F.coalesce(F.col("MAGNITUD"), F.lit("")), 2)
    part = lambda i: joins.code_lookup(code, {k: v[i] for k, v in POLLUTANTS.items()})
    return j.select(*_stamped(source), "station_id", "station_name", "station_address", code.alias("magnitude_code"), part(0).alias("magnitude_abbr"), part(1).alias("magnitude_name"), part(2).alias("unit"), F.col("__value").alias("value"), iso(F.col("__at")).alias("measured_at"), ingested.alias("ingested_at"), _where(F.col("lat"), F.col("lon")).alias("location"))


def weather(raw: DataFrame, stations: DataFrame, ingested: Column, source: str = "meteorologia") -> DataFrame:
    """One row per station: every magnitude at its last valid hour, the record's time being the freshest. [P8]"""
    d = _last_hour(raw).withColumns({"station_id": _station_id(), "__name": joins.code_lookup(F.col("MAGNITUD"), WEATHER)})
    aggs = [F.max_by(F.when(F.col("__name") == n, F.col("__value")), F.when(F.col("__name") == n, F.col("__at"))).alias(n) for n in WEATHER.values()]
    one = d.where(F.col("__name").isNotNull()).groupBy("station_id").agg(F.max("__at").alias("__at"), *aggs)
    j = joins.lookup(one, stations, ["station_id"])
    where = F.struct(F.col("lat"), F.col("lon"), F.lit("EPSG:4326").alias("srid"), F.col("altitude_m"))
    return j.select(*_stamped(source), "station_id", "station_name", "station_address", iso(F.col("__at")).alias("measured_at"), ingested.alias("ingested_at"), *WEATHER.values(), where.alias("location"))


def noise(raw: DataFrame, stations: DataFrame, ingested: Column, source: str = "ruido") -> DataFrame:
    """Daily levels with decimal comma; station codes padded to RF-01. [X9, M3, F15]"""
    key = F.concat(F.lit("RF-"), text.zfill(text.clean(F.col("NMT")), 2))
    day = F.try_to_date(F.concat_ws("-", F.col("anio"), F.lpad(F.col("mes"), 2, "0"), F.lpad(F.col("dia"), 2, "0")), "yyyy-MM-dd")
    d = raw.withColumns({"station_id": key, "__day": day})
    j = joins.lookup(d, stations, ["station_id"])
    where = F.struct(F.col("lat"), F.col("lon"), F.lit("EPSG:4326").alias("srid"), F.col("altitude_m"))
    levels = {"laeq_db": "LAeq", "l1_db": "L1", "l10_db": "L10", "l50_db": "L50", "l90_db": "L90", "l99_db": "L99"}
    return j.select(*_stamped(source), "station_id", "station_name", "station_address", "district", "neighbourhood", F.col("tipo").alias("period"), joins.code_lookup(F.col("tipo"), PERIODS).alias("period_name"), F.date_format("__day", "yyyy-MM-dd").alias("measured_date"), ingested.alias("ingested_at"), *[numbers.decimal_comma(F.col(c)).alias(k) for k, c in levels.items()], where.alias("location"))


def counts(raw: DataFrame, mode: str, count: str, ingested: Column, source: str = "aforos") -> DataFrame:
    """Hourly counts of one mode; coordinates with grouping points. [M4, D5, U1]"""
    at = times.source_time(F.concat_ws(" ", F.col("fecha"), F.col("hora")), "dd/MM/yyyy HH:mm", "d/M/yyyy H:mm")
    n = numbers.to_int_via_float(F.col(count))
    return raw.select(
        *_stamped(source), text.clean(F.col("identificador")).alias("station_id"), F.lit(mode).alias("mode"), iso(at).alias("measured_at"), ingested.alias("ingested_at"),
        (n if mode == "peatones" else F.lit(None).cast("int")).alias("pedestrian_count"), (n if mode == "bicicletas" else F.lit(None).cast("int")).alias("bicycle_count"),
        text.clean(F.col("numero_distrito")).alias("district_code"), text.clean(F.col("distrito")).alias("district"), text.clean(F.col("direccion")).alias("address"), text.clean(F.col("observaciones_direccion")).alias("address_notes"),
        _where(numbers.grouped_decimal(F.col("latitude")), numbers.grouped_decimal(F.col("longitude"))).alias("location"),
    )


def posts(raw: DataFrame, mode: str, term: Column, captured: Column, source: str = "bluesky", languages: str = "es") -> DataFrame:
    """Posts in one language or without one; the author is never kept, the text gets a hash. [F14, X12]"""
    lang = F.get("record.langs", F.lit(0))
    d = raw.where(lang.isNull() | lang.startswith(languages))
    body = F.col("record.text")
    return d.select(*_stamped(source), F.lit(mode).alias("mode"), term.alias("match_term"), text.content_id(body).alias("post_hash"), body.alias("text"), lang.alias("lang"), F.col("record.createdAt").alias("created_at"), F.col("indexedAt").alias("indexed_at"), *[F.col(f"{c}Count").alias(f"{c}_count") for c in ("like", "repost", "reply", "quote")], captured.alias("captured_at"))


def alerts(info: DataFrame, captured: Column, source: str = "avisos") -> DataFrame:
    """CAP infos with parameters array<struct(valueName, value)>. [C7]"""
    p = lambda name: arrays.parameters(F.col("parameters"), name)
    return info.select(*_stamped(source), "identifier", F.col("sent").alias("sent_at"), F.coalesce(p("AEMET-Meteoalerta zona"), F.get("areas", F.lit(0))).alias("zone"), p("AEMET-Meteoalerta nivel").alias("level"), F.coalesce(p("AEMET-Meteoalerta fenomeno"), F.col("event")).alias("phenomenon"), p("AEMET-Meteoalerta probabilidad").alias("probability"), "severity", "urgency", "certainty", F.col("onset").alias("effective_from"), F.col("expires").alias("effective_until"), "headline", "description", captured.alias("captured_at"))


def areas(features: DataFrame, names: Mapping[str, str], ingested: Column, tolerance: float | None = 0.0001, source: str = "barrios") -> DataFrame:
    """GeoJSON features (properties, geometry type, coordinates as multi-polygon) with rings simplified. [M10]

    names: bronze column -> property.
    """
    rings = F.col("coordinates")
    if tolerance:
        # every ring is one row of the simplifier, in its place by (polygon, ring)
        d = features.withColumn("__id", F.xxhash64(F.to_json(F.struct(*[F.col(f"properties.`{p}`") for p in names.values()]))))
        flat = d.select("__id", F.posexplode("coordinates").alias("__p", "__rings")).select("__id", "__p", F.posexplode("__rings").alias("__r", "__ring"))
        flat = flat.select("__id", "__p", "__r", geo.simplify(tolerance)(F.col("__ring")).alias("__ring"))
        polys = flat.groupBy("__id", "__p").agg(F.transform(F.sort_array(F.collect_list(F.struct("__r", "__ring"))), lambda x: x["__ring"]).alias("__rings"))
        back = polys.groupBy("__id").agg(F.transform(F.sort_array(F.collect_list(F.struct("__p", "__rings"))), lambda x: x["__rings"]).alias("__c"))
        features, rings = d.join(back, "__id", "left"), F.col("__c")
    shape = F.struct(F.col("type"), rings.alias("coordinates"), F.lit("EPSG:4326").alias("srid"))
    return features.select(*_stamped(source), *[F.col(f"properties.`{p}`").alias(k) for k, p in names.items()], ingested.alias("ingested_at"), F.lit(bool(tolerance)).alias("simplified"), F.lit(tolerance).cast("double").alias("simplify_tolerance_deg"), shape.alias("geometry"))


def crossings(raw: DataFrame, vials: DataFrame, ingested: Column, source: str = "cruces") -> DataFrame:
    """Street crossings of known streets; positions in degrees, minutes, seconds. [J5, M5]"""
    d = joins.keep_known(raw, vials.select(F.col("vial_id").alias("from_id")), ["from_id"])
    return d.select(*_stamped(source), F.col("from_id").alias("from_vial_id"), text.clean(F.col("from_name")).alias("from_vial_name"), F.col("to_id").alias("to_vial_id"), text.clean(F.col("to_name")).alias("to_vial_name"), ingested.alias("ingested_at"), _where(numbers.dms(F.col("lat")), numbers.dms(F.col("lon"))).alias("location"))


def calendar(raw: DataFrame, ingested: Column, source: str = "calendario") -> DataFrame:
    """Working calendar: Dia, Dia_semana, laborable_festivo, Tipo_festivo, Festividad. [D17]"""
    day = F.try_to_date(F.col("Dia"), "dd/MM/yyyy")
    kind = F.lower(text.clean(F.col("laborable_festivo")))
    return raw.where(day.isNotNull()).select(*_stamped(source), F.date_format(day, "yyyy-MM-dd").alias("date"), text.clean(F.col("Dia_semana")).alias("weekday"), kind.alias("day_type"), F.coalesce(kind == "festivo", F.lit(False)).alias("is_holiday"), text.clean(F.col("Tipo_festivo")).alias("holiday_type_raw"), text.clean(F.col("Festividad")).alias("holiday_name"), ingested.alias("ingested_at"))


def places(raw: DataFrame, query: Column, captured: Column, source: str = "afluencia") -> DataFrame:
    """Places with current popularity and a week profile of (name, data) entries. [C2, S9]"""
    return raw.select(*_stamped(source), F.col("id").alias("place_id"), "name", query.alias("query"), "address", _where(F.col("coordinates.lat"), F.col("coordinates.lng")).alias("location"), captured.alias("captured_at"), F.col("current_popularity").alias("live_pct"), arrays.week_profile(F.col("populartimes")).alias("typical_by_hour"))


def forecast_days(raw: DataFrame, captured: Column, source: str = "prevision") -> DataFrame:
    """Municipality forecasts, one row per day; period lists give their whole-day entry. [C6, C10]"""
    d = raw.select("id", "nombre", "provincia", "elaborado", F.explode("dia").alias("d"))
    pick = lambda c, v="value": arrays.whole_day(F.col(f"d.{c}"), v)
    return d.select(*_stamped(source), F.col("id").alias("municipio_code"), F.col("nombre").alias("municipio_name"), F.col("provincia").alias("province"), F.col("elaborado").alias("elaborated_at"), F.substring_index("d.fecha", "T", 1).alias("valid_date"), pick("estadoCielo", "descripcion").alias("sky_state"), pick("estadoCielo").alias("sky_state_code"), pick("probPrecipitacion").alias("precipitation_probability_pct"), F.col("d.temperatura.maxima").alias("temperature_max_c"), F.col("d.temperatura.minima").alias("temperature_min_c"), captured.alias("captured_at"))


def _point(lat: Column, lon: Column) -> dict[str, Column]:
    return {"lat": lat, "lon": lon, "srid": F.when(lat.isNotNull() & lon.isNotNull(), "EPSG:4326")}


_NOWHERE = ("venue_name", "address", "district", "neighborhood", "postal_code", "lat", "lon", "srid")


def _event_place(**known: Column) -> Column:
    return F.struct(*[known.get(c, F.lit(None).cast("string")).alias(c) for c in _NOWHERE])


def municipal_events(raw: DataFrame, captured: Column, source: str = "agenda_eventos_madrid_municipal") -> DataFrame:
    """Events of the municipal graph, a column ``v`` with each entry as a variant. [X5, C9, D5]"""
    get = lambda path, kind="string": F.try_variant_get("v", path, kind)
    word = lambda path: rollup.truthy(get(path))
    moment = lambda path: F.coalesce(F.date_format(times.source_time(word(path), "yyyy-MM-dd HH:mm:ss"), "yyyy-MM-dd'T'HH:mm:ss"), word(path))
    place = _event_place(venue_name=word("$['event-location']"), address=word("$.address.area['street-address']"), district=text.url_segment(get("$.address.district['@id']")), neighborhood=text.url_segment(get("$.address.area['@id']")), postal_code=word("$.address.area['postal-code']"), **_point(get("$.location.latitude", "double"), get("$.location.longitude", "double")))
    return raw.select(
        *_stamped(source), F.coalesce(word("$.id"), word("$.uid")).alias("event_id"), word("$.title").alias("title"), text.shorten(get("$.description")).alias("description"), text.url_segment(get("$['@type']")).alias("category"),
        moment("$.dtstart").alias("start_datetime"), moment("$.dtend").alias("end_datetime"), word("$.time").alias("schedule_text"), (get("$.free", "int") != 0).alias("free"), word("$.price").alias("price_info"), place.alias("location"), word("$.link").alias("url"), captured.alias("captured_at"),
    )


def _item(items: Column, name: str) -> Column:
    """Text of the first item of a name among array<struct(_name, _VALUE)>. [S12]"""
    return text.clean(F.get(F.filter(items, lambda i: i["_name"] == name), F.lit(0))["_VALUE"])


def tourism_events(service: DataFrame, captured: Column, source: str = "agenda_turismo_esmadrid") -> DataFrame:
    """<service> elements of the tourism agenda as read by the XML source (see TOURISM): first date range, entities decoded, tags off. [X2, X3, X6]"""
    extra, first = F.col("extradata"), F.get("extradata.fechas.rango", F.lit(0))
    kind = F.get("extradata.categorias.categoria", F.lit(0))
    category = text.breadcrumb(_item(extra["item"], "Tipo"), _item(kind["item"], "Categoria"), _item(F.get(kind["subcategorias"]["subcategoria"], F.lit(0))["item"], "SubCategoria"))
    day = lambda c: F.coalesce(F.date_format(F.try_to_date(c, "dd/MM/yyyy"), "yyyy-MM-dd"), rollup.truthy(c))
    geo_of = lambda c: numbers.to_float(F.col(f"geoData.{c}"))
    place = _event_place(venue_name=text.clean(F.col("basicData.nombrert")), address=text.clean(F.col("geoData.address")), postal_code=text.clean(F.col("geoData.zipcode")), **_point(geo_of("latitude"), geo_of("longitude")))
    return service.select(
        *_stamped(source), F.col("_id").alias("event_id"), rollup.truthy(text.unescape(text.clean(F.col("basicData.name")))).alias("title"), text.shorten(text.strip_tags(F.col("basicData.body"))).alias("description"), category.alias("category"),
        day(first["inicio"]).alias("start_datetime"), day(first["fin"]).alias("end_datetime"), text.strip_tags(_item(extra["item"], "Horario")).alias("schedule_text"), F.lit(None).cast("boolean").alias("free"),
        text.strip_tags(_item(extra["item"], "Servicios de pago")).alias("price_info"), place.alias("location"), text.clean(F.col("basicData.web")).alias("url"), captured.alias("captured_at"),
    )


_ITEMS = "array<struct<_name:string,_VALUE:string>>"
# Schema of the elements that tourism_events and points_of_interest read.
TOURISM = f"_id string, _fechaActualizacion string, basicData struct<name:string,title:string,body:string,web:string,phone:string,email:string,nombrert:string>, geoData struct<address:string,zipcode:string,locality:string,country:string,latitude:string,longitude:string>, extradata struct<item:{_ITEMS},fechas:struct<rango:array<struct<inicio:string,fin:string>>>,categorias:struct<categoria:array<struct<item:{_ITEMS},subcategorias:struct<subcategoria:array<struct<item:{_ITEMS}>>>>>>>"


def venue_events(events: DataFrame, venues: DataFrame, source: str = "agenda_recintos_madrid") -> DataFrame:
    """Tourism events at one of the venues, with the kind of event its category names. [F18, X7]"""
    e = of_venues(events.withColumn("__at", F.col("location.venue_name")), venues, "__at")
    return e.select(*_stamped(source), F.col("source").alias("upstream_source"), "venue_id", F.col("venue").alias("venue_name"), "event_id", "title", text.last_part(F.col("category")).alias("event_type"), "category", "start_datetime", "end_datetime", "schedule_text", F.lit(None).cast("bigint").alias("capacity"), "url", "captured_at")


def streets(raw: DataFrame, ingested: Column, source: str = "callejero_viales") -> DataFrame:
    """Streets with their two ends in degrees, minutes, seconds; districts crossed as an array. [M5, X10]"""
    words = {"vial_id": "Codigo de vía", "class": "Clase de la via", "particle": "Particula de la via", "name": "Nombre de la via", "full_name": "Literal completo del vial ", "type": "Tipo de la via", "situation": "Situacion de la via respecto al terreno", "postal_code": "Codigos postales", "ine_code": "Codigo de vía I N E "}
    at = lambda end: _where(numbers.dms(F.col(f"`Latitud en S R  WGS84 ({end})`")), numbers.dms(F.col(f"`Longitud en S R  WGS84 ({end})`")))
    return raw.select(*_stamped(source), *[text.clean(F.col(f"`{c}`")).alias(k) for k, c in words.items()], text.parts_of(F.col("`Distritos atravesados`")).alias("district_codes"), numbers.to_int(F.col("`Cantidad de numeraciones en la via`")).alias("address_count"), ingested.alias("ingested_at"), at("inicio").alias("start_node"), at("final").alias("end_node"))


def showtimes(raw: DataFrame, cinemas: DataFrame, captured: Column, source: str = "cartelera_cines_madrid") -> DataFrame:
    """Sessions scraped per cinema: one row per showtime id, repeats dropped, experiences from their JSON list. [W5, C5, X8, J1]"""
    d = raw.where(rollup.truthy(F.col("showtime_id")).isNotNull() & rollup.truthy(F.col("showtime_time")).isNotNull())
    d = windows.keep_first(d, ["cinema_id", "showtime_id"], [F.col("position")])
    j = joins.lookup(d, cinemas.withColumnRenamed("cinema_name", "display_name"), ["cinema_id"])
    return j.select(*_stamped(source), "cinema_id", "chain", F.coalesce("cinema_name", "display_name").alias("cinema_name"), "movie_title", "movie_url", text.after_dash(F.col("version_text")).alias("language_version"), arrays.text_list(F.col("experiences")).alias("experiences"), F.col("showtime_time").alias("showtime_datetime"), "showtime_id", captured.alias("captured_at"))


def premieres(raw: DataFrame, captured: Column, source: str = "cartelera_cines_madrid") -> DataFrame:
    """Films of the week: long Spanish date, duration in minutes. [D6, D7]"""
    return raw.where(F.col("title").isNotNull()).select(*_stamped(source), F.lit("estreno_semana").alias("record_type"), text.clean(F.col("title")).alias("movie_title"), F.col("url").alias("movie_url"), F.date_format(times.long_date(F.col("release")), "yyyy-MM-dd").alias("release_date"), times.duration_min(F.col("info")).alias("duration_minutes"), F.col("genres"), captured.alias("captured_at"))


def points_of_interest(service: DataFrame, categories: DataFrame, ingested: Column, source: str = "poi_madrid") -> DataFrame:
    """<service> elements of the places catalogue with the category they were listed under; categories: poi_id, name, subcategories. [X1-X3]"""
    j = joins.lookup(service.withColumn("poi_id", text.clean(F.col("_id"))), categories.withColumnsRenamed({"name": "__category"}), ["poi_id"])
    items = F.col("extradata.item")
    word = {"address": "geoData.address", "postal_code": "geoData.zipcode", "locality": "geoData.locality", "country": "geoData.country", "website": "basicData.web", "phone": "basicData.phone", "email": "basicData.email"}
    name = F.coalesce(rollup.truthy(text.unescape(text.clean(F.col("basicData.name")))), rollup.truthy(text.unescape(text.clean(F.col("basicData.title")))))
    return j.select(*_stamped(source), "poi_id", name.alias("name"), F.col("__category").alias("category"), "subcategories", text.strip_tags(F.col("basicData.body")).alias("description"), *[text.clean(F.col(c)).alias(k) for k, c in word.items()], text.strip_tags(_item(items, "Horario")).alias("schedule"), text.strip_tags(_item(items, "Servicios de pago")).alias("price_info"), text.clean(F.col("_fechaActualizacion")).alias("last_updated"), ingested.alias("ingested_at"), _where(numbers.to_float(F.col("geoData.latitude")), numbers.to_float(F.col("geoData.longitude"))).alias("location"))


def model_forecast(grid: DataFrame, lat: float, lon: float, captured: Column, source: str = "cams") -> DataFrame:
    """Cells of a model grid to the records of the cell nearest to a place.

    grid: pollutant, pollutant_code, unit, value, latitude, longitude (0..360), time double, units, long_name.
    Times are "units since DATE", or hours from the date in long_name. [M12, O7, D14, D16, M11]
    """
    d = grid.withColumn("longitude", numbers.wrap_longitude(F.col("longitude")))
    off = F.struct(F.abs(F.col("latitude") - lat).alias("y"), F.abs(F.col("longitude") - lon).alias("x"), "latitude", "longitude")
    best = d.agg(F.min(off).alias("b")).select("b.latitude", "b.longitude")
    d = d.join(F.broadcast(best), ["latitude", "longitude"])
    base = times.reference_date(F.col("long_name"), F.col("units"))
    valid = times.decode_time(F.col("time"), F.col("units"), base)
    first = d.groupBy("pollutant_code").agg(F.min(valid).alias("__first"))
    d = d.join(F.broadcast(first), "pollutant_code")
    issued = F.coalesce(times.forecast_base(F.col("long_name")), F.col("__first"))
    hours = F.bround((times.ntz_micros(valid) - times.ntz_micros(issued)) / 3_600_000_000).cast("int")
    at = lambda c: iso(F.convert_timezone(F.lit("UTC"), F.lit(ZONE), c))
    return d.select(*_stamped(source), "pollutant", "pollutant_code", F.bround("value", 3).alias("value"), "unit", at(valid).alias("valid_datetime"), at(issued).alias("forecast_issued_at"), hours.alias("leadtime_hour"), F.bround("latitude", 4).alias("latitude"), F.bround("longitude", 4).alias("longitude"), captured.alias("captured_at"))


def of_venues(events: DataFrame, venues: DataFrame, venue: str = "venue_name") -> DataFrame:
    """Events at one of the venues, by any of their names; venues: venue_id, display_name, names array. [F18]"""
    v = venues.select("venue_id", "display_name", F.explode("names").alias("__alias")).groupBy("__alias").agg(F.min(F.struct("venue_id", "display_name")).alias("__v"))
    e = events.join(v, F.lower(text.collapse(F.col(venue))) == F.lower(text.collapse(F.col("__alias"))))
    return e.select(*events.columns, F.col("__v.venue_id").alias("venue_id"), F.col("__v.display_name").alias("venue"))


def routes(route: DataFrame, trip: DataFrame, stop_time: DataFrame, stop: DataFrame, mode: str, ingested: Column, source: str = "crtm") -> DataFrame:
    """Routes with the ordered stops of one representative trip each. [W6, J4, J5, A19, O3]

    Only the chosen trips' stop times are joined; the stops of a route (bounded
    by the trip) become an array sorted by sequence.
    """
    chosen = trip.groupBy("route_id").agg(F.min_by("trip_id", F.struct((F.coalesce(F.col("direction_id"), F.lit("")) != "0").alias("d"), F.col("trip_id"))).alias("trip_id"))
    times_of = joins.keep_known(stop_time, chosen, ["trip_id"]).join(stop, "stop_id")
    seq = F.coalesce(numbers.to_int(F.col("stop_sequence").cast("string")), F.lit(0))
    at = F.struct(seq.alias("sequence"), F.col("stop_id"), F.col("stop_name").alias("name"), _where(numbers.to_float(F.col("stop_lat")), numbers.to_float(F.col("stop_lon"))).alias("location"))
    per_trip = times_of.groupBy("trip_id").agg(F.sort_array(F.collect_list(at)).alias("stops"))
    j = route.join(chosen, "route_id", "left").join(per_trip, "trip_id", "left")
    return j.select(*_stamped(source), F.lit(mode).alias("mode"), "route_id", text.clean(F.col("route_short_name")).alias("short_name"), text.clean(F.col("route_long_name")).alias("long_name"), ingested.alias("ingested_at"), F.coalesce("stops", F.from_json(F.lit("[]"), per_trip.schema["stops"].dataType)).alias("stops"))


def route_stops(r: DataFrame) -> DataFrame:
    """One row per route and stop, with the line's name or, without one, its id. [C10, G5]"""
    return r.select("route_id", F.coalesce("short_name", "route_id").alias("line"), F.explode("stops").alias("s")).select("route_id", "line", "s.*")
