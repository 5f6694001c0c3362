"""Raw feeds to bronze, and on to silver where a mart takes them."""

import pytest
from pyspark.sql import functions as F

from mobilake.datasets import landing, specs
from mobilake.sources import readers

def now():
    return F.lit("2026-08-15T09:00:00+02:00")


def ntz(s):
    return F.lit(s).cast("timestamp_ntz")


def test_iso_offsets(spark):
    r = spark.range(1).select(landing.iso(ntz("2026-01-05 10:00:00")).alias("w"), landing.iso(ntz("2026-07-05 10:00:00")).alias("s"), landing.iso(ntz("2026-07-05 10:00:00"), "America/New_York").alias("n"), landing.iso_of_instant(F.lit(1755244800_000000)).alias("e")).first()
    assert (r.w, r.s, r.n, r.e) == ("2026-01-05T10:00:00+01:00", "2026-07-05T10:00:00+02:00", "2026-07-05T10:00:00-04:00", "2025-08-15T10:00:00+02:00")


def test_traffic_to_silver(spark):
    cols = "idelem string, descripcion string, accesoAsociado string, subarea string, error string, intensidad string, ocupacion string, carga string, nivelServicio string, intensidadSat string, st_x string, st_y string"
    raw = spark.createDataFrame([("1", " Calle ", "", "z", "N", "120", "5", "7", "0", "400", "440300,5", "4474300,5"), ("2", None, None, None, "S", "x", None, None, None, None, None, None)], cols)
    b = landing.traffic(raw, ntz("2026-08-15 08:55:00"), now())
    good, bad = specs.silver(specs.MARTS["trafico"], b)
    g = good.first()
    assert (g.point_id, g.description, g.access_code, g.intensity_ratio, g.fecha, g.hora) == ("1", "Calle", None, 0.3, "2026-08-15", "08") and g.location.lat == pytest.approx(40.416, abs=0.01)
    assert bad.first().reasons == ["location_missing_or_outside_madrid_bbox", "sensor_reports_error"]


def test_bikes_parking_arrivals(spark):
    info = spark.createDataFrame([("7", "n", "a", 20, 40.4, -3.7), ("8", "m", "b", 10, 40.4, -3.7)], "station_id string, name string, address string, capacity int, lat double, lon double")
    cols = "station_id string, last_reported bigint, num_bikes_available int, num_bikes_disabled int, num_docks_available int, num_docks_disabled int, status string, is_renting boolean, is_returning boolean, is_installed boolean"
    status = spark.createDataFrame([("7", 1755244800, 1, 0, 19, 0, "IN", True, True, True), ("7", 1755244900, 5, 0, 15, 0, "IN", True, True, True)], cols)
    r = {x.station_id: x for x in landing.bikes(info, status, now()).collect()}
    assert r["7"].bikes_available == 5 and r["7"].measured_at == "2025-08-15T10:01:40+02:00" and r["8"].bikes_available is None and r["8"].measured_at is None
    listed = spark.createDataFrame([("p", "n", " ", "40.4", "-3.7", "12", "15/08/2026 08:00:00"), ("q", "n", "a", "x", None, "", None)], "parking_id string, name string, address string, latitude string, longitude string, free string, moment string")
    total = spark.createDataFrame([("p", "100")], "parking_id string, total_spaces string")
    r = {x.parking_id: x for x in landing.parking(listed, total, now()).collect()}
    assert (r["p"].free_spaces, r["p"].total_spaces, r["p"].measured_at, r["p"].address) == (12, 100, "2026-08-15T08:00:00+02:00", None) and r["q"].total_spaces is None and r["q"].location.lat is None
    raw = spark.createDataFrame([(1, 27, 9, "Sol", 60, 400, "True", None, "0", ([-3.7, 40.4],)), (1, None, 9, None, None, None, None, 3, "0", None)], "stop_id int, line int, bus bigint, destination string, estimateArrive int, DistanceBus int, isHead string, deviation int, positionTypeBus string, geometry struct<coordinates:array<double>>")
    a = landing.arrivals(raw, now()).collect()
    assert (a[0].line, a[0].is_head, a[0].deviation_sec, a[0].location.lat) == ("27", True, 0, 40.4) and a[1].line is None and a[1].is_head is False and a[1].location.lat is None


def _wide(spark, rows):
    cols = ["PUNTO_MUESTREO", "MAGNITUD", "ANO", "MES", "DIA", *[f"{k}{h:02d}" for h in range(1, 25) for k in "HV"]]
    data = []
    for point, mag, upto in rows:
        data.append((point, mag, "2026", "08", "14", *[x for h in range(1, 25) for x in ((str(h * 1.0), "V") if h <= upto else ("0", "N"))]))
    return spark.createDataFrame(data, ", ".join(f"{c} string" for c in cols))


def test_wide_hours(spark):
    stations = spark.createDataFrame([("28079004", "Plaza", "dir", 40.4, -3.7, 600)], "station_id string, station_name string, station_address string, lat double, lon double, altitude_m int")
    air = {r.magnitude_code: r for r in landing.air(_wide(spark, [("28079004_8_8", "8", 24), ("28079009_14_6", "14", 3), ("28079004_1_1", "1", 0)]), stations, now()).collect()}
    assert set(air) == {"08", "14"} and (air["08"].value, air["08"].measured_at, air["08"].magnitude_abbr, air["08"].station_name) == (24.0, "2026-08-15T00:00:00+02:00", "NO2", "Plaza")
    assert air["14"].measured_at == "2026-08-14T03:00:00+02:00" and air["14"].station_name is None
    w = landing.weather(_wide(spark, [("28079004_83_1", "83", 5), ("28079004_86_1", "86", 7), ("28079004_99_1", "99", 9)]), stations, now()).collect()
    assert len(w) == 1 and (w[0].temperature_c, w[0].humidity_pct, w[0].pressure_mb, w[0].measured_at, w[0].location.altitude_m) == (5.0, 7.0, None, "2026-08-14T07:00:00+02:00", 600)


def test_text_feeds(spark):
    st = spark.createDataFrame([("RF-01", "P", "d", "di", "ba", 40.4, -3.7, 600)], "station_id string, station_name string, station_address string, district string, neighbourhood string, lat double, lon double, altitude_m int")
    n = landing.noise(spark.createDataFrame([("1", "2026", "8", "4", "D", "61,5", *["50,0"] * 5)], "NMT string, anio string, mes string, dia string, tipo string, LAeq string, L1 string, L10 string, L50 string, L90 string, L99 string"), st, now()).first()
    assert (n.station_id, n.measured_date, n.laeq_db, n.period_name, n.station_name) == ("RF-01", "2026-08-04", 61.5, "diurno", "P")
    c = landing.counts(spark.createDataFrame([("5/8/2025", "9:00", "PERM", "12.0", "1", "Centro", "x", "", "40.417.386", "-3.707.141")], "fecha string, hora string, identificador string, peatones string, numero_distrito string, distrito string, direccion string, observaciones_direccion string, latitude string, longitude string"), "peatones", "peatones", now()).first()
    assert (c.measured_at, c.pedestrian_count, c.bicycle_count, c.address_notes, c.location.lat, c.location.lon) == ("2025-08-05T09:00:00+02:00", 12, None, None, 40.417386, -3.707141)
    cal = landing.calendar(spark.createDataFrame([("15/08/2026", "sábado", "Festivo", "nacional", "Asunción"), ("x", None, None, None, None)], "Dia string, Dia_semana string, laborable_festivo string, Tipo_festivo string, Festividad string"), now()).collect()
    assert len(cal) == 1 and cal[0].is_holiday and cal[0].date == "2026-08-15"
    cr = landing.crossings(spark.createDataFrame([("1", "A", "2", "B", "40º25'0\" N", "3º41'30\" W"), ("9", "A", "2", "B", None, None)], "from_id string, from_name string, to_id string, to_name string, lat string, lon string"), spark.createDataFrame([("1",)], "vial_id string"), now()).collect()
    assert len(cr) == 1 and cr[0].location.lon == -3.691667


def test_nested_feeds(spark):
    raw = spark.createDataFrame([(("hola", "t", ["es"]), "i", 1, 2, 3, 4), (("hello", "t", ["en"]), "i", 1, 2, 3, 4), (("x", "t", None), "i", None, None, None, None)], "record struct<text:string,createdAt:string,langs:array<string>>, indexedAt string, likeCount int, repostCount int, replyCount int, quoteCount int")
    p = landing.posts(raw, "bajo_demanda", F.lit("sol"), now()).collect()
    assert [x.text for x in p] == ["hola", "x"] and len(p[0].post_hash) == 16
    a = landing.alerts(spark.createDataFrame([("i", "s", [("AEMET-Meteoalerta nivel", "rojo")], ["Sierra"], "viento", None, None, None, "a", "b", None, None)], "identifier string, sent string, parameters array<struct<valueName:string,value:string>>, areas array<string>, event string, severity string, urgency string, certainty string, onset string, expires string, headline string, description string"), now()).first()
    assert (a.zone, a.level, a.phenomenon) == ("Sierra", "rojo", "viento")
    ring = [[x / 10, 0.0] for x in range(11)] + [[1.0, 1.0], [0.0, 1.0], [0.0, 0.0]]
    f = spark.createDataFrame([(("011", "Sol"), "Polygon", [[ring]]), (("012", "Luna"), "Polygon", None)], "properties struct<COD_BAR:string,NOMBRE:string>, type string, coordinates array<array<array<array<double>>>>")
    r = {x.neighbourhood_id: x for x in landing.areas(f, {"neighbourhood_id": "COD_BAR", "name": "NOMBRE"}, now()).collect()}
    assert r["011"].geometry.coordinates == [[[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 1.0], [0.0, 0.0]]]] and r["012"].geometry.coordinates is None
    day = spark.createDataFrame([("1", "M", "P", "e", [("2026-08-15T00:00:00", [("00-12", "11", "x"), ("00-24", "12", "Nuboso")], [(None, "40")], (30, 20))])], "id string, nombre string, provincia string, elaborado string, dia array<struct<fecha:string,estadoCielo:array<struct<periodo:string,value:string,descripcion:string>>,probPrecipitacion:array<struct<periodo:string,value:string>>,temperatura:struct<maxima:int,minima:int>>>")
    d = landing.forecast_days(day, now()).first()
    assert (d.valid_date, d.sky_state, d.sky_state_code, d.precipitation_probability_pct, d.temperature_max_c) == ("2026-08-15", "Nuboso", "12", "40", 30)
    pl = landing.places(spark.createDataFrame([("p", "n", "a", (40.4, -3.7), 33, [("lunes", [1])])], "id string, name string, address string, coordinates struct<lat:double,lng:double>, current_popularity int, populartimes array<struct<name:string,data:array<int>>>"), F.lit("q"), now()).first()
    assert pl.typical_by_hour.lunes == [1] and pl.location.lon == -3.7


def test_routes_and_venues(spark):
    route = spark.createDataFrame([("r", " 5 ", "L"), ("q", None, None)], "route_id string, route_short_name string, route_long_name string")
    trip = spark.createDataFrame([("r", "t1", "1"), ("r", "t2", "0"), ("r", "t3", "0"), ("q", "t9", None)], "route_id string, trip_id string, direction_id string")
    stop_time = spark.createDataFrame([("t2", "10", "b"), ("t2", "2", "a"), ("t2", None, "z"), ("t1", "1", "b"), ("t2", "11", "gone")], "trip_id string, stop_sequence string, stop_id string")
    stop = spark.createDataFrame([("a", "A", "40.4", "-3.7"), ("b", "B", "x", None), ("z", "Z", "40.5", "-3.7")], "stop_id string, stop_name string, stop_lat string, stop_lon string")
    r = landing.routes(route, trip, stop_time, stop, "metro", now())
    got = {x.route_id: [s.stop_id for s in x.stops] for x in r.collect()}
    assert got == {"r": ["z", "a", "b"], "q": []}
    flat = landing.route_stops(r).collect()
    assert {(x.line, x.stop_id) for x in flat} == {("5", "z"), ("5", "a"), ("5", "b")}
    ev = spark.createDataFrame([(1, " teatro  real "), (2, "Otro"), (3, None)], "i int, venue_name string")
    ve = spark.createDataFrame([("v", "Teatro Real", ["Teatro Real", "El Real"]), ("w", "W", ["Teatro Real"])], "venue_id string, display_name string, names array<string>")
    assert [(x.i, x.venue_id) for x in landing.of_venues(ev, ve).collect()] == [(1, "v")]


def test_all_pollutant_codes_also_without_padding(spark):
    base = {"PUNTO_MUESTREO": "28079004_1_38", "ANO": "2026", "MES": "08", "DIA": "15", **{f"H{h:02d}": "12" for h in range(1, 25)}, **{f"V{h:02d}": "V" for h in range(1, 25)}}
    rows = [(*base.values(), c) for c in ("1", "08", "431", "35", "99", None)]
    df = spark.createDataFrame(rows, ", ".join(f"{k} string" for k in [*base, "MAGNITUD"]))
    stations = spark.createDataFrame([("28079004", "Sol", "Plaza", 40.4, -3.7)], "station_id string, station_name string, station_address string, lat double, lon double")
    got = {r.magnitude_code: (r.magnitude_abbr, r.unit) for r in landing.air(df, stations, F.lit("now")).collect()}
    assert got == {"01": ("SO2", "µg/m³"), "08": ("NO2", "µg/m³"), "431": ("MPX", "mg/m³"), "35": ("EBE", "µg/m³"), "99": (None, None), "00": (None, None)}


def test_municipal_events(spark):
    v = {"id": "1", "title": "Noche &amp; día", "@type": "https://d.es/kos/actividades/CineActividades%20Audio", "dtstart": "2026-08-21 22:00:00.0", "dtend": "pronto", "free": 1, "price": "", "event-location": "Sala", "address": {"area": {"@id": "https://d.es/Barrio/Sol", "street-address": "Mayor 1", "postal-code": "28013"}, "district": {"@id": "https://d.es/Distrito/Centro"}}, "location": {"latitude": 40.4, "longitude": -3.7}, "description": "x" * 500}
    import json

    df = spark.createDataFrame([(json.dumps(v),), ('{"uid": "2"}',)], "j string").select(F.parse_json("j").alias("v"))
    a, b = sorted(landing.municipal_events(df, F.lit("now")).collect(), key=lambda r: r.event_id)
    assert (a.event_id, a.category, a.start_datetime, a.end_datetime, a.free, a.price_info) == ("1", "CineActividades Audio", "2026-08-21T22:00:00", "pronto", True, None)
    assert tuple(a.location) == ("Sala", "Mayor 1", "Centro", "Sol", "28013", 40.4, -3.7, "EPSG:4326") and len(a.description) <= 403
    assert (b.event_id, b.title, b.free, b.location.lat, b.location.srid) == ("2", None, None, None, None)


def test_tourism_events_and_places(spark, tmp_path):
    xml = """<list><service id="7" fechaActualizacion="2026-01-02"><basicData><name>M&amp;aacute;laga</name><body>&lt;p&gt;Un &lt;b&gt;d&#237;a&lt;/b&gt;&lt;/p&gt;</body><nombrert>Teatro Uno</nombrert><web>w</web></basicData><geoData><address>Sol 1</address><latitude>40.4</latitude><longitude>-3.7</longitude></geoData>
<extradata><item name="Tipo">Ocio</item><item name="Horario">&lt;p&gt;10 h&lt;/p&gt;</item><item name="Servicios de pago">5 &amp;euro;</item><fechas><rango><inicio>01/09/2026</inicio><fin>x</fin></rango><rango><inicio>02/09/2026</inicio><fin>y</fin></rango></fechas>
<categorias><categoria><item name="Categoria">Teatro</item><subcategorias><subcategoria><item name="SubCategoria">Danza</item></subcategoria></subcategorias></categoria></categorias></extradata></service><service id="8"><basicData/></service></list>"""
    (tmp_path / "a.xml").write_text(xml)
    from pyspark.sql.types import StructType

    service = readers.xml_rows(spark, str(tmp_path), "service", StructType.fromDDL(landing.TOURISM))
    a, b = sorted(landing.tourism_events(service, F.lit("now")).collect(), key=lambda r: r.event_id)
    assert (a.title, a.description, a.category, a.start_datetime, a.end_datetime, a.schedule_text, a.price_info) == ("Málaga", "Un día", "Ocio > Teatro > Danza", "2026-09-01", "x", "10 h", "5 €")
    assert a.location.venue_name == "Teatro Uno" and a.location.lat == 40.4 and b.title is None and b.category is None
    venues = spark.createDataFrame([("v1", "Uno", ["teatro  uno", "otro"])], "venue_id string, display_name string, names array<string>")
    v = landing.venue_events(landing.tourism_events(service, F.lit("now")), venues).collect()
    assert [(r.venue_id, r.venue_name, r.event_type, r.event_id, r.upstream_source) for r in v] == [("v1", "Uno", "danza", "7", "agenda_turismo_esmadrid")]
    kinds = spark.createDataFrame([("7", "Monumentos", ["a"])], "poi_id string, name string, subcategories array<string>")
    p = {r.poi_id: r for r in landing.points_of_interest(service, kinds, F.lit("now")).collect()}
    assert (p["7"].name, p["7"].category, p["7"].last_updated, p["8"].category, p["8"].name) == ("Málaga", "Monumentos", "2026-01-02", None, None)


def test_streets_showtimes_premieres(spark):
    names = ["Codigo de vía", "Clase de la via", "Particula de la via", "Nombre de la via", "Literal completo del vial ", "Tipo de la via", "Situacion de la via respecto al terreno", "Codigos postales", "Codigo de vía I N E ", "Distritos atravesados", "Cantidad de numeraciones en la via", "Latitud en S R  WGS84 (inicio)", "Longitud en S R  WGS84 (inicio)", "Latitud en S R  WGS84 (final)", "Longitud en S R  WGS84 (final)"]
    row = ("31", "CALLE", " ", "SOL", "CALLE SOL", "Vía", "S", "varios", "5", "1 - 2", "7", "40°25'7.0'' N", "3°42'0.0'' W", None, "")
    s = landing.streets(spark.createDataFrame([row], ", ".join(f"`{n}` string" for n in names)), F.lit("now")).first()
    assert (s.vial_id, s.particle, s.district_codes, s.address_count, s.start_node.lat, s.start_node.lon, s.end_node.lat) == ("31", None, ["1", "2"], 7, 40.418611, -3.7, None)
    raw = spark.createDataFrame([("c", 1, "s1", "2026-08-15T20:00:00+02:00", None, "Film", "u", "Versión - VOSE", '["3D"]'), ("c", 2, "s1", "other", None, "Film", "u", "x", "bad"), ("c", 3, "", "t", None, "F", "u", "x", None)], "cinema_id string, position int, showtime_id string, showtime_time string, cinema_name string, movie_title string, movie_url string, version_text string, experiences string")
    out = landing.showtimes(raw, spark.createDataFrame([("c", "chain", "Cine")], "cinema_id string, chain string, cinema_name string"), F.lit("now")).collect()
    assert [(r.showtime_id, r.showtime_datetime, r.cinema_name, r.language_version, r.experiences) for r in out] == [("s1", "2026-08-15T20:00:00+02:00", "Cine", "VOSE", ["3D"])]
    p = landing.premieres(spark.createDataFrame([("Film", "u", "15 de agosto de 2026", "1h 45min", ["a"]), (None, "u", None, None, None)], "title string, url string, release string, info string, genres array<string>"), F.lit("now")).collect()
    assert [(r.movie_title, r.release_date, r.duration_minutes) for r in p] == [("Film", "2026-08-15", 105)]


def test_model_forecast(spark):
    g = [("NO2", "no2", "ug", 1.23456, lat, lon, t, "hours", "FORECAST time from 20260815") for lat in (40.4, 41.0) for lon in (356.3, 357.0) for t in (0.0, 5.0)]
    grid = spark.createDataFrame(g, "pollutant string, pollutant_code string, unit string, value double, latitude double, longitude double, time double, units string, long_name string")
    out = sorted(landing.model_forecast(grid, 40.42, -3.7, F.lit("now")).collect(), key=lambda r: r.leadtime_hour)
    assert [(r.value, r.latitude, r.longitude, r.valid_datetime, r.forecast_issued_at, r.leadtime_hour) for r in out] == [(1.235, 40.4, -3.7, "2026-08-15T02:00:00+02:00", "2026-08-15T02:00:00+02:00", 0), (1.235, 40.4, -3.7, "2026-08-15T07:00:00+02:00", "2026-08-15T02:00:00+02:00", 5)]
    since = grid.withColumns({"units": F.lit("seconds since 2026-08-15 06:00:00"), "long_name": F.lit("time")})
    assert sorted(r.leadtime_hour for r in landing.model_forecast(since, 40.42, -3.7, F.lit("now")).collect()) == [0, 0]


def test_archive_rows_are_streamed_and_filtered(spark, tmp_path):
    import zipfile

    from pyspark.sql.types import StructType

    with zipfile.ZipFile(tmp_path / "g.zip", "w") as z:
        z.writestr("stop_times.txt", "\ufefftrip_id,stop_id,stop_sequence\n" + "".join(f"t{i % 3},s{i},{i}\n" for i in range(50)))
    schema = StructType.fromDDL("trip_id string, stop_sequence int, none string")
    got = readers.archive_rows(spark, str(tmp_path / "g.zip"), "stop_times.txt", schema, keys=["t1"], column="trip_id", batch=4).collect()
    assert sorted(r.stop_sequence for r in got) == list(range(1, 50, 3)) and all(r.trip_id == "t1" and r.none is None for r in got)
    assert readers.archive_rows(spark, str(tmp_path / "g.zip"), "stop_times.txt", schema).count() == 50


def test_slow_body_ends_at_the_deadline():
    from mobilake.sources import remote

    clock, blocks = iter(range(100)), iter([b"a"] * 50)
    with pytest.raises(TimeoutError):
        remote.within_deadline(lambda n: next(blocks, b""), 5, now=lambda: next(clock))
    assert remote.within_deadline(lambda n, it=iter([b"a", b"b", b""]): next(it), 5) == b"ab"
