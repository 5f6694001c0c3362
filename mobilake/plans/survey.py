"""Functions and operators one by one as queries over the given tables, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mobilake.datasets import landing
from mobilake.functions import arrays, numbers, text, times
from mobilake.functions.instants import from_epoch_us
from mobilake.operators import contracts, gate, graph, joins, rollup, spatial, windows
from mobilake.plans.general import SQL, _nodes, _r, _t, query


@query("SELECT row_id, CAST(trunc(try_cast(trim(precipitation_probability_pct)||'.7' AS DOUBLE)) AS INTEGER) AS n FROM aemet_prevision")
def int_via_float(spark: SparkSession, d: str) -> DataFrame:
    """[M2] '35.7' to 35, '.7' (a blank before it) to 0, words to null."""
    return _t(spark, d, "aemet_prevision").select("row_id", numbers.to_int_via_float(F.concat(F.trim("precipitation_probability_pct"), F.lit(".7"))).alias("n"))


@query("SELECT p_partkey, CAST(CASE WHEN p_size%2=0 THEN p_size END AS INTEGER) AS n, p_retailprice AS x FROM part")
def safe_numbers(spark: SparkSession, d: str) -> DataFrame:
    """[M1] whole and decimal texts, others null."""
    p = _t(spark, d, "part")
    return p.select("p_partkey", numbers.to_int(F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(" "), F.col("p_size"))).otherwise(F.lit("4 2"))).alias("n"), numbers.to_float(F.col("p_retailprice").cast("string")).alias("x"))


@query("SELECT row_id, round(location.lat*1000000)/1000000 AS lat, round(location.lon*1000000)/1000000 AS lon FROM poi_madrid WHERE location.lat BETWEEN 10 AND 80 AND location.lon BETWEEN -99 AND -1")
def grouped_decimals(spark: SparkSession, d: str) -> DataFrame:
    """[M4] '40.417.386' to 40.417386, '-3.707.141' to -3.707141."""
    k = lambda c: F.abs(F.round(F.col(c) * 1_000_000)).cast("bigint")
    as_text = lambda c: F.concat(F.when(F.col(c) < 0, "-").otherwise(""), (k(c) / 1_000_000).cast("bigint").cast("string"), F.lit("."), F.lpad(((k(c) % 1_000_000) / 1000).cast("bigint").cast("string"), 3, "0"), F.lit("."), F.lpad((k(c) % 1000).cast("string"), 3, "0"))
    p = _t(spark, d, "poi_madrid").where(F.col("location.lat").between(10, 80) & F.col("location.lon").between(-99, -1))
    return p.select("row_id", numbers.grouped_decimal(as_text("location.lat")).alias("lat"), numbers.grouped_decimal(as_text("location.lon")).alias("lon"))


@query("SELECT p_partkey, round((CASE WHEN p_partkey%2=0 THEN 1 ELSE -1 END)*(p_partkey%80 + (p_partkey%60)/60.0 + (p_partkey%59 + 0.25)/3600.0),6) AS deg FROM part")
def dms(spark: SparkSession, d: str) -> DataFrame:
    """[M5] degrees, minutes and seconds with a hemisphere."""
    n = F.col("p_partkey")
    t = F.concat((n % 80).cast("string"), F.lit("°"), (n % 60).cast("string"), F.lit("' "), (n % 59).cast("string"), F.lit(",25'' "), F.when(n % 2 == 0, "N").otherwise("W"))
    return _t(spark, d, "part").select("p_partkey", numbers.dms(t).alias("deg"))


_UTM = """WITH k AS (SELECT 6378137.0 AS a, 1/298.257222101 AS f, 0.9996 AS k0), c AS (SELECT *, f*(2-f) AS e2 FROM k), c2 AS (SELECT *, (1-sqrt(1-e2))/(1+sqrt(1-e2)) AS n, e2/(1-e2) AS ep FROM c),
p AS (SELECT p_partkey, 430000.0 + p_partkey%20000 AS x, 4470000.0 + p_partkey%15000 AS y FROM part),
m AS (SELECT p_partkey, x, c2.*, y/k0/(a*(1-e2/4-3*e2*e2/64-5*e2*e2*e2/256)) AS mu FROM p, c2),
q AS (SELECT *, mu+(3*n/2-27*pow(n,3)/32)*sin(2*mu)+(21*n*n/16-55*pow(n,4)/32)*sin(4*mu)+(151*pow(n,3)/96)*sin(6*mu)+(1097*pow(n,4)/512)*sin(8*mu) AS phi FROM m),
s AS (SELECT *, a/sqrt(1-e2*pow(sin(phi),2)) AS nu, a*(1-e2)/pow(1-e2*pow(sin(phi),2),1.5) AS rho, ep*pow(cos(phi),2) AS cc, pow(tan(phi),2) AS t FROM q), u AS (SELECT *, (x-500000.0)/k0/nu AS d FROM s)
SELECT p_partkey, round(degrees(phi-nu*tan(phi)/rho*(d*d/2-(5+3*t+10*cc-4*cc*cc-9*ep)*pow(d,4)/24+(61+90*t+298*cc+45*t*t-252*ep-3*cc*cc)*pow(d,6)/720)),7) AS lat,
round(degrees((d-(1+2*t+cc)*pow(d,3)/6+(5-2*cc+28*t-3*cc*cc+8*ep+24*t*t)*pow(d,5)/120)/cos(phi))-3,7) AS lon FROM u"""
SQL["utm_reprojection"] = _UTM


@query("SELECT l_orderkey, l_linenumber, round_even(l_extendedprice/7, 2) AS x FROM lineitem")
def half_even(spark: SparkSession, d: str) -> DataFrame:
    """[M11]"""
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", numbers.half_even(F.col("l_extendedprice") / 7, 2).alias("x"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey%360>180 THEN o_orderkey%360-360 ELSE o_orderkey%360 END AS lon FROM orders")
def wrap_longitude(spark: SparkSession, d: str) -> DataFrame:
    """[M12]"""
    return _t(spark, d, "orders").select("o_orderkey", numbers.wrap_longitude(F.col("o_orderkey") % 360).alias("lon"))


@query("SELECT o_orderkey, strftime(o_orderdate,'%Y-%m-%d %H:%M:%S') AS a, strftime(o_orderdate,'%Y-%m-%d') AS b FROM orders")
def source_formats(spark: SparkSession, d: str) -> DataFrame:
    """[D5] texts in one of several known formats."""
    o = F.col("o_orderdate")
    t = F.when(F.col("o_orderkey") % 2 == 0, F.date_format(o, "dd/MM/yyyy HH:mm:ss")).otherwise(F.concat(F.date_format(o, "yyyy-MM-dd HH:mm:ss"), F.lit(".0")))
    at = times.source_time(t, "dd/MM/yyyy HH:mm:ss", "yyyy-MM-dd HH:mm:ss")
    return _t(spark, d, "orders").select("o_orderkey", F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("a"), times.date_key(at).alias("b"))


@query("SELECT o_orderkey, strftime(o_orderdate,'%Y-%m-%d') AS day FROM orders")
def long_dates(spark: SparkSession, d: str) -> DataFrame:
    """[D6] '15 de agosto de 2026'."""
    from mobilake.functions.instants import MONTHS

    o = F.col("o_orderdate")
    name = F.element_at(F.array(*[F.lit(m[0].capitalize()) for m in MONTHS]), F.month(o))
    t = F.concat(F.dayofmonth(o).cast("string"), F.lit(" de "), name, F.lit(" de "), F.year(o).cast("string"))
    return _t(spark, d, "orders").select("o_orderkey", F.date_format(times.long_date(t), "yyyy-MM-dd").alias("day"))


@query("SELECT p_partkey, CASE WHEN p_partkey%4=3 THEN NULL ELSE CAST((CASE WHEN p_partkey%4<2 THEN p_size ELSE 0 END)*60 + (CASE WHEN p_partkey%4>0 THEN p_partkey%60 ELSE 0 END) AS INTEGER) END AS minutes FROM part")
def durations(spark: SparkSession, d: str) -> DataFrame:
    """[D7] '1h 45min', '2h', '95min', none."""
    n, h, m = F.col("p_partkey"), F.concat(F.col("p_size").cast("string"), F.lit("h")), F.concat((F.col("p_partkey") % 60).cast("string"), F.lit("min"))
    t = F.when(n % 4 == 0, h).when(n % 4 == 1, F.concat(h, F.lit(" "), m)).when(n % 4 == 2, m).otherwise(F.lit("sin datos"))
    return _t(spark, d, "part").select("p_partkey", times.duration_min(t).cast("int").alias("minutes"))


_OFFSET = "CAST(date_diff('minute', {u}, timezone('Europe/Madrid', timezone('UTC', {u}))) AS BIGINT)"


@query(f"SELECT event_id, strftime(timezone('Europe/Madrid', timezone('UTC', date_trunc('second', ts))),'%Y-%m-%dT%H:%M:%S')||'+'||lpad(CAST({_OFFSET.format(u='ts')}//60 AS VARCHAR),2,'0')||':00' AS at FROM events")
def epoch_to_local(spark: SparkSession, d: str) -> DataFrame:
    """[D8, D10] seconds since 1970 to local ISO text with its offset."""
    seconds = F.floor(times.ntz_micros(F.col("ts").cast("timestamp_ntz")) / 1_000_000)
    return _t(spark, d, "events").select("event_id", landing.iso_of_instant(seconds * 1_000_000).alias("at"))


@query("SELECT o_orderkey, strftime(date_trunc('day', o_orderdate) + to_hours(CAST(o_orderkey%24+1 AS INTEGER)),'%Y-%m-%d %H:%M') AS at FROM orders")
def hours_of_day(spark: SparkSession, d: str) -> DataFrame:
    """[D9] hours 1 to 24; 24 is the next day's midnight."""
    o = F.col("o_orderdate")
    at = times.hour_of_day(F.year(o), F.month(o), F.dayofmonth(o), (F.col("o_orderkey") % 24 + 1).cast("int"))
    return _t(spark, d, "orders").select("o_orderkey", F.date_format(at, "yyyy-MM-dd HH:mm").alias("at"))


@query("SELECT event_id, strftime(timezone('Europe/Madrid', timezone('UTC', ts - INTERVAL 1 HOUR)),'%Y-%m-%d') AS fecha, strftime(timezone('Europe/Madrid', timezone('UTC', ts - INTERVAL 1 HOUR)),'%H') AS hora FROM events")
def previous_hours(spark: SparkSession, d: str) -> DataFrame:
    """[D11, N16]"""
    at = F.timestamp_micros(times.ntz_micros(F.col("ts").cast("timestamp_ntz")))
    return _t(spark, d, "events").select("event_id", times.previous_hour(at).alias("p")).select("event_id", "p.fecha", "p.hora")


@query("SELECT o_orderkey, strftime(CAST(unnest(generate_series(date_trunc('day',o_orderdate), date_trunc('day',o_orderdate)+INTERVAL 3 DAY, INTERVAL 1 DAY)) AS DATE),'%Y-%m-%d') AS day FROM orders WHERE o_orderstatus='F'")
def date_ranges(spark: SparkSession, d: str) -> DataFrame:
    """[D11]"""
    day = F.col("o_orderdate").cast("date")
    o = _t(spark, d, "orders").where("o_orderstatus = 'F'")
    return o.select("o_orderkey", F.explode(times.days_between(day, F.date_add(day, 3))).alias("x")).select("o_orderkey", F.date_format("x", "yyyy-MM-dd").alias("day"))


@query("SELECT o_orderkey, strftime(CASE WHEN o_orderkey%2=0 THEN TIMESTAMP '1900-01-01' ELSE date_trunc('day', o_orderdate) END + to_hours(CAST(o_orderkey%97 AS INTEGER)),'%Y-%m-%d %H') AS at FROM orders")
def model_times(spark: SparkSession, d: str) -> DataFrame:
    """[D16] 'hours since DATE', or hours with the date in a long name."""
    even = F.col("o_orderkey") % 2 == 0
    units = F.when(even, "hours since 1900-01-01 00:00:00").otherwise("hours")
    name = F.when(even, "time").otherwise(F.concat(F.lit("FORECAST time from "), F.date_format("o_orderdate", "yyyyMMdd")))
    at = times.decode_time((F.col("o_orderkey") % 97).cast("double"), units, times.reference_date(name, units))
    return _t(spark, d, "orders").select("o_orderkey", F.date_format(at, "yyyy-MM-dd HH").alias("at"))


@query("SELECT o_orderkey, CASE WHEN strftime(o_orderdate,'%m-%d') IN ('01-01','12-25') THEN 'festivo' WHEN isodow(o_orderdate)=7 THEN 'domingo' WHEN isodow(o_orderdate)=6 THEN 'sabado' ELSE 'laborable' END AS kind FROM orders")
def day_kinds(spark: SparkSession, d: str) -> DataFrame:
    """[D17]"""
    day = F.col("o_orderdate").cast("date")
    holidays = F.array(F.make_date(F.year(day), F.lit(1), F.lit(1)), F.make_date(F.year(day), F.lit(12), F.lit(25)))
    return _t(spark, d, "orders").select("o_orderkey", times.day_kind(day, holidays).alias("kind"))


@query("SELECT event_id, CAST(CASE WHEN hour(ts)<20 THEN (isodow(ts)-1)*100+hour(ts) END AS INTEGER) AS typical FROM events")
def week_profiles(spark: SparkSession, d: str) -> DataFrame:
    """[C1, C2, C3, A14] a week profile of named arrays, read at an event's weekday and hour; hours beyond it are null."""
    entries = F.array(*[F.struct(F.lit(w.capitalize()).alias("name"), F.sequence(F.lit(i * 100), F.lit(i * 100 + 19)).alias("data")) for i, w in enumerate(times.WEEKDAYS)])
    return _t(spark, d, "events").withColumn("week", arrays.week_profile(entries)).select("event_id", arrays.profile_at(F.col("week"), F.col("ts")).alias("typical"))


@query("SELECT row_id, CASE WHEN row_id%3=0 THEN '' ELSE coalesce(array_to_string(subcategories,'|'),'') END AS parts FROM poi_madrid")
def text_lists(spark: SparkSession, d: str) -> DataFrame:
    """[C5] JSON lists of texts; broken ones are empty."""
    t = F.when(F.col("row_id") % 3 == 0, "[broken").otherwise(F.to_json("subcategories"))
    return _t(spark, d, "poi_madrid").select("row_id", F.array_join(arrays.text_list(t), "|").alias("parts"))


@query("SELECT row_id, CASE WHEN row_id%2=0 THEN humidity_min_pct ELSE humidity_max_pct END AS value FROM aemet_prevision")
def whole_days(spark: SparkSession, d: str) -> DataFrame:
    """[C6] the entry of 00-24, else the one without period."""
    e = lambda p, c: F.struct(p.cast("string").alias("periodo"), F.col(c).alias("value"))
    some = F.array(e(F.lit("00-12"), "humidity_max_pct"), e(F.lit("00-24"), "humidity_min_pct"))
    entries = F.when(F.col("row_id") % 2 == 0, some).otherwise(F.array(e(F.lit(None), "humidity_max_pct")))
    return _t(spark, d, "aemet_prevision").select("row_id", arrays.whole_day(entries).alias("value"))


@query("SELECT row_id, CASE WHEN row_id%2=0 THEN sky_state ELSE municipio_name END AS zone FROM aemet_prevision")
def alert_parameters(spark: SparkSession, d: str) -> DataFrame:
    """[C7] named parameters with a chain of names; of a repeated name the last counts."""
    p = lambda n, v: F.struct(F.lit(n).alias("valueName"), v.alias("value"))
    entries = F.when(F.col("row_id") % 2 == 0, F.array(p("zona", F.col("province")), p("zona", F.col("sky_state")))).otherwise(F.array(p("lugar", F.col("municipio_name"))))
    return _t(spark, d, "aemet_prevision").select("row_id", arrays.parameters(entries, "zona", "lugar").alias("zone"))


@query("""WITH r AS (SELECT row_id, unnest(geometry.coordinates) AS rings FROM barrios_madrid), g AS (SELECT row_id, unnest(rings) AS ring FROM r), p AS (SELECT row_id, unnest(ring) AS pt FROM g)
SELECT row_id, count(*) AS points, min(pt[2]) AS south, max(pt[1]) AS east FROM p GROUP BY 1""")
def ring_points(spark: SparkSession, d: str) -> DataFrame:
    """[C8, C10] polygons exploded to points, [lon, lat] read by place."""
    b = _t(spark, d, "barrios_madrid").select("row_id", F.explode("geometry.coordinates").alias("rings")).select("row_id", F.explode("rings").alias("ring")).select("row_id", F.explode("ring").alias("p"))
    at = arrays.point_of(F.col("p"))
    return b.groupBy("row_id").agg(F.count(F.lit(1)).alias("points"), F.min(at["lat"]).alias("south"), F.max(at["lon"]).alias("east"))


@query("SELECT row_id FROM aemet_prevision WHERE coalesce(try_cast(precipitation_probability_pct AS DOUBLE) BETWEEN 5 AND 90, false)")
def range_required(spark: SparkSession, d: str) -> DataFrame:
    """numbers as text in a range; null and no number fail."""
    good, _ = gate.split(_t(spark, d, "aemet_prevision"), [gate.between("precipitation_probability_pct", 5, 90, required=True)])
    return good.select("row_id")


@query("SELECT row_id FROM aemet_prevision WHERE NOT coalesce(humidity_min_pct + temperature_min_c > humidity_max_pct, false)")
def parts_within_whole(spark: SparkSession, d: str) -> DataFrame:
    """a sum of columns against another; nulls pass."""
    good, _ = gate.split(_t(spark, d, "aemet_prevision"), [gate.exceeds("too_much", ["humidity_min_pct", "temperature_min_c"], "humidity_max_pct")])
    return good.select("row_id")


@query("SELECT row_id FROM ruido WHERE period IN ('D','E')")
def set_rule(spark: SparkSession, d: str) -> DataFrame:
    """membership; null fails."""
    good, _ = gate.split(_t(spark, d, "ruido"), [gate.one_of("period", ("D", "E"))])
    return good.select("row_id")


@query("SELECT vec_id FROM embeddings WHERE len(list_filter(embedding, lambda x: x < -0.45 OR x > 0.45)) = 0")
def array_range(spark: SparkSession, d: str) -> DataFrame:
    """no element out of range."""
    return _t(spark, d, "embeddings").where(arrays.all_within([F.col("embedding").cast("array<double>")], -0.45, 0.45)).select("vec_id")


@query("SELECT event_id FROM events WHERE json_exists(props, '$.k') ")
def payload_keys(spark: SparkSession, d: str) -> DataFrame:
    """[F10, U3] records whose payload has one of some keys."""
    return _t(spark, d, "events").where(arrays.has_key(F.col("props"), "k", "error")).select("event_id")


@query("SELECT row_id FROM agenda_eventos WHERE free IS NOT DISTINCT FROM false")
def is_false(spark: SparkSession, d: str) -> DataFrame:
    """false itself, not null."""
    return _t(spark, d, "agenda_eventos").where(F.coalesce(~F.col("free"), F.lit(False))).select("row_id")


@query("SELECT row_id FROM aforos_peatones_bicicletas WHERE mode='peatones' AND pedestrian_count IS NOT NULL")
def typed_records(spark: SparkSession, d: str) -> DataFrame:
    """records of one type whose figure is there."""
    good, _ = gate.split(_t(spark, d, "aforos_peatones_bicicletas"), [gate.one_of("mode", ("peatones",)), gate.null("pedestrian_count")])
    return good.select("row_id")


@query("SELECT row_id FROM ruido WHERE year(try_cast(measured_date AS DATE)) = (SELECT max(year(try_cast(measured_date AS DATE))) FROM ruido WHERE regexp_full_match(measured_date,'\\d{4}-\\d{2}-\\d{2}')) AND regexp_full_match(measured_date,'\\d{4}-\\d{2}-\\d{2}')")
def latest_year_rows(spark: SparkSession, d: str) -> DataFrame:
    """[F16]"""
    return windows.latest_year(_t(spark, d, "ruido"), times.iso_date(F.col("measured_date"))).select("row_id")


@query("""WITH v AS (SELECT lower(venue_name) AS n, min(venue_id) AS venue_id FROM agenda_recintos GROUP BY 1), e AS (SELECT row_id, nullif(trim(regexp_replace(location.venue_name,'\\s+',' ','g')),'') AS n FROM agenda_eventos)
SELECT row_id, venue_id FROM e JOIN v ON lower(e.n)=trim(regexp_replace(v.n,'\\s+',' ','g'))""")
def venue_filter(spark: SparkSession, d: str) -> DataFrame:
    """[F18, J4] events at venues known by one of their names; others are dropped."""
    r = _t(spark, d, "agenda_recintos").groupBy(F.lower("venue_name").alias("n")).agg(F.min("venue_id").alias("venue_id"))
    v = r.select("venue_id", F.col("n").alias("display_name"), F.array("n").alias("names"))
    e = _t(spark, d, "agenda_eventos").select("row_id", F.col("location.venue_name").alias("venue_name"))
    return landing.of_venues(e, v).select("row_id", "venue_id")


@query("SELECT row_id, concat_ws(' > ', nullif(trim(category),''), nullif(trim(location.district),''), nullif(trim(location.neighborhood),'')) AS trail, lower(coalesce(nullif(trim(location.neighborhood),''), nullif(trim(location.district),''), nullif(trim(category),''))) AS last FROM agenda_eventos WHERE concat_ws('', category, location.district, location.neighborhood)<>''")
def breadcrumbs(spark: SparkSession, d: str) -> DataFrame:
    """[X6, X7] parts joined, and the last of them."""
    t = text.breadcrumb(F.col("category"), F.col("location.district"), F.col("location.neighborhood"))
    return _t(spark, d, "agenda_eventos").select("row_id", t.alias("trail")).where(F.col("trail").isNotNull()).select("row_id", "trail", text.last_part(F.col("trail")).alias("last"))


@query("SELECT row_id, nullif(substr(title, strpos(title,' - ')+3),'') AS version FROM agenda_eventos WHERE strpos(title,' - ')>0")
def after_dash(spark: SparkSession, d: str) -> DataFrame:
    """[X8]"""
    return _t(spark, d, "agenda_eventos").where(F.contains("title", F.lit(" - "))).select("row_id", text.after_dash(F.col("title")).alias("version"))


@query("SELECT row_id, string_split(device_id||'_8_x','_')[1] AS first, list_filter(list_transform(string_split(station_id,'_'), lambda x: trim(x)), lambda x: x<>'') AS parts FROM aforos_peatones_bicicletas")
def split_codes(spark: SparkSession, d: str) -> DataFrame:
    """[X10]"""
    return _t(spark, d, "aforos_peatones_bicicletas").select("row_id", text.first_of(F.concat("device_id", F.lit("_8_x"))).alias("first"), text.parts_of(F.col("station_id"), "_").alias("parts"))


@query("SELECT event_id, concat_ws(' ', nullif(event_type,''), user_id) AS q, event_type LIKE 'p%' AS p FROM events")
def search_terms(spark: SparkSession, d: str) -> DataFrame:
    """[X11, X15]"""
    e = _t(spark, d, "events")
    return e.select("event_id", text.search_terms(F.concat(F.lit("##"), "event_type"), F.lit("  "), F.col("user_id").cast("string")).alias("q"), text.is_true(F.when(F.col("event_type").startswith("p"), " TRUE").otherwise("False")).alias("p"))


@query("SELECT doc_id, coalesce(NOT regexp_matches(text,'[^\\s\\x{00a0}\\x0b]'), true) AS blank FROM documents")
def blank_texts(spark: SparkSession, d: str) -> DataFrame:
    """[X14]"""
    return _t(spark, d, "documents").select("doc_id", text.is_blank(F.col("text")).alias("blank"))


@query("SELECT file_id, 'land' AS bucket, ltrim(path,'/') AS key, 'file:'||file_id AS id FROM aforos_landing_files")
def object_paths(spark: SparkSession, d: str) -> DataFrame:
    """[X13, X16]"""
    p = text.bucket_and_key(F.concat(F.lit("s3://land/"), F.ltrim(F.col("path"), F.lit("/"))))
    return _t(spark, d, "aforos_landing_files").select("file_id", p["bucket"].alias("bucket"), p["key"].alias("key"), text.prefixed("file", F.col("file_id").cast("string")).alias("id"))


@query("SELECT o_custkey, count(*) AS samples_count, arg_min(CASE WHEN o_orderstatus<>'P' THEN o_orderpriority END, (o_orderdate, o_orderkey)) FILTER (o_orderstatus<>'P') AS first_priority FROM orders GROUP BY 1")
def earliest_attribute(spark: SparkSession, d: str) -> DataFrame:
    """[A4] the earliest value that is there."""
    c = F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority"))
    return rollup.rollup(_t(spark, d, "orders"), ["o_custkey"], {"first_priority": rollup.earliest(c, F.col("o_orderdate"), F.col("o_orderkey"))})


@query("SELECT l_orderkey, list(l_suppkey ORDER BY l_linenumber, l_suppkey) AS stops FROM lineitem GROUP BY 1")
def grouped_stops(spark: SparkSession, d: str) -> DataFrame:
    """[A19, O2, O3] lists per group, sorted by sequence."""
    g = windows.grouped_lists(_t(spark, d, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_suppkey"], ["l_suppkey"], "s")
    return g.select("l_orderkey", F.transform("s", lambda x: x["l_suppkey"]).alias("stops"))


_GRID = "CAST(floor({lat}/0.0014) AS BIGINT) AS cy, CAST(floor({lon}/0.0019) AS BIGINT) AS cx"
SQL["places_near_events"] = f"""WITH e AS (SELECT DISTINCT event_id, location.lat AS lat, location.lon AS lon FROM agenda_eventos WHERE location.lat BETWEEN 39 AND 42 AND location.lon BETWEEN -5 AND -2 AND event_id IS NOT NULL),
p AS (SELECT DISTINCT poi_id, location.lat AS lat, location.lon AS lon FROM poi_madrid WHERE location.lat BETWEEN 39 AND 42 AND location.lon BETWEEN -5 AND -2 AND poi_id IS NOT NULL),
pg AS (SELECT *, {_GRID.format(lat="lat", lon="lon")} FROM p), eg AS (SELECT e.event_id, e.lat, e.lon, e.cy+dy AS cy, e.cx+dx AS cx FROM (SELECT *, {_GRID.format(lat="lat", lon="lon")} FROM e) e, (SELECT unnest([-1,0,1]) AS dy), (SELECT unnest([-1,0,1]) AS dx)),
d AS (SELECT event_id, poi_id, min(2*6371000.0*asin(sqrt(least(1.0, pow(sin(radians(p.lat-e.lat)/2),2)+cos(radians(e.lat))*cos(radians(p.lat))*pow(sin(radians(p.lon-e.lon)/2),2))))) AS m FROM eg e JOIN pg p USING (cy, cx) GROUP BY ALL)
SELECT event_id, poi_id, round(m,3) AS distance_m FROM d WHERE m<=150"""

_PLACED = """n AS (SELECT id, kind, lat, lon FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY name IS NULL, name, lat IS NULL, lat, lon) AS rn FROM (
SELECT 'poi:'||poi_id AS id, 'Lugar' AS kind, name, lat, lon FROM (SELECT poi_id, name, {ok}) WHERE poi_id<>''
UNION ALL SELECT 'ruido:'||station_id, 'EstacionMedida', name, lat, lon FROM (SELECT station_id, station_name AS name, {ok2}) WHERE station_id<>''
UNION ALL SELECT 'aforos:'||station_id, 'EstacionMedida', name, lat, lon FROM (SELECT station_id, address AS name, {ok3}) WHERE station_id<>'')) WHERE rn=1)"""
_OKP = "CASE WHEN location.lat BETWEEN 39 AND 42 AND location.lon BETWEEN -5 AND -2 THEN location.lat END AS lat, CASE WHEN location.lat BETWEEN 39 AND 42 AND location.lon BETWEEN -5 AND -2 THEN location.lon END AS lon FROM "
_PLACED = _PLACED.format(ok=_OKP + "poi_madrid", ok2=_OKP + "ruido", ok3=_OKP + "aforos_peatones_bicicletas")
_CLOSE = """cg AS (SELECT *, CAST(floor(lat/0.0027) AS BIGINT) AS cy, CAST(floor(lon/0.0037) AS BIGINT) AS cx FROM n WHERE lat IS NOT NULL), ch AS (SELECT cg.id, cg.kind, cg.lat, cg.lon, cg.cy+dy AS cy, cg.cx+dx AS cx FROM cg, (SELECT unnest([-1,0,1]) AS dy), (SELECT unnest([-1,0,1]) AS dx)),
close AS (SELECT DISTINCT a.id AS src, b.id AS dst FROM cg a JOIN ch b USING (cy, cx) WHERE a.id<b.id AND a.kind<>b.kind AND 2*6371000.0*asin(sqrt(least(1.0, pow(sin(radians(b.lat-a.lat)/2),2)+cos(radians(a.lat))*cos(radians(b.lat))*pow(sin(radians(b.lon-a.lon)/2),2)))) <= 300)"""


def _edges_sql() -> str:
    from mobilake.plans.general import _EDGES

    inside = _EDGES.replace("SELECT poi_id, neighbourhood_id, poly FROM p JOIN e", "SELECT id AS poi_id, neighbourhood_id, poly FROM n AS p JOIN e").replace("GROUP BY poi_id, lat", "GROUP BY id, lat")
    return f"WITH {_PLACED}, {_CLOSE}, {inside} SELECT src, dst, 'PROXIMO_A' AS kind FROM close UNION ALL SELECT poi_id, min(neighbourhood_id), 'UBICADO_EN' FROM w GROUP BY 1"


SQL["graph_edges"] = _edges_sql()
SQL["path_hops"] = """WITH RECURSIVE s AS (SELECT DISTINCT l_orderkey, l_linenumber, l_suppkey FROM lineitem), p AS (SELECT l_suppkey AS a, lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey) AS b FROM s),
e AS (SELECT DISTINCT src, dst FROM (SELECT a AS src, b AS dst FROM p WHERE b IS NOT NULL UNION ALL SELECT b, a FROM p WHERE b IS NOT NULL)),
r(id, hops) AS (SELECT min(src), 0 FROM e UNION SELECT dst, hops+1 FROM r JOIN e ON r.id=e.src WHERE hops<12)
SELECT (SELECT min(src) FROM e) AS start, id, CAST(min(hops) AS INTEGER) AS hops FROM r GROUP BY id"""


@query(f"WITH {_PLACED} SELECT kind, count(*) AS nodes, count(lat) AS placed FROM n GROUP BY 1 UNION ALL SELECT 'Barrio', count(DISTINCT neighbourhood_id), 0 FROM barrios_madrid UNION ALL SELECT 'Distrito', count(DISTINCT district_id), 0 FROM barrios_madrid UNION ALL SELECT 'Recinto', count(DISTINCT venue_id), 0 FROM agenda_recintos")
def node_families(spark: SparkSession, d: str) -> DataFrame:
    """[G1] five node families, counted with their places."""
    b = _t(spark, d, "barrios_madrid")
    more = [graph.nodes(b, "Barrio", "barrios", F.col("neighbourhood_id"), F.col("name")), graph.nodes(b, "Distrito", "distritos", F.col("district_id"), F.col("district_name")), graph.nodes(_t(spark, d, "agenda_recintos"), "Recinto", "recintos", F.col("venue_id"), F.col("venue_name"))]
    n = graph.union_nodes(_nodes(spark, d), *more)
    return n.groupBy("kind").agg(F.count(F.lit(1)).alias("nodes"), F.count("lat").alias("placed"))


@query(f"WITH {_PLACED}, {_CLOSE} SELECT 'nodes/estaciones' AS part, count(*) AS n FROM n WHERE kind='EstacionMedida' UNION ALL SELECT 'nodes/lugares', count(*) FROM n WHERE kind='Lugar' UNION ALL SELECT 'edges/proximo_a', count(*) FROM close")
def graph_load(spark: SparkSession, d: str) -> DataFrame:
    """[G8] nodes before edges, edges only between nodes that are there."""
    from mobilake.session import work_path

    n = _nodes(spark, d)
    close = graph.close_to(n, 300.0)
    done = graph.load(spark, work_path(spark, "graph"), {"lugares": n.where("kind = 'Lugar'"), "estaciones": n.where("kind = 'EstacionMedida'")}, {"proximo_a": close})
    return spark.createDataFrame(sorted(done.items()), "part string, n bigint")


@query("SELECT count(*) AS broken FROM (SELECT l_suppkey FROM lineitem WHERE l_suppkey%7<>0) e WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey=e.l_suppkey AND s_suppkey%5<>0)")
def edge_integrity(spark: SparkSession, d: str) -> DataFrame:
    """[J10, G7] edges an end of which is no node."""
    e = _t(spark, d, "lineitem").where("l_suppkey % 7 <> 0").select(F.col("l_suppkey").alias("src"), F.col("l_suppkey").alias("dst"))
    n = _t(spark, d, "supplier").where("s_suppkey % 5 <> 0").select(F.col("s_suppkey").alias("id"))
    both = e.agg(F.count(F.lit(1)).alias("n")).unionByName(joins.with_both_ends(e, n).agg((-F.count(F.lit(1))).alias("n")))
    return both.agg(F.sum("n").alias("broken"))


_READ = "SELECT station_id, period, CAST(measured_date AS DATE) AS day, laeq_db AS v FROM ruido WHERE laeq_db IS NOT NULL AND regexp_full_match(measured_date,'\\d{4}-\\d{2}-\\d{2}') AND try_cast(measured_date AS DATE) IS NOT NULL"


@query(f"""WITH r AS ({_READ}), m AS (SELECT max(day) - INTERVAL 30 DAY AS t FROM r), l AS (SELECT station_id, period, max_by(v, (day, v)) AS v FROM r, m WHERE day<=t GROUP BY ALL), s AS (SELECT period AS pollutant, avg(v) AS value FROM l GROUP BY 1),
f AS (SELECT CASE WHEN row_id%2=0 THEN 'X' ELSE 'D' END AS pollutant, temperature_max_c AS v FROM aemet_prevision WHERE try_cast(valid_date AS DATE) = DATE '2025-05-01')
SELECT pollutant, round(value,6) AS value, 'measured' AS basis FROM s UNION ALL SELECT pollutant, round(avg(v),6), 'forecast' FROM f WHERE pollutant NOT IN (SELECT pollutant FROM s) GROUP BY 1""")
def air_or_forecast(spark: SparkSession, d: str) -> DataFrame:
    """[Q2] the latest measured value per kind at a moment, the forecast where nothing was measured; noise periods stand for pollutants."""
    r = _t(spark, d, "ruido").select("station_id", F.col("period").alias("pollutant"), times.iso_date(F.col("measured_date")).cast("timestamp").alias("at"), F.col("laeq_db").alias("value")).where(F.col("at").isNotNull() & F.col("value").isNotNull())
    top = r.agg((F.max("at") - F.expr("interval 30 days")).alias("__t"))
    f = _t(spark, d, "aemet_prevision").select(F.when(F.col("row_id") % 2 == 0, "X").otherwise("D").alias("pollutant"), times.iso_date(F.col("valid_date")).alias("day"), F.col("temperature_max_c").cast("double").alias("value"))
    moment = top.first()["__t"]
    seen = contracts.air_or_forecast(r, f.withColumn("day", F.when(F.col("day") == F.lit("2025-05-01").cast("date"), F.lit(moment).cast("date"))), F.lit(moment))
    return seen.select("pollutant", _r(F.col("value"), 6).alias("value"), "basis")


@query("""WITH g AS (SELECT user_id, strftime(ts,'%Y-%m-%d') AS date, CAST(hour(ts) AS INTEGER) AS hour, avg(value) AS f, count(*) AS t FROM events GROUP BY ALL), l AS (SELECT user_id, arg_max(f, (date,hour)) AS f, arg_max(t, (date,hour)) AS t FROM g GROUP BY 1)
SELECT user_id%5 AS zone, round(sum(f),6) AS free_spaces, CAST(sum(t) AS BIGINT) AS total_spaces FROM l GROUP BY 1""")
def free_parking(spark: SparkSession, d: str) -> DataFrame:
    """[Q4] free and total spaces per zone over each car park's latest hour; users stand for car parks."""
    e = _t(spark, d, "events").withColumns({"date": times.date_key(F.col("ts")), "hour": F.hour("ts")})
    g = e.groupBy(F.col("user_id").alias("parking_id"), "date", "hour").agg(F.avg("value").alias("avg_free_spaces"), F.count(F.lit(1)).alias("total_spaces"))
    z = e.select(F.col("user_id").alias("parking_id"), (F.col("user_id") % 5).alias("zone")).distinct()
    return contracts.free_parking(g, z).select("zone", _r(F.col("free_spaces"), 6).alias("free_spaces"), "total_spaces")


@query("SELECT row_id, CASE WHEN row_number() OVER (PARTITION BY row_id//3 ORDER BY row_id)>1 THEN 'duplicate_exact_content' END AS reason FROM ruido WHERE row_id%3<>2")
def dedupe_gate(spark: SparkSession, d: str) -> DataFrame:
    """[T7, W5] rows doubled under the key of their thirds: the first stays, the second is rejected with its reason."""
    r = _t(spark, d, "ruido").select("row_id", F.floor(F.col("row_id") / 3).alias("k")).where("row_id % 3 <> 2")
    good, bad = gate.split(r, [], unique="k", order=["row_id"])
    return good.select("row_id", F.lit(None).cast("string").alias("reason")).unionByName(bad.select("row_id", F.get("reasons", F.lit(0)).alias("reason")))
