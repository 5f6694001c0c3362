"""The marts whose feeds have no table here, over bronze rows made of the given tables.

BRONZE holds for each mart one SELECT that both engines run; the golden rows
then come from the mart in Spark and from plain SQL in the twin.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mobilake.datasets import specs
from mobilake.plans.general import QUERIES, SQL
from mobilake.plans.marts import _OK

_A, _R, _W = "aforos_peatones_bicicletas", "ruido", "aemet_prevision"
BRONZE = {
    "trafico": f"SELECT row_id, device_id AS point_id, district AS subarea, ingested_at AS measured_at, ingested_at, location, pedestrian_count AS intensity_vph, CAST(row_id%120 AS INT) AS occupancy_pct, CAST(row_id%110 AS INT) AS load_pct, CAST(row_id%12 AS INT) AS service_level, CAST(1000 AS INT) AS saturation_intensity_vph, row_id%50=0 AS has_error FROM {_A}",
    "transporte_publico_emt": f"SELECT row_id, CASE WHEN row_id%41=0 THEN '{{\"code\": 80}}' ELSE '{{}}' END AS _raw, station_id AS stop_id, district_code AS line, ingested_at, pedestrian_count*10 AS estimate_arrive_sec, CAST(row_id%500-5 AS INT) AS distance_bus_m FROM {_A}",
    "bicimad": f"SELECT row_id, device_id AS station_id, address AS name, location, ingested_at AS measured_at, ingested_at, row_id%20 AS bikes_available, row_id%3 AS bikes_disabled, 25-row_id%25 AS docks_available, row_id%2 AS docks_disabled, CASE WHEN row_id%40=0 THEN 0 ELSE 22 END AS docks_total, row_id%37<>0 AS is_installed FROM {_A}",
    "aparcamientos": f"SELECT row_id, station_id AS parking_id, address AS name, location, CASE WHEN row_id%11=0 THEN NULL ELSE ingested_at END AS measured_at, ingested_at, CASE WHEN row_id%9=0 THEN NULL ELSE row_id%260 END AS free_spaces, CAST(200 AS BIGINT) AS total_spaces FROM {_A}",
    "calidad_aire": f"SELECT row_id, station_id, station_id AS station_name, location, CASE row_id%3 WHEN 0 THEN 'NO2' WHEN 1 THEN 'CO' END AS magnitude_abbr, 'name' AS magnitude_name, '08' AS magnitude_code, 'u' AS unit, CAST(pedestrian_count AS DOUBLE) AS value, ingested_at AS measured_at, ingested_at FROM {_A}",
    "meteorologia": f"SELECT row_id, station_id, station_name, station_address, location, ingested_at AS measured_at, ingested_at, laeq_db-40 AS temperature_c, l10_db AS humidity_pct, l90_db AS wind_speed_ms, l1_db*4 AS wind_direction_deg, 800+laeq_db*4 AS pressure_mb, l50_db*20 AS solar_radiation_wm2, l99_db*50 AS uv_radiation_mwm2, l10_db*4 AS precipitation_lm2 FROM {_R}",
    "cartelera_cines_estrenos": f"SELECT row_id, CASE WHEN row_id%13=0 THEN 'estreno_semana' END AS record_type, address AS movie_title, device_id AS movie_url, station_id AS cinema_id, 'chain' AS chain, district AS cinema_name, address, district_code AS postal_code, district AS locality, mode AS language_version, CAST(row_id%50 AS VARCHAR(9)) AS showtime_id, ingested_at AS showtime_datetime, ingested_at AS captured_at FROM {_A}",
    "bluesky_menciones": f"SELECT row_id, CASE mode WHEN 'peatones' THEN 'bajo_demanda' ELSE 'distrito_sweep' END AS mode, district AS match_term, address AS text, CAST(row_id%9000 AS VARCHAR(9)) AS post_hash, district_code AS lang, ingested_at AS created_at, ingested_at AS captured_at, row_id%7 AS like_count, row_id%5 AS repost_count, CASE WHEN row_id%3=0 THEN NULL ELSE row_id%3 END AS reply_count, row_id%2 AS quote_count FROM {_A}",
    "aemet_avisos": f"SELECT row_id, CAST(row_id%700 AS VARCHAR(9)) AS identifier, municipio_code AS zone, CASE row_id%4 WHEN 0 THEN 'amarillo' WHEN 1 THEN 'naranja' WHEN 2 THEN 'rojo' ELSE 'verde' END AS level, sky_state AS phenomenon, captured_at AS effective_from, captured_at AS effective_until, captured_at FROM {_W}",
    "cams_calidad_aire": f"SELECT row_id, CASE row_id%4 WHEN 0 THEN 'NO2' WHEN 1 THEN 'O3' WHEN 2 THEN 'polvo' END AS pollutant, 'c' AS pollutant_code, 'u' AS unit, captured_at AS valid_datetime, captured_at AS forecast_issued_at, CAST(row_id%96-1 AS INT) AS leadtime_hour, CAST(temperature_max_c*20 AS DOUBLE) AS value, captured_at AS ingested_at FROM {_W}",
}
_LOCAL = "timezone('Europe/Madrid', CAST({c} AS TIMESTAMPTZ))"
_HOUR = "strftime(t,'%Y-%m-%d') AS date, CAST(hour(t) AS INTEGER) AS hour, count(*) AS samples_count"


def _twin(name: str, where: str, time: str, select: str, silver: str = "*", group: str = "GROUP BY ALL") -> str:
    return f"WITH b AS ({BRONZE[name]}), k AS (SELECT * FROM b WHERE {_OK.format(c=time)}), s AS (SELECT {silver}, {_LOCAL.format(c=time)} AS t FROM k WHERE {where}) SELECT {select} FROM s {group}"


_OKR = "({c} IS NULL OR {c} BETWEEN {a} AND {b})"
_BOX = "coalesce(location.lat BETWEEN 39.8 AND 41.2 AND location.lon BETWEEN -4.6 AND -3.0, false)"
_in = lambda c, a, b: _OKR.format(c=c, a=a, b=b)
# name of the query -> (mart, columns of the result with the digits they are rounded to, SQL twin)
GOLD = {
    "gold_trafico": ("trafico", {"point_id": None, "date": None, "hour": None, "samples_count": None, "avg_intensity_vph": 6, "avg_occupancy_ratio": 6, "avg_load_ratio": 6, "avg_intensity_ratio": 6, "max_intensity_vph": None, "min_intensity_vph": None},
        _twin("trafico", f"point_id<>'' AND {_BOX} AND {_in('intensity_vph', 0, 20000)} AND {_in('occupancy_pct', 0, 100)} AND {_in('load_pct', 0, 100)} AND {_in('service_level', 0, 10)} AND NOT has_error", "measured_at",
            f"point_id, {_HOUR}, round(avg(intensity_vph),6) AS avg_intensity_vph, round(avg(o),6) AS avg_occupancy_ratio, round(avg(l),6) AS avg_load_ratio, round(avg(i),6) AS avg_intensity_ratio, max(intensity_vph) AS max_intensity_vph, min(intensity_vph) AS min_intensity_vph", "*, occupancy_pct/100 AS o, load_pct/100 AS l, round_even(intensity_vph/1000, 4) AS i")),
    "gold_emt": ("transporte_publico_emt", {"stop_id": None, "line": None, "date": None, "hour": None, "samples_count": None, "avg_estimate_arrive_sec": 6, "max_estimate_arrive_sec": None, "min_estimate_arrive_sec": None},
        _twin("transporte_publico_emt", f"row_id%41<>0 AND stop_id<>'' AND line<>'' AND {_in('estimate_arrive_sec', 0, 7200)} AND distance_bus_m>=0", "ingested_at",
            f"stop_id, line, {_HOUR}, round(avg(estimate_arrive_sec),6) AS avg_estimate_arrive_sec, max(estimate_arrive_sec) AS max_estimate_arrive_sec, min(estimate_arrive_sec) AS min_estimate_arrive_sec")),
    "gold_bicimad": ("bicimad", {"station_id": None, "date": None, "hour": None, "samples_count": None, "avg_bikes_available": 6, "avg_bikes_disabled": 6, "avg_docks_available": 6, "avg_docks_disabled": 6, "avg_occupancy_ratio": 3},
        _twin("bicimad", "station_id<>'' AND is_installed AND bikes_available+bikes_disabled<=docks_total AND docks_available+docks_disabled<=docks_total", "measured_at",
            f"station_id, {_HOUR}, round(avg(bikes_available),6) AS avg_bikes_available, round(avg(bikes_disabled),6) AS avg_bikes_disabled, round(avg(docks_available),6) AS avg_docks_available, round(avg(docks_disabled),6) AS avg_docks_disabled, round(avg(o),3) AS avg_occupancy_ratio", "*, round_even(bikes_available/nullif(docks_total,0),4) AS o")),
    "gold_aparcamientos": ("aparcamientos", {"parking_id": None, "date": None, "hour": None, "samples_count": None, "avg_free_spaces": 6, "avg_occupancy_ratio": 6},
        _twin("aparcamientos", "parking_id<>'' AND free_spaces<=total_spaces", "measured_at", f"parking_id, {_HOUR}, round(avg(free_spaces),6) AS avg_free_spaces, round(avg((total_spaces-free_spaces)/total_spaces),6) AS avg_occupancy_ratio")),
    "gold_calidad_aire": ("calidad_aire", {"station_id": None, "pollutant": None, "date": None, "hour": None, "samples_count": None, "avg_value": 6, "max_value": None, "min_value": None},
        _twin("calidad_aire", "station_id<>'' AND magnitude_abbr IS NOT NULL AND value>=0 AND value<=CASE magnitude_abbr WHEN 'NO2' THEN 500 ELSE 50 END", "measured_at", f"station_id, magnitude_abbr AS pollutant, {_HOUR}, round(avg(value),6) AS avg_value, max(value) AS max_value, min(value) AS min_value")),
    "gold_meteorologia": ("meteorologia", {"station_id": None, "magnitude": None, "date": None, "hour": None, "samples_count": None, "avg_value": 6, "max_value": 6, "min_value": 6},
        f"WITH b AS ({BRONZE['meteorologia']}), k AS (SELECT * FROM b WHERE station_id<>'' AND {_OK.format(c='measured_at')}), u AS (SELECT station_id, measured_at, magnitude, value FROM (UNPIVOT k ON temperature_c, humidity_pct, wind_speed_ms, wind_direction_deg, pressure_mb, solar_radiation_wm2, uv_radiation_mwm2, precipitation_lm2 INTO NAME magnitude VALUE value)), "
        "r AS (SELECT * FROM (VALUES ('temperature_c',-20,50),('humidity_pct',0,100),('wind_speed_ms',0,100),('wind_direction_deg',0,360),('pressure_mb',850,1050),('solar_radiation_wm2',0,1500),('uv_radiation_mwm2',0,5000),('precipitation_lm2',0,300)) AS r(magnitude, lo, hi)), "
        f"s AS (SELECT u.*, {_LOCAL.format(c='measured_at')} AS t FROM u JOIN r USING (magnitude) WHERE value BETWEEN lo AND hi) SELECT station_id, magnitude, {_HOUR}, round(avg(value),6) AS avg_value, round(max(value),6) AS max_value, round(min(value),6) AS min_value FROM s GROUP BY ALL"),
    "gold_cartelera": ("cartelera_cines_estrenos", {"movie_url": None, "cinema_id": None, "date": None, "samples_count": None, "sessions_count": None},
        _twin("cartelera_cines_estrenos", "record_type IS NULL AND movie_title<>'' AND cinema_id<>'' AND movie_url<>''", "showtime_datetime", "movie_url, cinema_id, strftime(t,'%Y-%m-%d') AS date, count(*) AS samples_count, count(DISTINCT showtime_id) AS sessions_count")),
    "gold_bluesky": ("bluesky_menciones", {"mode": None, "match_term": None, "date": None, "hour": None, "samples_count": None, "mentions_count": None, "total_like_count": None, "total_reply_count": None},
        f"WITH b AS ({BRONZE['bluesky_menciones']}), k AS (SELECT *, row_number() OVER (PARTITION BY post_hash ORDER BY row_id) AS rn FROM b WHERE regexp_matches(match_term,'\\S') AND regexp_matches(text,'\\S') AND {_OK.format(c='created_at')}), s AS (SELECT *, {_LOCAL.format(c='created_at')} AS t FROM k WHERE rn=1) "
        f"SELECT mode, match_term, {_HOUR}, count(DISTINCT post_hash) AS mentions_count, CAST(sum(like_count) AS BIGINT) AS total_like_count, CAST(coalesce(sum(reply_count),0) AS BIGINT) AS total_reply_count FROM s GROUP BY ALL"),
    "gold_avisos": ("aemet_avisos", {"zone": None, "fecha": None, "level": None, "samples_count": None, "alerts_count": None},
        _twin("aemet_avisos", "zone<>'' AND level<>'verde' AND phenomenon<>''", "captured_at", "zone, substr(effective_from,1,10) AS fecha, level, count(*) AS samples_count, count(DISTINCT identifier) AS alerts_count")),
    "gold_cams": ("cams_calidad_aire", {"pollutant": None, "fecha_validez": None, "samples_count": None, "avg_value": 6, "max_value": None},
        _twin("cams_calidad_aire", "pollutant IS NOT NULL AND leadtime_hour>=0 AND value>=0 AND value<=CASE pollutant WHEN 'polvo' THEN 1000 ELSE 500 END", "valid_datetime", "pollutant, strftime(t,'%Y-%m-%d') AS fecha_validez, count(*) AS samples_count, round(avg(value),6) AS avg_value, max(value) AS max_value")),
}


def bronze(spark: SparkSession, d: str, name: str) -> DataFrame:
    """Bronze rows of a mart; the tables are named by views that only this statement uses."""
    statement = BRONZE[name]
    for t in (_A, _R, _W):
        if f"FROM {t}" in statement:
            spark.read.parquet(f"{d}/{t}.parquet").createOrReplaceTempView(f"bronze_of_{t}")
            statement = statement.replace(f"FROM {t}", f"FROM bronze_of_{t}")
    return spark.sql(statement)


def _gold(query: str):  # noqa: ANN202
    mart, columns, _ = GOLD[query]

    def run(spark: SparkSession, d: str) -> DataFrame:
        m = specs.MARTS[mart]
        rows, _bad = specs.silver(m, bronze(spark, d, mart), ["row_id"])
        return m.gold(rows).select(*[F.col(c) if n is None else F.round(c, n).alias(c) for c, n in columns.items()])

    run.__doc__ = f"Gold rows of {mart}."
    return run


for _q, (_, _, _sql) in GOLD.items():
    QUERIES[_q] = _gold(_q)
    SQL[_q] = _sql
