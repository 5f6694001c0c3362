"""SQL twins of the core problems' queries."""

from mobilake.plans.general import _EDGES, _NEAR

_READ = r"SELECT station_id, CAST(measured_date AS DATE) AS day, laeq_db AS v FROM ruido WHERE laeq_db IS NOT NULL AND regexp_full_match(measured_date,'\d{4}-\d{2}-\d{2}') AND try_cast(measured_date AS DATE) IS NOT NULL"
_DAYS = f"""WITH r AS ({_READ}), g AS (SELECT station_id, day, count(*) AS n, sum(CAST(v AS DECIMAL(20,6))) AS s FROM r GROUP BY ALL),
b AS (SELECT station_id, min(day) AS lo, max(day) AS hi FROM g GROUP BY 1),
c AS (SELECT station_id, CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM b),
f AS (SELECT c.station_id, c.day, coalesce(n,0) AS n, coalesce(s,0) AS s FROM c LEFT JOIN g ON c.station_id=g.station_id AND c.day=g.day)"""


def _win(p: int) -> str:
    return f"(PARTITION BY station_id ORDER BY day RANGE BETWEEN INTERVAL {p - 1} DAY PRECEDING AND CURRENT ROW)"


SQL = {
    "p1_found": _DAYS + ", w AS (SELECT station_id, day, " + ", ".join(f"sum(n) OVER {_win(p)} AS n{p}" for p in (1, 7, 30)) + " FROM f) " + " UNION ALL ".join(f"SELECT station_id, strftime(day,'%Y-%m-%d') AS day, CAST({p} AS BIGINT) AS period_days FROM w WHERE n{p}=0" for p in (1, 7, 30)),
    "p1_rolling": _DAYS + ", w AS (SELECT station_id, day, " + ", ".join(f"CAST(sum(n) OVER {_win(p)} AS BIGINT) AS n_{p}, CAST(sum(s) OVER {_win(p)} AS DOUBLE) AS total_{p}" for p in (7, 30)) + ") SELECT station_id, strftime(day,'%Y-%m-%d') AS day, " + ", ".join(f"n_{p}, total_{p}, CASE WHEN n_{p}>0 THEN total_{p}/n_{p} END AS avg_{p}" for p in (7, 30)) + " FROM w",
    "p3_found": r"""SELECT row_id FROM (SELECT row_id, row_number() OVER (PARTITION BY schema_version, source, station_id, device_id, mode, measured_at, pedestrian_count, bicycle_count, district_code, district, address, address_notes, location
ORDER BY try_cast(ingested_at AS TIMESTAMPTZ) NULLS LAST, row_id) AS n FROM aforos_peatones_bicicletas WHERE regexp_matches(measured_at,'\S')) WHERE n>1""",
    "p3_manifest": r"""SELECT (SELECT count(*) FROM aforos_peatones_bicicletas) - (SELECT count(*) FROM (SELECT row_number() OVER (PARTITION BY schema_version, source, station_id, device_id, mode, measured_at, pedestrian_count, bicycle_count, district_code, district, address, address_notes, location ORDER BY row_id) AS n FROM aforos_peatones_bicicletas WHERE regexp_matches(measured_at,'\S')) WHERE n>1) AS n_rows""",
    "p4_found": _NEAR + ", " + _EDGES + " SELECT 'near' AS kind, left_id, right_id FROM near UNION ALL SELECT 'within', poi_id, neighbourhood_id FROM w",
}
SQL["p4_places"] = _NEAR + """, e AS (SELECT left_id AS id FROM near UNION ALL SELECT right_id FROM near), k AS (SELECT id, count(*) AS n FROM e GROUP BY 1)
SELECT poi_id, min(poi_id) OVER (PARTITION BY lat, lon) AS place, coalesce(n, 0) AS links FROM p LEFT JOIN k ON poi_id=id"""
_ZONED = r"^(\d{10}|\d{13}|\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d{1,6})?(Z|[+-]\d{2}:\d{2}))$"
_INSTANT = "CASE WHEN length(t)=10 THEN make_timestamp(CAST(t AS BIGINT)*1000000) WHEN length(t)=13 THEN make_timestamp(CAST(t AS BIGINT)*1000) ELSE timezone('UTC', try_cast(t AS TIMESTAMPTZ)) END"
_TEXTS = " UNION ALL ".join(f"SELECT '{a}' AS table_name, row_id, {b} AS t FROM {a}" for a, b in (("agenda_eventos", "start_datetime"), ("aforos_peatones_bicicletas", "measured_at"), ("aemet_prevision", "elaborated_at")))
SQL["p7_zoned"] = f"SELECT table_name, row_id, strftime(i,'%Y-%m-%dT%H:%M:%S.%f') AS instant_utc FROM (SELECT table_name, row_id, {_INSTANT} AS i FROM ({_TEXTS}) WHERE regexp_matches(t,'{_ZONED}')) WHERE i IS NOT NULL"
SQL["p1_rolling"] = SQL["p1_rolling"].replace(") SELECT station_id, strftime", " FROM f) SELECT station_id, strftime")
