"""General operators as queries, each with its SQL twin for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mobilake.functions import arrays, geo, numbers, text, times
from mobilake.operators import gate, graph, joins, quality, rollup, spatial, windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _r(c, n: int = 9):  # noqa: ANN001, ANN202
    return F.round(c, n)


@query("""SELECT user_id, strftime(ts,'%Y-%m-%d') AS date, CAST(hour(ts) AS INTEGER) AS hour, count(*) AS samples_count,
round(avg(value),9) AS avg_value, max(value) AS max_value, min(value) AS min_value, arg_min(event_id, ts) AS first_event, arg_max(event_id, ts) AS last_event
FROM events GROUP BY ALL""")
def hourly_rollup(spark: SparkSession, d: str) -> DataFrame:
    """[A1, A2, A3, A5, A13]"""
    e = _t(spark, d, "events").withColumns({"date": times.date_key(F.col("ts")), "hour": F.hour("ts")})
    m = {"avg_value": _r(F.avg("value")), "max_value": F.max("value"), "min_value": F.min("value"), "first_event": rollup.first_by(F.col("event_id"), F.col("ts")), "last_event": rollup.last_by(F.col("event_id"), F.col("ts"))}
    return rollup.rollup(e, ["user_id", "date", "hour"], m)


@query("""SELECT user_id, event_type, strftime(ts,'%Y-%m-%d') AS date, CAST(hour(ts) AS INTEGER) AS hour, count(*) AS samples_count, round(avg(value),9) AS avg_value
FROM events WHERE event_type IS NOT NULL AND event_type<>'' GROUP BY ALL""")
def hourly_rollup_two_keys(spark: SparkSession, d: str) -> DataFrame:
    """[A1, A2, F19]"""
    e = _t(spark, d, "events").withColumns({"date": times.date_key(F.col("ts")), "hour": F.hour("ts")})
    return rollup.rollup(e, ["user_id", "event_type", "date", "hour"], {"avg_value": _r(F.avg("value"))}, ["event_type"])


@query("""SELECT strftime(l_shipdate,'%Y-%m-%d') AS date, count(*) AS samples_count, round(sum(l_quantity),4) AS sum_qty, round(avg(l_discount),9) AS avg_discount FROM lineitem GROUP BY 1""")
def daily_sum_avg(spark: SparkSession, d: str) -> DataFrame:
    """[A6]"""
    li = _t(spark, d, "lineitem").withColumn("date", times.date_key(F.col("l_shipdate")))
    return rollup.rollup(li, ["date"], {"sum_qty": _r(F.sum("l_quantity"), 4), "avg_discount": _r(F.avg("l_discount"))})


@query("""SELECT user_id, count(*) AS samples_count, round(coalesce(sum(CASE WHEN event_type='purchase' THEN value END),0),4) AS total_purchase FROM events GROUP BY 1""")
def coalesced_sums(spark: SparkSession, d: str) -> DataFrame:
    """[A7]"""
    return rollup.rollup(_t(spark, d, "events"), ["user_id"], {"total_purchase": _r(rollup.total(F.when(F.col("event_type") == "purchase", F.col("value"))), 4)})


@query("""SELECT strftime(ts,'%Y-%m-%d') AS date, count(*) AS samples_count, count(DISTINCT user_id) AS users, array_to_string(list_sort(list(DISTINCT event_type) FILTER (event_type<>'')),',') AS types FROM events GROUP BY 1""")
def distinct_sessions(spark: SparkSession, d: str) -> DataFrame:
    """[A8, A10]"""
    e = _t(spark, d, "events").withColumn("date", times.date_key(F.col("ts")))
    return rollup.rollup(e, ["date"], {"users": rollup.distinct_count(F.col("user_id")), "types": F.array_join(rollup.distinct_list(F.col("event_type")), ",")})


@query("""SELECT event_type, count(*) AS samples_count, count(DISTINCT CASE WHEN value>100 THEN user_id END) AS big_users FROM events GROUP BY 1""")
def conditional_distinct(spark: SparkSession, d: str) -> DataFrame:
    """[A9]"""
    return rollup.rollup(_t(spark, d, "events"), ["event_type"], {"big_users": rollup.distinct_count(F.col("user_id"), F.col("value") > 100)})


@query("""SELECT coalesce(nullif(category,''),'__sin_categoria__') AS category, coalesce(nullif(location.district,''),'__sin_distrito__') AS district, count(*) AS samples_count, count(DISTINCT event_id) AS events_count, count(DISTINCT CASE WHEN free THEN event_id END) AS free_events_count FROM agenda_eventos GROUP BY ALL""")
def sentinel_groups(spark: SparkSession, d: str) -> DataFrame:
    """[A11, P3]"""
    keys = [rollup.sentinel(F.col("category"), "__sin_categoria__").alias("category"), rollup.sentinel(F.col("location.district"), "__sin_distrito__").alias("district")]
    return rollup.rollup(_t(spark, d, "agenda_eventos"), keys, {"events_count": rollup.distinct_count(F.col("event_id")), "free_events_count": rollup.distinct_count(F.col("event_id"), F.col("free"))})


@query("""SELECT CAST(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS INTEGER) AS leadtime_days, count(*) AS samples_count, round(avg(l_quantity),9) AS avg_qty FROM lineitem JOIN orders ON l_orderkey=o_orderkey GROUP BY 1""")
def leadtime_rollup(spark: SparkSession, d: str) -> DataFrame:
    """[A12, D14]"""
    j = _t(spark, d, "lineitem").join(_t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rollup.rollup(j.withColumn("leadtime_days", times.lead_days(F.col("l_shipdate").cast("date"), F.col("o_orderdate").cast("date"))), ["leadtime_days"], {"avg_qty": _r(F.avg("l_quantity"))})


@query("""WITH g AS (SELECT user_id, CAST(ts AS DATE) AS day, avg(value) AS a FROM events GROUP BY ALL)
SELECT user_id, strftime(day,'%Y-%m-%d') AS date, round(avg(a) OVER w,6) AS avg_7d, count(a) OVER w AS days_7d FROM g WINDOW w AS (PARTITION BY user_id ORDER BY day RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW)""")
def rolling_7d(spark: SparkSession, d: str) -> DataFrame:
    """[A15, W1, W2]"""
    g = _t(spark, d, "events").groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(F.avg("value").alias("a"))
    out = rollup.calendar_rolling(g, ["user_id"], F.col("day"), "a", 7, "avg_7d", "days_7d")
    return out.select("user_id", times.date_key(F.col("day")).alias("date"), _r(F.col("avg_7d"), 6).alias("avg_7d"), "days_7d")


@query("""SELECT ['lunes','martes','miercoles','jueves','viernes','sabado','domingo'][isodow(ts)] AS weekday, CAST(hour(ts) AS INTEGER) AS hour, count(*) AS samples_count, round(avg(value),9) AS avg_value FROM events GROUP BY ALL""")
def weekday_profile(spark: SparkSession, d: str) -> DataFrame:
    """[D13]"""
    e = _t(spark, d, "events").withColumns({"weekday": times.weekday_name(F.col("ts")), "hour": F.hour("ts")})
    return rollup.rollup(e, ["weekday", "hour"], {"avg_value": _r(F.avg("value"))})


@query("""SELECT user_id, max_by(value, (ts, event_id)) AS value FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 14 DAY GROUP BY 1""")
def latest_per_key(spark: SparkSession, d: str) -> DataFrame:
    """[A16, F13]"""
    e = _t(spark, d, "events")
    top = e.agg((F.max("ts") - F.expr("interval 14 days")).alias("since"))
    return e.join(F.broadcast(top), F.col("ts") >= F.col("since")).groupBy("user_id").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def distinct_keys(spark: SparkSession, d: str) -> DataFrame:
    """[A17]"""
    return _t(spark, d, "lineitem").select("l_returnflag", "l_linestatus").distinct()


@query("""SELECT substr(sha256(text),1,16) AS id, min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY 1""")
def dedupe_first(spark: SparkSession, d: str) -> DataFrame:
    """[W5, X12]"""
    docs = _t(spark, d, "documents").where("text is not null").select(text.content_id(F.col("text")).alias("id"), "doc_id")
    return windows.keep_first(docs, ["id"], [F.col("doc_id")])


@query("""SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) rn FROM events) WHERE rn<=2""")
def first_k_per_group(spark: SparkSession, d: str) -> DataFrame:
    """[W4]"""
    return windows.first_k(_t(spark, d, "events"), ["user_id"], [F.col("ts"), F.col("event_id")], 2).select("user_id", "event_id", "ts")


@query("""SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderstatus<>'O'), o_orderkey) rn FROM orders) WHERE rn=1""")
def representative_row(spark: SparkSession, d: str) -> DataFrame:
    """[W6]"""
    return windows.representative(_t(spark, d, "orders"), ["o_custkey"], "o_orderkey", F.col("o_orderstatus") == "O", F.col("o_orderkey"))


@query("""WITH p AS (SELECT user_id, event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events)
SELECT user_id, a, b, count(*) AS n FROM (SELECT user_id,a,b FROM p WHERE b IS NOT NULL UNION ALL SELECT user_id,b,a FROM p WHERE b IS NOT NULL) GROUP BY ALL""")
def consecutive_pairs(spark: SparkSession, d: str) -> DataFrame:
    """[W3, U1]"""
    return windows.consecutive_pairs(_t(spark, d, "events"), ["user_id"], [F.col("ts"), F.col("event_id")], "event_type").groupBy("user_id", "a", "b").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT row_id, magnitude, value FROM (UNPIVOT (SELECT row_id, laeq_db, l1_db, l10_db, l50_db, l90_db, l99_db FROM ruido) ON laeq_db, l1_db, l10_db, l50_db, l90_db, l99_db INTO NAME magnitude VALUE value) WHERE value BETWEEN 20 AND 120""")
def melt_measures(spark: SparkSession, d: str) -> DataFrame:
    """[P7, F5]"""
    names = ["laeq_db", "l1_db", "l10_db", "l50_db", "l90_db", "l99_db"]
    long = windows.melt(_t(spark, d, "ruido"), ["row_id"], names, "magnitude", "value")
    return long.where(numbers.range_by(F.col("magnitude"), F.col("value"), {n: (20, 120) for n in names}))


@query("""SELECT user_id, max(ts) AS freshest, arg_max(value, (ts,event_id)) FILTER (event_type='click') AS click, arg_max(value,(ts,event_id)) FILTER (event_type='view') AS view FROM events GROUP BY 1""")
def pivot_measures(spark: SparkSession, d: str) -> DataFrame:
    """[P8]"""
    e = _t(spark, d, "events")
    out = windows.freshest_pivot(e, ["user_id"], "event_type", ["click", "view"], "value", F.struct("ts", "event_id"))
    return out.select("user_id", F.col("freshest.ts").alias("freshest"), "click", "view")


_RUIDO_GATE = """SELECT row_id, concat_ws(',', CASE WHEN station_id IS NULL OR station_id='' THEN 'station_id_missing' END, CASE WHEN period IS NULL OR period='' THEN 'period_missing' END,
CASE WHEN NOT coalesce(regexp_full_match(measured_date,'\\d{4}-\\d{2}-\\d{2}') AND try_cast(measured_date AS DATE) IS NOT NULL, false) THEN 'measured_date_missing_or_unparseable' END,
CASE WHEN laeq_db IS NULL THEN 'laeq_missing' END, CASE WHEN laeq_db NOT BETWEEN 20 AND 120 THEN 'laeq_db_out_of_plausible_range' END) AS reasons FROM ruido"""


def _ruido_rules() -> list[gate.Rule]:
    return [gate.missing("station_id"), gate.missing("period"), gate.date("measured_date"), gate.null("laeq", "laeq_db"), gate.between("laeq_db", 20, 120, suffix="out_of_plausible_range")]


@query(f"SELECT * FROM ({_RUIDO_GATE}) WHERE reasons<>''")
def quality_gate(spark: SparkSession, d: str) -> DataFrame:
    """[F1, F3]"""
    _, bad = gate.split(_t(spark, d, "ruido"), _ruido_rules())
    return bad.select("row_id", F.array_join("reasons", ",").alias("reasons"))


@query(f"SELECT reason, count(*) AS rows FROM (SELECT unnest(string_split(reasons,',')) AS reason FROM ({_RUIDO_GATE}) WHERE reasons<>'') GROUP BY 1")
def quality_gate_reason_counts(spark: SparkSession, d: str) -> DataFrame:
    """[F1]"""
    return gate.reason_counts(gate.split(_t(spark, d, "ruido"), _ruido_rules())[1])


@query("""SELECT 'not_null' AS expectation, 'station_id' AS "column", count(*) AS element_count, count(*) FILTER (station_id IS NULL) AS unexpected_count, count(*) FILTER (station_id IS NULL)=0 AS success FROM ruido
UNION ALL SELECT 'between','laeq_db',count(*),count(*) FILTER (laeq_db NOT BETWEEN 20 AND 120),count(*) FILTER (laeq_db NOT BETWEEN 20 AND 120)=0 FROM ruido
UNION ALL SELECT 'in_set','period',count(*),count(*) FILTER (period NOT IN ('D','E','N','T')),count(*) FILTER (period NOT IN ('D','E','N','T'))=0 FROM ruido
UNION ALL SELECT 'regex','station_id',count(*),count(*) FILTER (NOT regexp_matches(station_id,'^RF-')),count(*) FILTER (NOT regexp_matches(station_id,'^RF-'))=0 FROM ruido
UNION ALL SELECT 'pair_at_least','l1_db>=l99_db',count(*),count(*) FILTER (l1_db<l99_db),count(*) FILTER (l1_db<l99_db)=0 FROM ruido
UNION ALL SELECT 'unique','row_id',CAST(sum(k) AS BIGINT),CAST(coalesce(sum(k) FILTER (k>1),0) AS BIGINT),coalesce(sum(k) FILTER (k>1),0)=0 FROM (SELECT count(*) k FROM ruido WHERE row_id IS NOT NULL GROUP BY row_id)""")
def quality_report(spark: SparkSession, d: str) -> DataFrame:
    """[survey 2.9]"""
    q = quality
    return q.report(_t(spark, d, "ruido"), [q.not_null("station_id"), q.between("laeq_db", 20, 120), q.in_set("period", ["D", "E", "N", "T"]), q.matches("station_id", "^RF-"), q.pair_at_least(F.col("l1_db"), F.col("l99_db"), "l1_db>=l99_db"), q.unique("row_id")])


@query("""SELECT event_id, value - CASE event_type WHEN 'purchase' THEN 200.0 WHEN 'click' THEN 50.0 END AS excess FROM events WHERE value > CASE event_type WHEN 'purchase' THEN 200.0 WHEN 'click' THEN 50.0 END""")
def plausible_max(spark: SparkSession, d: str) -> DataFrame:
    """[F5, M14]"""
    x = numbers.excess(F.col("event_type"), F.col("value"), {"purchase": 200, "click": 50})
    return _t(spark, d, "events").select("event_id", x.alias("excess")).where("excess > 0")


@query("SELECT row_id FROM poi_madrid WHERE location.lat BETWEEN 39.8 AND 41.2 AND location.lon BETWEEN -4.6 AND -3.0")
def bbox_filter(spark: SparkSession, d: str) -> DataFrame:
    """[F2]"""
    return _t(spark, d, "poi_madrid").where(spatial.in_box(F.col("location.lat"), F.col("location.lon"), 39.8, 41.2, -4.6, -3.0)).select("row_id")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice / nullif(l_quantity, 0) AS unit_price FROM lineitem")
def safe_ratio(spark: SparkSession, d: str) -> DataFrame:
    """[M6]"""
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", numbers.ratio(F.col("l_extendedprice"), F.col("l_quantity")).alias("unit_price"))


@query("""SELECT o_orderkey, c_name, n_name, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'filled' END AS status FROM orders LEFT JOIN customer ON o_custkey=c_custkey LEFT JOIN nation ON c_nationkey=n_nationkey""")
def dim_lookup(spark: SparkSession, d: str) -> DataFrame:
    """[J1, J2, J3, J9]"""
    o = _t(spark, d, "orders").withColumn("c_custkey", F.col("o_custkey"))
    j = joins.lookup(o, _t(spark, d, "customer"), ["c_custkey"]).withColumn("n_nationkey", F.col("c_nationkey"))
    j = joins.lookup(j, _t(spark, d, "nation"), ["n_nationkey"])
    return j.select("o_orderkey", "c_name", "n_name", joins.code_lookup(F.col("o_orderstatus"), {"O": "open", "F": "filled"}).alias("status"))


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey=o_orderkey AND l_returnflag='R')")
def semi_join(spark: SparkSession, d: str) -> DataFrame:
    """[J4, J5]"""
    r = _t(spark, d, "lineitem").where("l_returnflag = 'R'").withColumn("o_orderkey", F.col("l_orderkey"))
    return joins.keep_known(_t(spark, d, "orders"), r, ["o_orderkey"]).select("o_orderkey")


@query("""WITH g AS (SELECT strftime(ts,'%Y-%m-%d') AS date, CAST(hour(ts) AS INTEGER) AS hour, event_type, avg(value) AS v FROM events GROUP BY ALL)
SELECT a.date, a.hour, a.v AS click, b.v AS view FROM g a JOIN g b USING (date, hour) WHERE a.event_type='click' AND b.event_type='view'""")
def temporal_join(spark: SparkSession, d: str) -> DataFrame:
    """[J6] both sides are one aggregation each, joined on date and hour."""
    e = _t(spark, d, "events").withColumns({"date": times.date_key(F.col("ts")), "hour": F.hour("ts")})
    side = lambda k: e.where(F.col("event_type") == k).groupBy("date", "hour").agg(F.avg("value").alias(k))
    return side("click").join(side("view"), ["date", "hour"])


@query("""SELECT event_id, p.value AS last_purchase FROM events e ASOF LEFT JOIN (SELECT user_id, ts, max_by(value, event_id) AS value FROM events WHERE event_type='purchase' GROUP BY ALL) p ON e.user_id=p.user_id AND e.ts>=p.ts""")
def as_of_join(spark: SparkSession, d: str) -> DataFrame:
    """Latest purchase of the user at or before each event. [A1-A5 of the query contracts]"""
    e = _t(spark, d, "events")
    p = e.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max_by("value", "event_id").alias("last_purchase"))
    return joins.as_of(e.select("event_id", "user_id", "ts"), p, ["user_id"], "ts", "ts", ["last_purchase"]).select("event_id", "last_purchase")


_NEAR = """WITH p AS (SELECT DISTINCT poi_id, location.lat AS lat, location.lon AS lon FROM poi_madrid WHERE location.lat BETWEEN 39 AND 42 AND location.lon BETWEEN -5 AND -2),
c AS (SELECT *, CAST(floor(lat/0.00018) AS BIGINT) AS cy, CAST(floor(lon/0.00025) AS BIGINT) AS cx FROM p),
o AS (SELECT unnest([-1,0,1]) AS dy), q AS (SELECT unnest([-1,0,1]) AS dx),
n AS (SELECT c.poi_id, c.lat, c.lon, cy+dy AS cy, cx+dx AS cx FROM c, o, q),
near AS (SELECT DISTINCT a.poi_id AS left_id, b.poi_id AS right_id FROM c a JOIN n b ON a.cy=b.cy AND a.cx=b.cx WHERE a.poi_id < b.poi_id
 AND 2*6371000.0*asin(sqrt(least(1.0, pow(sin(radians(b.lat-a.lat)/2),2)+cos(radians(a.lat))*cos(radians(b.lat))*pow(sin(radians(b.lon-a.lon)/2),2)))) <= 20)"""
_EDGES = """r AS (SELECT neighbourhood_id, min(geometry.coordinates) AS c FROM barrios_madrid GROUP BY 1),
g AS (SELECT neighbourhood_id, generate_subscripts(c,1) AS poly, unnest(c) AS rings FROM r),
h AS (SELECT neighbourhood_id, poly, unnest(rings) AS ring FROM g),
s AS (SELECT neighbourhood_id, poly, ring, unnest(range(1, len(ring)+1)) AS i FROM h WHERE len(ring)>=3),
e AS (SELECT neighbourhood_id, poly, ring[i][1] AS x1, ring[i][2] AS y1, ring[(i % len(ring))+1][1] AS x2, ring[(i % len(ring))+1][2] AS y2 FROM s),
w AS (SELECT DISTINCT poi_id, neighbourhood_id FROM (SELECT poi_id, neighbourhood_id, poly FROM p JOIN e ON (y1>lat)<>(y2>lat) AND lon < (x2-x1)*(lat-y1)/(y2-y1)+x1 GROUP BY poi_id, lat, lon, neighbourhood_id, poly HAVING count(*)%2=1))"""


@query("""WITH p AS (SELECT DISTINCT poi_id, location.lat AS lat, location.lon AS lon FROM poi_madrid WHERE location.lat BETWEEN 39 AND 42 AND location.lon BETWEEN -5 AND -2), """ + _EDGES + " SELECT poi_id AS point_id, neighbourhood_id AS region_id FROM w")
def pip_join(spark: SparkSession, d: str) -> DataFrame:
    """[J7, M9]"""
    p = _t(spark, d, "poi_madrid").where(spatial.in_box(F.col("location.lat"), F.col("location.lon"), 39, 42, -5, -2))
    return spatial.within(p, "poi_id", F.col("location.lat"), F.col("location.lon"), _t(spark, d, "barrios_madrid"), "neighbourhood_id", F.col("geometry.coordinates"))


@query(_NEAR.replace("0.00018", "0.0027").replace("0.00025", "0.0037").replace("<= 20", "<= 300") + " SELECT left_id AS src, right_id AS dst FROM near")
def proximity_pairs(spark: SparkSession, d: str) -> DataFrame:
    """[J8, M8]"""
    p = _t(spark, d, "poi_madrid").where(spatial.in_box(F.col("location.lat"), F.col("location.lon"), 39, 42, -5, -2))
    return spatial.near(p, "poi_id", F.col("location.lat"), F.col("location.lon"), 300.0).select(F.col("left_id").alias("src"), F.col("right_id").alias("dst"))


@query()
def utm_reprojection(spark: SparkSession, d: str) -> DataFrame:
    """[M7] positions made of the part keys; held against known points in the tests."""
    p = _t(spark, d, "part").select("p_partkey", (F.lit(430_000.0) + F.col("p_partkey") % 20_000).alias("x"), (F.lit(4_470_000.0) + F.col("p_partkey") % 15_000).alias("y"))
    return p.select("p_partkey", _r(geo.utm_to_lat(F.col("x"), F.col("y")), 7).alias("lat"), _r(geo.utm_to_lon(F.col("x"), F.col("y")), 7).alias("lon"))


_NODES = """SELECT id, kind, source, name FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY kind, source, name) rn FROM (
SELECT 'poi:'||poi_id AS id, 'Lugar' AS kind, 'poi' AS source, min(name) AS name FROM poi_madrid WHERE poi_id<>'' GROUP BY poi_id
UNION ALL SELECT 'ruido:'||station_id, 'EstacionMedida', 'ruido', min(station_name) FROM ruido WHERE station_id<>'' GROUP BY station_id
UNION ALL SELECT 'aforos:'||station_id, 'EstacionMedida', 'aforos', min(address) FROM aforos_peatones_bicicletas WHERE station_id<>'' GROUP BY station_id)) WHERE rn=1"""


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    """One row per key: the least name with its place (nulls last)."""
    out = []
    for table, kind, source, key, name in (("poi_madrid", "Lugar", "poi", "poi_id", "name"), ("ruido", "EstacionMedida", "ruido", "station_id", "station_name"), ("aforos_peatones_bicicletas", "EstacionMedida", "aforos", "station_id", "address")):
        ok = F.col("location.lat").between(39, 42) & F.col("location.lon").between(-5, -2)
        lat, lon = F.when(ok, F.col("location.lat")), F.when(ok, F.col("location.lon"))
        out.append(graph.nodes(_t(spark, d, table), kind, source, F.col(key), F.col(name), lat, lon, [F.col(name).isNull(), F.col(name), lat.isNull(), lat, lon]))
    return graph.union_nodes(*out)


@query(_NODES)
def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    """[G1, U2]"""
    return _nodes(spark, d).select("id", "kind", "source", "name")


@query("SELECT DISTINCT neighbourhood_id AS src, district_id AS dst FROM barrios_madrid")
def graph_belongs_to(spark: SparkSession, d: str) -> DataFrame:
    """[G2]"""
    return graph.belongs_to(_t(spark, d, "barrios_madrid"), "neighbourhood_id", "district_id")


@query()
def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    """[G3, G4, J10] placed-in and close-to edges with both ends checked."""
    n = _nodes(spark, d)
    close = graph.close_to(n, 300.0).select("src", "dst", F.lit("PROXIMO_A").alias("kind"))
    inside = graph.located_in(n, _t(spark, d, "barrios_madrid"), "neighbourhood_id", F.col("geometry.coordinates")).select("src", "dst", F.lit("UBICADO_EN").alias("kind"))
    return joins.with_both_ends(close, n).unionByName(inside)


@query("""WITH s AS (SELECT DISTINCT l_orderkey, l_linenumber, l_suppkey FROM lineitem), p AS (SELECT l_orderkey, l_suppkey AS a, lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey) AS b FROM s)
SELECT DISTINCT src, dst FROM (SELECT a AS src, b AS dst FROM p WHERE b IS NOT NULL UNION ALL SELECT b, a FROM p WHERE b IS NOT NULL)""")
def graph_connected(spark: SparkSession, d: str) -> DataFrame:
    """[G5, W3]"""
    s = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey").distinct()
    return graph.connected(s, "l_orderkey", F.col("l_linenumber"), "l_suppkey", F.lit("x")).select("src", "dst").distinct()


@query("""SELECT coalesce(a.s_suppkey, b.s_suppkey) AS id, coalesce(b.name, a.name) AS name, CASE WHEN b.s_suppkey IS NULL THEN a.bal ELSE b.bal END AS bal FROM (SELECT s_suppkey, s_name AS name, s_acctbal AS bal FROM supplier) a
FULL JOIN (SELECT s_suppkey, CASE WHEN s_suppkey%2=0 THEN upper(s_name) END AS name, s_acctbal+1 AS bal FROM supplier WHERE s_suppkey%3=0) b ON a.s_suppkey=b.s_suppkey""")
def node_upsert(spark: SparkSession, d: str) -> DataFrame:
    """[G6, J11]"""
    s = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("bal"))
    new = s.where("id % 3 = 0").select("id", F.when(F.col("id") % 2 == 0, F.upper("name")).alias("name"), (F.col("bal") + 1).alias("bal"))
    return joins.upsert(s, new, ["id"], keep_when_null=("name",))


@query("SELECT poi_id, count(*) AS rows FROM poi_madrid GROUP BY 1 HAVING count(*)>1")
def key_violations(spark: SparkSession, d: str) -> DataFrame:
    """[G7]"""
    return graph.broken_keys(_t(spark, d, "poi_madrid"), "poi_id")


@query("SELECT strftime(o_orderdate,'%Y-%m-%d') AS day, 'orders' AS feed FROM orders UNION ALL SELECT strftime(l_shipdate,'%Y-%m-%d'), 'lineitem' FROM lineitem")
def union_all(spark: SparkSession, d: str) -> DataFrame:
    """[U1]"""
    a = _t(spark, d, "orders").select(times.date_key(F.col("o_orderdate")).alias("day"), F.lit("orders").alias("feed"))
    return a.unionByName(_t(spark, d, "lineitem").select(times.date_key(F.col("l_shipdate")).alias("day"), F.lit("lineitem").alias("feed")))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def top_k(spark: SparkSession, d: str) -> DataFrame:
    """[O1, O4-O6] the limit is the feature."""
    return _t(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


@query("SELECT p_partkey, CAST(list_position(list_transform([900,1200,1500,1800,2100], lambda x: abs(x-p_retailprice)), list_min(list_transform([900,1200,1500,1800,2100], lambda x: abs(x-p_retailprice))))-1 AS INTEGER) AS cell FROM part")
def nearest_grid(spark: SparkSession, d: str) -> DataFrame:
    """[O7]"""
    grid = F.array(*[F.lit(float(x)) for x in (900, 1200, 1500, 1800, 2100)])
    return _t(spark, d, "part").select("p_partkey", arrays.nearest_index(grid, F.col("p_retailprice")).alias("cell"))


@query("SELECT event_id, CAST(json_extract_string(props,'$.k') AS BIGINT) AS k FROM events")
def json_field(spark: SparkSession, d: str) -> DataFrame:
    """[C9]"""
    return _t(spark, d, "events").select("event_id", arrays.json_path(F.col("props"), "$.k", "bigint").alias("k"))


_WS, _EDGES_WS = "[ \\t\\n\\r\\f\\x0b\\x{00a0}]", "[ \\t\\n\\r\\f\\x0b\\x{00a0}\\x{1680}\\x{2000}-\\x{200b}\\x{202f}\\x{205f}\\x{3000}\\x{feff}]"


def _collapsed(expr: str) -> str:
    """SQL twin of functions.text.collapse."""
    return f"nullif(regexp_replace(regexp_replace({expr},'{_WS}+',' ','g'),'^{_EDGES_WS}+|{_EDGES_WS}+$','','g'),'')"


@query(f"SELECT doc_id, {_collapsed("regexp_replace(text,'<[^>]*>',' ','g')")} AS plain FROM documents")
def strip_tags(spark: SparkSession, d: str) -> DataFrame:
    """[X2] tags and white space; entities stay."""
    return _t(spark, d, "documents").select("doc_id", text.collapse(F.regexp_replace("text", r"<[^>]*>", " ")).alias("plain"))


@query()
def strip_html(spark: SparkSession, d: str) -> DataFrame:
    """[X2, X3] with entities decoded, which SQL cannot; tested against the standard library."""
    return _t(spark, d, "documents").select("doc_id", text.strip_tags(F.col("text")).alias("plain"))


@query("SELECT doc_id, nullif(replace(url_decode(replace(regexp_extract(regexp_replace(url,'[?#].*$',''),'([^/]+)/*$',1),'+','%2B')),chr(0),''),'') AS segment FROM documents")
def url_segment(spark: SparkSession, d: str) -> DataFrame:
    """[X5]"""
    return _t(spark, d, "documents").select("doc_id", text.url_segment(F.col("url")).alias("segment"))


@query(f"WITH t AS (SELECT doc_id, {_collapsed('title')} AS t FROM documents) SELECT doc_id, CASE WHEN length(t)>12 THEN rtrim(substr(t,1,12))||'...' ELSE t END AS short FROM t")
def text_truncate(spark: SparkSession, d: str) -> DataFrame:
    """[X4]"""
    return _t(spark, d, "documents").select("doc_id", text.shorten(F.col("title"), 12).alias("short"))


@query("SELECT p_partkey, p_retailprice AS price FROM part")
def decimal_comma(spark: SparkSession, d: str) -> DataFrame:
    """[M3] a number written with a comma and read again."""
    return _t(spark, d, "part").select("p_partkey", numbers.decimal_comma(F.replace(F.col("p_retailprice").cast("string"), F.lit("."), F.lit(","))).alias("price"))


@query("SELECT row_id, try_cast(precipitation_probability_pct AS DOUBLE) AS rain FROM aemet_prevision")
def safe_cast(spark: SparkSession, d: str) -> DataFrame:
    """[M1]"""
    return _t(spark, d, "aemet_prevision").select("row_id", numbers.to_float(F.col("precipitation_probability_pct")).alias("rain"))


@query("SELECT row_id, epoch_us(try_cast(ingested_at AS TIMESTAMPTZ)) AS us FROM aforos_peatones_bicicletas")
def iso_parse(spark: SparkSession, d: str) -> DataFrame:
    """[D1-D4]"""
    return _t(spark, d, "aforos_peatones_bicicletas").select("row_id", F.unix_micros(times.iso_instant(F.col("ingested_at"))).alias("us"))


@query("SELECT strftime(timezone('Europe/Madrid', try_cast(ingested_at AS TIMESTAMPTZ)),'%Y-%m-%d') AS fecha, strftime(timezone('Europe/Madrid', try_cast(ingested_at AS TIMESTAMPTZ)),'%H') AS hora, count(*) AS rows FROM aforos_peatones_bicicletas GROUP BY ALL")
def partition_keys(spark: SparkSession, d: str) -> DataFrame:
    """[D10, D12, N3]"""
    k = times.local_clock(times.iso_instant(F.col("ingested_at")))
    return _t(spark, d, "aforos_peatones_bicicletas").groupBy(times.date_key(k).alias("fecha"), times.hour_key(k).alias("hora")).agg(F.count(F.lit(1)).alias("rows"))


@query("SELECT p_partkey, CASE WHEN length(CAST(p_size AS VARCHAR))<3 THEN lpad(CAST(p_size AS VARCHAR),3,'0') ELSE CAST(p_size AS VARCHAR) END AS code FROM part")
def zfill_codes(spark: SparkSession, d: str) -> DataFrame:
    """[X9]"""
    return _t(spark, d, "part").select("p_partkey", text.zfill(F.col("p_size").cast("string"), 3).alias("code"))


@query("SELECT vec_id, list_min(embedding) AS low, list_max(embedding) AS high, embedding[3] AS third FROM embeddings")
def array_profile(spark: SparkSession, d: str) -> DataFrame:
    """[C4]"""
    x = arrays.extremes(F.array("embedding"))
    return _t(spark, d, "embeddings").select("vec_id", x["low"].alias("low"), x["high"].alias("high"), F.get("embedding", F.lit(2)).alias("third"))


@query("SELECT row_id, CASE WHEN l99_db IS NOT NULL THEN 3 WHEN l90_db IS NOT NULL THEN 2 WHEN l50_db IS NOT NULL THEN 1 END AS hour, CASE WHEN l99_db IS NOT NULL THEN l99_db WHEN l90_db IS NOT NULL THEN l90_db ELSE l50_db END AS value FROM ruido")
def last_valid_hour(spark: SparkSession, d: str) -> DataFrame:
    """[W7] three wide columns stand for the 24."""
    flag = lambda c: F.when(F.col(c).isNotNull(), "V").otherwise("N")
    x = arrays.last_valid([(F.col(c), flag(c)) for c in ("l50_db", "l90_db", "l99_db")])
    return _t(spark, d, "ruido").select("row_id", x["hour"].alias("hour"), x["value"].alias("value"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_shipdate=(SELECT max(l_shipdate) FROM lineitem)")
def latest_day_rows(spark: SparkSession, d: str) -> DataFrame:
    """[F15, F16]"""
    return windows.latest_rows(_t(spark, d, "lineitem"), F.col("l_shipdate")).select("l_orderkey", "l_linenumber")


@query("SELECT doc_id FROM documents WHERE lang IS NULL OR lang LIKE 'es%'")
def lang_filter(spark: SparkSession, d: str) -> DataFrame:
    """[F14]"""
    return _t(spark, d, "documents").where(F.col("lang").isNull() | F.col("lang").startswith("es")).select("doc_id")


@query("SELECT row_id, CASE mode WHEN 'peatones' THEN pedestrian_count WHEN 'bicicletas' THEN bicycle_count END AS count FROM aforos_peatones_bicicletas")
def count_by_mode(spark: SparkSession, d: str) -> DataFrame:
    """[P6]"""
    return _t(spark, d, "aforos_peatones_bicicletas").select("row_id", windows.by_mode("mode", {"peatones": "pedestrian_count", "bicicletas": "bicycle_count"}).alias("count"))


@query("SELECT count(*) AS rows, count(DISTINCT station_id) AS stations, round(avg(laeq_db),6) AS avg_db FROM ruido WHERE laeq_db BETWEEN 20 AND 120")
def ad_hoc_sql(spark: SparkSession, d: str) -> DataFrame:
    """[A18, S23] SQL text over a named table."""
    _t(spark, d, "ruido").createOrReplaceTempView("ruido_ad_hoc")
    return spark.sql("SELECT count(*) AS rows, count(DISTINCT station_id) AS stations, round(avg(laeq_db), 6) AS avg_db FROM ruido_ad_hoc WHERE laeq_db BETWEEN 20 AND 120")


@query("SELECT station_id, round(10*log10(avg(pow(10, laeq_db/10))),6) AS level FROM ruido WHERE laeq_db BETWEEN 20 AND 120 GROUP BY 1")
def energetic_mean(spark: SparkSession, d: str) -> DataFrame:
    """[N17]"""
    return _t(spark, d, "ruido").where("laeq_db between 20 and 120").groupBy("station_id").agg(_r(rollup.energetic_mean(F.col("laeq_db")), 6).alias("level"))


@query()
def path_hops(spark: SparkSession, d: str) -> DataFrame:
    """Breadth-first steps from the first supplier over consecutive suppliers of an order. [Q3]"""
    s = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey").distinct()
    e = graph.connected(s, "l_orderkey", F.col("l_linenumber"), "l_suppkey", F.lit("x"))
    return graph.hops(e, e.agg(F.min("src").alias("id")))
