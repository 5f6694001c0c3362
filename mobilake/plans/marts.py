"""The data marts over the given tables, and the query contracts of the assistant layer. [Q1-Q5]"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mobilake.datasets import specs
from mobilake.functions import arrays, times
from mobilake.operators import drift, spatial

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _mart(name: str, bronze: DataFrame) -> DataFrame:
    rows, _ = specs.silver(specs.MARTS[name], bronze)
    return specs.MARTS[name].gold(rows)


def gold_ruido(spark: SparkSession, d: str) -> DataFrame:
    """Daily noise by station and period with the trailing seven days."""
    g = _mart("ruido", _t(spark, d, "ruido"))
    return g.select("station_id", "period", "date", "samples_count", *[F.round(c, 6).alias(c) for c in ("avg_laeq_db", "laeq_rolling_7d_avg_db")], "max_laeq_db", "min_laeq_db", "laeq_rolling_7d_days")


_OK = "coalesce(regexp_full_match({c},'\\d{{4}}-\\d{{2}}-\\d{{2}}[T ]\\d{{2}}:\\d{{2}}(:\\d{{2}}([.,]\\d{{1,9}})?)?(Z|[+-]\\d{{2}}:?\\d{{2}})') AND try_cast({c} AS TIMESTAMPTZ) IS NOT NULL, false)"
_LEVELS = " AND ".join(f"({c} IS NULL OR {c} BETWEEN 20 AND 120)" for c in ("laeq_db", "l1_db", "l10_db", "l50_db", "l90_db", "l99_db"))
SQL["gold_ruido"] = f"""WITH s AS (SELECT * FROM ruido WHERE station_id<>'' AND period<>'' AND regexp_full_match(measured_date,'\\d{{4}}-\\d{{2}}-\\d{{2}}') AND try_cast(measured_date AS DATE) IS NOT NULL AND {_OK.format(c="ingested_at")} AND laeq_db IS NOT NULL AND {_LEVELS}),
g AS (SELECT station_id, period, measured_date AS date, count(*) AS samples_count, avg(laeq_db) AS a, max(laeq_db) AS max_laeq_db, min(laeq_db) AS min_laeq_db FROM s GROUP BY ALL)
SELECT station_id, period, date, samples_count, round(a,6) AS avg_laeq_db, max_laeq_db, min_laeq_db, round(avg(a) OVER w,6) AS laeq_rolling_7d_avg_db, count(a) OVER w AS laeq_rolling_7d_days FROM g
WINDOW w AS (PARTITION BY station_id, period ORDER BY CAST(date AS DATE) RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW)"""


def gold_aforos(spark: SparkSession, d: str) -> DataFrame:
    """Hourly counts by station and mode."""
    g = _mart("aforos_peatones_bicicletas", _t(spark, d, "aforos_peatones_bicicletas"))
    return g.select("station_id", "mode", "date", "hour", "samples_count", "total_count", F.round("avg_count", 6).alias("avg_count"), "max_count", "min_count")


SQL["gold_aforos"] = f"""WITH s AS (SELECT *, CASE mode WHEN 'peatones' THEN pedestrian_count WHEN 'bicicletas' THEN bicycle_count END AS c FROM aforos_peatones_bicicletas WHERE station_id<>'' AND {_OK.format(c="measured_at")} AND {_OK.format(c="ingested_at")}),
k AS (SELECT *, timezone('Europe/Madrid', CAST(measured_at AS TIMESTAMPTZ)) AS t FROM s WHERE c >= 0)
SELECT station_id, mode, strftime(t,'%Y-%m-%d') AS date, CAST(hour(t) AS INTEGER) AS hour, count(*) AS samples_count, CAST(sum(c) AS BIGINT) AS total_count, round(avg(c),6) AS avg_count, max(c) AS max_count, min(c) AS min_count FROM k GROUP BY ALL"""


def gold_agenda(spark: SparkSession, d: str) -> DataFrame:
    """Events by category, district and day; times must be ISO here (others are problem 7's)."""
    g = _mart("agenda_eventos", _t(spark, d, "agenda_eventos"))
    return g.select("category", "district", "date", "samples_count", "events_count", "free_events_count", F.array_join("sources", ",").alias("sources"))


SQL["gold_agenda"] = f"""SELECT coalesce(nullif(category,''),'__sin_categoria__') AS category, coalesce(nullif(location.district,''),'__sin_distrito__') AS district, start_datetime[1:10] AS date, count(*) AS samples_count, count(DISTINCT event_id) AS events_count,
count(DISTINCT CASE WHEN free THEN event_id END) AS free_events_count, array_to_string(list_sort(list(DISTINCT source)),',') AS sources FROM agenda_eventos
WHERE source IN ('agenda_eventos_madrid_municipal','agenda_turismo_esmadrid','agenda_eventos_distritos') AND event_id<>'' AND title<>'' AND {_OK.format(c="captured_at")}
AND regexp_full_match(start_datetime,'\\d{{4}}-\\d{{2}}-\\d{{2}}[T ]\\d{{2}}:\\d{{2}}(:\\d{{2}}([.,]\\d{{1,9}})?)?(Z|[+-]\\d{{2}}:?\\d{{2}})?') AND coalesce(try_cast(start_datetime AS TIMESTAMPTZ) IS NOT NULL, false) GROUP BY ALL"""


def gold_aemet(spark: SparkSession, d: str) -> DataFrame:
    """Forecasts by municipality and lead time."""
    g = _mart("aemet_prevision", _t(spark, d, "aemet_prevision"))
    return g.select("municipio_code", "leadtime_days", "samples_count", *[F.round(c, 6).alias(c) for c in ("avg_temperature_max_c", "avg_temperature_min_c", "avg_precipitation_probability_pct")], "max_temperature_max_c", "min_temperature_min_c", "first_valid_date", "last_valid_date")


SQL["gold_aemet"] = f"""WITH s AS (SELECT *, CAST(timezone('Europe/Madrid', CAST(captured_at AS TIMESTAMPTZ)) AS DATE) AS c, CAST(valid_date AS DATE) AS v, try_cast(precipitation_probability_pct AS DOUBLE) AS p FROM aemet_prevision
WHERE municipio_code<>'' AND regexp_full_match(valid_date,'\\d{{4}}-\\d{{2}}-\\d{{2}}') AND try_cast(valid_date AS DATE) IS NOT NULL AND {_OK.format(c="captured_at")} AND temperature_max_c BETWEEN -20 AND 50 AND temperature_min_c BETWEEN -20 AND 50)
SELECT municipio_code, CAST(v-c AS INTEGER) AS leadtime_days, count(*) AS samples_count, round(avg(temperature_max_c),6) AS avg_temperature_max_c, round(avg(temperature_min_c),6) AS avg_temperature_min_c, round(avg(p),6) AS avg_precipitation_probability_pct,
CAST(max(temperature_max_c) AS DOUBLE) AS max_temperature_max_c, CAST(min(temperature_min_c) AS DOUBLE) AS min_temperature_min_c, min(valid_date) AS first_valid_date, max(valid_date) AS last_valid_date FROM s WHERE v>=c AND p BETWEEN 0 AND 100 GROUP BY ALL"""


def gold_afluencia(spark: SparkSession, d: str) -> DataFrame:
    """Crowding by place and hour, fed by the drift-proof table of problem 2."""
    t = drift.evolve(_t(spark, d, "afluencia_lugares_raw"))[0]
    week = "struct<" + ",".join(f"{w}:array<int>" for w in times.WEEKDAYS) + ">"
    from mobilake.functions.instants import from_epoch_us

    k = F.convert_timezone(F.lit("UTC"), F.lit(specs.ZONE), from_epoch_us(F.col("captured_at")))
    t = t.where(F.col("place_id").isNotNull() & F.col("captured_at").isNotNull()).withColumns({"date": times.date_key(k), "hour": F.hour(k), "typical": arrays.profile_at(F.from_json(F.regexp_replace("typical_by_hour", r'"(\d+(\.\d+)?)"', "$1"), week), k)})
    return t.groupBy("place_id", "date", "hour").agg(F.count(F.lit(1)).alias("samples_count"), F.round(F.avg("live_pct"), 6).alias("avg_live_pct"), F.round(F.avg("typical"), 6).alias("typical_pct"))


def rejected_rows(spark: SparkSession, d: str) -> DataFrame:
    """Reasons of all rejected rows of the marts that have tables here: the quarantine is kept, not dropped."""
    out = None
    for name, table in (("ruido", "ruido"), ("aforos_peatones_bicicletas", "aforos_peatones_bicicletas"), ("aemet_prevision", "aemet_prevision"), ("agenda_eventos", "agenda_eventos")):
        _, bad = specs.silver(specs.MARTS[name], _t(spark, d, table))
        r = bad.select(F.lit(name).alias("dataset"), F.explode("reasons").alias("reason")).groupBy("dataset", "reason").agg(F.count(F.lit(1)).alias("rows"))
        out = r if out is None else out.unionByName(r)
    return out


def expected_crowd(spark: SparkSession, d: str) -> DataFrame:
    """[Q1] typical and mean live crowding by place, weekday and hour."""
    g = gold_afluencia(spark, d).withColumn("weekday", times.weekday_name(F.to_date("date")))
    return g.groupBy("place_id", "weekday", "hour").agg(F.round(F.avg("typical_pct"), 4).alias("typical_pct"), F.round(F.avg("avg_live_pct"), 4).alias("live_pct"))


def noise_now(spark: SparkSession, d: str) -> DataFrame:
    """[Q2] for noise: latest plausible level of every station and period at or before a moment (here its last day)."""
    r = _t(spark, d, "ruido").withColumn("day", times.iso_date(F.col("measured_date"))).where(F.col("day").isNotNull() & F.col("laeq_db").between(20, 120))
    return r.groupBy("station_id", "period").agg(F.max_by("laeq_db", F.struct("day", F.col("laeq_db"))).alias("laeq_db"), F.date_format(F.max("day"), "yyyy-MM-dd").alias("day"))


SQL["noise_now"] = """SELECT station_id, period, max_by(laeq_db, (CAST(measured_date AS DATE), laeq_db)) AS laeq_db, strftime(max(CAST(measured_date AS DATE)),'%Y-%m-%d') AS day FROM ruido WHERE regexp_full_match(measured_date,'\\d{4}-\\d{2}-\\d{2}') AND try_cast(measured_date AS DATE) IS NOT NULL AND laeq_db BETWEEN 20 AND 120 GROUP BY ALL"""


def places_near_events(spark: SparkSession, d: str) -> DataFrame:
    """[Q5] places within 150 m of an event's venue, nearest first by distance."""
    e = _t(spark, d, "agenda_eventos").select(F.concat(F.lit("e:"), F.col("event_id")).alias("id"), F.col("location.lat").alias("lat"), F.col("location.lon").alias("lon")).where(spatial.in_box(F.col("lat"), F.col("lon"), 39, 42, -5, -2))
    p = _t(spark, d, "poi_madrid").select(F.concat(F.lit("p:"), F.col("poi_id")).alias("id"), F.col("location.lat").alias("lat"), F.col("location.lon").alias("lon")).where(spatial.in_box(F.col("lat"), F.col("lon"), 39, 42, -5, -2))
    n = spatial.near(e.union(p), "id", F.col("lat"), F.col("lon"), 150.0)
    return n.where(F.col("left_id").startswith("e:") & F.col("right_id").startswith("p:")).select(F.substring("left_id", 3, 100).alias("event_id"), F.substring("right_id", 3, 100).alias("poi_id"), F.round("distance_m", 3).alias("distance_m"))


for f in (gold_ruido, gold_aforos, gold_agenda, gold_aemet, gold_afluencia, rejected_rows, expected_crowd, noise_now, places_near_events):
    QUERIES[f.__name__] = f


def streaming_hourly(spark: SparkSession, d: str) -> DataFrame:
    """[T1, T3] the hourly roll-up as a stream over the landed files, run until all of them are read; equals the batch."""
    from mobilake.session import work_path
    from mobilake.streaming import hourly

    schema = _t(spark, d, "events").schema
    stream = hourly.file_stream(spark, f"{d}/events.parquet*", schema)
    counts = hourly.windowed(stream, "ts", ["user_id"], {"samples_count": F.count(F.lit(1)), "max_value": F.max("value")}, lateness=None)
    out = work_path(spark, "stream")
    counts.writeStream.outputMode("complete").foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{out}/rows")).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(counts.schema).parquet(f"{out}/rows").select("user_id", F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "samples_count", "max_value")


QUERIES["streaming_hourly"] = streaming_hourly
SQL["streaming_hourly"] = "SELECT user_id, strftime(ts,'%Y-%m-%d %H') AS hour, count(*) AS samples_count, max(value) AS max_value FROM events GROUP BY ALL"
