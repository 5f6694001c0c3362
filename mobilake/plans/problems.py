"""The core problems' operators applied to their tables: queries p1..p5 and p7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mobilake.functions import instants as I
from mobilake.operators import compaction, drift, instants, rolling, spatial, spikes

# Physical limits, what a sensor of the kind can resolve, and the width in scales of each series.
LEVEL = spikes.Chart(low=15, high=140, finest=0.5, width=6.9, run=6)
COUNT = spikes.Chart(low=0, high=60_000, finest=0.05, width=4.9, width_down=6.5, slots=24, log=True, run=10)
WARMTH = spikes.Chart(low=-35, high=52, finest=0.5, width=3.6, alpha=0.3)


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Trailing periods of 1, 7 or 30 days without any reading of the station."""
    return rolling.empty_periods(_t(spark, d, "ruido"), "station_id", rolling.valid_day(F.col("measured_date")), "laeq_db")


def p1_rolling(spark: SparkSession, d: str) -> DataFrame:
    """Totals and averages of laeq_db over the last 7 and 30 days, for every station and calendar day."""
    out = rolling.trailing(_t(spark, d, "ruido"), "station_id", rolling.valid_day(F.col("measured_date")), "laeq_db")
    return out.select("station_id", F.date_format("day", "yyyy-MM-dd").alias("day"), *[f"{k}_{p}" for p in (7, 30) for k in ("n", "total", "avg")])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Fields added, removed, renamed or retyped between the files of a feed."""
    return drift.changes(_t(spark, d, "afluencia_lugares_raw"))


def p2_table(spark: SparkSession, d: str) -> DataFrame:
    """The records as one table with one set of fields, and what did not fit as JSON."""
    return drift.evolve(_t(spark, d, "afluencia_lugares_raw"))[0]


def _compaction(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, dict]:
    rows, files = _t(spark, d, "aforos_peatones_bicicletas"), _t(spark, d, "aforos_landing_files")
    return rows, files, {"skip": ["row_id", "file_id", "ingested_at"], "order_us": I.iso_us(F.col("ingested_at")), "only": F.col("measured_at").rlike(r"[^\s\u00a0]")}


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Copies that the compaction leaves out: rows of the landed files whose record the published files hold in another row."""
    rows, files, how = _compaction(spark, d)
    return compaction.removed_by_compaction(rows, files, "file_id", "row_id", **how)


def p3_manifest(spark: SparkSession, d: str) -> DataFrame:
    """The verified manifest of the compacted files: rows in the files and files written."""
    rows, files, how = _compaction(spark, d)
    _, manifest = compaction.compact(rows, files, "file_id", "row_id", compaction.duplicates(rows, "row_id", **how))
    return manifest.agg(F.sum("n_rows").alias("n_rows"))


def _places(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "poi_madrid").where(spatial.in_box(F.col("location.lat"), F.col("location.lon"), 39, 42, -5, -2))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Places within 20 m of each other, and the neighbourhood around each place."""
    poi, lat, lon = _places(spark, d), F.col("location.lat"), F.col("location.lon")
    n = spatial.near(poi, "poi_id", lat, lon, 20.0)
    w = spatial.within(poi, "poi_id", lat, lon, _t(spark, d, "barrios_madrid"), "neighbourhood_id", F.col("geometry.coordinates"))
    near = n.select(F.lit("near").alias("kind"), "left_id", "right_id")
    return near.union(w.select(F.lit("within"), "point_id", "region_id"))


def p4_places(spark: SparkSession, d: str) -> DataFrame:
    """Every place with its class (places on one spot, named by the least) and the number of other places within 20 m."""
    pairs, members = spatial.near_classes(_places(spark, d), "poi_id", F.col("location.lat"), F.col("location.lon"), 20.0)
    sizes = members.groupBy("class").agg(F.count(F.lit(1)).alias("k"))
    ends = pairs.select(F.explode(F.array(F.struct(F.col("class_a").alias("class"), F.col("class_b").alias("class2")), F.struct(F.col("class_b").alias("class"), F.col("class_a").alias("class2")))).alias("e")).select("e.*")
    others = ends.join(sizes.withColumnRenamed("class", "class2"), "class2").groupBy("class").agg(F.sum("k").alias("others"))
    links = sizes.join(others, "class", "left").select("class", (F.col("k") - 1 + F.coalesce("others", F.lit(0))).alias("links"))
    return members.join(links, "class").select(F.col("id").alias("poi_id"), F.col("class").alias("place"), "links")


def spike_rows(spark: SparkSession, d: str) -> DataFrame:
    """(table_name, row_id, reason) over the three tables of problem 5."""
    r = _t(spark, d, "ruido")
    date = F.unix_date(rolling.valid_day(F.col("measured_date")))
    a = spikes.flag(r, "row_id", F.concat_ws("\u0001", F.coalesce("station_id", F.lit("\u0000")), F.coalesce("period", F.lit("\u0000"))), F.col("laeq_db"), date, F.lit(0), date, LEVEL)
    p = _t(spark, d, "aforos_peatones_bicicletas").where((F.col("mode") == "peatones") & F.col("pedestrian_count").isNotNull())
    p = instants.normalise(p.select("row_id", "station_id", "device_id", "pedestrian_count", "measured_at"), "measured_at", instant="utc", status="st")
    p = p.withColumn("local", F.convert_timezone(F.lit("UTC"), F.lit("Europe/Madrid"), F.col("utc")))
    key = F.concat_ws("\u0001", F.coalesce("station_id", F.lit("\u0000")), F.coalesce("device_id", F.lit("\u0000")))
    b = spikes.flag(p, "row_id", key, F.col("pedestrian_count"), F.unix_date(F.col("local").cast("date")), F.hour("local"), I.wall_seconds(F.col("utc")), COUNT)
    w = _t(spark, d, "aemet_prevision")
    valid = F.unix_date(rolling.valid_day(F.col("valid_date")))
    c = spikes.flag(w, "row_id", F.col("municipio_code"), F.col("temperature_max_c"), valid, F.lit(0), valid, WARMTH)
    tag = lambda t, x: x.select(F.lit(t).alias("table_name"), "row_id", "reason")
    return tag("ruido", a).unionByName(tag("aforos_peatones_bicicletas", b)).unionByName(tag("aemet_prevision", c))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows with readings that cannot be right for their station or municipality."""
    return spike_rows(spark, d).select("table_name", "row_id")


TIMES = (("agenda_eventos", "start_datetime", "captured_at"), ("aforos_peatones_bicicletas", "measured_at", "ingested_at"), ("aemet_prevision", "elaborated_at", "captured_at"))


ZONED = r"^(\d{10}|\d{13}|\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d{1,6})?(Z|[+-]\d{2}:\d{2}))$"


def instants_of(spark: SparkSession, d: str) -> DataFrame:
    """(table_name, row_id, instant_utc, instant_status) of the three tables of problem 7.

    All three are aligned with the instant their record was captured. For
    announced starts, mostly days ahead of it, that says nothing about the zone,
    so the declared one holds there.
    """
    out = None
    for table, text, ingested in TIMES:
        df = _t(spark, d, table).select(F.lit(table).alias("table_name"), "row_id", "source", text, ingested)
        n = instants.normalise(df, text, "Europe/Madrid", source="source", ingested=ingested).select("table_name", "row_id", "instant_utc", "instant_status")
        out = n if out is None else out.unionByName(n)
    return out


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose time text is there but does not denote exactly one instant."""
    return instants_of(spark, d).where(~F.col("instant_status").isin("ok", "missing")).select("table_name", "row_id")


def p7_instants(spark: SparkSession, d: str) -> DataFrame:
    """Every row of the three tables with its instant in UTC, or the reason it has none."""
    return instants_of(spark, d).select("table_name", "row_id", F.date_format("instant_utc", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("instant_utc"), "instant_status")


def p7_zoned(spark: SparkSession, d: str) -> DataFrame:
    """The instants of texts that are ISO with an offset, or epochs; what SQL can read by itself."""
    out = None
    for table, text, ingested in TIMES:
        df = _t(spark, d, table).where(F.col(text).rlike(ZONED)).select(F.lit(table).alias("table_name"), "row_id", "source", text, ingested)
        n = instants.normalise(df, text, "Europe/Madrid", source="source", ingested=ingested).where("instant_status = 'ok'")
        n = n.select("table_name", "row_id", F.date_format("instant_utc", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("instant_utc"))
        out = n if out is None else out.unionByName(n)
    return out


QUERIES = {"p1_found": p1_found, "p1_rolling": p1_rolling, "p2_found": p2_found, "p2_table": p2_table, "p3_found": p3_found, "p3_manifest": p3_manifest, "p4_found": p4_found, "p4_places": p4_places, "p5_found": p5_found, "p7_found": p7_found, "p7_instants": p7_instants, "p7_zoned": p7_zoned}
