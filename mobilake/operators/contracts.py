"""Parametrised answers over gold tables. [Q2-Q5]"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mobilake.operators import spatial


def air_or_forecast(measured: DataFrame, forecast: DataFrame, moment: Column) -> DataFrame:
    """Per pollutant the mean over stations of the latest measured hour at or before the moment, else the forecast of its day. [Q2]

    measured: station_id, pollutant, at timestamp, value; forecast: pollutant, day date, value.
    """
    last = measured.where(F.col("at") <= moment).groupBy("station_id", "pollutant").agg(F.max_by("value", F.struct("at", "value")).alias("value"))
    seen = last.groupBy("pollutant").agg(F.avg("value").alias("value")).withColumn("basis", F.lit("measured"))
    day = forecast.where(F.col("day") == moment.cast("date")).groupBy("pollutant").agg(F.avg("value").alias("value")).withColumn("basis", F.lit("forecast"))
    return seen.unionByName(day.join(seen, "pollutant", "left_anti"))


def stops_around(stops: DataFrame, place: DataFrame, metres: float) -> DataFrame:
    """Stops within so many metres of each place, with the distance. [Q3] stops, place: id, lat, lon; ids differ between the two."""
    tagged = stops.select(F.concat(F.lit("s\u0001"), F.col("id")).alias("id"), "lat", "lon").union(place.select(F.concat(F.lit("p\u0001"), F.col("id")), "lat", "lon"))
    n = spatial.near(tagged, "id", F.col("lat"), F.col("lon"), metres)
    mixed = n.where(F.col("left_id").startswith("p\u0001") & F.col("right_id").startswith("s\u0001"))
    return mixed.select(F.substring("left_id", 3, 10_000).alias("place_id"), F.substring("right_id", 3, 10_000).alias("stop_id"), "distance_m")


def free_parking(gold: DataFrame, zones: DataFrame) -> DataFrame:
    """Free and total spaces per zone over the latest hour of each car park. [Q4]

    gold: parking_id, date, hour, avg_free_spaces, total_spaces; zones: parking_id, zone.
    """
    at = F.struct("date", "hour")
    last = gold.groupBy("parking_id").agg(F.max_by(F.struct("avg_free_spaces", "total_spaces"), at).alias("x"), F.max(at).alias("at"))
    j = last.join(zones.select("parking_id", "zone").distinct(), "parking_id")
    return j.groupBy("zone").agg(F.sum("x.avg_free_spaces").alias("free_spaces"), F.sum("x.total_spaces").alias("total_spaces"), F.max("at").alias("as_of"))


def events_around(events: DataFrame, place: DataFrame, metres: float, moment: Column | None = None) -> DataFrame:
    """Events within so many metres of each place that start at or after a moment (all without one), with the distance. [Q5]

    events: id, lat, lon, starts timestamp; place: id, lat, lon.
    """
    e = events if moment is None else events.where(F.col("starts") >= moment)
    return stops_around(e, place, metres).withColumnRenamed("stop_id", "event_id")
