"""Problem 4: points near other points, and the region around each point.

``within``: the edges of all rings are binned into latitude strips; a point
meets only the edges of its own strip, and a ray to the east counts crossings,
grouped by point, region and polygon: odd means inside (outline less holes, as
every ring counts). Edges are half-open in latitude, so a vertex counts once.
A point exactly on an edge is handled on its own: it is found by the exact
collinearity test and belongs to every region whose edge it lies on.

``near``: equal coordinates are one place, whatever the number of points there,
so ``near_places`` finds pairs of places plus the places' members, and no group
of points on one spot is paired with itself. Places go to bands of latitude and,
within a band, to cells of longitude as wide as the radius is there, so the
grid holds up to the poles and goes around at 180 degrees. Each place is looked
up in its own cell and in the neighbours one cell on, so every pair of cells
meets once. A cell with many places is split in salted parts: one side is
spread over them, the other copied to each. The exact distance decides.

Edge cases: null, NaN or out-of-range coordinates (beyond 90 and 180 degrees)
take no part; a point given
twice gives each case once; polygons given twice count once; rings may run
either way and may lack the closing point; rings of fewer than three points
and null geometries enclose nothing; empty tables give empty results.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mobilake.session import BROADCAST_LIMIT_BYTES

EARTH_M = 6_371_000.0


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance in metres on a sphere of 6,371,000 m. [M8]"""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_M) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def in_box(lat: Column, lon: Column, south: float, north: float, west: float, east: float) -> Column:
    """Inclusive bounding box; null coordinates are outside. [F2]"""
    return F.coalesce(lat.between(south, north) & lon.between(west, east), F.lit(False))


CELL_PLACES = 2_000  # places of a cell that one task pairs


def _columns(cy: Column, dlat: float, angle: float) -> Column:
    """Cells of longitude in a band of latitude and the one above, each at least as wide as the radius is at their higher edge."""
    edge = F.least(F.lit(90.0), F.greatest(F.abs(cy), F.abs(cy + 2)) * dlat)
    width = F.degrees(2 * F.asin(F.least(F.lit(1.0), math.sin(angle / 2) / F.greatest(F.cos(F.radians(edge)), F.lit(1e-15))))) * 1.000001
    return F.greatest(F.lit(1), F.floor(360.0 / width)).cast("bigint")


def places(points: DataFrame, key: str, lat: Column, lon: Column) -> tuple[DataFrame, DataFrame]:
    """(places: place, lat, lon; members: place, id): equal coordinates are one place; ids given twice count once."""
    p = points.select(F.col(key).alias("id"), lat.cast("double").alias("lat"), lon.cast("double").alias("lon"))
    p = p.where(F.col("id").isNotNull() & F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180)).withColumns({"lat": F.col("lat") + 0.0, "lon": F.when(F.col("lon") == -180, 180.0).otherwise(F.col("lon") + 0.0)})
    at = F.struct("lat", "lon")
    members = p.select(at.alias("place"), "id").distinct()
    return members.select("place").distinct().select("place", "place.lat", "place.lon"), members


def near_places(spots: DataFrame, radius_m: float, split: int = CELL_PLACES) -> DataFrame:
    """(a, b, distance_m): pairs of different places at most radius_m apart, once each."""
    angle = min(math.pi, radius_m / EARTH_M)
    dlat = math.degrees(angle) * 1.000001
    band = F.floor(F.col("lat") / dlat).cast("bigint")
    # a band's own grid of longitudes serves all pairs whose lower place lies in it; the upper one is put on it too
    p = spots.withColumn("cy", band).withColumn("n", _columns(F.col("cy"), dlat, angle))
    cell = lambda n: F.pmod(F.floor((F.col("lon") + 180) / 360 * n).cast("bigint"), n)
    low = p.withColumn("cx", cell(F.col("n")))
    high = p.select("place", "lat", "lon", F.explode(F.array(F.struct(F.col("cy").alias("g"), F.lit(True).alias("own")), F.struct((F.col("cy") - 1).alias("g"), F.lit(False).alias("own")))).alias("s"))
    high = high.select("place", "lat", "lon", F.col("s.g").alias("cy"), "s.own").withColumn("n", _columns(F.col("cy"), dlat, angle))
    high = high.withColumn("c", cell(F.col("n")))
    steps = F.array_distinct(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: F.pmod(F.col("c") + k, F.col("n"))))
    high = high.select("place", "lat", "lon", "cy", "own", F.explode(steps).alias("cx"))
    # a hot cell's lower places are spread over parts, its upper ones copied to each
    hot = low.groupBy("cy", "cx").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > split).select("cy", "cx", F.ceil(F.col("k") / split).cast("int").alias("parts"))
    part = lambda d: d.join(hot, ["cy", "cx"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    a = part(low).select(F.col("place").alias("a"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"), "cy", "cx", F.pmod(F.xxhash64("place"), F.col("parts")).cast("int").alias("part"))
    b = part(high).select(F.col("place").alias("b"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), "own", "cy", "cx", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    pairs = a.join(b, ["cy", "cx", "part"]).where(~F.col("own") | (F.col("a") < F.col("b"))).where(F.abs(F.col("lat1") - F.col("lat2")) <= dlat)
    d = haversine_m(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))
    return pairs.select("a", "b", d.alias("distance_m")).where(F.col("distance_m") <= radius_m)


def near(points: DataFrame, key: str, lat: Column, lon: Column, radius_m: float) -> DataFrame:
    """(left_id, right_id, distance_m): pairs of different keys at most radius_m apart, smaller key left, once each.

    Writes out all pairs. Where many keys may share a spot, take
    ``near_classes``, which does not.
    """
    spots, members = places(points, key, lat, lon)
    m = lambda i, c: members.select(F.col("place").alias(c), F.col("id").alias(i))
    apart = near_places(spots, radius_m).join(m("l", "a"), "a").join(m("r", "b"), "b").where(F.col("l") != F.col("r")).select("l", "r", "distance_m")
    shared = members.groupBy("place").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select(F.col("place").alias("a"))
    same = m("l", "a").join(shared, "a").join(m("r", "a"), "a").where(F.col("l") < F.col("r")).select("l", "r", F.lit(0.0).alias("distance_m"))
    return apart.unionByName(same).groupBy(F.least("l", "r").alias("left_id"), F.greatest("l", "r").alias("right_id")).agg(F.min("distance_m").alias("distance_m"))


def near_classes(points: DataFrame, key: str, lat: Column, lon: Column, radius_m: float) -> tuple[DataFrame, DataFrame]:
    """(pairs: class_a, class_b, distance_m; members: id, class): keys on one spot are one class, named by its least key.

    Keys of one class are at distance 0 of one another; keys of two paired
    classes are near each other. Nothing is lost, and no group is squared.
    """
    spots, members = places(points, key, lat, lon)
    names = members.groupBy("place").agg(F.min("id").alias("class"))
    n = lambda c, to: names.select(F.col("place").alias(c), F.col("class").alias(to))
    pairs = near_places(spots, radius_m).join(n("a", "class_a"), "a").join(n("b", "class_b"), "b")
    pairs = pairs.select(F.least("class_a", "class_b").alias("class_a"), F.greatest("class_a", "class_b").alias("class_b"), "distance_m")
    return pairs, members.join(names, "place").select("id", "class")


def edges(regions: DataFrame, key: str, coordinates: Column, strip_deg: float) -> DataFrame:
    """One row per ring edge and latitude strip it touches: key, poly, (x1,y1,x2,y2), the polygon's box and strip."""
    r = regions.where(F.col(key).isNotNull() & coordinates.isNotNull()).groupBy(F.col(key).alias("region")).agg(F.min_by(coordinates, F.to_json(F.struct(coordinates.alias("c")))).alias("c"))
    r = r.select("region", F.posexplode("c").alias("poly", "rings"))
    pts = F.flatten("rings")
    r = r.withColumns({"west": F.array_min(F.transform(pts, lambda p: p[0])), "east": F.array_max(F.transform(pts, lambda p: p[0]))})
    r = r.select("region", "poly", "west", "east", F.explode("rings").alias("ring")).where(F.size("ring") >= 3)
    closed = F.concat("ring", F.slice("ring", 1, 1))
    seg = F.transform(F.sequence(F.lit(1), F.size("ring")), lambda i: F.struct(F.get(closed, i - 1).alias("a"), F.get(closed, i).alias("b")))
    e = r.select("region", "poly", "west", "east", F.explode(seg).alias("e"))
    e = e.select("region", "poly", "west", "east", *[F.col(f"e.{n}").getItem(i).alias(f"{x}{k}") for k, n in ((1, "a"), (2, "b")) for i, x in ((0, "x"), (1, "y"))])
    e = e.where((F.col("x1") != F.col("x2")) | (F.col("y1") != F.col("y2")))
    strip = lambda c: F.floor(c / strip_deg)
    return e.withColumn("strip", F.explode(F.sequence(strip(F.least("y1", "y2")), strip(F.greatest("y1", "y2")))))


def within(points: DataFrame, key: str, lat: Column, lon: Column, regions: DataFrame, region_key: str, coordinates: Column, strip_deg: float = 0.002, broadcast_limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """(point_id, region_id): each point in each region whose polygons, less their holes, contain it."""
    p = points.select(F.col(key).alias("id"), lat.cast("double").alias("lat"), lon.cast("double").alias("lon"))
    p = p.where(F.col("id").isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull() & ~F.isnan("lat") & ~F.isnan("lon")).distinct()
    p = p.withColumn("strip", F.floor(F.col("lat") / strip_deg))
    e = edges(regions, region_key, coordinates, strip_deg)
    if e.count() * 120 <= broadcast_limit:  # some 80 bytes a row; larger edge tables are shuffled by strip
        e = F.broadcast(e)
    x, y = F.col("lon"), F.col("lat")
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    c = p.join(e, "strip").where(x.between(F.col("west"), F.col("east")) & y.between(F.least(y1, y2), F.greatest(y1, y2)) & (x <= F.greatest(x1, x2)))
    cross = (x2 - x1) * (y - y1) - (x - x1) * (y2 - y1)
    on = (cross == 0) & x.between(F.least(x1, x2), F.greatest(x1, x2))
    ray = ((y1 > y) != (y2 > y)) & F.when(y2 > y1, cross > 0).otherwise(cross < 0)
    c = c.groupBy("id", "lat", "lon", "region", "poly").agg(F.sum(ray.cast("int")).alias("n"), F.max(on.cast("int")).alias("edge"))
    return c.where((F.col("n") % 2 == 1) | (F.col("edge") == 1)).select(F.col("id").alias("point_id"), F.col("region").alias("region_id")).distinct()
