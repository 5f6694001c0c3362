"""Property graph as tables: nodes, edges, integrity and paths. [G1-G8]"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mobilake.operators import joins, spatial, windows
from mobilake.session import cut


def nodes(df: DataFrame, kind: str, source: str, key: Column, name: Column, lat: Column | None = None, lon: Column | None = None, order: Sequence[Column] = ()) -> DataFrame:
    """(id, kind, source, name, lat, lon) of one source, one row per id; rows without key are left out. [G1, X13]"""
    has = F.lit(None).cast("double")
    both = lat.isNotNull() & lon.isNotNull() if lat is not None else F.lit(False)
    d = df.where(key.isNotNull() & (key.cast("string") != ""))
    d = d.select(F.concat(F.lit(f"{source}:"), key).alias("id"), F.lit(kind).alias("kind"), F.lit(source).alias("source"), name.alias("name"), (F.when(both, lat) if lat is not None else has).alias("lat"), (F.when(both, lon) if lat is not None else has).alias("lon"), *[o.alias(f"__o{i}") for i, o in enumerate(order)])
    os = [F.col(f"__o{i}") for i in range(len(order))] or [F.col("name"), F.col("lat"), F.col("lon")]
    return windows.keep_first(d, ["id"], os).select("id", "kind", "source", "name", "lat", "lon")


def union_nodes(*families: DataFrame) -> DataFrame:
    """All families, the first row of an id in (kind, source, name) order wins. [U2, W5]"""
    out = families[0]
    for f in families[1:]:
        out = out.unionByName(f)
    return windows.keep_first(out, ["id"], [F.col("kind"), F.col("source"), F.col("name")])


def belongs_to(regions: DataFrame, child: str, parent: str) -> DataFrame:
    """(src, dst) from a region to the region above it. [G2]"""
    return regions.where(F.col(child).isNotNull() & F.col(parent).isNotNull()).select(F.col(child).alias("src"), F.col(parent).alias("dst")).distinct()


def located_in(n: DataFrame, regions: DataFrame, key: str, coordinates: Column) -> DataFrame:
    """(src, dst): node in region; of several regions the smallest key. [G3, J7]"""
    hit = spatial.within(n, "id", F.col("lat"), F.col("lon"), regions, key, coordinates)
    return hit.groupBy(F.col("point_id").alias("src")).agg(F.min("region_id").alias("dst"))


def close_to(n: DataFrame, metres: float = 300.0) -> DataFrame:
    """(src, dst, distance_m): nodes of different kinds at most so far apart, smaller id first. [G4, J8]"""
    p = spatial.near(n, "id", F.col("lat"), F.col("lon"), metres)
    kinds = n.select("id", "kind")
    a, b = kinds.withColumnsRenamed({"id": "left_id", "kind": "ka"}), kinds.withColumnsRenamed({"id": "right_id", "kind": "kb"})
    return p.join(a, "left_id").join(b, "right_id").where("ka <> kb").select(F.col("left_id").alias("src"), F.col("right_id").alias("dst"), F.bround("distance_m", 3).alias("distance_m"))


def connected(stops: DataFrame, route: str, sequence: Column, stop: str, line: Column) -> DataFrame:
    """(src, dst, line) between consecutive stops of a route, both ways, once each; null sequences count as 0. [G5]"""
    d = stops.withColumns({"__seq": F.coalesce(sequence.try_cast("int"), F.lit(0)), "__line": line})
    p = windows.consecutive_pairs(d, [route, "__line"], [F.col("__seq"), F.col(stop)], stop)
    return p.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("__line").alias("line")).distinct()


def merge_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert: everything is set, but a place stays where the new row has none. [G6]"""
    return joins.upsert(old, new, ["id"], keep_when_null=("lat", "lon"))


def broken_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once: the check behind a uniqueness constraint. [G7]"""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def hops(edges: DataFrame, starts: DataFrame, limit: int | None = None) -> DataFrame:
    """(start, id, hops): fewest steps from each start over directed edges, breadth first.

    One join per step, only the frontier moves; each step is cut to a table in
    the shared folder, so lineage does not grow and lost executors are no loss.
    Ends when a step reaches nothing new; if that is not so after ``limit``
    steps, it raises instead of leaving nodes out.
    """
    e = edges.select("src", "dst").distinct()
    seen = cut(starts.select(F.col("id").alias("start"), F.col("id"), F.lit(0).alias("hops")).distinct(), "hops")
    front = seen
    for k in count(1):
        step = front.join(e, front["id"] == e["src"]).select("start", F.col("dst").alias("id")).distinct()
        step = cut(step.join(seen.select("start", "id"), ["start", "id"], "left_anti").withColumn("hops", F.lit(k)), "hops")
        if step.isEmpty():
            break
        if limit is not None and k > limit:
            raise ValueError(f"more than {limit} steps are needed to reach every node")
        seen, front = seen.unionByName(step), step
        if k % 16 == 0:
            seen = cut(seen, "hops")
    return seen


def load(spark: SparkSession, root: str, nodes_of: Mapping[str, DataFrame], edges_of: Mapping[str, DataFrame]) -> dict[str, int]:
    """Load a graph: all node families first, then the edges whose two ends are there; (table: rows). [G8]

    A family that breaks the uniqueness of its ids stops the load before any edge is written.
    """
    done = {}
    for name, n in nodes_of.items():
        n.write.mode("overwrite").parquet(f"{root}/nodes/{name}")
        stored = spark.read.schema(n.schema).parquet(f"{root}/nodes/{name}")
        if not broken_keys(stored, "id").isEmpty():
            raise ValueError(f"ids of {name} are not unique")
        done[f"nodes/{name}"] = stored.count()
    known = union_nodes(*[spark.read.schema(n.schema).parquet(f"{root}/nodes/{k}") for k, n in nodes_of.items()]).select("id")
    for name, e in edges_of.items():
        joins.with_both_ends(e, known).write.mode("overwrite").parquet(f"{root}/edges/{name}")
        done[f"edges/{name}"] = spark.read.schema(e.schema).parquet(f"{root}/edges/{name}").count()
    return done
