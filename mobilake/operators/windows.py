"""Sequences, first rows and deduplication. [W3-W6, F15, F16, P7, P8]"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row of every key, nulls equal. [W5, A17]

    By an aggregate of the whole row, which combines before the shuffle.
    """
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in df.columns]), F.struct(*order)).alias("__best"))
    return best.select("__best.*")


def first_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """First k rows of every key. Spark pushes the limit below the shuffle (window group limit). [W4]"""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= k).drop("__rn")


def representative(df: DataFrame, keys: Sequence[str], value: str, preferred: Column, order: Column) -> DataFrame:
    """One value per key: of preferred rows if there are any, then by order. [W6]"""
    return df.groupBy(*keys).agg(F.min_by(value, F.struct((~preferred).alias("p"), order.alias("o"), F.col(value))).alias(value))


def consecutive_pairs(df: DataFrame, keys: Sequence[str], order: Sequence[Column], item: str, both_ways: bool = True) -> DataFrame:
    """(keys, a, b) of neighbours within a key, in both directions. [W3, U1]"""
    w = Window.partitionBy(*keys).orderBy(*order)
    p = df.select(*keys, F.col(item).alias("a"), F.lead(item).over(w).alias("b")).where(F.col("b").isNotNull())
    if not both_ways:
        return p
    ways = F.array(F.struct(F.col("a"), F.col("b")), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    return p.select(*keys, F.explode(ways).alias("e")).select(*keys, "e.a", "e.b")


def latest_rows(df: DataFrame, c: Column) -> DataFrame:
    """Rows at the greatest value of c, by one small aggregate joined back. [F15, F16]"""
    top = df.agg(F.max(c).alias("__top"))
    return df.join(F.broadcast(top), c == F.col("__top")).drop("__top")


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str, value: str) -> DataFrame:
    """Wide to long, nulls dropped. [P7]"""
    return df.unpivot(list(ids), list(values), name, value).where(F.col(value).isNotNull())


def freshest_pivot(df: DataFrame, keys: Sequence[str], name: str, names: Sequence[str], value: str, order: Column) -> DataFrame:
    """Long to wide: freshest value per name, and the freshest order of all. [P8]"""
    cols = [F.max_by(F.when(F.col(name) == n, F.col(value)), F.when((F.col(name) == n) & F.col(value).isNotNull(), order)).alias(n) for n in names]
    return df.groupBy(*keys).agg(F.max(order).alias("freshest"), *cols)


def by_mode(mode: str, columns: Mapping[str, str]) -> Column:
    """Column chosen by another column's value. [P6]"""
    out = None
    for m, c in columns.items():
        out = F.when(F.col(mode) == m, F.col(c)) if out is None else out.when(F.col(mode) == m, F.col(c))
    return out


def latest_year(df: DataFrame, c: Column) -> DataFrame:
    """Rows of the greatest year of c. [F16]"""
    return latest_rows(df, F.year(c))


def grouped_lists(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], to: str) -> DataFrame:
    """One row per key with its values as an array of structs, sorted by ``order``; the groups are those of a schedule or a route, not of a feed. [A19, O2, O3]"""
    rows = F.sort_array(F.collect_list(F.struct(*order, *[v for v in values if v not in order])))
    return df.groupBy(*keys).agg(F.transform(rows, lambda x: F.struct(*[x[v].alias(v) for v in values])).alias(to))
