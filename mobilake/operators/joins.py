"""Joins of facts to dimensions and of times to times. [J1-J11]"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mobilake.operators.windows import keep_first


def lookup(df: DataFrame, dim: DataFrame, keys: Sequence[str], order: Sequence[Column] = ()) -> DataFrame:
    """Left join to a dimension, one row per key. [J1, J2, J9]

    The join strategy is Spark's: a dimension under the broadcast threshold is
    broadcast, at run time too, a larger one is shuffled.
    """
    one = keep_first(dim, keys, order or [F.col(c) for c in dim.columns])
    return df.join(one, list(keys), "left")


def code_lookup(c: Column, table: Mapping[str, str]) -> Column:
    """Literal table; unknown codes give null. [J3]"""
    return F.try_element_at(F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))]), c)


def keep_known(df: DataFrame, known: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left semi join. [J4, J5]"""
    return df.join(known.select(*keys), list(keys), "left_semi")


def with_both_ends(edges: DataFrame, nodes: DataFrame, src: str = "src", dst: str = "dst", key: str = "id") -> DataFrame:
    """Edges both of whose ends are nodes. [J10]"""
    n = nodes.select(F.col(key).alias("__n")).distinct()
    return edges.join(n, F.col(src) == F.col("__n"), "left_semi").join(n, F.col(dst) == F.col("__n"), "left_semi")


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, values: Sequence[str]) -> DataFrame:
    """Each left row with the values of the last right row at or before its time.

    Union and one running last value per key, no pairing of rows; both sides
    are split by key and day, and the last value of each earlier day is carried
    in through one row per key and day, so a hot key is not one group.
    """
    both = [*keys, "__t", "__left", "__v", "__row"]
    v = F.struct(*values)
    row_type = F.struct(*[F.col(f"`{c}`") for c in left.columns])
    lhs = left.select(*keys, F.col(left_time).alias("__t"), F.lit(1).alias("__left"), F.lit(None).cast(right.select(v.alias("v")).schema["v"].dataType).alias("__v"), row_type.alias("__row"))
    rhs = right.where(F.col(right_time).isNotNull()).select(*keys, F.col(right_time).alias("__t"), F.lit(0).alias("__left"), v.alias("__v"), F.lit(None).cast(lhs.schema["__row"].dataType).alias("__row"))
    u = lhs.select(*both).unionByName(rhs.select(*both)).withColumn("__d", F.to_date("__t"))
    w = Window.partitionBy(*keys, "__d").orderBy("__t", "__left").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    u = u.withColumn("__in", F.last("__v", ignorenulls=True).over(w))
    days = u.groupBy(*keys, "__d").agg(F.max_by("__v", F.when(F.col("__left") == 0, F.col("__t"))).alias("__end"))
    before = Window.partitionBy(*keys).orderBy("__d").rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumn("__carry", F.last("__end", ignorenulls=True).over(before))
    rows = u.where("__left = 1")
    on = [rows[k].eqNullSafe(days[k]) for k in (*keys, "__d")]
    j = rows.join(days, on, "left").select(rows["__row"], F.coalesce(rows["__in"], days["__carry"]).alias("__m"))
    return j.select("__row.*", *[F.col(f"__m.{c}").alias(f"{c}_asof" if c in left.columns else c) for c in values])


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], keep_when_null: Sequence[str] = ()) -> DataFrame:
    """Keyed merge: new values win, but where new is null in ``keep_when_null`` the old one stays. [J11, G6]"""
    cols = [c for c in old.columns if c not in keys]
    n = new.select(*keys, F.lit(True).alias("__new"), *[F.col(c).alias(f"__n_{c}") for c in cols])
    j = old.withColumn("__old", F.lit(True)).join(n, list(keys), "full_outer")
    pick = [F.when(F.col("__new").isNull(), F.col(c)).otherwise(F.coalesce(F.col(f"__n_{c}"), F.col(c)) if c in keep_when_null else F.col(f"__n_{c}")).alias(c) for c in cols]
    return j.select(*keys, *pick)
