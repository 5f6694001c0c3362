"""Roll-ups to a calendar grain. [A1-A15]

Everything is one groupBy with declarative aggregates, so Spark combines on
the map side. "First" attributes are the earliest non-null value by (instant,
tie), never the order rows happen to arrive in. [N1, N2]
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def truthy(c: Column) -> Column:
    """Null and empty text become null. [N5-N7]"""
    return F.when(c.cast("string") != "", c)


def sentinel(c: Column, label: str) -> Column:
    """A group key that is never null or empty. [A11]"""
    return F.coalesce(truthy(c), F.lit(label))


def earliest(c: Column, *order: Column) -> Column:
    """Earliest non-null value. [A4]"""
    return F.min_by(c, F.when(c.isNotNull(), F.struct(*order, c)))


def first_by(c: Column, instant: Column) -> Column:
    """Value at the least instant, ties by value. [A5]"""
    return F.min_by(c, F.when(instant.isNotNull(), F.struct(instant, c)))


def last_by(c: Column, instant: Column) -> Column:
    """Value at the greatest instant, ties by value. [A5, A16]"""
    return F.max_by(c, F.when(instant.isNotNull(), F.struct(instant, c)))


def total(c: Column) -> Column:
    """Sum with null as 0. [A7]"""
    return F.coalesce(F.sum(c), F.lit(0))


def distinct_count(c: Column, when: Column | None = None) -> Column:
    """Distinct non-empty values, of rows where ``when`` holds. [A8, A9]"""
    v = truthy(c)
    return F.count_distinct(v if when is None else F.when(when, v))


def distinct_list(c: Column) -> Column:
    """Sorted distinct non-empty values. [A10]"""
    return F.sort_array(F.collect_set(truthy(c)))


def energetic_mean(c: Column) -> Column:
    """Mean level of decibels by energy. [N17]"""
    return 10 * F.log10(F.avg(F.pow(F.lit(10.0), c / 10)))


def rollup(df: DataFrame, keys: Sequence[str | Column], measures: Mapping[str, Column], required: Sequence[str] = ()) -> DataFrame:
    """Group by keys; rows whose required keys are null or empty are left out. [F19]"""
    for k in required:
        df = df.where(truthy(F.col(k)).isNotNull())
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("samples_count"), *[m.alias(n) for n, m in measures.items()])


def calendar_rolling(df: DataFrame, keys: Sequence[str], day: Column, value: str, days: int, mean: str, count: str) -> DataFrame:
    """Trailing mean over calendar days by a range frame on the day number, with the number of days that count. [W1, W2, D15]"""
    w = Window.partitionBy(*keys).orderBy(F.unix_date(day)).rangeBetween(-(days - 1), 0)
    return df.withColumns({mean: F.avg(value).over(w), count: F.count(value).over(w)})
