"""Observational expectations in a single pass. [survey 2.9]"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Expectation:
    """name and column of the report row; bad: true for an unexpected value; nulls: whether nulls are judged."""

    name: str
    column: str
    bad: Column
    judges_null: bool = False


def not_null(c: str) -> Expectation:
    return Expectation("not_null", c, F.col(c).isNull(), True)


def between(c: str, low: float | None = None, high: float | None = None) -> Expectation:
    v, bad = F.col(c), F.lit(False)
    if low is not None:
        bad = bad | (v < low)
    if high is not None:
        bad = bad | (v > high)
    return Expectation("between", c, bad)


def in_set(c: str, values: Sequence) -> Expectation:
    return Expectation("in_set", c, ~F.col(c).isin(*values))


def matches(c: str, pattern: str) -> Expectation:
    return Expectation("regex", c, ~F.col(c).rlike(pattern))


def pair_at_least(a: Column, b: Column, name: str) -> Expectation:
    """a >= b, compared as what the columns are (dates as dates). [N14]"""
    return Expectation("pair_at_least", name, a < b)


def unique(c: str) -> Expectation:
    return Expectation("unique", c, F.lit(None).cast("boolean"))


def report(df: DataFrame, suite: Sequence[Expectation]) -> DataFrame:
    """One row per expectation: expectation, column, element_count, unexpected_count, success.

    All row-wise expectations are one aggregation; each unique one adds a
    count of its keys. The result has as many rows as the suite.
    """
    plain = [e for e in suite if e.name != "unique"]
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, e in enumerate(plain):
        aggs.append(F.coalesce(F.sum(F.when(e.bad, 1).otherwise(0)), F.lit(0)).cast("bigint").alias(f"u{i}"))
    rows = [F.struct(F.lit(e.name).alias("expectation"), F.lit(e.column).alias("column"), F.col("n").alias("element_count"), F.col(f"u{i}").alias("unexpected_count")) for i, e in enumerate(plain)]
    out = df.agg(*aggs).select(F.explode(F.array(*rows)).alias("r")).select("r.*") if rows else None
    for e in suite:
        if e.name == "unique":
            per = df.where(F.col(e.column).isNotNull()).groupBy(e.column).agg(F.count(F.lit(1)).alias("k"))
            one = per.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("element_count"), F.coalesce(F.sum(F.when(F.col("k") > 1, F.col("k")).otherwise(0)), F.lit(0)).alias("unexpected_count"))
            one = one.select(F.lit("unique").alias("expectation"), F.lit(e.column).alias("column"), "element_count", "unexpected_count")
            out = one if out is None else out.unionByName(one)
    return out.withColumn("success", F.col("unexpected_count") == 0)
