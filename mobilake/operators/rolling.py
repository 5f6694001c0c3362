"""Problem 1: totals and averages over trailing calendar periods.

Readings are pre-aggregated to one row per entity and day (map-side combine),
so the window that follows holds at most one row per calendar day of an
entity, however many readings a hot entity has. A running prefix (sum, count)
is forward-filled over the days up to the next reading, and the total of a
trailing period is the difference of two prefix values found by ``lag`` over
the dense days: one shuffle for the aggregation, one sort, no self join.

Edge cases: days before the first day are empty; the sum of an empty period is
0 and its average null; null values and days that are no valid YYYY-MM-DD date
are no readings; entities without any reading do not appear; a null entity is an
entity of its own. Values that a decimal of 12 digits and 18 decimals holds
exactly (as they are written) are summed as such, so differences of prefixes
carry no floating-point residue; the others, also NaN and infinite ones, are
added as doubles over the period itself and never enter a prefix, so they
change the periods that hold them and no other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EXACT = "decimal(30,18)"


def valid_day(text: Column) -> Column:
    """YYYY-MM-DD text -> date, null when it is anything else or no date."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))


def daily_prefix(df: DataFrame, entity: str, day: Column, value: str) -> DataFrame:
    """(entity, day, n_day, rough_day, s, n): dense days with forward-filled prefixes of sums and counts."""
    v = F.col(value).cast("double")
    exact = v.try_cast(EXACT)
    fits = F.coalesce(exact.cast("double") == v, F.lit(False))
    daily = (
        df.select(F.col(entity).alias("entity"), day.alias("day"), v.alias("v"), F.when(fits, exact).alias("x"))
        .where(F.col("v").isNotNull() & F.col("day").isNotNull())
        .groupBy("entity", "day")
        .agg(F.coalesce(F.sum("x"), F.lit(0).cast(EXACT)).alias("s_day"), F.sum(F.when(F.col("x").isNull(), F.col("v"))).alias("rough_day"), F.count(F.lit(1)).alias("n_day"))
    )
    w = Window.partitionBy("entity").orderBy("day")
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    until = F.coalesce(F.date_sub(F.lead("day").over(w), 1), F.col("day"))
    here = lambda c: F.when(F.col("d") == F.col("day"), F.col(c))
    return (
        daily.withColumns({"s": F.sum("s_day").over(run).cast("decimal(38,18)"), "n": F.sum("n_day").over(run), "until": until})
        .withColumn("d", F.explode(F.sequence("day", "until")))
        .select("entity", F.col("d").alias("day"), F.coalesce(here("n_day"), F.lit(0)).alias("n_day"), here("rough_day").alias("rough_day"), "s", "n")
    )


def trailing(df: DataFrame, entity: str, day: Column, value: str, periods: Sequence[int] = (7, 30)) -> DataFrame:
    """One row per entity and calendar day: n_P, total_P and avg_P for each period P in days."""
    w = Window.partitionBy("entity").orderBy("day")
    out = daily_prefix(df, entity, day, value)
    cols = {}
    for p in periods:
        n = F.col("n") - F.coalesce(F.lag("n", p).over(w), F.lit(0))
        exact = F.col("s") - F.coalesce(F.lag("s", p).over(w), F.lit(0).cast("decimal(38,18)"))
        rough = F.sum("rough_day").over(w.rowsBetween(-(p - 1), 0))
        total = exact.cast("double") + F.coalesce(rough, F.lit(0.0))
        cols |= {f"n_{p}": n, f"total_{p}": total, f"avg_{p}": F.when(n > 0, total / n)}
    out = out.withColumns(cols)
    return out.select(F.col("entity").alias(entity), "day", *cols)


def empty_periods(df: DataFrame, entity: str, day: Column, value: str, periods: Sequence[int] = (1, 7, 30)) -> DataFrame:
    """(entity, day, period_days): trailing periods, ending on a day of the entity's span, without readings."""
    t = trailing(df, entity, day, value, periods)
    pairs = F.filter(F.array(*[F.when(F.col(f"n_{p}") == 0, F.lit(p).cast("bigint")) for p in periods]), lambda x: x.isNotNull())
    return t.select(F.col(entity), F.date_format("day", "yyyy-MM-dd").alias("day"), F.explode(pairs).alias("period_days"))
