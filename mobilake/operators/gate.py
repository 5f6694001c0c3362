"""Quality gate: rules with reasons, rejected rows kept. [F1]

A rule is a reason and a predicate that is true for bad rows. One projection
evaluates all rules; ``split`` gives the valid and the rejected rows of one
pass over the input.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mobilake.functions import times
from mobilake.functions.numbers import in_range
from mobilake.session import cut


@dataclass(frozen=True)
class Rule:
    """reason: name of the fault; bad: true where the row has it (null counts as no)."""

    reason: str
    bad: Column


def missing(name: str, column: str | None = None) -> Rule:
    c = F.col(column or name)
    return Rule(f"{name}_missing", c.isNull() | (c.cast("string") == ""))


def null(name: str, column: str | None = None) -> Rule:
    return Rule(f"{name}_missing", F.col(column or name).isNull())


def instant(name: str, optional: bool = False, zoned: bool = True) -> list[Rule]:
    """The text must be a full ISO time and, where zoned, carry an offset."""
    c = F.col(name)
    bad = ~times.iso_ok(c)
    rules = [Rule(f"{name}_unparseable", c.isNotNull() & bad) if optional else Rule(f"{name}_missing_or_unparseable", bad)]
    return rules + ([Rule(f"{name}_not_timezone_aware", times.iso_ok(c) & ~times.aware(c))] if zoned else [])


def date(name: str) -> Rule:
    return Rule(f"{name}_missing_or_unparseable", times.iso_date(F.col(name)).isNull())


def between(name: str, low: float | None, high: float | None, required: bool = False, suffix: str | None = None) -> Rule:
    c = F.col(name)
    return Rule(f"{name}_{suffix or ('missing_or_out_of_range' if required else 'out_of_range')}", ~in_range(c.cast("string").try_cast("double"), low, high, required))


def negative(name: str) -> Rule:
    return Rule(f"{name}_negative", F.col(name) < 0)


def one_of(name: str, values: Sequence[str], suffix: str = "missing_or_invalid") -> Rule:
    """Not in the set, or null. [F6]"""
    return Rule(f"{name}_{suffix}", F.coalesce(~F.col(name).isin(*values), F.lit(True)))


def blank(name: str, suffix: str = "missing") -> Rule:
    return Rule(f"{name}_{suffix}", F.coalesce(~F.col(name).rlike(r"[^\s\u00a0]"), F.lit(True)))


def exceeds(reason: str, parts: Sequence[str], whole: str) -> Rule:
    """Sum of the parts above the whole; nulls pass. [F7]"""
    total = F.col(parts[0])
    for p in parts[1:]:
        total = total + F.col(p)
    return Rule(reason, total > F.col(whole))


def with_reasons(df: DataFrame, rules: Sequence[Rule], to: str = "reasons") -> DataFrame:
    """df plus the array of reasons each row has."""
    return df.withColumn(to, F.array_compact(F.array(*[F.when(r.bad, F.lit(r.reason)) for r in rules])))


def split(df: DataFrame, rules: Sequence[Rule], unique: str | None = None, order: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected with reasons). ``unique``: of otherwise valid rows of one key exactly one stays, the first by ``order``.

    Ties (also all rows, where there is no order) are broken by a hash of the
    row, and equal rows by a number of their place in the input. The kept row
    is the least of these per key, found by a partial aggregate, so a key with a
    third of all rows is no sorted group. Rows whose key is null are one key. [T7, W5]
    """
    judged = with_reasons(df, rules)
    if unique:
        row = F.xxhash64(*[F.to_json(F.struct(F.col(f"`{c}`"))) for c in df.columns])
        judged = cut(judged.withColumn("__place", F.struct(*[F.col(c) for c in order], row.alias("__row"), F.monotonically_increasing_id().alias("__at"))), "judged")
        fine = F.size("reasons") == 0
        first = judged.where(fine).groupBy(F.col(unique).alias("__k")).agg(F.min("__place").alias("__first"))
        joined = judged.join(first, F.col(unique).eqNullSafe(F.col("__k")), "left")
        again = fine & (F.col("__place") != F.col("__first"))
        judged = joined.withColumn("reasons", F.when(again, F.array(F.lit("duplicate_exact_content"))).otherwise(F.col("reasons"))).drop("__k", "__first", "__place")
    return judged.where(F.size("reasons") == 0).drop("reasons"), judged.where(F.size("reasons") > 0)


def reason_counts(rejected: DataFrame) -> DataFrame:
    """(reason, rows)."""
    return rejected.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("rows"))
