"""Problem 5: implausible readings, per source and relative to its own behaviour.

A robust exponentially weighted control chart runs over every series (and,
where asked, every hour slot of it). Its scale starts from the series' own
moving ranges (the median step between successive readings), a suspected value
is clipped to the control limit before it updates mean and scale, and a reading
is a spike when it lies more than ``width`` of these scales from the mean. So
what is a spike for a quiet source may be usual for a lively one; the only
constant in decibels, degrees or counts is ``finest``, the scale below which a
sensor of its kind cannot tell readings apart (for counts also the noise of
counting itself, one over the root of the mean). The chart runs forward and
backward and a reading is a spike only if both call it one, which spares level
shifts and starts. Run-length counters find stuck values, physical limits the
impossible ones.

Plan: impossible values are found natively and leave at once. The others are
reduced to distinct (series, time, value) with partial aggregation, so repeated
rows cost nothing, and go to the task of their series in order of time; a task
charts them in blocks of whole series, each block one matrix walked once per
time step. A series is walked from its first reading to its last, whatever its
length: it is bounded by its calendar (one hour slot a day) and the values that
its sensor shows, not by its rows. The few flagged readings are joined back.

Edge cases: null values are never cases; NaN and infinite values are
``impossible``; rows whose time is unknown are spikes if they lie beyond the
limits of every time of their series, and count in no run; a series shorter than
five readings has no chart, only limits; of several values at one time each can
carry on a stretch of stuck values, and impossible ones do not end it;
null series keys form a series of their own; empty tables give no rows.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Chart:
    """Settings of one measurement.

    low/high: physical limits. finest: least scale of the chart, near what the
    sensor can resolve (for counts on the logarithmic scale). width: limits in
    scales of the series; width_down: those below, where they differ (small
    counts scatter further down than up on the logarithmic scale). alpha: weight of a new reading. slots: slots of a
    day. log: counts, charted as log(1 + count). run: readings in a row with
    one value other than zero (0: not asked).
    """

    low: float
    high: float
    finest: float
    width: float
    alpha: float = 0.1
    slots: int = 1
    log: bool = False
    run: int = 0
    width_down: float | None = None


CLIP = 2.5  # suspected values move the chart by so many scales at most
SEEN = 5  # readings that a chart needs
BLOCK_ROWS, BLOCK_CELLS = 100_000, 8_000_000


def _quiet_median(a: np.ndarray) -> np.ndarray:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return np.nanmedian(a, axis=0)


def _least(mean: np.ndarray, c: Chart) -> np.ndarray | float:
    """The scale below which nothing can be told apart."""
    return np.maximum(c.finest, 1 / np.sqrt(np.maximum(np.expm1(mean), 0) + 1)) if c.log else c.finest


def own_scale(m: np.ndarray) -> np.ndarray:
    """Scale of every column: the median step between successive readings, as the deviation of a normal series with such steps."""
    last, steps = np.full(m.shape[1], np.nan), np.full_like(m, np.nan)
    for t in range(len(m)):
        seen = ~np.isnan(m[t])
        steps[t] = np.where(seen, np.abs(m[t] - last), np.nan)
        last = np.where(seen, m[t], last)
    return np.nan_to_num(_quiet_median(steps) / 0.954)


def _walk(m: np.ndarray, c: Chart, usual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The chart along axis 0: mean and scale of every column as they stand before each step."""
    k = np.cumsum(~np.isnan(m), axis=0)
    mean = np.nan_to_num(_quiet_median(np.where((k <= 15) & ~np.isnan(m), m, np.nan)))
    s = usual.copy()
    means, scales = np.empty_like(m), np.empty_like(m)
    for t in range(len(m)):
        e = np.maximum(s, _least(mean, c))
        means[t], scales[t] = mean, np.maximum(e, usual)
        seen = ~np.isnan(m[t])
        clipped = np.clip(np.where(seen, m[t] - mean, 0.0), -CLIP * e, CLIP * e)
        mean = mean + c.alpha * clipped
        s = np.where(seen, (1 - c.alpha / 2) * s + c.alpha / 2 * 1.6 * np.abs(clipped), s)
    return means, scales


def _stuck(code: np.ndarray, t: np.ndarray, v: np.ndarray, run: int) -> np.ndarray:
    """Readings in stretches of one value other than zero; rows come in order of (series, t, v).

    The walk is by distinct time: of several values at one time each carries on its own run.
    """
    at = np.cumsum(np.r_[True, (code[1:] != code[:-1]) | (t[1:] != t[:-1])])
    o = np.lexsort((at, v, code))
    c, at, x = code[o], at[o], v[o]
    new = np.r_[True, (c[1:] != c[:-1]) | (x[1:] != x[:-1]) | (np.diff(at) > 1)]
    of = np.cumsum(new) - 1
    fresh = np.r_[True, (at[1:] != at[:-1]) | new[1:]]
    out = np.zeros(len(v), bool)
    out[o] = (np.bincount(of, weights=fresh)[of] >= run) & (x != 0)
    return out


def chart_block(pdf: pd.DataFrame, c: Chart) -> pd.DataFrame:
    """Whole series, in order of (series, t, v), with columns series, t, step, slot, v, placed -> flagged readings."""
    code, _ = pd.factorize(pdf["series"], use_na_sentinel=False)
    placed = pdf["placed"].to_numpy(bool)
    step, slot = pdf["step"].to_numpy(), pdf["slot"].to_numpy()
    # a step's place among the steps of its series, so that a gap or a far-off date takes no room
    o = np.lexsort((step, code))
    fresh = np.r_[True, (code[o][1:] != code[o][:-1]) | (step[o][1:] != step[o][:-1])]
    rank = np.cumsum(fresh)
    first = np.r_[True, code[o][1:] != code[o][:-1]]
    at = np.empty(len(pdf), np.int64)
    at[o] = rank - np.maximum.accumulate(np.where(first, rank, 0))
    n_series = int(code.max()) + 1
    if (int(at.max()) + 1) * n_series * c.slots > BLOCK_CELLS and n_series > 1:
        half = code < n_series // 2
        return pd.concat([chart_block(pdf[half].reset_index(drop=True), c), chart_block(pdf[~half].reset_index(drop=True), c)])
    v = pdf["v"].to_numpy(float)
    x = np.log1p(np.maximum(v, 0)) if c.log else v
    col = code * c.slots + slot
    m = np.full((int(at.max()) + 1, n_series * c.slots), np.nan)
    ix = np.flatnonzero(placed)
    usual = pd.Series(x[ix]).groupby(col[ix]).transform("median").to_numpy()
    ix = ix[np.argsort(-np.abs(x[ix] - usual), kind="stable")]
    m[at[ix], col[ix]] = x[ix]  # where one time has several values the most usual one leads
    own = own_scale(m)
    (fm, fs), (bm, bs) = _walk(m, c, own), (w[::-1] for w in _walk(m[::-1], c, own))
    n = (~np.isnan(m)).sum(axis=0)
    down = c.width if c.width_down is None else c.width_down
    over, under = np.maximum(fm + c.width * fs, bm + c.width * bs), np.minimum(fm - down * fs, bm - down * bs)
    spike = placed & (n[col] >= SEEN) & ((x > over[at, col]) | (x < under[at, col]))
    if not placed.all():
        # whatever the series takes for usual at some time of some slot
        ever = lambda a, f, none: f(np.where(np.isnan(m), none, a).reshape(len(m), n_series, -1), axis=(0, 2))
        enough = n.reshape(n_series, c.slots).sum(axis=1) >= SEEN
        spike |= ~placed & enough[code] & ((x > ever(over, np.max, -np.inf)[code]) | (x < ever(under, np.min, np.inf)[code]))
    stuck = np.zeros(len(pdf), bool)
    if c.run and placed.any():
        stuck[placed] = _stuck(code[placed], pdf["t"].to_numpy()[placed], v[placed], c.run)
    hit = spike | stuck
    return pd.DataFrame({"series": pdf["series"][hit], "t": pdf["t"][hit], "v": v[hit], "placed": placed[hit], "reason": np.where(stuck[hit], "stuck", "spike")})


def _blocks(c: Chart):  # noqa: ANN202
    """mapInPandas function: rows in order of series -> blocks of whole series, charted."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        rows, most = 0, BLOCK_ROWS
        for p in parts:
            if not len(p):
                continue
            held.append(p)
            rows += len(p)
            if rows < most:
                continue
            d = pd.concat(held, ignore_index=True)
            last = d["series"].iloc[-1]
            cut = int((d["series"] != last).sum())
            if cut:
                yield chart_block(d[:cut].reset_index(drop=True), c)
            held, rows = [d[cut:]], len(d) - cut
            most = max(BLOCK_ROWS, 2 * rows)
        if held:
            yield chart_block(pd.concat(held, ignore_index=True), c)

    return run


def flag(df: DataFrame, row_id: str, series: Column, value: Column, step: Column, slot: Column, order: Column, chart: Chart) -> DataFrame:
    """(row_id, reason) of the implausible rows of df.

    step: day number or null when the time is unknown; slot: 0 to slots - 1;
    order: bigint time.
    """
    v = value.cast("double")
    placed = step.isNotNull()
    rows = df.where(value.isNotNull()).select(
        F.col(row_id).alias("row_id"), F.coalesce(series, F.lit("\u0000")).alias("series"), v.alias("v"), placed.alias("placed"),
        F.coalesce(step, F.lit(0)).cast("int").alias("step"), F.when(placed, F.coalesce(slot, F.lit(0))).otherwise(0).cast("int").alias("slot"), F.when(placed, F.coalesce(order, F.lit(0))).otherwise(0).cast("bigint").alias("t"),
    )
    possible = v.between(chart.low, chart.high) & ~F.isnan(v)
    odd = df.where(value.isNotNull() & ~possible).select(F.col(row_id).alias("row_id"), F.lit("impossible").alias("reason"))
    rows = rows.where(F.col("v").between(chart.low, chart.high) & ~F.isnan("v"))
    distinct = rows.select("series", "t", "v", "placed", "step", "slot").distinct()
    flagged = distinct.repartition("series").sortWithinPartitions("series", "t", "v").mapInPandas(_blocks(chart), "series string, t bigint, v double, placed boolean, reason string")
    flagged = flagged.groupBy("series", "t", "v", "placed").agg(F.min("reason").alias("reason"))
    r = rows.alias("r").join(flagged.alias("f"), [F.col("r.series") == F.col("f.series"), F.col("r.t") == F.col("f.t"), F.col("r.v") == F.col("f.v"), F.col("r.placed") == F.col("f.placed")])
    return r.select("r.row_id", "f.reason").unionByName(odd)
