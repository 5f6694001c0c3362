"""Problem 7: mixed timestamp formats and zones -> one instant in UTC.

Texts are parsed by an Arrow UDF over distinct values. For texts without a zone the
operator estimates, per source and week, which zone's offset history they were
written in: local times are aligned with the ingestion instant, and the history
with the fewest violations is chosen, with a price on every change of zone. What
violates is learned from the source itself: its texts that carry an offset, Z or
epoch show how long after their time records arrive, and a zone-less text whose
lag under a zone is rare among them violates (fully when it was never seen). A
source with fewer than ``LEARNED`` such texts falls back to what no source can
show, readings later than their ingestion; of such a source only zones east of
the declared one can be seen. The declared zone is kept unless another one removes violations on a clear share of
the rows. Then the wall clock is converted, and skipped or repeated times are
named instead of guessed.

Plan: one partial aggregation to (source, week, quarter hour of lag) counts,
lags beyond two days either way falling together; a dynamic programme over the
weeks of each source; the weeks in another zone than the declared one are joined
back on (source, week), so that a hot source is split by its weeks, and are
broadcast only after their rows were counted.

Edge cases: null or blank text has status ``missing``; unreadable text or a
date or time that does not exist ``invalid``; a wall clock inside a clock
change ``skipped`` or ``repeated``; all of them have a null instant. Extra and
clashing columns pass through (the operator adds only the names asked for and
uses a reserved prefix inside). Repeated rows are kept as they are; a null source
is a source of its own.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mobilake.functions import instants as I
from mobilake.session import BROADCAST_LIMIT_BYTES, cut

CANDIDATES = ("Europe/Madrid", "UTC", "Atlantic/Canary", "Europe/Helsinki")
LEARNED = 20  # texts with a zone that a source's own lags can be learned from
EDGE = 48 * 4  # quarter hours of lag; longer ones say nothing about a zone
RAREST = 1e-4  # share of lags below which a lag counts as never seen
_EPOCH = datetime(1970, 1, 1, 12)


def east_quarters(zone: str, week: int) -> int:
    """Offset of a zone in the middle of a week since 1970, in quarter hours east of UTC."""
    at = _EPOCH + timedelta(days=min(max(week, -100_000), 400_000) * 7 + 3)
    return round(at.replace(tzinfo=ZoneInfo(zone)).utcoffset().total_seconds() / 900)


def _rarity(zoned: pd.DataFrame) -> np.ndarray:
    """Cost of each lag from -EDGE to EDGE quarter hours, 0 (usual) to 1 (not seen or impossible)."""
    total = zoned["n"].sum()
    if total < LEARNED:
        return (np.arange(-EDGE, EDGE + 1) < -1).astype(float)
    seen = np.bincount(zoned["lag"].to_numpy() + EDGE, weights=zoned["n"].to_numpy(float), minlength=2 * EDGE + 1)
    near = np.convolve(seen, np.ones(5), mode="same") / total  # half an hour either way
    return np.log(np.clip(near, RAREST, 1)) / np.log(RAREST)


def zone_history(pdf: pd.DataFrame, zones: list[str], declared: str, switch_cost: float, evidence: float) -> pd.DataFrame:
    """Weeks and their zone for one source: least violations plus a price per change.

    pdf holds counts n by zoned, wk and lag; it is bounded by the number of
    weeks, whatever the number of rows.
    """
    cost_of = _rarity(pdf[pdf["zoned"]])
    naive = pdf[~pdf["zoned"]]
    weeks, at = np.unique(naive["wk"].to_numpy(), return_inverse=True)
    if not len(weeks):
        return pd.DataFrame(columns=["src", "wk", "zone"], dtype=object)
    n = np.bincount(at, weights=naive["n"].to_numpy(float))
    cost = np.empty((len(weeks), len(zones)))
    for i, z in enumerate(zones):
        east = np.array([east_quarters(z, int(w)) for w in weeks])
        lag = np.clip(naive["lag"].to_numpy() + east[at], -EDGE, EDGE)
        cost[:, i] = np.bincount(at, weights=naive["n"].to_numpy(float) * cost_of[lag + EDGE])
    home = zones.index(declared)
    cost += np.where(np.arange(len(zones)) == home, 0.0, 1.0) * (evidence * n)[:, None]
    total, back = cost[0].copy(), []
    price = switch_cost * max(1.0, float(np.median(n)))
    for row in cost[1:]:
        stay, move = total, total.min() + price
        back.append(np.where(stay <= move, np.arange(len(zones)), int(total.argmin())))
        total = np.minimum(stay, move) + row
    path = [home if total[home] <= total.min() else int(total.argmin())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    path.reverse()
    # weeks without rows to learn from belong to the stretch around them
    stretch = np.cumsum(np.r_[0, np.diff(path) != 0])
    rows = [(w, zones[path[k[0]]]) for k in (np.flatnonzero(stretch == j) for j in range(stretch[-1] + 1)) if path[k[0]] != home for w in range(int(weeks[k[0]]), int(weeks[k[-1]]) + 1)]
    return pd.DataFrame([(pdf["src"].iloc[0], w, z) for w, z in rows], columns=["src", "wk", "zone"], dtype=object)


def _week(us: Column) -> Column:
    return F.floor(F.floor(us / 86_400_000_000) / 7).cast("int")


def estimate_zones(parsed: DataFrame, source: Column, ingested_us: Column, declared: str, candidates: Iterable[str] = CANDIDATES, switch_cost: float = 0.5, evidence: float = 0.2) -> DataFrame:
    """(src, wk, zone): weeks in which a source's zone-less texts were written in another zone than the declared one.

    ``parsed`` has column ``__p`` (parse_local).
    """
    zones = [declared, *[z for z in candidates if z != declared]]
    p = F.col("__p")
    zoned = (p["form"] == "epoch") | p["offset_min"].isNotNull()
    known = p["form"].isin("clock", "epoch") & ingested_us.isNotNull() & (zoned | p["region"].isNull())
    written = p["wall_us"] - F.coalesce(p["offset_min"], F.lit(0)).cast("bigint") * 60_000_000
    lag = F.floor((ingested_us - written) / 900_000_000)
    far = F.when(zoned, F.lit(EDGE)).otherwise(F.lit(EDGE + 16))  # naive lags still lack their zone's offset
    counts = parsed.where(known).select(source.alias("src"), zoned.alias("zoned"), F.when(zoned, F.lit(0)).otherwise(_week(p["wall_us"])).alias("wk"), F.greatest(-far, F.least(far, lag)).cast("int").alias("lag"))
    counts = counts.groupBy("src", "zoned", "wk", "lag").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("src").applyInPandas(lambda pdf: zone_history(pdf, zones, declared, switch_cost, evidence), "src string, wk int, zone string")


def normalise(df: DataFrame, text: str, declared: str = "Europe/Madrid", source: str | None = None, ingested: str | None = None, instant: str = "instant_utc", status: str = "instant_status", zone_used: str | None = None, broadcast_limit: int = BROADCAST_LIMIT_BYTES, **estimate) -> DataFrame:
    """df plus the instant (timestamp_ntz, UTC) and its status.

    With ``ingested`` (an ISO text column) zone-less texts are aligned with the
    ingestion; without it the declared zone holds.
    """
    zone, d = F.lit(declared), df
    if ingested:
        src = (F.col(source) if source else F.lit("")).cast("string")
        p = d.withColumn("__p", I.parse_local(F.col(text)))
        hist = cut(estimate_zones(p.select("__p", src.alias("__src"), I.iso_us(F.col(ingested)).alias("__ing")), F.col("__src"), F.col("__ing"), declared, **estimate), "zones")
        rows = hist.count()
        if rows:  # without any such week the declared zone holds for all rows and there is nothing to join
            weeks = hist.select(F.col("src").alias("__hs"), F.col("wk").alias("__hw"), F.col("zone").alias("__hz"))
            weeks = F.broadcast(weeks) if rows * 100 <= broadcast_limit else weeks
            d = p.withColumns({"__src": src, "__wk": _week(F.col("__p")["wall_us"])})
            d = d.join(weeks, F.col("__src").eqNullSafe(F.col("__hs")) & (F.col("__wk") == F.col("__hw")), "left")
            zone = F.coalesce("__hz", F.lit(declared))
    d = d.withColumn("__zone", zone).withColumn("__i", I.to_instant(F.col(text).cast("string"), F.col("__zone")))
    d = d.withColumns({status: F.col("__i")["status"], instant: I.from_epoch_us(F.col("__i")["utc_us"])})
    if zone_used:
        d = d.withColumn(zone_used, F.col("__zone"))
    return d.drop(*[c for c in d.columns if c.startswith("__")])
