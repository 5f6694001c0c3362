"""The core problems' operators: brute force, edge cases, empty tables, clashing columns."""

import json
import math
import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from mobilake.functions import instants as I
from mobilake.operators import compaction, drift, instants, rolling, spatial, spikes

RUIDO = "station_id string, measured_date string, laeq_db double"


def _day():
    return rolling.valid_day(F.col("measured_date"))


def test_rolling_against_brute_force(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice("ABC"), str(date(2025, 1, 1) + timedelta(rnd.randrange(90))), round(rnd.uniform(40, 80), 1)) for _ in range(150)]
    rows += rows[:5] + [("A", "2025-02-30", 50.0), ("A", None, 50.0), ("B", "2025-01-10", None), ("Z", "2025-1-1", 3.0), (None, "2025-01-05", 60.0)]
    df = spark.createDataFrame(rows, RUIDO)
    got = {(r.station_id, r.day): r for r in rolling.trailing(df, "station_id", _day(), "laeq_db").collect()}
    by = {}
    for s, d, v in rows:
        if d and len(d) == 10 and d != "2025-02-30" and v is not None:
            by.setdefault(s, []).append((date.fromisoformat(d), v))
    expected = set()
    for s, x in by.items():
        lo, hi = min(d for d, _ in x), max(d for d, _ in x)
        for k in range((hi - lo).days + 1):
            day = lo + timedelta(k)
            expected.add((s, day))
            for p in (7, 30):
                v = [v for d, v in x if day - timedelta(p) < d <= day]
                r = got[(s, day)]
                assert r[f"n_{p}"] == len(v) and r[f"total_{p}"] == pytest.approx(sum(v)) and (r[f"avg_{p}"] is None) == (not v)
    assert set(got) == expected


def test_rolling_odd_values_and_empty(spark):
    df = spark.createDataFrame([("A", "2025-01-01", float("nan")), ("A", "2025-01-09", 1e300), ("A", "2025-01-20", 50.0)], RUIDO)
    r = {x.day.isoformat(): x for x in rolling.trailing(df, "station_id", _day(), "laeq_db").collect()}
    assert math.isnan(r["2025-01-01"].total_7) and r["2025-01-01"].n_7 == 1 and r["2025-01-08"].total_7 == 0.0 and r["2025-01-20"].total_7 == 50.0
    assert r["2025-01-09"].total_7 == 1e300 and r["2025-01-15"].total_7 == 1e300 and r["2025-01-16"].total_7 == 0.0
    big = spark.createDataFrame([("A", "2025-01-01", 5e12), ("A", "2025-01-02", 1e-20), ("A", "2025-01-03", 0.1234567890123), ("A", "2025-01-12", 0.3)], RUIDO)
    r = {x.day.isoformat(): x for x in rolling.trailing(big, "station_id", _day(), "laeq_db").collect()}
    assert r["2025-01-07"].total_7 == pytest.approx(5e12 + 0.1234567890123) and r["2025-01-09"].total_7 == 0.1234567890123 and r["2025-01-12"].avg_7 == 0.3
    none = spark.createDataFrame([], RUIDO)
    assert rolling.empty_periods(none, "station_id", _day(), "laeq_db").count() == 0
    found = rolling.empty_periods(df, "station_id", _day(), "laeq_db").where("period_days = 7").collect()
    assert {x.day for x in found} == {"2025-01-08", "2025-01-16", "2025-01-17", "2025-01-18", "2025-01-19"}


def test_instants(spark):
    cases = {
        "2025-03-30T02:30:00": ("skipped", None),
        "26/10/2025 02:15": ("repeated", None),
        "2025-10-26 02:15:00 CEST": ("ok", "2025-10-26T00:15:00"),
        "2025-10-26T02:15:00[Europe/Madrid]": ("repeated", None),
        "1 de marzo de 2025, 23:15 h": ("ok", "2025-03-01T22:15:00"),
        "8-abr-2025 0:30": ("ok", "2025-04-07T22:30:00"),
        "20250401T195249+0200": ("ok", "2025-04-01T17:52:49"),
        "1745445600000": ("ok", "2025-04-23T22:00:00"),
        "1751061600": ("ok", "2025-06-27T22:00:00"),
        "2025-09-12 17:00:00.000": ("ok", "2025-09-12T15:00:00"),
        "2025-04-11T10:30:00.250000+02:00": ("ok", "2025-04-11T08:30:00.250000"),
        "2025-15-15T13:21:00": ("invalid", None),
        "31/06/2025 10:00": ("invalid", None),
        "2025-07-22 20:75:00": ("invalid", None),
        "2025-11-14T36:00:00+01:00": ("invalid", None),
        "2O25-06-05T18:30:00": ("invalid", None),
        "2025-01-01": ("invalid", None),
        "2025-01-01 10:00 XYZ": ("invalid", None),
        "2025-01-01T10:00[Mars/Base]": ("invalid", None),
        "  ": ("missing", None),
        "x" * 100_000: ("invalid", None),
    }
    rows = [(k, 1, "keep") for k in cases] + [(None, 1, "keep")]
    df = spark.createDataFrame(rows, "t string, instant int, status string")
    out = instants.normalise(df, "t", instant="u", status="s").collect()
    assert len(out) == len(rows) and out[0]["status"] == "keep" and out[0]["instant"] == 1
    for r in out:
        s, u = cases.get(r.t, ("missing", None))
        assert (r.s, r.u.isoformat() if r.u else None) == (s, u), r.t
    assert instants.normalise(spark.createDataFrame([], "t string"), "t").count() == 0


def _feed(name, base, weeks, east, per_week=20, zoned=0):
    """Readings every six hours, seen seven minutes later; ``zoned`` of each week's texts carry an offset."""
    rows = []
    for week in weeks:
        for k in range(per_week):
            utc = base + timedelta(weeks=week, hours=4 + k * 6)
            seen = (utc + timedelta(minutes=7)).strftime("%Y-%m-%dT%H:%M:%S+00:00")
            text = utc.strftime("%Y-%m-%dT%H:%M:%SZ") if k < zoned else (utc + timedelta(hours=east(week))).strftime("%Y-%m-%dT%H:%M:%S")
            rows.append((name, week, text, seen, utc))
    return rows


FEED = "source string, week int, t string, seen string, utc timestamp_ntz"


def test_zone_is_estimated_from_ingestion(spark):
    base, weeks = datetime(2025, 5, 8), range(15)  # weeks count from a Thursday; all of summer time
    rows = _feed("utc", base, weeks, lambda w: 0, zoned=4) + _feed("canary", base, weeks, lambda w: 1, zoned=4) + _feed("madrid", base, weeks, lambda w: 2, zoned=4)
    rows += _feed("east", base, weeks, lambda w: 3, zoned=4) + _feed("east-unlearned", base, weeks, lambda w: 3) + _feed("madrid-unlearned", base, weeks, lambda w: 2) + _feed(None, base, weeks, lambda w: 0, zoned=4)
    df = spark.createDataFrame(rows, FEED)
    out = instants.normalise(df, "t", source="source", ingested="seen", zone_used="z").collect()
    assert len(out) == len(rows) and all(r.instant_utc == r.utc for r in out)
    z = {r.source: r.z for r in out if not r.t.endswith("Z")}
    assert z == {"utc": "UTC", "canary": "Atlantic/Canary", "madrid": "Europe/Madrid", "east": "Europe/Helsinki", "east-unlearned": "Europe/Helsinki", "madrid-unlearned": "Europe/Madrid", None: "UTC"}


def test_zone_history_keeps_the_stretch_between(spark):
    base = datetime(2025, 5, 8)
    rows = _feed("utc-madrid-utc", base, range(20), lambda w: 2 if 6 <= w < 14 else 0, zoned=4) + _feed("east-madrid-east", base, range(20), lambda w: 2 if 6 <= w < 14 else 3)
    df = spark.createDataFrame(rows, FEED)
    for limit in (1 << 20, 0):
        out = instants.normalise(df, "t", source="source", ingested="seen", broadcast_limit=limit).collect()
        assert len(out) == len(rows) and all(r.instant_utc == r.utc for r in out)


def _hav(a, b):
    x = math.sin(math.radians(b[0] - a[0]) / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6_371_000 * math.asin(math.sqrt(x))


def test_near_against_brute_force(spark):
    rnd = random.Random(2)
    pts = [(f"p{i}", 40.4 + rnd.gauss(0, 0.0006), -3.7 + rnd.gauss(0, 0.0006)) for i in range(250)]
    pts += [pts[0], ("p1", *pts[0][1:]), ("n", None, -3.7), ("m", float("nan"), -3.7)]
    df = spark.createDataFrame(pts, "id string, lat double, lon double")
    got = {(r.left_id, r.right_id) for r in spatial.near(df, "id", F.col("lat"), F.col("lon"), 20.0).collect()}
    ok = [p for p in pts if p[1] is not None and p[1] == p[1]]
    want = {tuple(sorted((a[0], b[0]))) for a in ok for b in ok if a[0] != b[0] and _hav(a[1:], b[1:]) <= 20}
    assert got == want


def test_near_at_poles_date_line_and_equator(spark):
    rnd = random.Random(12)
    pts = [(f"a{i}", 64 + rnd.gauss(0, 0.0003), 25 + rnd.gauss(0, 0.0006)) for i in range(60)]
    pts += [(f"b{i}", rnd.gauss(0, 0.0003), (180 + rnd.gauss(0, 0.0003) + 180) % 360 - 180) for i in range(60)]
    pts += [(f"c{i}", 90 - abs(rnd.gauss(0, 0.0003)), rnd.uniform(-180, 180)) for i in range(60)]
    pts += [("d1", -90.0, 12.0), ("d2", -90.0, -100.0), ("e1", 5.0, 180.0), ("e2", 5.0, -180.0), ("f", 91.0, 0.0)]
    df = spark.createDataFrame(pts, "id string, lat double, lon double")
    spots, members = spatial.places(df, "id", F.col("lat"), F.col("lon"))
    want = {tuple(sorted((a[0], b[0]))) for a in pts for b in pts if a[0] < b[0] and a[1] <= 90 and b[1] <= 90 and _hav(a[1:], b[1:]) <= 30}
    assert {(r.left_id, r.right_id) for r in spatial.near(df, "id", F.col("lat"), F.col("lon"), 30.0).collect()} == want and len(want) > 300
    # split cells give the same pairs
    assert {(tuple(r.a), tuple(r.b)) for r in spatial.near_places(spots, 30.0, split=2).collect()} == {(tuple(r.a), tuple(r.b)) for r in spatial.near_places(spots, 30.0).collect()}


def test_near_with_many_ids_on_one_spot(spark):
    n = 100_000
    df = spark.range(n).select(F.format_string("p%06d", "id").alias("id"), F.lit(40.4).alias("lat"), F.lit(-3.7).alias("lon")).union(spark.createDataFrame([("q", 40.4001, -3.7), ("r", 40.5, -3.7)], "id string, lat double, lon double"))
    pairs, members = spatial.near_classes(df, "id", F.col("lat"), F.col("lon"), 20.0)
    assert [(r.class_a, r.class_b) for r in pairs.collect()] == [("p000000", "q")]
    assert {r["class"]: r["count"] for r in members.groupBy("class").count().collect()} == {"p000000": n, "q": 1, "r": 1}


def test_within_holes_borders_and_copies(spark):
    square = [[[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [0.0, 4.0], [0.0, 0.0]], [[1.0, 1.0], [1.0, 3.0], [3.0, 3.0], [3.0, 1.0]]]
    multi = [[[[10.0, 0.0], [12.0, 0.0], [11.0, 2.0]]], [[[10.5, 0.5], [11.5, 0.5], [11.0, 1.0]]]]
    regions = spark.createDataFrame([("s", [square]), ("s", [square]), ("m", multi), ("x", None), ("y", [[[[0.0, 0.0], [1.0, 1.0]]]])], "k string, c array<array<array<array<double>>>>")
    pts = {"in": (0.5, 0.5), "hole": (2.0, 2.0), "edge": (0.0, 2.0), "corner": (0.0, 0.0), "vertexray": (1.0, 0.5), "both": (0.7, 11.0), "out": (5.0, 5.0)}
    df = spark.createDataFrame([(k, *v) for k, v in pts.items()] * 2, "id string, lat double, lon double")
    for limit in (1 << 20, 0):
        got = {(r.point_id, r.region_id) for r in spatial.within(df, "id", F.col("lat"), F.col("lon"), regions, "k", F.col("c"), 0.5, limit).collect()}
        assert got == {("in", "s"), ("edge", "s"), ("corner", "s"), ("vertexray", "s"), ("both", "m")}
    assert spatial.within(df.limit(0), "id", F.col("lat"), F.col("lon"), regions, "k", F.col("c")).count() == 0


def test_spikes(spark):
    rnd = random.Random(3)
    rows, bad = [], set()
    for s in ("a", "b", None):
        for k in range(200):
            rows.append((len(rows), s, k, 60 + rnd.gauss(0, 1.5)))
        for k, v in ((20, 99.0), (90, -99.9), (150, 25.0)):
            i = len(rows)
            rows.append((i, s, k, v))
            bad.add(i)
    rows += [(len(rows) + j, "a", 200 + j, 61.7) for j in range(9)]
    bad |= {r[0] for r in rows[-9:]}
    rows.append((len(rows), "a", 20, 99.0))
    bad.add(rows[-1][0])
    rows.append((len(rows), "a", None, float("nan")))
    bad.add(rows[-1][0])
    rows.append((len(rows), "a", None, 60.0))
    rows.append((len(rows), "a", 5, None))
    df = spark.createDataFrame(rows, "row_id bigint, s string, d int, v double")
    chart = spikes.Chart(low=15, high=140, finest=0.5, width=6, run=6)
    out = spikes.flag(df, "row_id", F.col("s"), F.col("v"), F.col("d"), F.lit(0), F.col("d"), chart)
    assert {r.row_id for r in out.collect()} == bad
    assert spikes.flag(df.limit(0), "row_id", F.col("s"), F.col("v"), F.col("d"), F.lit(0), F.col("d"), chart).count() == 0


def test_stuck_stretch_with_corrected_hours(spark):
    rnd = random.Random(15)
    usual = lambda lo, hi: [(k, 60 + rnd.gauss(0, 1.5)) for k in range(lo, hi)]
    stuck = [(40 + k, 61.7) for k in range(12)]
    # two values in one hour, before or after the stuck one in order, and an impossible one at its own time or beside it
    for extra in ([(45, 59.0)], [(45, 63.0)], [(45, -99.0)], [(45, 63.0), (46, 59.0), (46, 61.7)]):
        rows = [(i, k, v) for i, (k, v) in enumerate(usual(0, 40) + usual(52, 90) + extra + stuck)]
        pdf = spark.createDataFrame(rows, "row_id bigint, d int, v double")
        chart = spikes.Chart(low=15, high=140, finest=0.5, width=6, run=10)
        got = {r.row_id for r in spikes.flag(pdf, "row_id", F.lit("a"), F.col("v"), F.col("d"), F.lit(0), F.col("d"), chart).collect()}
        assert got == {i for i, k, v in rows if v in (61.7, -99.0)}
    rows = [(i, k, v) for i, (k, v) in enumerate(usual(0, 40) + usual(52, 90) + [(k, -99.0 if k == 45 else v) for k, v in stuck])]
    pdf = spark.createDataFrame(rows, "row_id bigint, d int, v double")
    got = {r.row_id for r in spikes.flag(pdf, "row_id", F.lit("a"), F.col("v"), F.col("d"), F.lit(0), F.col("d"), chart).collect()}
    assert got == {i for i, k, v in rows if v in (61.7, -99.0)}


def test_limits_follow_each_source(spark, monkeypatch):
    rnd, rows = random.Random(21), []
    for s, spread in (("quiet", 0.3), ("lively", 4.0)):
        rows += [(s, k, 60 + rnd.gauss(0, spread)) for k in range(300) if k % 100]
        rows += [(s, k, 70.0) for k in (100, 200)]
    rows = [(i, *r) for i, r in enumerate(rows)]
    df = spark.createDataFrame(rows, "row_id bigint, s string, d int, v double")
    chart = spikes.Chart(low=15, high=140, finest=0.5, width=6)
    run = lambda c: {r.row_id for r in spikes.flag(df, "row_id", F.col("s"), F.col("v"), F.col("d"), F.lit(0), F.col("d"), c).collect()}
    assert run(chart) == {r[0] for r in rows if r[1] == "quiet" and r[3] == 70.0}
    # blocks of any size hold the same series
    one = spikes.chart_block(df.toPandas().rename(columns={"s": "series", "d": "t"}).assign(step=lambda x: x["t"], slot=0, placed=True).sort_values(["series", "t", "v"]).reset_index(drop=True), chart)
    assert len(one) == 2
    monkeypatch.setattr(spikes, "BLOCK_CELLS", 10)
    two = spikes.chart_block(df.toPandas().rename(columns={"s": "series", "d": "t"}).assign(step=lambda x: x["t"], slot=0, placed=True).sort_values(["series", "t", "v"]).reset_index(drop=True), chart)
    assert two.sort_values("t").reset_index(drop=True).equals(one.sort_values("t").reset_index(drop=True))


def test_stretch_of_a_sparse_series(spark):
    rows = [(k, k * 30, 55.5 if 14 <= k < 20 else 60 + (k * 7 % 5) / 10) for k in range(40)] + [(99, 3_000_000, 60.0)]
    df = spark.createDataFrame(rows, "row_id bigint, d int, v double")
    chart = spikes.Chart(low=15, high=140, finest=0.5, width=60, run=6)
    got = {r.row_id for r in spikes.flag(df, "row_id", F.lit("a"), F.col("v"), F.col("d"), F.lit(0), F.col("d"), chart).collect()}
    assert got == set(range(14, 20))


RAW = "file_id bigint, feed string, landed_at timestamp_ntz, line_no bigint, record string"


def _changes(spark, files):
    rows = [(i, "f", datetime(2025, 1, 1 + i // 2, i % 2), n, r) for i, recs in enumerate(files) for n, r in enumerate(recs)]
    return {(r.file_id, r.field, r.change) for r in drift.changes(spark.createDataFrame(rows, RAW)).collect()}


def test_drift_changes(spark):
    week = lambda x: json.dumps({"lunes": [x, 7, 9], "martes": [3, x, 5]})
    files = [
        ['{"schema_version": 1, "name": "A", "live_pct": 3, "location": {"lat": 1.5}}', '{"schema_version": 1'],
        ['{"schemaVersion": "1", "name": "A", "live_pct": null, "location": {"lat": "1,5", "lon": 2.0}}'],
        ["not json", None, "[1]"],
        [f'{{"schemaVersion": 2.0, "name": "A", "zona": "norte 12", "typical_by_hour": {week(1)}}}'] * 2,
        [f'{{"schemaVersion": 2.0, "name": "A", "zona": "norte 12", "typicalByHour": {week(1).replace("7", chr(34) + "7" + chr(34))}}}'],
        [f'{{"schemaVersion": 2.0, "nombre": "A", "barrio_zona": "norte 12", "typicalByHour": {week(2)}}}'],
    ]
    assert _changes(spark, files) == {
        (1, "schemaVersion", "renamed"), (1, "schemaVersion", "retyped"), (1, "location.lat", "retyped"), (1, "location.lon", "added"),
        (3, "schemaVersion", "retyped"), (3, "live_pct", "removed"), (3, "location.lat", "removed"), (3, "location.lon", "removed"), (3, "zona", "added"), (3, "typical_by_hour", "added"),
        (4, "typicalByHour", "renamed"), (4, "typicalByHour", "retyped"),
        (5, "barrio_zona", "renamed"), (5, "nombre", "renamed"), (5, "typicalByHour", "retyped"),
    }
    assert drift.changes(spark.createDataFrame([], RAW)).count() == 0


def test_names_are_learned_and_replayed(spark):
    rnd = random.Random(31)
    places = [(f"p{i}", f"Plaza {rnd.randrange(10**6)}") for i in range(12)]
    files = []
    for k in range(12):
        pid, name, live, mock = ("place_id", "name", "live_pct", "is_mock") if k < 4 else ("lugar", "titulo", "ocupa", "is_mock") if k < 8 else ("place_id", "name", "live_pct", "prueba")
        recs = [{pid: p, name: n, live: rnd.randrange(20, 80), mock: rnd.random() < 0.1, "cerrado": rnd.random() < 0.5} for p, n in places]
        for r in recs if k < 2 else []:
            del r["cerrado"]
        files.append([json.dumps(r) for r in recs])
    rows = [(i, "f", datetime(2025, 1, 1 + i // 2, i % 2), n, r) for i, recs in enumerate(files) for n, r in enumerate(recs)]
    df = spark.createDataFrame(rows, RAW)
    table, found, names = drift.evolve(df)
    assert names["place_id"] == ("place_id", "lugar") and names["name"] == ("name", "titulo") and names["live_pct"] == ("live_pct", "ocupa") and names["is_mock"] == ("is_mock", "prueba")
    got = {(r.file_id, r.field, r.change) for r in found.collect()}
    assert got == {(2, "cerrado", "added"), (4, "lugar", "renamed"), (4, "titulo", "renamed"), (4, "ocupa", "renamed"), (8, "place_id", "renamed"), (8, "name", "renamed"), (8, "live_pct", "renamed"), (8, "prueba", "renamed")}
    # every renamed field is filled under its own name, and what is left is what was never approved
    out = table.collect()
    assert len(out) == len(rows) and all(r.place_id and r.name and r.live_pct is not None and r.is_mock is not None for r in out)
    assert {k for r in out for k in json.loads(r["_rescued"] or "{}")} == {"cerrado"}


MORE = {**drift.NAMES, "schema_version": ("schema_version", "version"), "place_id": ("place_id", "pid", "id"), "location.lon": ("location.lon", "location.lng"), "live_pct": ("live_pct", "live_percent"), "is_mock": ("is_mock", "isMock", "mock"), "rating_n": ("rating_n",)}
KINDS = {**drift.KINDS, "rating_n": "whole"}


def test_drift_ingest_and_replay(spark):
    recs = ['{"place_id": "x", "odd2": 5, "location": {"lat": 1.5, "floor": {"n": 2}}, "mock": null}', '{"location": "here", "name": null}', '{"version": "2", "live_percent": "41", "isMock": "false", "captured_at": 1745077266000, "odd": {"a": [1]}, "location": {"lat": "40,5", "lng": -3}}', '{"schema_version": "two", "mock": 1}', "{broken", None]
    recs += ['{"n": NaN}', '{"n": 1e400}', "[" * 100_000, '{"a": {"deep": [1, "x", null, {"b": 2.5}]}}']
    df = spark.createDataFrame([(i, r, "own") for i, r in enumerate(recs)], "n int, record string, name string")
    t = drift.ingest(df, names=MORE, kinds=KINDS, arrived="shape")
    assert t.where("in_name = 'own'").count() == len(recs)
    r = {x.n - 2: x for x in t.collect()}
    assert json.loads(r[-2]["_rescued"]) == {"odd2": 5, "location.floor": {"n": 2}} and r[-2].location_lat == 1.5
    assert json.loads(r[-1]["_rescued"]) == {"location": "here"}
    assert (r[0].schema_version, r[0].live_pct, r[0].is_mock, r[0].captured_at, r[0].location_lat, r[0].location_lon) == (2, 41.0, False, 1745077266000000, 40.5, -3.0)
    assert json.loads(r[0]["_rescued"]) == {"odd": {"a": [1]}}
    assert r[1].schema_version is None and '"schema_version":"two"' in r[1]["_rescued"] and r[1].is_mock is True
    assert '"_record":"{broken"' in r[2]["_rescued"] and r[3]["_rescued"] is None
    assert all("_record" in r[k]["_rescued"] and r[k]["shape"] is None for k in (4, 5, 6)) and json.loads(r[7]["shape"]) == [["a", "{deep:[s|w|{b:f}]}"]]
    again = {x.n - 2: x for x in drift.replay(t, {"extra": ("odd",), "place_id": ("place_id", "odd2")}, {"extra": "json", "place_id": "text"}).collect()}
    assert again[0].extra == '{"a":[1]}' and again[1].extra is None and again[0]["_rescued"] is None
    assert again[-2].place_id == "x" and json.loads(again[-2]["_rescued"]) == {"odd2": 5, "location.floor": {"n": 2}} and again[2]["_rescued"] == r[2]["_rescued"]


def test_drift_ingest_loses_no_value(spark):
    recs = [
        '{"place_id": "A", "id": "B", "version": 2, "schema_version": 1}',
        '{"schema_version": "two", "version": "2", "pid": "A", "id": "A"}',
        '{"schema_version": "2.7", "rating_n": 1.1}',
        '{"schema_version": 2.0, "rating_n": "1e3"}',
        '{"schema_version": 1e30, "rating_n": "9007199254740993"}',
    ]
    r = {x.n: x for x in drift.ingest(spark.createDataFrame(list(enumerate(recs)), "n int, record string"), names=MORE, kinds=KINDS).collect()}
    left = {n: json.loads(x["_rescued"]) if x["_rescued"] else None for n, x in r.items()}
    assert (r[0].place_id, r[0].schema_version) == ("A", 1) and left[0] == {"id": "B", "version": 2}
    assert (r[1].place_id, r[1].schema_version) == ("A", 2) and left[1] == {"schema_version": "two"}
    assert (r[2].schema_version, r[2].rating_n) == (None, None) and left[2] == {"schema_version": "2.7", "rating_n": 1.1}
    assert (r[3].schema_version, r[3].rating_n) == (2, 1000) and left[3] is None
    assert (r[4].schema_version, r[4].rating_n) == (None, 9007199254740993) and left[4] == {"schema_version": 1e30}


ROWS = "row_id bigint, file_id bigint, ingested_at string, measured_at string, v bigint, location struct<lat:double,lon:double>"


def test_compaction(spark, tmp_path):
    rnd = random.Random(4)
    rows = []
    for i in range(400):
        rows.append((i, rnd.randrange(40), f"2025-01-01T00:{i % 60:02d}:00+00:00", f"m{i % 150}", i % 3 or None, (1.0, None) if i % 2 else None))
    rows += [(1000, None, None, "lost", 1, None), (1001, 999, None, " ", 1, None), (1002, 999, None, " ", 1, None), (1003, 1, "2025-01-01T00:00:00+01:00", "m1", 1, (1.0, None))]
    df = spark.createDataFrame([(*r, 7) for r in rows], ROWS + ", grp int").repartition(5)
    files = spark.createDataFrame([(i, 100 + i * 37 % 900) for i in range(40)] + [(5, 100), (None, 3)], "file_id bigint, n_bytes bigint")
    keys, want = {}, set()
    for r in sorted(rows, key=lambda r: (0, datetime.fromisoformat(r[2]), r[0]) if r[2] else (1, datetime.max, r[0])):
        if r[3] and r[3].strip():
            if r[3:] in keys:
                want.add(r[0])
            keys.setdefault(r[3:], r[0])
    dup = compaction.duplicates(df, "row_id", ["row_id", "file_id", "ingested_at"], I.iso_us(F.col("ingested_at")), F.col("measured_at").rlike(r"\S"))
    assert {r.row_id for r in dup.collect()} == want
    root, manifest = compaction.compact(df, files, "file_id", "row_id", dup, target_bytes=3000, root=f"file://{tmp_path}/c")
    back = spark.read.parquet(f"{root}/data")
    assert sorted(r.row_id for r in back.collect()) == sorted({r[0] for r in rows} - want)
    assert {tuple(r) for r in back.select(df.columns).collect()} == {tuple(r) for r in df.collect() if r.row_id not in want}
    m = manifest.collect()
    assert sum(x.n_rows for x in m) == len(rows) - len(want) and len(m) <= 14
    assert max(x.n_rows for x in m) <= 2 * sum(x.n_rows for x in m) / len(m)
    shuffled = compaction.duplicates(df, "row_id", ["row_id", "file_id", "ingested_at"], I.iso_us(F.col("ingested_at")), F.col("measured_at").rlike(r"\S"), broadcast_limit=0)
    assert {r.row_id for r in shuffled.collect()} == want
    root, manifest = compaction.compact(df.limit(0), files.limit(0), "file_id", "row_id", root=f"file://{tmp_path}/e")
    assert manifest.count() == 0


def test_groups_keep_the_balance_of_the_heap(spark):
    rnd = random.Random(8)
    files = spark.createDataFrame([(i, rnd.randrange(1, 1000)) for i in range(3000)], "file_id bigint, n_bytes bigint")
    planned = compaction.plan(files, "file_id", "n_bytes", target_bytes=20_000, files_per_bucket=500)
    p, n = compaction.numbered(planned)
    loads = {r.grp: r.b for r in p.join(files, "file_id").groupBy("grp").agg(F.sum("n_bytes").alias("b")).collect()}
    assert sorted(loads) == list(range(n)) and max(loads.values()) <= 1.1 * sum(loads.values()) / n
    # every group is a partition of its own
    parts = p.repartitionById(n, "grp").select(F.spark_partition_id().alias("p"), "grp").distinct().collect()
    assert len(parts) == n and all(r.p == r.grp for r in parts)


def test_work_folder_is_shared_and_cleared(spark, tmp_path):
    import os

    from mobilake import session

    path = session.work_path(spark, "x")
    assert path.startswith("file:///") and spark.sparkContext.applicationId in path
    kept = session.cut(spark.range(3), "kept")
    assert kept.count() == 3
    session.clear_work(spark)
    assert not os.path.exists(os.path.dirname(path)[7:])
    assert session.qualified(spark, "/a/b") == "file:///a/b"


def test_longest_first_is_balanced():
    sizes = [random.Random(5).randrange(1, 100) for _ in range(500)]
    groups = compaction.longest_first(sizes, 7)
    loads = [sum(s for s, g in zip(sizes, groups) if g == k) for k in range(7)]
    assert max(loads) - min(loads) <= max(sizes) and compaction.longest_first([], 0) == []
