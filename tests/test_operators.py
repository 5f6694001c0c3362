"""Gates, reports, roll-ups, windows, joins, graph, sources, layers, streaming, marts."""

import io
import json
import tarfile
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mobilake.datasets import specs
from mobilake.operators import gate, graph, joins, quality, rollup, windows
from mobilake.sources import layers, readers, remote
from mobilake.streaming import hourly


def test_gate_keeps_reasons_and_first_of_repeats(spark):
    df = spark.createDataFrame([("a", 1, 5.0, "h1"), ("b", 2, 500.0, "h2"), (None, 3, None, "h1"), ("", 4, -1.0, "h4"), ("c", 5, 5.0, "h1"), ("d", 6, 7.0, "h2")], "k string, n int, v double, h string")
    good, bad = gate.split(df, [gate.missing("k"), gate.between("v", 0, 100)], unique="h", order=["n"])
    assert sorted(r.n for r in good.collect()) == [1, 6]
    assert {r.n: r.reasons for r in bad.collect()} == {2: ["v_out_of_range"], 3: ["k_missing"], 4: ["k_missing", "v_out_of_range"], 5: ["duplicate_exact_content"]}
    assert {r.reason: r.rows for r in gate.reason_counts(bad).collect()} == {"k_missing": 2, "v_out_of_range": 2, "duplicate_exact_content": 1}


def test_gate_keeps_exactly_one_row_of_a_key(spark):
    same = ("a", "2026-01-01")
    df = spark.createDataFrame([same, same, same, ("a", "2026-01-02"), (None, "x"), (None, "x"), ("b", None)], "h string, at string").repartition(3)
    for order in ([], ["at"]):
        good, bad = gate.split(df, [], unique="h", order=order)
        assert sorted((r.h or "") for r in good.collect()) == ["", "a", "b"] and bad.count() == 4
        assert {tuple(r.reasons) for r in bad.collect()} == {("duplicate_exact_content",)}
    good, _ = gate.split(df, [], unique="h", order=["at"])
    assert good.where("h = 'a'").first().at == "2026-01-01"
    good, bad = gate.split(df.limit(0), [], unique="h")
    assert good.count() == 0 and bad.count() == 0


def test_quality_report_on_nothing_and_on_nulls(spark):
    schema = "a string, v double, w double"
    suite = [quality.not_null("a"), quality.between("v", 0, 1), quality.in_set("a", ["x"]), quality.matches("a", "^x"), quality.unique("a"), quality.pair_at_least(F.col("v"), F.col("w"), "v>=w")]
    empty = quality.report(spark.createDataFrame([], schema), suite).collect()
    assert len(empty) == 6 and all(r.success and r.element_count == 0 for r in empty)
    r = {x.expectation: x.unexpected_count for x in quality.report(spark.createDataFrame([("x", 2.0, 1.0), ("x", None, None), (None, 0.5, 0.7)], schema), suite).collect()}
    assert r == {"not_null": 1, "between": 1, "in_set": 0, "regex": 0, "unique": 2, "pair_at_least": 1}


def test_rollup_firsts_do_not_depend_on_row_order(spark):
    rows = [("s", "2025-10-26T02:30:00+01:00", "late"), ("s", "2025-10-26T02:45:00+02:00", None), ("s", "2025-10-26T02:50:00+02:00", "early"), (None, "2025-10-26T02:50:00+02:00", "x"), ("", "2025-10-26T02:50:00+02:00", "x")]
    for part in (rows, rows[::-1]):
        df = spark.createDataFrame(part, "k string, t string, name string").repartition(3)
        at = F.to_timestamp("t")
        out = rollup.rollup(df, ["k"], {"name": rollup.earliest(F.col("name"), at), "first": rollup.first_by(F.col("t"), at), "last": rollup.last_by(F.col("t"), at)}, ["k"]).collect()
        assert len(out) == 1 and (out[0].name, out[0].first, out[0].last, out[0].samples_count) == ("early", rows[1][1], rows[0][1], 3)


def test_windows(spark):
    df = spark.createDataFrame([("r", 2, "b"), ("r", 1, "a"), ("r", 3, "c"), ("q", 1, "z")], "k string, n int, s string")
    assert {tuple(r) for r in windows.consecutive_pairs(df, ["k"], [F.col("n")], "s").collect()} == {("r", "a", "b"), ("r", "b", "a"), ("r", "b", "c"), ("r", "c", "b")}
    assert {r.s for r in windows.first_k(df, ["k"], [F.col("n")], 2).collect()} == {"a", "b", "z"}
    assert {r.s for r in windows.keep_first(df, ["k"], [-F.col("n")]).collect()} == {"c", "z"}
    assert {tuple(r) for r in windows.representative(df, ["k"], "s", F.col("n") == 3, F.col("n")).collect()} == {("r", "c"), ("q", "z")}
    assert {r.s for r in windows.latest_rows(df, F.col("n")).collect()} == {"c"}


def test_joins(spark):
    left = spark.createDataFrame([(1, "a", datetime(2025, 1, 5, 12)), (2, "a", datetime(2025, 1, 1)), (3, "b", datetime(2025, 1, 9)), (4, None, datetime(2025, 1, 9)), (5, "a", datetime(2025, 1, 2))], "i int, k string, t timestamp_ntz")
    right = spark.createDataFrame([("a", datetime(2025, 1, 2), 10), ("a", datetime(2025, 1, 5, 11), 20), ("a", datetime(2025, 1, 6), 30), (None, datetime(2025, 1, 1), 7), ("a", None, 99)], "k string, u timestamp_ntz, v int")
    assert {r.i: r.v for r in joins.as_of(left, right, ["k"], "t", "u", ["v"]).collect()} == {1: 20, 2: None, 3: None, 4: 7, 5: 10}
    dim = spark.createDataFrame([("a", "x"), ("a", "y")], "k string, name string")
    assert sorted((r.i, r.name) for r in joins.lookup(left, dim, ["k"]).collect()) == [(1, "x"), (2, "x"), (3, None), (4, None), (5, "x")]
    old = spark.createDataFrame([("n1", 1.0, "A"), ("n2", 2.0, "B")], "id string, lat double, name string")
    new = spark.createDataFrame([("n2", None, None), ("n3", 3.0, "C")], "id string, lat double, name string")
    assert {tuple(r) for r in joins.upsert(old, new, ["id"], ["lat"]).collect()} == {("n1", 1.0, "A"), ("n2", 2.0, None), ("n3", 3.0, "C")}


def test_graph(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y")], "src string, dst string")
    start = spark.createDataFrame([("a",)], "id string")
    assert {(r.id, r.hops) for r in graph.hops(e, start).collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}
    n = spark.createDataFrame([("p", "A", "s", "x", 40.0, -3.0), ("q", "B", "s", "x", 40.001, -3.0), ("r", "A", "s", "x", 40.0001, -3.0), ("t", "B", "s", "x", None, None)], "id string, kind string, source string, name string, lat double, lon double")
    assert {(r.src, r.dst) for r in graph.close_to(n, 150.0).collect()} == {("p", "q"), ("q", "r")}
    assert [r.src for r in joins.with_both_ends(e, spark.createDataFrame([("a",), ("b",)], "id string")).collect()] == ["a"]
    twice = graph.nodes(spark.createDataFrame([("1", "b", 1.0, None), ("1", "a", 1.0, 2.0), (None, "c", 1.0, 1.0), ("", "c", 1.0, 1.0)], "k string, n string, la double, lo double"), "K", "src", F.col("k"), F.col("n"), F.col("la"), F.col("lo"))
    assert [tuple(r) for r in twice.collect()] == [("src:1", "K", "src", "a", 1.0, 2.0)]
    stops = spark.createDataFrame([("r1", "2", "s2"), ("r1", None, "s0"), ("r1", "10", "s10")], "route string, seq string, stop string")
    assert {(r.src, r.dst) for r in graph.connected(stops, "route", F.col("seq"), "stop", F.lit("L")).collect()} == {("s0", "s2"), ("s2", "s0"), ("s2", "s10"), ("s10", "s2")}


def test_readers(spark, tmp_path):
    (tmp_path / "j").mkdir()
    (tmp_path / "j/a.json").write_text(json.dumps([{"a": 1, "code": None}, {"a": 2}]))
    (tmp_path / "j/b.json").write_text(json.dumps({"a": 3}))
    (tmp_path / "j/c.json").write_text("[]")
    schema = T.StructType().add("a", "integer").add("b", "string")
    got = readers.json_arrays(spark, str(tmp_path / "j"), schema, raw=True).collect()
    assert sorted((r.a, r.b) for r in got) == [(1, None), (2, None), (3, None)] and any('"code":null' in r["_raw"] for r in got)
    (tmp_path / "m.json").write_text(json.dumps({"data": {"stations": [{"a": 5}]}}))
    assert [r.a for r in readers.json_member(spark, str(tmp_path / "m.json"), "$.data.stations", schema).collect()] == [5]
    (tmp_path / "x.xml").write_text("<pms><pm><a>1</a><b>z</b></pm><pm><a>2</a></pm></pms>")
    assert sorted((r.a, r.b or "") for r in readers.xml_rows(spark, str(tmp_path / "x.xml"), "pm", schema).collect()) == [(1, "z"), (2, "")]
    (tmp_path / "l.csv").write_bytes("a;b\n1;Peñón\n".encode("latin-1"))
    assert [r.b for r in readers.semicolon_csv(spark, str(tmp_path / "l.csv"), schema, "ISO-8859-1").collect()] == ["Peñón"]
    with zipfile.ZipFile(tmp_path / "g.zip", "w") as z:
        z.writestr("stops.txt", "﻿b,a\nuno,1\ndos,x\n")
        z.writestr("other.bin", "no")
    with tarfile.open(tmp_path / "t.tar.gz", "w:gz") as t:
        info = tarfile.TarInfo("alerts/one.xml")
        info.size = 4
        t.addfile(info, io.BytesIO(b"<a/>"))
    (tmp_path / "broken.zip").write_bytes(b"nothing")
    m = readers.archive_members(spark, str(tmp_path / "*.zip"), ".txt")
    assert sorted((r.b, r.a) for r in readers.csv_member(m, schema).collect()) == [("dos", None), ("uno", 1)]
    assert [r.content for r in readers.archive_members(spark, str(tmp_path / "t.tar.gz"), ".xml").collect()] == [b"<a/>"]
    page = '<html><script>var a</script><script type="application/ld+json">{"name": "x"}</script></html>'
    assert spark.createDataFrame([(page,), (None,)], "p string").select(readers.ld_json(F.col("p")).alias("s")).collect() == [(['{"name": "x"}'],), ([],)]
    cat = spark.createDataFrame([("d", "Aforos 2024", "csv", "u1", None, "2024"), ("d", "Aforos 2025", "CSV", "u2", "2025", None), ("d", "Otra", "csv", "u3", "2026", None)], "ds string, name string, format string, url string, last_modified string, created string")
    assert readers.latest_resource(cat, "ds", "aforos").first().url == "u2"


def test_remote(spark, tmp_path):
    waits, calls = [], []

    def flaky(left):
        calls.append(left)
        if len(calls) < 3:
            raise OSError("no")
        return b"ok"

    assert remote.with_retries(flaky, 3, 2.0, 60, waits.append) == b"ok" and waits == [2.0, 4.0]
    with pytest.raises(OSError):
        remote.with_retries(lambda left: (_ for _ in ()).throw(OSError("x")), 2, 0.0, 60, waits.append)
    with pytest.raises(TimeoutError):
        remote.with_retries(lambda left: b"", 1, 0.0, -1)
    assert remote.query_url("http://x", where="a=1", limit=None, order="b") == "http://x?where=a%3D1&order=b"
    (tmp_path / "a.json").write_text('{"datos": "file://%s"}' % (tmp_path / "b.json"))
    (tmp_path / "b.json").write_text("[1]")
    spark.dataSource.register(remote.Feed)
    got = spark.read.format("feed").option("url.0", f"file://{tmp_path}/a.json").option("url.1", f"file://{tmp_path}/b.json").load()
    assert sorted(r.body for r in got.collect())[0] == "[1]"
    assert spark.read.format("feed").option("url", f"file://{tmp_path}/a.json").option("wrapped", "datos").load().first().body == "[1]"


def test_layers_replace_only_touched_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    schema = T.StructType().add("v", "integer").add("fecha", "string").add("hora", "string")
    assert layers.read_table(spark, path, schema).count() == 0
    df = spark.createDataFrame([(1, "2025-01-01", "09"), (2, "2025-01-02", "__sin_medida__")], schema)
    for _ in range(2):
        layers.write_partitions(df, path, ["fecha", "hora"])
    layers.write_partitions(spark.createDataFrame([(3, "2025-01-01", "09")], schema), path, ["fecha", "hora"])
    assert sorted(tuple(r) for r in layers.read_table(spark, path, schema).collect()) == [(2, "2025-01-02", "__sin_medida__"), (3, "2025-01-01", "09")]
    only = layers.read_table(spark, path, schema, F.col("fecha") == "2025-01-01")
    assert only.count() == 1 and "PartitionFilters: [isnotnull(fecha" in only._jdf.queryExecution().executedPlan().toString()
    moment = F.lit("2025-01-01 07:00:00").cast("timestamp_ntz")
    for batch, rows in (("one", [(1,)]), ("two", [(2,)]), ("one", [(1,)])):  # the first batch is landed twice
        layers.append_bronze(spark.createDataFrame(rows, "a int"), str(tmp_path / "b"), moment, batch)
    assert sorted((r.a, r.hora) for r in spark.read.json(str(tmp_path / "b")).collect()) == [(1, "07"), (2, "07")]
    layers.register(spark, "t_view", path, schema)
    assert spark.sql("select count(*) c from t_view").first().c == 2
    layers.write_report(quality.report(df, [quality.not_null("v")]), str(tmp_path / "r"))
    assert len(list((tmp_path / "r").glob("part-*"))) == 1


TRAFFIC = "schema_version int, source string, point_id string, subarea string, measured_at string, ingested_at string, location struct<lat:double,lon:double>, intensity_vph int, occupancy_pct int, load_pct int, service_level int, saturation_intensity_vph int, has_error boolean"


def _traffic(spark, hour, point="P1", v=100, at="2026-08-15T0{h}:05:00+02:00"):
    return (1, "s", point, "z", at.format(h=hour), "2026-08-15T09:00:00+02:00", (40.4, -3.7), v, 50, 20, 1, 200, False)


def test_marts_on_small_batches(spark):
    t = spark.createDataFrame([_traffic(spark, 7), _traffic(spark, 7, v=300), _traffic(spark, 8, v=99999), _traffic(spark, 8, point="")], TRAFFIC)
    good, bad = specs.silver(specs.MARTS["trafico"], t)
    assert {tuple(r.reasons) for r in bad.collect()} == {("intensity_vph_out_of_range",), ("point_id_missing",)}
    g = specs.gold(specs.MARTS["trafico"], good, "now").collect()
    assert len(g) == 1 and (g[0].date, g[0].hour, g[0].samples_count, g[0].avg_intensity_vph, g[0].avg_occupancy_ratio, g[0].avg_intensity_ratio, g[0].lat) == ("2026-08-15", 7, 2, 200.0, 0.5, 1.0, 40.4)
    emt = spark.createDataFrame([('{"stop_id":"1"}', "1", "27", "2026-08-15T07:00:00+02:00", 60, 5), ('{"code":null}', "1", "27", "2026-08-15T07:01:00+02:00", 9000, -1)], "_raw string, stop_id string, line string, ingested_at string, estimate_arrive_sec int, distance_bus_m int")
    good, bad = specs.silver(specs.MARTS["transporte_publico_emt"], emt)
    assert bad.first().reasons == ["unexpected_auth_error_payload", "estimate_arrive_sec_out_of_range", "distance_bus_m_negative"] and specs.MARTS["transporte_publico_emt"].gold(good).count() == 1
    bike = spark.createDataFrame([("1", "n", "2026-08-15T07:00:00+02:00", "2026-08-15T07:00:00+02:00", True, 4, 0, 6, 0, 10, (40.4, -3.7)), ("2", "n", "2026-08-15T07:00:00", "2026-08-15T07:00:00+02:00", False, 9, 2, 1, 0, 10, None)], "station_id string, name string, measured_at string, ingested_at string, is_installed boolean, bikes_available int, bikes_disabled int, docks_available int, docks_disabled int, docks_total int, location struct<lat:double,lon:double>")
    good, bad = specs.silver(specs.MARTS["bicimad"], bike)
    assert bad.first().reasons == ["measured_at_not_timezone_aware", "station_not_installed", "bikes_exceed_docks_total"] and specs.MARTS["bicimad"].gold(good).first().avg_occupancy_ratio == 0.4
    park = spark.createDataFrame([("1", "n", None, "2026-08-15T07:00:00+02:00", 5, 10, None), ("2", "n", "2026-08-15T07:00:00+02:00", "2026-08-15T07:00:00+02:00", 4, 10, (40.4, -3.7)), ("3", "n", None, "2026-08-15T07:00:00+02:00", 12, 10, None)], "parking_id string, name string, measured_at string, ingested_at string, free_spaces int, total_spaces int, location struct<lat:double,lon:double>")
    good, bad = specs.silver(specs.MARTS["aparcamientos"], park)
    assert bad.first().reasons == ["free_spaces_exceeds_total_spaces"] and {r.fecha for r in good.collect()} == {"__sin_medida__", "2026-08-15"}
    assert [(r.parking_id, r.avg_occupancy_ratio) for r in specs.MARTS["aparcamientos"].gold(good).collect()] == [("2", 0.6)]
    air = spark.createDataFrame([("s", "n", "8", "NO2", "x", "u", 40.0, "2026-08-15T07:00:00+02:00", "2026-08-15T07:30:00+02:00", None), ("s", "n", "8", "NO2", "x", "u", 900.0, "2026-08-15T07:00:00+02:00", "2026-08-15T07:30:00+02:00", None), ("s", "n", "8", "??", "x", "u", 9e9, "2026-08-15T07:00:00+02:00", "2026-08-15T07:30:00+02:00", None)], "station_id string, station_name string, magnitude_code string, magnitude_abbr string, magnitude_name string, unit string, value double, measured_at string, ingested_at string, location struct<lat:double,lon:double>")
    good, bad = specs.silver(specs.MARTS["calidad_aire"], air)
    assert bad.first().reasons == ["value_out_of_plausible_range"] and specs.MARTS["calidad_aire"].gold(good).count() == 2
    names = list(specs.MAGNITUDE_RANGE)
    wx = spark.createDataFrame([("s", "n", "2026-08-15T07:00:00+02:00", "2026-08-15T07:30:00+02:00", None, 21.0, 150.0, *[None] * 6)], "station_id string, station_name string, measured_at string, ingested_at string, location struct<lat:double,lon:double,altitude_m:int>, " + ", ".join(f"{c} double" for c in names))
    good, _ = specs.silver(specs.MARTS["meteorologia"], wx)
    assert [(r.magnitude, r.value) for r in good.collect()] == [("temperature_c", 21.0)] and specs.MARTS["meteorologia"].gold(good).count() == 1
    film = spark.createDataFrame([("sesion", "F", "u", "c", "s1", "VOSE", "2026-08-15T22:00:00+02:00", "2026-08-15T07:00:00+02:00"), ("sesion", "F", "u", "c", "s2", None, "2026-08-15T18:00:00+02:00", "2026-08-15T07:00:00+02:00"), ("estreno_semana", "F", "u", None, None, None, None, "2026-08-15T07:00:00+02:00"), ("sesion", "F", "u", "c", "s3", None, "2026-08-14T18:00:00+02:00", "2026-08-15T07:00:00+02:00")], "record_type string, movie_title string, movie_url string, cinema_id string, showtime_id string, language_version string, showtime_datetime string, captured_at string").withColumns({c: F.lit("x") for c in ("chain", "cinema_name", "address", "postal_code", "locality")})
    good, bad = specs.silver(specs.MARTS["cartelera_cines_estrenos"], film)
    g = specs.MARTS["cartelera_cines_estrenos"].gold(good).first()
    assert (g.sessions_count, g.language_versions, g.first_showtime_datetime) == (2, ["VOSE"], "2026-08-15T18:00:00+02:00") and {r.reasons[0] for r in bad.collect()} == {"not_a_screening_session", "showtime_already_passed"}
    post = spark.createDataFrame([("bajo_demanda", "sol", "t", "h", "es", "2026-08-15T07:00:00Z", "2026-08-15T08:00:00Z", 1, None, 2, 3, 1), ("bajo_demanda", "sol", "t", "h", "es", "2026-08-15T07:00:00Z", "2026-08-15T08:00:00Z", 1, None, 2, 3, 2), ("x", " ", " ", "i", None, None, None, 0, 0, 0, 0, 3)], "mode string, match_term string, text string, post_hash string, lang string, created_at string, captured_at string, like_count int, repost_count int, reply_count int, quote_count int, n int")
    good, bad = specs.silver(specs.MARTS["bluesky_menciones"], post, ["n"])
    g = specs.MARTS["bluesky_menciones"].gold(good).first()
    assert (g.mentions_count, g.total_repost_count, g.total_quote_count, g.hour, g.langs) == (1, 0, 3, 9, ["es"]) and bad.count() == 2
    alert = spark.createDataFrame([("i1", "z", "amarillo", "viento", "2026-08-15T10:00:00+02:00", "2026-08-15T20:00:00+02:00", "2026-08-15T07:00:00+02:00"), ("i2", "z", "verde", None, None, None, None)], "identifier string, zone string, level string, phenomenon string, effective_from string, effective_until string, captured_at string")
    good, bad = specs.silver(specs.MARTS["aemet_avisos"], alert)
    assert specs.MARTS["aemet_avisos"].gold(good).first().phenomena == ["viento"] and len(bad.first().reasons) == 4
    cams = spark.createDataFrame([("NO2", "no2", 12.0, "u", "2026-08-16T00:00:00+00:00", "2026-08-15T00:00:00+00:00", 24, "2026-08-15T07:00:00+02:00"), ("polvo", None, 1e6, "u", None, "2026-08-15T00:00:00", -1, "2026-08-15T07:00:00+02:00")], "pollutant string, pollutant_code string, value double, unit string, valid_datetime string, forecast_issued_at string, leadtime_hour int, ingested_at string")
    good, bad = specs.silver(specs.MARTS["cams_calidad_aire"], cams)
    assert specs.MARTS["cams_calidad_aire"].gold(good).first().leadtime_hours == [24] and len(bad.first().reasons) == 5
    week = "struct<" + ",".join(f"{w}:array<int>" for w in specs.times.WEEKDAYS) + ">"
    crowd = spark.createDataFrame([("p", "n", "2026-08-15T07:00:00+02:00", 40, tuple([list(range(24))] * 7), (40.4, -3.7)), ("p", "n", "2026-08-15T07:10:00+02:00", 400, tuple([[200]] * 7), None)], f"place_id string, name string, captured_at string, live_pct int, typical_by_hour {week}, location struct<lat:double,lon:double>")
    good, bad = specs.silver(specs.MARTS["afluencia_lugares"], crowd)
    g = specs.MARTS["afluencia_lugares"].gold(good).first()
    assert (g.typical_pct, g.day_of_week, g.hour) == (7.0, "sabado", 7) and bad.first().reasons == ["live_pct_out_of_range", "typical_by_hour_value_out_of_range"]


def test_stream_equals_batch_and_late_rows(spark, tmp_path):
    landed, silver, gold, check, bad = (str(tmp_path / x) for x in ("landed", "silver", "gold", "check", "bad"))
    first = spark.createDataFrame([_traffic(spark, 7), _traffic(spark, 8, v=50)], TRAFFIC)
    late = spark.createDataFrame([_traffic(spark, 7, v=300), _traffic(spark, 7)], TRAFFIC)  # a late row and a replayed one
    for batch in (first, late):
        batch.coalesce(1).write.mode("append").parquet(landed)
        hourly.land(hourly.file_stream(spark, landed, batch.schema), specs.MARTS["trafico"], silver, gold, check, "now", bad).awaitTermination()
    got = {r.hour: (r.samples_count, r.avg_intensity_vph) for r in spark.read.parquet(gold).collect()}
    assert got == {7: (3, 500 / 3), 8: (1, 50.0)}  # equal rows of two batches are two readings
    hourly.land(hourly.file_stream(spark, landed, first.schema), specs.MARTS["trafico"], silver, gold, check, "now", bad).awaitTermination()
    assert spark.read.parquet(silver).count() == 4
    # rejected rows are kept with their reasons; a batch of them alone changes nothing else
    spark.createDataFrame([_traffic(spark, 7, v=-5)], TRAFFIC).coalesce(1).write.mode("append").parquet(landed)
    hourly.land(hourly.file_stream(spark, landed, first.schema), specs.MARTS["trafico"], silver, gold, check, "now", bad).awaitTermination()
    assert [(r.reasons, '"intensity_vph":-5' in r.record) for r in spark.read.parquet(bad).collect()] == [(["intensity_vph_out_of_range"], True)]
    assert spark.read.parquet(silver).count() == 4


POST = "schema_version int, source string, mode string, match_term string, post_hash string, text string, lang string, created_at string, captured_at string, like_count int, repost_count int, reply_count int, quote_count int"


def test_stream_keeps_one_row_of_each_post(spark, tmp_path):
    landed, silver, gold, check, bad = (str(tmp_path / x) for x in ("landed", "silver", "gold", "check", "bad"))
    post = lambda h, at: (1, "s", "bajo_demanda", "sol", h, "x", "es", "2026-08-15T07:05:00+02:00", at, 1, 0, 0, 0)
    for rows in ([post("a", "2026-08-15T08:00:00+02:00"), post("a", "2026-08-15T08:10:00+02:00"), post("b", "2026-08-15T08:00:00+02:00")], [post("a", "2026-08-15T09:00:00+02:00"), post("c", "2026-08-15T09:00:00+02:00")]):
        df = spark.createDataFrame(rows, POST)
        df.coalesce(1).write.mode("append").parquet(landed)
        hourly.land(hourly.file_stream(spark, landed, df.schema), specs.MARTS["bluesky_menciones"], silver, gold, check, "now", bad).awaitTermination()
    assert sorted(r.post_hash for r in spark.read.parquet(silver).collect()) == ["a", "b", "c"]
    assert [r.reasons for r in spark.read.parquet(bad).collect()] == [["duplicate_exact_content"]] * 2


NOISE = "station_id string, station_name string, district string, neighbourhood string, period string, period_name string, measured_date string, ingested_at string, laeq_db double, l1_db double, l10_db double, l50_db double, l90_db double, l99_db double, location struct<lat:double,lon:double,altitude_m:int>"


def test_stream_trailing_week_sees_late_days(spark, tmp_path):
    row = lambda d, v: ("s", "n", None, None, "D", "d", d, "2026-08-20T09:00:00+02:00", v, None, None, None, None, None, None)
    landed, silver, gold, check, bad = (str(tmp_path / x) for x in ("landed", "silver", "gold", "check", "bad"))
    for batch in ([row("2026-08-03", 60.0), row("2026-08-05", 70.0), row("2026-08-12", 50.0)], [row("2026-08-04", 80.0)]):
        df = spark.createDataFrame(batch, NOISE)
        df.coalesce(1).write.mode("append").parquet(landed)
        hourly.land(hourly.file_stream(spark, landed, df.schema), specs.MARTS["ruido"], silver, gold, check, "now", bad).awaitTermination()
    got = {r.date: (r.laeq_rolling_7d_avg_db, r.laeq_rolling_7d_days) for r in spark.read.parquet(gold).collect()}
    assert got == {"2026-08-03": (60.0, 1), "2026-08-04": (70.0, 2), "2026-08-05": (70.0, 3), "2026-08-12": (50.0, 1)}


def test_windowed_stream_and_dedupe(spark, tmp_path):
    rows = [(i, datetime(2025, 1, 1, i % 3, i), "u", float(i)) for i in range(30)] + [(5, datetime(2025, 1, 1, 2, 5), "u", 5.0)]
    path = str(tmp_path / "e")
    df = spark.createDataFrame(rows, "event_id int, ts timestamp, user_id string, value double")
    df.coalesce(1).write.parquet(path)
    s = hourly.windowed(hourly.once_each(hourly.file_stream(spark, path, df.schema), "ts", "event_id"), "ts", ["user_id"], {"n": F.count(F.lit(1)), "avg": F.avg("value")}, lateness=None)
    s.writeStream.format("memory").queryName("win").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    s2 = hourly.file_stream(spark, path, df.schema)
    assert s2.isStreaming and spark.sql("select * from win").columns == ["user_id", "start", "n", "avg"]


def test_contracts(spark):
    from mobilake.operators import contracts

    m = spark.createDataFrame([("s", "NO2", datetime(2025, 1, 1, 8), 10.0), ("s", "NO2", datetime(2025, 1, 1, 9), 30.0), ("t", "NO2", datetime(2025, 1, 1, 7), 50.0), ("s", "NO2", datetime(2025, 1, 1, 12), 99.0)], "station_id string, pollutant string, at timestamp_ntz, value double")
    f = spark.createDataFrame([("NO2", "2025-01-01", 1.0), ("O3", "2025-01-01", 7.0), ("O3", "2025-01-02", 9.0)], "pollutant string, day string, value double").withColumn("day", F.to_date("day"))
    out = contracts.air_or_forecast(m, f, F.lit("2025-01-01 10:00:00").cast("timestamp_ntz")).collect()
    assert {(r.pollutant, r.value, r.basis) for r in out} == {("NO2", 40.0, "measured"), ("O3", 7.0, "forecast")}
    g = spark.createDataFrame([("a", "2025-01-01", 9, 5.0, 10), ("a", "2025-01-01", 10, 3.0, 10), ("b", "2025-01-01", 9, 4.0, 20)], "parking_id string, date string, hour int, avg_free_spaces double, total_spaces int")
    z = spark.createDataFrame([("a", "z"), ("a", "z"), ("b", "z"), ("c", "y")], "parking_id string, zone string")
    r = contracts.free_parking(g, z).collect()
    assert len(r) == 1 and (r[0].free_spaces, r[0].total_spaces, r[0].as_of.hour) == (7.0, 30, 10)
    p = spark.createDataFrame([("1", 40.0, -3.0)], "id string, lat double, lon double")
    s = spark.createDataFrame([("1", 40.0005, -3.0), ("2", 40.1, -3.0)], "id string, lat double, lon double")
    assert [(x.place_id, x.stop_id) for x in contracts.stops_around(s, p, 100.0).collect()] == [("1", "1")]


def test_events_around_a_place(spark):
    from mobilake.operators import contracts

    e = spark.createDataFrame([("a", 40.4, -3.7, datetime(2026, 8, 15, 20)), ("b", 40.4005, -3.7, datetime(2026, 8, 14)), ("c", 41.0, -3.7, datetime(2026, 8, 16))], "id string, lat double, lon double, starts timestamp_ntz")
    p = spark.createDataFrame([("sol", 40.4, -3.7001)], "id string, lat double, lon double")
    moment = F.lit("2026-08-15 00:00:00").cast("timestamp_ntz")
    assert {r.event_id for r in contracts.events_around(e, p, 500.0).collect()} == {"a", "b"}
    assert {r.event_id for r in contracts.events_around(e, p, 500.0, moment).collect()} == {"a"}


def test_hops_run_until_nothing_new(spark):
    e = spark.createDataFrame([(f"n{i:02d}", f"n{i + 1:02d}") for i in range(18)], "src string, dst string")
    start = spark.createDataFrame([("n00",)], "id string")
    assert {(r.id, r.hops) for r in graph.hops(e, start).collect()} == {(f"n{i:02d}", i) for i in range(19)}
    assert graph.hops(e, start, 18).count() == 19
    with pytest.raises(ValueError, match="17 steps"):
        graph.hops(e, start, 17)
