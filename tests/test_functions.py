"""Column functions, held against plain Python."""

import html
import math
import re

import pytest
from pyspark.sql import functions as F

from mobilake.functions import arrays, geo, numbers, text, times


def one(spark, value, kind, f):
    return spark.createDataFrame([(value,)], f"c {kind}").select(f(F.col("c")).alias("r")).first().r


def many(spark, values, f, kind="string"):
    rows = spark.createDataFrame(list(enumerate(values)), f"i int, c {kind}").select("i", f(F.col("c")).alias("r")).orderBy("i").collect()
    return [r.r for r in rows]


def test_text(spark):
    assert many(spark, ["  a b ", "", "  ", None], text.clean) == ["a b", None, None, None]
    pages = ["<p>Uno &amp;amp; dos</p><br>tres", "a &lt;b&gt; c", None, "<i></i>", "x" * 50_000]
    want = [None if p is None else re.sub(r"\s+", " ", html.unescape(html.unescape(re.sub(r"<[^>]*>", " ", p)))).strip() or None for p in pages]
    assert many(spark, pages, text.strip_tags) == want
    assert many(spark, ["abc def ghi", "abc", None], lambda c: text.shorten(c, 4)) == ["abc...", "abc", None]
    assert many(spark, ["https://x.example/a/b%20c+d/", "https://x.example", "https://x.example/q?z=/y", None, "https://x.example/%zz"], text.url_segment) == ["b c+d", None, "q", None, None]
    assert many(spark, ["7", "431", "1234", None], lambda c: text.zfill(c, 3)) == ["007", "431", "1234", None]
    assert many(spark, ["Film - VOSE - x", "Film", None], text.after_dash) == ["VOSE - x", None, None]
    assert many(spark, ["a_b", None], text.first_of) == ["a", None]
    assert many(spark, ["a- b--c", ""], text.parts_of) == [["a", "b", "c"], []]
    assert many(spark, ["Eventos > Danza", "x"], text.last_part) == ["danza", "x"]
    assert many(spark, [None, " ", "x"], text.is_blank) == [True, True, False]
    assert many(spark, ["TRUE", "no", None], text.is_true) == [True, False, None]
    assert one(spark, "s3://b/k/x.json", "string", text.bucket_and_key).asDict() == {"bucket": "b", "key": "k/x.json"}
    df = spark.createDataFrame([("a", " ", None, "#b")], "a string, b string, c string, d string")
    r = df.select(text.breadcrumb(*map(F.col, "abc")).alias("x"), text.breadcrumb(F.col("b"), F.col("c")).alias("y"), text.search_terms(F.col("a"), F.col("d")).alias("z"), text.prefixed("s", F.col("c")).alias("p")).first()
    assert (r.x, r.y, r.z, r.p) == ("a", None, "a b", None)


def test_numbers(spark):
    assert many(spark, ["12", " -3.5 ", "nan", "inf", "1_000", "", None], numbers.to_float) == [12.0, -3.5, None, None, None, None, None]
    assert many(spark, ["12", "12.0", "99999999999"], numbers.to_int) == [12, None, None]
    assert many(spark, ["12.9", "-12.9", "x"], numbers.to_int_via_float) == [12, -12, None]
    assert many(spark, ["12,5", "1.5", "a"], numbers.decimal_comma) == [12.5, 1.5, None]
    assert many(spark, ["40.417.386", "-3.707.141", "40.4", "x"], numbers.grouped_decimal) == [40.417386, -3.707141, 40.4, None]
    assert many(spark, ["3º 41' 30\" W", "40º 25' 0\" N", "x"], numbers.dms) == [-3.691667, 40.416667, None]
    df = spark.createDataFrame([(1, 0), (1, 4), (None, 2)], "a int, b int")
    assert [r[0] for r in df.select(numbers.ratio(F.col("a"), F.col("b"))).collect()] == [None, 0.25, None]
    assert many(spark, [0.00005, 0.00015], numbers.half_even, "double") == [0.0, 0.0002]
    assert many(spark, [350.0, 10.0], numbers.wrap_longitude, "double") == [-10.0, 10.0]
    assert many(spark, [1.0, 200.0, None], lambda c: numbers.in_range(c, 0, 100), "double") == [True, False, True]
    assert many(spark, [1.0, None], lambda c: numbers.in_range(c, 0, 100, True), "double") == [True, False]


def test_times(spark):
    assert many(spark, ["2025-01-01T10:00:00Z", "12:30", "2026", "2025-02-30T10:00", None], times.iso_ok) == [True, False, False, False, False]
    assert many(spark, ["2025-01-01", "2025-1-1", "2025-02-30"], times.iso_date)[1:] == [None, None]
    assert str(one(spark, "15 de agosto de 2026", "string", times.long_date)) == "2026-08-15"
    assert many(spark, ["1h 45min", "2h", "50 min", "x"], times.duration_min) == [105, 120, 50, None]
    assert str(one(spark, "5/8/2025 9:05", "string", lambda c: times.source_time(c, "d/M/yyyy H:mm:ss", "d/M/yyyy H:mm"))) == "2025-08-05 09:05:00"
    r = spark.range(1).select(times.hour_of_day(F.lit(2025), F.lit(12), F.lit(31), F.lit(24)).alias("a"), times.hour_of_day(F.lit(2025), F.lit(2), F.lit(30), F.lit(1)).alias("b"), times.hour_of_day(F.lit(2025), F.lit(1), F.lit(1), F.lit(25)).alias("c")).first()
    assert str(r.a) == "2026-01-01 00:00:00" and r.b is None and r.c is None
    # over the spring change the hour before 03:10 local is 01, in autumn both hours of 02 are met
    hours = []
    for t in ("2026-03-29T01:10:00Z", "2026-10-25T01:10:00Z", "2026-10-25T02:10:00Z"):
        hours.append(one(spark, t, "string", lambda c: times.previous_hour(F.to_timestamp(c))).hora)
    assert hours == ["01", "02", "02"]
    assert one(spark, "2025-06-01T22:30:00Z", "string", lambda c: times.date_key(times.local_clock(times.iso_instant(c)))) == "2025-06-02"
    assert many(spark, ["2025-08-04 10:00:00", "2025-08-10 10:00:00"], lambda c: times.weekday_name(c.cast("timestamp_ntz"))) == ["lunes", "domingo"]


def test_geo(spark):
    # Puerta del Sol, EPSG:25830 -> ETRS89, to about a centimetre
    r = spark.range(1).select(geo.utm_to_lat(F.lit(440300.0), F.lit(4474300.0)).alias("lat"), geo.utm_to_lon(F.lit(440300.0), F.lit(4474300.0)).alias("lon")).first()
    x, y = _forward(r.lat, r.lon)
    assert x == pytest.approx(440300.0, abs=0.01) and y == pytest.approx(4474300.0, abs=0.01)
    ring = [[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [0.0, 4.0]]
    df = spark.createDataFrame([(1.0, 1.0, [[ring]]), (5.0, 1.0, [[ring]]), (2.0, 2.0, [[ring, [[1.0, 1.0], [3.0, 1.0], [3.0, 3.0], [1.0, 3.0]]]]), (1.0, 1.0, None)], "lat double, lon double, c array<array<array<array<double>>>>")
    assert [r[0] for r in df.select(geo.inside_polygons(F.col("lat"), F.col("lon"), F.col("c"))).collect()] == [True, False, False, False]
    line = [[x / 10, math.sin(x / 10)] for x in range(100)]
    out = geo.simplify_line(line, 0.05)
    assert out[0] == line[0] and out[-1] == line[-1] and len(out) < 30
    assert geo.simplify_line([[0.0, 0.0], [1.0, 0.0], [2.0, 0.0]], 0.1) == [[0.0, 0.0], [2.0, 0.0]]
    got = spark.createDataFrame([(line,), (None,)], "p array<array<double>>").select(geo.simplify(0.05)(F.col("p")).alias("s")).collect()
    assert got[0].s == out and got[1].s is None


def _forward(lat, lon):
    """Transverse Mercator by the Krueger series, an independent formula."""
    a, f, k0, lon0 = 6378137.0, 1 / 298.257222101, 0.9996, math.radians(-3)
    n = f / (2 - f)
    big = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * math.sqrt(n) / (1 + n)
    p, q = math.radians(lat), math.radians(lon) - lon0
    t = math.sinh(math.atanh(math.sin(p)) - e * math.atanh(e * math.sin(p)))
    xi, eta = math.atan2(t, math.cos(q)), math.atanh(math.sin(q) / math.sqrt(1 + t * t))
    x = 500000 + k0 * big * (eta + sum(c * math.cos(2 * j * xi) * math.sinh(2 * j * eta) for j, c in enumerate(alpha, 1)))
    return x, k0 * big * (xi + sum(c * math.sin(2 * j * xi) * math.cosh(2 * j * eta) for j, c in enumerate(alpha, 1)))


def test_arrays(spark):
    df = spark.createDataFrame([([("lunes", list(range(24))), ("martes", [1])],), (None,)], "p array<struct<name:string,data:array<int>>>")
    rows = df.select(arrays.week_profile(F.col("p")).alias("w")).select("w", arrays.profile_at(F.col("w"), F.lit("2025-08-04 05:00:00").cast("timestamp_ntz")).alias("v"), arrays.profile_at(F.col("w"), F.lit("2025-08-05 05:00:00").cast("timestamp_ntz")).alias("o")).collect()
    assert rows[0].v == 5 and rows[0].o is None and rows[0].w.domingo is None and rows[1].w is None and rows[1].v is None
    assert many(spark, ['["a","b"]', "x", '{"a":1}', None], arrays.text_list) == [["a", "b"], [], [], []]
    assert many(spark, ['{"code":null}', '{"x":{"code":1}}', "no", None], lambda c: arrays.has_key(c, "code", "y")) == [True, False, False, False]
    assert many(spark, ['{"k": 3}', '{"k": "x"}', "{", None], lambda c: arrays.json_path(c, "$.k", "bigint")) == [3, None, None, None]
    g = spark.range(1).select(arrays.nearest_index(F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)), F.lit(2.5)).alias("i"), arrays.point_of(F.array(F.lit(-3.7), F.lit(40.4))).alias("p"), arrays.point_of(F.array(F.lit(1.0))).alias("q")).first()
    assert g.i == 1 and (g.p.lat, g.p.lon) == (40.4, -3.7) and g.q.lat is None
    e = spark.createDataFrame([([("a", "1"), ("b", "2"), ("a", "3")],)], "e array<struct<valueName:string,value:string>>")
    assert e.select(arrays.parameters(F.col("e"), "z", "a")).first()[0] == "3"
    d = spark.createDataFrame([([("00-12", 1), ("00-24", 2)],), ([(None, 7)],)], "e array<struct<periodo:string,value:int>>")
    assert [r[0] for r in d.select(arrays.whole_day(F.col("e"))).collect()] == [2, 7]
    w = spark.createDataFrame([([1, 200], None), (None, None)], "a array<int>, b array<int>")
    assert [r[0] for r in w.select(arrays.all_within([F.col("a"), F.col("b")], 0, 100)).collect()] == [False, True]
