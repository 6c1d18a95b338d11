import calendar
import datetime as dt
import math

import pytest
from conftest import rows
from pyspark.sql import functions as F

from flowspark.functions import codes, geo, num, text
from flowspark.functions import time as tm


def test_slot_date_round_trip(spark):
    df = spark.createDataFrame([("2013070101",), ("2013070148",)], "s string")
    out = df.select(tm.ts_text(tm.parse_slot_date(F.col("s"), 8)).alias("t"))
    assert rows(out) == [("2013-06-30 16:00:00",), ("2013-07-01 15:30:00",)]


def test_text_times(spark):
    df = spark.createDataFrame([("201401010030", "2014-01-01 00:30:00 +0000 UTC", "05:10", "--")], "a string, b string, c string, d string")
    out = df.select(
        tm.ts_text(tm.parse_minute_text(F.col("a"), -5)), tm.ts_text(tm.parse_utc_suffix(F.col("b"))),
        tm.minutes_of_day(F.col("c")), tm.minutes_of_day(F.col("d")),
    )
    assert [tuple(r) for r in out.collect()] == [("2014-01-01 05:30:00", "2014-01-01 00:30:00", 310, None)]


def test_step_parts_match_the_calendar(spark):
    df = spark.createDataFrame([("2016-02-28 15:59:00",), ("2016-02-28 16:00:00",), ("1969-12-31 23:10:00",)], "s string")
    df = df.withColumn("step", tm.step_of(F.to_timestamp("s")))
    for r in df.select("s", tm.slot_of(F.col("step"), 8).alias("slot"), tm.weekday_of(F.col("step"), 8).alias("wd"), tm.local_date(F.col("step"), 8).alias("d")).collect():
        local = dt.datetime.strptime(r.s, "%Y-%m-%d %H:%M:%S") + dt.timedelta(hours=8)
        assert (r.slot, r.wd, r.d) == (local.hour * 2 + local.minute // 30, local.weekday(), local.date())


def expected_holidays(year):
    out = {dt.date(year, m, d) for m, d in tm.FIXED_HOLIDAYS}
    weeks = lambda m: calendar.monthcalendar(year, m)
    nth = lambda m, wd: [w[wd] for w in weeks(m) if w[wd]]
    out |= {dt.date(year, m, nth(m, wd)[n - 1]) for m, wd, n in tm.NTH_WEEKDAY_HOLIDAYS}
    out |= {dt.date(year, m, nth(m, wd)[-1]) for m, wd in tm.LAST_WEEKDAY_HOLIDAYS}
    july4 = dt.date(year, 7, 4).weekday()
    if july4 == 5:
        out.add(dt.date(year, 7, 3))
    if july4 == 6:
        out.add(dt.date(year, 7, 5))
    return out


def test_us_holidays_over_many_years(spark):
    days = spark.sql("SELECT explode(sequence(DATE'1999-01-01', DATE'2031-12-31')) AS d")
    got = {r.d for r in days.where(tm.is_us_holiday(F.col("d"))).collect()}
    assert got == set().union(*[expected_holidays(y) for y in range(1999, 2032)])


def test_cyclic_columns(spark):
    df = spark.createDataFrame([("2014-12-31 18:30:00",)], "s string")
    cols = tm.temporal_columns(F.to_timestamp("s"))
    r = df.select(*[c.alias(n) for n, c in cols.items()]).first()
    assert r.slot_sin == pytest.approx(math.sin(2 * math.pi * 37 / 48))
    assert r.weekday_cos == pytest.approx(math.cos(2 * math.pi * 2 / 7))
    assert r.month_sin == pytest.approx(math.sin(2 * math.pi * 11 / 12))
    assert r.doy_cos == pytest.approx(math.cos(2 * math.pi * 364 / 366))
    assert r.is_weekend == 0


G = geo.GridSpec("t", 0.0, 4.0, 0.0, 4.0, 4, 4, 0)


def test_cell_rules_on_lines_and_outside(spark):
    pts = [(0.5, 3.5), (1.0, 3.0), (4.0, 1.0), (-0.1, 1.0), (0.0, 0.0), (0.0, 4.0)]
    df = spark.createDataFrame(pts, "x double, y double")
    got = [tuple(r) for r in df.select(geo.cell_id(F.col("x"), F.col("y"), G), geo.cell_id(F.col("x"), F.col("y"), G, "north")).collect()]
    # (1, 3) lies on a horizontal line: south cell row 1, north cell row 0
    assert got == [(0, 0), (5, 1), (-1, -1), (-1, -1), (-1, 12), (0, -1)]


def test_haversine_and_rings(spark):
    df = spark.createDataFrame([(116.3974, 39.9087, 116.4274, 39.9022)], "a double, b double, c double, d double")
    km = df.select(geo.haversine_km(*[F.col(c) for c in "abcd"])).first()[0]
    assert km == pytest.approx(2.659, abs=0.01)
    rings = spark.createDataFrame([(x,) for x in (0.0, 3.5, 3.6, 7.1, 11.5, 20.0)], "km double").select(geo.ring_of(F.col("km")).alias("r"))
    assert [r.r for r in rings.collect()] == [1, 1, 2, 3, 4, 5]


def test_numbers(spark):
    df = spark.createDataFrame([(0.0, 1.0, -1.0), (1000.0, 0.2, 0.6), (None, 0.0, 0.0)], "dn double, a double, b double")
    out = df.select(
        num.reflectance(F.col("dn"), F.lit(2e-5), F.lit(-0.1), F.lit(30.0)).alias("rho"), num.norm_diff(F.col("a"), F.col("b")).alias("nd"),
        num.clip(F.col("dn"), 0, 5).alias("c"), num.fahrenheit_to_celsius(F.col("a")).alias("t"),
    ).collect()
    assert [r.rho for r in out] == [None, 0.0, None]
    assert out[0].nd is None and out[1].nd == pytest.approx(-0.5) and out[2].nd is None
    assert [r.c for r in out] == [0.0, 5.0, None]
    assert out[0].t == pytest.approx(-17.2222, abs=1e-3)


def test_rnd_is_stable_on_ties(spark):
    df = spark.createDataFrame([(64.4821875,), (64.48218749999999,), (-1e-9,)], "x double")
    a, b, c = [r[0] for r in df.select(num.rnd(F.col("x"))).collect()]
    assert a == b and str(c) == "0.0"


def test_codes(spark):
    df = spark.createDataFrame([("Clear", 200), ("Tornado", 450), ("Ash", 800), (None, 801)], "m string, i int")
    out = [tuple(r) for r in df.select(codes.weather_code(F.col("m")), codes.weather_text(F.col("i"))).collect()]
    assert out == [(0, "雷暴"), (13, "未知"), (15, "晴"), (15, "多云")]
    flags = spark.createDataFrame([([0, 1, 0],), ([1, 1, 0],), ([0, 0, 0],)], "f array<int>").select(codes.one_hot_code(F.col("f")).alias("c"))
    assert [r.c for r in flags.collect()] == [1, None, None]


def test_tag_rules(spark):
    df = spark.createDataFrame(
        [
            ({"name": "x", "amenity": "cafe"},), ({"office": "government"},), ({"office": "lawyer"},), ({"shop": "none", "tourism": "hotel"},),
            ({"building": "yes"},), ({"amenity": "cinema", "shop": "mall"},), ({"sport": "tennis", "amenity": "cafe"},),
        ],
        "tags map<string,string>",
    )
    got = [r[0] for r in df.select(codes.poi_class(F.col("tags"))).collect()]
    # office=government is listed under two rules: the exact value goes before office=*
    assert got == ["food", "government", "office", "tourism", None, "entertainment", "sports"]
    t = spark.createDataFrame([({"station": "subway", "highway": "bus_stop"},), ({"railway": "subway_entrance"},), ({"highway": "bus_stop"},), ({},)], "tags map<string,string>")
    assert [r[0] for r in t.select(codes.transit_class(F.col("tags"))).collect()] == ["subway_station", "subway_entrance", "bus_stop", None]
    k = spark.createDataFrame([("trunk",), ("steps",), ("track",)], "k string")
    assert [r[0] for r in k.select(codes.road_group(F.col("k"))).collect()] == ["highway", "active", None]


def test_names(spark):
    df = spark.createDataFrame([(" 西单站 ", "西单（北口）公交站"), ("西单地铁站", "白石桥(东)路口"), ("地铁大厦", "A站")], "a string, b string")
    out = [tuple(r) for r in df.select(text.station_name(F.col("a")), text.stop_name(F.col("b"))).collect()]
    assert out == [("西单", "西单"), ("西单地铁", "白石桥"), ("大厦", "A")]
