"""Sources and sinks: tables written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.functions import codes, num
from flowspark.functions import time as tm
from flowspark.functions.num import rnd as r
from flowspark.operators import graphs as gp
from flowspark.operators import series
from flowspark.operators import transit as tr
from flowspark.plans import fixtures as fx
from flowspark.plans.oracle import cte, rnd, sql
from flowspark.plans.q_clean import raw_weather
from flowspark.plans.q_forecast import log_rows, rolling
from flowspark.plans.q_graphs import occupied
from flowspark.plans.q_scalars import metric_cols, metric_sql, predictions, segmented
from flowspark.plans.registry import query
from flowspark.session import fresh_dir
from flowspark.sources import sinks
from flowspark.sources import tables as src
from flowspark.sources.tables import Tables

G = fx.GRID


def flow_rows(df: DataFrame) -> DataFrame:
    return df.select("city", tm.step_ts(F.col("step")).alias("ts"), "grid_id", "inflow", "outflow")


@query("flow_store", sql(["sparse"], "SELECT grid_id, step, inflow, outflow FROM sparse"))
def flow_store(t: Tables) -> DataFrame:
    path = fresh_dir(t.spark, "flow")
    sinks.write_table(flow_rows(fx.flow_sparse(t)), path, ["city"])
    d = src.read_flow(t.spark, path, city="bj")
    return d.select("grid_id", tm.step_of(F.col("ts")).alias("step"), "inflow", "outflow")


@query("segment_store", sql(["segmented"], """
SELECT 's' || segment AS segment, count(*) AS n_rows, count(DISTINCT step) AS n_steps FROM segmented GROUP BY 1"""))
def segment_store(t: Tables) -> DataFrame:
    base = fresh_dir(t.spark, "segments")
    # one pass writes all segments; each is then a folder of its own, as yearly files are
    d = segmented(t).withColumn("part", F.concat(F.lit("s"), F.col("segment").cast("string")))
    flow = d.select("city", tm.step_ts(F.col("step")).alias("ts"), "grid_id", "inflow", "outflow", "part")
    sinks.write_table(flow, base, ["part"])
    d = src.read_segments(t.spark, src.segment_paths(t.spark, base, "part"))
    return d.groupBy("segment").agg(F.count("*").alias("n_rows"), F.countDistinct("ts").alias("n_steps"))


@query("metrics_store", sql(["metrics_log"], f"SELECT model, 'avg' AS horizon, {metric_sql()} FROM metrics_log GROUP BY 1"))
def metrics_store(t: Tables) -> DataFrame:
    path = fresh_dir(t.spark, "metrics")
    sinks.append_metrics(log_rows(t, "historical_average", predictions(t), 0, "base"), path)
    sinks.append_metrics(log_rows(t, "ar1", rolling(t), 1, "base"), path)
    return sinks.read_metrics(t.spark, path).where("horizon = 'avg'").select("model", "horizon", *metric_cols())


@query("graph_store", sql(["spatial"], f"SELECT src, dst, {rnd('weight', 'weight')} FROM spatial"))
def graph_store(t: Tables) -> DataFrame:
    path = fresh_dir(t.spark, "graphs")
    parts = {"spatial": gp.spatial_graph(occupied(t), G), "transit": tr.transit_graph(fx.stations(t)).drop("hops")}
    named = [e.withColumns({"city": F.lit("bj"), "graph": F.lit(n)}) for n, e in parts.items()]
    sinks.save_graphs(named[0].unionByName(named[1]), path)
    return sinks.load_graphs(t.spark, path, "bj", ["spatial"]).select("src", "dst", r(F.col("weight")).alias("weight"))


@query("csv_weather", sql(["ev"], """
SELECT k % 4 AS kind, count(*) AS n_rows, count(CASE WHEN k % 3 != 0 THEN value END) AS n_temp, count(CASE WHEN k % 2 = 0 THEN value END) AS n_rain
FROM (SELECT value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM ev) GROUP BY 1"""))
def csv_weather(t: Tables) -> DataFrame:
    path = fresh_dir(t.spark, "weather-csv")
    raw_weather(t).select("dt_iso", "temp", "rain_1h", "weather_main").write.option("header", True).csv(path)
    d = src.read_csv(t.spark, path, "dt_iso STRING, temp DOUBLE, rain_1h DOUBLE, weather_main STRING")
    kind = codes.lookup({"Clear": 0, "Rain": 1, "Fog": 2, "Ash": 3})[F.col("weather_main")]
    return d.groupBy(kind.alias("kind")).agg(
        F.count("*").alias("n_rows"), F.count("temp").alias("n_temp"), F.count("rain_1h").alias("n_rain")
    )


@query("text_tables", f"""
SELECT {fx.cell_sql(fx.lon_sql('p_partkey'), fx.lat_sql('p_partkey'))} AS grid_id, count(*) AS n_stops FROM part WHERE p_size < 45 GROUP BY 1""")
def text_tables(t: Tables) -> DataFrame:
    """Stops from two directories of all-string tables: repeats across directories fold, rows
    whose position does not parse are dropped."""
    base = fresh_dir(t.spark, "gtfs")
    p = F.col("p_partkey")
    # large parts stand for stops with an unreadable position
    lat = F.when(F.col("p_size") >= 45, "n/a").otherwise(fx.point_lat(p).cast("string"))
    s = t.part.select(p.cast("string").alias("stop_id"), lat.alias("stop_lat"), fx.point_lon(p).cast("string").alias("stop_lon"))
    for d in ("a", "b"):
        s.write.option("header", True).csv(f"{base}/{d}/stops.txt")
    d = src.read_text_table(t.spark, [f"{base}/a", f"{base}/b"], "stops.txt", ["stop_id", "stop_lat", "stop_lon"])
    d = src.numeric_or_drop(series.first_by(d, ["stop_id"], ["stop_lat", "stop_lon"]), ["stop_lat", "stop_lon"])
    cell = fx.cell_id(F.col("stop_lon"), F.col("stop_lat"), G)
    return tr.stop_cells(d, cell).groupBy("grid_id").agg(F.count("*").alias("n_stops"))


@query("date_list", "SELECT DISTINCT strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def date_list(t: Tables) -> DataFrame:
    path = fresh_dir(t.spark, "dates")
    line = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyyMMdd")).otherwise(F.date_format("o_orderdate", " yyyy-MM-dd"))
    noise = F.array(line, F.lit("# holiday list"), F.lit(""), F.lit("not a date"))
    t.orders.select(F.explode(noise).alias("value")).write.text(path)
    return src.read_dates(t.spark, path).select(F.date_format("d", "yyyy-MM-dd").alias("day"))


@query("sensor_locations", f"""
SELECT count(*) AS n_rows, count(*) - count(DISTINCT c_custkey // 2) AS n_repeated,
  {rnd('min(' + fx.lat_sql('c_custkey') + ')', 'lat_min')}, {rnd('max(' + fx.lat_sql('c_custkey') + ')', 'lat_max')},
  {rnd('min(' + fx.lon_sql('c_custkey') + ')', 'lon_min')}, {rnd('max(' + fx.lon_sql('c_custkey') + ')', 'lon_max')} FROM customer""")
def sensor_locations(t: Tables) -> DataFrame:
    c = F.col("c_custkey")
    d = t.customer.select(F.floor(c / 2).alias("sensor_id"), fx.point_lat(c).alias("latitude"), fx.point_lon(c).alias("longitude"))
    out = src.sensor_location_report(d)
    return out.select("n_rows", "n_repeated", *[r(F.col(x)).alias(x) for x in ("lat_min", "lat_max", "lon_min", "lon_max")])


_TYPES = ["view", "click", "purchase", "signup", "error"]


@query("one_hot_weather", f"SELECT event_id, list_position({_TYPES!r}, event_type) - 1 AS code FROM events")
def one_hot_weather(t: Tables) -> DataFrame:
    flags = F.array(*[(F.col("event_type") == x).cast("int") for x in _TYPES])
    return t.events.select("event_id", codes.one_hot_code(flags).alias("code"))


cte("span", "SELECT min(ts) + INTERVAL 2 DAY AS a, max(ts) - INTERVAL 2 DAY AS b FROM events")


@query("sensor_units", sql(["span"], f"""
SELECT event_id, {rnd('(value - 32) * 5 / 9', 'celsius')}, {rnd('greatest(least(value, 100), 0)', 'speed')} FROM events, span WHERE ts BETWEEN a AND b"""))
def sensor_units(t: Tables) -> DataFrame:
    """Readings inside a time range (inclusive), converted and clipped; the range is one row."""
    two = F.make_interval(days=F.lit(2))
    ts = F.col("ts").cast("timestamp")
    ev = t.events.withColumn("city", F.lit("bj")).withColumn("ts", ts)
    span = ev.groupBy("city").agg((F.min("ts") + two).alias("a"), (F.max("ts") - two).alias("b"))
    d = ev.join(span, "city").where(F.col("ts").between(F.col("a"), F.col("b")))
    return d.select(
        "event_id", r(num.fahrenheit_to_celsius(F.col("value"))).alias("celsius"),
        r(num.clip(F.col("value"), 0.0, 100.0)).alias("speed"),
    )
