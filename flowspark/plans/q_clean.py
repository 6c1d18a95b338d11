"""Cleaning, weather and alignment queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.functions import time as tm
from flowspark.functions.num import clip, rnd as r
from flowspark.operators import clean, series, weather as wx
from flowspark.plans import fixtures as fx
from flowspark.plans.oracle import cte, rnd, sql
from flowspark.plans.registry import query
from flowspark.plans.q_scalars import _TCOLS, segmented
from flowspark.sources import tables as src
from flowspark.session import fresh_dir
from flowspark.sources.tables import Tables, view

KEYS = fx.KEYS


def known_sql(source: str, order: str, cols: list[str], part: str = "") -> str:
    """Rows of ``source`` with the nearest known value on both sides of each column."""
    p = f"PARTITION BY {part} " if part else ""
    up = f"OVER ({p}ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    down = f"OVER ({p}ORDER BY {order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    out = []
    for c in cols:
        at = f"CASE WHEN {c} IS NOT NULL THEN {order} END"
        out += [
            f"last_value({c} IGNORE NULLS) {up} AS pv_{c}", f"last_value({at} IGNORE NULLS) {up} AS pa_{c}",
            f"first_value({c} IGNORE NULLS) {down} AS nv_{c}", f"first_value({at} IGNORE NULLS) {down} AS na_{c}",
        ]
    return f"SELECT *, {', '.join(out)} FROM {source}"


def lerp_sql(c: str, order: str, leading: str) -> str:
    """Linear between the neighbours of ``known_sql``."""
    return (
        f"CASE WHEN {c} IS NOT NULL THEN {c} WHEN pv_{c} IS NOT NULL AND nv_{c} IS NOT NULL THEN "
        f"pv_{c} + (nv_{c} - pv_{c}) * (({order} - pa_{c}) / CAST(na_{c} - pa_{c} AS DOUBLE)) "
        f"WHEN pv_{c} IS NOT NULL THEN pv_{c} ELSE {leading} END"
    )


@query("dedup_first", sql(["ev"], """
SELECT grid_id, step, event_id, event_type, value FROM (
  SELECT *, row_number() OVER (PARTITION BY grid_id, step ORDER BY ts, event_id) AS rn FROM ev) WHERE rn = 1"""))
def dedup_first(t: Tables) -> DataFrame:
    d = t.events.select(
        (F.col("user_id") % fx.N_CELLS).alias("grid_id"), tm.step_of(F.col("ts")).alias("step"),
        "ts", "event_id", "event_type", "value",
    )
    return series.first_by(d, ["grid_id", "step"], ["ts", "event_id"]).drop("ts")


@query("gap_report", sql(["sparse"], """
SELECT grid_id, min(step) AS first_step, max(step) AS last_step, count(*) AS n_observed,
  max(step) - min(step) + 1 - count(*) AS n_missing FROM sparse GROUP BY 1"""))
def gap_report(t: Tables) -> DataFrame:
    return clean.gap_report(fx.flow_sparse(t), KEYS, "step").drop("city")


@query("gap_examples", sql(["sparse"], """
SELECT grid_id, step, rank FROM (SELECT grid_id, step, row_number() OVER (PARTITION BY grid_id ORDER BY step) AS rank FROM (
  SELECT grid_id, unnest(range(min(step), max(step) + 1)) AS step FROM sparse GROUP BY 1
  EXCEPT SELECT grid_id, step FROM sparse)) WHERE rank <= 5"""))
def gap_examples(t: Tables) -> DataFrame:
    return clean.gap_examples(fx.flow_sparse(t), KEYS, "step").select("grid_id", "step", F.col("rank").cast("long").alias("rank"))


cte("flagged", """
SELECT f.grid_id, f.step, inflow, outflow, round(abs((inflow - m1) / s1), 9) > 5 AS out_inflow, round(abs((outflow - m2) / s2), 9) > 5 AS out_outflow
FROM flow f JOIN (SELECT grid_id, avg(inflow) AS m1, greatest(stddev_pop(inflow), 1e-6::DOUBLE) AS s1,
  avg(outflow) AS m2, greatest(stddev_pop(outflow), 1e-6::DOUBLE) AS s2 FROM flow GROUP BY 1) USING (grid_id)
""", ["flow"])


@query("outlier_mask", sql(["flagged"], """
SELECT grid_id, step, inflow, outflow, out_inflow::INT AS out_inflow, out_outflow::INT AS out_outflow
FROM flagged WHERE out_inflow OR out_outflow"""))
def outlier_mask(t: Tables) -> DataFrame:
    d = clean.outlier_flags(fx.flow(t), KEYS, ["inflow", "outflow"])
    return d.where("out_inflow OR out_outflow").select(
        "grid_id", "step", "inflow", "outflow",
        F.col("out_inflow").cast("int").alias("out_inflow"), F.col("out_outflow").cast("int").alias("out_outflow"),
    )


cte("masked", """
SELECT grid_id, step, CASE WHEN NOT out_inflow THEN inflow END AS inflow, CASE WHEN NOT out_outflow THEN outflow END AS outflow FROM flagged
""", ["flagged"])
cte("masked_known", known_sql("masked", "step", ["inflow", "outflow"], "grid_id"), ["masked"])


@query("interp_linear", sql(["masked_known"], f"""
SELECT grid_id, step, {rnd(lerp_sql('inflow', 'step', 'nv_inflow'), 'inflow')}, {rnd(lerp_sql('outflow', 'step', 'nv_outflow'), 'outflow')}
FROM masked_known"""))
def interp_linear(t: Tables) -> DataFrame:
    d = clean.repair_outliers(fx.flow(t), KEYS, "step", ["inflow", "outflow"])
    return d.select("grid_id", "step", r(F.col("inflow")).alias("inflow"), r(F.col("outflow")).alias("outflow"))


cte("null_known", known_sql("flow_null", "step", ["inflow", "outflow"], "grid_id"), ["flow_null"])


@query("interp_time", sql(["null_known"], f"""
SELECT grid_id, step, {rnd(lerp_sql('inflow', 'step', '0'), 'inflow')}, {rnd(lerp_sql('outflow', 'step', '0'), 'outflow')} FROM null_known"""))
def interp_time(t: Tables) -> DataFrame:
    d = series.interpolate(fx.flow_null(t), KEYS, "step", ["inflow", "outflow"], leading="zero")
    return d.select("grid_id", "step", r(F.col("inflow")).alias("inflow"), r(F.col("outflow")).alias("outflow"))


@query("ffill_bfill", sql(["null_known"], """
SELECT grid_id, step, coalesce(pv_inflow, nv_inflow) AS inflow, coalesce(pv_outflow, nv_outflow) AS outflow FROM null_known"""))
def ffill_bfill(t: Tables) -> DataFrame:
    return series.ffill_bfill(fx.flow_null(t), KEYS, "step", ["inflow", "outflow"]).drop("city")


cte("w_steps", """
SELECT s.step, temp, clouds_all FROM (SELECT unnest(range(min(hour) * 2, max(hour) * 2 + 1)) AS step FROM w) s
LEFT JOIN w ON w.hour * 2 = s.step""", ["w"])
cte("w_steps_known", known_sql("w_steps", "step", ["temp", "clouds_all"]), ["w_steps"])


@view
def weather_steps(t: Tables) -> DataFrame:
    return wx.upsample(fx.weather_source(t).drop("wind_speed"), ["city"], ["temp", "clouds_all"])


@query("upsample_asof", sql(["w_steps_known"], f"""
SELECT step, {rnd('pv_temp', 'temp')}, pv_clouds_all AS clouds_all FROM w_steps_known"""))
def upsample_asof(t: Tables) -> DataFrame:
    return weather_steps(t).select("step", r(F.col("temp")).alias("temp"), "clouds_all")


@query("asof_alignment", sql(["sparse", "w"], f"""
SELECT grid_id, step, inflow, {rnd('temp', 'temp')} FROM sparse s ASOF LEFT JOIN (SELECT hour * 2 AS st, temp FROM w) h ON s.step >= h.st"""))
def asof_alignment(t: Tables) -> DataFrame:
    right = fx.weather_source(t).withColumn("step", F.col("hour") * 2)
    d = wx.asof_join(fx.flow_sparse(t), right, ["city"], "step", ["temp"])
    return d.select("grid_id", "step", "inflow", r(F.col("temp")).alias("temp"))


cte("merged", """
SELECT hour, a.temp, a.wind_speed, b.clouds_b FROM (SELECT hour, temp, wind_speed FROM wa) a
FULL JOIN (SELECT hour, clouds_all AS clouds_b FROM wb) b USING (hour)""", ["wa", "wb"])
cte("merged_known", known_sql("merged", "hour", ["temp", "wind_speed", "clouds_b"]), ["merged"])


@view
def merged_weather(t: Tables) -> DataFrame:
    a = fx.weather_source(t, 0).drop("clouds_all")
    b = fx.weather_source(t, 1).withColumnRenamed("clouds_all", "clouds_b")
    return wx.outer_merge(a, b, ["city"], "hour")


@query("weather_outer_merge", sql(["merged_known"], f"""
SELECT hour, {', '.join(rnd(f'coalesce(pv_{c}, nv_{c})', c) for c in ('temp', 'wind_speed', 'clouds_b'))} FROM merged_known"""))
def weather_outer_merge(t: Tables) -> DataFrame:
    return merged_weather(t).select("hour", *[r(F.col(c)).alias(c) for c in ("temp", "wind_speed", "clouds_b")])


@query("flow_covariate_join", sql(["flow", "w_steps_known", "temporal_all", "holidays"], f"""
SELECT grid_id, f.step, inflow, {rnd('pv_temp', 'temp')}, {', '.join(rnd(c, c) for c in _TCOLS)}, is_weekend,
  CASE WHEN CAST(make_timestamp((f.step + 16) * 1800000000) AS DATE) IN (SELECT d FROM holidays) THEN 1 ELSE 0 END AS is_holiday
FROM flow f LEFT JOIN w_steps_known w USING (step) JOIN temporal_all tt USING (step)"""))
def flow_covariate_join(t: Tables) -> DataFrame:
    d = wx.covariates(fx.flow(t), weather_steps(t), ["city"], fx.TZ, fx.holidays(t))
    return d.select(
        "grid_id", "step", "inflow", r(F.col("temp")).alias("temp"), *[r(F.col(c)).alias(c) for c in _TCOLS],
        "is_weekend", "is_holiday",
    )


def forecast_documents(t: Tables) -> DataFrame:
    """One JSON document per day: at most 24 hourly entries each, every third hour of the source."""
    a = fx.weather_source(t).groupBy("city", F.floor(F.col("hour") / 3).alias("h3")).agg(
        r(F.avg("temp"), 4).alias("temp"), F.max("wind_speed").alias("speed"), F.sum("clouds_all").alias("n")
    )
    ts = F.timestamp_seconds(F.col("h3") * 10800)
    code = (F.lit(200) + (F.col("n") * 97) % 700).cast("int")
    item = F.struct(
        tm.ts_text(ts).alias("dt_txt"),
        F.struct("temp", F.col("n").cast("double").alias("humidity")).alias("main"),
        F.struct("speed").alias("wind"),
        F.array(F.struct(code.alias("id"))).alias("weather"),
        F.when(F.col("n") % 2 == 0, 0.5).alias("pop"),
    )
    docs = a.groupBy("city", F.floor(F.col("h3") / 8).alias("day")).agg(F.sort_array(F.collect_list(item)).alias("list"))
    return docs.select("city", "day", F.to_json(F.struct("list")).alias("value"))


cte("fc3", f"""
SELECT hour // 3 * 6 AS step, {rnd('avg(temp)', 'temp', 4)}, max(wind_speed) AS wind_speed, CAST(sum(clouds_all) AS BIGINT) AS n
FROM w GROUP BY 1""", ["w"])
cte("fc3_grid", """
SELECT s.step, temp, wind_speed, CASE WHEN n IS NOT NULL THEN 200 + (n * 97) % 700 END AS weather_code
FROM (SELECT unnest(range(min(step), max(step) + 1)) AS step FROM fc3) s LEFT JOIN fc3 USING (step)""", ["fc3"])
cte("fc3_known", known_sql("fc3_grid", "step", ["temp", "wind_speed", "weather_code"]), ["fc3_grid"])


@query("forecast_json", sql(["fc3"], """
SELECT step, temp AS temperature, CAST(n AS DOUBLE) AS humidity, wind_speed, 200 + (n * 97) % 700 AS weather_code,
  CASE WHEN n % 2 = 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS pop FROM fc3"""))
def forecast_json(t: Tables) -> DataFrame:
    d = src.forecast_records(forecast_documents(t))
    return d.select(tm.step_of(F.col("ts")).alias("step"), "temperature", "humidity", "wind_speed", "weather_code", "pop")


@query("forecast_resample", sql(["fc3_known"], f"""
SELECT step, {rnd(lerp_sql('temp', 'step', 'NULL'), 'temperature')}, {rnd(lerp_sql('wind_speed', 'step', 'NULL'), 'wind_speed')},
  pv_weather_code AS weather_code FROM fc3_known"""))
def forecast_resample(t: Tables) -> DataFrame:
    fc = src.forecast_records(forecast_documents(t)).select(
        F.lit("bj").alias("city"), tm.step_of(F.col("ts")).alias("step"), "temperature", "wind_speed", "weather_code"
    )
    d = wx.resample_forecast(fc, ["city"], "step", ["temperature", "wind_speed"], ["weather_code"], 1)
    return d.select("step", r(F.col("temperature")).alias("temperature"), r(F.col("wind_speed")).alias("wind_speed"), "weather_code")


def raw_weather(t: Tables) -> DataFrame:
    """Hourly weather rows as they arrive: text time, repeats, nulls, a name column."""
    k = F.get_json_object("props", "$.k").cast("int")
    hour = F.timestamp_seconds(F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 10800) * 10800)
    names = F.array(*[F.lit(w) for w in ("Clear", "Rain", "Fog", "Ash")])
    return t.events.select(
        F.lit("bj").alias("city"), "event_id",
        F.concat(tm.ts_text(hour), F.lit(" +0000 UTC")).alias("dt_iso"),
        F.when(k % 3 != 0, F.col("value")).alias("temp"),
        F.when(k % 2 == 0, F.col("value")).alias("rain_1h"),
        F.element_at(names, k % 4 + 1).alias("weather_main"),
        F.lit("x").alias("city_name"),
    )


cte("rw", """
SELECT hour, CASE WHEN k % 3 != 0 THEN value END AS temp, coalesce(CASE WHEN k % 2 = 0 THEN value END, 0) AS rain_1h,
  [0, 2, 7, 15][k % 4 + 1] AS weather_code
FROM (SELECT *, row_number() OVER (PARTITION BY hour ORDER BY event_id) AS rn FROM (
  SELECT event_id, value, step // 6 * 3 AS hour, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM ev)) WHERE rn = 1
""", ["ev"])
cte("rw_known", known_sql("rw", "hour", ["temp"]), ["rw"])
cte("rw_grid", """
SELECT s.hour, coalesce(pv_temp, nv_temp) AS temp, rain_1h, weather_code
FROM (SELECT unnest(range(min(hour), max(hour) + 1)) AS hour FROM rw) s LEFT JOIN rw_known USING (hour)""", ["rw", "rw_known"])
cte("rw_grid_known", known_sql("rw_grid", "hour", ["temp", "rain_1h", "weather_code"]), ["rw_grid"])


@query("weather_clean", sql(["rw_grid_known"], f"""
SELECT hour, {rnd(lerp_sql('temp', 'hour', 'nv_temp'), 'temp')}, {rnd(lerp_sql('rain_1h', 'hour', 'nv_rain_1h'), 'rain_1h')},
  coalesce(pv_weather_code, nv_weather_code) AS weather_code FROM rw_grid_known"""))
def weather_clean(t: Tables) -> DataFrame:
    d = wx.clean_hourly(raw_weather(t), ["city"], "event_id")
    return d.select("hour", r(F.col("temp")).alias("temp"), r(F.col("rain_1h")).alias("rain_1h"), "weather_code")


def sensor_rows(t: Tables) -> DataFrame:
    """Pre-windowed sensor rows: node, local text time of the last input step, its value. Written as
    three splits and read back."""
    five = F.timestamp_seconds(F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 21600) * 21600)
    made = t.events.select(
        "event_id", (F.col("user_id") % 16).alias("node_id"), tm.ts_text(five).alias("t0_timestamp"), F.col("value").alias("x_t+0_d0")
    )
    base = fresh_dir(t.spark, "sensors")
    paths = {name: f"{base}/{name}" for name in ("train", "val", "test")}
    for i, path in enumerate(paths.values()):
        made.where(F.col("event_id") % 3 == i).drop("event_id").write.parquet(path)
    return src.read_sensor_splits(t.spark, paths)


cte("sensor", """
SELECT node, step, greatest(least(avg(value), 100), 0) AS speed FROM (
  SELECT user_id % 16 AS node, step // 12 * 12 + 16 AS step, value FROM ev) GROUP BY ALL
""", ["ev"])
cte("sensor_grid", """
SELECT node, s.step, speed FROM (SELECT node, unnest(range(lo, hi + 1, 12)) AS step FROM (
  SELECT node, min(step) AS lo, max(step) AS hi FROM sensor GROUP BY 1)) s LEFT JOIN sensor USING (node, step)
""", ["sensor"])
cte("sensor_known", known_sql("sensor_grid", "step", ["speed"], "node"), ["sensor_grid"])


@query("sensor_rebuild", sql(["sensor_known"], f"""
SELECT node AS node_id, step, {rnd(lerp_sql('speed', 'step', 'nv_speed'), 'speed')} FROM sensor_known"""))
def sensor_rebuild(t: Tables) -> DataFrame:
    """Series from pre-windowed rows: repeated readings averaged, local time (UTC-8) to UTC by
    adding eight hours, gaps interpolated, speeds clipped."""
    d = sensor_rows(t).select("node_id", "t0_timestamp", F.col("value").alias("speed"))
    utc = tm.shift_hours(F.to_timestamp("t0_timestamp"), 8)
    d = d.groupBy("node_id", tm.step_of(utc).alias("step")).agg(F.avg("speed").alias("speed"))
    d = d.withColumn("speed", clip(F.col("speed"), 0.0, 100.0))
    d = series.interpolate(series.reindex(d, ["node_id"], "step", 12), ["node_id"], "step", ["speed"])
    return d.select("node_id", "step", r(F.col("speed")).alias("speed"))


@query("sensor_wide", sql(["sensor_known"], f"""
SELECT step, {', '.join(rnd(f"max({lerp_sql('speed', 'step', 'nv_speed')}) FILTER (node = {i})", f's{i}') for i in range(16))}
FROM sensor_known GROUP BY step"""))
def sensor_wide(t: Tables) -> DataFrame:
    wide = sensor_rebuild(t).groupBy("step").pivot("node_id", list(range(16))).agg(F.max("speed"))
    return wide.select("step", *[r(F.col(str(i))).alias(f"s{i}") for i in range(16)])


_PROFILE = {
    "n_rows": "count(*)", "n_steps": "count(DISTINCT step)", "first_step": "min(step)", "last_step": "max(step)",
}


@query("dataset_profile", sql(["flow"], " UNION ALL ".join(f"""
SELECT '{c}' AS channel, count(*) AS n_rows, {rnd(f'min({c})', 'vmin')}, {rnd(f'max({c})', 'vmax')}, {rnd(f'avg({c})', 'mean')},
  {rnd(f'stddev_pop({c})', 'std')}, {rnd(f'avg(CASE WHEN {c} = 0 THEN 1 ELSE 0 END)', 'zero_share')},
  {', '.join(rnd(f'quantile_cont({c}, {p}::DOUBLE)', n) for n, p in (('p50', 0.5), ('p90', 0.9), ('p95', 0.95), ('p99', 0.99)))} FROM flow"""
    for c in ("inflow", "outflow"))))
def dataset_profile(t: Tables) -> DataFrame:
    from flowspark.operators.profile import channel_profile

    d = channel_profile(fx.flow(t), ["city"], ["inflow", "outflow"])
    return d.select(
        "channel", "n_rows", *[r(F.col(c)).alias(c) for c in ("vmin", "vmax", "mean", "std", "zero_share", "p50", "p90", "p95", "p99")]
    )


@query("segment_profile", sql(["segmented"], f"""
SELECT segment, {', '.join(f'{e} AS {n}' for n, e in _PROFILE.items())}, {rnd('avg(inflow)', 'mean_in')}, {rnd('avg(outflow)', 'mean_out')},
  {rnd('avg(CASE WHEN inflow < 0 OR outflow < 0 THEN 1 ELSE 0 END)', 'missing_share')} FROM segmented GROUP BY 1"""))
def segment_profile(t: Tables) -> DataFrame:
    from flowspark.operators.profile import segment_profile as profile

    d = profile(segmented(t), ["segment"])
    return d.select("segment", *_PROFILE, *[r(F.col(c)).alias(c) for c in ("mean_in", "mean_out", "missing_share")])


@query("null_rates", sql(["merged"], " UNION ALL ".join(
    f"SELECT '{c}' AS name, {rnd(f'avg(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)', 'null_rate')} FROM merged" for c in ("temp", "wind_speed", "clouds_b"))))
def null_rates(t: Tables) -> DataFrame:
    from flowspark.operators.profile import null_rates as rates

    a = fx.weather_source(t, 0).drop("clouds_all")
    b = fx.weather_source(t, 1).select("city", "hour", F.col("clouds_all").alias("clouds_b"))
    d = a.join(b, ["city", "hour"], "full_outer").drop("city", "hour")
    return rates(d).select("name", r(F.col("null_rate")).alias("null_rate"))


@query("peak_step", sql(["flow"], """
SELECT step, round(sum(inflow), 2) AS total FROM flow GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1"""))
def peak_step(t: Tables) -> DataFrame:
    from flowspark.operators.profile import peak_step as peak

    return peak(fx.flow(t), ["city"]).drop("city")


@query("value_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def value_counts(t: Tables) -> DataFrame:
    from flowspark.operators.profile import value_counts as counts

    return counts(t.events, "event_type")


@query("coverage_rate", sql(["sparse"], f"""
SELECT count(*) AS n_rows, {rnd('avg(CASE WHEN inflow > 0 THEN 1 ELSE 0 END)', 'inflow_share')},
  {rnd('avg(CASE WHEN outflow > 0 THEN 1 ELSE 0 END)', 'outflow_share')}, count(DISTINCT grid_id) FILTER (inflow > 0) AS n_cells FROM sparse"""))
def coverage_rate(t: Tables) -> DataFrame:
    from flowspark.operators.profile import share

    return fx.flow_sparse(t).agg(
        F.count("*").alias("n_rows"), r(share(F.col("inflow") > 0)).alias("inflow_share"),
        r(share(F.col("outflow") > 0)).alias("outflow_share"),
        F.countDistinct(F.when(F.col("inflow") > 0, F.col("grid_id"))).alias("n_cells"),
    )
