"""Time, grid and scaling queries; splits and forecast metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.functions import codes, geo
from flowspark.functions import time as tm
from flowspark.functions.num import rnd as r
from flowspark.operators import forecast as fc
from flowspark.operators import grid as gr
from flowspark.operators import metrics as mt
from flowspark.operators import splits
from flowspark.operators.scale import scale
from flowspark.plans import fixtures as fx
from flowspark.plans.oracle import cte, rnd, sql
from flowspark.plans.registry import query
from flowspark.sources.tables import Tables, view

G, TZ = fx.GRID, fx.TZ


@query("slot_date_parse", sql(["sparse"], """
SELECT grid_id, slot_date, epoch_us(strptime(substr(slot_date, 1, 8), '%Y%m%d')) // 1800000000
  + CAST(substr(slot_date, 9, 2) AS BIGINT) - 1 - 16 AS step
FROM (SELECT grid_id, strftime(make_timestamp((step + 16) * 1800000000), '%Y%m%d')
        || lpad(CAST((step + 16) % 48 + 1 AS VARCHAR), 2, '0') AS slot_date FROM sparse)"""))
def slot_date_parse(t: Tables) -> DataFrame:
    step = F.col("step")
    text = F.concat(
        F.date_format(tm.step_ts(tm.local_step(step, TZ)), "yyyyMMdd"),
        F.lpad((tm.slot_of(step, TZ) + 1).cast("string"), 2, "0"),
    )
    d = fx.flow_sparse(t).select("grid_id", text.alias("slot_date"))
    return d.withColumn("step", tm.step_of(tm.parse_slot_date(F.col("slot_date"), TZ)))


@query("weather_time_parse", sql(["w"], """
SELECT strftime(make_timestamp((hour + 8) * 3600000000), '%Y%m%d%H%M') AS local_text,
       strftime(make_timestamp(hour * 3600000000), '%Y-%m-%d %H:%M:%S') || ' +0000 UTC' AS dt_iso,
       hour * 3600 AS utc_a, hour * 3600 AS utc_b, ((hour + 8) % 24) * 60 AS first_minutes FROM w"""))
def weather_time_parse(t: Tables) -> DataFrame:
    ts = F.timestamp_seconds(F.col("hour") * 3600)
    local = tm.shift_hours(ts, TZ)
    d = fx.weather_source(t).select(
        F.date_format(local, "yyyyMMddHHmm").alias("local_text"),
        F.concat(tm.ts_text(ts), F.lit(" +0000 UTC")).alias("dt_iso"),
        F.date_format(local, "HH:mm").alias("_hm"),
    )
    return d.select(
        "local_text",
        "dt_iso",
        F.unix_seconds(tm.parse_minute_text(F.col("local_text"), TZ)).alias("utc_a"),
        F.unix_seconds(tm.parse_utc_suffix(F.col("dt_iso"))).alias("utc_b"),
        tm.minutes_of_day(F.col("_hm")).alias("first_minutes"),
    )


def _us_holiday_sql(d: str) -> str:
    m, dd, wd = f"month({d})", f"day({d})", f"(isodow({d}) - 1)"
    nth = f"((day({d}) + 6) // 7)"
    parts = [f"({m} = {a} AND {dd} = {b})" for a, b in tm.FIXED_HOLIDAYS]
    parts += [f"({m} = {a} AND {wd} = {w} AND {nth} = {n})" for a, w, n in tm.NTH_WEEKDAY_HOLIDAYS]
    parts += [f"({m} = {a} AND {wd} = {w} AND {dd} + 7 > day(last_day({d})))" for a, w in tm.LAST_WEEKDAY_HOLIDAYS]
    parts += [f"({m} = 7 AND {dd} = 3 AND {wd} = 4)", f"({m} = 7 AND {dd} = 5 AND {wd} = 0)"]
    return "(" + " OR ".join(parts) + ")"


_TEMPORAL = {"slot": ("s % 48", 48), "hour": ("s % 48 // 2", 24), "weekday": ("isodow(ts) - 1", 7),
             "month": ("month(ts) - 1", 12), "doy": ("dayofyear(ts) - 1", 366)}
for _name, _steps in (("temporal", "ev"), ("temporal_all", "cal")):
    cte(_name, f"""
SELECT s - 16 AS step, {', '.join(f"sin(2 * pi() * ({x}) / {p}) AS {n}_sin, cos(2 * pi() * ({x}) / {p}) AS {n}_cos" for n, (x, p) in _TEMPORAL.items())},
  CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END AS is_weekend,
  CASE WHEN {_us_holiday_sql('ts')} THEN 1 ELSE 0 END AS is_holiday
FROM (SELECT DISTINCT step + 16 AS s, make_timestamp((step + 16) * 1800000000) AS ts FROM {_steps})
""", [_steps])
_TCOLS = [f"{n}_{f}" for n in _TEMPORAL for f in ("sin", "cos")]


@query("cyclic_time_features", sql(["temporal"], f"""
SELECT step, {', '.join(rnd(c, c) for c in _TCOLS)}, is_weekend, is_holiday FROM temporal"""))
def cyclic_time_features(t: Tables) -> DataFrame:
    steps = fx.flow_sparse(t).select("step").distinct()
    cols = tm.temporal_columns(tm.step_ts(tm.local_step(F.col("step"), TZ)))
    holiday = tm.is_us_holiday(tm.local_date(F.col("step"), TZ)).cast("int")
    return steps.select(
        "step", *[r(cols[c]).alias(c) for c in _TCOLS], cols["is_weekend"].alias("is_weekend"),
        holiday.alias("is_holiday"),
    )


@query("us_holidays", f"""
SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total
FROM orders WHERE {_us_holiday_sql('o_orderdate')} GROUP BY 1""")
def us_holidays(t: Tables) -> DataFrame:
    d = F.col("o_orderdate").cast("date")
    return (
        t.orders.where(tm.is_us_holiday(d))
        .groupBy(F.date_format(d, "yyyy-MM-dd").alias("day"))
        .agg(F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    )


@view
def cell_points(t: Tables) -> DataFrame:
    """Events at their location, with the cell."""
    n = fx.osm_nodes(t)
    return n.withColumn("grid_id", geo.cell_id(F.col("lon"), F.col("lat"), G))


cte("cells", """
SELECT g.range AS grid_id, g.range // 8 AS "row", g.range % 8 AS col,
  116.25::DOUBLE + (g.range % 8) * 0.0625::DOUBLE AS lon_min, 40.25::DOUBLE - (g.range // 8) * 0.0625::DOUBLE AS lat_max,
  116.25::DOUBLE + (g.range % 8 + 0.5::DOUBLE) * 0.0625::DOUBLE AS center_lon,
  40.25::DOUBLE - (g.range // 8 + 0.5::DOUBLE) * 0.0625::DOUBLE AS center_lat,
  0.0625::DOUBLE * 111.32::DOUBLE * 0.0625::DOUBLE * 111.32::DOUBLE
    * cos(radians(40.25::DOUBLE - (g.range // 8 + 0.5::DOUBLE) * 0.0625::DOUBLE)) AS area_km2
FROM range(64) g""")


@query("grid_metadata", sql(["cells", "nodes"], f"""
SELECT c.grid_id, "row", col, {rnd('center_lon', 'center_lon')}, {rnd('center_lat', 'center_lat')},
  {rnd('lon_min', 'lon_min')}, {rnd('lon_min + 0.0625::DOUBLE', 'lon_max')}, {rnd('lat_max - 0.0625::DOUBLE', 'lat_min')},
  {rnd('lat_max', 'lat_max')}, {rnd('area_km2', 'area_km2')}, coalesce(n, 0) AS n_points
FROM cells c LEFT JOIN (SELECT grid_id, count(*) AS n FROM nodes GROUP BY 1) p USING (grid_id)"""))
def grid_metadata(t: Tables) -> DataFrame:
    counts = cell_points(t).groupBy("grid_id").agg(F.count("*").alias("n_points"))
    d = gr.onto_grid(gr.grid_table(t.spark, G), counts, ["grid_id"])
    num = ["center_lon", "center_lat", "lon_min", "lon_max", "lat_min", "lat_max", "area_km2"]
    return d.select("grid_id", "row", "col", *[r(F.col(c)).alias(c) for c in num], "n_points")


@query("cell_assign", f"""
SELECT event_id, {fx.cell_sql('lon', 'lat')} AS south_rule,
  (CAST(ceil((40.25::DOUBLE - lat) / 0.0625::DOUBLE) AS BIGINT) - 1) * 8 + CAST(floor((lon - 116.25::DOUBLE) / 0.0625::DOUBLE) AS BIGINT) AS north_rule,
  CASE WHEN lat <= 40.1::DOUBLE AND lat > 39.9::DOUBLE AND lon >= 116.4::DOUBLE AND lon < 116.6::DOUBLE
    THEN CAST(floor((40.1::DOUBLE - lat) / 0.05::DOUBLE) AS BIGINT) * 4 + CAST(floor((lon - 116.4::DOUBLE) / 0.05::DOUBLE) AS BIGINT)
    ELSE -1 END AS inner_box
FROM (SELECT event_id, {fx.lon_sql('event_id')} AS lon, {fx.lat_sql('event_id')} AS lat FROM events)""")
def cell_assign(t: Tables) -> DataFrame:
    i = F.col("event_id")
    lon, lat = fx.point_lon(i), fx.point_lat(i)
    inner = geo.GridSpec("bj", 116.4, 116.6, 39.9, 40.1, 4, 4, 8)
    return t.events.select(
        "event_id",
        geo.cell_id(lon, lat, G).alias("south_rule"),
        geo.cell_id(lon, lat, G, closed="north").alias("north_rule"),
        geo.cell_id(lon, lat, inner).alias("inner_box"),
    )


def _hav(lon: str, lat: str, p: tuple[float, float]) -> str:
    lo, la = f"{p[0]!r}::DOUBLE", f"{p[1]!r}::DOUBLE"
    a = (f"pow(sin(radians({la} - {lat}) / 2), 2) + cos(radians({lat})) * cos(radians({la})) "
         f"* pow(sin(radians({lo} - {lon}) / 2), 2)")
    return f"(2 * 6371.0::DOUBLE * asin(sqrt({a})))"


_LM = geo.LANDMARKS["bj"]


def _least(ps) -> str:
    return "least(" + ", ".join(_hav("center_lon", "center_lat", p) for p in ps) + ")"


_LM_SQL = {"dist_center_km": _least(_LM["city_center"]), "dist_hub_min_km": _least(_LM["transport"]),
           "dist_commercial_min_km": _least(_LM["commercial"])}
_LM_SQL |= {f"dist_hub{i + 1}_km": _hav("center_lon", "center_lat", p) for i, p in enumerate(_LM["transport"])}
_LM_SQL |= {f"dist_com{i + 1}_km": _hav("center_lon", "center_lat", p) for i, p in enumerate(_LM["commercial"])}
cte("dists", f"SELECT grid_id, {', '.join(f'{v} AS {k}' for k, v in _LM_SQL.items())} FROM cells", ["cells"])


@query("haversine_landmarks", sql(["dists", "nodes"], f"""
SELECT grid_id, {', '.join(rnd(k, k) for k in _LM_SQL)} FROM dists WHERE grid_id IN (SELECT grid_id FROM nodes)"""))
def haversine_landmarks(t: Tables) -> DataFrame:
    occupied = cell_points(t).select("grid_id").distinct()
    d = gr.landmark_distances(occupied, G, geo.LANDMARKS["bj"])
    return d.select("grid_id", *[r(F.col(c)).alias(c) for c in _LM_SQL])


@query("ring_bucket", sql(["dists", "nodes"], """
SELECT ring, count(*) AS n_cells, CAST(sum(n) AS BIGINT) AS n_points FROM (
  SELECT CASE WHEN dist_center_km > 16 THEN 5 WHEN dist_center_km > 11 THEN 4 WHEN dist_center_km > 7 THEN 3
    WHEN dist_center_km > 3.5 THEN 2 ELSE 1 END AS ring, n
  FROM dists JOIN (SELECT grid_id, count(*) AS n FROM nodes GROUP BY 1) USING (grid_id)) GROUP BY 1"""))
def ring_bucket(t: Tables) -> DataFrame:
    counts = cell_points(t).groupBy("grid_id").agg(F.count("*").alias("n"))
    d = gr.landmark_distances(counts, G, geo.LANDMARKS["bj"])
    return (
        d.groupBy(geo.ring_of(F.col("dist_center_km")).alias("ring"))
        .agg(F.count("*").alias("n_cells"), F.sum("n").alias("n_points"))
    )


cte("cell_means", "SELECT grid_id, avg(inflow) AS m_in, avg(outflow) AS m_out FROM flow GROUP BY 1", ["flow"])


@view
def cell_means(t: Tables) -> DataFrame:
    return fx.flow(t).groupBy(*fx.KEYS).agg(F.avg("inflow").alias("m_in"), F.avg("outflow").alias("m_out"))


@query("minmax_scale", sql(["cell_means"], f"""
SELECT grid_id, {rnd('(m_in - min(m_in) OVER ()) / (max(m_in) OVER () - min(m_in) OVER () + 1e-8::DOUBLE)', 'm_in')},
  {rnd('(m_out - min(m_out) OVER ()) / (max(m_out) OVER () - min(m_out) OVER () + 1e-8::DOUBLE)', 'm_out')} FROM cell_means"""))
def minmax_scale(t: Tables) -> DataFrame:
    d = scale(cell_means(t), ["city"], minmax=["m_in", "m_out"])
    return d.select("grid_id", r(F.col("m_in")).alias("m_in"), r(F.col("m_out")).alias("m_out"))


@query("zscore_scale", sql(["cell_means"], f"""
SELECT grid_id, {rnd('(m_in - avg(m_in) OVER ()) / (stddev_pop(m_in) OVER () + 1e-8::DOUBLE)', 'm_in')},
  {rnd('(ln(1 + m_out) - avg(ln(1 + m_out)) OVER ()) / (stddev_pop(ln(1 + m_out)) OVER () + 1e-8::DOUBLE)', 'm_out')}
FROM cell_means"""))
def zscore_scale(t: Tables) -> DataFrame:
    d = scale(cell_means(t), ["city"], zscore=["m_in"], log_zscore=["m_out"])
    return d.select("grid_id", r(F.col("m_in")).alias("m_in"), r(F.col("m_out")).alias("m_out"))


@query("train_normalise", sql(["flow"], f"""
SELECT grid_id, step, {rnd('(inflow - m) / (s + 1e-8::DOUBLE)', 'inflow')}, {rnd('(outflow - m) / (s + 1e-8::DOUBLE)', 'outflow')}
FROM flow, (SELECT avg(x) AS m, stddev_pop(x) AS s FROM (SELECT unnest([inflow, outflow]) AS x FROM flow WHERE is_train))""", once=True))
def train_normalise(t: Tables) -> DataFrame:
    d = fx.flow_split(t)
    stats = splits.channel_stats(d.where("is_train"), ["city"], ["inflow", "outflow"])
    out = splits.normalise(d, stats, ["city"], ["inflow", "outflow"])
    return out.select("grid_id", "step", r(F.col("inflow")).alias("inflow"), r(F.col("outflow")).alias("outflow"))


@query("chrono_split", sql(["sparse"], """
SELECT split, count(*) AS n_rows, count(DISTINCT step) AS n_steps, min(step) AS first_step, max(step) AS last_step FROM (
  SELECT *, CASE WHEN pos < CAST(floor(n * 0.7::DOUBLE) AS BIGINT) THEN 'train'
    WHEN pos < CAST(floor(n * (0.7::DOUBLE + 0.1::DOUBLE)) AS BIGINT) THEN 'val' ELSE 'test' END AS split
  FROM (SELECT s.step, pos, n FROM sparse s JOIN (
    SELECT step, row_number() OVER (ORDER BY step) - 1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT step FROM sparse)) USING (step))
) GROUP BY 1"""))
def chrono_split(t: Tables) -> DataFrame:
    d = splits.chrono_split(fx.flow_sparse(t), ["city"], "step")
    return d.groupBy("split").agg(
        F.count("*").alias("n_rows"), F.countDistinct("step").alias("n_steps"),
        F.min("step").alias("first_step"), F.max("step").alias("last_step"),
    )


def segmented(t: Tables) -> DataFrame:
    """Four segments by event time: eight days each."""
    d = fx.flow_sparse(t).join(fx.full_days(fx.flow_sparse(t)), "city")
    return d.withColumn("segment", F.floor((F.col("step") - F.col("lo")) / (48 * 8))).drop("lo", "hi")


cte("segmented", "SELECT s.*, (step - lo) // 384 AS segment FROM sparse s, bounds", ["sparse", "bounds"])


@query("segment_split", sql(["segmented"], """
SELECT segment, split, count(*) AS n_rows FROM (
  SELECT s.segment, CASE WHEN s.segment = 3 THEN 'test' WHEN s.segment = 2 AND s.step >= cut THEN 'val' ELSE 'train' END AS split
  FROM segmented s, (SELECT min(step) FILTER (pos >= floor(n * 0.75::DOUBLE)) AS cut FROM (
    SELECT step, row_number() OVER (ORDER BY step) - 1 AS pos, count(*) OVER () AS n
    FROM (SELECT DISTINCT step FROM segmented WHERE segment = 2)))) GROUP BY ALL"""))
def segment_split(t: Tables) -> DataFrame:
    d = splits.segment_split(segmented(t), ["city"], "step", "segment", train=[0, 1, 2], test=[3])
    return d.groupBy("segment", "split").agg(F.count("*").alias("n_rows"))


@view
def predictions(t: Tables) -> DataFrame:
    """Historical average on the test rows, with the step inside 48-step blocks."""
    d = fc.historical_average(fx.flow_split(t), "inflow", fx.KEYS)
    cut = fx.full_days(fx.flow_sparse(t)).select(
        "city", (F.col("lo") + F.floor((F.col("hi") - F.col("lo") + 1) * fx.TRAIN_SHARE)).alias("_cut")
    )
    pos = F.col("step") - F.col("_cut")
    return d.join(cut, "city").withColumns({"block": F.floor(pos / 48), "h": pos % 48 + 1}).drop("_cut")


cte("preds", """
SELECT f.grid_id, f.step, f.inflow AS y, mu AS y_hat, (f.step - cut) // 48 AS block, (f.step - cut) % 48 + 1 AS h
FROM flow f JOIN base USING (grid_id, slot), (SELECT min(step) AS cut FROM flow WHERE NOT is_train) WHERE NOT is_train
""", ["flow", "base"])


@query("historical_average", sql(["preds"], f"SELECT grid_id, step, block, h, y, {rnd('y_hat', 'y_hat')} FROM preds"))
def historical_average(t: Tables) -> DataFrame:
    return predictions(t).select("grid_id", "step", "block", "h", "y", r(F.col("y_hat")).alias("y_hat"))


@query("recent_mean_fallback", sql(["flow"], f"""
SELECT grid_id, {rnd('avg(inflow)', 'fallback')} FROM (
  SELECT *, row_number() OVER (PARTITION BY grid_id ORDER BY step DESC) AS rn FROM flow WHERE is_train) WHERE rn <= 48 GROUP BY 1"""))
def recent_mean_fallback(t: Tables) -> DataFrame:
    d = fc.recent_mean(fx.flow_split(t).where("is_train"), "inflow", fx.KEYS, "step")
    return d.select("grid_id", r(F.col("fallback")).alias("fallback"))


_M = {"mae": "coalesce(avg(abs(y_hat - y)) FILTER ({m}), 0)",
      "rmse": "sqrt(coalesce(avg((y_hat - y) * (y_hat - y)) FILTER ({m}), 0))",
      "mape": "coalesce(avg(abs(y_hat - y) / (abs(y) + 1)) FILTER ({m}), 0) * 100"}


def metric_sql(mask: str = "abs(y) > 0") -> str:
    return ", ".join(rnd(e.format(m=mask), k) for k, e in _M.items())


def metric_cols() -> list:
    return [r(F.col(c)).alias(c) for c in _M]


@query("masked_metrics", sql(["preds"], f"""
SELECT grid_id, {metric_sql()}, {rnd('avg(CASE WHEN abs(y_hat - y) <= 1 THEN (y_hat - y) * (y_hat - y) / 2 ELSE abs(y_hat - y) - 0.5 END)', 'huber')}
FROM preds GROUP BY 1"""))
def masked_metrics(t: Tables) -> DataFrame:
    truth = fx.flow(t).select(*fx.KEYS, "step", F.col("inflow").alias("y"))
    d = mt.masked_metrics(mt.align_truth(predictions(t).select(*fx.KEYS, "step", "y_hat"), truth, [*fx.KEYS, "step"]), ["grid_id"])
    return d.select("grid_id", *metric_cols(), r(F.col("huber")).alias("huber"))


@query("horizon_metrics", sql(["preds"], " UNION ALL ".join(
    f"SELECT '{n}' AS horizon, {metric_sql(f'abs(y) > 0 AND {p}')} FROM preds"
    for n, p in [*[(f"h{k}", f"h <= {k}") for k in mt.HORIZONS], ("avg", "true")])))
def horizon_metrics(t: Tables) -> DataFrame:
    return mt.horizon_metrics(predictions(t), ["city"], 48).select("horizon", *metric_cols())


@query("horizon_metrics_exact", sql(["preds"], " UNION ALL ".join(
    f"SELECT '{n}' AS horizon, {metric_sql(f'abs(y) > 0 AND {p}')} FROM preds"
    for n, p in [*[(f"h{k}", f"h = {k}") for k in mt.HORIZONS], ("avg", "true")])))
def horizon_metrics_exact(t: Tables) -> DataFrame:
    return mt.horizon_metrics(predictions(t), ["city"], 48, exact=True).select("horizon", *metric_cols())


_WN = [*codes.WEATHER_MAIN_CODE, "Ash", "Cold"]


@query("weather_encode", f"""
SELECT event_id, main, CASE main {' '.join(f"WHEN '{k}' THEN {v}" for k, v in codes.WEATHER_MAIN_CODE.items())} ELSE 15 END AS code,
  CASE {' '.join(f"WHEN id BETWEEN {a} AND {b} THEN '{x}'" for a, b, x in codes.WEATHER_ID_RANGES)} ELSE '{codes.WEATHER_ID_UNKNOWN}' END AS description
FROM (SELECT event_id, {_WN!r}[k % {len(_WN)} + 1] AS main, 200 + (k * 23) % 701 AS id
  FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))""")
def weather_encode(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    d = t.events.select(
        "event_id",
        F.element_at(F.array(*[F.lit(w) for w in _WN]), k % len(_WN) + 1).alias("main"),
        (F.lit(200) + (k * 23) % 701).alias("id"),
    )
    return d.select(
        "event_id", "main", codes.weather_code(F.col("main")).alias("code"),
        codes.weather_text(F.col("id")).alias("description"),
    )
