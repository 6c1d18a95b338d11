"""Declared schemas (DDL) of the tables the jobs read and write."""

from __future__ import annotations

FLOW = ("city STRING, ts TIMESTAMP, grid_id BIGINT, inflow DOUBLE, outflow DOUBLE")
WEATHER_HOURLY = (
    "dt_iso STRING, temp DOUBLE, dew_point DOUBLE, pressure DOUBLE, humidity DOUBLE, "
    "wind_speed DOUBLE, wind_deg DOUBLE, rain_1h DOUBLE, snow_1h DOUBLE, clouds_all DOUBLE, "
    "weather_id INT, weather_main STRING"
)
WEATHER_PRIMARY = (
    "time STRING, temperature DOUBLE, wind_speed DOUBLE, precipitation DOUBLE, weather_code INT"
)
FORECAST = (
    "list ARRAY<STRUCT<dt_txt: STRING, main: STRUCT<temp: DOUBLE, humidity: DOUBLE>, "
    "wind: STRUCT<speed: DOUBLE>, weather: ARRAY<STRUCT<id: INT>>, pop: DOUBLE>>"
)
OSM_NODES = ("id BIGINT, lon DOUBLE, lat DOUBLE, tags MAP<STRING,STRING>")
OSM_WAYS = ("id BIGINT, tags MAP<STRING,STRING>, coords ARRAY<STRUCT<lon: DOUBLE, lat: DOUBLE>>")
OSM_RELATIONS = (
    "id BIGINT, tags MAP<STRING,STRING>, "
    "members ARRAY<STRUCT<type: STRING, ref: BIGINT, role: STRING>>"
)
EDGES = ("city STRING, graph STRING, src BIGINT, dst BIGINT, weight DOUBLE")
METRICS_COLUMNS = {
    "model": "string", "city": "string", "t_in": "int", "t_out": "int", "tag": "string",
    "horizon": "string", "mae": "double", "rmse": "double", "mape": "double", "config": "string",
}
METRICS_LOG = ", ".join(f"{c} {t}" for c, t in METRICS_COLUMNS.items())
EVENTS = (
    "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
)
