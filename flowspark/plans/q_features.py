"""Static feature queries and the 41-column assembly."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.functions import codes, geo
from flowspark.functions.num import rnd as r
from flowspark.operators import features as ft
from flowspark.operators import grid as gr
from flowspark.operators import transit as tr
from flowspark.operators.profile import distinct_sketches, distinct_within
from flowspark.plans import fixtures as fx
from flowspark.plans.oracle import cte, rnd, sql
from flowspark.plans.registry import query
from flowspark.plans.q_scalars import _TCOLS  # noqa: F401  (registers the shared fragments)
from flowspark.sources import tables as src
from flowspark.sources.tables import Tables, view

G = fx.GRID
PX, SIZE = 0.5 / 60, 64


def _rounded(df: DataFrame, cols: list[str], keep: list[str] = ("grid_id",)) -> DataFrame:
    return df.select(*keep, *[r(F.col(c)).alias(c) for c in cols])


@view
def classified(t: Tables) -> DataFrame:
    n = src.tagged_points(fx.osm_nodes(t), G, F.lit(True))
    return n.withColumns({
        "category": codes.poi_class(F.col("tags")), "transit": codes.transit_class(F.col("tags")),
        "grid_id": geo.cell_id(F.col("lon"), F.col("lat"), G),
    })


cte("rules", "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in codes.tag_rules().items()) + ") v(tag, cls)")
cte("classified", """
SELECT n.*, coalesce(a.cls, b.cls, c.cls) AS category,
  CASE WHEN is_station THEN 'subway_station' WHEN is_entrance THEN 'subway_entrance' WHEN key1 = 'highway' AND val1 = 'bus_stop' THEN 'bus_stop' END AS transit
FROM nodes n LEFT JOIN rules a ON a.tag = key1 || '=' || val1 LEFT JOIN rules b ON b.tag = key1 || '=*'
LEFT JOIN rules c ON c.tag = 'building=' || val2
""", ["nodes", "rules"])


@query("tag_classify", sql(["classified"], "SELECT id, grid_id, category, transit FROM classified"))
def tag_classify(t: Tables) -> DataFrame:
    return classified(t).select("id", "grid_id", "category", "transit")


def _class_sql(name: str, column: str, classes: list[str]) -> None:
    cols = ", ".join(
        f"coalesce({c}, 0) AS {c}_count, coalesce({c}, 0) / area_km2 AS {c}_density" for c in classes
    )
    counts = ", ".join(f"count(*) FILTER ({column} = '{c}') AS {c}" for c in classes)
    cte(name, f"""SELECT g.grid_id, {cols} FROM cells g LEFT JOIN (
        SELECT grid_id, {counts} FROM classified GROUP BY 1) c USING (grid_id)""", ["cells", "classified"])


_class_sql("poi", "category", codes.POI_CLASSES)
_class_sql("transit", "transit", ft.TRANSIT_CLASSES)


def _count_select(classes: list[str]) -> str:
    return ", ".join(f"{c}_count, {rnd(f'{c}_density', f'{c}_density')}" for c in classes)


def _counts(df: DataFrame, classes: list[str]) -> DataFrame:
    return df.select("grid_id", *[x for c in classes for x in (F.col(f"{c}_count"), r(F.col(f"{c}_density")).alias(f"{c}_density"))])


@query("poi_counts_pivot", sql(["poi"], f"SELECT grid_id, {_count_select(codes.POI_CLASSES)} FROM poi"))
def poi_counts_pivot(t: Tables) -> DataFrame:
    return _counts(ft.class_counts(classified(t), G, "category", codes.POI_CLASSES), codes.POI_CLASSES)


@query("transit_density", sql(["transit"], f"SELECT grid_id, {_count_select(ft.TRANSIT_CLASSES)} FROM transit"))
def transit_density(t: Tables) -> DataFrame:
    return _counts(ft.class_counts(classified(t), G, "transit", ft.TRANSIT_CLASSES), ft.TRANSIT_CLASSES)


@view
def parking(t: Tables) -> DataFrame:
    p = src.tagged_points(fx.osm_nodes(t), G, F.col("tags")["amenity"] == "parking")
    p = p.select(geo.cell_id(F.col("lon"), F.col("lat"), G).alias("grid_id"), F.lit("parking").alias("kind"))
    return ft.class_counts(p, G, "kind", ["parking"])


cte("parking", """
SELECT g.grid_id, coalesce(n, 0) AS parking_count, coalesce(n, 0) / area_km2 AS parking_density FROM cells g LEFT JOIN (
  SELECT grid_id, count(*) AS n FROM nodes WHERE key1 = 'amenity' AND val1 = 'parking' GROUP BY 1) USING (grid_id)
""", ["cells", "nodes"])


@query("parking_density", sql(["parking"], f"SELECT grid_id, parking_count, {rnd('parking_density', 'parking_density')} FROM parking"))
def parking_density(t: Tables) -> DataFrame:
    return _counts(parking(t), ["parking"])


@view
def street(t: Tables) -> DataFrame:
    kind = codes.street_class(F.col("tags"))
    p = src.tagged_points(fx.osm_nodes(t), G, kind.isNotNull())
    return ft.class_counts(p.select(geo.cell_id(F.col("lon"), F.col("lat"), G).alias("grid_id"), kind.alias("kind")), G, "kind", list(codes.STREET_TAGS))


_STREET = ", ".join(f"coalesce(n_{n}, 0) AS {n}_count, {rnd(f'coalesce(n_{n}, 0) / area_km2', f'{n}_density')}" for n in codes.STREET_TAGS)


@query("street_density", sql(["cells", "nodes"], f"""
SELECT g.grid_id, {_STREET} FROM cells g LEFT JOIN (
  SELECT grid_id, {', '.join(f"count(*) FILTER (key1 = '{k}' AND val1 = '{v}') AS n_{n}" for n, (k, v) in codes.STREET_TAGS.items())} FROM nodes GROUP BY 1) USING (grid_id)"""))
def street_density(t: Tables) -> DataFrame:
    """Crossings, signals and bicycle rental per cell, in one pass."""
    return _counts(street(t), list(codes.STREET_TAGS))


_LEN = "CAST(sqrt(pow(({bx} - {ax}) * 111.32::DOUBLE * cos(radians(({ay} + {by}) / 2)), 2) + pow(({by} - {ay}) * 111.32::DOUBLE, 2)) AS DOUBLE)"
_AT = {f"{a}{q}": f"({a}0 + ({a}1 - {a}0) * t{i})" for a in "xy" for i, q in ((0, "s"), (1, "e"))}
cte("roads", f"""
SELECT kind, grid_id, {_LEN.format(ax=_AT['xs'], ay=_AT['ys'], bx=_AT['xe'], by=_AT['ye'])} AS km FROM (
  SELECT *, greatest(0.0, CASE WHEN x1 != x0 THEN least((w - x0) / (x1 - x0), (e - x0) / (x1 - x0)) WHEN floor((x0 - 116.25::DOUBLE) / 0.0625::DOUBLE) = col THEN 0 ELSE 2 END,
      CASE WHEN y1 != y0 THEN least((s - y0) / (y1 - y0), (n - y0) / (y1 - y0)) WHEN floor((40.25::DOUBLE - y0) / 0.0625::DOUBLE) = "row" THEN 0 ELSE 2 END) AS t0,
    least(1.0, CASE WHEN x1 != x0 THEN greatest((w - x0) / (x1 - x0), (e - x0) / (x1 - x0)) ELSE 1 END,
      CASE WHEN y1 != y0 THEN greatest((s - y0) / (y1 - y0), (n - y0) / (y1 - y0)) ELSE 1 END) AS t1
  FROM (SELECT kind, x0, y0, x1, y1 FROM kept UNION ALL SELECT kind, x1, y1, x2, y2 FROM kept) sg,
    (SELECT grid_id, "row", col, lon_min AS w, lon_min + 0.0625::DOUBLE AS e, lat_max AS n, lat_max - 0.0625::DOUBLE AS s FROM cells) c
) WHERE t1 > t0
""", ["kept", "cells"])
cte("kept", f"""
SELECT * FROM ways WHERE kind IN ({', '.join(repr(x) for x in codes.ROAD_TYPES)}) AND (
  {' OR '.join(f"(x{i} BETWEEN 116.25::DOUBLE AND 116.75::DOUBLE AND y{i} BETWEEN 39.75::DOUBLE AND 40.25::DOUBLE)" for i in range(3))})
""", ["ways"])
_GRP = {g: " AND kind IN (" + ", ".join(repr(x) for x in ts) + ")" for g, ts in codes.ROAD_GROUPS.items()}
cte("road", f"""
SELECT c.grid_id, coalesce(sum(km), 0) / any_value(area_km2) AS road_density_km_km2,
  {', '.join(f"coalesce(sum(km) FILTER (true{p}), 0) / any_value(area_km2) AS {g}_density" for g, p in _GRP.items())}
FROM cells c LEFT JOIN roads USING (grid_id) GROUP BY 1
""", ["cells", "roads"])


@view
def road(t: Tables) -> DataFrame:
    ways = src.polylines(fx.osm_ways(t), G, codes.ROAD_TYPES)
    return ft.road_features(ft.road_pieces(ways, G), G)


@query("road_density", sql(["road"], f"SELECT grid_id, {', '.join(rnd(c, c) for c in ft.ROAD)} FROM road"))
def road_density(t: Tables) -> DataFrame:
    return _rounded(road(t), ft.ROAD)


def _rho(b: int) -> str:
    return f"CASE WHEN dn{b} != 0 THEN greatest(least((2e-5::DOUBLE * dn{b} + (-0.1)::DOUBLE) / sin(radians(sun)), 1.0), 0.0) END AS b{b}"


def _nd(a: str, b: str) -> str:
    return f"CASE WHEN abs({a} + {b}) > 1e-6 THEN ({a} - {b}) / ({a} + {b}) END"


cte("bands", f"""
SELECT "row", col, b4, {_nd('b5', 'b4')} AS ndvi, {_nd('b6', 'b5')} AS ndbi, {_nd('b3', 'b6')} AS mndwi FROM (
  SELECT "row", col, {', '.join(_rho(b) for b in (3, 4, 5, 6))} FROM pixels, (SELECT count(*) * 10.0::DOUBLE AS sun FROM region))
""", ["pixels"])
_HOLD = "p.{a} >= floor(c.{a} * 0.0625::DOUBLE / {px!r}::DOUBLE) AND p.{a} < least(ceil((c.{a} + 1) * 0.0625::DOUBLE / {px!r}::DOUBLE), 64)"
cte("raster", f"""
SELECT c.grid_id, coalesce(avg(ndvi), 0) AS ndvi, coalesce(avg(ndbi), 0) AS ndbi, coalesce(avg(mndwi), 0) AS mndwi,
  coalesce(avg(b4), 0) AS b4_mean, coalesce(stddev_pop(b4), 0) AS b4_std
FROM cells c LEFT JOIN bands p ON {_HOLD.format(a='col', px=PX)} AND {_HOLD.format(a='"row"', px=PX)} GROUP BY 1
""", ["cells", "bands"])


@view
def raster(t: Tables) -> DataFrame:
    return ft.raster_features(ft.pixel_bands(fx.pixels(t), fx.scenes(t)), G, PX, SIZE, SIZE)


@query("spectral_index_grid", sql(["raster"], f"SELECT grid_id, {', '.join(rnd(c, c) for c in ft.RASTER)} FROM raster"))
def spectral_index_grid(t: Tables) -> DataFrame:
    return _rounded(raster(t), ft.RASTER)


cte("hist", """
SELECT grid_id, (mean - min(mean) OVER ()) / (max(mean) OVER () - min(mean) OVER () + 1e-8::DOUBLE) AS hist_mean,
  p99 / (max(p99) OVER () + 1e-8::DOUBLE) AS hist_p99, zero_rate,
  least(greatest(coalesce(peak, wd) / (wd + 1e-8::DOUBLE), 0), 5) AS peak_ratio, least(greatest(we / (wd + 1e-8::DOUBLE), 0), 5) AS weekend_ratio,
  least(greatest(night / (mean + 1e-8::DOUBLE), 0), 1) AS night_ratio,
  (net - min(net) OVER ()) / (max(net) OVER () - min(net) OVER () + 1e-8::DOUBLE) AS flow_dir,
  least(greatest(sd / (mean + 1e-8::DOUBLE), 0), 5) AS flow_cv
FROM (SELECT grid_id, avg(inflow) AS mean, quantile_cont(inflow, 0.99::DOUBLE) AS p99, avg(CASE WHEN inflow = 0 THEN 1 ELSE 0 END) AS zero_rate,
  coalesce(avg(inflow) FILTER (wd < 5), avg(inflow)) AS wd, avg(inflow) FILTER (wd < 5 AND slot // 2 IN (7, 8)) AS peak,
  coalesce(avg(inflow) FILTER (wd >= 5), avg(inflow)) AS we, avg(inflow) FILTER (slot // 2 < 6) AS night,
  avg(inflow - outflow) AS net, stddev_pop(inflow) AS sd
  FROM (SELECT *, ((step + 16) // 48 + 3) % 7 AS wd FROM flow WHERE is_train) GROUP BY 1)
""", ["flow"])


@view
def history(t: Tables) -> DataFrame:
    return ft.history_features(fx.flow_split(t).where("is_train"), fx.KEYS, fx.TZ)


@query("cell_hist_stats", sql(["hist"], f"SELECT grid_id, {', '.join(rnd(c, c) for c in ft.HISTORY)} FROM hist"))
def cell_hist_stats(t: Tables) -> DataFrame:
    return _rounded(history(t), ft.HISTORY)


cte("lines", """
SELECT grid_id, count(DISTINCT line) AS num_subway_lines, max(CASE WHEN n >= 2 THEN 1 ELSE 0 END) AS is_transfer_hub
FROM stations JOIN (SELECT grid_id, station, count(DISTINCT line) AS n FROM stations GROUP BY ALL) USING (grid_id, station) GROUP BY 1
""", ["stations"])


@query("hub_flag", sql(["lines"], "SELECT * FROM lines"))
def hub_flag(t: Tables) -> DataFrame:
    return tr.cell_lines(fx.stations(t))


cte("stops", f"SELECT p_partkey AS stop_id, {fx.cell_sql(fx.lon_sql('p_partkey'), fx.lat_sql('p_partkey'))} AS grid_id FROM part")
cte("stop_routes", """
SELECT DISTINCT l_partkey AS stop_id, o_custkey AS route_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE l_partkey IN (SELECT stop_id FROM stops)""", ["stops"])
cte("bus", "SELECT grid_id, count(DISTINCT route_id) AS num_bus_routes FROM stop_routes JOIN stops USING (stop_id) GROUP BY 1", ["stops", "stop_routes"])


@view
def stops_in_grid(t: Tables) -> DataFrame:
    s = src.numeric_or_drop(fx.stops(t), ["stop_lon", "stop_lat"])
    return tr.stop_cells(s, geo.cell_id(F.col("stop_lon"), F.col("stop_lat"), G))


@query("stop_routes", sql(["stop_routes"], "SELECT stop_id, count(*) AS n_routes FROM stop_routes GROUP BY 1"))
def stop_routes(t: Tables) -> DataFrame:
    return tr.routes_per_stop(tr.stop_route_pairs(fx.stop_times(t), fx.trips(t), stops_in_grid(t)))


@view
def bus_routes(t: Tables) -> DataFrame:
    s = stops_in_grid(t)
    return tr.routes_per_cell(tr.stop_route_pairs(fx.stop_times(t), fx.trips(t), s), s)


@query("routes_per_cell", sql(["bus"], "SELECT * FROM bus"))
def routes_per_cell(t: Tables) -> DataFrame:
    return bus_routes(t)


@query("relation_members", sql(["relation_members"], """
SELECT route, line, node_id FROM relation_members WHERE route = 'subway'
UNION SELECT route, line, node_id FROM relation_members WHERE route = 'bus' AND (role LIKE '%platform%' OR role = 'stop')"""))
def relation_members(t: Tables) -> DataFrame:
    rel = fx.osm_relations(t)
    subway = src.route_members(rel, "subway").withColumn("route", F.lit("subway"))
    return subway.unionByName(src.route_members(rel, "bus", src.bus_roles()).withColumn("route", F.lit("bus")))


@query("relation_station_cells", sql(["relation_members", "stops"], """
SELECT grid_id, count(DISTINCT line) AS num_subway_lines, max(CASE WHEN n >= 2 THEN 1 ELSE 0 END) AS is_transfer_hub FROM (
  SELECT grid_id, node_id, line, count(*) OVER (PARTITION BY node_id) AS n FROM (SELECT DISTINCT line, node_id FROM relation_members WHERE route = 'subway') m
  JOIN stops ON stop_id = node_id) GROUP BY 1"""))
def relation_station_cells(t: Tables) -> DataFrame:
    members = src.route_members(fx.osm_relations(t), "subway")
    nodes = stops_in_grid(t).select(F.col("stop_id").alias("node_id"), "grid_id")
    return tr.cell_lines(members.join(nodes, "node_id").withColumnRenamed("node_id", "station"))


@view
def node_features(t: Tables) -> DataFrame:
    points = classified(t)
    blocks = [
        road(t),
        ft.class_counts(points, G, "category", codes.POI_CLASSES).select("grid_id", *ft.POI),
        raster(t),
        ft.class_counts(points, G, "transit", ft.TRANSIT_CLASSES).select("grid_id", *ft.TRANSIT),
        tr.cell_lines(fx.stations(t)),
        bus_routes(t),
    ]
    return ft.node_features(t.spark, G, geo.LANDMARKS["bj"], blocks, history(t))


_mm = lambda c: f"({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER () + 1e-8::DOUBLE)"
_z = lambda c: f"({c} - avg({c}) OVER ()) / (stddev_pop({c}) OVER () + 1e-8::DOUBLE)"
_NF = {"lat_norm": _mm("center_lat"), "lon_norm": _mm("center_lon"), "dist_center_km": _mm("dist_center_km"), "ring": "ring / 5.0::DOUBLE"}
_NF |= {c: _mm(c) for c in ft.DISTANCE} | {c: _z(f"ln(1 + {c})") for c in [*ft.ROAD, *ft.POI, *ft.TRANSIT]} | {c: _z(c) for c in ft.RASTER}
_NF |= {c: c for c in ft.HISTORY} | {"num_subway_lines": "ln(1 + coalesce(num_subway_lines, 0))", "is_transfer_hub": "coalesce(is_transfer_hub, 0)",
                                     "num_bus_routes": "ln(1 + coalesce(num_bus_routes, 0))"}
cte("node_features", f"""
SELECT grid_id, {', '.join(f'{_NF[c]} AS {c}' for c in ft.NODE_FEATURES)} FROM (SELECT *,
  CASE WHEN dist_center_km > 16 THEN 5 WHEN dist_center_km > 11 THEN 4 WHEN dist_center_km > 7 THEN 3 WHEN dist_center_km > 3.5 THEN 2 ELSE 1 END AS ring
  FROM cells JOIN dists USING (grid_id) JOIN road USING (grid_id) JOIN poi USING (grid_id) JOIN raster USING (grid_id)
  JOIN hist USING (grid_id) JOIN transit USING (grid_id) LEFT JOIN lines USING (grid_id) LEFT JOIN bus USING (grid_id))
""", ["cells", "dists", "road", "poi", "raster", "hist", "transit", "lines", "bus"])


@query("node_features", sql(["node_features"], f"SELECT grid_id, {', '.join(rnd(c, c) for c in ft.NODE_FEATURES)} FROM node_features"))
def node_features_query(t: Tables) -> DataFrame:
    return _rounded(node_features(t), ft.NODE_FEATURES)


_DEG = repr(500.0 / 1000.0 / geo.KM_PER_DEGREE)


@query("poi_regrid", sql(["classified"], f"""
SELECT CAST(floor(lon / {_DEG}::DOUBLE) AS BIGINT) AS bx, CAST(floor(lat / {_DEG}::DOUBLE) AS BIGINT) AS "by", count(*) AS n,
  {', '.join(rnd(f"avg(CASE WHEN category = '{c}' THEN 1 ELSE 0 END)", c) for c in codes.POI_CLASSES)}
FROM classified WHERE category IS NOT NULL GROUP BY 1, 2"""))
def poi_regrid(t: Tables) -> DataFrame:
    return _rounded(ft.poi_regrid(classified(t), "category", codes.POI_CLASSES), codes.POI_CLASSES, ["bx", "by", "n"])


@query("poi_supernodes")
def poi_supernodes(t: Tables) -> DataFrame:
    bins = ft.poi_regrid(classified(t), "category", codes.POI_CLASSES)
    d = ft.poi_supernodes(bins, codes.POI_CLASSES)
    return d.groupBy("supernode").agg(F.count("*").alias("n_bins"), F.sum("n").alias("n_points"))


@query("soft_edges", sql(["nodes", "cells"], f"""
SELECT src, dst, {rnd('km', 'km')}, {rnd('exp(-km / 3.0::DOUBLE) * 0.3::DOUBLE', 'weight')} FROM (
  SELECT a.grid_id AS src, b.grid_id AS dst, 2 * 6371.0::DOUBLE * asin(sqrt(pow(sin(radians(b.center_lat - a.center_lat) / 2), 2)
    + cos(radians(a.center_lat)) * cos(radians(b.center_lat)) * pow(sin(radians(b.center_lon - a.center_lon) / 2), 2))) AS km
  FROM cells a, cells b WHERE a.grid_id != b.grid_id
    AND a.grid_id IN (SELECT grid_id FROM nodes WHERE key1 = 'amenity' AND val1 = 'parking')
    AND b.grid_id IN (SELECT grid_id FROM nodes WHERE key1 = 'amenity' AND val1 = 'parking')) WHERE km <= 8"""))
def soft_edges(t: Tables) -> DataFrame:
    e = gr.soft_edges(parking(t).where("parking_count > 0"), G, km=8.0)
    return _rounded(e, ["km", "weight"], ["src", "dst"])


@query("bicycle_edges", sql(["nodes", "cells"], f"""
SELECT src, dst, {rnd('km', 'km')}, {rnd('exp(-km / 3.0::DOUBLE) * 0.3::DOUBLE', 'weight')} FROM (
  SELECT a.grid_id AS src, b.grid_id AS dst, 2 * 6371.0::DOUBLE * asin(sqrt(pow(sin(radians(b.center_lat - a.center_lat) / 2), 2)
    + cos(radians(a.center_lat)) * cos(radians(b.center_lat)) * pow(sin(radians(b.center_lon - a.center_lon) / 2), 2))) AS km
  FROM cells a, cells b WHERE a.grid_id != b.grid_id
    AND a.grid_id IN (SELECT grid_id FROM nodes WHERE key1 = 'amenity' AND val1 = 'bicycle_rental')
    AND b.grid_id IN (SELECT grid_id FROM nodes WHERE key1 = 'amenity' AND val1 = 'bicycle_rental')) WHERE km <= 8"""))
def bicycle_edges(t: Tables) -> DataFrame:
    e = gr.soft_edges(street(t).where("bicycle_rental_count > 0"), G, km=8.0)
    return _rounded(e, ["km", "weight"], ["src", "dst"])


@query("radius_edges", sql(["classified", "cells"], f"""
SELECT id AS poi, grid_id, edge_type, {rnd('km', 'km')} FROM (
  SELECT n.id, c.grid_id, n.grid_id AS home, 2 * 6371.0::DOUBLE * asin(sqrt(pow(sin(radians(center_lat - lat) / 2), 2)
    + cos(radians(lat)) * cos(radians(center_lat)) * pow(sin(radians(center_lon - lon) / 2), 2))) AS km
  FROM classified n, cells c WHERE category IS NOT NULL), (VALUES ('poi_inf_grid'), ('grid_rev_poi')) v(edge_type)
WHERE km <= 1 OR home = grid_id"""))
def radius_edges(t: Tables) -> DataFrame:
    pois = classified(t).where("category IS NOT NULL")
    return _rounded(gr.point_cell_edges(pois, G, "id", 1.0), ["km"], ["poi", "grid_id", "edge_type"])


_HALF = "(0.01::DOUBLE + (s_suppkey % 9) * 0.004::DOUBLE)"


@query("range_join_cells", f"""
SELECT event_id, coalesce(min(s_suppkey), -1) AS cell FROM (SELECT event_id, {fx.lon_sql('event_id')} AS lon, {fx.lat_sql('event_id')} AS lat FROM events)
LEFT JOIN (SELECT s_suppkey, {fx.lon_sql('s_suppkey * 17')} AS cx, {fx.lat_sql('s_suppkey * 17')} AS cy, {_HALF} AS hw FROM supplier)
  ON cx - hw <= lon AND lon < cx + hw AND cy - hw <= lat AND lat < cy + hw GROUP BY 1""")
def range_join_cells(t: Tables) -> DataFrame:
    i, s = F.col("event_id"), F.col("s_suppkey")
    points = t.events.select("event_id", fx.point_lon(i).alias("lon"), fx.point_lat(i).alias("lat"))
    cx, cy, half = fx.point_lon(s * 17), fx.point_lat(s * 17), F.lit(0.01) + (s % 9) * 0.004
    boxes = t.supplier.select(
        s.alias("cell"), (cx - half).alias("lon_min"), (cx + half).alias("lon_max"),
        (cy - half).alias("lat_min"), (cy + half).alias("lat_max"),
    )
    return gr.cells_containing(points, boxes, "event_id", 0.05)


@query("route_sketches", """
SELECT l_suppkey % 64 AS grid_id, year(l_shipdate) * 2 + (month(l_shipdate) - 1) // 6 AS half, count(DISTINCT l_partkey) AS n_routes, true AS within
FROM lineitem GROUP BY ALL""")
def route_sketches(t: Tables) -> DataFrame:
    """Different routes per cell and half-year from monthly sketches, held against the exact count: 5 % or 2 off at most."""
    month = F.year("l_shipdate") * 12 + F.month("l_shipdate") - 1
    d = t.lineitem.select((F.col("l_suppkey") % 64).alias("grid_id"), month.alias("month"), F.col("l_partkey").alias("route"))
    half = F.floor(F.col("month") / 6)
    told = distinct_within(distinct_sketches(d, ["grid_id"], "month", "route"), ["grid_id"], "month", half)
    exact = d.groupBy("grid_id", half.alias("range")).agg(F.count_distinct("route").alias("n_routes"))
    off = F.abs(F.col("estimate") - F.col("n_routes")) <= F.greatest(F.lit(2.0), 0.05 * F.col("n_routes"))
    return told.join(exact, ["grid_id", "range"]).select("grid_id", F.col("range").alias("half"), "n_routes", off.alias("within"))
