"""Graph queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.functions import codes
from flowspark.functions.num import rnd as r
from flowspark.operators import features as ft
from flowspark.operators import graphs as gp
from flowspark.operators import grid as gr
from flowspark.operators import similarity as sim
from flowspark.operators import transit as tr
from flowspark.plans import fixtures as fx
from flowspark.plans.oracle import cte, rnd, sql
from flowspark.plans.registry import query
from flowspark.plans.q_features import classified
from flowspark.sources import tables as src
from flowspark.sources.tables import Tables, view

G = fx.GRID
_EDGE = f"src, dst, {rnd('weight', 'weight')}"


def _edges(df: DataFrame) -> DataFrame:
    return df.select("src", "dst", r(F.col("weight")).alias("weight"))


cte("occupied", "SELECT grid_id, count(*) AS n FROM nodes GROUP BY 1", ["nodes"])
cte("spatial", """
SELECT a.grid_id AS src, b.grid_id AS dst, exp(-(pow(a."row" - b."row", 2) + pow(a.col - b.col, 2)) / 2.25::DOUBLE) AS weight
FROM cells a JOIN cells b ON abs(a."row" - b."row") <= 1 AND abs(a.col - b.col) <= 1 AND a.grid_id != b.grid_id
WHERE a.grid_id IN (SELECT grid_id FROM occupied)
""", ["cells", "occupied"])


@view
def occupied(t: Tables) -> DataFrame:
    return classified(t).where("grid_id >= 0").select("grid_id").distinct()


@query("spatial_graph", sql(["spatial"], f"SELECT {_EDGE} FROM spatial"))
def spatial_graph(t: Tables) -> DataFrame:
    return _edges(gp.spatial_graph(occupied(t), G))


@query("spatial_graph_rook", sql(["spatial"], "SELECT src, dst, 1.0::DOUBLE AS weight FROM spatial WHERE abs(src - dst) IN (1, 8)"))
def spatial_graph_rook(t: Tables) -> DataFrame:
    return _edges(gp.spatial_graph(occupied(t), G, offsets=gr.ROOK, weighted=False))


def cosine_sql(source: str) -> str:
    return f"""
    SELECT a.id AS src, b.id AS dst, round(list_dot_product(a.u, b.u), 9) AS weight FROM
      (SELECT id, list_transform(vec, lambda x: x / n) AS u FROM (SELECT id, vec, sqrt(list_dot_product(vec, vec)) + 1e-8::DOUBLE AS n FROM {source})) a,
      (SELECT id, list_transform(vec, lambda x: x / n) AS u FROM (SELECT id, vec, sqrt(list_dot_product(vec, vec)) + 1e-8::DOUBLE AS n FROM {source})) b
    WHERE a.id != b.id"""


def top_sql(source: str, k: int) -> str:
    return f"SELECT src, dst, weight FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS rn FROM {source}) WHERE rn <= {k}"


cte("vecs", "SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings")
cte("vec_sim", cosine_sql("vecs"), ["vecs"])


@query("cosine_knn", sql(["vec_sim"], f"SELECT {_EDGE} FROM ({top_sql('vec_sim', 10)})"))
def cosine_knn(t: Tables) -> DataFrame:
    return _edges(sim.cosine_neighbours(fx.vectors(t), 10))


@query("cosine_threshold", sql(["vec_sim"], f"SELECT {_EDGE} FROM vec_sim WHERE weight > 0.5"))
def cosine_threshold(t: Tables) -> DataFrame:
    return _edges(sim.cosine_neighbours(fx.vectors(t), k=None, least=0.5))


cte("poi_vecs", f"SELECT grid_id AS id, [{', '.join(f'ln(1 + {c}_density)' for c in codes.POI_CLASSES)}] AS vec FROM poi", ["poi"])
cte("poi_sim", cosine_sql("poi_vecs"), ["poi_vecs"])
cte("poi_graph", top_sql("poi_sim", 10), ["poi_sim"])


@view
def poi_graph(t: Tables) -> DataFrame:
    return gp.poi_graph(ft.class_counts(classified(t), G, "category", codes.POI_CLASSES), ft.POI)


@query("poi_graph", sql(["poi_graph"], f"SELECT {_EDGE} FROM poi_graph"))
def poi_graph_query(t: Tables) -> DataFrame:
    return _edges(poi_graph(t))


cte("unit_flow", """
SELECT grid_id, step, (inflow - m) / s AS x FROM flow JOIN (
  SELECT grid_id, avg(inflow) AS m, stddev_pop(inflow) + 1e-8::DOUBLE AS s FROM flow WHERE is_train GROUP BY 1) USING (grid_id) WHERE is_train
""", ["flow"])
cte("flow_sim", """
SELECT a.grid_id AS src, b.grid_id AS dst, round(sum(a.x * b.x) / count(*), 9) AS weight
FROM unit_flow a JOIN unit_flow b USING (step) WHERE a.grid_id != b.grid_id GROUP BY ALL
""", ["unit_flow"])
cte("flow_graph", f"SELECT * FROM ({top_sql('flow_sim', 15)}) WHERE weight > 0", ["flow_sim"])


@view
def train_flow(t: Tables) -> DataFrame:
    return fx.flow_split(t).where("is_train").select("grid_id", "step", "inflow")


@view
def flow_graph(t: Tables) -> DataFrame:
    return gp.flow_graph(train_flow(t), G)


@query("pearson_knn", sql(["flow_graph"], f"SELECT {_EDGE} FROM flow_graph"))
def pearson_knn(t: Tables) -> DataFrame:
    return _edges(flow_graph(t))


@query("pearson_threshold", sql(["flow_sim"], f"SELECT {_EDGE} FROM flow_sim WHERE weight > 0.02"))
def pearson_threshold(t: Tables) -> DataFrame:
    return _edges(gp.flow_graph(train_flow(t), G, least=0.02))


cte("line_order", """
SELECT line, station, min(minutes) AS minutes, any_value(grid_id) AS grid_id FROM stations JOIN (
  SELECT line, direction FROM (SELECT line, direction, row_number() OVER (PARTITION BY line ORDER BY minutes, direction) AS rn FROM stations) WHERE rn = 1
) USING (line, direction) GROUP BY line, station
""", ["stations"])
cte("numbered", """
SELECT line, grid_id, row_number() OVER (PARTITION BY line ORDER BY minutes, station) - 1 AS pos, station, minutes FROM line_order
""", ["line_order"])
cte("hops", """
SELECT least(a.grid_id, b.grid_id) AS src, greatest(a.grid_id, b.grid_id) AS dst, min(b.pos - a.pos) AS hops
FROM numbered a JOIN numbered b ON a.line = b.line AND b.pos - a.pos BETWEEN 1 AND 10 WHERE a.grid_id != b.grid_id GROUP BY ALL
""", ["numbered"])
cte("transit_edges", """
SELECT src, dst, hops, exp(-hops / 3.0::DOUBLE) AS weight FROM hops UNION ALL SELECT dst, src, hops, exp(-hops / 3.0::DOUBLE) FROM hops
""", ["hops"])


@query("line_order", sql(["numbered"], "SELECT line, station, minutes, grid_id, pos FROM numbered"))
def line_order(t: Tables) -> DataFrame:
    d = tr.number_stations(tr.line_order(fx.stations(t)).where("grid_id >= 0"))
    return d.select("line", "station", "minutes", "grid_id", "pos")


@query("transit_graph", sql(["transit_edges"], f"SELECT src, dst, hops, {rnd('weight', 'weight')} FROM transit_edges"))
def transit_graph(t: Tables) -> DataFrame:
    return tr.transit_graph(fx.stations(t)).select("src", "dst", "hops", r(F.col("weight")).alias("weight"))


cte("unordered", """
SELECT DISTINCT a.grid_id AS src, b.grid_id AS dst FROM (SELECT *, row_number() OVER (PARTITION BY line ORDER BY grid_id) AS pos FROM (SELECT DISTINCT line, grid_id FROM stations)) a
JOIN (SELECT *, row_number() OVER (PARTITION BY line ORDER BY grid_id) AS pos FROM (SELECT DISTINCT line, grid_id FROM stations)) b
  ON a.line = b.line AND b.pos - a.pos BETWEEN 1 AND 10
""", ["stations"])


@query("transit_graph_unordered", sql(["unordered"], f"""
SELECT src, dst, {rnd('exp(-1 / 3.0::DOUBLE)', 'weight')} FROM (SELECT src, dst FROM unordered UNION ALL SELECT dst, src FROM unordered)"""))
def transit_graph_unordered(t: Tables) -> DataFrame:
    return _edges(tr.transit_graph_unordered(fx.stations(t)))


def all_graphs(t: Tables) -> DataFrame:
    parts = {"spatial": gp.spatial_graph(occupied(t), G), "poi": poi_graph(t), "flow": flow_graph(t), "transit": tr.transit_graph(fx.stations(t))}
    out = None
    for name, e in parts.items():
        e = e.select(F.lit("bj").alias("city"), F.lit(name).alias("graph"), "src", "dst", "weight")
        out = e if out is None else out.unionByName(e)
    return out


cte("graphs", """
SELECT 'spatial' AS graph, src, dst, weight FROM spatial UNION ALL SELECT 'poi', src, dst, weight FROM poi_graph
UNION ALL SELECT 'flow', src, dst, weight FROM flow_graph UNION ALL SELECT 'transit', src, dst, weight FROM transit_edges
""", ["spatial", "poi_graph", "flow_graph", "transit_edges"])


@query("graph_stats", sql(["graphs"], f"""
SELECT graph, 64 AS n_nodes, count(*) AS n_edges, {rnd('count(*) / 64.0::DOUBLE', 'mean_degree')}, {rnd('avg(weight)', 'weight_mean')},
  {rnd('min(weight)', 'weight_min')} FROM graphs GROUP BY 1"""))
def graph_stats(t: Tables) -> DataFrame:
    d = gp.graph_stats(all_graphs(t), G.n_cells)
    return d.select("graph", "n_nodes", "n_edges", *[r(F.col(c)).alias(c) for c in ("mean_degree", "weight_mean", "weight_min")])


def dense_adjacency(t: Tables) -> DataFrame:
    """Nation to nation order volume as rows of a dense matrix, diagonal 1."""
    o = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    o = o.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    n = o.groupBy(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")).agg(F.count("*").alias("n"))
    w = F.when(F.col("src") == F.col("dst"), 1.0).otherwise(r(F.col("n") / (F.col("n") + 100.0)))
    # a row of the matrix has one entry per nation
    row = F.map_from_entries(F.collect_list(F.struct("dst", "w")))
    last = t.supplier.agg(F.max("s_nationkey").cast("int").alias("_last"))
    dense = F.transform(F.sequence(F.lit(0), F.col("_last")), lambda j: F.coalesce(F.element_at("_m", j), F.lit(0.0)))
    return n.withColumn("w", w).groupBy("src").agg(row.alias("_m")).crossJoin(last).select("src", dense.alias("weights"))


cte("dense_edges", f"""
SELECT src, dst, CASE WHEN src = dst THEN 1.0 ELSE {rnd('n / (n + 100.0::DOUBLE)')} END AS weight FROM (
  SELECT c_nationkey AS src, s_nationkey AS dst, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)
""")


@query("dense_to_edges", sql(["dense_edges"], f"SELECT {_EDGE} FROM dense_edges WHERE weight > 0"))
def dense_to_edges(t: Tables) -> DataFrame:
    return _edges(src.dense_to_edges(dense_adjacency(t)))


@query("adjacency_checks", sql(["dense_edges"], f"""
SELECT {rnd('max(abs(coalesce(a.weight, 0) - coalesce(b.weight, 0))) FILTER (coalesce(a.src, b.dst) != coalesce(a.dst, b.src))', 'max_asymmetry')},
  count(*) FILTER (a.src = a.dst AND a.weight = 1) AS n_unit_diagonal, count(*) FILTER (a.src = a.dst) AS n_diagonal, count(a.src) AS n_edges
FROM (SELECT * FROM dense_edges WHERE weight > 0) a FULL JOIN (SELECT * FROM dense_edges WHERE weight > 0) b ON a.src = b.dst AND a.dst = b.src"""))
def adjacency_checks(t: Tables) -> DataFrame:
    d = gp.adjacency_checks(src.dense_to_edges(dense_adjacency(t)))
    return d.select(r(F.col("max_asymmetry")).alias("max_asymmetry"), "n_unit_diagonal", "n_diagonal", "n_edges")


cte("loops", "SELECT src, dst, weight FROM spatial UNION ALL SELECT grid_id, grid_id, 1.0 FROM occupied", ["spatial", "occupied"])


def _norm_sql(source: str) -> str:
    deg = f"(SELECT src, sum(weight) AS d FROM {source} GROUP BY 1)"
    return f"SELECT e.src, e.dst, e.weight / sqrt(a.d * coalesce(b.d, 1)) AS weight FROM {source} e JOIN {deg} a ON a.src = e.src LEFT JOIN {deg} b ON b.src = e.dst"


cte("loops_n", _norm_sql("loops"), ["loops"])
cte("spatial_n", _norm_sql("spatial"), ["spatial"])


@query("neighbor_mean", sql(["loops_n", "flow"], f"""
SELECT src AS grid_id, step, {rnd('sum(weight * inflow)', 'inflow')}, {rnd('sum(weight * outflow)', 'outflow')}
FROM loops_n JOIN flow ON dst = grid_id GROUP BY ALL"""))
def neighbor_mean(t: Tables) -> DataFrame:
    cells = occupied(t)
    e = gp.sym_normalised(gp.with_self_loops(gp.spatial_graph(cells, G), cells))
    d = gp.propagate(fx.flow(t), e, ["inflow", "outflow"])
    return d.select("grid_id", "step", r(F.col("inflow")).alias("inflow"), r(F.col("outflow")).alias("outflow"))


cte("ch1", "SELECT src AS grid_id, step, -sum(weight * inflow) AS t1 FROM spatial_n JOIN flow ON dst = grid_id GROUP BY ALL", ["spatial_n", "flow"])
cte("ch2", "SELECT src AS grid_id, step, -2 * sum(weight * t1) AS t2 FROM spatial_n JOIN ch1 ON dst = grid_id GROUP BY ALL", ["spatial_n", "ch1"])


@query("cheb_features", sql(["ch2"], f"""
SELECT grid_id, step, inflow AS t0, {rnd('t1', 't1')}, {rnd('t2 - inflow', 't2')} FROM flow JOIN ch1 USING (grid_id, step) JOIN ch2 USING (grid_id, step)""", once=True))
def cheb_features(t: Tables) -> DataFrame:
    e = gp.sym_normalised(gp.spatial_graph(occupied(t), G))
    d = gp.chebyshev(fx.flow(t), e, "inflow", 3)
    return d.select("grid_id", "step", "t0", r(F.col("t1")).alias("t1"), r(F.col("t2")).alias("t2"))


FUSION = {"spatial": 0.5, "poi": 0.3, "transit": 0.2}
for _g in FUSION:
    cte(f"fuse_{_g}", f"SELECT src, dst, weight FROM graphs WHERE graph = '{_g}'", ["graphs"])
    cte(f"fuse_{_g}_n", _norm_sql(f"fuse_{_g}"), [f"fuse_{_g}"])
cte("fused", " UNION ALL ".join(f"SELECT src, dst, weight * {w}::DOUBLE AS weight FROM fuse_{g}_n" for g, w in FUSION.items()), [f"fuse_{g}_n" for g in FUSION])


@query("graph_fusion_mean", sql(["fused", "flow"], f"""
SELECT src AS grid_id, step, {rnd('sum(weight * inflow)', 'inflow')} FROM fused JOIN flow ON dst = grid_id GROUP BY ALL"""))
def graph_fusion_mean(t: Tables) -> DataFrame:
    parts = {"spatial": gp.spatial_graph(occupied(t), G), "poi": poi_graph(t), "transit": tr.transit_graph(fx.stations(t)).drop("hops")}
    g = None
    for name, e in parts.items():
        e = e.withColumn("graph", F.lit(name))
        g = e if g is None else g.unionByName(e)
    d = gp.propagate(fx.flow(t), gp.fuse(g, FUSION), ["inflow"])
    return d.select("grid_id", "step", r(F.col("inflow")).alias("inflow"))
