"""Lines, stations and routes per cell; transit graphs (A-04..A-06, W-14, G-05, G-06, J-04, J-05)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowspark.functions import num
from flowspark.functions import time as tm
from flowspark.operators.series import ordinal

K_MAX = 10
SIGMA = 3.0


def cell_lines(stations: DataFrame) -> DataFrame:
    """Distinct lines per cell and whether a station there has two or more (A-04).
    Repeats fold before the first shuffle ends; both counts are two-level aggregates."""
    pairs = stations.where("grid_id >= 0").select("grid_id", "station", "line").distinct()
    per_station = pairs.groupBy("grid_id", "station").agg(F.count("*").alias("n"))
    hubs = per_station.groupBy("grid_id").agg((F.max("n") >= 2).cast("int").alias("is_transfer_hub"))
    lines = pairs.groupBy("grid_id").agg(F.countDistinct("line").alias("num_subway_lines"))
    return lines.join(hubs, "grid_id")


def stop_cells(stops: DataFrame, cell) -> DataFrame:
    """Stops inside the grid with their cell."""
    return stops.withColumn("grid_id", cell).where("grid_id >= 0")


def stop_route_pairs(stop_times: DataFrame, trips: DataFrame, stops_in: DataFrame) -> DataFrame:
    """(stop, route) pairs of the stops inside the grid (J-04, J-05, A-06). The set of routes
    of a stop stays one row per member. Stop times of other stops are dropped before the
    join with the trips."""
    near = stop_times.join(stops_in.select("stop_id"), "stop_id", "left_semi")
    return near.join(trips, "trip_id").select("stop_id", "route_id").distinct()


def routes_per_stop(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("stop_id").agg(F.count("*").alias("n_routes"))


def routes_per_cell(pairs: DataFrame, stops_in: DataFrame) -> DataFrame:
    """Size of the union of route sets per cell (A-05)."""
    d = pairs.join(stops_in.select("stop_id", "grid_id"), "stop_id")
    return d.groupBy("grid_id").agg(F.countDistinct("route_id").alias("num_bus_routes"))


def line_order(stations: DataFrame) -> DataFrame:
    """Stations of each line in order: the direction with the earliest first train, each
    station once, by minutes and then name (W-14). Adds ``pos`` counted over the rows kept."""
    d = stations.withColumn("minutes", tm.minutes_of_day(F.col("first_train"))).where("minutes IS NOT NULL")
    first = d.groupBy("line").agg(F.min(F.struct("minutes", "direction"))["direction"].alias("direction"))
    kept = d.join(first, ["line", "direction"], "left_semi")
    once = kept.groupBy("line", "station").agg(F.min(F.struct("minutes", "grid_id")).alias("_m"))
    return once.select("line", "station", "_m.minutes", "_m.grid_id")


def number_stations(stations: DataFrame) -> DataFrame:
    return ordinal(stations, ["line"], "minutes", ["station"])


def hop_edges(numbered: DataFrame, keys: list[str], pos: str = "pos", k_max: int = K_MAX) -> DataFrame:
    """Cell pairs up to ``k_max`` positions apart on one line with the least hops (J-10).
    Each row looks up its ``k_max`` successors by exact position: no pair of a line beyond
    them is built, however long the line is."""
    ahead = numbered.select(
        *keys, F.col("grid_id").alias("a"), F.explode(F.sequence(F.lit(1), F.lit(k_max))).alias("hops"), F.col(pos).alias("_p")
    ).withColumn("_q", F.col("_p") + F.col("hops"))
    other = numbered.select(*keys, F.col(pos).alias("_q"), F.col("grid_id").alias("b"))
    d = ahead.join(other, [*keys, "_q"]).where("a <> b")
    return d.groupBy(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).agg(F.min("hops").alias("hops"))


def both_ways(edges: DataFrame) -> DataFrame:
    """Undirected edges as two directed ones (S-06)."""
    pair = F.array(
        F.struct(F.col("src").alias("src"), F.col("dst").alias("dst")),
        F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")),
    )
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select(F.explode(pair).alias("_e"), *rest).select("_e.*", *rest)


def transit_graph(stations: DataFrame, k_max: int = K_MAX, sigma: float = SIGMA) -> DataFrame:
    """Edges between cells on ordered lines (G-05); stations outside the grid are left out
    before the positions are counted."""
    inside = line_order(stations).where("grid_id >= 0")
    e = hop_edges(number_stations(inside), ["line"], k_max=k_max)
    return both_ways(e.withColumn("weight", num.hop_decay(F.col("hops"), sigma)))


def transit_graph_unordered(stations: DataFrame, k_max: int = K_MAX, sigma: float = SIGMA) -> DataFrame:
    """Without a station order: cells of a line in id order, every link one hop (G-06, J-11).
    A line has at most as many rows here as the grid has cells."""
    cells = stations.where("grid_id >= 0").select("line", "grid_id").distinct()
    w = Window.partitionBy("line").orderBy("grid_id")
    e = hop_edges(cells.withColumn("pos", F.row_number().over(w)), ["line"], k_max=k_max)
    return both_ways(e.select("src", "dst", F.lit(1).alias("hops"), num.hop_decay(F.lit(1.0), sigma).alias("weight")))
