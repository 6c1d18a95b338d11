"""Grid tables and joins (P-01, P-02, J-01, J-06, J-09, J-14, J-20, J-21)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark.functions import geo
from flowspark.functions.geo import GridSpec
from flowspark.session import cut_lineage


def grid_table(spark: SparkSession, g: GridSpec) -> DataFrame:
    """One row per cell with centre, bounds and area, row-major from the north-west corner."""
    gid = F.col("grid_id")
    lon, lat = geo.center_lon(gid, g), geo.center_lat(gid, g)
    return spark.range(g.n_cells).select(F.col("id").alias("grid_id")).select(
        F.lit(g.city).alias("city"),
        "grid_id",
        F.floor(gid / g.cols).alias("row"),
        F.pmod(gid, F.lit(g.cols)).alias("col"),
        lon.alias("center_lon"),
        lat.alias("center_lat"),
        (lon - g.d_lon / 2).alias("lon_min"),
        (lon + g.d_lon / 2).alias("lon_max"),
        (lat - g.d_lat / 2).alias("lat_min"),
        (lat + g.d_lat / 2).alias("lat_max"),
        geo.cell_area_km2(lat, g).alias("area_km2"),
    )


def onto_grid(grid: DataFrame, features: DataFrame, keys: list[str]) -> DataFrame:
    """Features on every cell, zero where a cell has none (J-01). ``features`` has at most one
    row per cell."""
    cols = [c for c in features.columns if c not in keys]
    return grid.join(features, keys, "left").fillna(0, subset=cols)


def landmark_distances(cells: DataFrame, g: GridSpec, landmarks: dict[str, list[tuple[float, float]]]) -> DataFrame:
    """Distance of each cell centre to every landmark and the nearest of each kind (J-09).
    Landmarks are a fixed short list: they enter as literals, not as a join."""
    lon, lat = geo.center_lon(F.col("grid_id"), g), geo.center_lat(F.col("grid_id"), g)
    to = lambda p: geo.haversine_km(lon, lat, F.lit(p[0]), F.lit(p[1]))
    nearest = lambda ps: F.least(*[to(p) for p in ps]) if len(ps) > 1 else to(ps[0])
    cols = {
        "dist_center_km": nearest(landmarks["city_center"]),
        "dist_hub_min_km": nearest(landmarks["transport"]),
        "dist_commercial_min_km": nearest(landmarks["commercial"]),
    }
    cols |= {f"dist_hub{i + 1}_km": to(p) for i, p in enumerate(landmarks["transport"])}
    cols |= {f"dist_com{i + 1}_km": to(p) for i, p in enumerate(landmarks["commercial"])}
    return cells.withColumns(cols)


MOORE = [(dr, dc) for dr in (-1, 0, 1) for dc in (-1, 0, 1) if (dr, dc) != (0, 0)]
ROOK = [(dr, dc) for dr, dc in MOORE if dr == 0 or dc == 0]


def neighbours(cells: DataFrame, g: GridSpec, offsets: list[tuple[int, int]] = MOORE, src: str = "grid_id") -> DataFrame:
    """(row of ``cells``, dst, dr, dc) for every neighbour inside the grid (J-14): arithmetic only."""
    pairs = F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in offsets])
    d = cells.withColumn("_o", F.explode(pairs))
    row = F.floor(F.col(src) / g.cols) + F.col("_o.dr")
    col = F.pmod(F.col(src), F.lit(g.cols)) + F.col("_o.dc")
    inside = (row >= 0) & (row < g.rows) & (col >= 0) & (col < g.cols)
    return d.where(inside).select(
        *cells.columns, (row * g.cols + col).alias("dst"), F.col("_o.dr").alias("dr"), F.col("_o.dc").alias("dc")
    )


def reach_offsets(g: GridSpec, km: float) -> list[tuple[int, int]]:
    """Cell offsets that can hold a point within ``km``; longitude is tightest at the pole side."""
    lat = max(abs(g.lat_min), abs(g.lat_max))
    nr = math.ceil(km / (g.d_lat * geo.KM_PER_DEGREE * 0.998)) + 1
    nc = math.ceil(km / (g.d_lon * geo.KM_PER_DEGREE * 0.998 * math.cos(math.radians(lat)))) + 1
    return [(a, b) for a in range(-nr, nr + 1) for b in range(-nc, nc + 1)]


def soft_edges(cells: DataFrame, g: GridSpec, km: float = 2.0, factor: float = 0.3, sigma: float = 3.0) -> DataFrame:
    """Edges between cells of the list whose centres are within ``km`` (J-20). Each cell looks
    only at the offsets in reach, so no pair beyond them is built."""
    offsets = [o for o in reach_offsets(g, km) if o != (0, 0)]
    n = neighbours(cells.select("grid_id").distinct(), g, offsets)
    n = n.join(cells.select(F.col("grid_id").alias("dst")).distinct(), "dst", "left_semi")
    d = geo.haversine_km(
        geo.center_lon(F.col("grid_id"), g), geo.center_lat(F.col("grid_id"), g),
        geo.center_lon(F.col("dst"), g), geo.center_lat(F.col("dst"), g),
    )
    return (
        n.withColumn("km", d)
        .where(F.col("km") <= km)
        .select(F.col("grid_id").alias("src"), "dst", "km", (F.exp(-F.col("km") / sigma) * factor).alias("weight"))
    )


def point_cell_edges(points: DataFrame, g: GridSpec, id_col: str, km: float = 1.0) -> DataFrame:
    """Typed edges between a point and the cells that hold it or whose centre is within ``km``,
    in both directions (J-21). Candidates come from the point's own cell by offset."""
    p = points.select(id_col, "lon", "lat").withColumn("_home", geo.cell_id(F.col("lon"), F.col("lat"), g))
    near = neighbours(p.where("_home >= 0"), g, reach_offsets(g, km), src="_home")
    dst = F.col("dst")
    near = near.withColumn("km", geo.haversine_km(F.col("lon"), F.col("lat"), geo.center_lon(dst, g), geo.center_lat(dst, g)))
    inf = near.where((F.col("km") <= km) | (dst == F.col("_home"))).select(
        F.col(id_col).alias("poi"), dst.alias("grid_id"), "km"
    )
    kinds = F.array(F.lit("poi_inf_grid"), F.lit("grid_rev_poi"))
    return inf.withColumn("edge_type", F.explode(kinds))


GROUP = 100_000  # points, and boxes, that one task looks at together


def first_boxes(x: np.ndarray, y: np.ndarray, boxes: np.ndarray) -> np.ndarray:
    """Per point the number of the first box (row of lon_min, lon_max, lat_min, lat_max) that holds it, else ``len(boxes)``.

    A box is cut along x into runs of 1, 2, 4, ... points, and along y into two overlapping runs of the points
    there, so the work is that of a few sorts of the points and not that of all pairs.
    """
    n, none = len(x), len(boxes)
    best = np.full(n, none)
    by_x, by_y = np.argsort(x, kind="stable"), np.argsort(y, kind="stable")
    x_rank, y_rank = np.empty(n, np.int64), np.empty(n, np.int64)
    x_rank[by_x], y_rank[by_y] = np.arange(n), np.arange(n)
    left, right = np.searchsorted(x[by_x], boxes[:, 0]), np.searchsorted(x[by_x], boxes[:, 1])
    low, high = np.searchsorted(y[by_y], boxes[:, 2]), np.searchsorted(y[by_y], boxes[:, 3])
    for level in range(n.bit_length()):
        some = left < right
        first, last = np.flatnonzero(some & (left % 2 == 1)), np.flatnonzero(some & (right % 2 == 1))
        run, box = np.concatenate([left[first], right[last] - 1]), np.concatenate([first, last])
        left, right = (left + 1) // 2, right // 2
        place = (x_rank >> level) * n + y_rank
        order = np.argsort(place)
        start, end = np.searchsorted(place[order], run * n + low[box]), np.searchsorted(place[order], run * n + high[box])
        full = start < end
        start, end, box = start[full], end[full], box[full]
        if not len(box):
            continue
        power = np.frexp(end - start)[1] - 1  # the largest power of two that fits
        least = np.full(n, none)
        for k in range(power.max(), -1, -1):
            at = power == k
            np.minimum.at(least, start[at], box[at])
            np.minimum.at(least, end[at] - (1 << k), box[at])
            if k:
                half, whole = 1 << (k - 1), least.copy()
                np.minimum(least[half:], whole[:-half], out=least[half:])
        best[order] = np.minimum(best[order], least)
    return best


def cells_containing(
    points: DataFrame, cells: DataFrame, id_col: str, bin_deg: float, salts: int = 8, cell_col: str = "cell"
) -> DataFrame:
    """First (smallest id) cell whose half-open box holds the point (J-06), for boxes of any size.

    Both sides are cut into bins. Of the boxes that hold all points of a bin only the first counts, and
    of the others only those before it. These meet the points in groups of at most about ``GROUP`` points and
    ``GROUP`` boxes: a bin with more points is spread over ``salts`` groups or more, and no pairs become rows.
    """
    b = lambda c: F.floor(F.col(c) / bin_deg)
    sides, key = ["lon_min", "lon_max", "lat_min", "lat_max"], ["_bx", "_by"]
    pts = points.select(id_col, "lon", "lat").dropna().where(~F.isnan("lon") & ~F.isnan("lat"))
    pts = pts.withColumns({"_bx": b("lon"), "_by": b("lat")})
    bins = pts.groupBy(*key).agg(
        F.count("*").alias("_n"), F.min("lon").alias("_x0"), F.max("lon").alias("_x1"), F.min("lat").alias("_y0"), F.max("lat").alias("_y1")
    )
    bins = cut_lineage(bins)
    boxes = cells.select(F.col(cell_col).alias("_cell"), *sides).where("_cell IS NOT NULL AND lon_min < lon_max AND lat_min < lat_max")
    boxes = boxes.withColumn("_bx", F.explode(F.sequence(b("lon_min"), b("lon_max"))))
    boxes = boxes.withColumn("_by", F.explode(F.sequence(b("lat_min"), b("lat_max"))))
    met = boxes.join(bins, key).where("lon_min <= _x1 AND _x0 < lon_max AND lat_min <= _y1 AND _y0 < lat_max")
    whole = F.expr("lon_min <= _x0 AND _x1 < lon_max AND lat_min <= _y0 AND _y1 < lat_max")
    covers = cut_lineage(met.where(whole).groupBy(*key).agg(F.min("_cell").alias("_all")))
    cut = met.where(~whole).join(covers, key, "left").where("_all IS NULL OR _cell < _all")
    cut = cut_lineage(cut.select(*key, "_cell", *sides))
    share = lambda n: F.ceil(F.col(n) / GROUP)
    spread = F.when(F.col("_n") <= GROUP, 1).otherwise(F.greatest(F.lit(salts), share("_n")))
    bins = bins.join(covers, key, "left").join(cut.groupBy(*key).agg(F.count("*").alias("_m")), key, "left")
    bins = cut_lineage(bins.select(*key, "_all", spread.cast("int").alias("_salts"), F.coalesce(share("_m"), F.lit(0)).cast("int").alias("_parts")))

    dealt = pts.join(bins, key)
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    mine = lambda n, *by: F.pmod(F.xxhash64(*by), F.col(n)).cast("int")
    group = [*key, "_salt", "_part"]
    left = dealt.where("_parts > 0").withColumn("_salt", mine("_salts", id_col, "lon", "lat")).withColumn("_part", numbers("_parts"))
    right = cut.join(bins, key).withColumn("_part", mine("_parts", "_cell", *sides)).withColumn("_salt", numbers("_salts"))
    kind = cells.schema[cell_col].dataType.simpleString()

    def look(p: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        c = c.sort_values("_cell", ignore_index=True)
        at = first_boxes(p["lon"].to_numpy(float), p["lat"].to_numpy(float), c[sides].to_numpy(float))
        hit = at < len(c)
        return pd.DataFrame({id_col: p[id_col][hit], cell_col: c["_cell"].to_numpy()[at[hit]]})

    left = left.select(*group, id_col, "lon", "lat").groupBy(*group)
    inside = left.cogroup(right.select(*group, "_cell", *sides).groupBy(*group)).applyInPandas(
        look, f"`{id_col}` {points.schema[id_col].dataType.simpleString()}, `{cell_col}` {kind}"
    )
    found = inside.unionByName(dealt.where("_all IS NOT NULL").select(id_col, F.col("_all").alias(cell_col)))
    found = found.groupBy(id_col).agg(F.min(cell_col).alias(cell_col))
    return points.select(id_col).join(found, id_col, "left").withColumn(cell_col, F.coalesce(cell_col, F.lit(-1)))
