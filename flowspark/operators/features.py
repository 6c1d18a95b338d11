"""Static features per cell: points of interest, transit, roads, raster, history, assembly."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowspark.functions import codes, geo, num
from flowspark.functions import time as tm
from flowspark.functions.geo import GridSpec
from flowspark.operators.grid import grid_table, landmark_distances, onto_grid
from flowspark.operators.kmeans import kmeans
from flowspark.operators.scale import scale


def class_counts(points: DataFrame, g: GridSpec, cls: str, classes: list[str]) -> DataFrame:
    """Count and density of every class on every cell (A-01, A-02, P-27). ``points`` has
    ``grid_id``; one conditional aggregation, no pivot pass."""
    counts = (
        points.where(F.col("grid_id") >= 0)
        .groupBy("grid_id")
        .agg(*[F.count_if(F.col(cls) == c).alias(f"{c}_count") for c in classes])
    )
    d = onto_grid(grid_table(points.sparkSession, g), counts, ["grid_id"])
    density = {f"{c}_density": F.col(f"{c}_count") / F.col("area_km2") for c in classes}
    cols = [x for c in classes for x in (f"{c}_count", f"{c}_density")]
    return d.withColumns(density).select("grid_id", *cols)


# ---- roads ------------------------------------------------------------------------------


def road_pieces(ways: DataFrame, g: GridSpec) -> DataFrame:
    """Pieces of way segments per cell with their length in km (J-07).

    A segment meets only the cells of its own bounding box, found by arithmetic. It is
    clipped to each of them by the parameter interval [t0, t1] along the segment.
    """
    n = F.size("coords") - 1
    seg = F.explode(F.arrays_zip(F.slice("coords", 1, n).alias("a"), F.slice("coords", 2, n).alias("b")))
    d = ways.select("id", F.col("tags")["highway"].alias("kind"), seg.alias("s"))
    x0, y0, x1, y1 = F.col("s.a.lon"), F.col("s.a.lat"), F.col("s.b.lon"), F.col("s.b.lat")
    d = d.select("id", "kind", x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    cells = lambda a, b, n: F.sequence(F.greatest(F.least(a, b), F.lit(0)), F.least(F.greatest(a, b), F.lit(n - 1)))
    ca, cb = geo.cell_col(x0, g), geo.cell_col(x1, g)
    ra, rb = geo.cell_row(y0, g), geo.cell_row(y1, g)
    meets = (F.greatest(ca, cb) >= 0) & (F.least(ca, cb) < g.cols) & (F.greatest(ra, rb) >= 0) & (F.least(ra, rb) < g.rows)
    d = d.where(meets).withColumn("col", F.explode(cells(ca, cb, g.cols))).withColumn("row", F.explode(cells(ra, rb, g.rows)))
    west = F.lit(g.lon_min) + F.col("col") * g.d_lon
    north = F.lit(g.lat_max) - F.col("row") * g.d_lat
    dx, dy = x1 - x0, y1 - y0

    def bounds(p: Column, delta: Column, lo: Column, hi: Column) -> tuple[Column, Column]:
        # a segment along one axis has a single candidate on the other one: nothing to clip
        ta, tb = (lo - p) / delta, (hi - p) / delta
        enter = F.when(delta != 0, F.least(ta, tb)).otherwise(F.lit(0.0))
        leave = F.when(delta != 0, F.greatest(ta, tb)).otherwise(F.lit(1.0))
        return enter, leave

    ex, lx = bounds(x0, dx, west, west + g.d_lon)
    ey, ly = bounds(y0, dy, north - g.d_lat, north)
    d = d.withColumns({"t0": F.greatest(F.lit(0.0), ex, ey), "t1": F.least(F.lit(1.0), lx, ly)}).where("t1 > t0")
    at = lambda t: (x0 + dx * F.col(t), y0 + dy * F.col(t))
    length = geo.local_km(*at("t0"), *at("t1"))
    return d.select("id", "kind", (F.col("row") * g.cols + F.col("col")).alias("grid_id"), length.alias("km"))


def road_features(pieces: DataFrame, g: GridSpec) -> DataFrame:
    """Total and per-group road density on every cell (A-03, P-29)."""
    d = pieces.withColumn("grp", codes.road_group(F.col("kind")))
    groups = list(codes.ROAD_GROUPS)
    sums = d.groupBy("grid_id").agg(
        F.sum("km").alias("total_km"), *[F.sum(F.when(F.col("grp") == x, F.col("km"))).alias(x) for x in groups]
    )
    out = onto_grid(grid_table(pieces.sparkSession, g), sums, ["grid_id"])
    cols = {"road_density_km_km2": F.col("total_km") / F.col("area_km2")}
    cols |= {f"{x}_density": F.col(x) / F.col("area_km2") for x in groups}
    return out.withColumns(cols).select("grid_id", *cols)


# ---- raster -----------------------------------------------------------------------------


def pixel_bands(pixels: DataFrame, scenes: DataFrame) -> DataFrame:
    """Reflectance and indices of every pixel; scene calibration is one row per scene (SRC-11)."""
    d = pixels.join(scenes, "scene")
    rho = {
        f"b{b}": num.reflectance(F.col(f"dn{b}"), F.col("mult"), F.col("add"), F.col("sun_elev")) for b in (3, 4, 5, 6)
    }
    d = d.withColumns(rho)
    return d.select(
        "scene", "row", "col", "b4",
        num.norm_diff(F.col("b5"), F.col("b4")).alias("ndvi"),
        num.norm_diff(F.col("b6"), F.col("b5")).alias("ndbi"),
        num.norm_diff(F.col("b3"), F.col("b6")).alias("mndwi"),
    )


def raster_features(bands: DataFrame, g: GridSpec, px: float, width: int, height: int) -> DataFrame:
    """Mean index values and band-4 deviation per cell (A-08). ``px`` is the pixel size in
    degrees, the raster starts at the grid's north-west corner.

    A cell takes the pixels from the truncated first to the rounded-up last one, so a pixel
    on a boundary may count in two cells; each pixel finds its cells by arithmetic.
    """

    def into_cells(d: DataFrame, p: str, n: int, size_deg: float, size: int, name: str) -> DataFrame:
        mid = F.floor((F.col(p) + 0.5) * px / size_deg)
        i = F.col(name)
        first, last = F.floor(i * size_deg / px), F.least(F.ceil((i + 1) * size_deg / px), F.lit(size))
        d = d.withColumn(name, F.explode(F.array(mid - 1, mid, mid + 1)))
        return d.where((i >= 0) & (i < n) & (first <= F.col(p)) & (F.col(p) < last))

    d = into_cells(bands, "col", g.cols, g.d_lon, width, "_c")
    d = into_cells(d, "row", g.rows, g.d_lat, height, "_r")
    stats = d.groupBy((F.col("_r") * g.cols + F.col("_c")).alias("grid_id")).agg(
        F.avg("ndvi").alias("ndvi"), F.avg("ndbi").alias("ndbi"), F.avg("mndwi").alias("mndwi"),
        F.avg("b4").alias("b4_mean"), F.stddev_pop("b4").alias("b4_std"),
    )
    grid = grid_table(bands.sparkSession, g).select("grid_id")
    return onto_grid(grid, stats, ["grid_id"])


# ---- flow history -----------------------------------------------------------------------


def history_features(flow: DataFrame, keys: list[str], tz_hours: int) -> DataFrame:
    """Eight statistics of each cell's inflow (A-09), scaled per city. ``keys[0]`` is the city.

    Pass training rows only: the features describe what a model may know.

    The flow has one row per cell and half-hour (17,520 a year), so the exact percentile of a
    cell holds that many values at most and needs no second pass.
    """
    step = F.col("step")
    hour = F.floor(tm.slot_of(step, tz_hours) / 2)
    workday = tm.weekday_of(step, tz_hours) < 5
    x, net = F.col("inflow"), F.col("inflow") - F.col("outflow")
    mean_if = lambda flag: F.avg(F.when(flag, x))
    stats = flow.groupBy(*keys).agg(
        F.avg(x).alias("mean"), F.avg((x == 0).cast("double")).alias("zero_rate"),
        mean_if(workday).alias("wd"), mean_if(workday & hour.isin(7, 8)).alias("peak"),
        mean_if(~workday).alias("we"), mean_if(hour < 6).alias("night"),
        F.avg(net).alias("net"), F.stddev_pop(x).alias("sd"), F.percentile(x, 0.99).alias("p99"),
    )
    top = stats.groupBy(keys[0]).agg(F.max("p99").alias("top"))
    d = stats.join(top, keys[0])
    wd, we = F.coalesce("wd", "mean"), F.coalesce("we", "mean")
    d = d.select(
        *keys,
        F.col("mean").alias("hist_mean"),
        (F.col("p99") / (F.col("top") + num.EPS)).alias("hist_p99"),
        "zero_rate",
        num.clip(num.ratio(F.coalesce(F.col("peak"), wd), wd), 0, 5).alias("peak_ratio"),
        num.clip(num.ratio(we, wd), 0, 5).alias("weekend_ratio"),
        num.clip(num.ratio(F.col("night"), F.col("mean")), 0, 1).alias("night_ratio"),
        F.col("net").alias("flow_dir"),
        num.clip(num.ratio(F.col("sd"), F.col("mean")), 0, 5).alias("flow_cv"),
    )
    return scale(d, [keys[0]], minmax=["hist_mean", "flow_dir"])


HISTORY = ["hist_mean", "hist_p99", "zero_rate", "peak_ratio", "weekend_ratio", "night_ratio", "flow_dir", "flow_cv"]
GEO = ["lat_norm", "lon_norm", "dist_center_km", "ring"]
DISTANCE = ["dist_hub_min_km", "dist_commercial_min_km"]
ROAD = ["road_density_km_km2", *[f"{x}_density" for x in codes.ROAD_GROUPS]]
POI = [f"{c}_density" for c in codes.POI_CLASSES]
RASTER = ["ndvi", "ndbi", "mndwi", "b4_mean", "b4_std"]
TRANSIT_CLASSES = ["subway_station", "subway_entrance", "bus_stop"]
TRANSIT = [f"{c}_density" for c in TRANSIT_CLASSES]
LINES = ["num_subway_lines", "is_transfer_hub"]
BUS = ["num_bus_routes"]
NODE_FEATURES = [*GEO, *DISTANCE, *ROAD, *POI, *RASTER, *HISTORY, *TRANSIT, *LINES, *BUS]
FEATURE_GROUP = {
    **{c: "geo" for c in [*GEO, *DISTANCE]}, **{c: "road" for c in ROAD}, **{c: "poi" for c in POI},
    **{c: "satellite" for c in RASTER}, **{c: "history" for c in HISTORY},
    **{c: "transit" for c in [*TRANSIT, *LINES, *BUS]},
}


def node_features(spark, g: GridSpec, landmarks: dict, blocks: list[DataFrame], history: DataFrame) -> DataFrame:
    """The 41 scaled columns of every cell, in the order of ``NODE_FEATURES`` (J-02).

    ``blocks`` are raw tables with one row per cell (roads, points, raster, transit, lines,
    bus routes); ``history`` is scaled already.
    """
    grid = landmark_distances(grid_table(spark, g), g, landmarks).select(
        "city", "grid_id", F.col("center_lat").alias("lat_norm"), F.col("center_lon").alias("lon_norm"),
        "dist_center_km", (geo.ring_of(F.col("dist_center_km")) / 5.0).alias("ring"), *DISTANCE,
    )
    attach = lambda d, b: d.join(b, "grid_id", "left")
    d = reduce(attach, [*blocks, history.drop("city")], grid)
    d = d.fillna(0, subset=[c for c in NODE_FEATURES if c not in GEO and c not in DISTANCE])
    d = scale(
        d, ["city"], minmax=["lat_norm", "lon_norm", "dist_center_km", *DISTANCE], zscore=RASTER,
        log_zscore=[*ROAD, *POI, *TRANSIT],
    )
    d = d.withColumns({"num_subway_lines": F.log1p("num_subway_lines"), "num_bus_routes": F.log1p("num_bus_routes")})
    return d.select("city", "grid_id", *[F.col(c).cast("double").alias(c) for c in NODE_FEATURES])


def group_contributions(contrib: DataFrame, keys: list[str], names: list[str], groups: dict[str, str]) -> DataFrame:
    """Sum of feature contributions per group (A-32): one row per key and group."""
    by_group: dict[str, list[str]] = {}
    for n in names:
        by_group.setdefault(groups[n], []).append(n)
    rows = F.array(
        *[
            F.struct(F.lit(k).alias("feature_group"), reduce(lambda a, b: a + b, [F.col(c) for c in cs]).alias("contribution"))
            for k, cs in by_group.items()
        ]
    )
    return contrib.select(*keys, F.explode(rows).alias("_r")).select(*keys, "_r.*")


def poi_regrid(points: DataFrame, cls: str, classes: list[str], metres: float = 500.0) -> DataFrame:
    """Share of each class per ``metres`` bin with the mean position (A-30, first half)."""
    deg = metres / 1000.0 / geo.KM_PER_DEGREE
    return (
        points.where(F.col(cls).isNotNull())
        .groupBy(F.floor(F.col("lon") / deg).alias("bx"), F.floor(F.col("lat") / deg).alias("by"))
        .agg(
            F.count("*").alias("n"), F.avg("lon").alias("lon"), F.avg("lat").alias("lat"),
            *[F.avg((F.col(cls) == c).cast("double")).alias(c) for c in classes],
        )
    )


def poi_supernodes(bins: DataFrame, classes: list[str], k: int = 500, seed: int = 0) -> DataFrame:
    """K-means of the bins into at most ``k`` super-nodes (A-30, second half): adds ``supernode`` and ``distance``."""
    vec = F.array(*[F.col(c) for c in classes])
    return kmeans(bins, ["bx", "by"], vec, k, seed)[0].withColumnRenamed("cluster", "supernode")
