"""Grid geometry as arithmetic on columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
KM_PER_DEGREE = 111.32


@dataclass(frozen=True)
class GridSpec:
    """A regular lon/lat grid. ``grid_id = row * cols + col``, row 0 is the north edge."""

    city: str
    lon_min: float
    lon_max: float
    lat_min: float
    lat_max: float
    rows: int
    cols: int
    tz_hours: int

    @property
    def n_cells(self) -> int:
        return self.rows * self.cols

    @property
    def d_lon(self) -> float:
        return (self.lon_max - self.lon_min) / self.cols

    @property
    def d_lat(self) -> float:
        return (self.lat_max - self.lat_min) / self.rows


# The two city grids.
BEIJING = GridSpec("bj", 116.25, 116.75, 39.75, 40.25, 32, 32, 8)
NEW_YORK = GridSpec("nyc", -74.0166, -73.9004, 40.6996, 40.9196, 15, 5, -5)


def cell_row(lat: Column, g: GridSpec, closed: str = "south") -> Column:
    """Row of a latitude. A point on a horizontal line belongs to the cell south of it
    (``closed="south"``, affine rule) or north of it (``"north"``, half-open containment)."""
    q = (F.lit(g.lat_max) - lat) / F.lit(g.d_lat)
    return F.floor(q) if closed == "south" else F.ceil(q) - 1


def cell_col(lon: Column, g: GridSpec) -> Column:
    return F.floor((lon - F.lit(g.lon_min)) / F.lit(g.d_lon))


def cell_id(lon: Column, lat: Column, g: GridSpec, closed: str = "south") -> Column:
    """Cell of a point, -1 outside the grid (P-16, P-17)."""
    row, col = cell_row(lat, g, closed), cell_col(lon, g)
    inside = (row >= 0) & (row < g.rows) & (col >= 0) & (col < g.cols)
    return F.when(inside, row * g.cols + col).otherwise(F.lit(-1)).cast("long")


def in_bbox(lon: Column, lat: Column, g: GridSpec) -> Column:
    """Inclusive at both ends, as the point scans need it."""
    return lon.between(g.lon_min, g.lon_max) & lat.between(g.lat_min, g.lat_max)


def center_lon(grid_id: Column, g: GridSpec) -> Column:
    return F.lit(g.lon_min) + (F.pmod(grid_id, F.lit(g.cols)) + 0.5) * g.d_lon


def center_lat(grid_id: Column, g: GridSpec) -> Column:
    return F.lit(g.lat_max) - (F.floor(grid_id / g.cols) + 0.5) * g.d_lat


def cell_area_km2(lat: Column, g: GridSpec) -> Column:
    return F.lit(g.d_lat * KM_PER_DEGREE * g.d_lon * KM_PER_DEGREE) * F.cos(F.radians(lat))


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    d_lat, d_lon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(d_lat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(d_lon / 2), 2
    )
    return F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), a)))) * (2 * EARTH_KM)


def local_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Length of a short segment on the local tangent plane."""
    mid = F.radians((lat1 + lat2) / 2)
    dx = (lon2 - lon1) * KM_PER_DEGREE * F.cos(mid)
    dy = (lat2 - lat1) * KM_PER_DEGREE
    return F.sqrt(dx * dx + dy * dy)


# Landmarks as (lon, lat).
LANDMARKS = {
    "bj": {
        "city_center": [(116.3974, 39.9087)],
        "transport": [
            (116.4274, 39.9022), (116.3221, 39.8942), (116.3784, 39.8648), (116.5883, 40.0799),
        ],
        "commercial": [
            (116.4074, 39.9139), (116.4551, 39.9327), (116.3106, 39.9840), (116.3664, 39.9133),
        ],
    },
    "nyc": {
        "city_center": [(-73.9857, 40.7484)],
        "transport": [
            (-73.9937, 40.7506), (-73.9772, 40.7527), (-73.7789, 40.6413), (-74.0099, 40.7143),
        ],
        "commercial": [
            (-73.9855, 40.7580), (-74.0094, 40.7069), (-73.9681, 40.7851), (-73.9442, 40.7794),
        ],
    },
}

# Ring thresholds in km from the centre.
RING_KM = [3.5, 7.0, 11.0, 16.0]


def ring_of(km: Column) -> Column:
    """1 inside the first threshold, 5 beyond the last (P-26)."""
    ring = F.lit(1)
    for t in RING_KM:
        ring = ring + F.when(km > t, 1).otherwise(0)
    return ring
