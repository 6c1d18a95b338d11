"""Connected components of flagged cells per step, 8-neighbour (G-11), and cluster summaries."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.functions.geo import GridSpec
from flowspark.operators import grid as gr
from flowspark.session import cut_lineage

TILE = 32


def _tile(cell, g: GridSpec, tile: int):
    row, col = F.floor(cell / g.cols), F.pmod(cell, F.lit(g.cols))
    return F.floor(row / tile) * (-(-g.cols // tile)) + F.floor(col / tile)


def _local_labels(g: GridSpec):
    width = g.cols + 2

    @F.pandas_udf("array<bigint>")
    def labels(cells: pd.Series) -> pd.Series:
        sizes = cells.map(len).to_numpy()
        flat = np.concatenate(cells.to_list()) if len(cells) else np.zeros(0, np.int64)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        # sorted keys on a padded grid: a neighbour is a fixed key distance away
        key = (owner * (g.rows + 2) + flat // g.cols + 1) * width + flat % g.cols + 1
        a, b = [], []
        for shift in (1, width - 1, width, width + 1):
            pos = np.minimum(np.searchsorted(key, key + shift), len(key) - 1)
            hit = np.nonzero(key[pos] == key + shift)[0]
            a.append(hit)
            b.append(pos[hit])
        a, b = np.concatenate(a), np.concatenate(b)
        parent = np.arange(len(flat))
        while len(a):
            # parents are roots here: the larger root of an edge hooks to the smaller one
            ra, rb = parent[a], parent[b]
            np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
            while not (parent[parent] == parent).all():
                parent = parent[parent]
            open_ = parent[a] != parent[b]
            a, b = a[open_], b[open_]
        return pd.Series(np.split(flat[parent], np.cumsum(sizes)[:-1]))

    return labels


def label_components(flagged: DataFrame, by: list[str], g: GridSpec, tile: int = TILE) -> DataFrame:
    """Add ``label``, the smallest cell id of the component, to rows (by, grid_id).

    A group is one tile of one step, at most tile x tile cells. Components that cross tile
    borders are merged afterwards on the few border links; a grid of one tile has no borders.
    """
    cells = flagged.select(*by, "grid_id").distinct()
    tiles = cells.groupBy(*by, _tile(F.col("grid_id"), g, tile).alias("_tile")).agg(
        F.sort_array(F.collect_list("grid_id")).alias("_cells")
    )
    pairs = F.explode(F.arrays_zip(F.col("_cells"), _local_labels(g)("_cells").alias("_labels")))
    local = tiles.select(*by, pairs.alias("_p")).select(*by, F.col("_p._cells").alias("grid_id"), F.col("_p._labels").alias("label"))
    if max(g.rows, g.cols) > tile:
        local = _merge_tiles(local, by, g, tile)
    return flagged.join(local, [*by, "grid_id"])


def _merge_tiles(local: DataFrame, by: list[str], g: GridSpec, tile: int) -> DataFrame:
    local = cut_lineage(local)
    across = gr.neighbours(local, g).where(_tile(F.col("grid_id"), g, tile) != _tile(F.col("dst"), g, tile))
    other = local.select(*by, F.col("grid_id").alias("dst"), F.col("label").alias("v"))
    links = cut_lineage(
        across.join(other, [*by, "dst"]).select(*by, F.col("label").alias("u"), "v").distinct()
    )
    root = links.select(*by, F.col("u").alias("label"), F.col("u").alias("root")).distinct()
    while not links.isEmpty():
        # every root hooks to its smallest smaller neighbour; hooks are then shortened to the end
        hook = cut_lineage(links.where("v < u").groupBy(*by, "u").agg(F.min("v").alias("p")))
        while True:
            up = hook.select(*by, F.col("u").alias("p"), F.col("p").alias("_pp"))
            jumped = hook.join(up, [*by, "p"], "left").select(
                *by, "u", F.coalesce("_pp", "p").alias("p"), F.col("_pp").isNotNull().alias("_moved")
            )
            jumped = cut_lineage(jumped)
            hook = jumped.drop("_moved")
            if jumped.where("_moved").isEmpty():
                break
        move = lambda d, c: d.join(hook.withColumnsRenamed({"u": c, "p": f"_{c}"}), [*by, c], "left").withColumn(
            c, F.coalesce(f"_{c}", c)
        ).drop(f"_{c}")
        root = cut_lineage(move(root, "root"))
        links = cut_lineage(move(move(links, "u"), "v").where("u <> v").distinct())
    return (
        local.join(root, [*by, "label"], "left")
        .withColumn("label", F.coalesce("root", "label"))
        .drop("root")
        .groupBy(*by, "grid_id")
        .agg(F.min("label").alias("label"))
    )


def cluster_summary(labelled: DataFrame, by: list[str], g: GridSpec, min_cells: int = 2) -> DataFrame:
    """Cells, peak, centroid and extent of each component of two or more cells (AN-04, J-22)."""
    row, col = F.floor(F.col("grid_id") / g.cols), F.pmod(F.col("grid_id"), F.lit(g.cols))
    d = labelled.groupBy(*by, "label").agg(
        F.count("*").alias("cell_count"), F.max("z").alias("max_z"),
        F.avg(row).alias("centroid_row"), F.avg(col).alias("centroid_col"),
        F.min(row).alias("row_min"), F.max(row).alias("row_max"), F.min(col).alias("col_min"), F.max(col).alias("col_max"),
    ).where(F.col("cell_count") >= min_cells)
    return d.withColumns({
        "center_lon": F.lit(g.lon_min) + (F.col("centroid_col") + 0.5) * g.d_lon,
        "center_lat": F.lit(g.lat_max) - (F.col("centroid_row") + 0.5) * g.d_lat,
        "lon_min": F.lit(g.lon_min) + F.col("col_min") * g.d_lon,
        "lon_max": F.lit(g.lon_min) + (F.col("col_max") + 1) * g.d_lon,
        "lat_min": F.lit(g.lat_max) - (F.col("row_max") + 1) * g.d_lat,
        "lat_max": F.lit(g.lat_max) - F.col("row_min") * g.d_lat,
    })
