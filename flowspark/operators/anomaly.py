"""Alert levels, types, labels and their evaluation (AN-*, A-22..A-26)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowspark.functions.geo import GridSpec
from flowspark.operators.grid import neighbours


@dataclass(frozen=True)
class Level:
    level: int
    z: float
    min_cells: int


# The four alert levels of a 1024-cell city.
LEVELS = [Level(1, 3.0, 6), Level(2, 3.0, 12), Level(3, 3.5, 12), Level(4, 4.0, 25)]
TRIGGER_THRESHOLDS = [2.0, 2.5, 3.0, 3.5, 4.0]
MAJOR_DAYS = ["0101", "0501", "1001", "0214", "1231"]


def over(z: Column, threshold: float) -> Column:
    return F.count_if(z > threshold)


def count_name(threshold: float) -> str:
    return f"n_z{threshold:g}".replace(".", "_")


def cells_over(scored: DataFrame, by: list[str], thresholds: list[float], z: str = "z") -> DataFrame:
    """Cells above each threshold per step (AN-03), counted map-side first."""
    return scored.groupBy(*by).agg(*[over(F.col(z), t).alias(count_name(t)) for t in thresholds])


def level_by_count(levels: list[Level]) -> Column:
    """Highest level whose own threshold is passed by enough cells (AN-06)."""
    hits = [
        F.when(F.col(count_name(lv.z)) >= lv.min_cells, F.lit(lv.level)).otherwise(F.lit(0)) for lv in levels
    ]
    return F.greatest(*hits) if len(hits) > 1 else hits[0]


def level_by_cluster(cells: Column, max_z: Column, levels: list[Level]) -> Column:
    """Level from the cells in clusters and their peak (AN-05). Levels 1 and 2 test the cell
    count alone, 3 and 4 also the peak."""
    l1, l2, l3, l4 = sorted(levels, key=lambda lv: lv.level)
    return (
        F.when((cells >= l4.min_cells) & (max_z > l4.z), 4)
        .when((cells >= l3.min_cells) & (max_z > l3.z), 3)
        .when(cells >= l2.min_cells, 2)
        .when(cells >= l1.min_cells, 1)
        .otherwise(0)
    )


# ---- clusters ---------------------------------------------------------------------------


def cluster_levels(clusters: DataFrame, by: list[str], levels: list[Level]) -> DataFrame:
    """Alert level per step from its clusters (AN-05); steps without a cluster are absent (level 0)."""
    d = clusters.groupBy(*by).agg(
        F.sum("cell_count").alias("clustered_cells"), F.count("*").alias("n_clusters"), F.max("max_z").alias("max_z")
    )
    return d.withColumn("level", level_by_cluster(F.col("clustered_cells"), F.col("max_z"), levels))


def anomaly_type(clusters: DataFrame, by: list[str], gathering_cells: int = 15, jam_aspect: float = 3.0) -> DataFrame:
    """One large cluster, a stretched one, or scattered ones (AN-08)."""
    h, w = F.col("row_max") - F.col("row_min") + 1, F.col("col_max") - F.col("col_min") + 1
    d = clusters.groupBy(*by).agg(
        F.count("*").alias("n_clusters"), F.max("cell_count").alias("largest"),
        F.max(F.greatest(h, w) / F.least(h, w)).alias("aspect"),
    )
    kind = (
        F.when((F.col("n_clusters") == 1) & (F.col("largest") > gathering_cells), "mass_gathering")
        .when(F.col("aspect") > jam_aspect, "traffic_jam")
        .otherwise("sudden_incident")
    )
    return d.withColumn("type", kind)


# ---- weak labels ------------------------------------------------------------------------


def weak_labels(
    scored: DataFrame, by: list[str], local_date: Column, cells_a: int = 12, cells_b: int = 6,
    z_a: float = 3.0, z_b: float = 2.5, major_days: list[str] = MAJOR_DAYS, pad_days: int = 0,
) -> DataFrame:
    """Labels A, B and C per step (AN-09..AN-11). ``z`` scores the inflow and ``z_out`` the
    outflow against the inflow baseline. C is 2 where A holds within ``pad_days`` of a major day."""
    n = scored.groupBy(*by).agg(over(F.col("z"), z_a).alias("n_a"), over(F.col("z_out"), z_b).alias("n_b"))
    a = F.col("n_a") >= cells_a
    near = F.exists(
        F.sequence(F.lit(-pad_days), F.lit(pad_days)),
        lambda k: F.date_format(F.date_add(local_date, k), "MMdd").isin(major_days),
    )
    return n.withColumns({
        "label_a": a.cast("int"),
        "label_b": (a & (F.col("n_b") >= cells_b)).cast("int"),
        "label_c": F.when(a & near, 2).otherwise(a.cast("int")),
        "is_major_day": near.cast("int"),
    })


def label_balance(labels: DataFrame, label: str) -> DataFrame:
    """Positive rate, class weight and recall on major days (A-24, A-25)."""
    p = F.avg(F.col(label).cast("double"))
    return labels.agg(
        p.alias("positive_rate"), ((1 - p) / p).alias("class_weight"),
        F.avg(F.when(F.col("is_major_day") == 1, F.col(label).cast("double"))).alias("holiday_recall"),
    )


def consecutive_share(labels: DataFrame, label: str, keys: list[str], order: str) -> DataFrame:
    """Share of positive steps whose predecessor is positive too (W-16). Positive rows are
    matched to their successor in one aggregation."""
    pos = labels.where(F.col(label) == 1).select(*keys, order)
    marks = pos.withColumn("_m", F.lit(0)).unionByName(pos.withColumn(order, F.col(order) + 1).withColumn("_m", F.lit(1)))
    both = marks.groupBy(*keys, order).agg(F.min("_m").alias("lo"), F.max("_m").alias("hi"))
    # a pair has both marks, a positive step has mark 0
    return both.groupBy(*keys).agg(
        F.count_if(F.col("lo") == 0).alias("n_positive"), F.count_if((F.col("lo") == 0) & (F.col("hi") == 1)).alias("n_consecutive")
    ).withColumn("share", F.col("n_consecutive") / F.greatest(F.col("n_positive"), F.lit(1)))


def oversample(df: DataFrame, label: str, times: int) -> DataFrame:
    """Positives repeated ``times`` times (T-10)."""
    n = F.when(F.col(label) == 1, times).otherwise(1)
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1), n)))


# ---- evaluation -------------------------------------------------------------------------


def confusion(predicted: Column, truth: Column) -> dict[str, Column]:
    p, t = predicted, truth
    return {"tp": F.count_if(p & t), "fp": F.count_if(p & ~t), "fn": F.count_if(~p & t), "tn": F.count_if(~p & ~t)}


def scores(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    """Precision, recall, F1 and false positive rate (A-23); zero where undefined."""
    div = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return {
        "precision": div(tp, tp + fp), "recall": div(tp, tp + fn), "f1": div(2 * tp, 2 * tp + fp + fn), "fpr": div(fp, fp + tn),
    }


def evaluate(df: DataFrame, detectors: dict[str, Column], truth: Column) -> DataFrame:
    """Confusion counts and scores of several detectors in one pass; one row per detector."""
    aggs, rows = [], []
    for name, p in detectors.items():
        cols = confusion(p, truth)
        aggs += [c.alias(f"{name}__{k}") for k, c in cols.items()]
        rows.append(F.struct(F.lit(name).alias("detector"), *[F.col(f"{name}__{k}").alias(k) for k in cols]))
    d = df.agg(*aggs).select(F.explode(F.array(*rows)).alias("_r")).select("_r.*")
    return d.withColumns(scores(*[F.col(c) for c in ("tp", "fp", "fn", "tn")]))


def best_threshold(evaluated: DataFrame) -> DataFrame:
    """Detector with the largest F1, the last name on ties (AN-14)."""
    w = F.max(F.struct("f1", "detector"))
    return evaluated.agg(w.alias("_b")).select("_b.*")


def trigger_rates(scored: DataFrame, thresholds: list[float], z: str = "z") -> DataFrame:
    """Share of cell-steps above each threshold (A-22), one pass."""
    aggs = [F.avg((F.col(z) > t).cast("double")).alias(count_name(t)) for t in thresholds]
    rows = [F.struct(F.lit(t).alias("threshold"), F.col(count_name(t)).alias("rate")) for t in thresholds]
    return scored.agg(*aggs).select(F.explode(F.array(*rows)).alias("_r")).select("_r.*")


# ---- context ----------------------------------------------------------------------------


def top_cells(scored: DataFrame, by: list[str], n: int) -> DataFrame:
    """Cells with the largest z per step (T-05); the rank filter runs before the shuffle."""
    w = Window.partitionBy(*by).orderBy(F.col("z").desc(), "grid_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def flagged_neighbours(flagged: DataFrame, by: list[str], g: GridSpec) -> DataFrame:
    """Number of flagged cells around each flagged cell (AN-16): every cell sends one mark to
    its neighbours and one to itself, so no self-join is needed."""
    own = flagged.select(*by, "grid_id").withColumns({"_self": F.lit(1), "_n": F.lit(0)})
    sent = neighbours(flagged.select(*by, "grid_id"), g).select(
        *by, F.col("dst").alias("grid_id"), F.lit(0).alias("_self"), F.lit(1).alias("_n")
    )
    d = own.unionByName(sent).groupBy(*by, "grid_id").agg(F.max("_self").alias("_self"), F.sum("_n").alias("flagged_neighbours"))
    return d.where("_self = 1").drop("_self")
