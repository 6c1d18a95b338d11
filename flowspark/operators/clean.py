"""Outlier detection and repair (W-02, W-03) and gap reports (J-16, T-08)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowspark.operators import series


def cell_stats(df: DataFrame, keys: list[str], channels: list[str]) -> DataFrame:
    """Mean and floored population deviation per cell and channel (A-07)."""
    return df.groupBy(*keys).agg(
        *[
            a
            for c in channels
            for a in (F.avg(c).alias(f"mu_{c}"), F.greatest(F.stddev_pop(c), F.lit(1e-6)).alias(f"sd_{c}"))
        ]
    )


def outlier_flags(
    df: DataFrame, keys: list[str], channels: list[str], threshold: float = 5.0
) -> DataFrame:
    """Add ``out_c``: |z| beyond the threshold. At most one statistics row per cell is broadcast."""
    d = df.join(cell_stats(df, keys, channels), keys)
    z = {c: F.round(F.abs((F.col(c) - F.col(f"mu_{c}")) / F.col(f"sd_{c}")), 9) for c in channels}
    return d.select(*df.columns, *[(z[c] > threshold).alias(f"out_{c}") for c in channels])


def repair_outliers(
    df: DataFrame, keys: list[str], order: str, channels: list[str], threshold: float = 5.0
) -> DataFrame:
    """Flagged values become the line between their neighbours; ``order`` is the position."""
    d = outlier_flags(df, keys, channels, threshold)
    d = d.withColumns({c: F.when(~F.col(f"out_{c}"), F.col(c)) for c in channels})
    return series.interpolate(d, keys, order, channels)


def gap_report(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Expected, observed and missing steps of each key."""
    return df.groupBy(*keys).agg(
        F.min(order).alias("first_step"),
        F.max(order).alias("last_step"),
        F.countDistinct(order).alias("n_observed"),
    ).withColumn("n_missing", F.col("last_step") - F.col("first_step") + 1 - F.col("n_observed"))


def gap_examples(df: DataFrame, keys: list[str], order: str, n: int = 5) -> DataFrame:
    """First missing steps of each key."""
    w = Window.partitionBy(*keys).orderBy(order)
    return (
        series.missing_steps(df, keys, order).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    )
