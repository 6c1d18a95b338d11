"""Slot baselines and z-scores (A-10, A-11, AN-01, AN-02)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def slot_baseline(train: DataFrame, value: Column, keys: list[str], floor: float = 1.0) -> DataFrame:
    """Mean and floored population deviation per (cell, slot)."""
    return train.groupBy(*keys, "slot").agg(
        F.avg(value).alias("mu"), F.greatest(F.stddev_pop(value), F.lit(floor)).alias("sigma")
    )


def slot_zscore(
    df: DataFrame,
    value: Column,
    keys: list[str],
    baseline_value: Column | None = None,
    floor: float = 1.0,
    baseline: DataFrame | None = None,
    name: str = "z",
) -> DataFrame:
    """Add ``mu``, ``sigma`` and the z-score against the baseline of the training rows.

    The baseline has at most cells x 48 rows; whether it is broadcast is left to Spark, which
    knows its bytes. ``baseline_value`` scores one channel with another one's baseline.
    """
    source = value if baseline_value is None else baseline_value
    base = baseline if baseline is not None else slot_baseline(df.where("is_train"), source, keys, floor)
    z = (value - F.col("mu")) / F.col("sigma")
    return df.join(base, [*keys, "slot"]).withColumn(name, F.round(z, 9))
