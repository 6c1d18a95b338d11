"""Train, validation and test splits, and normalisation fitted on the training part."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.operators.series import ordinal

DAY = 48


def positions(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """0-based position of every distinct step of each key, ranked day by day."""
    steps = df.select(*keys, order).distinct().withColumn("_day", F.floor(F.col(order) / DAY))
    return ordinal(steps, keys, "_day", [order]).drop("_day")


def chrono_cuts(
    df: DataFrame, keys: list[str], order: str, train: float = 0.7, val: float = 0.1, test: float = 0.2
) -> DataFrame:
    """First validation and first test step of each key; counts are truncated."""
    if abs(train + val + test - 1.0) >= 1e-6:
        raise ValueError("the shares must sum to 1")
    pos = positions(df, keys, order)
    n = pos.groupBy(*keys).agg(F.count("*").alias("_n"))
    cut = lambda share: F.min(F.when(F.col("pos") >= F.floor(F.col("_n") * F.lit(share)), F.col(order)))
    return pos.join(n, keys).groupBy(*keys).agg(
        cut(train).alias("val_from"), cut(train + val).alias("test_from")
    )


def chrono_split(df: DataFrame, keys: list[str], order: str, **shares: float) -> DataFrame:
    """Add ``split`` by time order, 7:1:2 by default (W-10). ``keys`` are the city columns:
    one cut row per city is broadcast."""
    cuts = chrono_cuts(df, keys, order, **shares)
    split = (
        F.when(F.col(order) < F.col("val_from"), "train")
        .when(F.col(order) < F.col("test_from"), "val")
        .otherwise("test")
    )
    return df.join(cuts, keys).withColumn("split", split).drop("val_from", "test_from")


def segment_split(
    df: DataFrame, keys: list[str], order: str, segment: str, train: list, test: list, val_share: float = 0.25
) -> DataFrame:
    """Training segments with the tail of the last one as validation, other segments as
    test (W-11)."""
    last = train[-1]
    pos = positions(df.where(F.col(segment) == last), keys, order)
    n = pos.groupBy(*keys).agg(F.count("*").alias("_n"))
    cut = pos.join(n, keys).groupBy(*keys).agg(
        F.min(F.when(F.col("pos") >= F.floor(F.col("_n") * (1 - val_share)), F.col(order))).alias("_cut")
    )
    split = (
        F.when(F.col(segment).isin(test), "test")
        .when((F.col(segment) == last) & (F.col(order) >= F.col("_cut")), "val")
        .when(F.col(segment).isin(train), "train")
    )
    return df.join(cut, keys).withColumn("split", split).drop("_cut")


def channel_stats(df: DataFrame, keys: list[str], channels: list[str]) -> DataFrame:
    """Mean and population deviation over all channels together, one row per city (P-24)."""
    stacked = df.select(*keys, F.explode(F.array(*channels)).alias("_x"))
    return stacked.groupBy(*keys).agg(F.avg("_x").alias("mean"), F.stddev_pop("_x").alias("std"))


def normalise(df: DataFrame, stats: DataFrame, keys: list[str], channels: list[str]) -> DataFrame:
    d = df.join(stats, keys)
    return d.withColumns({c: (F.col(c) - F.col("mean")) / (F.col("std") + 1e-8) for c in channels})


def denormalise(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: F.col(c) * F.col("std") + F.col("mean") for c in cols})
