"""Dataset profiles (SNK-04, A-15, A-16, A-18, A-19, A-27, A-31)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowspark.operators.quantiles import exact_quantiles

QUANTILES = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}


def share(flag: Column) -> Column:
    return F.avg(flag.cast("double"))


def channel_profile(df: DataFrame, by: list[str], channels: list[str]) -> DataFrame:
    """Count, range, mean, population deviation, zero share and exact quantiles per channel."""
    pairs = F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).alias("v")) for c in channels])
    d = df.select(*by, F.explode(pairs).alias("_p")).select(*by, "_p.*")
    keys = [*by, "channel"]
    stats = d.groupBy(*keys).agg(
        F.count("*").alias("n_rows"), F.min("v").alias("vmin"), F.max("v").alias("vmax"), F.avg("v").alias("mean"),
        F.stddev_pop("v").alias("std"), share(F.col("v") == 0).alias("zero_share"),
    )
    return stats.join(exact_quantiles(d, keys, "v", QUANTILES), keys)


def segment_profile(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count("*").alias("n_rows"), F.countDistinct("step").alias("n_steps"), F.min("step").alias("first_step"),
        F.max("step").alias("last_step"), F.avg("inflow").alias("mean_in"), F.avg("outflow").alias("mean_out"),
        share((F.col("inflow") < 0) | (F.col("outflow") < 0)).alias("missing_share"),
    )


def null_rates(df: DataFrame) -> DataFrame:
    """One row per column with its share of nulls."""
    rates = df.agg(*[share(F.col(c).isNull()).alias(c) for c in df.columns])
    rows = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("null_rate")) for c in df.columns])
    return rates.select(F.explode(rows).alias("_r")).select("_r.*")


def peak_step(df: DataFrame, by: list[str]) -> DataFrame:
    """Step of the largest total inflow, the earliest on ties."""
    total = df.groupBy(*by, "step").agg(F.round(F.sum("inflow"), 2).alias("total"))
    best = F.max_by(F.struct("step", "total"), F.struct("total", -F.col("step")))
    return total.groupBy(*by).agg(best.alias("_r")).select(*by, "_r.*")


def value_counts(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count("*").alias("n"))


def distinct_sketches(df: DataFrame, keys: list[str], part: str, value: str, lg_k: int = 12) -> DataFrame:
    """A sketch of the different values per key and ``part`` (A-05 at scale): 2**lg_k registers, whatever it has seen.

    Sketches merge, so any range of parts is counted without going back to the rows. The standard error
    of a count is about 1.04 / 2**(lg_k / 2).
    """
    return df.where(F.col(value).isNotNull()).groupBy(*keys, part).agg(F.hll_sketch_agg(value, lg_k).alias("sketch"))


def distinct_within(sketches: DataFrame, keys: list[str], part: str, ranges: Column) -> DataFrame:
    """Estimated number of different values per key and range, ``ranges`` being a column over ``part``."""
    d = sketches.withColumn("range", ranges).groupBy(*keys, "range").agg(F.hll_union_agg("sketch").alias("_u"))
    return d.select(*keys, "range", F.hll_sketch_estimate("_u").alias("estimate"))
