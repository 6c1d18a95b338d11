"""Per-city feature scaling. The statistics have one row per city and are broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowspark.functions.num import EPS


def scale(df: DataFrame, by: list[str], minmax: list[str] = (), zscore: list[str] = (), log_zscore: list[str] = ()) -> DataFrame:
    """Replace columns by their min-max (P-21), z (P-22) or log1p-z (P-23) value."""
    base: dict[str, Column] = {c: F.col(c) for c in [*minmax, *zscore]} | {c: F.log1p(c) for c in log_zscore}
    aggs = [a for c in minmax for a in (F.min(c).alias(f"_a_{c}"), F.max(c).alias(f"_b_{c}"))]
    aggs += [
        a
        for c in [*zscore, *log_zscore]
        for a in (F.avg(base[c]).alias(f"_a_{c}"), F.stddev_pop(base[c]).alias(f"_b_{c}"))
    ]
    d = df.join(df.groupBy(*by).agg(*aggs), by)
    out = {c: (F.col(c) - F.col(f"_a_{c}")) / (F.col(f"_b_{c}") - F.col(f"_a_{c}") + EPS) for c in minmax}
    out |= {c: (base[c] - F.col(f"_a_{c}")) / (F.col(f"_b_{c}") + EPS) for c in [*zscore, *log_zscore]}
    return d.withColumns(out).select(*df.columns)
