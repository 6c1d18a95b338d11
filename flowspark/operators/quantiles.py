"""Exact quantiles without holding a group's values in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowspark.session import cut_lineage


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Linear-interpolated quantiles, one column per entry of ``probs``.

    Equal values are counted first. The counts are dealt out by ranges of (key, value), so one
    key with very many values covers many ranges. The total of each range tells which one holds
    a rank; only the values of those ranges are ranked, and a range is never larger than a
    partition of the shuffle.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_c"))
    placed = cut_lineage(counts.repartitionByRange(*keys, "_v").withColumn("_p", F.spark_partition_id()))
    over = Window.partitionBy(*keys).orderBy("_p")
    ranges = placed.groupBy(*keys, "_p").agg(F.sum("_c").alias("_s"))
    ranges = ranges.withColumns(
        {
            "_before": F.sum("_s").over(over.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_s"),
            "_n": F.sum("_s").over(over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        }
    )
    h = [(F.col("_n") - 1) * F.lit(p) for p in probs.values()]
    ranks = [
        F.struct(F.lit(q).alias("q"), F.lit(side).alias("side"), side_of(x).cast("long").alias("rank"), x.alias("h"))
        for q, x in enumerate(h)
        for side, side_of in enumerate((F.floor, F.ceil))
    ]
    want = ranges.select(*keys, "_p", "_before", "_s", F.explode(F.array(*ranks)).alias("_r"))
    want = want.where((F.col("_r.rank") >= F.col("_before")) & (F.col("_r.rank") < F.col("_before") + F.col("_s")))
    upto = Window.partitionBy(*keys, "_p", "_r.q", "_r.side").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = placed.join(want, [*keys, "_p"]).withColumn("_cum", F.col("_before") + F.sum("_c").over(upto))
    hit = ranked.where(F.col("_cum") > F.col("_r.rank")).groupBy(*keys, "_r.q", "_r.side").agg(F.min("_v").alias("_v"), F.first("_r.h").alias("_h"))

    def at(q: int, side: int, c: str = "_v"):
        return F.max(F.when((F.col("q") == q) & (F.col("side") == side), F.col(c)))

    def between(q: int):
        low, high, x = at(q, 0), at(q, 1), at(q, 0, "_h")
        return low + (high - low) * (x - F.floor(x))

    return hit.groupBy(*keys).agg(*[between(q).alias(name) for q, name in enumerate(probs)])
