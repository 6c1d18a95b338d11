"""Time-series operators that never put a whole series into one task.

A series is cut into chunks of ``CHUNK`` steps. Frames of bounded width run inside a chunk
plus a halo of copied neighbour rows; unbounded carries (fill, runs) run inside a chunk and
meet through one summary row per chunk. Partitions stay bounded however long or hot a key is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 48 * 30


def with_halo(df: DataFrame, order: str, before: int, after: int = 0, chunk: int = CHUNK) -> DataFrame:
    """Copy each row to every chunk whose frames can see it; ``_core`` marks the owner's copy."""
    o = F.col(order)
    first, last = F.floor((o - after) / chunk), F.floor((o + before) / chunk)
    return df.withColumn("_chunk", F.explode(F.sequence(first, last))).withColumn(
        "_core", F.col("_chunk") == F.floor(o / chunk)
    )


def halo_window(keys: list[str], order: str):
    return Window.partitionBy(*keys, "_chunk").orderBy(order)


def core(df: DataFrame) -> DataFrame:
    return df.where("_core").drop("_chunk", "_core")


def lagged(
    df: DataFrame, keys: list[str], order: str, lags: dict[str, tuple[str, int]], chunk: int = CHUNK
) -> DataFrame:
    """Add ``name = column at order - lag``; null where that step is absent (W-09)."""
    reach = max(lag for _, lag in lags.values())
    w = halo_window(keys, order)
    cols = {
        name: F.when(F.lag(order, lag).over(w) == F.col(order) - lag, F.lag(c, lag).over(w))
        for name, (c, lag) in lags.items()
    }
    return core(with_halo(df, order, reach, chunk=chunk).withColumns(cols))


def differences(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """First and second difference (W-13)."""
    d = lagged(df, keys, order, {"_l1": (value, 1), "_l2": (value, 2)})
    return d.withColumns(
        {
            "d1": F.col(value) - F.col("_l1"),
            "d2": F.col(value) - 2 * F.col("_l1") + F.col("_l2"),
        }
    ).drop("_l1", "_l2")


def known_neighbours(
    df: DataFrame, keys: list[str], order: str, cols: list[str], chunk: int = CHUNK
) -> DataFrame:
    """For each column add ``_prev_c`` and ``_next_c``: structs (at, v) of the nearest
    non-null value at or before, and at or after, the row."""
    by = [*keys, "_chunk"]
    d = df.withColumn("_chunk", F.floor(F.col(order) / chunk))
    up = Window.partitionBy(*by).orderBy(F.col(order).asc())
    down = Window.partitionBy(*by).orderBy(F.col(order).desc())
    known = {
        c: F.when(F.col(c).isNotNull(), F.struct(F.col(order).alias("at"), F.col(c).alias("v")))
        for c in cols
    }
    local = d.withColumns({f"_prev_{c}": F.last(k, True).over(up) for c, k in known.items()})
    local = local.withColumns({f"_next_{c}": F.last(k, True).over(down) for c, k in known.items()})

    # one row per chunk: its last and first known value, then carried across chunks
    ends = local.groupBy(*by).agg(
        *[F.max(f"_prev_{c}").alias(f"_l_{c}") for c in cols],
        *[F.min(f"_next_{c}").alias(f"_f_{c}") for c in cols],
    )
    past = Window.partitionBy(*keys).orderBy(F.col("_chunk").asc()).rowsBetween(
        Window.unboundedPreceding, -1
    )
    future = Window.partitionBy(*keys).orderBy(F.col("_chunk").desc()).rowsBetween(
        Window.unboundedPreceding, -1
    )
    carried = ends.select(
        *by,
        *[F.last(f"_l_{c}", True).over(past).alias(f"_cp_{c}") for c in cols],
        *[F.last(f"_f_{c}", True).over(future).alias(f"_cn_{c}") for c in cols],
    )
    out = local.join(carried, by, "left")
    out = out.withColumns(
        {f"_prev_{c}": F.coalesce(f"_prev_{c}", f"_cp_{c}") for c in cols}
        | {f"_next_{c}": F.coalesce(f"_next_{c}", f"_cn_{c}") for c in cols}
    )
    return out.drop("_chunk", *[f"_cp_{c}" for c in cols], *[f"_cn_{c}" for c in cols])


def _drop_neighbours(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.drop(*[f"_prev_{c}" for c in cols], *[f"_next_{c}" for c in cols])


def ffill_bfill(
    df: DataFrame, keys: list[str], order: str, cols: list[str], backward: bool = True
) -> DataFrame:
    """Last known value, then (optionally) the next known one (W-04)."""
    d = known_neighbours(df, keys, order, cols)
    fill = {
        c: F.coalesce(F.col(f"_prev_{c}.v"), F.col(f"_next_{c}.v")) if backward else F.col(f"_prev_{c}.v")
        for c in cols
    }
    return _drop_neighbours(d.withColumns(fill), cols)


def interpolate(
    df: DataFrame, keys: list[str], order: str, cols: list[str], leading: str = "nearest"
) -> DataFrame:
    """Linear in ``order`` between known values (W-03 with a position, W-05 with a time).

    After the last known value it stays constant. Before the first one it is the nearest
    value (``leading="nearest"``), zero (``"zero"``) or null (``"null"``).
    """
    d = known_neighbours(df, keys, order, cols)
    out = {}
    for c in cols:
        p, n, o = F.col(f"_prev_{c}"), F.col(f"_next_{c}"), F.col(order)
        lerp = p["v"] + (n["v"] - p["v"]) * ((o - p["at"]) / (n["at"] - p["at"]))
        head = {"nearest": n["v"], "zero": F.lit(0.0), "null": F.lit(None).cast("double")}[leading]
        out[c] = (
            # a known row is its own neighbour: the plain column is not read, so both uses of
            # the neighbours share one shuffle
            F.when(p["at"] == o, p["v"])
            .when(p.isNotNull() & n.isNotNull(), lerp)
            .when(p.isNotNull(), p["v"])
            .otherwise(head)
        )
    return _drop_neighbours(d.withColumns(out), cols)


def run_starts(flagged: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows are the flagged steps of each key; adds ``run_start`` of the unbroken run (W-15)."""
    w = halo_window(keys, order)
    prev = F.lag(order, 1).over(w)
    start = F.when(prev.isNull() | (prev != F.col(order) - 1), F.col(order))
    d = core(with_halo(flagged, order, 1).withColumn("_start", start))
    d = known_neighbours(d, keys, order, ["_start"])
    return _drop_neighbours(d.withColumn("run_start", F.col("_prev__start.at")), ["_start"]).drop("_start")


def runs(flagged: DataFrame, keys: list[str], order: str, min_length: int = 1) -> DataFrame:
    """Unbroken runs with their length; ``min_length=2`` is the persistence rule."""
    d = run_starts(flagged, keys, order)
    return (
        d.groupBy(*keys, "run_start")
        .agg(F.max(order).alias("run_end"), F.count("*").alias("duration_steps"))
        .where(F.col("duration_steps") >= min_length)
    )


def sliding_samples(
    df: DataFrame,
    keys: list[str],
    order: str,
    inputs: list[str],
    target: str,
    t_in: int,
    t_out: int,
    guard: bool = True,
) -> DataFrame:
    """One row per window start: input arrays and the target array (W-08).

    ``order`` at the row is the last input step. With ``guard`` windows over a gap are left out.
    """
    w = halo_window(keys, order)
    past, ahead = w.rowsBetween(-(t_in - 1), 0), w.rowsBetween(1, t_out)
    d = with_halo(df, order, t_in - 1, t_out)
    d = d.withColumns(
        {f"x_{c}": F.collect_list(c).over(past) for c in inputs}
        | {
            "y": F.collect_list(target).over(ahead),
            "_first": F.min(order).over(past),
            "_last": F.max(order).over(ahead),
        }
    )
    full = (F.size(f"x_{inputs[0]}") == t_in) & (F.size("y") == t_out)
    if guard:
        full = full & (F.col("_last") - F.col("_first") == t_in + t_out - 1)
    return core(d.where(full)).select(*keys, order, *[f"x_{c}" for c in inputs], "y")


def calendar(df: DataFrame, keys: list[str], order: str, every: int = 1) -> DataFrame:
    """All steps from the first to the last of each key, spread over tasks chunk by chunk."""
    span = df.groupBy(*keys).agg(F.min(order).alias("_lo"), F.max(order).alias("_hi"))
    width = CHUNK * every
    pieces = span.withColumn("_from", F.explode(F.sequence("_lo", "_hi", F.lit(width))))
    pieces = pieces.repartition(*[F.col(k) for k in keys], F.col("_from"))
    upto = F.least(F.col("_from") + (width - every), F.col("_hi"))
    return pieces.select(
        *keys, F.explode(F.sequence(F.col("_from"), upto, F.lit(every))).alias(order)
    )


def missing_steps(df: DataFrame, keys: list[str], order: str, every: int = 1) -> DataFrame:
    """Expected minus observed steps (J-16, S-02)."""
    return calendar(df, keys, order, every).join(df.select(*keys, order).distinct(), [*keys, order], "left_anti")


def reindex(df: DataFrame, keys: list[str], order: str, every: int = 1) -> DataFrame:
    """Observed rows on the full calendar, null where a step was missing."""
    return calendar(df, keys, order, every).join(df, [*keys, order], "left")


def first_by(df: DataFrame, keys: list[str], seq: list[str | Column]) -> DataFrame:
    """Keep the first row per key in ``seq`` order (W-01). Map-side partial, so a key that
    repeats without bound costs one row per task and not a sort."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.min_by(F.struct(*rest), F.struct(*seq)).alias("_row")
    return df.groupBy(*keys).agg(pick).select(*keys, "_row.*").select(*df.columns)


def ordinal(df: DataFrame, keys: list[str], bucket: str, order: list[str], name: str = "pos") -> DataFrame:
    """0-based position per key. ``bucket`` is a coarse column in the same order as ``order``:
    rows are ranked inside a bucket and shifted by the sizes of the buckets before it."""
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        df.groupBy(*keys, bucket)
        .agg(F.count("*").alias("_n"))
        .select(*keys, bucket, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    )
    inside = Window.partitionBy(*keys, bucket).orderBy(*order)
    ranked = df.withColumn("_rn", F.row_number().over(inside))
    return (
        ranked.join(offsets, [*keys, bucket])
        .withColumn(name, F.col("_off") + F.col("_rn") - 1)
        .drop("_off", "_rn")
    )
