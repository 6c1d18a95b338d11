"""K-means with parallel seeding, the same centres at every run (A-30).

Seeding takes a few passes: each keeps a row with a chance in proportion to its squared distance from
the rows kept so far, drawn from a hash of the row and the pass. About ``oversample * k`` rows are kept
a pass. They are weighted by the rows nearest to them and reduced to k on the driver, which
holds passes x oversample x k vectors however large the table is. Rounds then move the centres to
the means of their rows; sums leave a task as one row per centre.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowspark.session import cut_lineage

DIGITS = 9  # centres are rounded here, so the order in which Spark adds does not show


def nearest(x: np.ndarray, centres: np.ndarray, block: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centre, the smaller on ties, and the squared distance, of each row."""
    number, distance = np.empty(len(x), np.int64), np.empty(len(x))
    norms = (centres**2).sum(1)
    for i in range(0, len(x), block):
        part = x[i : i + block]
        d = np.round(np.maximum((part**2).sum(1)[:, None] + norms - 2 * part @ centres.T, 0), DIGITS)
        number[i : i + block] = d.argmin(1)
        distance[i : i + block] = d.min(1)
    return number, distance


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def assigned(rows: DataFrame, centres: np.ndarray, keep: list[str]) -> DataFrame:
    """The columns ``keep`` with ``cluster`` and ``distance`` (squared)."""
    shared = rows.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                number, distance = nearest(_matrix(b.column(0)), shared.value)
                yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(number, pa.int32()), pa.array(distance)], [*keep, "cluster", "distance"])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.select("vec", *keep).mapInArrow(run, f"{kinds}, cluster int, distance double")


def seeds(rows: DataFrame, k: int, seed: int, passes: int, oversample: int) -> np.ndarray:
    """k starting centres from ``rows`` (key, vec)."""
    chance = lambda n: F.pmod(F.xxhash64("key", F.lit(seed), F.lit(n)), F.lit(1 << 52)) / float(1 << 52)
    first = rows.orderBy(chance(0), "key").select("vec").limit(1).collect()
    if not first:
        return np.zeros((0, 0))
    kept = np.array([r.vec for r in first])
    for n in range(1, passes + 1):
        near = assigned(rows, kept, ["key", "vec"])
        cost = near.agg(F.sum("distance")).collect()[0][0]
        if not cost:
            break
        draw = near.where(chance(n) < F.col("distance") * (oversample * k / cost)).select("vec").collect()
        kept = np.unique(np.concatenate([kept, np.array([r.vec for r in draw]).reshape(-1, kept.shape[1])]), axis=0)
    weight = np.zeros(len(kept))
    for r in assigned(rows, kept, ["key"]).groupBy("cluster").count().collect():
        weight[r["cluster"]] = r["count"]
    return reduced(kept, weight, k, seed)


def reduced(points: np.ndarray, weight: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Up to k of the weighted points, each drawn by its weight and squared distance from those before."""
    rng = np.random.default_rng(seed)
    at = [int(rng.choice(len(points), p=weight / weight.sum()))]
    distance = ((points - points[at[0]]) ** 2).sum(1)
    while len(at) < k and (weight * distance).sum() > 0:
        at.append(int(rng.choice(len(points), p=weight * distance / (weight * distance).sum())))
        distance = np.minimum(distance, ((points - points[at[-1]]) ** 2).sum(1))
    return points[at]


def moved(rows: DataFrame, centres: np.ndarray) -> np.ndarray:
    """The centres at the means of their rows; a centre without rows stays."""
    shared = rows.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        n, total = np.zeros(len(c), np.int64), np.zeros(c.shape)
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(0))
                number, _ = nearest(x, c)
                np.add.at(total, number, x)
                n += np.bincount(number, minlength=len(c))
        own = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"cluster": pa.array(own, pa.int32()), "n": n[own], "s": pa.array(total[own].tolist(), pa.list_(pa.float64()))})

    parts = rows.select("vec").mapInArrow(run, "cluster int, n long, s array<double>")
    each = parts.select("cluster", "n", F.posexplode("s").alias("at", "s")).groupBy("cluster", "at").agg((F.sum("s") / F.sum("n")).alias("m"))
    out = centres.copy()
    for r in each.collect():  # k x dimensions rows
        out[r["cluster"], r["at"]] = round(r["m"], DIGITS)
    return out


def kmeans(df: DataFrame, key: list[str], vec: Column, k: int, seed: int = 0, passes: int = 3, oversample: int = 2, rounds: int = 10) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """The rows with ``cluster`` and ``distance``; the centres; the starting centres.

    ``key`` names the columns that tell rows apart. Fewer different rows than k give fewer centres.
    """
    rows = cut_lineage(df.select("*", F.struct(*key).alias("key"), vec.cast("array<double>").alias("vec")))
    start = seeds(rows.select("key", "vec"), k, seed, passes, oversample)
    centres = start
    for _ in range(rounds if len(start) else 0):
        now = moved(rows, centres)
        if (now == centres).all():
            break
        centres = now
    if not len(start):
        return df.withColumns({"cluster": F.lit(0), "distance": F.lit(0.0)}), centres, start
    return assigned(rows, centres, df.columns), centres, start
