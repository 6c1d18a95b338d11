"""One linear model shared by all cells (FC-05..FC-07, FC-12, FC-13, A-32)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.operators import series
from flowspark.operators.splits import channel_stats
from flowspark.session import cut_lineage


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def fit(train: DataFrame, n_x: int, n_y: int, ridge: float = 1e-6) -> np.ndarray:
    """Least squares of all columns of ``y`` on ``x`` and a constant: weights (1 + n_x, n_y).

    X'X and X'Y are summed in one pass over the rows; the driver solves one system of the model's
    own size. ``ridge`` is relative to the mean square of the inputs and spares the constant.
    """
    k = 1 + n_x

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((k, k + n_y))
        for b in batches:
            for i in range(0, b.num_rows, 2000):
                part = b.slice(i, 2000)
                x = np.hstack([np.ones((part.num_rows, 1)), _matrix(part.column(0))])
                out += x.T @ np.hstack([x, _matrix(part.column(1))])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(out.size)), pa.array(out.ravel())], ["at", "v"])

    total = np.zeros(k * (k + n_y))
    for at, v in train.select("x", "y").mapInArrow(sums, "at long, v double").groupBy("at").agg(F.sum("v")).collect():
        total[at] = v
    both = total.reshape(k, k + n_y)
    gram = both[:, :k]
    gram[np.arange(1, k), np.arange(1, k)] += ridge * max(float(np.diag(gram)[1:].mean()), 1e-12)
    return np.linalg.lstsq(gram, both[:, k:], rcond=None)[0]


def predict(rows: DataFrame, weights: np.ndarray, horizons: list[int], keep: list[str] = ()) -> DataFrame:
    """Rows (keep, h, y, y_hat) for every row and horizon."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(horizons)
        for b in batches:
            p = _matrix(b.column("x")) @ weights[1:] + weights[0]
            at = pa.array(np.repeat(np.arange(b.num_rows), n))
            cols = [b.column(c).take(at) for c in keep]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array(np.tile(np.array(horizons, np.int32), b.num_rows)), pa.array(_matrix(b.column("y")).ravel()), pa.array(p.ravel())],
                [*keep, "h", "y", "y_hat"],
            )

    kinds = "".join(f"{c} {rows.schema[c].dataType.simpleString()}, " for c in keep)
    return rows.select(*keep, "x", "y").mapInArrow(run, f"{kinds}h int, y double, y_hat double")


def _wanted(horizons: list[int]):
    return F.array(*[F.col("y")[h - 1] for h in horizons])


def fit_predict(samples: DataFrame, inputs: list[str], horizons: list[int], t_in: int) -> DataFrame:
    """One regression per horizon on the window arrays; rows (h, y, y_hat) of the test part."""
    d = samples.select("is_train", F.concat(*inputs).alias("x"), _wanted(horizons).alias("y"))
    weights = fit(d.where("is_train"), t_in * len(inputs), len(horizons))
    return predict(d.where("NOT is_train"), weights, horizons)


def fit_predict_trees(
    samples: DataFrame, inputs: list[str], horizons: list[int], rounds: int = 10, depth: int = 4, step: float = 0.3, bins: int = 32, seed: int = 0
) -> DataFrame:
    """Boosted regression trees, one set per horizon, on the window arrays; rows (h, y, y_hat) of the test part.

    Splits are chosen from histograms of at most ``bins`` values a feature, so a horizon takes about
    rounds x depth passes over the training rows, written once, whatever their number.
    """
    d = cut_lineage(samples.select("is_train", F.concat(*inputs).alias("x"), _wanted(horizons).alias("y")))
    d = d.withColumn("features", array_to_vector("x"))
    out = None
    for i, h in enumerate(horizons):
        own = d.select("is_train", "features", F.col("y")[i].alias("target"))
        trees = GBTRegressor(featuresCol="features", labelCol="target", maxIter=rounds, maxDepth=depth, maxBins=bins, stepSize=step, seed=seed)
        model = trees.fit(own.where("is_train").select("features", "target"))
        told = model.transform(own.where("NOT is_train")).select(F.lit(h).alias("h"), F.col("target").alias("y"), F.col("prediction").alias("y_hat"))
        out = told if out is None else out.unionByName(told)
    return out


def transfer(
    source: DataFrame, source_city: str, target: DataFrame, keys: list[str], order: str, value: str, t_in: int, horizons: list[int]
) -> DataFrame:
    """Zero-shot: statistics and model of one source city applied to other cities.

    Rows (keys, order, h, y, y_hat) of the target's test part, in the target's unit.
    """
    own = source.where((F.col("city") == source_city) & F.col("is_train"))
    stats = channel_stats(own, ["city"], [value]).first()
    mean, std = (stats["mean"], stats["std"]) if stats else (0.0, 1.0)

    def windows(df: DataFrame) -> DataFrame:
        d = df.withColumn(value, (F.col(value) - mean) / (std + 1e-8))
        d = series.sliding_samples(d.select(*keys, order, value), keys, order, [value], value, t_in, max(horizons))
        return d.select(*keys, order, F.col(f"x_{value}").alias("x"), _wanted(horizons).alias("y"))

    weights = fit(windows(own), t_in, len(horizons))
    p = predict(windows(target.where("NOT is_train")), weights, horizons, [*keys, order])
    return p.withColumns({c: F.col(c) * std + mean for c in ("y", "y_hat")})


def lookup(pred: DataFrame, city: str, order: str, value: str, horizon: int, start=None, grid_ids: list[int] | None = None) -> DataFrame:
    """A cell -> (step, value) pairs map per city (FC-13); ``start`` defaults to the first
    forecast step. At most horizon pairs per listed cell are gathered; a cell keeps its own steps."""
    d = pred if grid_ids is None else pred.where(F.col("grid_id").isin(grid_ids))
    first = F.lit(start).alias("_from") if start is not None else F.min(order).alias("_from")
    d = d.join(pred.groupBy(city).agg(first), city)
    d = d.where((F.col(order) >= F.col("_from")) & (F.col(order) < F.col("_from") + horizon))
    per_cell = d.groupBy(city, "grid_id", "_from").agg(F.sort_array(F.collect_list(F.struct(order, value))).alias("_v"))
    return per_cell.groupBy(city).agg(
        F.min("_from").alias("start"), F.map_from_entries(F.collect_list(F.struct("grid_id", "_v"))).alias("predictions")
    )


def linear_contributions(df: DataFrame, names: list[str], target: str) -> DataFrame:
    """coefficient x (value - mean) of every column in a linear fit of ``target``."""
    # one row per cell, costly to derive: written once, read by the fit and the result
    d = cut_lineage(df.fillna(0.0, subset=names))
    d = VectorAssembler(inputCols=names, outputCol="features").transform(d)
    model = LinearRegression(featuresCol="features", labelCol=target, solver="normal", regParam=0.01).fit(d.select("features", target))
    means = d.groupBy("city").agg(*[F.avg(c).alias(f"_m_{c}") for c in names])
    d = d.join(means, "city")
    cols = {c: F.lit(float(b)) * (F.col(c) - F.col(f"_m_{c}")) for c, b in zip(names, model.coefficients)}
    return d.withColumns(cols).select("city", "grid_id", *names)
