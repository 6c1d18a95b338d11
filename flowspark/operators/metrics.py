"""Masked forecast metrics (A-12, A-13, FC-11) and result tables (A-28, A-29)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HORIZONS = [1, 3, 6, 12]


def _metric_columns(mask: Column, y: Column, y_hat: Column, eps: float) -> dict[str, Column]:
    e = F.abs(y_hat - y)
    avg = lambda x: F.coalesce(F.avg(F.when(mask, x)), F.lit(0.0))
    return {
        "mae": avg(e),
        "rmse": F.sqrt(avg(e * e)),
        "mape": avg(e / (F.abs(y) + eps)) * 100,
    }


def masked_metrics(
    df: DataFrame, by: list[str], y: str = "y", y_hat: str = "y_hat", null_val: float = 0.0, eps: float = 1.0
) -> DataFrame:
    """MAE, RMSE, MAPE where |y| > null_val, zero if nothing is left, and Huber loss over all."""
    t, p = F.col(y), F.col(y_hat)
    e = F.abs(p - t)
    huber = F.avg(F.when(e <= 1, e * e / 2).otherwise(e - 0.5))
    cols = _metric_columns(F.abs(t) > null_val, t, p, eps)
    return df.groupBy(*by).agg(*[c.alias(n) for n, c in cols.items()], huber.alias("huber"))


def horizon_metrics(
    df: DataFrame,
    by: list[str],
    t_out: int,
    horizons: list[int] = HORIZONS,
    exact: bool = False,
    y: str = "y",
    y_hat: str = "y_hat",
    h: str = "h",
    eps: float = 1.0,
) -> DataFrame:
    """Metrics over the first h steps (or exactly step h) and over all steps, in one pass
    over the rows; the few result rows are unfolded afterwards."""
    t, p = F.col(y), F.col(y_hat)
    picks = {f"h{k}": (F.col(h) == k if exact else F.col(h) <= k) for k in horizons if k <= t_out}
    picks["avg"] = F.lit(True)
    aggs, rows = [], []
    for name, pick in picks.items():
        cols = _metric_columns((F.abs(t) > 0) & pick, t, p, eps)
        aggs += [c.alias(f"{name}_{m}") for m, c in cols.items()]
        rows.append(F.struct(F.lit(name).alias("horizon"), *[F.col(f"{name}_{m}").alias(m) for m in cols]))
    return df.groupBy(*by).agg(*aggs).select(*by, F.explode(F.array(*rows)).alias("_r")).select(*by, "_r.*")


def align_truth(pred: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """Prediction and truth on their common keys (J-19)."""
    return pred.join(truth, keys)


def model_comparison(log: DataFrame, metric: str = "mae") -> DataFrame:
    """Model by horizon (A-28)."""
    names = [f"h{k}" for k in HORIZONS] + ["avg"]
    return log.groupBy("model").pivot("horizon", names).agg(F.first(metric))


def ablation_summary(log: DataFrame, seq: str) -> DataFrame:
    """Last logged row of every (model, tag) at horizon ``avg`` (A-29)."""
    cols = ["t_in", "mae", "rmse", "mape"]
    last = F.max_by(F.struct(*cols), F.col(seq)).alias("_r")
    return log.where(F.col("horizon") == "avg").groupBy("model", "tag").agg(last).select("model", "tag", "_r.*")
