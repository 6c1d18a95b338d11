"""Order choice with moving-average terms and the unit-root test with chosen lags (FC-08, FC-09).

One pass per series sums the products of a value, its lags and 1. Every regression here is on linear
combinations of these (differences, residuals of a long autoregression), so its normal equations are
products of that one matrix of sums with the combinations; only these small systems are solved
in Python, one row per series.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.operators.forecast import lag_moments

LONG = 8  # lags of the autoregression whose residuals stand for the shocks
CRITICAL = -2.86  # 5 % value of the test with a constant


def centred_moments(train: DataFrame, value: str, keys: list[str], order: str, lags: int) -> DataFrame:
    """``lag_moments`` of the value less its mean, which keeps differences of sums exact enough."""
    mean = train.groupBy(*keys).agg(F.avg(value).alias("_mean"))
    d = train.select(*keys, order, value).join(mean, keys).withColumn(value, F.col(value) - F.col("_mean"))
    return lag_moments(d, value, keys, order, lags)


def symmetric(upper, size: int) -> np.ndarray:
    m = np.zeros((size, size))
    m[np.triu_indices(size)] = upper
    return m + np.triu(m, 1).T


def regression(m: np.ndarray, y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """Coefficients, sum of squared residuals and X'X of y on the rows of x, all combinations of the summed columns."""
    xx, xy = x @ m @ x.T, x @ m @ y
    coef = np.linalg.lstsq(xx, xy, rcond=None)[0]
    return coef, max(float(y @ m @ y - coef @ xy), 1e-12), xx


def aic(n: float, rss: float, terms: int) -> float:
    return n * math.log(rss / n) + 2 * terms


def arma_fits(m: np.ndarray, p_max: int, q_max: int, long: int) -> list[dict]:
    """AIC of each (p, q) but (0, 0): regressions on p lags and on q lags of the residuals of a long autoregression."""
    unit = np.eye(len(m))
    value = lambda lag: unit[1 + lag]
    c = regression(m, value(0), np.stack([unit[0], *(value(i) for i in range(1, long + 1))]))[0]
    shock = lambda lag: value(lag) - c[0] * unit[0] - sum(c[i] * value(lag + i) for i in range(1, long + 1))
    shocks = [shock(j) for j in range(1, q_max + 1)]
    out = []
    for p in range(p_max + 1):
        for q in range(q_max + 1):
            if p + q:
                coef, rss, _ = regression(m, value(0), np.stack([unit[0], *(value(i) for i in range(1, p + 1)), *shocks[:q]]))
                out.append({"p": p, "q": q, "aic": aic(m[0, 0], rss, p + q + 1), "coef": coef.tolist()})
    return out


def arma_orders(train: DataFrame, value: str, keys: list[str], order: str, p_max: int = 3, q_max: int = 2, long: int = LONG) -> DataFrame:
    """AIC and coefficients (constant, lags, lagged shocks; of the centred series) of ARMA(p, q) per series (FC-09)."""
    lags = max(p_max, q_max + long)

    @F.pandas_udf("array<struct<p:int,q:int,aic:double,coef:array<double>>>")
    def solve(moments: pd.Series) -> pd.Series:
        return pd.Series([arma_fits(symmetric(m, lags + 2), p_max, q_max, long) for m in moments])

    m = centred_moments(train, value, keys, order, lags)
    return m.select(*keys, F.explode(solve("moments")).alias("_f")).select(*keys, "_f.*")


def select_arma(orders: DataFrame, keys: list[str]) -> DataFrame:
    """The (p, q) with the smallest AIC; of equals the one with fewer lags."""
    best = F.min_by(F.struct("p", "q", "aic", "coef"), F.struct("aic", "p", "q"))
    return orders.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.*")


def unit_root_fits(m: np.ndarray, max_lags: int, critical: float) -> dict:
    """The first difference order 0, 1, 2 whose statistic passes, each with the number of lags of least AIC."""
    size = len(m)
    binomial = lambda d: [(-1) ** i * math.comb(d, i) for i in range(d + 1)]

    def diff(d: int, lag: int) -> np.ndarray:
        v = np.zeros(size)
        v[1 + lag : 2 + lag + d] = binomial(d)
        return v

    one = np.eye(size)[0]
    n = m[0, 0]
    for d in range(3):
        y, level = diff(d + 1, 0), diff(d, 1)
        best = None
        for k in range(max_lags + 1):
            coef, rss, xx = regression(m, y, np.stack([one, level, *(diff(d + 1, i) for i in range(1, k + 1))]))
            terms = k + 2
            score = aic(n, rss, terms)
            if best is None or score < best[0]:
                spread = rss / max(n - terms, 1) * np.linalg.pinv(xx)[1, 1]
                best = score, float(coef[1] / math.sqrt(spread)) if spread > 0 else 0.0, k
        if best[1] < critical or d == 2:
            return {"d": d, "stat": best[1], "lags": best[2], "stationary": d == 0 and best[1] < critical}
    raise AssertionError


def unit_root_lagged(df: DataFrame, value: str, keys: list[str], order: str, max_lags: int = 12, critical: float = CRITICAL) -> DataFrame:
    """Augmented Dickey-Fuller statistic (FC-08): change on level, constant and lagged changes, their number by AIC.

    ``d`` is the first order of differences whose statistic passes the critical value, else 2.
    All regressions of a series are on the rows that have all lags.
    """

    @F.pandas_udf("struct<d:int,stat:double,lags:int,stationary:boolean>")
    def solve(moments: pd.Series) -> pd.DataFrame:
        found = [unit_root_fits(symmetric(m, max_lags + 5), max_lags, critical) for m in moments]
        return pd.DataFrame(found, columns=["d", "stat", "lags", "stationary"])

    m = centred_moments(df, value, keys, order, max_lags + 3)
    return m.select(*keys, solve("moments").alias("_f")).select(*keys, "_f.*")
