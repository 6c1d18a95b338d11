"""Forecast baselines and diagnostics: one model per cell as grouped aggregates (FC-*)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowspark.operators import series
from flowspark.operators.baseline import slot_baseline

T_OUT = 48


def historical_average(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Predict the non-training rows by the training mean of their slot (FC-01)."""
    base = slot_baseline(df.where("is_train"), F.col(value), keys).select(*keys, "slot", F.col("mu").alias("y_hat"))
    return df.where("NOT is_train").join(base, [*keys, "slot"]).withColumn("y", F.col(value))


def recent_mean(train: DataFrame, value: str, keys: list[str], order: str, n: int = T_OUT) -> DataFrame:
    """Mean of the last n training values (FC-02). The rank filter is applied before the
    shuffle, so at most n rows per task and cell travel."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return (
        train.select(*keys, order, value)
        .withColumn("_rn", F.row_number().over(w))
        .where(F.col("_rn") <= n)
        .groupBy(*keys)
        .agg(F.avg(value).alias("fallback"))
    )


def ar1_fit(train: DataFrame, value: str, keys: list[str], order: str) -> DataFrame:
    """Slope and intercept of x_t on x_{t-1} per cell (FC-03); a flat series has slope 0."""
    d = series.lagged(train.select(*keys, order, value), keys, order, {"_x": (value, 1)})
    y, x = F.col(value), F.col("_x")
    phi = F.coalesce(F.regr_slope(y, x), F.lit(0.0))
    return (
        d.where("_x IS NOT NULL")
        .groupBy(*keys)
        .agg(phi.alias("phi"), F.avg(y).alias("_my"), F.avg(x).alias("_mx"), F.count("*").alias("n"))
        .select(*keys, "phi", (F.col("_my") - F.col("phi") * F.col("_mx")).alias("c"), "n")
    )


def ar1_rolling(
    df: DataFrame, fit: DataFrame, value: str, keys: list[str], order: str, block: int = T_OUT
) -> DataFrame:
    """Forecast the test rows in blocks; each block starts from the true value before it.

    ``df`` carries ``test_pos``, the position inside the test part (-1 is the last training
    row). Origins are one row per cell and block.
    """
    origin = (
        df.where((F.col("test_pos") >= -1) & ((F.col("test_pos") + 1) % block == 0))
        .select(*keys, ((F.col("test_pos") + 1) / block).cast("long").alias("block"), F.col(value).alias("_x0"))
    )
    test = df.where(F.col("test_pos") >= 0).withColumns(
        {"block": F.floor(F.col("test_pos") / block), "h": F.col("test_pos") % block + 1}
    )
    d = test.join(origin, [*keys, "block"]).join(fit, keys)
    p, c, h = F.col("phi"), F.col("c"), F.col("h")
    grow = F.pow(p, h)
    drift = F.when(F.abs(1 - p) < 1e-9, c * h).otherwise(c * (1 - grow) / (1 - p))
    return d.withColumns({"y": F.col(value), "y_hat": drift + grow * F.col("_x0")}).drop("_x0")


def autocorrelation(df: DataFrame, value: str, keys: list[str], order: str, lags: int) -> DataFrame:
    """ACF at lags 1..n (W-18): centred lag products from one halo pass, no self-join."""
    stats = df.groupBy(*keys).agg(F.avg(value).alias("_m"), F.count("*").alias("n"))
    d = df.select(*keys, order, value).join(stats, keys)
    d = d.withColumn("_d", F.col(value) - F.col("_m"))
    d = series.lagged(d, keys, order, {f"_d{k}": ("_d", k) for k in range(1, lags + 1)})
    sums = d.groupBy(*keys).agg(
        F.max("n").alias("n"),
        F.sum(F.col("_d") * F.col("_d")).alias("_ss"),
        *[F.coalesce(F.sum(F.col("_d") * F.col(f"_d{k}")), F.lit(0.0)).alias(f"_c{k}") for k in range(1, lags + 1)],
    )
    pairs = F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"_c{k}").alias("c")) for k in range(1, lags + 1)])
    return sums.select(*keys, "n", "_ss", F.explode(pairs).alias("_p")).select(
        *keys, "n", F.col("_p.lag").alias("lag"),
        F.when(F.col("_ss") > 0, F.col("_p.c") / F.col("_ss")).alias("acf"),
    )


def ljung_box(acf: DataFrame, keys: list[str], lags: int = 10) -> DataFrame:
    """Q statistic and chi-square tail for an even number of lags (FC-10)."""
    if lags % 2:
        raise ValueError("lags must be even")
    n, k, a = F.col("n"), F.col("lag"), F.col("acf")
    q = acf.where(k <= lags).groupBy(*keys).agg((F.first("n") * (F.first("n") + 2) * F.sum(a * a / (n - k))).alias("q"))
    half = F.col("q") / 2
    tail = F.lit(0.0)
    for i in range(lags // 2):
        tail = tail + F.pow(half, F.lit(i)) / math.factorial(i)
    return q.withColumn("p_value", F.exp(-half) * tail).withColumn("white_noise", F.col("p_value") > 0.05)


def unit_root(df: DataFrame, value: str, keys: list[str], order: str, critical: float = -2.86) -> DataFrame:
    """Dickey-Fuller t statistic for the series and its first two differences (FC-08).

    ``d`` is the first order whose statistic passes the 5 % value, else 2.
    """
    lags = {f"_l{k}": (value, k) for k in range(1, 4)}
    x = series.lagged(df.select(*keys, order, value), keys, order, lags)
    l0, l1, l2, l3 = F.col(value), F.col("_l1"), F.col("_l2"), F.col("_l3")
    # (change of the d-th difference, its previous level)
    pairs = {
        0: (l0 - l1, l1),
        1: (l0 - 2 * l1 + l2, l1 - l2),
        2: (l0 - 3 * l1 + 3 * l2 - l3, l1 - 2 * l2 + l3),
    }
    aggs = []
    for d, (dy, lv) in pairs.items():
        aggs += [
            F.regr_count(dy, lv).alias(f"n{d}"),
            F.regr_sxx(dy, lv).alias(f"sxx{d}"),
            F.regr_sxy(dy, lv).alias(f"sxy{d}"),
            F.regr_syy(dy, lv).alias(f"syy{d}"),
        ]
    s = x.groupBy(*keys).agg(*aggs)

    def t_stat(d: int) -> Column:
        n, sxx, sxy, syy = (F.col(f"{m}{d}") for m in ("n", "sxx", "sxy", "syy"))
        b = sxy / sxx
        se = F.sqrt((syy - b * sxy) / (n - 2) / sxx)
        return F.when((sxx > 0) & (se > 0), b / se)

    s = s.select(*keys, *[t_stat(d).alias(f"t{d}") for d in pairs])
    order_d = F.when(F.col("t0") < critical, 0).when(F.col("t1") < critical, 1).otherwise(2)
    stat = F.when(F.col("t0") < critical, F.col("t0")).when(F.col("t1") < critical, F.col("t1")).otherwise(F.col("t2"))
    return s.select(*keys, order_d.alias("d"), stat.alias("stat"), (F.col("t0") < critical).alias("stationary"))


def most_common(df: DataFrame, col: str) -> DataFrame:
    """Mode as a count per value and the largest count, smallest value on ties (A-17)."""
    return df.groupBy(col).agg(F.count("*").alias("n")).agg(
        F.max_by(F.col(col), F.struct("n", -F.col(col))).alias("value"), F.max("n").alias("n")
    )


def lag_moments(train: DataFrame, value: str, keys: list[str], order: str, p_max: int) -> DataFrame:
    """Sums of lag products of (1, x_t, x_{t-1}, .., x_{t-p}) per cell, on rows with all lags."""
    names = [f"_l{k}" for k in range(1, p_max + 1)]
    d = series.lagged(train.select(*keys, order, value), keys, order, {n: (value, k + 1) for k, n in enumerate(names)})
    v = [F.lit(1.0), F.col(value), *[F.col(n) for n in names]]
    sums = [F.sum(v[i] * v[j]) for i in range(len(v)) for j in range(i, len(v))]
    return d.where(F.col(names[-1]).isNotNull()).groupBy(*keys).agg(F.array(*sums).alias("moments"))


def _ar_solver(p_max: int):
    @F.pandas_udf("array<struct<p:int,aic:double,coef:array<double>>>")
    def solve(moments: pd.Series) -> pd.Series:
        size = p_max + 2
        out = []
        for m in moments:
            full = np.zeros((size, size))
            full[np.triu_indices(size)] = m
            full = full + np.triu(full, 1).T
            n, yy = full[0, 0], full[1, 1]
            fits = []
            for p in range(p_max + 1):
                idx = [0, *range(2, 2 + p)]
                a, b = full[np.ix_(idx, idx)], full[idx, 1]
                coef = np.linalg.lstsq(a, b, rcond=None)[0]
                rss = max(float(yy - coef @ b), 1e-12)
                fits.append({"p": p, "aic": n * math.log(rss / n) + 2 * (p + 1), "coef": coef.tolist()})
            out.append(fits)
        return pd.Series(out)

    return solve


def ar_orders(train: DataFrame, value: str, keys: list[str], order: str, p_max: int = 3) -> DataFrame:
    """AIC of AR(p), p = 0..p_max, and its coefficients per cell. Sums are Spark aggregates;
    only the small linear systems are solved in Python, one row per cell."""
    m = lag_moments(train, value, keys, order, p_max)
    return m.select(*keys, F.explode(_ar_solver(p_max)("moments")).alias("_f")).select(*keys, "_f.*")


def select_order(orders: DataFrame, keys: list[str]) -> DataFrame:
    """Order with the smallest AIC (FC-09)."""
    return orders.groupBy(*keys).agg(
        F.min_by(F.struct("p", "aic", "coef"), F.struct("aic", "p")).alias("_b")
    ).select(*keys, "_b.*")


# ---- trend and seasonal regression -------------------------------------------------------

DAILY_ORDER, WEEKLY_ORDER = 4, 3


def _fourier(step: np.ndarray, origin: np.ndarray, span: np.ndarray, tz_hours: int) -> np.ndarray:
    local = step + 2 * tz_hours
    cols = [np.ones(len(step)), (step - origin) / span]
    for period, k_max in ((48.0, DAILY_ORDER), (336.0, WEEKLY_ORDER)):
        for k in range(1, k_max + 1):
            cols += [np.sin(2 * np.pi * k * local / period), np.cos(2 * np.pi * k * local / period)]
    return np.stack(cols, axis=1)


def fourier_fit(train: DataFrame, value: str, keys: list[str], order: str, tz_hours: int, chunk: int = series.CHUNK) -> DataFrame:
    """Linear trend plus daily and weekly Fourier terms per cell (FC-04).

    Normal equations are summed per (cell, time chunk), a bounded group, and then per cell;
    one small system per cell is solved at the end.
    """
    span = train.groupBy(keys[0]).agg(F.min(order).alias("_o"), (F.max(order) - F.min(order) + 1).alias("_s"))
    d = (
        train.select(*keys, order, F.col(value).alias("_y"))
        .join(span, keys[0])
        .withColumn("_chunk", F.floor(F.col(order) / chunk))
    )
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in d.schema if f.name in keys)

    def partial(pdf: pd.DataFrame) -> pd.DataFrame:
        x = _fourier(pdf[order].to_numpy(float), pdf["_o"].to_numpy(float), pdf["_s"].to_numpy(float), tz_hours)
        y = pdf["_y"].to_numpy(float)
        row = {k: pdf[k].iloc[0] for k in keys}
        row |= {"o": float(pdf["_o"].iloc[0]), "s": float(pdf["_s"].iloc[0]), "xtx": (x.T @ x).ravel(), "xty": x.T @ y}
        return pd.DataFrame([row])

    parts = d.groupBy(*keys, "_chunk").applyInPandas(
        partial, f"{schema}, o double, s double, xtx array<double>, xty array<double>"
    )

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        b = np.sum(np.stack(pdf["xty"].to_list()), axis=0)
        a = np.sum(np.stack(pdf["xtx"].to_list()), axis=0).reshape(len(b), len(b))
        beta = np.linalg.solve(a + 1e-9 * np.eye(len(b)), b)
        row = {k: pdf[k].iloc[0] for k in keys} | {"o": pdf["o"].iloc[0], "s": pdf["s"].iloc[0], "beta": beta}
        return pd.DataFrame([row])

    # a cell has one partial row per 30 days
    return parts.groupBy(*keys).applyInPandas(solve, f"{schema}, o double, s double, beta array<double>")


def fourier_predict(df: DataFrame, fit: DataFrame, keys: list[str], order: str, tz_hours: int) -> DataFrame:
    """Evaluate the fitted terms with column expressions."""
    d = df.join(fit, keys)
    local = F.col(order) + 2 * tz_hours
    beta = F.col("beta")
    y = beta[0] + beta[1] * (F.col(order) - F.col("o")) / F.col("s")
    i = 2
    for period, k_max in ((48.0, DAILY_ORDER), (336.0, WEEKLY_ORDER)):
        for k in range(1, k_max + 1):
            angle = local * (2 * math.pi * k / period)
            y = y + beta[i] * F.sin(angle) + beta[i + 1] * F.cos(angle)
            i += 2
    return d.withColumn("y_hat", y).drop("beta", "o", "s")
