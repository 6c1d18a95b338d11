"""Forecast and diagnostics queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.functions.num import rnd as r
from flowspark.operators import arma
from flowspark.operators import forecast as fc
from flowspark.operators import metrics as mt
from flowspark.operators import pooled
from flowspark.operators import series
from flowspark.plans import fixtures as fx
from flowspark.plans.oracle import cte, rnd, sql
from flowspark.plans.registry import query
from flowspark.plans.q_scalars import metric_cols, metric_sql, predictions
from flowspark.session import cut_lineage
from flowspark.sources.tables import Tables, view

G, KEYS = fx.GRID, fx.KEYS


@query("sliding_windows", sql(["flow"], """
SELECT grid_id, step, array_to_string(list_transform(x_in, lambda v: printf('%.2f', v)), ',') AS x_in,
  array_to_string(list_transform(x_out, lambda v: printf('%.2f', v)), ',') AS x_out,
  array_to_string(list_transform(y, lambda v: printf('%.2f', v)), ',') AS y FROM (
  SELECT grid_id, step, list(inflow) OVER p AS x_in, list(outflow) OVER p AS x_out, list(inflow) OVER f AS y FROM flow
  WINDOW p AS (PARTITION BY grid_id ORDER BY step ROWS BETWEEN 11 PRECEDING AND CURRENT ROW),
         f AS (PARTITION BY grid_id ORDER BY step ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)) WHERE len(x_in) = 12 AND len(y) = 3"""))
def sliding_windows(t: Tables) -> DataFrame:
    d = series.sliding_samples(fx.flow(t), KEYS, "step", ["inflow", "outflow"], "inflow", 12, 3)
    text = lambda c: F.array_join(F.transform(c, lambda v: F.format_string("%.2f", v)), ",")
    return d.select("grid_id", "step", text("x_inflow").alias("x_in"), text("x_outflow").alias("x_out"), text("y").alias("y"))


@query("sliding_windows_guarded", sql(["sparse"], """
SELECT grid_id, count(*) AS n_samples FROM (SELECT grid_id, max(step) OVER w - min(step) OVER w AS span, count(*) OVER w AS n FROM sparse
  WINDOW w AS (PARTITION BY grid_id ORDER BY step ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING)) WHERE n = 4 AND span = 3 GROUP BY 1"""))
def sliding_windows_guarded(t: Tables) -> DataFrame:
    """Windows of the series with gaps: those over a gap are left out."""
    d = series.sliding_samples(fx.flow_sparse(t), KEYS, "step", ["inflow"], "inflow", 3, 1)
    return d.groupBy("grid_id").agg(F.count("*").alias("n_samples"))


cte("lagged", "SELECT *, lag(inflow) OVER (PARTITION BY grid_id ORDER BY step) AS prev FROM flow", ["flow"])
cte("ar1", """
SELECT grid_id, phi, my - phi * mx AS c, n FROM (
  SELECT grid_id, CASE WHEN regr_sxx(inflow, prev) > 0 THEN regr_slope(inflow, prev) ELSE 0 END AS phi, avg(inflow) AS my, avg(prev) AS mx, count(*) AS n
  FROM lagged WHERE is_train AND prev IS NOT NULL GROUP BY 1)
""", ["lagged"])


@view
def ar1(t: Tables) -> DataFrame:
    return fc.ar1_fit(fx.flow_split(t).where("is_train"), "inflow", KEYS, "step")


@query("ar1_fit", sql(["ar1"], f"SELECT grid_id, {rnd('phi', 'phi')}, {rnd('c', 'c')}, n FROM ar1"))
def ar1_fit(t: Tables) -> DataFrame:
    return ar1(t).select("grid_id", r(F.col("phi")).alias("phi"), r(F.col("c")).alias("c"), "n")


cte("rolling", """
SELECT f.grid_id, f.step, block, h, f.inflow AS y, c * (1 - pow(phi, h)) / (1 - phi) + pow(phi, h) * o.inflow AS y_hat FROM (
  SELECT *, (step - cut) // 48 AS block, (step - cut) % 48 + 1 AS h, cut + (step - cut) // 48 * 48 - 1 AS origin
  FROM flow, (SELECT min(step) AS cut FROM flow WHERE NOT is_train) WHERE NOT is_train) f
JOIN flow o ON o.grid_id = f.grid_id AND o.step = f.origin JOIN ar1 a ON a.grid_id = f.grid_id
""", ["flow", "ar1"])


@view
def rolling(t: Tables) -> DataFrame:
    flow = fx.flow_split(t)
    cut = fx.full_days(fx.flow_sparse(t)).select(
        "city", (F.col("lo") + F.floor((F.col("hi") - F.col("lo") + 1) * fx.TRAIN_SHARE)).alias("_cut")
    )
    d = flow.join(cut, "city").withColumn("test_pos", F.col("step") - F.col("_cut"))
    return fc.ar1_rolling(d, ar1(t).drop("n"), "inflow", KEYS, "step")


@query("ar1_rolling", sql(["rolling"], f"SELECT grid_id, step, block, h, y, {rnd('y_hat', 'y_hat')} FROM rolling"))
def ar1_rolling(t: Tables) -> DataFrame:
    return rolling(t).select("grid_id", "step", "block", "h", "y", r(F.col("y_hat")).alias("y_hat"))


@query("diff_series", sql(["flow"], f"""
SELECT grid_id, step, {rnd('inflow - lag(inflow) OVER w', 'd1')}, {rnd('inflow - 2 * lag(inflow) OVER w + lag(inflow, 2) OVER w', 'd2')}
FROM flow WINDOW w AS (PARTITION BY grid_id ORDER BY step)"""))
def diff_series(t: Tables) -> DataFrame:
    d = series.differences(fx.flow(t), KEYS, "step", "inflow")
    return d.select("grid_id", "step", r(F.col("d1")).alias("d1"), r(F.col("d2")).alias("d2"))


cte("centred", "SELECT f.grid_id, step, inflow - m AS d, n FROM flow f JOIN (SELECT grid_id, avg(inflow) AS m, count(*) AS n FROM flow WHERE is_train GROUP BY 1) USING (grid_id) WHERE is_train", ["flow"])
cte("acf", """
SELECT a.grid_id, a.n, b.step - a.step AS lag, sum(a.d * b.d) / any_value(ss) AS acf FROM centred a JOIN centred b
  ON a.grid_id = b.grid_id AND b.step - a.step BETWEEN 1 AND 48 JOIN (SELECT grid_id, sum(d * d) AS ss FROM centred GROUP BY 1) s ON s.grid_id = a.grid_id GROUP BY ALL
""", ["centred"])


def acf(t: Tables, lags: int = 48) -> DataFrame:
    return fc.autocorrelation(fx.flow_split(t).where("is_train"), "inflow", KEYS, "step", lags)


@query("acf", sql(["acf"], f"SELECT grid_id, lag, {rnd('acf', 'acf')} FROM acf"))
def acf_query(t: Tables) -> DataFrame:
    return acf(t).select("grid_id", "lag", r(F.col("acf")).alias("acf"))


cte("resid", "SELECT grid_id, step, inflow - (c + phi * prev) AS e FROM lagged JOIN ar1 USING (grid_id) WHERE is_train AND prev IS NOT NULL", ["lagged", "ar1"])
cte("resid_centred", "SELECT r.grid_id, step, e - m AS d, n FROM resid r JOIN (SELECT grid_id, avg(e) AS m, count(*) AS n FROM resid GROUP BY 1) USING (grid_id)", ["resid"])
cte("resid_acf", """
SELECT a.grid_id, a.n, b.step - a.step AS lag, sum(a.d * b.d) / any_value(ss) AS acf FROM resid_centred a JOIN resid_centred b
  ON a.grid_id = b.grid_id AND b.step - a.step BETWEEN 1 AND 10 JOIN (SELECT grid_id, sum(d * d) AS ss FROM resid_centred GROUP BY 1) s ON s.grid_id = a.grid_id GROUP BY ALL
""", ["resid_centred"])


@query("ljung_box", sql(["resid_acf"], f"""
SELECT grid_id, {rnd('q', 'q')}, {rnd(' + '.join(['exp(-q / 2)'] + [f'exp(-q / 2) * pow(q / 2, {i}) / {f}' for i, f in ((1, 1), (2, 2), (3, 6), (4, 24))]), 'p_value')}
FROM (SELECT grid_id, any_value(n) * (any_value(n) + 2) * sum(acf * acf / (n - lag)) AS q FROM resid_acf GROUP BY 1)"""))
def ljung_box(t: Tables) -> DataFrame:
    """Whether what the AR(1) model leaves over is white noise."""
    train = fx.flow_split(t).where("is_train")
    x = series.lagged(train.select(*KEYS, "step", "inflow"), KEYS, "step", {"prev": ("inflow", 1)}).where("prev IS NOT NULL")
    e = x.join(ar1(t).drop("n"), KEYS).select(*KEYS, "step", (F.col("inflow") - F.col("c") - F.col("phi") * F.col("prev")).alias("e"))
    d = fc.ljung_box(fc.autocorrelation(e, "e", KEYS, "step", 10), KEYS)
    return d.select("grid_id", r(F.col("q")).alias("q"), r(F.col("p_value")).alias("p_value"))


_T = lambda dy, lv: f"(regr_slope({dy}, {lv}) / sqrt((regr_syy({dy}, {lv}) - regr_slope({dy}, {lv}) * regr_sxy({dy}, {lv})) / (regr_count({dy}, {lv}) - 2) / regr_sxx({dy}, {lv})))"


@query("unit_root", sql(["flow"], f"""
SELECT grid_id, CASE WHEN t0 < -2.86 THEN 0 WHEN t1 < -2.86 THEN 1 ELSE 2 END AS d, {rnd('CASE WHEN t0 < -2.86 THEN t0 WHEN t1 < -2.86 THEN t1 ELSE t2 END', 'stat')} FROM (
  SELECT grid_id, {_T('l0 - l1', 'l1')} AS t0, {_T('l0 - 2 * l1 + l2', 'l1 - l2')} AS t1, {_T('l0 - 3 * l1 + 3 * l2 - l3', 'l1 - 2 * l2 + l3')} AS t2
  FROM (SELECT grid_id, inflow AS l0, lag(inflow) OVER w AS l1, lag(inflow, 2) OVER w AS l2, lag(inflow, 3) OVER w AS l3 FROM flow WHERE is_train
    WINDOW w AS (PARTITION BY grid_id ORDER BY step)) GROUP BY 1)"""))
def unit_root(t: Tables) -> DataFrame:
    d = fc.unit_root(fx.flow_split(t).where("is_train"), "inflow", KEYS, "step")
    return d.select("grid_id", "d", r(F.col("stat")).alias("stat"))


@view
def orders(t: Tables) -> DataFrame:
    return fc.ar_orders(fx.flow_split(t).where("is_train"), "inflow", KEYS, "step", 3)


# AR(0) and AR(1) on the rows with three lags have closed forms
@query("ar_aic", sql(["flow"], f"""
SELECT grid_id, {rnd('n * ln(greatest(syy, 1e-12::DOUBLE) / n) + 2', 'aic0')}, {rnd('n * ln(greatest(CASE WHEN sxx > 0 THEN syy - sxy * sxy / sxx ELSE syy END, 1e-12::DOUBLE) / n) + 4', 'aic1')} FROM (
  SELECT grid_id, regr_count(l0, l1) AS n, regr_syy(l0, l1) AS syy, regr_sxy(l0, l1) AS sxy, regr_sxx(l0, l1) AS sxx FROM (
    SELECT grid_id, inflow AS l0, lag(inflow) OVER w AS l1, lag(inflow, 3) OVER w AS l3 FROM flow WHERE is_train WINDOW w AS (PARTITION BY grid_id ORDER BY step))
  WHERE l3 IS NOT NULL GROUP BY 1)"""))
def ar_aic(t: Tables) -> DataFrame:
    pick = lambda p: r(F.max(F.when(F.col("p") == p, F.col("aic")))).alias(f"aic{p}")
    return orders(t).groupBy("grid_id").agg(pick(0), pick(1))


# AR(0..3) by sweeping one lag after the other out of the centred sums of products
_DOT = lambda a, b: f"covar_pop({a}, {b}) * count(*)"
_SWEEP = lambda ab, a, b, pivot: f"{ab} - CASE WHEN {pivot} > 1e-9 THEN {a} * {b} / {pivot} ELSE 0 END"
cte("ar_sums", f"""
SELECT grid_id, count(*) AS n, {', '.join(f"{_DOT(a, b)} AS s{a[1]}{b[1]}" for i, a in enumerate(("l0", "l1", "l2", "l3")) for b in ("l0", "l1", "l2", "l3")[i:])} FROM (
  SELECT grid_id, inflow AS l0, lag(inflow) OVER w AS l1, lag(inflow, 2) OVER w AS l2, lag(inflow, 3) OVER w AS l3 FROM flow WHERE is_train
  WINDOW w AS (PARTITION BY grid_id ORDER BY step)) WHERE l3 IS NOT NULL GROUP BY 1
""", ["flow"])
cte("ar_one", f"""
SELECT grid_id, n, s00, {', '.join(f"{_SWEEP(f's{a}{b}', f's{min(a, 1)}{max(a, 1)}', f's1{b}' if b else 's01', 's11')} AS t{a}{b}" for a, b in ((0, 0), (0, 2), (0, 3), (2, 2), (2, 3), (3, 3)))} FROM ar_sums
""", ["ar_sums"])
cte("ar_two", f"""
SELECT grid_id, n, s00, t00, {_SWEEP('t00', 't02', 't02', 't22')} AS u00, {_SWEEP('t03', 't02', 't23', 't22')} AS u03, {_SWEEP('t33', 't23', 't23', 't22')} AS u33 FROM ar_one
""", ["ar_one"])
cte("ar_best", f"""
SELECT grid_id, p, aic FROM (SELECT grid_id, p, n * ln(greatest(rss, 1e-12::DOUBLE) / n) + 2 * (p + 1) AS aic FROM (
  SELECT grid_id, n, unnest([0, 1, 2, 3]) AS p, unnest([s00, t00, u00, {_SWEEP('u00', 'u03', 'u03', 'u33')}]) AS rss FROM ar_two))
QUALIFY row_number() OVER (PARTITION BY grid_id ORDER BY aic, p) = 1
""", ["ar_two"])


@query("order_selection", sql(["ar_best"], f"SELECT grid_id, p, {rnd('aic', 'aic')} FROM ar_best"))
def order_selection(t: Tables) -> DataFrame:
    return fc.select_order(orders(t), KEYS).select("grid_id", "p", r(F.col("aic")).alias("aic"))


@query("common_order", sql(["ar_best"], "SELECT p AS value, count(*) AS n FROM ar_best GROUP BY p ORDER BY n DESC, p LIMIT 1"))
def common_order(t: Tables) -> DataFrame:
    """Most common selected order over the cells (A-17)."""
    return fc.most_common(fc.select_order(orders(t), KEYS).select("p"), "p")


@view
def arma_fits(t: Tables) -> DataFrame:
    return arma.arma_orders(fx.flow_split(t).where("is_train"), "inflow", KEYS, "step")


@query("arma_order_selection")
def arma_order_selection(t: Tables) -> DataFrame:
    """(p, q) with the smallest AIC per cell."""
    return arma.select_arma(arma_fits(t), KEYS).select("grid_id", "p", "q", r(F.col("aic"), 4).alias("aic"))


@query("unit_root_lagged")
def unit_root_lagged(t: Tables) -> DataFrame:
    d = arma.unit_root_lagged(fx.flow_split(t).where("is_train"), "inflow", KEYS, "step")
    return d.select("grid_id", "d", r(F.col("stat"), 4).alias("stat"), "lags", "stationary")


def fourier(t: Tables) -> DataFrame:
    d = fx.flow_split(t)
    fit = fc.fourier_fit(d.where("is_train"), "inflow", KEYS, "step", fx.TZ)
    out = fc.fourier_predict(d.where("NOT is_train"), fit, KEYS, "step", fx.TZ)
    return out.withColumn("y", F.col("inflow"))


@query("fourier_regression")
def fourier_regression(t: Tables) -> DataFrame:
    return mt.masked_metrics(fourier(t), ["grid_id"]).select("grid_id", *metric_cols())


def samples(t: Tables, t_in: int = 12, t_out: int = 12) -> DataFrame:
    d = series.sliding_samples(fx.flow(t), KEYS, "step", ["inflow", "outflow"], "inflow", t_in, t_out)
    return fx.with_split(d, fx.flow_sparse(t))


def log_rows(t: Tables, model: str, d: DataFrame, t_in: int, tag: str) -> DataFrame:
    m = mt.horizon_metrics(d, ["city"], 12)
    config = F.to_json(F.struct(F.lit(t_in).alias("t_in"), F.lit(tag).alias("tag")))
    return m.select(
        F.lit(model).alias("model"), "city", F.lit(t_in).alias("t_in"), F.lit(12).alias("t_out"), F.lit(tag).alias("tag"),
        "horizon", "mae", "rmse", "mape", config.alias("config"),
    )


@query("pooled_regression")
def pooled_regression(t: Tables) -> DataFrame:
    d = pooled.fit_predict(samples(t), ["x_inflow", "x_outflow"], [1, 3, 6, 12], 12)
    return d.groupBy("h").agg(*[c.alias(n) for n, c in mt._metric_columns(F.abs("y") > 0, F.col("y"), F.col("y_hat"), 1.0).items()])


@query("pooled_trees")
def pooled_trees(t: Tables) -> DataFrame:
    """Mean absolute error per horizon of boosted trees beside that of the linear model (FC-05)."""
    d = cut_lineage(samples(t))
    inputs, horizons = ["x_inflow", "x_outflow"], [1, 3, 6, 12]
    linear = pooled.fit_predict(d, inputs, horizons, 12).withColumn("model", F.lit("linear"))
    both = linear.unionByName(pooled.fit_predict_trees(d, inputs, horizons, rounds=5, step=0.5).withColumn("model", F.lit("trees")))
    mae = lambda m: F.avg(F.when((F.col("model") == m) & (F.abs("y") > 0), F.abs(F.col("y_hat") - F.col("y")))).alias(f"mae_{m}")
    return both.groupBy("h").agg(mae("linear"), mae("trees"), F.count_if(F.col("model") == "trees").alias("n"))


@query("pooled_graph_regression")
def pooled_graph_regression(t: Tables) -> DataFrame:
    """Pooled regression with the neighbour-diffused history as a further input (FC-06)."""
    from flowspark.operators import graphs as gp
    from flowspark.plans.q_graphs import occupied

    cells = occupied(t)
    e = gp.sym_normalised(gp.with_self_loops(gp.spatial_graph(cells, G), cells))
    flow = fx.flow(t)
    near = gp.propagate(flow, e, ["inflow"]).withColumnRenamed("inflow", "near")
    d = series.sliding_samples(flow.join(near, ["step", "grid_id"]), KEYS, "step", ["inflow", "near"], "inflow", 12, 12)
    d = pooled.fit_predict(fx.with_split(d, fx.flow_sparse(t)), ["x_inflow", "x_near"], [1, 3, 6, 12], 12)
    return d.groupBy("h").agg(*[c.alias(n) for n, c in mt._metric_columns(F.abs("y") > 0, F.col("y"), F.col("y_hat"), 1.0).items()])


@query("history_length_sweep")
def history_length_sweep(t: Tables, lengths: tuple[int, ...] = (48, 336, 672)) -> DataFrame:
    """One pooled model per history length, scored at the first step (FC-07). A length of 1440
    steps needs a table of more than its one month."""
    out = None
    for t_in in lengths:
        d = pooled.fit_predict(samples(t, t_in, 1), ["x_inflow"], [1], t_in).withColumn("city", F.lit("bj"))
        m = mt.masked_metrics(d, ["city"]).select(F.lit(t_in).alias("t_in"), "mae", "rmse", "mape")
        out = m if out is None else out.unionByName(m)
    return out


def flow_nyc(t: Tables) -> DataFrame:
    """Second city from the same events: 15 x 5 cells by event id, all types as inflow."""
    ev = t.events.select(
        F.lit("nyc").alias("city"), (F.col("event_id") % 75).alias("grid_id"), fx.tm.step_of(F.col("ts")).alias("step"),
        F.col("value").alias("inflow"), F.lit(0.0).alias("outflow"),
    )
    sparse = cut_lineage(fx._sum_flow(ev))
    return fx.with_split(fx.dense_flow(sparse, 75), sparse)


@query("zero_shot_transfer")
def zero_shot_transfer(t: Tables) -> DataFrame:
    """Fit on one city, score another with the first city's statistics (FC-12)."""
    d = pooled.transfer(fx.flow_split(t).drop("slot"), fx.GRID.city, flow_nyc(t), KEYS, "step", "inflow", 12, [1, 3, 6, 12])
    return mt.masked_metrics(d, ["city", "h"]).select("city", "h", *metric_cols())


cte("metrics_log", "SELECT 'historical_average' AS model, * FROM (SELECT y, y_hat, h FROM preds) UNION ALL SELECT 'ar1', y, y_hat, h FROM rolling", ["preds", "rolling"])


def metrics_log(t: Tables) -> DataFrame:
    a = log_rows(t, "historical_average", predictions(t), 0, "base")
    return a.unionByName(log_rows(t, "ar1", rolling(t), 1, "base"))


@query("model_comparison", sql(["metrics_log"], f"""
SELECT model, {', '.join(rnd(f'avg(abs(y_hat - y)) FILTER (abs(y) > 0 AND h <= {k})', f'h{k}') for k in mt.HORIZONS)},
  {rnd('avg(abs(y_hat - y)) FILTER (abs(y) > 0)', 'avg')} FROM metrics_log GROUP BY 1"""))
def model_comparison(t: Tables) -> DataFrame:
    d = mt.model_comparison(metrics_log(t))
    return d.select("model", *[r(F.col(c)).alias(c) for c in d.columns if c != "model"])


@query("ablation_summary", sql(["metrics_log"], f"""
SELECT model, 'base' AS tag, CASE WHEN model = 'ar1' THEN 1 ELSE 0 END AS t_in, {metric_sql()} FROM metrics_log GROUP BY 1"""))
def ablation_summary(t: Tables) -> DataFrame:
    log = metrics_log(t).withColumn("t_logged", F.get_json_object("config", "$.t_in").cast("int"))
    d = mt.ablation_summary(log, "t_logged")
    return d.select("model", "tag", "t_in", *metric_cols())


@query("forecast_lookup", sql(["preds"], f"""
SELECT grid_id, step, {rnd('y_hat', 'y_hat')} FROM preds WHERE step BETWEEN (SELECT min(step) FROM preds) AND (SELECT min(step) FROM preds) + 11"""))
def forecast_lookup(t: Tables) -> DataFrame:
    """Twelve steps for every cell, unfolded from the lookup's map form."""
    d = pooled.lookup(predictions(t), "city", "step", "y_hat", horizon=12)
    out = d.select(F.explode("predictions").alias("grid_id", "values"))
    return out.select("grid_id", F.explode("values").alias("_p")).select("grid_id", "_p.step", r(F.col("_p.y_hat")).alias("y_hat"))


@query("feature_contributions")
def feature_contributions(t: Tables) -> DataFrame:
    """Linear contributions of the 41 cell features to the mean inflow, summed by group (A-32)."""
    from flowspark.operators import features as ft
    from flowspark.plans.q_features import node_features

    mean = fx.flow(t).groupBy(*KEYS).agg(F.avg("inflow").alias("target"))
    names = [c for c in ft.NODE_FEATURES if c != "hist_mean"]
    d = pooled.linear_contributions(node_features(t).join(mean, KEYS), names, "target")
    return ft.group_contributions(d, ["grid_id"], names, ft.FEATURE_GROUP)
