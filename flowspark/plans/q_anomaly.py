"""Anomaly queries: clusters, levels, labels, evaluation, history and context."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowspark.functions import time as tm
from flowspark.functions.num import rnd as r
from flowspark.operators import anomaly as an
from flowspark.operators import baseline as bl
from flowspark.operators import components as cc
from flowspark.operators import forecast as fc
from flowspark.operators import series
from flowspark.operators.quantiles import exact_quantiles
from flowspark.operators import weather as wx
from flowspark.plans import fixtures as fx
from flowspark.plans.oracle import cte, rnd, sql
from flowspark.plans.registry import query
from flowspark.plans.q_clean import merged_weather, weather_steps
from flowspark.plans.q_core import LEVELS, count_alerts, scored
from flowspark.plans.q_features import parking
from flowspark.session import cut_lineage
from flowspark.sources.tables import Tables, view

G, KEYS = fx.GRID, fx.KEYS
Z_CLUSTER = 2.0
BY = ["city", "step"]

cte("hot", 'SELECT grid_id, step, z, grid_id // 8 AS "row", grid_id % 8 AS col FROM scored WHERE z > 2', ["scored"])
cte("reach", """
SELECT step, grid_id AS a, grid_id AS b FROM hot
UNION SELECT r.step, r.a, h.grid_id FROM reach r JOIN hot h ON h.step = r.step
  AND abs(h."row" - r.b // 8) <= 1 AND abs(h.col - r.b % 8) <= 1
""", ["hot"])
cte("labelled", """
SELECT h.*, label FROM hot h JOIN (SELECT step, a AS grid_id, min(b) AS label FROM reach GROUP BY ALL) USING (step, grid_id)
""", ["hot", "reach"])
cte("clusters", """
SELECT step, label, count(*) AS cell_count, max(z) AS max_z, avg("row") AS centroid_row, avg(col) AS centroid_col,
  min("row") AS row_min, max("row") AS row_max, min(col) AS col_min, max(col) AS col_max
FROM labelled GROUP BY ALL HAVING count(*) >= 2
""", ["labelled"])


@view
def labelled(t: Tables) -> DataFrame:
    hot = scored(t).where(F.col("z") > Z_CLUSTER).select(*BY, "grid_id", "z")
    return cc.label_components(hot, BY, G)


@view
def clusters(t: Tables) -> DataFrame:
    """Written once: levels, runs and largest clusters read it."""
    return cut_lineage(cc.cluster_summary(labelled(t), BY, G))


@query("anomaly_components", sql(["labelled"], f"SELECT step, grid_id, label, {rnd('z', 'z')} FROM labelled"))
def anomaly_components(t: Tables) -> DataFrame:
    return labelled(t).select("step", "grid_id", "label", r(F.col("z")).alias("z"))


@query("anomaly_components_tiled", sql(["labelled"], "SELECT step, grid_id, label FROM labelled"))
def anomaly_components_tiled(t: Tables) -> DataFrame:
    """Same labels with tiles smaller than the grid: exercises the merge across tiles."""
    hot = scored(t).where(F.col("z") > Z_CLUSTER).select(*BY, "grid_id")
    return cc.label_components(hot, BY, G, tile=3).select("step", "grid_id", "label")


_BOX = {"center_lon": "116.25::DOUBLE + (centroid_col + 0.5::DOUBLE) * 0.0625::DOUBLE", "center_lat": "40.25::DOUBLE - (centroid_row + 0.5::DOUBLE) * 0.0625::DOUBLE",
        "lon_min": "116.25::DOUBLE + col_min * 0.0625::DOUBLE", "lon_max": "116.25::DOUBLE + (col_max + 1) * 0.0625::DOUBLE",
        "lat_min": "40.25::DOUBLE - (row_max + 1) * 0.0625::DOUBLE", "lat_max": "40.25::DOUBLE - row_min * 0.0625::DOUBLE"}


@query("cluster_summary", sql(["clusters"], f"""
SELECT step, label, cell_count, {', '.join(rnd(c, c) for c in ('max_z', 'centroid_row', 'centroid_col'))},
  {', '.join(rnd(e, c) for c, e in _BOX.items())} FROM clusters"""))
def cluster_summary(t: Tables) -> DataFrame:
    return clusters(t).select("step", "label", "cell_count", *[r(F.col(c)).alias(c) for c in ("max_z", "centroid_row", "centroid_col", *_BOX)])


cte("cluster_levels", """
SELECT step, clustered_cells, n_clusters, max_z, CASE WHEN clustered_cells >= 5 AND max_z > 4 THEN 4 WHEN clustered_cells >= 3 AND max_z > 3.5 THEN 3
  WHEN clustered_cells >= 3 THEN 2 WHEN clustered_cells >= 2 THEN 1 ELSE 0 END AS level
FROM (SELECT step, CAST(sum(cell_count) AS BIGINT) AS clustered_cells, count(*) AS n_clusters, max(max_z) AS max_z FROM clusters GROUP BY 1)
""", ["clusters"])


@view
def cluster_alerts(t: Tables) -> DataFrame:
    return an.cluster_levels(clusters(t), BY, LEVELS)


@query("alert_levels_cluster", sql(["cluster_levels"], f"SELECT step, clustered_cells, n_clusters, {rnd('max_z', 'max_z')}, level FROM cluster_levels"))
def alert_levels_cluster(t: Tables) -> DataFrame:
    return cluster_alerts(t).select("step", "clustered_cells", "n_clusters", r(F.col("max_z")).alias("max_z"), "level")


@query("alert_levels_count", sql(["count_alerts"], "SELECT step, level FROM count_alerts WHERE level > 0"))
def alert_levels_count(t: Tables) -> DataFrame:
    return count_alerts(t).where("level > 0").select("step", "level")


@query("anomaly_type", sql(["clusters"], f"""
SELECT step, n_clusters, largest, {rnd('aspect', 'aspect')}, CASE WHEN n_clusters = 1 AND largest > 3 THEN 'mass_gathering'
  WHEN aspect > 1.5 THEN 'traffic_jam' ELSE 'sudden_incident' END AS type FROM (
  SELECT step, count(*) AS n_clusters, max(cell_count) AS largest,
    max(greatest(row_max - row_min + 1, col_max - col_min + 1) / least(row_max - row_min + 1, col_max - col_min + 1)) AS aspect
  FROM clusters GROUP BY 1)"""))
def anomaly_type(t: Tables) -> DataFrame:
    d = an.anomaly_type(clusters(t), BY, gathering_cells=3, jam_aspect=1.5)
    return d.select("step", "n_clusters", "largest", r(F.col("aspect")).alias("aspect"), "type")


# ---- labels -----------------------------------------------------------------------------

_PAD = {"exact": 0, "padded": 2}


def _near_sql(pad: int) -> str:
    days = ", ".join(f"'{d}'" for d in an.MAJOR_DAYS)
    tests = [f"strftime(CAST(make_timestamp((step + 16) * 1800000000) AS DATE) + {k}, '%m%d') IN ({days})" for k in range(-pad, pad + 1)]
    return "(" + " OR ".join(tests) + ")"


cte("label_counts", """
SELECT step, count(*) FILTER (z > 3) AS n_a, count(*) FILTER (round((outflow - mu) / sigma, 9) > 2.5) AS n_b FROM scored GROUP BY 1
""", ["scored"])
cte("weak_labels", f"""
SELECT *, CASE WHEN n_a >= 2 THEN 1 ELSE 0 END AS label_a, CASE WHEN n_a >= 2 AND n_b >= 2 THEN 1 ELSE 0 END AS label_b,
  CASE WHEN n_a >= 2 AND {_near_sql(2)} THEN 2 WHEN n_a >= 2 THEN 1 ELSE 0 END AS label_c, CASE WHEN {_near_sql(2)} THEN 1 ELSE 0 END AS is_major_day
FROM label_counts
""", ["label_counts"])


def weak_labels(t: Tables, pad_days: int = 2) -> DataFrame:
    d = scored(t).withColumn("z_out", F.round((F.col("outflow") - F.col("mu")) / F.col("sigma"), 9))
    return an.weak_labels(d, BY, tm.local_date(F.col("step"), fx.TZ), cells_a=2, cells_b=2, pad_days=pad_days)


@query("weak_label_a", sql(["weak_labels"], "SELECT step, n_a, label_a FROM weak_labels"))
def weak_label_a(t: Tables) -> DataFrame:
    return weak_labels(t).select("step", "n_a", "label_a")


@query("weak_label_b", sql(["weak_labels"], "SELECT step, n_b, label_b FROM weak_labels"))
def weak_label_b(t: Tables) -> DataFrame:
    return weak_labels(t).select("step", "n_b", "label_b")


@query("weak_label_c", sql(["label_counts"], f"""
SELECT step, CASE WHEN n_a >= 2 AND {_near_sql(0)} THEN 2 WHEN n_a >= 2 THEN 1 ELSE 0 END AS label_c,
  CASE WHEN n_a >= 2 AND {_near_sql(2)} THEN 2 WHEN n_a >= 2 THEN 1 ELSE 0 END AS label_c_padded FROM label_counts"""))
def weak_label_c(t: Tables) -> DataFrame:
    exact, padded = (weak_labels(t, pad).select("step", F.col("label_c").alias(n)) for pad, n in ((0, "label_c"), (2, "label_c_padded")))
    return exact.join(padded, "step")


@query("label_balance", sql(["weak_labels"], f"""
SELECT {rnd('avg(label_a)', 'positive_rate')}, {rnd('(1 - avg(label_a)) / avg(label_a)', 'class_weight')},
  {rnd('avg(label_a) FILTER (is_major_day = 1)', 'holiday_recall')} FROM weak_labels"""))
def label_balance(t: Tables) -> DataFrame:
    d = an.label_balance(weak_labels(t), "label_a")
    return d.select(*[r(F.col(c)).alias(c) for c in d.columns])


@query("label_consistency", sql(["weak_labels"], f"""
SELECT count(*) FILTER (label_a = 1) AS n_positive, count(*) FILTER (label_a = 1 AND prev = 1) AS n_consecutive,
  {rnd('count(*) FILTER (label_a = 1 AND prev = 1) / greatest(count(*) FILTER (label_a = 1), 1)', 'share')}
FROM (SELECT *, lag(label_a) OVER (ORDER BY step) AS prev FROM weak_labels)"""))
def label_consistency(t: Tables) -> DataFrame:
    d = an.consecutive_share(weak_labels(t), "label_a", ["city"], "step")
    return d.select("n_positive", "n_consecutive", r(F.col("share")).alias("share"))


@query("oversample_positives", sql(["weak_labels"], """
SELECT step, label_a, unnest(range(1, CASE WHEN label_a = 1 THEN 26 ELSE 2 END)) AS copy FROM weak_labels"""))
def oversample_positives(t: Tables) -> DataFrame:
    return an.oversample(weak_labels(t).select("step", "label_a"), "label_a", 25)


# ---- persistence and rates --------------------------------------------------------------

cte("cell_runs", """
SELECT grid_id, min(step) AS run_start, max(step) AS run_end, count(*) AS duration_steps FROM (
  SELECT grid_id, step, step - row_number() OVER (PARTITION BY grid_id ORDER BY step) AS island FROM scored WHERE z > 1)
GROUP BY grid_id, island HAVING count(*) >= 2
""", ["scored"])


@query("persistence_runs", sql(["cell_runs"], "SELECT * FROM cell_runs"))
def persistence_runs(t: Tables) -> DataFrame:
    hot = scored(t).where("z > 1").select(*KEYS, "step")
    return series.runs(hot, KEYS, "step", min_length=2).drop("city")


@query("trigger_rates", sql(["scored"], " UNION ALL ".join(
    f"SELECT {t}::DOUBLE AS threshold, {rnd(f'avg(CASE WHEN z > {t} THEN 1 ELSE 0 END)', 'rate')} FROM scored" for t in an.TRIGGER_THRESHOLDS)))
def trigger_rates(t: Tables) -> DataFrame:
    d = an.trigger_rates(scored(t), an.TRIGGER_THRESHOLDS)
    return d.select("threshold", r(F.col("rate")).alias("rate"))


cte("park_cut", "SELECT quantile_cont(parking_density, 0.75::DOUBLE) AS cut FROM parking", ["parking"])


@query("stratified_thresholds", sql(["scored", "parking", "park_cut"], """
SELECT step, count(*) FILTER (z > CASE WHEN parking_density > cut THEN 3.5 ELSE 3.0 END) AS n_l2,
  count(*) FILTER (z > CASE WHEN parking_density > cut THEN 4.0 ELSE 3.5 END) AS n_l3
FROM scored JOIN parking USING (grid_id), park_cut GROUP BY 1"""))
def stratified_thresholds(t: Tables) -> DataFrame:
    park = parking(t).select(F.lit("bj").alias("city"), "grid_id", "parking_density")
    cut = exact_quantiles(park, ["city"], "parking_density", {"cut": 0.75})
    cells = park.join(cut, "city").select(*KEYS, (F.col("parking_density") > F.col("cut")).alias("high"))
    d = scored(t).join(cells, KEYS)
    over = lambda hi, lo: F.count_if(F.col("z") > F.when(F.col("high"), hi).otherwise(lo))
    return d.groupBy("step").agg(over(3.5, 3.0).alias("n_l2"), over(4.0, 3.5).alias("n_l3"))


# ---- detectors --------------------------------------------------------------------------

cte("iqr", """
SELECT grid_id, avg(inflow) AS m, stddev_pop(inflow) AS s, quantile_cont(inflow, 0.25::DOUBLE) AS q1, quantile_cont(inflow, 0.75::DOUBLE) AS q3
FROM sparse GROUP BY 1""", ["sparse"])


@query("iqr_detector", sql(["sparse", "iqr"], f"""
SELECT grid_id, {rnd('any_value(q1)', 'q1')}, {rnd('any_value(q3)', 'q3')},
  count(*) FILTER (inflow > q3 + 1.5 * (q3 - q1) OR inflow < q1 - 1.5 * (q3 - q1)) AS n_iqr,
  count(*) FILTER (round(abs(inflow - m) / s, 9) > 3) AS n_sigma FROM sparse JOIN iqr USING (grid_id) GROUP BY 1"""))
def iqr_detector(t: Tables) -> DataFrame:
    d = fx.flow_sparse(t)
    q = exact_quantiles(d, KEYS, "inflow", {"q1": 0.25, "q3": 0.75})
    m = d.groupBy(*KEYS).agg(F.avg("inflow").alias("m"), F.stddev_pop("inflow").alias("s"))
    x, q1, q3 = F.col("inflow"), F.col("q1"), F.col("q3")
    j = d.join(q.join(m, KEYS), KEYS)
    wide = 1.5 * (q3 - q1)
    return j.groupBy("grid_id").agg(
        r(F.first(q1)).alias("q1"), r(F.first(q3)).alias("q3"),
        F.count_if((x > q3 + wide) | (x < q1 - wide)).alias("n_iqr"),
        F.count_if(F.round(F.abs(x - F.col("m")) / F.col("s"), 9) > 3).alias("n_sigma"),
    )


_DET = {"count_l1": "level >= 1", "count_l2": "level >= 2", "z2_any": "n_z2 >= 2", "z4_any": "n_z4 >= 1"}
_SCORE = {"precision": "CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END", "recall": "CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END",
          "f1": "CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END", "fpr": "CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0 END"}


def _eval_sql(detectors: dict[str, str], source: str, truth: str) -> str:
    parts = " UNION ALL ".join(
        f"SELECT '{n}' AS detector, count(*) FILTER ({p} AND {truth}) AS tp, count(*) FILTER ({p} AND NOT {truth}) AS fp, "
        f"count(*) FILTER (NOT ({p}) AND {truth}) AS fn, count(*) FILTER (NOT ({p}) AND NOT {truth}) AS tn FROM {source}" for n, p in detectors.items())
    return f"SELECT *, {', '.join(rnd(e, c) for c, e in _SCORE.items())} FROM ({parts})"


def _scores(d: DataFrame) -> DataFrame:
    return d.select("detector", "tp", "fp", "fn", "tn", *[r(F.col(c)).alias(c) for c in _SCORE])


cte("judged", "SELECT * FROM count_alerts JOIN weak_labels USING (step)", ["count_alerts", "weak_labels"])


@view
def judged(t: Tables) -> DataFrame:
    return count_alerts(t).join(weak_labels(t), BY)


@query("detector_eval", sql(["judged"], _eval_sql(_DET, "judged", "(label_b = 1)")))
def detector_eval(t: Tables) -> DataFrame:
    return _scores(an.evaluate(judged(t), {n: F.expr(p) for n, p in _DET.items()}, F.col("label_b") == 1))


cte("vote", """
SELECT s.step, s.grid_id, (CASE WHEN s.z > 3 THEN 0.5 ELSE 0 END) + (CASE WHEN round((ln(1 + inflow) - l.mu) / l.sigma, 9) > 3 THEN 0.3 ELSE 0 END)
  + (CASE WHEN round(abs(inflow - g.m) / g.s, 9) > 3 THEN 0.2 ELSE 0 END) AS vote, round((outflow - s.mu) / s.sigma, 9) > 2 AS truth
FROM scored s JOIN log_base l USING (grid_id, slot), (SELECT avg(inflow) AS m, stddev_pop(inflow) AS s FROM flow WHERE is_train) g
""", ["scored", "log_base", "flow"])
_SWEEP = [0.1, 0.25, 0.4, 0.6, 0.75, 0.9]


@view
def votes(t: Tables) -> DataFrame:
    """Weighted vote of slot z, log slot z and global three-sigma per cell-step."""
    d = scored(t).withColumn("_t", F.round((F.col("outflow") - F.col("mu")) / F.col("sigma"), 9) > 2)
    d = bl.slot_zscore(d.drop("mu", "sigma"), F.log1p("inflow"), KEYS, floor=0.1, name="z_log")
    g = fx.flow_split(t).where("is_train").groupBy("city").agg(F.avg("inflow").alias("m"), F.stddev_pop("inflow").alias("s"))
    d = d.join(g, "city")
    part = lambda flag, w: F.when(flag, w).otherwise(0.0)
    sigma3 = F.round(F.abs(F.col("inflow") - F.col("m")) / F.col("s"), 9) > 3
    vote = part(F.col("z") > 3, 0.5) + part(F.col("z_log") > 3, 0.3) + part(sigma3, 0.2)
    return d.select("grid_id", "step", vote.alias("vote"), F.col("_t").alias("truth"))


@query("threshold_sweep", sql(["vote"], _eval_sql({f"vote_{s * 100:.0f}": f"vote > {s}" for s in _SWEEP}, "vote", "truth")))
def threshold_sweep(t: Tables) -> DataFrame:
    return _scores(an.evaluate(votes(t), {f"vote_{s * 100:.0f}": F.col("vote") > s for s in _SWEEP}, F.col("truth")))


@query("best_threshold", sql(["vote"], f"""
SELECT {rnd('f1', 'f1')}, detector FROM ({_eval_sql({f"vote_{s * 100:.0f}": f"vote > {s}" for s in _SWEEP}, "vote", "truth")}) ORDER BY f1 DESC, detector DESC LIMIT 1"""))
def best_threshold(t: Tables) -> DataFrame:
    d = an.best_threshold(threshold_sweep(t))
    return d.select(r(F.col("f1")).alias("f1"), "detector")


cte("resid", """
SELECT grid_id, step, slot, is_train, inflow - (c + phi * prev) AS e FROM (
  SELECT *, lag(inflow) OVER (PARTITION BY grid_id ORDER BY step) AS prev FROM flow) JOIN ar1 USING (grid_id) WHERE prev IS NOT NULL
""", ["flow", "ar1"])
cte("resid_base", "SELECT grid_id, slot, avg(e) AS mu, greatest(stddev_pop(e), 1.0) AS sigma FROM resid WHERE is_train GROUP BY ALL", ["resid"])


@query("residual_detector", sql(["resid", "resid_base"], f"""
SELECT grid_id, step, {rnd('round((e - mu) / sigma, 9)', 'z')} FROM resid JOIN resid_base USING (grid_id, slot) WHERE NOT is_train AND round((e - mu) / sigma, 9) > 3"""))
def residual_detector(t: Tables) -> DataFrame:
    flow = fx.flow_split(t)
    fit = fc.ar1_fit(flow.where("is_train"), "inflow", KEYS, "step")
    d = series.lagged(flow, KEYS, "step", {"prev": ("inflow", 1)}).where("prev IS NOT NULL")
    d = d.join(fit, KEYS).withColumn("e", F.col("inflow") - (F.col("c") + F.col("phi") * F.col("prev")))
    z = bl.slot_zscore(d.drop("n"), F.col("e"), KEYS)
    return z.where("NOT is_train AND z > 3").select("grid_id", "step", r(F.col("z")).alias("z"))


# ---- history, context, samples ----------------------------------------------------------


@query("daily_alert_counts", sql(["count_alerts"], """
SELECT strftime(make_timestamp((step + 16) * 1800000000), '%Y-%m-%d') AS day, level, count(*) AS n FROM count_alerts WHERE level > 0 GROUP BY ALL"""))
def daily_alert_counts(t: Tables) -> DataFrame:
    day = F.date_format(tm.local_date(F.col("step"), fx.TZ), "yyyy-MM-dd")
    return count_alerts(t).where("level > 0").groupBy(day.alias("day"), "level").agg(F.count("*").alias("n"))


@query("top_cells", sql(["scored"], f"""
SELECT step, grid_id, rank, {rnd('z', 'z')}, inflow AS flow, {rnd('mu', 'expected')} FROM (
  SELECT *, row_number() OVER (PARTITION BY step ORDER BY z DESC, grid_id) AS rank FROM scored) WHERE rank <= 5"""))
def top_cells(t: Tables) -> DataFrame:
    d = an.top_cells(scored(t), BY, 5)
    return d.select("step", "grid_id", "rank", r(F.col("z")).alias("z"), F.col("inflow").alias("flow"), r(F.col("mu")).alias("expected"))


cte("hist_alerts", """
SELECT a.step, level, clustered_cells, run_start, duration_steps, b.centroid_row, b.centroid_col FROM cluster_levels a JOIN (
  SELECT step, min(step) OVER w AS run_start, count(*) OVER w AS duration_steps FROM (
    SELECT step, step - row_number() OVER (ORDER BY step) AS island FROM cluster_levels WHERE level >= 1) WINDOW w AS (PARTITION BY island)) USING (step)
JOIN (SELECT *, row_number() OVER (PARTITION BY step ORDER BY cell_count DESC, label) AS rn FROM clusters) b ON b.step = a.step AND rn = 1
""", ["cluster_levels", "clusters"])


@query("alert_history", sql(["hist_alerts", "merged_known"], f"""
SELECT h.step, level, clustered_cells, run_start, duration_steps, {rnd('116.25::DOUBLE + (centroid_col + 0.5::DOUBLE) * 0.0625::DOUBLE', 'center_lon')},
  {rnd('40.25::DOUBLE - (centroid_row + 0.5::DOUBLE) * 0.0625::DOUBLE', 'center_lat')}, {rnd('coalesce(pv_temp, nv_temp)', 'temp')}
FROM hist_alerts h LEFT JOIN merged_known w ON w.hour = h.step // 2
WHERE h.step BETWEEN epoch_us(TIMESTAMP '2024-01-03') // 1800000000 AND epoch_us(TIMESTAMP '2024-01-28') // 1800000000"""))
def alert_history(t: Tables) -> DataFrame:
    """Alerts of level 1 and up between two days, with run length, place and weather."""
    span = F.col("step").between(*[tm.step_of(F.to_timestamp(F.lit(d))) for d in ("2024-01-03", "2024-01-28")])
    c = clusters(t)
    alerts = an.cluster_levels(c, BY, LEVELS).where("level >= 1")
    runs = series.run_starts(alerts.select(*BY), ["city"], "step")
    length = runs.groupBy("city", "run_start").agg(F.count("*").alias("duration_steps"))
    largest = c.groupBy(*BY).agg(F.max_by(F.struct("center_lon", "center_lat"), F.struct("cell_count", -F.col("label"))).alias("_c"))
    d = alerts.join(runs, BY).join(length, ["city", "run_start"]).join(largest, BY).where(span)
    d = d.withColumn("hour", F.floor(F.col("step") / 2)).join(merged_weather(t), ["city", "hour"], "left")
    return d.select(
        "step", "level", "clustered_cells", "run_start", "duration_steps", r(F.col("_c.center_lon")).alias("center_lon"),
        r(F.col("_c.center_lat")).alias("center_lat"), r(F.col("temp")).alias("temp"),
    )


@query("alert_context", sql(["hot", "scored", "w_steps_known", "holidays"], f"""
SELECT h.step, h.grid_id, {rnd('s.inflow - s.mu', 'deviation')}, (SELECT count(*) FROM hot o WHERE o.step = h.step AND o.grid_id != h.grid_id
    AND abs(o."row" - h."row") <= 1 AND abs(o.col - h.col) <= 1) AS flagged_neighbours,
  CASE WHEN CAST(make_timestamp((h.step + 16) * 1800000000) AS DATE) IN (SELECT d FROM holidays) THEN 1 ELSE 0 END AS is_holiday,
  CASE WHEN pv_clouds_all >= 4 THEN 1 ELSE 0 END AS weather_extreme
FROM hot h JOIN scored s USING (step, grid_id) LEFT JOIN w_steps_known w USING (step)"""))
def alert_context(t: Tables) -> DataFrame:
    hot = scored(t).where(F.col("z") > Z_CLUSTER)
    around = an.flagged_neighbours(hot, BY, G)
    d = hot.join(around, [*BY, "grid_id"]).join(weather_steps(t), BY, "left")
    d = wx.mark_holidays(d, ["city"], fx.TZ, fx.holidays(t))
    return d.select(
        "step", "grid_id", r(F.col("inflow") - F.col("mu")).alias("deviation"), "flagged_neighbours",
        "is_holiday", F.when(F.col("clouds_all") >= 4, 1).otherwise(0).alias("weather_extreme"),
    )


@query("most_active_cells", sql(["cell_means"], f"SELECT grid_id, {rnd('m_in', 'mean')} FROM cell_means WHERE m_in > 0 ORDER BY m_in DESC, grid_id LIMIT 30"))
def most_active_cells(t: Tables) -> DataFrame:
    m = fx.flow(t).groupBy("grid_id").agg(F.avg("inflow").alias("mean")).where("mean > 0")
    return m.orderBy(F.col("mean").desc(), "grid_id").limit(30).select("grid_id", r(F.col("mean")).alias("mean"))


@query("first_active_cells", sql(["cell_means"], f"SELECT grid_id, {rnd('m_in', 'mean')} FROM cell_means WHERE m_in > 0 ORDER BY grid_id LIMIT 10"))
def first_active_cells(t: Tables) -> DataFrame:
    m = fx.flow(t).groupBy("grid_id").agg(F.avg("inflow").alias("mean")).where("mean > 0")
    return m.orderBy("grid_id").limit(10).select("grid_id", r(F.col("mean")).alias("mean"))


@query("stratified_sample", sql(["flow"], """
SELECT grid_id, step, stratum FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5('7-' || grid_id || '-' || step), grid_id, step) AS rn FROM (
  SELECT grid_id, step, CASE WHEN slot // 2 IN (7, 8) THEN 'peak' WHEN slot // 2 IN (18, 19, 20) THEN 'evening' WHEN inflow = 0 THEN 'low_flow' ELSE 'other' END AS stratum FROM flow))
WHERE rn <= 50"""))
def stratified_sample(t: Tables) -> DataFrame:
    """Fifty rows per stratum, chosen by a seeded hash of the key."""
    d = fx.flow(t).withColumn("hour", F.floor(tm.slot_of(F.col("step"), fx.TZ) / 2))
    stratum = (
        F.when(F.col("hour").isin(7, 8), "peak").when(F.col("hour").isin(18, 19, 20), "evening")
        .when(F.col("inflow") == 0, "low_flow").otherwise("other")
    )
    key = F.md5(F.concat_ws("-", F.lit("7"), F.col("grid_id"), F.col("step")).cast("binary"))
    w = Window.partitionBy("stratum").orderBy("_k", "grid_id", "step")
    d = d.select("grid_id", "step", stratum.alias("stratum"), key.alias("_k"))
    return d.withColumn("_rn", F.row_number().over(w)).where("_rn <= 50").drop("_rn", "_k")
