"""Flagship: slot z-scores and alert levels per step."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.operators import anomaly as an
from flowspark.operators import baseline as bl
from flowspark.plans import fixtures as fx
from flowspark.plans.oracle import cte, rnd, sql
from flowspark.plans.registry import query
from flowspark.sources.tables import Tables, view
from flowspark.functions.num import rnd as r

# The fixture grid has 64 cells, so the cell counts of the levels are scaled down.
LEVELS = [an.Level(1, 3.0, 2), an.Level(2, 3.0, 3), an.Level(3, 3.5, 3), an.Level(4, 4.0, 5)]


@view
def scored(t: Tables) -> DataFrame:
    return bl.slot_zscore(fx.flow_split(t), F.col("inflow"), fx.KEYS)


@view
def step_counts(t: Tables) -> DataFrame:
    return an.cells_over(scored(t), ["city", "step"], an.TRIGGER_THRESHOLDS)


@view
def count_alerts(t: Tables) -> DataFrame:
    return step_counts(t).withColumn("level", an.level_by_count(LEVELS))


cte("base", """
SELECT grid_id, slot, avg(inflow) AS mu, greatest(stddev_pop(inflow), 1.0) AS sigma, count(*) AS n
FROM flow WHERE is_train GROUP BY ALL
""", ["flow"])
cte("scored", """
SELECT f.*, mu, sigma, round((inflow - mu) / sigma, 9) AS z FROM flow f JOIN base USING (grid_id, slot)
""", ["flow", "base"])
cte("step_counts", """
SELECT step, count(*) FILTER (z > 2) AS n_z2, count(*) FILTER (z > 2.5) AS n_z2_5, count(*) FILTER (z > 3) AS n_z3,
  count(*) FILTER (z > 3.5) AS n_z3_5, count(*) FILTER (z > 4) AS n_z4 FROM scored GROUP BY step
""", ["scored"])
cte("count_alerts", """
SELECT *, CASE WHEN n_z4 >= 5 THEN 4 WHEN n_z3_5 >= 3 THEN 3 WHEN n_z3 >= 3 THEN 2 WHEN n_z3 >= 2 THEN 1 ELSE 0 END AS level
FROM step_counts
""", ["step_counts"])


@query("slot_zscore_levels", sql(["count_alerts"], "SELECT * FROM count_alerts"))
def slot_zscore_levels(t: Tables) -> DataFrame:
    return count_alerts(t).drop("city")


@query("slot_baseline", sql(["base"], f"SELECT grid_id, slot, {rnd('mu','mu')}, {rnd('sigma','sigma')} FROM base"))
def slot_baseline(t: Tables) -> DataFrame:
    b = bl.slot_baseline(fx.flow_split(t).where("is_train"), F.col("inflow"), fx.KEYS)
    return b.select("grid_id", "slot", r(F.col("mu")).alias("mu"), r(F.col("sigma")).alias("sigma"))


cte("log_base", """
SELECT grid_id, slot, avg(ln(1 + inflow)) AS mu, greatest(stddev_pop(ln(1 + inflow)), 0.1) AS sigma
FROM flow WHERE is_train GROUP BY ALL
""", ["flow"])


@query("log_zscore", sql(["log_base"], f"""
SELECT f.grid_id, f.step, {rnd('round((ln(1 + inflow) - mu) / sigma, 9)', 'z')}
FROM flow f JOIN log_base USING (grid_id, slot)"""))
def log_zscore(t: Tables) -> DataFrame:
    d = bl.slot_zscore(fx.flow_split(t), F.log1p("inflow"), fx.KEYS, floor=0.1)
    return d.select("grid_id", "step", r(F.col("z")).alias("z"))
