"""Streaming jobs run over the event files; the SQL is their batch result on closed windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.functions.num import rnd as r
from flowspark.operators import baseline as bl
from flowspark.plans import fixtures as fx
from flowspark.plans.oracle import cte, rnd, sql
from flowspark.plans.q_anomaly import Z_CLUSTER
from flowspark.plans.q_core import LEVELS
from flowspark.plans.registry import query
from flowspark.session import cut_lineage, fresh_dir
from flowspark.sources.tables import Tables
from flowspark.streaming import jobs

# windows that end before the newest event less the watermark delay
cte("closed", """
SELECT * FROM sparse WHERE (step + 1) * 1800000000 <= (SELECT max(epoch_us(ts)) FROM ev) - 3600000000
""", ["sparse", "ev"])
cte("live", "SELECT grid_id, step, z FROM closed JOIN (SELECT grid_id, step, z FROM scored) USING (grid_id, step)", ["closed", "scored"])


def live_flow(t: Tables) -> DataFrame:
    events = jobs.read_events(t.spark, t.folder)
    return jobs.tumbling_flow(events, F.col("user_id") % fx.N_CELLS, fx._amount(fx.IN_TYPES), fx._amount(fx.OUT_TYPES))


def live_scored(t: Tables) -> DataFrame:
    """The baseline is written before the stream starts, so that no micro-batch reads raw events."""
    base = bl.slot_baseline(fx.flow_split(t).where("is_train"), F.col("inflow"), ["grid_id"])
    return jobs.live_zscore(live_flow(t), cut_lineage(base), fx.TZ)


@query("stream_tumbling_flow", sql(["closed"], "SELECT grid_id, step, inflow, outflow FROM closed"))
def stream_tumbling_flow(t: Tables) -> DataFrame:
    d = jobs.with_step(live_flow(t), fx.TZ).select("grid_id", "step", "inflow", "outflow")
    return jobs.run_available(d, "tumbling-flow")


@query("stream_dedup", "SELECT event_id, event_type, value FROM events")
def stream_dedup(t: Tables) -> DataFrame:
    """Every event arrives twice and is kept once."""
    twice = jobs.read_events(t.spark, t.folder).union(jobs.read_events(t.spark, t.folder))
    return jobs.run_available(jobs.dedup(twice, ["event_id"]).select("event_id", "event_type", "value"), "dedup")


@query("stream_zscore", sql(["live"], f"SELECT grid_id, step, {rnd('z', 'z')} FROM live"))
def stream_zscore(t: Tables) -> DataFrame:
    d = jobs.run_available(live_scored(t).select("grid_id", "step", "z"), "zscore")
    return d.select("grid_id", "step", r(F.col("z")).alias("z"))


@query("stream_alert_level", sql(["live"], """
SELECT step, CASE WHEN count(*) FILTER (z > 4) >= 5 THEN 4 WHEN count(*) FILTER (z > 3.5) >= 3 THEN 3 WHEN count(*) FILTER (z > 3) >= 3 THEN 2
  WHEN count(*) FILTER (z > 3) >= 2 THEN 1 ELSE 0 END AS level FROM live GROUP BY 1"""))
def stream_alert_level(t: Tables) -> DataFrame:
    return jobs.run_available(jobs.live_levels(live_scored(t), LEVELS), "alert-level")


@query("stream_persistence", sql(["live"], """
SELECT grid_id, step, row_number() OVER (PARTITION BY grid_id, island ORDER BY step) AS duration_steps FROM (
  SELECT grid_id, step, step - row_number() OVER (PARTITION BY grid_id ORDER BY step) AS island FROM live WHERE z > 0)"""))
def stream_persistence(t: Tables) -> DataFrame:
    flagged = live_scored(t).where("z > 0")
    return jobs.run_available(jobs.persistence(flagged), "persistence")


# a run is over once the window after its last step has closed
@query("stream_runs", sql(["live"], """
SELECT * FROM (SELECT grid_id, min(step) AS run_start, max(step) AS run_end, count(*) AS duration_steps FROM (
    SELECT grid_id, step, step - row_number() OVER (PARTITION BY grid_id ORDER BY step) AS island FROM live WHERE z > 1) GROUP BY grid_id, island)
WHERE duration_steps >= 2 AND (run_end + 2) * 1800000000 <= (SELECT max(epoch_us(ts)) FROM events) - 3600000000"""))
def stream_runs(t: Tables) -> DataFrame:
    flagged = live_scored(t).where("z > 1")
    return jobs.run_available(jobs.closed_runs(flagged, 2), "runs")


@query("stream_cluster_level", sql(["cluster_levels"], f"""
SELECT step, clustered_cells, n_clusters, {rnd('max_z', 'max_z')}, level FROM cluster_levels
WHERE (step + 1) * 1800000000 <= (SELECT max(epoch_us(ts)) FROM events) - 3600000000"""))
def stream_cluster_level(t: Tables) -> DataFrame:
    hot = live_scored(t).where(F.col("z") > Z_CLUSTER).select("step", "grid_id", "z")
    job = lambda batch: jobs.live_clusters(batch, ["step"], fx.GRID, LEVELS)
    schema = "step long, clustered_cells long, n_clusters long, max_z double, level int"
    d = jobs.commit_batches(hot, fresh_dir(t.spark, "cluster-levels"), job, schema)
    return d.withColumn("max_z", r(F.col("max_z")))
