"""Structured Streaming jobs (ST-01..ST-05). Each takes a stream and returns a stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from flowspark import schemas
from flowspark.functions import time as tm
from flowspark.functions.geo import GridSpec
from flowspark.operators import anomaly as an
from flowspark.operators import components as cc
from flowspark.session import fresh_dir

DELAY = "1 hour"
WINDOW = "30 minutes"


def read_events(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """Event files as a stream; the event time is an instant, as watermarks need it."""
    r = spark.readStream.schema(schemas.EVENTS).option("pathGlobFilter", "events*.parquet")
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def dedup(events: DataFrame, key: list[str], delay: str = DELAY) -> DataFrame:
    """Drop repeats that arrive within the watermark (ST-02)."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(key)


def tumbling_flow(events: DataFrame, cell, inflow, outflow, delay: str = DELAY) -> DataFrame:
    """Half-hour inflow and outflow per cell, emitted once the window is closed (ST-01)."""
    return (
        events.withWatermark("ts", delay)
        .groupBy(F.window("ts", WINDOW), cell.alias("grid_id"))
        .agg(F.round(F.sum(inflow), 2).alias("inflow"), F.round(F.sum(outflow), 2).alias("outflow"))
    )


def with_step(flow: DataFrame, tz_hours: int) -> DataFrame:
    step = tm.step_of(F.col("window.start"))
    return flow.withColumns({"step": step, "slot": tm.slot_of(step, tz_hours)})


def live_zscore(flow: DataFrame, baseline: DataFrame, tz_hours: int) -> DataFrame:
    """Closed windows against the static slot baseline (ST-03)."""
    d = with_step(flow, tz_hours).join(baseline, ["grid_id", "slot"])
    return d.withColumn("z", F.round((F.col("inflow") - F.col("mu")) / F.col("sigma"), 9))


def live_levels(scored: DataFrame, levels: list[an.Level]) -> DataFrame:
    """Alert level per closed step: a second windowed aggregate on the first (ST-04)."""
    thresholds = sorted({lv.z for lv in levels})
    d = scored.groupBy(F.window(F.window_time("window"), WINDOW).alias("w")).agg(
        *[an.over(F.col("z"), t).alias(an.count_name(t)) for t in thresholds]
    )
    return d.select(tm.step_of(F.col("w.start")).alias("step"), an.level_by_count(levels).alias("level"))


STEP_MS = 30 * 60 * 1000


class Runs(StatefulProcessor):
    """The unbroken run of flagged steps that a cell is in: first and last step.

    A timer closes the run once the window after its last step has passed without the cell, and
    clears the state, so that only cells in a run have any. ``growing`` emits the length at every
    step, else a run is emitted once, when it is closed.
    """

    def __init__(self, growing: bool):
        self.growing = growing

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "first long, last long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # one row per half-hour window of one cell; a batch holds the windows closed since the last
        steps = sorted(int(s) for pdf in rows for s in pdf["step"])
        known = self.run.get() if self.run.exists() else None
        first, last = known or (steps[0], steps[0] - 1)
        out = []
        for s in steps:
            if s != last + 1:
                out.append((first, last))
                first = s
            last = s
            if self.growing:
                out.append((first, last))
        if known:
            self.handle.deleteTimer(self.closes(known[1]))
        self.handle.registerTimer(self.closes(last))
        self.run.update((first, last))
        yield self.told(key, [r for r in dict.fromkeys(out)])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        first, last = self.run.get()
        self.run.clear()
        yield self.told(key, [] if self.growing else [(first, last)])

    @staticmethod
    def closes(last: int) -> int:
        """When the window after the last step has ended."""
        return (last + 2) * STEP_MS

    @staticmethod
    def told(key, runs: list[tuple[int, int]]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], a, b, b - a + 1) for a, b in runs], columns=["grid_id", "run_start", "run_end", "duration_steps"])

    def close(self) -> None:
        pass


def _runs(flagged: DataFrame, growing: bool) -> DataFrame:
    d = flagged.select("grid_id", "step", F.window_time("window").alias("at")).groupBy("grid_id")
    kind = "grid_id long, run_start long, run_end long, duration_steps long"
    return d.transformWithStateInPandas(Runs(growing), kind, "append", "EventTime")


def persistence(flagged: DataFrame) -> DataFrame:
    """Running length of each cell's flagged run, kept in state while it lasts (ST-05)."""
    return _runs(flagged, True).select("grid_id", F.col("run_end").alias("step"), "duration_steps")


def closed_runs(flagged: DataFrame, min_length: int = 1) -> DataFrame:
    """Each flagged run once, when it is over (ST-05)."""
    return _runs(flagged, False).where(F.col("duration_steps") >= min_length)


def live_clusters(hot: DataFrame, by: list[str], g: GridSpec, levels: list[an.Level]) -> DataFrame:
    """Alert level per step from the clusters of flagged cells (AN-05) in one micro-batch (ST-04).

    A closed window comes with all its cells in one micro-batch, so its clusters are whole there.
    """
    clusters = cc.cluster_summary(cc.label_components(hot, by, g), by, g)
    return an.cluster_levels(clusters, by, levels)


def commit_batches(stream: DataFrame, folder: str, job: Callable[[DataFrame], DataFrame], schema: str) -> DataFrame:
    """Run the stream over what is there and give each micro-batch to ``job``; all results so far.

    A micro-batch's rows lie under its own number and are replaced when it is run again, so each
    counts once, also after a loss or a restart from the folder's checkpoint.
    """
    spark = stream.sparkSession

    def commit(batch: DataFrame, number: int) -> None:
        job(batch).write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{folder}/out/batch=-1")
    writer = stream.writeStream.option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True)
    writer.foreachBatch(commit).start().awaitTermination()
    return spark.read.schema(f"{schema}, batch long").parquet(f"{folder}/out").drop("batch")


def run_available(stream: DataFrame, name: str) -> DataFrame:
    """Run the stream over what is there, into a Parquet table in the shared folder."""
    spark = stream.sparkSession
    base = fresh_dir(spark, name)
    q = (
        stream.writeStream.format("parquet")
        .option("path", f"{base}/out")
        .option("checkpointLocation", f"{base}/checkpoint")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")
