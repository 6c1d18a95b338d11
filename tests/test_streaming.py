import datetime as dt
import os
import shutil
import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from conftest import rows
from pyspark.sql import functions as F

from flowspark.functions.geo import GridSpec
from flowspark.operators import anomaly as an
from flowspark.streaming import jobs


def write_files(spark, batches):
    """One file per batch, in time order."""
    folder = tempfile.mkdtemp(prefix="flowspark-test-")
    schema = pa.schema(
        [("event_id", pa.int64()), ("ts", pa.timestamp("us")), ("user_id", pa.int64()), ("event_type", pa.string()), ("value", pa.float64()), ("props", pa.string())]
    )
    for i, b in enumerate(batches):
        data = [dict(zip(schema.names, (e, t, u, "view", v, None))) for e, t, u, v in b]
        path = f"{folder}/events{i}.parquet"
        pq.write_table(pa.Table.from_pylist(data, schema), path)
        os.utime(path, (1_700_000_000 + 60 * i,) * 2)
    return folder


def at(h, m):
    return dt.datetime(2024, 1, 1, h, m)


def flow(events):
    return jobs.tumbling_flow(events, F.col("user_id"), F.col("value"), F.lit(0.0), "30 minutes")


def test_late_rows_are_dropped_and_windows_emitted_once(spark):
    batches = [
        [(1, at(1, 5), 7, 1.0), (2, at(1, 20), 7, 2.0), (3, at(1, 40), 7, 4.0)],
        [(4, at(3, 0), 7, 8.0)],
        [(7, at(3, 5), 7, 1.0)],
        [(5, at(1, 10), 7, 100.0), (6, at(5, 0), 7, 1.0)],  # event 5 comes after its window was emitted
    ]
    events = jobs.read_events(spark, write_files(spark, batches), files_per_trigger=1)
    out = jobs.run_available(jobs.with_step(flow(events), 0).select("grid_id", "slot", "inflow"), "test-flow")
    assert rows(out) == [(7, 2, 3.0), (7, 3, 4.0), (7, 6, 9.0)]


def test_dedup_across_files(spark):
    batches = [[(1, at(1, 0), 7, 1.0), (1, at(1, 0), 7, 1.0)], [(1, at(1, 5), 7, 1.0), (2, at(1, 6), 7, 1.0)]]
    events = jobs.read_events(spark, write_files(spark, batches), files_per_trigger=1)
    out = jobs.run_available(jobs.dedup(events, ["event_id"]).select("event_id"), "test-dedup")
    assert rows(out) == [(1,), (2,)]


def test_run_length_state_spans_batches(spark):
    batches = [[(i * 10 + j, at(h, m), j, 1.0) for j in (1, 2)] for i, (h, m) in enumerate([(1, 0), (1, 30), (2, 0), (4, 0), (4, 30), (9, 0)])]
    events = jobs.read_events(spark, write_files(spark, batches), files_per_trigger=1)
    flagged = jobs.with_step(flow(events), 0).where("inflow > 0")
    out = jobs.run_available(jobs.persistence(flagged), "test-runs")
    assert rows(out.where("grid_id = 1").select("duration_steps")) == [(1,), (1,), (2,), (2,), (3,)]


STEPS = [(1, 0), (1, 30), (2, 0), (4, 0), (4, 30), (6, 0), (9, 0)]


def test_closed_runs_come_once_and_leave_no_state(spark):
    batches = [[(i * 10 + j, at(h, m), j, 1.0) for j in range(1, 6)] for i, (h, m) in enumerate(STEPS[:-1])] + [[(99, at(9, 0), 1, 1.0)]]
    folder = write_files(spark, batches)
    for files in (1, 100):
        flagged = jobs.with_step(flow(jobs.read_events(spark, folder, files_per_trigger=files)), 0).where("inflow > 0")
        base = tempfile.mkdtemp(prefix="flowspark-test-")
        runs = jobs.closed_runs(flagged)
        stream = runs.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
        stream.awaitTermination()
        first = 1704067200 // 1800  # 2024-01-01
        want = [(j, first + a, first + b, b - a + 1) for j in range(1, 6) for a, b in ((2, 4), (8, 9), (12, 12))]
        assert rows(spark.read.schema(runs.schema).parquet(f"{base}/out")) == want
        assert [op["numRowsTotal"] for op in stream.lastProgress["stateOperators"] if op["operatorName"] == "transformWithStateInPandasExec"] == [0]


GRID = GridSpec("t", 0, 1, 0, 1, 6, 6, 0)
LEVELS = [an.Level(1, 1.0, 2), an.Level(2, 1.0, 3), an.Level(3, 3.0, 4), an.Level(4, 4.0, 6)]
SCHEMA = "step long, clustered_cells long, n_clusters long, max_z double, level int"


def cluster_batches():
    rng = np.random.default_rng(3)
    out, n = [], 0
    for h, m in STEPS:
        cells = rng.choice(36, rng.integers(4, 20), replace=False).tolist()
        out.append([(n + i, at(h, m), c, float(rng.integers(1, 6))) for i, c in enumerate(cells)])
        n += 100
    return out


def levels_of(spark, batches):
    """The batch result on the windows that are closed."""
    last = max(t for b in batches for _, t, _, _ in b) - dt.timedelta(minutes=60)
    hot = [(int(t.replace(tzinfo=dt.UTC).timestamp()) // 1800, c, v) for b in batches for _, t, c, v in b if t <= last]
    df = spark.createDataFrame(hot, "step long, grid_id long, z double")
    return rows(jobs.live_clusters(df, ["step"], GRID, LEVELS))


def hot_stream(spark, folder):
    return jobs.with_step(flow(jobs.read_events(spark, folder, files_per_trigger=1)), 0).select("step", "grid_id", F.col("inflow").alias("z"))


def test_live_clusters_equal_the_batch_after_a_loss_and_a_restart(spark, tmp_path):
    batches = cluster_batches()
    folder, done = write_files(spark, batches[:4]), []

    def job(batch):
        out = jobs.live_clusters(batch, ["step"], GRID, LEVELS)
        if len(done) == 3:  # once, after rows of this micro-batch have been written
            done.append("lost")
            out.write.mode("overwrite").parquet(f"{tmp_path}/job/out/batch=3")
            raise RuntimeError("lost")
        done.append(out)
        return out

    with pytest.raises(Exception, match="lost"):
        jobs.commit_batches(hot_stream(spark, folder), f"{tmp_path}/job", job, SCHEMA)
    again = jobs.commit_batches(hot_stream(spark, folder), f"{tmp_path}/job", job, SCHEMA)
    assert "lost" in done and rows(again) == levels_of(spark, batches[:4])
    more = write_files(spark, batches)
    for i in range(4, len(batches)):
        shutil.copy(f"{more}/events{i}.parquet", f"{folder}/events{i}.parquet")
    again = jobs.commit_batches(hot_stream(spark, folder), f"{tmp_path}/job", job, SCHEMA)
    assert rows(again) == levels_of(spark, batches) and again.count() > 4
