"""Registered queries against their SQL. A spread of them by default; all with FLOWSPARK_ALL=1."""

import os
import re
import shutil
import subprocess
import sys

import pytest
from check import compare, duck

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
CORE = [
    "slot_zscore_levels", "slot_date_parse", "cyclic_time_features", "us_holidays", "cell_assign", "chrono_split", "segment_split",
    "horizon_metrics", "dedup_first", "interp_linear", "weather_clean", "forecast_resample", "sensor_rebuild", "dataset_profile",
    "road_density", "spectral_index_grid", "routes_per_cell", "node_features", "pearson_knn", "transit_graph", "adjacency_checks",
    "cheb_features", "graph_fusion_mean", "anomaly_components_tiled", "alert_history", "weak_label_c", "threshold_sweep", "ar1_rolling",
    "unit_root", "fuzzy_match", "radius_edges", "stream_alert_level", "graph_store", "text_tables",
]
NAMES = list(entry.oracle_sql()) if os.environ.get("FLOWSPARK_ALL") else CORE
needs_data = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are absent")


@needs_data
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    got = entry.queries()[name](spark, FOLDER).toPandas()
    assert compare(got, duck(FOLDER).execute(entry.oracle_sql()[name]).df()) == "ok"


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@needs_data
def test_entry(spark):
    assert entry.entry(spark).count() > 0


@needs_data
def test_executors_get_the_package(tmp_path):
    """A session started in another folder, without PYTHONPATH, runs the package's Python code."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
import __spark_entry__ as e
for name in ("anomaly_components", "cosine_knn", "order_selection"):
    print(name, e.queries()[name](spark, {FOLDER!r}).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert run.returncode == 0, run.stderr[-2000:]
    assert all(int(line.split()[1]) > 0 for line in run.stdout.splitlines())


def test_entry_without_the_llm_part(tmp_path):
    """A copy without the llm folders imports and has all other queries, whether or not the pipeline's file is there."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    copy = tmp_path / "copy"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns("llm", ".git", "__pycache__", "tests", ".pytest_cache"))
    others = {n for n in entry.queries() if n != "pipeline" and not re.match(r"op\d", n)}
    code = "import sys; sys.path.insert(0, '.'); import __spark_entry__ as e; e.oracle_sql(); print(*e.queries())"
    for _ in range(2):
        run = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, timeout=120)
        assert run.returncode == 0, run.stderr[-2000:]
        assert others <= set(run.stdout.split()) and "pipeline" not in run.stdout.split()
        (copy / "corpus_pipeline.py").unlink(missing_ok=True)


def test_entry_lets_other_missing_modules_through(tmp_path, monkeypatch):
    (tmp_path / "corpus_pipeline_broken.py").write_text("import no_such_module_here")
    monkeypatch.syspath_prepend(str(tmp_path))
    with pytest.raises(ModuleNotFoundError):
        entry.optional("corpus_pipeline_broken")


def test_a_run_removes_its_folder(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import os, sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {str(tmp_path / "shared")!r}).getOrCreate()
from flowspark.session import cut_lineage
print(cut_lineage(spark.range(5)).count(), *(n[:4] for n in os.listdir({str(tmp_path / "shared")!r}) if n.startswith("run-")))
"""
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0 and run.stdout.split() == ["5", "run-"], run.stderr[-2000:]
    assert not [n for n in os.listdir(tmp_path / "shared") if n.startswith("run-")]
