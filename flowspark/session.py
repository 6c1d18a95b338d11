"""Session settings shared by the jobs, the registered queries and the tests."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_run_dirs: set[str] = set()
_own_dirs: dict[str, str] = {}  # by application, where the cluster names no folder
BATCH_BYTES = "4m"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PACKAGE = os.path.dirname(os.path.abspath(__file__))


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the settings the results depend on, and give the package to the executors.

    Results depend on UTC time; adaptive execution picks joins by the bytes it sees; the rows that
    travel to a Python worker together are bounded in bytes, however long a row is. The state of
    streams lies on disk, not in an executor's memory. All other settings belong to the job that starts the session.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_flowspark_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="flowspark-ship-")
    path = os.path.join(folder, "flowspark.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for top, _, names in os.walk(PACKAGE):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(top, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(PACKAGE)))
    sc.addPyFile(path)
    # the driver's own helper for state processors does not look at added files
    root = os.path.dirname(PACKAGE)
    sc.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, sc.environment.get("PYTHONPATH")]))
    sc._flowspark_shipped = True
    atexit.register(shutil.rmtree, folder, ignore_errors=True)  # executors fetch it from here


def shared_dir(spark: SparkSession) -> str:
    """This application's folder in the one that every executor can reach, as the cluster names it.

    It holds what a run writes for itself and is removed when the application ends. Where the cluster
    names none, a local session gets one folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        sc = spark.sparkContext
        base = f"{named.rstrip('/')}/run-{sc.applicationId}"
        if base not in _run_dirs:
            path = sc._jvm.org.apache.hadoop.fs.Path(base)
            store = path.getFileSystem(sc._jsc.hadoopConfiguration())
            store.mkdirs(path)
            store.deleteOnExit(path)
            _run_dirs.add(base)
        return base
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="flowspark-")
        atexit.register(shutil.rmtree, _own_dirs[app], ignore_errors=True)
    return _own_dirs[app]


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and read them back.

    The written table survives the loss of executors, and the new plan starts at a scan, so
    loops do not grow it.
    """
    path = fresh_dir(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
