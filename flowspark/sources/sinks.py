"""Writers (SNK-*)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark import schemas


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    """Feature, weather and temporal tables (SNK-01)."""
    w = df.write.mode(mode)
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def append_metrics(df: DataFrame, path: str) -> None:
    """Metrics log (SNK-02); the schema is enforced, the columns are named."""
    cols = [F.col(c).cast(t) for c, t in schemas.METRICS_COLUMNS.items()]
    df.select(*cols).write.mode("append").parquet(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.METRICS_LOG).parquet(path)


def save_graphs(edges: DataFrame, path: str) -> None:
    """Named graphs, one folder per city and graph (SNK-03)."""
    edges.write.mode("overwrite").partitionBy("city", "graph").parquet(path)


def load_graphs(spark: SparkSession, path: str, city: str, names: list[str] | None = None) -> DataFrame:
    df = spark.read.schema(schemas.EDGES).parquet(path).where(F.col("city") == city)
    return df if names is None else df.where(F.col("graph").isin(names))
