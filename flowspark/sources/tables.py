"""Table readers (SRC-*). File codecs of other tools are out of scope: inputs are
Parquet, CSV, JSON or text."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark import schemas
from flowspark.functions.geo import GridSpec, in_bbox


class Tables:
    """Parquet tables of one folder, as attributes, and the views derived from them.

    A table or view is planned once per instance; nothing is computed or kept here.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.plans: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.plan(name, lambda: self.spark.read.parquet(f"{self.folder}/{name}.parquet"))

    def plan(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        if name not in self.plans:
            self.plans[name] = build()
        return self.plans[name]


def view(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    """Plan a derived view once per ``Tables``."""

    @wraps(fn)
    def planned(t: Tables) -> DataFrame:
        return t.plan(f"{fn.__module__}.{fn.__qualname__}", lambda: fn(t))

    return planned


def segment_paths(spark: SparkSession, base: str, column: str) -> dict[str, str]:
    """The folders of a table partitioned by ``column``, named by its values."""
    names = spark.read.schema(f"{schemas.FLOW}, {column} STRING").parquet(base).select(column).distinct().collect()
    return {n: f"{base}/{column}={n}" for n in sorted(r[0] for r in names)}


def read_segments(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Yearly segments in one table with a ``segment`` column (SRC-01, S-01)."""
    parts = [
        spark.read.schema(schemas.FLOW).parquet(p).withColumn("segment", F.lit(name))
        for name, p in paths.items()
    ]
    out = spark.createDataFrame([], f"{schemas.FLOW}, segment STRING")
    for p in parts:
        out = out.unionByName(p)
    return out


def read_flow(spark: SparkSession, path: str, city: str | None = None) -> DataFrame:
    """Cleaned flow table (SRC-02); ``city`` prunes partitions."""
    df = spark.read.schema(schemas.FLOW).parquet(path)
    return df if city is None else df.where(F.col("city") == city)


def read_csv(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """CSV with a header and a declared schema (SRC-03)."""
    return spark.read.schema(schema).option("header", True).csv(path)


def read_sensor_splits(spark: SparkSession, paths: dict[str, str], value: str = "x_t+0_d0") -> DataFrame:
    """Three columns of the pre-windowed sensor table, all splits (SRC-04)."""
    parts = [
        spark.read.parquet(p).select(
            "node_id", "t0_timestamp", F.col(f"`{value}`").alias("value"), F.lit(split).alias("split")
        )
        for split, p in paths.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def read_text_table(spark: SparkSession, dirs: list[str], name: str, cols: list[str]) -> DataFrame:
    """One all-string transit text table over several directories (SRC-05).

    Each directory keeps its own header, so columns are matched by name.
    """
    parts = [spark.read.option("header", True).csv(f"{d}/{name}").select(*cols) for d in dirs]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def numeric_or_drop(df: DataFrame, cols: list[str]) -> DataFrame:
    """Cast to double, drop the rows that do not parse (P-35)."""
    return df.withColumns({c: F.col(c).try_cast("double") for c in cols}).dropna(subset=cols)


def read_dates(spark: SparkSession, path: str) -> DataFrame:
    """One date per line; blank lines, ``#`` comments and other text are skipped (SRC-07)."""
    line = F.trim("value")
    return (
        spark.read.text(path)
        .where((F.length(line) > 0) & ~line.startswith("#"))
        .select(
            F.coalesce(
                F.try_to_timestamp(line, F.lit("yyyy-MM-dd")), F.try_to_timestamp(line, F.lit("yyyyMMdd"))
            ).cast("date").alias("d")
        )
        .where("d IS NOT NULL")
        .distinct()
    )


def sensor_location_report(df: DataFrame) -> DataFrame:
    """Row count, repeated sensor ids and coordinate bounds (SRC-08)."""
    per_id = df.groupBy("sensor_id").agg(
        F.count("*").alias("n"),
        *[f(c).alias(f"{f.__name__}_{c}") for c in ("latitude", "longitude") for f in (F.min, F.max)],
    )
    return per_id.agg(
        F.sum("n").alias("n_rows"),
        F.sum(F.col("n") - 1).alias("n_repeated"),
        F.min("min_latitude").alias("lat_min"),
        F.max("max_latitude").alias("lat_max"),
        F.min("min_longitude").alias("lon_min"),
        F.max("max_longitude").alias("lon_max"),
    )


def dense_to_edges(df: DataFrame, src: str = "src", weights: str = "weights") -> DataFrame:
    """Rows of a dense adjacency matrix to positive edges (SRC-09)."""
    return df.select(F.col(src).alias("src"), F.posexplode(weights).alias("dst", "weight")).where("weight > 0")


def forecast_records(df: DataFrame, json: str = "value") -> DataFrame:
    """Forecast documents to one row per forecast time (SRC-10)."""
    doc = F.from_json(F.col(json), schemas.FORECAST)
    item = F.col("i")
    return df.select(F.explode(doc["list"]).alias("i")).select(
        F.to_timestamp(item["dt_txt"]).alias("ts"),
        item["main"]["temp"].alias("temperature"),
        item["main"]["humidity"].alias("humidity"),
        item["wind"]["speed"].alias("wind_speed"),
        F.get(item["weather"], F.lit(0))["id"].alias("weather_code"),
        F.coalesce(item["pop"], F.lit(0.0)).alias("pop"),
    )


def tagged_points(nodes: DataFrame, g: GridSpec, predicate: Column) -> DataFrame:
    """Points inside the box whose tags pass (SRC-12, P-42); both tests reach the scan."""
    return nodes.where(in_bbox(F.col("lon"), F.col("lat"), g) & predicate)


def polylines(ways: DataFrame, g: GridSpec, types: list[str]) -> DataFrame:
    """Ways of the given types with two or more vertices, any of them in the box (SRC-13)."""
    near = F.exists("coords", lambda c: in_bbox(c["lon"], c["lat"], g))
    return ways.where(F.col("tags")["highway"].isin(types) & (F.size("coords") >= 2) & near)


def route_members(relations: DataFrame, route: str, roles: Column | None = None) -> DataFrame:
    """(line, node id) pairs of the relations of one route type (SRC-14)."""
    tags = F.col("tags")
    line = F.trim(
        F.coalesce(tags["ref"], tags["name"], F.concat(F.lit("route_"), F.col("id").cast("string")))
    )
    members = (
        relations.where(tags["route"] == route)
        .select(line.alias("line"), F.explode("members").alias("m"))
        .where(F.col("m.type") == "n")
    )
    if roles is not None:
        members = members.where(roles)
    return members.select("line", F.col("m.ref").alias("node_id")).distinct()


def bus_roles() -> Column:
    return F.col("m.role").contains("platform") | (F.col("m.role") == "stop")


def stop_routes_reference(df: DataFrame, route: str, stop: str, normalise) -> DataFrame:
    """(stop name, route) pairs from a reference table, null and blank stops dropped (SRC-15).
    A set per stop is kept as pairs, one row each, so no set has to fit in a task."""
    return (
        df.dropna(subset=[stop])
        .select(normalise(F.col(stop)).alias("stop_name"), F.trim(F.col(route)).alias("route"))
        .where(F.length("stop_name") > 0)
        .distinct()
    )
