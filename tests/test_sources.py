import tempfile

import pytest
from conftest import rows
from pyspark.sql import functions as F

from flowspark.functions.geo import GridSpec
from flowspark.plans import catalog
from flowspark.sources import sinks
from flowspark.sources import tables as src

G = GridSpec("t", 0.0, 4.0, 0.0, 4.0, 4, 4, 0)


def folder():
    return tempfile.mkdtemp(prefix="flowspark-test-")


def test_forecast_records_default_pop(spark):
    doc = '{"list":[{"dt_txt":"2024-01-01 03:00:00","main":{"temp":1.5,"humidity":40},"wind":{"speed":2},"weather":[{"id":800}]}]}'
    r = src.forecast_records(spark.createDataFrame([(doc,)], "value string")).first()
    assert (r.temperature, r.weather_code, r["pop"]) == (1.5, 800, 0.0)


def test_point_scan_is_inclusive_and_pushed_down(spark):
    path = folder() + "/n"
    data = [(1, 0.0, 4.0, {"station": "subway"}), (2, 4.1, 1.0, {"station": "subway"}), (3, 1.0, 1.0, {"shop": "x"})]
    spark.createDataFrame(data, "id long, lon double, lat double, tags map<string,string>").write.parquet(path)
    d = src.tagged_points(spark.read.parquet(path), G, F.col("tags")["station"] == "subway").select("id")
    assert rows(d) == [(1,)]
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(lon" in plan


def test_polyline_scan(spark):
    data = [
        (1, {"highway": "service"}, [(9.0, 9.0), (1.0, 1.0)]), (2, {"highway": "service"}, [(1.0, 1.0)]),
        (3, {"highway": "track"}, [(1.0, 1.0), (2.0, 2.0)]), (4, {"highway": "service"}, [(9.0, 1.0), (9.0, 2.0)]),
    ]
    df = spark.createDataFrame(data, "id long, tags map<string,string>, coords array<struct<lon:double,lat:double>>")
    assert rows(src.polylines(df, G, ["service"]).select("id")) == [(1,)]


def test_route_members(spark):
    data = [
        (1, {"route": "bus", "ref": "5"}, [("n", 10, "platform_entry"), ("n", 11, "forward"), ("w", 12, "stop"), ("n", 13, "stop")]),
        (2, {"route": "bus", "name": "N"}, [("n", 10, "stop")]), (3, {"route": "bus"}, [("n", 14, "platform")]), (4, {"route": "subway", "ref": "1"}, [("n", 10, "")]),
    ]
    df = spark.createDataFrame(data, "id long, tags map<string,string>, members array<struct<type:string,ref:long,role:string>>")
    assert rows(src.route_members(df, "bus", src.bus_roles())) == [("5", 10), ("5", 13), ("N", 10), ("route_3", 14)]
    assert rows(src.route_members(df, "subway")) == [("1", 10)]


def test_dense_adjacency(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.4, 1.0])], "src int, weights array<double>")
    assert rows(src.dense_to_edges(df)) == [(0, 0, 1.0), (1, 0, 0.4), (1, 1, 1.0)]


def test_graphs_round_trip_prunes(spark):
    path = folder() + "/g"
    data = [("bj", "spatial", 0, 1, 0.5), ("bj", "poi", 0, 2, 0.1), ("nyc", "poi", 3, 4, 0.2)]
    sinks.save_graphs(spark.createDataFrame(data, "city string, graph string, src long, dst long, weight double"), path)
    d = sinks.load_graphs(spark, path, "bj", ["poi"])
    assert rows(d, "src", "dst") == [(0, 2)]
    assert "PartitionFilters: [isnotnull(city" in d._jdf.queryExecution().executedPlan().toString()


def test_sensor_splits(spark):
    base = folder()
    for s, v in (("train", 1.0), ("test", 2.0)):
        spark.createDataFrame([(1, "2012-03-01 00:00:00", v, 0.0)], ["node_id", "t0_timestamp", "x_t+0_d0", "other"]).write.parquet(f"{base}/{s}")
    d = src.read_sensor_splits(spark, {s: f"{base}/{s}" for s in ("train", "test")})
    assert rows(d, "split", "value") == [("test", 2.0), ("train", 1.0)]


@pytest.mark.parametrize("n", [0, 2, 6, 11])
def test_segment_store_reads_all_segments(spark, monkeypatch, n):
    catalog.load()
    from flowspark.plans import q_sources

    data = [("bj", 384 * i + j, 7, 1.0, 2.0, i) for i in range(n) for j in range(i + 1)]
    made = spark.createDataFrame(data, "city string, step long, grid_id long, inflow double, outflow double, segment long")
    monkeypatch.setattr(q_sources, "segmented", lambda t: made)
    got = q_sources.segment_store(src.Tables(spark, "/nowhere"))
    assert rows(got) == sorted((f"s{i}", i + 1, i + 1) for i in range(n))


def test_dense_adjacency_has_all_nations(spark):
    catalog.load()
    from flowspark.plans import q_graphs

    t = src.Tables(spark, "/nowhere")
    t.plans |= {
        "lineitem": spark.createDataFrame([(1, 1), (1, 2)], "l_orderkey long, l_suppkey long"), "orders": spark.createDataFrame([(1, 1)], "o_orderkey long, o_custkey long"),
        "customer": spark.createDataFrame([(1, 30)], "c_custkey long, c_nationkey int"), "supplier": spark.createDataFrame([(1, 30), (2, 2)], "s_suppkey long, s_nationkey int"),
    }
    assert [r[:2] for r in rows(src.dense_to_edges(q_graphs.dense_adjacency(t)))] == [(30, 2), (30, 30)]
