import numpy as np
import pandas as pd
import pytest
from conftest import rows
from pyspark.sql import functions as F

from flowspark.operators import series
from flowspark.operators.quantiles import exact_quantiles
from flowspark.operators import splits


@pytest.fixture(scope="module")
def holes(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"k": np.repeat(["a", "b", "c"], 60), "o": np.tile(np.arange(60), 3), "v": np.round(rng.random(180), 3)})
    pdf.loc[rng.random(180) < 0.7, "v"] = np.nan
    pdf.loc[pdf.k == "c", "v"] = np.nan
    pdf.loc[(pdf.k == "c") & (pdf.o == 41), "v"] = 0.5
    df = spark.createDataFrame(pdf.sample(frac=1, random_state=1)).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    return pdf, df


def _values(df):
    return df.orderBy("k", "o").toPandas()["v"].to_numpy(float)


def test_known_neighbours_cross_chunks(holes):
    pdf, df = holes
    got = series.known_neighbours(df, ["k"], "o", ["v"], chunk=7).orderBy("k", "o").toPandas()
    prev = pdf.groupby("k")["v"].ffill().to_numpy()
    nxt = pdf.groupby("k")["v"].bfill().to_numpy()
    value = lambda col: np.array([np.nan if x is None else x["v"] for x in got[col]])
    np.testing.assert_array_equal(value("_prev_v"), prev)
    np.testing.assert_array_equal(value("_next_v"), nxt)


@pytest.mark.parametrize("leading,limit", [("nearest", "both"), ("null", "forward")])
def test_interpolate_like_pandas(holes, leading, limit, monkeypatch):
    pdf, df = holes
    monkeypatch.setattr(series.known_neighbours, "__defaults__", (9,))
    got = _values(series.interpolate(df, ["k"], "o", ["v"], leading=leading))
    want = pdf.groupby("k")["v"].transform(lambda s: s.interpolate(limit_direction=limit)).to_numpy()
    np.testing.assert_allclose(got, want)


def test_ffill_bfill(holes):
    pdf, df = holes
    want = pdf.groupby("k")["v"].transform(lambda s: s.ffill().bfill()).to_numpy()
    np.testing.assert_array_equal(_values(series.ffill_bfill(df, ["k"], "o", ["v"])), want)


def test_lagged_respects_gaps_and_chunks(spark):
    pdf = pd.DataFrame({"k": 1, "o": [0, 1, 2, 3, 4, 6, 7, 8, 9, 10], "v": np.arange(10.0)})
    d = series.lagged(spark.createDataFrame(pdf), ["k"], "o", {"l1": ("v", 1), "l2": ("v", 2)}, chunk=4).orderBy("o").toPandas()
    assert [None if np.isnan(x) else x for x in d.l1] == [None, 0, 1, 2, 3, None, 5, 6, 7, 8]
    assert [None if np.isnan(x) else x for x in d.l2] == [None, None, 0, 1, 2, None, None, 5, 6, 7]


def test_sliding_samples_count_and_guard(spark):
    df = spark.range(100).select(F.lit(1).alias("k"), F.col("id").alias("o"), F.col("id").cast("double").alias("v"))
    s = series.sliding_samples(df, ["k"], "o", ["v"], "v", 12, 5)
    assert s.count() == 100 - 12 - 5 + 1
    r = s.where("o = 40").first()
    assert list(r.x_v) == [float(x) for x in range(29, 41)] and list(r.y) == [41.0, 42.0, 43.0, 44.0, 45.0]
    gap = df.where("o <> 50")
    assert series.sliding_samples(gap, ["k"], "o", ["v"], "v", 12, 5).count() == (50 - 16) + (49 - 16)
    assert series.sliding_samples(gap, ["k"], "o", ["v"], "v", 12, 5, guard=False).count() == 99 - 16


def test_runs_over_chunk_borders(spark):
    steps = [0, 1, 2, 5, 1438, 1439, 1440, 1441, 3000]
    df = spark.createDataFrame([(1, s) for s in steps], "k int, o long")
    assert rows(series.runs(df, ["k"], "o", 2), "run_start", "run_end", "duration_steps") == [(0, 2, 3), (1438, 1441, 4)]


def test_calendar_missing_and_dedup(spark):
    df = spark.createDataFrame([(1, 0, "x"), (1, 4, "y"), (1, 4, "a"), (2, 7, "z")], "k int, o long, v string")
    assert rows(series.missing_steps(df, ["k"], "o")) == [(1, 1), (1, 2), (1, 3)]
    assert rows(series.first_by(df, ["k", "o"], ["v"])) == [(1, 0, "x"), (1, 4, "a"), (2, 7, "z")]
    assert series.reindex(df, ["k"], "o", 2).count() == 5


def test_ordinal_is_row_number(spark):
    pdf = pd.DataFrame({"k": np.repeat([1, 2], 50), "b": np.tile(np.arange(50) // 9, 2), "o": np.tile(np.arange(50), 2)})
    d = series.ordinal(spark.createDataFrame(pdf.sample(frac=1, random_state=0)), ["k"], "b", ["o"]).toPandas()
    assert (d.pos == d.o).all()


def test_exact_quantiles_with_a_hot_key(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=8000), np.repeat(0.25, 4000)])
    pdf = pd.DataFrame({"k": np.where(np.arange(12000) % 12 < 11, "hot", "cold"), "v": rng.permutation(x)})
    probs = {"p0": 0.0, "q1": 0.25, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    got = exact_quantiles(spark.createDataFrame(pdf).repartition(5), ["k"], "v", probs).toPandas().set_index("k")
    for k, g in pdf.groupby("k"):
        np.testing.assert_allclose(got.loc[k, list(probs)].to_numpy(float), np.quantile(g.v, list(probs.values())), rtol=0, atol=1e-12)


def test_chrono_split_sizes(spark):
    df = spark.range(22484).select(F.lit("bj").alias("city"), (F.col("id") * 3).alias("step"))
    d = splits.chrono_split(df, ["city"], "step")
    n = dict(rows(d.groupBy("split").count(), "split", "count"))
    assert n == {"train": 15738, "val": 2249, "test": 4497}
    with pytest.raises(ValueError):
        splits.chrono_cuts(df, ["city"], "step", train=0.5)


def test_normalise_round_trip(spark):
    df = spark.createDataFrame([("x", 1.0, 3.0), ("x", 5.0, 7.0)], "city string, a double, b double")
    st = splits.channel_stats(df, ["city"], ["a", "b"])
    assert rows(st) == [("x", 4.0, pytest.approx(np.std([1, 3, 5, 7])))]
    back = splits.denormalise(splits.normalise(df, st, ["city"], ["a", "b"]), ["a", "b"]).select("a", "b").toPandas().sort_values("a")
    np.testing.assert_allclose(back.to_numpy(), [[1, 3], [5, 7]], atol=1e-6)
