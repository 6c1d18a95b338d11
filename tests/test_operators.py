import math
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pytest
from conftest import rows
from pyspark.sql import functions as F

from flowspark.functions import codes
from flowspark.functions.geo import GridSpec
from flowspark.operators import anomaly as an
from flowspark.operators import arma
from flowspark.operators import clean, features as ft
from flowspark.operators import forecast as fc
from flowspark.operators import kmeans as km
from flowspark.operators import match as ma
from flowspark.operators import metrics as mt
from flowspark.operators import pooled, profile
from flowspark.operators import weather as wx
from flowspark.operators.scale import scale


def test_masked_metrics(spark):
    df = spark.createDataFrame([("a", 0.0, 9.0), ("a", 10.0, 8.0), ("a", 1.0, 1.5), ("b", 0.0, 3.0)], "k string, y double, y_hat double")
    got = {r.k: r for r in mt.masked_metrics(df, ["k"]).collect()}
    assert got["a"].mae == pytest.approx(1.25) and got["a"].rmse == pytest.approx(math.sqrt(4.25 / 2))
    assert got["a"].mape == pytest.approx((2 / 11 + 0.5 / 2) / 2 * 100)
    assert got["a"].huber == pytest.approx((8.5 + 1.5 + 0.125) / 3)
    assert (got["b"].mae, got["b"].rmse, got["b"].mape) == (0.0, 0.0, 0.0)


def test_horizon_metrics_are_cumulative(spark):
    df = spark.createDataFrame([("x", h, 10.0, 10.0 + h) for h in range(1, 5)], "m string, h int, y double, y_hat double")
    got = dict(rows(mt.horizon_metrics(df, ["m"], 4), "horizon", "mae"))
    assert got == {"h1": 1.0, "h3": 2.0, "avg": 2.5}
    assert dict(rows(mt.horizon_metrics(df, ["m"], 4, exact=True), "horizon", "mae"))["h3"] == 3.0


def test_scale(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0, 0.0), ("a", 3.0, 3.0, math.e - 1), ("b", 7.0, 7.0, 1.0)], "c string, x double, y double, z double")
    got = scale(df, ["c"], minmax=["x"], zscore=["y"], log_zscore=["z"]).orderBy("c", "x").toPandas()
    np.testing.assert_allclose(got[["x", "y", "z"]].to_numpy(), [[0, -1, -1], [1, 1, 1], [0, 0, 0]], atol=1e-6)


def test_outliers_are_repaired(spark):
    v = [1.0, 2.0] * 30
    v[0], v[25], v[59] = 900.0, 900.0, 900.0
    df = spark.createDataFrame([("bj", 1, i, x) for i, x in enumerate(v)], "city string, grid_id int, step long, inflow double")
    got = clean.repair_outliers(df, ["city", "grid_id"], "step", ["inflow"], threshold=3.0).orderBy("step").toPandas().inflow.tolist()
    assert got[25] == 1.0 and got[0] == 2.0 and got[59] == 1.0 and got[24] == 1.0


def test_fuzzy_candidates_miss_nothing(spark):
    rng = np.random.default_rng(11)
    words = ["".join(rng.choice(list("abcd"), rng.integers(1, 14))) for _ in range(120)]
    noisy = []
    for w in words:
        w = list(w)
        for _ in range(rng.integers(0, 4)):
            i = int(rng.integers(0, len(w) + 1))
            w[i : i + int(rng.integers(0, 2))] = list(rng.choice(list("abcd"), rng.integers(0, 2)))
        noisy.append("".join(w) or "a")
    a, b = sorted(set(noisy)), sorted(set(words))
    left, right = (spark.createDataFrame([(x,) for x in y], "name string") for y in (a, b))

    score = {"levenshtein": lambda s, t: 1 - edits(s, t) / max(len(s), len(t)), "ratio": lambda s, t: SequenceMatcher(None, s, t).ratio()}
    for scorer, f in score.items():
        got = {r.name: (r.match, None if r.score is None else round(r.score, 9)) for r in ma.best_matches(left, right, scorer=scorer).collect()}
        for s in a:
            if s in b:
                assert got[s] == (s, 1.0)
                continue
            best = max(round(f(s, t), 9) for t in b)
            if best >= 0.8:
                assert got[s][1] == best and got[s][0] == min(t for t in b if round(f(s, t), 9) == best)
            else:
                assert got[s] == (None, None)


@pytest.mark.parametrize("scorer", ["levenshtein", "ratio"])
def test_fuzzy_candidates_are_few_and_complete(spark, scorer):
    """Names of shared words, with typing errors: below 5 % of all pairs, and every pair that scores enough."""
    rng = np.random.default_rng(5)
    words = ["north", "south", "main", "market", "station", "bridge", "park", "river", "garden", "street", "museum", "harbour", "old", "new", "hill", "mill"]
    names = sorted({" ".join(rng.choice(words, rng.integers(2, 5))) for _ in range(400)})
    typed = []
    for w in names[:250]:
        w = list(w)
        for _ in range(rng.integers(0, 4)):
            i = int(rng.integers(0, len(w)))
            w[i : i + int(rng.integers(0, 2))] = list(rng.choice(list("aeinorst "), rng.integers(0, 2)))
        typed.append("".join(w))
    left, right = (spark.createDataFrame([(x,) for x in y], "name string") for y in (typed, names))
    got = {(r.a, r.b) for r in ma.candidate_pairs(left, right, scorer=scorer).collect()}
    score = {"levenshtein": lambda a, b: 1 - edits(a, b) / max(len(a), len(b)), "ratio": lambda a, b: SequenceMatcher(None, a, b).ratio()}[scorer]
    want = {(a, b) for a in set(typed) for b in names if round(score(a, b), 9) >= 0.8}
    assert want <= got and len(want) > 200
    assert len(got) < 0.05 * len(set(typed)) * len(names)


@pytest.mark.parametrize("scorer,threshold", [("levenshtein", 0.5), ("ratio", 0.55), ("levenshtein", 0.95), ("ratio", 0.9)])
def test_fuzzy_candidates_at_other_thresholds(spark, monkeypatch, scorer, threshold):
    """Low thresholds, where short names share no gram, and hot grams in many parts."""
    monkeypatch.setattr(ma, "HOT", 3)
    rng = np.random.default_rng(6)
    names = sorted({"".join(rng.choice(list("ab\U0001f600"), rng.integers(1, 9))) for _ in range(90)})
    df = spark.createDataFrame([(x,) for x in [*names, "", None]], "name string")
    got = {(r.a, r.b) for r in ma.candidate_pairs(df, df, threshold, scorer).collect()}
    score = {"levenshtein": lambda a, b: 1 - edits(a, b) / max(len(a), len(b)), "ratio": lambda a, b: SequenceMatcher(None, a, b).ratio()}[scorer]
    assert {(a, b) for a in names for b in names if round(score(a, b), 9) >= threshold} <= got


def edits(s, t):
    d = list(range(len(t) + 1))
    for i, x in enumerate(s, 1):
        p, d[0] = d[0], i
        for j, y in enumerate(t, 1):
            p, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, p + (x != y))
    return d[-1]


def test_supplement_routes(spark):
    stops = spark.createDataFrame([(1, "Main St(east)"), (2, "Maim St"), (3, "Nowhere")], "stop_id int, name string")
    pairs = spark.createDataFrame([(1, "r1")], "stop_id int, route_id string")
    ref = spark.createDataFrame([("Main St", "r7"), ("Main St", "r8")], "stop_name string, route string")
    from flowspark.functions.text import stop_name

    assert rows(ma.supplement_routes(stops, pairs, ref, stop_name)) == [(1, "r1"), (2, "r7"), (2, "r8")]


def test_weather_outer_merge_primary_owns_shared_columns(spark):
    p = spark.createDataFrame([("c", 1, 5.0), ("c", 2, None)], "city string, hour long, wind double")
    s = spark.createDataFrame([("c", 2, 9.0, 3.0), ("c", 3, 9.0, 4.0)], "city string, hour long, wind double, clouds double")
    assert rows(wx.outer_merge(p, s, ["city"], "hour"), "hour", "wind", "clouds") == [(1, 5.0, 3.0), (2, 5.0, 3.0), (3, 5.0, 4.0)]


def test_asof_join(spark):
    left = spark.createDataFrame([("c", s) for s in (0, 3, 4, 4, 9)], "city string, step long")
    right = spark.createDataFrame([("c", 3, 1.0), ("c", 7, 2.0)], "city string, step long, v double")
    assert rows(wx.asof_join(left, right, ["city"], "step", ["v"]), "step", "v") == [(0, None), (3, 1.0), (4, 1.0), (4, 1.0), (9, 2.0)]


def test_levels():
    l = an.LEVELS
    assert [x.min_cells for x in l] == [6, 12, 12, 25]


def test_level_rules_differ(spark):
    df = spark.createDataFrame([(5, 9.0), (6, 3.1), (12, 3.2), (12, 3.6), (25, 3.9), (25, 4.1)], "cells int, max_z double")
    got = [r[0] for r in df.select(an.level_by_cluster(F.col("cells"), F.col("max_z"), an.LEVELS)).collect()]
    assert got == [0, 1, 2, 3, 3, 4]
    counts = spark.createDataFrame([(5, 5, 5), (6, 0, 0), (12, 11, 0), (12, 12, 0), (30, 12, 25)], "n_z3 int, n_z3_5 int, n_z4 int")
    assert [r[0] for r in counts.select(an.level_by_count(an.LEVELS)).collect()] == [0, 1, 2, 3, 4]


def test_anomaly_type(spark):
    df = spark.createDataFrame(
        [(1, 16, 0, 3, 0, 3), (2, 8, 0, 0, 0, 7), (3, 3, 0, 1, 0, 1), (3, 2, 5, 5, 5, 6)],
        "step int, cell_count int, row_min int, row_max int, col_min int, col_max int",
    )
    assert rows(an.anomaly_type(df, ["step"]), "step", "type") == [(1, "mass_gathering"), (2, "traffic_jam"), (3, "sudden_incident")]


def test_consecutive_share_and_oversample(spark):
    df = spark.createDataFrame([("c", i, int(x)) for i, x in enumerate("0110111")], "city string, step long, lab int")
    r = an.consecutive_share(df, "lab", ["city"], "step").first()
    assert (r.n_positive, r.n_consecutive, r.share) == (5, 3, 0.6)
    assert an.oversample(df, "lab", 4).count() == 2 + 5 * 4


def test_evaluate(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 1), (0, 0), (1, 1)], "p int, t int")
    r = an.evaluate(df, {"d": F.col("p") == 1}, F.col("t") == 1).first()
    assert (r.tp, r.fp, r.fn, r.tn) == (2, 1, 1, 1) and r.precision == pytest.approx(2 / 3) and r.fpr == 0.5


def ar_series(n=600, phi=0.7, cells=3, seed=0):
    rng = np.random.default_rng(seed)
    out = []
    for c in range(cells):
        x, v = 0.0, []
        for _ in range(n):
            x = phi * x + 2 + rng.normal()
            v.append(x)
        out.append(v)
    return np.array(out)


def series_frame(spark, x):
    n = x.shape[1]
    pdf = pd.DataFrame({"city": "bj", "grid_id": np.repeat(np.arange(len(x)), n), "step": np.tile(np.arange(n), len(x)), "inflow": x.ravel()})
    return spark.createDataFrame(pdf)


def test_ar1_and_orders_match_least_squares(spark):
    x = ar_series()
    df = series_frame(spark, x)
    fit = {r.grid_id: r for r in fc.ar1_fit(df, "inflow", ["city", "grid_id"], "step").collect()}
    for i, s in enumerate(x):
        b, a = np.polyfit(s[:-1], s[1:], 1)
        assert (fit[i].phi, fit[i].c) == (pytest.approx(b), pytest.approx(a))
    got = {(r.grid_id, r.p): r for r in fc.ar_orders(df, "inflow", ["city", "grid_id"], "step", 3).collect()}
    for i, s in enumerate(x):
        for p in range(4):
            m = np.column_stack([np.ones(len(s) - 3)] + [s[3 - k : len(s) - k] for k in range(1, p + 1)])
            coef, *_ = np.linalg.lstsq(m, s[3:], rcond=None)
            rss = ((s[3:] - m @ coef) ** 2).sum()
            assert got[(i, p)].aic == pytest.approx(len(m) * math.log(rss / len(m)) + 2 * (p + 1), rel=1e-6)


def test_rolling_forecast_uses_block_origins(spark):
    x = ar_series(n=300, cells=1)
    df = series_frame(spark, x).withColumn("test_pos", F.col("step") - 200)
    fit = spark.createDataFrame([("bj", 0, 0.5, 1.0)], "city string, grid_id int, phi double, c double")
    got = fc.ar1_rolling(df, fit, "inflow", ["city", "grid_id"], "step", block=48).orderBy("step").toPandas()
    assert len(got) == 100 and got.h.tolist()[:50] == [*range(1, 49), 1, 2]
    o = x[0, 199]
    for h in range(1, 49):
        o = 1.0 + 0.5 * o
        assert got.y_hat[h - 1] == pytest.approx(o)
    assert got.y_hat[48] == pytest.approx(1.0 + 0.5 * x[0, 247])


def test_acf_and_unit_root(spark):
    x = ar_series()
    df = series_frame(spark, x)
    got = {(r.grid_id, r.lag): r.acf for r in fc.autocorrelation(df, "inflow", ["city", "grid_id"], "step", 5).collect()}
    d = x[1] - x[1].mean()
    for k in range(1, 6):
        assert got[(1, k)] == pytest.approx((d[k:] * d[:-k]).sum() / (d * d).sum())
    walk = np.cumsum(np.random.default_rng(3).normal(size=(1, 600)), axis=1)
    assert {r.d for r in fc.unit_root(df, "inflow", ["city", "grid_id"], "step").collect()} == {0}
    assert [r.d for r in fc.unit_root(series_frame(spark, walk), "inflow", ["city", "grid_id"], "step").collect()] == [1]


def test_fourier_fit_matches_least_squares(spark):
    rng = np.random.default_rng(6)
    n = 336 * 3
    t = np.arange(n)
    y = 20 + 5 * np.sin(2 * np.pi * (t + 16) / 48) + 3 * np.cos(2 * np.pi * (t + 16) / 336) + 0.01 * t + rng.normal(size=n)
    df = series_frame(spark, y[None, :])
    fit = fc.fourier_fit(df.where("step < 800"), "inflow", ["city", "grid_id"], "step", 8, chunk=100)
    got = fc.fourier_predict(df, fit, ["city", "grid_id"], "step", 8).orderBy("step").toPandas().y_hat
    z = np.zeros(n)
    m = fc._fourier(t.astype(float), z, z + 800, 8)
    coef, *_ = np.linalg.lstsq(m[:800], y[:800], rcond=None)
    np.testing.assert_allclose(got, m @ coef, atol=1e-4)


def test_pooled_regression_recovers_a_linear_rule(spark):
    rng = np.random.default_rng(9)
    x = rng.random((400, 3))
    y = 2 * x[:, 0] - x[:, 2] + 1
    pdf = pd.DataFrame({"is_train": np.arange(400) < 300, "x_a": x.tolist(), "y": [[v, -v] for v in y.tolist()]})
    got = pooled.fit_predict(spark.createDataFrame(pdf, "is_train boolean, x_a array<double>, y array<double>"), ["x_a"], [1, 2], 3).toPandas()
    assert len(got) == 200 and np.abs(got.y - got.y_hat).max() < 1e-3


def test_transfer_keeps_the_source_statistics(spark):
    x = ar_series(n=200)
    src = series_frame(spark, x).withColumn("is_train", F.col("step") < 150)
    other = src.withColumn("city", F.lit("nyc"))
    more = src.withColumns({"city": F.lit("far"), "inflow": F.col("inflow") * 100})
    got = pooled.transfer(src.unionByName(more), "bj", other, ["city", "grid_id"], "step", "inflow", 4, [1, 2])
    assert got.count() == 2 * 3 * (50 - 5)
    e = got.where("h = 1").toPandas()
    assert np.abs(e.y - e.y_hat).mean() < 1.2


def test_lookup_map(spark):
    pred = spark.createDataFrame([("bj", g, s, float(10 * g + s)) for g in (1, 2) for s in range(5)], "city string, grid_id int, step long, y_hat double")
    r = pooled.lookup(pred, "city", "step", "y_hat", 3, start=1, grid_ids=[2]).first()
    assert r.start == 1 and r.predictions == {2: [(1, 21.0), (2, 22.0), (3, 23.0)]}
    gap = pooled.lookup(pred.where("NOT (grid_id = 2 AND step = 2)"), "city", "step", "y_hat", 3, start=1).first()
    assert gap.predictions[2] == [(1, 21.0), (3, 23.0)]


def test_road_length_is_kept(spark):
    g = GridSpec("t", 0.0, 4.0, 0.0, 4.0, 4, 4, 0)
    way = [(1, {"highway": "service"}, [(0.5, 0.5), (3.5, 0.5), (3.5, 3.0), (3.5, 9.0)])]
    df = spark.createDataFrame(way, "id long, tags map<string,string>, coords array<struct<lon:double,lat:double>>")
    pieces = ft.road_pieces(df, g).toPandas().groupby("grid_id").km.sum()
    km = 111.32
    assert pieces.loc[12] == pytest.approx(0.5 * km * math.cos(math.radians(0.5)))
    assert pieces.loc[15] == pytest.approx(0.5 * km * math.cos(math.radians(0.5)) + 0.5 * km)
    assert pieces.loc[[3, 7, 11]].sum() == pytest.approx(3 * km)
    total = ft.road_features(ft.road_pieces(df, g), g).agg(F.sum("service_density")).first()[0]
    assert total > 0


def test_raster_boundary_pixels_count_twice(spark):
    g = GridSpec("t", 0.0, 4.0, 0.0, 4.0, 2, 2, 0)
    px = 4.0 / 3  # a cell is 1.5 pixels wide
    data = [("s", r, c, float(10 * r + c), 0.0, 0.0, 0.0) for r in range(3) for c in range(3)]
    df = spark.createDataFrame(data, "scene string, row long, col long, b4 double, ndvi double, ndbi double, mndwi double")
    got = {r.grid_id: r.b4_mean for r in ft.raster_features(df, g, px, 3, 3).collect()}
    assert got == {0: 5.5, 1: 6.5, 2: 15.5, 3: 16.5}


def test_history_features(spark):
    x = np.tile(np.r_[np.zeros(24), np.ones(24) * 4], 14)
    pdf = pd.DataFrame({"city": "bj", "grid_id": 0, "step": np.arange(len(x)), "inflow": x, "outflow": 1.0})
    flat = pdf.assign(grid_id=1, inflow=2.0)
    got = {r.grid_id: r for r in ft.history_features(spark.createDataFrame(pd.concat([pdf, flat])), ["city", "grid_id"], 0).collect()}
    assert got[0].zero_rate == 0.5 and got[0].night_ratio == 0.0 and got[0].peak_ratio == 0.0
    assert got[1].flow_cv == pytest.approx(0.0) and got[0].flow_cv == pytest.approx(1.0)
    assert got[1].hist_p99 == pytest.approx(0.5) and got[0].weekend_ratio == pytest.approx(1.0)


def test_class_counts_cover_every_cell(spark):
    g = GridSpec("t", 0.0, 4.0, 0.0, 4.0, 2, 2, 0)
    df = spark.createDataFrame([(0, "food"), (0, "food"), (3, None), (-1, "food")], "grid_id long, category string")
    got = rows(ft.class_counts(df, g, "category", codes.POI_CLASSES), "grid_id", "food_count", "sports_count")
    assert got == [(0, 2, 0), (1, 0, 0), (2, 0, 0), (3, 0, 0)]


def test_node_feature_columns():
    assert len(ft.NODE_FEATURES) == 41 and set(ft.FEATURE_GROUP) == set(ft.NODE_FEATURES)


def lagged_matrix(x, lags):
    """Rows t = lags.. of the columns x_t, x_{t-1}, .., x_{t-lags}."""
    return np.stack([x[lags - k : len(x) - k] for k in range(lags + 1)], 1)


def least_squares(y, cols):
    x = np.stack([np.ones(len(y)), *cols], 1)
    b = np.linalg.lstsq(x, y, rcond=None)[0]
    return b, float(((y - x @ b) ** 2).sum()), x


def arma_series(n=700, seed=3):
    rng = np.random.default_rng(seed)
    out = {}
    for g, (phi, theta) in enumerate([((0.6,), ()), ((), (0.8,)), ((0.5, -0.3), (0.6,)), ((0.9,), (-0.5, 0.3))]):
        e, x = rng.normal(size=n), np.zeros(n)
        for t in range(2, n):
            x[t] = sum(p * x[t - 1 - i] for i, p in enumerate(phi)) + e[t] + sum(q * e[t - 1 - i] for i, q in enumerate(theta))
        out[g] = 50 + x
    return out


def frame_of(spark, found):
    rows = [("bj", g, i + 7, float(v)) for g, x in found.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "city string, grid_id long, step long, inflow double")


def test_arma_orders_match_two_regressions(spark):
    found = arma_series()
    got = arma.arma_orders(frame_of(spark, found), "inflow", ["city", "grid_id"], "step")
    table = {(r.grid_id, r.p, r.q): r for r in got.collect()}
    best = {r.grid_id: (r.p, r.q) for r in arma.select_arma(got, ["city", "grid_id"]).collect()}
    for g, x in found.items():
        x = x - x.mean()
        lags = lagged_matrix(x, arma.LONG + 2)
        n = len(lags)
        c, _, _ = least_squares(lags[:, 0], [lags[:, i] for i in range(1, arma.LONG + 1)])
        shock = [lags[:, j] - c[0] - sum(c[i] * lags[:, j + i] for i in range(1, arma.LONG + 1)) for j in (1, 2)]
        scores = {}
        for p in range(4):
            for q in range(3):
                if p + q:
                    b, rss, _ = least_squares(lags[:, 0], [*(lags[:, i] for i in range(1, p + 1)), *shock[:q]])
                    scores[p, q] = n * math.log(rss / n) + 2 * (p + q + 1)
                    r = table[g, p, q]
                    assert r.aic == pytest.approx(scores[p, q], abs=1e-6)
                    np.testing.assert_allclose(r.coef, b, atol=1e-7)
        assert best[g] == min(scores, key=lambda k: (scores[k], k))
    assert len(table) == 4 * 11 and any(q > 0 for _, q in best.values())


def test_lagged_unit_root_matches_least_squares(spark):
    rng = np.random.default_rng(4)
    found = arma_series(500)
    found |= {10: np.cumsum(rng.normal(size=500)), 11: np.cumsum(np.cumsum(rng.normal(size=500))), 12: np.full(500, 3.0)}
    got = {r.grid_id: r for r in arma.unit_root_lagged(frame_of(spark, found), "inflow", ["city", "grid_id"], "step", 6).collect()}
    for g, x in found.items():
        if g == 12:
            continue
        for d in range(3):
            w = np.diff(x, d) if d else x
            change = np.diff(w)
            rows = len(x) - 9  # those of the levels with all lags, whatever d
            y = change[-rows:]
            lag = lambda k: change[len(change) - rows - k : len(change) - k]
            level = w[len(w) - rows - 1 : len(w) - 1]
            fits = []
            for k in range(7):
                b, rss, m = least_squares(y, [level, *(lag(i) for i in range(1, k + 1))])
                se = math.sqrt(rss / (rows - k - 2) * np.linalg.inv(m.T @ m)[1, 1])
                fits.append((rows * math.log(rss / rows) + 2 * (k + 2), b[1] / se, k))
            _, stat, k = min(fits, key=lambda f: f[0])
            if stat < arma.CRITICAL or d == 2:
                break
        r = got[g]
        assert (r.d, r.lags, r.stationary) == (d, k, d == 0 and stat < arma.CRITICAL)
        assert r.stat == pytest.approx(stat, rel=1e-5, abs=1e-6)
    assert got[0].d == 0 and got[11].d == 2 and 12 in got


def test_kmeans_matches_numpy_and_repeats(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(40, 5)) * 4
    x = np.round(centres[rng.integers(0, 40, 1500)] + 0.3 * rng.normal(size=(1500, 5)), 6)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    rows_, found, start = km.kmeans(df, ["id"], F.col("v"), 40)
    again = km.kmeans(df.repartition(7), ["id"], F.col("v"), 40)
    np.testing.assert_allclose(found, again[1], atol=1e-8)
    c = start
    for _ in range(10):
        near = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
        c = np.stack([x[near == i].mean(0) if (near == i).any() else c[i] for i in range(len(c))])
    np.testing.assert_allclose(found, c, atol=1e-6)
    got = rows_.toPandas()
    d = ((x[:, None] - c[None]) ** 2).sum(2)
    assert got.distance.sum() == pytest.approx(d.min(1).sum(), rel=1e-6)
    # as good as numpy seeding over all rows, the best of three
    own = []
    for s in range(3):
        p = km.reduced(x, np.ones(len(x)), 40, s)
        for _ in range(10):
            near = ((x[:, None] - p[None]) ** 2).sum(2).argmin(1)
            p = np.stack([x[near == i].mean(0) if (near == i).any() else p[i] for i in range(len(p))])
        own.append(((x[:, None] - p[None]) ** 2).sum(2).min(1).sum())
    assert got.distance.sum() <= 1.25 * min(own)


def test_kmeans_of_few_and_equal_rows(spark):
    df = spark.createDataFrame([(i, [float(i % 3), 1.0]) for i in range(30)], "id long, v array<double>")
    rows_, found, _ = km.kmeans(df, ["id"], F.col("v"), 500)
    assert len(found) == 3 and rows_.agg(F.sum("distance")).first()[0] == 0
    assert km.kmeans(df.limit(0), ["id"], F.col("v"), 5)[0].count() == 0


def test_group_contributions_add_up(spark):
    df = spark.createDataFrame([(1, 0.5, -1.0, 2.0), (2, 1.0, 0.0, 0.25)], "grid_id long, a double, b double, c double")
    got = ft.group_contributions(df, ["grid_id"], ["a", "b", "c"], {"a": "x", "b": "y", "c": "x"})
    assert rows(got, "grid_id", "feature_group", "contribution") == [(1, "x", 2.5), (1, "y", -1.0), (2, "x", 1.25), (2, "y", 0.0)]


def test_distinct_sketches_are_within_their_error(spark):
    """Union over ranges of days against exact counts: four standard errors."""
    n = 200_000
    h = lambda salt, m: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(m))
    d = spark.range(n).select(h(1, 3).alias("cell"), h(2, 30).alias("day"), h(3, 40_000).alias("route"))
    sketches = profile.distinct_sketches(d, ["cell"], "day", "route")
    assert sketches.count() == 90
    for width in (1, 7, 30):
        week = F.floor(F.col("day") / width)
        exact = {(r.cell, r["range"]): r.n for r in d.groupBy("cell", week.alias("range")).agg(F.count_distinct("route").alias("n")).collect()}
        got = profile.distinct_within(sketches, ["cell"], "day", week).collect()
        assert len(got) == len(exact)
        assert all(abs(r.estimate / exact[r.cell, r["range"]] - 1) < 4 * 1.04 / 2**6 for r in got)


def test_pooled_trees_find_a_rule_that_a_line_cannot(spark):
    rng = np.random.default_rng(2)
    x = rng.uniform(-1, 1, (1200, 3))
    y = np.stack([np.where(x[:, 0] * x[:, 1] > 0, 5.0, -5.0), np.abs(x[:, 2]) * 4], 1)
    rows_ = [(bool(i < 900), a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows_, "is_train boolean, x_a array<double>, y array<double>")
    error = lambda d: {r.h: r.e for r in d.groupBy("h").agg(F.avg(F.abs(F.col("y_hat") - F.col("y"))).alias("e")).collect()}
    line, trees = error(pooled.fit_predict(df, ["x_a"], [1, 2], 3)), error(pooled.fit_predict_trees(df, ["x_a"], [1, 2]))
    assert trees[1] < 0.4 * line[1] and trees[2] < 0.4 * line[2]
    again = pooled.fit_predict_trees(df, ["x_a"], [1, 2])
    assert error(again) == pytest.approx(trees, rel=1e-9)
