import math

import numpy as np
import pandas as pd
import pytest
from conftest import rows
from pyspark.sql import functions as F

from flowspark.functions.geo import BEIJING, NEW_YORK, GridSpec
from flowspark.operators import components as cc
from flowspark.operators import graphs as gp
from flowspark.operators import grid as gr
from flowspark.operators import similarity as sim
from flowspark.operators import transit as tr


@pytest.mark.parametrize("g,n_edges", [(BEIJING, 7812), (NEW_YORK, 484)])
def test_spatial_graph_size_and_weights(spark, g, n_edges):
    e = gp.spatial_graph(spark.range(g.n_cells).withColumnRenamed("id", "grid_id"), g)
    w = sorted({round(r.weight, 3) for r in e.select("weight").distinct().collect()})
    assert e.count() == n_edges and w == [0.411, 0.641]


def test_grid_table(spark):
    d = gr.grid_table(spark, BEIJING).toPandas().set_index("grid_id")
    assert len(d) == 1024
    assert d.loc[0, "lat_max"] == pytest.approx(40.25) and d.loc[0, "lon_min"] == pytest.approx(116.25)
    assert d.loc[1023, "lat_min"] == pytest.approx(39.75) and (d.lon_max - d.lon_min).iloc[5] == pytest.approx(0.015625)
    assert d.area_km2.mean() == pytest.approx(2.32, abs=0.05)


def brute_top(m, k):
    m = np.round(m, 9)
    out = {}
    for i in range(len(m)):
        order = sorted((j for j in range(len(m)) if j != i), key=lambda j: (-m[i, j], j))[:k]
        out[i] = order
    return out


@pytest.mark.parametrize("block_rows", [16, 1024])
def test_cosine_neighbours_exact_with_copies(spark, block_rows):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(150, 6))
    x[:50] = x[0]  # a third are copies
    x[60] = 0.0
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(150), "vec": x.tolist()}), "id long, vec array<double>")
    got = sim.cosine_neighbours(df, 10, block_rows=block_rows).toPandas()
    u = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-8)
    want = brute_top(u @ u.T, 10)
    for i, g in got.sort_values(["src", "weight", "dst"], ascending=[True, False, True]).groupby("src"):
        assert g.dst.tolist() == want[i]
    assert len(got) == 1500
    above = sim.cosine_neighbours(df, None, least=0.5, block_rows=block_rows).count()
    m = np.round(u @ u.T, 9)
    np.fill_diagonal(m, -1)
    assert above == (m > 0.5).sum()


@pytest.mark.parametrize("block_nodes,chunk", [(8, 100), (128, 1440)])
def test_pearson_neighbours_exact(spark, block_nodes, chunk):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 20)) + rng.normal(size=(300, 1))
    x[:, 7] = 3.0
    pdf = pd.DataFrame({"grid_id": np.tile(np.arange(20), 300), "step": np.repeat(np.arange(300) + 77, 20), "inflow": x.ravel()})
    got = sim.pearson_neighbours(spark.createDataFrame(pdf), "inflow", 5, block_nodes=block_nodes, chunk=chunk).toPandas()
    z = (x - x.mean(0)) / (x.std(0) + 1e-8)
    c = z.T @ z / 300
    want = brute_top(c, 5)
    for i, g in got.sort_values(["src", "weight", "dst"], ascending=[True, False, True]).groupby("src"):
        assert g.dst.tolist() == want[i]
    np.testing.assert_allclose(got.weight, c[got.src, got.dst], atol=1e-9)


def clustered(n, dims, groups, seed=4, noise=0.08):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dims))
    return centres[rng.integers(0, groups, n)] + noise * rng.normal(size=(n, dims))


@pytest.mark.parametrize("k,least", [(7, None), (None, 0.97)])
def test_cosine_skips_blocks_of_other_clusters(spark, k, least):
    """Clustered vectors, some of them copies, zero or very short: the same edges from less than half of the blocks."""
    x = clustered(2000, 12, 16)
    x[100:160] = x[100]
    x[200:203], x[203:206] = 0.0, x[203:206] * 1e-8
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(2000), "vec": x.tolist()}), "id long, vec array<double>")
    edges, blocks, pairs = sim.search(sim.unit_rows(df, least), k, 64)
    compared = pairs.agg(F.sum(F.when(F.col("i") == F.col("j"), 1).otherwise(F.col("there").cast("int") + F.col("back").cast("int")))).first()[0]
    assert compared < 0.5 * blocks.count**2 and blocks.count >= 30
    u = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-8)
    m = np.round(u @ u.T, 9)
    got = edges.toPandas()
    if k is None:
        np.fill_diagonal(m, -1)
        assert set(zip(got.src, got.dst, strict=True)) == set(zip(*np.nonzero(m > least), strict=True))
    else:
        want = brute_top(u @ u.T, k)
        for i, g in got.sort_values(["src", "weight", "dst"], ascending=[True, False, True]).groupby("src"):
            assert g.dst.tolist() == want[i]
        assert len(got) == 2000 * k


@pytest.mark.parametrize("k,least", [(5, None), (None, 0.4)])
def test_cosine_blocks_are_not_shuffled_per_pair(spark, monkeypatch, k, least):
    """Vectors without structure meet all others: no block is shuffled for that, and of the k best a row and side send k."""
    n = 900
    monkeypatch.setattr(sim, "SIDE_BYTES", n * 8 * 8 // 3 + 1)
    x = np.random.default_rng(11).normal(size=(n, 8))
    ids = np.arange(n)
    ids[-20:] = ids[:20]  # some ids come twice
    df = spark.createDataFrame(pd.DataFrame({"id": ids, "vec": x.tolist()}), "id long, vec array<double>")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        edges, blocks, _ = sim.search(sim.unit_rows(df, least), k, 32)
        plan = edges._jdf.queryExecution().executedPlan().toString()
        sent = sim.multiplied(blocks, k).count()
        got = edges.toPandas()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "CartesianProduct" in plan and plan.count("Exchange") == (0 if k is None else 1)
    assert blocks.count >= 28 and blocks.sides == 3
    u = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-8)
    m = np.round(u @ u.T, 9)
    m[ids[:, None] == ids[None, :]] = -np.inf
    if k is None:
        r, c = np.nonzero(m > least)
        assert sorted(zip(got.src, got.dst, strict=True)) == sorted(zip(ids[r], ids[c], strict=True)) and sent == len(got)
        return
    assert sent <= n * k * blocks.sides
    for i in range(n - 20):
        near = sorted((-m[r, c], ids[c]) for r in np.flatnonzero(ids == i) for c in range(n))[:k]
        g = got[got.src == i].sort_values(["weight", "dst"], ascending=[False, True])
        assert g.dst.tolist() == [d for _, d in near]
        np.testing.assert_allclose(g.weight, [-w for w, _ in near], atol=2e-9)


def test_cosine_rows_send_k_edges_however_many_sides(spark, monkeypatch):
    """Over vectors of five sides, some of them copies, a row sends its k best once."""
    n, k = 600, 5
    monkeypatch.setattr(sim, "SIDE_BYTES", n * 8 * 8 // 5 + 1)
    x = np.random.default_rng(12).normal(size=(n, 8))
    x[:90] = x[0]
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(n), "vec": x.tolist()}), "id long, vec array<double>")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        edges, blocks, _ = sim.search(sim.unit_rows(df), k, 32)
        sent = sim.multiplied(blocks, k).count()
        got = edges.toPandas()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert blocks.sides == 5 and sent == len(got) == n * k
    u = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-8)
    want = brute_top(u @ u.T, k)
    for i, g in got.sort_values(["src", "weight", "dst"], ascending=[True, False, True]).groupby("src"):
        assert g.dst.tolist() == want[i]


def test_cosine_of_few_none_and_opposite_vectors(spark):
    for x in ([], [[1.0, 0.0]], [[1.0, 0.0], [-1.0, 0.0], [0.0, 0.0]], [[0.0, 0.0]] * 3):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "id long, vec array<double>")
        got = sim.cosine_neighbours(df, 5)
        assert got.count() == len(x) * max(0, len(x) - 1)


def waves(n, steps, seed=8):
    """Daily patterns of a few kinds with noise."""
    rng = np.random.default_rng(seed)
    t = np.arange(steps)[:, None]
    kind = rng.integers(0, 6, n)
    phase = rng.uniform(0, 2 * np.pi, 6)[kind]
    return np.sin(2 * np.pi * t / 48 + phase) + 0.5 * np.sin(2 * np.pi * t / 24 * (1 + kind % 2) + 2 * phase) + 0.1 * rng.normal(size=(steps, n))


@pytest.mark.parametrize("k,least", [(6, None), (None, 0.9)])
def test_pearson_multiplies_few_pairs(spark, k, least):
    n, steps = 160, 480
    x = waves(n, steps)
    x[:, 5] = 1.0
    pdf = pd.DataFrame({"grid_id": np.tile(np.arange(n), steps), "step": np.repeat(np.arange(steps) + 1000, n), "inflow": x.ravel()})
    edges, pairs = sim.pearson_search(spark.createDataFrame(pdf), "inflow", k, least, block_nodes=32, chunk=100)
    share = pairs.count() / (n * (n - 1) / 2)
    print(f"share of pairs multiplied: {share:.3f}")
    assert share < 0.35
    z = (x - x.mean(0)) / (x.std(0) + 1e-8)
    c = np.round(z.T @ z / steps, 9)
    got = edges.toPandas()
    if k is None:
        np.fill_diagonal(c, -1)
        assert set(zip(got.src, got.dst, strict=True)) == set(zip(*np.nonzero(c > least), strict=True))
    else:
        want = brute_top(c, k)
        for i, g in got.sort_values(["src", "weight", "dst"], ascending=[True, False, True]).groupby("src"):
            assert g.dst.tolist() == want[i]
        assert len(got) == n * k


def brute_components(cells, rows_, cols):
    left, label = set(cells), {}
    while left:
        start = min(left)
        stack, seen = [start], {start}
        while stack:
            c = stack.pop()
            for dr in (-1, 0, 1):
                for dc in (-1, 0, 1):
                    r, k = c // cols + dr, c % cols + dc
                    n = r * cols + k
                    if 0 <= r < rows_ and 0 <= k < cols and n in left and n not in seen:
                        seen.add(n)
                        stack.append(n)
        for c in seen:
            label[c] = start
        left -= seen
    return label


@pytest.mark.parametrize("tile", [32, 5, 2])
def test_components_match_flood_fill(spark, tile):
    g = GridSpec("t", 0, 1, 0, 1, 12, 17, 0)
    rng = np.random.default_rng(5)
    data, want = [], set()
    for step, density in enumerate([0.1, 0.3, 0.45, 1.0]):
        cells = np.nonzero(rng.random(g.n_cells) < density)[0].tolist()
        data += [(step, c, float(c)) for c in cells]
        want |= {(step, c, l) for c, l in brute_components(cells, g.rows, g.cols).items()}
    snake = [r * 17 + c for r in range(0, 12, 2) for c in range(17)] + [r * 17 + (16 if r % 4 == 1 else 0) for r in range(1, 12, 2)]
    data += [(9, c, float(c)) for c in snake]
    want |= {(9, c, l) for c, l in brute_components(snake, g.rows, g.cols).items()}
    df = spark.createDataFrame(data, "step long, grid_id long, z double")
    got = cc.label_components(df, ["step"], g, tile=tile)
    assert set(rows(got, "step", "grid_id", "label")) == want
    s = cc.cluster_summary(got, ["step"], g).where("step = 9").first()
    assert s.cell_count == len(snake) and s.max_z == max(snake)


def test_chebyshev_and_propagate_match_matrices(spark):
    rng = np.random.default_rng(4)
    g = GridSpec("t", 0, 1, 0, 1, 3, 4, 0)
    e = gp.spatial_graph(spark.range(12).withColumnRenamed("id", "grid_id"), g)
    norm = gp.sym_normalised(e)
    a = np.zeros((12, 12))
    for r in e.collect():
        a[r.src, r.dst] = r.weight
    d = a.sum(1)
    lap = -a / np.sqrt(np.outer(d, d))
    x = rng.random((5, 12))
    pdf = pd.DataFrame({"step": np.repeat(np.arange(5), 12), "grid_id": np.tile(np.arange(12), 5), "v": x.ravel()})
    df = spark.createDataFrame(pdf)
    got = gp.chebyshev(df, norm, "v", 4).orderBy("step", "grid_id").toPandas()
    t = [x, x @ lap.T]
    for _ in range(2):
        t.append(2 * t[-1] @ lap.T - t[-2])
    for k in range(4):
        np.testing.assert_allclose(got[f"t{k}"].to_numpy().reshape(5, 12), t[k], atol=1e-12)
    one = gp.propagate(df, norm, ["v"]).orderBy("step", "grid_id").toPandas()
    np.testing.assert_allclose(one.v.to_numpy().reshape(5, 12), -x @ lap.T, atol=1e-12)


def test_neighbour_sums_need_one_shuffle(spark):
    e = spark.createDataFrame([(0, 1, 1.0)], "src long, dst long, weight double")
    df = spark.range(100).select((F.col("id") % 10).alias("step"), (F.col("id") % 2).alias("grid_id"), F.lit(1.0).alias("v"))
    out = gp.propagate(df, e, ["v"])
    out.collect()
    final = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    # the written graph's size makes it a broadcast; the flow moves once, by step
    assert final.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in final


def test_propagate_without_broadcasts(spark):
    """The 32 x 32 grid's edges as a shuffled join: same sums, flow moved a bounded number of times."""
    g = GridSpec("t", 0, 1, 0, 1, 32, 32, 0)
    cells = spark.range(1024).withColumnRenamed("id", "grid_id")
    e = gp.sym_normalised(gp.spatial_graph(cells, g))
    df = cells.crossJoin(spark.range(3).withColumnRenamed("id", "step")).withColumn("v", (F.col("grid_id") * 7 + F.col("step")) % 5 * 1.0)
    want = {(r.step, r.grid_id): r.v for r in gp.propagate(df, e, ["v"]).collect()}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = gp.propagate(df, e, ["v"])
        got = {(r.step, r.grid_id): r.v for r in out.collect()}
        plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastExchange" not in plan and plan.count("Exchange hashpartitioning") <= 4
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_transit_graph_renumbers_inside_the_grid(spark):
    data = [
        ("L1", "up", "A", "05:00", 1), ("L1", "up", "B", "05:10", -1), ("L1", "up", "C", "05:20", 2), ("L1", "up", "C", "05:25", 2),
        ("L1", "up", "D", "05:30", 2), ("L1", "up", "E", "05:40", 3), ("L1", "down", "E", "05:01", 3), ("L2", "up", "X", "soon", 5),
    ]
    df = spark.createDataFrame(data, "line string, direction string, station string, first_train string, grid_id long")
    got = {(a, b): (h, w) for a, b, h, w in rows(tr.transit_graph(df), "src", "dst", "hops", "weight")}
    # B is outside, so A and C are neighbours; C and D share a cell
    assert {k: v[0] for k, v in got.items()} == {(1, 2): 1, (2, 1): 1, (1, 3): 3, (3, 1): 3, (2, 3): 1, (3, 2): 1}
    assert got[(1, 3)][1] == pytest.approx(math.exp(-1))


def test_transit_graph_keeps_ten_hops(spark):
    data = [("L", "up", f"S{i:02d}", f"05:{i:02d}", i) for i in range(30)]
    df = spark.createDataFrame(data, "line string, direction string, station string, first_train string, grid_id long")
    got = {(a, b) for a, b in rows(tr.transit_graph(df), "src", "dst")}
    assert got == {(a, b) for a in range(30) for b in range(30) if 0 < abs(a - b) <= 10}
    un = {(a, b) for a, b in rows(tr.transit_graph_unordered(df.withColumn("grid_id", F.col("grid_id") * 2)), "src", "dst")}
    assert un == {(2 * a, 2 * b) for a, b in got}


def test_hub_flag(spark):
    df = spark.createDataFrame([("L1", "A", 1), ("L2", "A", 1), ("L2", "A", 1), ("L1", "B", 2), ("L3", "C", 2), ("L9", "Z", -1)], "line string, station string, grid_id long")
    assert rows(tr.cell_lines(df), "grid_id", "num_subway_lines", "is_transfer_hub") == [(1, 2, 1), (2, 2, 0)]


def test_adjacency_checks(spark):
    e = spark.createDataFrame([(0, 0, 1.0), (1, 1, 1.0), (0, 1, 0.5), (1, 0, 0.2), (2, 1, 0.9)], "src int, dst int, weight double")
    r = gp.adjacency_checks(e).first()
    assert r.max_asymmetry == pytest.approx(0.9) and (r.n_unit_diagonal, r.n_diagonal, r.n_edges) == (2, 2, 5)


def test_point_edges_and_boxes_match_brute_force(spark):
    from flowspark.functions import geo

    g = BEIJING
    rng = np.random.default_rng(8)
    pts = pd.DataFrame({"id": np.arange(60), "lon": rng.uniform(116.2, 116.8, 60), "lat": rng.uniform(39.7, 40.3, 60)})
    df = spark.createDataFrame(pts)
    got = set(rows(gr.point_cell_edges(df, g, "id", 1.0).where("edge_type = 'poi_inf_grid'"), "poi", "grid_id"))
    grid = gr.grid_table(spark, g)
    near = df.crossJoin(grid).withColumn("km", geo.haversine_km(F.col("lon"), F.col("lat"), F.col("center_lon"), F.col("center_lat")))
    home = geo.cell_id(F.col("lon"), F.col("lat"), g)
    want = set(rows(near.where(home >= 0).where((F.col("km") <= 1.0) | (home == F.col("grid_id"))), "id", "grid_id"))
    assert got == want
    cells = spark.createDataFrame(
        pd.DataFrame({"cell": np.arange(40), "lon_min": rng.uniform(116.2, 116.7, 40), "lat_min": rng.uniform(39.7, 40.2, 40)})
    ).withColumns({"lon_max": F.col("lon_min") + 0.13, "lat_max": F.col("lat_min") + 0.04})
    got = rows(gr.cells_containing(df, cells, "id", 0.05, salts=3))
    c = cells.toPandas()
    for i, cell in got:
        p = pts.loc[i]
        hit = c[(c.lon_min <= p.lon) & (p.lon < c.lon_max) & (c.lat_min <= p.lat) & (p.lat < c.lat_max)].cell
        assert cell == (hit.min() if len(hit) else -1)


def brute_boxes(x, y, boxes):
    hit = (boxes[:, 0] <= x[:, None]) & (x[:, None] < boxes[:, 1]) & (boxes[:, 2] <= y[:, None]) & (y[:, None] < boxes[:, 3])
    return np.where(hit.any(1), hit.argmax(1), len(boxes))


@pytest.mark.parametrize("digits", [15, 1])
def test_first_boxes(digits):
    """Also on points and boxes that share their sides; 4 x 10^10 pairs are never looked at one by one."""
    rng = np.random.default_rng(5)
    for n, m in ((1, 1), (3, 40), (64, 20), (700, 300)):
        x, y, lo, width = rng.uniform(0, 1, n), rng.uniform(0, 1, n), rng.uniform(-0.1, 1, (m, 2)), rng.uniform(0, 0.2, (m, 2))
        boxes = np.round(np.stack([lo[:, 0], lo[:, 0] + width[:, 0], lo[:, 1], lo[:, 1] + width[:, 1]], 1), digits)
        x, y = np.round(x, digits), np.round(y, digits)
        assert gr.first_boxes(x, y, boxes).tolist() == brute_boxes(x, y, boxes).tolist()
    n = 200_000
    x, lo = rng.uniform(0, 1, n), rng.uniform(0, 0.1, n)
    got = gr.first_boxes(x, x[::-1].copy(), np.stack([lo, lo + 0.9, lo, lo + 0.9], 1)[::-1])
    assert (got < n).mean() > 0.8


@pytest.mark.parametrize("group", [100_000, 30])
def test_boxes_of_crowded_bins(spark, monkeypatch, group):
    """Bins that boxes hold whole or cut, spread over groups or not; ids and cells that repeat or are null."""
    monkeypatch.setattr(gr, "GROUP", group)
    rng = np.random.default_rng(6)
    n, m = 500, 200
    pts = [(int(i) if i % 50 else None, float(a), float(b)) for i, (a, b) in enumerate(rng.uniform(0, 1, (n, 2)))]
    pts += [(7, 0.5, 0.5), (7, 5.0, 5.0), (n, 0.25, 0.25), (n + 1, None, 0.5), (n + 2, float("nan"), 0.5), (n + 3, 9.0, 9.0)]
    lo, width = rng.uniform(-0.1, 1, (m, 2)), np.where(np.arange(m) % 40 == 39, 0.6, rng.uniform(0, 0.15, m))
    cells = [(int(c) % 150 if c % 30 else None, *map(float, (a, a + w, b, b + w))) for c, ((a, b), w) in enumerate(zip(lo, width, strict=True))]
    cells += [(500, 0.25, 0.5, 0.25, 0.5), (501, 0.9, 0.1, 0.0, 1.0)]
    df = spark.createDataFrame(pts, "id long, lon double, lat double")
    boxes = spark.createDataFrame(cells, "cell long, lon_min double, lon_max double, lat_min double, lat_max double")
    first = {}
    for i, x, y in pts:
        held = [c for c, a, b, d, e in cells if i is not None and c is not None and x is not None and a <= x < b and d <= y < e]
        first.setdefault(i, []).extend(held)
    want = sorted(((i, min(first[i], default=-1)) for i, *_ in pts), key=str)
    assert sorted(map(tuple, gr.cells_containing(df, boxes, "id", 0.25, salts=3).collect()), key=str) == want
