import numpy as np
import pytest

from flowspark.llm import vantage

KIND = "vec_id long, embedding array<float>, cluster int, v string"


def brute(rows, k, rounds, seed, dims, scale):
    """Lloyd's rounds in Python integers."""
    import math
    from hashlib import sha256

    good = []
    for i, v in rows:
        if v is not None and len(v) == dims and all(c is not None and math.isfinite(c) for c in v):
            good.append((i, [math.floor(scale * float(np.float32(c))) for c in v]))
    first = sorted((sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in good if i is not None)[:k]
    centres = [v for _, v in first]
    d2 = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v: min((d2(v, c), n) for n, c in enumerate(centres))
    for _ in range(rounds):
        own = [[] for _ in centres]
        for _, v in good:
            own[nearest(v)[1]].append(v)
        centres = [[sum(x) // len(x) for x in zip(*o, strict=True)] if o else c for o, c in zip(own, centres, strict=True)]
    return [(i, nearest(v)[1], nearest(v)[0]) for i, v in good], centres


def test_clusters_equal_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=4).round(2).tolist()) for i in range(300)]
    rows += [(400 + i, rows[0][1]) for i in range(30)]  # one vector many times
    rows += [(500, None), (501, []), (502, [1.0, 2.0, 3.0]), (503, [1.0, None, 0.0, 0.0]), (504, [float("nan"), 0.0, 0.0, 0.0]), (505, [float("inf"), 0.0, 0.0, 0.0])]
    rows += [(None, [0.0, 0.0, 0.0, 0.0]), (7, rows[7][1]), (7, [9.0, 9.0, 9.0, 9.0]), (506, [-0.0001, 0.0, -5.5, 1e3])]
    df = spark.createDataFrame([(i, v, 5, "clash") for i, v in rows], KIND)
    for k, rounds in ((8, 10), (3, 1), (1, 2), (40, 4), (5, 0)):
        members, found = vantage.cluster(df, k=k, rounds=rounds, seed=3, dims=4, scale=16)
        want, centres = brute(rows, k, rounds, 3, 4, 16)
        key = lambda t: (t[0] is None, t[0] or 0, t[1:])
        assert sorted((tuple(r) for r in members.collect()), key=key) == sorted(want, key=key)
        rest = {r.cluster: r for r in found.collect()}
        assert [rest[c].centroid for c in range(len(centres))] == centres
        assert sum(r.size for r in rest.values()) == len(want)
        assert sum(r.cluster_inertia for r in rest.values()) == sum(d for _, _, d in want)


def test_tree_finds_the_nearest_and_the_smaller_number_on_ties():
    rng = np.random.default_rng(1)
    for k, dims, high in ((1, 2, 5), (2, 1, 2), (50, 2, 6), (300, 3, 9), (200, 64, 1000)):
        centres = rng.integers(-high, high + 1, (k, dims))  # many equal centroids and equal distances
        x = rng.integers(-2 * high, 2 * high + 1, (1000, dims))
        number, best, _ = vantage.Tree.build(centres).nearest(x)
        d = ((x[:, None, :] - centres[None]) ** 2).sum(2)
        assert (best == d.min(1)).all() and (number == d.argmin(1)).all()


def test_tree_prunes_on_clustered_centroids():
    rng = np.random.default_rng(2)
    groups = rng.integers(-(10**6), 10**6, (32, 16))
    centres = np.concatenate([g + rng.integers(-100, 100, (32, 16)) for g in groups])
    x = centres[rng.integers(0, len(centres), 2000)] + rng.integers(-50, 50, (2000, 16))
    number, _, seen = vantage.Tree.build(centres).nearest(x)
    assert (number == ((x[:, None, :] - centres[None]) ** 2).sum(2).argmin(1)).all()
    assert seen < 0.25 * len(x) * len(centres)


def test_large_integers_are_exact():
    centres = np.array([[vantage.LARGEST] * 64, [vantage.LARGEST - 1] + [vantage.LARGEST] * 63])
    number, best, _ = vantage.Tree.build(centres).nearest(np.array([[-vantage.LARGEST] * 64]))
    assert number[0] == 1 and int(best[0]) == 63 * (2 * vantage.LARGEST) ** 2 + (2 * vantage.LARGEST - 1) ** 2


def test_components_out_of_range_end_the_job(spark):
    df = spark.createDataFrame([(1, [3e38, 0.0])], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="beyond"):
        vantage.cluster(df, dims=2)


def test_fewer_rows_than_centroids_and_none(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<double>")
    members, found = vantage.cluster(df, k=8, dims=2)
    assert {r.vec_id: r.distance for r in members.collect()} == {1: 0, 2: 0} and found.count() == 2
    members, found = vantage.cluster(df.limit(0), dims=2)
    assert members.count() == 0 and found.count() == 0
