import math

import numpy as np
from pyspark.sql import functions as F

from flowspark.llm import ann
from flowspark.session import cut_lineage


def brute(rows, k=5):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and len(v) == 16 and all(x is not None and math.isfinite(x) for x in v) and any(v):
            good[i] = np.array(v, np.float32).astype(float)
    ids = np.array(sorted(good))
    if not len(ids):
        return {}
    x = np.stack([good[i] for i in ids.tolist()])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for at, q in enumerate(ids.tolist()):
        if q % 50 == 0:
            s = x @ x[at]
            order = [j for j in np.lexsort((ids, -np.round(s, 12))) if j != at][:k]
            out[q] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def table(n, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 16)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    hot = x[3].tolist()
    rows += [(n + i, hot) for i in range(n // 2)]  # a third of all rows is one vector
    rows += [(10**6, None), (10**6 + 50, [0.0] * 16), (10**6 + 100, [float("nan")] * 16), (10**6 + 150, [1.0] * 15), (10**6 + 200, [None] * 16), (10**6 + 250, [float("inf")] * 16), (None, hot), (5, x[5].tolist())]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 0.5) for i, v in rows], "vec_id long, embedding array<float>, rank int, score double").repartition(4)


def recall(spark, rows, plan):
    got = {}
    for r in ann.search(frame(spark, rows), F.col("vec_id") % 50 == 0, plan=plan).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = brute(rows)
    assert set(got) == set(want)
    hits = total = 0
    for q, best in want.items():
        mine = sorted(got[q])
        assert [m[0] for m in mine] == list(range(1, len(best) + 1))
        assert all(a[2] >= b[2] - 1e-12 for a, b in zip(mine, mine[1:], strict=False))
        hits += len({m[1] for m in mine} & {b[0] for b in best})
        total += len(best)
        scores = dict(best)
        assert all(abs(scores[m[1]] - m[2]) < 1e-9 for m in mine if m[1] in scores)
    return hits / total


def test_all_leaves_give_the_exact_answer(spark):
    assert recall(spark, table(900), ann.Plan(leaf=40, probes=10_000, sample=300)) == 1


def test_recall_with_few_leaves(spark):
    # leaves go on below the sample: 150 sampled rows, 1,800 different vectors
    plan = ann.Plan(leaf=30, probes=120, sample=150, least=20)
    assert recall(spark, table(1800, 1), plan) >= 0.9


def test_leaves_and_queue_agree():
    x = ann.unit(np.random.default_rng(3).normal(size=(500, 8)))
    forest = ann.Forest(x[:100], 500, ann.Plan(leaf=10, probes=1, least=16))
    assert forest.levels > 0
    x = x[100:]  # sampled rows lie on the cuts themselves
    own, first = forest.leaves(x), forest.nearest(x)
    assert all(f[0] in o for f, o in zip(first, own.tolist(), strict=True))


def test_leaves_follow_the_recall_not_a_constant(spark):
    # about 6,000 leaves of vectors without structure: 448 of them hold few of the neighbours
    assert recall(spark, table(6000, 2), ann.Plan(leaf=4, sample=500, asked=32)) >= 0.9


def test_few_leaves_on_vectors_with_structure(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(60, 16))
    x = (centres[rng.integers(60, size=6000)] + rng.normal(size=(6000, 16)) * 0.05).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    plan = ann.Plan(leaf=20, sample=2000, asked=40)
    kept = cut_lineage(ann.distinct_vectors(ann.vectors(frame(spark, rows), "vec_id", "embedding"), 6))
    queries = kept.select(F.get("ids", F.lit(0)).alias("vec_id"), "v").where("vec_id % 50 = 0")
    forest = ann.fit(kept, plan)
    needed = ann.leaves_needed(kept, queries, forest, 6000, 5, "bigint")
    assert needed is not None and needed < (len(forest.means) << forest.levels) / 10
    assert recall(spark, rows, plan) >= 0.9


def test_places_are_those_of_the_queue():
    x = ann.unit(np.random.default_rng(4).normal(size=(600, 8)))
    forest = ann.Forest(x[:100], 500, ann.Plan(leaf=10, probes=10_000, least=16))
    assert forest.levels > 0
    q, near = x[100:110], [x[200 + 20 * i : 220 + 20 * i] for i in range(10)]
    for order, rows, place in zip(forest.nearest(q), near, forest.places(q, near), strict=True):
        at = {leaf: i + 1 for i, leaf in enumerate(order)}
        # the query's own leaves, one a tree, come out at once
        assert [max(4, min(at[c] for c in own)) for own in forest.leaves(rows).tolist()] == place.tolist()


def test_small_tables(spark):
    assert ann.search(frame(spark, []), F.col("vec_id") % 50 == 0).count() == 0
    assert ann.search(frame(spark, [(0, [1.0, 2.0])]), F.col("vec_id") % 50 == 0).count() == 0
    got = ann.search(frame(spark, [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [2.0, 1.0])]), F.col("vec_id") % 50 == 0).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in sorted(got, key=lambda r: r.rank)] == [(0, 1, 1), (0, 2, 2)]


def test_exact_compares_all_rows(spark):
    assert recall(spark, table(900, 7), ann.Plan(exact=True)) == 1


def test_hot_groups_in_many_parts(spark):
    """Groups cut by queries and by rows give what whole groups give."""
    rows = table(900, 8)
    assert recall(spark, rows, ann.Plan(leaf=10, probes=10_000, sample=300, group=100, meet=3)) == 1


def test_vectors_of_one_direction_tie(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(1000 + i, (x[0] * f).tolist()) for i, f in enumerate([3.0, 1.7, 1 / 3, 1e-3, 7e4, 0.9, 11.0])]
    df = spark.createDataFrame([(i, v) for i, v in rows], "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in ann.search(df, F.col("vec_id").isin(0, 1000, 1003, 7)).collect()}
    assert [got[0, r][0] for r in range(1, 6)] == [1000, 1001, 1002, 1003, 1004]
    assert [got[1000, r][0] for r in range(1, 6)] == [0, 1001, 1002, 1003, 1004]
    assert [got[1003, r][0] for r in range(1, 6)] == [0, 1000, 1001, 1002, 1004]
    assert all(abs(got[0, r][1] - 1) < 1e-12 for r in range(1, 6))


def test_the_query_goes_through_the_forest(spark, monkeypatch):
    """At sf0.01: all queries search leaves; only those asked in advance are compared with all rows."""
    from flowspark.llm.queries import QUERIES

    seen = {"groups": 0, "blocks": []}
    groups, blocks = ann.in_groups, ann.in_blocks
    monkeypatch.setattr(ann, "in_groups", lambda kept, queries, forest, kind: (seen.update(groups=queries.count(), leaves=forest.probes), groups(kept, queries, forest, kind))[1])
    monkeypatch.setattr(ann, "in_blocks", lambda kept, queries, n, *a: (seen["blocks"].append(queries.count()), blocks(kept, queries, n, *a))[1])
    assert QUERIES["op4_neighbours"](spark, "/root/testdata/sf0.01").count() == 50
    assert seen["groups"] == 10 and seen["leaves"] >= 1 and seen["blocks"] == [10]
