"""Approximate nearest neighbours by cosine: a forest of random-projection trees.

The trees are fitted on a bounded sample (``Forest.sample`` rows, chosen by a hash of the id): a
node splits its sample at the median of a projection on the difference of two of its vectors.
Where the table needs smaller leaves than the sample can show, a fitted leaf goes on for as many
levels as it takes with hyperplanes through its sample's mean. Every row of the table is put into
one leaf of every tree. A query walks all trees at once: one priority queue holds the nodes of all
of them by the squared distance to the hyperplanes on the wrong side, and the first leaves to come
out are searched. Leaves are searched where their rows lie, in double precision on the original
vectors; only the best of each leaf travel on.

How many leaves follows from the data at every run: ``Plan.asked`` queries, chosen by a hash of the
id, are compared with all rows, and as many leaves are searched as bring ``Plan.recall`` of the
neighbours found there. This holds for tables of any size; a small one is a forest of few leaves.
``Plan.exact`` leaves the forest out and compares all queries with all rows in blocks.

Neighbouring leaves of one tree form a group. A row goes to the groups of its leaves, a query once to each group
in which it searches leaves, with their list, so a query travels once for many leaves. Groups
that more than ``Plan.meet`` queries search, or that hold many more rows than others, are dealt to
several tasks. In a task the queries of a group are held and its rows pass by, leaf after leaf.

Vectors of one direction are searched as one, which carries the smallest ids of its rows: k + 1 of
them, and no query can use more, as they are equally near and ties go to the smaller id. The
candidates left, some more than k, are scored again on the original vectors, each by one sum in the order of the
components, so a score does not depend on what else a task holds; scores equal in twelve digits tie.

A vector takes part if it is not null, has the length of most vectors, no null or non-finite
component, and is not zero; so does an id that is not null. Repeated rows of one id are one row; if
their vectors differ, its nearest one counts. An empty table, or one row, gives no result. Further columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowspark.session import cut_lineage


@dataclass(frozen=True)
class Plan:
    trees: int = 4
    leaf: int = 200  # rows a leaf, about
    probes: int | None = None  # leaves a query, over all trees; None: as many as the recall takes
    recall: float = 0.95  # of the neighbours of the queries that are asked in advance
    asked: int = 256  # queries that are compared with all rows to choose the leaves
    exact: bool = False  # compare all rows instead of searching the forest
    group: int = 32  # leaves that are searched in one task
    meet: int = 4096  # queries that meet a group in one task, about
    spare: int = 4  # candidates beyond those needed that are scored again
    sample: int = 20_000  # rows that the trees are fitted on
    least: int = 16  # sampled rows of a fitted leaf, at least
    seed: int = 11


class Forest:
    """Nodes of all trees in arrays; a child below 0 is a leaf, numbered from -1 on."""

    def __init__(self, x: np.ndarray, rows: int, plan: Plan):
        self.plan, self.probes = plan, plan.probes
        rng = np.random.default_rng(plan.seed)
        most = max(plan.least, int(plan.leaf * len(x) / max(rows, 1)))
        directions, cuts, children, self.roots, means = [], [], [], [], []

        def grow(own: np.ndarray) -> int:
            if len(own) > most:
                for _ in range(3):
                    a, b = x[rng.choice(own, 2, replace=False)]
                    d = a - b
                    length = np.linalg.norm(d)
                    if length == 0:
                        continue
                    p = x[own] @ (d / length)
                    cut = float(np.median(p))
                    left = p <= cut
                    if left.all():
                        continue
                    at = len(directions)
                    directions.append(d / length)
                    cuts.append(cut)
                    children.append((0, 0))
                    children[at] = (grow(own[left]), grow(own[~left]))
                    return at
            means.append(x[own].mean(0))
            return -len(means)

        tree: list[int] = []
        for t in range(plan.trees):
            self.roots.append(grow(np.arange(len(x))))
            tree += [t] * (len(means) - len(tree))
        self.tree = np.array(tree)  # of each fitted leaf
        self.directions = np.array(directions).reshape(-1, x.shape[1])
        self.cuts, self.children = np.array(cuts), np.array(children, np.int64).reshape(-1, 2)
        self.means = np.array(means)
        per_leaf = rows * plan.trees / len(means)
        self.levels = max(0, ceil(log2(per_leaf / plan.leaf) - 0.5)) if per_leaf > plan.leaf else 0
        more = rng.normal(size=(self.levels, x.shape[1]))
        self.more = more / np.maximum(np.linalg.norm(more, axis=1, keepdims=True), 1e-12)
        self.more_cuts = self.means @ self.more.T

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row of unit vectors in each tree."""
        out = np.empty((len(x), len(self.roots)), np.int64)
        bits = x @ self.more.T
        for t, root in enumerate(self.roots):
            at = np.full(len(x), root)
            while (inner := np.flatnonzero(at >= 0)).size:
                node = at[inner]
                side = np.einsum("ij,ij->i", x[inner], self.directions[node]) > self.cuts[node]
                at[inner] = self.children[node, side.astype(int)]
            leaf = -at - 1
            code = leaf << self.levels
            for k in range(self.levels):
                code |= (bits[:, k] > self.more_cuts[leaf, k]).astype(np.int64) << k
            out[:, t] = code
        return out

    def groups(self, code: np.ndarray) -> np.ndarray:
        """The group of each leaf: neighbouring leaves of one tree, so that no row is twice in a group."""
        return (self.tree[code >> self.levels].astype(np.int64) << 48) + code // self.plan.group

    def nearest(self, x: np.ndarray) -> list[list[int]]:
        """The leaves that each query searches, by one priority queue over all trees."""
        side = (x @ self.directions.T - self.cuts).tolist()
        bits = x @ self.more.T
        children = self.children.tolist()
        out = []
        for q in range(len(x)):
            heap = [(0.0, root, 0, 0) for root in self.roots]
            heapq.heapify(heap)
            found: list[int] = []
            own = side[q]
            while heap and len(found) < self.probes:
                far, node, level, code = heapq.heappop(heap)
                if node >= 0:
                    m = own[node]
                    low, high = children[node]
                    near, other = (high, low) if m > 0 else (low, high)
                    heapq.heappush(heap, (far, near, 0, 0))
                    heapq.heappush(heap, (far + m * m, other, 0, 0))
                elif level < self.levels:
                    m = float(bits[q, level] - self.more_cuts[-node - 1, level])
                    bit = int(m > 0)
                    heapq.heappush(heap, (far, node, level + 1, code | bit << level))
                    heapq.heappush(heap, (far + m * m, node, level + 1, code | (1 - bit) << level))
                else:
                    found.append(((-node - 1) << self.levels) | code)
            out.append(found)
        return out

    def places(self, x: np.ndarray, near: list[np.ndarray]) -> list[np.ndarray]:
        """For each query the number of leaves that come out up to the first with each of its ``near`` rows."""
        side = x @ self.directions.T - self.cuts
        bits = x @ self.more.T
        inner, fitted = np.zeros(side.shape), np.zeros((len(x), len(self.means)))
        for node, kids in enumerate(self.children.tolist()):  # a node comes before its children
            m = side[:, node]
            for kid, wrong in zip(kids, (m > 0, m <= 0), strict=True):
                (inner if kid >= 0 else fitted)[:, kid if kid >= 0 else -kid - 1] = inner[:, node] + np.where(wrong, m * m, 0)
        out = []
        step = max(1, 1_000_000 >> self.levels)
        for q, rows in enumerate(near):
            gap = bits[q] - self.more_cuts
            code = self.leaves(rows)
            leaf = code >> self.levels
            far = fitted[q, leaf]
            for k in range(self.levels):
                g = gap[leaf, k]
                far = far + np.where((g > 0) != (code >> k & 1), g * g, 0)
            far = far.min(1)
            place = np.zeros(len(rows), np.int64)
            for s in range(0, len(self.means), step):
                own, every = gap[s : s + step], fitted[q, s : s + step, None]
                for k in range(self.levels):
                    g = own[:, k, None]
                    every = np.concatenate([every + np.where(g > 0, g * g, 0), every + np.where(g > 0, 0, g * g)], axis=1)
                place += np.searchsorted(np.sort(every, axis=None), far, "right")
            out.append(place)
        return out


def matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    """At length 1; scaled first, so that squares neither overflow nor vanish. Each row by itself."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def vectors(table: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """The rows that take part: vec_id and ``v`` (doubles)."""
    v = F.col(vector).cast("array<double>")
    sound = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0)
    rows = table.select(F.col(vec_id).alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & sound)
    usual = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.where(F.size("v") == (usual[0]["n"] if usual else 0))


def directions(rows: DataFrame) -> DataFrame:
    """Adds ``d``: the vector at length 1, in twelve digits."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v = matrix(b.column(1))
                d = np.round(unit(v), 12) + 0.0
                size = pa.array(np.arange(0, d.size + 1, d.shape[1]), pa.int32())
                yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(size, pa.array(d.ravel()))], ["vec_id", "v", "d"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.select("vec_id", "v").mapInArrow(run, f"vec_id {kind}, v array<double>, d array<double>")


def distinct_vectors(rows: DataFrame, keep: int, salts: int = 64) -> DataFrame:
    """Different directions ``v`` with ``ids``, the ``keep`` smallest ids of their rows."""
    salt = F.pmod(F.xxhash64("vec_id"), F.lit(salts))
    some = directions(rows).select(F.col("d").alias("v"), "vec_id", salt.alias("salt"))
    for part in (["v", "salt"], ["v"]):
        some = some.withColumn("_r", F.dense_rank().over(Window.partitionBy(*part).orderBy("vec_id"))).where(F.col("_r") <= keep).drop("_r")
    return some.groupBy("v").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"))


def fit(rows: DataFrame, plan: Plan) -> Forest | None:
    """The forest of the different vectors ``rows``."""
    n = rows.count()
    if n == 0:
        return None
    place = F.abs(F.xxhash64("v", F.lit(plan.seed))) / float(2**63)
    taken = rows.where(place < min(1.0, plan.sample / n)).select("v").collect() or rows.select("v").limit(1).collect()
    x = unit(np.array(sorted(tuple(r.v) for r in taken)))
    return Forest(x, n, plan)


PACKED = "grp long, salt int, leaf long, is_row boolean, query {kind}, ids array<{kind}>, v array<double>, leaves array<long>"


def in_groups(kept: DataFrame, queries: DataFrame, forest: Forest, kind: str) -> DataFrame:
    """Rows and queries by the groups of leaves that hold and search them."""
    plan = forest.plan

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 2048):
                part = b.slice(i, 2048)
                code = forest.leaves(unit(matrix(part.column(1))))
                for t in range(code.shape[1]):
                    yield pa.RecordBatch.from_arrays([pa.array(forest.groups(code[:, t])), pa.array(code[:, t]), part.column(0), part.column(1)], ["grp", "leaf", "ids", "v"])

    def held(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of each group, counted per task."""
        total: dict[int, int] = {}
        for b in batches:
            for i in range(0, b.num_rows, 2048):
                own, n = np.unique(forest.groups(forest.leaves(unit(matrix(b.column(0).slice(i, 2048))))), return_counts=True)
                for g, c in zip(own.tolist(), n.tolist(), strict=True):
                    total[g] = total.get(g, 0) + c
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["grp", "n"])

    def probe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 64):
                part = b.slice(i, 64)
                who, groups, leaves = [], [], []
                for q, found in enumerate(forest.nearest(unit(matrix(part.column(1))))):
                    by: dict[int, list[int]] = {}
                    for code, g in zip(found, forest.groups(np.array(found, np.int64)).tolist(), strict=True):
                        by.setdefault(g, []).append(code)
                    who += [q] * len(by)
                    groups += by
                    leaves += by.values()
                at = pa.array(who, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(groups, pa.int64()), part.column(0).take(at), part.column(1).take(at), pa.array(leaves, pa.list_(pa.int64()))], ["grp", "query", "v", "leaves"])

    probes = cut_lineage(queries.mapInArrow(probe, f"grp long, query {kind}, v array<double>, leaves array<long>"))
    rows_of = kept.select("v").mapInArrow(held, "grp long, n long").groupBy("grp").agg(F.sum("n").alias("n"))
    # a group is cut by queries and by rows: part (i, j) has the i-th share of its queries and the j-th of its rows
    usual = plan.leaf * plan.group
    parts = probes.groupBy("grp").agg(F.ceil(F.count("*") / plan.meet).cast("int").alias("by_query")).join(rows_of, "grp")
    parts = parts.select("grp", "by_query", F.greatest(F.lit(1), F.round(F.col("n") / (4 * usual))).cast("int").alias("by_row"))
    part = lambda i, j: (i * F.col("by_row") + j).cast("int").alias("salt")
    each = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    x = kept.select("ids", "v").mapInArrow(place, f"grp long, leaf long, ids array<{kind}>, v array<double>").join(parts, "grp")
    x = x.withColumn("i", F.explode(each("by_query"))).select(
        "grp", part(F.col("i"), F.pmod(F.xxhash64("ids"), F.col("by_row"))), "leaf", F.lit(True).alias("is_row"), F.lit(None).cast(kind).alias("query"), "ids", "v", F.lit(None).cast("array<bigint>").alias("leaves")
    )
    y = probes.join(parts, "grp").withColumn("j", F.explode(each("by_row"))).select(
        "grp", part(F.pmod(F.xxhash64("query"), F.col("by_query")), F.col("j")), F.lit(None).cast("bigint").alias("leaf"), F.lit(False).alias("is_row"), "query", F.lit(None).cast(f"array<{kind}>").alias("ids"), "v", "leaves"
    )
    return x.unionByName(y)


def in_blocks(kept: DataFrame, queries: DataFrame, n: int, n_queries: int, kind: str, most: int = 16_384, least: int = 256) -> DataFrame:
    """Every block of queries with every part of the ``n`` rows, a part about as large as a block."""
    blocks = max(1, ceil(n_queries / most))
    parts = max(1, ceil(n / max(least, ceil(n_queries / blocks))))
    block, part = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)), F.pmod(F.xxhash64("v"), F.lit(parts))

    def each(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    x = kept.select("ids", "v", part.alias("part"), each(blocks).alias("block"))
    y = queries.select("vec_id", "v", block.alias("block"), each(parts).alias("part"))
    grp = (F.col("block") * parts + F.col("part")).cast("long").alias("grp")
    one, salt = F.lit(0).cast("long"), F.lit(0).alias("salt")  # a block is searched as one leaf
    x = x.select(grp, salt, one.alias("leaf"), F.lit(True).alias("is_row"), F.lit(None).cast(kind).alias("query"), "ids", "v", F.lit(None).cast("array<bigint>").alias("leaves"))
    return x.unionByName(y.select(grp, salt, F.lit(None).cast("bigint").alias("leaf"), F.lit(False).alias("is_row"), F.col("vec_id").alias("query"), F.lit(None).cast(f"array<{kind}>").alias("ids"), "v", F.array(one).alias("leaves")))


def best_of(both: DataFrame, keep: int, kind: str) -> DataFrame:
    """The ``keep`` best different vectors of each query (query, ids, score) among the rows that it meets."""
    # the queries of a group come first and stay; its rows pass by, leaf after leaf
    dealt = both.repartition("grp", "salt").sortWithinPartitions("grp", "salt", "is_row", "leaf")
    found = dealt.mapInArrow(lambda batches: searched(batches, keep), f"query {kind}, ids array<{kind}>, score double")
    best = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.get("ids", F.lit(0))))
    return found.dropDuplicates(["query", "ids"]).withColumn("_best", best).where(F.col("_best") <= keep).drop("_best")


def leaves_needed(kept: DataFrame, queries: DataFrame, forest: Forest, n: int, k: int, kind: str) -> int:
    """Leaves that bring ``Plan.recall`` of the true neighbours of some queries."""
    plan = forest.plan
    asked = cut_lineage(queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(plan.asked))
    true = best_of(in_blocks(kept, asked, n, plan.asked, kind), k + 1, kind).join(kept.select("ids", "v"), "ids")
    found: dict = {r.vec_id: (r.v, []) for r in asked.collect()}
    for r in true.collect():
        found[r["query"]][1].append(r)
    found = {q: f for q, f in found.items() if f[1]}
    near = [unit(np.array([r.v for r in rows])) for _, rows in found.values()]
    places = forest.places(unit(np.array([v for v, _ in found.values()])), near)
    need = []
    for (q, (_, rows)), place in zip(found.items(), places, strict=True):
        own = sorted((-r.score, i, int(p)) for r, p in zip(rows, place, strict=True) for i in r.ids if i != q)
        need += [p for _, _, p in own[:k]]
    return sorted(need)[max(0, ceil(plan.recall * len(need)) - 1)] if need else len(forest.roots)


def scored(pairs: DataFrame) -> DataFrame:
    """query, vec_id and the cosine of ``q`` and ``v``, each by a sum over its own row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (matrix(b.column(i)) for i in (2, 3))
                x, y = (v / np.abs(v).max(1, keepdims=True) for v in (x, y))
                score = (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score)], ["query", "vec_id", "score"])

    kind = pairs.schema["vec_id"].dataType.simpleString()
    return pairs.select("query", "vec_id", "q", "v").mapInArrow(run, f"query {kind}, vec_id {kind}, score double")


def search(table: DataFrame, is_query: Column, k: int = 5, plan: Plan | None = None, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The ``k`` nearest rows found for every row where ``is_query`` (over vec_id) holds.

    query_id, rank (from 1), vec_id, score (cosine); the row itself is no candidate.
    """
    plan = plan or Plan()
    rows = vectors(table, vec_id, vector)
    kept = cut_lineage(distinct_vectors(rows, k + 1))
    queries = cut_lineage(directions(rows.where(is_query)).select("vec_id", F.col("d").alias("v"), F.col("v").alias("q")).dropDuplicates(["vec_id"]))
    kind = rows.schema["vec_id"].dataType.simpleString()
    n = kept.count()
    if n == 0:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    asking = queries.select("vec_id", "v")
    if plan.exact:
        both = in_blocks(kept, asking, n, asking.count(), kind)
    else:
        forest = fit(kept, plan)
        if plan.probes is None:
            forest.probes = leaves_needed(kept, asking, forest, n, k, kind)
        both = in_groups(kept, asking, forest, kind)
    # the k + 1 best directions hold the k best rows: the query's own is one row of one of them
    few = cut_lineage(best_of(both, k + 1 + plan.spare, kind).select("query", F.explode("ids").alias("vec_id")).where("vec_id <> query"))
    near = few.join(rows, "vec_id").join(queries.select(F.col("vec_id").alias("query"), "q"), "query")
    near = scored(near).groupBy("query", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.round("score", 12).desc(), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("query").alias("query_id"), "rank", "vec_id", "score")


def searched(batches: Iterable[pa.RecordBatch], keep: int, block: int = 512) -> Iterator[pa.RecordBatch]:
    """For each group's queries their ``keep`` best rows; ties go to the smaller first id."""
    group, queries, vecs = None, [], []
    score, ids = np.empty((0, 0)), np.empty((0, 0), object)
    searches: dict[int, list[int]] = {}  # leaf -> queries

    def close() -> Iterator[pa.RecordBatch]:
        at, nth = np.nonzero(score > -np.inf)
        if len(at):
            names = pa.array([queries[i] for i in at], query_type)
            yield pa.RecordBatch.from_arrays([names, pa.array(ids[at, nth].tolist(), ids_type), pa.array(score[at, nth])], ["query", "ids", "score"])

    for b in batches:
        if not b.num_rows:
            continue
        query_type, ids_type = b.column(4).type, b.column(5).type
        key = np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()], 1)
        leaf, is_row = b.column(2).fill_null(-1).to_numpy(), b.column(3).to_numpy(zero_copy_only=False)
        flat = matrix(b.column(6))
        change = (np.diff(key, axis=0) != 0).any(1) | (np.diff(leaf) != 0) | (np.diff(is_row.astype(int)) != 0)
        edges = np.flatnonzero(change) + 1
        for s, e in zip([0, *edges.tolist()], [*edges.tolist(), b.num_rows], strict=True):
            if group != tuple(key[s]):
                if group is not None:
                    yield from close()
                group, queries, vecs, searches = tuple(key[s]), [], np.empty((0, flat.shape[1])), {}
                score, ids = np.empty((0, keep)), np.empty((0, keep), object)
            if not is_row[s]:
                for q, leaves in enumerate(b.column(7).slice(s, e - s).to_pylist(), len(queries)):
                    for x in leaves:
                        searches.setdefault(x, []).append(q)
                queries += b.column(4).slice(s, e - s).to_pylist()
                vecs = np.concatenate([vecs, unit(flat[s:e])])
                score = np.full((len(queries), keep), -np.inf)
                ids = np.empty((len(queries), keep), object)
                continue
            asking = searches.get(int(leaf[s]))
            if not asking:
                continue
            rows = unit(flat[s:e])
            names = np.empty(e - s, object)
            names[:] = b.column(5).slice(s, e - s).to_pylist()
            for i in range(0, len(asking), block):
                own = np.array(asking[i : i + block])
                part = vecs[own] @ rows.T
                for r in np.flatnonzero(part.max(1) >= score[own, -1]):
                    q = own[r]
                    better = np.flatnonzero(part[r] >= score[q, -1])
                    if len(better) > keep:
                        edge = np.partition(part[r][better], len(better) - keep)[len(better) - keep]
                        better = better[part[r][better] >= edge]
                    merged = [(-s_, n) for s_, n in zip(score[q], ids[q], strict=True) if n is not None]
                    merged += [(-part[r, j], names[j]) for j in better]
                    merged.sort()
                    for nth, (s_, n) in enumerate(merged[:keep]):
                        score[q, nth], ids[q, nth] = -s_, n
    if group is not None:
        yield from close()
