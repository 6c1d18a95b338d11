"""Centroid clustering in exact integers, with a vantage-point tree over the centroids.

Components become integers, floor(scale * x), so every distance and mean is exact and the result
depends neither on the order of the rows nor on how they are spread. Each round builds a tree over
the centroids and broadcasts it; it holds ``k`` vectors, whatever the table's size. A node keeps one
centroid, the vantage point, and for each of its two subtrees the range of distances from the
vantage point to the centroids in it. A vector opens nodes best first, by the least distance that
any centroid below can have (triangle inequality), and stops when that is above the best found. The
limit is inclusive and the bounds, which are in floating point, are lowered by a margin: a subtree
that may hold an equally near centroid of smaller number is opened. Distances themselves are 64-bit
integers. Many vectors walk the tree in step, each in its own order.

A round's sums leave a task as one row per centroid and are merged by Spark; the driver sees
k x dimensions numbers.

A vector takes part if it has exactly ``dims`` components and none is null or non-finite; each row
is a vector, so repeated rows count each. Rows without an id are clustered, but are no start. With
fewer than k rows to start from there are as many centroids as rows; without any the result is
empty. Equal centroids: the smaller number gets the vectors, the other stays as it is. Integers
beyond 2**27 would leave the range of exact distances and end the job with an error. Further
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowspark.session import cut_lineage

LARGEST = 1 << 27
MARGIN = 1e-9  # of the distances that make up a bound, above their rounding by far
AT_ONCE = 1 << 20  # entries of the table of open nodes


@dataclass(frozen=True)
class Tree:
    """Node i has the centroid ``point[i]`` and up to two subtrees; -1 where there is none."""

    vectors: np.ndarray  # centroid number x dims
    point: np.ndarray
    children: np.ndarray  # node x 2
    low: np.ndarray  # node x 2: least and greatest distance from the node's point to a centroid below
    high: np.ndarray

    @classmethod
    def build(cls, vectors: np.ndarray) -> Tree:
        point: list[int] = []
        children: list[list[int]] = []
        low: list[list[float]] = []
        high: list[list[float]] = []

        def grow(own: np.ndarray) -> int:
            at = len(point)
            point.append(int(own[0]))
            children.append([-1, -1])
            low.append([0.0, 0.0])
            high.append([0.0, 0.0])
            rest = own[1:]
            if len(rest):
                d = np.sqrt(squared(vectors[rest], vectors[own[0]]).astype(float))
                order = np.argsort(d, kind="stable")
                half = (len(rest) + 1) // 2
                for side, part in enumerate((order[:half], order[half:])):
                    if len(part):
                        low[at][side], high[at][side] = float(d[part].min()), float(d[part].max())
                        children[at][side] = grow(np.sort(rest[part]))
            return at

        grow(np.arange(len(vectors)))
        return cls(vectors, np.array(point), np.array(children), np.array(low), np.array(high))

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Number and squared distance of the nearest centroid of each row, and the distances computed."""
        number, best = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
        step, seen = max(1, AT_ONCE // len(self.point)), 0
        for i in range(0, len(x), step):
            number[i : i + step], best[i : i + step], n = self._walk(x[i : i + step])
            seen += n
        return number, best, seen

    def _walk(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        n, seen = len(x), 0
        open_ = np.full((n, len(self.point)), np.inf)  # bound of every node that waits
        open_[:, 0] = 0.0
        best, number = np.full(n, np.iinfo(np.int64).max), np.full(n, len(self.point))
        going = np.arange(n)
        while len(going):
            node = open_[going].argmin(1)
            bound = open_[going, node]
            live = bound <= np.sqrt(best[going].astype(float))  # inclusive: ties are looked at
            going, node = going[live], node[live]
            if not len(going):
                break
            bound = bound[live]
            open_[going, node] = np.inf
            point = self.point[node]
            d2 = squared(x[going], self.vectors[point])
            seen += len(going)
            nearer = (d2 < best[going]) | ((d2 == best[going]) & (point < number[going]))
            best[going[nearer]], number[going[nearer]] = d2[nearer], point[nearer]
            d = np.sqrt(d2.astype(float))
            for side in (0, 1):
                child = self.children[node, side]
                has = child >= 0
                lo, hi = self.low[node[has], side], self.high[node[has], side]
                least = np.maximum(lo - d[has], d[has] - hi) - MARGIN * (d[has] + hi)
                open_[going[has], child[has]] = np.maximum(least, bound[has])
        return number, best, seen


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return np.einsum("ij,ij->i", d, d)


def whole_vectors(table: DataFrame, dims: int, scale: int, vec_id: str, vector: str) -> DataFrame:
    """The rows that take part: vec_id and ``v``, the integers floor(scale * x)."""
    v = F.col(vector).cast("array<double>")
    sound = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = table.select(F.col(vec_id).alias("vec_id"), v.alias("v")).where(F.col("v").isNotNull() & (F.size("v") == dims) & sound)

    def whole(c: Column) -> Column:
        n = F.floor(c * F.lit(float(scale)))
        in_range = F.abs(c * F.lit(float(scale))) <= LARGEST
        return F.when(in_range, n).otherwise(F.raise_error(F.lit(f"a component is beyond {LARGEST} / {scale}"))).cast("int")

    return rows.select("vec_id", F.transform("v", whole).alias("v"))


def starts(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k rows with the smallest sha256 of ``seed:vec_id``, in that order; rows of one id by their components."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.where(F.col("vec_id").isNotNull()).select(order.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return np.array([r.v for r in first], np.int64)


def matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.int64)


def sums(rows: DataFrame, tree) -> dict[int, tuple[int, list[int]]]:
    """Count and componentwise sum of the vectors nearest to each centroid, empty ones left out."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t: Tree = tree.value
        count, total = np.zeros(len(t.vectors), np.int64), np.zeros(t.vectors.shape, np.int64)
        for b in batches:
            x = matrix(b.column(0))
            number, _, _ = t.nearest(x)
            order = np.argsort(number, kind="stable")
            own, first = np.unique(number[order], return_index=True)
            total[own] += np.add.reduceat(x[order], first, axis=0)
            count += np.bincount(number, minlength=len(count))
        own = np.flatnonzero(count)
        yield pa.RecordBatch.from_pydict({"cluster": pa.array(own, pa.int32()), "n": count[own], "s": pa.array(total[own].tolist(), pa.list_(pa.int64()))})

    parts = rows.select("v").mapInArrow(run, "cluster int, n long, s array<long>")
    each = parts.select("cluster", "n", F.posexplode("s").alias("at", "s"))
    merged = each.groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    found: dict[int, dict[int, tuple[int, int]]] = {}
    for r in merged.collect():  # k x dims rows
        found.setdefault(r.cluster, {})[r["at"]] = (r.n, r.s)
    return {c: (own[0][0], [own[i][1] for i in range(len(own))]) for c, own in found.items()}


def assigned(rows: DataFrame, tree) -> DataFrame:
    """vec_id, cluster and squared distance of every vector."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t: Tree = tree.value
        for b in batches:
            number, best, _ = t.nearest(matrix(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(number, pa.int32()), pa.array(best)], ["vec_id", "cluster", "distance"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.select("vec_id", "v").mapInArrow(run, f"vec_id {kind}, cluster int, distance long")


def cluster(
    table: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, dims: int = 64, scale: int = 1024, vec_id: str = "vec_id", vector: str = "embedding"
) -> tuple[DataFrame, DataFrame]:
    """(vec_id, cluster, distance) of every vector, and (cluster, size, cluster_inertia, centroid) of every centroid.

    A round gives each vector to the nearest centroid, then moves each centroid with vectors to their
    componentwise floor(sum / count). After the last round the vectors are given out once more.
    """
    spark = table.sparkSession
    rows = cut_lineage(whole_vectors(table, dims, scale, vec_id, vector))
    centroids = starts(rows, k, seed)
    found = "cluster int, size long, cluster_inertia long, centroid array<long>"
    if not len(centroids):
        kind = rows.schema["vec_id"].dataType.simpleString()
        return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance long"), spark.createDataFrame([], found)
    for _ in range(rounds):
        tree = spark.sparkContext.broadcast(Tree.build(centroids))
        moved = centroids.copy()
        for c, (n, s) in sums(rows, tree).items():
            moved[c] = [t // n for t in s]
        tree.destroy()
        if (moved == centroids).all():
            break  # all further rounds would give the same
        centroids = moved
    members = cut_lineage(assigned(rows, spark.sparkContext.broadcast(Tree.build(centroids))))
    per = {r.cluster: r for r in members.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("distance").alias("s")).collect()}
    out = [(c, per[c].n if c in per else 0, per[c].s if c in per else 0, v) for c, v in enumerate(centroids.tolist())]
    return members, spark.createDataFrame(out, found)


def digest(centroid: list[int]) -> str:
    return sha256(",".join(map(str, centroid)).encode()).hexdigest()
