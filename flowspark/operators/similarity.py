"""Exact nearest neighbours by cosine and Pearson correlation (J-12, J-13, T-01, T-02, G-04).

Vectors are gathered around pivots into blocks of bounded size. A block is first compared with
itself; once its rows have k neighbours there, angles tell which other blocks can hold a nearer one:
all members of a cluster lie within its angular radius of the pivot, so none is nearer to a row than
the row's angle to the pivot less that radius. Only such pairs of blocks are multiplied, and a task
keeps the best k per node, so pairs are never rows. The result is the same as over all block pairs.
Blocks are written once and read by the tasks that pair them; no block is shuffled per pair, and a row
sends k edges however many blocks it meets.

A correlation of series is a cosine as well, but of long vectors. A few Fourier coefficients of each
series bound it from above, so the same search over these short vectors leaves few pairs, and only those
are summed over time.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowspark.functions.time import SLOTS_PER_DAY
from flowspark.operators.series import CHUNK
from flowspark.session import cut_lineage

DIGITS = 9  # weights are rounded here, so ties are broken by id and not by noise
UNIT = 1e-7  # by which a unit vector's length may differ from 1
SLACK = 1e-6  # by which bounds on weights are raised: rounding, and lengths that differ from 1
PIVOTS = 1024  # at most: they and their radii travel to every task
SAMPLE = 8  # rows per pivot that the pivots are chosen from
SIDE_BYTES = 128_000_000  # of vectors that a task holds to pair its own blocks with
ROUNDS = 4  # tasks per partition of the blocks that look for the k best, so that the last ones are short
_EDGE = "src long, dst long, weight double"


def _better(sim: np.ndarray, src: np.ndarray, dst: np.ndarray, least: np.ndarray):
    """Row numbers, dst and weight of a block pair's edges: those of ``least`` or more."""
    r, c = np.nonzero(sim >= least[:, None] - 10.0**-DIGITS)
    w = np.round(sim[r, c], DIGITS)
    kept = (w >= least[r]) & np.isfinite(w) & (src[r] != dst[c])
    return r[kept], dst[c[kept]], w[kept]


def _k_best(parts: list, k: int, least: np.ndarray):
    """The k best of each row, and ``least`` raised to the k-th."""
    r, dst, w = (np.concatenate(a) for a in zip(*parts, strict=True))
    order = np.lexsort((dst, -w, r))
    r, dst, w = r[order], dst[order], w[order]
    nth = np.arange(len(r)) - np.searchsorted(r, r)
    last, least = nth == k - 1, least.copy()
    least[r[last]] = np.maximum(least[r[last]], w[last])
    return (r[nth < k], dst[nth < k], w[nth < k]), least


def _edges(src: np.ndarray, dst: np.ndarray, weight: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64()), pa.array(weight, pa.float64())], ["src", "dst", "weight"])


def _top_k(edges: DataFrame, k: int | None) -> DataFrame:
    if k is None:
        return edges
    w = Window.partitionBy("src").orderBy(F.col("weight").desc(), "dst")
    return edges.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")


@dataclass
class Blocks:
    """Rows (id, unit, least) in blocks around pivots.

    ``rows`` has one row per block: b, c (cluster), ids, flat (the unit vectors one after the other)
    and least (per row: the weight that a neighbour must reach). ``radius`` is each cluster's angular
    radius. The last cluster has no pivot: it holds the rows that are no unit vectors, which meet all
    others. ``sides`` is the number of parts of the vectors that tasks can hold.
    """

    rows: DataFrame
    pivots: np.ndarray
    radius: np.ndarray
    count: int
    sides: int


def _pivots(rows: DataFrame, wanted: int) -> np.ndarray:
    """Pivots from a bounded sample of the rows, moved to the means of those nearest to them."""
    taken = rows.orderBy(F.xxhash64("id"), "id").limit(wanted * SAMPLE).select("unit").collect()
    x = np.array([r.unit for r in taken])
    x = np.unique(x[~_short(x)], axis=0)
    if not len(x):
        return np.eye(1, len(taken[0].unit))
    p = x[:: max(1, len(x) // wanted)][:wanted]
    for _ in range(5):
        near = (x @ p.T).argmax(1)
        sums = np.zeros_like(p)
        np.add.at(sums, near, x)
        length = np.linalg.norm(sums, axis=1)
        p = np.where(length[:, None] > 1e-9, sums / np.maximum(length, 1e-9)[:, None], p)
    used = np.bincount((x @ p.T).argmax(1), minlength=len(p)) >= min(3, len(x))
    return p[used] if used.any() else p[:1]


def _short(x: np.ndarray) -> np.ndarray:
    return np.abs(np.linalg.norm(x, axis=1) - 1) > UNIT


def _angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    length = np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    return np.arccos(np.clip(x / length @ pivots.T, -1, 1))


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def in_blocks(rows: DataFrame, block_rows: int) -> Blocks:
    """Put rows (id, unit, least) into blocks of about ``block_rows`` around pivots."""
    spark = rows.sparkSession
    rows = cut_lineage(rows)
    n = rows.count()
    if n == 0:
        none = rows.select(F.lit(0).alias("b"), F.lit(0).alias("c"), F.array("id").alias("ids"), F.col("unit").alias("flat"), F.array("least").alias("least"))
        return Blocks(none, np.zeros((0, 1)), np.zeros(0), 0, 1)
    spread = math.ceil(math.sqrt(2 * spark.sparkContext.defaultParallelism))
    wanted = max(1, math.ceil(n / block_rows), min(spread, n // 64))
    pivots = _pivots(rows, min(PIVOTS, wanted))

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(1))
                angle = _angles(x, pivots)
                c = angle.argmin(1)
                far = angle[np.arange(len(c)), c]
                c[_short(x)] = len(pivots)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(c, pa.int32()), pa.array(far)], ["id", "unit", "least", "c", "far"])

    placed = rows.mapInArrow(place, "id long, unit array<double>, least double, c int, far double")
    size, radius = np.zeros(len(pivots) + 1, int), np.zeros(len(pivots) + 1)
    for r in placed.groupBy("c").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect():  # one row a pivot
        size[r.c], radius[r.c] = r.n, r.far
    target = max(1, min(block_rows, math.ceil(n / wanted)))
    blocks = np.ceil(size / target).astype(int)
    first = np.concatenate([[0], np.cumsum(blocks)])
    own = spark.createDataFrame([(c, int(first[c]), int(blocks[c])) for c in np.flatnonzero(blocks).tolist()], "c int, first int, blocks int")
    b = (F.col("first") + F.pmod(F.xxhash64("id"), F.col("blocks"))).cast("int")
    member = F.struct("id", "unit", "least")
    packed = placed.join(own, "c").groupBy(b.alias("b"), "c").agg(F.sort_array(F.collect_list(member)).alias("m"))
    packed = packed.select("b", "c", F.col("m.id").alias("ids"), F.flatten("m.unit").alias("flat"), F.col("m.least").alias("least"))
    return Blocks(packed, pivots, radius[:-1], int(first[-1]), math.ceil(n * pivots.shape[1] * 8 / SIDE_BYTES))


def with_needs(blocks: Blocks, k: int | None) -> DataFrame:
    """The same blocks, their vectors as bytes, and need: the clusters that may hold a neighbour of a row.

    For the k best, ``least`` is first raised to the weight of each row's k-th neighbour in its own block.
    """
    pivots, radius = blocks.pivots, blocks.radius

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                ids, least = np.asarray(r.ids, np.int64), np.asarray(r.least, float)
                x = np.asarray(r.flat).reshape(len(ids), -1)
                if k is not None and len(ids) >= k:
                    sim = np.round(x @ x.T, DIGITS)
                    sim[ids[:, None] == ids[None, :]] = -np.inf
                    least = np.maximum(least, np.partition(sim, len(ids) - k, axis=1)[:, len(ids) - k])
                most = np.ones((len(ids), len(pivots) + 1))
                most[:, : len(pivots)] = np.cos(np.maximum(_angles(x, pivots) - radius - 1e-7, 0))
                most[_short(x)] = 1
                need = np.flatnonzero((most >= least[:, None] - SLACK).any(0))
                yield pd.DataFrame({"b": [r.b], "c": [r.c], "ids": [ids], "flat": [x.tobytes()], "least": [least], "need": [need]})

    return blocks.rows.mapInPandas(run, "b int, c int, ids array<long>, flat binary, least array<double>, need array<int>")


def needed_pairs(blocks: Blocks) -> DataFrame:
    """(i, j, there, back), i <= j: the pairs of blocks that must be multiplied, and for whose rows."""
    need = blocks.rows.select(F.col("b").alias("p"), F.explode("need").alias("c")).join(blocks.rows.select(F.col("b").alias("q"), "c"), "c")
    there, back = F.col("p") <= F.col("q"), F.col("p") >= F.col("q")
    return need.groupBy(F.least("p", "q").alias("i"), F.greatest("p", "q").alias("j")).agg(F.max(there).alias("there"), F.max(back).alias("back"))


def multiplied(blocks: Blocks, k: int | None) -> DataFrame:
    """Edges of the blocks and the blocks they need: those of ``least`` or more, of the k best only those of a row.

    For the k best, a task holds some of the blocks and goes through all others once, so each of its rows
    sends k edges, however many blocks there are. Without a k, a task goes through some of the blocks and, for
    each, through one side's blocks; a pair of blocks is multiplied once, for the rows of both.
    """
    cols = ("b", "c", "ids", "flat", "least", "need")
    side = lambda s, some: blocks.rows.select(*[F.col(c).alias(f"{c}_{s}") for c in some])
    meet = F.array_contains("need_i", F.col("c_j"))
    if k is None:
        meet = (F.col("b_i") <= F.col("b_j")) & (meet | F.array_contains("need_j", F.col("c_i")))
        joined = side("i", cols).join(side("j", cols).coalesce(blocks.sides), meet)
    else:  # the left side is read row by row, the right side's partitions are held
        others, some = side("j", cols[:4]).coalesce(1), [side("i", cols).where(F.pmod("b_i", F.lit(ROUNDS)) == r) for r in range(ROUNDS)]
        joined = reduce(DataFrame.union, [others.join(i.hint("shuffle_replicate_nl"), meet) for i in some])
    joined = joined.select("b_i", "ids_i", "flat_i", "least_i", "b_j", "ids_j", "flat_j", *["least_j"] * (k is None))

    def numbers(column: pa.Array, r: int) -> np.ndarray:
        return column[r].values.to_numpy(zero_copy_only=False)

    def vectors(batch: pa.RecordBatch, r: int, s: str):
        ids = numbers(batch.column(f"ids_{s}"), r)
        return ids, np.frombuffer(batch.column(f"flat_{s}")[r].as_buffer()).reshape(len(ids), -1)

    def best(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {}  # by block: its ids, what a row's edges must reach, and the k best so far
        for batch in batches:
            for r, i in enumerate(batch.column("b_i").to_pylist()):
                (ids, x), (other_ids, y) = vectors(batch, r, "i"), vectors(batch, r, "j")
                own_ids, least, parts = held.get(i) or (ids.copy(), numbers(batch.column("least_i"), r).copy(), [])
                found, least = _k_best([*parts, _better(x @ y.T, ids, other_ids, least)], k, least)
                held[i] = own_ids, least, [found]
        for ids, _, parts in held.values():
            yield _edges(ids[parts[0][0]], *parts[0][1:])

    def above(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, (i, j) in enumerate(zip(batch.column("b_i").to_pylist(), batch.column("b_j").to_pylist(), strict=True)):
                (ids, x), (other_ids, y) = vectors(batch, r, "i"), vectors(batch, r, "j")
                sim = x @ y.T
                q, dst, w = _better(sim, ids, other_ids, numbers(batch.column("least_i"), r))
                yield _edges(ids[q], dst, w)
                if i != j:
                    q, dst, w = _better(sim.T, other_ids, ids, numbers(batch.column("least_j"), r))
                    yield _edges(other_ids[q], dst, w)

    return joined.mapInArrow(above if k is None else best, _EDGE)


def search(rows: DataFrame, k: int | None, block_rows: int) -> tuple[DataFrame, Blocks, DataFrame]:
    """Edges (src, dst, weight) of rows (id, unit, least), the blocks, and the pairs of blocks multiplied."""
    blocks = in_blocks(rows, block_rows)
    files = min(blocks.count, max(4 * rows.sparkSession.sparkContext.defaultParallelism, blocks.sides))
    blocks.rows = cut_lineage(with_needs(blocks, k).repartition(max(1, files)))
    return _top_k(multiplied(blocks, k), k), blocks, needed_pairs(blocks)


def unit_rows(vectors: DataFrame, least: float | None = None) -> DataFrame:
    """(id, unit, least): vectors divided by their norm + 1e-8."""
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)) + 1e-8
    # weights are rounded: more than ``least`` is the next weight or more
    bound = F.lit(float("-inf") if least is None else math.nextafter(least, math.inf))
    return vectors.select(F.col("id").cast("long").alias("id"), norm.alias("_n"), "vec").select(
        "id", F.transform("vec", lambda x: x / F.col("_n")).alias("unit"), bound.alias("least")
    )


def cosine_neighbours(vectors: DataFrame, k: int | None = 10, least: float | None = None, block_rows: int = 1024) -> DataFrame:
    """(src, dst, weight) by cosine of ``vec`` per ``id``: the k nearest, or all above ``least``.

    Vectors are divided by their norm + 1e-8. Ties go to the smaller id. Only pairs of blocks
    that the angles allow are multiplied.
    """
    return search(unit_rows(vectors, least), k, block_rows)[0]


def frequencies(steps: int, day: int = SLOTS_PER_DAY) -> list[int]:
    """The frequencies that bound correlations: the slowest four, and the day's first four harmonics."""
    daily = round(steps / day)
    return sorted({f for f in [1, 2, 3, 4, *(daily * h for h in (1, 2, 3, 4))] if 0 < 2 * f < steps})


def short_vectors(d: DataFrame, lo: int, steps: int) -> DataFrame:
    """(id, unit): Fourier coefficients of each standardised series and the length of what they leave out.

    The product of two such vectors is the correlation of the parts kept, plus the most that the
    parts left out can add.
    """
    turn = lambda f: (F.col("step") - lo) * (2 * math.pi * f / steps)
    scale = math.sqrt(2 / steps)
    sums = [F.sum(F.col("x") * wave(turn(f)) * scale) for f in frequencies(steps) for wave in (F.cos, F.sin)]
    d = d.groupBy(F.col("grid_id").cast("long").alias("id")).agg(F.array(*sums).cast("array<double>").alias("c"), F.sum(F.col("x") * F.col("x")).alias("all"))
    kept = F.aggregate("c", F.lit(0.0), lambda s, x: s + x * x)
    return d.select("id", F.concat("c", F.array(F.sqrt(F.greatest(F.col("all") - kept, F.lit(0.0))))).alias("unit"))


def exact_weights(d: DataFrame, blocks: Blocks, pairs: DataFrame, chunk: int) -> DataFrame:
    """(src, dst, weight) of the pairs (src < dst): products of the series, summed over time chunks.

    A task multiplies two blocks of one chunk for the pairs asked for; the chunks of a pair of blocks
    are added up one after the other.
    """
    place = blocks.rows.select("b", F.posexplode("ids").alias("c", "id"))
    cells = d.join(place.withColumnRenamed("id", "grid_id"), "grid_id").select(
        F.floor(F.col("step") / chunk).alias("tc"), "b", F.pmod("step", F.lit(chunk)).cast("int").alias("t"), "c", "x"
    )
    # at most chunk x block_nodes values per group
    packed = cells.groupBy("tc", "b").agg(F.collect_list(F.struct("t", "c", "x")).alias("m"))
    side = lambda s: packed.select("tc", F.col("b").alias(s), F.col("m.t").alias(f"t_{s}"), F.col("m.c").alias(f"c_{s}"), F.col("m.x").alias(f"x_{s}"))
    at = lambda s, b, c: place.select(F.col("id").alias(s), F.col("b").alias(b), F.col("c").alias(c))
    asked = pairs.join(at("src", "i", "p"), "src").join(at("dst", "j", "q"), "dst")
    asked = asked.groupBy("i", "j").agg(F.sort_array(F.collect_list(F.struct("src", "dst", "p", "q"))).alias("a"))
    asked = asked.select("i", "j", *[F.col(f"a.{c}").alias(c) for c in ("src", "dst", "p", "q")])
    joined = asked.join(side("i"), "i").join(side("j"), ["tc", "j"])

    def dense(t, c, x, width):
        m = np.zeros((chunk, width))
        m[np.asarray(t), np.asarray(c)] = np.asarray(x)
        return m

    def partial(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                p, q = np.asarray(r.p), np.asarray(r.q)
                a, b = dense(r.t_i, r.c_i, r.x_i, max(p.max(), max(r.c_i)) + 1), dense(r.t_j, r.c_j, r.x_j, max(q.max(), max(r.c_j)) + 1)
                if 8 * len(p) > a.shape[1] * b.shape[1]:
                    sums = (a.T @ b)[p, q]
                else:
                    sums = np.concatenate([np.einsum("tk,tk->k", a[:, p[s : s + 512]], b[:, q[s : s + 512]]) for s in range(0, len(p), 512)])
                yield pd.DataFrame({"i": [r.i], "j": [r.j], "tc": [r.tc], "src": [r.src], "dst": [r.dst], "sums": [sums]})

    parts = joined.mapInPandas(partial, "i int, j int, tc long, src array<long>, dst array<long>, sums array<double>")

    def total(batches):
        now, src, dst, sums = None, None, None, None
        done = lambda: pd.DataFrame({"src": src, "dst": dst, "weight": sums})
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                if (r.i, r.j) == now:
                    sums = sums + np.asarray(r.sums)
                else:
                    if now is not None:
                        yield done()
                    now, src, dst, sums = (r.i, r.j), np.asarray(r.src), np.asarray(r.dst), np.asarray(r.sums)
        if now is not None:
            yield done()

    return parts.repartition("i", "j").sortWithinPartitions("i", "j", "tc").mapInPandas(total, _EDGE)


def both_ways(weights: DataFrame) -> DataFrame:
    w = F.round("weight", DIGITS)
    ends = F.array(F.struct(F.col("src"), F.col("dst")), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return weights.select(F.explode(ends).alias("e"), w.alias("weight")).select("e.src", "e.dst", "weight")


def pearson_search(
    series: DataFrame, value: str, k: int | None = 15, least: float | None = None, block_nodes: int = 128, chunk: int = CHUNK
) -> tuple[DataFrame, DataFrame]:
    """Edges as ``pearson_neighbours`` gives them, and the pairs (src < dst) whose series were multiplied.

    For the k best, each cell's k best by the bound are summed first; the least of these weights
    is what any other pair's bound must reach.
    """
    bounds = series.agg(F.min("step").alias("lo"), F.max("step").alias("hi")).collect()[0]
    lo, steps = bounds.lo or 0, (bounds.hi or 0) - (bounds.lo or 0) + 1
    stats = series.groupBy("grid_id").agg(
        F.avg(value).alias("_m"), (F.stddev_pop(value) + 1e-8).alias("_s"), F.count("*").alias("_n")
    )
    d = series.select("grid_id", "step", value).join(stats, "grid_id")
    d = d.select("grid_id", "step", ((F.col(value) - F.col("_m")) / F.col("_s") / F.sqrt("_n")).alias("x"))
    d = cut_lineage(d)
    bound = cut_lineage(short_vectors(d, lo, steps))
    ordered = lambda e: e.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    if k is None:
        needed = bound.withColumn("least", F.lit(math.nextafter(least, math.inf) - 2 * 10.0**-DIGITS))
    else:
        likely, blocks, _ = search(bound.withColumn("least", F.lit(float("-inf"))), k, block_nodes)
        known = both_ways(exact_weights(d, blocks, ordered(likely), chunk))
        kth = _top_k(known, k).groupBy("src").agg(F.min("weight").alias("w"), F.count("*").alias("n")).where(F.col("n") == k)
        kth = kth.select(F.col("src").alias("id"), (F.col("w") - 2 * 10.0**-DIGITS).alias("least"))
        needed = bound.join(kth, "id", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
    reached, blocks, _ = search(needed, None, block_nodes)
    pairs = cut_lineage(ordered(reached))
    edges = both_ways(exact_weights(d, blocks, pairs, chunk))
    return (edges.where(F.col("weight") > least) if k is None else _top_k(edges, k)), pairs


def pearson_neighbours(
    series: DataFrame, value: str, k: int | None = 15, least: float | None = None, block_nodes: int = 128, chunk: int = CHUNK
) -> DataFrame:
    """(src, dst, weight) by correlation of the dense series (grid_id, step, value).

    A flat series has correlation 0. The k best are taken before any sign filter.
    """
    return pearson_search(series, value, k, least, block_nodes, chunk)[0]


def positive(edges: DataFrame) -> DataFrame:
    """Drop non-positive edges, after the k best were chosen (T-02)."""
    return edges.where("weight > 0")
