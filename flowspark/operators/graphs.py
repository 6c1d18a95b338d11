"""Cell graphs, their statistics and neighbour features (G-01..G-10, A-20, A-21)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.functions import num
from flowspark.functions.geo import GridSpec
from flowspark.operators import grid as gr
from flowspark.operators.similarity import cosine_neighbours, pearson_neighbours, positive
from flowspark.session import cut_lineage


def spatial_graph(
    cells: DataFrame, g: GridSpec, sigma: float = 1.5, offsets: list[tuple[int, int]] = gr.MOORE, weighted: bool = True
) -> DataFrame:
    """Neighbour edges of the given cells with Gaussian weight (G-01)."""
    n = gr.neighbours(cells.select("grid_id"), g, offsets)
    d2 = F.col("dr") * F.col("dr") + F.col("dc") * F.col("dc")
    w = num.gaussian_decay(d2, sigma) if weighted else F.lit(1.0)
    return n.select(F.col("grid_id").alias("src"), "dst", w.alias("weight"))


def poi_graph(features: DataFrame, columns: list[str], k: int = 10, least: float | None = None) -> DataFrame:
    """Cosine neighbours of the log densities (G-02); ``features`` has one row per cell."""
    v = features.select(F.col("grid_id").alias("id"), F.array(*[F.log1p(c) for c in columns]).alias("vec"))
    return cosine_neighbours(v, k=None if least is not None else k, least=least)


def flow_graph(flow: DataFrame, g: GridSpec, k: int = 15, least: float | None = None) -> DataFrame:
    """Positive correlation neighbours of the inflow (G-03)."""
    e = pearson_neighbours(flow, "inflow", k=None if least is not None else k, least=least)
    return positive(e)


def graph_stats(edges: DataFrame, n_nodes: int) -> DataFrame:
    """Edges, mean degree and weights per graph (A-20)."""
    return edges.groupBy("graph").agg(
        F.lit(n_nodes).alias("n_nodes"), F.count("*").alias("n_edges"),
        (F.count("*") / n_nodes).alias("mean_degree"), F.avg("weight").alias("weight_mean"), F.min("weight").alias("weight_min"),
    )


def adjacency_checks(edges: DataFrame) -> DataFrame:
    """Largest |w_ij - w_ji| and whether every node's diagonal is 1 (A-21). Both directions of
    a pair meet in one aggregation, no self-join."""
    w = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("weight"))), F.lit(0.0))
    pairs = edges.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(
        w(F.col("src") <= F.col("dst")).alias("up"), w(F.col("src") > F.col("dst")).alias("down")
    )
    diagonal = F.col("a") == F.col("b")
    return pairs.agg(
        F.max(F.when(~diagonal, F.abs(F.col("up") - F.col("down")))).alias("max_asymmetry"),
        F.count_if(diagonal & (F.col("up") == 1)).alias("n_unit_diagonal"),
        F.count_if(diagonal).alias("n_diagonal"),
        F.sum(F.when(diagonal, 1).otherwise(F.when(F.col("up") > 0, 1).otherwise(0) + F.when(F.col("down") > 0, 1).otherwise(0))).alias("n_edges"),
    )


# ---- neighbour features -----------------------------------------------------------------


def with_self_loops(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    loops = nodes.select(F.col("grid_id").alias("src"), F.col("grid_id").alias("dst"), F.lit(1.0).alias("weight"))
    return edges.select("src", "dst", "weight").unionByName(loops)


def sym_normalised(edges: DataFrame, weighted: bool = True) -> DataFrame:
    """Weights divided by the root of both degrees."""
    e = edges if weighted else edges.withColumn("weight", F.lit(1.0))
    deg = e.groupBy("src").agg(F.sum("weight").alias("deg"))
    d = e.join(deg, "src").join(
        deg.select(F.col("src").alias("dst"), F.col("deg").alias("deg_d")), "dst", "left"
    )
    w = F.col("weight") / F.sqrt(F.col("deg") * F.coalesce(F.col("deg_d"), F.lit(1.0)))
    return d.select("src", "dst", w.alias("weight"))


def propagate(x: DataFrame, edges: DataFrame, values: list[str]) -> DataFrame:
    """One hop: value of a cell = weighted sum over its neighbours, per step (G-08).

    Rows are placed by step first, so that the sums over neighbours need no second shuffle;
    the fan-out along the edges happens inside the task. The graph is written first: Spark then
    knows its bytes, and broadcasts it or not by its own threshold.
    """
    edges = cut_lineage(edges.select("src", "dst", "weight"))
    d = x.select("step", F.col("grid_id").alias("dst"), *values).repartition("step")
    j = d.join(edges, "dst")
    return j.groupBy("step", "src").agg(*[F.sum(F.col("weight") * F.col(v)).alias(v) for v in values]).withColumnRenamed(
        "src", "grid_id"
    )


def chebyshev(x: DataFrame, edges: DataFrame, value: str, order: int) -> DataFrame:
    """T_0..T_{order-1} of the scaled Laplacian applied to a value (G-09).

    ``edges`` are symmetrically normalised without loops, so the scaled Laplacian is their
    negative. Each round is one aggregation on (step, cell); a row sends its newest term to
    its neighbours and its older terms to itself, so rounds need no join and, placed by step,
    no further shuffle.
    """
    d = x.select("step", "grid_id", F.col(value).alias("t0")).repartition("step")
    e = edges.groupBy("dst").agg(F.collect_list(F.struct("src", "weight")).alias("_to")).withColumnRenamed("dst", "grid_id")
    e = cut_lineage(e)
    for k in range(1, order):
        newest, keep = f"t{k - 1}", [f"t{i}" for i in range(k)]
        scale = 1.0 if k == 1 else 2.0
        own = -F.col(f"t{k - 2}") if k > 1 else F.lit(0.0)
        j = d.join(e, "grid_id", "left")
        to = F.transform(
            F.coalesce("_to", F.array().cast("array<struct<src:bigint,weight:double>>")),
            lambda t: F.struct(
                t["src"].alias("cell"), (t["weight"] * F.col(newest) * -scale).alias("new"),
                *[F.lit(None).cast("double").alias(c) for c in keep],
            ),
        )
        self_row = F.array(F.struct(F.col("grid_id").alias("cell"), own.alias("new"), *[F.col(c).alias(c) for c in keep]))
        sent = j.select("step", F.explode(F.concat(to, self_row)).alias("m"))
        d = sent.groupBy("step", F.col("m.cell").alias("grid_id")).agg(
            *[F.max(f"m.{c}").alias(c) for c in keep], F.sum("m.new").alias(f"t{k}")
        )
    return d


def fuse(graphs: DataFrame, weights: dict[str, float]) -> DataFrame:
    """One edge list for a weighted mean over graphs (G-10): normalised per graph, then summed.
    A single ``propagate`` over it equals the weighted mean of one pass per graph."""
    # few rows, costly to derive, read three times per graph: written once
    graphs = cut_lineage(graphs.select("graph", "src", "dst", "weight"))
    parts = [
        sym_normalised(graphs.where(F.col("graph") == name)).withColumn("weight", F.col("weight") * w)
        for name, w in weights.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
