"""Triangles, clustering, degree mixing and modularity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import Key, attach_stats, names, spread_by
from ..staging import stage
from .blocks import FRAME_ROWS, Numbered
from .local_paths import rows_of, triangles_of
from .local_walks import whole_tables
from .multi_source import TASK_EDGES, by_size, map_shares
from .tables import GRAPH, degree


def _with_triangles(edges: DataFrame, key: Key, task_edges: int) -> DataFrame:
    """(key, node, degree, triangles) of all nodes. Graphs of at most ``task_edges`` edges are counted in the tasks."""
    by = names(key)
    held = stage(edges.select(*by, "src", "dst")).df
    small, large = by_size(held, key, task_edges if by else -1, max(task_edges, 1))

    def solve(graphs: Numbered) -> pd.DataFrame:
        found, closed = triangles_of(graphs)
        return rows_of(graphs, by, {"degree": found, "triangles": closed})

    node = dict(edges.dtypes)["src"]
    out = map_shares(small, solve, f"node {node}, degree long, triangles long", key)
    if large is None:
        return out
    joined = degree(large, key).join(_triangles_by_joins(large, key), [*by, "node"], "left")
    return out.unionByName(joined.withColumn("triangles", F.coalesce("triangles", F.lit(0)).cast("long")))


def triangles(edges: DataFrame, key: Key = GRAPH, task_edges: int = TASK_EDGES) -> DataFrame:
    """Triangles through each node of a simple graph; nodes on none are absent."""
    return _with_triangles(edges, key, task_edges).where("triangles > 0").drop("degree")


def _triangles_by_joins(edges: DataFrame, key: Key) -> DataFrame:
    """Every edge points from its lower to its higher end by (degree, id). No node then has more than
    sqrt(2m) outgoing edges, however large a hub is, which bounds the wedges a single node forms.
    """
    by = names(key)
    deg = stage(degree(edges, key)).df
    lo = deg.select(*by, F.col("node").alias("src"), F.col("degree").alias("_ds"))
    hi = deg.select(*by, F.col("node").alias("dst"), F.col("degree").alias("_dd"))
    marked = edges.select(*by, "src", "dst").join(lo, [*by, "src"]).join(hi, [*by, "dst"])
    forward = (F.col("_ds") < F.col("_dd")) | (
        (F.col("_ds") == F.col("_dd")) & (F.col("src") < F.col("dst"))
    )
    arcs = marked.select(
        *by,
        F.when(forward, F.col("src")).otherwise(F.col("dst")).alias("u"),
        F.when(forward, F.col("dst")).otherwise(F.col("src")).alias("v"),
    )
    left = arcs.withColumnRenamed("v", "v1")
    right = arcs.withColumnRenamed("v", "v2")
    wedges = left.join(right, [*by, "u"]).where(F.col("v1") < F.col("v2"))
    closing = edges.select(*by, F.col("src").alias("v1"), F.col("dst").alias("v2"))
    closed = wedges.join(closing, [*by, "v1", "v2"])
    return (
        closed.select(*by, F.explode(F.array("u", "v1", "v2")).alias("node"))
        .groupBy(*by, "node")
        .agg(F.count(F.lit(1)).alias("triangles"))
    )


def clustering_coefficient(edges: DataFrame, key: Key = GRAPH, task_edges: int = TASK_EDGES) -> DataFrame:
    """Local clustering 2T / d(d-1), zero below degree two."""
    by = [*names(key), "node"]
    d, t = F.col("degree"), F.col("triangles")
    return _with_triangles(edges, key, task_edges).select(
        *by,
        "degree",
        "triangles",
        F.when(d >= 2, 2.0 * t / (d * (d - 1))).otherwise(F.lit(0.0)).alias("clustering"),
    )


def average_clustering(clustering: DataFrame, key: Key = GRAPH) -> DataFrame:
    return clustering.groupBy(*names(key)).agg(F.avg("clustering").alias("avg_clustering"))


def clustering_by_degree(clustering: DataFrame, key: Key = None) -> DataFrame:
    return clustering.groupBy(*names(key), "degree").agg(
        F.avg("clustering").alias("mean_clustering"),
        F.stddev_pop("clustering").alias("std_clustering"),
    )


def degree_pairs(edges: DataFrame, key: Key = GRAPH, pool: Key = GRAPH, task_edges: int = TASK_EDGES) -> DataFrame:
    """How often an edge joins a node of degree k1 to one of degree k2, both ways round.

    ``pool`` names the columns to keep apart: the graph key for one matrix per graph, a corpus
    column or None to pool graphs. Graphs of at most ``task_edges`` edges are counted in the tasks, larger ones by joins.
    """
    by, kept = names(key), names(pool)
    extra = [c for c in kept if c not in by]
    if not by:
        return _degree_pairs_by_joins(edges, key, pool)
    held = stage(edges.select(*by, *extra, "src", "dst")).df
    small, large = by_size(held, key, task_edges, max(task_edges, 1))
    at = [*kept, "k1", "k2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_tables(batches, by, FRAME_ROWS):
            graphs = Numbered(table.select([*by, "src", "dst"]).to_pandas(), by, split=False)
            count = np.bincount(graphs.a, minlength=len(graphs.ids)) + np.bincount(graphs.b, minlength=len(graphs.ids))
            ends = [pa.array(count[x]) for x in (graphs.a, graphs.b)]
            part = table.select(kept)
            both = [part.append_column("k1", x).append_column("k2", y) for x, y in (ends, ends[::-1])]
            found = pa.concat_tables(both).group_by(at).aggregate([([], "count_all")])
            yield from found.select([*at, "count_all"]).to_batches()

    types = dict(held.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in kept), "k1 long, k2 long, n long"])
    out = spread_by(small.select(*dict.fromkeys([*by, *extra, "src", "dst"])), by).mapInArrow(run, schema)
    if large is not None:
        out = out.unionByName(_degree_pairs_by_joins(large, key, pool))
    return out.groupBy(*at).agg(F.sum("n").alias("n"))


def _degree_pairs_by_joins(edges: DataFrame, key: Key, pool: Key) -> DataFrame:
    by, kept = names(key), names(pool)
    extra = [c for c in kept if c not in by]
    deg = stage(degree(edges, key)).df
    ends = edges.select(*by, *extra, "src", "dst")
    for end, name in (("src", "_a"), ("dst", "_b")):
        side = deg.select(*by, F.col("node").alias(end), F.col("degree").alias(name))
        ends = ends.join(side, [*by, end])
    both = ends.select(
        *kept,
        F.explode(
            F.array(
                F.struct(F.col("_a").alias("k1"), F.col("_b").alias("k2")),
                F.struct(F.col("_b").alias("k1"), F.col("_a").alias("k2")),
            )
        ).alias("_k"),
    ).select(*kept, "_k.*")
    return both.groupBy(*kept, "k1", "k2").agg(F.count(F.lit(1)).alias("n"))


def degree_correlation_matrix(edges: DataFrame, key: Key = GRAPH, pool: Key = GRAPH) -> DataFrame:
    """Nonzero entries P(k1, k2) of the joint degree law across an edge."""
    kept = names(pool)
    return attach_stats(degree_pairs(edges, key, pool), pool, [F.sum("n").alias("_total")]).select(
        *kept, "k1", "k2", (F.col("n") / F.col("_total")).alias("p")
    )


def degree_correlation_dense(matrix: DataFrame, key: Key = GRAPH) -> DataFrame:
    """All entries of the matrices from degree 0 to the largest degree of the whole input."""
    by = names(key)
    top = matrix.agg(F.max("k1").alias("_top"))
    keys = matrix.select(*by).distinct() if by else matrix.select(F.lit(0).alias("_g")).distinct()
    grid = (
        keys.select("*", F.lit(1).alias("_one"))
        .join(F.broadcast(top.select("_top", F.lit(1).alias("_one"))), "_one")
        .withColumn("k1", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_top"))))
        .withColumn("k2", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_top"))))
        .select(*by, "k1", "k2")
    )
    return grid.join(matrix, [*by, "k1", "k2"], "left").select(
        *by, "k1", "k2", F.coalesce("p", F.lit(0.0)).alias("p")
    )


def degree_correlation_function(matrix: DataFrame, key: Key = GRAPH) -> DataFrame:
    """Mean degree of the neighbours of degree-k nodes; degrees without nodes are absent."""
    return matrix.groupBy(*names(key), F.col("k1").alias("degree")).agg(
        (F.sum(F.col("k2") * F.col("p")) / F.sum("p")).alias("knn")
    )


def modularity(edges: DataFrame, partition: DataFrame, key: Key = GRAPH) -> DataFrame:
    """Weighted modularity of a ``(key, node, community)`` partition."""
    by = names(key)
    weighted = edges if "weight" in edges.columns else edges.withColumn("weight", F.lit(1.0))
    side = weighted.select(*by, "src", "dst", "weight")
    for end, name in (("src", "_cs"), ("dst", "_cd")):
        side = side.join(
            partition.select(*by, F.col("node").alias(end), F.col("community").alias(name)),
            [*by, end],
        )
    w = F.col("weight")
    per = (
        side.select(
            *by,
            F.explode(
                F.array(
                    F.struct(
                        F.col("_cs").alias("community"),
                        w.alias("tot"),
                        F.when(F.col("_cs") == F.col("_cd"), 2 * w).otherwise(0.0).alias("inside"),
                    ),
                    F.struct(F.col("_cd").alias("community"), w.alias("tot"), F.lit(0.0).alias("inside")),
                )
            ).alias("_c"),
        )
        .groupBy(*by, "_c.community")
        .agg(F.sum("_c.tot").alias("_tot"), F.sum("_c.inside").alias("_in"))
    )
    m2 = F.col("_m2")
    share = F.col("_tot") / m2
    return (
        attach_stats(per, key, [F.sum("_tot").alias("_m2")])
        .groupBy(*by)
        .agg(F.sum(F.col("_in") / m2 - share * share).alias("modularity"))
    )
