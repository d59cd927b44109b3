"""Graph tables: canonical edges, sizes, degrees and the filters and joins around them.

Edges are ``(key, src, dst[, weight])`` with ``src <= dst``; nodes are ``(key, node[, attrs])``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import Key, attach_stats, names, spread_fine
from ..functions.scalars import density, mapped, sparsity
from ..staging import release, stage, stage_counting

GRAPH = "graph_id"


def canonical(edges: DataFrame, key: Key = GRAPH, src: str = "src", dst: str = "dst") -> DataFrame:
    """Order the two ends of each edge; other columns stay."""
    rest = [c for c in edges.columns if c not in (src, dst)]
    return edges.select(
        *names(key),
        F.least(src, dst).alias("src"),
        F.greatest(src, dst).alias("dst"),
        *[c for c in rest if c not in names(key)],
    )


def dedup_edges(edges: DataFrame, key: Key = GRAPH) -> DataFrame:
    """Unordered edge set."""
    return canonical(edges, key).select(*names(key), "src", "dst").distinct()


def edges_from_table(
    rows: DataFrame, src: str, dst: str, key: Key = GRAPH, weight: Column | None = None
) -> DataFrame:
    """Edge set of a link table; ``weight`` is an aggregate over the parallel links."""
    by = names(key)
    ends = rows.withColumns({"src": F.least(src, dst), "dst": F.greatest(src, dst)})
    ends = spread_fine(ends, *by, "src", "dst")
    if weight is None:
        return ends.select(*by, "src", "dst").distinct()
    return ends.groupBy(*by, "src", "dst").agg(weight.alias("weight"))


def remove_self_loops(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("src") != F.col("dst"))


def endpoints(edges: DataFrame, key: Key = GRAPH) -> DataFrame:
    """Two rows per edge, one per end, with the other end as ``peer``."""
    return edges.select(
        *names(key),
        *[c for c in edges.columns if c not in (*names(key), "src", "dst")],
        F.explode(
            F.array(
                F.struct(F.col("src").alias("node"), F.col("dst").alias("peer")),
                F.struct(F.col("dst").alias("node"), F.col("src").alias("peer")),
            )
        ).alias("_end"),
    ).select("*", "_end.node", "_end.peer").drop("_end")


def degree(edges: DataFrame, key: Key = GRAPH, nodes: DataFrame | None = None) -> DataFrame:
    """Degree per node; a self-loop counts twice. ``nodes`` adds the isolated ones."""
    by = [*names(key), "node"]
    ends = endpoints(edges, key).select(*by, F.lit(1).alias("_one"))
    if nodes is not None:
        ends = ends.unionByName(nodes.select(*by, F.lit(0).alias("_one")))
    return ends.groupBy(*by).agg(F.sum("_one").cast("long").alias("degree"))


def strength(edges: DataFrame, key: Key = GRAPH) -> DataFrame:
    """Weighted degree per node."""
    return endpoints(edges, key).groupBy(*names(key), "node").agg(F.sum("weight").alias("strength"))


def graph_size(edges: DataFrame, key: Key = GRAPH, nodes: DataFrame | None = None) -> DataFrame:
    """Nodes and edges per graph. Each edge adds one half to both its ends."""
    return (
        degree(edges, key, nodes)
        .groupBy(*names(key))
        .agg(
            F.count(F.lit(1)).alias("n"),
            (F.sum("degree") / 2).cast("long").alias("m"),
        )
    )


def average_degree(edges: DataFrame, key: Key = GRAPH) -> DataFrame:
    return (
        degree(edges, key)
        .groupBy(*names(key))
        .agg(
            F.avg("degree").alias("avg_degree"),
            F.stddev_pop("degree").alias("std_degree"),
            F.max("degree").alias("max_degree"),
        )
    )


def average_weighted_degree(edges: DataFrame, key: Key = GRAPH) -> DataFrame:
    return strength(edges, key).groupBy(*names(key)).agg(F.avg("strength").alias("avg_strength"))


def degree_distribution(degrees: DataFrame, key: Key = None) -> DataFrame:
    """Share of nodes per degree, pooled over all graphs of ``key``."""
    by = names(key)
    counts = degrees.groupBy(*by, "degree").agg(F.count(F.lit(1)).alias("n"))
    return attach_stats(counts, key, [F.sum("n").alias("_total")]).select(
        *by, "degree", "n", (F.col("n") / F.col("_total")).alias("p")
    )


def degree_rank(degrees: DataFrame, key: Key = GRAPH, chunk: int = 4096) -> DataFrame:
    """Degrees in falling order with their rank, rebuilt from the counts per degree.

    The counts are far fewer than the nodes, so the running total never sorts a whole graph.
    Long runs of one degree are cut into chunks and spread before they are written out.
    """
    by = names(key)
    counts = degrees.groupBy(*by, "degree").agg(F.count(F.lit(1)).alias("n"))
    higher = Window.partitionBy(*by).orderBy(F.desc("degree")).rowsBetween(Window.unboundedPreceding, -1)
    runs = counts.withColumn("_before", F.coalesce(F.sum("n").over(higher), F.lit(0).cast("long")))
    pieces = runs.withColumn(
        "_lo", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(chunk).cast("long")))
    ).repartition(*by, "degree", "_lo")
    return pieces.select(
        *by,
        F.explode(
            F.sequence(
                F.col("_before") + F.col("_lo") + 1,
                F.col("_before") + F.least(F.col("_lo") + chunk, F.col("n")),
            )
        ).alias("rank"),
        "degree",
    )


def filter_nodes_by_attr(nodes: DataFrame, col: str, value) -> DataFrame:
    return nodes.where(F.col(col) == F.lit(value))


def max_degree_flags(edges: DataFrame, threshold: int, key: Key = GRAPH) -> DataFrame:
    """Largest degree per graph and whether it stays below ``threshold``."""
    by = names(key)
    return (
        degree(edges, key)
        .groupBy(*by)
        .agg(F.max("degree").alias("max_degree"))
        .withColumn("kept", F.col("max_degree") < threshold)
    )


def filter_by_max_degree(
    edges: DataFrame, threshold: int, key: Key = GRAPH
) -> tuple[DataFrame, DataFrame]:
    """Edges of the graphs below the threshold, and the percentage of graphs removed."""
    flags = stage(max_degree_flags(edges, threshold, key)).df
    kept = edges.join(flags.where("kept").select(*names(key)), names(key), "left_semi")
    removed = flags.agg((F.avg(F.when(F.col("kept"), 0.0).otherwise(1.0)) * 100).alias("pct_removed"))
    return kept, removed


def drop_isolated(nodes: DataFrame, edges: DataFrame, key: Key = GRAPH) -> DataFrame:
    ends = endpoints(edges, key).select(*names(key), "node")
    return nodes.join(ends, [*names(key), "node"], "left_semi")


def two_core(edges: DataFrame, key: Key = GRAPH, nodes: DataFrame | None = None, task_edges: int = 1 << 20):
    """Strip the nodes of degree exactly one until none is left; degree-0 nodes stay.

    Graphs of at most ``task_edges`` edges are stripped in the tasks. For larger ones a round of joins removes all leaves at
    once, and only the number of leaves comes to the driver.
    """
    from .multi_source import by_size, core_in_tasks

    by = names(key)
    if not by:
        return _core_by_joins(edges, key, nodes)
    small, large = by_size(stage(edges).df, key, task_edges, max(task_edges, 1))
    if large is None:
        return core_in_tasks(small.select(*edges.columns), key, nodes)
    inside = small.select(*by).distinct()
    # nodes of graphs without edges lose nothing in either form
    of_small, of_large = (None if nodes is None else nodes.join(inside, by, how) for how in ("left_semi", "left_anti"))
    kept_nodes, kept_edges = core_in_tasks(small.select(*edges.columns), key, of_small)
    core_nodes, core_edges = _core_by_joins(large, key, of_large)
    return kept_nodes.unionByName(core_nodes), kept_edges.unionByName(core_edges)


def _core_by_joins(edges: DataFrame, key: Key, nodes: DataFrame | None):
    spark = edges.sparkSession
    by = [*names(key), "node"]
    if nodes is None:
        nodes = endpoints(edges, key).select(*by).distinct()
    alive_edges, alive_nodes = stage(edges), stage(nodes)
    while True:
        leaves, seen = stage_counting(
            degree(alive_edges.df, key).where("degree = 1").select(*by), n=F.count(F.lit(1))
        )
        if not seen["n"]:
            release(spark, leaves)
            return alive_nodes.df, alive_edges.df
        # a null in the key, or for a node, is a value like others: its leaves would never go otherwise
        gone = leaves.df.select(*(F.col(c).alias(f"_{c}") for c in by))

        def without(df: DataFrame, node: str) -> DataFrame:
            same = F.col(node).eqNullSafe(F.col("_node"))
            for c in names(key):
                same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
            return df.join(gone, same, "left_anti")

        kept_edges = stage(without(without(alive_edges.df, "src"), "dst"))
        kept_nodes = stage(without(alive_nodes.df, "node"))
        release(spark, alive_edges, alive_nodes, leaves)
        alive_edges, alive_nodes = kept_edges, kept_nodes


def set_weights(edges: DataFrame, new: DataFrame, key: Key = GRAPH) -> DataFrame:
    """Replace the weights by those in ``new``; edges without a new weight keep theirs."""
    on = [*names(key), "src", "dst"]
    fresh = new.select(*on, F.col("weight").alias("_new"))
    joined = edges.join(fresh, on, "left")
    return joined.withColumn("weight", F.coalesce("_new", "weight")).drop("_new")


def remove_attribute(df: DataFrame, col: str) -> DataFrame:
    return df.drop(col)


def attach_node_attrs(edges: DataFrame, nodes: DataFrame, attrs: list[str], key: Key = GRAPH):
    """Add ``src_<attr>`` and ``dst_<attr>`` for both ends."""
    by = names(key)
    out = edges
    for end in ("src", "dst"):
        side = nodes.select(
            *by, F.col("node").alias(end), *[F.col(a).alias(f"{end}_{a}") for a in attrs]
        )
        out = out.join(side, [*by, end])
    return out


def intersect_nodes(a: DataFrame, b: DataFrame, key: Key = GRAPH) -> DataFrame:
    on = [*names(key), "node"]
    return a.select(*on).distinct().join(b.select(*on), on, "left_semi")


def add_ground_node(
    nodes: DataFrame, edges: DataFrame, x0: float, ground: int = -1, key: Key = GRAPH
) -> tuple[DataFrame, DataFrame]:
    """Virtual node joined with weight 1 to every node right of ``x0``."""
    by = names(key)
    right = nodes.where(F.col("x") > x0)
    links = right.select(
        *by,
        F.lit(ground).cast("long").alias("src"),
        F.col("node").alias("dst"),
        F.lit(1.0).alias("weight"),
    )
    # fixed values: the ground node sits 160 beyond the electrode, at height 250
    place = x0 + (160.0 if x0 > 0 else -160.0 if x0 < 0 else 0.0)
    extra = nodes.select(*by).distinct().select(
        *by,
        F.lit(ground).cast("long").alias("node"),
        F.lit(place).alias("x"),
        F.lit(250.0).alias("y"),
    )
    placed = nodes.select(
        *by, "node", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")
    )
    return placed.unionByName(extra), edges.select(*by, "src", "dst", "weight").unionByName(links)


def add_self_loops(
    nodes: DataFrame, edges: DataFrame, feature: str, above: float = 0.7, key: Key = GRAPH
) -> DataFrame:
    """Self-loop of weight ``feature`` scaled to [min, 1] where that exceeds ``above``."""
    by = names(key)
    stats = attach_stats(nodes, key, [F.min(feature).alias("_lo"), F.max(feature).alias("_hi")])
    lo, hi = F.col("_lo"), F.col("_hi")
    scaled = mapped(F.col(feature), lo, hi, lo, F.lit(1.0))
    loops = stats.select(*by, F.col("node").alias("src"), F.col("node").alias("dst"), scaled.alias("weight"))
    return edges.select(*by, "src", "dst", "weight").unionByName(loops.where(F.col("weight") > above))


def subgraph_density(edges: DataFrame, chosen: DataFrame, key: Key = GRAPH) -> DataFrame:
    """Density of the subgraph spanned by the ``chosen`` nodes."""
    by = names(key)
    inner = edges
    for end in ("src", "dst"):
        inner = inner.join(chosen.select(*by, F.col("node").alias(end)), [*by, end], "left_semi")
    n = chosen.groupBy(*by).agg(F.countDistinct("node").alias("n"))
    m = inner.groupBy(*by).agg(F.count(F.lit(1)).alias("_m"))
    return (
        n.join(m, by, "left")
        .withColumn("m", F.coalesce("_m", F.lit(0).cast("long")))
        .withColumn("density", density(F.col("n"), F.col("m")))
        .drop("_m")
    )


def density_and_sparsity(edges: DataFrame, key: Key = GRAPH) -> DataFrame:
    """Edge density and share of nonzero adjacency entries of loop-free graphs."""
    size = graph_size(edges, key)
    return size.withColumn("density", density(F.col("n"), F.col("m"))).withColumn(
        "sparsity", sparsity(2.0 * F.col("m"), F.col("n"))
    )


def size_percentage(part: DataFrame, whole: DataFrame, key: Key = GRAPH) -> DataFrame:
    """Nodes left in ``part`` as a percentage of ``whole``; ``part`` may have further key columns."""
    by = names(key)
    return part.drop("m").join(whole.select(*by, F.col("n").alias("n_base")), by).withColumn("size_percentage", F.col("n") / F.col("n_base") * 100)


def stationary_distribution(edges: DataFrame, key: Key = GRAPH) -> DataFrame:
    """Share of the total strength: the invariant law of the walk on an undirected graph.

    A self-loop stands once on the diagonal of the adjacency matrix, so it counts once.
    """
    by = names(key)
    once = endpoints(edges, key).withColumn(
        "weight", F.when(F.col("node") == F.col("peer"), F.col("weight") / 2).otherwise(F.col("weight"))
    )
    s = once.groupBy(*by, "node").agg(F.sum("weight").alias("_s"))
    return attach_stats(s, key, [F.sum("_s").alias("_total")]).select(
        *by, "node", F.try_divide("_s", "_total").alias("probability")
    )


def union_corpora(corpora: dict[str, DataFrame]) -> DataFrame:
    """Stack corpora of the same columns under a ``corpus`` label."""
    out = None
    for name, df in corpora.items():
        part = df.withColumn("corpus", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out
