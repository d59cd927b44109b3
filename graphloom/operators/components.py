"""Connected components by label contraction on keyed edge tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import Key, join_stats, names
from ..staging import release, stage, stage_counting
from .blocks import Numbered, key_schema, map_components, smallest_joined
from .local_paths import rows_of
from .multi_source import TASK_EDGES, by_size
from .tables import GRAPH, endpoints

#: Edges that a task contracts at a time.
CONTRACT_ROWS = 1 << 20


def _stars(frame: pd.DataFrame, by: list[str]) -> pd.DataFrame:
    """The frame's edges contracted: every node but the smallest of what they join, linked to that smallest one."""
    graph = frame.groupby(by, sort=False).ngroup().to_numpy() if by else np.zeros(len(frame), np.int64)
    row = np.tile(np.arange(len(frame)), 2)
    owner, ends = np.tile(graph, 2), np.concatenate([frame["src"].to_numpy(), frame["dst"].to_numpy()])
    order = np.lexsort((ends, owner))
    new = np.ones(len(order), bool)
    new[1:] = (owner[order][1:] != owner[order][:-1]) | (ends[order][1:] != ends[order][:-1])
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    node, seen_in = ends[order][new], row[order][new]
    label = smallest_joined(len(node), number[: len(frame)], number[len(frame) :])
    leaf = np.flatnonzero(label != np.arange(len(node)))
    out = frame[by].iloc[seen_in[leaf]].reset_index(drop=True)
    out["src"], out["dst"] = node[label[leaf]], node[leaf]
    return out


def contract_edges(edges: DataFrame, key: Key = GRAPH, rows: int = CONTRACT_ROWS) -> DataFrame:
    """Fewer edges that join the same nodes: each run of ``rows`` edges gives one to every node but the smallest it joins.

    Edges are dealt in ranges of key and source, so that most of a small graph meets in one run and a large one is
    dealt to many tasks. Loops and rows with nulls are left out.
    """
    by = names(key)
    cols = [*by, "src", "dst"]
    loose = edges.select(*cols).where("src <> dst").dropna(subset=cols)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, count = [], 0
        for frame in frames:
            held.append(frame)
            count += len(frame)
            if count >= rows:
                yield _stars(pd.concat(held, ignore_index=True), by)
                held, count = [], 0
        if count:
            yield _stars(pd.concat(held, ignore_index=True), by)

    types = dict(edges.dtypes)
    schema = ", ".join(filter(None, [key_schema(edges, key), f"src {types['src']}, dst {types['dst']}"]))
    return loose.repartitionByRange(*by, "src").mapInPandas(run, schema)


def connected_components(
    edges: DataFrame, key: Key = GRAPH, nodes: DataFrame | None = None, task_edges: int = TASK_EDGES
) -> DataFrame:
    """Smallest node id of the component of every node, for all graphs at once.

    Under a key, graphs of at most ``task_edges`` edges are labelled in the tasks after one shuffle; larger ones, and those
    with nulls, by rounds of joins, with the same rows. ``nodes`` (key, node) adds isolated ones and goes by joins.
    """
    by = names(key)
    if not by or nodes is not None:
        return _components_by_joins(edges, key, nodes)
    given = stage(edges.select(*by, "src", "dst"))
    small, large = by_size(given.df, key, task_edges, max(task_edges, 1))

    def solve(graphs: Numbered) -> Iterator[pd.DataFrame]:
        # nodes of a component stand in order of their id
        yield rows_of(graphs, by, {"component": graphs.ids[graphs.first][graphs.component]})

    node = dict(edges.dtypes)["src"]
    labels = map_components(small, solve, f"{key_schema(edges, key)}, node {node}, component {node}", key)
    if large is not None:
        labels = labels.unionByName(_components_by_joins(large, key, None))
    labels = stage(labels).df
    release(edges.sparkSession, given)
    return labels


def _components_by_joins(edges: DataFrame, key: Key, nodes: DataFrame | None) -> DataFrame:
    """Hooking and shortcutting rounds (the FastSV scheme of Zhang, Azad and Hu, 2020): each node
    offers the grandparent labels around it to itself and to its parent and keeps the smallest.
    The rounds grow with the logarithm of the diameter, not with the diameter, and work on edges that
    were contracted in the tasks first.
    """
    spark = edges.sparkSession
    by = names(key)
    flat = [*by, "node"]
    # the ranges are sampled: the edges are made once
    given = stage(edges.select(*by, "src", "dst"))
    arcs = stage(endpoints(contract_edges(given.df, key), key).select(*by, "node", "peer"))
    loops = given.df.where(~F.coalesce(F.col("src") != F.col("dst"), F.lit(False)))
    ends = arcs.df.select(*flat, "peer").unionByName(endpoints(loops, key).select(*flat, "peer"))
    if nodes is not None:
        ends = ends.unionByName(nodes.select(*flat, F.col("node").alias("peer")))
    # start one step ahead: every node already knows the smallest of its neighbours
    first = stage(ends.groupBy(*flat).agg(F.least(F.col("node"), F.min("peer")).alias("f")))
    state = stage(
        first.df.join(first.df.select(*by, F.col("node").alias("f"), F.col("f").alias("g")), [*by, "f"]).select(
            *flat, "f", "g"
        )
    )
    release(spark, first, given)
    while True:
        around = (
            arcs.df.join(
                state.df.select(*by, F.col("node").alias("peer"), F.col("g").alias("_g")),
                [*by, "peer"],
            )
            .groupBy(*flat)
            .agg(F.min("_g").alias("near"))
        )
        offers = (
            state.df.join(around, flat, "left")
            .withColumn("best", F.least(F.coalesce("near", "g"), "g"))
            .select(
                *by,
                F.explode(
                    F.array(
                        F.struct(F.col("node"), F.col("best").alias("label"), F.col("g").alias("old")),
                        F.struct(F.col("f").alias("node"), F.col("best").alias("label"), F.lit(None).cast("long").alias("old")),
                    )
                ).alias("_o"),
            )
            .groupBy(*by, "_o.node")
            .agg(F.min("_o.label").alias("f"), F.max("_o.old").alias("old"))
        )
        parents = stage(offers)
        jumped = parents.df.join(
            parents.df.select(*by, F.col("node").alias("f"), F.col("f").alias("g")), [*by, "f"]
        ).select(*flat, "f", "g", "old")
        following, seen = stage_counting(jumped, moved=F.count_if(F.col("g") != F.col("old")))
        release(spark, state, parents)
        state = following._replace(df=following.df.drop("old"))
        if not seen["moved"]:
            release(spark, arcs)
            return state.df.select(*flat, F.col("g").alias("component"))


def component_sizes(labels: DataFrame, key: Key = GRAPH) -> DataFrame:
    return labels.groupBy(*names(key), "component").agg(F.count(F.lit(1)).alias("size"))


def component_count(labels: DataFrame, key: Key = GRAPH) -> DataFrame:
    """Components of more than one node per graph, and the size of the largest."""
    return (
        component_sizes(labels, key)
        .where("size > 1")
        .groupBy(*names(key))
        .agg(F.count(F.lit(1)).alias("n_components"), F.max("size").alias("largest"))
    )


def largest_component(labels: DataFrame, key: Key = GRAPH) -> DataFrame:
    """Nodes of the largest component of more than one node; ties go to the smallest label."""
    by = names(key)
    top = (
        component_sizes(labels, key)
        .where("size > 1")
        .groupBy(*by)
        .agg(F.max_by("component", F.struct(F.col("size"), -F.col("component"))).alias("component"))
    )
    return join_stats(labels, top, [*by, "component"], "left_semi").select(*by, "node")


def keep_nodes(edges: DataFrame, nodes: DataFrame, key: Key = GRAPH) -> DataFrame:
    """Edges with both ends among ``nodes``."""
    by = names(key)
    out = edges
    for end in ("src", "dst"):
        out = out.join(nodes.select(*by, F.col("node").alias(end)), [*by, end], "left_semi")
    return out.select(*edges.columns)


def largest_component_edges(edges: DataFrame, key: Key = GRAPH) -> DataFrame:
    """Edges of the largest component. An edge lies inside one component, so one end decides."""
    by = names(key)
    members = largest_component(connected_components(edges, key), key)
    return edges.join(
        members.select(*by, F.col("node").alias("src")), [*by, "src"], "left_semi"
    ).select(*edges.columns)
