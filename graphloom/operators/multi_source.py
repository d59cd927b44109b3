"""Hop counts from all nodes by bit-parallel breadth-first search.

Sixty-four sources of a graph share the bits of one number. Graphs of at most ``TASK_EDGES`` edges are searched in the
tasks (``local_paths``), component by component, after one shuffle; a graph of more than ``SHARE_EDGES`` edges goes to several
tasks, each with a share of the sources. For larger graphs a level is a join of the edges with the
frontiers and a bitwise or: n * n / 64 rows for a graph of n nodes, and no matrix. Blocks of sources go in batches of a
bounded number of rows, whose sums per node are added up. Both give the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import FINE, Key, names, spread_by
from ..staging import Staged, release, stage, stage_counting, with_row_index
from .blocks import FRAME_ROWS, Numbered, key_schema, whole_groups
from .local_paths import core_of, hops_of, rows_of
from .local_walks import key_columns, whole_tables
from .tables import GRAPH, endpoints

#: Edges of a graph that a task may hold, and from which on several tasks share its sources.
TASK_EDGES = 1 << 20
SHARE_EDGES = 1 << 17
#: Rows of (block of sources, node) that a batch may reach.
BATCH_ROWS = 50_000_000


def _sweep(
    edges: DataFrame, key: Key, nodes: DataFrame | None, batch_rows: int, at_level: Callable[[int, DataFrame], DataFrame] | None = None
) -> tuple[list[Staged], list[Staged]]:
    """Sums per (key, block, node) of each batch, and what ``at_level`` makes of each level's (key, block, node, front)."""
    by = names(key)
    spark = edges.sparkSession
    loose = edges.where(F.col("src") != F.col("dst")).select(*by, "src", "dst").distinct()
    arcs = stage(endpoints(loose, key).select(*by, "node", "peer"))
    every = endpoints(edges, key).select(*by, "node")
    if nodes is not None:
        every = every.unionByName(nodes.select(*by, "node"))
    numbered = with_row_index(every.distinct(), [*by, "node"])
    block = F.floor(F.col("idx") / 64).alias("block")
    seeds = stage(numbered.select(*by, block, "node", F.expr("shiftleft(1L, int(idx % 64))").alias("bit")))
    of_graph = seeds.df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("block").alias("blocks"))
    rows = of_graph.agg(F.sum(F.col("n").cast("double") * F.col("blocks"))).first()[0] or 0.0
    batches = max(1, int(-(-rows // batch_rows)))
    at = [*by, "block", "node"]
    zero = F.lit(0).cast("long")
    sums, levels = [], []
    for batch in range(batches):
        own = seeds.df.where(F.pmod("block", F.lit(batches)) == batch)
        state = stage(own.select(*at, F.col("bit").alias("seen"), F.col("bit").alias("front"), *(zero.alias(c) for c in ("reached", "total_hops", "eccentricity"))))
        if at_level is not None:
            levels.append(stage(at_level(0, state.df)))
        level = 0
        while True:
            level += 1
            hits = (
                state.df.where("front <> 0")
                .select(*by, "block", F.col("node").alias("peer"), "front")
                .join(arcs.df, [*by, "peer"])
                .select(*at, zero.alias("seen"), F.col("front").alias("hit"), *(zero.alias(c) for c in ("reached", "total_hops", "eccentricity")))
            )
            held = state.df.select(*at, "seen", zero.alias("hit"), "reached", "total_hops", "eccentricity")
            met = held.unionByName(hits).groupBy(*at).agg(
                F.bit_or("seen").alias("seen"), F.bit_or("hit").alias("hit"), F.sum("reached").alias("reached"),
                F.sum("total_hops").alias("total_hops"), F.max("eccentricity").alias("eccentricity"),
            )
            front = F.col("hit").bitwiseAND(F.bitwise_not("seen"))
            count = F.bit_count("front").cast("long")
            moved = met.withColumn("front", front).select(
                *at,
                F.col("seen").bitwiseOR(F.col("front")).alias("seen"),
                "front",
                (F.col("reached") + count).alias("reached"),
                (F.col("total_hops") + count * level).alias("total_hops"),
                F.when(F.col("front") != 0, F.lit(level).cast("long")).otherwise(F.col("eccentricity")).alias("eccentricity"),
            )
            following, seen = stage_counting(moved, open=F.count_if(F.col("front") != 0))
            release(spark, state)
            state = following
            if not seen["open"]:
                break
            if at_level is not None:
                levels.append(stage(at_level(level, state.df)))
        # hops are symmetric: the sources that reach a node are the nodes it reaches
        sums.append(
            stage(state.df.groupBy(*by, "node").agg(F.sum("reached").alias("reached"), F.sum("total_hops").alias("total_hops"), F.max("eccentricity").alias("eccentricity")))
        )
        release(spark, state)
    release(spark, arcs, seeds)
    return sums, levels


def _union(parts: list[Staged]) -> DataFrame:
    out = parts[0].df
    for part in parts[1:]:
        out = out.unionByName(part.df)
    return out


def by_size(
    edges: DataFrame, key: Key, task_edges: int, share_edges: int = SHARE_EDGES, barred: Column | None = None
) -> tuple[DataFrame, DataFrame | None]:
    """Edges of the graphs for the tasks, with ``_share`` and ``_shares``, and the other ones (None if there are none).

    Graphs without a whole key, with a null for a node, or with a ``barred`` edge, are among the others. A share stands for
    ``share_edges`` edges at least, and for a task's part of all edges: many graphs keep the tasks busy without copies.
    """
    by = names(key)
    named = F.lit(True)
    for c in by:
        named = named & F.col(c).isNotNull()
    unfit = F.col("src").isNull() | F.col("dst").isNull()
    nulls = F.count_if(unfit if barred is None else unfit | barred)
    count = edges.groupBy(*by).agg(F.count(F.lit(1)).alias("_m"), nulls.alias("_nulls"))
    fits = named & (F.col("_m") <= task_edges) & (F.col("_nulls") == 0)
    sizes, seen = stage_counting(count.withColumn("_in", fits), out=F.count_if(~F.col("_in")), most=F.max("_m"), all=F.sum("_m"))
    tasks = FINE * int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share_edges = max(share_edges, (seen["all"] or 0) // tasks)
    shares = F.ceil(F.col("_m") / share_edges).cast("long")
    if seen["out"]:
        fit = sizes.df.where("_in")
        flags = fit.select(*by, shares.alias("_shares")) if by else fit.select(F.lit(1).alias("_one"), shares.alias("_shares"))
        both = edges if by else edges.withColumn("_one", F.lit(1))
        small = both.join(flags, by or "_one").drop("_one")
        large = both.join(flags.drop("_shares"), by or "_one", "left_anti").drop("_one")
    else:
        large = None
        if (seen["most"] or 0) <= share_edges or not by:
            small = edges.withColumn("_shares", F.lit(-(-(seen["most"] or 1) // share_edges) if not by else 1).cast("long"))
        else:
            small = edges.join(sizes.df.select(*by, shares.alias("_shares")), by)
    if (seen["most"] or 0) <= share_edges:
        small = small.withColumn("_share", F.lit(0).cast("long"))
    else:
        small = small.withColumn("_share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_shares") - 1)))
    return small, large


def map_shares(edges: DataFrame, solve: Callable[[Numbered], pd.DataFrame], schema: str, key: Key) -> DataFrame:
    """Apply ``solve`` to frames of whole graphs, one of each share."""
    by = [*names(key), "_share", "_shares"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_groups(frames, by, FRAME_ROWS):
            yield solve(Numbered(frame, by))

    types = ", ".join(filter(None, [key_schema(edges, key), schema]))
    return spread_by(edges.select(*by, "src", "dst"), by, times=FINE).mapInPandas(run, types)


def core_in_tasks(edges: DataFrame, key: Key, nodes: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges left when the nodes of degree one are stripped; ``nodes`` adds those without edges."""
    by = names(key)

    def kept_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_tables(batches, by, FRAME_ROWS):
            _, stays = core_of(Numbered(table.select([*by, "src", "dst"]).to_pandas(), by, split=False))
            yield from table.filter(pa.array(stays)).to_batches()

    def cores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_tables(batches, by, FRAME_ROWS):
            graphs = Numbered(table.to_pandas(), by, split=False)
            stays, _ = core_of(graphs)
            columns = key_columns(graphs.keys, by, graphs.graph) | {"node": pa.array(graphs.ids), "_stays": pa.array(stays)}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    ends = edges.select(*by, "src", "dst")
    node = ", ".join(filter(None, [key_schema(edges, key), f"node {dict(edges.dtypes)['src']}, _stays boolean"]))
    left = spread_by(ends, by).mapInArrow(cores, node)
    if nodes is None:
        alive = left.where("_stays").drop("_stays")
    else:
        alive = nodes.join(left.where("not _stays").drop("_stays"), [*by, "node"], "left_anti")
    return alive, spread_by(edges, by).mapInArrow(kept_edges, edges.schema)


SUMS = ("reached", "total_hops", "eccentricity")


def hop_sums(
    edges: DataFrame, key: Key = GRAPH, nodes: DataFrame | None = None, batch_rows: int = BATCH_ROWS, task_edges: int = TASK_EDGES
) -> DataFrame:
    """Per node: nodes reached, summed hops and eccentricity. ``nodes`` adds isolated ones, which reach none."""
    by = names(key)
    edges = stage(edges.select(*by, "src", "dst")).df
    small, large = by_size(edges, key, task_edges)

    def solve(graphs: Numbered) -> pd.DataFrame:
        sums, _ = hops_of(graphs)
        return rows_of(graphs, by, {c: sums[c].to_numpy() for c in SUMS})

    out = map_shares(small, solve, "node long, reached long, total_hops long, eccentricity long", key)
    if large is not None:
        sums, _ = _sweep(large, key, None, batch_rows)
        out = out.unionByName(_union(sums))
    if nodes is not None:
        out = out.unionByName(nodes.select(*by, "node", *(F.lit(0).cast("long").alias(c) for c in SUMS)))
    return out.groupBy(*by, "node").agg(
        F.sum("reached").alias("reached"), F.sum("total_hops").alias("total_hops"), F.max("eccentricity").alias("eccentricity")
    )


def hop_histogram(
    edges: DataFrame, key: Key = GRAPH, nodes: DataFrame | None = None, batch_rows: int = BATCH_ROWS, task_edges: int = TASK_EDGES
) -> DataFrame:
    """Ordered node pairs per hop count, each node's zero hops to itself included."""
    by = names(key)
    edges = stage(edges.select(*by, "src", "dst")).df
    small, large = by_size(edges, key, task_edges)

    def pairs(level: int, state: DataFrame) -> DataFrame:
        counted = state.where("front <> 0").groupBy(*by).agg(F.sum(F.bit_count("front").cast("long")).alias("pairs"))
        return counted.select(*by, F.lit(level).cast("long").alias("hops"), "pairs")

    def solve(graphs: Numbered) -> pd.DataFrame:
        _, table = hops_of(graphs)
        out = graphs.keys[by].iloc[table["graph"].to_numpy()].reset_index(drop=True)
        out["hops"], out["pairs"] = table["hops"], table["pairs"]
        return out

    out = map_shares(small, solve, "hops long, pairs long", key)
    if large is not None:
        sums, levels = _sweep(large, key, None, batch_rows, pairs)
        release(edges.sparkSession, *sums)
        out = out.unionByName(_union(levels))
    if nodes is not None:
        ends = endpoints(edges, key).select(*by, "node")
        lone = nodes.select(*by, "node").distinct().join(ends, [*by, "node"], "left_anti")
        out = out.unionByName(lone.groupBy(*by).agg(F.count(F.lit(1)).alias("pairs")).select(*by, F.lit(0).cast("long").alias("hops"), "pairs"))
    return out.groupBy(*by, "hops").agg(F.sum("pairs").alias("pairs"))
