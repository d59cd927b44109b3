"""Community detection by synchronous modularity moves."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import Key, names, spread_by
from ..staging import release, stage, stage_counting
from .blocks import FRAME_ROWS, Numbered, key_schema, whole_groups
from .local_walks import key_columns, moves_of
from .multi_source import TASK_EDGES, by_size
from .tables import GRAPH


def _weighted(edges: DataFrame, by: list[str]) -> DataFrame:
    if "weight" not in edges.columns:
        edges = edges.withColumn("weight", F.lit(1.0))
    return edges.groupBy(*by, F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(
        F.sum("weight").cast("double").alias("weight")
    )


def _move_nodes(edges: DataFrame, by: list[str], resolution: float, rounds: int, task_edges: int) -> DataFrame:
    """Move nodes to the neighbouring community of largest gain until few move.

    All moves of a round see the same state. Only half of the nodes, chosen by hash, may move in a
    round, which keeps two neighbours from swapping places for ever. Few are counted over all graphs: the tasks hand on the
    communities after every round of graphs of at most ``task_edges`` edges, and the round to end with is chosen from
    the sums of the moves.
    """
    # the rounds a node may move in are the bits of one number
    limit = task_edges if 0 < rounds < 63 else -1
    strange = F.col("weight").isNull() | F.isnan("weight")
    small, large = by_size(edges, by, limit, limit, barred=strange) if by and limit > 0 else (None, edges)
    inside, moved, nodes = None, [0] * rounds, 0
    if small is not None:
        inside, seen = stage_counting(
            _moved_in_tasks(small, by, resolution, rounds),
            all=F.count(F.lit(1)),
            **{f"r{t}": F.sum(F.shiftright("_moved", t).bitwiseAND(F.lit(1))) for t in range(rounds)},
        )
        moved, nodes = [seen[f"r{t}"] or 0 for t in range(rounds)], seen["all"]
    out, last = None, rounds - 1
    if large is not None:
        out, last = _moved_by_joins(large, by, resolution, rounds, moved, nodes)
    else:
        for turn in range(1, rounds):
            if moved[turn] * 1000 < nodes:
                last = turn
                break
    if inside is None:
        return out
    found = inside.df.select(*by, "node", F.col("_after")[last].alias("community"))
    return found if out is None else found.unionByName(out)


def _may_move(turn: int, node: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(turn), node), F.lit(2)) == 0


def _moved_in_tasks(edges: DataFrame, by: list[str], resolution: float, rounds: int) -> DataFrame:
    """(key, node, _after array of the communities after each round, _moved bits of the rounds a node moved in)."""

    def turns(node: str) -> Column:
        out = F.lit(0).cast("long")
        for t in range(rounds):
            out = out.bitwiseOR(F.shiftleft(_may_move(t, node).cast("long"), t))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in whole_groups((batch.to_pandas() for batch in batches), by, FRAME_ROWS):
            graphs = Numbered(frame, by, split=False)
            allowed = np.empty(len(graphs.ids), np.int64)
            allowed[graphs.a], allowed[graphs.b] = frame["_src"].to_numpy(), frame["_dst"].to_numpy()
            after, moved = moves_of(graphs, allowed, resolution, rounds)
            columns = key_columns(graphs.keys, by, graphs.graph) | {"node": pa.array(graphs.ids)}
            ends = pa.array(np.arange(len(after) + 1) * rounds, pa.int32())
            columns["_after"] = pa.ListArray.from_arrays(ends, pa.array(graphs.ids[after.reshape(-1)]))
            columns["_moved"] = pa.array(moved)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    node = dict(edges.dtypes)["src"]
    schema = f"{key_schema(edges, by)}, node {node}, _after array<{node}>, _moved long"
    held = spread_by(edges.select(*by, "src", "dst", "weight"), by)
    return held.select("*", turns("src").alias("_src"), turns("dst").alias("_dst")).mapInArrow(run, schema)


def _moved_by_joins(
    edges: DataFrame, by: list[str], resolution: float, rounds: int, others: list[int], nodes: int
) -> tuple[DataFrame, int]:
    """The partition and the round it ended with; ``others`` are the moves of each round and ``nodes`` the nodes elsewhere."""
    spark = edges.sparkSession
    arcs = stage(
        edges.select(
            *by,
            "weight",
            F.explode(
                F.when(F.col("src") == F.col("dst"), F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("peer"))))
                .otherwise(
                    F.array(
                        F.struct(F.col("src").alias("node"), F.col("dst").alias("peer")),
                        F.struct(F.col("dst").alias("node"), F.col("src").alias("peer")),
                    )
                )
            ).alias("_e"),
        ).select(*by, "weight", "_e.*")
    )
    # a self-loop stands once in the arcs but adds its weight twice
    mass = F.when(F.col("node") == F.col("peer"), 2.0 * F.col("weight")).otherwise(F.col("weight"))
    degrees = arcs.df.groupBy(*by, "node").agg(F.sum(mass).alias("k"))
    totals = degrees.groupBy(*by).agg(F.sum("k").alias("m2"))
    state = stage(degrees.join(totals, by).withColumn("community", F.col("node")))
    links = arcs.df.where(F.col("node") != F.col("peer"))
    turn = rounds - 1
    for turn in range(rounds):
        volume = stage(state.df.groupBy(*by, "community").agg(F.sum("k").alias("tot"))).df
        own = state.df.select(*by, "node", "k", "m2", F.col("community").alias("own"))
        toward = (
            links.join(state.df.select(*by, F.col("node").alias("peer"), "community"), [*by, "peer"])
            .groupBy(*by, "node", "community")
            .agg(F.sum("weight").alias("_in"))
        )
        stay = state.df.select(*by, "node", "community", F.lit(0.0).alias("_in"))
        options = (
            toward.unionByName(stay)
            .groupBy(*by, "node", "community")
            .agg(F.sum("_in").alias("_in"))
            .join(volume, [*by, "community"])
            .join(own, [*by, "node"])
        )
        here = F.col("community") == F.col("own")
        rest = F.col("tot") - F.when(here, F.col("k")).otherwise(0.0)
        gain = F.col("_in") - F.lit(resolution) * F.col("k") * rest / F.col("m2")
        best = options.withColumn("_gain", gain).groupBy(*by, "node", "k", "m2", "own").agg(
            F.max_by("community", F.struct(F.col("_gain"), -F.col("community"))).alias("_to"),
            F.max("_gain").alias("_best"),
            F.max(F.when(here, F.col("_gain"))).alias("_now"),
        )
        moves = _may_move(turn, "node") & (F.col("_best") > F.col("_now") + 1e-12)
        following, seen = stage_counting(
            best.select(*by, "node", "k", "m2", F.when(moves, F.col("_to")).otherwise(F.col("own")).alias("community"), moves.alias("_moved")),
            moved=F.count_if("_moved"),
            all=F.count(F.lit(1)),
        )
        release(spark, state)
        state = following._replace(df=following.df.drop("_moved"))
        if turn > 0 and (seen["moved"] + others[turn]) * 1000 < seen["all"] + nodes:
            break
    release(spark, arcs)
    return state.df.select(*by, "node", "community"), turn


def community_detection(
    edges: DataFrame, key: Key = GRAPH, resolution: float = 1.0, levels: int = 3, rounds: int = 8, task_edges: int = TASK_EDGES
) -> DataFrame:
    """Partition ``(key, node, community)`` by the two-phase scheme of Blondel et al. (2008): move
    nodes, contract communities to nodes, repeat. Nodes of graphs of at most ``task_edges`` edges move in the tasks, those
    of larger ones by joins, with the same communities."""
    by = names(key)
    current = stage(_weighted(edges, by)).df
    partition = None
    for _ in range(levels):
        moved = _move_nodes(current, by, resolution, rounds, task_edges)
        moved = stage(moved).df
        step = moved.withColumnRenamed("community", "_next")
        if partition is None:
            partition = moved
        else:
            partition = stage(
                partition.join(step.withColumnRenamed("node", "community"), [*by, "community"]).select(
                    *by, "node", F.col("_next").alias("community")
                )
            ).df
        folded = current
        for end in ("src", "dst"):
            folded = folded.join(step.withColumnRenamed("node", end), [*by, end]).withColumn(end, F.col("_next")).drop("_next")
        contracted, seen = stage_counting(_weighted(folded, by), edges=F.count(F.lit(1)))
        before = current.count()
        current = contracted.df
        if seen["edges"] == before:
            break
    return partition
